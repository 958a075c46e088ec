"""Page ingest: content hash, deduplicating upsert, lookups and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sentinelweave.functions.identity import uuid5
from sentinelweave.functions.text import content_hash, strip_text

# Fixed value: marker stored when a document is met again.
DEDUPE_MARK = "same_source_same_normalized_text"
KEY = ["source_code", "content_sha256"]


def distinct_blocks(text: Column) -> Column:
    """Order-preserving paragraph dedupe; ``struct<text,paragraph_count>``."""
    blocks = F.array_distinct(F.filter(F.split(text, "\n\n"), lambda b: b != ""))
    return F.struct(F.array_join(blocks, "\n\n").alias("text"), F.size(blocks).alias("paragraph_count"))


def checked_arrivals(batch: DataFrame, sources: DataFrame) -> DataFrame:
    """``batch`` with the ``reason`` a row is rejected for: its source is not active, or it has no text."""
    active = sources.filter("is_active").select("source_code", F.lit(True).alias("__active"))
    reason = F.when(F.col("__active").isNull(), "unknown_source").when(strip_text(F.coalesce("raw_text", F.lit(""))) == "", "empty_text")
    return batch.join(active, "source_code", "left").withColumn("reason", reason).drop("__active")


def fold_arrivals(checked: DataFrame) -> DataFrame:
    """One row per key of the arrivals without a ``reason``; a stream keeps the same fold as its state.

    Arrivals of a key combine map-side, so a document copied millions of times costs one row per task. The text is
    that of the first arrival; title, date, language and type are the last ones given.
    """
    fresh = checked.filter("reason is null").withColumn("content_sha256", content_hash("raw_text"))
    at = F.col("arrival")

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), at)).alias("n_" + name)

    return fresh.groupBy(*KEY).agg(
        F.max_by("url", at).alias("n_url"), *[last(n) for n in ("title", "published_on", "language", "mime_type")],
        F.min_by("raw_text", at).alias("n_raw_text"), F.min("arrival").alias("first_arrival"), F.count("*").alias("arrivals"),
        F.max("seen_at").alias("last_seen"), F.min("seen_at").alias("first_seen"), F.max_by("metadata", at).alias("n_metadata"),
    )


def merge_arrivals(folded: DataFrame, raw_items: DataFrame) -> DataFrame:
    """The raw items after the arrivals of :func:`fold_arrivals`, with ``action``.

    A new key inserts, a known one refreshes url, metadata and what the arrivals give; a stored text stays.
    """
    stored = raw_items.select(
        "raw_item_id", *KEY, "url", "title", "published_on", "language", "mime_type", "raw_text", "retrieved_at", "metadata", F.lit(True).alias("__old")
    )
    joined = stored.join(folded, KEY, "full_outer")
    old, new = F.col("__old").isNotNull(), F.col("arrivals").isNotNull()
    again = new & (old | (F.col("arrivals") > 1))
    mark = F.create_map(F.lit("last_seen_at"), F.col("last_seen").cast("string"), F.lit("deduplication"), F.lit(DEDUPE_MARK))
    empty = F.create_map().cast("map<string,string>")
    return joined.select(
        F.coalesce("raw_item_id", uuid5(F.concat_ws(":", *KEY))).alias("raw_item_id"), *KEY,
        F.coalesce("n_url", "url").alias("url"),
        *[F.coalesce("n_" + n, n).alias(n) for n in ("title", "published_on", "language", "mime_type")],
        F.coalesce("raw_text", "n_raw_text").alias("raw_text"), F.coalesce("retrieved_at", "first_seen").alias("retrieved_at"),
        _merge_maps(_merge_maps(F.coalesce("metadata", empty), F.coalesce("n_metadata", empty)), F.when(again, mark).otherwise(empty)).alias("metadata"),
        F.when(~new, "kept").when(old, "refreshed").otherwise("inserted").alias("action"),
        F.coalesce("arrivals", F.lit(0).cast("long")).alias("arrivals"),
    )


def upsert_raw_items(batch: DataFrame, raw_items: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge a batch of parsed documents into the raw items.

    ``batch``: source_code, url, title, published_on, language, mime_type, raw_text,
    arrival, seen_at, metadata.  ``raw_items`` carries the same identity columns plus
    raw_item_id, content_sha256 and raw_text.  Returns (table with ``action``, rejected rows
    with ``reason``); the rules are those of :func:`fold_arrivals` and :func:`merge_arrivals`.
    """
    checked = checked_arrivals(batch, sources)
    rejected = checked.filter("reason is not null").select("source_code", "arrival", "reason")
    return merge_arrivals(fold_arrivals(checked), raw_items), rejected


def split_payloads(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items without their text, ``raw_item_id, raw_text``): the payload table keeps one text per item."""
    items = table.withColumns({"text_length": F.length("raw_text"), "text_sha256": F.sha2("raw_text", 256)}).drop("raw_text")
    return items, table.select("raw_item_id", "raw_text")


def _merge_maps(a: Column, b: Column) -> Column:
    """Right-hand keys win, whatever the session's duplicate-key policy is."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def latest_raw_by_url(raw: DataFrame, urls: DataFrame) -> DataFrame:
    """Newest raw item per requested url; trailing slashes do not matter."""
    bare = lambda c: F.rtrim(F.col(c), F.lit("/"))
    wanted = urls.select(F.col("url").alias("requested")).distinct().withColumn("__u", bare("requested"))
    # A stored url matches as written, bare or with one slash.
    stored = raw.filter(F.col("raw_text").isNotNull()).withColumn("__u", bare("url"))
    joined = wanted.join(stored, "__u").filter((F.length("url") - F.length("__u") <= 1) | (F.col("url") == F.col("requested")))
    best = F.max_by(F.struct("raw_item_id", "url", "retrieved_at"), F.struct("retrieved_at", "raw_item_id"))
    return joined.groupBy("requested").agg(best.alias("b")).select("requested", "b.*")


def ingest_summary(table: DataFrame) -> DataFrame:
    """Counts per source after an upsert."""
    return table.groupBy("source_code").agg(
        F.count("*").alias("documents"), F.count_if(F.col("action") == "inserted").alias("inserted"),
        F.count_if(F.col("action") == "refreshed").alias("refreshed"), F.count_if(F.col("title").isNotNull()).alias("titled"),
        F.sum(F.length("raw_text")).alias("text_length"),
    )
