"""Publishable projections, dossiers and relational fan-out of nested signals."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sentinelweave.functions.text import strip_text
from sentinelweave.operators.gates import yes

# Names that must never be published.
SECRET_NAMES = re.compile(r"(raw_text|output_json|password|secret|token|api_?key|database_url|credential)", re.IGNORECASE)


def _names(dtype: T.DataType, prefix: str = "") -> list[str]:
    if isinstance(dtype, T.StructType):
        found = []
        for f in dtype.fields:
            found += [prefix + f.name, *_names(f.dataType, prefix + f.name + ".")]
        return found
    if isinstance(dtype, T.ArrayType):
        return _names(dtype.elementType, prefix)
    return []


def mask_projection(df: DataFrame, allow: Sequence[str]) -> DataFrame:
    """Only allow-listed columns; a secret-like name at any depth is an error."""
    out = df.select(*allow)
    leaked = [n for n in _names(out.schema) if SECRET_NAMES.search(n)]
    if leaked:
        raise ValueError(f"columns may not be published: {leaked}")
    return out


def _informative(c: Column) -> Column:
    return yes(c.isNotNull() & (c != ""))


def fan_out_signals(signals: DataFrame) -> dict[str, DataFrame]:
    """Split nested signals into seven normalised tables.

    Child arrays explode without a shuffle; repeated locations and hosts of one signal
    collapse as an upsert that ignores conflicts would.
    """
    d, g = F.col("diagnostics"), F.col("genomics")
    outcome = lambda c: yes(~c.isin("unknown", "not_applicable"))
    tested = yes(d["test_reported"]) | outcome(d["result"])
    for name in ("test_type", "method", "target", "specimen"):
        tested = tested | _informative(d[name])
    sequenced = yes(g["sequence_reported"]) | outcome(g["test_result"])
    for name in ("lineage", "clade", "accession"):
        sequenced = sequenced | _informative(g[name])

    def child(name: str) -> DataFrame:
        return signals.select("signal_id", F.posexplode(name).alias("seq", "c"))

    locations = child("locations").select(
        "signal_id", "seq", F.coalesce(F.nullif(F.col("c.role"), F.lit("")), F.lit("unknown")).alias("location_role"),
        *[F.col("c." + n).alias(n) for n in ("country_iso2", "country", "admin1", "admin2", "locality", "region", "precision", "confidence")],
    )
    place = ["country_iso2", "admin1", "admin2", "locality", "region", "precision"]
    return {
        "signals": signals.select(
            "signal_id", "raw_item_id", "local_signal_key", "signal_role", "signal_type", "signal_summary",
            "verification_status", "domains", "disease", "pathogen", "event_date", "reference_period", "transmission",
        ),
        "locations": _first(locations, ["signal_id", "location_role", *place]),
        "hosts": child("hosts").select("signal_id", "seq", "c.*"),
        "metrics": child("metrics").select("signal_id", "seq", "c.*"),
        "evidence": child("evidence").select(
            "signal_id", "seq", F.coalesce(F.nullif(F.col("c.type"), F.lit("")), F.lit("source_span")).alias("evidence_type"),
            F.col("c.text").alias("excerpt"), F.col("c.location_in_document").alias("document_locator"), F.col("c.page_number").alias("page_number"),
        ),
        "diagnostics": signals.filter(tested).select(
            "signal_id", yes(d["test_reported"]).alias("test_reported"), d["test_type"].alias("test_type"),
            d["method"].alias("test_method"), d["target"].alias("target"), d["specimen"].alias("specimen"),
            F.coalesce(F.nullif(d["result"], F.lit("")), F.lit("unknown")).alias("test_result"),
        ),
        "genomics": signals.filter(sequenced).select(
            "signal_id", g["accession"].alias("accession"), g["lineage"].alias("lineage"), g["clade"].alias("clade"),
            yes(g["sequence_reported"]).alias("sequence_reported"),
            F.coalesce(F.nullif(g["test_result"], F.lit("")), F.lit("unknown")).alias("test_result"),
        ),
    }


def _first(df: DataFrame, keys: list[str]) -> DataFrame:
    """First row per key by ``seq``; map-side combine, nulls group together."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("seq")).alias("__r")).select(*keys, "__r.*")


def dossier_rows(
    events: DataFrame, members: DataFrame, signals: DataFrame, raw: DataFrame, evidence: DataFrame, relations: DataFrame,
    event_ids: DataFrame | None = None,
) -> DataFrame:
    """The dossier of every event as ordered rows: a header, its cards, their excerpts and the relations inside of it.

    ``section`` is 0 for the header (with the headline counts), 1 for a card, 2 for an excerpt, 3 for a relation; within
    an event rows read by (section, published, signal_id, seq, relation_id), so documents appear in publication order
    and undated ones last.  No array holds an event: a hot event is as many rows as it has entries.  Only the fields
    named here leave the tables.  ``event_ids`` narrows the export.
    """
    chosen = events if event_ids is None else events.join(event_ids.select("event_id").distinct(), "event_id", "left_semi")
    link = members.groupBy("event_id", "signal_id").agg(F.min("match_decision").alias("match_decision"))
    link = link.join(chosen.select("event_id"), "event_id", "left_semi")
    docs = raw.select("raw_item_id", F.col("title").alias("source_title"), F.col("url").alias("source_url"), "published_on")
    cards = (
        link.join(signals.select("signal_id", "raw_item_id", "signal_type", "signal_summary"), "signal_id").join(docs, "raw_item_id", "left")
        .withColumn("published", F.coalesce(F.col("published_on").cast("string"), F.lit("9999"))).drop("published_on")
    )
    excerpts = cards.select("event_id", "published", "signal_id").join(evidence.select("signal_id", "seq", F.col("text").alias("excerpt")), "signal_id")
    a = link.select("event_id", F.col("signal_id").alias("source_id"))
    b = link.select("event_id", F.col("signal_id").alias("target_id"))
    kept = ["relation_id", "source_id", "target_id", "relation", "decision", "score"]
    inner = relations.select(*kept).join(a, "source_id").join(b, ["event_id", "target_id"])

    card_counts = cards.groupBy("event_id").agg(F.count("*").alias("signals"), F.count_distinct("raw_item_id").alias("source_documents"))
    excerpt_counts = excerpts.groupBy("event_id").agg(F.count("*").alias("excerpts"))
    relation_counts = inner.groupBy("event_id").agg(F.count("*").alias("relations"))
    header = chosen.select("event_id", "lifecycle_status", "priority")
    for counts in (card_counts, excerpt_counts, relation_counts):
        header = header.join(counts, "event_id", "left")
    header = header.fillna(0, ["signals", "source_documents", "excerpts", "relations"])

    parts = [header, cards.drop("raw_item_id"), excerpts, inner]
    out = None
    for section, part in enumerate(parts):
        part = part.withColumn("section", F.lit(section))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.select("event_id", "section", "published", "signal_id", "seq", *[n for n in out.columns if n not in ("event_id", "section", "published", "signal_id", "seq")])


DOSSIER_ORDER = ["event_id", "section", "published", "signal_id", "seq", "relation_id"]


def write_dossiers(rows: DataFrame, path: str) -> None:
    """Write dossier rows as JSON lines to a new folder, sorted throughout: files in order of their names read as one list.

    Rows are dealt by ranges of the whole order, so a task holds a range of lines and never an event as a unit.
    """
    ranged = rows.repartitionByRange(*DOSSIER_ORDER).sortWithinPartitions(*DOSSIER_ORDER)
    ranged.write.mode("errorifexists").option("ignoreNullFields", "true").json(path)


def blank(c: Column) -> Column:
    return strip_text(F.coalesce(c, F.lit(""))) == ""
