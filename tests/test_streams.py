"""Streams against the batch operators, whatever the micro-batches are."""

import pytest
from pyspark.sql import functions as F

from sentinelweave.operators import ingest
from sentinelweave.operators.relations import all_or_nothing, audited, batch_errors, checked_batch, upsert_relations
from sentinelweave.plans.queries_review import STORED_ITEMS
from sentinelweave.streaming import streams

ARRIVALS = (
    "source_code string, url string, title string, published_on date, language string, mime_type string, raw_text string, arrival long, seen_at timestamp, metadata map<string,string>"
)


def arrivals(spark):
    texts = ["Fever in town.", "Fever  in town.", "Other news", " \n", None, "Fever in town. "]
    rows = []
    for i in range(60):
        rows.append((["s1", "s2", "off", None][i % 7 % 4], f"u{i}", None if i % 3 else f"t{i}", None, "en" if i % 5 else None, None, texts[i % 6], i, None, {"k": str(i), f"x{i % 4}": "1"} if i % 4 else None))
    return spark.createDataFrame(rows, ARRIVALS).withColumn("seen_at", F.timestamp_seconds(F.col("arrival")))


def rows_of(df):
    return sorted(str(r.asDict(True)) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 5])
def test_raw_items_stream_equals_batch(spark, parts):
    folder = streams.run_folder(spark)
    documents = arrivals(spark)
    sources = spark.createDataFrame([("s1", True), ("s2", True), ("off", False)], "source_code string, is_active boolean")
    stored = spark.createDataFrame([("r1", "s1", None, "old", "old title", None, None, "html", "Fever in town.", None, {"k": "old", "kept": "yes"})], STORED_ITEMS).withColumn(
        "content_sha256", ingest.content_hash("raw_text")
    )
    want, _ = ingest.upsert_raw_items(documents, stored, sources)
    stream = streams.in_parts(documents, folder + "/arrivals", parts, "arrival")
    log = streams.ChangeLog(spark, folder + "/items", streams.arrivals_schema(stream, sources))
    assert log.read().count() == 0
    query = streams.stream_raw_items(stream, log, sources, folder + "/checkpoint")
    query.awaitTermination()
    batches = log.read().select("batch").distinct().count()
    assert batches >= min(parts, 3) and (parts == 1 or len(query.recentProgress) >= 3)
    got = ingest.merge_arrivals(log.newest(*ingest.KEY), stored)
    assert rows_of(got.select(*want.columns)) == rows_of(want)
    # A replayed micro-batch replaces itself; a compacted log reads the same.
    last = log.read().agg(F.max("batch")).first()[0]
    again = streams.materialised(log.read().filter(F.col("batch") == last).drop("batch"), "replay")
    before = log.read().count()
    log.append(again, last)
    assert log.read().count() == before
    short = streams.ChangeLog(spark, folder + "/compacted", again.schema)
    log.compact(short, log.newest(*ingest.KEY))
    assert rows_of(short.newest(*ingest.KEY)) == rows_of(log.newest(*ingest.KEY))


def test_state_holds_the_keys_and_no_more(spark):
    """The state store has one row per key, and a later micro-batch touches only what it brings."""
    folder = streams.run_folder(spark)
    sources = spark.createDataFrame([("s", True)], "source_code string, is_active boolean")
    rows = spark.range(200).select(
        F.lit("s").alias("source_code"), F.lit("u").alias("url"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("date").alias("published_on"), F.lit(None).cast("string").alias("language"),
        F.lit(None).cast("string").alias("mime_type"), F.concat(F.lit("text "), (F.col("id") % 150).cast("string")).alias("raw_text"), F.col("id").alias("arrival"),
        F.timestamp_seconds("id").alias("seen_at"), F.lit(None).cast("map<string,string>").alias("metadata"),
    )
    first, second = folder + "/arrivals", rows.filter("arrival >= 195")
    stream = streams.in_parts(rows.filter("arrival < 195"), first, 1, "arrival")
    log = streams.ChangeLog(spark, folder + "/items", streams.arrivals_schema(stream, sources))
    streams.stream_raw_items(stream, log, sources, folder + "/checkpoint").awaitTermination()
    second.coalesce(1).write.mode("append").parquet(first)
    later = streams.stream_raw_items(spark.readStream.schema(rows.schema).parquet(first), log, sources, folder + "/checkpoint")
    later.awaitTermination()
    state = later.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] == 150 and state["numRowsUpdated"] <= 5
    assert log.newest(*ingest.KEY).agg(F.sum("arrivals")).first()[0] == 200


RELATIONS = "relation_id string, source_id string, target_id string, relation string, decision string, merge_allowed boolean, hard_conflict boolean, score double, producer string, created_at timestamp"


def relation_tables(spark):
    stored = spark.createDataFrame(
        [("r1", "a", "b", "supports", "rejected", False, False, 0.1, "matcher"), ("r0", "a", "b", "refines", "rejected", False, False, 0.2, "matcher"),
         ("r2", "a", "c", "refines", "rejected", False, False, 0.3, "manual"), ("r3", "x", "y", "refines", "rejected", False, False, 0.4, "matcher")],
        RELATIONS.rsplit(",", 1)[0],
    ).withColumn("created_at", F.timestamp_seconds(F.when(F.col("relation_id") == "r1", 5).otherwise(9)))
    return stored, spark.createDataFrame([(c,) for c in "abcd"], "signal_id string")


def batch_of(spark, *rows):
    return spark.createDataFrame(list(rows), "source_id string, target_id string, relation string, decision string, merge_allowed boolean, hard_conflict boolean, score double, gate string, base_decision string")


def test_upsert_relations(spark):
    stored, ids = relation_tables(spark)
    batch = batch_of(spark, ("a", "b", "duplicates", "auto_linked", True, False, 0.8765, "eligible", "auto_linked"), ("c", "d", "supports", "rejected", False, False, None, "eligible", "rejected"))
    table = {r.relation_id if r.action != "inserted" else "new": r for r in upsert_relations(batch, stored, ids).collect()}
    # The oldest row of the pair lives on, the younger one goes, the rest stays.
    assert {k: r.action for k, r in table.items()} == {"r1": "updated", "new": "inserted", "r2": "kept", "r3": "kept"}
    assert (table["r1"].score, table["r1"].raw_score, table["r1"].base_decision, table["r1"].created_at.timestamp() % 60) == (0.877, 0.8765, "auto_linked", 5)
    assert table["new"].shared_event_context_anchors == [] and table["r2"].score == 0.3
    again = upsert_relations(batch, upsert_relations(batch, stored, ids).drop("action"), ids)
    assert sorted(r.action for r in again.collect()) == ["kept", "kept", "updated", "updated"]


@pytest.mark.parametrize("row, reason", [
    (("b", "a", "duplicates", "auto_linked", True, False, 0.5, "eligible", None), "not_canonical"), (("a", "b", "duplicates", "auto_linked", True, False, 0.5, "ineligible", None), "not_eligible"),
    (("a", "b", "likes", "auto_linked", True, False, 0.5, "eligible", None), "invalid_relation"), (("a", "b", "refines", None, True, False, 0.5, "eligible", None), "invalid_decision"),
    (("a", "b", "refines", "rejected", True, False, 1.5, "eligible", None), "invalid_score"), (("a", "c", "refines", "rejected", True, False, 0.5, "eligible", None), "foreign_owner"),
    (("a", "z", "refines", "rejected", True, False, 0.5, "eligible", None), "stale_endpoint"),
])
def test_one_bad_row_rejects_the_batch(spark, row, reason):
    stored, ids = relation_tables(spark)
    good = ("c", "d", "supports", "rejected", False, False, None, "eligible", None)
    batch = batch_of(spark, good, row)
    assert [r.reason for r in batch_errors(batch, stored, ids).collect()] == [reason]
    folder = streams.run_folder(spark)
    with pytest.raises(Exception, match=f"relation batch rejected: {reason}"):
        upsert_relations(batch, stored, ids).write.parquet(folder)
    log = streams.ChangeLog(spark, folder + "-log", audited(batch).schema)
    with pytest.raises(Exception, match="rejected"):
        log.append(all_or_nothing(checked_batch(audited(batch), stored, ids)), 0)
    assert log.read().count() == 0


def test_repeated_pair_rejects_the_batch(spark):
    stored, ids = relation_tables(spark)
    good = ("c", "d", "supports", "rejected", False, False, None, "eligible", None)
    assert {r.reason for r in batch_errors(batch_of(spark, good, good), stored, ids).collect()} == {"duplicate_pair"}
