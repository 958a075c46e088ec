"""Structured Streaming entry points; results equal the batch operators on the same rows, however they are cut.

What must be remembered between micro-batches is Spark's own keyed state or an append-only log, so a micro-batch
costs what it brings and not what was stored before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from sentinelweave.operators.ingest import checked_arrivals, fold_arrivals
from sentinelweave.operators.relations import AUDIT, all_or_nothing, checked_batch, match_anchors, relation_batch
from sentinelweave.session import materialised, shared_folder

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ChangeLog:
    """An append-only table: one partition ``batch`` per micro-batch.

    A replayed micro-batch replaces its own partition and nothing else. The newest rows of a key
    are an aggregate over the log; :meth:`compact` writes that aggregate as one partition of another log.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType([*spark.createDataFrame([], schema).schema.fields, T.StructField("batch", T.LongType())])
        # So that a log nobody has written to reads as an empty table.
        spark.createDataFrame([], self.schema).write.mode("append").partitionBy("batch").parquet(self.path)

    def append(self, rows: DataFrame, batch_id: int) -> None:
        out = rows.withColumn("batch", F.lit(batch_id).cast("long")).select(*self.schema.names)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def newest(self, *key: str) -> DataFrame:
        """The last row of every key; combined map-side."""
        rest = [c for c in self.schema.names if c not in (*key, "batch")]
        return self.read().groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, "r.*")

    def compact(self, target: "ChangeLog", newest: DataFrame) -> None:
        """Starts ``target`` with the aggregate ``newest`` of this log; later batches go on from there."""
        target.append(newest, -1)


#: What :func:`stream_matches` logs.
RELATION_ROWS = (
    "source_id string, target_id string, relation string, decision string, merge_allowed boolean, hard_conflict boolean, score double, "
    + ", ".join(f"{name} {kind}" for name, kind in AUDIT.items()) + ", created_at timestamp"
)


def keyed_state(spark: SparkSession) -> None:
    """State of keys on the executors' disks rather than in their heaps, where the session names no other store."""
    if spark.conf.get(STATE_PROVIDER, "").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(STATE_PROVIDER, ROCKS)


def arrivals_schema(documents: DataFrame, sources: DataFrame) -> T.StructType:
    """What :func:`stream_raw_items` logs."""
    return fold_arrivals(checked_arrivals(documents, sources)).schema


def stream_raw_items(documents: DataFrame, log: ChangeLog, sources: DataFrame, checkpoint: str) -> StreamingQuery:
    """Folds a stream of parsed documents by (source, content): a streaming aggregation in update mode.

    Spark keeps the fold of each key in its state store; a micro-batch reads and writes the keys it brings and logs
    their new folds. A repeat may come at any age, so no watermark drops a key. ``ingest.merge_arrivals`` of
    ``log.newest(*ingest.KEY)`` and the stored items is the table of the batch operator.
    """
    keyed_state(log.spark)
    folded = fold_arrivals(checked_arrivals(documents, sources))
    return folded.writeStream.outputMode("update").foreachBatch(log.append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_matches(
    arrivals: DataFrame, index: Callable[[], DataFrame], signals: Callable[[], DataFrame], raw: Callable[[], DataFrame], log: ChangeLog,
    relations: DataFrame, checkpoint: str, k: int = 250,
) -> StreamingQuery:
    """Matches newly current signals against the current table and logs the relations of each micro-batch.

    A micro-batch is checked against the ``relations`` of other producers and the current ids; one that breaks a
    rule is rejected whole by its own write. ``newest_relations`` folds the log.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        current = index()
        found = materialised(relation_batch(match_anchors(batch, current, signals(), raw(), k, few=True)).withColumn("created_at", F.current_timestamp()), "relation-batch")
        log.append(all_or_nothing(checked_batch(found, relations, current.select("signal_id"))), batch_id)

    return arrivals.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_relations(log: ChangeLog) -> DataFrame:
    """One row per pair: its last values and the time it was first stored."""
    pair = ["source_id", "target_id"]
    rest = [c for c in log.schema.names if c not in (*pair, "batch", "created_at")]
    folded = log.read().groupBy(*pair).agg(F.max_by(F.struct(*rest), "batch").alias("r"), F.min("created_at").alias("created_at"))
    return folded.select(*pair, "r.*", "created_at")


def in_parts(rows: DataFrame, folder: str, parts: int, by: str) -> DataFrame:
    """``rows`` as a file stream of ``parts`` micro-batches or more: written once, one file at a time."""
    rows.repartition(parts, by).write.mode("overwrite").parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run_folder(spark: SparkSession) -> str:
    """A fresh folder on the session's shared checkpoint storage."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
