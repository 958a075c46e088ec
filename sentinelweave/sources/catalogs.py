"""Catalog merges, corpus planning and artifact verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sentinelweave.functions.dates import iso_date
from sentinelweave.functions.identity import uuid5
from sentinelweave.operators.gates import yes


def upsert_catalog(existing: DataFrame, incoming: DataFrame, key: str, mode: str = "update") -> DataFrame:
    """Merge a catalog: ``update`` lets non-null incoming values win, ``ignore`` only adds new keys."""
    if mode == "ignore":
        added = incoming.join(existing.select(key), key, "left_anti").withColumn("action", F.lit("inserted"))
        return existing.withColumn("action", F.lit("kept")).unionByName(added, allowMissingColumns=True)
    if mode != "update":
        raise ValueError(f"unknown mode {mode}")
    others = [c for c in existing.columns if c != key]
    o = existing.select(key, *[F.col(c).alias("o_" + c) for c in others], F.lit(True).alias("__o"))
    n = incoming.select(key, *[F.col(c).alias("n_" + c) for c in others], F.lit(True).alias("__n"))
    types = dict(existing.dtypes)

    def merged(name: str):
        a, b = F.col("o_" + name), F.col("n_" + name)
        if types[name].startswith("map<"):
            kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
            return F.coalesce(F.map_concat(kept, b), b, a).alias(name)
        return F.coalesce(b, a).alias(name)

    action = F.when(F.col("__o").isNull(), "inserted").when(F.col("__n").isNull(), "kept").otherwise("updated")
    return o.join(n, key, "full_outer").select(key, *[merged(c) for c in others], action.alias("action"))


def plan_corpus(manifest: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with the first reason to skip them or null, paths used twice)."""
    files = artifacts.select("path").distinct().withColumn("__found", F.lit(True))
    p = files.select(F.col("path").alias("prediction"), F.col("__found").alias("__p"))
    g = files.select(F.col("path").alias("gold"), F.col("__found").alias("__g"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = (
        F.when(~yes(F.col("status") == "adjudicated"), "gold_not_adjudicated")
        .when(blank("prediction") | blank("gold"), "missing_paths")
        .when(F.col("__p").isNull(), "prediction_not_found")
        .when(F.col("__g").isNull(), "gold_not_found")
    )
    plan = manifest.join(p, "prediction", "left").join(g, "gold", "left").withColumn("reason", reason).drop("__p", "__g")
    used = plan.filter("reason is null").select(F.explode(F.array(
        F.struct(F.lit("prediction").alias("role"), F.col("prediction").alias("path")), F.struct(F.lit("gold").alias("role"), F.col("gold").alias("path"))
    )).alias("u"))
    return plan, used.groupBy("u.role", "u.path").count().filter("count > 1")


def verify_artifacts(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows that do not hold: hash, presence, blank text, repeated id or path, bad date.

    ``files`` is ``spark.read.format('binaryFile')`` (path, content); contents are hashed
    where they are read and never joined.
    """
    facts = files.select("path", F.sha2("content", 256).alias("__sha"), (F.length(F.trim(F.decode("content", "UTF-8"))) == 0).alias("__blank"))
    ids = manifest.groupBy("document_id").agg(F.count("*").alias("__ids"))
    paths = manifest.groupBy("path").agg(F.count("*").alias("__paths"))
    joined = manifest.join(facts, "path", "left").join(ids, "document_id").join(paths, "path")
    date = F.col("declared_date")
    problems = F.array_compact(F.array(
        F.when(F.col("__sha").isNull(), F.lit("missing_file")),
        F.when(F.col("__sha") != F.lower("sha256"), F.lit("hash_mismatch")),
        F.when(F.col("__blank"), F.lit("blank_text")),
        F.when(F.col("__ids") > 1, F.lit("repeated_id")),
        F.when(F.col("__paths") > 1, F.lit("repeated_path")),
        F.when(date.isNotNull() & iso_date(date).isNull(), F.lit("invalid_date")),
    ))
    return joined.select("document_id", problems.alias("problems")).filter(F.size("problems") > 0)


def artifact_document_id(*binding) -> "F.Column":
    """Deterministic document id of a binding tuple."""
    return uuid5(F.to_json(F.array(*binding)))
