"""Relational load: catalog resolution, versions, snapshot promotion and adoption."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sentinelweave.functions.identity import row_sha256, uuid5
from sentinelweave.operators.gates import yes
from sentinelweave.operators.hydrate import has_links

# Snapshot policy of complete candidates, stored error length, level order of a place name.
SNAPSHOT_POLICY = "document-v1"
PLACE_KEY = ["country_iso2", "admin1", "admin2", "locality", "region", "precision"]
UNRESOLVED_PLACE = "Ubicación no resuelta"


def resolve_entities(entities: DataFrame, catalog: DataFrame, key: Sequence[str] = ("signal_id",)) -> DataFrame:
    """Catalog id of each mention: canonical name, else verbatim, against names and synonyms.

    The catalog becomes one row per distinct lower-case name, so the lookup is an
    equi-join Spark can broadcast when the catalog is small and shuffle when it is not.
    """
    names = catalog.select("id", F.explode(F.array_union(F.array("canonical_name"), "synonyms")).alias("name"))
    lookup = names.groupBy(F.lower("name").alias("__n")).agg(F.min("id").alias("id"))
    candidate = F.coalesce(F.nullif("canonical_name", F.lit("")), F.nullif("verbatim", F.lit("")))
    joined = entities.withColumn("__n", F.lower(candidate)).join(lookup, "__n", "left")
    return joined.select(*key, "id", F.when(F.col("id").isNull(), "unresolved").otherwise("resolved").alias("status"))


def resolve_hosts(hosts: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, unresolved mentions).  Humans are always the one human catalog entry."""
    person = catalog.filter(F.col("scientific_name") == "Homo sapiens").agg(F.min("id").alias("__human"))
    names = catalog.select("id", F.explode(F.array("common_name", "scientific_name")).alias("name")).filter("name is not null")
    lookup = names.groupBy(F.lower("name").alias("__n")).agg(F.min("id").alias("__id"))
    candidate = F.coalesce(F.nullif("canonical_name", F.lit("")), F.nullif("verbatim", F.lit("")))
    human = yes(F.col("host_type") == "human")
    # The human entry is one aggregated row; everything else is an equi-join.
    joined = hosts.withColumn("__n", F.when(~human, F.lower(candidate))).join(lookup, "__n", "left").join(F.broadcast(person))
    out = joined.withColumn("host_id", F.when(human, F.col("__human")).otherwise(F.col("__id"))).drop("__n", "__id", "__human")
    return out.filter("host_id is not null"), out.filter("host_id is null")


def resolve_or_create_locations(locations: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions with location_id, new catalog rows).  Levels compare null-safe."""
    c = catalog.select(F.col("id").alias("__id"), *[F.col(k).alias("c_" + k) for k in PLACE_KEY])
    same = F.lit(True)
    for k in PLACE_KEY:
        same = same & F.col(k).eqNullSafe(F.col("c_" + k))
    known = c.groupBy(*["c_" + k for k in PLACE_KEY]).agg(F.min("__id").alias("__id"))
    mentions = locations.withColumn("precision", F.coalesce(F.nullif("precision", F.lit("")), F.lit("unknown")))
    joined = mentions.join(known, same, "left").drop(*["c_" + k for k in PLACE_KEY])
    fresh_id = uuid5(F.to_json(F.array(*[F.coalesce(k, F.lit("\u0000")) for k in PLACE_KEY])))
    out = joined.withColumn("location_id", F.coalesce("__id", fresh_id))
    levels = ["locality", "admin2", "admin1", "region", "country", "country_iso2"]
    said = [F.nullif(k, F.lit("")) for k in levels]
    new = (
        out.filter("__id is null").groupBy("location_id", *PLACE_KEY).agg(F.min("country").alias("country"))
        .withColumns({
            "display_name": F.coalesce(*said, F.lit(UNRESOLVED_PLACE)),
            "normalization_status": F.when(F.coalesce(*said).isNull(), "unresolved").otherwise("resolved"),
        })
    )
    return out.drop("__id"), new


def next_versions(batch: DataFrame, signals: DataFrame) -> DataFrame:
    """New rows get the next version of their (document, key) and are not current."""
    top = signals.groupBy("raw_item_id", "local_signal_key").agg(F.max("version").alias("__v"))
    out = batch.join(top, ["raw_item_id", "local_signal_key"], "left")
    return out.withColumns({"version": F.coalesce("__v", F.lit(0)) + 1, "is_current": F.lit(False), "supersedes_signal_id": F.lit(None).cast("string")}).drop("__v")


def _keys_digest(key: str) -> list[Column]:
    """Count, distinct count and order-free digest of a key set, combined map-side."""
    return [F.count(key).alias("n"), F.count_distinct(key).alias("d"), F.bit_xor(F.xxhash64(key)).alias("x"), F.sum(F.xxhash64(F.lit(7), key).cast("decimal(38,0)")).alias("y")]


def candidate_membership(runs: DataFrame, payload_keys: DataFrame, signals: DataFrame) -> DataFrame:
    """Whether each run is a complete candidate for its document.

    ``payload_keys``: run_id, raw_item_id, key as listed in the run's output.  Key sets
    are compared by digests, so no set is gathered.
    """
    listed = payload_keys.groupBy("run_id").agg(*_keys_digest("key"), F.min("raw_item_id").alias("bound"))
    stored = signals.groupBy("extraction_run_id").agg(
        *[c.alias("s_" + n) for c, n in zip(_keys_digest("local_signal_key"), ("n", "d", "x", "y"))], F.count_if("is_current").alias("current"), F.min("raw_item_id").alias("lo"), F.max("raw_item_id").alias("hi")
    ).withColumnRenamed("extraction_run_id", "run_id")
    facts = runs.select("run_id", "raw_item_id", "status", "snapshot_policy")
    j = facts.join(listed, "run_id", "left").join(stored, "run_id", "left")
    complete = (
        yes(F.col("n") == F.col("s_n")) & yes(F.col("d") == F.col("n")) & yes(F.col("x") == F.col("s_x")) & yes(F.col("y") == F.col("s_y"))
        & yes(F.col("current") == 0) & yes(F.col("lo") == F.col("raw_item_id")) & yes(F.col("hi") == F.col("raw_item_id"))
    )
    succeeded = yes(F.col("status") == "succeeded") & yes(F.col("snapshot_policy") == SNAPSHOT_POLICY)
    return j.select(
        "run_id", "raw_item_id", succeeded.alias("is_candidate"), yes(F.col("bound") == F.col("raw_item_id")).alias("is_bound"), F.coalesce("n", F.lit(0).cast("long")).alias("listed"),
        complete.alias("is_complete"),
    )


def promotion_plan(requests: DataFrame, membership: DataFrame, signals: DataFrame, heads: DataFrame, promotions: DataFrame, members: DataFrame, relations: DataFrame) -> DataFrame:
    """One status per promotion request; the first failing check wins."""
    h = heads.select("raw_item_id", F.col("run_id").alias("head_run"), "revision")
    m = membership.select("run_id", F.col("raw_item_id").alias("run_doc"), "is_candidate", "is_bound", "listed", "is_complete")
    done = promotions.select("run_id", F.lit(True).alias("__done")).distinct()
    touched = has_links(signals.select("signal_id", "raw_item_id", "extraction_run_id", "is_current"), members, relations)
    linked_now = touched.filter("is_current").groupBy("raw_item_id").agg(F.count("*").alias("__l0"))
    linked_run = touched.groupBy(F.col("extraction_run_id").alias("run_id")).agg(F.count("*").alias("__l1"))
    now = signals.filter("is_current").groupBy("raw_item_id").agg(
        F.count("*").alias("__now"), F.min("extraction_run_id").alias("__r0"), F.max("extraction_run_id").alias("__r1"),
        F.count_if((F.col("review_status") != "pending") | F.col("reviewed_by").isNotNull()).alias("__reviewed"),
    )
    j = requests.join(h, "raw_item_id", "left").join(m, "run_id", "left").join(done, "run_id", "left").join(now, "raw_item_id", "left").join(linked_now, "raw_item_id", "left").join(linked_run, "run_id", "left")
    mixed = (F.col("head_run").isNull() & yes(F.col("__now") > 0)) | (
        F.col("head_run").isNotNull() & ~(yes(F.col("__r0") == F.col("head_run")) & yes(F.col("__r1") == F.col("head_run")))
    )
    status = (
        F.when(F.coalesce("revision", F.lit(0)) != F.col("expected_revision"), "stale_revision")
        .when(~yes(F.col("is_candidate")) | ~yes(F.col("run_doc") == F.col("raw_item_id")) | ~(yes(F.col("is_bound")) | yes(F.col("listed") == 0)), "not_candidate")
        .when(yes(F.col("listed") == 0), "empty_snapshot").when(yes(F.col("__done")), "already_promoted").when(~yes(F.col("is_complete")), "incomplete_membership")
        .when(mixed, "mixed_vigence").when(yes(F.col("__reviewed") > 0), "human_reviewed").when(yes(F.col("__l0") > 0) | yes(F.col("__l1") > 0), "linked").otherwise("promotable")
    )
    return j.select("raw_item_id", "run_id", "expected_revision", F.col("head_run").alias("previous_run_id"), status.alias("status"))


def apply_promotion(signals: DataFrame, heads: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signals with flipped currency, new heads, log rows) for the promotable requests."""
    go = plan.filter("status = 'promotable'").select("raw_item_id", F.col("run_id").alias("new_run"), "previous_run_id", (F.col("expected_revision") + 1).alias("new_revision"))
    s = signals.join(go.select("raw_item_id", "new_run"), "raw_item_id", "left")
    current = F.when(F.col("new_run").isNull(), F.col("is_current")).otherwise(F.col("extraction_run_id").eqNullSafe(F.col("new_run")))
    kept = heads.select("raw_item_id", "run_id", "revision").join(go.select("raw_item_id"), "raw_item_id", "left_anti")
    moved = go.select("raw_item_id", F.col("new_run").alias("run_id"), F.col("new_revision").alias("revision"))
    return s.withColumn("is_current", current).drop("new_run"), kept.unionByName(moved), moved.join(go.select("raw_item_id", "previous_run_id"), "raw_item_id")


def snapshot_heads(promotions: DataFrame) -> DataFrame:
    """Current head per document: the highest revision of its log."""
    return promotions.groupBy("raw_item_id").agg(F.max_by("run_id", "revision").alias("run_id"), F.max("revision").alias("revision"))


def state_fingerprint(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Digest per key over the rows of related tables, for detecting drift.

    Row digests combine without order through a xor of two independent halves plus a
    count, so a key with any number of rows costs one partial aggregate per task.
    """
    out = None
    for name in sorted(tables):
        df = tables[name]
        body = F.struct(*[c for c in df.columns if c != key])
        sha = row_sha256(body, df.select(body.alias("b")).schema["b"].dataType)
        part = df.select(key, sha.alias("h")).groupBy(key).agg(
            F.concat_ws(":", F.count("*").cast("string"), F.hex(F.bit_xor(F.conv(F.substring("h", 1, 15), 16, 10).cast("bigint"))), F.hex(F.bit_xor(F.conv(F.substring("h", 16, 15), 16, 10).cast("bigint"))),
                        F.sum(F.conv(F.substring("h", 31, 15), 16, 10).cast("decimal(38,0)")).cast("string")).alias(name)
        )
        out = part if out is None else out.join(part, key, "full_outer")
    parts = [F.concat(F.lit(name + "="), F.coalesce(name, F.lit("-"))) for name in sorted(tables)]
    return out.select(key, F.sha2(F.concat_ws("|", *parts), 256).alias("state_sha256"))


def adoption_plan(requests: DataFrame, runs: DataFrame, payload_keys: DataFrame, signals: DataFrame, heads: DataFrame, promotions: DataFrame, members: DataFrame, relations: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Status, counts and state fingerprint of legacy runs to be registered unchanged."""
    listed = payload_keys.groupBy("run_id").agg(*_keys_digest("key"))
    mine = signals.filter("is_current").groupBy("raw_item_id").agg(
        *[c.alias("s_" + n) for c, n in zip(_keys_digest("local_signal_key"), ("n", "d", "x", "y"))], F.min("extraction_run_id").alias("r0"), F.max("extraction_run_id").alias("r1")
    )
    total = signals.groupBy(F.col("extraction_run_id").alias("run_id")).agg(F.count("*").alias("run_rows"))
    doc = signals.filter("is_current").select("signal_id", "raw_item_id")
    event_links = doc.join(members.select("signal_id"), "signal_id").groupBy("raw_item_id").agg(F.count("*").alias("event_memberships"))
    ends = relations.select("relation_id", F.explode(F.array("source_id", "target_id")).alias("signal_id"))
    rel_links = doc.join(ends, "signal_id").groupBy("raw_item_id").agg(F.count_distinct("relation_id").alias("relations"))
    j = requests.join(runs.select("run_id", F.col("raw_item_id").alias("run_doc"), "status", "snapshot_policy"), "run_id", "left").join(listed, "run_id", "left").join(total, "run_id", "left")
    j = j.join(mine, "raw_item_id", "left").join(heads.select("raw_item_id", F.lit(True).alias("__head")), "raw_item_id", "left")
    j = j.join(promotions.select("run_id", F.lit(True).alias("__done")).distinct(), "run_id", "left").join(event_links, "raw_item_id", "left").join(rel_links, "raw_item_id", "left").join(fingerprints, "raw_item_id", "left")
    exact = (
        yes(F.col("n") == F.col("s_n")) & yes(F.col("d") == F.col("n")) & yes(F.col("x") == F.col("s_x")) & yes(F.col("y") == F.col("s_y")) & yes(F.col("r0") == F.col("run_id"))
        & yes(F.col("r1") == F.col("run_id")) & yes(F.col("run_rows") == F.col("n"))
    )
    verdict = (
        F.when(yes(F.col("__head")), "head_exists").when(~yes(F.col("run_doc") == F.col("raw_item_id")) | ~yes(F.col("status") == "succeeded") | F.col("snapshot_policy").isNotNull(), "not_legacy_run")
        .when(yes(F.col("__done")), "already_promoted").when(~yes(F.col("n") > 0), "empty_payload").when(~exact, "membership_differs").otherwise("planned")
    )
    zero = F.lit(0).cast("long")
    return j.select("raw_item_id", "run_id", verdict.alias("plan_status"), F.coalesce("s_n", zero).alias("signal_count"), F.coalesce("event_memberships", zero).alias("event_memberships"),
                    F.coalesce("relations", zero).alias("relations"), "state_sha256")


def failed_runs(results: DataFrame) -> DataFrame:
    """Failure rows with their whole error text."""
    return results.filter(F.col("error_text").isNotNull()).withColumn("status", F.lit("failed"))
