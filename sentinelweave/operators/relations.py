"""Matching a set of anchors end to end and storing the result as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sentinelweave.functions.identity import uuid5
from sentinelweave.operators.context import context_anchors
from sentinelweave.operators.gates import current_eligible, yes
from sentinelweave.operators.hydrate import candidates, cell_candidates, met_in_cells
from sentinelweave.operators.matching import COMPONENTS, MatchConfig, auto_link_guard, match_features, match_pairs, with_features
from sentinelweave.session import materialised

# Relation classes and decisions a stored relation may carry.
RELATIONS = ["supports", "duplicates", "refines", "contradicts", "possibly_related", "unrelated", "unknown"]
DECISIONS = ["auto_linked", "review_required", "rejected"]
MATCHER_VERSION, CONTEXT_RESOLVER_VERSION = "0.4.8", "0.4.9"
#: What a stored relation tells of its match, with types.
AUDIT = {
    "matcher_version": "string", "gate": "string", "hard_conflict_reason": "string", "information_coverage": "double",
    "component_scores": "struct<" + ",".join(f"{c}:double" for c in COMPONENTS) + ">", "base_decision": "string", "policy_version": "string",
    "context_resolver_version": "string", "auto_link_guard_reason": "string", "auto_link_guard_override_reason": "string",
    "shared_event_context_anchors": "array<string>", "source_event_context_anchors": "array<string>", "target_event_context_anchors": "array<string>",
    "candidate_prefilter": "struct<rank:int,same_pathogen:boolean,same_disease:boolean,days:int>",
}


def match_anchors(
    anchors: DataFrame, index: DataFrame, signals: DataFrame, raw: DataFrame, k: int = 250, cfg: MatchConfig = MatchConfig(), few: bool = False
) -> DataFrame:
    """Rank, score, decide and guard the candidates of every anchor in one job.

    ``index`` holds the narrow ranking columns of all signals, ``signals`` the nested
    ones.  Features and context anchors are computed once per signal, not per pair; with
    ``few`` anchors (a micro-batch), only for the signals that their candidates name.
    """
    live = current_eligible(index)
    some = live if anchors is index else live.join(anchors.select("signal_id").distinct(), "signal_id", "left_semi")
    ends = {"source_id": F.least("anchor_id", "candidate_id"), "target_id": F.greatest("anchor_id", "candidate_id")}
    if few:
        pairs = materialised(candidates(some, live, k).withColumns(ends), "pairs")
        signals = signals.join(pairs.select(F.explode(F.array("source_id", "target_id")).alias("signal_id")).distinct(), "signal_id", "left_semi")
    features = materialised(match_features(signals, cfg).join(context_anchors(signals, raw), "signal_id"), "features")
    side = lambda i, f, x: features.select(F.col("signal_id").alias(i), F.col("mf").alias(f), F.col("context_anchors").alias(x))
    if few:
        met = pairs.join(side("source_id", "l", "source_anchors"), "source_id").join(side("target_id", "r", "target_anchors"), "target_id")
        return auto_link_guard(match_pairs(met, cfg))
    # Anchors and lists get their features before they meet: once per signal and once per row of a list, while a pair is never moved.
    places, lists = cell_candidates(some, live, k)
    met = met_in_cells(places.join(side("anchor_id", "__a", "__aa"), "anchor_id"), lists.join(side("candidate_id", "__c", "__ca"), "candidate_id"), k)
    first = F.col("anchor_id") < F.col("candidate_id")
    either = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    ordered = {"l": either("__a", "__c"), "r": either("__c", "__a"), "source_anchors": either("__aa", "__ca"), "target_anchors": either("__ca", "__aa")}
    return auto_link_guard(match_pairs(met.withColumns(ends | ordered).drop("__a", "__c", "__aa", "__ca"), cfg))


def match_listed_pairs(pairs: DataFrame, signals: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Score a given list of pairs (``source_id``, ``target_id``)."""
    return match_pairs(with_features(pairs, match_features(signals, cfg)), cfg)


def audited(rows: DataFrame) -> DataFrame:
    """``rows`` with every audit column a stored relation carries; null, or an empty list, where nothing is known."""
    have = set(rows.columns)
    out = rows
    if "component_scores" not in have and have >= set(COMPONENTS):
        out = out.withColumn("component_scores", F.struct(*COMPONENTS))
    for name, kind in AUDIT.items():
        column = F.col(name) if name in out.columns else F.lit(None)
        out = out.withColumn(name, F.coalesce(column.cast(kind), F.array().cast(kind)) if kind.startswith("array") else column.cast(kind))
    return out


def relation_batch(matches: DataFrame) -> DataFrame:
    """Distinct eligible pairs of a matching run with their audit columns, ready to be stored.

    A pair met from both of its anchors has one symmetric result; it keeps the candidate rank of the anchor that
    ranks it better, the smaller anchor on a tie.
    """
    out = matches.filter(F.col("gate") == "eligible").withColumns(
        {"matcher_version": F.lit(MATCHER_VERSION), "context_resolver_version": F.lit(CONTEXT_RESOLVER_VERSION)}
    )
    for side in ("source", "target"):
        if f"{side}_anchors" in out.columns:
            out = out.withColumn(f"{side}_event_context_anchors", F.col(f"{side}_anchors"))
    pair = ["source_id", "target_id"]
    own = ["relation", "decision", "merge_allowed", "hard_conflict", "score"]
    if "rank" not in matches.columns:
        return audited(out).select(*pair, *own, *AUDIT)
    out = audited(out.withColumn("candidate_prefilter", F.struct("rank", "same_pathogen", "same_disease", "days")))
    best = F.min_by(F.struct(*own, *AUDIT), F.struct("rank", "anchor_id")).alias("r")
    return out.groupBy(*pair).agg(best).select(*pair, "r.*")


def checked_batch(batch: DataFrame, relations: DataFrame, current: DataFrame, producer: str = "matcher") -> DataFrame:
    """``batch`` with the first ``reason`` a row must not be stored for, null where it may; one pass over the batch."""
    pair = ["source_id", "target_id"]
    flagged = lambda rows, flag, *names: rows.select(*names).distinct().withColumn(flag, F.lit(True))
    foreign = flagged(relations.filter(~F.col("producer").eqNullSafe(F.lit(producer))), "__foreign", *pair, "relation")
    source = flagged(current.withColumnRenamed("signal_id", "source_id"), "__source", "source_id")
    target = flagged(current.withColumnRenamed("signal_id", "target_id"), "__target", "target_id")
    out = (
        batch.withColumn("__copies", F.count("*").over(Window.partitionBy(*pair)))
        .join(foreign, [*pair, "relation"], "left").join(source, "source_id", "left").join(target, "target_id", "left")
    )
    reason = (
        F.when(~yes(F.col("source_id") < F.col("target_id")), "not_canonical")
        .when(~F.col("gate").eqNullSafe(F.lit("eligible")), "not_eligible")
        .when(~yes(F.col("relation").isin(RELATIONS)), "invalid_relation")
        .when(~yes(F.col("decision").isin(DECISIONS)), "invalid_decision")
        .when(~F.coalesce(F.col("score").between(0, 1), F.lit(True)), "invalid_score")
        .when(F.col("__copies") > 1, "duplicate_pair").when(F.col("__foreign").isNotNull(), "foreign_owner")
        .when(F.col("__source").isNull() | F.col("__target").isNull(), "stale_endpoint")
    )
    return out.withColumn("reason", reason).select(*batch.columns, "reason")


def batch_errors(batch: DataFrame, relations: DataFrame, current: DataFrame, producer: str = "matcher") -> DataFrame:
    """``(source_id, target_id, reason)`` of the rows that must not be stored; an empty result means the batch may."""
    return checked_batch(batch, relations, current, producer).filter("reason is not null").select("source_id", "target_id", "reason")


def all_or_nothing(checked: DataFrame, what: str = "relation batch") -> DataFrame:
    """``checked`` without its ``reason``; the job that reads a row with one fails, and its writer commits nothing.

    The check stands in the plan of the rows themselves, so what is written and what was checked cannot part.
    """
    stop = F.raise_error(F.concat(F.lit(f"{what} rejected: "), F.col("reason"))).cast("boolean")
    return checked.filter(F.when(F.col("reason").isNotNull(), stop).otherwise(F.lit(True))).drop("reason")


def upsert_relations(batch: DataFrame, relations: DataFrame, current: DataFrame, producer: str = "matcher") -> DataFrame:
    """The relation table after storing a batch, with an ``action`` per row.

    One row per pair and producer: the oldest id survives, extra rows of the same pair
    go, everything else is kept.  All or nothing: reading the result of a batch with any error fails.
    Scores are stored with three decimals, the full value in ``raw_score``; every audit column of the match is
    stored.  A pair keeps the creation time of its oldest row; a new one gets that of ``batch`` (now where it has none).
    The batch is computed once and staged; one full outer join with the producer's own rows stores it.
    """
    pair = ["source_id", "target_id"]
    shape = ["relation_id", *pair, "relation", "decision", "merge_allowed", "hard_conflict", "score", "raw_score", "producer", "created_at", *AUDIT]
    values = [c for c in shape if c not in (*pair, "producer")]
    batch_at = F.col("created_at") if "created_at" in batch.columns else F.current_timestamp()
    staged = materialised(audited(batch).withColumn("created_at", batch_at), "relation-batch")
    sound = all_or_nothing(checked_batch(staged, relations, current, producer))
    new = sound.withColumns({"relation_id": uuid5(F.concat_ws(":", F.lit(producer), *pair)), "raw_score": F.col("score").cast("double"),
                             "score": F.col("score").cast("decimal(4,3)").cast("double")}).select(*pair, F.struct(*values).alias("n"))
    raw = F.col("raw_score") if "raw_score" in relations.columns else F.col("score")
    old = audited(relations).withColumns({"raw_score": raw.cast("double"), "score": F.col("score").cast("double")}).select(*shape)
    mine = F.col("producer").eqNullSafe(F.lit(producer))
    age = Window.partitionBy(*pair).orderBy("created_at", "relation_id")
    own = old.filter(mine).withColumn("place", F.row_number().over(age)).select(*pair, "place", F.struct(*values).alias("o"))
    joined = own.join(new, pair, "full_outer").filter(F.col("n").isNull() | F.coalesce(F.col("place") == 1, F.lit(True)))
    lasting = ("relation_id", "created_at")
    picked = [
        (F.coalesce(f"o.{c}", f"n.{c}") if c in lasting else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).alias(c) for c in values
    ]
    action = F.when(F.col("n").isNull(), "kept").when(F.col("o").isNull(), "inserted").otherwise("updated")
    stored = joined.select(*pair, *picked, F.lit(producer).alias("producer"), action.alias("action"))
    return stored.select(*shape, "action").unionByName(old.filter(~mine).withColumn("action", F.lit("kept")))
