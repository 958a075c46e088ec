"""Membership plans for stored relations and their guarded application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sentinelweave.operators.cohorts import CREATING_RELATIONS, MANUAL_DECISIONS, OPEN_LIFECYCLES, approved
from sentinelweave.operators.gates import yes
from sentinelweave.operators.relations import all_or_nothing

# Memberships that count as positive, actions of a plan, closed lifecycles.
POSITIVE_DECISIONS = ["auto_linked", "manual_linked"]
ACTIONS = ["no_event_change", "create_event", "attach_target_to_event", "attach_source_to_event", "already_same_event", "manual_review"]
TERMINAL_LIFECYCLES = ["resolved", "closed"]


def _sides(memberships: DataFrame) -> DataFrame:
    """Per signal: number of positive events, the only one, and whether other decisions exist."""
    positive = yes(F.col("match_decision").isin(POSITIVE_DECISIONS))
    event = F.when(positive, F.col("event_id"))
    return memberships.groupBy("signal_id").agg(
        F.min(event).alias("lo"), F.max(event).alias("hi"), F.count_if(~positive).alias("other")
    )


def assignment_plan(relations: DataFrame, memberships: DataFrame, guarded: bool = True) -> DataFrame:
    """One plan per relation: action, reason, event, whether it writes or needs review.

    A side has several events when its smallest and largest positive event differ, so no
    list of memberships is gathered.  A contract violation is returned as ``error``.
    With ``guarded`` any non-positive membership turns a write, or "already the same",
    into a manual review.
    """
    sides = _sides(memberships)
    s = sides.select(F.col("signal_id").alias("source_id"), F.col("lo").alias("s_lo"), F.col("hi").alias("s_hi"), F.col("other").alias("s_other"))
    t = sides.select(F.col("signal_id").alias("target_id"), F.col("lo").alias("t_lo"), F.col("hi").alias("t_hi"), F.col("other").alias("t_other"))
    j = relations.join(s, "source_id", "left").join(t, "target_id", "left")
    auto = yes(F.col("decision") == "auto_linked")
    several = yes(F.col("s_lo") != F.col("s_hi")) | yes(F.col("t_lo") != F.col("t_hi"))
    has_s, has_t = F.col("s_lo").isNotNull(), F.col("t_lo").isNotNull()

    def plan(action: str, reason: str, event: Column | None = None, write: bool = False, review: bool = False) -> Column:
        return F.struct(
            F.lit(action).alias("action"), F.lit(reason).alias("reason"), (event if event is not None else F.lit(None).cast("string")).alias("event_id"),
            F.lit(write).alias("write_allowed"), F.lit(review).alias("requires_review"),
        )

    chain = (
        F.when(~yes(F.col("gate") == "eligible"), plan("no_event_change", "matcher_pair_ineligible"))
        .when(yes(F.col("hard_conflict")), plan("no_event_change", "hard_conflict"))
        .when(yes(F.col("decision") == "review_required"), plan("no_event_change", "matcher_requires_review", review=True))
        .when(~auto, plan("no_event_change", "matcher_rejected"))
        .when(several, plan("manual_review", "signal_has_multiple_existing_events", review=True))
        .when(has_s & has_t & (F.col("s_lo") == F.col("t_lo")), plan("already_same_event", "both_signals_already_linked", F.col("s_lo")))
        .when(has_s & has_t, plan("manual_review", "signals_belong_to_distinct_events", review=True))
        .when(has_s, plan("attach_target_to_event", "source_already_has_event", F.col("s_lo"), write=True))
        .when(has_t, plan("attach_source_to_event", "target_already_has_event", F.col("t_lo"), write=True))
        .otherwise(plan("create_event", "auto_linked_pair_without_event", write=True))
    )
    live = yes(F.col("gate") == "eligible") & ~yes(F.col("hard_conflict")) & auto
    error = (
        F.when(F.col("source_id") == F.col("target_id"), "self_pair")
        .when(live & ~yes(F.col("merge_allowed")), "auto_linked_without_merge")
        .when(live & ~yes(F.col("relation").isin(CREATING_RELATIONS)), "auto_linked_with_invalid_relation")
    )
    out = j.withColumns({"__p": chain, "error": error, "nonpositive": F.coalesce("s_other", F.lit(0)) + F.coalesce("t_other", F.lit(0)) > 0})
    out = out.select(*relations.columns, "__p.*", "error", "nonpositive")
    return nonpositive_guard(out) if guarded else out


def _to_review(plans: DataFrame, hit: Column, reason: Column, keep_event: bool) -> DataFrame:
    marked = plans.withColumn("__hit", hit)
    h = F.col("__hit")
    return marked.withColumns(
        {
            "reason": F.when(h, reason).otherwise(F.col("reason")),
            "action": F.when(h, "manual_review").otherwise(F.col("action")),
            "event_id": F.col("event_id") if keep_event else F.when(~h, F.col("event_id")),
            "write_allowed": F.col("write_allowed") & ~h,
            "requires_review": F.col("requires_review") | h,
        }
    ).drop("__hit")


def nonpositive_guard(plans: DataFrame) -> DataFrame:
    """Negative, pending or unknown memberships of either side ask for a human."""
    hit = F.col("nonpositive") & (F.col("write_allowed") | (F.col("action") == "already_same_event"))
    return _to_review(plans, hit, F.lit("non_positive_membership_requires_review"), keep_event=False)


def lifecycle_guard(plans: DataFrame, events: DataFrame) -> DataFrame:
    """Attach only to open events; contradictory lifecycle rows fail the job."""
    state = events.groupBy("event_id").agg(
        F.min(F.coalesce("lifecycle_status", F.lit(""))).alias("__lo"), F.max(F.coalesce("lifecycle_status", F.lit(""))).alias("__hi")
    )
    state = state.select(
        "event_id", F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).otherwise(F.raise_error(F.lit("contradictory lifecycle rows"))).alias("__life")
    )
    joined = plans.join(state, "event_id", "left")
    writes = F.col("write_allowed") & F.col("event_id").isNotNull()
    closed = yes(F.col("__life").isin(TERMINAL_LIFECYCLES))
    reason = F.when(closed, F.concat(F.lit("target_event_"), F.col("__life"))).otherwise(F.lit("target_event_lifecycle_unknown"))
    return _to_review(joined, writes & ~yes(F.col("__life").isin(OPEN_LIFECYCLES)), reason, keep_event=True).drop("__life")


def assignment_summary(plans: DataFrame) -> DataFrame:
    """One row of action counts and the split into executable, deferred and blocked plans."""
    attach = F.col("action").isin("attach_target_to_event", "attach_source_to_event") & F.col("write_allowed")
    create = (F.col("action") == "create_event") & F.col("write_allowed")
    return plans.agg(
        F.count("*").alias("relations"), *[F.count_if(F.col("action") == a).alias(a) for a in ACTIONS],
        F.count_if("write_allowed").alias("write_allowed"), F.count_if("requires_review").alias("requires_review"),
        F.count_if(attach).alias("executable"), F.count_if(create).alias("deferred_create"), F.count_if(~attach & ~create).alias("blocked"),
    )


def attachments(plans: DataFrame) -> DataFrame:
    """Executable attachments: the signal to attach, the event and the side already in it."""
    to_target = F.col("action") == "attach_target_to_event"
    return plans.filter(F.col("write_allowed") & F.col("action").isin("attach_target_to_event", "attach_source_to_event")).select(
        "relation_id", "action", "reason", "event_id", F.when(to_target, F.col("target_id")).otherwise(F.col("source_id")).alias("signal_id"),
        F.when(to_target, F.col("source_id")).otherwise(F.col("target_id")).alias("anchor_id"),
    )


def checked_attachments(batch: DataFrame, relations: DataFrame, events: DataFrame, memberships: DataFrame, live: DataFrame, producer: str = "matcher") -> DataFrame:
    """``batch`` with the first ``reason`` an attachment no longer holds for, null where it does."""
    rel = relations.filter(F.col("producer") == producer).select("relation_id", approved().alias("__ok"))
    ev = events.select("event_id", F.coalesce("lifecycle_status", F.lit("")).alias("__life"))
    alive = live.select("signal_id", F.lit(True).alias("__live"))
    anchor = memberships.filter(F.col("match_decision").isin(POSITIVE_DECISIONS)).select(
        "event_id", F.col("signal_id").alias("anchor_id"), F.lit(True).alias("__anchor")
    ).distinct()
    held = memberships.groupBy("signal_id").agg(F.min("event_id").alias("__e0"), F.max("event_id").alias("__e1"))
    same = memberships.groupBy("event_id", "signal_id").agg(
        F.count_if(F.col("match_decision").isin(MANUAL_DECISIONS)).alias("__manual"), F.count_if(~F.col("producer").eqNullSafe(F.lit(producer))).alias("__foreign")
    )
    j = (
        batch.withColumn("__n", F.count("*").over(Window.partitionBy("event_id", "signal_id"))).join(rel, "relation_id", "left").join(ev, "event_id", "left").join(alive, "signal_id", "left").join(anchor, ["event_id", "anchor_id"], "left")
        .join(held, "signal_id", "left").join(same, ["event_id", "signal_id"], "left")
    )
    elsewhere = yes(F.col("__e0") != F.col("event_id")) | yes(F.col("__e1") != F.col("event_id"))
    reason = (
        F.when(F.col("__n") > 1, "duplicate_membership").when(F.col("__life").isNull(), "event_missing")
        .when(~F.col("__life").isin(OPEN_LIFECYCLES), "event_not_open").when(F.col("__live").isNull(), "signal_stale")
        .when(F.col("__ok").isNull(), "relation_missing").when(F.col("__anchor").isNull(), "anchor_membership_changed")
        .when(elsewhere, "member_of_other_event").when(~F.col("__ok"), "relation_not_authorised")
        .when(yes(F.col("__manual") > 0), "manual_membership").when(yes(F.col("__foreign") > 0), "foreign_membership")
    )
    return j.select(*batch.columns, reason.alias("failed"))


def attachment_errors(batch: DataFrame, relations: DataFrame, events: DataFrame, memberships: DataFrame, live: DataFrame, producer: str = "matcher") -> DataFrame:
    """``(relation_id, event_id, signal_id, reason)`` of the attachments that no longer hold."""
    failed = checked_attachments(batch, relations, events, memberships, live, producer).filter("failed is not null")
    return failed.select("relation_id", "event_id", "signal_id", F.col("failed").alias("reason"))


def apply_attachments(plans: DataFrame, relations: DataFrame, events: DataFrame, memberships: DataFrame, live: DataFrame, producer: str = "matcher") -> DataFrame:
    """Memberships after attaching, with an ``action`` per row.

    All or nothing: while any attachment fails its checks, reading the result fails with the reason. Callers that
    want the sound ones alone take the failing out first, by :func:`attachment_errors`.
    """
    checked = checked_attachments(attachments(plans), relations, events, memberships, live, producer)
    sound = all_or_nothing(checked.drop("reason").withColumnRenamed("failed", "reason"), "attachment batch")
    r = relations.select("relation_id", F.col("relation").alias("relation_to_event"), F.col("score").cast("decimal(4,3)").cast("double").alias("match_score"))
    new = sound.join(r, "relation_id").select("event_id", "signal_id", F.lit("auto_linked").alias("match_decision"), F.lit(producer).alias("producer"), "relation_to_event", "match_score")
    known = memberships.select("event_id", "signal_id").distinct().withColumn("__k", F.lit(True))
    written = new.join(known, ["event_id", "signal_id"], "left").withColumn("action", F.when(F.col("__k").isNull(), "inserted").otherwise("updated")).drop("__k")
    kept = memberships.join(new.select("event_id", "signal_id"), ["event_id", "signal_id"], "left_anti").select(
        "event_id", "signal_id", "match_decision", "producer", F.lit(None).cast("string").alias("relation_to_event"), F.lit(None).cast("double").alias("match_score"), F.lit("kept").alias("action")
    )
    return written.unionByName(kept)
