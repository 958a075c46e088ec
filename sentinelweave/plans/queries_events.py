"""Registered queries for cohorts, events and memberships (CO, AS)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentinelweave.operators import assignment as AS
from sentinelweave.operators import cohorts as C
from sentinelweave.operators.gates import current_eligible
from sentinelweave.operators.hydrate import event_seed_signals
from sentinelweave.plans.nested import signal_rows
from sentinelweave.plans.registry import query
from sentinelweave.plans.views import view
from sentinelweave.session import materialised

OK = "gate = 'eligible' and decision = 'auto_linked' and merge_allowed and not hard_conflict and relation in ('duplicates', 'refines')"
GRAPH = f"""edge as (select * from {{rel}} where {OK}),
link as (select 's:' || source_id as u, 's:' || target_id as v from edge union all select 's:' || source_id, 't:' || anchor from edge where anchor like 'vessel:%'),
both_ways as (select u, v from link union select v, u from link),
reach as (select distinct u as node, u as label from both_ways union select r.node, b.v from reach r join both_ways b on b.u = r.label),
comp as (select substr(node, 3) as signal_id, min(substr(label, 3)) as cohort from reach where node like 's:%' and label like 's:%' group by node)"""


def edges_of(spark, sf):
    anchor = F.when(F.col("anchor").isNotNull(), F.array("anchor")).otherwise(F.array().cast("array<string>"))
    return view(spark, sf, "rel").withColumn("shared_event_context_anchors", anchor)


def labelled(spark, sf):
    edges, _ = C.creation_edges(edges_of(spark, sf))
    return C.cohorts(edges)


def seed_signals(spark, sf):
    raw = view(spark, sf, "doc").select("raw_item_id", F.col("published_on").cast("timestamp").alias("published_at"))
    rows = signal_rows(spark, sf)
    # Every reporter's document exists here, whether or not a published one shares its id.
    ids = rows.select("raw_item_id").distinct().join(raw, "raw_item_id", "left")
    return event_seed_signals(rows, ids, view(spark, sf, "disease"), view(spark, sf, "pathogen"))


SEEDSIG = """ss as (select s.signal_id, s.disease_id, s.disease_name, s.pathogen_id, s.pathogen_name, s.occurred_start, s.domain_a, s.domain_b from {sig_eligible} s)"""


@query("co1_creation_edges", f"select relation_id, {OK} as may_create from {{rel}}")
def _(spark, sf):
    ok, excluded = C.creation_edges(view(spark, sf, "rel"))
    return ok.select("relation_id", F.lit(True).alias("may_create")).unionByName(excluded.select("relation_id", F.lit(False).alias("may_create")))


@query("co2_cohorts", "select signal_id, cohort from comp", GRAPH)
def _(spark, sf):
    return labelled(spark, sf)


@query(
    "co3_cohort_rollup",
    """select c.cohort, count(distinct e.relation_id) as relation_count, max(n.signal_count) as signal_count, arg_min(e.relation_id, struct_pack(a := -coalesce(cast(e.score as double), -1.0), b := e.relation_id)) as seed_relation_id,
      count(distinct case when e.anchor like 'vessel:%' then e.anchor end) as anchor_count, case when min(e.relation) = max(e.relation) then min(e.relation) end as source_relation
    from edge e join comp c on c.signal_id = e.source_id join (select cohort, count(*) as signal_count from comp group by cohort) n on n.cohort = c.cohort group by c.cohort""",
    GRAPH,
)
def _(spark, sf):
    edges, _ = C.creation_edges(edges_of(spark, sf))
    return C.cohort_rollup(edges, C.cohorts(edges)).select("cohort", "relation_count", "signal_count", "seed_relation_id", "anchor_count", "source_relation")


@query(
    "co4_cohort_seed",
    """select c.cohort, case when min(s.disease_id) <> max(s.disease_id) then 'conflicting_disease' when min(s.pathogen_id) <> max(s.pathogen_id) then 'conflicting_pathogen' end as error,
      coalesce(case when count(distinct s.disease_name) = 1 then min(s.disease_name) when count(distinct s.pathogen_name) = 1 then min(s.pathogen_name) end || ' - emerging event', 'One Health emerging event') as title,
      min(s.occurred_start) as event_start_date, array_to_string(list_sort(list_distinct(list(s.domain_a) || coalesce(list(s.domain_b) filter (s.domain_b is not null), []))), ',') as domains_present
    from comp c join ss s on s.signal_id = c.signal_id group by c.cohort""",
    GRAPH + ",\n" + SEEDSIG,
)
def _(spark, sf):
    edges, _ = C.creation_edges(edges_of(spark, sf))
    labels = C.cohorts(edges)
    seeds = C.cohort_seed(labels, C.cohort_rollup(edges, labels), seed_signals(spark, sf))
    return seeds.select("cohort", "error", "title", "event_start_date", F.array_join("domains_present", ",").alias("domains_present"))


@query(
    "co5_pair_seed",
    """select relation_id, case when a.disease_id <> b.disease_id then 'conflicting_disease' when a.pathogen_id <> b.pathogen_id then 'conflicting_pathogen' end as error,
      coalesce(coalesce(case when lower(a.disease_name) = lower(b.disease_name) then a.disease_name end, case when lower(a.pathogen_name) = lower(b.pathogen_name) then a.pathogen_name end,
        case when a.disease_name is null or b.disease_name is null then coalesce(a.disease_name, b.disease_name) end, case when a.pathogen_name is null or b.pathogen_name is null then coalesce(a.pathogen_name, b.pathogen_name) end) || ' - emerging event', 'One Health emerging event') as title,
      least(a.occurred_start, b.occurred_start) as event_start_date from edge e join ss a on a.signal_id = e.source_id join ss b on b.signal_id = e.target_id""",
    GRAPH.split(",\nlink as")[0] + ",\n" + SEEDSIG,
)
def _(spark, sf):
    return C.pair_seed(edges_of(spark, sf), seed_signals(spark, sf)).select("relation_id", "error", "title", "event_start_date")


REASON = """case when gate <> 'eligible' then 'matcher_pair_ineligible' when hard_conflict then 'hard_conflict' when decision = 'review_required' then 'matcher_requires_review' when decision <> 'auto_linked' then 'matcher_rejected'
  when not merge_allowed then 'merge_not_allowed' when relation not in ('duplicates', 'refines') then 'relation_not_auto_creatable'
  when source_id in (select signal_id from {mem}) or target_id in (select signal_id from {mem}) then 'existing_event_membership' else 'auto_linked_pair_without_event' end"""


@query("co6_plan_pair_creation", f"select relation_id, {REASON} as reason from {{rel}}")
def _(spark, sf):
    return C.plan_pair_creation(view(spark, sf, "rel"), view(spark, sf, "mem")).select("relation_id", "reason")


def stored_relations(spark, sf):
    """Stored relations with the audit fields of the matcher, gaps and overrides by modulo."""
    n = F.substring("relation_id", 2, 20).cast("long")
    anchored = F.size("shared_event_context_anchors") > 0
    return edges_of(spark, sf).withColumns(
        {
            "matcher_version": F.when(n % 41 == 5, F.lit(None).cast("string")).otherwise("0.4.8"),
            "policy_version": F.when(n % 43 == 5, "0.4.7").otherwise("0.4.9"), "context_resolver_version": F.lit("0.4.9"),
            "auto_link_guard_override_reason": F.when(anchored | (n % 47 == 3), C.ANCHOR_OVERRIDE),
            "information_coverage": F.when(anchored | (n % 53 == 3), 0.4).otherwise(0.9),
        }
    )


def validated(spark, sf):
    """Reviewed drafts against stored tables that have moved on: faults of every kind by modulo of the cohort's number.

    Some cohorts have their event already, stored as :func:`cohorts.create_events` would; some of those were closed,
    edited, reviewed or lost a member.
    """
    stored = stored_relations(spark, sf)
    edges, _ = C.creation_edges(stored)
    labels = materialised(C.cohorts(edges), "cohorts")
    signals = seed_signals(spark, sf)
    seeds = materialised(C.cohort_seed(labels, C.cohort_rollup(edges, labels), signals), "seeds")
    n = F.col("cohort").cast("long")
    reviewed = seeds.withColumn("title", F.when(n % 19 == 4, "Another title").otherwise(F.col("title")))
    anchors = C.cohort_anchors(edges, labels).filter(n % 17 != 3)
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("signal_id"), "shared_event_context_anchors")
    supported = (
        ends.select("signal_id", F.explode("shared_event_context_anchors").alias("a")).filter(F.col("signal_id").cast("long") % 29 != 7)
        .groupBy("signal_id").agg(F.collect_set("a").alias("context_anchors"))
    )
    older = seeds.filter(n % 5 == 1)
    nothing = spark.createDataFrame([], "event_code string")
    rows, links = C.create_events(older.select("cohort", F.lit("ready_to_create").alias("status")), older, labels, nothing)
    events = rows.withColumns(
        {
            "lifecycle_status": F.when(n % 3 == 0, "closed").otherwise(F.col("lifecycle_status")), "title": F.when(n % 7 == 2, "Edited").otherwise(F.col("title")),
            "summary": F.when(n % 11 == 5, "Written").otherwise(F.col("summary")),
        }
    )
    links = links.join(rows.select("event_id", "cohort"), "event_id").filter((n % 13 != 6) | (F.col("signal_id") != F.col("cohort"))).drop("cohort")
    memberships = view(spark, sf, "mem").unionByName(links, allowMissingColumns=True)
    live = current_eligible(view(spark, sf, "sig_eligible"))
    member_edges = C.cohort_members(edges, labels).select("cohort", "relation_id")
    out = C.validate_cohort(reviewed, labels, member_edges, live, stored, events, memberships, signals, anchors, supported)
    return out, labels, seeds, events


VALID = """st as (select e.*, cast(substr(relation_id, 2) as bigint) as m, cast(source_id as bigint) as sn, cast(target_id as bigint) as tn from edge e),
stx as (select s.*, c.cohort, cast(c.cohort as bigint) as n, m % 41 = 5 as blank, m % 43 = 5 as off, anchor is not null or m % 47 = 3 as override, anchor is not null and anchor like 'vessel:%' and cast(c.cohort as bigint) % 17 <> 3 as known
  from st s join comp c on c.signal_id = s.source_id),
fe as (select cohort, count(*) filter (where producer = 'manual') as lost, count(*) filter (where producer <> 'manual' and override and anchor is null) as bad_override,
  count(*) filter (where producer <> 'manual' and anchor is not null and not known) as strange, count(*) filter (where producer <> 'manual' and known and blank) as known_blanks,
  count(*) filter (where producer <> 'manual' and known and not blank and off) as known_offs, count(*) filter (where producer <> 'manual' and blank) as blanks, count(*) filter (where producer <> 'manual' and not blank and off) as offs,
  count(*) filter (where producer <> 'manual' and anchor is not null and (sn % 29 = 7 or tn % 29 = 7)) as unsupported, count(*) filter (where producer <> 'manual' and m % 53 = 3 and not override) as policy
  from stx group by cohort),
fs as (select c.cohort, cast(c.cohort as bigint) as n, count(*) filter (where not (s.is_current and s.event_matching_eligible)) as missing, min(s.disease_id) <> max(s.disease_id) or coalesce(min(s.pathogen_id) <> max(s.pathogen_id), false) as split
  from comp c join {sig_eligible} s on s.signal_id = c.signal_id group by c.cohort),
fm as (select c.cohort, count(*) filter (where m.match_decision in ('manual_linked', 'manual_unlinked') or m.linked_by is not null) as manual, count(*) as held from comp c join {mem} m on m.signal_id = c.signal_id group by c.cohort),
verdict as (select fs.cohort, fs.n, n % 5 = 1 as stored, case when missing > 0 then 'signals_missing_stale_or_ineligible' when lost > 0 then 'relations_missing_or_foreign' when bad_override > 0 then 'invalid_context_override'
  when strange > 0 then 'context_anchor_mismatch' when known_blanks > 0 then 'invalid_context_versions' when known_offs > 0 then 'incompatible_context_versions' when blanks > 0 then 'invalid_context_versions'
  when offs > 0 then 'incompatible_context_versions' when coalesce(split, false) then 'invalid_persisted_event_seed' when n % 19 = 4 then 'event_seed_mismatch' when unsupported > 0 then 'unsupported_context_anchors'
  when policy > 0 then 'invalid_matcher_policy' when manual > 0 then 'manual_membership_conflict' when held > 0 then 'other_event_membership_conflict'
  when n % 5 = 1 and n % 3 = 0 then 'event_lifecycle_blocked' when n % 5 = 1 and (n % 7 = 2 or n % 11 = 5) then 'existing_event_mismatch' when n % 5 = 1 and n % 13 = 6 then 'existing_membership_mismatch' end as reason
  from fs join fe on fe.cohort = fs.cohort left join fm on fm.cohort = fs.cohort),
state as (select *, case when reason is not null then 'blocked' when stored then 'already_exists' else 'ready_to_create' end as status,
  case when reason = 'event_seed_mismatch' then 'title' when reason = 'existing_event_mismatch' then array_to_string(list_filter([case when n % 11 = 5 then 'summary' end, case when n % 7 = 2 then 'title' end], lambda x: x is not null), ',') else '' end as mismatched from verdict)"""


@query("co7_validate_cohort", "select cohort, reason, status, mismatched from state", GRAPH + ",\n" + VALID)
def _(spark, sf):
    return validated(spark, sf)[0].select("cohort", "reason", "status", F.array_join("mismatched_fields", ",").alias("mismatched"))


@query(
    "co8_create_events",
    """select c.signal_id, c.cohort, 'auto_linked' as match_decision, 'supports' as relation_to_event, cast(z.n as varchar) as source_signals, cast(r.n as varchar) as source_relations
    from comp c join state v on v.cohort = c.cohort join (select cohort, count(*) as n from comp group by cohort) z on z.cohort = c.cohort
    join (select cohort, count(distinct relation_id) as n from stx group by cohort) r on r.cohort = c.cohort where v.status = 'ready_to_create'""",
    GRAPH + ",\n" + VALID,
)
def _(spark, sf):
    valid, labels, seeds, events = validated(spark, sf)
    rows, links = C.create_events(valid, seeds, labels, events)
    shown = [F.col("rationale")[c].alias(c) for c in ("source_signals", "source_relations")]
    return links.join(rows.select("event_id", "cohort"), "event_id").select("signal_id", "cohort", "match_decision", "relation_to_event", *shown)


@query("co9_plan_summary", "select status, reason, count(*) as n from state group by status, reason", GRAPH + ",\n" + VALID)
def _(spark, sf):
    return C.plan_summary(validated(spark, sf)[0])


PLAN = """side as (select signal_id, count(distinct event_id) filter (where match_decision in ('auto_linked', 'manual_linked')) as n, min(event_id) filter (where match_decision in ('auto_linked', 'manual_linked')) as e,
  count(*) filter (where match_decision not in ('auto_linked', 'manual_linked')) as other from {mem} group by signal_id),
p1 as (select r.*, coalesce(a.n, 0) as sn, coalesce(b.n, 0) as tn, a.e as se, b.e as te, coalesce(a.other, 0) + coalesce(b.other, 0) > 0 as nonpos
  from {rel} r left join side a on a.signal_id = r.source_id left join side b on b.signal_id = r.target_id),
p2 as (select *, case when gate <> 'eligible' then 'matcher_pair_ineligible' when hard_conflict then 'hard_conflict' when decision = 'review_required' then 'matcher_requires_review' when decision <> 'auto_linked' then 'matcher_rejected'
  when sn > 1 or tn > 1 then 'signal_has_multiple_existing_events' when sn = 1 and tn = 1 and se = te then 'both_signals_already_linked' when sn = 1 and tn = 1 then 'signals_belong_to_distinct_events'
  when sn = 1 then 'source_already_has_event' when tn = 1 then 'target_already_has_event' else 'auto_linked_pair_without_event' end as reason from p1),
p3 as (select * replace (case when nonpos and reason in ('both_signals_already_linked', 'source_already_has_event', 'target_already_has_event', 'auto_linked_pair_without_event') then 'non_positive_membership_requires_review' else reason end as reason),
  reason as first_reason from p2),
p4 as (select p3.*, v.lifecycle_status as life from p3 left join {evt} v on v.event_id = coalesce(se, te) and p3.reason in ('source_already_has_event', 'target_already_has_event')),
p5 as (select * replace (case when reason in ('source_already_has_event', 'target_already_has_event') and coalesce(life, '') not in ('active', 'monitoring') then case when life in ('closed', 'resolved') then 'target_event_' || life else 'target_event_lifecycle_unknown' end else reason end as reason) from p4)"""
ACTION = """case when {r} in ('matcher_pair_ineligible', 'hard_conflict', 'matcher_requires_review', 'matcher_rejected') then 'no_event_change' when {r} = 'both_signals_already_linked' then 'already_same_event'
  when {r} = 'source_already_has_event' then 'attach_target_to_event' when {r} = 'target_already_has_event' then 'attach_source_to_event' when {r} = 'auto_linked_pair_without_event' then 'create_event' else 'manual_review' end"""


@query(
    "as1_assignment_plan",
    f"""select relation_id, {ACTION.replace('{r}', 'reason')} as action, reason, case when reason in ('both_signals_already_linked', 'source_already_has_event') then se when reason = 'target_already_has_event' then te end as event_id,
      case when gate = 'eligible' and not hard_conflict and decision = 'auto_linked' then case when not merge_allowed then 'auto_linked_without_merge' when relation = 'supports' then 'auto_linked_with_invalid_relation' end end as error from p2""",
    PLAN,
)
def _(spark, sf):
    return AS.assignment_plan(view(spark, sf, "rel"), view(spark, sf, "mem"), guarded=False).select("relation_id", "action", "reason", "event_id", "error")


@query("as2_nonpositive_guard", f"select relation_id, {ACTION.replace('{r}', 'reason')} as action, reason from p3", PLAN)
def _(spark, sf):
    return AS.assignment_plan(view(spark, sf, "rel"), view(spark, sf, "mem")).select("relation_id", "action", "reason")


def guarded_plans(spark, sf):
    return AS.lifecycle_guard(AS.assignment_plan(view(spark, sf, "rel"), view(spark, sf, "mem")), view(spark, sf, "evt"))


@query("as3_lifecycle_guard", f"select relation_id, {ACTION.replace('{r}', 'reason')} as action, reason from p5", PLAN)
def _(spark, sf):
    return guarded_plans(spark, sf).select("relation_id", "action", "reason")


_COUNTS = ", ".join(f"count(*) filter (where act = '{a}') as {a}" for a in AS.ACTIONS)


@query(
    "as4_assignment_summary",
    f"""select count(*) as relations, {_COUNTS}, count(*) filter (where act in ('create_event', 'attach_target_to_event', 'attach_source_to_event')) as write_allowed,
      count(*) filter (where act = 'manual_review' or reason = 'matcher_requires_review') as requires_review, count(*) filter (where act in ('attach_target_to_event', 'attach_source_to_event')) as executable,
      count(*) filter (where act = 'create_event') as deferred_create, count(*) filter (where act not in ('create_event', 'attach_target_to_event', 'attach_source_to_event')) as blocked
    from (select *, {ACTION.replace('{r}', 'reason')} as act from p5) q""",
    PLAN,
)
def _(spark, sf):
    return AS.assignment_summary(guarded_plans(spark, sf))


# An attachment that fails its checks would fail the whole batch, so the query takes those out first.
@query(
    "as5_apply_attachments",
    """select m.event_id, m.signal_id, m.match_decision, m.producer, cast(null as varchar) as relation_to_event, cast(null as double) as match_score, 'kept' as action
      from {mem} m where not exists (select 1 from good g where g.event_id = m.event_id and g.signal_id = m.signal_id)
    union all select g.event_id, g.signal_id, 'auto_linked', 'matcher', g.relation, cast(g.score as double),
      case when exists (select 1 from {mem} m where g.event_id = m.event_id and g.signal_id = m.signal_id) then 'updated' else 'inserted' end from good g""",
    PLAN + """, att as (select relation_id, case when reason = 'source_already_has_event' then target_id else source_id end as signal_id, coalesce(se, te) as event_id, merge_allowed, relation, producer, score from p5 where reason in ('source_already_has_event', 'target_already_has_event')),
    good as (select * from (select *, count(*) over (partition by event_id, signal_id) as copies from att) a where copies = 1 and merge_allowed and relation in ('duplicates', 'refines') and producer = 'matcher'
      and exists (select 1 from {sig_eligible} s where s.signal_id = a.signal_id and s.is_current and s.event_matching_eligible) and not exists (select 1 from {mem} m where m.signal_id = a.signal_id))""",
)
def _(spark, sf):
    live = current_eligible(view(spark, sf, "sig_eligible"))
    tables = view(spark, sf, "rel"), view(spark, sf, "evt"), view(spark, sf, "mem"), live
    plans = guarded_plans(spark, sf)
    failing = AS.attachment_errors(AS.attachments(plans), *tables).select("relation_id").distinct()
    return AS.apply_attachments(plans.join(failing, "relation_id", "left_anti"), *tables)
