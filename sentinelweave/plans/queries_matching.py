"""Registered queries for joins, hydration and pairwise matching (JN, MT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentinelweave.operators import hydrate as H
from sentinelweave.operators import matching as M
from sentinelweave.operators.context import context_anchors
from sentinelweave.operators.gates import current_eligible, manifest_eligible
from sentinelweave.operators.relations import match_anchors, match_listed_pairs, relation_batch, upsert_relations
from sentinelweave.plans.nested import nested_signals, signal_rows
from sentinelweave.plans.registry import query
from sentinelweave.plans.views import view

# The default of the operators, for the SQL twins.
K = 250


def D(x: float) -> str:
    return f"cast({x} as double)"


def sql_fold(c: str) -> str:
    return f"translate(lower({c}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"


_MARK = " or ".join(f"t like '%{m}%'" for m in M.NON_RELATION_MARKERS)


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _nv(c: str) -> str:
    return rf"nullif(trim(regexp_replace(lower({c}), '\s+', ' ', 'g')), '')"


FEATURES = f"""
ftext as (select s.signal_id, {sql_fold("s.signal_summary || coalesce(' ' || e.t, '')")} as t from {{sig}} s
  left join (select signal_id, string_agg(text, ' ' order by seq) as t from {{sig_evidence}} group by signal_id) e on e.signal_id = s.signal_id),
feat as (select s.signal_id, s.signal_role in ('primary_event', 'negative_evidence') and s.signal_type <> 'official_alert' as ok,
  lower(s.disease_name) as disease, lower(s.pathogen_name) as pathogen,
  coalesce(s.occurred_start, case when s.period_year is not null then make_date(s.period_year, 1, 1) end) as lo,
  case when s.occurred_start is not null then coalesce(s.occurred_end, s.occurred_start) when s.period_year is not null then make_date(s.period_year, 12, 31) end as hi,
  s.signal_type as type, case when s.test_result in ('positive', 'negative') then s.test_result end as result,
  s.human_to_human as h2h, s.animal_to_human as a2h, s.vector_borne as vec,
  (s.human_to_human = 'refuted' or s.animal_to_human = 'refuted' or s.vector_borne = 'refuted') as refuted,
  (s.human_to_human <> 'unknown' or s.animal_to_human <> 'unknown' or s.vector_borne <> 'unknown') as known,
  s.signal_role = 'negative_evidence' and (s.verification_status = 'refuted' or s.human_to_human = 'refuted' or s.animal_to_human = 'refuted' or s.vector_borne = 'refuted') as neg,
  s.sequence_reported as seqd, ({_MARK}) as nonrel,
  list_filter([s.domain_a, s.domain_b], lambda x: x is not null) as doms
  from {{sig_eligible}} s join ftext f on f.signal_id = s.signal_id),
place as (select signal_id, case when lower(role) in {_in(M.EVENT_ROLES)} then 'e' when lower(role) in {_in(M.CONTEXT_ROLES)} then 'c' end as kind,
  {_nv("coalesce(country_iso2, country)")} as country, {_nv("admin1")} as admin1, {_nv("admin2")} as admin2, {_nv("locality")} as locality from {{sig_loc}}),
hosts as (select signal_id, list_distinct(list({_nv("coalesce(canonical_name, verbatim)")})) as names, list_distinct(list(host_type)) as types
  from {{sig_host}} group by signal_id)"""


def pair_ctes(pairs: str) -> str:
    """Common table expressions scoring the pairs of ``pairs`` (source_id, target_id)."""
    geo = " union all ".join(
        f"""select p.source_id, p.target_id, '{k}' as kind, max(case when a.country is not null and b.country is not null and a.country <> b.country then 0.0
    when a.locality = b.locality then 1.0 when a.admin2 = b.admin2 then 0.9 when a.admin1 = b.admin1 then 0.8
    when a.country is not null and b.country is not null then 0.35 else 0.0 end) as sim
  from pairs p join place a on a.signal_id = p.source_id and a.kind = '{k}' join place b on b.signal_id = p.target_id and b.kind = '{k}' group by p.source_id, p.target_id"""
        for k in "ec"
    )
    compat = " ".join(f"when least(l.type, r.type) = '{a}' and greatest(l.type, r.type) = '{b}' then {v}" for (a, b), v in M.TYPE_COMPATIBILITY.items())
    caps = "".join(
        f", case when l.type = 'transmission_observation' and r.type = 'transmission_observation' and l.{c} <> 'unknown' and r.{c} <> 'unknown' and l.{c} <> r.{c} then case when l.{c} = 'refuted' or r.{c} = 'refuted' then 0.1 else 0.75 end else 1.0 end"
        for c in ("h2h", "a2h", "vec")
    )
    pin = lambda ps: "(" + " or ".join(f"(lt = '{a}' and ht = '{b}')" for a, b in ps) + ")"
    sec = "['human', 'wildlife', 'domestic_animal', 'vector']"
    parts = list(M.WEIGHTS)
    total = " + ".join(f"coalesce({D(M.WEIGHTS[c])} * {c}, 0)" for c in parts)
    seen = " + ".join(f"case when {c} is not null then {D(M.WEIGHTS[c])} else 0 end" for c in parts)
    return f"""{FEATURES},
pairs as ({pairs}),
geo as ({geo}),
comp as (select p.*, l.ok and r.ok as ok, least(l.type, r.type) as lt, greatest(l.type, r.type) as ht, l.ok as lok, r.ok as rok,
  case when pt is not null and ds is not null then {D(0.75)} * pt + {D(0.25)} * ds when pt is not null then pt when ds is not null then case when ds = 1 then 0.8 else 0 end end as etiology,
  cast(ge.sim as double) as geography,
  cast(case when l.lo is not null and r.lo is not null then case when l.lo <= r.hi and r.lo <= l.hi then 1.0 when gap <= 7 then 0.9 when gap <= 30 then 0.75 when gap <= 90 then 0.5 when gap <= 180 then 0.25 else 0.0 end end as double) as temporality,
  cast(case when hl.names is not null and hr.names is not null then case when list_has_any(hl.names, hr.names) then 1.0 when list_has_any(hl.types, hr.types) then 0.85
    when list_has_all({sec}, hl.types) and list_has_all({sec}, hr.types) then 0.5 else 0.25 end end as double) as host,
  cast(least(case when l.type = r.type then 1.0 {compat} else 0.45 end,
    case when l.result <> r.result then 0.25 else 1.0 end{caps}) as double) as epidemiology,
  (jac + coalesce(gc.sim, 0)) / (1 + case when gc.sim is null then 0 else 1 end) as shared_context,
  case when (l.neg and l.seqd and r.seqd and (l.refuted or l.nonrel)) or (r.neg and l.seqd and r.seqd and (r.refuted or r.nonrel)) then 'explicit_genomic_incompatibility'
    when (l.neg and l.nonrel) or (r.neg and r.nonrel) then 'explicit_official_non_relation'
    when (l.neg and l.refuted) or (r.neg and r.refuted) then 'explicit_source_refutation' end as reason,
  l.type = 'transmission_observation' and r.type = 'transmission_observation' and l.known <> r.known as refinement
  from pairs p join feat l on l.signal_id = p.source_id join feat r on r.signal_id = p.target_id
  left join hosts hl on hl.signal_id = p.source_id left join hosts hr on hr.signal_id = p.target_id
  left join geo ge on ge.source_id = p.source_id and ge.target_id = p.target_id and ge.kind = 'e'
  left join geo gc on gc.source_id = p.source_id and gc.target_id = p.target_id and gc.kind = 'c',
  lateral (select case when l.disease is not null and r.disease is not null then cast(l.disease = r.disease as double) end as ds,
    case when l.pathogen is not null and r.pathogen is not null then case when l.pathogen = r.pathogen then {D(1)} when l.pathogen in {_in(M.GENUS_SYNONYMS)} and r.pathogen in {_in(M.GENUS_SYNONYMS)} then {D(0.85)} else {D(0)} end end as pt,
    case when l.hi < r.lo then r.lo - l.hi else l.lo - r.hi end as gap,
    len(list_intersect(l.doms, r.doms)) / cast(len(list_distinct(l.doms || r.doms)) as double) as jac) x),
gated as (select * replace ({", ".join(f"case when ok then {c} end as {c}" for c in parts)}, case when ok then reason end as reason) from comp),
scored as (select *, case when ok then round(({total}) / ({seen}), 6) end as score, case when ok then round({seen}, 6) else 0 end as coverage from gated),
related as (select *, case when not ok then null when reason is not null then 'contradicts' when lt = 'genomic_observation' and ht = 'genomic_observation' then 'duplicates'
  when lt = 'outbreak' and ht = 'outbreak' then 'refines'
  when lt = 'transmission_observation' and ht = 'transmission_observation' then case when refinement then 'refines' else 'supports' end
  when lt = 'travel_or_mobility' and ht = 'travel_or_mobility' then 'possibly_related' when {pin(M.REFINING_TYPES)} then 'refines'
  when {pin(M.SUPPORTING_TYPES)} then 'supports' when {pin(M.POSSIBLE_TYPES)} then 'possibly_related' when score >= 0.6 then 'supports' else 'unknown' end as relation from scored),
decided as (select *, case when not ok then null when reason is not null then 'rejected'
    when relation in ('duplicates', 'refines') and score >= 0.8 and not (relation = 'refines' and refinement) then 'auto_linked'
    when relation in ('duplicates', 'refines', 'supports', 'possibly_related') then 'review_required' else 'rejected' end as decision,
  ok and reason is null and relation in ('duplicates', 'refines') as merge_allowed from related)"""


REL_PAIRS = pair_ctes("select relation_id, source_id, target_id from {rel}")


def rel_matches(spark, sf):
    pairs = view(spark, sf, "rel").select("relation_id", "source_id", "target_id")
    return match_listed_pairs(pairs, nested_signals(spark, sf))


def _component(number: int, name: str) -> None:
    @query(f"mt{number:02d}_{name}", f"select relation_id, round({name}, 6) as {name} from gated", REL_PAIRS)
    def _(spark, sf):
        return rel_matches(spark, sf).select("relation_id", name)


for _i, _name in enumerate(M.COMPONENTS, 1):
    _component(_i, _name)


@query("mt07_pair_score", "select relation_id, ok as eligible, score, coverage as information_coverage from scored", REL_PAIRS)
def _(spark, sf):
    return rel_matches(spark, sf).select("relation_id", "eligible", "score", "information_coverage")


@query("mt08_hard_conflict", "select relation_id, reason is not null as hard_conflict, reason as hard_conflict_reason from gated", REL_PAIRS)
def _(spark, sf):
    return rel_matches(spark, sf).select("relation_id", "hard_conflict", "hard_conflict_reason")


@query("mt09_relation", "select relation_id, relation from related", REL_PAIRS)
def _(spark, sf):
    return rel_matches(spark, sf).select("relation_id", "relation")


@query("mt10_decision", "select relation_id, decision, merge_allowed from decided", REL_PAIRS)
def _(spark, sf):
    return rel_matches(spark, sf).select("relation_id", "decision", "merge_allowed")


_ALL = ", ".join(f"round({c}, 6) as {c}" for c in M.COMPONENTS)


@query(
    "mt11_match_pairs",
    f"select source_id, target_id, case when ok then 'eligible' else 'ineligible' end as gate, score, coverage as information_coverage, relation, decision, merge_allowed, reason as hard_conflict_reason, {_ALL} from decided",
    REL_PAIRS,
)
def _(spark, sf):
    return rel_matches(spark, sf).select(
        "source_id", "target_id", "gate", "score", "information_coverage", "relation", "decision", "merge_allowed", "hard_conflict_reason", *M.COMPONENTS
    )


# Context anchors: the own text mentions the vessel, else nothing in these documents does.
CONTEXT = """, ctx as (select signal_id, case when signal_summary like '%MV Hondius%' then 'vessel:mv hondius' else '' end as anchor from {sig})"""
GUARDED = """, guarded as (select d.*, a.anchor as sa, b.anchor as ta,
  case when d.decision = 'auto_linked' and coverage < 0.5 and not (a.anchor <> '' and a.anchor = b.anchor) then 'insufficient_information_coverage' end as guard
  from decided d join ctx a on a.signal_id = d.source_id join ctx b on b.signal_id = d.target_id)"""


@query(
    "mt12_auto_link_guard",
    """select relation_id, decision as base_decision, case when guard is null then decision else 'review_required' end as decision, guard as auto_link_guard_reason,
      case when decision = 'auto_linked' and coverage < 0.5 and guard is null then 'shared_strong_event_context_anchor' end as override_reason from guarded""",
    REL_PAIRS + CONTEXT + GUARDED,
)
def _(spark, sf):
    return guarded_matches(spark, sf).select("relation_id", "base_decision", "decision", "auto_link_guard_reason", F.col("auto_link_guard_override_reason").alias("override_reason"))


# Documents with paragraphs about a named vessel, an anaphoric paragraph and a context reset.
_SHIP_DOC = """select raw_item_id, 'Salida del buque Aurora N' || raw_item_id || chr(10) || chr(10) || case when cast(raw_item_id as bigint) % 4 = 0 then 'A nivel nacional ' else 'Siguen ' end
  || case when cast(raw_item_id as bigint) % 3 = 0 then 'las muestras ' else 'los casos ' end || 'click seen by  ' || raw_item_id || '.' || chr(10) || chr(10) || raw_text as raw_text from {raw_text}"""


@query(
    "mt13_context_anchors",
    """select s.signal_id, case when s.signal_summary like '%MV Hondius%' then 'vessel:mv hondius'
      when s.user_id % 4 <> 0 and s.user_id % 3 <> 0 and e.quoted then 'vessel:aurora n' || s.raw_item_id else '' end as anchor_list
    from {sig} s join (select signal_id, bool_or(text = 'click seen by  ' || raw_item_id) as quoted from {sig_evidence} group by signal_id) e on e.signal_id = s.signal_id""",
)
def _(spark, sf):
    from sentinelweave.plans.views import run_sql

    raw = run_sql(spark, sf, _SHIP_DOC)
    out = context_anchors(nested_signals(spark, sf), raw)
    return out.select("signal_id", F.array_join("context_anchors", "|").alias("anchor_list"))


CANDIDATES = f""", live as (select * from {{sig_eligible}} where is_current and event_matching_eligible),
best as (select a.signal_id as anchor_id, min_by(struct_pack(candidate_id := c.signal_id, same_pathogen := coalesce(a.pathogen_id = c.pathogen_id, false),
      same_disease := coalesce(a.disease_id = c.disease_id, false), days := abs(a.occurred_start - c.occurred_start)),
    row(coalesce(a.pathogen_id <> c.pathogen_id, true), coalesce(a.disease_id <> c.disease_id, true), coalesce(abs(a.occurred_start - c.occurred_start), 1000000),
      -epoch_us(c.created_at), c.signal_id), {K}) as near
  from live a join live c on a.signal_id <> c.signal_id group by a.signal_id),
near as materialized (select anchor_id, c.candidate_id as candidate_id, rank, c.same_pathogen as same_pathogen, c.same_disease as same_disease, c.days as days
  from (select anchor_id, unnest(near) as c, generate_subscripts(near, 1) as rank from best) q)"""


def live_index(spark, sf):
    return view(spark, sf, "sig_eligible").select(
        "signal_id", "disease_id", "pathogen_id", "occurred_start", "created_at", "is_current", "event_matching_eligible"
    )


@query("jn03_candidates", "select * from near", CANDIDATES.lstrip(", "))
def _(spark, sf):
    live = current_eligible(live_index(spark, sf))
    return H.candidates(live, live)


def anchor_matches(spark, sf):
    index = live_index(spark, sf)
    return match_anchors(index, index, nested_signals(spark, sf), view(spark, sf, "raw_text"))


ANCHOR_PAIRS = (
    CANDIDATES.lstrip(", ") + ", "
    + pair_ctes("select anchor_id, candidate_id, rank, least(anchor_id, candidate_id) as source_id, greatest(anchor_id, candidate_id) as target_id from near").replace("from pairs p join place a", "from (select distinct source_id, target_id from pairs) p join place a")
    + CONTEXT + GUARDED
)


@query(
    "mt14_match_anchors",
    """select anchor_id, rank, source_id, target_id, case when ok then 'eligible' else 'ineligible' end as gate, score, coverage as information_coverage, relation,
      case when guard is null then decision else 'review_required' end as decision, merge_allowed, reason as hard_conflict_reason from guarded""",
    ANCHOR_PAIRS,
)
def _(spark, sf):
    return anchor_matches(spark, sf).select(
        "anchor_id", "rank", "source_id", "target_id", "gate", "score", "information_coverage", "relation", "decision", "merge_allowed", "hard_conflict_reason"
    )


@query(
    "mt15_match_summary",
    """select anchor_id, count(*) as candidates, count(*) filter (where d = 'auto_linked') as auto_linked, count(*) filter (where d = 'review_required') as review_required,
      count(*) filter (where d = 'rejected') as rejected, count(*) filter (where not ok) as ineligible, count(*) filter (where reason is not null) as hard_conflicts,
      count(*) filter (where ok) as persistable, count(*) filter (where not ok) as skipped
    from (select *, case when guard is null then decision else 'review_required' end as d from guarded) q group by anchor_id""",
    ANCHOR_PAIRS,
)
def _(spark, sf):
    return M.match_summary(anchor_matches(spark, sf))


def stored_relations(spark, sf):
    return view(spark, sf, "rel").select(
        "relation_id", "source_id", "target_id", "relation", "decision", "merge_allowed", "hard_conflict",
        F.col("score").cast("double").alias("score"), "producer", "created_at", "gate",
    )


def guarded_matches(spark, sf):
    """The stored pairs scored again, with the guard on automatic links."""
    anchors = context_anchors(nested_signals(spark, sf), view(spark, sf, "raw_text"))
    a = anchors.select(F.col("signal_id").alias("source_id"), F.col("context_anchors").alias("source_anchors"))
    b = anchors.select(F.col("signal_id").alias("target_id"), F.col("context_anchors").alias("target_anchors"))
    return M.auto_link_guard(rel_matches(spark, sf).join(a, "source_id").join(b, "target_id"))


# A pair whose relation another producer owns would fail the whole batch, so the query leaves it out first.
@query(
    "mt16_upsert_relations",
    """select case when o.relation_id is null then 'new' else o.relation_id end as relation_id, b.source_id, b.target_id, b.relation, b.decision, b.merge_allowed, b.hard_conflict,
      cast(round(cast(b.score as decimal(12, 6)), 3) as double) as score, b.score as raw_score, 'matcher' as producer, case when o.relation_id is null then 'inserted' else 'updated' end as action,
      'eligible' as gate, b.reason as hard_conflict_reason, b.coverage as information_coverage, round(b.etiology, 6) as etiology, b.base as base_decision, '0.4.9' as policy_version, '0.4.8' as matcher_version, b.guard as auto_link_guard_reason,
      b.override as override_reason, case when b.override is not null then b.sa else '' end as shared_anchors, b.sa as source_anchors, b.ta as target_anchors
    from batch b left join own o on o.source_id = b.source_id and o.target_id = b.target_id
    union all
    select r.relation_id, r.source_id, r.target_id, r.relation, r.decision, r.merge_allowed, r.hard_conflict, cast(r.score as double), cast(r.score as double), r.producer, 'kept',
      r.gate, null, null, null, null, null, null, null, null, '', '', ''
    from {rel} r left join batch b on b.source_id = r.source_id and b.target_id = r.target_id and r.producer = 'matcher' where b.source_id is null""",
    REL_PAIRS + CONTEXT + GUARDED + """, batch as (select g.source_id, g.target_id, g.relation, g.decision as base, case when guard is null then g.decision else 'review_required' end as decision, g.merge_allowed, reason is not null as hard_conflict, g.score,
      reason, coverage, etiology, guard, sa, ta, case when g.decision = 'auto_linked' and coverage < 0.5 and guard is null then 'shared_strong_event_context_anchor' end as override
      from guarded g where ok and not exists (select 1 from {rel} f where f.source_id = g.source_id and f.target_id = g.target_id and f.relation = g.relation and f.producer <> 'matcher')),
    own as (select * from {rel} where producer = 'matcher')""",
)
def _(spark, sf):
    stored = stored_relations(spark, sf)
    batch = relation_batch(guarded_matches(spark, sf))
    batch = batch.join(H.foreign_owner(batch, stored).select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")
    out = upsert_relations(batch, stored, nested_signals(spark, sf).select("signal_id"))
    joined = lambda c: F.array_join(c, "|")
    return out.select(
        F.when(F.col("action") == "inserted", F.lit("new")).otherwise(F.col("relation_id")).alias("relation_id"), "source_id", "target_id", "relation", "decision", "merge_allowed",
        "hard_conflict", "score", "raw_score", "producer", "action", "gate", "hard_conflict_reason", "information_coverage", F.col("component_scores.etiology").alias("etiology"), "base_decision",
        "policy_version", "matcher_version", "auto_link_guard_reason", F.col("auto_link_guard_override_reason").alias("override_reason"),
        joined("shared_event_context_anchors").alias("shared_anchors"), joined("source_event_context_anchors").alias("source_anchors"), joined("target_event_context_anchors").alias("target_anchors"),
    )


@query(
    "jn01_hydrate_signals",
    """select s.signal_id, coalesce(l.t, '') as locations, coalesce(h.t, '') as hosts, coalesce(m.t, '') as metrics, coalesce(e.t, '') as evidence from {sig} s
    left join (select signal_id, string_agg(role || '/' || coalesce(locality, '-'), '|' order by seq) as t from {sig_loc} group by signal_id) l on l.signal_id = s.signal_id
    left join (select signal_id, string_agg(host_type || '/' || verbatim, '|' order by seq) as t from {sig_host} group by signal_id) h on h.signal_id = s.signal_id
    left join (select signal_id, string_agg(name || '/' || coalesce(unit, '-'), '|' order by seq) as t from {sig_metric} group by signal_id) m on m.signal_id = s.signal_id
    left join (select signal_id, string_agg(type || '/' || text, '|' order by seq) as t from {sig_evidence} group by signal_id) e on e.signal_id = s.signal_id""",
)
def _(spark, sf):
    def shown(name, a, b):
        return F.array_join(F.transform(name, lambda x: F.concat(x[a], F.lit("/"), F.coalesce(x[b], F.lit("-")))), "|").alias(name)

    return nested_signals(spark, sf).select(
        "signal_id", shown("locations", "role", "locality"), shown("hosts", "host_type", "verbatim"), shown("metrics", "name", "unit"), shown("evidence", "type", "text")
    )


@query(
    "jn02_latest_child",
    "select signal_id, id, test_result, test_type from (select *, row_number() over (partition by signal_id order by created_at desc, id desc) as rn from {sig_diag}) q where rn = 1",
)
def _(spark, sf):
    return H.latest_child(view(spark, sf, "sig_diag").drop("n")).select("signal_id", "id", "test_result", "test_type")


@query(
    "jn04_event_seed_signals",
    """select s.signal_id, s.disease_id, s.disease_name as disease_canonical_name, s.pathogen_id, s.pathogen_name as pathogen_canonical_name, s.occurred_start,
      cast(coalesce(d.published_on, cast(s.created_at as date)) as date) as observed_on
    from {sig_eligible} s join {doc} d on d.raw_item_id = s.raw_item_id""",
)
def _(spark, sf):
    raw = view(spark, sf, "doc").select("raw_item_id", F.col("published_on").cast("timestamp").alias("published_at"))
    rows = signal_rows(spark, sf)
    out = H.event_seed_signals(rows, raw, view(spark, sf, "disease"), view(spark, sf, "pathogen"))
    return out.withColumn("observed_on", F.col("observed_at").cast("date")).drop("observed_at", "domains")


@query(
    "jn05_relations_of",
    """select s.signal_id as anchor_id, r.relation_id from {sig} s join {rel} r on r.source_id = s.signal_id where r.producer = 'matcher'
    union all select s.signal_id as anchor_id, r.relation_id from {sig} s join {rel} r on r.target_id = s.signal_id where r.producer = 'matcher'""",
)
def _(spark, sf):
    return H.relations_of(view(spark, sf, "sig"), view(spark, sf, "rel")).select("anchor_id", "relation_id")


@query(
    "jn06_memberships_of",
    "select m.event_id, m.signal_id, m.match_decision, e.lifecycle_status from {mem} m join {evt} e on e.event_id = m.event_id join {sig} s on s.signal_id = m.signal_id",
)
def _(spark, sf):
    out = H.memberships_of(view(spark, sf, "sig"), view(spark, sf, "mem"), view(spark, sf, "evt"))
    return out.select("event_id", "signal_id", "match_decision", "lifecycle_status")


@query(
    "jn07_missing_or_stale",
    "select distinct m.signal_id from {mem} m where not exists (select 1 from {sig_eligible} s where s.signal_id = m.signal_id and s.is_current and s.event_matching_eligible)",
)
def _(spark, sf):
    return H.missing_or_stale(view(spark, sf, "mem"), current_eligible(view(spark, sf, "sig_eligible")))


@query(
    "jn08_foreign_owner",
    "select source_id, target_id, relation from {rel} where producer <> 'matcher'",
)
def _(spark, sf):
    r = view(spark, sf, "rel")
    return H.foreign_owner(r.select("source_id", "target_id", "relation"), r)


@query(
    "jn09_has_links",
    """select signal_id from {sig} s where exists (select 1 from {mem} m where m.signal_id = s.signal_id)
      or exists (select 1 from {rel} r where r.source_id = s.signal_id) or exists (select 1 from {rel} r where r.target_id = s.signal_id)""",
)
def _(spark, sf):
    return H.has_links(view(spark, sf, "sig").select("signal_id"), view(spark, sf, "mem"), view(spark, sf, "rel"))


@query(
    "jn10_bind_pairs",
    """select r.relation_id, case when a.ok and b.ok then 'eligible' else 'ineligible' end as gate from {rel} r
    join (select signal_id, signal_role in ('primary_event', 'negative_evidence') and signal_type <> 'official_alert' as ok from {sig}) a on a.signal_id = r.source_id
    join (select signal_id, signal_role in ('primary_event', 'negative_evidence') and signal_type <> 'official_alert' as ok from {sig}) b on b.signal_id = r.target_id""",
)
def _(spark, sf):
    known = view(spark, sf, "sig").select("signal_id", manifest_eligible(F.col("signal_role"), F.col("signal_type")).alias("eligible"))
    bound, _, _ = H.bind_pairs(view(spark, sf, "rel").withColumn("expected_gate", F.col("gate")).drop("gate"), known)
    return bound.select("relation_id", "gate")


_MAP = """matches as (select o_orderkey as k, cast(o_orderkey as string) as gold_id, 'pred' || cast(o_custkey as string) as predicted_id from {orders}
  union all select o_orderkey, cast(o_orderkey as string), 'again' from {orders} where o_orderkey % 50 = 0),
once as (select gold_id, min(predicted_id) as predicted_id from matches group by gold_id having count(*) = 1)"""


@query(
    "jn11_map_gold_to_prediction",
    "select r.relation_id, a.predicted_id as predicted_source_id, b.predicted_id as predicted_target_id from {rel} r join once a on a.gold_id = r.source_id join once b on b.gold_id = r.target_id",
    _MAP,
)
def _(spark, sf):
    o = view(spark, sf, "orders")
    m = o.select(F.col("o_orderkey").cast("string").alias("gold_id"), F.concat(F.lit("pred"), F.col("o_custkey").cast("string")).alias("predicted_id"))
    again = o.filter("o_orderkey % 50 = 0").select(F.col("o_orderkey").cast("string").alias("gold_id"), F.lit("again").alias("predicted_id"))
    mapped, _, _ = H.map_gold_to_prediction(m.unionByName(again), view(spark, sf, "rel"))
    return mapped.select("relation_id", "predicted_source_id", "predicted_target_id")


@query(
    "jn12_row_diff",
    """select c_custkey, array_to_string(list_filter([case when c_custkey % 3 = 0 then 'acct' end, case when c_custkey % 4 = 1 then 'segment' end], lambda x: x is not null), ',') as different
    from {customer}""",
)
def _(spark, sf):
    c = view(spark, sf, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("acct"), F.col("c_mktsegment").alias("segment"), F.array(F.lit("a"), F.col("c_name")).alias("tags")
    )
    other = c.withColumns({
        "acct": F.when(F.col("c_custkey") % 3 != 0, F.col("acct")),
        "segment": F.when(F.col("c_custkey") % 4 == 1, F.lit("x")).otherwise(F.col("segment")),
        "tags": F.reverse("tags"),
    })
    out = H.row_diff(c, other, ["c_custkey"], ["acct", "segment", "tags"], unordered=["tags"])
    return out.select("c_custkey", F.array_join("different_fields", ",").alias("different"))
