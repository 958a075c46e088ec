"""Registered queries for evaluation (EV)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentinelweave.functions.text import TEXT_LABELS_V045, TEXT_LABELS_V046
from sentinelweave.operators import evaluation as E
from sentinelweave.operators.relations import match_listed_pairs
from sentinelweave.plans.nested import nested_claims, nested_reference, nested_signals
from sentinelweave.plans.queries_expressions import NEGATIONS, STOP, sql_norm, sql_tokens
from sentinelweave.plans.queries_matching import REL_PAIRS
from sentinelweave.plans.registry import query
from sentinelweave.plans.views import remembered, view


def features(spark, sf, name, version="0.4.7", parts=None):
    return remembered(spark, sf, f"features_{name}_{version}_{parts}", lambda: E.score_features(nested_reference(spark, sf, name), version, parts))


def sides(spark, sf, version):
    """Gold and predicted signals with the keys that pairs are compared by."""
    return [features(spark, sf, name, version, E.pair_parts(version)) for name in ("gold", "pred")]


def pairs(spark, sf, version="0.4.7"):
    return E.pair_components(*sides(spark, sf, version), version)


def near_pairs(spark, sf, version="0.4.7"):
    """The pairs a matching chooses from."""
    return E.reachable_pairs(*sides(spark, sf, version), version)


def _eq(a: str) -> str:
    return f"cast(g.{a} is not distinct from p.{a} as double)"


def _unit(c: str) -> str:
    return f"case when {c} in ('case', 'cases', 'person', 'persons', 'people') then 'count' else {c} end"


def _name(c: str) -> str:
    return f"case {c} when 'cases_new' then 'new_cases' else {c} end"


DOMAINS = "list_filter([{s}.domain_a, {s}.domain_b], lambda x: x is not null)"
# Single-valued children in the flat views keep the twins readable.
PAIRS = f"""pr as (select g.doc, g.idx as g, p.idx as p, g.local_signal_id as gid, p.local_signal_id as pid, {_eq('signal_role')} as signal_role, {_eq('signal_type')} as signal_type,
  cast(case when g.disease_name is not null and p.disease_name is not null then g.disease_name = p.disease_name else {sql_norm('g.disease_verbatim')} is not distinct from {sql_norm('p.disease_verbatim')} end as double) as disease,
  cast({sql_norm('g.pathogen_verbatim')} is not distinct from {sql_norm('p.pathogen_verbatim')} as double) as pathogen,
  case when g.metric_name is null and p.metric_name is null then 1.0 when g.metric_name is null or p.metric_name is null then 0.0
    else cast({_name('g.metric_name')} = {_name('p.metric_name')} and case when g.metric_value is not null and p.metric_value is not null then g.metric_value = p.metric_value else not (g.metric_value is null and p.metric_value is null) end
      and coalesce({_unit('g.metric_unit')} = {_unit('p.metric_unit')}, true) and coalesce(g.metric_year = p.metric_year, true) as double) end as metrics,
  cast(g.admin1 = p.admin1 as double) as locations, {_eq('event_start')} as event_date, {_eq('period_type')} as reference_period, {_eq('test_result')} as diagnostics,
  2.0 * len(list_intersect({DOMAINS.format(s='g')}, {DOMAINS.format(s='p')})) / (len({DOMAINS.format(s='g')}) + len(list_distinct({DOMAINS.format(s='p')}))) as domains,
  cast(g.host_name = p.host_name and g.host_type = p.host_type as double) as hosts,
  cast((g.disease_name is null) = (p.disease_name is null) as double) as status
  from {{gold}} g join {{pred}} p on p.doc = g.doc),
sc as (select *, round({' + '.join(f'{c} * cast({w} as double)' for c, w in E.PAIR_WEIGHTS.items())}, 6) as score from pr)"""
_COLS = ", ".join(f"round({c}, 6) as {c}" for c in E.PAIR_WEIGHTS)


@query(
    "ev01_set_f1",
    "select k, case when na = 0 and nb = 0 then 1.0 when na = 0 or nb = 0 or nab = 0 then 0.0 else round(2.0 * nab / (na + nb), 6) end as f1 from (select l_orderkey as k, count(distinct case when l_returnflag = 'A' then l_linenumber end) as na, count(distinct case when l_linestatus = 'F' then l_linenumber end) as nb, count(distinct case when l_returnflag = 'A' then l_linenumber end) + count(distinct case when l_linestatus = 'F' then l_linenumber end) - count(distinct case when l_returnflag = 'A' or l_linestatus = 'F' then l_linenumber end) as nab from {lineitem} group by l_orderkey) q",
)
def _(spark, sf):
    li = view(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.collect_set(F.when(F.col("l_returnflag") == "A", F.struct("l_linenumber", F.lit(None).cast("int").alias("z")))).alias("a"),
        F.collect_set(F.when(F.col("l_linestatus") == "F", F.struct("l_linenumber", F.lit(None).cast("int").alias("z")))).alias("b"),
    )
    return li.select("k", F.round(E.set_f1(F.col("a"), F.col("b")), 6).alias("f1"))


@query("ev02_entity_exact", "select gid, pid, disease from pr", PAIRS)
def _(spark, sf):
    return pairs(spark, sf).select("gid", "pid", "disease")


@query("ev03_pair_components", f"select doc, g, p, {_COLS} from pr", PAIRS)
def _(spark, sf):
    return pairs(spark, sf).select("doc", "g", "p", *[F.round(c, 6).alias(c) for c in E.PAIR_WEIGHTS])


@query("ev04_pair_score", "select doc, g, p, score from sc", PAIRS)
def _(spark, sf):
    return pairs(spark, sf).select("doc", "g", "p", "score")


@query("ev05_metric_support", "select doc, g, p, metrics from pr", PAIRS)
def _(spark, sf):
    return pairs(spark, sf).select("doc", "g", "p", "metrics")


# Greedy: the best remaining pair of a document is taken again and again.
def _greedy_sql(tag: str, source: str, score: str, least: float) -> str:
    return f"""rk{tag} as (select doc, g, p, {score} as score, row_number() over (partition by doc order by {score} desc, g, p) as o from {source} where {score} >= {least}),
walk{tag} as (select doc, 0 as o, cast([] as integer[]) as ug, cast([] as integer[]) as up from (select distinct doc from rk{tag}) d
  union all select w.doc, r.o, case when list_contains(w.ug, r.g) or list_contains(w.up, r.p) then w.ug else w.ug || [r.g] end, case when list_contains(w.ug, r.g) or list_contains(w.up, r.p) then w.up else w.up || [r.p] end
  from walk{tag} w join rk{tag} r on r.doc = w.doc and r.o = w.o + 1),
last{tag} as (select doc, arg_max(ug, o) as ug, arg_max(up, o) as up from walk{tag} group by doc)"""


GREEDY = _greedy_sql("", "sc", "score", 0.55)
# Exact: every way to give the gold signals of a document different predictions, or none; the best total, then the least pairs.
EXACT = """gl as (select doc, g, row_number() over (partition by doc order by g) as k, list(struct_pack(p := p, s := score) order by p) as opts from sc where score >= 0.55 group by doc, g),
ways as (select doc, cast(0 as bigint) as k, cast([] as integer[]) as up, cast([] as struct(g integer, p integer, s double)[]) as m, cast(0 as double) as total from (select distinct doc from gl) d
  union all select x.doc, x.k, case when o.p is null then x.up else x.up || [o.p] end, case when o.p is null then x.m else x.m || [struct_pack(g := x.g, p := o.p, s := o.s)] end, x.total + coalesce(o.s, 0)
  from (select w.doc, l.k, l.g, w.up, w.m, w.total, unnest(l.opts || [struct_pack(p := cast(null as integer), s := cast(null as double))]) as o from ways w join gl l on l.doc = w.doc and l.k = w.k + 1) x
  where o.p is null or not list_contains(x.up, o.p)),
best as (select doc, unnest(m) as x from (select w.doc, w.m, row_number() over (partition by w.doc order by round(w.total, 9) desc, w.m) as rn from ways w join (select doc, max(k) as n from gl group by doc) f on f.doc = w.doc and f.n = w.k) q where rn = 1)"""


@query("ev06_match_greedy", "select l.doc, unnest(ug) as g, unnest(up) as p from last l", PAIRS + ",\n" + GREEDY)
def _(spark, sf):
    return E.match_greedy(near_pairs(spark, sf)).select("doc", "g", "p")


def matched(spark, sf, version="0.4.7"):
    return E.match_exact(near_pairs(spark, sf, version))


@query("ev07_match_exact", "select doc, x.g as g, x.p as p, x.s as score from best", PAIRS + ",\n" + EXACT)
def _(spark, sf):
    return matched(spark, sf).select("doc", "g", "p", "score")


def _sql_quotes(side: str, version: str = "0.4.7") -> str:
    labels = TEXT_LABELS_V045 if version == "0.4.5" else TEXT_LABELS_V046
    return f"""select doc, idx, case when evidence_type in ({', '.join(f"'{x}'" for x in labels)}) then 'text' else evidence_type end as ty, {_words('evidence_text')} from {{{side}}}"""


def _words(c: str) -> str:
    return f"{sql_norm(c)} as t, {sql_tokens(c)} as a, list_filter({sql_tokens(c)}, lambda x: x not in ({STOP}) and length(x) > 1) as c"


def _numbers(side: str) -> str:
    return f"list_filter({side}.a, lambda x: regexp_full_match(x, '[0-9]+'))"


def _negated(side: str) -> str:
    return f"(len(list_filter({side}.a, lambda x: x in ({NEGATIONS}))) > 0)"


SIMILAR = f"""case when g.ty <> p.ty then 0.0 when g.t = p.t then 1.0
  when {_negated('g')} <> {_negated('p')} then 0.0
  when length(g.t) <= length(p.t) and contains(p.t, g.t) and (len(g.c) >= 3 or length(g.t) >= 24) then 1.0
  when length(g.t) > length(p.t) and contains(g.t, p.t) and (len(p.c) >= 3 or length(p.t) >= 24) then 1.0
  when len({_numbers('g')}) > 0 and len({_numbers('p')}) > 0 and len(list_intersect({_numbers('g')}, {_numbers('p')})) = 0 then 0.0
  when len(list_intersect(g.c, p.c)) < 3 then 0.0 else round(2.0 * len(list_intersect(g.c, p.c)) / (len(g.c) + len(p.c)), 6) end"""
FRAGMENT = f"""(g.ty = p.ty and {_negated('g')} = {_negated('p')} and list_sort({_numbers('g')}) = list_sort({_numbers('p')}) and len(g.c) > 0 and len(p.c) > 0 and least(len(g.c), len(p.c)) <= 2
  and case when len(g.c) <= len(p.c) then list_has_all(p.c, g.c) else list_has_all(g.c, p.c) end)"""
QUOTES = f"""gq as ({_sql_quotes('gold')}), pq as ({_sql_quotes('pred')}),
qs as (select g.doc, g.idx as g, p.idx as p, g.t as gt, p.t as pt, cast(g.ty = p.ty and g.t = p.t as double) as exact, {SIMILAR} as similarity from gq g join pq p on p.doc = g.doc)"""
QUOTES_045 = f"""gq45 as ({_sql_quotes('gold', '0.4.5')}), pq45 as ({_sql_quotes('pred', '0.4.5')}),
qs45 as (select g.doc, g.idx as g, p.idx as p, {SIMILAR} as similarity from gq45 g join pq45 p on p.doc = g.doc)"""
# Clauses of compound gold quotations, each against every prediction of the document.
_SPLIT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(evidence_text), '\s*;\s*', chr(1), 'g'), '\s*:\s*', chr(1), 'g'), '([.!?])\s+', '\1' || chr(1), 'g'),
  ',\s*(\d)', chr(1) || '\1', 'g'), '\s+(?:y|e)\s+(\d|(?:no|sin)\b)', chr(1) || '\1', 'gi')"""
CLAUSES = f"""gs as (select doc, idx, ty0, parts, len(parts) as n from (select doc, idx, evidence_type as ty0,
    list_filter(list_transform(string_split({_SPLIT}, chr(1)), lambda p: trim(p, ' ' || chr(9) || chr(13) || chr(10) || ',;:.')), lambda p: p <> '') as parts from {{gold}}) q),
gc as (select doc, idx, k, case when ty0 in ('text', 'quote', 'excerpt', 'document_text') then 'text' else ty0 end as ty, {_words('raw')} from (select doc, idx, ty0, unnest(parts) as raw, generate_subscripts(parts, 1) as k from gs where n >= 2) q),
met as (select g.doc, g.idx as g, g.k, p.idx as p, {SIMILAR} >= 0.7 or {FRAGMENT} as ok from gc g join pq p on p.doc = g.doc),
wh as (select q.doc, q.g, q.p, (s.n < 2 or contains(q.pt, q.gt)) and q.similarity >= 0.7 as ok from qs q join gs s on s.doc = q.doc and s.idx = q.g),
s47 as (select w.doc, w.g, w.p, cast(w.ok or coalesce(e.ok, false) as double) as support from wh w left join (select doc, g, p, bool_and(ok) as ok from met group by doc, g, p) e on e.doc = w.doc and e.g = w.g and e.p = w.p)"""


@query("ev08_evidence_similarity", "select doc, g, p, cast(similarity as double) as similarity from qs", QUOTES)
def _(spark, sf):
    g = features(spark, sf, "gold", parts=["quotes"]).select("doc", F.col("idx").alias("g"), F.col("f.quotes")[0].alias("gq"))
    p = features(spark, sf, "pred", parts=["quotes"]).select("doc", F.col("idx").alias("p"), F.col("f.quotes")[0].alias("pq"))
    return g.join(p, "doc").select("doc", "g", "p", E.quote_similarity(F.col("gq"), F.col("pq")).alias("similarity"))


def supports(spark, sf, version):
    quoted = ["quotes", "clauses"]
    g = features(spark, sf, "gold", version, quoted).select("doc", F.col("idx").alias("g"), F.col("f").alias("gf"))
    p = features(spark, sf, "pred", version, quoted).select("doc", F.col("idx").alias("p"), F.col("f").alias("pf"))
    return g.join(p, "doc").select("doc", "g", "p", E.evidence_support(F.col("gf.quotes"), F.col("gf.clauses"), F.col("pf.quotes"), version).alias("support"))


@query("ev09_evidence_support_v046", "select doc, g, p, case when similarity >= 0.7 then 1.0 else 0.0 end as support from qs", QUOTES)
def _(spark, sf):
    return supports(spark, sf, "0.4.6")


@query("ev09_evidence_support_v045", "select doc, g, p, case when similarity >= 0.7 then 1.0 else 0.0 end as support from qs45", QUOTES_045)
def _(spark, sf):
    return supports(spark, sf, "0.4.5")


@query("ev09_evidence_support_v047", "select doc, g, p, support from s47", QUOTES + ",\n" + CLAUSES)
def _(spark, sf):
    return supports(spark, sf, "0.4.7")


def document_supports(spark, sf, version):
    """All quotations of a document's gold signals against all of its predicted ones."""
    def side(name, *parts):
        rows = features(spark, sf, name, version, list(parts)).select("doc", F.struct("idx", *[F.col(f"f.{c}")[0].alias(c) for c in parts]).alias("q"))
        gathered = rows.groupBy("doc").agg(F.array_sort(F.collect_list("q")).alias("a"))
        return gathered.select("doc", *[F.col("a").getField(c).alias(f"{name}_{c}") for c in parts])

    j = side("gold", "quotes", "clauses").join(side("pred", "quotes"), "doc")
    return j.select("doc", E.evidence_support(F.col("gold_quotes"), F.col("gold_clauses"), F.col("pred_quotes"), version).alias("support"))


_SIDES = "(select doc, count(*) as n_g from {gold} group by doc) a join (select doc, count(*) as n_p from {pred} group by doc) b on b.doc = a.doc"


@query(
    "ev09_document_support_v045",
    f"""select a.doc, case when coalesce(len(ug), 0) = 0 then 0.0 else round(2 * (len(ug) / cast(n_p as double)) * (len(ug) / cast(n_g as double)) / (len(ug) / cast(n_p as double) + len(ug) / cast(n_g as double)), 6) end as support
    from {_SIDES} left join last45 l on l.doc = a.doc""",
    QUOTES_045 + ",\n" + _greedy_sql("45", "qs45", "similarity", 0.7),
)
def _(spark, sf):
    return document_supports(spark, sf, "0.4.5")


@query(
    "ev09_document_support_v047",
    f"""select a.doc, round(coalesce(h.n, 0) / cast(n_g as double), 6) as support from {_SIDES} left join (
      select doc, count(*) as n from (select g.doc, g.idx from gq g where exists (select 1 from wh w where w.doc = g.doc and w.g = g.idx and w.ok)
        or exists (select 1 from (select doc, g, bool_and(ok) as ok from (select doc, g, k, bool_or(ok) as ok from met group by doc, g, k) c group by doc, g) e where e.doc = g.doc and e.g = g.idx and e.ok)) s group by doc) h on h.doc = a.doc""",
    QUOTES + ",\n" + CLAUSES,
)
def _(spark, sf):
    return document_supports(spark, sf, "0.4.7")


@query(
    "ev10_prf",
    "select doc, round(case when n_p > 0 then m / n_p else 1 end, 6) as precision, round(case when n_g > 0 then m / n_g else 1 end, 6) as recall, case when m > 0 then round(2.0 * m / (n_p + n_g), 6) else 0.0 end as f1 from (select q.doc, cast(n_g as double) as n_g, cast(coalesce(n_p, 0) as double) as n_p, cast(coalesce(len(ug), 0) as double) as m from (select doc, count(*) as n_g from {gold} group by doc) q left join (select doc, count(*) as n_p from {pred} group by doc) r on r.doc = q.doc left join last l on l.doc = q.doc) s",
    PAIRS + ",\n" + GREEDY,
)
def _(spark, sf):
    g = view(spark, sf, "gold").groupBy("doc").agg(F.count("*").alias("n_g"))
    p = view(spark, sf, "pred").groupBy("doc").agg(F.count("*").alias("n_p"))
    m = E.match_greedy(near_pairs(spark, sf)).groupBy("doc").agg(F.count("*").alias("m"))
    j = g.join(p, "doc", "left").join(m, "doc", "left").na.fill(0)
    return j.select("doc", E.prf(F.col("m"), F.col("n_p") - F.col("m"), F.col("n_g") - F.col("m")).alias("d")).select("doc", "d.*")


_FIELDS = {
    "signal_role_accuracy": "signal_role", "signal_type_accuracy": "signal_type", "disease_accuracy": "disease", "pathogen_accuracy": "pathogen", "normalization_status_accuracy": "status",
    "event_date_accuracy": "event_date", "reference_period_accuracy": "reference_period", "diagnostics_accuracy": "diagnostics", "domains_f1": "domains", "metrics_f1": "metrics",
    "locations_f1": "locations", "hosts_f1": "hosts", "evidence_exact_f1": "exact", "evidence_support_f1": "support",
}
_PRF = "case when tp + fp > 0 then tp / cast(tp + fp as double) else 1.0 end as pr0, case when tp + fn > 0 then tp / cast(tp + fn as double) else 1.0 end as re0"
_ROUND_PRF = "round(pr0, 6) as {p}precision, round(re0, 6) as {p}recall, round(case when pr0 + re0 > 0 then 2 * pr0 * re0 / (pr0 + re0) else 0.0 end, 6) as {p}f1"
REPORT = PAIRS + ",\n" + EXACT + ",\n" + QUOTES + ",\n" + CLAUSES + f""",
mf as (select b.doc, count(*) as matched, {', '.join(f'avg({c}) as {f}' for f, c in _FIELDS.items())} from best b join sc on sc.doc = b.doc and sc.g = b.x.g and sc.p = b.x.p
  join s47 on s47.doc = b.doc and s47.g = b.x.g and s47.p = b.x.p join qs on qs.doc = b.doc and qs.g = b.x.g and qs.p = b.x.p group by b.doc),
r1 as (select a.doc, n_g as gold_signals, coalesce(n_p, 0) as predicted_signals, coalesce(matched, 0) as matched_signals, coalesce(matched, 0) as tp, coalesce(n_p, 0) - coalesce(matched, 0) as fp, n_g - coalesce(matched, 0) as fn,
  {', '.join(f'round(coalesce({f}, 1.0), 6) as {f}' for f in _FIELDS)} from {_SIDES.replace(') a join', ') a left join')} left join mf on mf.doc = a.doc),
r2 as (select *, {_ROUND_PRF.format(p='')} from (select *, {_PRF} from r1) q),
rep as (select * exclude (pr0, re0), cast((2 * ({' + '.join(f'cast(round({f} * 1000000) as bigint)' for f in ['f1', *(f for f in _FIELDS if f != 'evidence_exact_f1')])}) + {len(_FIELDS)}) // {2 * len(_FIELDS)} as double) / 1000000 as composite_score,
  precision >= 0.9 and recall >= 0.9 and signal_role_accuracy >= 0.9 and signal_type_accuracy >= 0.85 and evidence_support_f1 >= 0.9 as single_document_pass from r2)"""


def reports(spark, sf, version="0.4.7"):
    gold, pred = (features(spark, sf, side, version, E.field_parts(version, side)) for side in ("gold", "pred"))
    fields = E.matched_fields(E.match_exact(near_pairs(spark, sf, version)), gold, pred, version)
    return E.document_report(gold, pred, fields)


@query("ev11_document_report", "select * from rep", REPORT)
def _(spark, sf):
    return reports(spark, sf)


@query(
    "ev12_unmatched",
    """select g.doc, 'gold' as side, g.local_signal_id, g.signal_type from {gold} g left join last l on l.doc = g.doc where not coalesce(list_contains(ug, g.idx), false)
    union all select p.doc, 'prediction', p.local_signal_id, p.signal_type from {pred} p left join last l on l.doc = p.doc where not coalesce(list_contains(up, p.idx), false)""",
    PAIRS + ",\n" + GREEDY,
)
def _(spark, sf):
    m = E.match_greedy(near_pairs(spark, sf))
    out = E.unmatched(nested_reference(spark, sf, "gold"), nested_reference(spark, sf, "pred"), m)
    return out.select("doc", "side", "local_signal_id", "signal_type")


_MEANS = {"mean_signal_f1": "f1", "mean_evidence_exact_f1": "evidence_exact_f1", "mean_evidence_support_f1": "evidence_support_f1", "mean_signal_role_accuracy": "signal_role_accuracy", "mean_signal_type_accuracy": "signal_type_accuracy"}
CORPUS = REPORT + f""", c1 as (select count(*) as evaluated_documents, {', '.join(f'round(coalesce(avg({c}), 0.0), 6) as {m}' for m, c in _MEANS.items())}, coalesce(sum(tp), 0)::bigint as tp, coalesce(sum(fp), 0)::bigint as fp, coalesce(sum(fn), 0)::bigint as fn from rep),
c2 as (select * exclude (pr0, re0), {_ROUND_PRF.format(p='micro_')} from (select *, (select count(distinct doc) from {{gold}}) as adjudicated_documents, {_PRF} from c1) q),
c3 as (select *, evaluated_documents >= 6 and evaluated_documents = adjudicated_documents as corpus_complete, {' and '.join(f'{n} >= {v}' for n, v in E.RELEASE_THRESHOLDS.items())} as metrics_pass from c2)"""


@query("ev13_corpus_report", "select *, corpus_complete and metrics_pass as ready from c3", CORPUS)
def _(spark, sf):
    return E.corpus_report(reports(spark, sf), view(spark, sf, "gold").select("doc").distinct())


_STATUS = "case n_doc % 10 when 1 then 'failed' when 2 then 'prepared' when 3 then 'missing' when 4 then 'invalid_prediction' else 'evaluated' end"


@query(
    "ev14_exploratory_report",
    f"""select * exclude (pr0, re0), {_ROUND_PRF.format(p='micro_')}, evaluated_documents = expected_documents as complete from (select *, {_PRF} from (
      select count(*) as expected_documents, count(*) filter (where st = 'evaluated') as evaluated_documents, count(*) filter (where st = 'evaluated' and matched_signals > 0) as field_metric_documents,
        round(avg(f1) filter (where st = 'evaluated'), 6) as macro_document_signal_f1, {', '.join(f"coalesce(sum({c}) filter (where st = 'evaluated'), 0)::bigint as {c}" for c in ("tp", "fp", "fn"))},
        {', '.join(f"round(avg({f}) filter (where st = 'evaluated' and matched_signals > 0), 6) as mean_{f}" for f in E.EXPLORATORY_FIELDS)},
        {', '.join(f"count(*) filter (where st = '{x}') as n_{x}" for x in ("failed", "prepared", "missing", "invalid_prediction"))}
      from (select rep.*, {_STATUS} as st from rep join (select distinct doc, n_doc from {{gold}}) d on d.doc = rep.doc) q) q) q""",
    REPORT,
)
def _(spark, sf):
    docs = view(spark, sf, "gold").select("doc", "n_doc").distinct()
    n = F.col("n_doc")
    status = F.when(n % 10 == 1, "failed").when(n % 10 == 2, "prepared").when(n % 10 == 3, "missing").when(n % 10 == 4, "invalid_prediction").otherwise("evaluated")
    return E.exploratory_report(docs.withColumn("status", status).join(reports(spark, sf), "doc", "left"))


@query(
    "ev15_classify_runs",
    """select cast(doc_id as string) as document_id, case when doc_id % 6 = 0 then 'missing' when doc_id % 6 = 1 then 'failed' when doc_id % 6 = 2 then 'prepared' when doc_id % 6 = 3 or doc_id % 14 = 10 then 'invalid_prediction' else 'evaluated' end as status from {documents}""",
)
def _(spark, sf):
    d = view(spark, sf, "documents")
    n = F.col("doc_id")
    docs = d.select(n.cast("string").alias("document_id"), F.sha2("text", 256).alias("source_sha256"))
    runs = d.filter("doc_id % 6 <> 0").select(
        n.cast("string").alias("document_id"), F.when(n % 6 == 1, "failed").when(n % 6 == 2, "prepared").otherwise("generated").alias("status"),
        F.sha2("text", 256).alias("source_sha256"), F.when(n % 6 == 3, F.lit("x")).otherwise(F.sha2("lang", 256)).alias("signals_sha256"), F.lit(4).alias("signals"),
    )
    preds = d.select(n.cast("string").alias("document_id"), F.col("lang").alias("body"), F.when(n % 14 == 10, 5).otherwise(4).alias("n_signals"))
    return E.classify_runs(docs, runs, preds)[0]


def expectations(spark, sf):
    return view(spark, sf, "rel").select(
        F.col("relation_id").alias("pair_id"), F.col("gate").alias("expected_gate"), F.col("relation").alias("expected_relation"), F.col("decision").alias("expected_decision"),
        F.col("merge_allowed").alias("expected_merge_allowed"), F.col("hard_conflict").alias("expected_hard_conflict"),
        F.when(F.col("hard_conflict"), "explicit_source_refutation").alias("expected_hard_conflict_reason"),
    )


def both_directions(spark, sf):
    p = view(spark, sf, "rel").select(F.col("relation_id").alias("pair_id"), "source_id", "target_id")
    signals = nested_signals(spark, sf)
    back = p.select("pair_id", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    return match_listed_pairs(p, signals), match_listed_pairs(back, signals)


BENCH = "xp as (select r.relation_id, r.gate as eg, r.relation as er, r.decision as ed, r.merge_allowed as em, r.hard_conflict as eh, case when r.hard_conflict then 'explicit_source_refutation' end as eq, case when d.ok then 'eligible' else 'ineligible' end as gate, d.relation, d.decision, d.merge_allowed, d.reason is not null as hard_conflict, d.reason from {rel} r join decided d on d.relation_id = r.relation_id)"


@query(
    "ev16_pair_benchmark",
    """select count(*) as evaluated_pairs, count(*) filter (where eg = 'eligible') as eligible_pairs, count(*) filter (where eh) as expected_hard_conflicts, count(*) filter (where decision = 'auto_linked') as predicted_auto_links,
      round(count(*) filter (where eg <> 'eligible' and gate = 'ineligible') / cast(count(*) filter (where eg <> 'eligible') as double), 6) as ineligible_gate_accuracy,
      round(count(*) filter (where eh and hard_conflict) / cast(count(*) filter (where eh) as double), 6) as hard_conflict_recall, round(count(*) filter (where eh and reason = eq) / cast(count(*) filter (where eh) as double), 6) as hard_conflict_reason_accuracy,
      count(*) filter (where eh and decision = 'auto_linked') as hard_conflict_false_auto_links, round(count(*) filter (where decision = 'auto_linked' and ed = 'auto_linked') / cast(count(*) filter (where decision = 'auto_linked') as double), 6) as auto_link_precision,
      round(count(*) filter (where decision is not distinct from ed) / cast(count(*) as double), 6) as pair_decision_accuracy, round(count(*) filter (where eg = 'eligible' and relation is not distinct from er) / cast(count(*) filter (where eg = 'eligible') as double), 6) as relation_accuracy,
      true as order_invariance from xp""",
    REL_PAIRS + ",\n" + BENCH,
)
def _(spark, sf):
    forward, reverse = both_directions(spark, sf)
    return E.pair_benchmark(forward, reverse, expectations(spark, sf)).drop("ineligible_pairs", "metrics_pass")


@query(
    "ev17_mismatch_summary",
    """select scope, count(*) as n from (select case when gate is not distinct from eg and relation is not distinct from er and decision is not distinct from ed and merge_allowed is not distinct from em and hard_conflict is not distinct from eh then 'explanation_only' else 'functional' end as scope from xp
      where not (gate is not distinct from eg and relation is not distinct from er and decision is not distinct from ed and merge_allowed is not distinct from em and hard_conflict is not distinct from eh and reason is not distinct from eq)) q group by scope""",
    REL_PAIRS + ",\n" + BENCH,
)
def _(spark, sf):
    return E.mismatch_summary(both_directions(spark, sf)[0], expectations(spark, sf))[1]


@query("ev18_corpus_reassembly")
def _(spark, sf):
    claims = nested_claims(spark, sf)
    docs = claims.select(F.col("doc").cast("string").alias("doc")).distinct()
    # A manifest and stored predictions of these documents: by a hash, rows of every status, and a row without claims for some.
    part = F.pmod(F.crc32("doc"), F.lit(8))
    named = docs.select("doc", F.col("doc").alias("claims"), part.alias("part")).unionByName(
        docs.filter(part == 3).select(F.concat("doc", F.lit("-absent")).alias("doc"), F.concat("doc", F.lit("-absent")).alias("claims"), F.lit(3).cast("long").alias("part")))
    manifest = named.select(
        F.col("doc").alias("position"), "doc", F.when(F.col("part") == 0, "pending").otherwise("adjudicated").alias("status"),
        F.when(F.col("part") != 1, F.col("claims")).alias("claims"), F.when(F.col("part") == 2, "").otherwise(F.concat(F.lit("predictions/"), "doc")).alias("prediction"),
    )
    stored = docs.filter(part == 4).select(F.concat(F.lit("predictions/"), "doc").alias("prediction"))
    return E.corpus_reassembly(manifest, claims, stored)
