"""Registered queries for the relational load and snapshots (LD, FP)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentinelweave.operators import load as L
from sentinelweave.plans.registry import query
from sentinelweave.plans.views import run_sql, view

MENTION = """select signal_id, case n % 5 when 0 then null when 1 then '' when 2 then upper(d.canonical_name) else null end as canonical_name,
  case n % 5 when 0 then d.synonym_a when 1 then d.synonym_b when 3 then 'nothing' || d.id else null end as verbatim from {sig} s left join {disease} d on d.id = s.disease_id"""


def catalog(spark, sf, name):
    return view(spark, sf, name).select("id", "canonical_name", F.array("synonym_a", "synonym_b").alias("synonyms"))


@query(
    "ld1_resolve_entities",
    """select m.signal_id, c.id, case when c.id is null then 'unresolved' else 'resolved' end as status from m left join (select n, min(id) as id from (select id, lower(canonical_name) as n from {disease} union all select id, lower(synonym_a) from {disease} union all select id, lower(synonym_b) from {disease}) q group by n) c
      on c.n = lower(coalesce(nullif(m.canonical_name, ''), nullif(m.verbatim, '')))""",
    f"m as ({MENTION})",
)
def _(spark, sf):
    return L.resolve_entities(run_sql(spark, sf, MENTION), catalog(spark, sf, "disease"))


HOSTS = "select signal_id, seq, host_type, case when n % 4 = 0 then 'SPECIES ' || cast(n % 2000 as string) else null end as canonical_name, case when n % 4 = 1 then 'small ring' else 'unknown beast' end as verbatim from {sig_host}"


@query(
    "ld2_resolve_hosts",
    """select h.signal_id, h.seq, case when h.host_type = 'human' then (select min(id) from {host_catalog} where scientific_name = 'Homo sapiens') else c.id end as host_id
    from h left join (select n, min(id) as id from (select id, lower(common_name) as n from {host_catalog} union all select id, lower(scientific_name) from {host_catalog}) q group by n) c on c.n = lower(coalesce(h.canonical_name, h.verbatim))""",
    f"h as ({HOSTS})",
)
def _(spark, sf):
    links, missing = L.resolve_hosts(run_sql(spark, sf, HOSTS), view(spark, sf, "host_catalog"))
    return links.select("signal_id", "seq", "host_id").unionByName(missing.select("signal_id", "seq", F.lit(None).cast("string").alias("host_id")))


PLACES = "select distinct country_iso2, admin1, admin2, locality, cast(null as string) as region, prec as precision from {sig_loc} where n % 2 = 0"


@query(
    "ld3_resolve_locations",
    """select l.country_iso2, l.admin1, l.admin2, l.locality, l.prec as precision, count(*) as mentions, c.precision is not null as known,
      coalesce(l.locality, l.admin2, l.admin1, max(l.country), l.country_iso2) as display_name
    from {sig_loc} l left join c on l.country_iso2 is not distinct from c.country_iso2 and l.admin1 is not distinct from c.admin1 and l.admin2 is not distinct from c.admin2 and l.locality is not distinct from c.locality and l.prec = c.precision
    group by l.country_iso2, l.admin1, l.admin2, l.locality, l.prec, c.precision""",
    f"c as ({PLACES})",
)
def _(spark, sf):
    known = run_sql(spark, sf, PLACES).withColumn("id", F.sha1(F.to_json(F.array("country_iso2", "admin1", "admin2", "locality", "precision"))))
    places = view(spark, sf, "sig_loc").select("country_iso2", "country", "admin1", "admin2", "locality", F.lit(None).cast("string").alias("region"), F.col("prec").alias("precision"))
    bound, new = L.resolve_or_create_locations(places, known)
    made = new.select("location_id", "display_name").withColumn("made", F.lit(True))
    keys = ["country_iso2", "admin1", "admin2", "locality", "precision"]
    out = bound.join(made, "location_id", "left").groupBy(*keys).agg(F.count("*").alias("mentions"), F.max("display_name").alias("dn"), F.max("made").alias("made"))
    return out.select(*keys, "mentions", F.col("made").isNull().alias("known"), F.coalesce("dn", "locality", "admin2", "admin1", "country_iso2").alias("display_name"))


@query(
    "ld4_next_versions",
    """select s.signal_id, coalesce(m.v, 0) + 1 as version from {sig} s left join (select raw_item_id, local_signal_key, max(version) as v from {sig} where n % 4 <> 0 and user_id % 3 <> 0 group by raw_item_id, local_signal_key) m
      on m.raw_item_id = s.raw_item_id and m.local_signal_key = s.local_signal_key""",
)
def _(spark, sf):
    s = view(spark, sf, "sig")
    stored = s.filter("n % 4 <> 0 and user_id % 3 <> 0").select("raw_item_id", "local_signal_key", "version")
    return L.next_versions(s.select("signal_id", "raw_item_id", "local_signal_key"), stored).select("signal_id", "version")


# Runs are orders, their stored signals are the order's lines, the listed keys differ for some.
RUNS = """select run_id, n, raw_item_id, status, snapshot_policy from {run}"""
STORED = """select 's' || doc || '-' || cast(ord as string) as signal_id, 'R' || doc as extraction_run_id, cast(o_custkey as string) as raw_item_id, 'k' || cast(ord as string) as local_signal_key, n_doc,
  n_doc % 7 = 2 as is_current, case when n_doc % 21 = 2 and ord = 1 then 'reviewed' else 'pending' end as review_status, cast(null as string) as reviewed_by from {line} l join {orders} o on o.o_orderkey = l.n_doc"""
LISTED = """select 'R' || doc as run_id, cast(o_custkey as string) as raw_item_id, case when n_doc % 13 = 1 and ord = 1 then 'other' else 'k' || cast(ord as string) end as key from {line} l join {orders} o on o.o_orderkey = l.n_doc"""
MEMBER = f"""rn as ({RUNS}), st as ({STORED}), li as ({LISTED}),
mb as (select rn.run_id, rn.raw_item_id, rn.n, coalesce(rn.status = 'succeeded' and rn.snapshot_policy = 'document-v1', false) as is_candidate, coalesce(a.n, 0) as listed, a.n is not null as is_bound,
  coalesce(a.keys = b.keys and not b.cur, false) as is_complete from rn
  left join (select run_id, count(*) as n, list_sort(list(key)) as keys from li group by run_id) a on a.run_id = rn.run_id
  left join (select extraction_run_id, list_sort(list(local_signal_key)) as keys, bool_or(is_current) as cur from st group by extraction_run_id) b on b.extraction_run_id = rn.run_id)"""


def membership(spark, sf):
    return L.candidate_membership(run_sql(spark, sf, RUNS), run_sql(spark, sf, LISTED), run_sql(spark, sf, STORED))


@query("ld5_candidate_membership", "select run_id, is_candidate, is_bound, listed, is_complete from mb", MEMBER)
def _(spark, sf):
    return membership(spark, sf).select("run_id", "is_candidate", "is_bound", "listed", "is_complete")


HEADS = "select cast(o_custkey as string) as raw_item_id, 'R' || cast(min(o_orderkey) as string) as run_id, cast(1 + o_custkey % 2 as int) as revision from {orders} where o_custkey % 3 = 0 group by o_custkey"
REQUESTS = "select cast(o_custkey as string) as raw_item_id, 'R' || cast(o_orderkey as string) as run_id, cast(case when o_custkey % 3 = 0 then 1 + o_custkey % 2 else 0 end + case when o_orderkey % 17 = 3 then 1 else 0 end as int) as expected_revision from {orders}"
DONE = "select 'R' || cast(o_orderkey as string) as run_id from {orders} where o_orderkey % 19 = 4"
LINKED = "select 's' || cast(o_orderkey as string) || '-1' as signal_id from {orders} where o_orderkey % 23 = 6"
NO_REL = "select cast(null as string) as relation_id, cast(null as string) as source_id, cast(null as string) as target_id from {region} where r_regionkey < 0"
PLAN = f"""{MEMBER}, hd as ({HEADS}), rq as ({REQUESTS}), dn as ({DONE}), lk as ({LINKED}),
cu as (select raw_item_id, count(*) as n, min(extraction_run_id) as r0, max(extraction_run_id) as r1, count(*) filter (where review_status <> 'pending') as rev, bool_or(signal_id in (select signal_id from lk)) as lnk from st where is_current group by raw_item_id),
rl as (select extraction_run_id as run_id, bool_or(signal_id in (select signal_id from lk)) as lnk from st group by extraction_run_id),
pl as (select rq.*, hd.run_id as previous_run_id, case when coalesce(hd.revision, 0) <> rq.expected_revision then 'stale_revision' when not (mb.is_candidate and (mb.is_bound or listed = 0)) then 'not_candidate' when listed = 0 then 'empty_snapshot'
  when rq.run_id in (select run_id from dn) then 'already_promoted' when not is_complete then 'incomplete_membership'
  when (hd.run_id is null and coalesce(cu.n, 0) > 0) or (hd.run_id is not null and not (coalesce(cu.r0, '') = hd.run_id and coalesce(cu.r1, '') = hd.run_id)) then 'mixed_vigence' when rev > 0 then 'human_reviewed'
  when cu.lnk or rl.lnk then 'linked' else 'promotable' end as status
  from rq left join hd on hd.raw_item_id = rq.raw_item_id left join mb on mb.run_id = rq.run_id left join cu on cu.raw_item_id = rq.raw_item_id left join rl on rl.run_id = rq.run_id)"""


def planned(spark, sf):
    q = lambda text: run_sql(spark, sf, text)
    return L.promotion_plan(q(REQUESTS), membership(spark, sf), q(STORED), q(HEADS), q(DONE), q(LINKED), q(NO_REL))


@query("ld6_promotion_plan", "select run_id, status from pl", PLAN)
def _(spark, sf):
    return planned(spark, sf).select("run_id", "status")


@query(
    "ld7_apply_promotion",
    """select st.signal_id, case when g.run_id is null then is_current else extraction_run_id = g.run_id end as is_current from st left join (select raw_item_id, min(run_id) as run_id from pl where status = 'promotable' group by raw_item_id) g on g.raw_item_id = st.raw_item_id""",
    PLAN,
)
def _(spark, sf):
    # One request per document at a time, as the revision check demands.
    plan = planned(spark, sf).filter("status = 'promotable'").groupBy("raw_item_id").agg(F.min_by(F.struct("run_id", "expected_revision", "previous_run_id", "status"), "run_id").alias("p")).select("raw_item_id", "p.*")
    signals, _, _ = L.apply_promotion(run_sql(spark, sf, STORED), run_sql(spark, sf, HEADS), plan)
    return signals.select("signal_id", "is_current")


@query("ld8_snapshot_heads", "select o_custkey as raw_item_id, arg_max(o_orderkey, o_orderkey) as run_id, max(o_orderkey) as revision from {orders} group by o_custkey")
def _(spark, sf):
    o = view(spark, sf, "orders").select(F.col("o_custkey").alias("raw_item_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderkey").alias("revision"))
    return L.snapshot_heads(o)


LEGACY = "select run_id, n, raw_item_id, status, case when n % 2 = 0 then null else snapshot_policy end as snapshot_policy from {run}"
CURRENT = "select signal_id, extraction_run_id, raw_item_id, local_signal_key, n_doc, extraction_run_id = f.first_run as is_current from (select *, min(extraction_run_id) over (partition by raw_item_id) as first_run from (" + STORED + ") s) f"


@query(
    "ld9_adoption_plan",
    """select rq.run_id, case when hd.run_id is not null then 'head_exists' when rn.status <> 'succeeded' or rn.snapshot_policy is not null then 'not_legacy_run' when rq.run_id in (select run_id from dn) then 'already_promoted' when a.n is null then 'empty_payload'
      when not (a.keys = b.keys and b.r = rq.run_id) then 'membership_differs' else 'planned' end as plan_status, coalesce(b.n, 0) as signal_count
    from rq join rn on rn.run_id = rq.run_id left join hd on hd.raw_item_id = rq.raw_item_id left join (select run_id, count(*) as n, list_sort(list(key)) as keys from li group by run_id) a on a.run_id = rq.run_id
    left join (select raw_item_id, min(extraction_run_id) as r, count(*) as n, list_sort(list(local_signal_key)) as keys from cs where is_current group by raw_item_id) b on b.raw_item_id = rq.raw_item_id""",
    f"rn as ({LEGACY}), li as ({LISTED}), hd as ({HEADS}), rq as ({REQUESTS}), dn as ({DONE}), cs as ({CURRENT})",
)
def _(spark, sf):
    q = lambda text: run_sql(spark, sf, text)
    signals = q(CURRENT)
    prints = L.state_fingerprint({"signals": signals.select("raw_item_id", "signal_id", "local_signal_key"), "runs": q(LEGACY)}, "raw_item_id")
    out = L.adoption_plan(q(REQUESTS), q(LEGACY), q(LISTED), signals, q(HEADS), q(DONE), q(LINKED), q(NO_REL), prints)
    return out.select("run_id", "plan_status", "signal_count")


@query("fp1_state_fingerprint")
def _(spark, sf):
    m = view(spark, sf, "sig_metric").select("signal_id", "name", "value_numeric", "unit")
    e = view(spark, sf, "sig_evidence").select("signal_id", "type", "text")
    return L.state_fingerprint({"metrics": m, "evidence": e}, "signal_id")


@query("ld10_failed_runs", "select run_id, 'failed' as status, md5(repeat(error_text, 2000)) as error_digest from {run} where error_text is not null")
def _(spark, sf):
    r = view(spark, sf, "run").withColumn("error_text", F.repeat("error_text", F.lit(2000)))
    return L.failed_runs(r).select("run_id", "status", F.md5("error_text").alias("error_digest"))
