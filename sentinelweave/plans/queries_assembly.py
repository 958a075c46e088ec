"""Registered queries for claim assembly (ASM).

The SQL twins read the flat claim view.  Rules over wording that never occurs in the
given texts (two-site and facility statements) are also covered by hand-made tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sentinelweave.operators import assembly as A
from sentinelweave.plans.nested import nested_claims, nested_signals
from sentinelweave.plans.registry import query
from sentinelweave.plans.views import view

# Group-level facts of the flat claims, step by step as the group rewrites apply them.
GROUPS = """g0 as (select *, coalesce(nullif(group_id, ''), claim_id) as gk,
    lower(coalesce(summary, '') || ' ' || evidence_text || coalesce(' ' || evidence2_text, '')) as txt from {clm}),
g1 as (select *, case when claim_kind = 'death_count' and bool_or(claim_kind = 'syndromic_cluster') over (partition by doc, gk) then 'syndromic_cluster' else claim_kind end as k1 from g0),
g2 as (select *, coalesce(k1 = 'diagnostic_result' and polarity <> 'negative' and subject_type = 'human' and test_result = 'positive', false) as pos from g1),
g3 as (select *, case when pos then 'case_status' when k1 = 'surveillance_baseline' and polarity <> 'negative' and metric_reported and period_type = 'historical_period'
    and period_from is not null and period_to is not null then 'historical_context' else k1 end as k2,
  case when coalesce(disease_verbatim, '') = '' and (lower(coalesce(pathogen_verbatim, '')) like '%hantavirus%' or lower(coalesce(pathogen_verbatim, '')) like '%andes%') then 'hantavirus' else disease_verbatim end as disease2,
  case when pos and not metric_reported then 'confirmed_cases' else metric_name end as metric_name2, metric_reported or pos as reported2,
  case when pos and not metric_reported then 1.0 else metric_value end as value2,
  (case when loc_role = 'current_location' and (pos or k1 = 'transmission_statement') then 0 else 1 end) + (case when loc2_role is null then 0 else 1 end) as n_locs,
  case when k1 = 'laboratory_investigation' and test_target is not null then 'cepa' else test_target end as target2 from g2),
g4 as (select *, k2 = 'wildlife_sampling' and bool_or(k2 = 'wildlife_presence_absence' and polarity = 'negative') over (partition by doc, gk) as absent from g3),
g5 as (select *, case when absent then 'wildlife_presence_absence' else k2 end as k3, case when absent then 'negative' else polarity end as pol3 from g4)"""


@query("asm01_split_multisite", "select claim_id, claim_kind, case when claim_kind = 'diagnostic_result' and subject_type = 'animal' and loc_locality is not null and loc2_role is not null and loc_locality <> 'Town ' || cast(sk % 5 as string) then 'ASM-MULTISITE-REVIEW' else '' end as note from {clm}")
def _(spark, sf):
    out = A.with_notes(nested_claims(spark, sf))
    return A.split_multisite(out).select("claim_id", "claim_kind", F.array_join("notes", ",").alias("note"))


@query("asm02_promote_animal_outbreaks", "select claim_id, claim_kind from {clm}")
def _(spark, sf):
    return A.promote_animal_outbreaks(nested_claims(spark, sf)).select("claim_id", "claim_kind")


@query("asm03_attach_lab_confirmation", "select claim_id, claim_kind from {clm}")
def _(spark, sf):
    return A.attach_lab_confirmation(nested_claims(spark, sf)).select("claim_id", "claim_kind")


@query(
    "asm04_collective_characterisation",
    """select claim_id, case when b and c then 'other' else subject_type end as subject_type, case when b and g then 'diagnostic_result' else claim_kind end as claim_kind
    from (select *, bool_or(c) over (partition by doc, gk) and bool_or(g) over (partition by doc, gk) as b from (
      select *, claim_kind = 'genomic_finding' as g, coalesce(claim_kind = 'diagnostic_result' and test_result = 'positive' and subject_type = 'human' and subject_verbatim = 'los casos confirmados', false) as c from g0) q) r""",
    GROUPS.split("\ng1 as")[0].rstrip(","),
)
def _(spark, sf):
    return A.collective_characterisation(nested_claims(spark, sf)).select("claim_id", F.col("subject.subject_type").alias("subject_type"), "claim_kind")


@query(
    "asm05_mobility_to_intervention",
    """select claim_id, case when claim_kind = 'mobility' and coalesce(subject_verbatim, '') = 'personal del ministerio' and bool_or(claim_kind = 'intervention') over (partition by doc, gk)
      then 'intervention' else claim_kind end as claim_kind from g0""",
    GROUPS.split("\ng1 as")[0].rstrip(","),
)
def _(spark, sf):
    return A.mobility_to_intervention(nested_claims(spark, sf)).select("claim_id", "claim_kind")


# First fit as a recursion over the baselines of a document: state is the list of group heads so far.
SNAPSHOTS = """b as (select *, row_number() over (partition by doc order by ord) as i, {'dis': dis, 'pth': pth, 'topic': coalesce(dis, pth, case when txt like '%hantavirus%' then 'hantavirus' end), 'scope': scope, 'doms': doms, 'grp': gk} as hint from (
    select doc, ord, coalesce(nullif(group_id, ''), claim_id) as gk, nullif(lower(trim(disease_verbatim)), '') as dis, nullif(lower(trim(pathogen_verbatim)), '') as pth,
      lower(coalesce(group_id, '') || ' ' || coalesce(summary, '') || ' ' || evidence_text || coalesce(' ' || evidence2_text, '')) as txt,
      coalesce('locality:' || lower(loc_locality), 'admin1:' || lower(loc_admin1)) as scope, list_sort(list_filter([domain_a, domain_b], lambda d: d is not null)) as doms
    from {clm} where claim_kind = 'surveillance_baseline' and period_type <> 'historical_period') q),
st as (select distinct doc, cast(0 as bigint) as i, cast([] as struct(dis varchar, pth varchar, topic varchar, scope varchar, doms varchar[], grp varchar)[]) as heads, cast(null as int) as ord, cast(null as varchar) as grp from b
  union all select doc, i, case when fit is null then heads || [hint] else heads end, ord, fit.grp from (
    select s.doc, b.i, s.heads, b.hint, b.ord, list_filter(s.heads, lambda h: h.doms = b.hint.doms and coalesce(h.dis = b.hint.dis, true) and coalesce(h.pth = b.hint.pth, true)
      and coalesce(h.topic = b.hint.topic, false) and coalesce(h.scope = b.hint.scope, false))[1] as fit from st s join b on b.doc = s.doc and b.i = s.i + 1) z)"""


@query(
    "asm06_merge_surveillance_snapshots",
    "select c.doc, c.claim_id, coalesce(st.grp, c.group_id) as group_id from {clm} c left join st on st.doc = c.doc and st.ord = c.ord where c.claim_kind = 'surveillance_baseline'",
    SNAPSHOTS,
)
def _(spark, sf):
    out = A.merge_surveillance_snapshots(nested_claims(spark, sf))
    return out.filter("claim_kind = 'surveillance_baseline'").select("doc", "claim_id", "group_id")


@query(
    "asm07_group_rewrites",
    """select claim_id, k3 as claim_kind, pol3 as polarity, disease2 as disease_verbatim, reported2 as reported, metric_name2 as metric_name, value2 as metric_value, n_locs as n_locations, target2 as target from g5""",
    GROUPS,
)
def _(spark, sf):
    out = A.group_rewrites(nested_claims(spark, sf))
    return out.select(
        "claim_id", "claim_kind", "polarity", "disease_verbatim", F.col("metric.reported").alias("reported"), F.col("metric.name").alias("metric_name"),
        F.col("metric.value_numeric").alias("metric_value"), F.size("locations").alias("n_locations"), F.col("diagnostics.target").alias("target"),
    )


@query(
    "asm08_mobility_window",
    """select g.claim_id, case when claim_kind = 'mobility' and n >= 2 then lo else event_start end as event_start, case when claim_kind = 'mobility' and n >= 2 then hi end as event_end,
      case when claim_kind = 'mobility' and n >= 2 then 'observation_window' else period_type end as period_type, case when claim_kind = 'mobility' and n >= 2 then v else period_verbatim end as period_verbatim
    from g0 g left join (select doc, gk, count(event_start) as n, min(event_start) as lo, max(event_start) as hi,
      string_agg(evidence_text || coalesce(' ' || evidence2_text, ''), ' ' order by ord) as v from g0 where claim_kind = 'mobility' group by doc, gk) m on m.doc = g.doc and m.gk = g.gk""",
    GROUPS.split("\ng1 as")[0].rstrip(","),
)
def _(spark, sf):
    return A.mobility_window(nested_claims(spark, sf)).select(
        "claim_id", F.col("event_date.start").alias("event_start"), F.col("event_date.end").alias("event_end"),
        F.col("reference_period.period_type").alias("period_type"), F.col("reference_period.verbatim").alias("period_verbatim"),
    )


GENOMIC = """gt as (select *, claim_kind = 'genomic_finding' as gen, lower(coalesce(pathogen_verbatim, '')) || ' ' || txt as gtxt from g0),
gw as (select *, bool_or(gen and gtxt like '%orthohantavirus andesense%') over (partition by doc, gk) as best, bool_or(gen and gtxt like '%virus andes%') over (partition by doc, gk) as second,
  bool_or(gen and gtxt like '%variante viral no descripta previamente%') over (partition by doc, gk) as novel from gt)"""


@query(
    "asm09_genomic_group",
    """select claim_id, case when gen and best then 'Orthohantavirus andesense' when gen and second then 'virus Andes' else pathogen_verbatim end as pathogen_verbatim,
      case when gen and novel and sequenced then coalesce(lineage, 'variante viral no descripta previamente') else lineage end as lineage from gw""",
    GROUPS.split("\ng1 as")[0].rstrip(",") + ",\n" + GENOMIC,
)
def _(spark, sf):
    return A.genomic_group(nested_claims(spark, sf)).select("claim_id", "pathogen_verbatim", F.col("genomics.lineage").alias("lineage"))


LABEL = """case when claim_kind = 'outbreak_update' and polarity = 'negative' then 'outbreak_absence' when claim_kind = 'case_status' and polarity = 'negative' then 'case_status_negative'
  when claim_kind in ('outbreak_update', 'case_status', 'death_count') then 'outbreak' when claim_kind = 'surveillance_baseline' then 'baseline'
  when claim_kind in ('wildlife_sampling', 'wildlife_presence_absence') and polarity = 'negative' then 'wildlife_negative' else claim_kind end"""


@query("asm10_bucket_key", f"select claim_id, {LABEL} as bucket, coalesce(nullif(group_id, ''), claim_id) as bucket_group from {{clm}}")
def _(spark, sf):
    return A.bucket_key(nested_claims(spark, sf)).select("claim_id", "bucket", "bucket_group")


# The fold over raw claims: no rewrites first, so every fact comes straight from the flat rows.
FOLD = f"""f0 as (select *, coalesce(nullif(group_id, ''), claim_id) as gk, {LABEL} as bucket from {{clm}}),
f1 as (select *, min(ord) over (partition by doc, gk) as gfirst from f0),
f2 as (select doc, gk, bucket, min(ord) as o, min(gfirst) as g, count(*) as n, list(claim_kind order by ord) as kinds, bool_or(polarity = 'negative') as anyneg, bool_and(polarity = 'negative') as allneg,
    bool_or(claim_kind = 'wildlife_presence_absence' and polarity = 'negative') as wneg,
    round(avg(coalesce(nullif(confidence, 0), 0.5)), 4) as conf, list_distinct(coalesce(list(domain_a) filter (domain_a is not null), []) || coalesce(list(domain_b) filter (domain_b is not null), [])) as doms,
    arg_min(trim(disease_verbatim), ord) filter (trim(disease_verbatim) <> '') as disease, arg_min(trim(pathogen_verbatim), ord) filter (trim(pathogen_verbatim) <> '') as pathogen,
    arg_min(test_result, ord) filter (test_reported or test_result not in ('unknown', 'not_applicable')) as first_result,
    arg_min(sequenced, ord) filter (sequenced or lineage is not null) as first_seq, arg_min(coalesce(lineage, ''), ord) filter (sequenced or lineage is not null) as first_lineage,
    arg_max(human_to_human, ord) filter (human_to_human <> 'unknown') as h2h, arg_max(animal_to_human, ord) filter (animal_to_human <> 'unknown') as a2h,
    arg_min(period_type, ord) filter (period_type <> 'unknown' or period_verbatim is not null) as period_type,
    arg_max(verification_status, (case verification_status when 'confirmed' then 6 when 'probable' then 5 when 'suspected' then 4 when 'reported' then 3 when 'unknown' then 2 else 1 end) * 1000 - ord) as verification,
    list(nullif(trim(summary), '') order by ord) filter (trim(summary) <> '') as sums,
    max(case event_precision when 'day' then 3 when 'month' then 2 else 0 end) as prec from f1 group by doc, gk, bucket),
f3 as (select *, dense_rank() over (partition by doc order by g, o) as nn,
  case when list_contains(kinds, 'outbreak_update') then 'outbreak' when n > 1 and len(list_filter(kinds, lambda k: k not in ('case_status', 'death_count'))) = 0 then 'outbreak'
    when len(list_filter(kinds, lambda k: k <> 'surveillance_baseline')) = 0 then 'baseline' when wneg then 'wildlife_negative' else kinds[1] end as kind from f2),
f4 as (select *, case kind when 'syndromic_cluster' then 'cluster' when 'outbreak' then 'outbreak' when 'baseline' then 'case_report' when 'diagnostic_result' then 'laboratory_result'
    when 'laboratory_investigation' then kind when 'genomic_finding' then 'genomic_observation' when 'transmission_statement' then 'transmission_observation' when 'wildlife_negative' then 'wildlife_event'
    when 'wildlife_sampling' then 'wildlife_event' when 'wildlife_presence_absence' then 'wildlife_event' when 'mobility' then 'travel_or_mobility' when 'historical_context' then 'case_report'
    when 'intervention' then kind when 'official_action' then 'official_alert' when 'case_status' then 'case_report' when 'death_count' then 'mortality_event' else 'other' end as signal_type from f3)"""


def folded(spark, sf, *wanted):
    return A.fold_bucket(nested_claims(spark, sf), *wanted)


@query(
    "asm11_fold_bucket",
    r"""select doc || '-asm-' || lpad(cast(nn as string), 2, '0') as local_signal_id, signal_type, case when coalesce(first_result, 'unknown') = 'negative' or kind = 'wildlife_negative' or (kind = 'outbreak' and allneg) then 'negative_evidence'
        when kind = 'baseline' then 'surveillance_baseline' when kind = 'historical_context' then 'background_context'
        when kind in ('diagnostic_result', 'transmission_statement', 'wildlife_presence_absence', 'case_status') and anyneg then 'negative_evidence' else 'primary_event' end as signal_role,
      cast(conf as double) as extraction_confidence, array_to_string(list_sort(list_distinct(case when len(coalesce(doms, [])) = 0 then ['human'] else doms end || case when signal_type = 'genomic_observation' then ['genomic'] else [] end)), ',') as domains,
      case when lower(disease) like '%hantavirus%' then 'Hantavirus disease' end as disease_name, disease as disease_verbatim,
      case when lower(pathogen) like '%andesense%' then 'Orthohantavirus andesense' when lower(pathogen) like '%andes%' then 'Andes virus' when lower(pathogen) like '%hantavirus%' then 'Hantavirus' end as pathogen_name
    from f4""",
    FOLD,
)
def _(spark, sf):
    return folded(spark, sf, "domains", "signal_role", "signal_type", "disease", "pathogen", "extraction_confidence").select(
        "local_signal_id", "signal_type", "signal_role", "extraction_confidence", F.array_join(F.array_sort("domains"), ",").alias("domains"),
        F.col("disease.canonical_name").alias("disease_name"), F.col("disease.verbatim").alias("disease_verbatim"), F.col("pathogen.canonical_name").alias("pathogen_name"),
    )


@query(
    "asm12_merge_children",
    """select f.doc || '-asm-' || lpad(cast(f.nn as string), 2, '0') as local_signal_id,
      coalesce(h.n, 0) as n_hosts, l.n as n_locations, coalesce(m.n, 0) as n_metrics, e.n as n_evidence from f4 f
    left join (select doc, gk, bucket, count(*) as n from (select distinct doc, gk, bucket, subject_verbatim, case when subject_type = 'human' then coalesce(subject_name, 'Homo sapiens') else subject_name end as nm,
        case when subject_type = 'animal' then 'other' else subject_type end as ty from f0 where subject_type in ('human', 'animal', 'wildlife', 'vector')) q group by doc, gk, bucket) h using (doc, gk, bucket)
    left join (select doc, gk, bucket, count(*) as n from (select distinct doc, gk, bucket, metric_name, metric_value, metric_date from f0 where metric_reported) q group by doc, gk, bucket) m using (doc, gk, bucket)
    left join (select doc, gk, bucket, count(*) as n from (select doc, gk, bucket, loc_admin1 as a, loc_locality as b, loc_role as c from f0 union select doc, gk, bucket, null, 'Town ' || cast(sk % 5 as string), loc2_role from f0 where loc2_role is not null) q group by doc, gk, bucket) l using (doc, gk, bucket)
    left join (select doc, gk, bucket, count(*) as n from (select doc, gk, bucket, evidence_type as a, evidence_text as b from f0 union select doc, gk, bucket, 'text', evidence2_text from f0 where evidence2_text is not null) q group by doc, gk, bucket) e using (doc, gk, bucket)""",
    FOLD,
)
def _(spark, sf):
    return folded(spark, sf, "hosts", "locations", "metrics", "evidence").select(
        "local_signal_id", *[F.size(n).cast("long").alias("n_" + n) for n in ("hosts", "locations", "metrics", "evidence")]
    )


@query(
    "asm13_best_event_date",
    """select f.doc || '-asm-' || lpad(cast(f.nn as string), 2, '0') as local_signal_id, case when f.prec > 0 and d.n > 1 then null else d.s end as event_start, f.prec > 0 and d.n > 1 as conflict
    from f4 f join (select f0.doc, f0.gk, f0.bucket, count(distinct event_start) as n, arg_min(event_start, ord) as s from f0 join f2 on f2.doc = f0.doc and f2.gk = f0.gk and f2.bucket = f0.bucket
      and f2.prec = case event_precision when 'day' then 3 when 'month' then 2 else 0 end group by f0.doc, f0.gk, f0.bucket) d on d.doc = f.doc and d.gk = f.gk and d.bucket = f.bucket""",
    FOLD,
)
def _(spark, sf):
    return folded(spark, sf, "event_date", "notes").select("local_signal_id", F.col("event_date.start").alias("event_start"), (F.size("notes") > 0).alias("conflict"))


@query(
    "asm14_first_informative",
    """select doc || '-asm-' || lpad(cast(nn as string), 2, '0') as local_signal_id, first_result as test_result_raw, coalesce(first_seq, false) as sequence_reported,
      nullif(first_lineage, '') as lineage, coalesce(period_type, 'unknown') as period_type from f4""",
    FOLD,
)
def _(spark, sf):
    s = folded(spark, sf, "diagnostics", "genomics", "reference_period")
    result = F.when(~((F.col("diagnostics.test_reported") == False) & (F.col("diagnostics.result") == "unknown")), F.col("diagnostics.result"))  # noqa: E712
    return s.select(
        "local_signal_id", result.alias("test_result_raw"), F.col("genomics.sequence_reported").alias("sequence_reported"), F.col("genomics.lineage").alias("lineage"),
        F.col("reference_period.period_type").alias("period_type"),
    )


@query(
    "asm15_last_known_transmission",
    "select doc || '-asm-' || lpad(cast(nn as string), 2, '0') as local_signal_id, coalesce(h2h, 'unknown') as human_to_human, coalesce(a2h, 'unknown') as animal_to_human, 'unknown' as vector_borne from f4",
    FOLD,
)
def _(spark, sf):
    return folded(spark, sf, "transmission").select("local_signal_id", "transmission.human_to_human", "transmission.animal_to_human", "transmission.vector_borne")


@query(
    "asm16_verification_summary",
    """select f.doc || '-asm-' || lpad(cast(f.nn as string), 2, '0') as local_signal_id, verification as verification_status,
      case when signal_type in ('outbreak', 'case_report') then coalesce(sums[1], '') else coalesce(u.t, '') end as signal_summary
    from f4 f left join (select doc, gk, bucket, string_agg(s, ' ' order by o) as t from (select doc, gk, bucket, trim(summary) as s, min(ord) as o from f0 where trim(summary) <> '' group by doc, gk, bucket, trim(summary)) q group by doc, gk, bucket) u
      on u.doc = f.doc and u.gk = f.gk and u.bucket = f.bucket""",
    FOLD,
)
def _(spark, sf):
    return folded(spark, sf, "verification_status", "signal_summary").select("local_signal_id", "verification_status", "signal_summary")


@query(
    "asm17_merge_nonrelation",
    """select doc || '-asm-' || lpad(cast(nn as string), 2, '0') as local_signal_id from (
      select *, bool_or(tgt) over (partition by doc) as has from (
        select f4.*, signal_type = 'transmission_observation' and (anyneg or coalesce(first_result, '') = 'negative' or coalesce(a2h, '') = 'refuted') as tgt,
          signal_type = 'genomic_observation' and len(list_filter(sums, lambda s: contains(lower(s), 'diferente'))) > 0 as fnd from f4) q) r
    where not (has and coalesce(fnd, false))""",
    FOLD,
)
def _(spark, sf):
    return A.merge_nonrelation(folded(spark, sf, *A.NONRELATION_READS)).select("local_signal_id")


@query(
    "asm18_dedupe_exact_signals",
    """select min(n_sig) as n, user_id, local_signal_key from (select user_id, local_signal_key, n as n_sig, row_number() over (partition by user_id, human_to_human, animal_to_human, vector_borne order by n) as rn from {sig}) q
    where rn = 1 group by user_id, local_signal_key, n_sig""",
)
def _(spark, sf):
    s = nested_signals(spark, sf).select(
        F.col("raw_item_id").alias("doc"), F.col("n").alias("nn"), F.col("local_signal_key").alias("local_signal_id"), "transmission"
    )
    out = A.dedupe_exact_signals(s)
    return out.select(F.col("nn").alias("n"), F.col("doc").cast("long").alias("user_id"), F.col("local_signal_id").alias("local_signal_key"))


@query(
    "asm19_reclassify_surveillance",
    """select s.signal_id, case when hit then 'surveillance_baseline' else signal_role end as signal_role, case when hit then 'case_report' else signal_type end as signal_type
    from (select s.*, signal_role = 'primary_event' and signal_type in ('outbreak', 'case_report') and m.signal_id is not null and occurred_start is null and period_year is not null and coalesce(l.only_rep, false) as hit
      from {sig} s left join (select distinct signal_id from {sig_metric}) m on m.signal_id = s.signal_id
      left join (select signal_id, bool_and(role = 'reporting_jurisdiction') as only_rep from {sig_loc} where seq = 1 group by signal_id) l on l.signal_id = s.signal_id) s""",
)
def _(spark, sf):
    s = nested_signals(spark, sf)
    only_second = F.filter("locations", lambda x, i: F.size(F.col("locations")) - i == 1)
    second = F.when(F.size("locations") > 1, only_second).otherwise(F.slice("locations", 1, 0))
    out = A.reclassify_surveillance(A.with_notes(s.withColumn("locations", second)))
    return out.select("signal_id", "signal_role", "signal_type")


@query("asm20_assemble")
def _(spark, sf):
    out = A.assemble(nested_claims(spark, sf))
    return out.select(
        "doc", "local_signal_id", "signal_role", "signal_type", "verification_status", "signal_summary", F.size("evidence").alias("n_evidence"),
        F.size("metrics").alias("n_metrics"), F.col("pathogen.canonical_name").alias("pathogen_name"),
    )


_UNSOUND = """bad as (select doc, claim_id as id, 'confidence' as path, 'required' as rule from {clm} where confidence is null
  union all select doc, claim_id, 'metric.as_of_date', 'date' from {clm} where qty % 10 = 0 and length(metric_date) < 10 union all select doc, claim_id, 'evidence[].text', 'literal' from {clm} where qty = 24)"""


@query(
    "asm20_checked_assembly",
    """select doc, 'claims' as stage, id, path, rule from bad union all select distinct doc, 'sound', null, null, null from {clm} where doc not in (select doc from bad)""",
    _UNSOUND,
)
def _(spark, sf):
    # Claims as the contract asks for them, but for missing confidences and imprecise metric dates; the texts lack one quotation.
    source = nested_claims(spark, sf, "qty")
    said = lambda x: F.when(x == "documented", "confirmed").when(x == "possible", "suspected").otherwise(x)
    t, m = F.col("transmission"), F.col("metric")
    claims = source.withColumns({
        "group_id": F.coalesce(F.nullif("group_id", F.lit("")), "claim_id"), "summary": F.when(F.trim("summary") == "", "Claim").otherwise(F.col("summary")),
        "domains": F.when(F.size("domains") == 0, F.array(F.lit("human"))).otherwise(F.col("domains")),
        "diagnostics": F.col("diagnostics").withField("result", F.coalesce("diagnostics.result", F.lit("unknown"))),
        "transmission": F.struct(*[said(t[n]).alias(n) for n in ("human_to_human", "animal_to_human", "vector_borne")]),
        "metric": m.withField("as_of_date", F.when((F.length(m["as_of_date"]) == 10) | (F.col("qty") % 10 == 0), m["as_of_date"])),
    }).drop("qty")
    numbers = F.filter(F.sequence(F.lit(1), F.lit(50)), lambda n: n != 24)
    quotes = F.array_join(F.transform(numbers, lambda n: F.concat(F.lit("obs "), n.cast("string"), F.lit(" virus Andes obs "), n.cast("string"))), " ")
    raw = view(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("raw_item_id"), F.concat(quotes, F.lit(" obs common "), F.col("o_orderkey").cast("string")).alias("raw_text"))
    signals, failures = A.checked_assembly(claims, raw)
    none = F.lit(None).cast("string")
    sound = claims.select("doc").distinct().join(failures.select("doc").distinct(), "doc", "left_anti")
    return failures.select("doc", "stage", "id", "path", "rule").unionByName(sound.select("doc", F.lit("sound").alias("stage"), none.alias("id"), none.alias("path"), none.alias("rule")))


@query("asm20_assembly_notes")
def _(spark, sf):
    out = A.assemble_marked(nested_claims(spark, sf))
    return out.select("doc", "local_signal_id", F.array_join("notes", "; ").alias("notes"), "dropped")


@query("asm20_dropped_claims")
def _(spark, sf):
    return A.dropped_claims(nested_claims(spark, sf)).select("doc", "claim_id", "reason")
