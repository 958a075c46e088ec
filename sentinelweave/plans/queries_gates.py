"""Registered queries for gates, validation and table audits (FLT, VAL, DQ)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentinelweave.operators import gates as G
from sentinelweave.operators import validation as V
from sentinelweave.plans.nested import nested_claims, nested_signals, signal_rows
from sentinelweave.plans.registry import query
from sentinelweave.plans.views import run_sql, view

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


@query("flt1_current_eligible", "select signal_id from {sig_eligible} where is_current and event_matching_eligible")
def _(spark, sf):
    return G.current_eligible(view(spark, sf, "sig_eligible")).select("signal_id")


@query("flt2_event_matching_eligible", "select signal_id, event_matching_eligible as eligible from {sig_eligible}")
def _(spark, sf):
    s = signal_rows(spark, sf)
    gate = G.event_matching_eligible(F.col("signal_role"), F.col("signal_type"), F.col("disease"), F.col("pathogen"))
    return s.select("signal_id", gate.alias("eligible"))


@query("flt3_manifest_eligible", "select signal_id, signal_role in ('primary_event', 'negative_evidence') and signal_type <> 'official_alert' as eligible from {sig}")
def _(spark, sf):
    return view(spark, sf, "sig").select("signal_id", G.manifest_eligible(F.col("signal_role"), F.col("signal_type")).alias("eligible"))


@query(
    "flt4_suppress_claims",
    """select claim_id, case when claim_kind = 'laboratory_investigation' and not metric_reported and not test_reported and not sequenced and t like '%investigando el origen del brote%' then 'generic_investigation'
      when claim_kind = 'surveillance_baseline' and polarity = 'negative' and not metric_reported and period_type = 'historical_period' then 'negative_history'
      when claim_kind = 'intervention' and not metric_reported and t like '%capacit%' then 'training_intervention' else 'kept' end as reason
    from (select *, lower(coalesce(summary, '') || ' ' || evidence_text) as t from {clm}) q""",
)
def _(spark, sf):
    kept, dropped = G.suppress_claims(nested_claims(spark, sf))
    return kept.select("claim_id", F.lit("kept").alias("reason")).unionByName(dropped.select("claim_id", "reason"))


@query(
    "flt5_drop_operational",
    """select claim_id, claim_kind = 'intervention' and not metric_reported and lower(summary) like '%capacit%' as dropped from {clm}""",
)
def _(spark, sf):
    c = nested_claims(spark, sf)
    metrics = F.filter(F.array("metric"), lambda m: m["reported"])
    s = c.select("claim_id", F.col("claim_kind").alias("signal_type"), metrics.alias("metrics"), F.col("summary").alias("signal_summary"), "evidence")
    kept, dropped = G.drop_operational_signals(s)
    return kept.select("claim_id", F.lit(False).alias("dropped")).unionByName(dropped.select("claim_id", F.lit(True).alias("dropped")))


@query(
    "flt6_nonbiological_hosts",
    """select signal_id, count(*) filter (where not (n % 9 in (3, 5) and seq = 0)) as kept from {sig_host} group by signal_id""",
)
def _(spark, sf):
    # Two host wordings are turned into an institution and a vessel, one look-alike word is not.
    word = F.when((F.col("seq") == 0) & (F.col("n") % 9 == 3), "El Hospital  central").when((F.col("seq") == 0) & (F.col("n") % 9 == 5), "EMBARCACIÓN").when(
        (F.col("seq") == 0) & (F.col("n") % 9 == 7), "barcos").otherwise(F.col("verbatim"))
    h = view(spark, sf, "sig_host").withColumn("verbatim", word)
    lists = h.groupBy("signal_id").agg(F.collect_list(F.struct("verbatim", "canonical_name", "host_type")).alias("hosts"))
    return lists.select("signal_id", F.size(G.biological_hosts(F.col("hosts"))).cast("long").alias("kept"))


@query(
    "val1_literal_evidence",
    f"""select e.raw_item_id, e.signal_id, cast(e.seq as int) as pos, case when trim(e.text) = '' then 'blank' else 'not_literal' end as reason
    from {{sig_evidence}} e join {{raw_text}} r on r.raw_item_id = e.raw_item_id
    where trim(e.text) = '' or not contains(trim(regexp_replace(r.raw_text, '{SPACE}', ' ', 'g')), trim(regexp_replace(e.text, '{SPACE}', ' ', 'g')))""",
)
def _(spark, sf):
    return V.literal_evidence(nested_signals(spark, sf), view(spark, sf, "raw_text"))


_BIND = """select raw_item_id, case when arrival % 7 = 0 then 'xx' else language end as language, case when arrival % 6 = 1 then null else published_on end as published_on from {doc}
  union all select raw_item_id || 'x', language, published_on from {doc} where arrival % 90 = 1"""


@query(
    "val2_document_binding",
    """select p.raw_item_id, array_to_string(list_filter([case when d.raw_item_id is null then 'unknown_document' end,
        case when d.raw_item_id is not null and p.language is distinct from d.language then 'language' end,
        case when d.raw_item_id is not null and p.published_on is distinct from d.published_on then 'published_on' end], lambda x: x is not null), ',') as different
    from p left join {doc} d on d.raw_item_id = p.raw_item_id where d.raw_item_id is null or p.language is distinct from d.language or p.published_on is distinct from d.published_on""",
    f"p as ({_BIND})",
)
def _(spark, sf):
    bad = V.document_binding(run_sql(spark, sf, _BIND), view(spark, sf, "doc"), ["language", "published_on"])
    return bad.select("raw_item_id", F.array_join("different", ",").alias("different"))


@query("val3_event_date_policy", "select claim_id from {clm} where not (event_start is null and event_precision = 'unknown')")
def _(spark, sf):
    return V.event_date_policy(nested_claims(spark, sf)).select("claim_id")


@query(
    "val4_contract_check",
    """select claim_id, array_to_string(list_filter([case when claim_id like '%-2' then 'claim_id:uuid' end, case when confidence is null then 'confidence:required' end, case when confidence > 0.8 then 'confidence:range' end,
        case when domain_a is null and domain_b is null then 'domains:min_items' end, case when event_start is not null and claim_kind = 'mobility' and false then '' end,
        case when period_from < 2020 then 'reference_period.start.year:min' end, case when coalesce(trim(summary), '') = '' then 'summary:non_blank' end,
        case when verification_status = 'reported' then 'verification_status:enum' end], lambda x: x is not null), ',') as failures
    from {clm} where claim_id like '%-2' or confidence is null or confidence > 0.8 or (domain_a is null and domain_b is null) or period_from < 2020 or coalesce(trim(summary), '') = '' or verification_status = 'reported'""",
)
def _(spark, sf):
    c = nested_claims(spark, sf)
    rules = [
        V.Rule("probe", "uuid"), V.Rule("confidence", "required"), V.Rule("confidence", "range", (0, 0.8)), V.Rule("domains", "min_items", 1),
        V.Rule("event_date.start", "date"), V.Rule("reference_period.start.year", "min", 2020), V.Rule("summary", "non_blank"),
        V.Rule("verification_status", "enum", [v for v in V.VERIFICATION if v != "reported"]), V.Rule("domains", "items_enum", ["human", "animal", "environment"]),
    ]
    # Ids ending in -2 carry a malformed uuid, all others a valid one.
    probe = F.when(F.col("claim_id").endswith("-2"), "not-a-uuid").otherwise("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
    bad = V.contract_check(c.withColumn("probe", probe), ["claim_id"], rules)
    path = F.replace("path", F.lit("probe"), F.lit("claim_id"))
    order = F.struct((path != "claim_id").alias("later"), "position", F.concat(path, F.lit(":"), F.col("rule")).alias("text"))
    listed = bad.groupBy("claim_id").agg(F.array_sort(F.collect_list(order)).alias("fs"))
    return listed.select("claim_id", F.array_join(F.transform("fs", lambda f: f["text"]), ",").alias("failures"))


@query("val5_finite_numbers", "select event_id from {events} where event_id % 11 in (3, 7)")
def _(spark, sf):
    v = F.when(F.col("event_id") % 11 == 3, float("nan")).when(F.col("event_id") % 11 == 7, float("-inf")).otherwise(F.col("value"))
    e = view(spark, sf, "events").select("event_id", F.struct(F.lit("a").alias("name"), F.array(F.struct(F.lit(1.0).alias("x")), F.struct(v.alias("x"))).alias("deep")).alias("p"))
    return e.filter(V.unfinite_numbers(e)).select("event_id")


@query(
    "val6_unique_ids",
    "select l_orderkey as doc, cast(l_linenumber as string) as id, count(*) as n, 'repeated' as reason from {lineitem} group by l_orderkey, l_linenumber having count(*) > 1",
)
def _(spark, sf):
    li = view(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("string").alias("id"))
    return V.unique_ids(li, "doc", "id")


@query("val7_token_usage", "select run_id, input_tokens is not null or output_tokens is not null as usage_reported, coalesce(input_tokens >= 0, true) as usage_valid from {run}")
def _(spark, sf):
    return V.token_usage(view(spark, sf, "run")).select("run_id", "usage_reported", "usage_valid")


_PAIRS = """select case when n % 70 = 3 then 'dup' when n % 71 = 3 then '' else relation_id end as pair_id, source_id, case when n % 53 = 1 then source_id else target_id end as target_id, gate as expected_gate,
  case when gate = 'ineligible' and n % 3 = 0 then null when n % 61 = 2 then 'other' else relation end as expected_relation, case when gate = 'ineligible' and n % 3 = 0 then null else decision end as expected_decision,
  merge_allowed and decision <> 'rejected' as expected_merge_allowed, hard_conflict as expected_hard_conflict, case when n % 2 = 0 then 'r' else null end as expected_hard_conflict_reason
  from (select *, cast(substr(relation_id, 2) as bigint) as n from {rel}) q"""


@query(
    "val8_pair_contract",
    """select reason, count(*) as n from (select unnest(list_filter([case when pair_id = '' then 'blank_id' end, case when source_id = target_id then 'self_pair' end,
      case when expected_gate = 'ineligible' and (expected_relation is not null or expected_decision is not null or expected_merge_allowed or expected_hard_conflict) then 'ineligible_with_outcome' end,
      case when expected_gate = 'eligible' and expected_relation = 'other' then 'invalid_relation' end, case when expected_hard_conflict and expected_hard_conflict_reason is null then 'conflict_without_reason' end,
      case when expected_gate = 'eligible' and expected_hard_conflict and (expected_merge_allowed or expected_decision <> 'rejected') then 'conflict_not_rejected' end,
      case when expected_gate = 'eligible' and expected_decision = 'auto_linked' and not expected_merge_allowed then 'auto_link_not_mergeable' end], lambda x: x is not null)) as reason from p
    union all select 'repeated_id' from (select pair_id from p group by pair_id having count(*) > 1) d) q group by reason""",
    f"p as ({_PAIRS})",
)
def _(spark, sf):
    return V.pair_contract(run_sql(spark, sf, _PAIRS)).groupBy("reason").agg(F.count("*").alias("n"))


@query("dq1_audit_unique", "select domain_b, user_id, count(*) as n from {sig} where is_current group by domain_b, user_id having count(*) > 1")
def _(spark, sf):
    return V.audit_unique(view(spark, sf, "sig").filter("is_current"), ["domain_b", "user_id"])


@query("dq2_audit_foreign_keys", "select m.signal_id, m.event_id from {mem} m where not exists (select 1 from {sig} s where s.signal_id = m.signal_id)")
def _(spark, sf):
    return V.audit_foreign_keys(view(spark, sf, "mem"), view(spark, sf, "sig"), "signal_id").select("signal_id", "event_id")


@query(
    "dq3_audit_checks",
    """select run_id, 'succeeded_has_output' as check_name from {run} where status = 'succeeded' and output_json is null
    union all select run_id, 'failed_has_error' from {run} where status = 'failed' and error_text is null union all select run_id, 'input_tokens_not_negative' from {run} where input_tokens < 0""",
)
def _(spark, sf):
    return V.audit_checks(view(spark, sf, "run"), "run_id", V.run_checks())


# Stored rows of every audited table, with defects by modulo, and the twin of each check.
STORED = {
    "signals": (
        """select n, version - n % 7 as version, occurred_start, case when n % 31 = 3 then occurred_start - interval '1' day else occurred_end end as occurred_end, case when n % 37 = 4 then null else n % 40 / 38.0 end as extraction_confidence,
          signal_role, case when n % 41 = 5 then 'rumour' else signal_type end as signal_type, verification_status, domain_a, case when n % 43 = 6 then 'space' else domain_b end as domain_b from {sig}""",
        {"version_positive": "version <= 0", "dates_ordered": "occurred_end < occurred_start", "confidence_given": "extraction_confidence is null", "extraction_confidence_in_unit": "extraction_confidence > 1",
         "signal_type_allowed": "signal_type = 'rumour'", "domains_allowed": "domain_b = 'space'"},
    ),
    "signal_metrics": ("select n, case when n % 11 = 5 then null else value_numeric end as value_numeric, value_text from {sig_metric}", {"has_value": "value_numeric is null and value_text is null"}),
    "signal_evidence": (
        "select n * 10 + seq as n, page_number, n % 50 as char_start, case when n % 6 = 0 then null else n % 50 + n % 9 - 1 end as char_end from {sig_evidence}",
        {"page_positive": "page_number <= 0", "chars_ordered": "char_end < char_start"},
    ),
    "signal_relations": (
        "select relation_id as n, source_id, case when crc % 17 = 0 then source_id else target_id end as target_id, score + case when crc % 19 = 0 then 0.6 else 0 end as score, case when crc % 23 = 0 then 'follows' else relation end as relation, decision from (select *, cast(substr(relation_id, 2) as bigint) as crc from {rel}) q",
        {"not_self": "source_id = target_id", "score_in_unit": "score > 1", "relation_allowed": "relation = 'follows'"},
    ),
    "snapshot_heads": ("select n, raw_item_id, case when n % 29 = 0 then null else run_id end as run_id, n % 10 as revision from {run}", {"revision_positive": "revision <= 0", "run_given": "run_id is null"}),
    "snapshot_promotions": (
        """select n, n % 10 as revision, case when n % 13 = 1 then '  ' else 'ana' end as actor, case when n % 17 = 1 then null else 'checked' end as reason,
          case n % 3 when 0 then 'legacy_adoption' when 1 then 'candidate_promotion' else case when n % 11 = 2 then 'copy' else 'legacy_adoption' end end as operation,
          case when n % 3 = 1 and n % 19 <> 1 then null when n % 23 = 2 then 'abc' when n % 27 = 3 then null else sha256(cast(n as string)) end as baseline_state_sha256 from {run}""",
        {"revision_positive": "revision <= 0", "actor_given": "trim(actor) = ''", "reason_given": "reason is null", "operation_allowed": "operation = 'copy'",
         "adoption_has_state": "case when operation = 'legacy_adoption' then baseline_state_sha256 is null or length(baseline_state_sha256) <> 64 else baseline_state_sha256 is not null end"},
    ),
}


def _audited(table, rows):
    def run(spark, sf):
        df = run_sql(spark, sf, rows.replace("sha256(cast(n as string))", "sha2(cast(n as string), 256)"))
        if table == "signals":
            df = df.withColumn("domains", F.array_compact(F.array("domain_a", "domain_b")))
        return V.audit_checks(df, "n", V.table_checks(table))

    return run


for _table, (_rows, _tests) in STORED.items():
    query(f"dq3_audit_{_table}", " union all ".join(f"select n, '{name}' as check_name from t where {test}" for name, test in _tests.items()), f"t as ({_rows})")(_audited(_table, _rows))
