"""Registered queries for review, provenance and streams (RV, ST)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentinelweave.functions.text import paragraphs
from sentinelweave.operators import review as R
from sentinelweave.operators.ingest import KEY, merge_arrivals
from sentinelweave.operators.relations import upsert_relations
from sentinelweave.plans.nested import nested_claims, nested_signals
from sentinelweave.plans.queries_assembly import FOLD, folded
from sentinelweave.plans.queries_matching import ANCHOR_PAIRS, live_index
from sentinelweave.plans.registry import query
from sentinelweave.plans.views import view
from sentinelweave.streaming import streams


@query(
    "rv1_claim_hints",
    """select claim_id, 'REVIEW-LOCALITY-QUOTE' as code, 'locations[0].locality' as field from {clm} where loc_locality is not null
    union all select claim_id, 'REVIEW-LOCALITY-QUOTE', 'locations[1].locality' from {clm} where loc2_role is not null
    union all select claim_id, 'REVIEW-TEST-RESULT', 'diagnostics' from {clm} where not test_reported and test_result in ('positive', 'negative', 'pending')
    union all select claim_id, 'REVIEW-INVESTIGATION-STATE', 'diagnostics.result' from {clm} where claim_kind = 'laboratory_investigation' and coalesce(test_result, '') <> 'pending'""",
)
def _(spark, sf):
    return R.claim_hints(nested_claims(spark, sf)).select("claim_id", "code", "field")


PROVENANCE = """mk as (select doc, metric_name, metric_value, metric_date, count(*) as n from {clm} where metric_reported group by doc, metric_name, metric_value, metric_date),
sm as (select distinct f.doc, f.nn, x.metric_name, x.metric_value, x.metric_date from f4 f join f0 x on x.doc = f.doc and x.gk = f.gk and x.bucket = f.bucket where x.metric_reported)"""


@query(
    "rv2_metric_provenance",
    """select sm.doc || '-asm-' || lpad(cast(nn as string), 2, '0') as local_signal_id, sm.metric_name, n as candidates, case when n = 1 then 'unique_metric_match' else 'ambiguous_metric_match' end as binding_status
    from sm join mk on mk.doc = sm.doc and mk.metric_name is not distinct from sm.metric_name and mk.metric_value is not distinct from sm.metric_value and mk.metric_date is not distinct from sm.metric_date""",
    FOLD + ",\n" + PROVENANCE,
)
def _(spark, sf):
    return R.metric_provenance(nested_claims(spark, sf), folded(spark, sf, "metrics")).select("local_signal_id", "metric_name", "candidates", "binding_status")


@query(
    "rv3_attribution_hints",
    """select code, count(*) as n from (
      select case when p.f in ('country', 'admin1') and raw_has then 'REVIEW-LOCATION-QUOTE' else 'REVIEW-LOCATION-DOCUMENT' end as code from (
        select c.claim_id, 'country' as f, c.n_doc % 2 = 0 as raw_has from {clm} c union all select claim_id, 'admin1', false from {clm} union all select claim_id, 'locality', false from {clm} where loc_locality is not null
        union all select claim_id, 'country', n_doc % 2 = 0 from {clm} where loc2_role is not null union all select claim_id, 'locality', false from {clm} where loc2_role is not null) p
      union all select 'REVIEW-METRIC-BINDING' from sm join mk on mk.doc = sm.doc and mk.metric_name is not distinct from sm.metric_name and mk.metric_value is not distinct from sm.metric_value and mk.metric_date is not distinct from sm.metric_date where n > 1) q group by code""",
    FOLD + ",\n" + PROVENANCE,
)
def _(spark, sf):
    raw = view(spark, sf, "clm").select("doc", "n_doc").distinct().select("doc", F.when(F.col("n_doc") % 2 == 0, "Desde  ARGENTINA, parte").otherwise("Argentinas").alias("raw_text"))
    out = R.attribution_hints(nested_claims(spark, sf), folded(spark, sf, "metrics"), raw)
    return out.groupBy("code").agg(F.count("*").alias("n"))


@query("rv4_resolve_spans")
def _(spark, sf):
    d = view(spark, sf, "doc").select(F.col("raw_item_id").alias("doc"), F.sha2("raw_text", 256).alias("source_sha256"), "raw_text")
    p = d.select("doc", "source_sha256", F.explode(paragraphs("raw_text")).alias("p")).select("doc", "source_sha256", "p.*")
    refs = p.select("doc", F.col("id").alias("paragraph_id"), F.lit(0).alias("start"), F.least(F.length("text"), F.lit(25)).alias("end"), "source_sha256")
    out = R.resolve_spans(refs, p)
    return out.select("doc", "paragraph_id", "quote", "unicode_start", "unicode_end", "reason")


@query(
    "rv5_audit_decisions",
    """select event_id as review_id, array_to_string(list_filter([case when event_id % 9 = 4 then 'missing_decision' end, case when event_id % 9 <> 4 and event_id % 10 = 1 then 'unsupported_disposition' end,
        case when event_id % 9 <> 4 and event_id % 8 = 2 then 'proposal_mismatch' end, case when event_id % 9 <> 4 and event_id % 12 = 5 then 'invalid_date' end, case when event_id % 7 = 3 then 'artifact_changed' end, case when event_id % 11 = 6 then 'observed_mismatch' end], lambda x: x is not null), ',') as broken
    from {events} where event_id % 9 = 4 or event_id % 10 = 1 or event_id % 8 = 2 or event_id % 12 = 5 or event_id % 7 = 3 or event_id % 11 = 6""",
)
def _(spark, sf):
    e = view(spark, sf, "events")
    n = F.col("event_id")
    value = F.get_json_object("props", "$.k")
    rows = e.select(
        n.alias("review_id"), F.col("user_id").cast("string").alias("document_id"), F.lit("$.k").alias("field_pointer"), F.when(n % 11 == 6, "x").otherwise(value).alias("observed_value"),
        F.lit("new").alias("proposed_value"), F.lit("replace").alias("proposed_action"), n.alias("artifact_id"), F.when(n % 7 == 3, "0").otherwise(F.sha2("props", 256)).alias("artifact_sha256"),
        F.lit(0).alias("span_start"), F.length("event_type").alias("span_end"), F.col("event_type").alias("excerpt"),
    )
    arts = e.select(n.alias("artifact_id"), F.try_parse_json("props").alias("body"), F.sha2("props", 256).alias("sha256"), F.concat("event_type", F.lit(" and more")).alias("raw_text"))
    decided = e.filter(n % 9 != 4).select(
        n.alias("review_id"), F.col("user_id").cast("string").alias("document_id"), F.lit("$.k").alias("field_pointer"), F.when(n % 10 == 1, "delete").otherwise("accept_review_proposal").alias("disposition"),
        F.when(n % 8 == 2, "old").otherwise("new").alias("proposal_value"), F.when(n % 12 == 5, "2026-02-30").otherwise("2026-02-03").alias("decided_on"), F.lit(False).alias("applied"), F.lit("because").alias("rationale"),
    )
    bad, _ = R.audit_decisions(decided, rows, arts)
    return bad.select("review_id", F.array_join("broken", ",").alias("broken"))


def _stream_documents(spark, sf, folder):
    """The documents as at least four micro-batches."""
    n = F.col("doc_id")
    rows = view(spark, sf, "documents").select(
        n.alias("arrival"), F.concat(F.lit("src"), (n % 5).cast("string")).alias("source_code"), F.concat(F.lit("https://example.org/a/"), (n % 97).cast("string")).alias("url"),
        F.when(n % 4 != 0, F.concat(F.lit("Title "), (n % 11).cast("string"))).alias("title"), F.lit(None).cast("date").alias("published_on"), F.col("lang").alias("language"),
        F.when(n % 5 != 1, "text/html").alias("mime_type"), F.col("text").alias("raw_text"), F.timestamp_seconds(n * 60).alias("seen_at"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
    )
    return streams.in_parts(rows, folder, 4, "arrival")


STORED_ITEMS = "raw_item_id string, source_code string, content_sha256 string, url string, title string, published_on date, language string, mime_type string, raw_text string, retrieved_at timestamp, metadata map<string,string>"


@query(
    "st1_stream_raw_items",
    r"""select source_code, content_sha256, url, title, arrivals, md5(raw_text) as text_md5 from (select 'src' || cast(doc_id % 5 as string) as source_code, sha256(t) as content_sha256, arg_max('https://example.org/a/' || cast(doc_id % 97 as string), doc_id) as url,
      arg_max(case when doc_id % 4 <> 0 then 'Title ' || cast(doc_id % 11 as string) end, doc_id) filter (doc_id % 4 <> 0) as title, count(*) as arrivals, arg_min(text, doc_id) as raw_text
      from (select doc_id, text, trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g')) as t from {documents}) q where t <> '' group by doc_id % 5, t) r""",
)
def _(spark, sf):
    folder = streams.run_folder(spark)
    documents = _stream_documents(spark, sf, folder + "/arrivals")
    sources = view(spark, sf, "doc").select("source_code").distinct().withColumn("is_active", F.lit(True))
    log = streams.ChangeLog(spark, folder + "/items", streams.arrivals_schema(documents, sources))
    streams.stream_raw_items(documents, log, sources, folder + "/checkpoint").awaitTermination()
    table = merge_arrivals(log.newest(*KEY), spark.createDataFrame([], STORED_ITEMS))
    return table.select("source_code", "content_sha256", "url", "title", "arrivals", F.md5("raw_text").alias("text_md5"))


@query(
    "st2_stream_matches",
    """select distinct source_id, target_id, relation, case when guard is null then decision else 'review_required' end as decision,
      cast(round(cast(score as decimal(12, 6)), 3) as double) as score, score as raw_score, coverage as information_coverage, guard as auto_link_guard_reason, 'inserted' as action
    from guarded where ok""",
    ANCHOR_PAIRS,
)
def _(spark, sf):
    folder = streams.run_folder(spark)
    index, signals, raw = live_index(spark, sf), nested_signals(spark, sf), view(spark, sf, "raw_text")
    empty = spark.createDataFrame([], "source_id string, target_id string, relation string, producer string, relation_id string, created_at timestamp, score double, decision string, merge_allowed boolean, hard_conflict boolean")
    arrivals = streams.in_parts(view(spark, sf, "events").select(F.col("event_id").cast("string").alias("signal_id")), folder + "/arrivals", 3, "signal_id")
    log = streams.ChangeLog(spark, folder + "/relations", streams.RELATION_ROWS)
    streams.stream_matches(arrivals, lambda: index, lambda: signals, lambda: raw, log, empty, folder + "/checkpoint").awaitTermination()
    table = upsert_relations(streams.newest_relations(log), empty, index.select("signal_id"))
    return table.select("source_id", "target_id", "relation", "decision", "score", "raw_score", "information_coverage", "auto_link_guard_reason", "action")
