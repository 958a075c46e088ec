"""Review hints, metric provenance, span references and decision audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sentinelweave.functions.text import casefold, squash, strip_text, whole_term
from sentinelweave.operators.gates import yes

# Fields checked for attribution, generic metric names, case-status wording, dispositions.
LOCATION_FIELDS = ["country", "admin1", "admin2", "locality", "region"]
GENERIC_METRICS = ["case_count", "case count", "case counts", "cases", "casos", "conteo de casos"]
STATUS_CUES = r"(?iU)(?<!\w)(?:confirmed|confirmados?|confirmadas?|probable|probables|suspected|sospechosos?|sospechosas?)(?!\w)"
DISPOSITIONS = ["accept_review_proposal", "reject_review_proposal", "retain_validation_failure", "confirm_current_value", "abstain"]
REPORTED_RESULTS = ["positive", "negative", "pending", "inconclusive"]
METRIC_FIELDS = ["name", "value_numeric", "value_text", "unit", "as_of_date", "as_of_year", "as_of_month", "as_of_precision", "as_of_verbatim"]


def _quoted(value: Column, evidence: Column) -> Column:
    return F.exists(F.transform(evidence, lambda e: F.coalesce(e["text"], F.lit(""))), lambda t: yes(whole_term(value, t)))


def claim_hints(claims: DataFrame) -> DataFrame:
    """Lexical hints on single claims, one row per hint; nothing is changed or rejected."""
    base = claims.select("doc", "claim_id", "claim_kind", "locations", "diagnostics", "evidence")
    places = base.select("doc", "claim_id", "evidence", F.posexplode("locations").alias("pos", "x"))
    named = strip_text(F.coalesce("x.locality", F.lit(""))) != ""
    absent = places.filter(named & ~_quoted(F.col("x.locality"), F.col("evidence"))).select(
        "doc", "claim_id", F.lit("REVIEW-LOCALITY-QUOTE").alias("code"), F.format_string("locations[%d].locality", "pos").alias("field"), F.col("x.locality").alias("value")
    )
    d = F.col("diagnostics")
    untested = yes(~d["test_reported"]) & yes(d["result"].isin(REPORTED_RESULTS))
    idle = yes(F.col("claim_kind") == "laboratory_investigation") & ~yes(d["result"] == "pending")
    flags = F.array_compact(F.array(
        F.when(untested, F.struct(F.lit("REVIEW-TEST-RESULT").alias("code"), F.lit("diagnostics").alias("field"))),
        F.when(idle, F.struct(F.lit("REVIEW-INVESTIGATION-STATE").alias("code"), F.lit("diagnostics.result").alias("field"))),
    ))
    state = base.select("doc", "claim_id", F.explode(flags).alias("f")).select("doc", "claim_id", "f.code", "f.field", F.lit(None).cast("string").alias("value"))
    return absent.unionByName(state)


def metric_provenance(claims: DataFrame, signals: DataFrame) -> DataFrame:
    """Every signal metric with the number of exactly equal reported claim metrics.

    ``claims``: doc, claim_id, ord, metric; ``signals``: doc, local_signal_id, metrics.
    ``first_claim`` is the earliest candidate; the candidates themselves stay rows and
    can be read with :func:`metric_candidates`.
    """
    m = signals.select("doc", "local_signal_id", F.posexplode("metrics").alias("pos", "m")).select("doc", "local_signal_id", "pos", "m", _digest("m").alias("k"))
    c = claims.filter(yes(F.col("metric.reported"))).select("doc", "claim_id", "ord", _digest("metric").alias("k"))
    counted = c.groupBy("doc", "k").agg(F.count("*").alias("candidates"), F.min_by("claim_id", "ord").alias("first_claim"))
    j = m.join(counted, ["doc", "k"], "left")
    status = F.when(F.col("candidates") == 1, "unique_metric_match").when(F.col("candidates") > 1, "ambiguous_metric_match").otherwise("unmatched")
    return j.select("doc", "local_signal_id", "pos", F.col("m.name").alias("metric_name"), F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"), "first_claim", status.alias("binding_status"))


def _digest(name: str) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(f"{name}.{f}").alias(f) for f in sorted(METRIC_FIELDS)]), {"ignoreNullFields": "false"}), 256)


def metric_candidates(claims: DataFrame, signals: DataFrame) -> DataFrame:
    """All (signal metric, equal claim metric) rows of a document."""
    m = signals.select("doc", "local_signal_id", F.posexplode("metrics").alias("pos", "m")).select("doc", "local_signal_id", "pos", _digest("m").alias("k"))
    c = claims.filter(yes(F.col("metric.reported"))).select("doc", "claim_id", _digest("metric").alias("k"))
    return m.join(c, ["doc", "k"]).drop("k")


def attribution_hints(claims: DataFrame, signals: DataFrame, raw: DataFrame) -> DataFrame:
    """Places absent from their quotations, unclear metric bindings, generic metrics with status wording.

    ``raw``: doc, raw_text.  Only claims with an absent place are joined to their text.
    """
    fields = F.array(*[F.struct(F.lit(f).alias("name"), F.col("x")[f].alias("value")) for f in LOCATION_FIELDS])
    places = claims.select("doc", "claim_id", "evidence", F.posexplode("locations").alias("pos", "x")).select("doc", "claim_id", "evidence", "pos", F.explode(fields).alias("p"))
    named = strip_text(F.coalesce("p.value", F.lit(""))) != ""
    absent = places.filter(named & ~_quoted(F.col("p.value"), F.col("evidence"))).select(
        "doc", "claim_id", F.concat(F.format_string("locations[%d].", "pos"), "p.name").alias("field"), F.col("p.value").alias("value")
    )
    located = absent.join(raw.select("doc", "raw_text"), "doc", "left")
    present = yes(whole_term(F.col("value"), F.coalesce("raw_text", F.lit(""))))
    location = located.select("doc", F.col("claim_id").alias("item"), F.when(present, "REVIEW-LOCATION-QUOTE").otherwise("REVIEW-LOCATION-DOCUMENT").alias("code"), "field", "value")
    bound = metric_provenance(claims, signals)
    pointer = F.concat(F.lit("metrics["), F.col("pos").cast("string"), F.lit("]"))
    unclear = bound.filter("binding_status <> 'unique_metric_match'").select("doc", F.col("local_signal_id").alias("item"), F.lit("REVIEW-METRIC-BINDING").alias("code"), pointer.alias("field"), F.col("binding_status").alias("value"))
    generic = bound.filter("binding_status = 'unique_metric_match'").filter(casefold(squash(F.coalesce("metric_name", F.lit("")))).isin(GENERIC_METRICS))
    source = claims.select("doc", F.col("claim_id").alias("first_claim"), F.array(F.col("subject.verbatim"), F.col("metric.name"), F.col("summary")).alias("said"))
    cued = generic.join(source, ["doc", "first_claim"]).filter(F.exists("said", lambda t: yes(t.rlike(STATUS_CUES))))
    classed = cued.select("doc", F.col("local_signal_id").alias("item"), F.lit("REVIEW-METRIC-CLASSIFICATION-SOURCE").alias("code"), pointer.alias("field"), F.col("metric_name").alias("value"))
    return location.unionByName(unclear).unionByName(classed)


def resolve_spans(refs: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """References (doc, paragraph_id, start, end) to literal quotes, or a reason.

    ``paragraphs``: doc, id, start, end, text and source_sha256.
    """
    p = paragraphs.select("doc", F.col("id").alias("paragraph_id"), F.col("start").alias("p_start"), "text", F.col("source_sha256").alias("p_sha"))
    j = refs.join(p, ["doc", "paragraph_id"], "left")
    repeated = refs.groupBy("doc", "paragraph_id", "start", "end").agg(F.count("*").alias("__n"))
    j = j.join(repeated, ["doc", "paragraph_id", "start", "end"])
    quote = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    inside = yes((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text")))
    reason = (
        F.when(F.col("text").isNull(), "unknown_paragraph").when(~yes(F.col("source_sha256") == F.col("p_sha")), "source_changed")
        .when(~inside, "out_of_bounds").when(F.col("__n") > 1, "duplicate_span").when(strip_text(quote) == "", "blank_quote")
    )
    ok = reason.isNull()
    return j.select(
        "doc", "paragraph_id", "start", "end", F.when(ok, quote).alias("quote"), F.when(ok, F.col("p_start") + F.col("start")).alias("unicode_start"),
        F.when(ok, F.col("p_start") + F.col("end")).alias("unicode_end"), reason.alias("reason"),
    )


def audit_decisions(decisions: DataFrame, rows: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(broken rules per review id, counts per disposition).

    ``rows``: review_id, document_id, field_pointer, observed_value, proposed_value,
    proposed_action, artifact_id, artifact_sha256, source excerpt and span;
    ``artifacts``: artifact_id, body (a variant), sha256, raw_text.
    The observed value is read by variant path from the artifact itself.
    """
    d = decisions.select("review_id", *[F.col(c).alias("d_" + c) for c in decisions.columns if c != "review_id"], F.lit(True).alias("__d"))
    r = rows.withColumn("__r", F.lit(True))
    a = artifacts.select("artifact_id", "body", F.col("sha256").alias("a_sha"), "raw_text")
    j = r.join(d, "review_id", "full_outer").join(a, "artifact_id", "left")
    twice = decisions.groupBy("review_id").agg(F.count("*").alias("__n"))
    j = j.join(twice, "review_id", "left")
    both = F.col("__d") & F.col("__r")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    seen = F.try_variant_get("body", F.col("field_pointer"), "string")
    excerpt = F.substring("raw_text", F.col("span_start") + 1, F.col("span_end") - F.col("span_start"))
    rules = {
        "missing_decision": F.col("__d").isNull(), "unknown_review_id": F.col("__r").isNull(), "duplicate_decision": F.col("__n") > 1,
        "target_mismatch": both & ~(same("d_document_id", "document_id") & same("d_field_pointer", "field_pointer")),
        "unsupported_disposition": both & ~yes(F.col("d_disposition").isin(DISPOSITIONS)),
        "proposal_mismatch": both & ~same("d_proposal_value", "proposed_value"),
        "confirmed_value_differs": both & (F.col("d_disposition") == "confirm_current_value") & ~same("d_proposal_value", "observed_value"),
        "failure_mismatch": both & (F.col("d_disposition") == "retain_validation_failure") & ~yes(F.col("proposed_action") == "retain_validation_failure"),
        "invalid_date": both & F.try_to_date("d_decided_on", "yyyy-MM-dd").isNull(),
        "already_applied": both & ~yes(F.col("d_applied") == F.lit(False)),
        "blank_rationale": both & (strip_text(F.coalesce("d_rationale", F.lit(""))) == ""),
        "artifact_changed": F.col("__r") & ~same("artifact_sha256", "a_sha"),
        "observed_mismatch": F.col("__r") & ~seen.eqNullSafe(F.col("observed_value")),
        "span_mismatch": F.col("__r") & ~yes(excerpt == F.col("excerpt")),
    }
    broken = F.array_compact(F.array(*[F.when(yes(test), F.lit(name)) for name, test in rules.items()]))
    bad = j.select("review_id", broken.alias("broken")).filter(F.size("broken") > 0)
    return bad, decisions.groupBy("disposition").agg(F.count("*").alias("n"))
