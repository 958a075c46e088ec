"""Stored-event checks: one small world per reason, all in one call, from relations as the matcher stores them."""

from pyspark.sql import functions as F

from sentinelweave.operators import cohorts as C
from sentinelweave.operators.matching import COMPONENTS
from sentinelweave.operators.relations import relation_batch, upsert_relations
from sentinelweave.session import materialised

MATCHES = (
    "source_id string, target_id string, gate string, relation string, decision string, base_decision string, merge_allowed boolean, hard_conflict boolean, hard_conflict_reason string, score double, "
    "information_coverage double, policy_version string, auto_link_guard_reason string, auto_link_guard_override_reason string, shared_event_context_anchors array<string>, source_anchors array<string>, target_anchors array<string>"
)
# World: (table that changes, column or None where its second signal's row goes, new value in SQL, reason, differing fields).
STORED_ONCE = ("exists", "manual", "other", "closed", "reviewed", "lost", "audit")
CHANGES = {
    "ready": ("", "", "", None, []), "exists": ("", "", "", None, []),
    "missing": ("live", None, "", "signals_missing_stale_or_ineligible", []), "foreign": ("stored", "producer", "'manual'", "relations_missing_or_foreign", []),
    "bare": ("stored", "shared_event_context_anchors", "array(' ')", "invalid_context_override", []), "strange": ("stored", "shared_event_context_anchors", "array('vessel:x')", "context_anchor_mismatch", []),
    "blank": ("stored", "matcher_version", "' '", "invalid_context_versions", []), "newer": ("stored", "policy_version", "'0.5.0'", "incompatible_context_versions", []),
    "unmerged": ("stored", "merge_allowed", "false", "invalid_matcher_relations", []), "leaving": ("stored", "target_id", "'leavingc'", "invalid_matcher_relations", []),
    "unknown": ("signals", None, "", "incomplete_seed_signals", []), "split": ("signals", "disease_id", "signal_id", "invalid_persisted_event_seed", []),
    "retitled": ("seeds", "title", "'Else'", "event_seed_mismatch", ["title"]), "unsupported": ("supported", None, "", "unsupported_context_anchors", []),
    "covered": ("stored", "information_coverage", "0.9D", "invalid_matcher_policy", []), "manual": ("memberships", "match_decision", "'manual_linked'", "manual_membership_conflict", []),
    "other": ("memberships", "event_id", "'E9'", "other_event_membership_conflict", []), "closed": ("events", "lifecycle_status", "'closed'", "event_lifecycle_blocked", []),
    "reviewed": ("events", "reviewed_by", "'ana'", "existing_event_mismatch", ["reviewed_by"]), "lost": ("memberships", None, "", "existing_membership_mismatch", []),
    "audit": ("memberships", "rationale", "map('event_code', 'x')", "existing_membership_mismatch", []),
}


def test_every_reason(spark):
    names = list(CHANGES)
    signals = spark.createDataFrame([(n + x,) for n in names for x in "abc"], "signal_id string").selectExpr(
        "signal_id", "'d1' as disease_id", "'Fever' as disease_canonical_name", "cast(null as string) as pathogen_id", "cast(null as string) as pathogen_canonical_name",
        "array('human') as domains", "date'2026-05-04' as occurred_start", "timestamp'2026-05-05 00:00:00' as observed_at",
    )
    matches = spark.createDataFrame(
        [(n + "a", n + "b", "eligible", "refines", "auto_linked", "auto_linked", True, False, None, 0.9, 0.4, "0.4.9", None, C.ANCHOR_OVERRIDE, *[["vessel:" + n]] * 3) for n in names], MATCHES
    ).withColumns({c: F.lit(0.5) for c in COMPONENTS})
    none = spark.createDataFrame([], "relation_id string, source_id string, target_id string, relation string, decision string, merge_allowed boolean, hard_conflict boolean, score double, producer string, created_at timestamp")
    # What upserting stores is what the checks read.
    stored = materialised(upsert_relations(relation_batch(matches), none, signals.select("signal_id")).drop("action"), "stored")
    edges, _ = C.creation_edges(stored)
    labels = materialised(C.cohorts(edges), "labels")
    seeds = materialised(C.cohort_seed(labels, C.cohort_rollup(edges, labels), signals), "seeds")
    old = seeds.filter(F.expr("left(cohort, length(cohort) - 1)").isin(*STORED_ONCE))
    rows, links = C.create_events(old.select("cohort", F.lit("ready_to_create").alias("status")), old, labels, spark.createDataFrame([], "event_code string"))
    audit = links.first().rationale
    assert (audit["source_signals"], audit["source_relations"], audit["policy_version"]) == ("2", "1", "0.4.9")
    sources = C.creation_sources(rows, edges, labels).select("matcher_version", "policy_version", "context_resolver_version").collect()
    assert [tuple(r) for r in sources] == [("0.4.8", "0.4.9", "0.4.9")] * len(STORED_ONCE)
    tables = {
        "stored": stored, "signals": signals, "live": signals.select("signal_id"), "seeds": seeds, "events": rows, "memberships": links,
        "supported": labels.select("signal_id", F.array(F.concat(F.lit("vessel:"), F.expr("left(signal_id, length(signal_id) - 1)"))).alias("context_anchors")),
    }
    for name, (table, column, value, *_) in CHANGES.items():
        if not table:
            continue
        key = next(c for c in ("source_id", "signal_id", "cohort") if c in tables[table].columns)
        hit = F.expr(f"left({key}, length({key}) - 1)") == name
        if column is None:
            tables[table] = tables[table].filter(~(hit & F.col(key).endswith("b")))
        else:
            tables[table] = tables[table].withColumn(column, F.when(hit, F.expr(value)).otherwise(F.col(column)))
    t = {n: materialised(x, "changed") for n, x in tables.items()}
    members = C.cohort_members(edges, labels).select("cohort", "relation_id")
    out = C.validate_cohort(t["seeds"], labels, members, t["live"], t["stored"], t["events"], t["memberships"], t["signals"], C.cohort_anchors(edges, labels), t["supported"])
    got = {r.cohort[:-1]: (r.status, r.reason, list(r.mismatched_fields)) for r in out.collect()}
    want = {n: ("blocked" if c[3] else "already_exists" if n == "exists" else "ready_to_create", c[3], c[4]) for n, c in CHANGES.items()}
    assert got == want
