from pyspark.sql import functions as F

from sentinelweave import schemas
from sentinelweave.operators import validation as V
from sentinelweave.sources import payloads

GOOD = """{"local_signal_id": "s1", "domains": ["human"], "signal_role": "primary_event", "signal_type": "outbreak",
 "disease": {"normalization_status": "resolved", "confidence": 1}, "pathogen": {"normalization_status": "unresolved", "confidence": 0},
 "hosts": [{"host_type": "human", "confidence": 0.5}], "locations": [{"country_iso2": "AR", "role": "event_location", "precision": "country", "confidence": 1}],
 "event_date": {"precision": "unknown"}, "reference_period": {"start": {"precision": "unknown"}, "end": {"precision": "year", "year": 2020}, "period_type": "season"},
 "metrics": [{"name": "cases", "as_of_precision": "day", "as_of_date": "2026-05-01"}],
 "transmission": {"human_to_human": "unknown", "animal_to_human": "unknown", "vector_borne": "refuted"},
 "genomics": {"sequence_reported": false, "test_result": "unknown"}, "diagnostics": {"test_reported": true, "result": "pending"},
 "verification_status": "confirmed", "signal_summary": "x", "evidence": [{"type": "text", "text": "q", "page_number": 1}], "extraction_confidence": 0.9}"""
BREAKS = [
    ('"event_location"', '"elsewhere"', "locations[].role"), ('"AR"', '"ar"', "locations[].country_iso2"), ('"host_type": "human"', '"host_type": "plant"', "hosts[].host_type"),
    ('"text": "q"', '"text": ""', "evidence[].text"), ('"page_number": 1', '"page_number": 0', "evidence[].page_number"), ('2026-05-01', '2026-13-01', "metrics[].as_of_date"),
    ('["human"]', '["human", "human"]', "domains"), ('["human"]', '["space"]', "domains[]"), ('"year": 2020', '"year": 1800', "reference_period.end.year"),
    ('"vector_borne": "refuted"', '"vector_borne": null', "transmission.vector_borne"), ('"extraction_confidence": 0.9', '"extraction_confidence": 2', "extraction_confidence"),
    ('"normalization_status": "resolved"', '"normalization_status": "maybe"', "disease.normalization_status"),
]


def test_signal_contract(spark):
    rows = [("good", GOOD)] + [(path, GOOD.replace(old, new)) for old, new, path in BREAKS]
    df = spark.createDataFrame(rows, "id string, body string").withColumn("s", F.from_json("body", schemas.SIGNAL)).select("id", "s.*")
    got = {(r.id, r.path) for r in V.contract_check(df, ["id"], V.SIGNAL_CONTRACT).collect()}
    assert got == {(path, path) for _, _, path in BREAKS}


def test_every_failure_is_kept(spark):
    df = spark.createDataFrame([("empty", "{}")], "id string, body string").withColumn("s", F.from_json("body", schemas.SIGNAL)).select("id", "s.*")
    failures = V.contract_check(df, ["id"], V.SIGNAL_CONTRACT)
    assert failures.count() > 20
    shown = V.first_failures(failures, ["id"], 3).first()
    assert len(shown.failures) == 3 and shown.more == failures.count() - 3


def test_broken_documents_are_quarantined(spark):
    df = spark.createDataFrame([("a", '{"schema_version": "claims-0.1", "claims": []}'), ("b", '{"claims": ['), ("c", "[1]"), ("d", None)], "raw_item_id string, body string")
    good, bad = payloads.split_payloads(df, "claims")
    assert [r.raw_item_id for r in good.collect()] == ["a"] and sorted(r.raw_item_id for r in bad.collect()) == ["b", "c", "d"]
