import json

from pyspark.sql import functions as F

from sentinelweave.operators import exports, validation as V
from sentinelweave.sources import payloads


def test_payloads_of_the_wrong_shape_are_quarantined(spark, tmp_path):
    claim = {"claim_id": "c", "domains": ["human"], "locations": [{"role": None, "confidence": 1}], "metric": {"reported": False, "as_of_year": 2024}, "confidence": 0.5}
    sound = {"schema_version": "claims-0.1", "document": {"raw_item_id": "d"}, "claims": [claim], "warnings": []}
    bad = {
        "json": '{"claims":', ":object": "[]", "claims:array": {**sound, "claims": {}}, "claims[]:object": {**sound, "claims": [claim, 5]},
        "claims[].domains[]:string": {**sound, "claims": [{**claim, "domains": ["human", 3]}]},
        "claims[].metric.as_of_year:integer": {**sound, "claims": [{**claim, "metric": {"as_of_year": 2024.5}}]},
        "claims[].locations[].confidence:number": {**sound, "claims": [claim, {**claim, "locations": [{"confidence": "1"}]}]},
        "claims[].metric.reported:boolean": {**sound, "claims": [{**claim, "metric": {"reported": 0}}]},
        "document:object": {**sound, "document": "d"}, "warnings:array": {**sound, "warnings": "none"}, "schema_version:string": {**sound, "schema_version": 1},
    }
    bodies = [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in bad.items()]
    bodies += [("ok", json.dumps(sound)), ("mark", "﻿" + json.dumps(sound)), ("bare", "{}"), ("nulls", json.dumps({**sound, "claims": [None, {**claim, "domains": None}]}))]
    bodies += [("null text", "null"), ("nothing", None), ("big", json.dumps({**sound, "claims": [{**claim, "metric": {"as_of_year": 99999999999}}]}))]
    df = spark.createDataFrame(bodies, "raw_item_id string, body string")
    ok, broken = payloads.split_payloads(df, "claims")
    assert sorted(r.raw_item_id for r in ok.collect()) == ["bare", "mark", "nulls", "ok"]
    found = {r.raw_item_id: r.problems for r in broken.collect()}
    assert {k: found[k] for k in bad} == {k: [k] for k in bad}
    assert found["null text"] == [":object"] and found["nothing"] == ["json"] and found["big"] == ["claims[].metric.as_of_year:integer"]
    assert ok.filter("raw_item_id = 'ok'").first().payload.claims[0].metric.as_of_year == 2024
    # The same from a folder of lines, where the id comes from the document itself.
    df.filter("body is not null").select(F.col("body").alias("value")).write.text(str(tmp_path / "lines"))
    ok, broken = payloads.split_payloads(payloads.read_payload_lines(spark, str(tmp_path / "lines")), "claims")
    assert ok.filter("raw_item_id = 'd'").count() == 3 and broken.count() == len(found) - 1


def test_dossiers_are_ordered_rows_with_relations(spark, tmp_path):
    table = spark.createDataFrame
    events = table([("E1", "active", "P1", "x"), ("E2", None, None, "x")], "event_id string, lifecycle_status string, priority string, output_json string")
    members = table([("E1", s, "auto_linked") for s in ("a", "b", "c")] + [("E1", "a", "a_first"), ("E3", "a", "auto_linked")], "event_id string, signal_id string, match_decision string")
    signals = table([("a", "1", "outbreak", "A"), ("b", "2", "cluster", None), ("c", "2", "cluster", "C"), ("z", "2", "cluster", "Z")], "signal_id string, raw_item_id string, signal_type string, signal_summary string")
    raw = table([("1", "T1", "u1", None, "secret"), ("2", "T2", "u2", "2026-01-02", "secret")], "raw_item_id string, title string, url string, published_on string, raw_text string")
    evidence = table([("a", 1, "q1"), ("a", 0, "q0"), ("c", 0, "qc"), ("z", 0, "qz")], "signal_id string, seq int, text string")
    relations = table([("r2", "b", "c", "supports", "auto_linked", 0.9), ("r1", "a", "b", "refines", "rejected", None), ("r0", "a", "z", "supports", "auto_linked", 1.0)],
                      "relation_id string, source_id string, target_id string, relation string, decision string, score double")
    rows = exports.dossier_rows(events, members, signals, raw, evidence, relations)
    assert not {"raw_text", "output_json"} & set(rows.columns)
    exports.write_dossiers(rows, str(tmp_path / "out"))
    lines = [json.loads(line) for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    assert [(x["event_id"], x["section"], x.get("signal_id") or x.get("relation_id"), x.get("excerpt")) for x in lines] == [
        ("E1", 0, None, None), ("E1", 1, "b", None), ("E1", 1, "c", None), ("E1", 1, "a", None), ("E1", 2, "c", "qc"), ("E1", 2, "a", "q0"), ("E1", 2, "a", "q1"),
        ("E1", 3, "r1", None), ("E1", 3, "r2", None), ("E2", 0, None, None),
    ]
    assert lines[0] == {"event_id": "E1", "section": 0, "lifecycle_status": "active", "priority": "P1", "signals": 3, "source_documents": 2, "excerpts": 3, "relations": 2}
    assert lines[3]["match_decision"] == "a_first" and lines[3]["source_title"] == "T1" and lines[3]["published"] == "9999"
    one = exports.dossier_rows(events, members, signals, raw, evidence, relations, events.filter("event_id = 'E2'"))
    assert [(r.section, r.signals) for r in one.collect()] == [(0, 0)]


def test_every_stored_table_has_its_checks(spark):
    def broken(table, ddl, *rows):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, " + ddl)
        return sorted((r.n, r.check_name) for r in V.audit_checks(df, "n", V.table_checks(table)).collect())

    assert broken("signal_hosts", "confidence double, host_type string", (0.5, "human"), (-0.1, "ship"), (None, None)) == [(1, "confidence_in_unit"), (1, "host_type_allowed")]
    assert broken("signal_locations", "confidence double, precision string", (1.5, "point"), (0.0, "street")) == [(0, "confidence_in_unit"), (1, "precision_allowed")]
    assert broken("event_signals", "match_score double, match_decision string", (1.01, "manual_linked"), (None, "perhaps")) == [(0, "match_score_in_unit"), (1, "match_decision_allowed")]
    assert broken("events", "lifecycle_status string, priority string, review_status string", ("open", "P5", "pending"), (None, None, None), ("closed", "P4", "done")) == [
        (0, "lifecycle_status_allowed"), (0, "priority_allowed"), (2, "review_status_allowed")]
    promotions = "revision int, actor string, reason string, operation string, baseline_state_sha256 string"
    assert broken("snapshot_promotions", promotions, (1, "a", "b", "legacy_adoption", "0" * 64), (1, "a", "b", "candidate_promotion", None), (1, "a", "b", "legacy_adoption", None),
                  (1, "a", "b", "legacy_adoption", "F" * 64), (1, "a", "b", "candidate_promotion", "0" * 64), (0, None, " ", "other", None)) == [
        (2, "adoption_has_state"), (3, "adoption_has_state"), (4, "adoption_has_state"), (5, "actor_given"), (5, "operation_allowed"), (5, "reason_given"), (5, "revision_positive")]


def test_payloads_are_compared_with_their_types_once(spark):
    # Both halves compared every document again, and every field was read from its parents as often as these repeat.
    df = spark.createDataFrame([("A", '{"claims": [{"claim_id": 5}]}'), ("B", "{}")], "raw_item_id string, body string")
    ok, bad = payloads.split_payloads(df, "claims")
    assert all("schema_of_variant" not in half._jdf.queryExecution().optimizedPlan().toString() for half in (ok, bad))
    assert [r.raw_item_id for r in ok.collect()] == ["B"] and [r.problems for r in bad.collect()] == [["claims[].claim_id:string"]]


def test_queries_over_documents_without_a_text_equal_their_twins(spark, tmp_path):
    # Blank and null texts of the stored sources stood in the table as kept; a null text was a missing file, a blank one a problem.
    import duckdb

    import __spark_entry__ as contract

    texts = [None, "", "  ", "\u00a0\t", "a", "a ", " b\n"]
    rows = [(i, texts[i // 30 % len(texts)], "en", "s", 1) for i in range(420)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("ing5_upsert_raw_items", "ing7_ingest_summary", "src6_verify_artifacts"):
        want = con.execute(contract.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        got = contract.queries()[name](spark, str(tmp_path)).select(*columns).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall())), name


def test_lines_of_payloads_are_written_compressed(spark):
    # Plain lines of nested claims filled the disk at sixty times the lines of sf0.1.
    import glob

    import __spark_entry__ as contract
    from sentinelweave.session import shared_folder

    pattern = shared_folder(spark).removeprefix("file:") + "/stream-*/lines/part-*"
    before = set(glob.glob(pattern))
    assert contract.queries()["src1_split_payloads"](spark, "/root/testdata/sf0.001").count()
    made = set(glob.glob(pattern)) - before
    assert made and all(name.endswith(".gz") for name in made)
