from pyspark.sql import functions as F

from sentinelweave import schemas
from sentinelweave.operators import assembly as A


def claims(spark, *rows):
    """Nested claims from sparse dicts; missing parts take neutral values."""
    import json

    unknown_point = {"precision": "unknown"}
    out = []
    for i, row in enumerate(rows, 1):
        base = {
            "claim_id": f"c{i}", "group_id": "g", "claim_kind": "other", "polarity": "positive", "domains": ["animal"], "subject": {"subject_type": "other"},
            "locations": [], "event_date": {"precision": "unknown"}, "reference_period": {"start": unknown_point, "end": unknown_point, "period_type": "unknown"},
            "metric": {"reported": False, "as_of_precision": "unknown"}, "diagnostics": {"test_reported": False, "result": "unknown"},
            "genomics": {"sequence_reported": False, "test_result": "not_applicable"},
            "transmission": {"human_to_human": "unknown", "animal_to_human": "unknown", "vector_borne": "unknown"}, "verification_status": "confirmed", "summary": f"s{i}",
            "evidence": [], "confidence": 0.8,
        }
        out.append(("D", float(i), json.dumps({**base, **row})))
    df = spark.createDataFrame(out, "doc string, ord double, body string")
    return df.select("doc", "ord", F.from_json("body", schemas.CLAIM).alias("c")).select("doc", "ord", "c.*")


def place(locality, role="event_location"):
    return {"country": "Argentina", "country_iso2": "AR", "admin1": "BA", "locality": locality, "precision": "locality", "role": role}


TWO_SITES = {
    "claim_kind": "diagnostic_result", "subject": {"subject_type": "animal", "verbatim": "aves"}, "diagnostics": {"test_reported": False, "result": "positive"},
    "locations": [place("Azul"), place("Tandil")],
    "evidence": [{"type": "text", "text": "El organismo confirmó dos casos positivos de gripe en aves de dos predios, uno en Azul y otro en Tandil."}],
}


def test_two_sites_become_two_outbreaks(spark):
    rows = A.split_multisite(A.with_notes(claims(spark, TWO_SITES))).orderBy("ord").collect()
    assert [(r.claim_id, r.group_id, r.claim_kind, r.locations[0].locality) for r in rows] == [
        ("c1:site:1", "g:site:1", "outbreak_update", "Azul"), ("c1:site:2", "g:site:2", "outbreak_update", "Tandil"),
    ]
    unclear = {**TWO_SITES, "evidence": [{"type": "text", "text": "posible: confirmó dos casos positivos en aves de dos predios, uno en Azul y otro en Tandil."}]}
    kept = A.split_multisite(A.with_notes(claims(spark, unclear))).collect()
    assert [r.claim_id for r in kept] == ["c1"] and kept[0].notes == ["ASM-MULTISITE-REVIEW"]


def test_taken_ids_prevent_the_split(spark):
    rows = A.split_multisite(claims(spark, {**TWO_SITES, "group_id": "h"}, {"claim_id": "c1:site:2", "group_id": "z"})).collect()
    assert sorted(r.claim_id for r in rows) == ["c1", "c1:site:2"]


def test_facility_detection_is_an_outbreak_and_absorbs_its_laboratory(spark):
    facility = {
        "claim_kind": "diagnostic_result", "subject": {"subject_type": "animal", "verbatim": "aves"}, "diagnostics": {"test_reported": True, "result": "positive"},
        "pathogen_verbatim": "H5", "locations": [place("Azul")],
        "evidence": [{"type": "text", "text": "El servicio confirmó un caso positivo en aves de un predio ubicado en la localidad de Azul, en traspatio."}],
    }
    lab = {
        "claim_kind": "diagnostic_result", "diagnostics": {"test_reported": True, "result": "positive"}, "pathogen_verbatim": " h5 ",
        "locations": [place("CABA", "laboratory_location")], "evidence": [{"type": "text", "text": "El laboratorio confirmó el resultado."}],
    }
    out = A.attach_lab_confirmation(A.promote_animal_outbreaks(A.with_notes(claims(spark, facility, lab)))).orderBy("ord").collect()
    assert [r.claim_kind for r in out] == ["outbreak_update", "outbreak_update"]
    elsewhere = {**facility, "locations": [place("Azul Chico")]}
    assert A.promote_animal_outbreaks(claims(spark, elsewhere)).first().claim_kind == "diagnostic_result"


def test_baselines_share_the_first_compatible_group(spark):
    def base(group, **kw):
        return {"claim_kind": "surveillance_baseline", "group_id": group, "disease_verbatim": "hantavirus", **kw}

    rows = A.merge_surveillance_snapshots(
        claims(spark, base("a"), base("b", locations=[{"country_iso2": "AR", "role": "x"}]), base("c", summary="casos del NOA"), base("d", summary="otra vez el NOA"), base("e", disease_verbatim="dengue"))
    ).orderBy("ord").collect()
    assert [r.group_id for r in rows] == ["a", "a", "c", "c", "e"]


def test_assembly_is_stable_under_partitioning(spark):
    rows = claims(spark, TWO_SITES, {"claim_kind": "mobility", "group_id": "m"}, {"claim_kind": "genomic_finding", "pathogen_verbatim": "virus Andes", "group_id": "n"})
    a = sorted((r.local_signal_id, r.signal_type) for r in A.assemble(rows.repartition(1)).collect())
    b = sorted((r.local_signal_id, r.signal_type) for r in A.assemble(rows.repartition(5)).collect())
    assert a == b == [("D-asm-01", "outbreak"), ("D-asm-02", "outbreak"), ("D-asm-03", "travel_or_mobility"), ("D-asm-04", "genomic_observation")]


SOUND = {
    "domains": ["human"], "evidence": [{"type": "text", "text": "un caso"}], "metric": {"reported": True, "name": "deaths", "value_numeric": 1.0, "as_of_date": None, "as_of_precision": "unknown"},
    "subject": {"subject_type": "human", "verbatim": "persona", "confidence": 0.5}, "locations": [],
}


def with_doc(df, doc):
    return df.withColumn("doc", F.lit(doc)).withColumn("claim_id", F.concat(F.lit(doc + "-"), "claim_id"))


def test_notes_tell_what_happened_and_drops_stay_as_rows(spark):
    day = lambda d: {"start": d, "precision": "day"}
    rows = [
        {**SOUND, "claim_kind": "case_status", "event_date": day("2024-01-01"), "pathogen_verbatim": "virus Andes", "metric": {**SOUND["metric"], "as_of_date": "2024-05"}},
        {**SOUND, "claim_kind": "case_status", "event_date": day("2024-01-02"), "subject": {"subject_type": "wildlife", "verbatim": "buque"}},
        {**SOUND, "claim_kind": "mobility", "group_id": "h"}, {**SOUND, "claim_kind": "mobility", "group_id": "i"},
        {**SOUND, "claim_kind": "laboratory_investigation", "group_id": "j", "summary": "Investigando el origen del brote", "metric": {"reported": False}, "diagnostics": {"test_reported": False}},
        {**SOUND, "claim_kind": "intervention", "group_id": "k", "summary": "Capacitación", "metric": {"reported": False}},
    ]
    df = A.with_notes(claims(spark, *rows)).withColumn("notes", F.when(F.col("ord") == 1, F.array(F.lit("ASM-ANIMAL-01"))).otherwise(F.col("notes")))
    out = {r.local_signal_id: r for r in A.assemble_marked(df).collect()}
    assert out["D-asm-01"].notes[:2] == ["ASM-ANIMAL-01 c1", "ASM-EVENT-DATE-01"] and "NORM-METRIC-DATE" in out["D-asm-01"].notes
    assert [n for n in out["D-asm-01"].notes if n.startswith("NORM-HOST")] == ["NORM-HOST buque"] and [h.verbatim for h in out["D-asm-01"].hosts] == ["persona"]
    assert out["D-asm-01"].dropped is None and out["D-asm-02"].dropped is None and out["D-asm-03"].dropped == "duplicate_of D-asm-02"
    assert {(r.claim_id, r.reason) for r in A.dropped_claims(df).collect()} == {("c5", "generic_investigation"), ("c6", "training_intervention")}
    assert {r.local_signal_id for r in A.assemble(df).collect()} == {"D-asm-01", "D-asm-02"}


def test_documents_are_checked_before_and_after(spark):
    kept = {**SOUND, "claim_kind": "case_status"}
    parts = {
        "A": [kept], "B": [{**kept, "confidence": 2.0}, kept], "C": [{**kept, "evidence": [{"type": "text", "text": "otro"}]}],
        "E": [{**kept, "summary": " "}], "F": [kept],
    }
    df = None
    for doc, rows in parts.items():
        part = with_doc(claims(spark, *rows), doc)
        df = part if df is None else df.unionByName(part)
    raw = spark.createDataFrame([(d, "Hay  un\ncaso.") for d in "ABCE"], "raw_item_id string, raw_text string")
    signals, failures = A.checked_assembly(df, raw)
    assert [r.doc for r in signals.collect()] == ["A"]
    assert {(r.doc, r.stage, r.id, r.path, r.rule) for r in failures.collect()} == {
        ("B", "claims", "B-c1", "confidence", "range"), ("C", "claims", "C-c1", "evidence[].text", "literal"), ("F", "claims", "F-c1", "evidence[].text", "literal"),
        ("E", "signals", "E-asm-01", "signal_summary", "filled"),
    }


def test_nested_claims_are_not_shuffled(spark):
    # Documents are dealt out as narrow lines: one exchange for their order, one for the documents, none of nested claims.
    from sentinelweave.plans.nested import nested_claims
    from sentinelweave.plans.queries_assembly import folded

    sf = "/root/testdata/sf0.001"
    for df in (folded(spark, sf), A.merge_nonrelation(folded(spark, sf)), A.assemble_marked(nested_claims(spark, sf))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 2, plan


def test_flat_columns_stay_beside_nested_claims(spark):
    # The checks of an assembly read a flat column of the claims; joining it back moved every nested claim.
    from sentinelweave.plans.nested import nested_claims
    from sentinelweave.plans.views import view

    sf = "/root/testdata/sf0.001"
    beside = nested_claims(spark, sf, "qty")
    assert "Join" not in beside._jdf.queryExecution().optimizedPlan().toString()
    flat = view(spark, sf, "clm").select("claim_id", "qty")
    assert beside.select("claim_id", "qty").exceptAll(flat).isEmpty() and flat.exceptAll(beside.select("claim_id", "qty")).isEmpty()


def test_tasks_that_nest_claims_follow_the_lines(spark, monkeypatch):
    # Spark chose tasks by the bytes of narrow lines, so one task sorted and spilled the nested claims of millions.
    from sentinelweave.plans import nested

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(nested, "LINES_PER_TASK", 100)
    sizes = nested._dealt_lines(spark, sf).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 50 and max(r["count"] for r in sizes) < 300


def test_the_fold_collects_only_what_its_columns_read(spark):
    from sentinelweave.plans.queries_assembly import folded

    sf = "/root/testdata/sf0.001"
    whole = folded(spark, sf)
    for wanted in (["transmission"], ["event_date", "notes"], ["hosts", "metrics"], list(A.NONRELATION_READS)):
        some = folded(spark, sf, *wanted)
        names = ["doc", "nn", "local_signal_id", *[n for n in A.FOLD_READS if n in wanted]]
        assert some.columns == names and some.exceptAll(whole.select(names)).isEmpty() and whole.select(names).exceptAll(some).isEmpty()
        plan = some._jdf.queryExecution().optimizedPlan().toString()
        assert ("evidence_text" in plan) == ("evidence" in wanted) and ("subject_name" in plan) == ("hosts" in wanted)
