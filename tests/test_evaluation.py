import itertools
import random

from pyspark.sql import functions as F

from sentinelweave.operators import evaluation as E


def test_assignment_equals_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        scores = {(g, p): round(rng.choice([0.5, 0.6, 0.7, 0.8, 0.9]), 6) for g in range(n) for p in range(m)}
        cands = [{"g": g, "p": p, "score": s} for (g, p), s in scores.items() if s >= 0.55]
        best, pick = 0.0, ()
        for chosen in itertools.product([None, *range(m)], repeat=n):
            used = [p for p in chosen if p is not None]
            if len(used) != len(set(used)):
                continue
            pairs = tuple((g, p, scores[g, p]) for g, p in enumerate(chosen) if p is not None)
            if any(s < 0.55 for _, _, s in pairs):
                continue
            total = sum(s for _, _, s in pairs)
            if total > best + 1e-9 or (abs(total - best) <= 1e-9 and pairs < pick):
                best, pick = total, pairs
        assert abs(sum(x["score"] for x in E._best_assignment(cands)) - best) < 1e-9


def test_native_and_exact_paths(spark):
    rows = [("free", 0, 0, 0.9), ("free", 1, 1, 0.8), ("tie", 0, 0, 0.8), ("tie", 0, 1, 0.8), ("tie", 1, 0, 0.7), ("low", 0, 0, 0.2)]
    pairs = spark.createDataFrame(rows, "doc string, g int, p int, score double")
    got = sorted((r.doc, r.g, r.p) for r in E.match_exact(pairs).collect())
    assert got == [("free", 0, 0), ("free", 1, 1), ("tie", 0, 1), ("tie", 1, 0)]
    greedy = sorted((r.doc, r.g, r.p) for r in E.match_greedy(pairs).collect())
    assert greedy == [("free", 0, 0), ("free", 1, 1), ("tie", 0, 0)]


def test_large_contested_document():
    # Every gold signal i may take prediction i or i + 1; taking i everywhere is best.
    cands = [{"g": i, "p": p, "score": 0.9 if p == i else 0.8} for i in range(60) for p in (i, i + 1)]
    assert [(x["g"], x["p"]) for x in E._best_assignment(cands)] == [(i, i) for i in range(60)]


def support(spark, gold, pred, version):
    q = lambda items: F.array(*[E.quote_features(F.lit(t), F.lit(x), F.lit(None).cast("int"), version) for t, x in items])
    from sentinelweave.functions.text import clauses

    def pieces(t, x):
        return F.transform(clauses(F.lit(x)), lambda c: E.quote_features(F.lit(t), c, F.lit(None).cast("int"), version))

    parts = F.array(*[pieces(t, x) for t, x in gold])
    return spark.range(1).select(E.evidence_support(q(gold), parts, q(pred), version).alias("v")).first()["v"]


def test_evidence_rules(spark):
    same = [("text", "se identificaron ocho casos a bordo del buque")]
    assert support(spark, same, [("excerpt", same[0][1])], "0.4.6") == 1.0
    assert support(spark, same, [("excerpt", same[0][1])], "0.4.5") == 0.0
    assert support(spark, [("text", "no se notificaron casos de hantavirus")], [("text", "se notificaron casos de hantavirus")], "0.4.7") == 0.0
    whole = [("text", "se identificaron ocho casos a bordo del buque, 6 confirmados y 2 probables")]
    assert support(spark, whole, [("text", "se identificaron ocho casos a bordo del buque")], "0.4.7") == 0.0
    assert support(spark, whole, [("text", "se identificaron ocho casos a bordo del buque"), ("text", "6 confirmados"), ("text", "2 probables")], "0.4.7") == 1.0


def test_reassembly_decides_the_status(spark):
    from __spark_entry__ import SMOKE_DIR
    from sentinelweave.operators.assembly import assemble
    from sentinelweave.plans.nested import nested_claims

    claims = nested_claims(spark, SMOKE_DIR)
    full = {r.doc: (r.claims, r.signals) for r in claims.groupBy("doc").agg(F.count("*").alias("claims")).join(assemble(claims).groupBy("doc").agg(F.count("*").alias("signals")), "doc").collect()}
    a, b = sorted(full)[:2]
    claims = claims.filter(F.col("doc").isin(a, b))
    rows = [
        (1, "pending", "pending", a, "p1"), (2, "null", None, a, "p1"), (3, "unnamed", "adjudicated", None, "p2"), (4, "nowhere", "adjudicated", a, ""),
        (5, "absent", "adjudicated", "?", "p3"), (6, "there", "adjudicated", a, "p4"), (7, "new", "adjudicated", b, "p5"), (8, "again", "adjudicated", b, "p5"), (9, "empty", "adjudicated", "none", "p6"),
    ]
    manifest = spark.createDataFrame(rows, "position long, doc string, status string, claims string, prediction string")
    stored = spark.createDataFrame([("p4",), ("p3",)], "prediction string")
    present = spark.createDataFrame([(a,), (b,), ("none",)], "doc string")
    want = {
        "pending": ("skipped_not_adjudicated", None, None), "null": ("skipped_not_adjudicated", None, None), "unnamed": ("skipped_missing_config", None, None),
        "nowhere": ("skipped_missing_config", None, None), "absent": ("skipped_claims_not_found", None, None), "there": ("existing", None, None),
        "new": ("reassembled", *full[b]), "again": ("existing", None, None), "empty": ("reassembled", 0, 0),
    }
    assert {r.doc: tuple(r)[1:] for r in E.corpus_reassembly(manifest, claims, stored, present=present).collect()} == want
    forced = {r.doc: tuple(r)[1:] for r in E.corpus_reassembly(manifest, claims, stored, force=True, present=present).collect()}
    assert forced == want | {"there": ("reassembled", *full[a]), "again": ("reassembled", *full[b])}


def test_pruned_pairs_are_those_at_the_threshold(spark):
    from __spark_entry__ import SMOKE_DIR
    from sentinelweave.plans.queries_evaluation import features

    for version, thresholds in (("0.4.6", (0.55,)), ("0.4.7", (0.3, 0.55))):
        gold, pred = features(spark, SMOKE_DIR, "gold", version), features(spark, SMOKE_DIR, "pred", version)
        every = E.pair_components(gold, pred, version)
        for threshold in thresholds:
            want = sorted(map(tuple, every.filter(F.col("score") >= threshold).select("doc", "g", "p", "score").collect()))
            got = sorted(map(tuple, E.reachable_pairs(gold, pred, version, threshold).select("doc", "g", "p", "score").collect()))
            assert got == want and want


def test_pairs_compute_only_what_they_compare(spark):
    # Quotations are costly to read and no component of a pair looks at them; document lines move, features do not.
    from sentinelweave.functions.text import TOKEN_PATTERN
    from sentinelweave.plans import queries_evaluation as Q

    sf = "/root/testdata/sf0.001"
    for df in (Q.pairs(spark, sf), Q.near_pairs(spark, sf)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert TOKEN_PATTERN not in plan and "disease" in plan
    full = E.pair_components(Q.features(spark, sf, "gold"), Q.features(spark, sf, "pred"))
    assert Q.pairs(spark, sf).exceptAll(full).isEmpty() and full.exceptAll(Q.pairs(spark, sf)).isEmpty()


def test_norm_once_is_norm_text(spark):
    from sentinelweave.functions.text import norm_once, norm_text

    rows = spark.createDataFrame([(x,) for x in (None, "", "  ", " \t", " A  Straße ", "x")], "t string")
    assert rows.filter(~norm_once("t").eqNullSafe(norm_text("t"))).isEmpty()
    assert [r[0] for r in rows.select(norm_once("t")).collect()] == [None, None, None, None, "a strasse", "x"]


def test_each_side_gets_the_keys_its_fields_read_and_no_others(spark):
    from __spark_entry__ import SMOKE_DIR
    from sentinelweave.operators import evaluation as E
    from sentinelweave.plans.nested import nested_reference

    source = {side: nested_reference(spark, SMOKE_DIR, side).filter("doc like '1%'") for side in ("gold", "pred")}
    whole = {side: E.score_features(s) for side, s in source.items()}
    lean = {side: E.score_features(s, parts=E.field_parts(side=side)) for side, s in source.items()}
    assert "clauses" not in lean["pred"].schema["f"].dataType.names and "metric_keys" not in lean["gold"].schema["f"].dataType.names
    a, b = (whole[side].select("doc", whole[side].idx.alias(n)) for side, n in (("gold", "g"), ("pred", "p")))
    pairs = a.join(b, "doc").selectExpr("doc", "g", "p", "1.0D as score")
    want, got = (sorted(map(tuple, E.matched_fields(pairs, f["gold"], f["pred"]).collect())) for f in (whole, lean))
    assert want and got == want
