import random

import pytest
from pyspark.sql import functions as F

from sentinelweave.operators import assignment, cohorts
from sentinelweave.operators.hydrate import candidates
from sentinelweave.operators.matching import MatchConfig


def test_candidates_equal_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for i in range(140):
        day = rng.choice([None, *range(1, 9)])
        rows.append((
            f"s{i:03d}", rng.choice(["d0", "d0", "d0", "d1", None]), rng.choice(["p0", "p0", "p1", "p2", None]),
            None if day is None else f"2024-01-{day:02d}", rng.randrange(5),
        ))
    df = spark.createDataFrame(rows, "signal_id string, disease_id string, pathogen_id string, d string, c int").select(
        "signal_id", "disease_id", "pathogen_id", F.to_date("d").alias("occurred_start"), F.timestamp_seconds("c").alias("created_at")
    )
    for k in (1, 4, 30):
        got = {(r.anchor_id, r["rank"]): r.candidate_id for r in candidates(df, df, k).collect()}
        want = {}
        for a in rows:
            def key(c):
                days = None if a[3] is None or c[3] is None else abs(int(a[3][-2:]) - int(c[3][-2:]))
                return (not (a[2] is not None and a[2] == c[2]), not (a[1] is not None and a[1] == c[1]), days is None, days or 0, -c[4], c[0])
            for at, c in enumerate(sorted((c for c in rows if c[0] != a[0]), key=key)[:k], 1):
                want[(a[0], at)] = c[0]
        assert got == want


def test_candidates_look_up_an_anchors_place_once_per_anchor(spark):
    df = spark.createDataFrame([("s1", "d0", "p0", 1), ("s2", "d0", "p0", 2)], "signal_id string, disease_id string, pathogen_id string, c int").select(
        "signal_id", "disease_id", "pathogen_id", F.to_date(F.lit("2024-01-01")).alias("occurred_start"), F.timestamp_seconds("c").alias("created_at")
    )
    plan = candidates(df, df, 2)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    places = [i for i, line in enumerate(plan) if "array_position(" in line]
    assert places and min(places) > next(i for i, line in enumerate(plan) if "Generate inline" in line)


def test_candidate_limit_is_checked(spark):
    with pytest.raises(ValueError):
        candidates(spark.range(1), spark.range(1), 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(str(rng.randrange(60)), str(rng.randrange(60)), [f"vessel:{rng.randrange(4)}"] if rng.random() < 0.1 else []) for _ in range(45)]
    edges += [(str(i), str(i + 1), []) for i in range(100, 160)] + [("hub", f"leaf{i}", ["place:x"]) for i in range(30)]
    edges = [e for e in edges if e[0] != e[1]]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, anchors in edges:
        parent[find("s" + a)] = find("s" + b)
        for t in anchors:
            if t.startswith("vessel:"):
                parent[find("t" + t)] = find("s" + a)
    groups = {}
    for x in list(parent):
        if x[0] == "s":
            groups.setdefault(find(x), set()).add(x[1:])
    want = {m: min(g) for g in groups.values() for m in g}
    df = spark.createDataFrame(edges, "source_id string, target_id string, shared_event_context_anchors array<string>")
    assert {r.signal_id: r.cohort for r in cohorts.cohorts(df).collect()} == want


def test_assignment_actions_and_guards(spark):
    rel = spark.createDataFrame(
        [(f"r{i}", f"s{i}", f"t{i}", "eligible", "refines", "auto_linked", True, False) for i in range(7)],
        "relation_id string, source_id string, target_id string, gate string, relation string, decision string, merge_allowed boolean, hard_conflict boolean",
    )
    mem = spark.createDataFrame(
        [("E1", "s1", "auto_linked"), ("E2", "t2", "manual_linked"), ("E1", "s3", "auto_linked"), ("E1", "t3", "auto_linked"), ("E1", "s4", "auto_linked"), ("E2", "t4", "auto_linked"),
         ("E1", "s5", "auto_linked"), ("E2", "t5", "manual_unlinked"), ("E3", "s6", "auto_linked")],
        "event_id string, signal_id string, match_decision string",
    )
    events = spark.createDataFrame([("E1", "active"), ("E2", "monitoring"), ("E3", "closed")], "event_id string, lifecycle_status string")
    plans = assignment.lifecycle_guard(assignment.assignment_plan(rel, mem), events)
    got = {r.relation_id: (r.action, r.reason) for r in plans.collect()}
    assert got["r0"][0] == "create_event"
    assert got["r1"][0] == "attach_target_to_event"
    assert got["r2"][0] == "attach_source_to_event"
    assert got["r3"][0] == "already_same_event"
    assert got["r4"] == ("manual_review", "signals_belong_to_distinct_events")
    assert got["r5"] == ("manual_review", "non_positive_membership_requires_review")
    assert got["r6"] == ("manual_review", "target_event_closed")


def test_match_configuration_is_checked():
    with pytest.raises(ValueError):
        MatchConfig(weights={"etiology": 1.0})
    with pytest.raises(ValueError):
        MatchConfig(auto_link_min=0.5)


def test_registered_candidates_reach_the_default(spark):
    from __spark_entry__ import SMOKE_DIR, queries
    from sentinelweave.plans import registry
    from sentinelweave.plans.queries_matching import current_eligible, live_index

    live = current_eligible(live_index(spark, SMOKE_DIR)).count()
    got = queries()["jn03_candidates"](spark, SMOKE_DIR).groupBy("anchor_id").agg(F.count("*").alias("n"), F.max("rank").alias("last")).collect()
    assert live > 251 and len(got) == live and {(r.n, r["last"]) for r in got} == {(250, 250)}
    assert ", 250) as near" in registry.ORACLES["jn03_candidates"]


def test_pairs_of_anchors_are_never_moved_with_their_features(spark):
    # Pairs got the features of one side and were then shuffled with them to meet the other side's.
    import __spark_entry__ as contract

    plan = contract.queries()["mt14_match_anchors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    top = next(line for line in plan if "Join" in line)
    assert "a_disease" in top and "target_id" not in top
