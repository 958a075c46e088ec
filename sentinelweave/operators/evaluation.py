"""Scoring predictions against adjudicated signals.

Keys and tokens are computed once per signal in :func:`score_features`; pairs exist only
inside a document, by an equi-join on it.  A document holds a handful of signals, and a
matching is decided inside one row per document.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sentinelweave.functions.sets import bound, prf, set_f1
from sentinelweave.functions.text import (
    canonical_label, clauses, content_tokens, has_negation, metric_name_of, metric_unit_of, norm_once, norm_text, numbers, token_list,
)
from sentinelweave.operators.assembly import assemble
from sentinelweave.operators.gates import yes

# Component weights, thresholds and release gates.
PAIR_WEIGHTS = {
    "signal_role": 0.18, "signal_type": 0.22, "disease": 0.12, "pathogen": 0.10, "metrics": 0.12, "locations": 0.10,
    "event_date": 0.06, "reference_period": 0.04, "diagnostics": 0.04, "domains": 0.02,
}
MATCH_THRESHOLD = 0.55
SUPPORT_THRESHOLD = 0.70
RELEASE_THRESHOLDS = {
    "mean_signal_f1": 0.90, "mean_evidence_support_f1": 0.90, "mean_signal_role_accuracy": 0.90, "mean_signal_type_accuracy": 0.85,
}
MINIMUM_DOCUMENTS = 6
FIELD_METRICS = [
    "signal_role_accuracy", "signal_type_accuracy", "disease_accuracy", "pathogen_accuracy", "normalization_status_accuracy",
    "event_date_accuracy", "reference_period_accuracy", "diagnostics_accuracy", "domains_f1", "metrics_f1", "locations_f1", "hosts_f1",
    "evidence_exact_f1", "evidence_support_f1",
]
COMPOSITE_FIELDS = [f for f in FIELD_METRICS if f != "evidence_exact_f1"]
EXPLORATORY_FIELDS = ["signal_role_accuracy", "signal_type_accuracy", "evidence_exact_f1", "evidence_support_f1"]
PAIR_RELEASE = {
    "ineligible_gate_accuracy": 1.0, "hard_conflict_recall": 1.0, "auto_link_precision": 1.0, "pair_decision_accuracy": 1.0, "relation_accuracy": 1.0,
}
MISMATCH_FIELDS = ["gate", "relation", "decision", "merge_allowed", "hard_conflict", "hard_conflict_reason"]
VERSIONS = ("0.4.5", "0.4.6", "0.4.7")


def _num(c: Column) -> Column:
    return F.round(c.cast("double"), 8)


def _struct(*parts: Column) -> Column:
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])


def _or_text(a: Column, b: Column) -> Column:
    return norm_once(F.coalesce(F.when(a != "", a), b))


def quote_features(type_: Column, text: Column, page: Column, version: str) -> Column:
    """What a quotation comparison needs."""

    def facts(n: Column) -> Column:
        return F.struct(
            canonical_label(n["label"], version).alias("type"), page.alias("page"), n["text"].alias("text"),
            has_negation(n["tokens"]).alias("negated"), F.array_sort(numbers(n["tokens"])).alias("numbers"), content_tokens(n["tokens"]).alias("content"),
        )

    def read(normal: Column) -> Column:
        return bound(F.struct(norm_once(type_).alias("label"), normal.alias("text"), token_list(normal).alias("tokens")), facts)

    return bound(F.coalesce(norm_once(text), F.lit("")), read)


def pair_parts(version: str = "0.4.7") -> list[str]:
    """The comparison keys that the ten components of a pair read."""
    metrics = "metric_facts" if version == "0.4.7" else "metric_keys"
    return ["role", "type", "disease_c", "disease_v", "pathogen_c", "pathogen_v", metrics, "location_keys", "event_date", "reference_period", "diagnostics", "domains"]


def field_parts(version: str = "0.4.7", side: str = "gold") -> list[str]:
    """The comparison keys that :func:`matched_fields` reads of one side; clauses are compared from 0.4.7 on, those of ``gold`` alone."""
    split = ["clauses"] if version == "0.4.7" and side == "gold" else []
    return [*pair_parts(version), "status", "host_keys", "evidence_keys", "quotes", *split]


def score_features(signals: DataFrame, version: str = "0.4.7", parts: list[str] | None = None) -> DataFrame:
    """``(doc, idx, local_signal_id, f)`` with the comparison keys of a signal: all of them, or ``parts``.

    Spark computes every field of a struct that is read, so what a comparison leaves out must not be asked for.
    """
    s = F.col
    point = lambda p: _struct(p["date"], p["year"], p["month"], norm_text(p["precision"]))
    d = s("diagnostics")
    signals = signals.withColumns({
        "__quotes": F.transform("evidence", lambda e: quote_features(e["type"], e["text"], e["page_number"], version)),
        "__parts": F.transform("evidence", lambda e: F.struct(e["type"].alias("type"), e["page_number"].alias("page"), clauses(e["text"]).alias("cl"))),
        "__metrics": F.transform("metrics", lambda m: F.struct(
            norm_once(m["name"]).alias("name"), _num(m["value_numeric"]).alias("number"), norm_once(m["value_text"]).alias("text"), norm_once(m["unit"]).alias("unit"),
            m["as_of_date"].alias("date"), m["as_of_year"].alias("year"), m["as_of_month"].alias("month"), norm_once(m["as_of_precision"]).alias("precision"),
        )),
    })
    # Only compound quotations need their clauses compared.
    split = F.transform(
        "__parts", lambda x: F.transform(F.filter(x["cl"], lambda _: F.size(x["cl"]) >= 2), lambda t: quote_features(x["type"], t, x["page"], version))
    )
    keys = [
        s("signal_role").alias("role"), s("signal_type").alias("type"),
        norm_text(s("disease.canonical_name")).alias("disease_c"), norm_text(s("disease.verbatim")).alias("disease_v"),
        norm_text(s("pathogen.canonical_name")).alias("pathogen_c"), norm_text(s("pathogen.verbatim")).alias("pathogen_v"),
        _struct(norm_text(s("disease.normalization_status")), norm_text(s("pathogen.normalization_status"))).alias("status"),
        F.array_distinct(F.transform(
            "__metrics", lambda m: _struct(*[m[n] for n in ("name", "number", "text", "unit", "date", "year", "month", "precision")])
        )).alias("metric_keys"),
        F.transform(
            "__metrics",
            lambda m: F.struct(
                metric_name_of(m["name"]).alias("name"), m["number"].alias("number"), m["text"].alias("text"), metric_unit_of(m["unit"]).alias("unit"),
                m["date"].alias("date"), m["year"].alias("year"), m["month"].alias("month"),
            ),
        ).alias("metric_facts"),
        F.array_distinct(F.transform(
            "locations",
            lambda x: _struct(
                _or_text(x["country_iso2"], x["country"]), *[norm_once(x[n]) for n in ("admin1", "admin2", "locality", "region", "role")]
            ),
        )).alias("location_keys"),
        F.array_distinct(F.transform("hosts", lambda h: _struct(_or_text(h["canonical_name"], h["verbatim"]), norm_once(h["host_type"])))).alias("host_keys"),
        _struct(s("event_date.start"), s("event_date.end"), norm_text(s("event_date.precision"))).alias("event_date"),
        _struct(point(s("reference_period.start")), point(s("reference_period.end")), norm_text(s("reference_period.period_type"))).alias("reference_period"),
        _struct(yes(d["test_reported"]), *[norm_text(d[n]) for n in ("test_type", "method", "target", "specimen", "result")]).alias("diagnostics"),
        F.array_distinct(F.filter(F.transform("domains", norm_once), lambda x: x.isNotNull())).alias("domains"),
        F.array_distinct(F.transform("__quotes", lambda q: _struct(q["type"], F.when(q["text"] != "", q["text"]), q["page"]))).alias("evidence_keys"),
        s("__quotes").alias("quotes"), split.alias("clauses"),
    ]
    names = [
        "role", "type", "disease_c", "disease_v", "pathogen_c", "pathogen_v", "status", "metric_keys", "metric_facts", "location_keys", "host_keys",
        "event_date", "reference_period", "diagnostics", "domains", "evidence_keys", "quotes", "clauses",
    ]
    f = F.struct(*[key for name, key in zip(names, keys, strict=True) if parts is None or name in parts])
    return signals.select("doc", "idx", "local_signal_id", f.alias("f"))


def entity_exact(gc: Column, gv: Column, pc: Column, pv: Column) -> Column:
    """Canonical names when both sides have one, else verbatim ones (null equals null)."""
    both = gc.isNotNull() & pc.isNotNull()
    return F.when(both, gc == pc).otherwise(gv.eqNullSafe(pv)).cast("double")


def metric_equivalent(g: Column, p: Column) -> Column:
    """Conservative equivalence: missing details agree, contradictions do not."""
    agree = lambda n: g[n].isNull() | p[n].isNull() | (g[n] == p[n])
    counted = g["number"].isNotNull() & p["number"].isNotNull()
    neither = g["number"].isNull() & p["number"].isNull() & (g["text"].isNull() | p["text"].isNull())
    value = F.when(counted, g["number"] == p["number"]).otherwise(agree("text") & ~neither)
    return g["name"].eqNullSafe(p["name"]) & value & agree("unit") & agree("date") & agree("year") & agree("month")


def metric_support_f1(gold: Column, pred: Column) -> Column:
    """In-order one-to-one matching of metrics, as a fold that remembers used positions."""

    def step(acc: Column, g: Column) -> Column:
        free = F.filter(
            F.transform(pred, lambda p, i: F.struct(i.alias("i"), metric_equivalent(g, p).alias("ok"))),
            lambda x: yes(x["ok"]) & ~F.array_contains(acc, x["i"]),
        )
        return F.when(F.size(free) > 0, F.concat(acc, F.array(F.get(free, F.lit(0))["i"]))).otherwise(acc)

    used = F.size(F.aggregate(gold, F.array().cast("array<int>"), step))
    total = F.size(gold) + F.size(pred)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.round(2 * used / total, 6))


def component_columns(a: Column, b: Column, version: str = "0.4.7") -> dict[str, Column]:
    """The ten components of one pair of feature structs."""
    same = lambda n: a[n].eqNullSafe(b[n]).cast("double")
    metrics = metric_support_f1(a["metric_facts"], b["metric_facts"]) if version == "0.4.7" else set_f1(a["metric_keys"], b["metric_keys"])
    return {
        "signal_role": same("role"), "signal_type": same("type"),
        "disease": entity_exact(a["disease_c"], a["disease_v"], b["disease_c"], b["disease_v"]),
        "pathogen": entity_exact(a["pathogen_c"], a["pathogen_v"], b["pathogen_c"], b["pathogen_v"]),
        "metrics": metrics, "locations": set_f1(a["location_keys"], b["location_keys"]),
        "event_date": same("event_date"), "reference_period": same("reference_period"), "diagnostics": same("diagnostics"),
        "domains": set_f1(a["domains"], b["domains"]),
    }


def pair_components(gold: DataFrame, pred: DataFrame, version: str = "0.4.7") -> DataFrame:
    """Ten components and the weighted score of every same-document pair, with the ids ``gid`` and ``pid``."""
    g = gold.select("doc", F.col("idx").alias("g"), F.col("local_signal_id").alias("gid"), F.col("f").alias("gf"))
    p = pred.select("doc", F.col("idx").alias("p"), F.col("local_signal_id").alias("pid"), F.col("f").alias("pf"))
    parts = component_columns(F.col("gf"), F.col("pf"), version)
    out = g.join(p, "doc").select("doc", "g", "p", "gid", "pid", *[v.alias(k) for k, v in parts.items()])
    total = F.lit(0.0)
    for name, weight in PAIR_WEIGHTS.items():
        total = total + F.col(name) * F.lit(weight)
    return out.withColumn("score", F.round(total, 6))


#: Components that are plain comparisons; the others fold or intersect arrays.
PLAIN = ["signal_role", "signal_type", "disease", "pathogen", "event_date", "reference_period", "diagnostics"]


def f1_bound(gold: Column, pred: Column) -> Column:
    """The F1 of two arrays is at most that of full agreement of the shorter one."""
    total = F.size(gold) + F.size(pred)
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * F.least(F.size(gold), F.size(pred)) / total)


def reachable_pairs(gold: DataFrame, pred: DataFrame, version: str = "0.4.7", threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """The pairs of :func:`pair_components` that reach ``threshold``, with their scores; exact, at a fraction of its work.

    Three steps, each on what the one before left: role, type, disease and pathogen, joined on, must leave the
    threshold in reach if all else agreed; then the other plain comparisons with the sizes of the arrays as bounds of
    their F1; then sets and the fold over metrics. Bounds are raised past the rounding of scores.
    """
    least = threshold - 1e-6
    g = gold.select("doc", F.col("idx").alias("g"), F.col("f").alias("gf"))
    p = pred.select("doc", F.col("idx").alias("p"), F.col("f").alias("pf"))
    a, b = F.col("gf"), F.col("pf")
    parts = component_columns(a, b, version)
    metrics = ("metric_facts" if version == "0.4.7" else "metric_keys")
    arrays = {"metrics": metrics, "locations": "location_keys", "domains": "domains"}

    def weighed(names: list[str]) -> Column:
        total = F.lit(0.0)
        for name in names:
            total = total + parts[name] * F.lit(PAIR_WEIGHTS[name])
        return total

    first = PLAIN[:4]
    rest = sum(w for name, w in PAIR_WEIGHTS.items() if name not in first)
    bound = weighed(PLAIN)
    for name, keys in arrays.items():
        bound = bound + f1_bound(a[keys], b[keys]) * F.lit(PAIR_WEIGHTS[name])
    near = g.join(p, "doc").filter((weighed(first) + F.lit(rest) >= least) & (bound >= least))
    out = near.select("doc", "g", "p", *[v.alias(k) for k, v in parts.items()])
    total = F.lit(0.0)
    for name, weight in PAIR_WEIGHTS.items():
        total = total + F.col(name) * F.lit(weight)
    return out.withColumn("score", F.round(total, 6)).filter(F.col("score") >= threshold)


def match_greedy(pairs: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """One-to-one matching per document by (score desc, gold, prediction)."""
    ranked = _candidates(pairs, threshold)
    return _expand(ranked.select("doc", _greedy(F.col("cands")).alias("m")))


def _candidates(pairs: DataFrame, threshold: float) -> DataFrame:
    """Per document: pairs at the threshold, best first, and the number of predictions."""
    good = F.when(F.col("score") >= threshold, F.struct((-F.col("score")).alias("n"), "g", "p", "score"))
    docs = pairs.groupBy("doc").agg(F.array_sort(F.collect_list(good)).alias("cands"), F.size(F.collect_set("p")).alias("n_pred"))
    return docs.filter(F.size("cands") > 0)


def _greedy(cands: Column) -> Column:
    start = F.filter(cands, lambda x: F.lit(False))

    def step(acc: Column, x: Column) -> Column:
        taken = F.exists(acc, lambda m: (m["g"] == x["g"]) | (m["p"] == x["p"]))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(x)))

    return F.transform(F.aggregate(cands, start, step), lambda m: F.struct(m["g"].alias("g"), m["p"].alias("p"), m["score"].alias("score")))


def _expand(matches: DataFrame) -> DataFrame:
    return matches.select("doc", F.explode("m").alias("m")).select("doc", F.col("m.g").alias("g"), F.col("m.p").alias("p"), F.col("m.score").alias("score"))


def _most_total(scores: dict[int, dict[int, float]], golds: list[int], taken: set[int]) -> float:
    """Largest total score of a one-to-one matching of ``golds`` without the predictions ``taken``.

    Shortest augmenting paths with potentials; every gold has a private column of score 0 for no match.
    """
    columns = sorted({p for g in golds for p in scores[g]} - taken)
    cost = [[-scores[g].get(p, 0.0) for p in columns] + [0.0] * len(golds) for g in golds]
    width = len(columns) + len(golds)
    row_price, column_price, owner = [0.0] * len(golds), [0.0] * width, [-1] * width
    for row in range(len(golds)):
        least, came, done = [float("inf")] * width, [-1] * width, [False] * width
        at, source, total = -1, row, 0.0
        while True:
            best = -1
            for c in range(width):
                if not done[c]:
                    reach = total + cost[source][c] - row_price[source] - column_price[c]
                    if reach < least[c]:
                        least[c], came[c] = reach, at
                    if best < 0 or least[c] < least[best]:
                        best = c
            at, total = best, least[best]
            done[at] = True
            if owner[at] < 0:
                break
            source = owner[at]
        for c in range(width):
            if done[c]:
                column_price[c] += least[c] - total
                if owner[c] >= 0:
                    row_price[owner[c]] += total - least[c]
        row_price[row] += total
        while at >= 0:
            before = came[at]
            owner[at] = row if before < 0 else owner[before]
            at = before
    return -sum(cost[owner[c]][c] for c in range(width) if owner[c] >= 0)


def _best_assignment(cands: list) -> list:
    """Maximum total score, lexicographically smallest pairs on ties (1e-12), in polynomial time.

    Gold signals and predictions that no chain of candidates ties together are solved apart. Then each gold signal
    in turn takes the first prediction with which the largest total can still be reached.
    """
    scores: dict[int, dict[int, float]] = {}
    by_pred: dict[int, list[int]] = {}
    for c in cands:
        scores.setdefault(c["g"], {})[c["p"]] = c["score"]
        by_pred.setdefault(c["p"], []).append(c["g"])
    out, seen = [], set()
    for start in sorted(scores):
        if start in seen:
            continue
        part, pending = set(), [start]
        while pending:
            g = pending.pop()
            if g not in part:
                part.add(g)
                pending += [h for p in scores[g] for h in by_pred[p]]
        seen |= part
        if len(part) == 1 or len({p for g in part for p in scores[g]}) == 1:
            # All compete for one place: the best score, the smallest pair among equals.
            most = max(x for g in part for x in scores[g].values())
            out.append(min((g, p, x) for g in part for p, x in scores[g].items() if x >= most - 1e-12))
            continue
        rest, taken = sorted(part), set()
        goal = _most_total(scores, rest, taken)
        while rest:
            g = rest.pop(0)
            for p, score in sorted(scores[g].items()):
                if p not in taken and score + (left := _most_total(scores, rest, taken | {p})) >= goal - 1e-12:
                    out.append((g, p, score))
                    taken.add(p)
                    goal = left
                    break
    return [{"g": g, "p": p, "score": s} for g, p, s in sorted(out)]


_MATCHES = T.ArrayType(
    T.StructType([T.StructField("g", T.IntegerType()), T.StructField("p", T.IntegerType()), T.StructField("score", T.DoubleType())])
)
# Executors get these helpers by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.pandas_udf(_MATCHES)
def _assign(cands: pd.Series) -> pd.Series:
    return cands.map(_best_assignment)


def match_exact(pairs: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Best one-to-one matching per document, of any size.

    Documents without competition for a gold signal or a prediction are settled by
    native expressions; only contested ones reach the vectorised assignment.
    """
    docs = _candidates(pairs, threshold)
    once = lambda n: F.size(F.array_distinct(F.transform("cands", lambda x: x[n]))) == F.size("cands")
    docs = docs.withColumn("__free", once("g") & once("p"))
    plain = F.transform("cands", lambda m: F.struct(m["g"].alias("g"), m["p"].alias("p"), m["score"].alias("score")))
    native = docs.filter("__free").select("doc", plain.alias("m"))
    contested = docs.filter("not __free").select("doc", _assign(plain).alias("m"))
    return _expand(native.unionByName(contested))


def quote_similarity(g: Column, p: Column) -> Column:
    """Whether two quotations support the same statement, 0 to 1."""
    g_short = F.length(g["text"]) <= F.length(p["text"])
    contained = F.when(g_short, F.contains(p["text"], g["text"]) & ((F.size(g["content"]) >= 3) | (F.length(g["text"]) >= 24))).otherwise(
        F.contains(g["text"], p["text"]) & ((F.size(p["content"]) >= 3) | (F.length(p["text"]) >= 24))
    )
    gn, pn = g["numbers"], p["numbers"]
    shared = F.size(F.array_intersect(g["content"], p["content"]))
    return (
        F.when(~_comparable(g, p), F.lit(0.0))
        .when(g["text"] == p["text"], F.lit(1.0))
        .when(g["negated"] != p["negated"], F.lit(0.0))
        .when(contained, F.lit(1.0))
        .when((F.size(gn) > 0) & (F.size(pn) > 0) & ~F.arrays_overlap(gn, pn), F.lit(0.0))
        .when(shared < 3, F.lit(0.0))
        .otherwise(F.round(2 * shared / (F.size(g["content"]) + F.size(p["content"])), 6))
    )


def _comparable(g: Column, p: Column) -> Column:
    return g["type"].eqNullSafe(p["type"]) & ~yes(g["page"] != p["page"]) & (g["text"] != "") & (p["text"] != "")


def short_fragment(g: Column, p: Column) -> Column:
    """Very short numeric fragments: same numbers, same negation, one token set inside the other."""
    gn, pn = g["numbers"], p["numbers"]
    a, b = F.size(g["content"]), F.size(p["content"])
    inside = F.when(a <= b, F.size(F.array_except(g["content"], p["content"])) == 0).otherwise(F.size(F.array_except(p["content"], g["content"])) == 0)
    return _comparable(g, p) & (g["negated"] == p["negated"]) & (gn == pn) & (a > 0) & (b > 0) & (F.least(a, b) <= 2) & inside


def evidence_support(gold: Column, gold_clauses: Column, pred: Column, version: str = "0.4.7", threshold: float = SUPPORT_THRESHOLD) -> Column:
    """Support of gold quotations by predicted ones, inside one matched pair."""
    empty_both = (F.size(gold) == 0) & (F.size(pred) == 0)
    empty_one = (F.size(gold) == 0) | (F.size(pred) == 0)
    near = lambda a, b: quote_similarity(a, b) >= threshold
    if version == "0.4.7":

        def supported(g: Column, parts: Column) -> Column:
            whole = F.exists(pred, lambda p: ((F.size(parts) < 2) | F.contains(p["text"], g["text"])) & near(g, p))
            pieces = (F.size(parts) >= 2) & F.forall(parts, lambda c: F.exists(pred, lambda p: near(c, p) | short_fragment(c, p)))
            return whole | pieces

        hits = F.size(F.filter(F.zip_with(gold, gold_clauses, supported), lambda x: x))
        value = hits / F.size(gold)
    elif version == "0.4.6":
        recall = F.size(F.filter(gold, lambda g: F.exists(pred, lambda p: near(g, p)))) / F.size(gold)
        precision = F.size(F.filter(pred, lambda p: F.exists(gold, lambda g: near(g, p)))) / F.size(pred)
        value = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    else:
        cands = F.flatten(F.transform(gold, lambda g, i: F.transform(pred, lambda p, j: F.struct((-quote_similarity(g, p)).alias("n"), i.alias("g"), j.alias("p"), quote_similarity(g, p).alias("score")))))
        tp = F.size(_greedy(F.array_sort(F.filter(cands, lambda x: x["score"] >= threshold))))
        precision, recall = tp / F.size(pred), tp / F.size(gold)
        value = F.when(tp > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return F.when(empty_both, F.lit(1.0)).when(empty_one, F.lit(0.0)).otherwise(F.round(value, 6))


def matched_fields(matches: DataFrame, gold: DataFrame, pred: DataFrame, version: str = "0.4.7") -> DataFrame:
    """All 14 field values of each matched pair."""
    g = gold.select("doc", F.col("idx").alias("g"), F.col("f").alias("gf"))
    p = pred.select("doc", F.col("idx").alias("p"), F.col("f").alias("pf"))
    j = matches.select("doc", "g", "p", "score").join(g, ["doc", "g"]).join(p, ["doc", "p"])
    a, b = F.col("gf"), F.col("pf")
    j = j.withColumns(component_columns(a, b, version))
    return j.select(
        "doc", "g", "p", "score", F.col("signal_role").alias("signal_role_accuracy"), F.col("signal_type").alias("signal_type_accuracy"),
        F.col("disease").alias("disease_accuracy"), F.col("pathogen").alias("pathogen_accuracy"),
        a["status"].eqNullSafe(b["status"]).cast("double").alias("normalization_status_accuracy"), F.col("event_date").alias("event_date_accuracy"),
        F.col("reference_period").alias("reference_period_accuracy"), F.col("diagnostics").alias("diagnostics_accuracy"), F.col("domains").alias("domains_f1"),
        F.col("metrics").alias("metrics_f1"), F.col("locations").alias("locations_f1"), set_f1(a["host_keys"], b["host_keys"]).alias("hosts_f1"),
        set_f1(a["evidence_keys"], b["evidence_keys"]).alias("evidence_exact_f1"),
        evidence_support(a["quotes"], a["clauses"], b["quotes"], version).alias("evidence_support_f1"),
    )


def document_report(gold: DataFrame, pred: DataFrame, fields: DataFrame) -> DataFrame:
    """Counts, detection, field means (no match gives 1.0), composite and gate per document."""
    g = gold.groupBy("doc").agg(F.count("*").alias("gold_signals"))
    p = pred.groupBy("doc").agg(F.count("*").alias("predicted_signals"))
    m = fields.groupBy("doc").agg(F.count("*").alias("matched_signals"), *[F.avg(f).alias(f) for f in FIELD_METRICS])
    j = g.join(p, "doc", "full_outer").join(m, "doc", "left").na.fill(0, ["gold_signals", "predicted_signals", "matched_signals"])
    j = j.withColumns({"tp": F.col("matched_signals"), "fp": F.col("predicted_signals") - F.col("matched_signals"), "fn": F.col("gold_signals") - F.col("matched_signals")})
    j = j.withColumns({f: F.round(F.coalesce(f, F.lit(1.0)), 6) for f in FIELD_METRICS}).withColumn("__d", prf(F.col("tp"), F.col("fp"), F.col("fn")))
    j = j.select("*", "__d.*").drop("__d")
    # Whole millionths, so that the mean does not depend on the order of a sum and its ties go up.
    count = len(COMPOSITE_FIELDS) + 1
    total = F.round(F.col("f1") * 1_000_000).cast("long")
    for f in COMPOSITE_FIELDS:
        total = total + F.round(F.col(f) * 1_000_000).cast("long")
    composite = F.floor((2 * total + count) / (2 * count)) / 1_000_000
    gate = (
        (F.col("precision") >= 0.90) & (F.col("recall") >= 0.90) & (F.col("signal_role_accuracy") >= 0.90) & (F.col("signal_type_accuracy") >= 0.85)
        & (F.col("evidence_support_f1") >= 0.90)
    )
    return j.withColumns({"composite_score": composite, "single_document_pass": gate})


def unmatched(gold: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """Left-over gold and predicted signals with a compact snapshot."""
    snap = ["local_signal_id", "signal_role", "signal_type", "signal_summary"]

    def side(signals: DataFrame, name: str, column: str) -> DataFrame:
        keys = matches.select("doc", F.col(column).alias("idx"))
        return signals.join(keys, ["doc", "idx"], "left_anti").select("doc", F.lit(name).alias("side"), *snap)

    return side(gold, "gold", "g").unionByName(side(pred, "prediction", "p"))


def corpus_report(documents: DataFrame, adjudicated: DataFrame, thresholds: Mapping[str, float] | None = None, minimum: int = MINIMUM_DOCUMENTS) -> DataFrame:
    """One row: macro means (no document gives 0.0), micro detection, completeness and gate."""
    limits = {**RELEASE_THRESHOLDS, **(thresholds or {})}
    if any(isinstance(v, bool) or not 0 <= v <= 1 for v in limits.values()) or isinstance(minimum, bool) or minimum < 1:
        raise ValueError("thresholds must lie between 0 and 1 and the minimum be positive")
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    agg = documents.agg(
        F.count("*").alias("evaluated_documents"), mean("f1").alias("mean_signal_f1"), mean("evidence_exact_f1").alias("mean_evidence_exact_f1"),
        mean("evidence_support_f1").alias("mean_evidence_support_f1"), mean("signal_role_accuracy").alias("mean_signal_role_accuracy"),
        mean("signal_type_accuracy").alias("mean_signal_type_accuracy"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")],
    )
    total = adjudicated.agg(F.count("*").alias("adjudicated_documents"))
    out = agg.join(F.broadcast(total)).withColumn("__d", prf(F.col("tp"), F.col("fp"), F.col("fn")))
    passed = F.lit(True)
    for name, limit in limits.items():
        passed = passed & (F.col(name) >= limit)
    complete = (F.col("evaluated_documents") >= minimum) & (F.col("evaluated_documents") == F.col("adjudicated_documents"))
    return out.select(
        *agg.columns, "adjudicated_documents", F.col("__d.precision").alias("micro_precision"), F.col("__d.recall").alias("micro_recall"), F.col("__d.f1").alias("micro_f1"),
        complete.alias("corpus_complete"), passed.alias("metrics_pass"), (complete & passed).alias("ready"),
    )


def exploratory_report(rows: DataFrame) -> DataFrame:
    """One row over classified documents: field means only where something matched, else null.

    ``rows``: status plus the document report columns (null unless evaluated).
    """
    done = F.col("status") == "evaluated"
    some = done & (F.col("matched_signals") > 0)
    agg = rows.agg(
        F.count("*").alias("expected_documents"), F.count_if(done).alias("evaluated_documents"), F.count_if(some).alias("field_metric_documents"),
        F.round(F.avg(F.when(done, F.col("f1"))), 6).alias("macro_document_signal_f1"),
        *[F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")],
        *[F.round(F.avg(F.when(some, F.col(f))), 6).alias("mean_" + f) for f in EXPLORATORY_FIELDS],
        *[F.count_if(F.col("status") == s).alias("n_" + s) for s in ("failed", "prepared", "missing", "invalid_prediction")],
    )
    out = agg.withColumn("__d", prf(F.col("tp"), F.col("fp"), F.col("fn")))
    return out.select("*", F.col("__d.precision").alias("micro_precision"), F.col("__d.recall").alias("micro_recall"), F.col("__d.f1").alias("micro_f1"),
                      (F.col("evaluated_documents") == F.col("expected_documents")).alias("complete")).drop("__d")


def classify_runs(documents: DataFrame, runs: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(status per document, errors).

    ``documents``: document_id, source_sha256; ``runs``: document_id, status,
    source_sha256, signals_sha256, signals; ``predictions``: document_id, body, n_signals.
    """
    r = runs.select("document_id", F.col("status").alias("run_status"), F.col("source_sha256").alias("run_source"), "signals_sha256", "signals", F.lit(True).alias("__r"))
    p = predictions.select("document_id", F.sha2("body", 256).alias("__sha"), "n_signals")
    j = documents.join(r, "document_id", "left").join(p, "document_id", "left")
    sound = yes(F.col("run_source") == F.col("source_sha256")) & yes(F.col("__sha") == F.col("signals_sha256")) & yes(F.col("n_signals") == F.col("signals"))
    status = (
        F.when(F.col("__r").isNull(), "missing").when(F.col("run_status") == "failed", "failed").when(F.col("run_status") == "prepared", "prepared")
        .when(sound, "evaluated").otherwise("invalid_prediction")
    )
    twice = runs.groupBy("document_id").count().filter("count > 1").select("document_id", F.lit("duplicate_run").alias("reason"))
    foreign = runs.join(documents, "document_id", "left_anti").select("document_id", F.lit("foreign_run").alias("reason"))
    odd = runs.filter(~yes(F.col("status").isin("prepared", "generated", "failed"))).select("document_id", F.lit("unknown_status").alias("reason"))
    return j.select("document_id", status.alias("status")), twice.unionByName(foreign).unionByName(odd)


def corpus_reassembly(manifest: DataFrame, claims: DataFrame, stored: DataFrame, force: bool = False, present: DataFrame | None = None) -> DataFrame:
    """``(doc, status, claims, signals)`` of every manifest row; only documents that need it are assembled.

    ``manifest`` holds ``position``, ``doc``, ``status`` and the names ``claims`` and ``prediction``; ``claims`` the
    nested claims with the name of their set in ``doc``; ``stored`` the ``prediction`` names that exist.  ``present``
    names the claim sets in ``doc``, empty ones too (default: those with claims).  Counts are null where nothing was
    assembled.  Of rows with one destination the first is assembled, unless ``force``.
    """
    missing = lambda c: F.coalesce(c, F.lit("")) == ""
    here = (claims if present is None else present).select(F.col("doc").alias("claims")).distinct().withColumn("__here", F.lit(True))
    done = stored.select("prediction").distinct().withColumn("__done", F.lit(True))
    rows = manifest.select("position", "doc", "status", "claims", "prediction").join(here, "claims", "left").join(done, "prediction", "left")
    state = (
        F.when(~yes(F.col("status") == "adjudicated"), F.lit("skipped_not_adjudicated"))
        .when(missing(F.col("claims")) | missing(F.col("prediction")), F.lit("skipped_missing_config"))
        .when(F.col("__here").isNull(), F.lit("skipped_claims_not_found"))
        .when(F.col("__done").isNotNull() & ~F.lit(force), F.lit("existing"))
        .otherwise(F.lit("reassembled"))
    )
    rows = rows.withColumn("status", state)
    if not force:
        # A destination of several rows is there once the first of them is assembled; other rows meet no window.
        first = rows.filter(F.col("status") == "reassembled").groupBy("prediction").agg(F.min("position").alias("__first"))
        rows = rows.join(first, "prediction", "left").withColumn(
            "status", F.when((F.col("status") == "reassembled") & (F.col("position") > F.col("__first")), F.lit("existing")).otherwise(F.col("status"))
        )
    needed = claims.join(rows.filter(F.col("status") == "reassembled").select(F.col("claims").alias("doc")).distinct(), "doc", "left_semi")
    counts = needed.groupBy("doc").agg(F.count("*").alias("__claims"))
    made = assemble(needed).groupBy("doc").agg(F.count("*").alias("__signals"))
    counts = counts.join(made, "doc", "left").withColumnRenamed("doc", "claims")
    count = lambda c: F.when(F.col("status") == "reassembled", F.coalesce(F.col(c), F.lit(0).cast("long")))
    return rows.join(counts, "claims", "left").select("doc", "status", count("__claims").alias("claims"), count("__signals").alias("signals"))


def pair_benchmark(forward: DataFrame, reverse: DataFrame, expected: DataFrame, release: Mapping[str, float] | None = None) -> DataFrame:
    """One row: the eight pair metrics and the release gate.

    ``forward`` and ``reverse`` are matching results by pair_id, ``expected`` the
    adjudicated outcomes.  A ratio over nothing is 1.0.
    """
    shown = ["gate", "score", "information_coverage", "relation", "decision", "merge_allowed", "hard_conflict", "hard_conflict_reason"]
    f = forward.select("pair_id", F.struct(*shown, "source_eligible", "target_eligible").alias("a"))
    r = reverse.select("pair_id", F.struct(*shown, F.col("target_eligible").alias("source_eligible"), F.col("source_eligible").alias("target_eligible")).alias("b"))
    j = expected.join(f, "pair_id").join(r, "pair_id")
    hit = lambda c: F.count_if(yes(c))
    eligible, conflict, auto = F.col("expected_gate") == "eligible", yes(F.col("expected_hard_conflict")), F.col("a.decision") == "auto_linked"
    reasoned = conflict & F.col("expected_hard_conflict_reason").isNotNull()

    def ratio(num: Column, den: Column) -> Column:
        return F.when(hit(den) == 0, F.lit(1.0)).otherwise(F.round(hit(num & den) / hit(den), 6))

    out = j.agg(
        F.count("*").alias("evaluated_pairs"), hit(eligible).alias("eligible_pairs"), hit(~eligible).alias("ineligible_pairs"),
        hit(conflict).alias("expected_hard_conflicts"), hit(auto).alias("predicted_auto_links"),
        ratio(F.col("a.gate") == "ineligible", ~eligible).alias("ineligible_gate_accuracy"), ratio(F.col("a.hard_conflict"), conflict).alias("hard_conflict_recall"),
        ratio(F.col("a.hard_conflict_reason") == F.col("expected_hard_conflict_reason"), reasoned).alias("hard_conflict_reason_accuracy"),
        hit(conflict & auto).alias("hard_conflict_false_auto_links"), ratio(F.col("expected_decision") == "auto_linked", auto).alias("auto_link_precision"),
        ratio(F.col("a.decision").eqNullSafe(F.col("expected_decision")), F.lit(True)).alias("pair_decision_accuracy"),
        ratio(F.col("a.relation").eqNullSafe(F.col("expected_relation")), eligible).alias("relation_accuracy"),
        F.coalesce(F.bool_and(F.col("a").eqNullSafe(F.col("b"))), F.lit(True)).alias("order_invariance"),
    )
    passed = (F.col("hard_conflict_false_auto_links") <= 0) & F.col("order_invariance")
    for name, limit in {**PAIR_RELEASE, **(release or {})}.items():
        passed = passed & (F.col(name) >= limit)
    return out.withColumn("metrics_pass", passed)


def mismatch_summary(actual: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(differing pairs with their fields and scope, counts per scope)."""
    e = expected.select("pair_id", *[F.col("expected_" + f) for f in MISMATCH_FIELDS])
    j = actual.select("pair_id", *MISMATCH_FIELDS).join(e, "pair_id")
    names = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col("expected_" + f)), F.lit(f)) for f in MISMATCH_FIELDS]))
    rows = j.select("pair_id", names.alias("different_fields")).filter(F.size("different_fields") > 0)
    scope = F.when(F.col("different_fields") == F.array(F.lit("hard_conflict_reason")), "explanation_only").otherwise("functional")
    rows = rows.withColumn("scope", scope)
    return rows, rows.groupBy("scope").agg(F.count("*").alias("n"))
