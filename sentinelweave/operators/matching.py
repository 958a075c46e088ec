"""Pairwise event matching: features once per signal, scores as column expressions.

Text work (normal forms, refutation cues, intervals) happens once per signal in
:func:`match_features`.  A pair then carries two narrow feature structs, so scoring
n*k pairs shuffles no summaries or excerpts.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from sentinelweave.functions.dates import signal_interval
from sentinelweave.functions.text import fold_accents, norm_text, signal_text
from sentinelweave.operators.gates import EligibilityConfig, contains_any, manifest_eligible, yes

# Component weights and decision thresholds.
WEIGHTS = {
    "etiology": 0.35, "geography": 0.25, "temporality": 0.15,
    "host": 0.10, "epidemiology": 0.10, "shared_context": 0.05,
}
AUTO_LINK_MIN = 0.80
REVIEW_MIN = 0.60
SUPPORT_MIN = 0.60
MIN_COVERAGE = 0.50
# Location roles that place the event itself and roles that only give context.
EVENT_ROLES = ["event_location", "possible_exposure_location", "sampling_location"]
CONTEXT_ROLES = [
    "travel_history", "laboratory_location", "testing_location", "current_location", "reporting_jurisdiction",
]
# Names of one pathogen genus treated as near-synonyms.
GENUS_SYNONYMS = ["hantavirus", "andes virus", "virus andes", "cepa andes", "orthohantavirus andesense"]
# Host sectors whose difference is compatible.
CROSS_SECTOR_HOSTS = ["human", "wildlife", "domestic_animal", "vector"]
# Compatibility of two different signal types; every other pair is 0.45.
TYPE_COMPATIBILITY = {
    ("cluster", "outbreak"): 0.95, ("case_report", "outbreak"): 0.90, ("case_report", "cluster"): 0.90,
    ("laboratory_investigation", "laboratory_result"): 0.95, ("genomic_observation", "laboratory_result"): 0.85,
    ("laboratory_result", "outbreak"): 0.80, ("genomic_observation", "outbreak"): 0.80,
    ("outbreak", "transmission_observation"): 0.85, ("case_report", "laboratory_result"): 0.85,
    ("case_report", "transmission_observation"): 0.80,
    ("genomic_observation", "transmission_observation"): 0.65, ("intervention", "wildlife_event"): 0.70,
    ("intervention", "laboratory_result"): 0.70, ("intervention", "travel_or_mobility"): 0.70,
    ("outbreak", "travel_or_mobility"): 0.60,
}
DEFAULT_COMPATIBILITY = 0.45
# Relation classes decided by the unordered pair of signal types.
REFINING_TYPES = [
    ("case_report", "outbreak"), ("cluster", "outbreak"), ("laboratory_investigation", "laboratory_result"),
]
SUPPORTING_TYPES = [("intervention", "travel_or_mobility")]
POSSIBLE_TYPES = [
    ("intervention", "laboratory_result"), ("genomic_observation", "intervention"), ("intervention", "wildlife_event"),
]
# Accent-folded wording of an explicit non-relation.
NON_RELATION_MARKERS = [
    "sin relacion", "no relacionado", "no relacionada", "no relacionados", "no relacionadas", "diferente de",
    "descartar", "descarto", "not related", "unrelated", "different from",
]
TRANSMISSION_FIELDS = ["human_to_human", "animal_to_human", "vector_borne"]
# Fixed value: prefix of context anchors strong enough to override low coverage.
STRONG_ANCHOR_PREFIX = "vessel:"


@dataclass(frozen=True)
class MatchConfig:
    """Matching policy; construction fails on an inconsistent configuration."""

    eligibility: EligibilityConfig = field(default_factory=EligibilityConfig)
    weights: Mapping[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    auto_link_min: float = AUTO_LINK_MIN
    review_min: float = REVIEW_MIN
    genomic_incompatibility: bool = True
    official_non_relation: bool = True
    source_refutation: bool = True

    def __post_init__(self) -> None:
        if set(self.weights) != set(WEIGHTS):
            raise ValueError("weights must name exactly the six components")
        values = [*self.weights.values(), self.auto_link_min, self.review_min]
        if any(isinstance(v, bool) or not math.isfinite(v) or not 0 <= v <= 1 for v in values):
            raise ValueError("weights and thresholds must lie between 0 and 1")
        if not math.isclose(sum(self.weights.values()), 1.0, rel_tol=0.0, abs_tol=1e-9):
            raise ValueError("weights must sum to 1")
        if self.auto_link_min <= self.review_min:
            raise ValueError("auto_link_min must be greater than review_min")
        gate = self.eligibility
        if set(gate.eligible_roles) & set(gate.ineligible_roles):
            raise ValueError("eligible and ineligible roles must be disjoint")
        if "official_alert" not in gate.ineligible_types:
            raise ValueError("official_alert must be an ineligible type")


def entity_name(entity: Column) -> Column:
    """Canonical name, else the verbatim one unless explicitly unresolved."""
    unresolved = yes(norm_text(entity["normalization_status"]) == "unresolved")
    return F.coalesce(norm_text(entity["canonical_name"]), F.when(~unresolved, norm_text(entity["verbatim"])))


def _norm_locations(locations: Column, roles: list[str]) -> Column:
    wanted = F.filter(locations, lambda x: yes(norm_text(x["role"]).isin(roles)))
    return F.coalesce(
        F.transform(
            wanted,
            lambda x: F.struct(
                norm_text(F.coalesce(F.nullif(x["country_iso2"], F.lit("")), x["country"])).alias("country"),
                norm_text(x["admin1"]).alias("admin1"),
                norm_text(x["admin2"]).alias("admin2"),
                norm_text(x["locality"]).alias("locality"),
            ),
        ),
        F.array().cast("array<struct<country:string,admin1:string,admin2:string,locality:string>>"),
    )


def _distinct_norm(array: Column) -> Column:
    found = F.array_distinct(F.filter(array, lambda x: x.isNotNull()))
    return F.coalesce(found, F.array().cast("array<string>"))


def match_features(signals: DataFrame, cfg: MatchConfig = MatchConfig(), id_col: str = "signal_id") -> DataFrame:
    """One narrow ``mf`` struct per signal holding everything a pair score needs."""
    s = F.col
    result = norm_text(s("diagnostics")["result"])
    normal = signals.select(
        s(id_col).alias("signal_id"),
        manifest_eligible(s("signal_role"), s("signal_type"), cfg.eligibility).alias("eligible"),
        entity_name(s("disease")).alias("disease"),
        entity_name(s("pathogen")).alias("pathogen"),
        _norm_locations(s("locations"), EVENT_ROLES).alias("event_places"),
        _norm_locations(s("locations"), CONTEXT_ROLES).alias("context_places"),
        signal_interval(s("event_date"), s("reference_period")).alias("__span"),
        F.coalesce(F.size(s("hosts")), F.lit(0)).alias("host_count"),
        _distinct_norm(
            F.transform(s("hosts"), lambda h: norm_text(F.coalesce(F.nullif(h["canonical_name"], F.lit("")), h["verbatim"])))
        ).alias("host_names"),
        _distinct_norm(F.transform(s("hosts"), lambda h: norm_text(h["host_type"]))).alias("host_types"),
        norm_text(s("signal_type")).alias("type"),
        result.alias("__result"),
        *[norm_text(s("transmission")[f]).alias(f) for f in TRANSMISSION_FIELDS],
        _distinct_norm(F.transform(s("domains"), norm_text)).alias("domains"),
        norm_text(s("signal_role")).alias("__role"),
        norm_text(s("verification_status")).alias("__status"),
        yes(s("genomics")["sequence_reported"]).alias("sequenced"),
        F.coalesce(fold_accents(signal_text(s("signal_summary"), s("evidence"))), F.lit("")).alias("__text"),
    )
    refuted, known = F.lit(False), F.lit(False)
    for name in TRANSMISSION_FIELDS:
        refuted = refuted | yes(F.col(name) == "refuted")
        known = known | yes(F.col(name) != "unknown")
    features = normal.withColumns(
        {
            "lo": F.col("__span.lo"),
            "hi": F.col("__span.hi"),
            "result": F.when(F.col("__result").isin("positive", "negative", "indeterminate"), F.col("__result")),
            "refuted": refuted,
            "transmission_known": known,
            "negative_refutation": yes(F.col("__role") == "negative_evidence") & (yes(F.col("__status") == "refuted") | refuted),
            "non_relation": contains_any(F.col("__text"), NON_RELATION_MARKERS),
        }
    )
    fields = [c for c in features.columns if c != "signal_id" and not c.startswith("__")]
    return features.select("signal_id", F.struct(*fields).alias("mf"))


def etiology(l: Column, r: Column) -> Column:
    disease = F.when(l["disease"].isNotNull() & r["disease"].isNotNull(), (l["disease"] == r["disease"]).cast("double"))
    pathogen = F.when(
        l["pathogen"].isNotNull() & r["pathogen"].isNotNull(),
        F.when(l["pathogen"] == r["pathogen"], F.lit(1.0))
        .when(l["pathogen"].isin(GENUS_SYNONYMS) & r["pathogen"].isin(GENUS_SYNONYMS), F.lit(0.85))
        .otherwise(F.lit(0.0)),
    )
    return F.coalesce(0.75 * pathogen + 0.25 * disease, pathogen, 0.80 * disease)


def place_similarity(a: Column, b: Column) -> Column:
    both = a["country"].isNotNull() & b["country"].isNotNull()
    return (
        F.when(both & (a["country"] != b["country"]), F.lit(0.0))
        .when(a["locality"] == b["locality"], F.lit(1.0))
        .when(a["admin2"] == b["admin2"], F.lit(0.90))
        .when(a["admin1"] == b["admin1"], F.lit(0.80))
        .when(both, F.lit(0.35))
        .otherwise(F.lit(0.0))
    )


def best_place(a: Column, b: Column) -> Column:
    """Best similarity over two place lists; null when either is empty."""
    return F.array_max(F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: place_similarity(x, y)))))


def geography(l: Column, r: Column) -> Column:
    return best_place(l["event_places"], r["event_places"])


def temporality(l: Column, r: Column) -> Column:
    known = l["lo"].isNotNull() & r["lo"].isNotNull()
    overlap = (l["lo"] <= r["hi"]) & (r["lo"] <= l["hi"])
    apart = F.when(l["hi"] < r["lo"], F.date_diff(r["lo"], l["hi"])).otherwise(F.date_diff(l["lo"], r["hi"]))
    return F.when(
        known,
        F.when(overlap, F.lit(1.0))
        .when(apart <= 7, F.lit(0.90))
        .when(apart <= 30, F.lit(0.75))
        .when(apart <= 90, F.lit(0.50))
        .when(apart <= 180, F.lit(0.25))
        .otherwise(F.lit(0.0)),
    )


def host(l: Column, r: Column) -> Column:
    sectors = F.array(*[F.lit(x) for x in CROSS_SECTOR_HOSTS])

    def all_sectors(types: Column) -> Column:
        return (F.size(types) > 0) & (F.size(F.array_except(types, sectors)) == 0)

    return F.when(
        (l["host_count"] > 0) & (r["host_count"] > 0),
        F.when(F.arrays_overlap(l["host_names"], r["host_names"]), F.lit(1.0))
        .when(F.arrays_overlap(l["host_types"], r["host_types"]), F.lit(0.85))
        .when(all_sectors(l["host_types"]) & all_sectors(r["host_types"]), F.lit(0.50))
        .otherwise(F.lit(0.25)),
    )


def type_pair(l: Column, r: Column) -> Column:
    return F.concat_ws("|", F.least(l["type"], r["type"]), F.greatest(l["type"], r["type"]))


def _pair_in(l: Column, r: Column, pairs: list[tuple[str, str]]) -> Column:
    return type_pair(l, r).isin(["|".join(p) for p in pairs])


def epidemiology(l: Column, r: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p, v in TYPE_COMPATIBILITY.items() for x in ("|".join(p), v)])
    base = F.when(l["type"] == r["type"], F.lit(1.0)).otherwise(
        F.coalesce(F.try_element_at(table, type_pair(l, r)), F.lit(DEFAULT_COMPATIBILITY))
    )
    # least() skips nulls, so a cap that does not apply is simply null.
    caps = [F.when((l["result"] != r["result"]) & l["result"].isin("positive", "negative") & r["result"].isin("positive", "negative"), F.lit(0.25))]
    both = (l["type"] == "transmission_observation") & (r["type"] == "transmission_observation")
    for name in TRANSMISSION_FIELDS:
        a, b = l[name], r[name]
        cap = F.when((a == "refuted") | (b == "refuted"), F.lit(0.10)).otherwise(F.lit(0.75))
        caps.append(F.when(both & (a != "unknown") & (b != "unknown") & (a != b), cap))
    score = F.least(base, *caps)
    return F.when(l["type"].isNotNull() & r["type"].isNotNull(), score)


def shared_context(l: Column, r: Column) -> Column:
    jaccard = F.when(
        (F.size(l["domains"]) > 0) & (F.size(r["domains"]) > 0),
        F.size(F.array_intersect(l["domains"], r["domains"])) / F.size(F.array_union(l["domains"], r["domains"])),
    )
    places = best_place(l["context_places"], r["context_places"])
    count = jaccard.isNotNull().cast("int") + places.isNotNull().cast("int")
    return F.when(count > 0, (F.coalesce(jaccard, F.lit(0.0)) + F.coalesce(places, F.lit(0.0))) / count)


COMPONENTS = {
    "etiology": etiology, "geography": geography, "temporality": temporality,
    "host": host, "epidemiology": epidemiology, "shared_context": shared_context,
}


def hard_conflict_reason(l: Column, r: Column, cfg: MatchConfig = MatchConfig()) -> Column:
    """Reason an explicit refutation forbids a merge, strongest first; null when none."""

    def either(test) -> Column:
        return test(l, r) | test(r, l)

    genomic = either(
        lambda a, b: a["negative_refutation"] & a["sequenced"] & b["sequenced"] & (a["refuted"] | a["non_relation"])
    )
    official = either(lambda a, _: a["negative_refutation"] & a["non_relation"])
    source = either(lambda a, _: a["negative_refutation"] & a["refuted"])
    return (
        F.when(F.lit(cfg.genomic_incompatibility) & genomic, F.lit("explicit_genomic_incompatibility"))
        .when(F.lit(cfg.official_non_relation) & official, F.lit("explicit_official_non_relation"))
        .when(F.lit(cfg.source_refutation) & source, F.lit("explicit_source_refutation"))
    )


def transmission_refinement(l: Column, r: Column) -> Column:
    both = (l["type"] == "transmission_observation") & (r["type"] == "transmission_observation")
    return yes(both) & (l["transmission_known"] != r["transmission_known"])


def relation_class(l: Column, r: Column, score: Column, conflict: Column) -> Column:
    def both(name: str) -> Column:
        return (l["type"] == name) & (r["type"] == name)

    return (
        F.when(conflict, F.lit("contradicts"))
        .when(both("genomic_observation"), F.lit("duplicates"))
        .when(both("outbreak"), F.lit("refines"))
        .when(both("transmission_observation"), F.when(transmission_refinement(l, r), F.lit("refines")).otherwise(F.lit("supports")))
        .when(both("travel_or_mobility"), F.lit("possibly_related"))
        .when(_pair_in(l, r, REFINING_TYPES), F.lit("refines"))
        .when(_pair_in(l, r, SUPPORTING_TYPES), F.lit("supports"))
        .when(_pair_in(l, r, POSSIBLE_TYPES), F.lit("possibly_related"))
        .when(score >= SUPPORT_MIN, F.lit("supports"))
        .otherwise(F.lit("unknown"))
    )


def pair_decision(l: Column, r: Column, relation: Column, score: Column, conflict: Column, cfg: MatchConfig = MatchConfig()) -> Column:
    """``struct<decision,merge_allowed>`` of an eligible pair."""
    mergeable = relation.isin("duplicates", "refines")
    held = (relation == "refines") & transmission_refinement(l, r)
    strong = yes(score >= cfg.auto_link_min)
    decision = (
        F.when(conflict, F.lit("rejected"))
        .when(mergeable & strong & ~held, F.lit("auto_linked"))
        .when(mergeable, F.lit("review_required"))
        .when(relation.isin("supports", "possibly_related"), F.lit("review_required"))
        .otherwise(F.lit("rejected"))
    )
    return F.struct(decision.alias("decision"), (~conflict & mergeable).alias("merge_allowed"))


def with_features(pairs: DataFrame, features: DataFrame, left: str = "source_id", right: str = "target_id") -> DataFrame:
    """Attach the feature structs of both endpoints as ``l`` and ``r``."""
    a = features.select(F.col("signal_id").alias(left), F.col("mf").alias("l"))
    b = features.select(F.col("signal_id").alias(right), F.col("mf").alias("r"))
    return pairs.join(a, left).join(b, right)


def match_pairs(pairs: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Score, classify and decide pairs carrying ``l`` and ``r`` feature structs.

    Ineligible pairs short-circuit to a null score with coverage 0.
    """
    l, r = F.col("l"), F.col("r")
    eligible = l["eligible"] & r["eligible"]
    scored = pairs.withColumn("eligible", eligible)
    scored = scored.withColumns({name: F.when(F.col("eligible"), f(l, r)) for name, f in COMPONENTS.items()})
    weighted, observed = F.lit(0.0), F.lit(0.0)
    for name in COMPONENTS:
        weight = F.lit(float(cfg.weights[name]))
        weighted = weighted + F.coalesce(weight * F.col(name), F.lit(0.0))
        observed = observed + F.when(F.col(name).isNotNull(), weight).otherwise(F.lit(0.0))
    scored = scored.withColumns({"__w": weighted, "__o": observed})
    scored = scored.withColumns(
        {
            "score": F.when(F.col("__o") > 0, F.round(F.col("__w") / F.col("__o"), 6)),
            "information_coverage": F.round(F.col("__o"), 6),
            "hard_conflict_reason": F.when(F.col("eligible"), hard_conflict_reason(l, r, cfg)),
        }
    )
    conflict = F.col("hard_conflict_reason").isNotNull()
    scored = scored.withColumn(
        "relation", F.when(F.col("eligible"), relation_class(l, r, F.col("score"), conflict))
    )
    verdict = pair_decision(l, r, F.col("relation"), F.col("score"), conflict, cfg)
    return scored.withColumns(
        {
            "gate": F.when(F.col("eligible"), F.lit("eligible")).otherwise(F.lit("ineligible")),
            "source_eligible": l["eligible"],
            "target_eligible": r["eligible"],
            "hard_conflict": conflict,
            "decision": F.when(F.col("eligible"), verdict["decision"]),
            "merge_allowed": F.col("eligible") & verdict["merge_allowed"],
            **{name: F.round(F.col(name), 6) for name in COMPONENTS},
        }
    ).drop("l", "r", "__w", "__o")


def shared_strong_anchors(a: Column, b: Column) -> Column:
    def tidy(x: Column) -> Column:
        return F.filter(F.transform(x, norm_text), lambda v: yes(v.startswith(STRONG_ANCHOR_PREFIX)))

    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_intersect(tidy(F.coalesce(a, empty)), tidy(F.coalesce(b, empty))))


def auto_link_guard(matches: DataFrame, source_anchors: str = "source_anchors", target_anchors: str = "target_anchors") -> DataFrame:
    """Withdraw automatic links built on too little information.

    Low coverage stays automatic only when both signals share a strong context anchor.
    """
    shared = shared_strong_anchors(F.col(source_anchors), F.col(target_anchors))
    auto = yes(F.col("decision") == "auto_linked")
    low = auto & F.col("information_coverage").isNotNull() & (F.col("information_coverage") < MIN_COVERAGE)
    rescued = low & (F.size(shared) > 0)
    missing = auto & F.col("information_coverage").isNull()
    reason = F.when(missing, F.lit("information_coverage_unavailable")).when(
        low & ~rescued, F.lit("insufficient_information_coverage")
    )
    return matches.withColumns(
        {
            "base_decision": F.col("decision"),
            "policy_version": F.lit("0.4.9"),
            "auto_link_guard_reason": reason,
            "auto_link_guard_override_reason": F.when(rescued, F.lit("shared_strong_event_context_anchor")),
            "shared_event_context_anchors": F.when(rescued, shared).otherwise(F.array().cast("array<string>")),
            "decision": F.when(reason.isNotNull(), F.lit("review_required")).otherwise(F.col("decision")),
        }
    )


def match_summary(matches: DataFrame, by: str = "anchor_id") -> DataFrame:
    """Counts per anchor."""
    persistable = yes(F.col("gate") == "eligible")
    return matches.groupBy(by).agg(
        F.count("*").alias("candidates"),
        F.count_if(F.col("decision") == "auto_linked").alias("auto_linked"),
        F.count_if(F.col("decision") == "review_required").alias("review_required"),
        F.count_if(F.col("decision") == "rejected").alias("rejected"),
        F.count_if(~persistable).alias("ineligible"),
        F.count_if(F.col("hard_conflict")).alias("hard_conflicts"),
        F.count_if(persistable).alias("persistable"),
        F.count_if(~persistable).alias("skipped"),
    )
