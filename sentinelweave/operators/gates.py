"""Eligibility gates and row filters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from sentinelweave.functions.text import casefold, squash, strip_text

# Roles and types that never take part in automatic matching.
CONTEXT_ROLES = ["background_context", "surveillance_baseline"]
ALERT_TYPE = "official_alert"
# Words that mark a host mention as an object or institution.
NON_BIOLOGICAL_HOST = (
    r"(?iU)\b(embarcaci[oó]n|buque|crucero|barco|veh[ií]culo|laboratorio|hospital|instituci[oó]n|edificio)\b"
)
# Markers of training, generic investigation and facility inventories.
TRAINING_MARKERS = ["capacit", "transferencia de la técnica", "transferencia de la tecnica"]
INVESTIGATION_MARKERS = [
    "investigando el origen del brote",
    "investigación epidemiológica del brote", "investigacion epidemiologica del brote",
    "posibles circunstancias de exposición", "posibles circunstancias de exposicion",
]
FACILITY_SUBJECTS = ["granjas", "granjas comerciales", "farms", "commercial farms"]
FACILITY_UNITS = ["granjas", "farms"]
FACILITY_BLOCKERS = r"(?U)\b(brotes?|casos?|infect\w*|virus|aves|animales|outbreaks?|cases?|animals)\b"
FACILITY_ABSENCE = r"(?U)\b(no se (encuentran|encontraron|registran|registraron)|there (are|were) no)\s+(granjas|farms)\b"


@dataclass(frozen=True)
class EligibilityConfig:
    """Gate of the pair benchmark: roles allowed, roles and types excluded."""

    eligible_roles: tuple[str, ...] = ("primary_event", "negative_evidence")
    ineligible_roles: tuple[str, ...] = ("background_context", "surveillance_baseline")
    ineligible_types: tuple[str, ...] = field(default=("official_alert",))


def contains_any(text: Column, markers: list[str]) -> Column:
    found = F.lit(False)
    for marker in markers:
        found = found | F.contains(text, F.lit(marker))
    return found


def current_eligible(signals: DataFrame) -> DataFrame:
    """Signals that are the current version and passed the stored gate."""
    return signals.filter(F.col("is_current") & F.col("event_matching_eligible"))


def event_matching_eligible(role: Column, kind: Column, disease: Column, pathogen: Column) -> Column:
    """Production pre-gate: a live role, not an alert, and one resolved identity."""

    def resolved(entity: Column) -> Column:
        return F.coalesce(
            (entity["normalization_status"] == "resolved") & (strip_text(entity["canonical_name"]) != ""), F.lit(False)
        )

    blocked = F.coalesce(kind == ALERT_TYPE, F.lit(False)) | F.coalesce(role.isin(CONTEXT_ROLES), F.lit(False))
    return ~blocked & (resolved(disease) | resolved(pathogen))


def manifest_eligible(role: Column, kind: Column, cfg: EligibilityConfig = EligibilityConfig()) -> Column:
    """Benchmark gate."""
    return (
        F.coalesce(role.isin(*cfg.eligible_roles), F.lit(False))
        & ~F.coalesce(role.isin(*cfg.ineligible_roles), F.lit(False))
        & ~F.coalesce(kind.isin(*cfg.ineligible_types), F.lit(False))
    )


def claim_text(summary: Column, evidence: Column) -> Column:
    """Case-folded summary and excerpts of a claim."""
    texts = F.transform(evidence, lambda e: F.coalesce(e["text"], F.lit("")))
    return casefold(F.concat_ws(" ", F.coalesce(summary, F.lit("")), F.coalesce(texts, F.array().cast("array<string>"))))


def evidence_text(evidence: Column) -> Column:
    """Case-folded excerpts only, whitespace collapsed."""
    texts = F.transform(evidence, lambda e: F.coalesce(e["text"], F.lit("")))
    return casefold(squash(F.concat_ws(" ", F.coalesce(texts, F.array().cast("array<string>")))))


def yes(c: Column) -> Column:
    """Null-safe truth."""
    return F.coalesce(c, F.lit(False))


def facility_inventory(c=F.col) -> Column:
    """An explicit zero inventory of facilities; never an absence of infection."""
    text = evidence_text(c("evidence"))
    return yes(
        (c("claim_kind") == "wildlife_presence_absence")
        & (c("polarity") == "negative")
        & (c("subject")["subject_type"] == "other")
        & casefold(strip_text(c("subject")["verbatim"])).isin(FACILITY_SUBJECTS)
        & c("metric")["reported"]
        & (c("metric")["value_numeric"] == 0)
        & c("metric")["unit"].isin(FACILITY_UNITS)
        & ~yes(c("diagnostics")["test_reported"])
        & ~yes(c("diagnostics")["result"] == "negative")
        & ~yes(c("genomics")["sequence_reported"])
        & ~text.rlike(FACILITY_BLOCKERS)
        & text.rlike(FACILITY_ABSENCE)
    )


def negative_history(c=F.col) -> Column:
    """A negative baseline over a closed period without a number."""
    return yes(
        (c("claim_kind") == "surveillance_baseline")
        & (c("polarity") == "negative")
        & ~yes(c("metric")["reported"])
        & (c("reference_period")["period_type"] == "historical_period")
    )


def training_intervention(c=F.col) -> Column:
    """An intervention without a number that only reports training."""
    return yes(
        (c("claim_kind") == "intervention")
        & ~yes(c("metric")["reported"])
        & contains_any(claim_text(c("summary"), c("evidence")), TRAINING_MARKERS)
    )


def generic_investigation(c=F.col) -> Column:
    """An investigation claim that reports no metric, test or sequence."""
    return yes(
        (c("claim_kind") == "laboratory_investigation")
        & ~yes(c("metric")["reported"])
        & ~yes(c("diagnostics")["test_reported"])
        & ~yes(c("genomics")["sequence_reported"])
        & contains_any(claim_text(c("summary"), c("evidence")), INVESTIGATION_MARKERS)
    )


def suppression_reason(c=F.col) -> Column:
    """Why a claim is left out of the canonical signals; null when it is kept."""
    return (
        F.when(facility_inventory(c), F.lit("facility_inventory"))
        .when(generic_investigation(c), F.lit("generic_investigation"))
        .when(negative_history(c), F.lit("negative_history"))
        .when(training_intervention(c), F.lit("training_intervention"))
    )


def suppress_claims(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split claims into kept ones and dropped ones with a reason."""
    marked = claims.withColumn("reason", suppression_reason())
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def operational_signal(c=F.col) -> Column:
    """A training intervention signal without metrics."""
    return yes(
        (c("signal_type") == "intervention")
        & (F.coalesce(F.size(c("metrics")), F.lit(0)) <= 0)
        & contains_any(claim_text(c("signal_summary"), c("evidence")), TRAINING_MARKERS)
    )


def drop_operational_signals(signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = signals.withColumn("__op", operational_signal())
    return marked.filter(~F.col("__op")).drop("__op"), marked.filter(F.col("__op")).drop("__op")


def host_label(host: Column) -> Column:
    return strip_text(
        F.concat(F.coalesce(host["verbatim"], F.lit("")), F.lit(" "), F.coalesce(host["canonical_name"], F.lit("")))
    )


def biological_hosts(hosts: Column) -> Column:
    """Drop vessels, vehicles, laboratories and buildings from a host list."""
    return F.filter(hosts, lambda h: ~host_label(h).rlike(NON_BIOLOGICAL_HOST))
