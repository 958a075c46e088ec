"""Checks that return failing rows: contracts, literal evidence, bindings, table audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sentinelweave.functions.dates import iso_date
from sentinelweave.functions.text import squash, strip_text
from sentinelweave.operators.gates import yes

# Allowed sets of the signal contract.
SIGNAL_ROLES = ["primary_event", "background_context", "surveillance_baseline", "negative_evidence"]
VERIFICATION = ["confirmed", "probable", "suspected", "reported", "unknown", "refuted"]
PAIR_GATES = ["eligible", "ineligible"]
PAIR_RELATIONS = ["supports", "duplicates", "refines", "contradicts", "possibly_related", "unrelated", "unknown"]
PAIR_DECISIONS = ["auto_linked", "review_required", "rejected"]
TOKEN_COUNTERS = ["input_tokens", "cached_input_tokens", "output_tokens", "reasoning_tokens", "total_tokens"]
UUID_PATTERN = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"


def literal_evidence(children: DataFrame, raw: DataFrame, owner: str = "signal_id") -> DataFrame:
    """Failing excerpts: blank, or not contiguous in the source after whitespace collapse.

    The source text is collapsed once per document, then joined to its excerpts.
    """
    source = raw.select("raw_item_id", squash("raw_text").alias("__src"))
    excerpts = children.select("raw_item_id", owner, F.posexplode("evidence").alias("pos", "e")).select(
        "raw_item_id", owner, "pos", F.col("e.text").alias("excerpt")
    )
    blank = strip_text(F.coalesce("excerpt", F.lit(""))) == ""
    joined = excerpts.join(source, "raw_item_id", "left")
    reason = F.when(blank, "blank").when(~yes(F.contains("__src", squash("excerpt"))), "not_literal")
    return joined.withColumn("reason", reason).filter("reason is not null").select("raw_item_id", owner, "pos", "reason")


def document_binding(payloads: DataFrame, docs: DataFrame, fields: Sequence[str], key: str = "raw_item_id") -> DataFrame:
    """Payloads whose declared document differs from the stored one."""
    d = docs.select(key, *[F.col(f).alias("d_" + f) for f in fields], F.lit(True).alias("__known"))
    joined = payloads.select(key, *fields).join(d, key, "left")
    checks = [F.when(F.col("__known").isNull(), F.lit("unknown_document"))]
    checks += [F.when(F.col("__known") & ~F.col(f).eqNullSafe(F.col("d_" + f)), F.lit(f)) for f in fields]
    bad = joined.withColumn("different", F.array_compact(F.array(*checks)))
    return bad.filter(F.size("different") > 0).select(key, "different")


def event_date_policy(payloads: DataFrame, policy: str = "unknown_only") -> DataFrame:
    """Rows whose event date breaks the declared policy."""
    if policy != "unknown_only":
        raise ValueError(f"unknown event date policy {policy}")
    d = F.col("event_date")
    fine = d["start"].isNull() & d["end"].isNull() & yes(d["precision"] == "unknown")
    return payloads.filter(~fine)


@dataclass(frozen=True)
class Rule:
    """One contract rule on a field path; ``name[]`` in a path means every item of an array."""

    path: str
    kind: str
    arg: object = None

    def broken(self) -> Column:
        head, *inner = self.path.split("[]")
        value = F.col(head)
        return self._any(value, [x.lstrip(".") for x in inner]) if inner else self._breaks(value)

    def _any(self, items: Column, inner: list[str]) -> Column:
        """Whether an item breaks the rule; a null array has none."""
        def one(item: Column) -> Column:
            for name in filter(None, inner[0].split(".")):
                item = item[name]
            return self._any(item, inner[1:]) if len(inner) > 1 else self._breaks(item)

        return yes(F.exists(items, lambda x: yes(one(x))))

    def _breaks(self, value: Column) -> Column:
        if self.kind == "required":
            return value.isNull()
        if self.kind == "non_blank":
            return strip_text(F.coalesce(value, F.lit(""))) == ""
        if self.kind == "filled":
            return F.coalesce(value, F.lit("")) == ""
        if self.kind == "enum":
            return value.isNotNull() & ~yes(value.isin(list(self.arg)))
        if self.kind == "range":
            low, high = self.arg
            return value.isNotNull() & ~yes(value.between(low, high))
        if self.kind == "min":
            return value.isNotNull() & ~yes(value >= self.arg)
        if self.kind == "date":
            return value.isNotNull() & iso_date(value).isNull()
        if self.kind == "uuid":
            return value.isNotNull() & ~value.rlike(UUID_PATTERN)
        if self.kind == "pattern":
            return value.isNotNull() & ~value.rlike(self.arg)
        if self.kind == "min_items":
            return ~yes(F.size(value) >= self.arg)
        if self.kind == "unique":
            return yes(F.size(F.array_distinct(value)) < F.size(value))
        if self.kind == "items_enum":
            return yes(F.exists(value, lambda x: ~yes(x.isin(list(self.arg)))))
        raise ValueError(f"unknown rule {self.kind}")


# Allowed sets of both contracts.
DOMAINS = ["human", "animal", "wildlife", "vector", "environment", "genomic", "food", "amr", "mobility"]
SIGNAL_TYPES = [
    "case_report", "cluster", "outbreak", "pathogen_detection", "animal_event", "wildlife_event", "vector_event", "environmental_signal",
    "genomic_observation", "mortality_event", "transmission_observation", "laboratory_investigation", "laboratory_result", "official_alert",
    "intervention", "travel_or_mobility", "other",
]
CLAIM_KINDS = [
    "syndromic_cluster", "outbreak_update", "case_status", "death_count", "diagnostic_result", "laboratory_investigation", "genomic_finding",
    "transmission_statement", "surveillance_baseline", "wildlife_sampling", "wildlife_presence_absence", "mobility", "historical_context",
    "intervention", "official_action",
]
POLARITIES = ["positive", "negative", "uncertain", "not_applicable"]
SUBJECT_TYPES = ["human", "animal", "wildlife", "vector", "environment", "pathogen", "population", "mobility", "other"]
HOST_TYPES = ["human", "domestic_animal", "wildlife", "vector", "other"]
NORMALIZATIONS = ["resolved", "ambiguous", "unresolved"]
LOCATION_PRECISIONS = ["country", "admin1", "admin2", "locality", "point", "region", "unknown"]
LOCATION_ROLES = [
    "event_location", "current_location", "possible_exposure_location", "travel_history", "sampling_location", "reporting_jurisdiction",
    "laboratory_location", "testing_location", "unknown",
]
DATE_PRECISIONS = ["day", "month", "year", "unknown"]
PERIOD_TYPES = ["surveillance_period", "historical_period", "season", "observation_window", "unknown"]
TRANSMISSIONS = ["confirmed", "probable", "suspected", "refuted", "unknown"]
GENOMIC_RESULTS = ["positive", "negative", "indeterminate", "not_applicable", "unknown"]
DIAGNOSTIC_RESULTS = ["positive", "negative", "indeterminate", "pending", "not_applicable", "unknown"]
COUNTRY_CODE = "^[A-Z]{2}$"
YEARS, MONTHS, UNIT = (1900, 2100), (1, 12), (0, 1)


def _needed(path: str, kind: str, arg: object) -> list[Rule]:
    """A value that must be there and in range or in a set."""
    return [Rule(path, "required"), Rule(path, kind, arg)]


def _shared_rules() -> list[Rule]:
    """What signals and claims have in common."""
    rules = [
        Rule("domains", "min_items", 1), Rule("domains", "unique"), Rule("domains[]", "enum", DOMAINS),
        *_needed("verification_status", "enum", VERIFICATION), *_needed("diagnostics.result", "enum", DIAGNOSTIC_RESULTS),
        *_needed("genomics.test_result", "enum", GENOMIC_RESULTS), *_needed("reference_period.period_type", "enum", PERIOD_TYPES),
        Rule("diagnostics.test_reported", "required"), Rule("genomics.sequence_reported", "required"),
        Rule("event_date.start", "date"), Rule("event_date.end", "date"), Rule("event_date.precision", "required"),
        Rule("evidence", "min_items", 1), Rule("evidence[].type", "required"), Rule("evidence[].text", "filled"), Rule("evidence[].page_number", "min", 1),
        Rule("locations", "required"), *_needed("locations[].role", "enum", LOCATION_ROLES), *_needed("locations[].precision", "enum", LOCATION_PRECISIONS),
        *_needed("locations[].confidence", "range", UNIT), Rule("locations[].country_iso2", "pattern", COUNTRY_CODE),
    ]
    for end in ("start", "end"):
        point = f"reference_period.{end}"
        rules += [Rule(f"{point}.date", "date"), Rule(f"{point}.year", "range", YEARS), Rule(f"{point}.month", "range", MONTHS), *_needed(f"{point}.precision", "enum", DATE_PRECISIONS)]
    for way in ("human_to_human", "animal_to_human", "vector_borne"):
        rules += _needed(f"transmission.{way}", "enum", TRANSMISSIONS)
    return rules


def _metric_rules(path: str) -> list[Rule]:
    return [
        Rule(f"{path}.as_of_date", "date"), Rule(f"{path}.as_of_year", "range", YEARS), Rule(f"{path}.as_of_month", "range", MONTHS),
        *_needed(f"{path}.as_of_precision", "enum", DATE_PRECISIONS),
    ]


#: The signal contract, on the columns of one signal per row.
SIGNAL_CONTRACT = [
    *_shared_rules(), Rule("local_signal_id", "filled"), Rule("signal_summary", "filled"), *_needed("signal_role", "enum", SIGNAL_ROLES),
    *_needed("signal_type", "enum", SIGNAL_TYPES), *_needed("extraction_confidence", "range", UNIT),
    *[r for e in ("disease", "pathogen") for r in _needed(f"{e}.normalization_status", "enum", NORMALIZATIONS) + _needed(f"{e}.confidence", "range", UNIT)],
    Rule("hosts", "required"), *_needed("hosts[].host_type", "enum", HOST_TYPES), *_needed("hosts[].confidence", "range", UNIT),
    Rule("metrics", "required"), Rule("metrics[].name", "required"), *_metric_rules("metrics[]"),
]
#: The claim contract, on the columns of one claim per row.
CLAIM_CONTRACT = [
    *_shared_rules(), Rule("claim_id", "filled"), Rule("group_id", "filled"), Rule("summary", "filled"), *_needed("claim_kind", "enum", CLAIM_KINDS),
    *_needed("polarity", "enum", POLARITIES), *_needed("confidence", "range", UNIT), *_needed("subject.subject_type", "enum", SUBJECT_TYPES),
    *_needed("subject.confidence", "range", UNIT), Rule("metric.reported", "required"), *_metric_rules("metric"),
]
#: The head of a payload of each kind.
DOCUMENT_CONTRACT = {
    "signals": [Rule("schema_version", "enum", ["0.4"]), Rule("document.raw_item_id", "uuid"), Rule("document.document_date", "date"), Rule("signals", "required"), Rule("warnings", "required")],
    "claims": [Rule("schema_version", "enum", ["claims-0.1"]), Rule("document.raw_item_id", "filled"), Rule("document.document_date", "date"), Rule("claims", "required"), Rule("warnings", "required")],
}


def contract_check(payloads: DataFrame, key: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """Every broken rule as a row ``(key, position, path, rule)``; positions follow the paths."""
    ordered = sorted(rules, key=lambda r: r.path)
    broken = F.array_compact(F.array(*[F.when(r.broken(), F.struct(F.lit(r.path).alias("path"), F.lit(r.kind).alias("rule"))) for r in ordered]))
    return payloads.select(*key, F.posexplode(broken).alias("position", "f")).select(*key, "position", "f.path", "f.rule")


def first_failures(failures: DataFrame, key: Sequence[str], shown: int = 10) -> DataFrame:
    """A display view: the first failures of each row and how many more there are; ``failures`` keeps them all."""
    listed = failures.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("position", "path", "rule"))).alias("all"))
    return listed.select(*key, F.slice("all", 1, shown).alias("failures"), F.greatest(F.size("all") - shown, F.lit(0)).alias("more"))


def _unfinite(c: Column, dtype: T.DataType) -> Column | None:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return yes(F.isnan(c) | (F.abs(c) == float("inf")))
    if isinstance(dtype, T.StructType):
        parts = [p for p in (_unfinite(c[f.name], f.dataType) for f in dtype.fields) if p is not None]
        if not parts:
            return None
        found = parts[0]
        for part in parts[1:]:
            found = found | part
        return found
    if isinstance(dtype, T.ArrayType) and _unfinite(F.lit(None), dtype.elementType) is not None:
        return yes(F.exists(c, lambda x: _unfinite(x, dtype.elementType)))
    return None


def unfinite_numbers(df: DataFrame) -> Column:
    """True where any number of the row, at any depth, is NaN or infinite."""
    found = F.lit(False)
    for f in df.schema.fields:
        part = _unfinite(F.col(f.name), f.dataType)
        if part is not None:
            found = found | part
    return found


def unique_ids(children: DataFrame, doc: str, id_col: str) -> DataFrame:
    """Blank or repeated ids per document."""
    counted = children.groupBy(doc, id_col).agg(F.count("*").alias("n"))
    blank = strip_text(F.coalesce(id_col, F.lit(""))) == ""
    return counted.filter(blank | (F.col("n") > 1)).withColumn("reason", F.when(blank, "blank").otherwise("repeated"))


def token_usage(runs: DataFrame) -> DataFrame:
    """Typed counters per run: null means unreported, negatives are rejected, all-null is no usage."""
    reported, negative = F.lit(False), F.lit(False)
    for name in TOKEN_COUNTERS:
        reported = reported | F.col(name).isNotNull()
        negative = negative | yes(F.col(name) < 0)
    return runs.withColumns({"usage_reported": reported, "usage_valid": ~negative})


def pair_contract(pairs: DataFrame) -> DataFrame:
    """Broken rules of an adjudicated pair table."""
    eligible = F.col("expected_gate") == "eligible"
    conflict, merge = yes(F.col("expected_hard_conflict")), yes(F.col("expected_merge_allowed"))
    decision, relation = F.col("expected_decision"), F.col("expected_relation")
    rules = {
        "blank_id": strip_text(F.coalesce("pair_id", F.lit(""))) == "",
        "self_pair": F.col("source_id") == F.col("target_id"),
        "invalid_gate": ~yes(F.col("expected_gate").isin(PAIR_GATES)),
        "flags_required": F.col("expected_merge_allowed").isNull() | F.col("expected_hard_conflict").isNull(),
        "ineligible_with_outcome": (F.col("expected_gate") == "ineligible") & (relation.isNotNull() | decision.isNotNull() | merge | conflict),
        "invalid_relation": eligible & ~yes(relation.isin(PAIR_RELATIONS)),
        "invalid_decision": eligible & ~yes(decision.isin(PAIR_DECISIONS)),
        "conflict_without_reason": conflict & (F.coalesce("expected_hard_conflict_reason", F.lit("")) == ""),
        "conflict_not_rejected": eligible & conflict & (merge | ~yes(decision == "rejected")),
        "auto_link_not_mergeable": eligible & yes(decision == "auto_linked") & ~merge,
        "rejected_mergeable": eligible & yes(decision == "rejected") & merge,
    }
    broken = F.array_compact(F.array(*[F.when(yes(test), F.lit(name)) for name, test in rules.items()]))
    row_rules = pairs.select("pair_id", F.explode(broken).alias("reason"))
    repeated = pairs.groupBy("pair_id").count().filter("count > 1").select("pair_id", F.lit("repeated_id").alias("reason"))
    return row_rules.unionByName(repeated)


def audit_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row; grouping treats nulls as equal."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def audit_foreign_keys(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    p = parent.select(F.col(parent_key or key).alias(key))
    return child.filter(F.col(key).isNotNull()).join(p, key, "left_anti")


def audit_checks(df: DataFrame, key: str, checks: Mapping[str, Column]) -> DataFrame:
    """``(key, check)`` for every row check that is false, in one pass over the table."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in checks.items()]))
    return df.select(key, F.explode(failed).alias("check_name"))


def run_checks() -> dict[str, Column]:
    """Row checks of the extraction-run table."""
    return {
        "status_allowed": F.col("status").isin("succeeded", "failed"),
        "succeeded_has_output": (F.col("status") != "succeeded") | F.col("output_json").isNotNull(),
        "failed_has_error": (F.col("status") != "failed") | F.col("error_text").isNotNull(),
        **{n + "_not_negative": F.col(n) >= 0 for n in TOKEN_COUNTERS},
    }


# Allowed sets of the stored tables.
REVIEW_STATUSES = ["pending", "in_review", "reviewed", "rejected"]
MATCH_DECISIONS = ["auto_linked", "review_required", "rejected", "manual_linked", "manual_unlinked"]
LIFECYCLES = ["active", "monitoring", "resolved", "closed"]
PRIORITIES = ["P1", "P2", "P3", "P4"]
OPERATIONS = ["candidate_promotion", "legacy_adoption"]
SHA256_PATTERN = "^[0-9a-f]{64}$"


def _within(name: str, allowed: Sequence[str]) -> dict[str, Column]:
    return {name + "_allowed": F.col(name).isin(list(allowed))}


def _unit(*names: str) -> dict[str, Column]:
    return {n + "_in_unit": F.col(n).between(0, 1) for n in names}


def _ordered(low: str, high: str) -> Column:
    return F.col(high) >= F.col(low)


def table_checks(table: str) -> dict[str, Column]:
    """Row checks of a stored table by name; a check over a null is not broken unless it asks for a value.

    Every table's checks are evaluated in one pass by ``audit_checks``.
    """
    catalogue = {
        "runs": run_checks,
        "signals": lambda: {
            "version_positive": F.col("version") > 0, "dates_ordered": _ordered("occurred_start", "occurred_end"),
            "confidence_given": F.col("extraction_confidence").isNotNull(), **_unit("extraction_confidence"),
            **_within("signal_role", SIGNAL_ROLES), **_within("signal_type", SIGNAL_TYPES), **_within("verification_status", VERIFICATION),
            "domains_allowed": F.forall("domains", lambda d: yes(d.isin(DOMAINS))),
        },
        "signal_metrics": lambda: {"has_value": F.col("value_numeric").isNotNull() | F.col("value_text").isNotNull()},
        "signal_evidence": lambda: {"page_positive": F.col("page_number") > 0, "chars_ordered": _ordered("char_start", "char_end")},
        "signal_locations": lambda: {**_unit("confidence"), **_within("precision", LOCATION_PRECISIONS)},
        "signal_hosts": lambda: {**_unit("confidence"), **_within("host_type", HOST_TYPES)},
        "signal_relations": lambda: {
            "not_self": F.col("source_id") != F.col("target_id"), **_unit("score"), **_within("relation", PAIR_RELATIONS), **_within("decision", MATCH_DECISIONS),
        },
        "event_signals": lambda: {**_unit("match_score"), **_within("match_decision", MATCH_DECISIONS)},
        "events": lambda: {**_within("lifecycle_status", LIFECYCLES), **_within("priority", PRIORITIES), **_within("review_status", REVIEW_STATUSES)},
        "snapshot_heads": lambda: {"revision_positive": F.col("revision") > 0, "run_given": F.col("run_id").isNotNull()},
        "snapshot_promotions": lambda: {
            "revision_positive": F.col("revision") > 0, "actor_given": strip_text(F.coalesce("actor", F.lit(""))) != "",
            "reason_given": strip_text(F.coalesce("reason", F.lit(""))) != "", **_within("operation", OPERATIONS),
            "adoption_has_state": F.when(F.col("operation") == "legacy_adoption", yes(F.col("baseline_state_sha256").rlike(SHA256_PATTERN)))
            .otherwise(F.col("baseline_state_sha256").isNull()),
        },
    }
    return catalogue[table]()
