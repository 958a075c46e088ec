"""Nested signals, claims and gold documents assembled from the flat derived views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sentinelweave.operators.hydrate import collect_children, hydrate_signals
from sentinelweave.plans.views import VIEWS, remembered, run_sql, view


def signal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat signal rows with the struct columns a hydrated signal needs."""
    s = view(spark, sf_dir, "sig_eligible")
    null = F.lit(None).cast("string")
    year = F.col("period_year").cast("int")

    def point(y):
        return F.struct(
            null.alias("date"), y.alias("year"), F.lit(None).cast("int").alias("month"),
            F.when(y.isNull(), "unknown").otherwise("year").alias("precision"), null.alias("verbatim"),
        )

    def entity(name, id_col):
        return F.struct(
            null.alias("verbatim"), F.col(name).alias("canonical_name"),
            F.when(F.col(id_col).isNull(), "unresolved").otherwise("resolved").alias("normalization_status"),
            F.lit(0.8).alias("confidence"),
        )

    return s.select(
        "signal_id", "n", "raw_item_id", "local_signal_key", "version", "is_current", "event_matching_eligible",
        "signal_role", "signal_type", "verification_status", "signal_summary", "disease_id", "pathogen_id",
        "occurred_start", "created_at",
        F.array_compact(F.array("domain_a", "domain_b")).alias("domains"),
        entity("disease_name", "disease_id").alias("disease"),
        entity("pathogen_name", "pathogen_id").alias("pathogen"),
        F.struct(
            F.col("occurred_start").cast("string").alias("start"), F.col("occurred_end").cast("string").alias("end"),
            F.when(F.col("occurred_start").isNull(), "unknown").otherwise("day").alias("precision"),
        ).alias("event_date"),
        F.struct(
            point(year).alias("start"), point(F.lit(None).cast("int")).alias("end"),
            F.when(year.isNull(), "unknown").otherwise("season").alias("period_type"), null.alias("verbatim"),
        ).alias("reference_period"),
        F.struct("human_to_human", "animal_to_human", "vector_borne").alias("transmission"),
        F.struct(
            F.col("test_result").isNotNull().alias("test_reported"), null.alias("test_type"), null.alias("method"),
            null.alias("target"), null.alias("specimen"), F.col("test_result").alias("result"),
        ).alias("diagnostics"),
        F.struct(
            F.col("sequence_reported"), null.alias("lineage"), null.alias("clade"), null.alias("accession"),
            F.lit("unknown").alias("test_result"),
        ).alias("genomics"),
    )


def nested_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals with ordered arrays of locations, hosts, metrics and evidence."""
    return remembered(spark, sf_dir, "nested_signals", lambda: _nested_signals(spark, sf_dir))


def _nested_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = F.lit(None).cast("string")
    loc = view(spark, sf_dir, "sig_loc").select(
        "signal_id", "seq", "country", "country_iso2", "admin1", "admin2", "locality", null.alias("region"),
        F.col("prec").alias("precision"), F.col("confidence").cast("double").alias("confidence"), "role",
    )
    host = view(spark, sf_dir, "sig_host").select(
        "signal_id", "seq", "verbatim", "canonical_name", "host_type", F.col("confidence").cast("double").alias("confidence")
    )
    metric = view(spark, sf_dir, "sig_metric").select(
        "signal_id", "seq", "name", "value_numeric", "value_text", "unit", "as_of_date"
    )
    evidence = view(spark, sf_dir, "sig_evidence").select(
        "signal_id", "seq", "type", "text", null.alias("location_in_document"), "page_number"
    )
    return hydrate_signals(
        signal_rows(spark, sf_dir),
        locations=collect_children(loc, "signal_id", ["seq"], "locations"),
        hosts=collect_children(host, "signal_id", ["seq"], "hosts"),
        metrics=collect_children(metric, "signal_id", ["seq"], "metrics"),
        evidence=collect_children(evidence, "signal_id", ["seq"], "evidence"),
    )


#: Lines that one task nests. Their shuffled bytes say little about the nested rows, which windows and folds sort, so Spark
#: must not choose the number of tasks by them; it follows the lines instead.
LINES_PER_TASK = 50_000


def _dealt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines, dealt out by document into tasks of bounded size; counting reads Parquet footers only."""
    tasks = max(spark.sparkContext.defaultParallelism, -(-view(spark, sf_dir, "lineitem").count() // LINES_PER_TASK))
    return view(spark, sf_dir, "line").repartition(tasks, "doc")


def _dealt_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of the lines whose documents are dealt out as narrow lines.

    Rows are nested where their documents lie, so no step keyed by document moves nested rows.
    """
    line = remembered(spark, sf_dir, "dealt_line", lambda: _dealt_lines(spark, sf_dir))
    given = {"line": line} if name != "pred" else {"gold": _dealt_view(spark, sf_dir, "gold")}
    return run_sql(spark, sf_dir, VIEWS[name], given)


def nested_claims(spark: SparkSession, sf_dir: str, *beside: str) -> DataFrame:
    """One nested claim per row, in contract shape, with the columns ``beside`` of its flat row."""
    return remembered(spark, sf_dir, "nested_claims" + "".join("," + n for n in beside), lambda: _nested_claims(spark, sf_dir, beside))


def _nested_claims(spark: SparkSession, sf_dir: str, beside: tuple[str, ...]) -> DataFrame:
    v = _dealt_view(spark, sf_dir, "clm")
    null, none = F.lit(None).cast("string"), F.lit(None).cast("int")

    def place(role, locality, admin1):
        return F.struct(
            F.lit("Argentina").alias("country"), F.col("loc_iso2").alias("country_iso2"), admin1.alias("admin1"), null.alias("admin2"),
            locality.alias("locality"), null.alias("region"), F.lit("locality").alias("precision"), F.lit(0.8).alias("confidence"), role.alias("role"),
        )

    def point(year):
        year = year.cast("int")
        return F.struct(
            null.alias("date"), year.alias("year"), none.alias("month"), F.when(year.isNull(), "unknown").otherwise("year").alias("precision"), null.alias("verbatim")
        )

    def quote(kind, text):
        return F.struct(kind.alias("type"), text.alias("text"), null.alias("location_in_document"), none.alias("page_number"))

    second_place = F.when(F.col("loc2_role").isNotNull(), place(F.col("loc2_role"), F.concat(F.lit("Town "), (F.col("sk") % 5).cast("string")), null))
    second_quote = F.when(F.col("evidence2_text").isNotNull(), quote(F.lit("text"), F.col("evidence2_text")))
    return v.select(
        "doc", F.col("ord").cast("double").alias("ord"), "claim_id", "group_id", "claim_kind", "polarity",
        F.array_compact(F.array("domain_a", "domain_b")).alias("domains"), "disease_verbatim", "pathogen_verbatim",
        F.struct(F.col("subject_verbatim").alias("verbatim"), F.col("subject_name").alias("canonical_name"), "subject_type", F.lit(0.7).alias("confidence")).alias("subject"),
        F.array_compact(F.array(place(F.col("loc_role"), F.col("loc_locality"), F.col("loc_admin1")), second_place)).alias("locations"),
        F.struct(F.col("event_start").alias("start"), null.alias("end"), F.col("event_precision").alias("precision")).alias("event_date"),
        F.struct(point(F.col("period_from")).alias("start"), point(F.col("period_to")).alias("end"), "period_type", F.col("period_verbatim").alias("verbatim")).alias("reference_period"),
        F.struct(
            F.col("metric_reported").alias("reported"), F.col("metric_name").alias("name"), F.col("metric_value").alias("value_numeric"), null.alias("value_text"),
            F.when(F.col("metric_reported"), "persons").alias("unit"), F.col("metric_date").alias("as_of_date"), none.alias("as_of_year"), none.alias("as_of_month"),
            F.lit("unknown").alias("as_of_precision"), null.alias("as_of_verbatim"),
        ).alias("metric"),
        F.struct(
            "test_reported", null.alias("test_type"), null.alias("method"), F.col("test_target").alias("target"), null.alias("specimen"), F.col("test_result").alias("result")
        ).alias("diagnostics"),
        F.struct(
            F.col("sequenced").alias("sequence_reported"), "lineage", null.alias("clade"), null.alias("accession"), F.lit("not_applicable").alias("test_result")
        ).alias("genomics"),
        F.struct("human_to_human", "animal_to_human", F.lit("unknown").alias("vector_borne")).alias("transmission"),
        "verification_status", "summary",
        F.array_compact(F.array(quote(F.col("evidence_type"), F.col("evidence_text")), second_quote)).alias("evidence"),
        F.col("confidence").cast("double").alias("confidence"), *beside,
    )


def nested_reference(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Adjudicated (``gold``) or predicted (``pred``) signals in contract shape."""
    return remembered(spark, sf_dir, "nested_" + name, lambda: _nested_reference(_dealt_view(spark, sf_dir, name)))


def _nested_reference(v: DataFrame) -> DataFrame:
    null, none = F.lit(None).cast("string"), F.lit(None).cast("int")
    point = F.struct(null.alias("date"), none.alias("year"), none.alias("month"), F.lit("unknown").alias("precision"), null.alias("verbatim"))
    entity = lambda name, verbatim: F.struct(
        verbatim.alias("verbatim"), name.alias("canonical_name"), F.when(name.isNull(), "unresolved").otherwise("resolved").alias("normalization_status"), F.lit(0.5).alias("confidence")
    )
    metric = F.struct(
        F.col("metric_name").alias("name"), F.col("metric_value").alias("value_numeric"), null.alias("value_text"), F.col("metric_unit").alias("unit"),
        null.alias("as_of_date"), F.col("metric_year").alias("as_of_year"), none.alias("as_of_month"), F.lit("unknown").alias("as_of_precision"), null.alias("as_of_verbatim"),
    )
    place = F.struct(
        null.alias("country"), F.lit("AR").alias("country_iso2"), "admin1", null.alias("admin2"), null.alias("locality"), null.alias("region"),
        F.lit("admin1").alias("precision"), F.lit(0.5).alias("confidence"), F.col("loc_role").alias("role"),
    )
    return v.select(
        "doc", "idx", "local_signal_id", "signal_role", "signal_type", F.array_compact(F.array("domain_a", "domain_b")).alias("domains"),
        entity(F.col("disease_name"), F.col("disease_verbatim")).alias("disease"), entity(null, F.col("pathogen_verbatim")).alias("pathogen"),
        F.array(F.struct(null.alias("verbatim"), F.col("host_name").alias("canonical_name"), "host_type", F.lit(0.5).alias("confidence"))).alias("hosts"),
        F.array(place).alias("locations"), F.array_compact(F.array(F.when(F.col("metric_name").isNotNull(), metric))).alias("metrics"),
        F.struct(F.col("event_start").alias("start"), null.alias("end"), F.lit("day").alias("precision")).alias("event_date"),
        F.struct(point.alias("start"), point.alias("end"), "period_type", null.alias("verbatim")).alias("reference_period"),
        F.struct(F.lit(True).alias("test_reported"), null.alias("test_type"), null.alias("method"), null.alias("target"), null.alias("specimen"), F.col("test_result").alias("result")).alias("diagnostics"),
        F.array(F.struct(F.col("evidence_type").alias("type"), F.col("evidence_text").alias("text"), null.alias("location_in_document"), none.alias("page_number"))).alias("evidence"),
        F.concat(F.lit("summary "), "local_signal_id").alias("signal_summary"),
    )
