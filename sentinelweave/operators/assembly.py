"""Claims to signals: group-level rewrites, then one fold per bucket.

Claims are rows ``(doc, ord, …)``; ``ord`` is the position in the document and every
"first", "last" or numbered result follows it.  Group rewrites are windows over
(doc, group), the fold is one aggregation over (doc, bucket).  Both are bounded by the
number of claims of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from sentinelweave.functions.dates import partial_date
from sentinelweave.functions.identity import normalize_entity, resolve_explicit_pathogen, row_sha256
from sentinelweave.functions.sets import distinct_by
from sentinelweave.functions.text import TEXT_LABELS_V046, casefold, squash, strip_text
from sentinelweave.operators import validation as V
from sentinelweave.operators.gates import (
    biological_hosts, claim_text, contains_any, evidence_text, facility_inventory, generic_investigation, host_label, negative_history,
    operational_signal, training_intervention, yes,
)
from sentinelweave.session import materialised

# Vocabulary of the animal outbreak rules.
ANIMAL_BLOCKERS = r"(?U)\b(no|not|sin|posible|possible|sospech\w*|presunt\w*|pasado|historical)\b"
ANIMAL_OUTBREAK = r"(?U)\b(confirmó|confirmaron|confirmed)\b.{0,40}\b(brote|outbreak)\b"
ANIMAL_POPULATION = (
    r"(?U)\b(aves|cerdos|bovinos|ovinos|caprinos|equinos|animales|rebaño|piara|parvada|poultry|livestock|cattle|pigs|birds|herd|flock)\b"
)
ASIDE_PLACE = r"(?U)\b(en|in|localidad|located|ubicad\w*|situad\w*)\b"
POSITIVE_CASE = r"(?U)\b(confirmó|detectó|confirmed|detected)\b.{0,60}\b(caso positivo|positive case)\b"
FACILITY = (
    r"(?U)\b(un predio|un establecimiento|una granja|a farm|an establishment)\b"
    r"(?:\s+(?:multiespecie|avícola|comercial|rural)){0,2}\s+(?:(?:ubicado|ubicada|situado|situada|located)\s+)?"
    r"(?:(?:en\s+)?(?:la\s+)?localidad\s+de\s+|(?:de|en|in)\s+)"
)
LAB_CONFIRMATION = r"(?U)\b(confirmó el resultado|confirmed the result)\b"
LAB_BLOCKERS = r"(?U)\b(no|not|sin|posible|possible)\b"
# Vocabulary of the two-site rule.
SITE_SUBJECTS = ["aves", "aves de corral", "aves de traspatio", "cerdos", "bovinos", "ovinos", "caprinos"]
SITE_BLOCKERS = r"(?U)\b(no|not|sin|posible|sospech\w*|presunt\w*|pasado)\b"
SITE_HEAD = r"(?U)\b(confirmó|confirmaron|detectó|detectaron) (dos )?casos positivos\b[^.!?]*?\ben "
SITE_MIDDLE = r" de dos (predios|establecimientos|granjas)\s*,?\s*uno en "
# Wording of collective subjects, institutions, scopes and genomic findings.
COLLECTIVE = ["los casos", "casos ", "pacientes", "personas", "muestras", "confirmados"]
INSTITUTIONS = [
    "personal del", "equipo del", "equipos técnicos", "equipos tecnicos", "ministerio", "anlis", "instituto", "laboratorio",
]
REGIONS = [
    ("noa", "region:noa"), ("nea", "region:nea"), ("cuyo", "region:cuyo"), ("patagonia", "region:patagonia"),
    ("región centro", "region:centro"), ("region centro", "region:centro"),
]
NATIONAL = ["a nivel nacional", "nivel nacional", "vigilancia nacional", "total de casos de toda la temporada", "argentina"]
NOVEL_VARIANT = "variante viral no descripta previamente"
HUMAN_CONTEXT = ["human", "brote", "casos"]
DIFFERENCE = ["diferente", "no relacionada", "no relacionado", "sin relación", "sin relacion"]
SUBNATIONAL = r"^(region|admin1|admin2|locality):"
# Claim kinds that share buckets, and the signal type of each remaining kind.
OUTBREAK_KINDS = ["outbreak_update", "case_status", "death_count"]
WILDLIFE_KINDS = ["wildlife_sampling", "wildlife_presence_absence"]
PLAIN_TYPES = {
    "syndromic_cluster": "cluster", "outbreak": "outbreak", "baseline": "case_report", "diagnostic_result": "laboratory_result",
    "laboratory_investigation": "laboratory_investigation", "genomic_finding": "genomic_observation",
    "transmission_statement": "transmission_observation", "wildlife_negative": "wildlife_event", "wildlife_sampling": "wildlife_event",
    "wildlife_presence_absence": "wildlife_event", "mobility": "travel_or_mobility", "historical_context": "case_report",
    "intervention": "intervention", "official_action": "official_alert", "case_status": "case_report", "death_count": "mortality_event",
}
NEGATABLE = ["diagnostic_result", "transmission_statement", "wildlife_presence_absence", "case_status"]
VERIFICATION_RANK = {"confirmed": 6, "probable": 5, "suspected": 4, "reported": 3, "unknown": 2, "refuted": 1}
PRECISION_RANK = {"day": 3, "month": 2, "year": 1}
METRIC_KEY = ("name", "value_numeric", "value_text", "unit", "as_of_date", "as_of_year", "as_of_month", "as_of_precision", "as_of_verbatim")
LOCATION_KEY = ("country", "country_iso2", "admin1", "admin2", "locality", "region", "role")

c = F.col


def group_key() -> Column:
    return F.coalesce(F.nullif(c("group_id"), F.lit("")), F.nullif(c("claim_id"), F.lit("")), F.lit("?"))


def in_group() -> Window:
    return Window.partitionBy("doc", group_key())


def folded(value: Column) -> Column:
    return casefold(F.nullif(strip_text(value), F.lit("")))


def filled(value: Column) -> Column:
    """A present, non-empty string."""
    return yes(value != "")


def _note(condition: Column, code: str) -> Column:
    return F.when(condition, F.concat(c("notes"), F.array(F.lit(code)))).otherwise(c("notes"))


def quote_meta(value: Column) -> Column:
    """Literal pattern for a value (an end-of-quote mark inside it is split out)."""
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def with_notes(claims: DataFrame) -> DataFrame:
    return claims if "notes" in claims.columns else claims.withColumn("notes", F.array().cast("array<string>"))


def split_multisite(claims: DataFrame) -> DataFrame:
    """Two-site animal detections become two outbreak claims; unclear ones get a note."""
    claims = with_notes(claims).withColumn("ord", c("ord").cast("double"))
    doc = Window.partitionBy("doc")
    localities = F.filter(F.transform("locations", lambda x: casefold(F.coalesce(x["locality"], F.lit("")))), lambda x: x != "")
    several = yes(
        (c("claim_kind") == "diagnostic_result") & (c("subject.subject_type") == "animal") & (F.size(F.array_distinct(localities)) >= 2)
    )
    a, b = F.get("locations", F.lit(0)), F.get("locations", F.lit(1))
    same = a["country_iso2"].isNotNull() & (a["country_iso2"] != "")
    for name in ("country", "country_iso2", "admin1", "admin2", "region"):
        same = same & a[name].eqNullSafe(b[name])
    events = F.forall("locations", lambda x: yes(x["role"] == "event_location") & filled(x["locality"]))
    m, d, g, p = c("metric"), c("diagnostics"), c("genomics"), c("reference_period")
    empty_metric = ~yes(m["reported"]) & yes(m["as_of_precision"] == "unknown")
    for name in ("name", "value_numeric", "value_text", "unit", "as_of_date", "as_of_year", "as_of_month", "as_of_verbatim"):
        empty_metric = empty_metric & m[name].isNull()
    undated = ~filled(c("event_date.start")) & ~filled(c("event_date.end")) & yes(c("event_date.precision") == "unknown")
    undated = undated & yes(p["period_type"] == "unknown") & ~filled(p["verbatim"])
    for end in ("start", "end"):
        point = p[end]
        undated = undated & yes(point["precision"] == "unknown")
        for name in ("date", "year", "month", "verbatim"):
            undated = undated & point[name].isNull()
    plain = yes(d["result"] == "positive") & ~yes(d["test_reported"]) & ~yes(g["sequence_reported"])
    for name in ("method", "target", "test_type", "specimen"):
        plain = plain & d[name].isNull()
    for name in ("lineage", "clade", "accession"):
        plain = plain & g[name].isNull()
    plain = plain & yes(g["test_result"].isin("unknown", "not_applicable"))
    for name in ("human_to_human", "animal_to_human", "vector_borne"):
        plain = plain & yes(F.coalesce(c("transmission")[name], F.lit("unknown")) == "unknown")
    subject = casefold(squash(F.coalesce(c("subject.verbatim"), F.lit(""))))
    described = yes(subject.isin(SITE_SUBJECTS)) & c("subject.canonical_name").isNull()

    def stated(first: Column, second: Column) -> Column:
        pattern = F.concat(
            F.lit(SITE_HEAD), quote_meta(subject), F.lit(SITE_MIDDLE), quote_meta(casefold(first["locality"])), F.lit(" y otro en "),
            quote_meta(casefold(second["locality"])), F.lit(r"(?=\s*(?:[.!?]|$))"),
        )
        texts = F.transform("evidence", lambda e: casefold(squash(F.coalesce(e["text"], F.lit("")))))
        return F.exists(texts, lambda t: ~t.rlike(SITE_BLOCKERS) & F.regexp_like(t, pattern))

    safe = (
        (c("__size") == 1) & (F.size("locations") == 2) & events & same & yes(c("domains") == F.array(F.lit("animal")))
        & yes(c("polarity") == "positive") & yes(c("verification_status") == "confirmed") & described & empty_metric & undated & plain
    )
    marked = claims.withColumns({"__size": F.count("*").over(in_group()), "__several": several})
    marked = marked.withColumn("__safe", F.when(c("__several"), yes(safe & (stated(a, b) | stated(b, a)))).otherwise(F.lit(False)))
    child = [F.concat(c("claim_id"), F.lit(f":site:{i}")) for i in (1, 2)]
    group = [F.concat(group_key(), F.lit(f":site:{i}")) for i in (1, 2)]
    # Ids already in use matter only in documents that have something to split.
    marked = marked.withColumn("__open", F.bool_or("__safe").over(doc))
    marked = marked.withColumn("__used", F.flatten(F.collect_list(F.when(c("__open"), F.array("claim_id", "group_id"))).over(doc)))
    clash = F.arrays_overlap(c("__used"), F.array(*child, *group))
    marked = marked.withColumn("__split", c("__safe") & ~yes(clash))
    marked = marked.withColumn(
        "notes",
        F.when(c("__split"), F.concat(c("notes"), F.array(F.lit("ASM-MULTISITE-01"))))
        .when(c("__several"), F.concat(c("notes"), F.array(F.lit("ASM-MULTISITE-REVIEW"))))
        .otherwise(c("notes")),
    )
    sites = F.when(c("__split"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    rows = marked.withColumn("__site", F.explode(sites))
    site = c("__site")
    place = F.get("locations", site - 1)
    rows = rows.withColumns(
        {
            "claim_id": F.when(site > 0, F.concat(c("claim_id"), F.lit(":site:"), site.cast("string"))).otherwise(c("claim_id")),
            "group_id": F.when(site > 0, F.concat(group_key(), F.lit(":site:"), site.cast("string"))).otherwise(c("group_id")),
            "claim_kind": F.when(site > 0, "outbreak_update").otherwise(c("claim_kind")),
            "summary": F.when(
                site > 0,
                F.concat(F.lit("Detección focal confirmada en "), c("subject.verbatim"), F.lit(", "), place["locality"], F.lit(".")),
            ).otherwise(c("summary")),
            "ord": c("ord") + F.when(site == 2, 0.5).otherwise(0.0),
            "locations": F.when(site > 0, F.array(place)).otherwise(c("locations")),
        }
    )
    return rows.select(*claims.columns)


def _event_places(locations: Column) -> Column:
    return F.filter(locations, lambda x: yes(x["role"] == "event_location"))


def _single_locality(locations: Column) -> Column:
    """All event locations name one and the same locality."""
    places = _event_places(locations)
    keys = F.transform(places, lambda x: F.struct(x["country_iso2"], x["admin1"], x["admin2"], x["locality"]))
    return yes((F.size(places) > 0) & F.forall(places, lambda x: filled(x["locality"])) & (F.size(F.array_distinct(keys)) == 1))


def promote_animal_outbreaks(claims: DataFrame) -> DataFrame:
    """Explicit confirmed animal detections become outbreak updates."""
    claims = with_notes(claims)
    text = evidence_text(c("evidence"))
    population = casefold(squash(F.coalesce(c("subject.verbatim"), F.lit(""))))
    locality = casefold(F.get(_event_places(c("locations")), F.lit(0))["locality"])
    site = F.concat(F.lit(FACILITY), quote_meta(locality), F.lit(r"(?=\s*(?:[,;]|$))"))

    def facility_clause(sentence: Column) -> Column:
        asides = F.regexp_extract_all(sentence, F.lit("—([^—]*)—"), F.lit(1))
        outside = squash(F.regexp_replace(sentence, "—[^—]*—", " "))
        return (
            ~F.exists(asides, lambda a: a.rlike(ASIDE_PLACE)) & F.contains(sentence, population)
            & sentence.rlike(POSITIVE_CASE) & F.regexp_like(outside, site)
        )

    facility = (
        yes(c("subject.subject_type") == "animal") & population.rlike(ANIMAL_POPULATION)
        & F.exists(F.split(text, "[.!?]"), facility_clause)
    )
    candidate = yes(
        (c("claim_kind") == "diagnostic_result") & (c("polarity") == "positive") & (c("verification_status") == "confirmed")
        & (c("diagnostics.result") == "positive") & ~yes(c("reference_period.period_type") == "historical_period")
        & c("subject.subject_type").isin("animal", "wildlife") & F.array_contains("domains", "animal")
    )
    explicit = F.when(
        candidate & _single_locality(c("locations")), yes(~text.rlike(ANIMAL_BLOCKERS) & (text.rlike(ANIMAL_OUTBREAK) | facility))
    ).otherwise(F.lit(False))
    marked = claims.withColumn("__hit", explicit)
    return marked.withColumns(
        {"claim_kind": F.when(c("__hit"), "outbreak_update").otherwise(c("claim_kind")), "notes": _note(c("__hit"), "ASM-ANIMAL-01")}
    ).drop("__hit")


def attach_lab_confirmation(claims: DataFrame) -> DataFrame:
    """The only animal outbreak of a group absorbs its laboratory confirmation."""
    claims = with_notes(claims)
    anchor = yes(
        (c("claim_kind") == "outbreak_update") & (c("subject.subject_type") == "animal") & (c("polarity") == "positive")
        & (c("verification_status") == "confirmed") & (c("diagnostics.result") == "positive")
    )
    marked = claims.withColumn("__anchor", anchor)
    facts = F.when(
        c("__anchor"),
        F.struct(
            c("event_date").alias("date"), folded(c("pathogen_verbatim")).alias("pathogen"), _single_locality(c("locations")).alias("placed")
        ),
    )
    marked = marked.withColumns({"__n": F.count_if("__anchor").over(in_group()), "__a": F.first(facts, ignorenulls=True).over(in_group())})
    text = evidence_text(c("evidence"))
    date_ok = F.lit(True)
    for name in ("start", "end"):
        date_ok = date_ok & (~filled(c("event_date")[name]) | c("event_date")[name].eqNullSafe(c("__a.date")[name]))
    hit = yes(
        (c("__n") == 1) & c("__a.placed") & (c("claim_kind") == "diagnostic_result") & (c("polarity") == "positive")
        & (c("verification_status") == "confirmed") & (c("subject.subject_type") == "other")
        & (folded(c("pathogen_verbatim")) == c("__a.pathogen")) & (c("diagnostics.result") == "positive")
        & yes(c("diagnostics.test_reported")) & ~yes(c("reference_period.period_type") == "historical_period")
        & ~yes(c("metric.reported")) & ~yes(c("genomics.sequence_reported")) & (F.size("locations") > 0)
        & F.forall("locations", lambda x: yes(x["role"] == "laboratory_location")) & date_ok
        & text.rlike(LAB_CONFIRMATION) & ~text.rlike(LAB_BLOCKERS)
    )
    marked = marked.withColumn("__hit", hit)
    return marked.withColumns(
        {"claim_kind": F.when(c("__hit"), "outbreak_update").otherwise(c("claim_kind")), "notes": _note(c("__hit"), "ASM-ANIMAL-02")}
    ).drop("__hit", "__anchor", "__n", "__a")


def collective_characterisation(claims: DataFrame) -> DataFrame:
    """A positive result about already known cases plus a genomic finding is one laboratory result."""
    person = F.coalesce(c("subject.verbatim"), F.lit(""))
    collective = yes(
        (c("claim_kind") == "diagnostic_result") & (c("diagnostics.result") == "positive") & (c("subject.subject_type") == "human")
    ) & contains_any(casefold(person), COLLECTIVE)
    genomic = yes(c("claim_kind") == "genomic_finding")
    marked = claims.withColumns({"__c": collective, "__g": genomic})
    marked = marked.withColumn("__both", F.bool_or("__c").over(in_group()) & F.bool_or("__g").over(in_group()))
    return marked.withColumns(
        {
            "subject": F.when(c("__both") & c("__c"), c("subject").withField("subject_type", F.lit("other"))).otherwise(c("subject")),
            "claim_kind": F.when(c("__both") & c("__g"), "diagnostic_result").otherwise(c("claim_kind")),
        }
    ).drop("__c", "__g", "__both")


def mobility_to_intervention(claims: DataFrame) -> DataFrame:
    """Institutional movements in a group with an intervention belong to it."""
    text = casefold(F.concat_ws(" ", F.coalesce(c("subject.verbatim"), F.lit("")), claim_text(c("summary"), c("evidence"))))
    has = F.bool_or(yes(c("claim_kind") == "intervention")).over(in_group())
    moved = yes(c("claim_kind") == "mobility") & has & contains_any(text, INSTITUTIONS)
    return claims.withColumn("claim_kind", F.when(moved, "intervention").otherwise(c("claim_kind")))


def _baseline_hints() -> dict[str, Column]:
    text = casefold(F.concat_ws(" ", F.coalesce(c("group_id"), F.lit("")), claim_text(c("summary"), c("evidence"))))

    def local(x: Column) -> Column:
        levels = [F.when(folded(x[n]).isNotNull(), F.concat(F.lit(n + ":"), folded(x[n]))) for n in ("locality", "admin2", "admin1", "region")]
        return F.coalesce(*levels)

    def country(x: Column) -> Column:
        return F.concat(F.lit("country:"), F.coalesce(folded(x["country_iso2"]), folded(x["country"])))

    def first(f) -> Column:
        return F.get(F.filter(F.transform("locations", f), lambda v: v.isNotNull()), F.lit(0))

    regional = F.coalesce(*[F.when(F.contains(text, F.lit(m)), F.lit(s)) for m, s in REGIONS])
    national = F.when(contains_any(text, NATIONAL), F.lit("country:ar"))
    return {
        "domains": F.array_sort(F.coalesce("domains", F.array().cast("array<string>"))),
        "disease": folded(c("disease_verbatim")),
        "pathogen": folded(c("pathogen_verbatim")),
        "topic": F.coalesce(
            folded(c("disease_verbatim")), folded(c("pathogen_verbatim")), F.when(F.contains(text, F.lit("hantavirus")), F.lit("hantavirus"))
        ),
        "scope": F.coalesce(first(local), regional, first(country), national),
    }


def _compatible(a: Column, b: Column) -> Column:
    agree = lambda n: a[n].isNull() | b[n].isNull() | (a[n] == b[n])
    local = yes(a["scope"].rlike(SUBNATIONAL)) | yes(b["scope"].rlike(SUBNATIONAL))
    scoped = F.when(local, yes(a["scope"] == b["scope"])).otherwise(agree("scope"))
    return (a["domains"] == b["domains"]) & agree("disease") & agree("pathogen") & yes(a["topic"] == b["topic"]) & scoped


def merge_surveillance_snapshots(claims: DataFrame) -> DataFrame:
    """Compatible current baselines of a document share the group of the first one.

    First fit against cluster heads, in order, folded over the baseline rows of the
    document.  A window by document keeps the rows where they already are.
    """
    baseline = yes(c("claim_kind") == "surveillance_baseline") & ~yes(c("reference_period.period_type") == "historical_period")
    hint = F.struct(c("ord"), group_key().alias("grp"), *[v.alias(k) for k, v in _baseline_hints().items()])
    marked = claims.withColumn("__b", F.when(baseline, hint))
    struct = marked.schema["__b"].dataType.simpleString()
    marked = marked.withColumn("__bs", F.array_sort(F.collect_list("__b").over(Window.partitionBy("doc"))))

    def step(acc: Column, b: Column) -> Column:
        head = F.get(F.filter(acc["heads"], lambda h: _compatible(h, b)), F.lit(0))
        placed = F.struct(b["ord"].alias("ord"), head["grp"].alias("grp"))
        return F.struct(
            F.when(head.isNull(), F.concat(acc["heads"], F.array(b))).otherwise(acc["heads"]).alias("heads"),
            F.concat(acc["placed"], F.array(placed)).alias("placed"),
        )

    start = F.struct(
        F.array().cast(f"array<{struct}>").alias("heads"), F.array().cast("array<struct<ord:double,grp:string>>").alias("placed")
    )
    mine = F.filter(F.aggregate("__bs", start, step)["placed"], lambda x: x["ord"] == c("ord"))
    joined = F.when(c("__b").isNotNull() & (F.size("__bs") > 1), F.get(mine, F.lit(0))["grp"])
    return marked.withColumn("group_id", F.coalesce(joined, c("group_id"))).select(*claims.columns)


def _drop_role(locations: Column, role: str) -> Column:
    return F.filter(locations, lambda x: ~yes(x["role"] == role))


def _implicit_case_metric(metric_type: str) -> Column:
    start, day = c("event_date.start"), yes(c("event_date.precision") == "day")
    return F.struct(
        F.lit(True).alias("reported"), F.lit("confirmed_cases").alias("name"), F.lit(1.0).alias("value_numeric"),
        c("subject.verbatim").alias("value_text"), F.lit("persons").alias("unit"),
        F.when(day, start).alias("as_of_date"),
        F.when(F.length(start) >= 4, F.substring(start, 1, 4).try_cast("int")).alias("as_of_year"),
        F.when(F.length(start) >= 7, F.substring(start, 6, 2).try_cast("int")).alias("as_of_month"),
        F.when(day, "day").otherwise("unknown").alias("as_of_precision"), F.lit(None).cast("string").alias("as_of_verbatim"),
    ).cast(metric_type)


def group_rewrites(claims: DataFrame) -> DataFrame:
    """Kind, metric, disease and laboratory-target rewrites that look at the whole group."""
    metric_type = claims.schema["metric"].dataType.simpleString()
    has_cluster = F.bool_or(yes(c("claim_kind") == "syndromic_cluster")).over(in_group())
    kind = F.when((c("claim_kind") == "death_count") & has_cluster, "syndromic_cluster").otherwise(c("claim_kind"))
    positive = yes(
        (kind == "diagnostic_result") & ~yes(c("polarity") == "negative") & (c("subject.subject_type") == "human")
        & (c("diagnostics.result") == "positive")
    )
    marked = claims.withColumns({"claim_kind": kind, "__pos": positive})
    pathogen = casefold(F.coalesce(c("pathogen_verbatim"), F.lit("")))
    target = casefold(F.coalesce(c("diagnostics.target"), F.lit("")))
    lab = yes(c("claim_kind") == "laboratory_investigation") & F.contains(target, F.lit("cepa")) & F.contains(target, F.lit("origen"))
    p = c("reference_period")

    def dated(point: Column) -> Column:
        return filled(point["date"]) | yes(point["year"] != 0)

    closed = (
        yes(c("claim_kind") == "surveillance_baseline") & ~yes(c("polarity") == "negative") & yes(c("metric.reported"))
        & yes(p["period_type"] == "historical_period") & dated(p["start"]) & dated(p["end"])
    )
    marked = marked.withColumns(
        {
            "locations": F.when(c("__pos") | yes(c("claim_kind") == "transmission_statement"), _drop_role(c("locations"), "current_location")).otherwise(c("locations")),
            "metric": F.when(c("__pos") & ~yes(c("metric.reported")), _implicit_case_metric(metric_type)).otherwise(c("metric")),
            "disease_verbatim": F.when(
                ~filled(c("disease_verbatim")) & contains_any(pathogen, ["hantavirus", "andes"]), "hantavirus"
            ).otherwise(c("disease_verbatim")),
            "diagnostics": F.when(lab, c("diagnostics").withField("target", F.lit("cepa"))).otherwise(c("diagnostics")),
            "claim_kind": F.when(c("__pos"), "case_status").when(closed, "historical_context").otherwise(c("claim_kind")),
        }
    )
    absent = F.bool_or(yes((c("claim_kind") == "wildlife_presence_absence") & (c("polarity") == "negative"))).over(in_group())
    marked = marked.withColumn("__absent", yes(c("claim_kind") == "wildlife_sampling") & absent)
    return marked.withColumns(
        {
            "claim_kind": F.when(c("__absent"), "wildlife_presence_absence").otherwise(c("claim_kind")),
            "polarity": F.when(c("__absent"), "negative").otherwise(c("polarity")),
        }
    ).select(*claims.columns)


def unknown_period(period_type: Column, verbatim: Column) -> Column:
    null = F.lit(None)
    point = F.struct(
        null.cast("string").alias("date"), null.cast("int").alias("year"), null.cast("int").alias("month"),
        F.lit("unknown").alias("precision"), null.cast("string").alias("verbatim"),
    )
    return F.struct(point.alias("start"), point.alias("end"), period_type.alias("period_type"), verbatim.alias("verbatim"))


def mobility_window(claims: DataFrame) -> DataFrame:
    """Two or more dated movements of a group share one observation window."""
    period_type = claims.schema["reference_period"].dataType.simpleString()
    mobile = yes(c("claim_kind") == "mobility")
    start = F.when(mobile, F.nullif(c("event_date.start"), F.lit("")))
    quotes = F.filter(F.transform("evidence", lambda e: strip_text(F.coalesce(e["text"], F.lit("")))), lambda t: t != "")
    marked = claims.withColumns({"__m": mobile, "__s": start, "__q": F.when(mobile, F.struct(c("ord"), quotes.alias("q")))})
    marked = marked.withColumns(
        {
            "__dated": F.count("__s").over(in_group()), "__lo": F.min("__s").over(in_group()), "__hi": F.max("__s").over(in_group()),
            "__all": F.collect_list("__q").over(in_group()),
        }
    )
    hit = c("__m") & (c("__dated") >= 2)
    verbatim = F.nullif(F.array_join(F.flatten(F.transform(F.array_sort("__all"), lambda x: x["q"])), " "), F.lit(""))
    window = F.struct(c("__lo").alias("start"), c("__hi").alias("end"), F.lit("day").alias("precision"))
    return marked.withColumns(
        {
            "event_date": F.when(hit, window).otherwise(c("event_date")),
            "reference_period": F.when(hit, unknown_period(F.lit("observation_window"), verbatim).cast(period_type)).otherwise(c("reference_period")),
        }
    ).select(*claims.columns)


def genomic_group(claims: DataFrame) -> DataFrame:
    """The most specific taxon named by a group's genomic claims applies to all of them."""
    genomic = yes(c("claim_kind") == "genomic_finding")
    text = F.concat_ws(" ", casefold(F.coalesce(c("pathogen_verbatim"), F.lit(""))), claim_text(c("summary"), c("evidence")))

    def said(words: str) -> Column:
        return F.bool_or(c("__gen") & F.contains("__text", F.lit(words))).over(in_group())

    marked = claims.withColumns({"__gen": genomic, "__text": text})
    taxon = F.when(said("orthohantavirus andesense"), "Orthohantavirus andesense").when(said("virus andes"), "virus Andes")
    marked = marked.withColumns({"__taxon": taxon, "__novel": said(NOVEL_VARIANT)})
    novel = c("__gen") & c("__novel") & yes(c("genomics.sequence_reported")) & ~filled(c("genomics.lineage"))
    return marked.withColumns(
        {
            "pathogen_verbatim": F.when(c("__gen"), F.coalesce("__taxon", "pathogen_verbatim")).otherwise(c("pathogen_verbatim")),
            "genomics": F.when(novel, c("genomics").withField("lineage", F.lit(NOVEL_VARIANT))).otherwise(c("genomics")),
        }
    ).select(*claims.columns)


def bucket_label(kind: Column, polarity: Column) -> Column:
    negative = yes(polarity == "negative")
    return (
        F.when((kind == "outbreak_update") & negative, "outbreak_absence")
        .when((kind == "case_status") & negative, "case_status_negative")
        .when(kind.isin(OUTBREAK_KINDS), "outbreak")
        .when(kind == "surveillance_baseline", "baseline")
        .when(kind.isin(WILDLIFE_KINDS) & negative, "wildlife_negative")
        .otherwise(F.coalesce(kind, F.lit("")))
    )


def bucket_key(claims: DataFrame) -> DataFrame:
    return claims.withColumns({"bucket": bucket_label(c("claim_kind"), c("polarity")), "bucket_group": group_key()})


def _rank_map(table: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for item in table.items() for x in item])


def _first_where(items: Column, test, value) -> Column:
    return F.get(F.transform(F.filter(items, test), value), F.lit(0))


def _keyed(names: tuple[str, ...]):
    return lambda x: F.struct(*[x[n].alias(n) for n in names])


def merge_hosts(items: Column) -> Column:
    subjects = F.filter(F.transform(items, lambda x: x["subject"]), lambda s: yes(s["subject_type"].isin("human", "animal", "wildlife", "vector")))

    def as_host(s: Column) -> Column:
        name = F.when(s["subject_type"] == "human", F.coalesce(F.nullif(s["canonical_name"], F.lit("")), F.lit("Homo sapiens"))).otherwise(s["canonical_name"])
        return F.struct(
            s["verbatim"].alias("verbatim"), name.alias("canonical_name"),
            F.when(s["subject_type"] == "animal", "other").otherwise(s["subject_type"]).alias("host_type"),
            F.coalesce(s["confidence"], F.lit(0.65)).alias("confidence"),
        )

    return distinct_by(F.transform(subjects, as_host), _keyed(("verbatim", "canonical_name", "host_type")))


def merge_locations(items: Column) -> Column:
    return distinct_by(F.flatten(F.transform(items, lambda x: x["locations"])), _keyed(LOCATION_KEY))


def merge_metrics(items: Column) -> Column:
    reported = F.filter(F.transform(items, lambda x: x["metric"]), lambda m: yes(m["reported"]))
    return distinct_by(F.transform(reported, lambda m: F.struct(*[m[n].alias(n) for n in METRIC_KEY])), _keyed(METRIC_KEY))


def merge_evidence(items: Column) -> Column:
    return distinct_by(F.flatten(F.transform(items, lambda x: x["evidence"])), _keyed(("type", "text", "page_number")))


def best_event_date(items: Column) -> Column:
    """``struct<date,conflict>``: the most precise date; differing equally precise ones are unknown."""
    dates = F.filter(F.transform(items, lambda x: x["event_date"]), lambda d: d.isNotNull())
    rank = lambda d: F.coalesce(F.try_element_at(_rank_map(PRECISION_RANK), d["precision"]), F.lit(0))
    top = F.array_max(F.transform(dates, rank))
    best = F.filter(dates, lambda d: rank(d) == top)
    conflict = yes((top > 0) & (F.size(F.array_distinct(best)) > 1))
    unknown = F.struct(F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end"), F.lit("unknown").alias("precision"))
    chosen = F.when(conflict | (F.size(dates) == 0), unknown).otherwise(F.get(best, F.lit(0)))
    return F.struct(chosen.alias("date"), conflict.alias("conflict"))


def first_reference_period(items: Column, period_type: str) -> Column:
    said = lambda x: yes(x["reference_period"]["period_type"] != "unknown") | filled(x["reference_period"]["verbatim"])
    default = unknown_period(F.lit("unknown"), F.lit(None).cast("string")).cast(period_type)
    return F.coalesce(_first_where(items, said, lambda x: x["reference_period"]), default)


def _telling(result: Column) -> Column:
    return yes(~result.isin("unknown", "not_applicable"))


def first_diagnostics(items: Column) -> Column:
    found = _first_where(items, lambda x: yes(x["diagnostics"]["test_reported"]) | _telling(x["diagnostics"]["result"]), lambda x: x["diagnostics"])
    null = F.lit(None).cast("string")
    default = F.struct(
        F.lit(False).alias("test_reported"), *[null.alias(n) for n in ("test_type", "method", "target", "specimen")], F.lit("unknown").alias("result")
    )
    return F.coalesce(found, default)


def first_genomics(items: Column) -> Column:
    def said(x: Column) -> Column:
        g = x["genomics"]
        return yes(g["sequence_reported"]) | filled(g["lineage"]) | filled(g["clade"]) | filled(g["accession"]) | _telling(g["test_result"])

    null = F.lit(None).cast("string")
    default = F.struct(
        F.lit(False).alias("sequence_reported"), *[null.alias(n) for n in ("lineage", "clade", "accession")], F.lit("not_applicable").alias("test_result")
    )
    return F.coalesce(_first_where(items, said, lambda x: x["genomics"]), default)


def last_known_transmission(items: Column) -> Column:
    def last(name: str) -> Column:
        known = F.filter(F.transform(items, lambda x: x["transmission"][name]), lambda v: yes(v != "unknown"))
        return F.coalesce(F.try_element_at(known, F.lit(-1)), F.lit("unknown")).alias(name)

    return F.struct(last("human_to_human"), last("animal_to_human"), last("vector_borne"))


def strongest_verification(items: Column) -> Column:
    values = F.transform(items, lambda x: F.coalesce(F.nullif(x["verification_status"], F.lit("")), F.lit("unknown")))
    rank = lambda v: F.coalesce(F.try_element_at(_rank_map(VERIFICATION_RANK), v), F.lit(0))
    top = F.array_max(F.transform(values, rank))
    return F.get(F.filter(values, lambda v: rank(v) == top), F.lit(0))


def bucket_summary(items: Column, signal_type: Column) -> Column:
    texts = F.array_distinct(F.filter(F.transform(items, lambda x: strip_text(F.coalesce(x["summary"], F.lit("")))), lambda t: t != ""))
    lead = signal_type.isin("outbreak", "case_report")
    return F.when(lead & (F.size(texts) > 0), F.get(texts, F.lit(0))).otherwise(F.array_join(texts, " "))


def dominant_kind(items: Column) -> Column:
    kinds = F.transform(items, lambda x: F.coalesce(x["claim_kind"], F.lit("")))
    only = lambda names: F.forall(kinds, lambda k: k.isin(names))
    return (
        F.when(F.array_contains(kinds, "outbreak_update"), "outbreak")
        .when(only(["case_status", "death_count"]) & (F.size(kinds) > 1), "outbreak")
        .when(only(["surveillance_baseline"]), "baseline")
        .when(F.exists(items, lambda x: yes((x["claim_kind"] == "wildlife_presence_absence") & (x["polarity"] == "negative"))), "wildlife_negative")
        .otherwise(F.get(kinds, F.lit(0)))
    )


#: What the fold reads of a claim, by column of a signal; ``claim_kind`` and ``polarity`` also name the bucket.
FOLD_READS = {
    "domains": ("claim_kind", "polarity", "domains"), "signal_role": ("claim_kind", "polarity", "diagnostics"), "signal_type": ("claim_kind", "polarity"),
    "disease": ("disease_verbatim",), "pathogen": ("pathogen_verbatim",), "hosts": ("subject",), "locations": ("locations",), "event_date": ("event_date",),
    "reference_period": ("reference_period",), "metrics": ("metric",), "transmission": ("transmission",), "genomics": ("genomics",),
    "verification_status": ("verification_status",), "signal_summary": ("claim_kind", "polarity", "summary"), "evidence": ("evidence",),
    "extraction_confidence": ("confidence",), "diagnostics": ("diagnostics",), "notes": ("claim_id", "event_date", "notes"),
}


def fold_bucket(claims: DataFrame, *wanted: str) -> DataFrame:
    """One signal per (document, bucket), with all columns of a signal or those ``wanted``.

    Numbering follows the first appearance of buckets when claims are read group by
    group, groups in order of their first claim.  Spark keeps every field of a collected
    claim, so claims keep only what the columns read.  Claims dealt out by document before
    they are nested are not moved again; others are moved here.
    """
    names = [n for n in FOLD_READS if not wanted or n in wanted]
    reads = {field for n in names for field in FOLD_READS[n]}
    claims = with_notes(claims)
    period_type = claims.schema["reference_period"].dataType.simpleString()
    payload = [n for n in claims.columns if n in reads]
    items_of = F.array_sort(F.collect_list(F.struct(c("ord"), F.struct(*payload, F.lit(True).alias("__any")).alias("v"))))
    # Groups of claims that were left out since still count where their first positions were noted.
    given = "group_first" in claims.columns
    folded_rows = bucket_key(claims).groupBy("doc", "bucket", "bucket_group").agg(items_of.alias("__i"), *[F.min("group_first").alias("__g")] * given)
    if not given:
        folded_rows = folded_rows.withColumn("__g", F.min(F.col("__i")[0]["ord"]).over(Window.partitionBy("doc", "bucket_group")))
    rows = folded_rows.select(
        "doc", F.dense_rank().over(Window.partitionBy("doc").orderBy("__g", F.col("__i")[0]["ord"])).alias("nn"),
        F.transform("__i", lambda x: x["v"]).alias("items"),
    )
    items = c("items")
    null = F.lit(None).cast("string")

    def first_text(name: str) -> Column:
        return F.coalesce(_first_where(items, lambda x: strip_text(F.coalesce(x[name], F.lit(""))) != "", lambda x: strip_text(x[name])), null)

    steps = {
        "__kind": ("claim_kind", lambda: dominant_kind(items)), "__disease": ("disease_verbatim", lambda: first_text("disease_verbatim")),
        "__pathogen": ("pathogen_verbatim", lambda: first_text("pathogen_verbatim")), "__date": ("event_date", lambda: best_event_date(items)),
        "diagnostics": ("diagnostics", lambda: first_diagnostics(items)),
        "__anyneg": ("polarity", lambda: F.exists(items, lambda x: yes(x["polarity"] == "negative"))),
        "__allneg": ("polarity", lambda: F.forall(items, lambda x: yes(x["polarity"] == "negative"))),
        "__domains": ("domains", lambda: F.array_distinct(F.flatten(F.transform(items, lambda x: F.coalesce(x["domains"], F.array().cast("array<string>")))))),
    }
    rows = rows.withColumns({n: step() for n, (field, step) in steps.items() if field in reads})
    kind = c("__kind")
    types = F.create_map(*[F.lit(x) for item in PLAIN_TYPES.items() for x in item])
    if "claim_kind" in reads:
        rows = rows.withColumn("signal_type", F.coalesce(F.try_element_at(types, kind), F.lit("other")))
    role = (
        F.when(c("diagnostics.result") == "negative", "negative_evidence")
        .when(kind == "wildlife_negative", "negative_evidence")
        .when((kind == "outbreak") & c("__allneg"), "negative_evidence")
        .when(kind == "baseline", "surveillance_baseline")
        .when(kind == "historical_context", "background_context")
        .when(kind.isin(NEGATABLE) & c("__anyneg"), "negative_evidence")
        .otherwise("primary_event")
    )
    domains = F.when(F.size("__domains") == 0, F.array(F.lit("human"))).otherwise(c("__domains"))
    domains = F.when(c("signal_type") == "genomic_observation", F.array_union(domains, F.array(F.lit("genomic")))).otherwise(domains)
    confidence = F.transform(items, lambda x: F.coalesce(F.nullif(x["confidence"].cast("double"), F.lit(0.0)), F.lit(0.5)))
    mean = F.aggregate(confidence, F.lit(0.0), lambda a, x: a + x) / F.size(confidence)
    parts = {
        "domains": domains, "signal_role": role, "signal_type": c("signal_type"),
        "disease": normalize_entity(c("__disease"), "disease"), "pathogen": normalize_entity(c("__pathogen"), "pathogen"),
        "hosts": merge_hosts(items), "locations": merge_locations(items), "event_date": c("__date.date"),
        "reference_period": first_reference_period(items, period_type), "metrics": merge_metrics(items),
        "transmission": last_known_transmission(items), "genomics": first_genomics(items),
        "verification_status": strongest_verification(items), "signal_summary": bucket_summary(items, c("signal_type")),
        "evidence": merge_evidence(items), "extraction_confidence": F.round(mean, 4), "diagnostics": c("diagnostics"),
        "notes": F.concat(_claim_notes(items), F.when(c("__date.conflict"), F.array(F.lit("ASM-EVENT-DATE-01"))).otherwise(F.array().cast("array<string>"))),
    }
    return rows.select(
        "doc", "nn",
        F.concat(c("doc"), F.lit("-asm-"), F.lpad(c("nn").cast("string"), F.greatest(F.lit(2), F.length(c("nn").cast("string"))), F.lit("0"))).alias("local_signal_id"),
        *[parts[n].alias(n) for n in names],
    )


def _claim_notes(items: Column) -> Column:
    """What happened to the claims of a signal, each note with its claim."""
    return F.flatten(F.transform(items, lambda x: F.transform(x["notes"], lambda n: F.concat_ws(" ", n, x["claim_id"]))))


def pathogen_specificity(entity: Column) -> Column:
    name = casefold(F.coalesce(entity["canonical_name"], F.lit("")))
    return (
        F.when(F.contains(name, F.lit("orthohantavirus andesense")), 3).when(F.contains(name, F.lit("andes virus")), 2)
        .when(name != "", 1).otherwise(0)
    )


#: Columns without which :func:`merge_nonrelation` cannot tell targets from findings or fold them.
NONRELATION_READS = ("signal_role", "signal_type", "pathogen", "transmission", "genomics", "signal_summary", "evidence")


def merge_nonrelation(signals: DataFrame) -> DataFrame:
    """Genomic non-relation findings fold into the document's negative transmission signal.

    Target: the only one, else the first with the same pathogen, else the first.  The
    findings are folded in order; windows by document need no join of the signals with
    themselves.
    """
    text = claim_text(c("signal_summary"), c("evidence"))
    target = yes(c("signal_type") == "transmission_observation") & (
        yes(c("signal_role") == "negative_evidence") | yes(c("transmission.animal_to_human") == "refuted")
    )
    finding = yes(c("signal_type") == "genomic_observation") & contains_any(text, HUMAN_CONTEXT) & contains_any(text, DIFFERENCE)
    moving = [n for n in ("domains", "pathogen", "genomics", "hosts", "evidence", "signal_summary", "notes") if n in signals.columns]
    doc = Window.partitionBy("doc")
    marked = signals.withColumns({"__target": target, "__finding": finding})
    goal = F.when(c("__target"), F.struct(c("nn"), c("pathogen.canonical_name").alias("name")))
    marked = marked.withColumn("__targets", F.array_sort(F.collect_list(goal).over(doc)))
    own = c("pathogen.canonical_name")
    alike = F.filter("__targets", lambda t: yes(filled(t["name"]) & (t["name"] == own)))
    choice = F.when(
        c("__finding"), F.coalesce(F.when(F.size("__targets") > 1, F.get(alike, F.lit(0))["nn"]), F.get("__targets", F.lit(0))["nn"])
    )
    marked = marked.withColumn("__goal", choice).drop("__targets")
    move = F.when(c("__goal").isNotNull(), F.struct(c("__goal").alias("goal"), c("nn").alias("f_nn"), F.struct(*moving).alias("f")))
    marked = marked.withColumn("__moves", F.collect_list(move).over(doc)).filter("__goal is null")
    mine = F.array_sort(F.filter("__moves", lambda m: m["goal"] == c("nn")), _by_finding)
    joined = marked.withColumn("__f", F.when(c("__target") & (F.size("__moves") > 0), mine))
    state = F.struct(*moving)

    def fold(acc: Column, x: Column) -> Column:
        f = x["f"]
        better = pathogen_specificity(f["pathogen"]) > pathogen_specificity(acc["pathogen"])
        said, own = strip_text(F.coalesce(f["signal_summary"], F.lit(""))), strip_text(F.coalesce(acc["signal_summary"], F.lit("")))
        sequenced = yes(f["genomics"]["sequence_reported"]) | yes(f["genomics"]["test_result"] == "positive")
        parts = {
            "domains": F.array_distinct(F.concat(acc["domains"], f["domains"])),
            "pathogen": F.when(better, f["pathogen"]).otherwise(acc["pathogen"]),
            "genomics": F.when(sequenced, f["genomics"]).otherwise(acc["genomics"]),
            "hosts": distinct_by(F.concat(acc["hosts"], f["hosts"]), _keyed(("canonical_name", "verbatim", "host_type"))),
            "evidence": distinct_by(F.concat(f["evidence"], acc["evidence"]), _keyed(("type", "text", "page_number"))),
            "signal_summary": F.when((said != "") & ~F.contains(own, said), strip_text(F.concat_ws(" ", said, own))).otherwise(acc["signal_summary"]),
            "notes": F.concat(acc["notes"], f["notes"]),
        }
        return F.struct(*[parts[n].alias(n) for n in moving])

    hit = F.coalesce(F.size("__f"), F.lit(0)) > 0
    merged = joined.withColumn("__m", F.when(hit, F.aggregate("__f", state, fold)))
    return merged.withColumns(
        {
            **{n: F.when(hit, c("__m")[n]).otherwise(c(n)) for n in moving},
            "signal_role": F.when(hit, "negative_evidence").otherwise(c("signal_role")),
            **({"verification_status": F.when(hit, "refuted").otherwise(c("verification_status"))} if "verification_status" in signals.columns else {}),
        }
    ).select(*signals.columns)


def _by_finding(a: Column, b: Column) -> Column:
    return F.when(a["f_nn"] < b["f_nn"], -1).when(a["f_nn"] > b["f_nn"], 1).otherwise(0)


def canonical_evidence(signals: DataFrame) -> DataFrame:
    """Textual evidence labels become ``text``."""
    fixed = F.transform("evidence", lambda e: e.withField("type", F.when(casefold(e["type"]).isin(TEXT_LABELS_V046), "text").otherwise(e["type"])))
    return signals.withColumn("evidence", fixed)


def normalize_signals(signals: DataFrame) -> DataFrame:
    """Partial dates, explicit pathogens and biological hosts."""

    def metric(m: Column) -> Column:
        p = partial_date(m["as_of_date"], m["as_of_year"], m["as_of_month"], m["as_of_precision"], m["as_of_verbatim"])
        return F.struct(
            *[m[n].alias(n) for n in ("name", "value_numeric", "value_text", "unit")], p["date"].alias("as_of_date"), p["year"].alias("as_of_year"),
            p["month"].alias("as_of_month"), p["precision"].alias("as_of_precision"), p["verbatim"].alias("as_of_verbatim"),
        )

    def point(x: Column) -> Column:
        p = partial_date(x["date"], x["year"], x["month"], x["precision"], x["verbatim"], keep_zero=False)
        return F.struct(*[p[n].alias(n) for n in ("date", "year", "month", "precision", "verbatim")])

    period = c("reference_period")
    dated = F.exists("metrics", lambda m: ~m["as_of_date"].eqNullSafe(metric(m)["as_of_date"]))
    points = F.array(*[F.array(period[e]["date"], point(period[e])["date"]) for e in ("start", "end")])
    changed = F.exists(points, lambda x: ~x[0].eqNullSafe(x[1]))
    named = resolve_explicit_pathogen(c("pathogen"))
    renamed = ~named["canonical_name"].eqNullSafe(c("pathogen.canonical_name")) | ~named["normalization_status"].eqNullSafe(c("pathogen.normalization_status"))
    lost = F.transform(F.array_except(F.transform("hosts", host_label), F.transform(biological_hosts(c("hosts")), host_label)), lambda h: F.concat(F.lit("NORM-HOST "), h))
    notes = {}
    if "notes" in signals.columns:
        told = [F.when(yes(hit), F.array(F.lit(code))).otherwise(F.array().cast("array<string>")) for hit, code in
                ((dated, "NORM-METRIC-DATE"), (changed, "NORM-PERIOD-DATE"), (renamed, "NORM-PATHOGEN"))]
        notes = {"notes": F.concat(c("notes"), *told, F.coalesce(lost, F.array().cast("array<string>")))}
    return signals.withColumns(
        {
            **notes,
            "metrics": F.transform("metrics", metric),
            "reference_period": period.withField("start", point(period["start"])).withField("end", point(period["end"])),
            "pathogen": resolve_explicit_pathogen(c("pathogen")),
            "hosts": biological_hosts(c("hosts")),
        }
    )


def _body(signals: DataFrame, beside: tuple[str, ...]) -> tuple[Column, T.DataType]:
    """What makes two signals of a document equal."""
    ignored = {"doc", "local_signal_id", "signal_summary", "extraction_confidence", "notes", *beside}
    body = F.struct(*[n for n in signals.columns if n not in ignored])
    return body, signals.select(body.alias("b")).schema["b"].dataType


def dedupe_exact_signals(signals: DataFrame, order: str = "nn") -> DataFrame:
    """Drop later signals of a document equal in everything but id, summary and confidence."""
    body, dtype = _body(signals, (order,))
    first = F.row_number().over(Window.partitionBy("doc", "__sig").orderBy(order))
    return signals.withColumn("__sig", row_sha256(body, dtype)).withColumn("__first", first).filter("__first = 1").drop("__sig", "__first")


def reclassify_surveillance(signals: DataFrame) -> DataFrame:
    """Aggregate surveillance snapshots are baselines, not events."""
    snapshot = (
        yes(c("signal_role") == "primary_event") & yes(c("signal_type").isin("outbreak", "case_report")) & (F.size("metrics") > 0)
        & ~filled(c("event_date.start")) & ~filled(c("event_date.end"))
        & yes(c("reference_period.period_type").isin("surveillance_period", "season")) & (F.size("locations") > 0)
        & F.forall("locations", lambda x: yes(x["role"] == "reporting_jurisdiction"))
    )
    marked = signals.withColumn("__hit", snapshot)
    return marked.withColumns(
        {
            "signal_role": F.when(c("__hit"), "surveillance_baseline").otherwise(c("signal_role")),
            "signal_type": F.when(c("__hit"), "case_report").otherwise(c("signal_type")),
            "notes": _note(c("__hit"), "SEM-049-01"),
        }
    ).drop("__hit")


def _claim_steps(claims: DataFrame) -> tuple[DataFrame, list[tuple[str, DataFrame]]]:
    """(claims that become signals, claims left out by reason), by the claim-level steps in order.

    Every step is keyed by document or finer, so claims dealt out by document before they are nested are never moved.
    """
    left = []

    def without(df: DataFrame, reason: str, rule: Column) -> DataFrame:
        left.append((reason, df.filter(rule)))
        return df.filter(~rule)

    out = without(split_multisite(claims), "facility_inventory", facility_inventory())
    out = mobility_to_intervention(collective_characterisation(attach_lab_confirmation(promote_animal_outbreaks(out))))
    out = merge_surveillance_snapshots(without(out, "generic_investigation", generic_investigation()))
    out = genomic_group(mobility_window(group_rewrites(out)))
    out = out.withColumn("group_first", F.min("ord").over(in_group()))
    out = without(out, "negative_history", negative_history())
    return without(out, "training_intervention", training_intervention()), left


def prepare_claims(claims: DataFrame) -> DataFrame:
    """All claim-level steps in order, ending with the claims that become signals."""
    return _claim_steps(claims)[0]


def dropped_claims(claims: DataFrame) -> DataFrame:
    """Claims that become no signal: ``doc``, ``claim_id``, ``reason`` and the notes they had by then."""
    parts = [df.select("doc", "claim_id", F.lit(reason).alias("reason"), "notes") for reason, df in _claim_steps(claims)[1]]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def assemble_marked(claims: DataFrame) -> DataFrame:
    """Claims to canonical, normalised signals, with what happened on the way.

    ``notes`` of a signal tell every step that changed it or one of its claims; ``dropped`` is null for a signal that
    stays, else ``operational`` or ``duplicate_of <id of the equal signal>``.  Dropped signals stay as rows, so nothing is
    computed twice to report them.
    """
    signals = merge_nonrelation(fold_bucket(prepare_claims(claims)))
    marked = canonical_evidence(signals.withColumn("dropped", F.when(operational_signal(), "operational")))
    marked = normalize_signals(marked)
    body, dtype = _body(marked, ("nn", "dropped"))
    equal = Window.partitionBy("doc", "dropped", "__sig").orderBy("nn")
    marked = marked.withColumn("__sig", row_sha256(body, dtype)).withColumn("__kept", F.first("local_signal_id").over(equal))
    repeated = c("dropped").isNull() & (c("__kept") != c("local_signal_id"))
    return reclassify_surveillance(marked.withColumn("dropped", F.when(repeated, F.concat(F.lit("duplicate_of "), "__kept")).otherwise(c("dropped"))).drop("__sig", "__kept"))


def assemble(claims: DataFrame) -> DataFrame:
    """Claims to canonical, normalised, deduplicated signals."""
    return assemble_marked(claims).filter("dropped is null").drop("dropped")


def checked_assembly(claims: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signals of sound documents with their notes, failures) of documents whose claims and signals are checked.

    A document whose claims break the claim contract or quote what its text does not hold becomes no signals; so does one
    whose signals break theirs.  Both are read several times, so they are written once.  ``failures``: ``doc``, ``stage`` (claims or signals), ``id``, ``path``, ``rule``.
    ``raw``: ``raw_item_id``, ``raw_text``.
    """
    before = materialised(_failures(claims, raw, "claims", "claim_id", V.CLAIM_CONTRACT), "claim-failures")
    signals = materialised(assemble(claims.join(before.select("doc").distinct(), "doc", "left_anti")), "checked-signals")
    after = materialised(_failures(signals, raw, "signals", "local_signal_id", V.SIGNAL_CONTRACT), "signal-failures")
    return signals.join(after.select("doc").distinct(), "doc", "left_anti"), before.unionByName(after)


def _failures(rows: DataFrame, raw: DataFrame, stage: str, key: str, rules: list[V.Rule]) -> DataFrame:
    broken = V.contract_check(rows, ["doc", key], rules).select("doc", F.col(key).alias("id"), "path", "rule")
    quoted = rows.select(F.col("doc").alias("raw_item_id"), F.col(key).alias("id"), "evidence")
    said = V.literal_evidence(quoted, raw, "id").select(F.col("raw_item_id").alias("doc"), "id", F.lit("evidence[].text").alias("path"), F.lit("literal").alias("rule"))
    return broken.unionByName(said.distinct()).withColumn("stage", F.lit(stage))
