"""Cohorts of automatically linked signals and the events created from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sentinelweave.functions.identity import event_code, uuid5
from sentinelweave.functions.text import casefold, strip_text
from sentinelweave.operators.gates import yes
from sentinelweave.operators.matching import MIN_COVERAGE, STRONG_ANCHOR_PREFIX
from sentinelweave.session import materialised, truncate_lineage

# Relation classes that may create events, defaults of a new event, versions a relation must carry.
CREATING_RELATIONS = ["duplicates", "refines"]
EVENT_DEFAULTS = {
    "lifecycle_status": "active", "priority": "P3", "evidence_confidence": "low", "cross_sector_convergence": "none", "review_status": "pending",
}
GENERIC_TITLE = "One Health emerging event"
VERSIONS = {"matcher_version": "0.4.8", "policy_version": "0.4.9", "context_resolver_version": "0.4.9"}
OPEN_LIFECYCLES = ["active", "monitoring"]
MANUAL_DECISIONS = ["manual_linked", "manual_unlinked"]
ANCHOR_OVERRIDE = "shared_strong_event_context_anchor"


def approved(c=F.col) -> Column:
    """A relation that may create or extend an event."""
    return yes(
        (c("gate") == "eligible") & (c("decision") == "auto_linked") & c("merge_allowed") & ~c("hard_conflict") & c("relation").isin(CREATING_RELATIONS)
    )


def creation_edges(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations that may create events, excluded relations)."""
    marked = relations.withColumn("__ok", approved())
    return marked.filter("__ok").drop("__ok"), marked.filter("not __ok").drop("__ok")


def strong_anchors(anchors: Column) -> Column:
    tidy = F.transform(F.coalesce(anchors, F.array().cast("array<string>")), lambda a: casefold(strip_text(a)))
    return F.array_sort(F.array_distinct(F.filter(tidy, lambda a: yes(a.startswith(STRONG_ANCHOR_PREFIX)))))


def cohorts(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(signal_id, cohort)``: connected components over signals and shared strong anchors.

    Alternating star contraction: every node is re-attached to the smallest node in its
    neighbourhood until nothing moves, about log(n) rounds.  Each round is a map-side
    combined minimum and one equi-join; no node's neighbours are ever gathered, and AQE
    splits the join partition of a hub.  Rounds are cut with reliable checkpoints.

    A cohort is named after its smallest signal id.
    """
    signal = lambda c: F.concat(F.lit("s:"), F.col(c))
    links = edges.select(signal("source_id").alias("u"), signal("target_id").alias("v"))
    shared = edges.select(signal("source_id").alias("u"), F.explode(strong_anchors(F.col("shared_event_context_anchors"))).alias("a"))
    # One endpoint per edge is enough: the edge itself ties the other one.
    links = links.unionByName(shared.select("u", F.concat(F.lit("t:"), "a").alias("v")))
    # Stars only: (v, u) with u < v means v hangs on u.
    stars = truncate_lineage(links.filter("u <> v").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).distinct())
    before = None
    for _ in range(max_rounds):
        stars = truncate_lineage(_small_star(_large_star(stars)))
        after = stars.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    members = stars.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
        stars.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    )
    ids = members.filter(F.startswith("node", F.lit("s:"))).select(F.substring("node", 3, 2**30).alias("signal_id"), "root")
    names = ids.groupBy("root").agg(F.min("signal_id").alias("cohort"))
    return ids.join(names, "root").select("signal_id", "cohort")


def _large_star(stars: DataFrame) -> DataFrame:
    """Larger neighbours of every node move to the smallest node around it."""
    both = stars.select("v", "u").unionByName(stars.select(F.col("u").alias("v"), F.col("v").alias("u")))
    lowest = both.groupBy("v").agg(F.min("u").alias("m")).withColumn("m", F.least("m", "v"))
    moved = both.filter("u > v").join(lowest, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return moved.filter("u <> v").distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them."""
    lowest = stars.groupBy("v").agg(F.min("u").alias("m"))
    joined = stars.join(lowest, "v")
    moved = joined.filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return moved.unionByName(lowest.select("v", F.col("m").alias("u"))).distinct()


def cohort_members(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with their cohort; an edge has both ends in one cohort."""
    return edges.join(labels.withColumnRenamed("signal_id", "source_id"), "source_id")


def cohort_rollup(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, seed relation and deterministic code per cohort.

    Members stay rows in ``labels`` and ``edges``; nothing here grows with a cohort.
    The seed is the best score, then the smallest relation id; a null score counts -1.
    """
    member_edges = cohort_members(edges, labels)
    by_edge = member_edges.groupBy("cohort").agg(
        F.count_distinct("relation_id").alias("relation_count"),
        F.min_by("relation_id", F.struct(-F.coalesce(F.col("score").cast("double"), F.lit(-1.0)), F.col("relation_id"))).alias("seed_relation_id"),
        F.min("relation").alias("__r0"), F.max("relation").alias("__r1"),
    )
    anchors = member_edges.select("cohort", F.explode_outer(strong_anchors(F.col("shared_event_context_anchors"))).alias("a"))
    by_anchor = anchors.groupBy("cohort").agg(F.count_distinct("a").alias("anchor_count"))
    out = by_edge.join(cohort_codes(labels), "cohort").join(by_anchor, "cohort")
    return out.withColumn("source_relation", F.when(F.col("__r0") == F.col("__r1"), F.col("__r0"))).drop("__r0", "__r1")


def cohort_codes(labels: DataFrame) -> DataFrame:
    """``(cohort, signal_count, event_code)``: the code follows from the number and combinable digests of the
    distinct ids, by one formula for cohorts of any size."""
    facts = labels.select("cohort", "signal_id").distinct().groupBy("cohort").agg(
        F.count("*").alias("signal_count"), F.min("signal_id").alias("__lo"), F.max("signal_id").alias("__hi"),
        F.bit_xor(F.xxhash64("signal_id")).alias("__x"), F.sum(F.xxhash64(F.lit("sum"), "signal_id").cast("decimal(38,0)")).alias("__s"),
    )
    parts = [F.lit("events:event:v0.4.9:digest"), F.col("signal_count").cast("string"), F.col("__lo"), F.col("__hi"), F.col("__x").cast("string"), F.col("__s").cast("string")]
    return facts.select("cohort", "signal_count", F.concat(F.lit("EVT-"), uuid5(F.concat_ws(":", *parts))).alias("event_code"))


def cohort_seed(labels: DataFrame, rollup: DataFrame, signals: DataFrame) -> DataFrame:
    """Event draft per cohort with the first reason it is invalid.

    ``signals``: signal_id, disease_id, disease_canonical_name, pathogen_id,
    pathogen_canonical_name, domains, occurred_start, observed_at.
    """
    joined = labels.join(signals, "signal_id", "left").withColumn("__known", F.col("observed_at").isNotNull() | F.col("domains").isNotNull())
    name = lambda c: casefold(F.nullif(strip_text(c), F.lit("")))

    def label(c: str, alias: str) -> list[Column]:
        shown = F.nullif(strip_text(F.col(c)), F.lit(""))
        return [F.min(name(F.col(c))).alias(f"__{alias}_lo"), F.max(name(F.col(c))).alias(f"__{alias}_hi"),
                F.min_by(shown, F.when(shown.isNotNull(), F.struct(name(F.col(c)), shown))).alias(f"__{alias}_s")]

    facts = joined.groupBy("cohort").agg(
        F.count("*").alias("__n"), F.count_distinct("signal_id").alias("__d"), F.count_if(~F.col("__known")).alias("__missing"),
        F.min("disease_id").alias("disease_id"), F.max("disease_id").alias("__dh"), F.min("pathogen_id").alias("pathogen_id"), F.max("pathogen_id").alias("__ph"),
        F.min("occurred_start").alias("event_start_date"), F.min("observed_at").alias("first_signal_at"), *label("disease_canonical_name", "dn"), *label("pathogen_canonical_name", "pn"),
    )
    domains = (
        joined.select("cohort", F.explode("domains").alias("d")).withColumn("d", strip_text("d")).filter("d <> ''").distinct()
        .groupBy("cohort").agg(F.array_sort(F.collect_list("d")).alias("domains_present"))
    )

    def unique(alias: str) -> Column:
        return F.when(F.col(f"__{alias}_lo") == F.col(f"__{alias}_hi"), F.col(f"__{alias}_s"))

    shown = F.coalesce(unique("dn"), unique("pn"))
    error = (
        F.when(F.col("__n") < 2, "too_few_signals").when(F.col("__d") < F.col("__n"), "duplicate_signal").when(F.col("__missing") > 0, "endpoint_outside_cohort")
        .when(F.col("disease_id") != F.col("__dh"), "conflicting_disease").when(F.col("pathogen_id") != F.col("__ph"), "conflicting_pathogen")
    )
    out = rollup.join(facts, "cohort").join(domains, "cohort", "left")
    return out.select(
        "cohort", "event_code", F.coalesce(F.concat(shown, F.lit(" - emerging event")), F.lit(GENERIC_TITLE)).alias("title"), "disease_id", "pathogen_id",
        F.coalesce("domains_present", F.array().cast("array<string>")).alias("domains_present"), "event_start_date", "first_signal_at",
        *[F.lit(v).alias(k) for k, v in EVENT_DEFAULTS.items()], F.lit(False).alias("contradictions_present"), "signal_count", "relation_count", "seed_relation_id",
        "source_relation", error.alias("error"),
    )


def pair_seed(relations: DataFrame, signals: DataFrame) -> DataFrame:
    """Two-signal event draft per approved relation, with its own title precedence."""
    fields = [c for c in signals.columns if c != "signal_id"]
    a = signals.select(F.col("signal_id").alias("source_id"), F.struct(*fields).alias("a"))
    b = signals.select(F.col("signal_id").alias("target_id"), F.struct(*fields).alias("b"))
    j = relations.filter(approved()).join(a, "source_id").join(b, "target_id")
    text = lambda side, n: F.nullif(strip_text(F.col(side)[n]), F.lit(""))
    da, db, pa, pb = text("a", "disease_canonical_name"), text("b", "disease_canonical_name"), text("a", "pathogen_canonical_name"), text("b", "pathogen_canonical_name")
    only = lambda x, y: F.when(x.isNull() | y.isNull() | (x == y), F.coalesce(x, y))
    label = F.coalesce(F.when(casefold(da) == casefold(db), da), F.when(casefold(pa) == casefold(pb), pa), only(da, db), only(pa, pb))
    error = F.when(F.col("a.disease_id") != F.col("b.disease_id"), "conflicting_disease").when(F.col("a.pathogen_id") != F.col("b.pathogen_id"), "conflicting_pathogen")
    return j.select(
        "relation_id", "source_id", "target_id", event_code(F.array("source_id", "target_id"), "pair").alias("event_code"),
        F.coalesce(F.concat(label, F.lit(" - emerging event")), F.lit(GENERIC_TITLE)).alias("title"),
        F.coalesce("a.disease_id", "b.disease_id").alias("disease_id"), F.coalesce("a.pathogen_id", "b.pathogen_id").alias("pathogen_id"),
        F.array_sort(F.array_union("a.domains", "b.domains")).alias("domains_present"),
        F.least("a.occurred_start", "b.occurred_start").alias("event_start_date"), F.least("a.observed_at", "b.observed_at").alias("first_signal_at"), error.alias("error"),
    )


def plan_pair_creation(relations: DataFrame, memberships: DataFrame) -> DataFrame:
    """Ready or blocked per relation, first reason wins."""
    held = memberships.select("signal_id").distinct()
    s = held.select(F.col("signal_id").alias("source_id"), F.lit(True).alias("__s"))
    t = held.select(F.col("signal_id").alias("target_id"), F.lit(True).alias("__t"))
    reason = (
        F.when(~yes(F.col("gate") == "eligible"), "matcher_pair_ineligible")
        .when(yes(F.col("hard_conflict")), "hard_conflict")
        .when(yes(F.col("decision") == "review_required"), "matcher_requires_review")
        .when(~yes(F.col("decision") == "auto_linked"), "matcher_rejected")
        .when(~yes(F.col("merge_allowed")), "merge_not_allowed")
        .when(~yes(F.col("relation").isin(CREATING_RELATIONS)), "relation_not_auto_creatable")
        .when(yes(F.col("__s")) | yes(F.col("__t")), "existing_event_membership")
    )
    out = relations.join(s, "source_id", "left").join(t, "target_id", "left").withColumn("block", reason)
    return out.select(
        *relations.columns, F.when(F.col("block").isNull(), "ready").otherwise("blocked").alias("status"),
        F.coalesce("block", F.lit("auto_linked_pair_without_event")).alias("reason"), F.col("block").isNull().alias("write_allowed"),
    )


#: Fields of a draft that stored rows must give again, and of a stored event that must equal the draft.
SEED_FIELDS = [
    "event_code", "title", "disease_id", "pathogen_id", "domains_present", "event_start_date", "first_signal_at", "lifecycle_status", "priority",
    "evidence_confidence", "cross_sector_convergence", "contradictions_present", "review_status",
]
SEED_SOURCES = ["signal_count", "relation_count", "seed_relation_id", "source_relation"]
#: Fields of a stored event that only a reviewer fills.
REVIEW_FIELDS = ["summary", "reviewed_by", "reviewed_at"]
# What an automatic membership holds besides its rationale.
MEMBERSHIP = {"relation_to_event": "supports", "match_score": None, "match_decision": "auto_linked", "linked_by": None}
CREATION_VERSION = "0.4.9"


def cohort_anchors(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(cohort, anchor)``: the strong anchors of a cohort's relations, once each."""
    return cohort_members(edges, labels).select("cohort", F.explode(strong_anchors(F.col("shared_event_context_anchors"))).alias("anchor")).distinct()


def membership_rationale() -> Column:
    """The audit an automatic membership carries: the event, its seed and the sizes and digest of its sources.

    The sources themselves are rows (:func:`creation_sources`): a list of them on every membership would be
    quadratic in a cohort.
    """
    return F.create_map(
        F.lit("producer"), F.lit("event_creation"), F.lit("event_code"), F.col("event_code"), F.lit("seed_relation_id"), F.col("seed_relation_id"),
        F.lit("source_signals"), F.col("signal_count").cast("string"), F.lit("source_relations"), F.col("relation_count").cast("string"),
        *[F.lit(x) for item in {**VERSIONS, "event_creation_version": CREATION_VERSION}.items() for x in item],
    )


def differing(names: list[str], a: str, b: str) -> Column:
    """Names of the fields in which two structs differ, null-safe, sorted; lists compare without order."""
    def side(struct: str, name: str) -> Column:
        c = F.col(f"{struct}.{name}")
        return F.array_sort(c) if name == "domains_present" else c

    return F.array_compact(F.array(*[F.when(~side(a, n).eqNullSafe(side(b, n)), F.lit(n)) for n in sorted(names)]))


def validate_cohort(
    seeds: DataFrame, members: DataFrame, edges: DataFrame, live: DataFrame, stored: DataFrame, events: DataFrame, memberships: DataFrame,
    signals: DataFrame, seed_anchors: DataFrame, supported: DataFrame, producer: str = "matcher",
) -> DataFrame:
    """Recheck reviewed event drafts against the stored tables; ``(cohort, event_code, event_id, status, reason, mismatched_fields)``.

    ``seeds`` are drafts as reviewed (:func:`cohort_seed`), ``seed_anchors`` their anchors (:func:`cohort_anchors`);
    ``members`` (cohort, signal_id) and ``edges`` (cohort, relation_id) as reviewed; ``live`` current eligible ids;
    ``stored`` relations with producer and the audit columns; ``signals`` those a draft is built of;
    ``supported`` (signal_id, context_anchors found in the source text); ``events`` and ``memberships`` as stored,
    where a column that is missing counts as different.

    Every check is a fact per cohort, and the first that fails is the reason. In order: signals; relations; overrides
    without anchor, of an anchor the draft lacks, without or of other versions; relations that may not create; signals
    no relation covers; versions of all relations; the draft built again from stored rows, and its fields; anchors
    without support in the text; the guard's verdict; more than one component; manual and other memberships; the
    event's lifecycle, fields and review, and its memberships row by row.
    """
    none = F.array().cast("array<string>")
    facts = seeds.select("cohort", "event_code")
    missing = members.join(live.select("signal_id"), "signal_id", "left_anti").groupBy("cohort").agg(F.count("*").alias("missing_signals"))
    own = stored.filter(F.col("producer") == producer)
    lost = edges.join(own.select("relation_id"), "relation_id", "left_anti").groupBy("cohort").agg(F.count("*").alias("missing_relations"))
    a = members.select("cohort", F.col("signal_id").alias("source_id"), F.lit(True).alias("__a"))
    b = members.select("cohort", F.col("signal_id").alias("target_id"), F.lit(True).alias("__b"))
    sa = supported.select(F.col("signal_id").alias("source_id"), F.col("context_anchors").alias("__sa"))
    sb = supported.select(F.col("signal_id").alias("target_id"), F.col("context_anchors").alias("__sb"))
    named = F.array_distinct(F.filter(F.transform(F.coalesce("shared_event_context_anchors", none), lambda x: casefold(strip_text(x))), lambda x: yes(x != "")))
    rel = (
        edges.join(own, "relation_id").join(a, ["cohort", "source_id"], "left").join(b, ["cohort", "target_id"], "left")
        .join(sa, "source_id", "left").join(sb, "target_id", "left").withColumn("__named", named)
    )
    # Which of a relation's anchors the draft has: by rows, an anchor of a relation against those of its cohort.
    known = rel.select("cohort", "relation_id", F.explode("__named").alias("anchor")).join(seed_anchors, ["cohort", "anchor"], "left_semi").select(
        "cohort", "relation_id", F.lit(True).alias("__known")).distinct()
    rel = materialised(rel.join(known, ["cohort", "relation_id"], "left"), "cohort-relations")
    override = yes(F.col("auto_link_guard_override_reason") == ANCHOR_OVERRIDE)
    blank, off = F.lit(False), F.lit(False)
    for field, expected in VERSIONS.items():
        empty = strip_text(F.coalesce(F.col(field), F.lit(""))) == ""
        blank, off = blank | empty, off | (~empty & (F.col(field) != expected))
    valid = approved() & F.col("__a").isNotNull() & F.col("__b").isNotNull()
    shared = F.array_intersect(F.coalesce("__sa", none), F.coalesce("__sb", none))
    strong = F.exists(shared, lambda x: yes(x.startswith(STRONG_ANCHOR_PREFIX)))
    coverage = F.col("information_coverage")
    low = coverage < MIN_COVERAGE
    # The guard again, on supported anchors: what it would decide, and the reason for an override it would give.
    passes = coverage.isNotNull() & (~low | strong)
    gives = F.when(low & strong, F.lit(ANCHOR_OVERRIDE))
    checks = {
        "invalid_context_override": valid & override & (F.size("__named") == 0),
        "context_anchor_mismatch": valid & override & (F.size("__named") > 0) & F.col("__known").isNull(),
        "override_versions": valid & override & F.col("__known").isNotNull() & blank,
        "override_other_versions": valid & override & F.col("__known").isNotNull() & ~blank & off,
        "invalid_matcher_relations": ~valid,
        "versions": blank, "other_versions": ~blank & off,
        "unsupported_context_anchors": F.size(F.array_except("__named", shared)) > 0,
        "invalid_matcher_policy": ~yes(passes) | ~gives.eqNullSafe(F.col("auto_link_guard_override_reason")),
    }
    per_edge = rel.groupBy("cohort").agg(*[F.count_if(test).alias(n) for n, test in checks.items()])
    good = rel.filter(valid)
    touched = good.select("cohort", F.explode(F.array("source_id", "target_id")).alias("signal_id")).distinct()
    uncovered = members.join(touched, ["cohort", "signal_id"], "left_anti").groupBy("cohort").agg(F.count("*").alias("uncovered"))
    labels = cohorts(good.select("source_id", "target_id", "shared_event_context_anchors"))
    parts = members.join(labels.withColumnRenamed("cohort", "component"), "signal_id").groupBy("cohort").agg(F.count_distinct("component").alias("parts"))
    # The draft again, of stored rows alone.
    rolled = cohort_rollup(good.drop("cohort"), members)
    rebuilt = cohort_seed(members, rolled, signals)
    fields = [*SEED_FIELDS, *SEED_SOURCES]
    again = rebuilt.select("cohort", F.struct(*fields).alias("__new"), F.col("error").alias("__error"))
    reviewed = seeds.select("cohort", F.struct(*[F.col(c) if c in seeds.columns else F.lit(None).alias(c) for c in fields]).alias("__old"))
    drafts = again.join(reviewed, "cohort").withColumn("__seed_fields", differing(fields, "__new", "__old"))
    base = facts.join(drafts, "cohort", "left")
    held_fields = [c for c in SEED_FIELDS if c in events.columns]
    lacking = [c for c in SEED_FIELDS if c not in events.columns]
    existing = events.select("event_code", F.col("event_id").alias("__event"), F.struct(*held_fields, *[c for c in REVIEW_FIELDS if c in events.columns]).alias("__stored"))
    base = base.join(existing, "event_code", "left")
    review = F.array_compact(F.array(*[F.when(F.col(f"__stored.{c}").isNotNull(), F.lit(c)) if c in events.columns else F.lit(c) for c in REVIEW_FIELDS]))
    always = F.array(*[F.lit(c) for c in lacking]) if lacking else none
    base = base.withColumn("__event_fields", F.array_sort(F.concat(differing(held_fields, "__new", "__stored"), review, always)))
    # Memberships of the signals anywhere, and of the event with anyone.
    wanted = members.join(base.select("cohort", "__event"), "cohort")
    links = wanted.join(memberships, "signal_id").groupBy("cohort").agg(
        F.count_if(F.col("match_decision").isin(MANUAL_DECISIONS) | F.col("linked_by").isNotNull()).alias("manual"),
        F.count_if(~F.col("event_id").eqNullSafe(F.col("__event"))).alias("other_event"),
    )
    targets = base.filter(F.col("__event").isNotNull()).select("cohort", F.col("__event").alias("event_id"), "event_code", "__new.signal_count", "__new.relation_count", "__new.seed_relation_id")
    insiders = members.select("cohort", "signal_id", F.lit(True).alias("__planned"))
    present = targets.join(memberships, "event_id").withColumn("__plan", membership_rationale())
    wrong = F.lit(False)
    for name, value in MEMBERSHIP.items():
        wrong = wrong | (~F.col(name).eqNullSafe(F.lit(value)) if name in memberships.columns else F.lit(True))
    # Maps have no equality; their sorted entries have.
    entries = lambda c: F.array_sort(F.map_entries(c))
    wrong = wrong | (~entries("rationale").eqNullSafe(entries("__plan")) if "rationale" in memberships.columns else F.lit(True))
    held = present.join(insiders, ["cohort", "signal_id"], "left").groupBy("cohort").agg(
        F.count_if(F.col("match_decision").isin(MANUAL_DECISIONS) | F.col("linked_by").isNotNull()).alias("event_manual"),
        F.count_if(wrong | F.col("__planned").isNull()).alias("wrong_members"), F.count_distinct(F.when(F.col("__planned"), F.col("signal_id"))).alias("already"),
    )
    sizes = members.groupBy("cohort").agg(F.count_distinct("signal_id").alias("size"))
    out = base
    for part in (missing, lost, per_edge, uncovered, parts, links, held, sizes):
        out = out.join(part, "cohort", "left")
    some = lambda c: yes(F.col(c) > 0)
    exists = F.col("__event").isNotNull()
    reason = F.when(some("missing_signals"), "signals_missing_stale_or_ineligible").when(some("missing_relations"), "relations_missing_or_foreign")
    for name, shown in (
        ("invalid_context_override", None), ("context_anchor_mismatch", None), ("override_versions", "invalid_context_versions"), ("override_other_versions", "incompatible_context_versions"),
        ("invalid_matcher_relations", None), ("uncovered", "uncovered_cohort_signals"), ("versions", "invalid_context_versions"), ("other_versions", "incompatible_context_versions"),
    ):
        reason = reason.when(some(name), shown or name)
    reason = (
        reason.when(yes(F.col("__error") == "endpoint_outside_cohort"), "incomplete_seed_signals").when(F.col("__error").isNotNull(), "invalid_persisted_event_seed")
        .when(F.col("__new").isNull() | yes(F.size("__seed_fields") > 0), "event_seed_mismatch")
        .when(some("unsupported_context_anchors"), "unsupported_context_anchors").when(some("invalid_matcher_policy"), "invalid_matcher_policy")
        .when(yes(F.col("parts") > 1), "multiple_event_creation_cohorts").when(some("manual") | some("event_manual"), "manual_membership_conflict")
        .when(some("other_event"), "other_event_membership_conflict")
        .when(exists & ~yes(F.col("__stored.lifecycle_status").isin(OPEN_LIFECYCLES)), "event_lifecycle_blocked")
        .when(exists & (F.size("__event_fields") > 0), "existing_event_mismatch")
        .when(exists & (some("wrong_members") | (F.coalesce("already", F.lit(0)) != F.col("size"))), "existing_membership_mismatch")
    )
    out = out.withColumn("reason", reason)
    status = F.when(F.col("reason").isNotNull(), "blocked").when(exists, "already_exists").otherwise("ready_to_create")
    shown = F.when(F.col("reason") == "event_seed_mismatch", F.col("__seed_fields")).when(F.col("reason") == "existing_event_mismatch", F.col("__event_fields"))
    return out.select("cohort", "event_code", F.col("__event").alias("event_id"), status.alias("status"), "reason", F.coalesce(shown, none).alias("mismatched_fields"))


def create_events(valid: DataFrame, seeds: DataFrame, members: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new event rows, their memberships).  Codes already stored are skipped, so a replay adds nothing."""
    ready = valid.filter("status = 'ready_to_create'").select("cohort").join(seeds, "cohort").join(events.select("event_code"), "event_code", "left_anti")
    rows = ready.withColumn("event_id", uuid5(F.col("event_code"))).withColumns({c: F.lit(None).cast("string") for c in REVIEW_FIELDS})
    links = rows.select("cohort", "event_id", "event_code", "seed_relation_id", "signal_count", "relation_count").join(members.select("cohort", "signal_id").distinct(), "cohort")
    kinds = {"match_score": "decimal(4,3)"}
    held = [F.lit(v).cast(kinds.get(c, "string")).alias(c) for c, v in MEMBERSHIP.items()]
    return rows, links.select("event_id", "signal_id", *held, membership_rationale().alias("rationale"))


def creation_sources(rows: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(event_id, relation_id, versions)``: the relations each new event rests on, one audit row each."""
    kept = cohort_members(edges, labels).select("cohort", "relation_id", *VERSIONS).distinct()
    return rows.select("event_id", "cohort").join(kept, "cohort").drop("cohort")


def plan_summary(plans: DataFrame) -> DataFrame:
    return plans.groupBy("status", "reason").agg(F.count("*").alias("n"))
