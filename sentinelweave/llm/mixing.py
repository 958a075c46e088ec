"""Mixing sources to target weights by entropy balancing.

``targets`` shares all words over the sources by weight, stops a source at ``most`` times its own words and
reshares the excess (water filling over the ordered table of sources).

``balanced_rates`` finds document rates r that change the corpus least (word-weighted entropy, sum of
size * (r ln r - r + 1)) while every group of every margin reaches its words. The convex dual has one multiplier
per group, and the solution is the exponential tilt r = exp(sum of the document's multipliers). A Newton step of
one margin needs, per group, the tilted words only: gradient target - words, curvature words. Documents are
pre-aggregated to cells (one per combination of groups), so a step is a grouped sum, combined map-side.

``copies`` rounds rates to whole copies: documents of a source stand in descending size classes, place i takes
floor(r i + 1/2) - floor(r (i - 1) + 1/2) copies, and the words then still missing or surplus are settled with
single copies of a bounded set of candidates per source and size class.

Everything is DataFrame operations. Hot sources are split by salt before any window.

Defined cases: null or empty texts have size 0 and are taken zero words; a null source is a source of its own,
ordered last; an empty table gives an empty mix; repeated rows are separate documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from sentinelweave.llm.common import free_names, stored

# Weights of the sources in code point order, repeating.
WEIGHTS = [5.0, 2.0, 1.0]
#: A source's target and a document's copies stop at this multiple.
MOST = 3
#: Words with separators as in [^\x20\x09-\x0D]+.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Relative gap at which the Newton iterations stop, and their bound.
GAP, ROUNDS = 1e-10, 60
#: Rows of one salted chunk of a source's size class, about.
CHUNK_ROWS = 100_000
#: Documents per source and size class that may settle the rest of a source, each way.
SETTLERS = 3


def sized(docs: DataFrame) -> DataFrame:
    """Documents with ``size``: the words of the whole text."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sources: DataFrame, weights: list[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``: one row per source passes a window."""
    line = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(line) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("w", w).withColumn("ceiling", F.col("source_size") * F.lit(float(most)))
    # The sources that stop first have the least ceiling per weight; level: what a unit of weight gets if this and all later ones do not stop.
    order = Window.orderBy(F.col("ceiling") / F.col("w"), F.asc_nulls_last("source"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.withColumn("all", F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    filled = filled.withColumn("level", (F.col("all") - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    free = F.col("level") * F.col("w") <= F.col("ceiling")
    ratio = F.col("ceiling") / F.col("w")
    first = F.min(F.when(free, F.struct(ratio.alias("ratio"), F.col("level").alias("level")))).over(everything)
    target = F.when(first.isNull() | (ratio < first["ratio"]), F.col("ceiling")).otherwise(F.least(first["level"] * F.col("w"), F.col("ceiling")))
    return filled.select("source", "source_size", target.alias("target"))


def balanced_rates(cells: DataFrame, margins: dict[str, DataFrame]) -> DataFrame:
    """``cells(groups..., words)`` with ``rate``; ``margins`` maps a group column to ``(group, target)``.

    Groups whose words or target are zero get rate 0. Raises where the margins cannot be met together.
    """
    state = cells
    for m, goal in margins.items():
        joined = goal.select(F.col(m).alias("__g"), F.col("target").alias(f"__t_{m}"))
        state = state.join(joined, F.col(m).eqNullSafe(F.col("__g")), "left").drop("__g")
    reached = F.lit(True)
    for m in margins:
        reached = reached & (F.col(f"__t_{m}") > 0)
    state = stored(state.withColumn("log_rate", F.lit(0.0)).withColumn("__on", F.coalesce(reached & (F.col("words") > 0), F.lit(False))), "cells")
    for _ in range(ROUNDS):
        for m in margins:
            tilted = F.when(F.col("__on"), F.col("words") * F.exp("log_rate"))
            sums = state.groupBy(F.col(m).alias("__g")).agg(F.sum(tilted).alias("__s"))
            step = (F.col(f"__t_{m}") - F.col("__s")) / F.col("__s")
            state = state.join(sums, F.col(m).eqNullSafe(F.col("__g"))).withColumn("log_rate", F.col("log_rate") + F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), step)), F.lit(0.0))).drop("__g", "__s")
        state = stored(state, "cells")
        worst = 0.0
        for m in margins:
            sums = state.filter("__on").groupBy(m).agg(F.sum(F.col("words") * F.exp("log_rate")).alias("s"), F.first(f"__t_{m}").alias("t"))
            worst = max(worst, sums.agg(F.max(F.abs(F.col("s") / F.col("t") - 1))).first()[0] or 0.0)
        if worst <= GAP:
            return state.withColumn("rate", F.when(F.col("__on"), F.exp("log_rate")).otherwise(F.lit(0.0))).drop("log_rate", "__on", *[f"__t_{m}" for m in margins])
    raise RuntimeError(f"the margins were not met: gap {worst}")


def _class(size: Column) -> Column:
    """Size class, four to a doubling, the largest first in ascending order."""
    return (-F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * 4)).cast("int")


def copies(docs: DataFrame, rates: DataFrame, most: int = MOST) -> DataFrame:
    """Rows of ``docs(doc_id, source, size, ...)`` with ``copies``; ``rates(source, rate, target)``."""
    keyed = docs.withColumn("__class", _class(F.col("size"))).withColumn("__h", F.xxhash64("doc_id", "size"))
    counts = keyed.groupBy("source", "__class").agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__salts", F.ceil(F.col("__n") / CHUNK_ROWS).cast("long"))
    chunked = keyed.join(counts.select(F.col("source").alias("__s"), F.col("__class").alias("__c"), "__salts"), F.col("source").eqNullSafe(F.col("__s")) & (F.col("__class") == F.col("__c"))).drop("__s", "__c")
    chunked = chunked.withColumn("__salt", F.pmod(F.shiftright("__h", 20), F.col("__salts")))
    place = Window.partitionBy("source", "__class", "__salt").orderBy("__h", "doc_id", "size")
    chunked = stored(chunked.withColumn("__place", F.row_number().over(place).cast("long")), "chunks")
    # Chunks follow one another: a place in the source is the chunk's offset and the place in the chunk.
    sizes = chunked.groupBy("source", "__class", "__salt").agg(F.count("*").alias("__n"))
    along = Window.partitionBy("source").orderBy("__class", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__offset", F.coalesce(F.sum("__n").over(along), F.lit(0))).join(
        rates.select(F.col("source").alias("__s"), "rate", "target"), F.col("source").eqNullSafe(F.col("__s"))
    ).select(F.col("source").alias("__s"), F.col("__class").alias("__c"), F.col("__salt").alias("__t"), "__offset", "rate", "target")
    placed = chunked.join(offsets, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__class") == F.col("__c")) & (F.col("__salt") == F.col("__t"))).drop("__s", "__c", "__t")
    at = F.col("__offset") + F.col("__place")
    rounded = placed.withColumn("__at", at).withColumn("copies", F.least(F.lit(most), F.floor(F.col("rate") * at + 0.5) - F.floor(F.col("rate") * (at - 1) + 0.5)).cast("long"))
    # What is left of a source is settled by single copies, largest first, of a bounded set of its documents.
    rest = rounded.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("__rest"))
    ways = rounded.filter("size > 0").select("source", "size", "__class", "__at", "__h", F.explode(F.array(*[
        F.when(F.col("copies") < most, F.lit(1)), F.when(F.col("copies") > 0, F.lit(-1))])).alias("__way")).filter("__way is not null")
    few = ways.join(rest.select(F.col("source").alias("__s"), "__rest"), F.col("source").eqNullSafe(F.col("__s"))).filter(
        (F.signum("__rest") == F.col("__way")) & (F.col("size") <= F.abs("__rest"))).groupBy("source", "__class").agg(
        F.first("__rest").alias("__rest"), *[F.min_by(F.struct("size", "__at", "__way"), F.xxhash64("__h", F.lit(i))).alias(f"__c{i}") for i in range(SETTLERS)])
    listed = few.select("source", "__rest", F.explode(F.array_distinct(F.array(*[f"__c{i}" for i in range(SETTLERS)]))).alias("c")).groupBy("source").agg(
        F.first("__rest").alias("__rest"), F.array_sort(F.collect_list(F.struct((-F.col("c.size")).alias("k"), F.col("c.__at").alias("at"), F.col("c.size").alias("size"), F.col("c.__way").alias("way")))).alias("cs"))
    settled = F.aggregate(
        "cs", F.struct(F.col("__rest").alias("rest"), F.array().cast("array<bigint>").alias("used")),
        lambda acc, c: F.when(
            F.abs(acc["rest"]) >= c["size"],
            F.struct((acc["rest"] - c["way"] * c["size"]).alias("rest"), F.concat(acc["used"], F.array(c["at"])).alias("used")),
        ).otherwise(acc),
    )
    used = listed.select(F.col("source").alias("__s"), F.signum("__rest").cast("long").alias("__way"), F.explode(settled["used"]).alias("__u"))
    out = rounded.join(used, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__at") == F.col("__u")), "left")
    return out.withColumn("copies", F.col("copies") + F.coalesce(F.col("__way"), F.lit(0))).drop(*[c for c in out.columns if c.startswith("__")])


def mix(docs: DataFrame, weights: list[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(doc_id, source, size, source_size, target, rate, copies, taken)`` of every document."""
    narrow = stored(sized(docs).select("doc_id", "source", "size"), "sizes")
    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = stored(targets(sources, weights, most), "targets")
    rated = balanced_rates(goals.select("source", F.col("source_size").alias("words")), {"source": goals.select("source", "target")})
    rates = stored(goals.join(rated.select(F.col("source").alias("__s"), "rate"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s"), "rates")
    out = copies(narrow, rates, most)
    sizes = rates.select(F.col("source").alias("__s"), "source_size")
    return out.join(sizes, F.col("source").eqNullSafe(F.col("__s"))).drop("__s").withColumn("taken", F.col("copies") * F.col("size"))


def mixed_copies(docs: DataFrame, weights: list[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` as often as the mix takes them, with ``copy`` from 1 (replacing a column of that name).

    Rows of equal id, source and size share the rounding's copies, the most to the least hash of the text.
    """
    d, s, z, size, n, m, k, own = free_names(docs, "__d", "__s", "__z", "__size", "__n", "__m", "__k", "__own")
    counts = mix(docs, weights, most).filter("copies > 0").select(
        F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(z), F.col("copies").alias(m))
    nth = lambda cols, order: F.row_number().over(Window.partitionBy(*cols).orderBy(order))
    repeated = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    rows = sized(docs.withColumnRenamed("size", own)).withColumnRenamed("size", size).withColumnRenamed(own, "size")
    same = F.col("doc_id").eqNullSafe(F.col(d)) & F.col("source").eqNullSafe(F.col(s)) & (F.col(size) == F.col(z))
    if repeated:
        rows = rows.withColumn(n, nth(["doc_id", "source", size], F.xxhash64("text")))
        counts = counts.withColumn(k, nth([d, s, z], F.col(m).desc()))
        same = same & (F.col(n) == F.col(k))
    taken = rows.join(counts, same)
    return taken.select(*[F.col(c) for c in docs.columns if c != "copy"], F.explode(F.sequence(F.lit(1), F.col(m).cast("int"))).alias("copy"))
