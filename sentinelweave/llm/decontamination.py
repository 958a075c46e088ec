"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words that a fixed mask keeps of ``SPAN`` consecutive words, so words under the mask's
gaps may be substituted. The seeds of all test items meet those of all documents in a join; a bitmap of fixed
size, built from the items' seeds, spares the join what cannot meet. Hits lie on diagonals (document word minus
item word). A hit is verified on its diagonal: some ``window`` aligned words around it must agree in ``share`` of
all places (the whole item where it is shorter). Windows that pass are merged to leaks.

Documents emit a row per cluster of hits with the words around it only. No step gathers a document's or an
item's hits beyond that cluster.

Defined cases: null or empty texts and items never leak; items below
``SPAN`` words are searched whole, by a seed for every choice of words that may differ; a null
doc_id or item_id is kept and compared like a value; equal items and repeated rows are reported once each id.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sentinelweave.llm.common import BASE, FOLD, buffers, free_names, mix, small_batches, stored, word_hashes

# Kept (1) and ignored (0) words of a seed. With the fifth, every pattern of substitutions that leaves
# SHARE of 8 to 20 words meets a seed.
MASKS = ["11011001", "10110110", "01101101", "11100011", "10010101"]
SPAN = len(MASKS[0])
#: Aligned words that decide, and the share of them that must agree.
WINDOW, SHARE = 20, 0.8
#: Bits of the bitmap per item seed, and its size in bits at most; a seed sets two bits.
BITS_PER_SEED, MOST_BITS = 1024, 1 << 26
SECOND = 37

SEPARATORS = np.ones(256, bool)
SEPARATORS[128:] = False
SEPARATORS[48:58] = SEPARATORS[65:91] = SEPARATORS[97:123] = False


def short_masks(span: int, share: float) -> list[str]:
    """Masks for whole items of ``span`` words, below ``SPAN``: every choice of the words that may differ is left out once."""
    spare = span - math.ceil(share * span - 1e-9)
    return ["".join("0" if i in gap else "1" for i in range(span)) for gap in itertools.combinations(range(span), min(spare, span))]


def seeds(hashes: np.ndarray, bounds: np.ndarray, span: int = SPAN, masks: list[str] = MASKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, text number, word in the text) for every mask and every place a mask fits."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.searchsorted(bounds, np.arange(n), "right") - 1
    at = np.flatnonzero(np.arange(n) + span <= bounds[text + 1])
    out = []
    for number, mask in enumerate(masks):
        h = np.full(n, (SPAN - span) * 64 + number + 1, np.uint64)
        for i, kept in enumerate(mask):
            if kept == "1":
                h = (h ^ (h >> np.uint64(29))) * np.uint64(BASE) + hashes[i : i + n]
        out.append(mix(h)[at])
    return np.concatenate(out), np.tile(text[at], len(masks)), np.tile(at - bounds[text[at]], len(masks))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    hashes, _, _, bounds = word_hashes(*buffers(column), SEPARATORS, FOLD)
    return hashes, bounds


def all_seeds(hashes: np.ndarray, bounds: np.ndarray, spans: Iterable[int], share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The seeds of ``SPAN`` words and those of the shorter ``spans``."""
    found = [seeds(hashes, bounds), *[seeds(hashes, bounds, n, short_masks(n, share)) for n in spans]]
    return tuple(np.concatenate(part) for part in zip(*found))


def item_seeds(items: DataFrame, share: float = SHARE) -> DataFrame:
    """``(seed, item_id, item_at)`` of all items; one below ``SPAN`` words has the seeds of its own length only."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bounds = tokens(batch.column(1))
            sizes = np.diff(bounds)
            found = [seeds(hashes, bounds)]
            for n in np.unique(sizes[(sizes > 0) & (sizes < SPAN)]).tolist():
                short = seeds(hashes, bounds, n, short_masks(n, share))
                whole = sizes[short[1]] == n
                found.append(tuple(part[whole] for part in short))
            seed, text, at = (np.concatenate(part) for part in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), batch.column(0).take(pa.array(text)), pa.array(at)], names=["seed", "item_id", "item_at"])

    return items.select("item_id", "text").mapInArrow(work, "seed long, item_id long, item_at long").distinct()


def item_words(items: DataFrame) -> DataFrame:
    """``(item_id, item_words)``: the word hashes of every item."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bounds = tokens(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], names=["item_id", "item_words"])

    return items.select("item_id", "text").mapInArrow(work, "item_id long, item_words binary").distinct()


def bitmap(found: DataFrame) -> np.ndarray:
    """Two bits set for every value of column ``seed``; at most ``MOST_BITS`` bits (8 MB) whatever their number."""
    bits = 64
    while bits < min(MOST_BITS, found.count() * BITS_PER_SEED):
        bits *= 2
    places = found.selectExpr(f"explode(array(seed & {bits - 1}L, shiftrightunsigned(seed, {SECOND}) & {bits - 1}L)) as p")
    words = places.selectExpr("shiftright(p, 6) as w", "shiftleft(1L, cast(p & 63 as int)) as b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values may have been put into ``bits``."""
    limit = np.uint64(len(bits) * 64 - 1)
    found = np.ones(len(values), bool)
    for place in (values & limit, (values >> np.uint64(SECOND)) & limit):
        found &= ((bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
    return found


def hit_spans(docs: DataFrame, bits: np.ndarray, reach: int = WINDOW, spans: Iterable[int] = (), share: float = SHARE) -> DataFrame:
    """``(doc_id, h, start, words, hits)``: words around every cluster of seeds that the bitmap passes; ``spans``: lengths of short items."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit_type = pa.list_(pa.struct([("at", pa.int64()), ("seed", pa.int64())]))
        for batch in batches:
            hashes, bounds = tokens(batch.column(2))
            seed, text, at = all_seeds(hashes, bounds, spans, share)
            hit = np.flatnonzero(passes(shared.value, seed))
            hit = hit[np.lexsort((at[hit], text[hit]))]
            seed, text, at = seed[hit].view(np.int64), text[hit], at[hit]
            head = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (at[1:] > at[:-1] + 2 * reach)]) if len(hit) else np.zeros(0, np.int64)
            tail = np.r_[head[1:], len(hit)][: len(head)]
            first = np.maximum(0, at[head] - reach)
            last = np.minimum(np.diff(bounds)[text[head]], at[tail - 1] + SPAN + reach) if len(head) else head
            blobs = [hashes[b + a : b + z].tobytes() for a, z, b in zip(first, last, bounds[text[head]])]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[head, len(hit)].astype(np.int32) if len(head) else np.zeros(1, np.int32)), pa.StructArray.from_arrays([pa.array(at), pa.array(seed)], names=["at", "seed"])).cast(hit_type)
            which = pa.array(text[head])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(first), pa.array(blobs, pa.binary()), lists], names=["doc_id", "h", "start", "words", "hits"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(work, "doc_id long, h long, start long, words binary, hits array<struct<at:long,seed:long>>")


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, hits: np.ndarray, window: int, share: float) -> tuple[int, int, int] | None:
    """(first document word, words, agreeing words) of the merged windows around ``hits`` that pass, else None."""
    low, high = max(0, diagonal), min(len(doc), len(item) + diagonal)
    need = min(window, len(item))
    if high - low < need:
        return None
    agree = doc[low:high] == item[low - diagonal : high - diagonal]
    sums = np.r_[0, np.cumsum(agree)]
    passed = sums[need:] - sums[:-need] >= np.ceil(share * need - 1e-9)
    start = np.arange(len(passed)) + low
    near = np.zeros(len(passed), bool)
    for at in hits:
        near |= (start <= at) & (at + min(SPAN, need) <= start + need)
    good = start[passed & near]
    if not len(good):
        return None
    a, z = int(good[0]), int(good[-1]) + need
    return a, z - a, int(sums[z - low] - sums[a - low])


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """``(doc_id, h, item_id, start_word, n_words, n_equal)``: every leak of an item into a document."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = stored(item_seeds(items, share), "item-seeds")
    # At most SPAN - 1 rows: the lengths of short items that occur.
    short = [r.n for r in item_words(items).select((F.length("item_words") / 8).cast("int").alias("n")).filter(f"n between 1 and {SPAN - 1}").distinct().collect()]
    spans = stored(hit_spans(docs, bitmap(found), window, short, share), "spans")
    hits = spans.select("doc_id", "h", "start", F.explode("hits").alias("hit")).select("doc_id", "h", "start", "hit.*").distinct()
    met = hits.join(found, "seed").select("doc_id", "h", "start", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal"), "at").distinct()
    lines = met.groupBy("doc_id", "h", "start", "item_id", "diagonal").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    words = spans.select("doc_id", "h", "start", "words").distinct()
    keyed = lines.join(words.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("start").alias("s"), "words"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")) & (F.col("start") == F.col("s")))
    texts = item_words(items).select(F.col("item_id").alias("i"), "item_words")
    full = keyed.join(texts, F.col("item_id").eqNullSafe(F.col("i"))).select("doc_id", "h", "item_id", "start", "diagonal", "ats", "words", "item_words")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (start, diagonal, ats, doc, item) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3, 8)))):
                got = overlap(np.frombuffer(doc, np.uint64), np.frombuffer(item, np.uint64), diagonal - start, np.array(ats) - start, window, share)
                if got:
                    rows.append((i, got[0] + start, got[1], got[2]))
            which = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(which) for c in range(3)], *[pa.array([r[c] for r in rows], pa.int64()) for c in (1, 2, 3)]], names=["doc_id", "h", "item_id", "start_word", "n_words", "n_equal"])

    return full.mapInArrow(verify, "doc_id long, h long, item_id long, start_word long, n_words long, n_equal long")


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, n_places, n_words, n_equal)``: the longest overlap of every document and item that meet."""
    best = F.max(F.struct("n_equal", "n_words"))
    out = leaks(docs, items).groupBy("doc_id", "item_id").agg(F.count_distinct("start_word").alias("n_places"), best.alias("b"))
    return out.select("doc_id", "item_id", "n_places", F.col("b.n_words").alias("n_words"), F.col("b.n_equal").alias("n_equal"))


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents into which no item leaks, all columns kept."""
    d, h = free_names(docs, "__d", "__h")
    bad = leaks(docs, items).select(F.col("doc_id").alias(d), F.col("h").alias(h)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(h)), "left_anti")
