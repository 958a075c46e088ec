"""Jaccard self-join of word shingle sets by parity sketches, and its connected components.

A set is hashed into P parts; a part's sketch is the XOR of the 64-bit hashes of its shingles, so equal parts
have equal sketches and the number of differing parts is a lower bound of the symmetric difference. Sets are
handled in bands of similar size. In a band, similar sets differ in at most d parts (d follows from the
threshold and the largest size), so by the pigeonhole principle a common part is among the first d + 1 non-empty
parts of both, in any common order; the order used puts parts of many rare shingles first, which seldom agree by
chance. Common shingles are those held by one in ``COMMON`` of all shingles or more (at most ``COMMON`` of them). A set also stands in the band of the largest partner it can have. P is chosen so that fewer than d + 1
filled parts have a chance below ``MISS`` (the union bound over bins), of the order of a hash collision; small
sets get one part per shingle that way.

Sets that share a sketch are candidates. Every member of a group is first compared with the smallest and with the
largest id of it. Then only members that are still in different components matter. Groups of up to ``FEW`` members
list those pairs. In larger ones the members meet in blocks of ``BLOCK``, inside a task, by bit sketches (parities
of the shingles over ``BITS`` bits per allowed difference): the Hamming distance is a lower bound of the symmetric
difference, and only pairs within the allowed one are listed, at first no more than join the components, in a
second round all that are left. No group's pairs are ever listed whole. Every listed pair is compared exactly on
the shingle hashes. Copies (equal sets) are linked by a 128-bit digest and one of them per task takes part.

Defined cases: null, empty or word-less texts have an empty set and link with nothing; a text shorter than a
shingle is one shingle; a null doc_id is kept with a null component; rows that share a doc_id are one document;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sentinelweave.llm.common import buffers, components, discard, free_names, grouped_order, mix, shingles, small_batches, stored, word_hashes

#: Words of a shingle, and the Jaccard similarity in hundredths.
WORDS, HUNDREDTHS = 5, 80
#: Ratio of neighbouring band limits; it exceeds 1 / similarity, so a pair lies in one band or two neighbours.
BAND_RATIO = 1.35
#: Chance that a set fills too few parts of its band.
MISS = 1e-12
#: A shingle is common if it makes up at least one in so many of all shingles of all sets.
COMMON = 500_000
#: Texts of a batch that must hold a shingle for it to be counted.
COUNTED_FROM = 3
#: Members of a group whose pairs are listed directly; members of a block of a larger group.
FEW, BLOCK = 12, 4096
#: Bits of a parity sketch per allowed difference: in the mean, sets up to 1.07 times the allowed differences apart stay below the bound.
BITS = 16
#: Ids that may be sent to all executors (8 bytes each) instead of shuffling texts.
SENT_IDS = 500_000


def most_different(sizes: int, hundredths: int) -> int:
    """Largest symmetric difference of two similar sets whose sizes add up to ``sizes``."""
    return sizes * (100 - hundredths) // (100 + hundredths)


def bands(largest: int, hundredths: int) -> list[tuple[int, int, int]]:
    """(upper size, d, P) of every band up to size ``largest``; the lower size is the previous upper one plus 1."""
    out, low = [], 1
    ratio = max(BAND_RATIO, 100 / hundredths * 1.05)
    while low <= largest:
        high = max(low, int(low * ratio) - 1)
        d = most_different(2 * high, hundredths)
        least = max(1, -(-low * hundredths // 100))
        parts = 2 * d + 1
        if d:
            miss = lambda p: math.lgamma(p + 1) - math.lgamma(d + 1) - math.lgamma(p - d + 1) + least * math.log(d / p)
            while miss(parts) > math.log(MISS) and parts < 1 << 40:
                parts = int(parts * 1.1) + 1
        out.append((high, d, parts))
        low = high + 1
    return out


def sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, bounds): ascending per text."""
    hashes, _, _, bounds = word_hashes(data, offsets)
    value, text = shingles(hashes, bounds, words)
    order = grouped_order(value, text)
    value, text = value[order], text[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[keep], text[keep]
    return value, np.searchsorted(text, np.arange(len(offsets)))


def digests(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for salt in (0x1234567, 0x89ABCDEF01):
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(salt)), dtype=np.uint64)]
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def sketch_keys(value: np.ndarray, bounds: np.ndarray, hundredths: int, wanted: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, text number) of the indexed parts of every wanted text; ``common`` shingles ascend."""
    size = np.diff(bounds)
    limits = bands(int(size.max(initial=0) * 100 // hundredths) + 1, hundredths)
    high = np.array([b[0] for b in limits])
    own = np.searchsorted(high, size)
    reach = np.searchsorted(high, size * 100 // hundredths)
    keys, texts = [], []
    rare = np.ones(len(value), np.int64)
    if len(common):
        rare -= common[np.minimum(np.searchsorted(common, value), len(common) - 1)] == value
    for band in np.unique(np.r_[own[wanted], reach[wanted]]).tolist():
        _, d, parts = limits[band]
        docs = np.flatnonzero(wanted & (size > 0) & ((own == band) | (reach == band)))
        if not len(docs):
            continue
        count = size[docs]
        doc = np.repeat(np.arange(len(docs)), count)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(bounds[docs], count)
        element = value[place]
        salt = mix(np.full(1, band + 1, np.uint64))
        part = mix(element ^ np.uint64(0xA5A5)) % np.uint64(parts)
        order = grouped_order(part, doc)
        doc, part, element, place = doc[order], part[order], element[order], place[order]
        head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])])
        sketch = np.bitwise_xor.reduceat(mix(element), head)
        filled = np.add.reduceat(rare[place], head)
        key = (mix(sketch + mix(part[head] ^ salt) + filled.astype(np.uint64)) & ~np.uint64(255)) | np.uint64(band)
        doc = doc[head]
        most = int(filled.max())
        order = grouped_order(key, doc * (most + 1) + most - filled)
        doc, key = doc[order], key[order]
        start = np.searchsorted(doc, np.arange(len(docs)))
        first = np.arange(len(doc)) - start[doc] <= d
        keys.append(key[first])
        texts.append(docs[doc[first]])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(texts)


def set_facts(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, n, d1, d2, often)``: size and digest of every row's set; the first row of a batch lists the
    shingles that ``COUNTED_FROM`` or more of the batch's sets hold, with their number."""
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("shingle", pa.int64()), ("n", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, bounds = sets(*buffers(batch.column(1)), words)
            d1, d2 = digests(value, bounds)
            slot = value & np.uint64((1 << 20) - 1)
            seen, times = np.unique(value[np.bincount(slot.astype(np.int64), minlength=1 << 20)[slot] >= COUNTED_FROM], return_counts=True)
            seen, times = seen[times >= COUNTED_FROM], times[times >= COUNTED_FROM]
            ends = np.full(len(d1) + 1, len(seen), np.int32)
            ends[0] = 0
            often = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(seen.view(np.int64)), pa.array(times)], names=["shingle", "n"])).cast(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(d1), pa.array(d2), often], names=["doc_id", "n", "d1", "d2", "often"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, n long, d1 long, d2 long, often array<struct<shingle:long,n:long>>")


def common_shingles(facts: DataFrame) -> np.ndarray:
    """The common shingles, ascending: at most ``COMMON`` numbers."""
    total = facts.agg(F.sum("n")).first()[0] or 0
    counts = facts.select(F.explode("often").alias("o")).groupBy("o.shingle").agg(F.sum("o.n").alias("n"))
    rows = counts.filter(F.col("n") * COMMON >= total).select("shingle").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def sketch_rows(docs: DataFrame, words: int, hundredths: int, common: np.ndarray) -> DataFrame:
    """``(key, doc_id)``: the indexed parts of all documents, of equal sets in one task those of the first."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids = batch.column(0)
            value, bounds = sets(*buffers(batch.column(1)), words)
            wanted = np.array(ids.is_valid())
            for i, pair in enumerate(zip(*(d.tolist() for d in digests(value, bounds)))):
                if pair in seen:
                    wanted[i] = False
                elif wanted[i]:
                    seen.add(pair)
            key, text = sketch_keys(value, bounds, hundredths, wanted, shared.value)
            number = ids.fill_null(0).to_numpy()[text]
            for i in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 100_000].view(np.int64)), pa.array(number[i : i + 100_000])], names=["key", "doc_id"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "key long, doc_id long")


def shared_keys(rows: DataFrame) -> DataFrame:
    """``(key, doc_id, low, high)`` of the keys that two documents have: one shuffle serves both uses."""
    spread = rows.repartition("key")
    groups = spread.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    return spread.join(groups, "key")


def parities(value: np.ndarray, bounds: np.ndarray, hundredths: int) -> Iterator[tuple[int, int, bytes]]:
    """(text number, band, parity sketch) of every non-empty set: one or two bands each, its own first."""
    size = np.diff(bounds)
    limits = bands(int(size.max(initial=0) * 100 // hundredths) + 1, hundredths)
    high = np.array([x[0] for x in limits])
    for i in np.flatnonzero(size).tolist():
        element = mix(value[bounds[i] : bounds[i + 1]] ^ np.uint64(0x5A5A))
        for band in sorted({int(np.searchsorted(high, size[i])), int(np.searchsorted(high, size[i] * 100 // hundredths))}):
            length = 64 * (1 + limits[band][1] * BITS // 64)
            odd = np.bincount((element % np.uint64(length)).astype(np.int64), minlength=length) & 1
            yield i, band, np.packbits(odd.astype(np.uint8)).tobytes()


def similar(pairs: DataFrame, docs: DataFrame, words: int, hundredths: int) -> DataFrame:
    """The pairs ``(u, v)`` whose sets are similar, stored: parity sketches meet first, then the sets of the pairs
    within the allowed Hamming distance are compared exactly."""
    ids = stored(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct(), "ids")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, bounds = sets(*buffers(batch.column(1)), words)
            blobs = [value[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            own, near, far = [None] * len(blobs), [None] * len(blobs), [None] * len(blobs)
            for i, band, bits in parities(value, bounds, hundredths):
                if near[i] is None:
                    own[i], near[i] = band, bits
                else:
                    far[i] = bits
            columns = [pa.array(np.diff(bounds)), pa.array(own, pa.int64()), pa.array(near, pa.binary()), pa.array(far, pa.binary()), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n", "own", "near", "far", "s"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for r in batch.to_pylist():
                # A similar pair meets in the band of its larger set.
                band = max(r["own_u"], r["own_v"])
                a, b = (r["near_" + x] if r["own_" + x] == band else r["far_" + x] for x in "uv")
                if a is None or b is None or len(a) != len(b):
                    keep.append(False)
                    continue
                apart = int(np.bitwise_count(np.frombuffer(a, np.uint64) ^ np.frombuffer(b, np.uint64)).sum())
                keep.append(apart <= most_different(r["n_u"] + r["n_v"], hundredths))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both > 0 and 100 * both >= hundredths * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    facts = stored(texts_of(docs, ids).mapInArrow(gather, "doc_id long, n long, own long, near binary, far binary, s binary"), "sets")
    sketch = lambda x: facts.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "own", "near", "far")])
    met = stored(pairs.join(sketch("u"), "u").join(sketch("v"), "v").filter("own_u is not null and own_v is not null").mapInArrow(close, "u long, v long"), "close")
    side = lambda a, b: facts.select(F.col("doc_id").alias(a), F.col("s").alias(b))
    links = stored(met.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(compare, "u long, v long"), "links")
    for table in (facts, met, ids):
        discard(table)
    return links


def bit_sketches(docs: DataFrame, ids: DataFrame, words: int, hundredths: int) -> DataFrame:
    """``(doc_id, band, n, bits)``: parity sketches of the documents ``ids`` for every band they stand in."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, bounds = sets(*buffers(batch.column(1)), words)
            size = np.diff(bounds)
            rows = [(i, band, int(size[i]), bits) for i, band, bits in parities(value, bounds, hundredths)]
            which = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), *[pa.array([r[c] for r in rows], t) for c, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.binary()))]], names=["doc_id", "band", "n", "bits"])

    return texts_of(docs, ids).mapInArrow(work, "doc_id long, band long, n long, bits binary")


def close_pairs(mixed: DataFrame, sketches: DataFrame, hundredths: int, joining: bool) -> DataFrame:
    """Pairs ``(u, v)`` of ``mixed(key, doc_id, root, members)`` across components within the allowed Hamming distance;
    ``joining``: of each block only as many as connect what they can."""
    def compare(table: pa.Table) -> pa.Table:
        ids, root, n = (table.column(c).to_numpy() for c in ("doc_id", "root", "n"))
        m = len(ids)
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(m, -1)
        names, part = np.unique(root, return_inverse=True)
        group = np.arange(len(names))
        us, vs = [], []
        for i in range(m - 1):
            other = np.flatnonzero(group[part[i + 1 :]] != group[part[i]] if joining else part[i + 1 :] != part[i]) + i + 1
            if not len(other):
                continue
            allowed = (n[other] + n[i]) * (100 - hundredths) // (100 + hundredths)
            for j in other[np.bitwise_count(bits[other] ^ bits[i]).sum(1) <= allowed].tolist():
                if joining:
                    if group[part[j]] == group[part[i]]:
                        continue
                    group[group == group[part[j]]] = group[part[i]]
                us.append(ids[i])
                vs.append(ids[j])
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    dealt = mixed.withColumn("band", F.col("key").bitwiseAND(F.lit(255))).join(sketches, ["doc_id", "band"]).withColumn("own", own)
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    return met.select("key", "low", "high", "doc_id", "root", "n", "bits").groupBy("key", "low", "high").applyInArrow(compare, "u long, v long")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of the documents ``ids``: sent to all executors if they are few, else joined by a shuffle."""
    small_batches(docs.sparkSession)
    few = ids.count() <= SENT_IDS
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def near_copies(docs: DataFrame, words: int = WORDS, hundredths: int = HUNDREDTHS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row: the smallest doc_id reachable by links."""
    facts = stored(set_facts(docs, words), "facts")
    known = facts.filter("doc_id is not null and n > 0")
    copies = known.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("u"), F.max("doc_id").alias("__hi")).filter("u < __hi").drop("__hi")
    links = [stored(known.join(copies, ["d1", "d2", "n"]).filter("doc_id <> u").select("u", F.col("doc_id").alias("v")).distinct(), "copies")]
    members = stored(shared_keys(sketch_rows(docs, words, hundredths, common_shingles(facts))), "members")
    side = lambda a: known.select(F.col("doc_id").alias(a), *[F.col(c).alias(f"{c}_{a}") for c in ("n", "d1", "d2")])
    possible = (
        (F.col("n_u") * 100 >= F.col("n_v") * hundredths) & (F.col("n_v") * 100 >= F.col("n_u") * hundredths)
        & ~((F.col("n_u") == F.col("n_v")) & (F.col("d1_u") == F.col("d1_v")) & (F.col("d2_u") == F.col("d2_v")))
    )

    def test(pairs: DataFrame) -> None:
        ordered = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct()
        sized = ordered.join(side("u"), "u").join(side("v"), "v").filter(possible).select("u", "v").distinct()
        links.append(similar(stored(sized, "pairs"), docs, words, hundredths))

    def roots() -> DataFrame:
        return components(reduce(DataFrame.unionByName, links))

    def apart(rows: DataFrame, root: DataFrame) -> DataFrame:
        """``(key, doc_id, root, members)`` of the groups in which different components are left."""
        known_roots = root.select(F.col("node").alias("doc_id"), "root")
        known_roots = F.broadcast(known_roots) if root.count() <= SENT_IDS else known_roots
        placed = rows.select("key", "doc_id").join(known_roots, "doc_id", "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root")).repartition("key")
        # Every column is used, so that both sides of the join read one shuffle.
        split = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("doc_id").alias("members"), F.max("doc_id").alias("c")).filter("a < b and c is not null").select("key", "members")
        return stored(placed.join(split, "key"), "mixed")

    test(members.select(F.col("low").alias("u"), F.col("doc_id").alias("v")).union(members.select(F.col("doc_id").alias("u"), F.col("high").alias("v"))))
    root = roots()
    mixed = apart(members, root)
    few = mixed.filter(F.col("members") <= FEW)
    other = few.select("key", F.col("doc_id").alias("v"), F.col("root").alias("root_v"))
    listed = few.withColumnRenamed("doc_id", "u").join(other, "key").filter("u < v and root <> root_v").select("u", "v")
    many = mixed.filter(F.col("members") > FEW)
    crowded = not many.isEmpty()
    if crowded:
        sketches = stored(bit_sketches(docs, stored(many.select("doc_id").distinct(), "ids"), words, hundredths), "bits")
        listed = listed.union(close_pairs(many, sketches, hundredths, joining=True))
    test(listed)
    root = roots()
    if crowded:
        left = apart(many, root)
        test(close_pairs(left, sketches, hundredths, joining=False))
        root = roots()
        discard(left)
        discard(sketches)
    discard(mixed)
    discard(members)
    return facts.join(root.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def one_per_group(docs: DataFrame, words: int = WORDS, hundredths: int = HUNDREDTHS) -> DataFrame:
    """``docs`` without the documents that are not the smallest id of their component.

    Rows that share a doc_id are one document and stay or go together; null ids stay.
    """
    (d,) = free_names(docs, "__d")
    gone = near_copies(docs, words, hundredths).filter("component_id <> doc_id").select(F.col("doc_id").alias(d)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(d), "left_anti")
