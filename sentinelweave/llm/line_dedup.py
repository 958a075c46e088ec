"""Line deduplication by an exact set-similarity join.

A line is the set of its five-word shingles (a shorter line is one shingle). Its tokens, the shingles, are ordered
by rarity, rarest first: exact counts over batches for those that make up at least one in ``COMMON`` of all (so
there are at most ``COMMON`` of them), the rest before them by hash; any one order gives the right result. Two
lines of Jaccard similarity 0.8 share a token within their prefixes of n - ceil(0.8 n) + 1 tokens. Lines meet by
such a token if their lengths and its positions still allow the overlap (length and positional filters), and the
sets are compared exactly.

A line goes if it matches an earlier line, in the order of doc_id and line number. Equal sets are one node with
one first place. Every node is compared with the earliest node of each of its groups; only nodes that found no
match there meet all earlier members, so a large group of variants costs comparisons linear in its size.

Defined cases: lines without words always stay; a null text has no lines; a null doc_id comes last; rows of equal
id and text are one document; a document of which every line goes is dropped by ``without_repeats``; extra columns
pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sentinelweave.llm.common import buffers, discard, free_names, grouped_order, mix, released, shingles, small_batches, stored, word_hashes
from sentinelweave.llm.decontamination import bitmap, passes
from sentinelweave.llm.near_copies import COMMON, COUNTED_FROM, digests

#: Jaccard similarity in hundredths.
HUNDREDTHS = 80
#: Words of a token.
WORDS = 5
NEWLINE = 10
LAST = 2**63 - 1
#: Tokens are shuffled by this many of their leading bits, in blocks of at least ``BLOCK_ROWS`` rows of a task together.
BUCKET_BITS = 12
BLOCK_ROWS = 500_000
#: Words of a set's parity sketch.
SKETCH = 4
PARITIES = [f"p{i}" for i in range(SKETCH)]


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte bounds of all lines, text number, line number); a line's bytes include its line end."""
    ends = np.flatnonzero(data == NEWLINE)
    text = np.r_[np.arange(len(offsets) - 1), np.searchsorted(offsets, ends, "right") - 1]
    start = np.r_[offsets[:-1], ends + 1]
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    return np.r_[start, offsets[-1]], text, np.arange(len(text)) - np.searchsorted(text, text)


def line_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct token hashes ascending per line, bounds, text number, line number)."""
    limits, text, line = line_bounds(data, offsets)
    hashes, _, _, bounds = word_hashes(data, limits)
    value, owner = shingles(hashes, bounds, WORDS)
    order = grouped_order(value, owner)
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[keep], owner[keep]
    return value, np.searchsorted(owner, np.arange(len(text) + 1)), text, line


def read_texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text")).filter("text is not null")


def line_facts(docs: DataFrame) -> DataFrame:
    """``(doc_id, h, line, n, d1, d2, often)``: size and digest of every line's set; the first line of a batch lists
    the tokens that ``COUNTED_FROM`` or more of the batch's lines hold, with their number."""
    kind = pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, bounds, text, line = line_sets(*buffers(batch.column(2)))
            d1, d2 = digests(value, bounds)
            slot = (value & np.uint64((1 << 20) - 1)).astype(np.int64)
            seen, times = np.unique(value[np.bincount(slot, minlength=1 << 20)[slot] >= COUNTED_FROM], return_counts=True)
            seen, times = seen[times >= COUNTED_FROM], times[times >= COUNTED_FROM]
            ends = np.full(len(d1) + 1, len(seen), np.int32)
            ends[0] = 0
            often = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(seen.view(np.int64)), pa.array(times)], names=["token", "n"])).cast(kind)
            which = pa.array(text)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), *[pa.array(x) for x in (line, np.diff(bounds), d1, d2)], often], names=["doc_id", "h", "line", "n", "d1", "d2", "often"])

    return read_texts(docs).mapInArrow(work, "doc_id long, h long, line long, n long, d1 long, d2 long, often array<struct<token:long,n:long>>")


def common_tokens(facts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(token ascending, count) of the common tokens: at most ``COMMON``."""
    total = facts.agg(F.sum("n")).first()[0] or 0
    counts = facts.select(F.explode("often").alias("o")).groupBy("o.token").agg(F.sum("o.n").alias("n"))
    rows = counts.filter(F.col("n") * COMMON >= total).collect()
    token = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], np.array([r[1] for r in rows], np.int64)[order]


def prefix_blocks(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``(bucket, token, d1, n, at)``: the prefix tokens of every set, of equal sets in one task those of the first, as
    columns of numbers. Rare tokens lie in the bucket of their leading bits, common ones in that of their set's above."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    shift = np.uint64(64 - BUCKET_BITS)

    def block(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        bucket, token, d1, n, at = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(bucket, kind="stable")
        held, first = np.unique(bucket[order], return_index=True)
        ends = np.r_[first, len(order)]
        packed = []
        # Sizes and places take as many bytes as the largest of them needs.
        for data in (token, d1, n.astype(np.min_scalar_type(n.max())), at.astype(np.min_scalar_type(at.max()))):
            data = data[order]
            offsets = pa.py_buffer((ends * data.itemsize).astype(np.int32))
            packed.append(pa.Array.from_buffers(pa.binary(), len(held), [None, offsets, pa.py_buffer(data)]))
        return pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), *packed], names=["bucket", "token", "d1", "n", "at"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, count = shared.value
        level = np.unique(count, return_inverse=True)[1] + 1
        seen: set[int] = set()
        parts, rows = [], 0
        for batch in batches:
            value, bounds, text, _ = line_sets(*buffers(batch.column(2)))
            d1, _ = digests(value, bounds)
            n = np.diff(bounds)
            # Sets of fewer than 4 tokens match equal sets only.
            wanted = n >= 4
            for i in np.flatnonzero(wanted).tolist():
                d = int(d1[i])
                if d in seen:
                    wanted[i] = False
                else:
                    seen.add(d)
            owner = np.repeat(np.arange(len(n)), n)
            use = wanted[owner]
            value, owner = value[use], owner[use]
            weight = np.zeros(len(value), np.int64)
            if len(hot):
                place = np.minimum(np.searchsorted(hot, value), len(hot) - 1)
                weight = np.where(hot[place] == value, level[place], 0)
            if weight.any():
                # Values ascend within a line, so a stable sort by line and weight leaves them in order.
                order = np.argsort(owner * (1 + int(weight.max())) + weight, kind="stable")
                value, owner, weight = value[order], owner[order], weight[order]
            at = np.arange(len(owner)) - np.searchsorted(owner, owner)
            size = n[owner]
            first = at <= size - -(-size * HUNDREDTHS // 100)
            value, owner, weight = value[first], owner[first], weight[first]
            own = d1[owner]
            bucket = np.where(weight > 0, (own.view(np.uint64) >> shift) + np.uint64(1 << BUCKET_BITS), value >> shift).astype(np.int32)
            parts.append((bucket, value, own, size[first], at[first]))
            rows += len(own)
            if rows >= BLOCK_ROWS:
                yield block(parts)
                parts, rows = [], 0
        if rows:
            yield block(parts)

    return read_texts(docs).mapInArrow(work, "bucket int, token binary, d1 binary, n binary, at binary")


def numbers(column: pa.ChunkedArray, beside: pa.ChunkedArray) -> np.ndarray:
    """The numbers of a column of blocks; their bytes follow from the 8-byte numbers ``beside`` them."""
    parts = [np.zeros(0, np.int64)]
    for mine, other in zip(column, beside):
        data, rows = mine.as_buffer(), other.as_buffer().size // 8
        parts.append(np.frombuffer(data, f"u{data.size // rows}").astype(np.int64))
    return np.concatenate(parts)


def shared_tokens(blocks: DataFrame) -> DataFrame:
    """``(token, d1, n, at)``: the distinct rows of :func:`prefix_blocks` whose token several sets have, and the common ones."""
    def work(group: pa.Table) -> pa.Table:
        token, d1 = (buffers(group.column(name))[0].view(kind) for name, kind in (("token", np.uint64), ("d1", np.int64)))
        n, at = (numbers(group.column(name), group.column("token")) for name in ("n", "at"))
        if len(group) and group.column("bucket")[0].as_py() < 1 << BUCKET_BITS:
            order = np.argsort(token)
            token, d1, n, at = token[order], d1[order], n[order], at[order]
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            several = np.minimum.reduceat(d1, first) < np.maximum.reduceat(d1, first)
            keep = np.repeat(several, np.diff(np.r_[first, len(token)]))
            token, d1, n, at = token[keep], d1[keep], n[keep], at[keep]
        order = np.lexsort((at, n, d1, token))
        columns = [x[order].view(np.int64) for x in (token, d1, n, at)]
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        return pa.table([pa.array(c[new]) for c in columns], names=["token", "d1", "n", "at"])

    return blocks.groupBy("bucket").applyInArrow(work, "token long, d1 long, n long, at long")


def parities(value: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """``SKETCH`` words for every non-empty set: a bit is the parity of the tokens that fall on it, so two sketches differ in
    no more bits than their sets in tokens."""
    place = mix(value ^ np.uint64(0x5EED))
    bit = np.uint64(1) << (place & np.uint64(63))
    word = (place >> np.uint64(6)) % np.uint64(SKETCH)
    return [np.bitwise_xor.reduceat(np.where(word == w, bit, np.uint64(0)), bounds[:-1]).view(np.int64) if len(value) else np.zeros(0, np.int64) for w in range(SKETCH)]


def wanted_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(d1, d2, n, p0.., s)``: sketches and token sets of the lines whose d1 is in ``ids``; a bitmap of fixed size comes first."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.col("d1").alias("seed"))))
    names = ["d1", "d2", "n", *PARITIES, "s"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            value, bounds, _, _ = line_sets(*buffers(batch.column(2)))
            d1, d2 = digests(value, bounds)
            n = np.diff(bounds)
            hit = []
            for i in np.flatnonzero(passes(shared.value, d1.view(np.uint64)) & (n > 0)).tolist():
                if int(d1[i]) not in seen:
                    seen.add(int(d1[i]))
                    hit.append(i)
            for i in range(0, len(hit), 5000):
                part = np.array(hit[i : i + 5000])
                limits = np.r_[0, np.cumsum(n[part])]
                held = value[np.arange(limits[-1]) + np.repeat(bounds[part] - limits[:-1], n[part])]
                offsets = pa.py_buffer(limits.astype(np.int64) * 8)
                s = pa.Array.from_buffers(pa.large_binary(), len(part), [None, offsets, pa.py_buffer(held)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d1[part], d2[part], n[part], *parities(held, limits))] + [s], names=names)

    found = read_texts(docs).mapInArrow(work, "d1 long, d2 long, n long, " + ", ".join(f"{p} long" for p in PARITIES) + ", s binary")
    return found.join(ids, "d1", "left_semi").dropDuplicates(["d1", "d2", "n"])


def matched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(d1)`` of the later nodes of ``pairs(early, late)`` whose sets are similar by exact comparison.

    Pairs whose sketches differ in more bits than similar sets may in tokens go first, so few sets are shipped.
    """
    def named(id_name: str, mark: str) -> DataFrame:
        return sets.select(F.col("d1").alias(id_name), F.col("n").alias("n" + mark), *[F.col(p).alias(p + mark) for p in PARITIES])

    apart = sum(F.bit_count(F.col(p + "_e").bitwiseXOR(F.col(p + "_l"))) for p in PARITIES)
    alike = apart * (100 + HUNDREDTHS) <= (F.col("n_e") + F.col("n_l")) * (100 - HUNDREDTHS)
    close = stored(pairs.join(named("early", "_e"), "early").join(named("late", "_l"), "late").filter(alike).select("early", "late").distinct(), "close")
    shared = sets.sparkSession.sparkContext.broadcast(bitmap(close.select(F.explode(F.array("early", "late")).alias("seed"))))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(shared.value, batch.column(0).to_numpy().view(np.uint64))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(1), batch.column(2)):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
                keep.append(100 * both >= HUNDREDTHS * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["d1"]).filter(pa.array(keep, pa.bool_()))

    side = lambda a, b: sets.select("d1", "s").mapInArrow(met, "d1 long, s binary").select(F.col("d1").alias(a), F.col("s").alias(b))
    return close.join(side("early", "a"), "early").join(side("late", "b"), "late").select("late", "a", "b").mapInArrow(compare, "d1 long").distinct()


def repeated_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts of all lines, ``(doc_id, h, line)`` of the lines that go)."""
    facts = stored(line_facts(docs), "lines")
    place = F.struct("doc_id", "h", "line")
    nodes = stored(facts.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min(place).alias("first"), F.count("*").alias("places")), "nodes")
    shared = shared_tokens(prefix_blocks(docs, common_tokens(facts)))
    members = stored(shared.join(nodes.groupBy("d1").agg(F.min("first").alias("first")), "d1"), "members")
    released(docs.sparkSession)
    # What the length and positional filters leave of a pair that meets at a token.
    reach = lambda a, b: F.lit(1) + F.least(F.col(f"n{a}") - F.col(f"at{a}") - 1, F.col(f"n{b}") - F.col(f"at{b}") - 1)
    def possible(a: str, b: str):
        total = F.col(f"n{a}") + F.col(f"n{b}")
        length = (F.col(f"n{a}") * 100 >= F.col(f"n{b}") * HUNDREDTHS) & (F.col(f"n{b}") * 100 >= F.col(f"n{a}") * HUNDREDTHS)
        return length & (reach(a, b) * (100 + HUNDREDTHS) >= total * HUNDREDTHS)
    side = lambda t: members.select("token", *[F.col(c).alias(c + t) for c in ("d1", "n", "at", "first")])
    leads = members.groupBy("token").agg(F.min(F.struct("first", "d1", "n", "at")).alias("m")).select("token", F.col("m.d1").alias("d1_e"), F.col("m.n").alias("n_e"), F.col("m.at").alias("at_e"), F.col("m.first").alias("first_e"))
    late = side("_l")
    meet = lambda early, later: early.join(later, "token").filter((F.col("first_e") < F.col("first_l")) & possible("_e", "_l")).select(F.col("d1_e").alias("early"), F.col("d1_l").alias("late")).distinct()
    ids = stored(members.select("d1").distinct(), "ids")
    sets = stored(wanted_sets(docs, ids), "sets")
    released(docs.sparkSession)
    led = stored(matched(meet(leads, late), sets), "matched")
    released(docs.sparkSession)
    open_late = late.join(led.select(F.col("d1").alias("d1_l")), "d1_l", "left_anti")
    rest = stored(matched(meet(side("_e"), open_late), sets), "matched")
    for table in (members, ids, sets):
        discard(table)
    released(docs.sparkSession)
    found = led.union(rest).distinct()
    gone = nodes.join(found.withColumn("gone", F.lit(True)), "d1", "left").filter("gone or places > 1").select("d1", "d2", "n", "first", "gone")
    placed = facts.filter("n > 0").join(gone, ["d1", "d2", "n"]).filter(F.col("gone") | (place != F.col("first")))
    lines = stored(placed.select("doc_id", "h", "line").distinct(), "gone")
    discard(nodes)
    released(docs.sparkSession)
    return facts, lines


def line_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_removed, removed_lines)`` of every document with a text; lines from 0, comma-joined."""
    facts, gone = repeated_lines(docs)
    sizes = facts.groupBy("doc_id", "h").agg(F.max(F.col("line") + 1).alias("n_lines"))
    lists = gone.groupBy("doc_id", "h").agg(F.count("*").alias("n_removed"), F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x.cast("string")), ",").alias("removed_lines"))
    out = sizes.join(lists, ["doc_id", "h"], "left")
    return out.select(F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "n_lines", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("removed_lines", F.lit("")).alias("removed_lines"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that match earlier ones; documents of which nothing is left go."""
    d, h, gone_lines, rest_text = free_names(docs, "__d", "__h", "__lines", "__text")
    facts, gone = repeated_lines(docs)
    discard(facts)
    lists = gone.groupBy("doc_id", "h").agg(F.collect_list("line").alias(gone_lines))
    lists = lists.select(F.col("doc_id").alias(d), F.col("h").alias(h), gone_lines)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    kept = docs.join(lists, (key == F.col(d)) & (F.xxhash64("text") == F.col(h)), "left")
    def left(lines: Column) -> Column:
        stay = F.array_except(F.transform(lines, lambda x, i: i.cast("long")), F.col(gone_lines))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i.cast("int"))), "\n")

    # A text is split once: inside a lambda the split would be computed anew for every line.
    rest = F.get(F.transform(F.array(F.split("text", "\n", -1)), left), F.lit(0))
    text = F.when(F.col(gone_lines).isNull(), F.col("text")).otherwise(rest)
    # Blanks of every kind: a document of which only line ends are left is empty.
    out = kept.withColumn(rest_text, text).filter(F.col(gone_lines).isNull() | F.col(rest_text).rlike(r"[^ \t-\r]"))
    return out.select(*[F.col(rest_text).alias("text") if c == "text" else F.col(c) for c in docs.columns])
