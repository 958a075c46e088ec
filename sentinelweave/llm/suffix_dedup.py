"""Removal of byte strings that start in an earlier document, by two-stage suffix sorting.

Every window of ``LENGTH`` bytes has a key: the least hash of its ``GRAM``-byte strings. Equal windows have equal
keys, and neighbouring windows mostly share theirs, so a run of windows with one key is one context of about 66
bytes. Three exchanges between blocks of documents (about 4 MB each) and buckets of keys follow:

1. Blocks send their distinct keys; buckets answer which of them stand in several blocks.
2. Blocks send the distinct contexts of such keys, each with the smallest doc_id it has in the block. A bucket
   lays its contexts out as one text, sorts all suffixes in two stages (suffixes smaller than their successors
   directly, the rest induced by one scan of the first-byte buckets), computes the common prefixes of neighbours,
   and answers the smallest doc_id of every window.
3. Blocks remove the bytes of windows whose smallest doc_id is below their document's.

A passage costs a bucket one context per block, however many documents hold it. Keys are hashes, but only decide
what is compared: the answer follows from the bytes.

Defined cases: null texts are empty; a null doc_id counts as larger than all others; rows of equal doc_id do not
remove from each other; texts below ``LENGTH`` bytes stay whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sentinelweave.llm.common import BYTES_KEY, buffers, mix, scratch_path, small_batches, span_hashes

#: Bytes of a repeated string, and of the strings whose least hash is its key.
LENGTH, GRAM = 50, 20
#: Windows hashed at once, and windows of a context at most.
PIECE, RUN = 1 << 20, 64
#: Text bytes of a bucket, about, and of a block.
BUCKET_BYTES, BLOCK_BYTES = 8 << 20, 4 << 20
#: Blocks of one file at most.
FILE_BLOCKS = 8
LAST = 2**63 - 1
MESSAGE = "block long, bucket long, kind int, body binary"


def pack(*arrays: object) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, protocol=5))


def unpack(body: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(body))


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["block", "bucket", "kind", "body"])


def blocks(docs: DataFrame) -> DataFrame:
    """One message per block of documents, its texts compressed; written once, so that block numbers stay."""
    spark = docs.sparkSession
    small_batches(spark)
    spark.conf.set(BYTES_KEY, str(BLOCK_BYTES))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(batches):
            data, offsets = buffers(batch.column(1))
            ids = batch.column(0).fill_null(LAST).to_numpy()
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            yield from messages([(part + i, -1, 0, pack(ids, known, offsets, data.tobytes()))]).to_batches()

    path = scratch_path(spark, "blocks")
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, MESSAGE)
    packed.write.option("compression", "uncompressed").option("maxRecordsPerFile", FILE_BLOCKS).parquet(path)
    return spark.read.schema(MESSAGE).parquet(path)


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mixed key, text number, first window, windows) of every run of windows with one key."""
    out = []
    width = LENGTH - GRAM + 1
    for low in range(0, max(0, len(data) - LENGTH + 1), PIECE):
        high = min(len(data), low + PIECE + LENGTH - 1)
        part = data[low:high]
        start = np.arange(len(part) - GRAM + 1)
        least = span_hashes(part, start, start + GRAM)
        step = 1
        while step * 2 <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        rest = width - step
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        window = np.arange(len(least)) + low
        text = np.searchsorted(offsets, window, "right") - 1
        whole = window + LENGTH <= offsets[text + 1]
        window, text, least = window[whole], text[whole], least[whole]
        if not len(window):
            continue
        head = np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])]
        since = np.arange(len(window)) - np.maximum.accumulate(np.where(head, np.arange(len(window)), 0))
        head = np.flatnonzero(since % RUN == 0)
        out.append((mix(least[head]), text[head], window[head], np.diff(np.r_[head, len(window)])))
    if not out:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def distinct_keys(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys ascending, whether two different documents hold them)."""
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    last = np.r_[head[1:], len(key)][: len(head)] - 1
    return key[head], ids[head] != ids[last]


def bucket_slices(keys: np.ndarray, count: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending keys: buckets are ranges of keys."""
    bucket = np.minimum((keys >> np.uint64(32)) * np.uint64(count) >> np.uint64(32), np.uint64(count - 1)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(cut, np.r_[cut[1:], len(keys)])]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of ``text`` (ordered by the first ``LENGTH`` bytes at least) by two-stage sorting."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # A suffix is small if it is smaller than its successor; runs of one byte follow what ends them.
    differs = np.flatnonzero(text[1:] != text[:-1])
    up = np.zeros(n, bool)
    if len(differs):
        follow = np.minimum(np.searchsorted(differs, np.arange(n)), len(differs) - 1)
        up = text[differs[follow] + 1] > text[differs[follow]]
        up[np.arange(n) > differs[-1]] = False
    small = np.flatnonzero(up)
    small = small[direct_order(text, small)]
    first = text[small]
    bounds = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    # The last suffix is larger than its (empty) successor and comes first of its byte.
    waiting[text[n - 1]].append(np.array([n - 1]))
    out = []
    for byte in range(256):
        level = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        waiting[byte] = []
        scanned = [level]
        while len(level):
            before = level[level > 0] - 1
            level = before[text[before] == byte]
            scanned.append(level)
        large = np.concatenate(scanned)
        place = np.concatenate([large, small[bounds[byte] : bounds[byte + 1]]])
        if not len(place):
            continue
        out.append(place)
        before = place[place > 0] - 1
        before = before[text[before] > byte]
        order = np.argsort(text[before], kind="stable")
        before = before[order]
        cut = np.flatnonzero(np.r_[True, text[before][1:] != text[before][:-1]]) if len(before) else []
        for a, b in zip(cut, np.r_[cut[1:], len(before)] if len(before) else []):
            waiting[text[before[a]]].append(before[a:b])
    return np.concatenate(out)


def direct_order(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Order of the suffixes at ``places`` by their first ``LENGTH`` bytes, eight bytes a round, ties alone going on."""
    padded = np.r_[text, np.zeros(LENGTH + 16, np.uint8)]
    word = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(text) + LENGTH + 8]).view(">u8").ravel().astype(np.uint64)
    order = np.argsort(word[places], kind="stable")
    open_at = np.arange(len(places))
    group = None
    depth = 0
    while depth < LENGTH:
        value = word[places[order[open_at]] + depth]
        if group is None:
            same = value[1:] == value[:-1]
        else:
            sub = np.lexsort((value, group))
            order[open_at] = order[open_at][sub]
            value, group = value[sub], group[sub]
            same = (value[1:] == value[:-1]) & (group[1:] == group[:-1])
        tied = np.zeros(len(open_at), bool)
        tied[1:] |= same
        tied[:-1] |= same
        number = np.cumsum(np.r_[True, ~same]) if len(open_at) else np.zeros(0, np.int64)
        open_at, group = open_at[tied], number[tied]
        depth += 8
        if not len(open_at):
            break
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix of ``order`` with the one before, up to ``LENGTH``."""
    padded = np.r_[text, np.zeros(LENGTH, np.uint8)]
    view = np.lib.stride_tricks.sliding_window_view(padded, LENGTH)
    out = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 1 << 16):
        b = min(len(order), a + (1 << 16))
        same = view[order[a:b]] == view[order[a - 1 : b - 1]]
        out[a:b] = np.where(same.all(1), LENGTH, same.argmin(1))
    return out


def smallest_ids(contexts: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest id of every window of every context, bounds of the contexts in it); ids are the contexts' own."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    text = np.frombuffer(b"".join(c + b"\0" for c in contexts), np.uint8)
    start = np.cumsum(sizes + 1) - sizes - 1
    count = sizes - LENGTH + 1
    bounds = np.r_[0, np.cumsum(count)]
    owner = np.repeat(np.arange(len(contexts)), count)
    place = start[owner] + np.arange(len(owner)) - bounds[owner]
    number = np.full(len(text), -1, np.int64)
    number[place] = np.arange(len(place))
    order = suffix_order(text)
    order = order[number[order] >= 0]
    head = np.flatnonzero(common_prefixes(text, order) < LENGTH)
    least = np.minimum.reduceat(ids[owner[number[order]]], head) if len(head) else np.zeros(0, np.int64)
    out = np.empty(len(owner), np.int64)
    out[number[order]] = np.repeat(least, np.diff(np.r_[head, len(order)]))
    return out, bounds


def remove_repeats(docs: DataFrame, texts_too: bool = True) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256)`` of every row; ``kept`` are the remaining bytes
    (null without ``texts_too``)."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    texts = blocks(docs)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(3)):
                ids, _, offsets, raw = unpack(body.as_py())
                key, text, _, _ = runs(np.frombuffer(raw, np.uint8), offsets)
                keys, _ = distinct_keys(key, ids[text])
                rows = [(block, bucket, 1, (keys[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()) for bucket, a, b in bucket_slices(keys, buckets)]
                yield from messages(rows).to_batches()

    def answer(table: pa.Table) -> pa.Table:
        """Which 32-bit rests of keys stand in several blocks: a bit per key, in the order of the message."""
        parts = [np.frombuffer(b.as_buffer(), np.uint32) for b in table.column("body")]
        every = np.concatenate(parts)
        slot = np.unique(every, return_inverse=True, return_counts=True)
        shared = (slot[2] > 1)[slot[1].ravel()]
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        return messages([(block, bucket, 2, np.packbits(bits).tobytes()) for block, bucket, bits in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), np.split(shared, cuts))])

    def contexts(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("block", "bucket", "kind", "body"))))
        block = rows[0][0]
        ids, _, offsets, raw = unpack(next(r[3] for r in rows if r[2] == 0))
        said = {r[1]: r[3] for r in rows if r[2] == 2}
        key, text, window, count = runs(np.frombuffer(raw, np.uint8), offsets)
        keys, wanted = distinct_keys(key, ids[text])
        slices = bucket_slices(keys, buckets)
        for bucket, a, b in slices:
            wanted[a:b] |= np.unpackbits(np.frombuffer(said[bucket], np.uint8), count=b - a).astype(bool)
        place = np.searchsorted(keys, key)
        use = np.flatnonzero(wanted[place])
        use = use[np.argsort(place[use], kind="stable")]
        place = place[use]
        out, seen_at = [], []
        for bucket, a, b in slices:
            part = use[np.searchsorted(place, a) : np.searchsorted(place, b)]
            if not len(part):
                continue
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(raw[w : w + c + LENGTH - 1], len(number)) for w, c in zip(window[part].tolist(), count[part].tolist())])
            least = np.full(len(number), LAST)
            np.minimum.at(least, which, ids[text[part]])
            out.append((block, bucket, 3, pack(list(number), least)))
            seen_at.append((bucket, which.astype(np.int32), window[part], text[part].astype(np.int32)))
        return messages([*out, (block, -1, 4, pack(seen_at))])

    def sort(table: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        held, ids = [], []
        for body in table.column("body"):
            texts_, least = unpack(body.as_py())
            held.append(np.array([number.setdefault(t, len(number)) for t in texts_]))
            ids.append(least)
        own = np.full(len(number), LAST)
        for which, least in zip(held, ids):
            np.minimum.at(own, which, least)
        least, bounds = smallest_ids(list(number), own)
        rows = []
        for block, bucket, which in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), held):
            size = bounds[which + 1] - bounds[which]
            at = np.repeat(bounds[which] - np.cumsum(size) + size, size) + np.arange(size.sum())
            rows.append((block, bucket, 5, pack(least[at], size.astype(np.int32))))
        return messages(rows)

    def apply(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("bucket", "kind", "body"))))
        ids, known, offsets, raw = unpack(next(r[2] for r in rows if r[1] == 0))
        said = {r[0]: r[2] for r in rows if r[1] == 5}
        starts = [np.zeros(0, np.int64)]
        for bucket, which, window, text in unpack(next(r[2] for r in rows if r[1] == 4))[0]:
            least, size = unpack(said[bucket])
            start = np.cumsum(size) - size
            count = size[which].astype(np.int64)
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            gone = least[np.repeat(start[which], count) + nth] < np.repeat(ids[text], count)
            starts.append((np.repeat(window, count) + nth)[gone])
        # A byte is covered if more windows have begun up to it than have ended.
        begun = np.zeros(len(raw) + 1, np.int32)
        begun[np.concatenate(starts)] = 1
        begun = np.cumsum(begun)
        covered = begun[:-1] > np.r_[np.zeros(LENGTH, np.int32), begun][: len(raw)]
        data = np.frombuffer(raw, np.uint8)
        out = []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            cover = covered[a:b]
            spans = int(cover[:1].sum() + (cover[1:] & ~cover[:-1]).sum())
            kept = data[a:b][~cover].tobytes()
            out.append((int(ids[i]) if known[i] else None, b - a, int(cover.sum()), spans, kept if texts_too else None, hashlib.sha256(kept).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.table([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    asked = texts.mapInArrow(ask, MESSAGE)
    answered = asked.groupBy("bucket").applyInArrow(answer, MESSAGE)
    path = scratch_path(spark, "contexts")
    texts.unionByName(answered).groupBy("block").applyInArrow(contexts, MESSAGE).write.option("compression", "uncompressed").parquet(path)
    sent = spark.read.schema(MESSAGE).parquet(path)
    sorted_ = sent.filter("kind = 3").groupBy("bucket").applyInArrow(sort, MESSAGE)
    full = texts.unionByName(sent.filter("kind = 4")).unionByName(sorted_)
    return full.groupBy("block").applyInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
