"""What the operators of this package share: shared-folder tables, Arrow text views, word hashes, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text hashed at once inside a task; bounds the working memory of a Python worker.
PIECE_BYTES = 1 << 20
#: Rows of an Arrow batch that carries whole texts.
TEXT_ROWS = 1000
ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

# The bytes that separate words, [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
# A-Z to a-z, all other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
# What a byte adds to a hash.
VALUES = np.arange(1, 257, dtype=np.uint64)
# An odd multiplier for prefix hashes and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; only on one machine and where none is named is one made."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a stored table that no later step reads."""
    context = table.sparkSession.sparkContext
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Shuffles and broadcasts that no table reads any more leave memory and disk now.

    Spark deletes them once the driver's JVM finds their handles unused, which it seldom looks for.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores as it takes to clash with no column of ``df``."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Arrow batches of whole texts stay small: by rows, and by bytes where Spark knows that setting."""
    spark.conf.set(ROWS_KEY, str(rows))
    spark.conf.set(BYTES_KEY, str(8 << 20))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = pc.fill_null(column, b"").cast(pa.large_binary())
    else:
        column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(max(n, PIECE_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all bits (finaliser of a 64-bit counter generator)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = VALUES) -> np.ndarray:
    """64-bit hashes of data[start:end] by prefix sums of a polynomial modulo 2^64; ``table``: the value of every byte."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    terms = table[data]
    terms *= up[:-1]
    np.cumsum(terms, out=sums[1:])
    out = sums[ends] - sums[starts]
    out *= down[starts]
    out += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of maximal runs of bytes that are no separator; no word crosses a text's end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separators[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    # Runs change at every edge; texts that meet inside a run cut it there.
    begins = edges[int(inside[0]) :: 2]
    ends = edges[1 - int(inside[0]) :: 2]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    cuts = np.unique(inner[inside[inner - 1] & inside[inner]])
    begins = np.concatenate([[0] * int(inside[0]), begins, cuts]).astype(np.int64)
    ends = np.concatenate([ends, cuts, [len(data)] * int(inside[-1])]).astype(np.int64)
    return (np.sort(begins, kind="stable"), np.sort(ends, kind="stable")) if len(cuts) else (begins, ends)


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes together; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, fold: np.ndarray = FOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word of every text, and the offsets of the texts in them.

    The work goes in pieces cut between words, so a very long text needs no more memory than its words' hashes.
    """
    starts, ends = words(data, offsets, separators)
    out = np.empty(len(starts), np.uint64)
    table = VALUES[fold]
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE_BYTES, "right")))
        lo, hi = starts[i], ends[j - 1]
        out[i:j] = span_hashes(data[lo:hi], starts[i:j] - lo, ends[i:j] - lo, table)
        i = j
    return out, starts, ends, np.searchsorted(starts, offsets)


def grouped_order(value: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order by group, then by value: one sort of group and leading value bits, in full where those tie."""
    bits = int(group.max(initial=0)).bit_length()
    if bits > 36:
        return np.lexsort((value, group))
    key = (value >> np.uint64(bits)) | (group.astype(np.uint64) << np.uint64(64 - bits)) if bits else value
    order = np.argsort(key, kind="stable")
    key, sorted_value = key[order], value[order]
    if ((key[1:] == key[:-1]) & (sorted_value[1:] < sorted_value[:-1])).any():
        return np.lexsort((value, group))
    return order


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every k consecutive words, text number); a text of fewer words is one shingle, none without words."""
    counts = np.diff(bounds)
    n = len(hashes)
    spread = np.zeros(max(0, n - k + 1), np.uint64)
    # Words' hashes are spread already: a polynomial of them is mixed once.
    for i in range(k if len(spread) else 0):
        spread *= np.uint64(BASE)
        spread += hashes[i : n - k + 1 + i]
    many = np.maximum(0, counts - k + 1)
    text = np.repeat(np.arange(len(counts)), many)
    full = mix(spread[np.arange(len(text)) + np.repeat(bounds[:-1] - np.cumsum(many) + many, many)])
    few = np.flatnonzero((counts > 0) & (counts < k))
    whole = np.zeros(len(few), np.uint64)
    for i in range(k - 1):
        has = counts[few] > i
        whole[has] = whole[has] * np.uint64(BASE) + hashes[bounds[few[has]] + i]
    whole = mix(whole + counts[few].astype(np.uint64))
    return np.concatenate([full, whole]), np.concatenate([text, few])


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` of every node of ``links(u, v)``: the smallest node reachable.

    Large-star and small-star steps in turn: a map-side combined minimum and an equi-join each, no node's
    neighbours are gathered; every round is written to the shared folder. Loops and nulls are left out.
    """
    stars = stored(links.filter("u <> v").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).distinct(), "stars")
    before = None
    for _ in range(max_rounds):
        both = stars.unionByName(stars.select(F.col("u").alias("v"), F.col("v").alias("u")))
        lowest = both.groupBy("v").agg(F.min("u").alias("m")).withColumn("m", F.least("m", "v"))
        large = both.filter("u > v").join(lowest, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        lowest = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lowest, "v").filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        stars = stored(small.unionByName(lowest.select("v", F.col("m").alias("u"))).distinct(), "stars")
        after = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if after == before:
            return stars.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(stars.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        before = after
    raise RuntimeError("components did not settle")
