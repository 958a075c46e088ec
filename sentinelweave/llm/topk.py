"""Exact top-k by inner product: tiles of queries times tiles of candidates, partial selection, tree merging.

Vectors become whole numbers, so every score is exact and ties go to the smaller id. Rows are packed into tiles
of ``TILE`` vectors by hash of their id. A candidate tile meets every query tile through an equi-join on the
query tile's number; one pair of tiles is one matrix product, of which ``k`` scores per query survive. Lists of
a query are merged in a tree: ``FAN_IN`` tiles at a time until one list is left, so no task sees more than
``FAN_IN * k`` rows of a query.

Defined cases: null vectors, vectors with a null or non-finite component and rows without id take no part;
shorter vectors count as padded with zeros; an empty vector scores 0; rows that share a query's id are never its
candidates; repeated candidate rows count once per row; components and scores outside 64 bits are clipped to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sentinelweave.llm.common import small_batches, stored

#: Vectors of a tile.
TILE = 2048
#: Tile lists merged at once.
FAN_IN = 32
SCALE = 1024
TILE_SCHEMA = "tile long, dim int, ids binary, vectors binary"


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` of the rows that take part, components scaled and floored."""
    v = F.col(vector_col)
    finite = ~F.exists(v, lambda x: F.coalesce(F.isnan(x) | (F.abs(x.cast("double")) == float("inf")), F.lit(True)))
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    return rows.filter(F.col(id_col).isNotNull() & v.isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), scaled.alias("v"))


def packed(vectors: DataFrame, tiles: int) -> DataFrame:
    """Tiles of vectors, ordered by id within a tile."""
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        lists = table.column("v").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        out = np.zeros((len(ids), max(1, int(sizes.max(initial=0)))))
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(ids)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        cells = [key[0].as_py(), out.shape[1], ids[order].tobytes(), out[order].tobytes()]
        return pa.table([pa.array([c], t) for c, t in zip(cells, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["tile", "dim", "ids", "vectors"])

    return vectors.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles))).groupBy("tile").applyInArrow(pack, TILE_SCHEMA)


def tile_top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of the best ``k`` candidates of every query; ``ids`` ascend."""
    dim = max(queries.shape[1], vectors.shape[1])
    queries = np.pad(queries, ((0, 0), (0, dim - queries.shape[1])))
    vectors = np.pad(vectors, ((0, 0), (0, dim - vectors.shape[1])))
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * dim
    n = len(ids)
    if bound * 2 * n >= 2.0**52:
        return _tile_top_large(query_ids, queries, ids, vectors, k)
    # Score and place in one whole number: places descend, so that the smaller id wins a tie.
    rank = (queries @ vectors.T).astype(np.int64) * n + np.arange(n - 1, -1, -1)
    rank[query_ids[:, None] == ids[None, :]] = np.iinfo(np.int64).min
    take = min(k, n)
    best = np.partition(rank, n - take, axis=1)[:, n - take :]
    row, col = np.nonzero(best > np.iinfo(np.int64).min)
    value = best[row, col]
    return query_ids[row], ids[n - 1 - value % n], value // n


def _tile_top_large(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same in whole numbers of any length, for components beyond the exact range of doubles."""
    left = [[int(x) for x in q] for q in queries.tolist()]
    right = [[int(x) for x in v] for v in vectors.tolist()]
    out = []
    for q, a in zip(query_ids.tolist(), left):
        scores = [(-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in zip(ids.tolist(), right) if i != q]
        out += [(q, i, -s) for s, i in sorted(scores)[:k]]
    return tuple(np.array([r[c] for r in out], np.int64) for c in range(3))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows for every query row."""
    spark = rows.sparkSession
    all_rows, asked = valid_vectors(rows, id_col, vector_col), valid_vectors(queries, id_col, vector_col)
    n_rows, n_asked = all_rows.count(), asked.count()
    tiles, query_tiles = max(1, -(-n_rows // TILE)), max(1, -(-n_asked // TILE))
    candidates = stored(packed(all_rows, tiles), "tiles")
    wanted = stored(packed(asked, query_tiles), "query-tiles")
    small_batches(spark, 1)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                view = lambda c, d: np.frombuffer(x[c], np.float64).reshape(-1, d)
                q, i, s = tile_top(np.frombuffer(x["q_ids"], np.int64), view("q_vectors", x["q_dim"]), np.frombuffer(x["ids"], np.int64), view("vectors", x["dim"]), k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), x["tile"], np.int64)), pa.array(q), pa.array(i), pa.array(s)], names=["tile", "query_id", "vec_id", "score"])

    asks = wanted.select(F.col("tile").alias("q_tile"), F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    met = candidates.withColumn("q_tile", F.explode(F.sequence(F.lit(0), F.lit(query_tiles - 1)).cast("array<long>"))).join(asks, "q_tile")
    lists = met.select("tile", "dim", "ids", "vectors", "q_dim", "q_ids", "q_vectors").mapInArrow(product, "tile long, query_id long, vec_id long, score long")
    while True:
        tiles = -(-tiles // FAN_IN)
        lists = lists.withColumn("tile", F.floor(F.col("tile") / FAN_IN).cast("long"))
        order = Window.partitionBy("tile", "query_id").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        if tiles == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")
