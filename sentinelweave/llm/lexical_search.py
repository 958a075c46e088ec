"""Ranked lexical search, exact: best-first over ball trees of sparse document vectors.

A document's vector holds ``(10^9 tf) div (1000 tf + 20 m)`` for each of its terms, an item's holds the weights of
its terms, and the score is their inner product. Texts are read once: a bitmap of fixed size, built from the terms
of the items, lets each task keep a document's occurrences of those terms only, and the statistics (documents, words,
document frequencies) are grouped sums over all documents. Every Arrow batch of sparse vectors becomes a ball tree.
A subtree is bounded by ``q.c + |q| r`` of its centroid and radius, in the space scaled by the roots of the weights
(which leaves inner products alone and keeps frequent words from widening the balls). Bounds are rounded up past any
error of doubles, and a subtree is left out only if its bound is below the score of the k-th best so far; leaves are
scored in whole numbers. The k-th scores of a sample of documents are lower bounds to start from, so most subtrees
are never opened. Lists of an item are merged in two levels, the first salted.

Items are the stated query set: they go through in blocks of about ``PAIRS`` (item, term) pairs, which bounds what
is sent to the tasks. Terms are compared by 64-bit hashes of their bytes.

Defined cases: null and empty texts have no terms and are never found; an item without terms that occur finds
nothing; rows that share an item_id are one item with the terms of all; a null item_id is an item, a null doc_id a
document, the last among equal scores; repeated document rows rank separately; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sentinelweave.llm.common import FOLD, buffers, grouped_order, small_batches, stored, word_hashes
from sentinelweave.llm.decontamination import bitmap, passes

#: Results per item.
TOP = 50
#: Documents of a tree at most, of a leaf at most.
TREE_ROWS, LEAF = 4096, 64
#: (item, term) pairs that go through the documents together.
PAIRS = 500_000
#: Documents, in expectation, whose scores give the first thresholds.
SAMPLE = 32_768
#: First-level lists of an item.
SALTS = 64
# Thousandths in a score, and the parameters of term saturation and length.
SCALE, SATURATION, LENGTH = 1_000_000_000, 20, 50

# Bytes outside terms, all but [0-9A-Za-z] and those from \x80.
BETWEEN = np.ones(256, bool)
BETWEEN[48:58] = BETWEEN[65:91] = BETWEEN[97:123] = BETWEEN[128:] = False


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges ``[start, start + size)``, one after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def term_counts(column: pa.Array, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text with repeats, offsets, hashes and counts of its distinct terms that ``bits`` passes)."""
    hashes, _, _, bounds = word_hashes(*buffers(column), BETWEEN, FOLD)
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(n)), n)
    if bits is not None:
        known = passes(bits, hashes)
        hashes, text = hashes[known], text[known]
    order = grouped_order(hashes, text)
    hashes, text = hashes[order], text[order]
    head = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])][: len(hashes)])
    return n, np.searchsorted(text[head], np.arange(len(n) + 1)), hashes[head], np.diff(np.r_[head, len(hashes)])


def item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, term)``, once each."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets, terms, _ = term_counts(batch.column(1), None)
            which = np.repeat(np.arange(len(batch)), np.diff(offsets))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), pa.array(terms.view(np.int64))], names=["item_id", "term"])

    small_batches(items.sparkSession)
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "item_id long, term long").distinct()


def sparse_vectors(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """``(doc_id, n, terms, counts)`` of every document: its length, and its terms that an item may hold."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, offsets, terms, counts = term_counts(batch.column(1), shared.value)
            lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x)) for x in (terms.view(np.int64), counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], names=["doc_id", "n", "terms", "counts"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(work, "doc_id long, n long, terms array<long>, counts array<long>")


class Block:
    """A block of items: ids, and the terms of each in one sorted vocabulary with weights."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        keys = table.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        item = keys.indices.to_numpy()
        self.ids = keys.dictionary
        self.vocabulary, term = np.unique(table.column("term").to_numpy(), return_inverse=True)
        self.weights = np.zeros(len(self.vocabulary), np.int64)
        self.weights[term] = table.column("w").to_numpy()
        order = np.argsort(item, kind="stable")
        self.terms = np.split(term[order], np.searchsorted(item[order], np.arange(1, len(self.ids)))) if len(self.ids) else []
        self.floors = np.ones(len(self.ids), np.int64)


class Tree:
    """A ball tree over sparse rows (``row``, ``column``, ``value``), rows ascending; ``inner`` are the whole numbers."""

    def __init__(self, offsets: np.ndarray, column: np.ndarray, value: np.ndarray, inner: np.ndarray, width: int):
        n = len(offsets) - 1
        self.order = np.arange(n)
        self.low, self.high, self.children, self.radius = [0], [n], [()], [0.0]
        squares = np.bincount(np.repeat(np.arange(n), np.diff(offsets)), value * value, n)
        sizes = np.diff(offsets)
        centres = []
        node = 0
        while node < len(self.low):
            rows = self.order[self.low[node] : self.high[node]]
            at = spans(offsets[rows], sizes[rows])
            owner = np.repeat(np.arange(len(rows)), sizes[rows])
            dots = lambda v: np.bincount(owner, value[at] * v[column[at]], len(rows))  # noqa: B023,E731
            centre = np.bincount(column[at], value[at], width) / len(rows)
            norm = float(centre @ centre)
            # Squared distances are raised past the error of their terms, so that no row lies outside its ball.
            far = np.maximum(0.0, squares[rows] - 2 * dots(centre) + norm) + 1e-11 * (squares[rows] + norm)
            self.radius[node] = float(np.sqrt(far.max()))
            held = np.flatnonzero(centre)
            centres.append((held, centre[held]))
            if len(rows) > LEAF:
                dense = lambda pole: np.bincount(column[p := at[owner == pole]], value[p], width)  # noqa: B023,E731
                one = dense(int(far.argmax()))
                other = dense(int((squares[rows] - 2 * dots(one)).argmax()))
                lean = dots(one - other)
                half = len(rows) // 2
                self.order[self.low[node] : self.high[node]] = rows[np.argpartition(lean, half)]
                first = len(self.low)
                self.low += [self.low[node], self.low[node] + half]
                self.high += [self.low[node] + half, self.high[node]]
                self.children[node] = (first, first + 1)
                self.children += [(), ()]
                self.radius += [0.0, 0.0]
            node += 1
        self.radius = np.array(self.radius)
        # Centroids by column.
        which = np.repeat(np.arange(len(centres)), [len(c[0]) for c in centres])
        flat, part = np.concatenate([c[0] for c in centres]), np.concatenate([c[1] for c in centres])
        by = np.argsort(flat, kind="stable")
        self.nodes, self.parts = which[by], part[by]
        self.columns = np.searchsorted(flat[by], np.arange(width + 1))
        # Rows in tree order.
        at = spans(offsets[self.order], sizes[self.order])
        self.row_ends = np.r_[0, np.cumsum(sizes[self.order])]
        self.row_column, self.row_inner = column[at], inner[at]

    def bounds(self, query: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """No inner product with a row of a node exceeds its bound; ``query``: columns, ``roots``: the item's values."""
        starts, sizes = self.columns[query], self.columns[query + 1] - self.columns[query]
        at = spans(starts, sizes)
        near = np.bincount(self.nodes[at], self.parts[at] * np.repeat(roots, sizes), len(self.radius))
        return (near + np.sqrt(roots @ roots) * self.radius) * (1 + 1e-9) + 1

    def scores(self, node: int, asked: np.ndarray) -> np.ndarray:
        """Exact scores of a node's rows; ``asked``: 1 for every column of the item."""
        a, z = self.row_ends[self.low[node]], self.row_ends[self.high[node]]
        sums = np.r_[0, np.cumsum(self.row_inner[a:z] * asked[self.row_column[a:z]])]
        ends = self.row_ends[self.low[node] : self.high[node] + 1] - a
        return sums[ends[1:]] - sums[ends[:-1]]


class Best:
    """The best ``k`` of an item so far: scores with the ids that break ties."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, int(floor)
        self.score = self.tie = np.zeros(0, np.int64)

    def add(self, score: np.ndarray, tie: np.ndarray) -> None:
        good = score >= self.floor
        if not good.any():
            return
        self.score, self.tie = np.r_[self.score, score[good]], np.r_[self.tie, tie[good]]
        if len(self.score) > self.k:
            best = np.lexsort((self.tie, -self.score))[: self.k]
            self.score, self.tie = self.score[best], self.tie[best]
        if len(self.score) == self.k:
            self.floor = max(self.floor, int(self.score.min()))


def search(batch: pa.RecordBatch, block: Block, best: list[Best], words: int, docs: int) -> None:
    """Puts a batch of sparse vectors into the lists ``best`` of the items."""
    n = batch.column(1).to_numpy()
    lists = batch.column(2)
    sizes = np.diff(lists.offsets.to_numpy())
    terms, counts = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
    row = np.repeat(np.arange(len(n)), sizes)
    place = np.minimum(np.searchsorted(block.vocabulary, terms), len(block.vocabulary) - 1)
    known = (block.vocabulary[place] == terms) & (block.weights[place] > 0)
    row, place, counts = row[known], place[known], counts[known]
    if not len(row):
        return
    m = 100 - LENGTH + (LENGTH * n * docs) // words
    inner = block.weights[place] * ((SCALE * counts) // (1000 * counts + SATURATION * m[row]))
    held, column = np.unique(place, return_inverse=True)
    live, row = np.unique(row, return_inverse=True)
    root = np.sqrt(block.weights[held].astype(float))
    tree = Tree(np.searchsorted(row, np.arange(len(live) + 1)), column, inner / root[column], inner, len(held))
    ids = batch.column(0).take(pa.array(live)).fill_null(np.iinfo(np.int64).max).to_numpy()[tree.order]
    asked = np.zeros(len(held), np.int64)
    to_local = np.full(len(block.vocabulary), -1)
    to_local[held] = np.arange(len(held))
    for terms_of, own in zip(block.terms, best):
        query = to_local[terms_of]
        query = query[query >= 0]
        if not len(query):
            continue
        bounds = tree.bounds(query, root[query])
        asked[query] = 1
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= own.floor:
            _, node = heapq.heappop(heap)
            if tree.children[node]:
                for child in tree.children[node]:
                    if bounds[child] >= own.floor:
                        heapq.heappush(heap, (-bounds[child], child))
            else:
                own.add(tree.scores(node, asked), ids[tree.low[node] : tree.high[node]])
        asked[query] = 0


def best_of(vectors: DataFrame, block: Block, k: int, words: int, docs: int) -> DataFrame:
    """``(item_id, doc_id, score, salt)``: the best ``k`` of every item in every task."""
    spark = vectors.sparkSession
    small_batches(spark, TREE_ROWS)
    shared = spark.sparkContext.broadcast(block)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best = [Best(k, floor) for floor in items.floors]
        for batch in batches:
            search(batch, items, best, words, docs)
        sizes = [len(b.score) for b in best]
        if sum(sizes):
            item = items.ids.take(pa.array(np.repeat(np.arange(len(best)), sizes)))
            tie = np.concatenate([b.tie for b in best])
            ids = pa.array(tie, mask=tie == np.iinfo(np.int64).max)
            yield pa.RecordBatch.from_arrays([item, ids, pa.array(np.concatenate([b.score for b in best]))], names=["item_id", "doc_id", "score"])

    found = vectors.filter(F.size("terms") > 0).mapInArrow(work, "item_id long, doc_id long, score long")
    return found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))


def merged(lists: DataFrame, k: int) -> DataFrame:
    """``(item_id, rank, doc_id, score)`` from lists of tasks, in two levels."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = lists.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, sample: int = SAMPLE, pairs: int = PAIRS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents of the highest score above 0 for every item."""
    spark = docs.sparkSession
    asked = stored(item_terms(items), "item-terms")
    vectors = stored(sparse_vectors(docs, bitmap(asked.select(F.col("term").alias("seed")).distinct())), "sparse-vectors")
    n_docs, n_words = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    weighed = stored(asked.join(frequency, "term").select("item_id", "term", weight.alias("w")), "item-weights")
    blocks = max(1, -(-weighed.count() // pairs))
    some = vectors.filter(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(1 << 20)) < int(min(1.0, sample / max(1, n_docs)) * (1 << 20)))
    out = None
    for number in range(blocks):
        block = Block(weighed.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).toArrow())
        if not len(block.ids):
            continue
        if n_docs > 2 * sample:
            first = merged(best_of(some, block, k, n_words, n_docs), k).filter(F.col("rank") == k).select("item_id", "score").toArrow()
            known = dict(zip(first.column("item_id").to_pylist(), first.column("score").to_pylist()))
            block.floors = np.array([known.get(i, 1) for i in block.ids.to_pylist()], np.int64)
        lists = stored(best_of(vectors, block, k, n_words, n_docs), "lists")
        out = lists if out is None else out.unionByName(lists)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return merged(out, k)
