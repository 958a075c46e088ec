"""Token counts by rank-synchronous merging of ragged arrays.

A byte-pair vocabulary joins two neighbouring symbols whose text is a piece, best rank first, leftmost first
among equals. No piece holds a character pair outside the vocabulary, so a text falls into pre-tokens between
which nothing can merge; equal pre-tokens are counted once. All pending pre-tokens of a batch lie in one array
with bounds. A round finds the best rank of every sequence at once and applies it in all of them. Within one
sequence every occurrence is merged together where no better piece can arise from the merged one, else the
leftmost alone; that keeps the result equal to the one-at-a-time order. A symbol that is no piece counts its
UTF-8 bytes (byte fallback).

Defined cases: a null or empty text has no tokens; repeated rows stay; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sentinelweave.llm.common import small_batches

MARK = "▁"
#: Counts a worker keeps by pre-token text before it starts anew.
KEPT_COUNTS = 200_000
#: Longer pre-tokens are counted but not kept.
KEPT_LENGTH = 64
NONE = np.iinfo(np.int32).max


class Merges:
    """Vocabulary arrays of a sentencepiece byte-pair model with byte fallback and no text normalisation."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        special = lambda i: sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
        score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not special(i)}
        letters = sorted({c for p in score for c in p} | {p for p in score if len(p) == 1})
        symbols = letters + sorted(p for p in score if len(p) > 1)
        number = {p: i for i, p in enumerate(symbols)}
        self.n = len(symbols)
        order = {s: i for i, s in enumerate(sorted({-x for x in score.values()}))}
        rank = {p: order[-s] for p, s in score.items()}
        self.cost = np.array([1 if p in score else len(p.encode()) for p in symbols], np.int64)
        pairs = {}
        near = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        unsafe = set()
        for p in score:
            for a, b in zip(p, p[1:]):
                near[number[a], number[b]] = True
            for i in range(1, len(p)):
                left, right = p[:i], p[i:]
                if left in number and right in number:
                    pairs[number[left] * self.n + number[right]] = (rank[p], number[p])
                unsafe.update(x for x in (left, right) if x in rank and len(x) > 1 and rank[p] < rank[x])
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()] + [NONE], np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()] + [-1], np.int32)
        self.safe = np.array([p not in unsafe for p in symbols] + [False])
        self.near = near
        self.letter = np.full(0x110000, -1, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(len(letters))
        self.kept: dict[str, int] = {}

    def pair_slots(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places in ``ranks`` and ``merged``; the last one where the pair is no piece."""
        key = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), at, len(self.keys))

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of every pre-token text (marks in place of blanks)."""
        lengths = np.array([len(t) for t in texts], np.int64)
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = self.letter[code]
        owner = np.repeat(np.arange(len(texts)), lengths)
        fallback = np.where(symbol < 0, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 0)
        total = np.bincount(owner, fallback, len(texts)).astype(np.int64)
        known = symbol >= 0
        cut = np.ones(len(code), bool)
        cut[1:] = (owner[1:] != owner[:-1]) | ~known[1:] | ~known[:-1] | ~self.near[symbol[:-1], symbol[1:]]
        sequence, symbol, owner = np.cumsum(cut)[known], symbol[known], owner[known]
        slot = None
        while len(symbol):
            start = np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1]])
            if slot is None:
                slot = np.full(len(symbol), len(self.keys))
                inner = np.flatnonzero(sequence[1:] == sequence[:-1])
                slot[inner] = self.pair_slots(symbol[inner], symbol[inner + 1])
            rank = self.ranks[slot]
            size = np.diff(np.r_[start, len(symbol)])
            best = np.minimum.reduceat(rank, start)
            done = np.repeat(best == NONE, size)
            if done.any():
                np.add.at(total, owner[done], self.cost[symbol[done]])
                sequence, symbol, owner, slot, rank = (x[~done] for x in (sequence, symbol, owner, slot, rank))
                if not len(symbol):
                    break
                size, best = size[best != NONE], best[best != NONE]
                start = np.r_[0, np.cumsum(size)[:-1]]
            hit = np.flatnonzero(rank == np.repeat(best, size))
            group = sequence[hit]
            leads = np.r_[True, group[1:] != group[:-1]]
            # Overlapping occurrences (a a a) are taken from the left, every second one.
            breaks = np.r_[True, hit[1:] != hit[:-1] + 1]
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(breaks, np.arange(len(hit)), 0))
            take = hit[leads | (self.safe[self.merged[slot[hit]]] & (run % 2 == 0))]
            symbol[take] = self.merged[slot[take]]
            keep = np.ones(len(symbol), bool)
            keep[take + 1] = False
            moved = np.cumsum(keep) - 1
            sequence, symbol, owner, slot = (x[keep] for x in (sequence, symbol, owner, slot))
            at = moved[take]
            near = np.zeros(len(symbol), bool)
            near[at] = near[at[at > 0] - 1] = True
            touched = np.flatnonzero(near)
            slot[touched] = len(self.keys)
            touched = touched[touched + 1 < len(symbol)]
            touched = touched[sequence[touched] == sequence[touched + 1]]
            slot[touched] = self.pair_slots(symbol[touched], symbol[touched + 1])
        return total

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts; equal pre-tokens are counted once."""
        split = [pretokens(t) for t in texts]
        kept = self.kept
        fresh = list(set().union(*split).difference(kept))
        if fresh:
            kept.update(zip(fresh, self.count(fresh).tolist()))
        out = [sum(map(kept.__getitem__, ws)) for ws in split]
        for w in [w for w in fresh if len(w) > KEPT_LENGTH]:
            del kept[w]
        if len(kept) > KEPT_COUNTS:
            kept.clear()
        return out


def pretokens(text: str) -> list[str]:
    """The marked text cut before every run of marks that follows another character."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return [MARK + w for w in text.split(" ")]
    return [w.replace(" ", MARK) for w in re.findall(" +[^ ]*", " " + text)]


_LOADED: dict[str, Merges] = {}


def loaded(model: str) -> Merges:
    if model not in _LOADED:
        _LOADED[model] = Merges(model)
    return _LOADED[model]


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row; ``model`` is a path every executor has."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = loaded(model)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            counts = []
            for i in range(0, len(texts), 200):
                counts += merges.counts([t or "" for t in texts[i : i + 200]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    out = read.mapInArrow(work, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
