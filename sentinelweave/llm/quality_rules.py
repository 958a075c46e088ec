"""Quality rules: counts that fail a text at once, and a calibrated n-gram classifier for the rest.

The classifier is a logistic regression over hashed words and word pairs and hashed character triples (bytes), learnt
from labelled quality rows. It is fitted on at most ``LABELS`` labelled documents, those of the least hashes of their
ids; every fifth of them is held out, and its scores are turned into probabilities by a logistic curve (Platt's
calibration with smoothed targets). Weights become whole numbers of ``UNIT``, so sums over n-grams are exact and a
document scores the same in any batch. Documents are scored in Arrow batches; ``KEEP`` is the fixed threshold.

Base counts of a text: words ``[^\\x20\\x09-\\x0D]+`` and their code points, symbols, lines equal to an earlier line,
and words that lie in a window of three words found twice or more. N-grams and windows are compared by 64-bit hashes.

Defined cases: a null or empty text has no words and fails; labels without a document, null ids and labels other than
0 and 1 are left out; a document whose id stands in several rows is learnt from its least text, an id with both labels
counts for both; without documents of both labels every probability is the share of good labels (1 without any);
repeated rows and null doc_ids are scored like others; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sentinelweave.llm.common import BASE, FOLD, SPACE, buffers, grouped_order, mix, small_batches, span_hashes, word_hashes

#: Labelled documents that fit the classifier, at most.
LABELS = 6000
#: Hashed slots of words and word pairs, and of character triples.
WORD_SLOTS, CHARACTER_SLOTS = 2048, 2048
EPOCHS, RATE, DECAY = 250, 2.0, 1e-4
#: Every so manieth labelled document calibrates.
HELD_OUT = 5
#: Weights are whole multiples of this.
UNIT = 2.0**-24
#: A document is kept if its probability of being good is this or more.
KEEP = 0.2
#: Base rules: words at least, and repeated words of 100 at most.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Bytes whose character triples are counted at once.
PIECE = 1 << 20

# Symbols that are counted, and the length of the window of repeated words.
SYMBOL = np.zeros(256, bool)
SYMBOL[[35, 36, 37, 38, 42, 60, 62, 124]] = True
WINDOW = 3


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive words; those that cross texts are the caller's to leave out."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(BASE) + hashes[i : len(hashes) - n + 1 + i]) if len(out) else out
    return out


def repeated_words(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words of each text in windows of ``WINDOW`` words that the text holds twice or more."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    found = windows(hashes, WINDOW)
    at = np.flatnonzero(text[: len(found)] == text[WINDOW - 1 :]) if len(found) else np.zeros(0, np.int64)
    order = at[grouped_order(found[at], text[at])]
    same = (found[order[1:]] == found[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    twice = np.r_[False, same] | np.r_[same, False] if len(order) else np.zeros(0, bool)
    covered = np.zeros(len(hashes), bool)
    for i in range(WINDOW):
        covered[order[twice] + i] = True
    return np.bincount(text[covered], minlength=len(bounds) - 1)


def repeated_lines(data: np.ndarray, offsets: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Lines of each text, with a word in them, that equal an earlier line of the text; ``start``: starts of words."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    text = np.searchsorted(offsets, breaks, "right") - 1
    low = np.concatenate([offsets[:-1], breaks + 1])
    owner = np.concatenate([np.arange(n), text])
    order = np.lexsort((low, owner))
    low, owner = low[order], owner[order]
    high = np.r_[low[1:] - 1, offsets[-1]] if n else low
    last = np.r_[owner[1:] != owner[:-1], True] if n else np.zeros(0, bool)
    high[last] = offsets[owner[last] + 1]
    wordy = np.searchsorted(start, high) > np.searchsorted(start, low)
    low, high, owner = low[wordy], high[wordy], owner[wordy]
    value = np.empty(len(low), np.uint64)
    i = 0
    while i < len(low):
        j = max(i + 1, int(np.searchsorted(high, low[i] + PIECE, "right")))
        value[i:j] = span_hashes(data[low[i] : high[j - 1]], low[i:j] - low[i], high[i:j] - low[i])
        i = j
    order = grouped_order(value, owner)
    same = (value[order[1:]] == value[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    return np.bincount(owner[order[1:]][same], minlength=n)


class Counts:
    """Base counts and n-grams of a batch of texts."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = buffers(column)
        self.exact, self.start, self.end, self.bounds = word_hashes(self.data, self.offsets, SPACE, np.arange(256, dtype=np.uint8))
        self.n_words = np.diff(self.bounds)

    def base(self) -> dict[str, np.ndarray]:
        within = lambda flags: (c := np.r_[0, np.cumsum(flags)])[self.offsets[1:]] - c[self.offsets[:-1]]
        return {
            "n_words": self.n_words,
            "word_chars": within(~SPACE[self.data] & ((self.data & 0xC0) != 0x80)),
            "n_symbols": within(SYMBOL[self.data]),
            "n_dup_lines": repeated_lines(self.data, self.offsets, self.start),
            "n_repeat_words": repeated_words(self.exact, self.bounds),
        }

    def slots(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, slot) of all n-grams, part by part."""
        text = np.repeat(np.arange(len(self.n_words)), self.n_words)
        yield text, (mix(self.exact) % np.uint64(WORD_SLOTS)).astype(np.int64)
        pairs = windows(self.exact, 2)
        inside = np.flatnonzero(text[: len(pairs)] == text[1:]) if len(pairs) else np.zeros(0, np.int64)
        yield text[inside], (pairs[inside] % np.uint64(WORD_SLOTS)).astype(np.int64)
        for low in range(0, max(0, len(self.data) - 2), PIECE):
            part = FOLD[self.data[low : low + PIECE + 2]].astype(np.uint64)
            triple = (part[:-2] << np.uint64(16)) | (part[1:-1] << np.uint64(8)) | part[2:]
            owner = np.searchsorted(self.offsets, np.arange(low, low + len(triple)), "right") - 1
            inside = np.arange(low, low + len(triple)) + 3 <= self.offsets[owner + 1]
            yield owner[inside], WORD_SLOTS + (mix(triple[inside]) % np.uint64(CHARACTER_SLOTS)).astype(np.int64)

    def features(self) -> np.ndarray:
        """Shares of the n-grams of both kinds by slot, a row per text."""
        out = np.zeros((len(self.n_words), WORD_SLOTS + CHARACTER_SLOTS), np.float32)
        for text, slot in self.slots():
            np.add.at(out, (text, slot), 1)
        for a, z in ((0, WORD_SLOTS), (WORD_SLOTS, out.shape[1])):
            out[:, a:z] /= np.maximum(1, out[:, a:z].sum(1, keepdims=True))
        return out

    def linear(self, weights: np.ndarray) -> np.ndarray:
        """Scores under whole-numbered ``weights``, the bias last."""
        n = len(self.n_words)
        sums, sizes = np.zeros((2, n), np.int64), np.zeros((2, n), np.int64)
        for text, slot in self.slots():
            kind = int(len(slot) > 0 and slot[0] >= WORD_SLOTS)
            total = np.r_[0, np.cumsum(weights[slot])]
            ends = np.searchsorted(text, np.arange(n + 1))
            sums[kind] += total[ends[1:]] - total[ends[:-1]]
            sizes[kind] += np.diff(ends)
        return ((sums / np.maximum(1, sizes)).sum(0) + weights[-1]) * UNIT


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights, the bias last, by gradient steps with momentum; both labels weigh alike."""
    spread = np.maximum(1e-3, np.sqrt((x**2).mean(0)))
    balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    weights, speed, bias, drift = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0, 0.0
    for _ in range(EPOCHS):
        error = (logistic(x @ (weights / spread) + bias) - y) * balance
        speed = 0.9 * speed - RATE * ((x.T @ error) / spread / 50 + DECAY * weights)
        drift = 0.9 * drift - RATE * error.sum() / 50
        weights, bias = weights + speed, bias + drift
    return np.r_[weights / spread, bias]


def calibration(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve from scores to probabilities, by Newton steps; targets are smoothed."""
    good, bad = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, float(np.log((good + 1) / (bad + 1)))
    x = np.stack([z, np.ones(len(z))], 1)
    for _ in range(50):
        p = logistic(a * z + b)
        gradient = x.T @ (p - target)
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
    return max(1e-6, float(a)), float(b)


class Model:
    def __init__(self, weights: np.ndarray, slope: float, shift: float):
        self.weights, self.slope, self.shift = np.round(weights / UNIT).astype(np.int64), slope, shift

    def probability(self, counts: Counts) -> np.ndarray:
        return logistic(self.slope * counts.linear(self.weights) + self.shift)


def labelled(docs: DataFrame, labels: DataFrame, most: int = LABELS) -> DataFrame:
    """``(doc_id, good, text)`` of at most ``most`` labelled documents: the least hashes of their ids."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good")).filter("doc_id is not null and good in (0, 1)").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    # Semi-join first: labels without a document must not use up places. The places are few, so they are sent to the texts.
    present = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = present.orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id", "good").limit(most)
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text"))


def fitted(docs: DataFrame, labels: DataFrame, most: int = LABELS) -> Model:
    small_batches(docs.sparkSession, 200)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Counts(batch.column(2)).features().astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([row.tobytes() for row in rows], pa.binary())], names=["doc_id", "good", "x"])

    table = labelled(docs, labels, most).mapInArrow(work, "doc_id long, good int, x binary").toArrow()
    ids, y = table.column("doc_id").to_numpy(), table.column("good").to_numpy().astype(float)
    width = WORD_SLOTS + CHARACTER_SLOTS
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 1)
        return Model(np.zeros(width + 1), 1.0, float(np.log(share / max(1e-9, 1 - share))))
    order = np.lexsort((y, ids))
    x = np.frombuffer(b"".join(v.as_buffer() for v in table.column("x")), np.float32).reshape(len(y), width)[order]
    y = y[order]
    held = mix(ids[order].view(np.uint64)) % np.uint64(HELD_OUT) == 0
    for part in (held, ~held):
        if y[part].size == 0 or y[part].min() == y[part].max():
            held = np.ones(len(y), bool)
    fit = ~held if not held.all() else held
    weights = np.round(train(x[fit], y[fit]) / UNIT) * UNIT
    return Model(weights, *calibration(x[held] @ weights[:-1] + weights[-1], y[held]))


def scored(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """``(doc_id, base counts, base_failed, probability, kept)`` of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counts(batch.column(1))
            base = counts.base()
            failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])
            p = np.round(shared.value.probability(counts), 9)
            arrays = [batch.column(0), *[pa.array(base[n].astype(np.int64)) for n in names], pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *names, "base_failed", "probability", "kept"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(work, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, probability double, kept boolean")


def quality_rules(docs: DataFrame, labels: DataFrame, most: int = LABELS, keep: float = KEEP) -> DataFrame:
    """Every row of ``docs`` with its base counts, its probability of being good, and the verdict of both."""
    return scored(docs, fitted(docs, labels, most), keep)
