"""Quality classifier from weak labels.

``LABELLERS`` overlapping rules vote good, bad or nothing on every document. Only the vote patterns matter to the
label model, so their counts over all documents (3 to the number of rules at most, whatever the corpus) go to
the driver, where expectation-maximisation estimates each rule's accuracies and the share of good documents.
The patterns' posteriors then label a bounded sample (``SAMPLE`` documents in expectation, chosen by the hash of
id and text) that trains a logistic scorer over hashed word features. Every document is scored.

Defined cases: a text without words (null, empty, blank) scores 0; null ids, ties and repeated rows are scored
like others; extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sentinelweave.llm.common import buffers, free_names, grouped_order, mix, small_batches, span_hashes, stored, word_hashes

#: Documents that train the scorer, in expectation; the only part of the corpus that reaches the driver.
SAMPLE = 8000
#: Hashed features, rounds and regularisation of the scorer.
FEATURES, EPOCHS, RATE, DECAY = 1024, 300, 2.0, 1e-4
#: Rows that training turns into doubles at once.
TRAIN_ROWS = 500
#: A document goes if its probability of being good is below this; clean documents matter more than rejected ones.
KEEP = 0.2
#: Rules vote on texts of this many words or more; a shorter text's score shrinks to the share of good documents.
EVIDENCE = 10
EM_ROUNDS = 100
# Frequent function words of the four languages.
FUNCTION_WORDS = (
    "a an and are as at be by for from in is it of on that the this to was with "
    "au avec dans de des du en est et la le les par pas pour qui que sur un une "
    "auf das dem den der des die ein eine im in ist mit nicht sich und von zu "
    "con de del el en la las los no para por que se su un una y"
).split()
# Labellers as (statistic, bad from, good from); those in REVERSED are bad up to; None: no such vote.
LABELLERS = [
    ("symbols", 0.10, None),
    ("capitals", 0.40, None),
    ("stutter", 0.15, None),
    ("variety", 0.30, 0.45),
    ("function", 0.05, 0.10),
    ("bare", 0.15, None),
    ("stops", 0.50, None),
    ("length", 12.0, None),
]
#: Probabilities of (no vote, bad, good) before the first round, in bad and in good documents.
PRIOR = [[0.55, 0.35, 0.10], [0.60, 0.02, 0.38]]
REVERSED = {"variety", "function"}
#: Words outside which variety and function words say nothing.
VARIETY_WORDS, FUNCTION_LEAST = (30, 3000), 30

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:127] = True
_SYMBOL &= ~(_LETTER | _DIGIT)
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True


class Profile:
    """Word-level facts of a batch of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.hashes, self.start, self.end, self.bounds = word_hashes(data, offsets)
        self.n = np.diff(self.bounds)
        self.text = np.repeat(np.arange(len(self.n)), self.n)
        within = lambda flags: (c := np.r_[0, np.cumsum(flags[data])])[self.end] - c[self.start]
        self.upper, self.letter, self.digit, self.symbol = within(_UPPER), within(_LETTER), within(_DIGIT), within(_SYMBOL)
        self.size = self.end - self.start
        self.first = data[self.start] if len(self.start) else np.zeros(0, np.uint8)
        self.last = data[self.end - 1] if len(self.start) else np.zeros(0, np.uint8)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.text, values, len(self.n))

    def statistics(self) -> dict[str, np.ndarray]:
        """Statistics by name; NaN where a rule has nothing to say."""
        n = np.maximum(1, self.n)
        same = np.zeros(len(self.text), bool)
        same[1:] = (self.hashes[1:] == self.hashes[:-1]) & (self.text[1:] == self.text[:-1])
        order = grouped_order(self.hashes, self.text)
        h, t = self.hashes[order], self.text[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        known = np.array([x.encode() for x in sorted(set(FUNCTION_WORDS))], object)
        joined = np.frombuffer(b"".join(known), np.uint8)
        ends = np.cumsum([len(x) for x in known])
        function = np.isin(self.hashes, span_hashes(joined, ends - [len(x) for x in known], ends))
        size = np.maximum(1, self.per_text(self.size))
        out = {
            "symbols": self.per_text(self.symbol) / size,
            "capitals": self.per_text(self.upper) / np.maximum(1, self.per_text(self.letter)),
            "stutter": self.per_text(same) / np.maximum(1, self.n - 1),
            "variety": np.bincount(t, fresh, len(self.n)) / n,
            "function": self.per_text(function) / n,
            "bare": self.per_text(self.symbol == self.size) / n,
            "stops": self.per_text(_STOP[self.last]) / n,
            "length": size / n,
        }
        out["variety"][(self.n < VARIETY_WORDS[0]) | (self.n > VARIETY_WORDS[1])] = np.nan
        out["function"][self.n < FUNCTION_LEAST] = np.nan
        for values in out.values():
            values[self.n < EVIDENCE] = np.nan
        return out

    def votes(self) -> np.ndarray:
        """Vote pattern of every text: digits of base 3, 0 nothing, 1 bad, 2 good."""
        statistics = self.statistics()
        code = np.zeros(len(self.n), np.int64)
        for name, bad, good in LABELLERS:
            x = statistics[name] * (-1 if name in REVERSED else 1)
            bad = -bad if name in REVERSED else bad
            code = code * 3 + np.where(x >= bad, 1, np.where(x <= (-np.inf if good is None else -good), 2, 0))
        return code

    def features(self, which: np.ndarray) -> np.ndarray:
        """Square roots of the shares of hashed word shapes, words and repeats of the texts ``which``."""
        row = np.full(len(self.n), -1)
        row[which] = np.arange(len(which))
        use = np.flatnonzero(row[self.text] >= 0)
        to = row[self.text[use]]
        bucket = lambda x: np.minimum(x, 4).astype(np.uint64)
        shape = np.zeros(len(use), np.uint64)
        for part in (self.upper, self.digit, self.symbol, self.size // 4):
            shape = shape * np.uint64(5) + bucket(part[use])
        shape = shape * np.uint64(256) + np.where(_SYMBOL[self.last[use]], self.last[use], 0).astype(np.uint64)
        again = np.zeros(len(use), np.uint64)
        again[1:] = (self.hashes[use][1:] == self.hashes[use][:-1]) & (to[1:] == to[:-1])
        out = np.zeros(len(which) * FEATURES)
        for salt, value in ((1, shape), (2, self.hashes[use]), (3, again)):
            slot = (mix(value ^ mix(np.full(1, salt, np.uint64))) % np.uint64(FEATURES)).astype(np.int64)
            out += np.bincount(to * FEATURES + slot, minlength=len(out))
        return np.sqrt(out.reshape(-1, FEATURES) / np.maximum(1, self.n[which])[:, None]).astype(np.float32)


def label_model(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good per pattern, accuracies [rule, bad/good], share of good) by expectation-maximisation.

    A rule has a probability of each vote, none included, in bad and in good documents. Its accuracy in a class is
    the share of right votes among those it gave there.
    """
    k = len(LABELLERS)
    votes = np.stack([(patterns // 3 ** (k - 1 - i)) % 3 for i in range(k)], 1) if len(patterns) else np.zeros((0, k), int)
    chance, share = np.tile(np.array(PRIOR), (k, 1, 1)), 0.8
    posterior = np.full(len(patterns), share)
    for _ in range(EM_ROUNDS):
        log = [np.log(chance[np.arange(k), j, votes]).sum(1) + np.log(p) for j, p in enumerate((1 - share, share))]
        posterior = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        for j, weight in enumerate((counts * (1 - posterior), counts * posterior)):
            for v in range(3):
                chance[:, j, v] = (weight[:, None] * (votes == v)).sum(0) + 0.1
        chance /= chance.sum(2, keepdims=True)
        share = float(np.clip((counts @ posterior + 1) / (counts.sum() + 2), 0.01, 0.99))
    accuracy = np.stack([chance[:, j, j + 1] / (chance[:, j, 1] + chance[:, j, 2]) for j in (0, 1)], 1)
    return posterior, accuracy, share


def train(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights, the bias last, by gradient steps with momentum on soft labels; both classes weigh alike."""
    weights, speed = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    total = max(1e-9, y.sum()), max(1e-9, (1 - y).sum())
    balance = y / total[0] + (1 - y) / total[1]
    for _ in range(EPOCHS):
        slope = DECAY * weights
        # In blocks, since a product with doubles makes a copy of its rows in doubles.
        for i in range(0, len(x), TRAIN_ROWS):
            part, want = x[i : i + TRAIN_ROWS].astype(float), y[i : i + TRAIN_ROWS]
            p = 1 / (1 + np.exp(-np.clip(part @ weights[:-1] + weights[-1], -50, 50)))
            miss = (p - want) * balance[i : i + TRAIN_ROWS]
            slope[:-1] += part.T @ miss
            slope[-1] += miss.sum()
        speed = 0.9 * speed - RATE * slope
        weights = weights + speed
    return weights


def fitted(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """(scorer weights, rule accuracies, share of good) learnt from ``docs``."""
    small_batches(docs.sparkSession)
    rate = min(1.0, sample / max(1, docs.count()))
    limit = int(rate * (1 << 30))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            profile = Profile(*buffers(batch.column(1)))
            code = profile.votes()
            chosen = np.flatnonzero(batch.column(0).to_numpy(zero_copy_only=False) & (code > 0))
            blobs: list[bytes | None] = [None] * len(code)
            for i, row in zip(chosen.tolist(), profile.features(chosen)):
                blobs[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(blobs, pa.binary())], names=["votes", "x"])

    picked = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < limit
    seen = stored(docs.select(picked.alias("picked"), F.col("text").cast("string").alias("text")).mapInArrow(work, "votes long, x binary"), "votes")
    table = seen.groupBy("votes").count().collect()
    patterns, counts = np.array([r[0] for r in table], np.int64), np.array([r[1] for r in table], float)
    posterior, accuracy, share = label_model(patterns, counts)
    label = dict(zip(patterns.tolist(), posterior.tolist()))
    rows = seen.filter("x is not null").collect()
    if not rows:
        return np.r_[np.zeros(FEATURES), 1.0], accuracy, share
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][1]))
    x = np.empty((len(rows), FEATURES), np.float32)
    for k, i in enumerate(order):
        x[k] = np.frombuffer(rows[i][1], np.float32)
    y = np.array([label[rows[i][0]] for i in order])
    # The collected rows are let go before training.
    del rows, order
    return train(x, y), accuracy, share


def scored(docs: DataFrame, weights: np.ndarray, share: float, column: str = "quality_score") -> DataFrame:
    """All rows and columns of ``docs`` with the probability of being good in ``column``."""
    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            profile = Profile(*buffers(batch.column(at)))
            out = np.zeros(len(batch))
            trust = np.minimum(1, profile.n / EVIDENCE)
            for i in range(0, len(batch), 200):
                which = np.arange(i, min(len(batch), i + 200))
                own = np.clip(profile.features(which) @ weights[:-1] + weights[-1], -50, 50)
                out[which] = 1 / (1 + np.exp(-trust[which] * own - (1 - trust[which]) * np.log(share / (1 - share))))
            out[profile.n == 0] = 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=schema.names)

    return docs.mapInArrow(work, schema)


def quality(docs: DataFrame) -> DataFrame:
    """``(doc_id, quality_score, keep)`` of every row."""
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    weights, _, share = fitted(narrow)
    return scored(narrow, weights, share).select("doc_id", F.round("quality_score", 9).alias("quality_score"), (F.round("quality_score", 9) >= KEEP).alias("keep"))


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns."""
    weights, _, share = fitted(docs)
    (score,) = free_names(docs, "__quality")
    return scored(docs, weights, share, score).filter(F.round(score, 9) >= KEEP).drop(score)
