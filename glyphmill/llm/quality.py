"""Quality of texts by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader steps.

A text's features are hashes of its words and word pairs, and of runs of one to three word shapes (letter
case, first and last mark, digits, length, the word before once more), which carry over to unseen words.
Every held feature counts once, with the same value, so that a text's vector has length one.

Shards of the labelled rows take steps from the same state (``z``, ``n`` for each bucket); the state moves by
the mean of their moves, several rounds over the same shards. L1 regularisation keeps most weights at zero.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.session import materialize

BITS = 18
BUCKETS = 1 << BITS
# Labelled rows that a model is fitted on at most (drawn by a hash of the id).
FIT_ROWS = 24_000
# Words that a task remembers.
REMEMBER = 1 << 19
SHARDS, ROUNDS = 8, 8
# Parts of the buckets in which the moves of the shards are added up.
PARTS = 8
_DIGIT = re.compile(r"\d")
# Odd numbers that spread hashes, and one for each kind of run.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_SALTS = np.arange(5, dtype=np.uint64) * _MIX[1]


def _mark(char: str) -> int:
    return 0 if char.isalpha() else 1 if char.isdigit() else 2 + ord(char) % 61


def shape_of(word: str) -> int:
    """A small number (below 2^19) for what a word looks like."""
    length = min(len(word), 40).bit_length()
    if word.islower() and word.isalpha():
        return (word[-1:] == word[-2:-1]) << 4 | length
    case = 0 if word.islower() else 1 if word.isupper() else 2 if word[0].isupper() else 3
    digits = _DIGIT.search(word) is not None
    return (((case << 6 | _mark(word[0])) << 6 | _mark(word[-1])) << 1 | digits) << 4 | (word[-1:] == word[-2:-1]) << 3 | length


class Featurizer(dict):
    """Sorted distinct buckets of texts; remembers a bounded number of words by their place in two arrays."""

    def __init__(self):
        super().__init__()
        self.hashes, self.shapes = np.empty(REMEMBER, np.uint64), np.empty(REMEMBER, np.uint64)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.hashes):
            self.hashes, self.shapes = (np.concatenate([x, np.empty(at, np.uint64)]) for x in (self.hashes, self.shapes))
        self[word] = at
        self.hashes[at], self.shapes[at] = xxhash.xxh64_intdigest(word.lower()), shape_of(word)
        return at

    def buckets(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.empty(0, np.uint32)
        if len(self) > REMEMBER:
            self.clear()
            self.__init__()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        word, shape = self.hashes[at], self.shapes[at]
        shape[1:] |= (at[1:] == at[:-1]).astype(np.uint64) << np.uint64(20)
        shape = (shape + np.uint64(1)) * _MIX[0]
        pair = shape[1:] * _MIX[1] + shape[:-1]
        runs = [word, shape, word[1:] * _MIX[1] + word[:-1], pair, shape[2:] * _MIX[2] + pair[:-1]]
        hashed = np.concatenate([(run ^ run >> np.uint64(29)) * _MIX[0] + salt for run, salt in zip(runs, _SALTS)])
        found = (((hashed ^ hashed >> np.uint64(32)) * _MIX[2]) >> np.uint64(64 - BITS)).astype(np.uint32)
        found.sort()
        return found[np.concatenate([[True], found[1:] != found[:-1]])]


@dataclass(frozen=True)
class Step:
    """Constants of the per-coordinate steps."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1


@dataclass
class State:
    """``z`` and ``n`` of every bucket and, last, of the constant."""

    z: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS + 1))
    n: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS + 1))

    def weights(self, step: Step, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        size = np.abs(z) - step.l1
        # The constant, the last, is not pulled to zero.
        if not isinstance(at, slice):
            size[at == BUCKETS] = np.abs(z[at == BUCKETS])
        else:
            size[-1] = abs(z[-1])
        return np.where(size > 0, -np.sign(z) * size / ((step.beta + np.sqrt(self.n[at])) / step.alpha + step.l2), 0.0)

    def learn(self, buckets: np.ndarray, label: int, step: Step) -> None:
        """One step on one text."""
        at = np.append(buckets.astype(np.int64), BUCKETS)
        value = np.full(len(at), 1.0 / np.sqrt(max(len(buckets), 1)))
        value[-1] = 1.0
        w = self.weights(step, at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -30, 30)))
        g = (p - label) * value
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / step.alpha * w
        self.n[at] = more


@dataclass(frozen=True)
class Model:
    """Weights of the buckets, most of them zero, and the constant."""

    weights: np.ndarray
    constant: float

    def score(self, buckets: np.ndarray) -> float:
        """Probability of label 1: a sparse dot product."""
        x = float(self.weights[buckets].sum()) / np.sqrt(max(len(buckets), 1)) + self.constant
        return float(1.0 / (1.0 + np.exp(-np.clip(x, -30, 30))))


def featured(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``shard, place, label, buckets`` of about ``rows`` labelled documents at most.

    The drawn ids are bounded by ``rows``, so they go to the scan of the documents and no text moves.
    Rows without a label of 0 or 1 or without an id are left out; an id labelled twice has its larger label.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    share = min(1.0, rows / max(marks.count(), 1))
    place = F.xxhash64(F.lit("quality"), "doc_id")
    drawn = marks.where(F.pmod(place, F.lit(1_000_000)) < int(share * 1_000_000))

    @F.pandas_udf("array<int>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        featurizer = Featurizer()
        for texts in batches:
            yield pd.Series([featurizer.buckets(t).astype(np.int32) for t in texts])

    chosen = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return chosen.select(F.pmod(F.hash("doc_id"), F.lit(SHARDS)).alias("shard"), place.alias("place"), "label", hashed("text").alias("buckets"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS, step: Step = Step()) -> Model:
    """Learn from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id``, ``label``), on ``rows`` labelled texts at most.

    Shards and the order in them follow hashes of the ids, never partitions, so that reruns agree. What comes to
    the driver in a round is bounded by the buckets. Without any label the model scores 0.5.
    """
    spark = docs.sparkSession
    # Whole shards lie in a task, in order, and stay there over the rounds.
    texts = featured(docs, labels, label, rows).repartition(SHARDS, "shard").sortWithinPartitions("shard", "place", "label")
    texts = materialize(texts)
    state = State()
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((state.z, state.n))

        def steps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            z, n = shared.value
            at, own = None, None

            def moved() -> pd.DataFrame:
                cut = [(np.array_split(own.z - z, PARTS)[k].tobytes(), np.array_split(own.n - n, PARTS)[k].tobytes()) for k in range(PARTS)]
                return pd.DataFrame({"part": range(PARTS), "shard": at, "z": [c[0] for c in cut], "n": [c[1] for c in cut]})

            for frame in frames:
                for shard, mark, buckets in zip(frame["shard"], frame["label"], frame["buckets"]):
                    if shard != at:
                        if own is not None:
                            yield moved()
                        at, own = shard, State(z.copy(), n.copy())
                    own.learn(np.asarray(buckets), mark, step)
            if own is not None:
                yield moved()

        def added(group: pd.DataFrame) -> pd.DataFrame:
            # Moves are added up in the order of their shards, so that reruns agree.
            k, out = int(group["part"].iloc[0]), {}
            for name, now in zip("zn", shared.value):
                out[name] = np.array_split(now, PARTS)[k].copy()
                for move in group.sort_values("shard")[name]:
                    out[name] += np.frombuffer(move, np.float64) / SHARDS
            return pd.DataFrame({"part": [k], "z": [out["z"].tobytes()], "n": [out["n"].tobytes()]})

        # The moves of all shards meet in tasks, by parts of the buckets; only the new state comes to the driver.
        moves = texts.mapInPandas(steps, "part int, shard int, z binary, n binary")
        parts = sorted(moves.groupBy("part").applyInPandas(added, "part int, z binary, n binary").collect())
        if parts:
            state.z, state.n = (np.frombuffer(b"".join(bytes(p[i]) for p in parts), np.float64).copy() for i in (1, 2))
        shared.destroy()
    weights = state.weights(step)
    return Model(weights[:-1].astype(np.float32), float(weights[-1]))


def score(text: Column, model: Model, spark: SparkSession) -> Column:
    """Probability (0 to 1) that a whole text has label 1; NULL and empty texts have the model's constant."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        featurizer, known = Featurizer(), shared.value
        for texts in batches:
            yield pd.Series([known.score(featurizer.buckets(t)) for t in texts])

    return scored(text)
