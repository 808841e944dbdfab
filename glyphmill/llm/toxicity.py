"""Toxic passages by maximum-scoring segments of token log-odds, calibrated as extreme values.

A token's score is its log-odds between toxic and clean labelled texts, with an informative
Dirichlet prior that shrinks rare tokens, less a penalty that makes clean text drift downwards. One
linear scan finds every maximal-scoring segment of a text. For a drift below zero the highest
segment of ``n`` clean tokens follows an extreme-value law ``P(S < s) = exp(-K n exp(-lambda s))``,
whose two parameters are fitted on clean labelled texts, so a long text is not toxic by its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.session import materialize

# Buckets of hashed features: the model's size, whatever the vocabulary.
BUCKETS = 1 << 20
# Labelled rows that a model is fitted on at most (drawn by a hash of the id).
FIT_ROWS = 50_000
# Words whose scores a task remembers.
REMEMBER = 1 << 19
_MARKS = ".,;:!?\"'()[]"
# A word counts by itself and by its beginnings, so that inflected forms share what they have in common.
_BEGINNINGS = (4, 5, 6)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def buckets_of(word: str) -> tuple[int, ...]:
    """Buckets of a word's features."""
    bare = word.strip(_MARKS)
    features = ["w" + bare, *("b" + bare[:n] for n in _BEGINNINGS if len(bare) >= n)]
    return tuple(xxhash.xxh64_intdigest(f) % BUCKETS for f in features)


class Remembered(dict):
    """A function of a word that keeps a bounded number of its results."""

    def __init__(self, fn):
        super().__init__()
        self.fn = fn

    def __missing__(self, word: str):
        if len(self) >= REMEMBER:
            self.clear()
        self[word] = found = self.fn(word)
        return found


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(start, end, score)`` in one pass, each above zero.

    Runs of equal sign are added up first, so the scan proper has one step for each run of positive tokens.
    A list of open candidates with their left and right totals is kept: a new run joins back to the
    last candidate that began lower, if that one also ended lower.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    breaks = np.flatnonzero(np.diff(positive) > 1)
    starts, ends = positive[np.r_[0, breaks + 1]], positive[np.r_[breaks, len(positive) - 1]] + 1
    total = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[list[float]] = []  # start, end, total before, total after
    for start, end in zip(starts.tolist(), ends.tolist()):
        left, right = float(total[start]), float(total[end])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
                # Candidates that began higher can never be joined by this or a later run from here.
            if j < 0 or found[j][3] >= right:
                found.append([start, end, left, right])
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(int(s), int(e), r - l) for s, e, l, r in found]


@dataclass(frozen=True)
class Model:
    """Scores of the features that mark toxic words, and the fitted laws."""

    weights: dict[int, float]
    penalty: float
    decay: float = 1.0  # lambda
    scale: float = 1.0  # K
    slope: float = 1.0
    offset: float = 0.0

    def word_score(self, word: str) -> float:
        return max((self.weights.get(b, 0.0) for b in buckets_of(word)), default=0.0) - self.penalty

    def scorer(self):
        """Function from words to their scores."""
        known = Remembered(self.word_score)
        return lambda words: np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def evidence(self, scores: np.ndarray) -> tuple[float, float, int]:
        """``(highest segment score, strength, significant segments)``.

        ``strength`` adds up, over the segments, how far each is above what the best segment of as
        many clean words reaches (in units of the law); for none above it, it is that of the best.
        """
        found = [s for _, _, s in segments(scores)]
        if not found:
            return 0.0, -1.0, 0
        expected = math.log(self.scale * len(scores) + 1.0)
        over = [self.decay * s - expected for s in found]
        above = [x for x in over if x > 0]
        return max(found), sum(above) if above else max(over), len(above)

    def probability(self, strength: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * _spread(strength) + self.offset, -30, 30)))

    def spans(self, text: str | None, alpha: float = 0.05) -> list[tuple[int, int, float, float]]:
        """``(first word, end, score, p)`` of the passages whose extreme-value probability is below ``alpha``."""
        words = words_of(text)
        out = []
        for start, end, score in segments(self.scorer()(words)):
            p = -math.expm1(-self.scale * len(words) * math.exp(-self.decay * score))
            if p < alpha:
                out.append((start, end, score, p))
        return out


def _spread(strength: np.ndarray) -> np.ndarray:
    return np.log1p(np.maximum(strength, -0.9))


def feature_weights(counts: DataFrame, prior: float, least_z: float) -> dict[int, float]:
    """Log-odds of the features that are surely more frequent in toxic texts.

    ``counts`` has ``bucket, toxic, clean`` document counts. The Dirichlet prior of a feature is
    ``prior`` times its count in both classes, which pulls rare features to no difference; a feature
    counts if its log-odds are above ``least_z`` of their standard deviations. Only those features,
    at most ``BUCKETS``, come to the driver.
    """
    sums = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    toxic, clean = (float(x or 0) for x in sums)
    if not toxic or not clean:
        return {}
    alpha, all_alpha = F.lit(prior) * (F.col("toxic") + F.col("clean")), prior * (toxic + clean)

    def odds(count: Column, total: float) -> Column:
        held = count + alpha
        return F.log(held) - F.log(F.greatest(F.lit(total + all_alpha) - held, F.lit(1e-12)))

    spread = F.sqrt(F.lit(1.0) / (F.col("toxic") + alpha) + F.lit(1.0) / (F.col("clean") + alpha))
    scored = counts.select("bucket", (odds(F.col("toxic"), toxic) - odds(F.col("clean"), clean)).alias("delta"), spread.alias("spread"))
    sure = scored.where(F.col("delta") > least_z * F.col("spread")).select("bucket", "delta")
    return {r.bucket: r.delta for r in sure.toLocalIterator()}


def labelled_texts(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``doc_id, text, toxic`` of about ``rows`` labelled documents at most.

    The ids drawn are bounded by ``rows``, so they go to the scan of the documents and no text is moved.
    Rows without a label of 0 or 1 or without an id are left out; an id labelled twice has its larger label.
    """
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, rows / max(marks.count(), 1))
    drawn = marks.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return materialize(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"))


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Least hash of the five-word runs of each text: near copies mostly share it."""
    for batch in batches:
        sketches = []
        for text in batch["text"]:
            words = words_of(text)
            sketches.append(min(xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) >> 1 for i in range(max(1, len(words) - 4))))
        yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "sketch": sketches})


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known, counts = Remembered(buckets_of), np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"]):
            held = set().union(*map(known.__getitem__, set(words_of(text))))
            counts[toxic, np.fromiter(held, np.int64, len(held))] += 1
    seen = np.flatnonzero(counts.any(axis=0))
    yield pd.DataFrame({"bucket": seen, "toxic": counts[1, seen], "clean": counts[0, seen]})


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, prior: float = 0.1, least_z: float = 4.0, penalty: float = 0.25) -> Model:
    """Learn a model from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, toxic``), on ``rows`` labelled texts at most.

    Near copies of a labelled text count once. Without both classes no feature has a weight and
    every score is low.
    """
    texts = labelled_texts(docs, labels, rows)
    sketched = texts.mapInPandas(_sketched, "doc_id bigint, toxic int, sketch bigint")
    single = sketched.groupBy("toxic", "sketch").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    # One row for each labelled text at most: bounded like the sample itself.
    chosen = texts.join(F.broadcast(single), "doc_id", "left_semi")
    partial = chosen.select("text", "toxic").mapInPandas(_counted, "bucket bigint, toxic bigint, clean bigint")
    counts = materialize(partial.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    weights = feature_weights(counts, prior, least_z)
    return calibrate(Model(weights, penalty), texts) if weights else Model({}, penalty, offset=-3.0)


def calibrate(model: Model, texts: DataFrame) -> Model:
    """Fit the extreme-value law on the clean texts, then the map from strength to probability on all."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def found_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = shared.value.scorer()
        for batch in batches:
            words = [words_of(t) for t in batch["text"]]
            found = [[x for _, _, x in segments(score(w))] for w in words]
            yield pd.DataFrame({"toxic": batch["toxic"], "n": list(map(len, words)), "found": found})

    held = materialize(texts.select("text", "toxic").mapInPandas(found_in, "toxic int, n bigint, found array<double>"))
    best = F.coalesce(F.array_max("found"), F.lit(0.0))
    clean = held.where((F.col("toxic") == 0) & (F.col("n") > 0))
    spread, mean, size = clean.agg(F.stddev_pop(best), F.avg(best), F.avg(F.log("n"))).first()
    # Gumbel by moments on the score left after the length's share; a least spread keeps the law defined
    # where clean texts hold no positive word.
    decay = math.pi / (max(spread or 0.0, 0.25) * math.sqrt(6.0))
    scale = math.exp(decay * (mean or 0.0) - (size or 0.0) - 0.5772)
    over = F.transform("found", lambda x: F.lit(decay) * x - F.log(F.lit(scale) * F.col("n") + 1.0))
    above = F.aggregate(over, F.lit(0.0), lambda total, x: total + F.greatest(x, F.lit(0.0)))
    strength = F.when(above > 0, above).otherwise(F.coalesce(F.array_max(over), F.lit(-1.0)))
    # Two numbers for each labelled text of the bounded sample.
    points = held.select("toxic", strength.alias("x")).toPandas()
    slope, offset = _logistic(_spread(points["x"].to_numpy()), points["toxic"].to_numpy(float))
    return Model(model.weights, model.penalty, decay, scale, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic regression by Newton steps."""
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - ridge * w
        curve = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.0)), float(w[1])


def score(text: Column, model: Model, spark: SparkSession) -> Column:
    """Struct ``score, top, n_segments`` of a text; NULL and empty texts hold no word and score lowest."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, top double, n_segments int")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        law = shared.value
        scores = law.scorer()
        for batch in batches:
            rows = [law.evidence(scores(words_of(t))) for t in batch]
            top, strength, n = np.array(rows, float).reshape(-1, 3).T
            yield pd.DataFrame({"score": law.probability(strength), "top": top, "n_segments": n.astype("int32")})

    return scored(text)
