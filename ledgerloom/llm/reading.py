"""Reading level of documents: a linear pairwise ranker, calibrated by isotonic regression.

Features are averages over the text - sentence and word lengths, subordination,
long words, and the shares of hashed words - so the score of a document is that
of its words and sentences on average, whatever its length. The ranker learns
from pairs of graded documents which of the two is harder; isotonic regression
turns its scores into grades.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = (1, 2, 3, 4)
BUCKETS = 1024
#: Most graded documents that the ranker is fitted on (those with the least hash of their key).
MAX_GRADED = 12_000
#: Pairs drawn from them in each round of fitting, and the rest of the fit's settings.
PAIRS, ROUNDS, RATE, RIDGE, FOLDS = 24_000, 6, 0.5, 1e-4, 3

# Words that open subordinate or relative clauses.
SUBORDINATORS = frozenset(
    "after although as because before considering despite even if insofar irrespective notwithstanding provided pursuant since so than that thereby though unless until whenever whereas wherever whether which while who whom whose".split()
)
_SENTENCE = re.compile(r"[.!?;]+(?=\s|$)")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_VOWELS = re.compile(r"[aeiouy]+")
_TAG = re.compile(r"<[^<>]*>")
SYNTAX = 9


class Hashed(dict):
    """Word to (bucket, letters, syllables, subordinator), computed once a word."""

    LIMIT = 200_000

    def __missing__(self, word: str):
        if len(self) > self.LIMIT:
            self.clear()
        value = (xxhash.xxh32_intdigest(word) % BUCKETS, len(word), max(1, len(_VOWELS.findall(word))), word in SUBORDINATORS)
        self[word] = value
        return value


def features(text: str, words: Hashed) -> np.ndarray:
    """Feature vector of a text; one without words is all zeros."""
    text = _TAG.sub(" ", text).lower()
    found = _WORD.findall(text)
    out = np.zeros(SYNTAX + BUCKETS, np.float32)
    n = len(found)
    if not n:
        return out
    letters = syllables = clauses = long = longest = 0
    for word, times in Counter(found).items():
        bucket, size, sounds, opens = words[word]
        out[SYNTAX + bucket] += times
        letters += times * size
        syllables += times * sounds
        clauses += times * opens
        long += times * (size >= 7)
        longest += times * (size >= 11)
    out[SYNTAX:] = np.sqrt(out[SYNTAX:] / n)
    sentences = max(1, len(_SENTENCE.findall(text)))
    commas = text.count(",")
    out[:SYNTAX] = (letters / n, syllables / n, math.log(n / sentences), clauses / n * 10, long / n * 4, longest / n * 8, commas / n * 10, commas / sentences, len(set(found)) / math.sqrt(n))
    return out


@dataclass
class Ranker:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    grades: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) / self.scale) @ self.weights

    def levels(self, x: np.ndarray) -> np.ndarray:
        grade = np.interp(self.scores(x), self.knots, self.grades)
        return np.clip(np.floor(grade + 0.5), LEVELS[0], LEVELS[-1]).astype(int)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the best non-decreasing fit of y on x (pooling adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x[order], y[order], w[order]):
        blocks.append([yi, wi, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, c, _, hi = blocks.pop()
            u, b, lo, _ = blocks.pop()
            blocks.append([(u * b + v * c) / (b + c), b + c, lo, hi])
    knots = [k for b in blocks for k in (b[2], b[3])]
    values = [b[0] for b in blocks for _ in (0, 1)]
    return np.array(knots), np.array(values)


def fit(x: np.ndarray, grade: np.ndarray, raters: np.ndarray, seed: int = 5) -> Ranker:
    """Fit on feature rows, mean grades and numbers of raters.

    Without two different grades every text gets the mean grade (2 without any).
    Scores for calibration come from rankers that didn't see the document (FOLDS parts).
    """
    n = len(x)
    if n < 10 or len(np.unique(grade)) < 2:
        mean = float(np.average(grade, weights=raters)) if n else 2.0
        d = x.shape[1]
        return Ranker(np.zeros(d), np.ones(d), np.zeros(d), np.array([0.0]), np.array([mean]))
    centre, scale = x.mean(0), x.std(0) + 1e-3
    scale[SYNTAX:] = max(float(scale[SYNTAX:].mean()), 1e-3) * 2
    z = ((x - centre) / scale).astype(np.float32)

    def rank(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        a, b = rng.choice(rows, PAIRS), rng.choice(rows, PAIRS)
        gap = grade[a] - grade[b]
        a, b, gap = a[gap != 0], b[gap != 0], gap[gap != 0]
        sign = np.sign(gap).astype(np.float32)
        weight = (np.abs(gap) * np.minimum(raters[a], raters[b])).astype(np.float32)
        weight /= weight.mean()
        w, speed = np.zeros(z.shape[1], np.float32), np.zeros(z.shape[1], np.float32)
        size = 2000
        for step in range(ROUNDS):
            order = rng.permutation(len(a))
            for lo in range(0, len(a), size):
                k = order[lo : lo + size]
                d = (z[a[k]] - z[b[k]]) * sign[k, None]
                pull = weight[k] / (1 + np.exp(np.clip(d @ w, -30, 30)))
                g = -(pull @ d) / len(k) + RIDGE * w
                speed = 0.9 * speed - RATE / (1 + step) * 0.1 * g
                w = w + speed
        return w

    rng = np.random.default_rng(seed)
    fold = rng.integers(0, FOLDS, n)
    held = np.zeros(n)
    for f in range(FOLDS):
        seen = np.flatnonzero(fold != f)
        if len(np.unique(grade[seen])) > 1:
            w = rank(seen, rng)
            s = z[seen] @ w
            held[fold == f] = (z[fold == f] @ w - s.mean()) / (s.std() + 1e-9)
    w = rank(np.arange(n), rng)
    s = z @ w
    weights = w / (s.std() + 1e-9)
    knots, grades = isotonic(held + s.mean() / (s.std() + 1e-9), grade, raters.astype(float))
    return Ranker(centre, scale, weights, knots, grades)


def _features_of(batches):
    words = Hashed()
    for pdf in batches:
        yield pd.DataFrame({"place": pdf["place"], "grade": pdf["grade"], "raters": pdf["raters"], "x": [features(t, words).tobytes() for t in pdf["text"]]})


def train(documents: DataFrame, labels: DataFrame, key: str, level: str = "reading_level", most: int = MAX_GRADED) -> Ranker:
    """Fit the ranker on at most ``most`` graded documents; null texts and null grades are left out.

    It sees PAIRS random pairs of them in each of ROUNDS rounds, a bound like ``most``.
    """
    graded = labels.where(F.col(level).isNotNull()).groupBy(key).agg(F.avg(level).alias("grade"), F.count("*").alias("raters"))
    texts = documents.select(key, "text").where("text is not null")
    graded = graded.join(texts.select(key), key, "left_semi").orderBy(F.xxhash64(key), key).limit(most)
    rows = texts.join(graded, key).select("text", "grade", "raters", F.xxhash64(key).alias("place"))
    got = rows.mapInPandas(_features_of, "place long, grade double, raters long, x binary").toPandas().sort_values(["place", "grade"])
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), SYNTAX + BUCKETS)
    return fit(x, got["grade"].to_numpy(float), got["raters"].to_numpy(float))


def _grader(ranker: Ranker):
    def run(batches):
        words = Hashed()
        for pdf in batches:
            x = np.array([features(t, words) for t in pdf["text"]]) if len(pdf) else np.zeros((0, SYNTAX + BUCKETS), np.float32)
            yield pd.DataFrame({"doc_key": pdf["doc_key"], "reading_level": ranker.levels(x), "score": ranker.scores(x)})

    return run


def levels(documents: DataFrame, key: str, ranker: Ranker) -> DataFrame:
    """(key, reading_level, score) of every document whose text is not null or empty."""
    kind = documents.schema[key].dataType.simpleString()
    texts = documents.where("text is not null and text <> ''").select(F.col(key).alias("doc_key"), "text")
    return texts.mapInPandas(_grader(ranker), f"doc_key {kind}, reading_level int, score double").withColumnRenamed("doc_key", key)
