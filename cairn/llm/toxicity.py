"""Toxicity by non-negative positive-unlabelled learning.

A linear model over word and word-prefix features is trained in numpy from
confirmed toxic texts (P) and unlabelled texts of the corpus (U). With class
prior q, sigmoid loss l and scores z the risk is

    q E_P[l(z)] + max(0, E_U[l(-z)] - q E_P[l(-z)])

The second part estimates the clean texts' risk; where it turns negative (the
model has begun to fit the sample), the step is taken against it instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = re.compile(r"[^\W\d_]+")
#: Bounds of the sample that the model is fitted on, and of its features.
MOST_POSITIVE, MOST_UNLABELLED, MOST_FEATURES = 5_000, 10_000, 4_096
#: A feature stands in so many texts of P at least, and by chance would stand in as
#: many with a chance under exp(-EVIDENCE), whatever the number of texts.
LEAST_DOCS, EVIDENCE = 2, 3.0

#: A task hands on its counts when it holds more features than this, and forgets words beyond that.
MOST_COUNTED, MOST_CACHED = 200_000, 100_000
#: What a text is taken for: confirmed toxic, unlabelled, or one of the label rows among which the cut is placed.
CONFIRMED, PLAIN, HELD = 0, 1, 2
#: Scores (before the sigmoid) this close are one score.
TIE = 1e-9


def features(word: str) -> list[str]:
    """The word, and its first 4, 5 and 6 letters marked as prefixes."""
    return [word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) >= k)]


def text_features(text: str | None) -> set[str]:
    return {f for w in set(LETTERS.findall((text or "").lower())) for f in features(w)}


@dataclass
class Model:
    bias: float
    weights: dict[str, float]

    def word(self, word: str) -> tuple[tuple[str, float], ...]:
        return tuple((f, self.weights[f]) for f in features(word) if f in self.weights)

    def score(self, text: str | None, cache: dict) -> float:
        found: dict[str, float] = {}
        for w in set(LETTERS.findall((text or "").lower())):
            got = cache.get(w)
            if got is None:
                if len(cache) > MOST_CACHED:
                    cache.clear()
                got = cache[w] = self.word(w)
            if got:
                found.update(got)
        z = self.bias + sum(found[f] for f in sorted(found))
        return 1 / (1 + exp(-max(-500.0, min(500.0, z))))


def fit_nnpu(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 1e-5) -> tuple[float, np.ndarray]:
    """Bias and weights; ``rows`` hold feature numbers, ``positive`` marks P (else U)."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    w, b = np.zeros(n_features), log(prior / (1 - prior))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, steps + 1):
        z = np.bincount(owner, w[at], len(rows)) + b
        s = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        slope = s * (1 - s)  # of l(-z) = s; that of l(z) = 1 - s is its negative
        clean = s[~positive].sum() / n_u - prior * s[positive].sum() / n_p
        d_clean = np.where(positive, -prior * slope / n_p, slope / n_u)
        d_toxic = np.where(positive, -prior * slope / n_p, 0.0)
        d = d_toxic + d_clean if clean >= 0 else -d_clean
        g = np.append(np.bincount(at, d[owner], n_features) + decay * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return float(b), w


def place_threshold(z: np.ndarray, positive: np.ndarray, prior: float, threshold: float) -> float:
    """The shift that puts ``threshold`` into the gap of least risk: with the share of
    P and of U above a cut, the risk counted there in place of the loss is

        prior (1 - P above) + max(0, U above - prior P above)

    Every gap between two scores is a cut, and of cuts with equal risk the widest
    is taken; a tie is never cut. Where no cut has less risk than to mark nothing,
    nothing reaches the threshold.
    """
    at = log(threshold / (1 - threshold))
    order = np.sort(z)[::-1]
    spots = np.flatnonzero(order[:-1] - order[1:] > TIE)
    cuts = (order[spots] + order[spots + 1]) / 2
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts, side="right") / max(1, len(x))
    p, u = above(z[positive]), above(z[~positive])
    risk = prior * (1 - p) + np.maximum(0, u - prior * p)
    if not len(cuts) or risk.min() >= prior - 1e-12:
        return at - float(order[0]) - 1
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    width = order[spots[best]] - order[spots[best] + 1]
    return at - float(cuts[best[np.argmax(width)]])


def train(df: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> Model:
    """Fit on the toxic label rows, and on documents of any kind, for which ``learn`` holds.

    P: toxic label rows whose document is in ``df``. U: documents of ``df``, with a
    label or without, and again the label rows, whose labels are not read: these
    hold P's texts in the very share of the prior, which steadies rare features.
    All are bounded samples chosen by a hash of the id, so ties, row order and partitions do
    not matter; a repeated row may enter twice. The prior is the toxic share of the
    label rows at hand, so the cut is placed among these (their labels unread): there
    the prior is exact, while the corpus may hold another share. Features are those in at least LEAST_DOCS texts of P and
    commoner there than in U, beyond chance (the Poisson tail bound of EVIDENCE at
    the rate of U). Without toxic rows (empty tables, null labels) or without
    features the model is a low constant. Whole texts are read, very long ones too:
    a text costs memory for its distinct words.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(learn).select("doc_id", "toxic")
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    total = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not total["n"] or not total["toxic"]:
        return Model(-4.0, {})
    prior = min(0.95, total["toxic"] / total["n"])
    sample = lambda rows, k: rows.orderBy(F.xxhash64(F.hash("doc_id")), "doc_id").limit(k)
    some = sample(known.where("toxic = 1").select("doc_id"), MOST_POSITIVE).select("doc_id", F.lit(CONFIRMED).alias("role"))
    held = sample(known.select("doc_id"), MOST_UNLABELLED).select("doc_id", F.lit(HELD).alias("role"))
    plain = sample(texts.where("doc_id is not null").where(learn).select("doc_id"), MOST_UNLABELLED).select("doc_id", F.lit(PLAIN).alias("role"))
    some = df.sparkSession.createDataFrame(some.union(plain).union(held).distinct().collect(), some.schema)  # bounded by the limits
    chosen = texts.join(F.broadcast(some), "doc_id").select("role", "text")
    n_p, n_u = (max(1, x) for x in chosen.agg(F.count_if(F.col("role") == CONFIRMED), F.count_if(F.col("role") != CONFIRMED)).first())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        def batch_of(seen: dict[bool, Counter]) -> pa.RecordBatch:
            names = list(seen[True] | seen[False])  # a text of P may be in another task
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[True][x] for x in names], pa.int64()), pa.array([seen[False][x] for x in names], pa.int64())], names=["f", "p", "u"])

        seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for batch in batches:
            for role, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen[role == CONFIRMED].update(text_features(text.as_py()))
            if len(seen[True]) + len(seen[False]) > MOST_COUNTED:
                yield batch_of(seen)
                seen = {True: Counter(), False: Counter()}
        yield batch_of(seen)

    kinds = chosen.mapInArrow(count, "f string, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    gain = F.col("p") * F.log((F.col("p") + 1) / n_p / ((F.col("u") + 1) / n_u))
    due = F.greatest("u", F.lit(1)) * n_p / n_u
    sure = F.col("p") * F.log(F.col("p") / due) - F.col("p") + due >= EVIDENCE
    kinds = kinds.where((F.col("p") >= LEAST_DOCS) & sure & (F.col("p") / n_p > 1.5 * F.col("u") / n_u))
    names = [r["f"] for r in kinds.orderBy(gain.desc(), "f").limit(MOST_FEATURES).select("f").collect()]
    if not names:
        return Model(-4.0, {})
    number = {f: k for k, f in enumerate(names)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(number[f] for f in text_features(t.as_py()) & number.keys()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["role", "at"])

    got = chosen.mapInArrow(encode, "role int, at array<int>").collect()
    got.sort(key=lambda r: (r["role"], r["at"]))
    rows = [np.array(r["at"], np.int64) for r in got]
    role = np.array([r["role"] for r in got], int)
    bias, weights = fit_nnpu(rows, role == CONFIRMED, len(names), prior)
    z = np.array([bias + weights[at].sum() for at in rows])
    bias += place_threshold(z[role != PLAIN], role[role != PLAIN] == CONFIRMED, prior, threshold)
    return Model(bias, dict(zip(names, weights.tolist())))


def score_toxicity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row: one map over the scan, no shuffle.

    Only the text enters the score; equal texts score equally. Null and empty
    texts get the score of a text without features.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t.as_py(), cache) for t in batch.column(1)], pa.float64())], names=["id", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
    return out.withColumnRenamed("id", id_col)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def drop_toxic(df: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``df`` that score below ``threshold``, with their columns, null ids and repeats included.

    Null and empty texts score as texts without features and stay. The model is
    trained on ``df`` itself; an empty table gives an empty one.
    """
    model = train(df, labels, fold() != 1, id_col, text_col)
    kinds = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            keep = [model.score(t.as_py(), cache) < threshold for t in batch.column(text_col)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, kinds)
