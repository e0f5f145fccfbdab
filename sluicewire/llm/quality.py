"""Quality by ordinal cumulative-link regression on graded ratings.

Grades 0 < 1 < ... < G share one weight vector over hashed text features, and ordered thresholds
split its score: ``P(grade > k) = sigmoid(w.x - t[k])``. The expected grade is the sum of these
tails; the tail at a grade selects documents.

Features: each distinct word once (so one telling word counts the same in a long text), and the
shares of token shapes, repeats and distinct words, all hashed into one space.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, documents, holds, named

DIMENSIONS = 1 << 18
#: The fit uses at most so many labelled rows, those of least hash of their id.
SAMPLE = 16_000
#: A feature needs so many rows of the sample to get a weight.
MIN_ROWS = 4
L2, STEPS, RATE = 1e-4, 250, 0.08
#: A document is kept if the probability of at least this grade is at least this.
KEEP_GRADE, KEEP_PROBABILITY = 2, 0.6
REMEMBERED = 200_000
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…“”‘’«»¿¡–—"


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) & (DIMENSIONS - 1)


def _sign(c: str) -> str:
    return "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c


def _shape(token: str) -> str:
    """Runs of one kind of character as one sign each: A upper, a other letters, 9 digits, else the character."""
    return "".join(s for s, _ in groupby(map(_sign, token)))


class _Tokens(dict):
    """The slots of tokens' words (-1: none) and shapes; new ones are computed, and remembered while there is room."""

    def __missing__(self, token: str) -> tuple[int, int]:
        word = token.strip(_STRIP).lower()
        got = (_slot("w:" + word) if word else -1, _slot("s:" + _shape(token)))
        if len(self) < REMEMBERED:
            self[token] = got
        return got


_tokens = _Tokens()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature slots and their values; none for a null or blank text."""
    tokens = (text or "").split()
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    words, shapes = zip(*map(_tokens.__getitem__, tokens), strict=True)
    n, value = len(tokens), dict.fromkeys(words, 1.0)
    value.pop(-1, None)
    for shape, k in Counter(shapes).items():
        value[shape] = 4 * (k / n) ** 0.5
    value[_slot("repeats")] = 4 * (sum(map(eq, tokens, tokens[1:])) / n) ** 0.5
    value[_slot(f"distinct:{10 * len(set(tokens)) // n}")] = 1.0
    return np.fromiter(value, np.int64, len(value)), np.fromiter(value.values(), np.float64, len(value))


@dataclass(frozen=True)
class Model:
    """``weights`` by slot, and increasing ``thresholds``, one for each grade over the lowest."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: Iterator[str | None]) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... for each text."""
        score = []
        for t in texts:
            at, v = features(t)
            score.append(float(self.weights[at] @ v))
        return _sigmoid(np.array(score, dtype=np.float64).reshape(-1, 1) - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit_rows(slots: np.ndarray, values: np.ndarray, lengths: np.ndarray, grades: np.ndarray, top: int) -> Model:
    """Least penalised negative log-likelihood by Adam over all rows at once; grades 0 to ``top``.

    The features of all rows stand end to end, ``lengths`` of them for each row.
    """
    n = len(grades)
    if not n:
        # nothing learned: every text surely has the top grade, so nothing is rejected
        return Model(np.zeros(DIMENSIONS), np.full(top, -50.0))
    row = np.repeat(np.arange(n, dtype=np.int32), lengths)
    used = np.bincount(slots, minlength=DIMENSIONS) >= MIN_ROWS
    on = used[slots]
    at = np.flatnonzero(used)
    rank = np.zeros(DIMENSIONS, dtype=np.int32)
    rank[at] = np.arange(len(at))
    values, row, inverse = values[on], row[on], rank[slots[on]]
    del slots, on
    m = len(at)
    # thresholds as a first one and positive steps
    share = [np.clip((grades > k).mean(), 1e-3, 1 - 1e-3) for k in range(top)]
    first = [-np.log(s / (1 - s)) for s in share]
    x = np.concatenate([np.zeros(m), [first[0]], np.log(np.maximum(np.diff(first), 0.1))])
    m1, m2 = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        w, t = x[:m], np.cumsum(np.concatenate([x[m : m + 1], np.exp(x[m + 1 :])]))
        z = np.bincount(row, weights=values * w[inverse], minlength=n)
        tail = np.hstack([np.ones((n, 1)), _sigmoid(z[:, None] - t), np.zeros((n, 1))])
        slope = tail * (1 - tail)
        i = np.arange(n)
        p = np.maximum(tail[i, grades] - tail[i, grades + 1], 1e-12)
        up, down = slope[i, grades] / p, slope[i, grades + 1] / p
        gz = -(up - down) / n
        gt = np.array([(up[grades == k + 1].sum() - down[grades == k].sum()) / n for k in range(top)])
        tail_sum = np.cumsum(gt[::-1])[::-1]
        grad = np.concatenate([np.bincount(inverse, weights=values * gz[row], minlength=m) + L2 * w, tail_sum[:1], tail_sum[1:] * np.exp(x[m + 1 :])])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        x = x - RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9) * (1 if step < 0.7 * STEPS else 0.2)
    weights = np.zeros(DIMENSIONS)
    weights[at] = x[:m]
    return Model(weights, np.cumsum(np.concatenate([x[m : m + 1], np.exp(x[m + 1 :])])))


def grade(quality: Column, toxic: Column) -> Column:
    """2 good, 1 poor, 0 toxic; null where neither rating decides."""
    return F.when(toxic == 1, 0).when(quality == 1, 2).when(quality == 0, 1)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    holds("quality", _tokens.clear)
    for batch in batches:
        got = [features(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([a.astype(np.int32) for a, _ in got], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in got], pa.list_(pa.float32())), batch.column(1)], names=["at", "value", "grade"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` rows of ``labels`` (doc_id, quality, toxic) with a text in ``docs``.

    Rows without an id or a grade are left out; null texts count as empty. If ids repeat, of the joined
    rows those of least (hash of the id, hash of the text, grade) are taken, so the bound holds. Without any, the
    model rejects nothing.
    """
    rated = labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).cast("int").alias("grade")).where("grade IS NOT NULL AND doc_id IS NOT NULL")
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    # at most `sample` rows of two numbers
    mine = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), F.col("id") == F.col("doc_id"))
    if mine.select("id").count() > sample:  # ids repeat in one of the tables
        mine = mine.orderBy(F.xxhash64("id"), F.xxhash64("text"), "grade").limit(sample)
    rows = mine.select("text", "grade").mapInArrow(_feature_rows, "at array<int>, value array<float>, grade int").toArrow().combine_chunks()
    at, value = (pc.list_flatten(rows.column(c)).to_numpy() for c in ("at", "value"))
    return fit_rows(at, value, pc.list_value_length(rows.column("at")).to_numpy(), rows.column("grade").to_numpy().astype(np.int64), KEEP_GRADE)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``expected_grade`` and ``tail_probability`` (of at least KEEP_GRADE).

    A null or blank text has no features: the thresholds alone decide. Every row is scored by its
    whole text, of any length; equal texts score the same, and repeated rows stay. A column of ``df`` named
    like one of the two gives way to it; all others keep name and values. An empty table gives no
    rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    fields = ["expected_grade", "tail_probability"]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        holds("quality", _tokens.clear)
        for texts in batches:
            tails = shared.value.tails(t.as_py() for t in texts)
            yield pa.StructArray.from_arrays([pa.array(tails.sum(axis=1)), pa.array(tails[:, KEEP_GRADE - 1])], names=fields)

    return beside(df, F.arrow_udf(run, ", ".join(f"{f} double" for f in fields))(named(text)), fields)


def keep_good(df: DataFrame, model: Model) -> DataFrame:
    """The rows of ``df`` that the model doesn't reject, with all their columns, whatever these are called."""
    return score(df.select(F.struct(*map(named, df.columns)).alias("row"), "text"), model).where(F.col("tail_probability") >= KEEP_PROBABILITY).select("row.*")


def labels_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of all ``documents``, learned from ``labels``; see :func:`score` for nulls, repeats and the rest."""
    docs = documents(spark, sf_dir)
    model = fit(docs, labels_table(spark, sf_dir))
    return score(docs.select("doc_id", "text"), model).select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= KEEP_PROBABILITY).alias("keep"))
