"""Quality as an ordinal cumulative-link regression on graded ratings.

A text is the square roots of the shares of its hashed byte n-grams (a vector of length one, so that long and short texts compare). All grades share the
weights; ordered thresholds part them: P(grade <= k) = sigmoid(threshold k - weights . features). Results are the expected grade and the tail
probability of a grade or more, by which documents are selected.

Fitting takes at most SAMPLE rated rows, of which the driver holds the features (FEATURES numbers of 16 bits each). Nulls and empty texts have no features; rows with a null id or rating are
not learnt from; ids may repeat, and rows that tie or repeat are judged alike. Empty tables give no rows; a long text is hashed in pieces. With fewer than two grades every text has the one there is (0 without any) and tail probability 1. Other columns stay; those with the names of new ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stash, give_back, table, text_of
from .hashed import grams, sampled
from .slices import replaced, sliced

SIZES, BITS, SAMPLE, ROUNDS, PENALTY, ROWS = (1, 2, 3), 11, 6000, 250, 1e-4, 512
FEATURES = 1 << BITS
#: Documents stay from this tail probability on.
KEEP = 0.5


def vector(text: str | None) -> np.ndarray:
    counts = np.zeros(FEATURES)
    for x in grams(np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8), SIZES, BITS):
        counts += np.bincount(x, minlength=FEATURES)
    return np.sqrt(counts / max(1.0, counts.sum()))


def _vectors(batches):
    for batch in sliced(batches, -1):
        out = [vector(x.as_py()).astype(np.float16).tobytes() for x in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["grade", "x"])
    give_back()


class Model:
    """weights, thresholds (ascending) between neighbouring grades, and the grades."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: np.ndarray):
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each grade but the first, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - (x @ self.weights)[:, None], -30, 30)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = 0.3) -> Model:
    """Maximum likelihood by Adam; thresholds are the first one and the logarithms of the gaps."""
    grades, k = np.unique(y, return_inverse=True)
    if len(grades) < 2:
        return Model(np.zeros(x.shape[1]), np.full(0, 0.0), grades.astype(float) if len(grades) else np.zeros(1))
    n, m = len(x), len(grades) - 1
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    share = np.clip(np.cumsum(np.bincount(k)[:-1]) / n, 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    params = np.concatenate([np.zeros(x.shape[1]), start[:1], np.log(np.maximum(1e-3, np.diff(start)))])
    mean, var = np.zeros_like(params), np.zeros_like(params)
    d = x.shape[1]
    for t in range(1, rounds + 1):
        cuts = params[d] + np.concatenate([[0.0], np.cumsum(np.exp(params[d + 1 :]))])
        by_weight, by_cut = PENALTY * params[:d], np.zeros(m)
        for a in range(0, n, ROWS):  # a few rows at a time as full numbers
            part, own = x[a : a + ROWS].astype(np.float32), k[a : a + ROWS]
            z = part @ params[:d].astype(np.float32)
            high = np.where(own < m, sigmoid(cuts[np.minimum(own, m - 1)] - z), 1.0)
            low = np.where(own > 0, sigmoid(cuts[np.maximum(own, 1) - 1] - z), 0.0)
            p = np.maximum(high - low, 1e-9)
            up, down = high * (1 - high) / p, low * (1 - low) / p
            by_cut -= (np.bincount(np.minimum(own, m - 1), np.where(own < m, up, 0), m) - np.bincount(np.maximum(own, 1) - 1, np.where(own > 0, down, 0), m)) / n
            by_weight = by_weight + (up - down).astype(np.float32) @ part / n
        slope = np.concatenate([by_weight, [by_cut.sum()], [by_cut[i:].sum() * np.exp(params[d + i]) for i in range(1, m)]])
        mean, var = 0.9 * mean + 0.1 * slope, 0.999 * var + 0.001 * slope**2
        params = params - rate * mean / (1 - 0.9**t) / (np.sqrt(var / (1 - 0.999**t)) + 1e-8)
    return Model(params[:d], params[d] + np.concatenate([[0.0], np.cumsum(np.exp(params[d + 1 :]))]), grades.astype(float))


def train(spark: SparkSession, rated: DataFrame, id_col: str, text_col: str, grade_col: str, sample: int = SAMPLE) -> Model:
    rows = rated.where(F.col(grade_col).isNotNull()).select(F.col(id_col), F.col(grade_col).cast("double").alias("grade"), text_of(text_col).alias("text"))
    stash = Stash(spark)
    seen = stash(sampled(rows, id_col, sample).select("grade", "text").repartition(8).mapInArrow(_vectors, "grade double, x binary"), "vectors")
    n = seen.count()  # at most sample rows; they come one partition at a time
    x, y = np.empty((n, FEATURES), np.float16), np.empty(n)
    for i, row in enumerate(seen.orderBy("grade", F.xxhash64("x")).toLocalIterator()):
        x[i], y[i] = np.frombuffer(row["x"], np.float16), row["grade"]
    stash.clear(seen)
    return fit(x, y)


def _judge(model, tail):
    def run(batches):
        for batch in sliced(batches, -1):
            m = model.value
            x = np.empty((batch.num_rows, FEATURES), np.float32)
            for i, t in enumerate(batch.column(batch.num_columns - 1)):
                x[i] = vector(t.as_py())
            tails = m.tails(x)
            at = int((m.grades[1:] < tail).sum())
            own = tails[:, at] if at < tails.shape[1] else np.ones(len(x)) if len(m.grades) < 2 else np.zeros(len(x))
            yield replaced(batch.select(batch.schema.names[:-1]), expected_grade=pa.array(m.expected(tails), pa.float64()), tail_probability=pa.array(own, pa.float64()))
        give_back()

    return run


def judged(docs: DataFrame, model: Model, text_col: str = "text", tail: float = 1.0) -> DataFrame:
    """docs with expected_grade and tail_probability, that of a grade of tail or more."""
    new = ("expected_grade", "tail_probability")
    src = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new), text_of(F.col(f"`{text_col}`")).alias("__text"))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in src.schema[:-1]), *(T.StructField(c, T.DoubleType()) for c in new)])
    return src.mapInArrow(_judge(docs.sparkSession.sparkContext.broadcast(model), tail), schema)


def op3_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(spark, docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id"), "doc_id", "text", "quality")
    return judged(docs, model).select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= KEEP).alias("kept"))
