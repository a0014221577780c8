"""Toxicity by a linear classifier of character n-grams that are scaled by naive Bayes log-count ratios.

Features are the hashed n-grams of the characters of a lower-cased text that it holds at least once, twice, three and five times: an n-gram that any text may hold once can mark
a class when it returns. Of these, the KEPT with the clearest ratio get weights: each is scaled by its log-count ratio, and logistic regression with an L2 penalty, in which both
classes weigh the same, fits the weights; the others count for nothing, so that a long text isn't judged by its length (on folds of the training rows of sf0.1, 30,000 features
found fewer toxic rows than 4000 did, 255 of 305 at most against 275).
Fitting takes at most SAMPLE labelled rows; the driver holds their chosen features alone. Weights are broadcast: at most KEPT numbers in a table of fixed size.

Nulls and empty texts score as a text without n-grams. Ids may repeat or be null: a row with a null label or id is not learnt from, and a document with several labels is
learnt once for each. Rows that tie or repeat score alike; empty tables give no rows; a long text is hashed in pieces. Without rows of both classes the score is the share of toxic labels (0.5 without labels). Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, table, text_of
from .hashed import grams, sampled
from .slices import sliced

SIZES, BITS, SAMPLE, KEPT, SMOOTH, PENALTY, BALANCE, LIMIT = (3, 4, 5, 6), 18, 6000, 4000, 1.0, 0.005, 1.0, 0.7
#: A bucket has a feature for each of these numbers of occurrences; those of one number are BUCKETS apart from those of the next.
TIMES, BUCKETS = (1, 2, 3, 5), 1 << BITS


def _characters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text between two spaces."""
    return np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), np.uint32)


def _at_least(buckets: list[np.ndarray]) -> np.ndarray:
    """Features of a text with these buckets, each listed as often as it occurs."""
    if not buckets:
        return np.empty(0, np.int64)
    own, n = np.unique(np.concatenate(buckets), return_counts=True)
    return np.concatenate([own[n >= times] + i * BUCKETS for i, times in enumerate(TIMES)])


def features(text: str | None) -> np.ndarray:
    return _at_least(list(grams(_characters(text), SIZES, BITS)))


def _features(batches):
    for batch in sliced(batches, -1):
        out = [features(x.as_py()) for x in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int32) for x in out], pa.list_(pa.int32()))], names=["y", "features"])


def _counts(batches):
    """Documents of each class that have each feature, summed over a batch."""
    for batch in batches:
        y = batch.column(0).to_numpy()
        lists = batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        values = lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
        for label in (0, 1):
            n = np.bincount(values[np.repeat(y, sizes) == label], minlength=len(TIMES) * BUCKETS)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), label, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["y", "feature", "n"])


def _chosen(at):
    def run(batches):
        for batch in batches:
            # As bytes: a list in a row that is collected holds an object for each number.
            out = [np.flatnonzero(np.isin(at, x.values.to_numpy(), assume_unique=True)).astype(np.int32).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["y", "places"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300, balance: float = BALANCE) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient steps; a row of label 1 counts as much more as the other label has more rows, to the power balance."""
    n, d = x.shape
    ones = max(1, int(y.sum()))
    own = np.where(y == 1, max(1, n - ones) / ones, 1.0) ** balance
    own = (own / own.mean()).astype(np.float32)
    w, b, v, c = np.zeros(d, np.float32), 0.0, np.zeros(d, np.float32), 0.0
    step = 1.0 / (0.25 * float(np.einsum("ij,ij,i->", x, x, own) / n + own.max()) + penalty)
    for k in range(rounds):
        wz, bz = w + k / (k + 3) * v, b + k / (k + 3) * c
        err = ((1 / (1 + np.exp(-np.clip(x @ wz + bz, -30, 30))) - y) * own).astype(np.float32)
        new, newb = wz - step * (x.T @ err / n + penalty * wz), bz - step * float(err.mean())
        v, c, w, b = new - w, newb - b, new, newb
    return w, b


class Model:
    def __init__(self, chosen: np.ndarray, weights: np.ndarray, bias: float):
        self.of = np.zeros(len(TIMES) * BUCKETS)
        self.of[chosen] = weights
        self.used = (self.of.reshape(len(TIMES), BUCKETS) != 0).any(axis=0)
        self.bias = bias

    def score(self, text: str) -> float:
        found = [x[self.used[x]] for x in grams(_characters(text), SIZES, BITS)]
        z = self.bias + float(self.of[_at_least(found)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(spark: SparkSession, labelled: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> Model:
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(F.col(id_col), F.col(label_col).cast("int").alias("y"), text_of(text_col).alias("text"))
    stash = Stash(spark)
    seen = stash(sampled(rows, id_col, sample).select("y", "text").repartition(8).mapInArrow(_features, "y int, features array<int>"), "features")
    many = {r["y"]: r["count"] for r in seen.groupBy("y").count().collect()}
    if len(many) < 2:
        share = many.get(1, 0) / max(1, sum(many.values())) if many else 0.5
        share = min(0.99, max(0.01, share))
        return Model(np.empty(0, int), np.empty(0), float(np.log(share / (1 - share))))
    held = seen.mapInArrow(_counts, "y int, feature int, n long").groupBy("feature").agg(*(F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)))
    p, q = ((F.col(f"n{y}") + SMOOTH) / (many[y] + 2 * SMOOTH) for y in (1, 0))
    # The clearest: many standard errors from no difference, and held by several documents.
    clear = F.abs(p - q) / F.sqrt(p * (1 - p) / many[1] + q * (1 - q) / many[0] + 1e-9)
    best = held.where("n0 + n1 >= 5").select("feature", F.log(p / q).alias("ratio"), clear.alias("clear")).where("clear > 2.5").orderBy(F.desc("clear"), "feature").limit(KEPT).toPandas().sort_values("feature")
    at, ratio = best["feature"].to_numpy(np.int64), best["ratio"].to_numpy(np.float64)
    fed = seen.mapInArrow(_chosen(at), "y int, places binary").toPandas().sort_values(["y", "places"])  # one order of the rows, one sum
    stash.clear(seen)
    x = np.zeros((len(fed), len(at)), np.float32)
    for i, places in enumerate(fed["places"]):
        f = np.frombuffer(places, np.int32)
        x[i, f] = ratio[f]
    w, b = logistic(x, fed["y"].to_numpy(np.float32), PENALTY)
    return Model(at, w * ratio, b)


def _score(model):
    def run(batches):
        for batch in sliced(batches, -1):
            scores = [model.value.score(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias(id_col), text_of(text_col).alias("text")).mapInArrow(_score(shared), f"{id_col} long, score double")


def held_out(i: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(i).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id")).select("doc_id", "toxic")
    model = train(spark, docs.join(labels, "doc_id"), "doc_id", "text", "toxic")
    return scored(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
