"""Classifiers: what they learn from simulated ratings and labels, on rows they haven't seen; odd texts and tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from foliant.llm import hashed, quality, toxicity

rng = random.Random(6)
CALM = [f"{a}{b}{c}" for a in "bdfgl" for b in "aeiou" for c in ("n", "rd", "st", "m")]
RUDE = ["idiot", "trash", "scum", "moron", "pathetic", "dämlich"]


def toxic_text():
    w = [rng.choice(CALM) for _ in range(rng.randrange(20, 200))]
    bad = rng.random() < 0.3
    for _ in range(max(2, len(w) // 15) if bad else 0):
        w[rng.randrange(len(w))] = rng.choice(RUDE)
    return " ".join(w), int(bad)


def test_classifiers(spark):
    rows = [(i, ("you vile thing " if i % 4 == 0 else "a nice thing ") * (1 + i % 5), int(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = toxicity.train(spark, df, "doc_id", "text", "y")
    assert all((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in toxicity.scored(df, model).collect())
    graded = spark.createDataFrame([(i, ["zz!", "some words", "many fine words"][i % 3] * (1 + i % 4), i % 3) for i in range(150)], "doc_id long, text string, g int")
    fitted = quality.train(spark, graded, "doc_id", "text", "g")
    assert (np.diff(fitted.thresholds) > 0).all()
    mean = {i: [] for i in range(3)}
    for r in quality.judged(graded, fitted).collect():
        mean[r.g].append(r.expected_grade)
    assert np.mean(mean[0]) < np.mean(mean[1]) < np.mean(mean[2])


def test_toxicity_on_rows_not_seen(spark):
    rows = [(i, *toxic_text()) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = toxicity.train(spark, df.where("doc_id < 1000"), "doc_id", "text", "y")
    got = {r.doc_id: r.score for r in toxicity.scored(df.where("doc_id >= 1000"), model).collect()}
    toxic = [got[i] >= toxicity.LIMIT for i, _, y in rows[1000:] if y]
    clean = [got[i] >= toxicity.LIMIT for i, _, y in rows[1000:] if not y]
    assert np.mean(toxic) > 0.95 and np.mean(clean) < 0.01


def test_features_are_those_of_characters():
    """The hash of each n-gram of code points, by itself, and how often it occurs; pieces change nothing."""
    text = "Ä bc é😀 äb bc é bc é"
    want = Counter()
    low = f" {text.lower()} "
    for n in toxicity.SIZES:
        for i in range(len(low) - n + 1):
            want.update(np.concatenate(list(hashed.grams(np.array([ord(c) for c in low[i : i + n]], np.uint32), (n,), toxicity.BITS))).tolist())
    times = [{b for b in want if want[b] >= t} for t in toxicity.TIMES]
    assert len(times[0]) > len(times[1]) > len(times[2]) > len(times[3]) == 0
    assert sorted(toxicity.features(text).tolist()) == sorted(b + i * toxicity.BUCKETS for i, own in enumerate(times) for b in own)


def test_query_against_a_plain_version(spark, tmp_path):
    """op10 on its tables: which features are chosen, their ratios, and the scores of the fitted weights, computed text by text; then rows held out."""
    rows = [(i, *toxic_text()) for i in range(900)]
    spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.op10_toxicity(spark, str(tmp_path)).collect()}
    out = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert set(got) == set(range(900)) and {i for i in got if got[i].held_out} == out
    have = {i: set(toxicity.features(t).tolist()) for i, t, _ in rows}
    learnt = [(have[i], y) for i, _, y in rows if i not in out]
    total = Counter(y for _, y in learnt)
    n = {y: Counter(f for own, label in learnt if label == y for f in own) for y in (0, 1)}
    ratio, clear = {}, {}
    for f in set(n[0]) | set(n[1]):
        p, q = ((n[y][f] + 1) / (total[y] + 2) for y in (1, 0))
        c = abs(p - q) / math.sqrt(p * (1 - p) / total[1] + q * (1 - q) / total[0] + 1e-9)
        if n[0][f] + n[1][f] >= 5 and c > 2.5:
            ratio[f], clear[f] = math.log(p / q), c
    chosen = sorted(sorted(ratio, key=lambda f: (-clear[f], f))[: toxicity.KEPT])
    x = np.array([[ratio[f] if f in own else 0.0 for f in chosen] for own, _ in learnt])
    y = np.array([label for _, label in learnt])
    w, b = toxicity.logistic(x.astype(np.float32), y.astype(np.float32), toxicity.PENALTY)
    for i, _, _ in rows:
        z = b + sum(w[k] * ratio[f] for k, f in enumerate(chosen) if f in have[i])
        assert abs(got[i].score - 1 / (1 + math.exp(-z))) < 0.01 and got[i].predicted == int(got[i].score >= 0.7)
    caught = [got[i].predicted == y for i, _, y in rows if i in out]
    assert np.mean(caught) > 0.97


def test_weights_are_at_the_least_loss():
    """The slope of the loss is next to nothing where the fit ends."""
    g = np.random.default_rng(2)
    x = g.normal(size=(500, 20)).astype(np.float32)
    y = (x[:, 0] - x[:, 1] + g.logistic(size=500) > 1.5).astype(np.float32)
    w, b = toxicity.logistic(x, y, 0.005)
    own = np.where(y == 1, (y == 0).sum() / y.sum(), 1.0)
    err = (1 / (1 + np.exp(-(x @ w + b))) - y) * own / own.mean()
    assert np.abs(x.T @ err / 500 + 0.005 * w).max() < 1e-3 and abs(err.mean()) < 1e-3


def test_an_n_gram_that_returns_marks_a_class(spark):
    """One use of a stem is common to both classes, several are not."""
    def text(y):
        w = [rng.choice(CALM) for _ in range(60)]
        for i in rng.sample(range(60), rng.randrange(3, 6) if y else rng.randrange(0, 2)):
            w[i] = "achlich" + rng.choice(CALM)
        return " ".join(w)

    rows = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = toxicity.train(spark, df.where("doc_id < 600"), "doc_id", "text", "y")
    said = {r.doc_id: r.score >= toxicity.LIMIT for r in toxicity.scored(df.where("doc_id >= 600"), model).collect()}
    assert np.mean([said[i] for i, _, y in rows[600:] if y]) > 0.9 and np.mean([said[i] for i, _, y in rows[600:] if not y]) < 0.02


def test_pieces_count_each_place_once(monkeypatch):
    data = np.array([rng.randrange(256) for _ in range(1000)], np.uint8)
    whole = np.sort(np.concatenate(list(hashed.grams(data, (1, 2, 3), 11))))
    monkeypatch.setattr(hashed, "PIECE", 37)
    assert np.sort(np.concatenate(list(hashed.grams(data, (1, 2, 3), 11)))).tolist() == whole.tolist()


def test_ordinal_fit_recovers_simulated_thresholds():
    g = np.random.default_rng(1)
    x, w = g.normal(size=(6000, 3)), np.array([2.0, -1.0, 0.5])
    z = x @ w + g.logistic(size=6000)
    model = quality.fit(x, np.digitize(z, [-1.0, 0.5, 2.0]).astype(float), rounds=600, rate=0.05)
    assert np.abs(model.weights - w).max() < 0.2 and np.abs(model.thresholds - [-1.0, 0.5, 2.0]).max() < 0.2
    tails = model.tails(x)
    assert (np.diff(tails, axis=1) <= 0).all()
    expected = model.expected(tails)
    assert np.allclose(expected, sum(k * p for k, p in enumerate(np.diff(np.concatenate([np.ones((6000, 1)), tails, np.zeros((6000, 1))], 1) * -1, axis=1).T)))


ODD = [(None, None), (1, None), (1, ""), (2, "x"), (2, "x"), (3, "é😀" * 400_000)]


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 1), (None, 1), (3, None), (2, 1)]])
def test_odd_tables(spark, labels):
    docs = spark.createDataFrame([(i, t, 5.0, "y") for i, t in ODD], "doc_id long, text string, tail_probability double, grade string")
    rated = docs.select("doc_id", "text").join(spark.createDataFrame(labels, "doc_id long, y int"), "doc_id")
    scores = toxicity.scored(docs, toxicity.train(spark, rated, "doc_id", "text", "y")).collect()
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)
    judged = quality.judged(docs, quality.train(spark, rated, "doc_id", "text", "y")).collect()
    assert len(judged) == len(ODD) and all(0 <= r.tail_probability <= 1 and r.grade == "y" for r in judged)
    empty = docs.limit(0)
    assert quality.judged(empty, quality.train(spark, rated.limit(0), "doc_id", "text", "y")).collect() == []
    assert toxicity.scored(empty, toxicity.train(spark, rated.limit(0), "doc_id", "text", "y")).collect() == []
