"""The n-gram Jaccard join against all pairs: odd texts, repeated and null ids, near copies, hot passages."""

import random

import numpy as np
import pytest

from foliant.llm import ngram_join
from foliant.llm.shingles import linked, need, shingles

rng = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(3000)]


def words(n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def edited(text, share):
    return [w if rng.random() > share else rng.choice(VOCABULARY) for w in text]


def roots(rows):
    """The first row that each row reaches by links and equal sets, and the sets."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a) and linked(a, sets[j]):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(rows))], sets


def brute(rows):
    """(id, n_shingles, component) of each row: the smallest non-null id that it reaches."""
    root, sets = roots(rows)
    members = {}
    for r, (i, _) in zip(root, rows):
        members.setdefault(r, []).append(i)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in members.items()}
    return sorted(((i, len(s), least[r] if len(s) else i) for (i, _), s, r in zip(rows, sets, root)), key=str)


def plain_shingles(text):
    """Distinct five-word shingles as texts: what the 64-bit names stand for."""
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


BASE = words(160)
FIXTURE = [
    *((i, t) for i, t in enumerate([None, "", " \t\n", "a", "A", "a b c", "A  b\tc", "é😀 漢字", "x" * 5000, " a b"])),
    *((100 + i, " ".join(edited(BASE, rng.random() * 0.12))) for i in range(60)),  # near copies, many of them not linked with each other
    *((200 + i, " ".join(BASE)) for i in range(20)),
    *((300 + i, " ".join(words(40) + BASE[:60] + words(40))) for i in range(60)),  # a passage that many share
    *((400 + i, " ".join(words(rng.randrange(1, 80)))) for i in range(60)),
    *((500 + i // 2, " ".join(edited(words(50), 0.0))) for i in range(8)),  # ids that repeat with other texts
    (500, " ".join(BASE)), (500, " ".join(BASE)), (501, " ".join(BASE[:-1])),
    *((None, t) for t in (None, "", " ".join(BASE), " ".join(BASE) + " x", "nobody has this text but two rows", "nobody has this text but two rows")),
    (600, " ".join(words(30_000))),
]
FIXTURE += [(601, FIXTURE[-1][1] + " tail"), (0, "a b c d e f g"), (0, "a b c d e f g")]
FIXTURE += [(700 + i, " ".join(c)) for i, c in enumerate([edited(BASE, 0.03) for _ in range(30)])]


def test_shingles_are_those_of_the_contract():
    for _, t in FIXTURE:
        assert len(shingles(t)) == len(plain_shingles(t))


def test_against_all_pairs(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in FIXTURE], "doc_id long, text string, sig string, n int")
    got = sorted(((r.id, r.n_shingles, r.component) for r in ngram_join.ngram_groups(spark, df).collect()), key=str)
    assert got == brute(FIXTURE)


def test_links_are_exact_at_the_threshold():
    for a in range(1, 60):
        for b in range(1, 60):
            for both in range(min(a, b) + 1):
                x, y = np.arange(a, dtype=np.uint64), np.arange(a - both, a - both + b, dtype=np.uint64)
                assert linked(x, y) == (100 * both >= 75 * (a + b - both)) == (both >= need(a, b))


def test_repeated_ids_lose_no_link(spark):
    x, y = " ".join(words(40)), " ".join(words(40))
    rows = [(1, x), (1, y), (2, x + " tail"), (3, y + " tail")]
    got = sorted((r.id, r.component) for r in ngram_join.ngram_groups(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_one_of_each(spark):
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(FIXTURE)], "doc_id long, text string, id int")
    kept = ngram_join.one_of_each(spark, df).collect()
    assert df.columns == list(kept[0].asDict())
    root, sets = roots(FIXTURE)
    assert sorted(r.id for r in kept if not len(sets[r.id])) == [k for k, s in enumerate(sets) if not len(s)]
    of = [r for r in kept if len(sets[r.id])]
    assert sorted(root[r.id] for r in of) == sorted({r for r, s in zip(root, sets) if len(s)})  # one row of each component
    for r in of:
        ids = [FIXTURE[k][0] for k in range(len(FIXTURE)) if root[k] == root[r.id]]
        assert r.doc_id == min((i for i in ids if i is not None), default=None)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.ngram_groups(spark, df).collect() == []
    assert ngram_join.one_of_each(spark, df).collect() == []


@pytest.mark.parametrize("times", [0, 1, 5])
def test_frequent_tokens_are_bounded(spark, times, monkeypatch):
    monkeypatch.setattr(ngram_join, "MOST", 10)
    rows = [(i, 100 - i) for i in range(8 * times)]
    tokens, counts = ngram_join._frequent(spark.createDataFrame(rows, "token long, times long"))
    assert len(tokens) <= 10 and sorted(counts, reverse=True) == [100 - i for i in range(len(counts))]
