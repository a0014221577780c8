"""What the join of texts asks of the driver: rounds, and the maps that it broadcasts."""

import random

from foliant.llm import ngram_join
from foliant.llm.common import Stash, components


def counted(monkeypatch):
    calls, plain = [], Stash.__call__
    monkeypatch.setattr(Stash, "__call__", lambda self, df, name=None, **how: (calls.append(name), plain(self, df, name, **how))[1])
    return calls


def plain_components(edges):
    root = {}

    def top(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if None not in (a, b) and a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return sorted((i, top(i)) for i in root)


def test_stars_take_no_round(spark, monkeypatch):
    calls = counted(monkeypatch)
    edges = [(10 * k, 10 * k + i) for k in range(20) for i in range(1, 5)] + [(3, 3), (None, 4), (10, 0)]
    edges = edges[:-1] + edges[:7]
    got = components(Stash(spark), spark.createDataFrame(edges, "u long, v long"))
    assert sorted(map(tuple, got.collect())) == plain_components(edges)
    assert calls == ["edges"]


def test_rounds_end_with_the_stars(spark, monkeypatch):
    rng = random.Random(8)
    for edges in ([(i, i + 1) for i in range(40)], [(rng.randrange(90), rng.randrange(90)) for _ in range(80)], []):
        calls = counted(monkeypatch)
        frame = spark.createDataFrame(edges, "u long, v long")
        got = components(Stash(spark), frame)
        rows = sorted(map(tuple, got.collect()))
        assert rows == plain_components(edges)
        if edges:  # one round fewer gives no stars
            try:
                components(Stash(spark), frame, rounds=len(calls) // 2)
            except RuntimeError:
                continue
            raise AssertionError("a round too many")


def test_maps_are_rows_of_many_words(spark, monkeypatch):
    seen, plain = [], ngram_join.F.broadcast
    monkeypatch.setattr(ngram_join.F, "broadcast", lambda df: (seen.append(df), plain(df))[1])
    rows = spark.range(60_000).selectExpr("if(id % 1000 = 7, null, id) as k", "id as x")
    wanted = spark.range(0, 60_000, 3).selectExpr("id as q").unionByName(spark.sql("select cast(null as bigint) q"))
    got = ngram_join._marked(rows, "k", wanted, "q").collect()
    assert seen[0].count() == ngram_join.CELLS // 64 // ngram_join.BLOCK
    assert len(got) == 60_000 and all(r["__hit"] for r in got if r.k is None or r.k % 3 == 0)
    assert sum(r["__hit"] for r in got) < 20_200
    assert not any(r["__hit"] for r in ngram_join._marked(rows, "k", wanted.limit(0), "q").collect())


def test_texts_without_pairs_need_few_writes(spark, monkeypatch):
    calls = counted(monkeypatch)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(20)]
    got = ngram_join.ngram_groups(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id, r.component) for r in got) == [(i, i) for i in range(20)]
    assert not {"intersected", "links", "large", "small"} & set(calls)
