"""Stages that have to be made anew, against a walk over the graph on Python values."""

import random

from foliant.operators import recompute as R
from foliant.streaming.jobs import RERUN


def test_followers(spark):
    got = {(r.stage, r.follower) for r in R.followers(spark).collect()}
    assert {b for a, b in got if a == "names"} == {"meta", "places", "aggregate"} and {b for a, b in got if a == "ocr"} == {"classify", "names", "meta", "places", "aggregate"}
    passes = {(r.stage, r.follower) for r in R.followers(spark, R.PASSES).collect()}
    # What a rerun of a pass makes anew beside itself, merging and the rule filter.
    for start, made in RERUN.items():
        assert {b for a, b in passes if a == start} - {"merged", "rule_filter"} == made - {start}


def plainly(pages, held):
    ups = {s: [a for a, b in R.EDGES if b == s] for s in {s for e in R.EDGES for s in e}}
    out = set()
    order = ["ingest", "ocr", "classify", "names", "meta", "places"]
    for doc, page in pages:
        for s in order:
            a = held.get((doc, page, s))
            if a is None or any((doc, page, u) in out for u in ups[s]) or any(held.get((doc, page, u), (None,))[0] != h for u, h in a[1].items()):
                out.add((doc, page, s))
    return out


def test_against_a_walk(spark):
    rng, held, pages = random.Random(3), {}, []
    order = ["ingest", "ocr", "classify", "names", "meta", "places"]
    ups = {s: [a for a, b in R.EDGES if b == s] for s in order}
    for page in range(1, 120):
        doc = f"d{page % 7}"
        pages.append((doc, page))
        old = {s: f"{s} {page}" for s in order}
        now = {s: h + (" new" if rng.random() < 0.08 else "") for s, h in old.items()}
        for s in order:
            if rng.random() < 0.95:
                held[doc, page, s] = (now[s], {u: old[u] for u in ups[s]})
    rows = [(d, p, s, h, u) for (d, p, s), (h, u) in held.items()]
    df = spark.createDataFrame(rows, R.ARTIFACTS)
    hashes = {(r.doc_id, r.stage): r.hash for r in R.pages_hash(df).collect()}
    whole = [(f"d{k}", 0, "aggregate", "t", {u: hashes[f"d{k}", u] for u in ("classify", "meta", "places")}) for k in range(6)]
    docs = spark.createDataFrame(pages + [("e", 1)], "doc_id string, page int")
    got = {tuple(r) for r in R.to_make(docs, df.unionByName(spark.createDataFrame(whole, R.ARTIFACTS))).collect()}
    want = plainly(pages + [("e", 1)], held)
    assert {x for x in got if x[1]} == want
    assert {x[0] for x in got if not x[1]} == {d for d, _, _ in want} | {"d6", "e"}


def test_names_made_again_leave_meta_and_places_stale(spark):
    """A page whose names were made again: what was made of them is stale, and the document's tables; other pages are as they were."""
    base = [("d", p, s, s, {u: u for u, t in R.EDGES if t == s}) for p in (1, 2) for s in ("ingest", "ocr", "classify", "names", "meta", "places")]
    df = spark.createDataFrame(base, R.ARTIFACTS)
    total = [("d", 0, "aggregate", "t", {r.stage: r.hash for r in R.pages_hash(df).collect() if r.stage in ("classify", "meta", "places")})]
    fresh = df.unionByName(spark.createDataFrame(total, R.ARTIFACTS))
    assert R.stale(fresh).count() == 0
    again = spark.createDataFrame([(d, p, s, "names made again" if (p, s) == (1, "names") else h, u) for d, p, s, h, u in base] + total, R.ARTIFACTS)
    assert {(r.page, r.stage, r.because) for r in R.stale(again).collect()} == {(1, "meta", "names"), (1, "places", "names"), (0, "aggregate", "names")}
    assert R.to_make(df.select("doc_id", "page"), spark.createDataFrame([], R.ARTIFACTS)).count() == 13


def test_fingerprints_are_not_brought_to_the_driver(spark):
    """Only the graph of stages is broadcast, however small the artifacts are as files."""
    held = spark.range(20).selectExpr("concat('d', id % 3) as doc_id", "cast(id as int) as page", "'ocr' as stage", "'h' as hash", "map('ingest', 'old') as used")
    plan = R.to_make(held.select("doc_id", "page"), held)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 5 and plan.count("BroadcastHashJoin") == 2
