"""Mixing sources to target weights: min-cost flow from membership patterns to source quotas, then seeded documents.

Documents are summed by pattern (the set of their sources). A pattern's words can be taken once, and up to REPEATS times at a cost that grows with each pass;
the flow fills the quotas of the sources as far as there are words, at the least cost. Of what a pattern gives, whole passes go to all its documents
and the rest to those first in a seeded order: all up to the first one that doesn't fit, then, from there on, those that still fit into what is left, up to STEPS times;
at last the smallest one left, if that comes nearer. Each cut is found by sums over BUCKETS ranges of the order, then within one range.

The driver holds a row a pattern, at most MAX_PATTERNS, else an error. Null texts have size 0; a null source is a source of its own, the last one; null ids are
ordered as 0. Rows that repeat an id stand at one place of the order, and those of one size are taken alike. An empty table gives no rows. Columns keep their
names, but one named size or copies is replaced. Reruns agree: order and flow depend on the rows alone.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, Stash, table, text_of

WEIGHTS, TOTAL, REPEATS, SEED, BUCKETS, MAX_PATTERNS, STEPS = (3, 1, 2), 1.5, 2, 17, 4096, 100_000, 12


def words(text: str = "text") -> Column:
    return F.regexp_count(text_of(F.col(text)), F.lit(WORD)).cast("long")


def ordered(sources: set) -> list:
    """By code point, null last."""
    return sorted((s for s in sources if s is not None)) + ([None] if None in sources else [])


def targets(sizes: dict, total: int, weights=WEIGHTS, share: float = TOTAL, repeats: int = REPEATS) -> dict:
    """Words asked of each source: shares of the total by weight; what exceeds repeats times a source's size is dealt to the others by weight."""
    names = ordered(set(sizes))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict = {}
    left, free = share * total, list(names)
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * unit > repeats * sizes[s]]
        if not full:
            return out | {s: weight[s] * unit for s in free}
        for s in full:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def flow(patterns: dict[tuple, int], quotas: dict, repeats: int = REPEATS) -> dict[tuple, int]:
    """Words taken of each pattern: a maximum flow into the quotas, at the least cost when pass k costs 2 k - 1 a word."""
    names, keys = ordered(set(quotas)), list(patterns)
    start, end = 0, 1 + len(keys) + len(names)
    graph: list[list[list]] = [[] for _ in range(end + 1)]

    def arc(a, b, room, cost):
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    at = {s: 1 + len(keys) + i for i, s in enumerate(names)}
    for i, p in enumerate(keys):
        for k in range(repeats):
            arc(start, 1 + i, patterns[p], 2 * k + 1)
        for s in p:
            arc(1 + i, at[s], repeats * patterns[p], 0)
    for s in names:
        arc(at[s], end, round(quotas[s]), 0)
    rise = [0] * (end + 1)
    while True:
        far, via = [float("inf")] * (end + 1), [None] * (end + 1)
        far[start], heap = 0, [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, (b, room, cost, _) in enumerate(graph[a]):
                if room > 0 and (new := d + cost + rise[a] - rise[b]) < far[b]:
                    far[b], via[b] = new, (a, k)
                    heapq.heappush(heap, (new, b))
        if via[end] is None:
            break
        for i, d in enumerate(far):
            rise[i] += d if d < float("inf") else 0
        push, b = float("inf"), end
        while b != start:
            a, k = via[b]
            push, b = min(push, graph[a][k][1]), a
        b = end
        while b != start:
            a, k = via[b]
            graph[a][k][1] -= push
            graph[b][graph[a][k][3]][1] += push
            b = a
    return {p: sum(graph[1 + i][j][1] for j in range(len(graph[1 + i])) if graph[1 + i][j][0] == start) for i, p in enumerate(keys)}


@dataclass
class Plan:
    sizes: dict
    targets: dict
    rows: list[tuple]  # pattern key, whole passes, steps of one more: (from, to], places (order, id), for documents up to a size


def _key(sources: Column) -> Column:
    """A name of the set of sources; null entries have a sign of their own."""
    return F.to_json(F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.concat(F.when(s.isNull(), "0").otherwise("1"), F.coalesce(s, F.lit("")))))))


def _order(i: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{i}`"), F.lit(0)).cast("long"), F.lit(SEED))


_FIRST, _LAST = (-(2**63), -(2**63)), (2**63 - 1, 2**63 - 1)


def _prefix(spark: SparkSession, sized: DataFrame, asked: dict[str, tuple]) -> dict[str, tuple]:
    """For each key with (room, greatest size, place): the place up to which documents of that size after the place fit into the room together, and their words."""
    rows = F.broadcast(spark.createDataFrame([(k, room, most, *at) for k, (room, most, at) in asked.items()], "key string, room long, most long, h0 long, id0 long"))
    bucket = F.least(F.floor((F.col("h") / 2.0**64 + 0.5) * BUCKETS).cast("int"), F.lit(BUCKETS - 1))
    dealt = sized.join(rows, "key").where("size <= most and struct(h, id) > struct(h0, id0)").withColumn("bucket", bucket)
    by = dealt.groupBy("key", "room", "bucket").agg(F.sum("size").alias("size"))
    by = by.withColumn("upto", F.sum("size").over(W.partitionBy("key").orderBy("bucket")))
    cuts = by.groupBy("key").agg(F.min(F.when(F.col("upto") > F.col("room"), F.struct("bucket", (F.col("upto") - F.col("size")).alias("before")))).alias("edge"), F.max(F.when(F.col("upto") <= F.col("room"), F.col("upto"))).alias("upto")).collect()
    edge = [(r["key"], *r["edge"]) for r in cuts if r["edge"]]
    every = {r["key"]: r["upto"] for r in cuts if r["upto"] is not None}
    out = {k: (_LAST, every.get(k, 0)) for k in asked}
    if edge:
        at = F.broadcast(spark.createDataFrame(edge, "key string, bucket int, before long"))
        near = dealt.join(at, ["key", "bucket"]).withColumn("upto", F.col("before") + F.sum("size").over(W.partitionBy("key").orderBy("h", "id"))).where("upto <= room")
        last = {r["key"]: r["last"] for r in near.groupBy("key").agg(F.max(F.struct("h", "id", "upto")).alias("last")).collect()}
        for key, bucket, before in edge:  # none of the range: the cut is before it
            found = last.get(key)
            begin = (int((bucket / BUCKETS - 0.5) * 2**64) - 1, 2**63 - 1) if bucket else _FIRST
            out[key] = ((found["h"], found["id"]), found["upto"]) if found else (max(begin, asked[key][2]), before)
    return out


def plan(spark: SparkSession, docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text", **how) -> Plan:
    stash = Stash(spark)
    sized = stash(docs.select(F.coalesce(F.col(f"`{id_col}`"), F.lit(0)).cast("long").alias("id"), words(f"`{text_col}`").alias("size"), _key(sources).alias("key"), _order(id_col).alias("h")), "sized")
    sums = sized.groupBy("key").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of sources")
    back = lambda key: tuple(ordered({None if x[0] == "0" else x[1:] for x in json.loads(key)}))
    patterns = {back(r["key"]): r["size"] for r in sorted(sums, key=lambda r: r["key"])}
    sizes = {s: sum(n for p, n in patterns.items() if s in p) for s in {s for p in patterns for s in p}}
    quotas = targets(sizes, sum(patterns.values()), **how)
    taken = flow(patterns, quotas, how.get("repeats", REPEATS))
    passes = {r["key"]: divmod(taken[back(r["key"])], r["size"]) if r["size"] else (0, 0) for r in sums}

    steps: dict[str, list[tuple]] = {k: [] for k in passes}
    asked = {k: (room, 2**62, _FIRST) for k, (_, room) in sorted(passes.items()) if room}
    left: dict[str, tuple] = {}
    for _ in range(STEPS):
        if not asked:
            break
        more = {}
        for k, (place, words_) in _prefix(spark, sized, asked).items():
            room, most, begin = asked[k]
            steps[k].append((*begin, *place, most))
            left[k] = (room - words_, place)
            if room > words_ and place != _LAST:
                more[k] = (room - words_, room - words_, place)
        asked = more
    ends = [(k, gap, [tuple(x) for x in steps[k]]) for k, (gap, _) in left.items() if gap]
    if ends:
        rows = F.broadcast(spark.createDataFrame(ends, f"key string, gap long, steps {_STEPS}"))
        rest = sized.join(rows, "key").where("size < 2 * gap").where(~_within("steps", F.struct("h", "id"), F.col("size")))
        for r in rest.groupBy("key").agg(F.min(F.struct("size", "h", "id")).alias("x")).select("key", "x.*").collect():
            if r["size"]:
                steps[r["key"]].append((r["h"], r["id"] - 1, r["h"], r["id"], r["size"]))
    stash.clear(sized)
    return Plan(sizes, quotas, [(k, whole, steps[k]) for k, (whole, _) in passes.items()])


_STEPS = "array<struct<h0:long,id0:long,h:long,id:long,most:long>>"


def _within(steps: str, place: Column, size: Column) -> Column:
    return F.exists(steps, lambda s: (size <= s["most"]) & (place > F.struct(s["h0"], s["id0"])) & (place <= F.struct(s["h"], s["id"])))


def with_copies(docs: DataFrame, plan: Plan, sources: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with size and copies, the passes that the mix makes over each row."""
    rows = docs.sparkSession.createDataFrame(plan.rows, f"__key string, __whole long, __steps {_STEPS}")
    out = docs.withColumn("__key", _key(sources)).withColumn("size", words(f"`{text_col}`")).join(F.broadcast(rows), "__key", "left")
    place = F.struct(_order(id_col), F.coalesce(F.col(f"`{id_col}`"), F.lit(0)).cast("long"))
    more = F.coalesce(_within("__steps", place, F.col("size")), F.lit(False))
    return out.withColumn("copies", (F.coalesce("__whole", F.lit(0)) + more.cast("int")).cast("long")).drop("__key", "__whole", "__steps")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    made = plan(spark, docs, F.array("source"))
    known = spark.createDataFrame([(s is None, s or "", n, float(made.targets[s])) for s, n in made.sizes.items()], "__none boolean, __source string, source_size long, target double")
    out = with_copies(docs, made, F.array("source")).withColumns({"__none": F.isnull("source"), "__source": F.coalesce("source", F.lit(""))}).join(F.broadcast(known), ["__none", "__source"], "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
