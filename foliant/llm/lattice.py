"""Near-duplicate vectors by lattice hashing: random projections to eight dimensions, decoded to the nearest point of E8.

Each of TABLES projections gives a vector its home cell and PROBES neighbouring cells, those whose points are nearest next. A pair is
compared where one's home is the other's home or probe. Cells meet in numpy blocks of at most 2 * CHUNK rows: a larger cell is cut into chunks and
each pair of chunks is a block. A linked pair counts once, in the first table that finds it, so no list of pairs is made: a block gives a count for each vector and
the edges of a spanning forest.

Rows with equal label and vector form a class, named by a number; cells, blocks and components hold classes, with how many vectors each stands for, so that copies cost
as much as one of them. A vector is a distinct (id, label, vector): rows that repeat it whole count once, an id that repeats with another vector is another one.

Vectors that are null, zero, or hold null or non-finite components, and vectors with a null label or id, link with nothing and are in the result. Vectors of different lengths
don't link. Extra columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, components, table
from .shingles import mix

TABLES, PROBES, SCALE, SEED, CHUNK = 8, 8, 1.35, 20, 1024


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1, 1):
                for b in (-1, 1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        v = np.array([0.5 if bits >> k & 1 else -0.5 for k in range(8)])
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


ROOTS = _roots()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    rest = x[odd] - near[odd]
    worst = np.abs(rest).argmax(1)
    near[odd, worst] += np.where(rest[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8: of the integer points with an even sum, or those moved by a half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _cells(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the home cell of each vector and table, and of its probes."""
    n, d = unit.shape
    spread = np.random.default_rng([SEED, d]).normal(size=(TABLES, d, 8)) / SCALE
    homes, probes = np.empty((n, TABLES), np.uint64), np.empty((n, TABLES, PROBES), np.uint64)

    def name(points, t):
        key = np.full(points.shape[:-1], t + 1, np.uint64)
        for k in range(8):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + (2 * points[..., k]).astype(np.int64).view(np.uint64))
        return key

    for t in range(TABLES):
        x = unit @ spread[t]
        home = nearest(x)
        order = np.argsort(-((x - home) @ ROOTS.T), axis=1, kind="stable")[:, :PROBES]
        homes[:, t] = name(home, t)
        probes[:, t] = name(home[:, None, :] + ROOTS[order], t)
    return homes, probes


def _units(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _emit(batches):
    """(key, id, home) of each vector's cells."""
    for batch in batches:
        ids, labels, vectors = (batch.column(k).to_pylist() for k in range(3))
        by: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by.setdefault(len(v), []).append(i)
        for d, own in by.items():
            for a in range(0, len(own), 2048):
                part = own[a : a + 2048]
                homes, probes = _cells(_units([vectors[i] for i in part]))
                both = np.concatenate([homes[:, :, None], probes], 2).reshape(len(part), -1)
                label = mix(np.array([labels[i] for i in part], np.int64).view(np.uint64) * np.uint64(31) + np.uint64(d))
                key = mix(both ^ label[:, None]).view(np.int64)
                home = np.zeros((TABLES, 1 + PROBES), bool)
                home[:, 0] = True
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(np.array([ids[i] for i in part], np.int64), key.shape[1])), pa.array(np.tile(home.ravel(), len(part)))], names=["key", "id", "home"])


def _block(key, ids, home, chunk, label, weight, unit, threshold):
    """(class, vectors linked, smallest class that they reach here) of the rows of a block with links that this block counts."""
    a, b = np.nonzero(np.triu(unit @ unit.T >= threshold, 1))
    good = (ids[a] != ids[b]) & (home[a] | home[b])
    if chunk.min() != chunk.max():
        good &= chunk[a] != chunk[b]
    a, b = a[good], b[good]
    if not len(a):
        return None
    used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    ids, weight = ids[used], weight[used]
    homes, probes = _cells(unit[used])
    mine = mix(np.array([label], np.int64).view(np.uint64) * np.uint64(31) + np.uint64(unit.shape[1]))
    ours = np.zeros(len(a), bool)
    for s in range(0, len(a), 20_000):
        x, y = a[s : s + 20_000], b[s : s + 20_000]
        same = homes[x] == homes[y]
        reach = (probes[x] == homes[y][:, :, None]).any(2)
        back = (probes[y] == homes[x][:, :, None]).any(2)
        first = (same | reach | back).argmax(1)
        row = np.arange(len(x))
        # The cell that counts the pair: the common home, or the home that the other probes; where both do, that of the smaller id.
        of_y = reach[row, first] & (~back[row, first] | (ids[y] < ids[x]))
        cell = np.where(of_y, homes[y, first], homes[x, first])
        ours[s : s + 20_000] = mix(cell ^ mine).view(np.int64) == key
    a, b = a[ours], b[ours]
    links = (np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))).astype(np.int64)
    root = ids.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, a, before[b])
        np.minimum.at(root, b, before[a])
        if (root == before).all():
            break
    some = links > 0
    return ids[some], links[some], root[some]


def _compare(threshold):
    def run(batches):
        """Rows come sorted by block; a block may go on in the next batch."""
        now, held = None, []

        def done():
            if not held:
                return None
            ids, home, chunk, label, weight, vectors = (np.concatenate([h[k] for h in held]) for k in range(6))
            return _block(now[0], ids, home, chunk, label[0], weight, _units(vectors), threshold) if len(ids) > 1 else None

        for batch in batches:
            key, i, j, ids, home, chunk, label, weight = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3, 4, 5, 7, 8))
            lists = batch.column(6)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            out = []
            for s, e in zip([0, *new], [*new, len(key)]):
                if s == e:
                    continue
                block = (key[s], i[s], j[s])
                if block != now:
                    out.append(done())
                    now, held = block, []
                held.append((ids[s:e], home[s:e], chunk[s:e], label[s:e], weight[s:e], values[offsets[s] : offsets[e]].reshape(e - s, -1)))
            yield _packed(out)
        yield _packed([done()])

    return run


def _packed(out):
    out = [x for x in out if x is not None]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out]) if out else [], pa.int64()) for k in range(3)], names=["id", "links", "root"])


def near_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component) of each row."""
    stash = Stash(spark)
    src = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("vector", lambda x: x != 0)
    good = src.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(~odd)
    key = F.xxhash64("label", "vector")  # the class itself is told by the vector; rows are dealt by this
    named = good.select("id", "label", "vector", key.alias("key"))
    classes = named.groupBy("key", "label", "vector").agg(F.countDistinct("id").alias("n"), F.min("id").alias("least")).withColumn("cid", F.monotonically_increasing_id())
    classes = stash(classes, "classes")
    cells = stash(classes.select("cid", "label", "vector").mapInArrow(_emit, "key long, id long, home boolean"), "cells")
    size = cells.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("homes")).where("n > 1 and homes > 0")
    size = size.select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    rows = cells.join(size, "key").withColumn("chunk", F.pmod(F.hash("id", F.lit(5)), F.col("chunks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "id", "home", "chunk")
    held = classes.select(F.col("cid").alias("id"), "vector", "label", "n")
    full = rows.join(held, "id").select("key", "i", "j", "id", "home", "chunk", "vector", "label", "n").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = stash(full.mapInArrow(_compare(threshold), "id long, links long, root long"), "links", heavy=True)
    comps = components(stash, found, "id", "root")
    links = found.groupBy(F.col("id").alias("cid")).agg(F.sum("links").alias("links"))
    own = classes.join(links, "cid", "left").join(comps.withColumnRenamed("id", "cid"), "cid", "left").select("key", "label", "vector", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    own = stash(own, "own")
    least = own.groupBy("component").agg(F.min("least").alias("first"))
    told = own.join(least, "component").select("key", "label", "vector", "n_links", "first")
    row = src.withColumn("fit", F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~odd, F.lit(False)))
    row = row.select("id", F.when(F.col("fit"), F.xxhash64("label", "vector")).alias("key"), "label", "vector")
    out = row.join(told.withColumnsRenamed({"label": "l", "vector": "v", "key": "k"}), (F.col("key") == F.col("k")) & (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v")), "left")
    return stash.only(out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", "id").alias("component")))


def op5_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(spark, table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
