"""N-gram Jaccard join of whole texts under several global token orders.

Rows with equal shingle sets form a class, named by a number; all work is on classes, so ids may repeat or be null.

1. Prefixes: a class gives the tokens of its prefix in the first order, with their positions. A token's list holds the classes that share it.
2. Stars: in each list, the others are compared with the class that has the token first in its prefix, then, among what is still apart, with one drawn anew for each token.
   Links join classes, so that a group of near copies becomes one component with a number of checks that is linear in its size.
3. The exact rest: pairs of a list that lie in different components. A pair comes once, from the first token that both prefixes share, as far as
   EARLIER tokens tell, and only if what follows that token in either set reaches the intersection that a link needs.

Candidates of every step are filtered before any set is sent: by parity bits, which differ in at least as many places as the sets, and by
intersecting the orders: under each of SEEDS they have to share as many prefix tokens as linked sets of their sizes do.
Survivors are verified on their whole sets. A link that is left out joins two classes of one component, so components lose nothing.

Frequent tokens come last in every order. Tokens are counted by BUCKETS of their names, so that a task's memory is fixed; a task gives the buckets that hold clearly
more of its distinct sets than the mean, and sums over all tasks give the at most MOST fullest ones, which are broadcast. Any order is a valid one: the counts decide how
long lists get, never what is found.

Nulls in text: empty. Empty texts have no shingles and link with nothing. Rows with a null id stay; their component is the smallest id that they reach,
null if there is none. Ids that repeat: each row goes by its own text. Extra columns are not read, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stash, components, give_back, table, text_of
from .shingles import BUCKETS, Orders, bucket, linked, parities, shingles
from .slices import sliced

#: Token orders: the first makes candidates, all filter them.
SEEDS = (0, 101, 202)
#: Tokens that a task holds before it counts them, and digests that it keeps to tell copies; how many buckets are broadcast at most, and from how many classes on; tokens of a prefix that
#: tell whether a pair came earlier.
ROOM, MOST, FLOOR, EARLIER = 1 << 19, 1 << 18, 8, 8
SALTS, SPARE = 16, 2
#: Bits of the maps of ids and tokens that are broadcast, whatever the input; they come in rows of BLOCK words of 64 bits.
CELLS, BLOCK = 1 << 24, 512
SIGNED = "id long, n int, sig binary, bits array<long>, often array<long>, times array<int>"
_LISTS = pa.list_(pa.int64())


def _sig(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


class _Counts:
    """How many sets hold a token of each bucket."""

    def __init__(self):
        self.times, self.held, self.size, self.total = np.zeros(BUCKETS, np.uint32), [], 0, 0

    def add(self, s: np.ndarray) -> None:
        self.held.append(bucket(s))
        self.size += len(s)
        if self.size >= ROOM:
            self.merge()

    def merge(self) -> None:
        if self.held:
            at, times = np.unique(np.concatenate(self.held), return_counts=True)
            self.times[at] += times.astype(np.uint32)
        self.total += self.size
        self.held, self.size = [], 0

    def full(self) -> np.ndarray:
        """Buckets with clearly more than the mean, three deviations and one more, and two at least."""
        self.merge()
        mean = self.total / BUCKETS
        return np.flatnonzero(self.times >= max(2, math.ceil(1 + mean + 3 * math.sqrt(mean))))


def _signed(batches):
    """Per text: size of its set, the set's digest and parity bits; at the end: the buckets that many sets of the task fill."""
    counts, seen = _Counts(), set()
    schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("sig", pa.binary()), ("bits", _LISTS), ("often", _LISTS), ("times", pa.list_(pa.int32()))])
    for batch in sliced(batches, 1):
        n, sig, bits = [], [], []
        for text in batch.column(1):
            s = shingles(text.as_py())
            n.append(len(s))
            sig.append(_sig(s))
            bits.append(parities(s) if len(s) else None)
            if sig[-1] not in seen:
                if len(seen) >= ROOM:
                    seen.clear()
                seen.add(sig[-1])
                counts.add(s)
        rows = len(n)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int32()), pa.array(sig, pa.binary()), pa.array(bits, _LISTS), pa.nulls(rows, _LISTS), pa.nulls(rows, pa.list_(pa.int32()))], schema=schema)
    often = counts.full()
    for a in range(0, len(often), 1 << 16):
        at = often[a : a + (1 << 16)]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:4]), pa.array([at], _LISTS), pa.array([counts.times[at].astype(np.int32)], pa.list_(pa.int32()))], schema=schema)
    del counts, seen
    give_back()


def _lists(found: list[np.ndarray], short: bool) -> pa.Array:
    """Lists of tokens; short: of the upper halves of their names."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    tokens = np.concatenate([np.empty(0, np.uint64), *found])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array((tokens >> np.uint64(32)).astype(np.uint32).view(np.int32) if short else tokens.view(np.int64)))


def _prefixes(orders, seeds, short: bool):
    """(sig, n, the prefix's tokens in each order) of each text that has a set."""

    def run(batches):
        for batch in sliced(batches, 0):
            sets = [s for s in (shingles(t.as_py()) for t in batch.column(0)) if len(s)]
            tokens = [_lists([orders.value.prefix(s, seed) for s in sets], short) for seed in seeds]
            yield pa.RecordBatch.from_arrays([pa.array(map(_sig, sets), pa.binary()), pa.array(map(len, sets), pa.int32()), *tokens], names=["sig", "n", *(f"p{k}" for k in range(len(seeds)))])
        give_back()

    return run


def _sets(batches):
    for batch in sliced(batches, 0, 1 << 20):
        sets = [shingles(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(map(_sig, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sig", "held"])
    give_back()


def _verify(batches):
    """Rows come as (a, salt, b, set) with a's own set first, then each b's."""
    now, head = None, None
    for batch in batches:
        out_a, out_b = [], []
        for a, salt, b, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            s = np.frombuffer(held.as_buffer(), np.uint64)
            if b is None:
                now, head = (a, salt), s.copy()
            elif now == (a, salt) and linked(head, s):
                out_a.append(a)
                out_b.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["u", "v"])
    give_back()


def _folded(longer: str, shorter: str) -> str:
    return f"zip_with(slice({longer}, 1, size({shorter})), slice({longer}, size({shorter}) + 1, size({shorter})), (p, q) -> p ^ q)"


def plausible(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Those (a, b) whose parity bits differ in no more places than linked sets of their sizes can; rows whose lengths don't compare stay."""
    both = pairs.join(bits.select(F.col("id").alias("a"), F.col("n").alias("an"), F.col("bits").alias("x")), "a")
    both = both.join(bits.select(F.col("id").alias("b"), F.col("n").alias("bn"), F.col("bits").alias("y")), "b").where("4 * least(an, bn) >= 3 * greatest(an, bn)")
    x = f"case when size(x) = 2 * size(y) then {_folded('x', 'y')} else x end"
    y = f"case when size(y) = 2 * size(x) then {_folded('y', 'x')} else y end"
    both = both.select("a", "b", (F.col("an") + F.col("bn")).alias("n"), F.expr(x).alias("x"), F.expr(y).alias("y"))
    differ = "aggregate(zip_with(x, y, (p, q) -> bit_count(p ^ q)), 0, (s, d) -> s + d)"
    return both.where(f"size(x) <> size(y) or {differ} <= n - 2 * ceil(3 * n / 7.0)").select("a", "b").distinct()


def _marked(rows: DataFrame, column: str, wanted: DataFrame, key: str) -> DataFrame:
    """rows with __hit: whether the column's hash meets that of a wanted key, by a map that is broadcast; it is true for every wanted key, and for some others.

    The map comes as CELLS / 64 / BLOCK rows of BLOCK words each: as a row a word, the driver would hold some ten times its bytes."""
    word = lambda c: f"shiftright(pmod(xxhash64({c}), {CELLS}L), 6)"
    mask = lambda c: f"shiftleft(1L, cast(pmod(xxhash64({c}), 64L) as int))"
    empty = rows.sparkSession.range(CELLS // 64).selectExpr("id as __word", "0L as __bits")  # so that no word of a block is missing
    words = wanted.selectExpr(f"{word(key)} as __word", f"{mask(key)} as __bits").unionByName(empty).groupBy("__word").agg(F.bit_or("__bits").alias("__bits"))
    cells = words.groupBy(F.expr(f"__word div {BLOCK}").alias("__place")).agg(F.array_sort(F.collect_list(F.struct("__word", "__bits")))["__bits"].alias("__cells"))
    both = rows.join(F.broadcast(cells), cells["__place"] == F.expr(f"{word(column)} div {BLOCK}"), "left")
    return both.withColumn("__hit", F.expr(f"coalesce(__cells[cast({word(column)} % {BLOCK} as int)] & {mask(column)}, 0L) <> 0")).drop("__place", "__cells")


def among(rows: DataFrame, column: str, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose column is among the wanted keys, and some others whose hashes meet theirs; nulls count as a value."""
    return _marked(rows, column, wanted, key).where("__hit").drop("__hit")


class _Join:
    """What the steps share: texts (id, text), classes (cid, sig, rep: their smallest id), bits (id: cid, n, bits), orders."""

    def __init__(self, stash: Stash, texts: DataFrame, classes: DataFrame, orders):
        self.stash, self.texts, self.classes, self.orders = stash, texts, classes, orders
        self.bits = classes.select(F.col("cid").alias("id"), "n", "bits")

    def texts_of(self, cids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The classes asked for, and their texts with some others."""
        asked = self.classes.select("cid", "sig", "rep").join(cids, "cid", "left_semi")
        return asked, among(self.texts, "id", asked, "rep").select("text")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The linked pairs (u, v) of the candidates (a, b)."""
        pairs = self.stash(plausible(pairs, self.bits), "plausible")
        if pairs.isEmpty():
            return pairs.toDF("u", "v")
        cids = pairs.select(F.explode(F.array("a", "b")).alias("cid"))
        asked, texts = self.texts_of(cids)
        schema = "sig binary, n int, " + ", ".join(f"p{k} array<int>" for k in range(len(SEEDS)))
        held = texts.mapInArrow(_prefixes(self.orders, SEEDS, True), schema).join(asked.select("cid", "sig"), "sig")
        side = lambda x: held.select(F.col("cid").alias(x), F.col("n").alias(f"{x}n"), *(F.col(f"p{k}").alias(f"{x}{k}") for k in range(len(SEEDS))))
        # Under each order: what two linked sets share up to the end of the prefix that ends first; beyond it there is the rest of that set. Of shared tokens, up to SPARE may have
        # the same half of a name as another one.
        enough = " and ".join(f"size(array_intersect(a{k}, b{k})) + {SPARE} + ceil(0.75D * greatest(an, bn)) - 1 >= ceil(3 * (an + bn) / 7.0)" for k in range(len(SEEDS)))
        pairs = self.stash(pairs.join(side("a"), "a").join(side("b"), "b").where(enough).select("a", "b").distinct(), "intersected")
        cids = pairs.select(F.explode(F.array("a", "b")).alias("cid"))
        asked, texts = self.texts_of(cids)
        sets = texts.mapInArrow(_sets, "sig binary, held binary").join(asked.select("cid", "sig"), "sig").select("cid", "held")
        salted = pairs.withColumn("salt", F.pmod(F.hash("b"), F.lit(SALTS)).cast("int"))
        heads = salted.select("a", "salt").distinct().join(sets.withColumnRenamed("cid", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "held")
        others = salted.join(sets.withColumnRenamed("cid", "b"), "b").select("a", "salt", "b", "held")
        rows = heads.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        found = self.stash(rows.mapInArrow(_verify, "u long, v long").distinct(), "links", heavy=True)
        self.stash.clear(pairs)
        return found

    def joined(self, comps: DataFrame | None, links: DataFrame) -> DataFrame:
        """(id, component) of the classes that links join, beside those joined before."""
        if comps is not None and links.isEmpty():
            return comps
        if comps is None:
            return self.stash(components(self.stash, links), "components")
        of = lambda x: comps.select(F.col("id").alias(x), F.col("component").alias(f"{x}c"))
        rest = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("uc", "u").alias("u"), F.coalesce("vc", "v").alias("v"))
        more = self.stash(components(self.stash, rest), "more")
        over = more.select(F.col("id").alias("component"), F.col("component").alias("over"))
        root = comps.join(over, "component", "left").select("id", F.coalesce("over", "component").alias("component"))
        out = self.stash(root.unionByName(more.join(comps, "id", "left_anti")), "components")
        self.stash.clear(comps, more)
        return out


def _frequent(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The fullest buckets, at most MOST: those from a count on below which there would be more."""
    steps = counted.groupBy(F.floor(F.log2("times") * 8).alias("step")).count().orderBy(F.desc("step")).collect()
    least, total = None, 0
    for r in steps:
        total += r["count"]
        if total > MOST:
            break
        least = r["step"]
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found = counted.where(F.floor(F.log2("times") * 8) >= least).toPandas()
    return found["token"].to_numpy(np.int64), found["times"].to_numpy(np.int64)


def class_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Stash, DataFrame, DataFrame]:
    """The rows (id, n, sig), and their classes (sig, cid, n, rep, component: the cid of one of the classes that links join, alone its own)."""
    stash = Stash(spark)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(F.col(f"`{text_col}`")).alias("text"))
    signed = stash(texts.mapInArrow(_signed, SIGNED), "signed")
    sets = signed.where("sig is not null")
    counted = signed.where("often is not null").select(F.explode(F.arrays_zip("often", "times")).alias("t")).groupBy(F.col("t.often").alias("token")).agg(F.sum("t.times").alias("times")).where(F.col("times") >= FLOOR)
    counted = stash(counted, "often")
    orders = spark.sparkContext.broadcast(Orders(*_frequent(counted)))

    full = sets.where("n > 0")
    one = full.groupBy("sig").agg(F.min("id").alias("rep"), F.min("n").alias("n"))
    like = full.select("sig", F.col("id").alias("of"), "bits").join(one, "sig").where(F.col("of").eqNullSafe(F.col("rep"))).select("sig", "rep", "n", "bits")
    classes = stash(like.dropDuplicates(["sig"]).withColumn("cid", F.monotonically_increasing_id()), "classes")
    join = _Join(stash, texts, classes, orders)

    asked, own = join.texts_of(classes.select("cid"))
    held = own.mapInArrow(_prefixes(orders, SEEDS[:1], False), "sig binary, n int, p0 array<long>").join(asked.select("cid", "sig"), "sig").select("cid", "n", F.col("p0").alias("tokens"))
    prefixes = stash(held, "prefixes", heavy=True)  # a row that repeats whole, id and text, has its class twice
    tokens = prefixes.select("cid", "n", F.posexplode("tokens").alias("pos", "token"))
    shared = stash(tokens.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1").select("token"), "shared", heavy=True)
    lists = stash(among(tokens, "token", shared, "token").join(shared, "token").distinct(), "lists", heavy=True)
    stash.clear(prefixes, shared)

    comps = None

    def placed(rows: DataFrame, star: Column) -> DataFrame:
        """Lists whose classes lie in several components, each with its star; without the rows after whose token too little follows for a link with any of the list."""
        rows = rows.select("token", "cid", "n", "pos")
        rows = rows.withColumn("comp", F.col("cid")) if comps is None else rows.join(comps.select(F.col("id").alias("cid"), "component"), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
        several = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.min(F.struct(star, F.xxhash64("cid", "token"), "cid", "comp")).alias("star")).where("lo <> hi")
        rows = rows.join(several.select("token", "least", F.col("star.cid").alias("a"), F.col("star.comp").alias("acomp")), "token")
        out = stash(rows.where("n - pos >= ceil(3 * (n + greatest(least, ceil(0.75D * n))) / 7.0)").drop("least"), "placed", heavy=True)
        return out

    near = lists  # components only grow and lists only shrink, so what goes once is gone
    for star in (F.col("pos"), F.lit(0)):
        before, near = near, placed(near, star)
        stash.clear(before)
        comps = join.joined(comps, join.links(near.where("comp <> acomp").select("a", F.col("cid").alias("b")).distinct()))
    before, near = near, placed(near, F.lit(0))
    stash.clear(before)
    first = near.groupBy("cid").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "token"))), 1, EARLIER).alias("first"))
    rows = near.drop("a", "acomp").join(first, "cid").withColumn("before", F.expr("transform(filter(first, t -> t.pos < pos), t -> t.token)")).drop("first")
    x, y = (rows.select("token", *(F.col(c).alias(p + c) for c in ("cid", "comp", "n", "pos", "before"))) for p in "xy")
    reach = "least(xn - xpos, yn - ypos) >= ceil(3 * (xn + yn) / 7.0)"
    pairs = x.join(y, "token").where(f"xcid < ycid and xcomp <> ycomp and 4 * least(xn, yn) >= 3 * greatest(xn, yn) and {reach} and not arrays_overlap(xbefore, ybefore)")
    comps = join.joined(comps, join.links(pairs.select(F.col("xcid").alias("a"), F.col("ycid").alias("b")).distinct()))
    stash.clear(near)
    found = classes.join(comps.select(F.col("id").alias("cid"), "component"), "cid", "left").select("sig", "cid", "n", "rep", F.coalesce("component", "cid").alias("component"))
    return stash, sets.select("id", "n", "sig"), found


def ngram_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component) of each row: the smallest id that it reaches by links, itself included."""
    stash, rows, classes = class_components(spark, docs, id_col, text_col)
    least = classes.groupBy("component").agg(F.min("rep").alias("least"))
    of = classes.join(least, "component").select("sig", "least")
    out = rows.join(of, "sig", "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component"))
    return stash.only(out)


@F.pandas_udf(T.BinaryType())
def _digest(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _sig(s) if len(s := shingles(t)) else None)


def one_of_each(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one of each component: that with its smallest id (null ids last). Texts without words are of no group and all stay."""
    stash, rows, classes = class_components(spark, docs, id_col, text_col)
    best = classes.groupBy("component").agg(F.min(F.struct(F.isnull("rep").alias("none"), "rep", "sig")).alias("best")).select("best.sig", F.col("best.rep").alias("rep"))
    kept = rows.join(best.withColumn("best", F.lit(True)), "sig", "left").where((F.col("n") == 0) | F.col("best") & F.col("id").eqNullSafe(F.col("rep"))).select("id", "sig", "n")
    times = rows.groupBy(F.col("id").alias("of")).agg(F.count("*").alias("times"))
    kept = stash(kept.join(times, F.col("id").eqNullSafe(F.col("of"))).select("id", "sig", "n", "times"), "kept")
    rows = stash(rows.select("id"), "rows")
    stash.clear(*(x for _, x in list(stash.paths.values()) if x is not kept and x is not rows))
    # Rows are dealt by id only if theirs goes, repeats or is null, as far as a map of those ids tells.
    odd = kept.where("times > 1 or id is null")
    alone = kept.where("times = 1 and id is not null").select("id")
    doubtful = rows.select("id").join(alone, "id", "left_anti").distinct()
    doubtful = doubtful.unionByName(odd.select("id"))
    marked = _marked(docs.withColumn("__id", F.col(f"`{id_col}`").cast("long")), "__id", doubtful, "id")
    sure, rest = marked.where("not __hit").drop("__id", "__hit"), marked.where("__hit").drop("__hit")
    single = rest.join(alone, F.col("__id") == alone["id"], "left_semi").drop("__id")
    # Ids that repeat and null ids: the row's own text decides, and of rows that repeat whole one stays.
    some = rest.join(odd, F.col("__id").eqNullSafe(odd["id"]), "left_semi").withColumn("__digest", _digest(text_of(F.col(f"`{text_col}`"))))
    empty = some.where("__digest is null").drop("__digest", "__id")
    full = some.join(odd.select("id", "sig"), F.col("__id").eqNullSafe(odd["id"]) & (F.col("__digest") == odd["sig"]), "left_semi").dropDuplicates(["__digest"]).drop("__digest", "__id")
    return sure.unionByName(single).unionByName(empty).unionByName(full)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_groups(spark, table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n_shingles").cast("long"), F.col("component").alias("component_id"))
