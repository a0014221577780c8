"""Product codes of vectors: integer Lloyd rounds a part position, with heaps of slacks that tell which parts have to be looked at again.

Vectors lie in blocks of BLOCK rows, each written with its state: a heap for each entry of each part's codebook, keyed by slack, the distance to the second
nearest entry less that to the nearest. When entries move, what an entry's parts can lose is its own move and the largest move of another entry, which add up from
round to round; a block pops from each heap the parts whose slack that sum has reached, measures them against all entries, and pushes them again. All others keep
their entry. Where several entries are as near, slack is 0 and the part is measured each time, so ties go to the lower index as by a whole scan. Entries' sums
change by what has moved alone. The driver holds the codebooks: 16 parts of 64 entries.

Defined results: rows whose vector is null or holds null or non-finite components are left out; null ids are the largest; rows of one id are ordered by vector; with
fewer than 64 rows codebooks are shorter, without rows the result is empty. Vectors are filled up with zeros to the longest one's length and that to a multiple of 16.
Integers are held to 2^24 either way (components to 65,536), so that all sums are exact. Labels are compared as texts, nulls together; other columns aren't read."""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, give_back, table

PARTS, ENTRIES, ROUNDS, BLOCK = 16, 64, 2, 4096
SCALE, MOST = 256, 1 << 24
#: Distances are rounded: a slack counts as reached this much (by share and by amount) before it is.
ROUNDING = 1e-9
_STATE = "ids array<bigint>, labels array<string>, vectors binary, codes binary, sizes binary, keys binary, members binary, moved binary, looked bigint"


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of parts (n, d) to entries (k, d), exact."""
    if x.shape[1] * max(1, int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0))) ** 2 < 1 << 50:  # all sums are exact in floating point
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    out = np.zeros((len(x), len(book)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None].astype(np.int64) - book[None, :, k]) ** 2
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry, the lower of equal ones, and the slack."""
    d2 = distances(x, book)
    code = d2.argmin(1)
    if d2.shape[1] == 1:
        return code, np.full(len(x), np.inf)
    two = np.sqrt(np.partition(d2, 1, axis=1)[:, :2].astype(np.float64))
    return code, (two[:, 1] - two[:, 0]) * (1 - ROUNDING) - ROUNDING


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """(parts, entries): by how much an entry's parts can have lost slack when the codebooks move."""
    move = np.sqrt(((new - old).astype(np.float64) ** 2).sum(2))
    top = np.sort(move, axis=1)[:, ::-1]
    others = np.where(move == top[:, :1], top[:, 1:2] if move.shape[1] > 1 else 0.0, top[:, :1])  # of equal largest ones the second is as large
    return (move + others) * (1 + ROUNDING) + ROUNDING


class Block:
    """Parts of some vectors with their codes and heaps; heaps[p][k] has (key, row), key being slack and the drift up to when it was pushed."""

    def __init__(self, vectors: np.ndarray, codes: np.ndarray | None = None, heaps: list | None = None):
        self.vectors, self.codes, self.heaps = vectors, codes, heaps

    def part(self, p: int) -> np.ndarray:
        d = self.vectors.shape[1] // PARTS
        return self.vectors[:, p * d : (p + 1) * d]

    def assign(self, books: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, int]:
        """Brings the codes up to the books, towards which entries have drifted so far in all; by how much entries' counts (last) and sums change, and the parts measured."""
        n, (parts, entries, d) = len(self.vectors), books.shape
        change, looked = np.zeros((parts, entries, d + 1), np.int64), 0
        first = self.codes is None
        if first:
            self.codes, self.heaps = np.zeros((n, parts), np.uint8), [[[] for _ in range(entries)] for _ in range(parts)]
        for p in range(parts):
            heaps, x = self.heaps[p], self.part(p)
            if first:
                rows = np.arange(n)
            else:
                out = []
                for heap, gone in zip(heaps, drift[p].tolist()):
                    while heap and heap[0][0] <= gone:
                        out.append(heapq.heappop(heap)[1])
                rows = np.array(out, np.int64)
            looked += len(rows)
            if not len(rows):
                continue
            code, slack = nearest(x[rows], books[p])
            key = slack + drift[p, code]
            moved = np.ones(len(rows), bool) if first else code != self.codes[rows, p]
            full = np.concatenate([x[rows[moved]].astype(np.int64), np.ones((int(moved.sum()), 1), np.int64)], axis=1)
            np.add.at(change[p], code[moved], full)
            if first:
                for k in range(entries):
                    mine = np.flatnonzero(code == k)
                    heaps[k] = list(zip(key[mine].tolist(), mine.tolist()))
                    heapq.heapify(heaps[k])
            else:
                np.subtract.at(change[p], self.codes[rows[moved], p], full)
                for k, item in zip(code.tolist(), zip(key.tolist(), rows.tolist())):
                    heapq.heappush(heaps[k], item)
            self.codes[rows, p] = code
        return change, looked

    def errors(self, books: np.ndarray) -> np.ndarray:
        """Squared distances of the parts to their entries, summed a vector."""
        total = np.zeros(len(self.vectors), np.int64)
        for p in range(len(books)):
            total += ((self.part(p).astype(np.int64) - books[p][self.codes[:, p]]) ** 2).sum(1)
        return total

    def state(self) -> tuple[bytes, bytes, bytes, bytes, bytes]:
        flat = [x for heaps in self.heaps for heap in heaps for x in heap]
        sizes = np.array([len(heap) for heaps in self.heaps for heap in heaps], np.int32)
        return self.vectors.tobytes(), self.codes.tobytes(), sizes.tobytes(), np.array([k for k, _ in flat], np.float64).tobytes(), np.array([r for _, r in flat], np.int32).tobytes()

    @classmethod
    def of(cls, n: int, entries: int, vectors: bytes, codes: bytes, sizes: bytes, keys: bytes, members: bytes) -> Block:
        pairs = list(zip(np.frombuffer(keys, np.float64).tolist(), np.frombuffer(members, np.int32).tolist()))
        ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
        lists = [pairs[a:b] for a, b in zip([0, *ends], ends)]
        heaps = [lists[p * entries : (p + 1) * entries] for p in range(PARTS)]
        return cls(np.frombuffer(vectors, np.int32).reshape(n, -1), np.frombuffer(codes, np.uint8).reshape(n, PARTS).copy(), heaps)


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(256 * x) of each component, filled up to the width."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), width), np.int32)
    out[np.arange(width)[None] < sizes[:, None]] = np.clip(np.floor(flat * SCALE), -MOST, MOST)
    return out


def _row(ids: pa.Array, labels: pa.Array, block: Block, change: np.ndarray, looked: int) -> pa.RecordBatch:
    one = lambda x: pa.array([x], pa.binary())
    lists = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(kind))
    names = ["ids", "labels", "vectors", "codes", "sizes", "keys", "members", "moved", "looked"]
    return pa.RecordBatch.from_arrays([lists(ids, pa.int64()), lists(labels, pa.string()), *map(one, block.state()), one(change.tobytes()), pa.array([looked], pa.int64())], names=names)


def _begin(books: np.ndarray, width: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                ids, labels, vectors = batch.slice(at, BLOCK).columns
                block = Block(integers(pa.array(vectors), width))
                yield _row(ids, labels, block, *block.assign(books, np.zeros(books.shape[:2])))
        give_back()

    return run


def _blocks(batches, entries: int):
    for batch in batches:
        for k in range(batch.num_rows):
            ids, labels = (batch.column(c)[k].values for c in range(2))
            yield ids, labels, Block.of(len(ids), entries, *(batch.column(c)[k].as_py() for c in range(2, 7)))


def _next(books: np.ndarray, drift: np.ndarray):
    def run(batches):
        for ids, labels, block in _blocks(batches, books.shape[1]):
            yield _row(ids, labels, block, *block.assign(books, drift))
        give_back()

    return run


def _end(books: np.ndarray):
    def run(batches):
        for ids, labels, block in _blocks(batches, books.shape[1]):
            codes = [x.tobytes().hex() for x in block.codes]
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(block.errors(books), pa.int64())], names=["id", "label", "code", "error"])
        give_back()

    return run


def _moved(shape: tuple[int, ...]):
    def run(batches):
        total = np.zeros(shape, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py(), np.int64).reshape(shape)
        part, entry = np.nonzero(total.any(2))
        sums = [total[p, k].tolist() for p, k in zip(part, entry)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(sums, pa.list_(pa.int64()))], names=["part", "entry", "sums"])

    return run


def _changes(blocks: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """By how much the sums of the entries change in all blocks: one row a task and entry, then one an entry."""
    each = blocks.select("moved").mapInArrow(_moved(shape), "part int, entry int, sums array<bigint>")
    rows = each.select("part", "entry", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(shape, np.int64)
    for r in rows:
        total[r.part, r.entry, r.at] = r.x
    return total


def product_codes(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[int]]:
    """((id, label, code, error) of each vector that is kept, the codebooks (part, entry, component), how many parts each assignment has measured)."""
    stash = Stash(spark)
    src = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    good = src.where(F.isnotnull("vector") & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    size = good.agg(F.max(F.size("vector"))).first()[0]
    none = spark.createDataFrame([], "id long, label string, code string, error long")
    if size is None:
        return none, np.zeros((PARTS, 0, 0), np.int64), []
    width = max(1, -(-size // PARTS)) * PARTS
    first = good.orderBy(F.asc_nulls_last("id"), "vector").limit(ENTRIES).select("vector").collect()  # 64 vectors
    ints = integers(pa.array([r.vector for r in first], pa.list_(pa.float64())), width).astype(np.int64)
    books = ints.reshape(len(first), PARTS, -1).transpose(1, 0, 2).copy()
    shape = (*books.shape[:2], books.shape[2] + 1)
    blocks = stash(good.mapInArrow(_begin(books, width), _STATE), "blocks")
    drift, sums, looked = np.zeros(shape[:2]), np.zeros(shape, np.int64), []
    for _ in range(rounds):
        sums += _changes(blocks, shape)
        looked.append(blocks.agg(F.sum("looked")).first()[0])
        used = sums[..., -1:] > 0
        new = np.where(used, sums[..., :-1] // np.maximum(sums[..., -1:], 1), books)
        drift, books = drift + drifts(books, new), new
        before, blocks = blocks, stash(blocks.select("ids", "labels", "vectors", "codes", "sizes", "keys", "members").mapInArrow(_next(books, drift), _STATE), "blocks")
        stash.clear(before)
    looked.append(blocks.agg(F.sum("looked")).first()[0])
    out = stash(blocks.select("ids", "labels", "vectors", "codes", "sizes", "keys", "members").mapInArrow(_end(books), "id long, label string, code string, error long"), "codes")
    stash.clear(blocks)
    return out, books, looked


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books, _ = product_codes(spark, table(spark, sf_dir, "embeddings"))
    name = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(by, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))


def _assigned(n: int) -> str:
    """SQL of the n-th assignment and of the codebooks after it."""
    return f"""
d{n} as (select r, p, e, list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) as d from parts join b{n} using (p)),
a{n} as (select r, p, d, e from d{n} qualify row_number() over (partition by r, p order by d, e) = 1),
s{n} as (select p, e, i, cast(floor(sum(v)::double / count(*)) as bigint) as m from (select p, e, unnest(x) as v, unnest(range(len(x))) as i from a{n} join parts using (r, p)) group by p, e, i),
m{n} as (select p, e, list(m order by i) as c from s{n} group by p, e),
b{n + 1} as (select p, e, coalesce(m{n}.c, b{n}.c) as c from b{n} left join m{n} using (p, e))"""


SQL = f"""
with kept as (select vec_id, label, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v, row_number() over (order by vec_id, embedding) as r
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
wide as (select cast(max(len(v)) / 16 as bigint) as w from kept),
parts as (select r, p, v[p * w + 1 : p * w + w] as x from kept, wide, range(16) as t(p)),
b1 as (select p, r - 1 as e, x as c from parts where r <= 64),{_assigned(1)},{_assigned(2)},{_assigned(3)},
whole as (select r, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from a3 group by r),
name as (select sha256(string_agg(v, ',' order by p, e, i)) as codebooks_sha256 from (select p, e, cast(unnest(c) as varchar) as v, unnest(range(len(c))) as i from b3))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from whole join kept using (r), name
"""
