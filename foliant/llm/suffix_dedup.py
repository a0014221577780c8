"""Removal of repeated byte strings by distributed prefix doubling over sampled positions.

A rank is a 64-bit name of the bytes that it covers: equal names, equal bytes. Ranking by names needs no dense numbers,
and equality is all that removal asks of a rank. Spark sorts (rank, document, position) at growing offsets and drops what is unique:

1. Offset SEED: of the strings of SEED bytes in each string of LENGTH bytes, the one with the least hash is its anchor.
   Equal strings have equal anchors at equal places, so that a repeated string has an anchor whose rank repeats. Anchors are about
   one in thirty positions; strings of neighbouring starts with one anchor form a segment.
2. Segments are ranked by all their bytes; those sorted below the same anchor rank are compared. All but the first of equal
   segments go whole. A segment whose anchor is unique, or whose anchor has equal segments alone, is done.
3. Offset HALF: the ranks of the anchor with the HALF bytes before it, and with those after it. A string of LENGTH bytes holds one of the two; the
   starts for which it is unique are done.
4. The rest, at the edges of copies, are ranked position by position: pairs of the ranks at offsets 0 and HALF give
   that of 2 * HALF bytes, and pairs at 0 and LENGTH - 2 * HALF that of LENGTH bytes, past which no rank is asked for.
Every string of LENGTH bytes is in one segment, so nothing is missed. Each task keeps one of the equal rows of a batch and marks the others
itself, so a passage in a third of all documents gives a row a batch; marked neighbours are one row, so a text of one letter gives a few rows a block.

Ranks have 64 bits; rows are compared below an equal rank of an anchor, and single positions by two ranks made in different ways, so that strings that
share nothing would have to agree in 96 bits at least to count as equal.

Nulls in text: empty. Documents with a null id take no part and come last with nothing removed. Rows that repeat an id with the same text are one document, whose rows all have its
result; with other texts they are documents of their own, in the order of a hash of the text. Extra columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Stash, table, text_of
from .shingles import mix

LENGTH, SEED, HALF = 100, 36, 32
#: Bytes that are ranked at once; positions within them have to fit BITS.
BLOCK, BITS = 1 << 19, 20
#: A span holds a position, in COUNT bits its number of starts (BLOCK at most) and in 8 bits the place of the anchor.
COUNT = 20
_BASE = 0x9E3779B97F4A7C15 | 5
_POWERS = np.ones(BLOCK + 2 * LENGTH + 1, np.uint64)
_POWERS[1:] = np.uint64(_BASE)
np.cumprod(_POWERS, out=_POWERS)
_INVERSE = np.ones_like(_POWERS)
_INVERSE[1:] = np.uint64(pow(_BASE, -1, 2**64))
np.cumprod(_INVERSE, out=_INVERSE)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64), 11)


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _POWERS[: len(data)], out=out[1:])
    return out


def _name(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of the bytes start..end."""
    return mix((sums[end] - sums[start]) * _INVERSE[start] + (end - start).astype(np.uint64))


def _blocks(ids, texts):
    """(ids, offset of each text's piece, bounds in the block, bytes): whole texts together, or overlapping pieces of a long one; each start is in one piece."""
    held, size = [], 0

    def out():
        data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
        return [i for i, _, _ in held], np.array([o for _, o, _ in held], np.int64), np.concatenate([[0], np.cumsum([len(x) for _, _, x in held])]), data

    for i, text in zip(ids, texts):
        if i[0] is None or len(text) < LENGTH:
            continue
        for o in range(0, len(text) - LENGTH + 1, BLOCK):
            piece = text[o : o + BLOCK + LENGTH - 1]
            if held and size + len(piece) > BLOCK:
                yield out()
                held, size = [], 0
            held.append((i, o, piece))
            size += len(piece)
    if held:
        yield out()


def _segments(data: np.ndarray, bounds: np.ndarray):
    """(piece, first start, starts, place of the anchor, its rank, ranks of both sides, rank of all bytes) of each segment; starts count from the block's begin."""
    sums = _sums(data)
    at = np.arange(len(data) - SEED + 1)
    seeds = _name(sums, at, at + SEED)
    key = (seeds >> np.uint64(BITS) << np.uint64(BITS)) | at.astype(np.uint64)
    width, have = LENGTH - SEED + 1, 1
    low = key
    while have < width:  # least of a growing number of neighbours
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    anchor = (low & np.uint64((1 << BITS) - 1)).astype(np.int64)
    piece = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(anchor)]
    good = np.arange(len(anchor)) + LENGTH <= bounds[piece + 1]
    starts = np.flatnonzero(good)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[starts[1:]] != anchor[starts[:-1]]) | (piece[starts[1:]] != piece[starts[:-1]])
    first = starts[new]
    count = np.diff(np.append(np.flatnonzero(new), len(starts)))
    a = anchor[first]
    rank = mix(_name(sums, first, first + count + LENGTH - 1) ^ ((a - first).astype(np.uint64) << np.uint64(32)))
    own = piece[first]
    left = _name(sums, np.maximum(a - HALF, bounds[own]), a + SEED)
    right = _name(sums, a, np.minimum(a + SEED + HALF, bounds[own + 1]))
    sides = left >> np.uint64(32) << np.uint64(32) | right >> np.uint64(32)
    return own, first, count, a - first, seeds[a], sides, rank


def _first_of(rank: np.ndarray, tag: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """True for the smallest (doc, tag, pos) of each rank."""
    at = np.lexsort((pos, tag, doc, rank))
    first = np.ones(len(at), bool)
    first[1:] = rank[at[1:]] != rank[at[:-1]]
    out = np.empty(len(at), bool)
    out[at] = first
    return out


def _runs(keep: np.ndarray, piece: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which segments begin a run, and the starts of each run: segments that stay are runs of their own, neighbours of one piece that are marked are one run."""
    if not len(keep):
        return np.empty(0, np.int64), count
    new = np.ones(len(keep), bool)
    new[1:] = keep[1:] | keep[:-1] | (piece[1:] != piece[:-1]) | (first[1:] != first[:-1] + count[:-1])
    at = np.flatnonzero(new)
    return at, np.add.reduceat(count, at)


def _scan(batches):
    """Segments of each block; a null rank marks those of which the block holds an earlier equal one."""
    for batch in batches:
        ids = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        for docs, offsets, bounds, data in _blocks(ids, map(memoryview, batch.column(2).cast(pa.binary()).to_pylist())):
            piece, first, count, place, anchor, sides, rank = _segments(data, bounds)
            doc, tag = np.array(docs, np.int64)[piece].T
            pos = offsets[piece] + first - bounds[piece]
            keep = _first_of(rank, tag, doc, pos)
            # Neighbours that are marked become one: in a text that repeats a few bytes each start may have its own anchor.
            first_of_run, count = _runs(keep, piece, first, count)
            keep, anchor, rank, sides, doc, tag, pos, place = (x[first_of_run] for x in (keep, anchor, rank, sides, doc, tag, pos, place))
            # Marked ones are dealt by document, not by a rank that many share.
            key = np.where(keep, anchor, mix(doc.view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rank.view(np.int64), mask=~keep), pa.array(sides.view(np.int64)), pa.array(doc), pa.array(tag), pa.array(pos << COUNT + 8 | count << 8 | place)], names=["anchor", "rank", "sides", "doc", "tag", "span"])


def _half_ranks(batches):
    """Ranks of 2 * HALF bytes, as pairs of those of HALF bytes, of each start in the listed segments; with them the rank of LENGTH bytes."""
    for batch in batches:
        ids, tags, texts, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3)
        docs, poss, ranks = [], [], []
        held = 0
        for i, tag, text, spans in zip(ids, tags, texts, lists):
            spans = spans.as_py()
            if not spans or i is None:
                continue
            data = np.frombuffer(text.as_buffer(), np.uint8)
            for span, left, right in ((s["span"], s["left"], s["right"]) for s in spans):
                p, n, middle = span >> COUNT + 8, span >> 8 & (1 << COUNT) - 1, (span & 255) - HALF
                low, high = 0 if left else max(0, middle), n - 1 if right else min(n - 1, middle)
                if low > high:
                    continue
                p, n = p + low, high - low + 1
                own = data[p : p + n + LENGTH - 1]
                sums, at = _sums(own), np.arange(n)
                low = np.arange(n + LENGTH - HALF)
                r = _name(sums, low, low + HALF)
                r = mix(r[:-HALF] * np.uint64(3) + mix(r[HALF:], 5))  # offset HALF: 2 * HALF bytes
                step = LENGTH - 2 * HALF
                # offset LENGTH - 2 * HALF: LENGTH bytes
                ranks.append(np.stack([mix(r[at] * np.uint64(3) + mix(r[at + step], 5)), mix(mix(r[at], 7) ^ r[at + step], 9)]))
                poss.append(p + at)
                docs.append(np.full((n, 2), (i, tag), np.int64))
                held += n
            if held > 500_000:
                yield from _positions(docs, poss, ranks)
                docs, poss, ranks, held = [], [], [], 0
        if held:
            yield from _positions(docs, poss, ranks)


def _positions(docs, poss, ranks):
    (doc, tag), pos, (rank, check) = np.concatenate(docs).T, np.concatenate(poss), np.concatenate(ranks, axis=1)
    keep = _first_of(rank, tag, doc, pos)
    key = np.where(keep, rank, mix(doc.view(np.uint64)))
    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array((check >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(~keep), pa.array(doc), pa.array(tag), pa.array(pos)], names=["rank", "check", "again", "doc", "tag", "pos"])


def _cut(batches):
    for batch in batches:
        n_bytes, n_removed, n_spans, sha, kept = [], [], [], [], []
        for text, spans in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
            data = text.as_py() or b""
            spans = sorted((s["pos"], s["pos"] + s["starts"] + LENGTH - 1) for s in spans.as_py() or ())
            out, at, cut, runs = [], 0, 0, 0
            k = 0
            while k < len(spans):
                lo, hi = spans[k]
                k += 1
                while k < len(spans) and spans[k][0] <= hi:
                    hi = max(hi, spans[k][1])
                    k += 1
                out.append(data[at:lo])
                cut, runs, at = cut + hi - lo, runs + 1, hi
            out.append(data[at:])
            out = b"".join(out)
            n_bytes.append(len(data))
            n_removed.append(cut)
            n_spans.append(runs)
            sha.append(hashlib.sha256(out).hexdigest())
            kept.append(out)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of each row."""
    stash = Stash(spark)
    text = text_of(F.col(f"`{text_col}`"))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    # Rows that repeat whole take part once; they are set apart, so that the others needn't be dealt by id. Where no id has several texts, the hash needn't be told.
    repeats = stash(texts.where("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.min("tag").alias("lo"), F.max("tag").alias("hi")).where("n > 1"), "repeats")
    if repeats.where("lo <> hi").isEmpty():
        texts = texts.withColumn("tag", F.lit(0).cast("long"))
    own = texts
    if not repeats.isEmpty():
        again = texts.join(repeats.select("id"), "id", "left_semi").groupBy("id", "tag").agg(F.count("*").alias("n")).where("n > 1").select("id", "tag")
        own = texts.join(again, ["id", "tag"], "left_anti").unionByName(texts.join(again, ["id", "tag"], "left_semi").dropDuplicates(["id", "tag"]))
    segments = own.mapInArrow(_scan, "anchor long, rank long, sides long, doc long, tag long, span long")
    by = W.partitionBy("anchor")
    nth = F.row_number().over(W.partitionBy("anchor", "rank").orderBy("doc", "tag", "span"))
    ranked = segments.select("*", (F.isnull("rank") | (nth > 1)).alias("again"), F.min("rank").over(by).alias("lo"), F.max("rank").over(by).alias("hi")).where("again or lo <> hi")
    # Equal segments count once; rows that are done with keep their place without a part in the counts.
    often = lambda side: F.sum(F.when(~F.col("again"), 1).otherwise(0)).over(W.partitionBy("anchor", side)) > 1
    sided = ranked.withColumns({"before": F.shiftright("sides", 32), "after": F.expr("sides & 4294967295")}).select("doc", "tag", "span", "again", often("before").alias("left"), often("after").alias("right"))
    found = stash(sided.where("again or left or right"), "segments", heavy=True)

    edges = found.where("not again").groupBy(F.col("doc").alias("id"), "tag").agg(F.collect_list(F.struct("span", "left", "right")).alias("spans"))
    asked = own.join(edges, ["id", "tag"]).select("id", "tag", "text", "spans")
    places = asked.mapInArrow(_half_ranks, "rank long, check int, again boolean, doc long, tag long, pos long")
    place = W.partitionBy("rank", "check", "again").orderBy("doc", "tag", "pos")
    twice = places.withColumn("nth", F.row_number().over(place)).where("again or nth > 1")
    # Neighbouring starts become one span before they are gathered.
    run = twice.withColumn("run", F.col("pos") - F.row_number().over(W.partitionBy("doc", "tag").orderBy("pos")))
    runs = run.groupBy("doc", "tag", "run").agg(F.min("pos").alias("pos"), F.count("*").cast("int").alias("starts")).select("doc", "tag", "pos", "starts")
    cuts = found.where("again").select("doc", "tag", F.expr(f"span >> {COUNT + 8} as pos"), F.expr(f"cast(span >> 8 & {(1 << COUNT) - 1} as int) as starts")).unionByName(runs)
    cuts = stash(cuts.groupBy(F.col("doc").alias("id"), "tag").agg(F.collect_list(F.struct("pos", "starts")).alias("spans")), "cuts", heavy=True)
    stash.clear(found)
    return texts.join(cuts, ["id", "tag"], "left").select("id", "text", "spans").mapInArrow(_cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark, table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
