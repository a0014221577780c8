"""First-fit clusters of the spellings of a document, whatever their number: no task holds a document.

A name joins the first cluster with a member that it matches. So its cluster is begun by the first of the names without an earlier match that it reaches by steps
from a name to an earlier one that it matches; this is found by passing the least such beginner along the links until nothing changes.

Links. A match takes equal first words, or first words that are alike, so names meet by pairs of first words of their document: the equal pair, and the pairs that
are alike. Names of one first word are dealt into chunks of at most about CHUNK names, and a task compares two chunks. What bounds a match from above by counts of
characters and words is computed for all pairs of two chunks at once; only pairs that the bounds leave are compared letter by letter. Bounds never exclude a match,
so the links are those of comparing all pairs. Documents of at most CHUNK spellings are clustered in one task each, by the same comparison.

Null and empty names are left out; repeats of a name count once, at its least ord; of names of one ord the first by letter comes first; names without a word to compare are clusters of their own."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import plain
from foliant.operators.steps import written

CHUNK = 2048
#: Buckets that characters, and words, are counted by.
BUCKETS = 32
#: Bounds are compared with a little to spare, since ratios are rounded.
SPARE = 1e-9


def _counts(texts: Iterable[str]) -> np.ndarray:
    out = np.zeros((len(texts), BUCKETS), np.uint16)
    for row, text in enumerate(texts):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % BUCKETS
        out[row] = np.minimum(np.bincount(codes, minlength=BUCKETS), 65535)
    return out


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How much two rows of counts have in common, for all pairs."""
    out = np.empty((len(a), len(b)), np.int32)
    step = max(1, (1 << 21) // max(1, len(b) * a.shape[1]))
    for at in range(0, len(a), step):
        out[at : at + step] = np.minimum(a[at : at + step, None], b[None]).sum(2, dtype=np.int32)
    return out


def _frame(doc, n: int, **columns) -> pd.DataFrame:
    """Columns beside __doc; texts are plain objects, which any Arrow type is made of."""
    docs = [doc] * n if not isinstance(doc, list) else doc
    return pd.DataFrame({"__doc": pd.Series(docs, dtype=object)} | {k: v if isinstance(v, np.ndarray) else pd.Series(v, dtype=object) for k, v in columns.items()})


class Names:
    """Spellings with what bounds their likeness."""

    def __init__(self, names: list[str]):
        self.names = names
        words = [plain.compared(n) for n in names]
        self.first = np.array([w[0] if w else "" for w in words], object)
        lower, flat = [plain.name(n).lower() for n in names], ["".join(w) for w in words]
        self.whole, self.flat = _counts(lower), _counts(flat)
        self.length, self.flat_length = (np.array([len(x) for x in t], np.int64) for t in (lower, flat))
        self.words = np.zeros((len(names), BUCKETS), np.uint16)
        for row, w in enumerate(words):
            for x in {*w}:
                self.words[row, hash(x) % BUCKETS] += 1
        self.n_words = self.words.sum(1).astype(np.int64)

    def may_match(self, other: Names) -> np.ndarray:
        """Pairs that no bound excludes, in either order; the limits are those of plain.same_person."""
        same = (self.first[:, None] == other.first[None]).astype(bool)
        flat = 2 * _shared(self.flat, other.flat) / np.maximum(self.flat_length[:, None] + other.flat_length[None], 1) + SPARE
        out = ~same & (flat >= 0.82)
        if same.any():
            whole = _shared(self.whole, other.whole)
            inside = whole >= np.minimum(self.length[:, None], other.length[None])  # one may hold the other
            near = 2 * whole / np.maximum(self.length[:, None] + other.length[None], 1) + SPARE >= 0.9
            words = _shared(self.words, other.words) / np.maximum(np.maximum(self.n_words[:, None], other.n_words[None]), 1) + SPARE >= 0.75
            out |= same & (inside | near | words | (flat >= 0.8))
        return out & (self.n_words > 0)[:, None] & (other.n_words > 0)[None]


def links(left: list[str], left_ord: np.ndarray, right: list[str] | None = None, right_ord: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(later, earlier) of the matches between two lists of names, or inside of one; a later name is compared with an earlier one."""
    a = Names(left)
    b, b_ord = (a, left_ord) if right is None else (Names(right), right_ord)
    may = a.may_match(b)
    if right is None:
        may &= left_ord[:, None] > b_ord[None]
    later, earlier = [], []
    for i, j in zip(*np.nonzero(may)):
        x, y = (i, j) if left_ord[i] > b_ord[j] else (j, i)
        first, second = (a.names[x], b.names[y]) if left_ord[i] > b_ord[j] else (b.names[x], a.names[y])
        if plain.same_person(first, second):
            later.append(max(left_ord[i], b_ord[j]))
            earlier.append(min(left_ord[i], b_ord[j]))
    return np.array(later, np.int64), np.array(earlier, np.int64)


def _first_fit(names: list[str], order: np.ndarray) -> np.ndarray:
    """The ord of each name's beginner; one document of at most CHUNK names."""
    later, earlier = links(names, order)
    begun = {int(o): int(o) for o in order}
    by: dict[int, list[int]] = {}
    for x, y in zip(later.tolist(), earlier.tolist()):
        by.setdefault(x, []).append(y)
    for o in sorted(begun):
        begun[o] = min((begun[y] for y in by.get(o, ())), default=o)
    return np.array([begun[int(o)] for o in order], np.int64)


def _small(pdf: pd.DataFrame) -> pd.DataFrame:
    order = pdf["ord"].to_numpy()
    return _frame(pdf["__doc"].tolist(), len(pdf), ord=order, begun=_first_fit(pdf["name"].tolist(), order))


def _first_words(batches):
    for batch in batches:
        names = batch["name"].tolist()
        yield _frame(batch["__doc"].tolist(), len(names), ord=batch["ord"].to_numpy(), name=names, word=[(plain.compared(n) or ("",))[0] for n in names])


def _alike_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """Unequal first words of two chunks that are alike in one order at least."""
    a = pdf.loc[pdf["side"] == 0, "word"].tolist()
    b = pdf.loc[pdf["side"] == 1, "word"].tolist() if (pdf["side"] == 1).any() else a
    size = lambda t: np.array([len(x) for x in t], np.int64)
    near = 2 * _shared(_counts(a), _counts(b)) / np.maximum(size(a)[:, None] + size(b)[None], 1) + SPARE >= 0.83
    found = {tuple(sorted((a[i], b[j]))) for i, j in zip(*np.nonzero(near)) if a[i] != b[j] and (plain._alike(a[i], b[j], 0.83) or plain._alike(b[j], a[i], 0.83))}
    return _frame(pdf["__doc"].iloc[0], len(found), word=[x for x, _ in found], other=[y for _, y in found])


def _compared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between two chunks of names, or inside of one."""
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    if len(right):
        later, earlier = links(left["name"].tolist(), left["ord"].to_numpy(), right["name"].tolist(), right["ord"].to_numpy())
    else:
        later, earlier = links(left["name"].tolist(), left["ord"].to_numpy())
    return _frame(pdf["__doc"].iloc[0], len(later), later=later, earlier=earlier)


def _chunk(column: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.ceil(n / CHUNK)).cast("int")


def _meetings(pairs: DataFrame) -> DataFrame:
    """A row for each two chunks that a pair of first words (with chunks and other_chunks) makes meet; of an equal pair, each two once."""
    each = pairs.withColumn("i", F.explode(F.expr("sequence(0, cast(chunks as int) - 1)"))).withColumn("j", F.explode(F.expr("sequence(if(word = other, i, 0), cast(other_chunks as int) - 1)")))
    return each.select("__doc", "word", "other", "i", "j")


def _sides(meetings: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """The rows (__doc, word, chunk) of both chunks of each meeting."""
    left = meetings.join(rows.withColumnRenamed("chunk", "i"), ["__doc", "word", "i"]).select("__doc", "word", "other", "i", "j", F.lit(0).alias("side"), *columns)
    apart = meetings.where("word <> other or i <> j")
    right = apart.join(rows.withColumnsRenamed({"chunk": "j", "word": "other"}), ["__doc", "other", "j"]).select("__doc", "word", "other", "i", "j", F.lit(1).alias("side"), *columns)
    return left.unionByName(right)


def links_of(rows: DataFrame) -> DataFrame:
    """(__doc, later, earlier): all matches between the names (__doc, ord, name) of each document."""
    words = rows.mapInPandas(_first_words, "__doc string, ord bigint, name string, word string").where("word <> ''")
    words = written(words)
    sizes = words.groupBy("__doc", "word").agg(F.count("*").alias("n"))
    # First words of a document that are alike: chunks of the words themselves meet.
    per_doc = sizes.groupBy("__doc").agg(F.count("*").alias("words")).select("__doc", F.lit("").alias("word"), F.lit("").alias("other"), F.ceil(F.col("words") / CHUNK).alias("chunks"))
    all_chunks = _meetings(per_doc.withColumn("other_chunks", F.col("chunks")))
    own = sizes.join(per_doc.select("__doc", "chunks"), "__doc").select("__doc", F.lit("").alias("word"), F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int").alias("chunk"), F.col("word").alias("spelt"))
    met = _sides(all_chunks, own, "spelt").withColumnsRenamed({"word": "none", "spelt": "word"})
    alike = met.groupBy("__doc", "i", "j").applyInPandas(_alike_words, "__doc string, word string, other string").distinct()
    counted = sizes.select("__doc", "word", F.ceil(F.col("n") / CHUNK).alias("chunks"))
    pairs = sizes.select("__doc", "word", F.col("word").alias("other")).unionByName(alike)
    pairs = pairs.join(counted, ["__doc", "word"]).join(counted.withColumnsRenamed({"word": "other", "chunks": "other_chunks"}), ["__doc", "other"])
    placed = words.join(sizes, ["__doc", "word"]).select("__doc", "word", _chunk("ord", F.col("n")).alias("chunk"), "ord", "name")
    both = _sides(_meetings(pairs), placed, "ord", "name")
    return both.groupBy("__doc", "word", "other", "i", "j").applyInPandas(_compared, "__doc string, later bigint, earlier bigint")


def beginners(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(__doc, ord, begun) of each name, from its links to earlier ones."""
    found = written(found.distinct())
    first = rows.select("__doc", "ord").join(found.select("__doc", F.col("later").alias("ord")).distinct(), ["__doc", "ord"], "left_anti").select("__doc", "ord", F.col("ord").alias("begun"))
    first = written(first)
    now, seen = first, None
    while True:
        passed = found.join(now.withColumnRenamed("ord", "earlier"), ["__doc", "earlier"]).groupBy("__doc", F.col("later").alias("ord")).agg(F.min("begun").alias("begun"))
        now = written(first.unionByName(passed))
        told = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(__doc, ord, begun))")).first())
        if told == seen:
            return now
        seen = told


def canonical_names(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, name, canonical, cluster) for the distinct normalised names of each document, in the order of ord: canonical is the name that began the cluster, cluster its number, which grows in that order."""
    kind = dict(rows.dtypes)[key]
    marked = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))  # a null key is a document too
    once = rows.where("name <> ''").groupBy(marked.alias("__doc"), "name").agg(F.min("ord").alias("__at"))
    # Numbers in the order of ord, of equal ones by name; a document's names may lie in several partitions.
    once = written(once.orderBy("__doc", "__at", "name").select("__doc", F.monotonically_increasing_id().alias("ord"), "name"))
    many = once.groupBy("__doc").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select("__doc")
    some = not many.isEmpty()
    small = (once.join(many, "__doc", "left_anti") if some else once).groupBy("__doc").applyInPandas(_small, "__doc string, ord bigint, begun bigint")
    if some:
        large = once.join(many, "__doc", "left_semi")
        small = small.unionByName(beginners(large, links_of(large)))
    told = written(small)
    names = once.join(told, ["__doc", "ord"])
    began = once.select("__doc", F.col("ord").alias("begun"), F.col("name").alias("canonical"))
    return names.join(began, ["__doc", "begun"]).select(F.expr("if(__doc = '', null, substring(__doc, 2))").cast(kind).alias(key), "name", "canonical", F.col("begun").alias("cluster"))
