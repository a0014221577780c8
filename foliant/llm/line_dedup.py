"""Lines that many documents share stay in one of them: hashes of lines are dealt by range and sorted by document and position, first occurrences stream past, and
what a document keeps is a compressed bitmap of its lines.

Only DataFrame functions run here. Texts aren't moved to find repeats: a line is two 64-bit hashes of its key, its document and its position. A hash that holds a
share of all lines is split by document into groups of some GROUP rows; the groups' firsts, a few rows a hash, are brought together afterwards.

Defined results: a null or empty text is one empty line; a key is its line without ASCII white space at both ends and with A-Z lowered; rows of one id are one
document, whatever their texts, and equal rows get equal bitmaps; rows with a null id keep all lines and count for none; a table without rows gives none; columns
beside id and text aren't read, whatever they are called. A document's bitmap is bounded by its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stash, table, text_of

SPACE = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One of so many lines is looked at to find hashes that hold a share of all lines; they decide how rows are dealt, never what is found.
LOOK = 64
#: A hash is split where it holds one in so many lines (so there are at most so many), into groups of about GROUP rows.
SHARE, GROUP = 2000, 50_000


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(F.col(f"`{text_col}`"))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))


def hashed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20) -> DataFrame:
    """(h1, h2, doc, tag, pos) of the lines whose keys have at least so many code points; tag tells texts of one id apart."""
    lines = _rows(docs, id_col, text_col).where("doc is not null").select("doc", "tag", F.posexplode(_lines()).alias("pos", "line"))
    keys = lines.select("doc", "tag", "pos", key_of(F.col("line")).alias("key")).where(F.length("key") >= least)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(11), "key").alias("h2"), "doc", "tag", "pos")


def _salted(lines: DataFrame, n: int) -> DataFrame:
    """lines with salt: the group, by document, of hashes that are split (from 1), 0 of the others."""
    seen = lines.where(F.pmod(F.xxhash64("doc", "tag", "pos"), F.lit(LOOK)) == 0).groupBy("h1", "h2").agg(F.count("*").alias("seen"))
    hot = seen.where((F.col("seen") >= 8) & (F.col("seen") * (LOOK * SHARE) >= n)).select("h1", "h2", F.ceil(F.col("seen") * LOOK / GROUP + 7).alias("groups"))
    salt = F.when(F.isnotnull("groups"), F.pmod(F.xxhash64("doc"), F.col("groups")) + 1).otherwise(0)
    return lines.join(F.broadcast(hot), ["h1", "h2"], "left").select("h1", "h2", salt.cast("int").alias("salt"), "doc", "tag", "pos")


def dropped_lines(stash: Stash, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, documents: int = 3) -> DataFrame:
    """(doc, tag, drop): positions, ascending, of the lines that go: those whose key stands in at least so many documents, but for its largest document."""
    lines = stash(hashed_lines(docs, id_col, text_col, least), "lines")
    dealt = _salted(lines, lines.count()).repartitionByRange("h1", "h2", "salt")
    group = W.partitionBy("h1", "h2", "salt")
    order = group.orderBy(F.desc("doc"), "tag", "pos")
    # In this order the first occurrence is the one that stays; the dense rank at the end of a group is its number of documents.
    streamed = dealt.select("*", F.first("doc").over(order).alias("first"), F.dense_rank().over(group.orderBy(F.desc("doc"))).alias("nth"))
    streamed = streamed.withColumn("n", F.max("nth").over(group)).where(F.expr(f"salt > 0 or nth > 1 and n >= {int(documents)}"))
    found = stash(streamed.select("h1", "h2", "salt", "doc", "tag", "pos", "first", "n"), "found")
    # Groups of one hash hold unlike documents: their numbers add up. One row a hash that is split, SHARE at most.
    split = found.where("salt > 0")
    whole = split.groupBy("h1", "h2", "salt").agg(F.max("first").alias("first"), F.max("n").alias("n")).groupBy("h1", "h2").agg(F.max("first").alias("last"), F.sum("n").alias("documents"))
    rest = split.join(F.broadcast(whole), ["h1", "h2"]).where(F.expr(f"documents >= {int(documents)} and doc < last"))
    go = found.where("salt = 0").select("doc", "tag", "pos").unionByName(rest.select("doc", "tag", "pos"))
    return go.groupBy("doc", "tag").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def _runs(n: Column, drop: Column) -> Column:
    """The bitmap's runs of ones: from which line on how many lines stay."""
    before = lambda i: F.when(i == 0, 0).otherwise(F.get(drop, i - 1) + 1)
    runs = F.transform(F.sequence(F.lit(0), F.size(drop)), lambda i: F.struct(before(i).alias("at"), (F.coalesce(F.get(drop, i), n) - before(i)).alias("lines")))
    return F.filter(runs, lambda r: r["lines"] > 0)


def _with_bitmaps(rows: DataFrame, drops: DataFrame) -> DataFrame:
    """(doc, n_lines, n_dropped, keep) beside what rows have; rows have n_lines."""
    none = F.array().cast("array<int>")
    joined = rows.join(drops, ["doc", "tag"], "left").withColumn("drop", F.coalesce("drop", none))
    return joined.select(*rows.columns, F.size("drop").cast("long").alias("n_dropped"), _runs(F.col("n_lines").cast("int"), F.col("drop")).alias("keep"))


def _lines(text: str = "text") -> Column:
    return F.split(text, "\n", -1)


def _n() -> Column:
    return F.size(_lines()).cast("long").alias("n_lines")


def keep_bitmaps(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, documents: int = 3) -> DataFrame:
    """(id, tag, n_lines, n_dropped, keep) of each row: keep is the bitmap of lines that stay, run-length compressed: array of (at, lines). Texts aren't moved."""
    stash = Stash(spark)
    drops = dropped_lines(stash, docs, id_col, text_col, least, documents)
    return _with_bitmaps(_rows(docs, id_col, text_col).select("doc", "tag", _n()), drops).withColumnRenamed("doc", "id")


def applied(lines: Column, keep: Column) -> Column:
    """The text of the lines (an array) that a bitmap keeps."""
    return _let(lines, lambda x: F.array_join(F.flatten(F.transform(keep, lambda r: F.slice(x, r["at"] + 1, r["lines"]))), "\n"))


def kept_texts(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, documents: int = 3) -> DataFrame:
    """(id, n_lines, n_dropped, keep, kept) of each row, with the text that its bitmap keeps."""
    stash = Stash(spark)
    drops = dropped_lines(stash, docs, id_col, text_col, least, documents)
    rows = _with_bitmaps(_rows(docs, id_col, text_col).select("doc", "tag", "text", _n()), drops)
    kept = F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(applied(_lines(), F.col("keep")))
    return rows.select(F.col("doc").alias("id"), "n_lines", "n_dropped", "keep", kept.alias("kept"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kept_texts(spark, table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
with lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents),
keyed as (select *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
often as (select key, max(doc_id) as last from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
told as (select keyed.*, coalesce(doc_id < last, false) as goes from keyed left join often using (key))
select doc_id, count(*) as n_lines, count(*) filter (where goes) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not goes), '')) as kept_sha256
from told group by doc_id
"""
