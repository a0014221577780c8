"""Evidence in a page's text: where a quotation or a name stands, spans that don't overlap, and the page with its spans marked. The functions of Python values are what tests hold the SQL against."""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import columns as C
from foliant.functions import plain
from foliant.functions import scalar as S
from foliant.operators import routes
from foliant.plans.dialect import SPARK

SPANS = "array<struct<s:int,e:int,label:string,priority:int>>"


def find_span(quotation: str | None, page: str | None) -> tuple[int, int] | None:
    """the first place of the quotation, whatever its case; else the first run of words that are its words without accents and signs."""
    quotation, page = plain.spaced(quotation), page or ""
    if not quotation or not page:
        return None
    at = page.casefold().find(quotation.casefold())
    if at >= 0 and len(page.casefold()) == len(page):
        return at, at + len(quotation)
    wanted = plain.match_key(quotation).split()
    if not wanted:
        return None
    words = [(m.start(), m.end(), k) for m in re.finditer(r"\S+", page) for k in plain.match_key(m.group()).split()]
    for i in range(len(words) - len(wanted) + 1):
        if [w[2] for w in words[i : i + len(wanted)]] == wanted:
            return words[i][0], words[i + len(wanted) - 1][1]
    return None


def chosen(spans: list[dict]) -> list[dict]:
    """spans that don't overlap: those of the least priority first, then by begin, longer ones before shorter; in the order of the text."""
    out: list[dict] = []
    for x in sorted(spans, key=lambda x: (x["priority"], x["s"], x["s"] - x["e"])):
        if all(x["e"] <= y["s"] or y["e"] <= x["s"] for y in out):
            out.append(x)
    return sorted(out, key=lambda x: x["s"])


def marked(page: str | None, spans: list[dict]) -> str:
    """the page as HTML with its spans in mark elements."""
    out, at, page = [], 0, page or ""
    for x in chosen(spans):
        out += [html.escape(page[at : x["s"]]), f'<mark title="{html.escape(x["label"])}">', html.escape(page[x["s"] : x["e"]]), "</mark>"]
        at = x["e"]
    return "".join(out) + html.escape(page[at:])


def _read(pages: DataFrame) -> DataFrame:
    """pages with low, the text in lower case, and its words: tokens (white space and what lies between), joined, the words of all tokens as match_key gives them, and owner, the token of each."""
    apart = F.regexp_extract_all("__t", F.lit(f"[^{S.SPACE[1:]}+|{S.SPACE}+"), F.lit(0))
    keys = F.transform("tokens", lambda t: F.filter(F.split(C.match_key(t), " "), lambda w: w != ""))
    told = pages.withColumn("__t", F.coalesce("text", F.lit(""))).withColumn("low", F.lower("__t"))
    told = told.select("*", F.inline(F.array(F.struct(apart.alias("tokens"))))).select("*", F.inline(F.array(F.struct(keys.alias("keys")))))
    owner = F.flatten(F.transform("keys", lambda w, k: F.array_repeat(k, F.size(w))))
    return told.select("*", F.inline(F.array(F.struct(F.concat(F.lit(" "), F.array_join(F.flatten("keys"), " "), F.lit(" ")).alias("joined"), owner.alias("owner"))))).drop("keys")


def find_spans(pages: DataFrame, quotations: DataFrame) -> DataFrame:
    """quotations (doc_id, page, ord, label, quotation) that stand in the text of pages (doc_id, page, text), with s and e: by their letters in any case, else by their words without accents
    and signs, of which each has to follow the one before. Where lower case changes a text's length, words decide."""
    rows = quotations.join(_read(pages.select("doc_id", "page", "text")), ["doc_id", "page"])
    rows = rows.withColumn("__q", C.spaced("quotation")).where("__q <> ''").withColumn("__k", C.match_key("__q"))
    direct = F.when(F.length("low") == F.length("__t"), F.instr("low", F.lower("__q"))).otherwise(0)
    rows = rows.select("*", F.inline(F.array(F.struct(direct.alias("hit"), F.when(F.col("__k") != "", F.instr("joined", F.concat(F.lit(" "), "__k", F.lit(" ")))).otherwise(0).alias("word")))))
    rows = rows.where("hit > 0 or word > 0")
    ahead = F.substring("joined", F.lit(1), F.col("word") - 1)
    nth = F.length(ahead) - F.length(F.replace(ahead, F.lit(" "), F.lit("")))  # words before the first one that is meant
    rows = rows.withColumn("nth", nth).withColumn("first", F.get("owner", F.col("nth"))).withColumn("last", F.get("owner", F.col("nth") + F.size(F.split("__k", " ")) - 1))
    upto = lambda n: F.length(F.array_join(F.slice("tokens", 1, n), ""))
    s = F.when(F.col("hit") > 0, F.col("hit") - 1).otherwise(upto(F.col("first")))
    e = F.when(F.col("hit") > 0, F.col("hit") - 1 + F.length("__q")).otherwise(upto(F.col("last") + 1))
    return rows.select(*quotations.columns, s.cast("int").alias("s"), e.cast("int").alias("e"))


def _gathered(found: DataFrame) -> DataFrame:
    """The chosen spans of each page; what is asked about a page is bounded."""
    one = F.array_sort(F.collect_list(F.struct("ord", "s", "e", F.coalesce("label", F.lit("")).alias("label"), "priority")))
    return found.groupBy("doc_id", "page").agg(C.chosen(F.transform(one, lambda x: F.struct(x["s"], x["e"], x["label"], x["priority"]))).alias("spans"))


def _shown(pages: DataFrame, spans: DataFrame) -> DataFrame:
    out = pages.join(spans, ["doc_id", "page"], "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))
    return out.withColumn("markup", C.marked("text", "spans"))


def highlighted(pages: DataFrame, evidence: DataFrame) -> DataFrame:
    """Pages (doc_id, page, text) with spans and markup, for evidence (doc_id, page, ord, label, quotation)."""
    return _shown(pages, _gathered(find_spans(pages, evidence).withColumn("priority", F.lit(0))))


def highlighted_names(pages: DataFrame, names: DataFrame) -> DataFrame:
    """pages with spans and markup of the places where their names (doc_id, page, ord, name) stand; where they overlap, the name that comes first in the list counts."""
    spelt = routes.normal(names, "name", "__n", S.name(SPARK, "x")).withColumn("__p", C.name_regex("__n"))
    both = spelt.join(pages.select("doc_id", "page", "text"), ["doc_id", "page"])
    found = both.select("doc_id", "page", "ord", F.col("name").alias("label"), F.explode(C.offsets("text", "__p")).alias("o")).select("doc_id", "page", "ord", "label", "o.s", "o.e", F.col("ord").cast("int").alias("priority"))
    return _shown(pages, _gathered(found))
