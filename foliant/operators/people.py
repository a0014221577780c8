"""Passes over the candidates of a page: what models name, what an allowed list keeps, merging of spellings, the rule filter, and audits of what went.

Tables of candidates have doc_id, page, ord (the order of the list), name and evidence; other columns stay where an operator keeps rows and go where it makes new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliant.functions import columns as C
from foliant.functions import plain
from foliant.functions import scalar as S
from foliant.operators import roles, routes
from foliant.operators.steps import written
from foliant.plans.dialect import SPARK

PAGE = ["doc_id", "page"]
AUDIT = "array<struct<name:string,evidence:string,stage:string,reason_type:string,reason:string,excerpt:string,kept_as:string>>"
#: Why a stage lets a candidate go.
FILTERED = ("llm_filtered", "Model filter did not keep this name.")


def from_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """LM3, LM5 and AGG12: one candidate a name of each reply, in the order of the reply; a later one takes the place of an earlier one of its name if its name or its evidence is longer.
    Equal replies about one page count once."""
    value = replies.select(*PAGE, F.xxhash64(reply).alias("__r"), C.reply_value(F.col(reply)).alias("__v"))
    items = value.select(*PAGE, "__r", F.posexplode(C.reply_items(F.col("__v"), "named_people")).alias("at", "i"))
    told = routes.once(items.select(*PAGE, "__r", "at", C.item_text("i", "name").alias("raw"), C.item_text("i", "evidence").alias("said")), evidence=S.first_words(SPARK, "said"))
    # Replies are read once, then names made of them.
    named = routes.shared(written(told), {"x": F.col("raw")}, lambda t: routes.once(routes.once(t, name=S.name(SPARK, "x")), fit=S.candidate_name(SPARK, "name"))).where("fit")
    # Names, and then the order of their reply, are told where the reply's rows are.
    by = named.repartition(*PAGE, "__r").groupBy(*PAGE, "__r", F.lower("name")).agg(F.sort_array(F.collect_list(F.struct("at", "name", "evidence"))).alias("l"))
    longer = lambda a, x: F.when((F.length(x["name"]) > F.length(a["name"])) | (F.length(x["evidence"]) > F.length(a["evidence"])), x).otherwise(a)
    kept = by.select(*PAGE, "__r", F.col("l")[0]["at"].alias("at"), F.when(F.size("l") == 1, F.col("l")[0]).otherwise(F.aggregate("l", F.col("l")[0], longer)).alias("p"))
    ord_ = F.row_number().over(W.partitionBy(*PAGE, "__r").orderBy("at")) - 1
    return kept.select(*PAGE, ord_.alias("ord"), "p.name", "p.evidence")


def key(name: str = "name") -> Column:
    return F.lower(C.normal_name(F.col(name)))


def keyed(rows: DataFrame) -> DataFrame:
    """rows with key; each common name is worked on once. rows are read three times."""
    return routes.shared(rows, {"__name": F.col("name")}, lambda t: t.withColumn("key", key("__name")))


def sifted(picks: DataFrame, allowed: DataFrame) -> DataFrame:
    """What restricted without fall_back keeps and what removed then tells as gone, of rows that have their key: PAGE, ord, name, evidence, kept. The rows of a key meet once."""
    one = lambda rows, side: rows.where("key <> ''").select(*PAGE, "key", F.lit(side).alias("side"), "ord", "name", "evidence")
    by = W.partitionBy(*PAGE, "key").orderBy("side", "ord")
    own = F.max(F.when(F.col("side") == 1, F.struct("ord", "name", "evidence"))).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    seen = one(picks, 0).unionByName(one(allowed, 1)).withColumns({"own": own, "nth": F.row_number().over(by)}).where("side = 0")
    seen = seen.withColumn("kept", F.expr("own is not null and doc_id is not null and page is not null")).where("not kept or nth = 1")
    evidence = F.when(F.col("kept"), F.coalesce(F.nullif("evidence", F.lit("")), "own.evidence")).otherwise(F.col("evidence"))
    told = F.array_join(F.slice(F.split(C.spaced(evidence), " "), 1, 25), " ")
    return seen.select(*PAGE, "ord", F.when(F.col("kept"), F.col("own.name")).otherwise(F.col("name")).alias("name"), told.alias("evidence"), "kept")


def restricted(picks: DataFrame, allowed: DataFrame, fall_back: bool = True) -> DataFrame:
    """JN11: picks that the allowed list has, in its spelling, the first pick of each; evidence of the pick, else of the list (of names that repeat there, the last).
    With fall_back, a page where nothing is left keeps its allowed list (LM4, LM6, LM7)."""
    known = allowed.withColumn("key", key()).groupBy(*PAGE, "key").agg(F.max(F.struct("ord", "name", "evidence")).alias("own"))
    first = picks.withColumn("key", key()).where("key <> ''").withColumn("nth", F.row_number().over(W.partitionBy(*PAGE, "key").orderBy("ord"))).where("nth = 1")
    told = F.array_join(F.slice(F.split(C.spaced(F.coalesce(F.nullif("evidence", F.lit("")), "own.evidence")), " "), 1, 25), " ")
    kept = first.join(known, [*PAGE, "key"]).select(*PAGE, "ord", F.col("own.name").alias("name"), told.alias("evidence"))
    if not fall_back:
        return kept
    return kept.unionByName(allowed.select(*PAGE, "ord", "name", "evidence").join(kept.select(*PAGE).distinct(), PAGE, "left_anti"))


def removed(before: DataFrame, after: DataFrame, stage: str, reason_type: str = FILTERED[0], reason: str = FILTERED[1]) -> DataFrame:
    """JN12, SET3: candidates whose name isn't there any more, and why."""
    gone = before.withColumn("key", key()).where("key <> ''").join(after.select(*PAGE, key().alias("key")).distinct(), [*PAGE, "key"], "left_anti")
    told = F.array_join(F.slice(F.split(C.spaced("evidence"), " "), 1, 25), " ")
    return gone.select(*PAGE, "ord", "name", told.alias("evidence"), F.lit(stage).alias("stage"), F.lit(reason_type).alias("reason_type"), F.lit(reason).alias("reason"), told.alias("excerpt"))


def union(*passes: DataFrame) -> DataFrame:
    """SET2: the candidates of one pass after those of another."""
    out = None
    for i, p in enumerate(passes):
        p = p.select(*PAGE, (F.col("ord") + F.lit(i) * F.lit(1 << 32)).cast("long").alias("ord"), "name", "evidence")
        out = p if out is None else out.unionByName(p)
    return out


def _listed(rows: DataFrame) -> DataFrame:
    """One row a page, with its candidates in order: what a page names is bounded by its text."""
    one = F.array_sort(F.collect_list(F.struct("ord", "name", "evidence")))
    return rows.groupBy(*PAGE).agg(F.transform(one, lambda x: F.struct(x["name"].alias("name"), x["evidence"].alias("evidence"))).alias("people"))


def merged(rows: DataFrame) -> DataFrame:
    """F3, AGG8, SRT3: spellings of a page by first-fit clusters, each with its best one, by lower name."""
    out = _listed(rows).select(*PAGE, F.posexplode(C.merged_people("people")).alias("ord", "p"))
    return out.select(*PAGE, "ord", "p.name", "p.evidence")


def _merge_audit(before, after) -> list[dict]:
    """First exact repeats beyond those that are kept, then spellings that went into another."""
    before, after = ([p.asDict() if hasattr(p, "asDict") else dict(p) for p in x or []] for x in (before, after))
    left: dict[str, int] = {}
    for p in after:
        k = plain.name(p["name"]).lower()
        left[k] = left.get(k, 0) + 1
    kept, out = set(left), []

    def told(p, kind, reason, into=None):
        words = plain.first_words(p["evidence"])
        out.append({"name": p["name"], "evidence": words, "stage": "merged", "reason_type": kind, "reason": reason, "excerpt": words, "kept_as": into})

    for p in before:
        k = plain.name(p["name"]).lower()
        if k and left.get(k, 0) > 0:
            left[k] -= 1
        elif k:
            told(p, "merged_duplicate", "Collapsed an exact duplicate during merge.")
    gone = {(p["name"], p["evidence"]) for p in out}
    for p in before:
        k = plain.name(p["name"]).lower()
        if not k or k in kept or (p["name"], plain.first_words(p["evidence"])) in gone:
            continue
        if into := next((a["name"] for a in after if plain.same_person(p["name"], a["name"])), ""):
            told(p, "merged_variant", f'Merged into "{into}".', into)
    return out


_audit = C.arrow(_merge_audit, AUDIT)


def merge_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """JN13: what merging did away with, and into what."""
    both = _listed(before).withColumnRenamed("people", "was").join(_listed(after), PAGE, "left")
    return both.select(*PAGE, F.posexplode(_audit("was", "people")).alias("ord", "a")).select(*PAGE, "ord", "a.*")


def judged(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows with keep, reason_type, reason and excerpt, from the evidence and each place of the page's text (doc_id, page, text) that names the candidate."""
    asked = written(rows.select(*PAGE, "name", "evidence").distinct().join(pages.select(*PAGE, F.col("text").alias("page_text")), PAGE, "left"))
    keys = [*PAGE, "name", "evidence"]
    decided = routes.shared(asked, {"name": F.col("name"), "evidence": F.col("evidence"), "page_text": F.col("page_text")}, roles.decisions)
    told = decided.select(*(F.col(c).alias(f"__{c}") for c in keys), "keep", "reason_type", "reason", "excerpt")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    return rows.join(told, same).select(*rows.columns, "keep", "reason_type", "reason", "excerpt")


def rule_filter(rows: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The candidates of each page, merged again, that are its subjects, with the reason; and those that aren't, with theirs."""
    told = F.array_join(F.slice(F.split(C.spaced("evidence"), " "), 1, 25), " ")
    seen = judged(merged(rows), pages).withColumns({"evidence": told, "stage": F.lit("rule_filter")})
    return seen.where("keep").drop("keep"), seen.where("not keep").drop("keep")


def listed_names(rows: DataFrame) -> DataFrame:
    """SRC13: the names of each page, trimmed, the first of those that differ in case alone."""
    trimmed = rows.withColumn("name", F.trim("name")).where("name <> ''")
    nth = F.row_number().over(W.partitionBy(*PAGE, F.lower("name")).orderBy("ord"))
    return trimmed.withColumn("nth", nth).where("nth = 1").select(*PAGE, "ord", "name")


def resolved(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """JN17: asked (doc_id, page, name) with the listed spelling; a person that a page doesn't have raises."""
    known = listed.select(*PAGE, F.lower("name").alias("__key"), F.col("name").alias("person"))
    found = asked.withColumn("__key", F.lower(F.trim("name"))).join(known, [*PAGE, "__key"], "left").drop("__key")
    gone = F.raise_error(F.concat(F.lit("no such person on the page: "), F.coalesce("name", F.lit("")))).cast("string")
    return found.withColumn("person", F.when(F.col("person").isNull(), gone).otherwise(F.col("person")))


def with_text(listed: DataFrame, pages: DataFrame) -> DataFrame:
    """JN3: a row a person of each page, with the page's columns; pages without people give none."""
    return listed.select(*PAGE, F.col("ord").alias("person_ord"), "name").join(pages, PAGE)


def upserted(stored: DataFrame, new: DataFrame, listed: DataFrame) -> DataFrame:
    """JN14: the records of a page's people (doc_id, page, name, record) after one or more have been made anew; a new record takes the place of one of the same name, whatever its case.
    nth: people in the order of the page's list first, then the others by name."""
    both = stored.select(*PAGE, "name", "record", F.lit(0).alias("version")).unionByName(new.select(*PAGE, "name", "record", F.lit(1).alias("version")))
    by = W.partitionBy(*PAGE, F.lower("name")).orderBy(F.desc("version"), "name")
    last = both.withColumn("again", F.row_number().over(by)).where("again = 1").withColumn("__key", F.lower("name"))
    at = listed.groupBy(*PAGE, F.lower("name").alias("__key")).agg(F.min("ord").alias("at"))
    nth = F.row_number().over(W.partitionBy(*PAGE).orderBy(F.col("at").asc_nulls_last(), "__key"))
    return last.join(at, [*PAGE, "__key"], "left").select(*PAGE, nth.alias("nth"), "name", "record")
