"""Place rows of a person on a page: from replies, folded, enriched with dates, reconciled with the page, checked.

Tables of place rows have doc_id, page, name, ord, place, order, arrival_date, date_confidence, time_info and evidence. What one person has on one page is
a short list, bounded by the page, so lists meet in a row and are worked on a batch of rows at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import columns as C
from foliant.functions import scalar as S
from foliant.operators import routes
from foliant.operators.steps import written
from foliant.plans.dialect import SPARK

KEYS = ["doc_id", "page", "name"]
FIELDS = ["place", "order", "arrival_date", "date_confidence", "time_info", "evidence"]


def gathered(rows: DataFrame) -> DataFrame:
    """One row a person and page, with the place rows in order as rows."""
    one = F.array_sort(F.collect_list(F.struct("ord", "name", *FIELDS)))
    return rows.groupBy(*KEYS).agg(F.transform(one, lambda x: F.struct(x["name"].alias("name"), *(x[c].alias(c) for c in FIELDS))).alias("rows"))


def _items(replies: DataFrame, reply: str, *more: str) -> DataFrame:
    """The rows of each reply's places that have a valid place, in their order."""
    value = replies.select(*KEYS, *more, C.reply_value(F.col(reply)).alias("__v"))
    items = value.select(*KEYS, *more, F.posexplode(C.reply_items(F.col("__v"), "places")).alias("ord", "i"))
    texts = [C.item_text("i", c).alias(f"__{c}") for c in ("place", "time_text", "evidence", "arrival_date", "date_confidence")]
    rows = items.select(*KEYS, *more, F.col("ord").cast("long").alias("ord"), *texts, F.greatest(F.coalesce(F.try_variant_get("i", "$.order", "int"), F.lit(0)), F.lit(0)).alias("order"))
    said = lambda c: S.cleaned(SPARK, S.spaced(SPARK, c))
    rows = routes.once(rows, time_info=said("__time_text"), evidence=S.first_words(SPARK, "__evidence"), __day=said("__arrival_date"), __sure=said("__date_confidence"))
    rows = routes.normal(written(rows).withColumnRenamed("__place", "__raw"), "__raw", "place", S.place(SPARK, "x"))
    return rows.where(F.expr(S.valid_place(SPARK, "place")))


def candidates(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Valid places of a reply, without order and dates, folded."""
    none = F.lit("")
    return routes.folded(_items(replies, reply).withColumns({"order": F.lit(0), "arrival_date": none, "date_confidence": none}).select(*KEYS, "ord", *FIELDS))


def final(replies: DataFrame, reply: str = "reply", year: str = "doc_year") -> DataFrame:
    """Places of a reply with order, date, confidence and words of time, folded. What can't be read as a date goes into the words of time."""
    rows = _items(replies.withColumn("__year", F.col(year).cast("int")), reply, "__year")
    iso, sure = S.iso_date(SPARK, "d", "y")
    dated = routes.shared(rows.drop("arrival_date"), {"d": F.col("__day"), "y": F.col("__year")}, lambda t: routes.once(routes.once(t, arrival_date=iso), __read=sure))
    unread = "__day <> '' and arrival_date = '' and instr(lower(time_info), lower(__day)) = 0"
    told = dated.withColumns({
        "date_confidence": F.expr(f"case when arrival_date = '' then '' when {S.one_of('__sure', S.CONFIDENCES)} then __sure else __read end"),
        "time_info": F.expr(f"case when {unread} and time_info <> '' then concat(__day, '; ', time_info) when {unread} then __day else time_info end"),
    })
    return routes.folded(told.select(*KEYS, "ord", *FIELDS))


def folded(*tables: DataFrame) -> DataFrame:
    """F1, F2 over the union of tables, in their order (SET2)."""
    out = None
    for i, t in enumerate(tables):
        t = t.select(*KEYS, (F.col("ord") + F.lit(i) * F.lit(1 << 32)).cast("long").alias("ord"), *FIELDS)
        out = t if out is None else out.unionByName(t)
    return routes.folded(out)


def enriched(rows: DataFrame, more: DataFrame) -> DataFrame:
    """JN10: dates where there are none and longer words of time, from rows of the same place; folded again."""
    return routes.enriched(rows, more)


def reconciled(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows in the order of a route. pages: doc_id, page, text, doc_year."""
    return routes.reconciled(rows, pages)


def for_prompt(rows: DataFrame) -> DataFrame:
    """PRJ3: the rows of a person as JSON for a prompt, null for what is empty."""
    empty = lambda c: F.nullif(c, F.lit(""))
    item = lambda x: F.struct(x["place"].alias("place"), x["order"].alias("order"), empty(x["arrival_date"]).alias("arrival_date"), empty(x["date_confidence"]).alias("date_confidence"), empty(x["time_info"]).alias("time_text"), empty(x["evidence"]).alias("evidence"))
    return gathered(rows).select(*KEYS, F.to_json(F.transform("rows", item), {"ignoreNullFields": "false"}).alias("places_json"))


def public(rows: DataFrame) -> DataFrame:
    """PRJ4: without columns that begin with an underscore."""
    return rows.select(*(c for c in rows.columns if not c.startswith("_")))


def ordered(rows: DataFrame) -> DataFrame:
    """SRT2: by page, lower name, order, lower place, and the order of rows."""
    return rows.orderBy("page", F.lower("name"), "order", F.lower("place"), "ord")
