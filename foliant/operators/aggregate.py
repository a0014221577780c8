"""The tables of a document: details, places, status of each page, statistics and merged spellings, from the rows that artifacts hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliant.functions import columns as C
from foliant.functions import plain
from foliant.functions import scalar as S
from foliant.operators import routes
from foliant.operators.clusters import canonical_names
from foliant.operators.folds import fold_places
from foliant.plans.dialect import SPARK

#: Columns of the three tables.
DETAIL = ("Name", "Page", "Report Type", "Crime Type", "Whether abuse", "Conflict Type", "Trial", "Amount paid")
PLACE = ("Name", "Page", "Place", "Order", "Arrival Date", "Date Confidence", "Time Info")
STATUS = ("page", "filename", "status", "named_people", "detail_rows", "place_rows", "model_calls", "repair_calls", "elapsed_seconds", "note")


def normalised(rows: DataFrame, column: str, sql: str) -> DataFrame:
    """rows with __norm, the normal form of a text column; each common text is worked on once, and no row moves for it."""
    return routes.normal(rows, column, "__norm", sql)


def _place_in_file(rows: DataFrame) -> DataFrame:
    """rows with nth_row, a number that grows with file_page (null: first) and ord."""
    return rows.withColumn("nth_row", F.coalesce(F.col("file_page"), F.lit(-(1 << 31))).cast("long") * F.lit(1 << 32) + F.col("ord"))


def all_names(details: DataFrame, places: DataFrame) -> DataFrame:
    """SET1: (doc_id, raw, name, at): normal names of detail rows, then of place rows, in the order of pages and rows (at). A spelling is one row a document and table, at its first place."""
    one = lambda rows, rank: _place_in_file(rows).groupBy("doc_id", F.col("name").alias("raw")).agg(F.min("nth_row").alias("nth_row")).select("doc_id", "raw", F.struct(F.lit(rank).alias("rank"), "nth_row").alias("at"))
    return normalised(one(details, 0).unionByName(one(places, 1)), "raw", S.name(SPARK, "x")).withColumnRenamed("__norm", "name")


def name_map(names: DataFrame) -> DataFrame:
    """F4, JN6: (doc_id, key: lower name, canonical) by first-fit clusters of the valid names, called by their first members; of clusters that share a name, the later counts."""
    first = names.groupBy("doc_id", "name").agg(F.min("at").alias("at")).where(S.valid_name(SPARK, "name"))
    numbered = first.withColumn("ord", F.row_number().over(W.partitionBy("doc_id").orderBy("at")))
    made = canonical_names(numbered.select("doc_id", "ord", "name"))
    return made.groupBy("doc_id", F.lower("name").alias("key")).agg(F.max_by("canonical", "cluster").alias("canonical"))


def spellings(names: DataFrame, canonical: DataFrame) -> DataFrame:
    """(doc_id, raw, name): what each spelling of all_names is called, by the name_map canonical of these; a normal name that the map doesn't have stays."""
    each = names.select("doc_id", "raw", "name").distinct().withColumn("key", F.lower("name")).join(canonical, ["doc_id", "key"], "left")
    return each.select("doc_id", "raw", F.coalesce("canonical", "name").alias("name"))


def canonical(rows: DataFrame, spelt: DataFrame) -> DataFrame:
    """Rows with their names replaced by those of spellings, which has them all."""
    told = spelt.select(F.col("doc_id").alias("__doc"), F.col("raw").alias("__raw"), F.col("name").alias("__called"))
    met = rows.join(told, F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("name").eqNullSafe(F.col("__raw")), "left")
    return met.withColumn("name", F.col("__called")).drop("__doc", "__raw", "__called")


def detail_table(rows: DataFrame, spelt: DataFrame) -> DataFrame:
    """PRJ1, AGG10, SRT1: the first row of each lower name, page and report type, with a name; nth is its place by page and lower name."""
    named = canonical(rows, spelt).where("name <> ''")
    first = named.withColumn("again", F.row_number().over(W.partitionBy("doc_id", F.lower("name"), "page", "report_type").orderBy("file_page", "ord"))).where("again = 1")
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("page", F.lower("name"), "file_page", "ord"))
    return first.select("doc_id", nth.alias("nth"), F.col("name").alias("Name"), F.col("page").alias("Page"), *(F.col(f).alias(label) for f, label in plain.FIELDS.items()))


def place_table(rows: DataFrame, spelt: DataFrame) -> DataFrame:
    """PRJ2, FLT10, AGG9, F2, SRT2: place rows folded by page, with those of people without a place beside them; nth is their place in the table."""
    normal = normalised(rows, "place", S.place(SPARK, "x")).drop("place").withColumnRenamed("__norm", "place")
    made = _place_in_file(canonical(normal, spelt).where("name <> ''")).drop("ord").withColumnRenamed("nth_row", "ord")
    full = made.where("place <> ''").repartition("doc_id", "page").select("doc_id", "page", "ord", "name", "place", F.col("order").alias("pos"), F.col("arrival_date").alias("arrival"), F.col("date_confidence").alias("confidence"), F.col("time_info").alias("time"), "evidence")
    folded = fold_places(full, "doc_id", "page").select("doc_id", "page", "ord", "name", "place", "pos", "arrival", "confidence", "time")
    blank = made.where("place = ''").select("doc_id", "page", "ord", "name", "place", F.col("order").alias("pos"), F.col("arrival_date").alias("arrival"), F.col("date_confidence").alias("confidence"), F.col("time_info").alias("time"))
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("page", F.lower("name"), "pos", F.lower("place"), "arrival", "ord"))
    both = folded.unionByName(blank)
    return both.select("doc_id", nth.alias("nth"), *(F.col(a).alias(b) for a, b in zip(("name", "page", "place", "pos", "arrival", "confidence", "time"), PLACE)))


def status_table(pages: DataFrame, details: DataFrame, places: DataFrame, facts: DataFrame) -> DataFrame:
    """AGG2-AGG6, JN5: a row a page, with the counts of raw rows."""
    one = lambda rows, d, person: rows.select("doc_id", F.col("file_page").alias("page"), F.lit(d).alias("d"), F.lit(1 - d).alias("p"), person.alias("person"))
    person = F.when(F.col("name") != "", F.lower("name"))
    both = one(details, 1, person).unionByName(one(places, 0, F.lit(None).cast("string")))
    counts = both.groupBy("doc_id", "page").agg(F.sum("d").alias("d"), F.sum("p").alias("p"), F.size(F.collect_set("person")).alias("people"))
    out = pages.join(counts, ["doc_id", "page"], "left").join(facts, ["doc_id", "page"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    status = F.coalesce("status", F.when(zero("d") + zero("p") > 0, "ok").otherwise("no_named_people"))
    columns = [F.concat(F.lit("p"), F.when(F.col("page") < 1000, F.lpad(F.col("page").cast("string"), 3, "0")).otherwise(F.col("page").cast("string"))), status, zero(F.coalesce("named_people", "people")), zero("d"), zero("p"), zero("model_calls"), zero("repair_calls"), F.coalesce(F.col("elapsed_seconds").cast("string"), F.lit("")), F.coalesce("note", F.lit(""))]
    return out.select("doc_id", "page", *(c.alias(n) for c, n in zip(columns, STATUS[1:])))


def _histogram(rows: DataFrame, column: str, name: str) -> DataFrame:
    some = rows.where(F.col(column) != "").groupBy("doc_id", F.col(column).alias("k")).count()
    return some.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", F.col("count").cast("long"))))).alias(name))


def stats(details: DataFrame, places: DataFrame, status: DataFrame) -> DataFrame:
    """AGG1: statistics of each document; histograms leave out what is empty."""
    skipped = F.count_if(F.col("status").startswith("skip:"))
    out = status.groupBy("doc_id").agg(F.count("*").alias("pages_processed"), F.bround(skipped / F.count("*"), 3).alias("skip_rate"), F.count("*").alias("status_rows"))
    d = details.groupBy("doc_id").agg(F.countDistinct(F.lower("Name")).alias("unique_people"), F.count("*").alias("detail_rows"))
    p = places.groupBy("doc_id").agg(F.countDistinct(F.lower(F.nullif("Place", F.lit("")))).alias("unique_places"), F.count("*").alias("place_rows"))
    for t in (d, p):
        out = out.join(t, "doc_id", "left")
    out = out.fillna(0, ["unique_people", "unique_places", "detail_rows", "place_rows"])
    for rows, column, name in ((details, "Report Type", "report_types"), (details, "Crime Type", "crime_types"), (status, "status", "statuses")):
        out = out.join(_histogram(rows, column, name), "doc_id", "left").withColumn(name, F.coalesce(name, F.create_map().cast("map<string,bigint>")))
    return out.select("doc_id", "pages_processed", "skip_rate", "unique_people", "unique_places", "detail_rows", "place_rows", "status_rows", "report_types", "crime_types", "statuses")


def actions(all_names: DataFrame, names: DataFrame) -> DataFrame:
    """AGG11: (doc_id, canonical, variants, action) for canonical names of several spellings, in order."""
    rows = all_names.where("name <> ''").select("doc_id", "name").distinct().withColumn("key", F.lower("name")).join(names, ["doc_id", "key"], "left")
    by = rows.groupBy("doc_id", F.coalesce("canonical", "name").alias("canonical")).agg(F.array_sort(F.collect_set("name")).alias("variants")).where("size(variants) > 1")
    return by.withColumn("action", F.concat(F.lit('Merged name variants into "'), "canonical", F.lit('": '), F.array_join("variants", ", ")))


def page_totals(calls: DataFrame) -> DataFrame:
    """AGG7: of each page, the calls and seconds of its people."""
    return calls.groupBy("doc_id", "page").agg(F.sum("model_calls").alias("model_calls"), F.sum("repair_calls").alias("repair_calls"), F.bround(F.sum("elapsed_seconds"), 2).alias("elapsed_seconds"))


def stage_summary(pages: DataFrame) -> DataFrame:
    """AGG13: of each document, how a stage stands, from rows (doc_id, page, state) with the states done, skipped and error; a document whose only row has no page has none to work on."""
    n = lambda state: F.count_if(F.col("state") == state)
    total = F.count("page")
    by = pages.groupBy("doc_id").agg(total.alias("total_pages"), n("done").alias("completed_pages"), n("skipped").alias("skipped_pages"), n("error").alias("error_pages"))
    status = F.when(F.col("total_pages") == 0, "empty").when(F.col("error_pages") > 0, "partial_with_errors").when(F.col("completed_pages") + F.col("skipped_pages") == F.col("total_pages"), "complete").otherwise("partial")
    return by.withColumn("status", status)
