"""Queries of whole operators whose texts come of the tables' own values: spellings of a document, and routes that pages tell; their oracle SQL is written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import clusters, evidence, places, recompute, routes
from foliant.plans.dialect import quoted

#: Spellings, and which of them match, whichever comes first: Faraj matches two that don't match one another, and so does Mariam bint Yusuf.
SPELLINGS = ("Mariam bint Yusuf", "Marium bint Yousuf", "Mariam", "Maryam bint Yusuf", "Faraj bin Said", "Faraj", "Farraj bin Said Muhammad", "Faraji bin Saeed", "Faraj bin Salim Zanzibari", "Juma bin Khamis bin Ali", "Juma Khamis Ali Nubi", "Jumah bin Khamis", "Abdulla bin Juma", "Abdallah bin Jumah", "Zaid bin Ali", "Ali bin Zaid", "Almas", "Almasi")
MATCHES = ((0, 1), (0, 2), (0, 3), (4, 5), (5, 8), (9, 10), (9, 11), (16, 17))
_WRITTEN = "select concat('doc', o_custkey % 900) as doc_id, (o_orderkey * 8 + l_linenumber) * 32 + (l_partkey * 7 + l_suppkey) % 18 as ord, (l_partkey * 7 + l_suppkey) % 18 as which from lineitem join orders on l_orderkey = o_orderkey"


def _views(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def first_fit_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN9, F4: the spelling that began the cluster of each spelling of a document."""
    _views(spark, sf_dir, "lineitem", "orders")
    rows = spark.sql(_WRITTEN).withColumn("name", F.element_at(F.array(*map(F.lit, SPELLINGS)), (F.col("which") + 1).cast("int")))
    return clusters.canonical_names(rows).select("doc_id", "name", "canonical")


def _first_fit_sql(rows: str, names, matches) -> str:
    """First-fit clusters by recursion: the first spelling that is reached by steps to an earlier one that matches. rows: doc_id, ord, which."""
    told = ", ".join(f"({k}, {quoted(n)})" for k, n in enumerate(names))
    pairs = ", ".join(f"({a}, {b}), ({b}, {a})" for a, b in matches)
    return f"""with recursive told(which, name) as (values {told}), pairs(a, b) as (values {pairs}),
once as (select doc_id, which, min(ord) as ord from ({rows}) r group by doc_id, which),
reach as (
  select doc_id, which, which as spot, ord from once
  union
  select r.doc_id, r.which, o.which, o.ord from reach r join pairs p on p.a = r.spot join once o on o.doc_id = r.doc_id and o.which = p.b and o.ord < r.ord
),
began as (select doc_id, which, arg_min(spot, ord) as began_by from reach group by doc_id, which)
select doc_id, t.name, f.name as canonical from began b join told t on t.which = b.which join told f on f.which = b.began_by"""


#: What the nations of customers stand for, by key.
_SPOTS = ("KENYA", "OMAN", "PERSIA", "INDIA", "EGYPT", "SUDAN", "YEMEN", "QATAR", "HEJAZ", "NEJD", "SOMALIA", "ERITREA", "TURKEY", "IRAQ", "SYRIA", "LAMU", "MOMBASA", "PEMBA", "KILWA", "SURAT", "GWADAR", "SOHAR", "JASK", "LINGEH", "SAUDI ARABIA")
_SPOT = lambda key: f"case {key} {' '.join(f'when {k} then {quoted(p)}' for k, p in enumerate(_SPOTS))} end"
#: Of each order: where from and where to, and what kind of page it is.
_LETTERS = f"""select o_orderkey as page, concat('doc', o_custkey % 40) as doc_id, 1900 + o_orderkey % 60 as doc_year, (o_custkey + o_orderkey) % 4 as kind, {_SPOT('n_nationkey')} as origin, {_SPOT('(n_nationkey * 3 + o_orderkey) % 25')} as goal
from orders join customer on o_custkey = c_custkey join nation on n_nationkey = c_nationkey"""


def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page where a model gave the route, one that tells of forwarding, one with a clause that only looks like an arrival, and one that doesn't name the person."""
    _views(spark, sf_dir, "orders", "customer", "nation")
    letters = spark.sql(_LETTERS)
    forwarded = F.concat(F.lit("No. 12.\nFrom - The Residency Agent, "), "origin", F.lit(".\nThe slave Faraj was forwarded by the mail arriving at "), "goal", F.lit(" on 17th May.\n"))
    clause = F.concat(F.lit("From - The Agent, "), "origin", F.lit(".\nFaraj arrived at without the slightest pressure on either, "), "goal", F.lit(".\n"))
    text = F.when(F.col("kind") == 2, clause).otherwise(F.when(F.col("kind") == 3, F.replace(forwarded, F.lit("Faraj"), F.lit("Almas"))).otherwise(forwarded))
    row = lambda n, place, order, day, sure, time, told: F.struct(F.lit(n).cast("long").alias("ord"), place.alias("place"), F.lit(order).alias("order"), F.lit(day).alias("arrival_date"), F.lit(sure).alias("date_confidence"), F.lit(time).alias("time_info"), told.alias("evidence"))
    given = F.array(row(5, F.lit("Bahrein"), 1, "", "unknown", "before", F.lit("certificate of Bahrain")), row(3, F.col("origin"), 2, "1907-10-27", "explicit", "", F.lit("Appeared")), row(1, F.lit("at Bushire"), 3, "", "", "after", F.lit("")), row(7, F.lower("origin"), 0, "", "", "later words", F.lit("a much longer tale of it")), row(8, F.lit("Muscat"), -1, "", "", "", F.lit("")))
    born = F.array(row(1, F.lit("Zanzibar"), 0, "", "", "", F.lit("born at Zanzibar")))
    reached = F.array(row(1, F.lit("Berbera"), 0, "", "", "", F.lit("find his own way to Berbera")), row(2, F.col("goal"), 0, "", "", "", F.concat(F.lit("he reached "), "goal")))
    rows = F.when(F.col("kind") == 0, given).when(F.col("kind") == 2, reached).otherwise(born)
    pages = letters.select("doc_id", "page", text.alias("text"), "doc_year")
    stops = letters.select("doc_id", "page", F.lit("Faraj").alias("name"), F.explode(rows).alias("r")).select("doc_id", "page", "name", "r.*")
    out = places.reconciled(stops, pages)
    return out.select("doc_id", "page", "name", F.col("ord").cast("int").alias("nth"), "place", F.col("order").alias("stop"), "arrival_date", "date_confidence", "time_info", "evidence")


def dates_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT4, DT5: the first date of a sentence, what gave it, and how many patterns were tried."""
    _views(spark, sf_dir, "orders")
    rows = spark.sql("select o_orderkey as page, o_orderdate as day, o_orderkey % 5 as kind, 1900 + o_custkey % 50 as year from orders")
    day = F.col("day").cast("date")
    month = F.element_at(F.array(*map(F.lit, ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"))), F.month(day))
    text = F.when(F.col("kind") == 0, F.concat(F.lit("dated "), F.date_format(day, "yyyy-MM-dd"), F.lit(", or so"))).when(F.col("kind") == 1, F.concat(F.lit("No. "), F.dayofmonth(day), F.lit("/"), F.month(day), F.lit("/"), F.year(day), F.lit(" of the office")))
    text = text.when(F.col("kind") == 2, F.concat(F.lit("on "), month, F.lit("  "), F.dayofmonth(day), F.lit(", "), F.year(day))).when(F.col("kind") == 3, F.concat(F.dayofmonth(day), F.lit("th "), month, F.lit(" last"))).otherwise(F.lit("no date here"))
    out = routes.found_dates(rows.select("page", text.alias("text"), "year"))
    return out.select("page", "date.iso", "date.confidence", "date.raw", F.size("date.tried").alias("n_tried"))


def quoted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotations without the accents, signs and line ends of their page; one lies inside of another, one stands twice, one nowhere."""
    _views(spark, sf_dir, "customer")
    rows = spark.sql("select c_custkey as page, 'doc' as doc_id, concat('The  ', c_mktsegment, ',\\n of <B\u016bshehr>: ', c_name, ' \u2014 the ', c_mktsegment) as text, c_mktsegment as segment, c_name as who from customer")
    asked = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(label).alias("label"), q.alias("quotation")) for k, (label, q) in enumerate((("inside", F.lower("segment")), ("words", F.concat(F.lit("the "), F.lower("segment"), F.lit(" of Bushehr"))), ('a "name"', F.upper("who")), ("none", F.lit("no such words")), ("empty", F.lit(" "))))))
    told = rows.select("doc_id", "page", F.explode(asked).alias("a")).select("doc_id", "page", "a.*")
    out = evidence.highlighted(rows.select("doc_id", "page", "text"), told)
    return out.select("page", F.col("spans")[0]["s"].alias("s0"), F.col("spans")[0]["e"].alias("e0"), F.col("spans")[1]["s"].alias("s1"), F.col("spans")[1]["e"].alias("e1"), F.size("spans").alias("n"), "markup")


def stages_to_make(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6, ST7: of each page, the stages that have to be made anew after one was made again, or is missing."""
    _views(spark, sf_dir, "orders")
    rows = spark.sql("select concat('doc', o_custkey % 400) as doc_id, cast(o_orderkey as int) as page, (o_orderkey + o_custkey) % 9 as kind from orders where o_orderkey % 3 = 0")
    made = {"ingest": (), "ocr": ("ingest",), "classify": ("ocr",), "names": ("classify", "ocr"), "meta": ("names", "ocr"), "places": ("names", "ocr")}
    was = lambda s, k: F.concat(F.lit(s), F.when(F.col("kind") == k, " before").otherwise(""))
    # Kind 1: names were made again since; kind 2: the text was read again; kind 3: places are missing; kind 4: classify was never made. Others are as they were.
    again = {"names": 1, "ocr": 2}
    one = lambda s: F.struct(F.lit(s).alias("stage"), F.lit(s).alias("hash"), F.create_map(*(x for u in made[s] for x in (F.lit(u), was(u, again.get(u, -1))))).cast("map<string,string>").alias("used"))
    held = rows.select("doc_id", "page", "kind", F.explode(F.array(*map(one, made))).alias("a")).select("doc_id", "page", "kind", "a.*")
    held = held.where("not (kind = 3 and stage = 'places') and not (kind = 4 and stage = 'classify')").drop("kind")
    whole = recompute.pages_hash(held.where("stage in ('classify', 'meta', 'places')"))
    # The tables of even documents were made of what is there now, those of odd ones of less.
    total = whole.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", F.when(F.substring("doc_id", -1, 1).cast("int") % 2 == 0, F.col("hash")).otherwise("less")))).alias("used"))
    held = held.unionByName(total.select("doc_id", F.lit(0).alias("page"), F.lit("aggregate").alias("stage"), F.lit("t").alias("hash"), "used"))
    return recompute.to_make(rows, held)


QUERIES = {f.__name__: f for f in (first_fit_spellings, page_routes, dates_in_texts, quoted_spans, stages_to_make)}

_CAPITAL = "array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_STOP = "select doc_id, page, 'Faraj' as name, {nth} as nth, {place} as place, {stop} as stop, {day} as arrival_date, {sure} as date_confidence, {time} as time_info, {told} as evidence from l where {when}"


def _stop(when: str, nth: int, place: str, stop: int, day: str = "''", sure: str = "''", time: str = "''", told: str = "''") -> str:
    return _STOP.format(when=when, nth=nth, place=place, stop=stop, day=day, sure=sure, time=time, told=told)


_MAY, _BORN = "doc_year || '-05-17'", "'born at Zanzibar'"
_SENT, _CAME = "'From - The Residency Agent, ' || origin || '.'", "'arriving at ' || goal || ' on 17th May'"
#: canonical_people: the valid ones of the catalogue's names, of which two match.
_VALID = {0: "Mariam bint Yusuf", 1: "Amina bin Salim", 2: "Marium bint Yousuf", 3: "Faraj bin Said", 7: "Abu Bakr Al-din", 9: "Zahra daughter of Ali"}
_VALID_ROWS = f"select l_orderkey % 40 as doc_id, l_orderkey * 10000000000 + (l_linenumber * 1000000 + l_partkey) * 1000 + l_suppkey as ord, (l_partkey + l_linenumber) % 10 as which from lineitem where (l_partkey + l_linenumber) % 10 in ({', '.join(map(str, _VALID))})"
SQL = {
    "canonical_people": _first_fit_sql(_VALID_ROWS, [_VALID.get(k, "") for k in range(10)], ((0, 2),)),
    "first_fit_spellings": _first_fit_sql(_WRITTEN, SPELLINGS, MATCHES),
    "page_routes": f"with l as (select *, {_CAPITAL.format(x='origin')} as o, {_CAPITAL.format(x='goal')} as g from ({_LETTERS}) x) "
    + " union all ".join((
        _stop("kind = 0", 0, "'Bahrain'", 1, sure="'unknown'", time="'before'", told="'certificate of Bahrain'"),
        _stop("kind = 0", 1, "o", 2, "'1907-10-27'", "'explicit'", "'later words'", "'Appeared'"),
        _stop("kind = 0", 2, "'Bushehr'", 3, time="'after'"),
        _stop("kind = 1 and o <> g", 0, "o", 1, told=_SENT),
        _stop("kind = 1 and o <> g", 1, "g", 2, _MAY, "'derived_from_doc'", "'17th May'", _CAME),
        _stop("kind = 1 and o <> g", 2, "'Zanzibar'", 0, told=_BORN),
        _stop("kind = 1 and o = g", 0, "g", 1, _MAY, "'derived_from_doc'", "'17th May'", _CAME),
        _stop("kind = 1 and o = g", 1, "'Zanzibar'", 0, told=_BORN),
        _stop("kind = 2", 0, "g", 1, told="'he reached ' || goal"),
        _stop("kind = 2", 1, "'Berbera'", 0, told="'find his own way to Berbera'"),
        _stop("kind = 3", 0, "'Zanzibar'", 0, told=_BORN),
    )),
    "stages_to_make": """with p as (select concat('doc', o_custkey % 400) as doc_id, cast(o_orderkey as int) as page, (o_orderkey + o_custkey) % 9 as kind, o_custkey % 2 as odd from orders where o_orderkey % 3 = 0),
w(kind, stage) as (values (1, 'meta'), (1, 'places'), (2, 'classify'), (2, 'names'), (2, 'meta'), (2, 'places'), (3, 'places'), (4, 'classify'), (4, 'names'), (4, 'meta'), (4, 'places'))
select distinct doc_id, page, stage from p join w using (kind) union all select distinct doc_id, 0 as page, 'aggregate' as stage from p where odd = 1 or kind in (1, 2, 3, 4)""",
    "quoted_spans": """with t as (select c_custkey as page, c_name as who, c_mktsegment as seg, length(c_mktsegment) as l from customer)
select page, 0 as s0, cast(5 + l + 6 + 10 as int) as e0, cast(5 + l + 6 + 10 + 1 as int) as s1, cast(5 + l + 6 + 10 + 1 + length(who) as int) as e1, 2 as n,
concat('<mark title="words">The  ', seg, ',', chr(10), ' of &lt;Būshehr&gt;:</mark> <mark title="a &quot;name&quot;">', who, '</mark> — the ', seg) as markup from t""",
    "dates_in_texts": """with r as (select o_orderkey as page, cast(o_orderdate as date) as day, o_orderkey % 5 as kind, 1900 + o_custkey % 50 as year from orders),
m as (select *, day(day) || '' as d, month(day) || '' as mm, year(day) || '' as y, monthname(day) as mn from r)
select page, case when kind in (0, 1, 2) then strftime(day, '%Y-%m-%d') when kind = 3 then year || strftime(day, '-%m-%d') else '' end as iso,
case when kind in (0, 1, 2) then 'explicit' when kind = 3 then 'derived_from_doc' else '' end as confidence,
case kind when 0 then strftime(day, '%Y-%m-%d') when 1 then d || '/' || mm || '/' || y when 2 then mn || ' ' || d || ', ' || y when 3 then d || 'th ' || mn else '' end as raw,
case kind when 0 then 1 when 1 then 2 when 2 then 3 else 4 end as n_tried from m""",
}
