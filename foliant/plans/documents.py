"""Queries that run the engine's operators whole, over artifacts and replies made of the driver's tables; their oracle SQL is written by hand on the tables themselves,
and shares no expression with the operators."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import columns as C
from foliant.operators import aggregate, evidence, people, places
from foliant.operators.steps import written
from foliant.sources import artifacts

TABLES = ("customer", "orders", "lineitem")

#: What the rows of artifacts hold, by a number from the tables, and what becomes of it: (raw, normal, canonical if it is the first of its document's cluster).
NAMES = (("mariam   BINT YUSUF", "Mariam bint Yusuf"), ("the slave āmina ibn salim", "Amina bin Salim"), ("Marium bint Yousuf", "Marium bint Yousuf"), ("Mr. Faraj bin Said (alias X)", "Faraj bin Said"), ("محمد بن علي", "محمد بن علي"), ("", ""))
PLACES = (("shargah", "Sharjah"), ("at\xa0Dibai", "Dubai"), ("Ras-ul-khaimah", "Ras al Khaimah"), ("", ""), ("from bushire (Persia)", "Bushehr"))
TYPES = ("statement", "correspondence", "None")
CRIMES = ("kidnapping", "null", "")
DATES = (("17th May 1931", "1931-05-17"), ("3/4/1931", "1931-04-03"), ("", ""), ("May 20, 1931", "1931-05-20"))
EVIDENCE = ("Statement of slave {n}, aged 30", "He was sold to {n} for  200 dollars.", "The Political Agent met {n} at noon", "", "{n} is free born and not a slave", "Statement made by {n}; sold to {n}")


def _pick(key: str, values) -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    return f"case {key} {' '.join(f'when {i} then {quoted(v)}' for i, v in enumerate(values))} end"


def _tables(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


#: Of each line item: document, page, order in the page, and numbers that choose what a row holds.
LINES = "lines as (select concat('doc', o_custkey % 40) as doc_id, o_orderkey as page, o_orderstatus as given, (l_linenumber * 1000000 + l_partkey) * 1000 + l_suppkey as n, (l_partkey + l_linenumber) % 6 as who, (l_suppkey + l_linenumber) % 5 as spot, l_partkey % 3 as kind, l_suppkey % 3 as crime, l_linenumber % 3 as stop, (l_partkey + l_suppkey) % 4 as day from lineitem join orders on l_orderkey = o_orderkey)"


def artifact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, kind, content): a JSON artifact of each kind a page, with alternate keys and rows that stand twice; some decisions are broken or not there."""
    _tables(spark, sf_dir)
    rows = spark.sql(f"with {LINES} select *, {_pick('who', [a for a, _ in NAMES])} as raw_name, {_pick('spot', [a for a, _ in PLACES])} as raw_place, {_pick('kind', TYPES)} as raw_type, {_pick('crime', CRIMES)} as raw_crime, {_pick('day', [b for _, b in DATES])} as raw_day from lines")
    listed = lambda item: F.sort_array(F.collect_list(F.struct("n", item.alias("item"))))["item"]
    detail = F.struct(F.when(F.col("n") % 2 == 0, F.col("raw_name")).alias("Name"), F.when(F.col("n") % 2 == 1, F.col("raw_name")).alias("name"), F.col("raw_type").alias("Report Type"), F.col("raw_crime").alias("crime_type"))
    place = F.struct(F.col("raw_name").alias("Name"), F.col("raw_place").alias("Place"), F.col("stop").alias("Order"), F.col("raw_day").alias("Arrival Date"), F.when(F.col("raw_day") != "", "explicit").alias("Date Confidence"))
    by = rows.groupBy("doc_id", "page", "given").agg(listed(detail).alias("details"), listed(place).alias("places"), F.count("*").alias("lines"), F.min("kind").alias("kind"))
    decision = F.to_json(F.struct((F.col("kind") != 2).alias("should_extract"), F.when(F.col("kind") == 2, "index").alias("skip_reason"), F.lit("he  says").alias("evidence"), F.col("lines").alias("model_calls"), F.lit(1.5).alias("elapsed_seconds")))
    decision = F.when(F.col("given") == "P", "{broken").otherwise(decision)
    files = by.select("doc_id", F.col("page").cast("int").alias("page"), F.explode(F.create_map(F.lit("meta"), F.to_json(F.struct(F.col("details").alias("detail_rows"))), F.lit("places"), F.to_json(F.struct(F.col("places").alias("rows"))), F.lit("classify"), decision)).alias("kind", "content"))
    return files


class _Engine:
    """The tables of the artifacts, each made when it is first asked for; artifacts and their rows are written once, since several steps read them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.files = written(artifact_files(spark, sf_dir))

    @cached_property
    def details(self) -> DataFrame:
        return written(artifacts.details(self.files))

    @cached_property
    def places(self) -> DataFrame:
        return written(artifacts.places(self.files))

    @cached_property
    def everyone(self) -> DataFrame:
        return written(aggregate.all_names(self.details, self.places))

    @cached_property
    def names(self) -> DataFrame:
        return aggregate.name_map(self.everyone)

    @cached_property
    def spelt(self) -> DataFrame:
        # Written, so that Spark knows whether it is small enough to be broadcast.
        return written(aggregate.spellings(self.everyone, self.names))

    def detail_table(self) -> DataFrame:
        return aggregate.detail_table(self.details, self.spelt)

    def place_table(self) -> DataFrame:
        return aggregate.place_table(self.places, self.spelt)

    def status_table(self) -> DataFrame:
        return aggregate.status_table(artifacts.pages(self.files), self.details, self.places, artifacts.facts(self.files))


_PLAIN = [c.lower().replace(" ", "_") for c in aggregate.DETAIL]
_PLACE = [c.lower().replace(" ", "_") for c in aggregate.PLACE]


def aggregate_details(spark, sf_dir):
    return _Engine(spark, sf_dir).detail_table().toDF("doc_id", "nth", *_PLAIN).select("doc_id", "nth", *_PLAIN[:4])


def aggregate_places(spark, sf_dir):
    return _Engine(spark, sf_dir).place_table().toDF("doc_id", "nth", *_PLACE).withColumnRenamed("order", "stop").drop("time_info", "nth")


def aggregate_status(spark, sf_dir):
    return _Engine(spark, sf_dir).status_table()


def aggregate_stats(spark, sf_dir):
    t = _Engine(spark, sf_dir)
    # Histograms and counts read these several times; places in tables, orders of routes and counts of pages aren't needed, and not made.
    needed = ((t.detail_table(), ("Name", "Report Type", "Crime Type")), (t.place_table(), ("Place",)), (t.status_table(), ("status",)))
    out = aggregate.stats(*(written(table.select("doc_id", *columns)) for table, columns in needed))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(c)
    return out.select("doc_id", "pages_processed", "skip_rate", "unique_people", "unique_places", "detail_rows", "place_rows", "status_rows", listed("report_types"), listed("crime_types"), listed("statuses"))


def aggregate_actions(spark, sf_dir):
    t = _Engine(spark, sf_dir)
    return aggregate.actions(t.everyone, t.names).select("doc_id", "canonical", "action")


def _replies(spark, sf_dir) -> DataFrame:
    """A model's reply about each page, with words before and a fence around its JSON."""
    _tables(spark, sf_dir)
    rows = spark.sql(f"with {LINES} select *, {_pick('who', [a for a, _ in NAMES])} as raw_name, {_pick('spot', [a for a, _ in PLACES])} as raw_place, {_pick('day', [a for a, _ in DATES])} as raw_day, replace({_pick('who', EVIDENCE)}, '{{n}}', {_pick('who', [b for _, b in NAMES])}) as told from lines")
    who = F.struct(F.col("raw_name").alias("name"), F.col("told").alias("evidence"))
    where = F.struct(F.col("raw_place").alias("place"), F.col("stop").alias("order"), F.col("raw_day").alias("arrival_date"))
    listed = lambda item: F.sort_array(F.collect_list(F.struct("n", item.alias("item"))))["item"]
    by = rows.groupBy("doc_id", "page").agg(listed(who).alias("named_people"), listed(where).alias("places"))
    wrapped = lambda key: F.concat(F.lit("Here is {the} answer:\n```json\n"), F.to_json(F.struct(key)), F.lit("\n``` done }"))
    return by.select("doc_id", F.col("page").cast("int").alias("page"), wrapped("named_people").alias("reply"), wrapped("places").alias("places_reply"))


def reply_people(spark, sf_dir):
    """AGG12 over replies."""
    return people.from_replies(_replies(spark, sf_dir))


def reply_places(spark, sf_dir):
    """R12 over replies, one person a page."""
    replies = _replies(spark, sf_dir).withColumns({"name": F.lit("Faraj"), "doc_year": F.lit(1931)})
    return places.final(replies, "places_reply").select("doc_id", "page", "name", "place", F.col("order").alias("stop"), "arrival_date", "date_confidence")


def reply_candidates(spark, sf_dir):
    """R11 over replies: no orders, no dates."""
    replies = _replies(spark, sf_dir).withColumn("name", F.lit("Faraj"))
    return places.candidates(replies, "places_reply").select("doc_id", "page", "place", F.col("order").alias("stop"), "arrival_date")


def allowed_people(spark, sf_dir):
    """JN11 and JN12: of the people of each reply, those that an allowed list keeps, and those that it doesn't."""
    found = written(people.keyed(written(people.from_replies(_replies(spark, sf_dir)))))
    allowed = found.where("name not like 'Faraj%' and name not like 'Amina%'")
    return people.sifted(found, allowed).select("doc_id", "page", "name", F.when(F.col("kept"), "kept").otherwise("filter").alias("state"))


def judged_people(spark, sf_dir):
    """R5, R6 by the evidence of each candidate."""
    found = written(people.from_replies(_replies(spark, sf_dir)))
    pages = found.select("doc_id", "page").distinct().withColumn("text", F.lit(""))
    return people.judged(found, pages).select("doc_id", "page", "name", "keep", "reason_type", "reason")


def merged_people(spark, sf_dir):
    """F3, AGG8: the best spelling of each person of a page."""
    return people.merged(people.from_replies(_replies(spark, sf_dir))).select("doc_id", "page", "ord", "name")


def detail_checks(spark, sf_dir):
    """CV4-CV6 on values of line items."""
    _tables(spark, sf_dir)
    values, told = ("Debt  Dispute", "YES", "illegal DETENTION", "none", "", "Rs. 40", "repatriation arranged"), ("he  said so", "", " ")
    rows = spark.sql(f"select l_orderkey as page, l_linenumber as n, {_pick('(l_partkey + l_linenumber) % 7', values)} as value, {_pick('l_suppkey % 3', told)} as told from lineitem")
    out = None
    for field in ("crime_type", "whether_abuse", "conflict_type", "trial", "amount_paid"):
        one = rows.withColumn("c", C.checked(field, F.col("value"), F.col("told"))).select("page", "n", F.lit(field).alias("field"), "c.status", "c.final_value", "c.evidence", "c.message")
        out = one if out is None else out.unionByName(one)
    return out


def page_cleanup(spark, sf_dir):
    """TX3, TX8, TX6, TX11, FLT8 on texts of several lines."""
    _tables(spark, sf_dir)
    texts = ("Here is it\r\n```text\r\n a  b\t c \r\n\r\n\r\n\r\nd\r\n```", " ab ", "[OCR_EMPTY]", "Transcription: x\nÉcole,  N° 5", "\n\nx\n")
    rows = spark.sql("select o_orderkey as page, o_orderkey % 5 as k from orders")
    text = F.element_at(F.array(*map(F.lit, texts)), (F.col("k") + 1).cast("int"))
    return rows.withColumn("text", text).select("page", C.page_text("text").alias("cleaned"), C.transcript("text").alias("transcript"), C.is_blank_page("text").alias("blank"), C.match_key("text").alias("match_key"), C.slug("text").alias("slug"))


def evidence_spans(spark, sf_dir):
    """where the customer's segment stands in a sentence that names it in another case."""
    _tables(spark, sf_dir)
    rows = spark.sql("select c_custkey as page, concat('Customer ', c_name, ' of the ', c_mktsegment, ' trade') as text, lower(c_mktsegment) as quotation, 'doc' as doc_id, 0 as ord, 'segment' as label from customer")
    found = evidence.highlighted(rows.select("doc_id", "page", "text"), rows.select("doc_id", "page", "ord", "label", "quotation"))
    return found.select("page", F.col("spans")[0]["s"].alias("start"), F.col("spans")[0]["e"].alias("end_at"), F.size("spans").alias("n"))


QUERIES = {f.__name__: f for f in (aggregate_details, aggregate_places, aggregate_status, aggregate_stats, aggregate_actions, reply_people, reply_places, reply_candidates, allowed_people, judged_people, merged_people, detail_checks, page_cleanup, evidence_spans)}

# --- the oracle: by hand ---

_NORMAL = _pick("who", [b for _, b in NAMES])
_PLACE_OF = _pick("spot", [b for _, b in PLACES])
#: Names 0 and 2 are one person's; the first of a document, details before places, then by page and line, names both. Details come first and hold every line, so pages and lines decide.
_CANONICAL = f"""named as (select *, {_NORMAL} as normal, {_PLACE_OF} as place_name, {_pick('day', [b for _, b in DATES])} as day_iso from lines),
first_spelling as (select doc_id, arg_min(normal, page * 1000000000000 + n) as spelling from named where who in (0, 2) group by doc_id),
canon as (select named.*, case when who in (0, 2) then spelling else normal end as name from named left join first_spelling using (doc_id))"""
_DETAILS = f"""with {LINES}, {_CANONICAL},
firsts as (select *, {_pick('kind', ('statement', 'correspondence', ''))} as report_type, {_pick('crime', ('kidnapping', '', ''))} as crime_type, row_number() over (partition by doc_id, page, lower(name), kind order by n) as again from canon where name <> ''),
details as (select doc_id, cast(row_number() over (partition by doc_id order by page, lower(name), n) as int) as nth, name, cast(page as int) as page, report_type, crime_type from firsts where again = 1)"""
_FOLD = """, steps as (select *, row_number() over (partition by doc_id, page, lower(name), lower(place_name) order by n) as step from canon where name <> '' and place_name <> ''),
fold as (
  with recursive f as (
    select doc_id, page, name, place_name, stop as pos, day_iso as arrival, step from steps where step = 1
    union all
    select f.doc_id, f.page, f.name, f.place_name,
      case when (s.stop > 0 and f.pos = 0) or ((s.stop > 0) = (f.pos > 0) and s.day_iso <> '' and f.arrival = '') then s.stop else f.pos end,
      case when (s.stop > 0 and f.pos = 0) or ((s.stop > 0) = (f.pos > 0) and s.day_iso <> '' and f.arrival = '') then case when s.day_iso = '' then f.arrival else s.day_iso end else case when f.arrival = '' then s.day_iso else f.arrival end end,
      s.step
    from f join steps s on s.doc_id = f.doc_id and s.page = f.page and lower(s.name) = lower(f.name) and lower(s.place_name) = lower(f.place_name) and s.step = f.step + 1
  ) select * from f
),
lasts as (select doc_id, page, name, place_name, arg_max(pos, step) as pos, arg_max(arrival, step) as arrival, (select min(n) from steps s where s.doc_id = fold.doc_id and s.page = fold.page and lower(s.name) = lower(fold.name) and lower(s.place_name) = lower(fold.place_name)) as first_n from fold group by doc_id, page, name, place_name),
place_rows as (
  select doc_id, page, name, place_name, case when pos > 0 then row_number() over (partition by doc_id, page, pos > 0 order by pos, arrival, lower(place_name), first_n) else 0 end as stop, arrival, case when arrival = '' then '' else 'explicit' end as sure from lasts
  union all select doc_id, page, name, '', stop, day_iso, case when day_iso = '' then '' else 'explicit' end from canon where name <> '' and place_name = ''
)"""
_STATUS = """, status as (select doc_id, cast(page as int) as page, concat('p', case when page < 1000 then lpad(cast(page as varchar), 3, '0') else cast(page as varchar) end) as filename,
  case when given <> 'P' and min(kind) = 2 then 'skip:index' else 'ok' end as status, cast(count(distinct case when normal <> '' then lower(normal) end) as int) as named_people, cast(count(*) as int) as detail_rows, cast(count(*) as int) as place_rows,
  case when given = 'P' then 0 else cast(count(*) as int) end as model_calls, 0 as repair_calls, case when given = 'P' then '' else '1.5' end as elapsed_seconds, case when given = 'P' then '' else 'he  says' end as note from canon group by doc_id, page, given)"""
_HISTOGRAM = lambda rows, column, name: f"(select doc_id, string_agg(concat(k, '=', n), ',' order by k) as {name} from (select doc_id, {column} as k, count(*) as n from {rows} where {column} <> '' group by all) group by doc_id) h_{name}"
#: Of a reply: the people, one a lower name, in the order of the first; of equal names the longest evidence, the first of those. Evidence is the same for each name here.
_EVIDENCE = f"regexp_replace(replace({_pick('who', EVIDENCE)}, '{{n}}', {_NORMAL}), ' +', ' ', 'g')"
_PEOPLE = f"with {LINES}, rows_of as (select doc_id, page, n, who, {_NORMAL} as name, {_EVIDENCE} as evidence from lines), first_of as (select doc_id, page, name, evidence, who, min(n) as n from rows_of where name <> '' group by all), numbered as (select doc_id, cast(page as int) as page, cast(row_number() over (partition by doc_id, page order by n) - 1 as int) as ord, name, evidence, who from first_of)"
_REPLY_PLACES = """, canon as (select doc_id, page, n, 'Faraj' as name, {place} as place_name, {stop} as stop, {day} as day_iso from lines)"""
_ROLE = {
    0: (True, "positive_rule", "'matched \"statement of ' || name || '\"'"),
    1: (False, "negative_rule", "'matched \"sold to ' || name || '\"'"),
    2: (False, "negative_rule", "'appears in an official-title context'"),
    3: (False, "ambiguous_subject_role", "'No positive subject signal survived the final rule filter.'"),
    4: (False, "freeborn_not_slave", "'matched \"free born\" plus \"not a slave\"'"),
}
_CHECKS = {
    "crime_type": ("Crime Type", {"illegal DETENTION": "illegal detention"}),
    "whether_abuse": ("Whether abuse", {"YES": "yes"}),
    "conflict_type": ("Conflict Type", {"Debt  Dispute": "debt dispute"}),
    "trial": ("Trial", {"repatriation arranged": "repatriation arranged"}),
    "amount_paid": ("Amount paid", {"Debt  Dispute": "Debt Dispute", "YES": "YES", "illegal DETENTION": "illegal DETENTION", "Rs. 40": "Rs. 40", "repatriation arranged": "repatriation arranged"}),
}


def _checked_sql(field: str) -> str:
    label, good = _CHECKS[field]
    hit = "case value " + " ".join(f"when '{k}' then '{v}'" for k, v in good.items()) + " else '' end"
    ok = "Whether abuse is one of yes/no and has evidence." if field == "whether_abuse" else "Amount paid kept as literal page text." if field == "amount_paid" else f"{label} is in the allowed set."
    blank = "value in ('', 'none')" if field == "amount_paid" else "value = ''"
    return f"""select page, n, '{field}' as field, case when hit <> '' and said <> '' then 'ok' when hit <> '' then 'cleared_missing_evidence' when {blank} then 'empty' else 'cleared_invalid' end as status,
case when said <> '' then hit else '' end as final_value, case when hit <> '' then said else '' end as evidence,
case when hit <> '' and said <> '' then '{ok}' when hit <> '' then 'Cleared {label} because no supporting evidence was provided.' when {blank} then '{label} empty.' else concat('Cleared invalid {label} value "', replace(value, '  ', ' '), '".') end as message
from (select *, {hit} as hit, case when told = 'he  said so' then 'he said so' else '' end as said from given_values)"""


SQL = {
    "aggregate_details": f"{_DETAILS} select * from details",
    "aggregate_places": f"with {LINES}, {_CANONICAL}{_FOLD} select doc_id, name, cast(page as int) as page, place_name as place, cast(stop as int) as stop, arrival as arrival_date, sure as date_confidence from place_rows",
    "aggregate_status": f"with {LINES}, {_CANONICAL}{_STATUS} select * from status",
    "aggregate_stats": f"""{_DETAILS}{_FOLD}{_STATUS}
select s.*, coalesce(d.unique_people, 0) as unique_people, coalesce(p.unique_places, 0) as unique_places, coalesce(d.detail_rows, 0) as detail_rows, coalesce(p.place_rows, 0) as place_rows, coalesce(report_types, '') as report_types, coalesce(crime_types, '') as crime_types, coalesce(statuses, '') as statuses
from (select doc_id, count(*) as pages_processed, round_even(count(*) filter (where status like 'skip:%') / count(*), 3) as skip_rate, count(*) as status_rows from status group by doc_id) s
left join (select doc_id, count(distinct lower(name)) as unique_people, count(*) as detail_rows from details group by doc_id) d using (doc_id)
left join (select doc_id, count(distinct case when place_name <> '' then lower(place_name) end) as unique_places, count(*) as place_rows from place_rows group by doc_id) p using (doc_id)
left join {_HISTOGRAM('details', 'report_type', 'report_types')} using (doc_id) left join {_HISTOGRAM('details', 'crime_type', 'crime_types')} using (doc_id) left join {_HISTOGRAM('status', 'status', 'statuses')} using (doc_id)""",
    "aggregate_actions": f"with {LINES}, {_CANONICAL} select doc_id, name as canonical, concat('Merged name variants into \"', name, '\": Mariam bint Yusuf, Marium bint Yousuf') as action from canon where who in (0, 2) group by doc_id, name having count(distinct normal) = 2",
    "reply_people": f"{_PEOPLE} select doc_id, page, ord, name, evidence from numbered",
    "reply_places": f"with {LINES}{_REPLY_PLACES.format(place=_PLACE_OF, stop='stop', day=_pick('day', [b for _, b in DATES]))}{_FOLD} select doc_id, cast(page as int) as page, name, place_name as place, cast(stop as int) as stop, arrival as arrival_date, '' as date_confidence from place_rows where place_name <> ''",
    "reply_candidates": f"with {LINES} select distinct doc_id, cast(page as int) as page, {_PLACE_OF} as place, 0 as stop, '' as arrival_date from lines where spot <> 3",
    "allowed_people": f"{_PEOPLE} select doc_id, page, name, case when who in (1, 3) then 'filter' else 'kept' end as state from numbered",
    "judged_people": f"{_PEOPLE} select doc_id, page, name, case who {' '.join(f'when {k} then {str(v[0]).lower()}' for k, v in _ROLE.items())} end as keep, case who {' '.join(f'''when {k} then '{v[1]}' ''' for k, v in _ROLE.items())} end as reason_type, case who {' '.join(f'when {k} then {v[2]}' for k, v in _ROLE.items())} end as reason from numbered",
    "merged_people": f"{_PEOPLE}, best as (select doc_id, page, case when who in (0, 2) and max(case when who = 2 then 1 else 0 end) over (partition by doc_id, page) = 1 then 'Marium bint Yousuf' else name end as name from numbered) select doc_id, page, cast(row_number() over (partition by doc_id, page order by lower(name)) - 1 as int) as ord, name from (select distinct doc_id, page, name from best)",
    "detail_checks": f"with given_values as (select l_orderkey as page, l_linenumber as n, {_pick('(l_partkey + l_linenumber) % 7', ('Debt  Dispute', 'YES', 'illegal DETENTION', 'none', '', 'Rs. 40', 'repatriation arranged'))} as value, {_pick('l_suppkey % 3', ('he  said so', '', ' '))} as told from lineitem) " + " union all ".join(map(_checked_sql, _CHECKS)),
    "page_cleanup": """select o_orderkey as page,
case o_orderkey % 5 when 0 then concat('Here is it', chr(10), '```text', chr(10), 'a b c', chr(10), chr(10), chr(10), chr(10), 'd', chr(10), '```') when 1 then 'ab' when 2 then '[OCR_EMPTY]' when 3 then concat('Transcription: x', chr(10), 'École, N° 5') else 'x' end as cleaned,
case o_orderkey % 5 when 0 then concat('a  b', chr(9), ' c', chr(10), chr(10), 'd') when 1 then 'ab' when 2 then '[OCR_EMPTY]' when 3 then 'École,  N° 5' else 'x' end as transcript,
o_orderkey % 5 in (1, 4) as blank,
case o_orderkey % 5 when 0 then 'here is it text a b c d' when 1 then 'ab' when 2 then 'ocr empty' when 3 then 'transcription x ecole n 5' else 'x' end as match_key,
case o_orderkey % 5 when 0 then 'here_is_it_text_a_b_c_d' when 1 then 'ab' when 2 then 'ocr_empty' when 3 then 'transcription_x_ecole_n_5' else 'x' end as slug from orders""",
    "evidence_spans": "select c_custkey as page, cast(length('Customer ' || c_name || ' of the ') as int) as start, cast(length('Customer ' || c_name || ' of the ' || c_mktsegment) as int) as end_at, 1 as n from customer",
}
