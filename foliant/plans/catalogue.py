"""The catalogue of queries: each is one text of SQL, made in Spark's dialect to run and in the oracle's to compare.

Their inputs are derived from the driver's tables by rule: pages from orders, people from customers, places and dates from line items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.functions import scalar as S
from foliant.plans.dialect import ORACLE, SPARK, Spark

TABLES = ("customer", "orders", "lineitem", "events")


def _case(key: str, values) -> str:
    return f"case {key} {' '.join(f"when {i} then {S.quoted(v)}" for i, v in enumerate(values[:-1]))} else {S.quoted(values[-1])} end"


PAGES = (
    "Statement of Mariam bint Yusuf. I was born in Zanzibar and taken to Dubai on 17th May 1931.",
    "He was sent to the Agency;   maintenance was paid. Passage to Muscat, 3-4-31.",
    "INDEX  of papers, table of contents (5/296)",
    "About this record: holding institution, Open Government Licence.",
    "%% ## ~~ @@ !! x",
    "[OCR_EMPTY]",
    "From - Sharjah, 12th May 1931. Arriving at Bushehr on May 20, 1931.",
    "Letter of the owner about a debt without any further news from 1928.",
)
NAMES = ("mariam   BINT YUSUF", "the slave āmina ibn salim", "Marium bint Yousuf", "Mr. Faraj bin Said (alias Farag)", "Sheikh Rashid", "owner", "Abdulla 7", "abu bakr al-din", "unknown man", "[Zahra daughter of Ali],")
PLACES = ("shargah", "at Dibai", "Ras-ul-khaimah", "H.M.S. Lawrence", "the agency", "from bushire (Persia)", "Without The Slightest Pressure On Either", "muscat", "Al Ain town near the old fort wall", "Pier 9")
DATES = ("1931-05-17", "17-5-1931", "3/4/31", "May 17, 1931", "17th May 1931", "17th May", "arrived 1931-05-17", "no date", "31-2-1931", "1/2/193")
TYPES = ("statement", "Statement", "transport/admin", "memo", "correspondence")
MOVES = ("he arrived at Muscat", "wished to be sent to Dubai", "certificate for delivery", "requested leave and reached Basra", "Taken  to the office", "no word", "", "not clearly completed")
REASONS = ("index", "Record_Metadata", "bad_ocr", "null", "other")


def views(d: Spark) -> str:
    """Common table expressions: pages, decisions on all of them and those that are stored, people, pages that name any, and routes."""
    return f"""
syn_pages as (select o_custkey % 40 as doc_id, o_orderkey as page, {_case('o_orderkey % 8', PAGES)} as text, 1900 + o_orderkey % 60 as doc_year from orders),
classify as (select o_custkey % 40 as doc_id, o_orderkey as page, (o_orderkey % 5) <> 2 as should_extract, case when o_orderkey % 5 = 2 then {_case('o_orderkey % 3', REASONS[:3])} else null end as skip_reason, {_case('o_orderkey % 5', TYPES)} as report_type, o_orderkey % 4 as model_calls, o_orderkey % 2 as repair_calls, case when o_orderkey % 9 = 0 then 'note' else '' end as note, o_orderstatus as given from orders),
decided as (select * from classify where given <> 'P'),
people as (select l_orderkey as page, (l_linenumber * 1000000 + l_partkey) * 1000 + l_suppkey as ord, {_case('(l_partkey + l_linenumber) % 10', NAMES)} as name, {_case('l_suppkey % 5', TYPES)} as report_type, l_returnflag as flag from lineitem),
naming as (select distinct page from people where flag = 'R'),
routes as (select l_orderkey as page, (l_linenumber * 1000000 + l_partkey) * 1000 + l_suppkey as ord, {_case('l_partkey % 10', NAMES)} as name, {_case('l_suppkey % 10', PLACES)} as place, l_linenumber % 4 - 1 as pos, {_case('(l_partkey + l_suppkey) % 10', DATES)} as date_text, l_orderkey % 60 + 1900 as doc_year from lineitem)"""


def _named(d: Spark) -> str:
    return f"{views(d)}, named as ({d.mapped('people', 's.page, s.ord, s.report_type', ('name',), name=S.name(d, 'name'))}), kept as (select * from named where {S.valid_name(d, 'name')})"


def _routed(d: Spark) -> str:
    iso, confidence = S.iso_date(d, "date_text", "cast(doc_year as int)")
    dated = d.mapped("spaced", "s.page, s.ord, s.name, s.place, s.pos", ("date_text", "doc_year"), arrival=iso, confidence=confidence)
    named = d.mapped("dated", "s.page, s.ord, s.place, s.pos, s.arrival, s.confidence", ("name",), name=S.name(d, "name"))
    placed = d.mapped("by_name", "s.page, s.ord, s.name, s.pos, s.arrival, s.confidence", ("place",), place=S.place(d, "place"))
    return f"{views(d)}, spaced as ({d.mapped('routes', 's.page, s.ord, s.name, s.place, s.pos, s.doc_year', ('date_text',), date_text=S.spaced(d, 'date_text'))}), dated as ({dated}), by_name as ({named}), placed as ({placed}), routed as (select * from placed where {S.valid_place(d, 'place')})"


def names_normalized(d):
    return f"with {views(d)}, n as ({d.mapped('people', 's.page, s.ord, s.name as raw', ('name',), name=S.name(d, 'name'), valid=S.valid_name(d, S.name(d, 'name')), candidate=S.candidate_name(d, S.name(d, 'name')))}) select page, ord, raw, name, valid, candidate from n"


def places_normalized(d):
    return f"with {views(d)}, n as ({d.mapped('routes', 's.page, s.ord, s.place as raw', ('place',), place=S.place(d, 'place'), valid=S.valid_place(d, S.place(d, 'place')))}) select page, ord, raw, place, valid from n"


def dates_iso(d):
    iso, confidence = S.iso_date(d, "raw", "cast(doc_year as int)")
    return f"with {views(d)}, n as ({d.mapped('routes', 's.page, s.ord, s.doc_year', ('date_text',), raw=S.spaced(d, 'date_text'))}), t as ({d.mapped('n', 's.page, s.ord, s.raw', ('raw', 'doc_year'), iso=iso, confidence=confidence)}) select page, ord, raw, iso, confidence from t"


def page_facts(d):
    return f"with {views(d)} select doc_id, page, {S.year(d, 'text')} as doc_year, cast(nullif({d.extract('text', r'\(([0-9]+)/[0-9]+\)', 1)}, '') as int) as header_page, {S.first_words(d, 'text')} as evidence from syn_pages"


def rule_hints(d):
    s = S.spaced(d, "text")
    hint = lambda p: S.first_words(d, d.extract(s, p))
    return f"with {views(d)} select page, {hint(S.STATEMENT)} as statement_hint, {hint(S.CORRESPONDENCE)} as correspondence_hint, {hint(S.INDEX)} as index_hint, {hint(S.RECORD)} as record_hint, {S.bad_page(d, 'text')} as bad_ocr, {S.overridden(d, 'text', "'correspondence'")} as report_type from syn_pages"


def page_decisions(d):
    return f"with {views(d)}, r as (select doc_id, page, should_extract, {S.skip_reason(d, 'skip_reason')} as reason, {S.report_type(d, 'report_type')} as report_type from classify) select doc_id, page, should_extract and reason = '' as should_extract, nullif(reason, '') as skip_reason, report_type from r"


def gated_pages(d):
    return f"with {views(d)} select p.doc_id, p.page, c.report_type from syn_pages p join decided c on p.doc_id = c.doc_id and p.page = c.page where c.should_extract and exists (select 1 from naming n where n.page = p.page)"


def pages_to_resume(d):
    return f"with {views(d)} select doc_id, page from syn_pages p where not exists (select 1 from decided c where c.doc_id = p.doc_id and c.page = p.page)"


def detail_rows(d):
    return f"with {_named(d)}, r as (select page, name, {S.cleaned(d, 'report_type')} as report_type, ord, row_number() over (partition by page, lower(name), {S.cleaned(d, 'report_type')} order by ord) as nth from kept) select page, name, report_type, row_number() over (partition by page order by lower(name), ord) as row_in_page from r where nth = 1"


def name_variants(d):
    joined = "array_join(array_sort(collect_set(name)), ', ')" if d.name == "spark" else "array_to_string(list_sort(list(distinct name)), ', ')"
    return f"with {_named(d)} select page, lower(name) as canonical, {joined} as variants, count(*) as n from kept group by page, lower(name)"


def status_rows(d):
    status = "case when c.page is not null and not c.should_extract then concat('skip:', coalesce(c.skip_reason, 'bad_ocr')) when coalesce(n.n, 0) + coalesce(r.n, 0) > 0 then 'ok' else 'no_named_people' end"
    return f"with {_named(d)}, n as (select page, count(*) as n, count(distinct lower(name)) as people from kept group by page), r as (select page, count(*) as n from routes group by page) select p.doc_id, p.page, {status} as status, coalesce(n.people, 0) as named_people, coalesce(n.n, 0) as detail_rows, 2 * coalesce(r.n, 0) as place_rows, coalesce(c.model_calls, 0) as model_calls, coalesce(c.repair_calls, 0) as repair_calls, coalesce(c.note, '') as note from syn_pages p left join decided c on p.doc_id = c.doc_id and p.page = c.page left join n on n.page = p.page left join r on r.page = p.page"


def document_stats(d):
    skipped = "sum(case when c.page is not null and not c.should_extract then 1 else 0 end)"
    return f"with {_named(d)}, n as (select page, count(*) as n, max(lower(name)) as last_name from kept group by page) select p.doc_id, count(*) as pages, cast({skipped} as bigint) as skipped, round({skipped} * 1000e0 / count(*)) / 1000e0 as skip_rate, cast(sum(coalesce(n.n, 0)) as bigint) as detail_rows, max(n.last_name) as last_name, cast(sum(case when c.report_type = 'statement' then 1 else 0 end) as bigint) as statements from syn_pages p left join decided c on p.doc_id = c.doc_id and p.page = c.page left join n on n.page = p.page group by p.doc_id"


def duplicate_places(d):
    return f"with {_routed(d)} select page, lower(name) as name, lower(place) as place, min(ord) as first_ord, count(*) as n from routed group by page, lower(name), lower(place) having count(*) > 1"


def route_checks(d):
    return f"with {_routed(d)}, s as (select page, name, ord, pos, arrival, row_number() over (partition by page, name order by ord) as nth, lag(arrival) over (partition by page, name order by ord) as before from routed where pos > 0) select page, name, count(*) as stops, min(case when pos = nth then 1 else 0 end) as consecutive, min(case when before is null or before = '' or arrival = '' or before <= arrival then 1 else 0 end) as ascending from s group by page, name"


def reranked_places(d):
    return f"with {_routed(d)}, f as (select *, row_number() over (partition by page, lower(name), lower(place) order by ord) as nth from routed where pos >= 0) select page, name, place, arrival, case when pos > 0 then row_number() over (partition by page, pos > 0 order by pos, arrival, lower(place), ord) else 0 end as place_order from f where nth = 1"


def category_choices(d):
    value = _case("l_suppkey % 6", ("Debt  Dispute", "kidnapping case", "none", "other", "", "OWNERSHIP DISPUTE"))
    return f"with r as (select l_orderkey as page, l_linenumber as ord, {value} as raw, l_partkey % 3 = 0 as evident from lineitem), c as (select *, {S.allowed(d, 'raw', S.CONFLICTS)} as found from r) select page, ord, case when evident then found else '' end as value, case when trim(raw) = '' or lower(raw) = 'none' then 'empty' when found = '' then 'cleared_invalid' when not evident then 'cleared_missing_evidence' else 'ok' end as status from c"


def stage_progress(d):
    return "with s as (select event_type as stage, user_id as page, max(event_id) as last from events group by event_type, user_id), t as (select s.stage, case e.event_id % 4 when 0 then 'done' when 1 then 'skipped' when 2 then 'failed' else 'running' end as state from s join events e on e.event_id = s.last) select stage, count(*) as total, sum(case when state = 'failed' then 1 else 0 end) as failed, cast(floor(100.0 * sum(case when state in ('done', 'skipped') then 1 else 0 end) / count(*) + 0.5) as bigint) as percent, case when sum(case when state = 'failed' then 1 else 0 end) > 0 then 'partial_with_errors' when sum(case when state = 'running' then 1 else 0 end) = 0 then 'complete' else 'partial' end as status from t group by stage"


def skip_propagation(d):
    return f"with {views(d)} select p.doc_id, p.page, case when c.page is null then 'blocked' when not c.should_extract then 'skipped' else 'pending' end as names_state, case when c.page is null then 'blocked' when not c.should_extract or n.page is null then 'skipped' else 'pending' end as places_state, case when c.page is not null and not c.should_extract then coalesce(c.skip_reason, 'bad_ocr') when c.page is not null and n.page is null then 'no_named_people' else '' end as reason from syn_pages p left join decided c on p.doc_id = c.doc_id and p.page = c.page left join naming n on n.page = p.page"


def document_listing(d):
    return f"with {views(d)} select {S.doc_id(d, "concat(' file:', cast(doc_id as " + ('string' if d.name == 'spark' else 'varchar') + "), '. ')")} as doc_id, count(*) as pages, min(page) as first_page, max(page) as last_page from syn_pages group by doc_id"


def move_texts(d):
    return f"with t as (select l_orderkey as page, l_linenumber as nth, {_case('(l_partkey + l_linenumber) % 8', MOVES)} as text from lineitem) select page, nth, text, {S.confident_move(d, 'text')} as confident, {S.uncertain_move(d, 'text')} as uncertain from t"


def _validated(d: Spark) -> str:
    """checks: of each person on a page, the five rules with status and message; persons without places have five empty ones."""

    def listed(x: str, when: str) -> str:
        if d.name == "spark":
            return f"array_join(transform(array_sort(collect_list(case when {when} then struct(ord, {x} as x) end)), s -> s.x), ', ')"
        return f"coalesce(string_agg({x}, ', ' order by ord) filter (where {when}), '')"

    fine, broken = "then 'ok'", "else 'fail'"
    rules = (
        ("Positive orders", "consecutive = 1", "'Positive orders form 1..n consecutively.'", "'Positive orders must be consecutive 1..n.'"),
        ("Duplicate places", "repeated = ''", "'No duplicate final places remain.'", "concat('Duplicate final places remain: ', repeated, '.')"),
        ("Date confidence", "undated = ''", "'Date confidence is blank when arrival date is blank.'", "concat('Date confidence must be blank when arrival_date is blank: ', undated, '.')"),
        ("Ascending dates", "ascending = 1", "'Positive route order is consistent with arrival dates.'", "'Positive route order conflicts with arrival dates.'"),
        ("Valid place text", "invalid = ''", "'No ships or generic office words were kept.'", "concat('Invalid place-like text remains: ', invalid, '.')"),
    )
    by = lambda of: "case rule_no " + " ".join(f"when {k} then {of(*rule)}" for k, rule in enumerate(rules, 1)) + " end"
    status = by(lambda rule, good, yes, no: f"case when places is null then 'empty' when {good} {fine} {broken} end")
    message = by(lambda rule, good, yes, no: f"case when places is null then 'No places extracted.' when {good} then {yes} else {no} end")
    rows = f"select page, name, rule_no, {by(lambda rule, *_: S.quoted(rule))} as rule, {status} as status, {message} as message from ruled"
    fit, confidence = S.valid_place(d, "place"), "case when ord % 3 = 0 then 'explicit' else confidence end as confidence"
    stops = f"listed as (select page, ord, name, place, pos, arrival, {confidence}, {fit} as fit from placed)"
    persons = f"persons as (select distinct page, {S.name(d, 'name')} as name from people"
    if d.name == "spark":
        stops = f"listed as ({d.over('placed', f'page, ord, name, place, pos, arrival, {confidence}', fit=(('place',), fit))})"
        persons = f"people_named as ({d.over('people', 'page', name=(('name',), S.name(d, 'name')))}),\npersons as (select distinct page, name from people_named"
    return f"""{_routed(d)},
{stops},
placed_at as (select *, case when pos > 0 then row_number() over (partition by page, name, pos > 0 order by ord) end as nth, lag(arrival) over (partition by page, name, pos > 0 and arrival <> '' order by ord) as before, row_number() over (partition by page, name, lower(place) order by ord) as again from listed),
facts as (select page, name, count(*) as places, min(case when pos > 0 and pos <> nth then 0 else 1 end) as consecutive, min(case when pos > 0 and arrival <> '' and before > arrival then 0 else 1 end) as ascending, {listed('place', "place <> '' and (again = 2 or again > 2 and place <> lower(place))")} as repeated, {listed('place', "arrival = '' and confidence <> ''")} as undated, {listed('place', 'not fit')} as invalid from placed_at group by page, name),
{persons} union select distinct page, name from placed),
judged as (select p.page, p.name, f.places, f.consecutive, f.ascending, f.repeated, f.undated, f.invalid from persons p left join facts f on p.page = f.page and p.name = f.name),
ruled as ({d.numbered('judged', len(rules), 'rule_no')}),
checks as ({rows})"""


def route_validation(d):
    return f"with {_validated(d)} select page, name, rule_no, rule, status, message from checks"


def route_retries(d):
    """The message of the first rule that fails."""
    first = "min_by(message, rule_no)" if d.name == "spark" else "arg_min(message, rule_no)"
    return f"with {_validated(d)} select page, name, case when min(status) = 'empty' then 'Verifier returned no places.' else {first} end as message from checks where status <> 'ok' group by page, name"


def histograms(d):
    return f"with {views(d)} select 'report_type' as kind, report_type as value, count(*) as n from classify group by report_type union all select 'status' as kind, case when should_extract then 'extract' else concat('skip:', coalesce(skip_reason, 'bad_ocr')) end as value, count(*) as n from classify group by 2"


BUILDERS = (move_texts, route_validation, route_retries, histograms, names_normalized, places_normalized, dates_iso, page_facts, rule_hints, page_decisions, gated_pages, pages_to_resume, detail_rows, name_variants, status_rows, document_stats, duplicate_places, route_checks, reranked_places, category_choices, stage_progress, skip_propagation, document_listing)


def _runner(build: Callable[[Spark], str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(build(SPARK))

    run.__name__ = build.__name__
    return run


QUERIES = {b.__name__: _runner(b) for b in BUILDERS}
SQL = {b.__name__: b(ORACLE) for b in BUILDERS}


def folded_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place fold over the routes of each page."""
    from foliant.operators.folds import fold_places

    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    for t in ("orders", "customer"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    routed = spark.sql(f"with {_routed(SPARK)} select page, ord, name, place, pos, arrival, confidence, if(ord % 2 = 0, 'in May', '') as time, place as evidence from placed")
    return fold_places(routed, "page").drop("ord")


def canonical_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-fit clusters of the names of each document."""
    from foliant.operators.clusters import canonical_names

    for t in ("orders", "customer", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    named = spark.sql(f"with {_named(SPARK)} select page % 40 as doc_id, page * 10000000000 + ord as ord, name from kept")
    return canonical_names(named).drop("cluster")


#: The fold, a row at a time: how a row's weight compares, and what the kept row takes from the other.
_WEIGHT = "struct_pack(a := cast({r}.pos > 0 as int), b := cast({r}.arrival <> '' as int), c := case {r}.confidence when 'explicit' then 3 when 'derived_from_doc' then 2 else 0 end, d := cast({r}.time <> '' as int), e := length({r}.evidence))"


def _fold_oracle() -> str:
    wins = f"{_WEIGHT.format(r='s')} > {_WEIGHT.format(r='f')}"
    pick = lambda c: f"case when {wins} then s.{c} else f.{c} end"
    fill = lambda c: f"case when {wins} then case when s.{c} = '' then f.{c} else s.{c} end else case when f.{c} = '' then s.{c} else f.{c} end end"
    sure = f"case when {wins} then case when s.arrival = '' and f.arrival <> '' then f.confidence else s.confidence end else case when f.arrival = '' and s.arrival <> '' then s.confidence else f.confidence end end"
    return f"""with {_routed(ORACLE)},
told as (select page, ord, name, place, pos, arrival, confidence, case when ord % 2 = 0 then 'in May' else '' end as time, place as evidence from placed where place <> ''),
steps as (select *, row_number() over (partition by page, lower(name), lower(place) order by ord) as step, min(ord) over (partition by page, lower(name), lower(place)) as first_ord from told),
fold as (with recursive f as (
  select * from steps where step = 1
  union all
  select f.page, {pick('ord')}, {pick('name')}, {pick('place')}, {pick('pos')}, {fill('arrival')}, {sure}, {fill('time')}, {fill('evidence')}, s.step, f.first_ord
  from f join steps s on s.page = f.page and lower(s.name) = lower(f.name) and lower(s.place) = lower(f.place) and s.step = f.step + 1
) select * from f),
kept as (select * from fold where step = (select max(step) from steps s where s.page = fold.page and lower(s.name) = lower(fold.name) and lower(s.place) = lower(fold.place)) and pos >= 0)
select page, name, place, cast(case when pos > 0 then row_number() over (partition by page, pos > 0 order by pos, arrival, lower(place), first_ord) else 0 end as int) as pos, arrival, confidence, time, evidence from kept"""


#: Clusters follow a sequence ratio, which SQL doesn't have; tests hold them against first-fit clusters in plain Python.
QUERIES |= {f.__name__: f for f in (folded_places, canonical_people)}
SQL["folded_places"] = _fold_oracle()
