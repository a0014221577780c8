"""Routes of a person on a page as one plan: rows are folded, what a page tells of forwarding is added where no route is given, rows are folded again, and put in
the order in which the page names them.

All of it is SQL on rows. What a page tells is found once a page, dates once a text; folds and orders need the rows of a person on a page together, so these share
one exchange. Lower case is Spark's, accents are those below U+0250, and white space, words and digits in patterns are Unicode's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliant.functions import columns as C
from foliant.functions import plain
from foliant.functions import scalar as S
from foliant.operators.folds import fold_places
from foliant.operators.steps import written
from foliant.plans.dialect import COMMON, SPARK

KEYS = ["doc_id", "page", "name"]
FIELDS = ["place", "order", "arrival_date", "date_confidence", "time_info", "evidence"]
FAR = plain.FAR
#: Where inferred rows stand after those that a person has.
AFTER = 1 << 48
#: Signs of keys that are worked on once; COMMON of them are broadcast.
SHORT = 300


def once(df: DataFrame, **made: str) -> DataFrame:
    """df with expressions over its columns; a generator, so that what reads them doesn't compute them again."""
    return df.select("*", F.inline(F.array(F.struct(*(F.expr(sql).alias(k) for k, sql in made.items())))))


def _java(pattern: str, flags: str = "idU") -> str:
    return SPARK.pattern(f"(?{flags}){pattern}")


def normal(rows: DataFrame, column: str, out: str, sql: str) -> DataFrame:
    """rows with out, an expression over x, the text in column (null: empty). The COMMON most frequent texts are worked on once and broadcast, so that no row moves; others where they are."""
    own = rows.withColumn("x", F.coalesce(column, F.lit("")))
    common = own.groupBy("x").count().orderBy(F.desc("count")).limit(COMMON).select("x")
    each = once(common, **{out: sql}).select(F.col("x").alias("__x"), F.col(out).alias("__made"), F.lit(True).alias("__found"))
    met = own.join(F.broadcast(each), F.col("x") == F.col("__x"), "left")
    return once(met, **{out: f"if(__found, __made, {sql})"}).drop("x", "__x", "__made", "__found")


def shared(rows: DataFrame, keys: dict[str, Column], work) -> DataFrame:
    """rows with what work adds to a table of its keys, all of these short: the COMMON most frequent keys are worked on once and broadcast, the other rows where they are; no row moves.
    rows are read three times."""
    own = rows.withColumns({f"__k{i}": k for i, k in enumerate(keys.values())})
    names = [f"__k{i}" for i in range(len(keys))]
    short = own.where(sum((F.coalesce(F.length(F.col(k).cast("string")), F.lit(0)) for k in names), F.lit(0)) <= SHORT)
    common = short.groupBy(*names).count().orderBy(F.desc("count")).limit(COMMON).select(*(F.col(k).alias(c) for k, c in zip(names, keys)))
    made = written(work(common))  # so that both joins read the same keys
    more = [c for c in made.columns if c not in keys]
    made = made.withColumnsRenamed({c: f"__c{i}" for i, c in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"__c{i}")) for i, k in enumerate(names)]
    hits = own.join(F.broadcast(made), same).select(*rows.columns, *more)
    rest = own.join(F.broadcast(made), same, "left_anti")
    # Columns have names of their own beside the keys.
    apart = {c: f"__row{i}" for i, c in enumerate(rows.columns)}
    rest = work(rest.select(*(F.col(c).alias(r) for c, r in apart.items()), *(F.col(k).alias(c) for k, c in zip(names, keys))))
    return hits.unionByName(rest.select(*(F.col(r).alias(c) for c, r in apart.items()), *more))


def found_dates(texts: DataFrame, text: str = "text", year: str = "year") -> DataFrame:
    """DT4, DT5: texts with date (iso, confidence, raw, tried): of the patterns, in the order in which they count, the first that gives a date; else that of the whole text.
    tried are the patterns up to that one."""
    return shared(texts, {"__t": F.coalesce(text, F.lit("")), "__y": F.col(year).cast("int")}, _dates)


def _dates(rows: DataFrame) -> DataFrame:
    """rows (__t, __y and others) with date."""
    own = once(rows, s=S.spaced(SPARK, "__t"))
    own = once(own, **{f"r{k}": f"regexp_extract(s, {_java(p)}, 0)" for k, (_, p) in enumerate(plain.DATES_IN_TEXT)})
    for k, source in enumerate(["r0", "r1", "r2", "r3", "s"]):
        iso, sure = S.iso_date(SPARK, source, "__y")
        own = once(once(own, **{f"i{k}": iso}), **{f"c{k}": sure})
    tried = [f"struct('{label}' as pattern, r{k} <> '' as matched, r{k} as raw, i{k} as iso, c{k} as confidence)" for k, (label, _) in enumerate(plain.DATES_IN_TEXT)]
    own = once(own, hit=f"case {' '.join(f"when i{k} <> '' then {k}" for k in range(4))} else 4 end", all_tried=f"array({', '.join(tried)})")
    pick = lambda c: F.expr(f"case hit {' '.join(f'when {k} then {c}{k}' for k in range(4))} else {c}4 end")
    raw = F.expr("case hit when 0 then r0 when 1 then r1 when 2 then r2 when 3 then r3 else if(i4 <> '', s, '') end")
    date = F.struct(pick("i").alias("iso"), pick("c").alias("confidence"), raw.alias("raw"), F.expr("slice(all_tried, 1, least(hit + 1, 4))").alias("tried")).alias("date")
    return own.select(*rows.columns, date)


def forwarding(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text, stops) of the pages (doc_id, page, text, doc_year) that tell where a letter was sent from and where someone arrived, if both may be places."""
    sent, came = [p.pattern for p in plain.SENDERS], _java(plain.DESTINATION.pattern)
    first, second = (_java(sent[0], "imdU"), _java(sent[1], "imdU"))
    own = pages.select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"), F.col("doc_year").cast("int").alias("doc_year"))
    own = own.where(F.expr(f"text rlike {second} and text rlike {came}"))  # the second pattern takes all that the first takes
    own = once(own, sent0=f"if(text rlike {first}, regexp_extract(text, {first}, 0), regexp_extract(text, {second}, 0))", sent1=f"if(text rlike {first}, regexp_extract(text, {first}, 1), regexp_extract(text, {second}, 1))", **{f"came{k}": f"regexp_extract(text, {came}, {k})" for k in range(3)})
    own = once(own, origin=S.place(SPARK, "sent1"), goal=S.place(SPARK, "came1"))
    own = own.where(F.expr(f"{S.plausible_place(SPARK, 'origin')} and {S.plausible_place(SPARK, 'goal')}"))
    own = found_dates(written(own), "came2", "doc_year")
    own = once(own, began=S.first_words(SPARK, "sent0"), ended=S.first_words(SPARK, "came0"), said=S.spaced(SPARK, "came2"))
    stop = lambda n, place, iso, sure, time, told: f"struct({n} as `order`, {place} as place, {iso} as arrival_date, {sure} as date_confidence, {time} as time_info, {told} as evidence)"
    stops = F.expr(f"array({stop(1, 'origin', "''", "''", "''", 'began')}, {stop(2, 'goal', 'date.iso', 'date.confidence', "if(date.iso <> '', date.raw, said)", 'ended')})")
    return own.select("doc_id", "page", "text", stops.alias("stops"))


def _listed(folded: DataFrame) -> DataFrame:
    """What fold_places gives, in the order of a list: the route, then the others by date and place."""
    nth = F.expr(f"cast(row_number() over (partition by {', '.join(f'`{k}`' for k in ('doc_id', 'page', '__person'))} order by pos = 0, pos, arrival, lower(place), ord) - 1 as bigint)")
    return folded.withColumn("ord", nth)


def _folded(rows: DataFrame) -> DataFrame:
    """Rows (KEYS, ord, FIELDS) with normal places, folded within each person and page."""
    made = normal(rows, "place", "__place", S.place(SPARK, "x")).where("__place <> ''")
    src = made.select("doc_id", "page", F.col("name").alias("__person"), "name", "ord", F.col("__place").alias("place"), F.col("order").alias("pos"), F.col("arrival_date").alias("arrival"), F.col("date_confidence").alias("confidence"), F.col("time_info").alias("time"), "evidence")
    return _listed(fold_places(src.repartition("doc_id", "page", "__person"), "doc_id", "page", "__person"))


def _rows(folded: DataFrame) -> DataFrame:
    names = {"pos": "order", "arrival": "arrival_date", "confidence": "date_confidence", "time": "time_info"}
    return folded.select("doc_id", "page", F.col("__person").alias("name"), "ord", "place", *(F.col(a).alias(b) for a, b in names.items()), "evidence")


def folded(rows: DataFrame) -> DataFrame:
    """rows (KEYS, ord, FIELDS), one a place of each person and page."""
    return _rows(_folded(rows)).select(*KEYS, "ord", *FIELDS)


def enriched(rows: DataFrame, more: DataFrame) -> DataFrame:
    """JN10: of each place of a person and page the last row, with the first date of its rows in more where it has none, and with their longest words of time if these are longer; folded."""
    key = lambda t: normal(t, "place", "__place", S.place(SPARK, "x")).withColumn("__key", F.lower("__place"))
    last = key(rows).groupBy(*KEYS, "__key").agg(F.min("ord").alias("ord"), F.max_by(F.struct(*FIELDS), "ord").alias("r")).select(*KEYS, "__key", "ord", "r.*")
    dated = F.when(F.col("arrival_date") != "", F.struct("ord", "arrival_date", "date_confidence"))
    told = key(more).groupBy(*KEYS, "__key").agg(F.min(dated).alias("d"), F.max(F.struct(F.length("time_info").alias("n"), (-F.col("ord")).alias("o"), F.col("time_info").alias("t"))).alias("t"))
    none = (F.col("arrival_date") == "") & F.col("d").isNotNull()
    both = last.join(told, [*KEYS, "__key"], "left").withColumns({
        "date_confidence": F.when(none, F.col("d.date_confidence")).otherwise(F.col("date_confidence")),
        "time_info": F.when(F.coalesce(F.col("t.n"), F.lit(0)) > F.length("time_info"), F.col("t.t")).otherwise(F.col("time_info")),
        "arrival_date": F.when(none, F.col("d.arrival_date")).otherwise(F.col("arrival_date")),
    })
    return folded(both.select(*KEYS, "ord", *FIELDS))


def _placed(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Folded rows with spot: where the page tells of the row, else names its place; FAR where it does neither, and where that is its very first sign."""
    texts = once(pages.select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text")).withColumn("low", F.lower("text")).withColumn("key", C.match_key("text")), **{"empty": "text = ''"})
    own = rows.join(texts, ["doc_id", "page"], "left").fillna("", ["text", "low", "key"])
    own = once(own, told=S.spaced(SPARK, "concat(evidence, ' ', time)"), normal=S.name(SPARK, "place"))
    own = own.withColumn("told_key", C.match_key("told")).withColumn("place_key", C.match_key("place"))
    at = lambda part, key: f"case when {part} = '' or text = '' then {FAR} when instr(low, lower({part})) > 0 then instr(low, lower({part})) - 1 when instr(key, {key}) > 0 then instr(key, {key}) - 1 else {FAR} end"
    words = r"array_join(transform(filter(split(normal, ' '), w -> w <> ''), w -> regexp_replace(w, r'([^\p{L}\p{N}_])', r'\\$1')), r'" + plain.BETWEEN.replace("'", "\\x27") + "')"
    own = once(own, by_told=at("told", "told_key"), pattern=f"if(normal = '', '', concat(r'(?iU)\\b', {words}, r'\\b'))", by_place=at("place", "place_key"))
    own = once(own, named="if(pattern <> '', regexp_instr(text, pattern), 0)")
    found = f"case when by_told <> {FAR} then by_told when named > 0 then named - 1 else by_place end"
    own = once(own, spot=f"coalesce(nullif({found}, 0), {FAR})", unsure=S.uncertain_move(SPARK, "told"), sure=S.confident_move(SPARK, "told"), fit=S.valid_place(SPARK, "place"))
    return own.select(*rows.columns, "spot", F.expr("not unsure and (arrival <> '' or fit and sure)").alias("reached"))


def reconciled(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """R9, SRT4: rows (KEYS, ord, FIELDS) in the order of a route; pages: doc_id, page, text, doc_year, once each. Given orders stay. Else the stops that the page tells of join the rows,
    if it names the person, and what was surely reached is the route, as the page names it; the others follow with order 0. Persons without a row stay without."""
    by = W.partitionBy("doc_id", "page", "__person")
    first = _folded(rows).withColumn("given", F.max(F.col("pos") > 0).over(by))
    first = written(first)
    persons = first.where("not given").select("doc_id", "page", "__person").distinct()
    persons = normal(persons, "__person", "__norm", S.name(SPARK, "x"))
    stops = persons.join(forwarding(pages), ["doc_id", "page"]).where(F.lower("text").contains(F.lower("__norm")))
    stops = stops.select("doc_id", "page", F.col("__person").alias("name"), F.posexplode("stops").alias("nth", "s")).select(*KEYS, (F.col("nth") + F.lit(AFTER)).cast("long").alias("ord"), *(f"s.{c}" for c in FIELDS))
    # The first fold is at rest under the second: it changes only where stops have come.
    second = _folded(_rows(first).select(*KEYS, "ord", *FIELDS).unionByName(stops)).join(first.select("doc_id", "page", "__person", "given").distinct(), ["doc_id", "page", "__person"])
    placed = _placed(second, pages).withColumn("low", F.lower("place"))
    placed = placed.withColumn("on_route", F.expr("pos > 0 or not given and reached"))
    nth = F.row_number().over(by.orderBy(F.desc("on_route"), F.expr("if(given and on_route, pos, 0)"), "spot", "low", "ord"))
    out = placed.withColumn("nth", nth).withColumn("pos", F.expr("case when not on_route then 0 when given then pos else nth end"))
    return _rows(out.withColumn("ord", (F.col("nth") - 1).cast("long"))).select(*KEYS, "ord", *FIELDS)
