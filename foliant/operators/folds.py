"""The place fold: an operator that follows the order of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ROW = "ord bigint, name string, place string, pos int, arrival string, confidence string, time string, evidence string"
_RANK = "case {r}.confidence when 'unknown' then 1 when 'derived_from_doc' then 2 when 'explicit' then 3 else 0 end"


def _score(r: str) -> str:
    return f"struct(cast({r}.pos > 0 as int), cast({r}.arrival <> '' as int), {_RANK.format(r=r)}, cast({r}.time <> '' as int), length({r}.evidence))"


def _filled(a: str, b: str) -> str:
    """Row a with b's date (and its confidence), time and evidence where a has none."""
    pick = lambda c: f"if({a}.{c} = '', {b}.{c}, {a}.{c})"
    return f"named_struct('ord', acc.first_ord, 'name', {a}.name, 'place', {a}.place, 'pos', {a}.pos, 'arrival', {pick('arrival')}, 'confidence', if({a}.arrival = '' and {b}.arrival <> '', {b}.confidence, {a}.confidence), 'time', {pick('time')}, 'evidence', {pick('evidence')})"


def fold_places(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each (keys, lower name, lower place), with places as they are (normalise them first): in the order of ord, a row takes the place of the one
    so far only if its score is greater, and what the kept row lacks comes from the other. Then positive orders are numbered from 1 within the keys by (order, date, lower place),
    zeroes stay, negative ones go. Null strings count as empty. A fold's group is the repeats of one place of one person of a page."""
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("name", "place", "arrival", "confidence", "time", "evidence")]
    src = rows.select(*keys, F.col("ord").cast("bigint").alias("ord"), F.coalesce(F.col("pos").cast("int"), F.lit(0)).alias("pos"), *text).where("place <> ''")
    grouped = src.groupBy(*keys, F.lower("name").alias("__n"), F.lower("place").alias("__p")).agg(F.sort_array(F.collect_list(F.expr("struct(ord, name, place, pos, arrival, confidence, time, evidence)"))).alias("l"))
    step = f"named_struct('first_ord', acc.first_ord, 'row', if({_score('x')} > {_score('acc.row')}, {_filled('x', 'acc.row')}, {_filled('acc.row', 'x')}))"
    only = f"cast(l[0] as struct<{_ROW.replace(' bigint', ':bigint').replace(' string', ':string').replace(' int', ':int')}>)"
    folded = f"if(size(l) = 1, {only}, aggregate(slice(l, 2, greatest(size(l) - 1, 0)), named_struct('first_ord', l[0].ord, 'row', {only}), (acc, x) -> {step}).row)"
    out = grouped.select(*keys, F.expr(folded).alias("r")).select(*keys, "r.*").where("pos >= 0")
    by = ", ".join([*keys, "pos > 0"])
    return out.withColumn("pos", F.expr(f"if(pos > 0, cast(row_number() over (partition by {by} order by pos, arrival, lower(place), ord) as int), 0)"))
