"""Whether a candidate is the subject of its page, as SQL: roles are told by patterns around the name, in its evidence and wherever the page names it.

Each place of the name in a text is replaced by a mark in turn, so that all patterns are the same for every row; only the pattern that has decided is read again with the name itself,
for the excerpt. Candidates have to have a name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import columns as C
from foliant.functions import plain
from foliant.functions import scalar as S
from foliant.operators.routes import once
from foliant.plans.dialect import SPARK, quoted

MARK = S.MARK


def _pattern(template: str, name: str) -> str:
    for spelt in (r"\b{name}\b", r"{name}\b", r"\b{name}", "{name}"):
        template = template.replace(spelt, name)
    return template


def _first(rows) -> str:
    """The number of the first pattern that a text t has around one of its places of the name; -1 without any."""
    case = "case " + " ".join(f"when m rlike {SPARK.pattern('(?isU)' + _pattern(t, MARK))} then {k}" for k, (_, t, _) in enumerate(rows)) + " end"
    return f"coalesce(array_min(transform(t.ms, m -> {case})), -1)"


def _told(rows, k: str) -> str:
    """The reason of pattern k."""
    arms = " ".join(f"when {n} then replace({quoted(r)}, '{{name}}', n)" for n, (_, _, r) in enumerate(rows))
    return f"case {k} {arms} end"


def _whole(rows, k: str) -> str:
    """Pattern k with the name itself; the name's own pattern has no sign that regexp_replace would read."""
    arms = " ".join(f"when {n} then replace({SPARK.pattern('(?isU)' + _pattern(t, MARK))}, '{MARK}', named)" for n, (_, t, _) in enumerate(rows))
    return f"case {k} {arms} end"


def decisions(rows: DataFrame) -> DataFrame:
    """Rows (name, evidence, page_text and others) with keep, reason_type, reason and excerpt, as plain.decision tells them."""
    out = once(rows, n=S.name(SPARK, "name"), own=S.first_words(SPARK, "evidence"))
    out = out.withColumn("named", C.name_regex("n")).withColumn("around", C.contexts(F.coalesce("page_text", F.lit("")), "named"))
    out = once(out, texts="filter(concat(array(own), around), x -> x <> '')", first="lower(split(n, ' ')[0])")
    one = lambda x, o: F.concat(F.substring(x, F.lit(1), o["s"]), F.lit(MARK), F.substring(x, o["e"] + 1, F.length(x)))
    out = out.withColumn("marks", F.transform("texts", lambda x: F.struct(x.alias("x"), F.transform(C.offsets(x, "named"), lambda o: one(x, o)).alias("ms"), F.lower(x).alias("low"))))
    free = rf"low rlike {SPARK.pattern(r'\bfree\s*born\b')} and low rlike {SPARK.pattern(r'\bnot\s+a?\s*slave\b')}"
    word = r"concat(r'(?U)\b', regexp_replace(first, r'([^\p{L}\p{N}_])', r'\\$1'), r'\b')"
    title = f"first <> '' and low rlike {SPARK.pattern(plain.TITLES.pattern)} and low rlike {word}"
    seen = "transform(marks, t -> {body})"
    inside = lambda sql: sql.replace("low rlike", "t.low rlike")
    out = once(out, good=f"get(filter({seen.format(body=f'struct(t.x, {_first(plain.IN_FAVOUR)} as k)')}, t -> t.k >= 0), 0)", bad_k=seen.format(body=f"struct(t.x, t.low, {_first(plain.AGAINST)} as k)"))
    out = once(out, freed=f"get(filter(bad_k, t -> {inside(free)}), 0)", bad=f"get(filter(transform(bad_k, t -> struct(t.x, case when t.k >= 0 then t.k when {inside(free)} then 100 when {inside(title)} then 101 else -1 end as k)), t -> t.k >= 0), 0)")
    out = once(out, joined="lower(array_join(texts, ' '))")
    out = once(out, phrase=S.first_phrase("joined"), fit=S.candidate_name(SPARK, "n"))
    kind = "case when freed is not null then 'freeborn_not_slave' when good is not null then 'positive_rule' when bad.k = 100 then 'freeborn_not_slave' when bad is not null then 'negative_rule' when phrase <> '' then 'strong_local_signal' when not fit then 'invalid_name' else 'ambiguous_subject_role' end"
    born = "'matched \"free born\" plus \"not a slave\"'"
    reason = f"case when freed is not null then {born} when good is not null then {_told(plain.IN_FAVOUR, 'good.k')} when bad.k = 101 then 'appears in an official-title context' when bad is not null then {_told(plain.AGAINST, 'bad.k')} when phrase <> '' then concat('found strong local phrase \"', phrase, '\"') when not fit then 'Name did not pass basic validation.' else 'No positive subject signal survived the final rule filter.' end"
    hit = f"case when freed is not null then freed.x when good is not null then regexp_extract(good.x, {_whole(plain.IN_FAVOUR, 'good.k')}, 0) when bad.k >= 100 then bad.x when bad is not null then regexp_extract(bad.x, {_whole(plain.AGAINST, 'bad.k')}, 0) when phrase <> '' then joined when not fit or own <> '' then own else coalesce(page_text, '') end"
    out = once(once(out, reason_type=kind, hit=hit), keep="freed is null and (good is not null or (bad is null and phrase <> ''))", reason=reason, excerpt=S.first_words(SPARK, "hit"))
    return out.select(*rows.columns, "keep", "reason_type", "reason", "excerpt")
