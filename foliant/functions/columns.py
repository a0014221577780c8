"""Functions of columns: SQL expressions of Spark where they can say it, Arrow-batched Python where not (replies in JSON, similar names, offsets of all matches).

register() gives them names in SQL. Nulls count as empty texts unless said otherwise."""

from __future__ import annotations

import functools

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from foliant.functions import plain
from foliant.functions import scalar as S
from foliant.plans.dialect import ACCENTED, BARE, SPARK

PERSON = "struct<name:string,evidence:string>"
PLACE = "struct<name:string,place:string,order:int,arrival_date:string,date_confidence:string,time_info:string,evidence:string>"
DECISION = "struct<keep:boolean,reason_type:string,reason:string,excerpt:string>"
CHECK = "struct<status:string,message:string,input_value:string,final_value:string,evidence:string>"
DETAIL = f"struct<name:string,page:int,row:map<string,string>,validation:map<string,{CHECK}>,raw:map<string,string>,evidence:map<string,string>>"
PAGE = "struct<should_extract:boolean,skip_reason:string,report_type:string,evidence:string>"
DATE = "struct<iso:string,confidence:string,raw:string,tried:array<struct<pattern:string,matched:boolean,raw:string,iso:string,confidence:string>>>"


class arrow:
    """A function of Python values as one of columns, which gets its values an Arrow batch at a time; made when it is first used, since that takes a session."""

    def __init__(self, f, kind: str):
        self.f, self.kind = f, kind

    @functools.cached_property
    def udf(self):
        return F.udf(self.f, self.kind, useArrow=True)

    def __call__(self, *columns) -> Column:
        return self.udf(*columns)


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- in SQL ---


def _let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def spaced(c) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(_column(c), F.lit("")), S.SPACE + "+", " "))


def page_text(c) -> Column:
    """TX3: line ends as one sign, blanks and tabs as one blank, marks of byte order gone; empty lines inside stay."""
    lines = F.regexp_replace(F.regexp_replace(F.coalesce(_column(c), F.lit("")), "\\x{feff}", ""), r"\r\n|\r", "\n")
    edge = S.SPACE[:-1].replace(r"\x09-\x0d", r"\x09\x0b-\x0d") + "]"  # all white space but the end of a line
    lines = F.regexp_replace(F.regexp_replace(lines, r"[\t ]+", " "), f"(?m)^{edge}+|{edge}+$", "")
    return F.regexp_replace(lines, f"^{S.SPACE}+|{S.SPACE}+\\z", "")


def transcript(c) -> Column:
    """TX8: without fences and preambles, at most one empty line in a row."""
    text = F.coalesce(_column(c), F.lit(""))
    lines = F.filter(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"), lambda x: ~x.rlike(r"^\s*```[a-zA-Z0-9_-]*\s*$") & ~x.rlike(r"(?i)^\s*(?:here is|the text in the image|transcription)\b"))
    lines = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, f"{S.SPACE}+\\z", "")), "\n")
    return F.regexp_replace(F.regexp_replace(lines, f"^{S.SPACE}+|{S.SPACE}+\\z", ""), r"\n{3,}", "\n\n")


def is_blank_page(c) -> Column:
    t = transcript(c)
    return (t != S.EMPTY_PAGE) & (F.length(t) < 5)


def is_read(c) -> Column:
    """FLT9: a page's text that needs no reading again."""
    head = F.substring(_column(c), 1, 2000)
    return F.coalesce((F.length(_column(c)) > 0) & ((F.trim(head) == S.EMPTY_PAGE) | ~is_blank_page(head)), F.lit(False))


def whole(c) -> Column:
    """TX10: a whole number as text, else 0; fractions aren't cut."""
    c = F.trim(_column(c).cast("string"))
    return F.coalesce(F.when(c.rlike(r"^[+-]?[0-9]+(?:_[0-9]+)*$"), F.regexp_replace(c, "_", "").try_cast("int")), F.lit(0))


def bare(c) -> Column:
    """TX2 for letters below U+0250; others lose combining marks that stand apart."""
    c = F.coalesce(_column(c), F.lit(""))
    return F.translate(F.regexp_replace(c, r"[\x{300}-\x{36f}]", ""), ACCENTED, BARE)


def match_key(c) -> Column:
    """TX6: without accents, in lower case, words of ASCII letters and digits apart by one space."""
    return F.trim(F.regexp_replace(F.lower(bare(spaced(c))), "[^a-z0-9]+", " "))


def slug(c) -> Column:
    """TX11"""
    s = F.regexp_replace(F.regexp_replace(F.lower(bare(spaced(c))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("person"))


def elapsed(start, end) -> Column:
    """DT6: seconds between two time stamps, at least 0, at two places; 0 where one can't be read."""
    seconds = F.try_to_timestamp(_column(end)).cast("double") - F.try_to_timestamp(_column(start)).cast("double")
    return F.coalesce(F.bround(F.greatest(seconds, F.lit(0.0)), 2), F.lit(0.0))


def reply_text(c) -> Column:
    """TX13: the text of a model server's reply; an error in it raises."""
    c = _column(c)
    at = lambda p: F.get_json_object(c, p)
    text = F.coalesce(at("$.response"), at("$.message.content"), at("$.output"), at("$.text"), at("$.content"), F.lit(""))
    return F.when(F.trim(F.coalesce(at("$.error"), F.lit(""))) != "", F.raise_error(F.trim(at("$.error"))).cast("string")).otherwise(text)


def filled(template, **values) -> Column:
    """TX5: each {key} replaced in turn."""
    out = _column(template)
    for key, value in values.items():
        out = F.replace(out, F.lit("{%s}" % key), _column(value).cast("string"))
    return out


def allowed(c, words) -> Column:
    """CV1: the allowed spelling, else empty."""
    known = F.create_map(*(F.lit(x) for w in words for x in (w.lower(), w)))
    return F.coalesce(F.element_at(known, F.lower(spaced(c))), F.lit(""))


def yes_no(c) -> Column:
    """CV2: yes or no in lower case, else empty."""
    low = F.lower(spaced(c))
    return F.when(low.isin(*plain.ABUSE), low).otherwise("")


def checked(field: str, value, evidence) -> Column:
    """CV4-CV6: the check of one field as (status, message, input_value, final_value, evidence)."""
    label, raw, told = plain.FIELDS[field], spaced(value), F.array_join(F.slice(F.split(spaced(evidence), " "), 1, 25), " ")
    if field == "amount_paid":
        raw = F.when(F.lower(raw).isin("null", "none"), "").otherwise(raw)
        good, kept = raw, "Amount paid kept as literal page text."
    elif field == "whether_abuse":
        good, kept = yes_no(value), "Whether abuse is one of yes/no and has evidence."
    else:
        good, kept = allowed(value, plain.WORDS[field]), f"{label} is in the allowed set."
    is_ok = (good != "") & (told != "")
    status = F.when(is_ok, "ok").when(good != "", "cleared_missing_evidence").when(raw != "", "cleared_invalid").otherwise("empty")
    invalid = F.concat(F.lit(f'Cleared invalid {label} value "'), raw, F.lit('".'))
    message = F.when(is_ok, kept).when(good != "", f"Cleared {label} because no supporting evidence was provided.").when(raw != "", invalid).otherwise(f"{label} empty.")
    return F.struct(status.alias("status"), message.alias("message"), raw.alias("input_value"), F.when(is_ok, good).otherwise("").alias("final_value"), F.when(is_ok, told).otherwise("").alias("evidence"))


# --- places in texts ---


def name_regex(c) -> Column:
    """A pattern of the words of a normalised name, apart by white space and signs; empty for an empty name."""
    words = F.transform(F.filter(F.split(_column(c), " "), lambda w: w != ""), lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}_])", r"\\$1"))
    return F.when(_column(c) == "", "").otherwise(F.concat(F.lit(r"(?iU)\b"), F.array_join(words, plain.BETWEEN), F.lit(r"\b")))


def offsets(text, pattern) -> Column:
    """All places (s, e) where a pattern that isn't empty matches: what lies between matches and the matches tell where each begins."""
    def of(parts: Column, hits: Column) -> Column:
        start = lambda k: F.length(F.array_join(F.slice(parts, 1, k + 1), "")) + F.length(F.array_join(F.slice(hits, 1, k), ""))
        begins = F.transform(hits, lambda h, k: F.struct(start(k).alias("s"), F.length(h).alias("n")))
        return F.transform(begins, lambda x: F.struct(x["s"].alias("s"), (x["s"] + x["n"]).alias("e")))

    text, pattern = _column(text), _column(pattern)
    none = F.array().cast("array<struct<s:int,e:int>>")
    found = _let(F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits")), lambda x: of(x["parts"], x["hits"]))
    return F.when((pattern == "") | text.isNull(), none).otherwise(found)


def contexts(text, pattern, window: int = plain.PROMPT_WINDOW) -> Column:
    """F8: each match with so many signs before and after it, with single spaces."""
    text = _column(text)
    first = lambda o: F.greatest(o["s"] - window, F.lit(0))
    return F.transform(offsets(text, pattern), lambda o: spaced(F.substring(text, first(o) + 1, o["e"] + window - first(o))))


def chosen(spans) -> Column:
    """of spans (s, e, label, priority), those that don't overlap: the least priority first, then by begin, longer ones first, of equal ones the first; in the order of the text."""
    keyed = F.transform(_column(spans), lambda x, k: F.struct(x["priority"], x["s"], (x["s"] - x["e"]).alias("less"), k.alias("k"), x["e"], x["label"]))
    free = lambda acc, x: ~F.exists(acc, lambda y: (x["e"] > y["s"]) & (y["e"] > x["s"]))
    none = F.array().cast("array<struct<s:int,e:int,label:string,priority:int>>")
    plainly = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["label"].alias("label"), x["priority"].alias("priority"))
    return F.array_sort(F.aggregate(F.array_sort(keyed), none, lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(plainly(x)))).otherwise(acc)))


def escaped(c) -> Column:
    out = _column(c)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def marked(text, spans) -> Column:
    """a text as HTML with its chosen spans in mark elements."""
    text, spans = F.coalesce(_column(text), F.lit("")), _column(spans)
    before = lambda k: F.when(k == 0, 0).otherwise(F.get(spans, k - 1)["e"])
    piece = lambda x, k: F.concat(escaped(F.substring(text, before(k) + 1, x["s"] - before(k))), F.lit('<mark title="'), escaped(x["label"]), F.lit('">'), escaped(F.substring(text, x["s"] + 1, x["e"] - x["s"])), F.lit("</mark>"))
    rest = escaped(F.substring(text, F.coalesce(F.get(spans, F.size(spans) - 1)["e"], F.lit(0)) + 1, F.length(text)))
    return F.concat(F.array_join(F.transform(spans, piece), ""), rest)


# --- replies in JSON ---

#: Strings as a whole, brackets, and what lies between them; a quotation mark that nothing closes is a token, too.
_TOKENS = r'(?s)"(?:[^"\\]++|\\.)*+"|[{}\[\]]|[^{}\[\]"]++|"'
#: An item that closes the list that a text is put into, so that nothing behind its first value is passed over.
_CLOSE = "\u0001 end of the text"
#: Signs that a value of JSON begins with, and the white space of S.SPACE as signs.
_BEGINS = '{["-0123456789tfn'
_BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def balanced(c) -> Column:
    """From the first bracket to the one that closes it; null if brackets cross or stay open. A fold over tokens: the brackets that are due, and the length so far."""
    rest = lambda x: F.substring(x, F.regexp_instr(x, F.lit(r"[{\[]")), F.length(x))

    def step(a: Column, t: Column) -> Column:
        closes = t.isin("}", "]")
        due = F.when(t == "{", F.concat(F.lit("}"), a["due"])).when(t == "[", F.concat(F.lit("]"), a["due"])).when(closes, F.substring(a["due"], 2, 1 << 30)).otherwise(a["due"])
        state = F.when((t == '"') | closes & (F.left(a["due"], F.lit(1)) != t), 2).when(closes & (F.length(a["due"]) == 1), 1).otherwise(0)
        return F.when(a["state"] != 0, a).otherwise(F.struct(due.alias("due"), (a["n"] + F.length(t)).alias("n"), state.alias("state")))

    begin = F.struct(F.lit("").alias("due"), F.lit(0).alias("n"), F.lit(0).alias("state"))
    cut = lambda text, end: F.when(end["state"] == 1, F.substring(text, F.lit(1), end["n"]))
    of = lambda text: _let(F.aggregate(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), begin, step), lambda end: cut(text, end))
    c = _column(c)
    return F.when(F.regexp_instr(c, F.lit(r"[{\[]")) > 0, _let(rest(c), of))


def json_value(c) -> Column:
    """The value (VARIANT) of a text that is JSON as a whole; null if it isn't, and for null. An object that has a key twice isn't JSON here, nor are NaN and Infinity."""
    put = lambda x: F.concat(F.lit("["), x, F.lit(f',"{_CLOSE}"]'.replace("\u0001", "\\u0001")))

    def read(v: Column) -> Column:
        at = lambda k, kind="variant": F.try_variant_get(v, f"$[{k}]", kind)
        alone = (at(1, "string") == _CLOSE) & at(2).isNull()
        return F.when(alone, _let(at(0), lambda x: F.when(~F.is_variant_null(x), x)))

    # Most replies begin with words: these are told without parsing.
    return _let(_column(c), lambda x: F.when(F.instr(F.lit(_BEGINS), F.substring(x, 1, 1)) > 0, _let(F.try_parse_json(put(x)), read)))


def reply_value(c) -> Column:
    """TX4: the value of a reply: the whole text, else what stands in its first fence, else its first balanced object or list; null if there is none."""
    text = F.coalesce(_column(c), F.lit(""))
    fence = _let(F.split(text, "```", 3), lambda p: F.when(F.size(p) == 3, F.when(F.lower(F.substring(p[1], 1, 4)) == "json", F.substring(p[1], 5, 1 << 30)).otherwise(p[1])))
    strip = lambda x: F.btrim(x, F.lit(_BLANKS))
    return F.coalesce(json_value(strip(text)), json_value(strip(fence)), json_value(balanced(fence)), json_value(balanced(text)))


def found_json(c) -> Column:
    """reply_value as text."""
    return F.to_json(reply_value(c))


def reply_items(value, key: str) -> Column:
    """The objects of a reply's list."""
    return F.filter(F.try_variant_get(value, f"$.{key}", "array<variant>"), lambda i: F.schema_of_variant(i).startswith("OBJECT"))


def item_text(item, key: str) -> Column:
    return F.coalesce(F.try_variant_get(item, f"$.{key}", "string"), F.lit(""))


# --- in Python, an Arrow batch at a time ---

_loads = lambda x: plain.found_json(x)
page_decision = arrow(lambda x: plain.page_decision(_loads(x)), PAGE)
detail_row = arrow(lambda x, person, page, kind, evidence: plain.detail_row(_loads(x), person or "", page, kind or "", evidence or ""), DETAIL)
merged_people = arrow(lambda people: plain.merged([p.asDict() if hasattr(p, "asDict") else p for p in people or []]), f"array<{PERSON}>")
decision = arrow(plain.decision, DECISION)
first_date = arrow(lambda x, year: plain.date_trace(x, year), DATE)
same_person = arrow(lambda a, b: plain.same_person(a or "", b or ""), "boolean")
accents_off = arrow(plain.bare, "string")
normal_name = arrow(plain.name, "string")
normal_place = arrow(plain.place, "string")


def register(spark: SparkSession) -> list[str]:
    """Names of the functions, now known to SQL: Python's by their Arrow form, SQL's as functions of SQL."""
    python = {"page_decision": page_decision, "name_decision": decision, "first_date": first_date, "same_person": same_person}
    for key, f in python.items():
        spark.udf.register(key, f.udf)
    own = {
        "normal_name": ("x string", "string", S.name(SPARK, "x")),
        "normal_place": ("x string", "string", S.place(SPARK, "x")),
        "valid_name": ("x string", "boolean", S.valid_name(SPARK, "x")),
        "valid_place": ("x string", "boolean", S.valid_place(SPARK, "x")),
        "one_space": ("x string", "string", S.spaced(SPARK, "x")),
        "first_words": ("x string", "string", S.first_words(SPARK, "x")),
        "doc_year": ("x string", "int", S.year(SPARK, "x")),
        "iso_date": ("x string, y int", "string", S.iso_date(SPARK, S.spaced(SPARK, "x"), "y")[0]),
        "date_confidence": ("x string, y int", "string", S.iso_date(SPARK, S.spaced(SPARK, "x"), "y")[1]),
        "report_type": ("x string", "string", S.report_type(SPARK, "x")),
        "doc_id_of": ("x string", "string", S.doc_id(SPARK, "x")),
    }
    for key, (takes, gives, body) in own.items():
        spark.sql(f"create or replace temporary function {key}({takes}) returns {gives} return {body}")
    return sorted([*python, *own])
