"""Personal data by weak supervision, in DataFrame and SQL functions throughout.

Base kinds (email, ip, card, phone) are found by pattern and check. Beside them stand candidates of two sorts: tokens with a digit or an at sign (id), and runs of
capitalised words (name). Four labelers (regex, gazetteer, context, shape) vote for, against or not at all on each candidate; for each sort,
expectation-maximisation over the counts of vote patterns estimates how reliable the labelers are, and the posteriors train a logistic classifier of span features,
which decides. Candidates that it takes and that touch no base span become spans of their sort.

Each text is scanned once: base spans and candidates are written, the classifier is trained on the written candidates, and what it takes is read from there.
What reaches the driver is counts: vote patterns times feature values, of which there are at most 3**4 * 540 a sort whatever the input.

Nulls in text: empty, without spans. Ids may repeat or be null: rows are judged one by one, ties and repeated rows alike. Other columns stay, whatever their names; only a column
with the name of a new one is replaced. Empty tables give no rows. Without any candidate of a sort the classifier takes none of it. Texts with many spans
are folded in parts of PART spans, so that no list is copied once a span.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, table, text_of

# The base patterns. Possessive runs and the look-behinds find the same matches without trying the inside of a long run.
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text has to hold for a match that can pass its check: a sign first, which is sought fast, then a pattern.
HINT = {"email": ("@", None), "ip": (".", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), "card": (None, r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": ("+", r"\+[0-9]")}
# A token ends with the last sign of its run that is no full stop, colon or hyphen; a name is of two capitalised words or more, without a form of address.
TOKEN = r"(?<![0-9A-Za-z_.%+@#:/-])[A-Za-z_.%+#:/-]*+[0-9@][0-9A-Za-z_.%+@#:/-]*(?<![.:-])"
NAME = r"(?<![0-9A-Za-z])(?!(?:Dear|Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Contact|Hello|Hi|Signed|From|To|By|The)\x20)[A-Z][a-z]++(?:\x20[A-Z][a-z]++)++(?![0-9A-Za-z])"
SORTS = {"id": (TOKEN, "[0-9@]", "length(x.v) > 2 and "), "name": (NAME, r"[a-z]\x20[A-Z][a-z]", "")}
KINDS = (*BASE, *SORTS)
BEFORE, PART = 24, 512
SPANS = "array<struct<s:int,e:int,v:string,b:string>>"

# Fixed values of the labelers of tokens: formats, endings and prefixes, and words before a candidate that speak for or against it.
FORMATS = r"(?i)^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|[a-z]{2}[0-9]{2}[a-z0-9]{11,30}|[0-9]{2}[/.-][0-9]{2}[/.-](?:19|20)[0-9]{2}|[^@]+@[^@]+|00[0-9]{8,14}|[0-9a-f]{16,}|akia[0-9a-z]{16})$"
OPAQUE = r"(?i)^v?[0-9]+(?:\.[0-9]+){0,2}$|^https?:|^[a-z-]+[0-9]{1,3}$|^[0-9]{1,4}(?:st|nd|rd|th|s)$"
ENDINGS = r"(?i)@(?:gmail|yahoo|hotmail|outlook|icloud|proton|example|mail[0-9]?)\.|\.(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|it|eu|us|ch|at)$"
PREFIXES = r"^(?:AKIA|ASIA|AIza|ghp_|gho_|glpat-|github_pat_|xox[abp]-|sk_live_|sk-|ya29\.|eyJ|(?:AT|BE|CH|DE|ES|FR|GB|IT|NL|PT)[0-9]{2}[0-9A-Z]{11}|(?:\+|00)(?:1|33|34|39|41|43|44|49)[0-9]{6}|(?:4|5[1-5]|3[47]|6011)[0-9]{12})"
FOR = r"(?i)(?:e-?mail|mailto|phone|tel|mobile|cell|fax|call|contact|address|card|iban|ssn|passport|account|born|birth|whatsapp|password|passwd|pwd|secret|token|key|credential|login|user)[^a-z]{0,6}$"
AGAINST = r"(?i)(?:version|release|license|licence|section|chapter|page|copyright|sha|hash|commit|build|isbn|doi|http|figure|table|year|by|cc|v)[^a-z]{0,6}$"
# Fixed values of the labelers of names: given names, words that no person's name holds, and words before one.
GIVEN = "Adam Ahmed Alan Albert Alexander Alice Amanda Amy Ana Andrea Andrew Angela Anna Anne Anthony Antonio Barbara Benjamin Brian Carlos Carmen Carol Catherine Charles Christian Christine Christopher Claire Daniel David Deborah Diana Diego Donald Dorothy Edward Elena Elizabeth Emily Emma Eric Eva Fatima Francisco Frank Gary George Hans Helen Henry Ibrahim Ingrid Isabel Jack Jacob James Jane Javier Jean Jennifer Jessica Joan John Jonathan Jose Joseph Juan Julia Julie Karen Karl Katherine Kevin Klaus Laura Linda Lisa Louis Lucas Luis Maria Marie Mark Martin Mary Matthew Michael Michelle Miguel Mohammed Monika Nancy Nicholas Olivia Pablo Patricia Patrick Paul Peter Philip Pierre Rachel Ralph Raymond Rebecca Richard Robert Rosa Ruth Ryan Samuel Sandra Sara Sarah Sophia Sophie Stefan Stephen Steven Susan Teresa Thomas Timothy Ursula Victor Victoria Walter William Wolfgang Yusuf".split()
NO_NAME = r"\b(?:The|This|That|License|Licence|Public|General|Commons|Creative|Foundation|University|College|Institute|Inc|Ltd|Corporation|Company|Street|Avenue|Road|City|State|United|North|South|East|West|Version|Apache|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|January|February|March|April|May|June|July|August|September|October|November|December)\b"
HONORIFIC = r"(?i)\b(?:mr|mrs|ms|miss|dr|prof|professor|sir|madam|herr|frau|monsieur|madame|se\x{f1}or|se\x{f1}ora)\.?\x20$"
NAMED = r"(?i)\b(?:name|named|contact|dear|signed|sincerely|regards|patient|employee|customer|client|author|attn|attention|called|born|resident)[^a-z]{0,4}(?:is\x20)?$"
UNNAMED = r"(?i)\b(?:the|a|an|under|in|at|of|license|licence)\x20$"
VOTERS = ("regex", "gazetteer", "context", "shape")


def _lit(pattern: str) -> str:
    return "r'" + pattern.replace("'", "[\\x27]") + "'"


def _in_parts(items: str, zero: str, step: str, kind: str) -> str:
    """SQL of a fold over an array, PART items at a time: step makes (at, out) from own (at, out) and x; the outs of all parts in a row."""
    part = f"aggregate(part, named_struct('at', acc.at, 'out', cast(array() as {kind})), (own, x) -> {step})"
    over = f"aggregate(transform(sequence(0, (size(xs) - 1) div {PART}), c -> slice(xs, c * {PART} + 1, {PART})), named_struct('at', {zero}, 'out', cast(array() as array<{kind}>)), (acc, part) -> transform(array({part}), r -> named_struct('at', r.at, 'out', if(size(r.out) = 0, acc.out, concat(acc.out, array(r.out)))))[0], acc -> flatten(acc.out))"
    return f"transform(array({items}), xs -> if(size(xs) = 0, cast(array() as {kind}), {over}))[0]"


def _spans(text: str, pattern: str, test: str) -> str:
    """SQL of the matches that pass the test (of x.v): start, end (code points), value and what stands before."""
    zipped = "transform(array(regexp_extract_all({t}, {p}, 0)), vs -> zip_with(vs, slice(split({t}, {p}, -1), 1, size(vs)), (v, p) -> named_struct('v', v, 'p', p)))[0]".format(t=text, p=_lit(pattern))
    one = f"array(named_struct('s', own.at + length(x.p), 'e', own.at + length(x.p) + length(x.v), 'v', x.v, 'b', right(x.p, {BEFORE})))"
    return _in_parts(zipped, "0", f"named_struct('at', own.at + length(x.p) + length(x.v), 'out', if({test}, concat(own.out, {one}), own.out))", SPANS)


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    """Doubled digits stand at every second place from the right."""
    one = f"cast(substring({d}, length({d}) - i, 1) as int)"
    two = f"(2 * {one} - if({one} > 4, 9, 0))"
    return f"aggregate(transform(sequence(0, length({d}) - 1), i -> if(i % 2 = 1, {two}, {one})), 0, (a, b) -> a + b) % 10 = 0"


def _holds(kind: str, x: str) -> str:
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
        return rf"{x}.v rlike '^(?:{part}(?<=[0-9]))(?:[.]{part}(?<=[0-9]))&&$'".replace("&&", "{3}")
    if kind == "card":
        d = _digits(f"{x}.v")
        return f"if(length({x}.v) < 13, false, length({d}) between 13 and 19 and {_luhn(d)})"
    if kind == "phone":
        return f"length({_digits(f'{x}.v')}) between 9 and 15"
    return "true"


def _guarded(text: str, sign: str | None, hint: str | None, then: str) -> str:
    tests = ([f"contains({text}, '{sign}')"] if sign else []) + ([f"{text} rlike {_lit(hint)}"] if hint else [])
    return f"case when {' and '.join(tests)} then {then} else cast(array() as {SPANS}) end"


def scanned(df: DataFrame, text: str = "text") -> DataFrame:
    """(row: the columns of df, text, one array of spans for each base kind, and one of candidates that touch no base span for each sort)."""
    out = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), text_of(F.col(f"`{text}`")).alias("text"))
    for kind, pattern in BASE.items():
        out = out.withColumn(kind, F.expr(_guarded("text", *HINT[kind], _spans("text", pattern, _holds(kind, "x")))))
    touched = " or ".join(f"exists({kind}, y -> y.s < x.e and x.s < y.e)" for kind in BASE)
    for sort, (pattern, hint, test) in SORTS.items():
        out = out.withColumn(sort, F.expr(f"filter({_guarded('text', None, hint, _spans('text', pattern, f'{test}true'))}, x -> not ({touched}))"))
    return out


def votes(sort: str, x: str) -> dict[str, str]:
    """SQL of each labeler's vote: 1, 0, or -1 for none."""
    like = lambda p, of=f"{x}.v": f"{of} rlike {_lit(p)}"
    if sort == "name":
        words = f"size(split({x}.v, ' '))"
        return {
            "regex": f"case when {like(HONORIFIC, f'{x}.b')} then 1 when {like(NO_NAME)} then 0 else -1 end",
            "gazetteer": f"case when substring_index({x}.v, ' ', 1) in ({', '.join(repr(g) for g in GIVEN)}) then 1 when {like(NO_NAME)} then 0 else -1 end",
            "context": f"case when {like(NAMED, f'{x}.b')} then 1 when {like(UNNAMED, f'{x}.b')} then 0 else -1 end",
            "shape": f"case when {words} > 4 then 0 when length({x}.v) < 6 then 0 else -1 end",
        }
    d = f"length({_digits(f'{x}.v')})"
    return {
        "regex": f"case when {like(OPAQUE)} then 0 when {like(FORMATS)} then 1 else -1 end",
        "gazetteer": f"case when {like(ENDINGS)} or {like(PREFIXES)} then 1 else -1 end",
        "context": f"case when {like(FOR, f'{x}.b')} then 1 when {like(AGAINST, f'{x}.b')} then 0 else -1 end",
        "shape": f"case when {d} between 9 and 19 and length({x}.v) < 2 * {d} then 1 when length({x}.v) >= 16 and {d} > 2 and {like('^[0-9A-Za-z]*$')} then 1 when {d} < 5 and length({x}.v) < 10 and not contains({x}.v, '@') then 0 else -1 end",
    }


def features(sort: str, x: str) -> dict[str, tuple[str, int]]:
    """SQL of each feature's value and how many it has."""
    like = lambda p, of=f"{x}.v": f"{of} rlike {_lit(p)}"
    if sort == "name":
        return {
            "words": (f"least(3, size(split({x}.v, ' ')) - 2)", 4),
            "before": (f"case when {like(HONORIFIC, f'{x}.b')} then 3 when {like(NAMED, f'{x}.b')} then 2 when {like(UNNAMED, f'{x}.b')} then 0 else 1 end", 4),
            "given": (f"cast(substring_index({x}.v, ' ', 1) in ({', '.join(repr(g) for g in GIVEN)}) as int)", 2),
            "other": (f"cast({like(NO_NAME)} as int)", 2),
            "size": (f"case when length({x}.v) < 10 then 0 when length({x}.v) < 24 then 1 else 2 end", 3),
        }
    d, n = f"length({_digits(f'{x}.v')})", f"length({x}.v)"
    return {
        "digits": (f"case when {d} < 5 then 0 when {d} < 9 then 1 when {d} < 13 then 2 when {d} < 20 then 3 else 4 end", 5),
        "letters": (f"case when {like('[G-Zg-z]')} then 2 when {like('[A-Fa-f]')} then 1 else 0 end", 3),
        "at": (f"cast(contains({x}.v, '@') as int)", 2),
        "signs": (f"least(2, regexp_count({x}.v, r'[./:-]'))", 3),
        "size": (f"case when {n} < 6 then 0 when {n} < 10 then 1 when {n} < 24 then 2 else 3 end", 4),
        "cue": (f"case when {like(FOR, f'{x}.b')} then 2 when {like(AGAINST, f'{x}.b')} then 0 else 1 end", 3),
    }


def reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = 100) -> tuple[float, list[list[float]], dict[tuple[int, ...], float]]:
    """Expectation-maximisation over counted vote patterns: the share of hits, each labeler's chance to vote 1 on (misses, hits), and the posterior of each pattern."""
    k = len(next(iter(patterns)))
    share, rate = 0.3, [[0.2, 0.8] for _ in range(k)]
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for p in patterns:
            odds = math.log(share / (1 - share))
            for j, v in enumerate(p):
                if v >= 0:
                    miss, hit = rate[j]
                    odds += math.log(hit / miss) if v else math.log((1 - hit) / (1 - miss))
            post[p] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
        total = sum(patterns.values())
        share = min(0.95, max(0.02, sum(n * post[p] for p, n in patterns.items()) / total))
        for j in range(k):
            for of in (0, 1):
                weight = {p: n * (post[p] if of else 1 - post[p]) for p, n in patterns.items() if p[j] >= 0}
                rate[j][of] = (1 + 3 * of + sum(w for p, w in weight.items() if p[j])) / (5 + sum(weight.values()))
            if rate[j][1] <= rate[j][0]:  # a labeler that errs more often than not says nothing
                rate[j] = [0.5, 0.5]
    return share, rate, post


def fit(rows: list[tuple[tuple[int, ...], float, float]], sizes: list[int], rounds: int = 300) -> list[list[float]]:
    """Weights of each feature's values (the bias comes first, alone) by gradient steps on the logistic loss; rows: values, count, mean posterior."""
    weights = [[0.0], *([0.0] * n for n in sizes)]
    total = sum(n for _, n, _ in rows)
    for _ in range(rounds):
        slope = [[0.002 * w for w in ws] for ws in weights]
        for values, n, p in rows:
            z = weights[0][0] + sum(weights[j + 1][v] for j, v in enumerate(values))
            err = n / total * (1 / (1 + math.exp(-max(-30, min(30, z)))) - p)
            slope[0][0] += err
            for j, v in enumerate(values):
                slope[j + 1][v] += err
        for ws, ss in zip(weights, slope):
            for i, s in enumerate(ss):
                ws[i] -= 2.0 * s
    return weights


def _trained(counted: list, sort: str) -> list[list[float]] | None:
    if not counted:
        return None
    patterns: dict[tuple[int, ...], int] = {}
    for r in counted:
        key = tuple(r[f"v_{k}"] for k in VOTERS)
        patterns[key] = patterns.get(key, 0) + r["count"]
    _, _, post = reliabilities(dict(sorted(patterns.items())))
    by: dict[tuple[int, ...], list[float]] = {}
    names = features(sort, "x")
    for r in counted:
        own = by.setdefault(tuple(r[f"f_{k}"] for k in names), [0.0, 0.0])
        own[0] += r["count"]
        own[1] += r["count"] * post[tuple(r[f"v_{k}"] for k in VOTERS)]
    rows = sorted((values, n, s / n) for values, (n, s) in by.items())
    return [[round(w, 6) for w in ws] for ws in fit(rows, [n for _, n in names.values()])]


def train(seen: DataFrame) -> dict[str, list[list[float]] | None]:
    """The classifier's weights for each sort, from all candidates of a scanned table; None where there are none."""
    out = {}
    for sort in SORTS:
        x = seen.select(F.explode(sort).alias("x"))
        named = {f"v_{k}": v for k, v in votes(sort, "x").items()} | {f"f_{k}": v for k, (v, _) in features(sort, "x").items()}
        out[sort] = _trained(x.select(*(F.expr(v).alias(k) for k, v in named.items())).groupBy(*named).count().collect(), sort)
    return out


def score(sort: str, x: str, weights: list[list[float]]) -> str:
    """SQL of the classifier's log odds."""
    parts = [f"{weights[0][0]!r}D"]
    for (sql, _), ws in zip(features(sort, x).values(), weights[1:]):
        parts.append(f"element_at(array({', '.join(f'{w!r}D' for w in ws)}), 1 + {sql})")
    return " + ".join(parts)


def decided(seen: DataFrame, weights: dict | None = None) -> DataFrame:
    """The rows of a scanned table with found: array of (kind, s, e), by kind as listed, then by start; weights: of train()."""
    parts = [f"transform({kind}, x -> named_struct('kind', '{kind}', 's', x.s, 'e', x.e))" for kind in BASE]
    for sort in SORTS:
        if (weights or {}).get(sort):
            parts.append(f"transform(filter({sort}, x -> {score(sort, 'x', weights[sort])} >= 0), x -> named_struct('kind', '{sort}', 's', x.s, 'e', x.e))")
    return seen.withColumn("found", F.expr(f"concat({', '.join(parts)})"))


def _rows(decided: DataFrame, *new: str) -> DataFrame:
    names = [f.name for f in decided.schema["row"].dataType.fields if f.name not in new]
    return decided.select(*(F.col(f"row.`{c}`") for c in names), *new)


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """df with found: array of (kind, s, e), by kind as listed, then by start; the classifier is trained on the candidates of all rows."""
    seen = Stash(df.sparkSession)(scanned(df, text).drop("text"), "spans")
    return _rows(decided(seen, train(seen)), "found")


def listed(of: str) -> str:
    return f"array_join(transform({of}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def replaced(found: str, text: str) -> str:
    """SQL of the text with [kind] in place of its spans; of spans that overlap, the later is cut back to what lies beyond those before it, and goes if nothing does."""
    kind = "array<struct<s:int,e:int,kind:string>>"
    apart = _in_parts(f"array_sort(transform({found}, x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind)))", "0", "named_struct('at', greatest(own.at, x.e), 'out', if(x.s >= own.at, concat(own.out, array(x)), own.out))", kind)
    # cuts: the spans that begin runs of overlapping ones; ends: where those runs end. Texts are cut a part at a time, since substring counts from the begin.
    inner = f"transform(sequence(c * {PART}, least((c + 1) * {PART}, size(cuts)) - 1), i -> concat(substring(g, if(i = 0, 0, ends[i - 1]) - lo + 1, cuts[i].s - if(i = 0, 0, ends[i - 1])), '[', cuts[i].kind, ']'))"
    piece = f"transform(array(if(c = 0, 0, ends[c * {PART} - 1])), lo -> transform(array(substring({text}, lo + 1, ends[least((c + 1) * {PART}, size(cuts)) - 1] - lo)), g -> array_join({inner}, ''))[0])[0]"
    pieces = f"array_join(transform(sequence(0, (size(cuts) - 1) div {PART}), c -> {piece}), '')"
    whole = f"concat({pieces}, substring({text}, ends[size(cuts) - 1] + 1))"
    return f"transform(array({apart}), cuts -> transform(array({_ends(found)}), ends -> {whole})[0])[0]"


def _ends(found: str) -> str:
    """SQL of the ends of the runs of overlapping spans, in order."""
    spans = f"array_sort(transform({found}, x -> named_struct('s', x.s, 'e', x.e)))"
    # at: the greatest end so far, or -1 before the first span. A span that begins at or after it ends a run.
    runs = _in_parts(f"concat({spans}, array(named_struct('s', 2147483647, 'e', 2147483647)))", "-1", "named_struct('at', greatest(own.at, x.e), 'out', if(own.at >= 0 and x.s >= own.at, concat(own.out, array(own.at)), own.out))", "array<int>")
    return runs


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """df whose text has [kind] in place of its spans; spans that overlap become one, named after the first. Texts without spans stay as they are, nulls too."""
    seen = Stash(df.sparkSession)(scanned(df, text), "spans")
    found = decided(seen, train(seen)).withColumn("text", F.expr(f"if(size(found) = 0, row.`{text}`, {replaced('found', 'text')})"))
    return found.select(*((F.col("text") if c == text else F.col(f"row.`{c}`")).alias(c) for c in df.columns))


def op7_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = scanned(docs)
    seen = Stash(spark)(seen.select(F.struct("row.doc_id").alias("row"), *KINDS), "spans")
    found = decided(seen, train(seen))
    counts = [F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    base = ", ".join(f"'{k}'" for k in BASE)
    return found.select("row.doc_id", *counts, F.expr(f"sha2({listed(f'filter(found, x -> x.kind in ({base}))')}, 256)").alias("base_sha256"), F.expr(listed("found")).alias("spans"))
