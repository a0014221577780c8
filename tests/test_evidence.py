"""Places in texts, in SQL against the same on Python values."""

import random

from pyspark.sql import functions as F

from foliant.functions import columns as C
from foliant.functions import plain
from foliant.operators import evidence

WORDS = ["Āmina", "amina,", "was", "<sold>", "at", "Dubai.", "Pol:Agent", "it's", "\n", "  ", "1931", "—", "WAS", "dubai", "(see)", "x&y"]


def pages(n=120):
    rng = random.Random(6)
    for k in range(n):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 14)))
        cut = text.split()
        quotes = [" ".join(cut[a : a + rng.randint(1, 4)]) for a in [rng.randrange(len(cut) + 1) for _ in range(3)]]
        quotes += [plain.match_key(q) for q in quotes] + [q.upper() for q in quotes[:1]] + ["nowhere", "", None, "amina was", "agent it s"]
        yield k, rng.choice([text, text, text, None if k % 9 == 0 else text]), quotes


def test_spans_and_markup(spark):
    rows = list(pages())
    told = [("d", p, k, f'l"{k}', q) for p, _, quotes in rows for k, q in enumerate(quotes)]
    df, asked = spark.createDataFrame([("d", p, t) for p, t, _ in rows], "doc_id string, page int, text string"), spark.createDataFrame(told, "doc_id string, page int, ord int, label string, quotation string")
    got = {(r.page, r.ord): (r.s, r.e) for r in evidence.find_spans(df, asked).collect()}
    want = {(p, k): span for p, t, quotes in rows for k, q in enumerate(quotes) if (span := evidence.find_span(q, t))}
    assert got == want and len(want) > 300
    for r in evidence.highlighted(df, asked).collect():
        t, quotes = next((t, q) for p, t, q in rows if p == r.page)
        spans = evidence.chosen([{"s": s[0], "e": s[1], "label": f'l"{k}', "priority": 0} for k, q in enumerate(quotes) if (s := evidence.find_span(q, t))])
        assert [x.asDict() for x in r.spans] == spans and r.markup == evidence.marked(t, spans)
    plan = evidence.highlighted(df, asked)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chosen(spark):
    rng = random.Random(3)
    lists = [[dict(s=(s := rng.randint(0, 20)), e=s + rng.randint(1, 8), label=f"{k}", priority=rng.randint(0, 2)) for k in range(rng.randint(0, 9))] for _ in range(200)]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, spans array<struct<s:int,e:int,label:string,priority:int>>").select("k", C.chosen("spans").alias("c")).collect()
    for r in rows:
        assert [x.asDict() for x in r.c] == evidence.chosen(lists[r.k]), lists[r.k]


def test_names_and_contexts(spark):
    text = "Faraj bin Said, (Faraj) and FARAJ  bin; Said of Zanzibar. " + "word " * 60 + "Said met Faraj-bin-Said; Farajbin Said"
    names = ["Faraj bin Said", "faraj", "Said", "", "(x)", "Nobody"]
    df = spark.createDataFrame([("d", 1, text), ("d", 2, None), ("d", 3, "none")], "doc_id string, page int, text string")
    listed = spark.createDataFrame([("d", p, k, n) for p in (1, 2) for k, n in enumerate(names)], "doc_id string, page int, ord int, name string")
    got = {r.page: [x.asDict() for x in r.spans] for r in evidence.highlighted_names(df, listed).collect()}
    spans = [{"s": m.start(), "e": m.end(), "label": n, "priority": k} for k, n in enumerate(names) if (p := plain.name_pattern(n)) for m in p.finditer(text)]
    assert got == {1: evidence.chosen(spans), 2: [], 3: []} and len(got[1]) >= 5
    told = spark.createDataFrame([(n, t) for n in names for t in (text, "", "Said")], "n string, t string").withColumn("x", F.col("n"))
    for r in told.select("n", "t", C.contexts("t", C.name_regex(F.expr(_name()))).alias("c")).collect():
        assert r.c == plain.contexts(r.n, r.t), (r.n, r.t)


def _name():
    from foliant.functions import scalar as S
    from foliant.plans.dialect import SPARK

    return S.name(SPARK, "x")
