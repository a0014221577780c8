"""Replies in SQL against the same on Python values: fences, strings with brackets, broken and cut JSON, and what follows from their lists."""

import json
import random

from pyspark.sql import functions as F

from foliant.functions import columns as C
from foliant.functions import plain
from foliant.operators import people, places

GOOD = ['{"a": 1}', '[{"a": 1}]', '{"text": "value with } brace", "items": [1, 2]}', '{"q": "say \\"}]\\" \\\\", "n": [[], {}]}', '"x"', "12", "[]", "true", '{"é": "漢 \\u0041"}', '{"a": [1.5, -2, "3"]}']
BAD = ["", "no structured payload here", '{"bad":', "{]", '[1, 2}', '{"a" 1}', "}{", '"open', '{"a": "open}', '[1] [2]', '{"a": 1}}', "nullx", "[1,]", '1], [2', '1, "b": 2']


def texts():
    yield from GOOD + BAD + [None, "null", "  [1] ", "```\nnull\n``` {\"a\": 2}"]
    for g in GOOD:
        yield from (f"Here is {{the}} answer:\n```json\n{g}\n``` done }}", f"noise {g} and more {{", f"```JSON {g}```", f"```\nnot {g} it\n```", f"say \"{g}", f"prefix {g[:-1]}", f"~~~{g}~~~ {{\"bad\":")
    rng = random.Random(1)
    for _ in range(300):
        yield "".join(rng.choice(['{', '}', '[', ']', '"', "\\", ",", ":", "1", "a", " ", "```", '"k"', "null"]) for _ in range(rng.randint(1, 14)))


def test_values_of_replies(spark):
    rows = list(dict.fromkeys(texts()))
    df = spark.createDataFrame([(t,) for t in rows], "t string").select("t", C.found_json("t").alias("j"), C.balanced("t").alias("b"))
    for r in df.collect():
        want = plain.found_json(r.t)
        assert (None if r.j is None else json.loads(r.j)) == want, r.t
        assert r.b == plain._balanced(r.t or ""), r.t
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_replies(spark):
    """Strings of a million signs and thousands of brackets neither overflow a stack nor take long."""
    items = [{"name": "Faraj bin Said", "evidence": "x{" * 500_000}] + [{"name": f"Person {c * 3}", "evidence": "[" * 50} for c in "abcdefghij" * 300]
    text = "so: " + json.dumps({"named_people": items}) + " }"
    value = spark.createDataFrame([(text,)], "t string").select(C.reply_value("t").alias("v")).select(F.size(C.reply_items("v", "named_people")).alias("n")).first()
    assert value.n == len(items)


NAMES = ["mariam   BINT YUSUF", "Mariam bint Yusuf", "the slave āmina ibn salim", "owner", "", "X", "Faraj (alias F) bin Said", "FARAJ BIN SAID", "Abdulla 7", None, 12, ["x"], "Sheikh Rashid"]
PLACES = ["shargah", "at\xa0Dibai", "Ras-ul-khaimah", "", "from bushire (Persia)", "H.M.S. Lapwing", "Zanzibar", "zanzibar", None]
DAYS = ["17th May 1931", "3/4/1931", "", None, "in spring", "null", "2nd June", "1931-05-17", "May 20, 1931"]


def made(n=120):
    rng = random.Random(2)
    for page in range(n):
        who = [{"name": rng.choice(NAMES), "evidence": rng.choice(["", "short", "a longer  piece\n of evidence", " ".join(["word"] * 40), None])} for _ in range(rng.randint(0, 7))] + rng.choice([[], ["text", 3, None]])
        where = [{"place": rng.choice(PLACES), "order": rng.choice([0, 1, 2, "3", None, -1, 2.7, "x"]), "arrival_date": rng.choice(DAYS), "date_confidence": rng.choice(["explicit", "sure", "", None, "unknown"]), "time_text": rng.choice(["", None, "in spring", "None", "about  noon"]), "evidence": rng.choice(["", "he was  there", None])} for _ in range(rng.randint(0, 7))]
        reply = rng.choice([{"named_people": who, "places": where}] * 6 + [[1], {"named_people": {"name": "x"}, "places": "x"}])
        yield page, rng.choice(["{}", "```json\n{}\n```", "see {} }}"]).replace("{}", json.dumps(reply, ensure_ascii=False)).replace("}}}", "}}")


def test_people_and_places_of_replies(spark):
    rows = list(made())
    df = spark.createDataFrame([("d", p, "Faraj", t, y) for p, t in rows for y in [1931 if p % 3 else None]], "doc_id string, page int, name string, reply string, doc_year int")
    want = {p: [(x["name"], x["evidence"]) for x in plain.named_people(plain.found_json(t))] for p, t in rows}
    got = {}
    for r in people.from_replies(df).orderBy("page", "ord").collect():
        got.setdefault(r.page, []).append((r.name, r.evidence))
    assert got == {p: v for p, v in want.items() if v}
    fields = ["place", "order", "arrival_date", "date_confidence", "time_info", "evidence"]
    for found, f in ((places.candidates(df), lambda v, y: plain.candidate_places(v, "Faraj")), (places.final(df), lambda v, y: plain.final_places(v, "Faraj", y))):
        lists = {}
        for r in found.orderBy("page", "ord").collect():
            lists.setdefault(r.page, []).append(tuple(r[c] for c in fields))
        want = {p: [tuple(x[c] for c in fields) for x in f(plain.found_json(t), 1931 if p % 3 else None)] for p, t in rows}
        assert lists == {p: v for p, v in want.items() if v}
