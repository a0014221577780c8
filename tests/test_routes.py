"""Routes as a plan against the same on Python lists: the letters of two cases, and made-up rows and pages by the hundred."""

import random

from pyspark.sql import functions as F

from foliant.functions import plain
from foliant.operators import places, routes

LETTER = "No. 12.\nFrom - The Residency Agent, Bushehr.\nThe slave {who} was forwarded by the mail arriving at {goal}{when}.\n"
WHO = ["Faraj", "Abdulla bin Said", "Mubarak"]
SPOTS = ["Zanzibar", "shargah", "Mekran", "at Dubai", "Ras-ul-khaimah", "H.M.S. Lapwing", "Without Pressure", "Bushehr", "Basra (old)", "", "École", "koweit"]
TOLD = ["born at {p}", "he reached {p}", "requested passage to {p}", "", "taken to {p} in a dhow", "arrived at {p}", "certificate of {p}", "word that no page has"]
TIMES = ["", "in spring", "on 17th May", "  about   the Autumn"]
TEXTS = [
    *(LETTER.format(who=w, goal=g, when=t) for w in WHO[:2] for g, t in (("Dubai", " on 17th May"), ("without the slightest pressure on either", ""), ("Kuwait", " about the 20th May 1931"), ("Muscat", " about the Autumn"), ("Bushehr", ""))),
    "From Mekran he was taken to Dubai; born at Zanzibar. He reached Shargah.\nFrom - X.\nFaraj arrived in Basra, well.",
    "Zanzibar first: Faraj\r\nFROM - Captain, Political Agent, Bahrain. \nand Abdulla   bin Said arriving Muscat on 3/4/31;",
    "", None, "RAS-UL-KHAIMAH and ecole, 'he reached   Mekran.'", "Faraj. taken to École in a dhow",
]
FIELDS = ["place", "order", "arrival_date", "date_confidence", "time_info", "evidence"]
ROWS = "doc_id string, page int, name string, ord long, place string, order int, arrival_date string, date_confidence string, time_info string, evidence string"


def made(n=160, seed=3):
    rng, rows, pages = random.Random(seed), [], []
    for page in range(n):
        pages.append(("d", page, rng.choice(TEXTS), rng.choice([None, 1931, 1907])))
        route = rng.random() < 0.4
        for who in rng.sample(WHO, rng.randint(0, 2)):
            for k in range(rng.randint(1, 6)):
                p = rng.choice(SPOTS)
                day, sure = rng.choice([("", ""), ("", "unknown"), ("1931-05-17", "explicit"), ("1907-06-10", "derived_from_doc")])
                rows.append(("d", page, who, k, p, rng.choice([0, 0, 1, 2, 3, -1]) if route else 0, day, sure, rng.choice(TIMES), rng.choice(TOLD).format(p=p)))
    return rows, pages


def listed(df):
    out = {}
    for r in df.orderBy("doc_id", "page", "name", "ord").collect():
        assert r.ord == len(out.setdefault((r.page, r.name), []))
        out[r.page, r.name].append(tuple(r[c] for c in FIELDS))
    return out


def grouped(rows):
    out = {}
    for _, page, who, _, *values in rows:
        out.setdefault((page, who), []).append(dict(zip(FIELDS, values), name=who))
    return out


def plainly(lists):
    return {k: [tuple(r[c] for c in FIELDS) for r in v] for k, v in lists.items() if v}


def test_made_up_rows(spark):
    rows, pages = made()
    df, text = spark.createDataFrame(rows, ROWS), spark.createDataFrame(pages, "doc_id string, page int, text string, doc_year int")
    by = {p: (t, y) for _, p, t, y in pages}
    want = plainly({(p, w): plain.reconciled(r, by[p][0], w, by[p][1]) for (p, w), r in grouped(rows).items()})
    got = listed(places.reconciled(df, text))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == want[k], (k, by[k[0]], grouped(rows)[k])
    assert listed(places.folded(df)) == plainly({k: plain.folded(r) for k, r in grouped(rows).items()})
    assert sum(len(v) for v in want.values()) > sum(len(v) for v in listed(places.folded(df)).values())  # stops were inferred


def test_enriched(spark):
    (rows, _), (more, _) = made(60, 5), made(60, 6)
    rows = [r for r in rows if r[4]]
    want = plainly({k: plain.enriched(plain.folded(r), plain.folded(grouped(more).get(k, []))) for k, r in grouped(rows).items()})
    a, b = (places.folded(spark.createDataFrame(t, ROWS)) for t in (rows, more))
    assert listed(places.enriched(a, b)) == want


def test_dates(spark):
    texts = ["on May 17, 1931", "D/ 3-4-31 and 1931-05-17", "17th May", "the 45th Foo 1931", "", None, "3/4/1931", "20th  May\n1931", "2nd Nov 07", "99/99/99 or Jun 5, 1901", "1907-13-45"]
    rows = spark.createDataFrame([(t, y) for t in texts for y in (None, 1931)], "text string, year int")
    for r in routes.found_dates(rows).collect():
        want = plain.date_trace(r.text, r.year)
        assert (r.date.iso, r.date.confidence, r.date.raw) == (want["iso"], want["confidence"], want["raw"]), r.text
        assert [t.asDict() for t in r.date.tried] == want["tried"]


def test_given_orders_of_the_two_letters(spark):
    """The route that a model gave stays; a clause that only looks like an arrival adds no place."""
    faraj = [("Bahrain", 1, "", "", "before 1907-05-19", "Manumission certificate dated 19th May 1907."), ("Kuwait", 2, "1907-10-27", "explicit", "", "Appeared before the author"), ("Bushehr", 3, "", "", "after 1907-11-02", "Case to be put up")]
    abdulla = [("Abyssinia", 1, "", "", "birthplace", "Birth place"), ("Koweit", 2, "1907-06-10", "explicit", "until the Autumn", "Copy of a letter"), ("Bushehr", 3, "1907-06-10", "derived_from_doc", "to-day", "conveyed to-day"), ("Berbera", 0, "", "", "if he can be taken", "his own way to Berbera")]
    rows = [("d", p, w, 9 - k, *r) for p, w, t in ((6, "Faraj bin Said", faraj), (10, "Abdulla, son of", abdulla)) for k, r in enumerate(t)]
    text = "From - The Agent, Koweit.\nAbdulla, Son Of a trader, arrived at without the slightest pressure on either, and Berbera.\n"
    pages = spark.createDataFrame([("d", 6, "Faraj bin Said of Bahrain", 1907), ("d", 10, text, 1907)], "doc_id string, page int, text string, doc_year int")
    got = listed(places.reconciled(spark.createDataFrame(rows, ROWS), pages))
    assert [r[:2] for r in got[6, "Faraj bin Said"]] == [("Bahrain", 1), ("Kuwait", 2), ("Bushehr", 3)] and got[6, "Faraj bin Said"] == faraj
    assert [r[:2] for r in got[10, "Abdulla, son of"]] == [("Abyssinia", 1), ("Koweit", 2), ("Bushehr", 3), ("Berbera", 0)]


def test_no_rows_and_no_python(spark):
    none, pages = spark.createDataFrame([], ROWS), spark.createDataFrame([], "doc_id string, page int, text string, doc_year int")
    df = places.reconciled(none, pages)
    assert df.count() == 0
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_common_keys_are_worked_on_once_and_others_in_place(spark, monkeypatch):
    """routes.shared and routes.normal give the same with few, many and no common keys, and move no row by its key."""
    from foliant.operators import routes

    rows = spark.createDataFrame([(i, None if i % 5 == 0 else "ab"[i % 2] * (1 + i % 3), i % 2) for i in range(40)], "id int, t string, y int")
    told = {(r.id, None if r.t is None else r.t.upper() + str(r.y)) for r in rows.collect()}
    for most, short in ((20_000, 300), (2, 300), (20_000, 2), (1, 0)):
        monkeypatch.setattr(routes, "COMMON", most)
        monkeypatch.setattr(routes, "SHORT", short)
        out = routes.shared(rows, {"t": F.col("t"), "k": F.col("y")}, lambda d: routes.once(d, made="upper(concat(t, k))"))
        assert out.columns == ["id", "t", "y", "made"] and {(r.id, r.made) for r in out.collect()} == told and out.count() == 40
        assert {(r.id, r.n) for r in routes.normal(rows, "t", "n", "upper(x)").collect()} == {(r.id, (r.t or "").upper()) for r in rows.collect()}
