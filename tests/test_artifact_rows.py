"""Rows of artifacts as Arrow batches against the same of Python values; names of a document, a row a spelling."""

import json
import random

from foliant.functions import plain
from foliant.operators import aggregate
from foliant.sources import artifacts

VALUES = ["Mariam bint  Yusuf", "mariam BINT yusuf", "", None, " none ", "NULL", 3, 0, 1.5, True, ["x"], {"a": 1}, "محمد", "17"]


def files():
    rng = random.Random(5)
    row = lambda: {k: rng.choice(VALUES) for k in rng.sample(["Name", "name", "Page", "page", "Report Type", "report_type", "Crime Type", "Place", "place", "Order", "order", "Arrival Date", "_evidence"], 6)}
    for page in range(60):
        rows = [row() for _ in range(rng.randint(0, 5))] + rng.choice([[], ["text", None]])
        yield page, "meta", rng.choice([json.dumps({rng.choice(["rows", "detail_rows", "details"]): rows}), json.dumps(rows), "{broken", "", None, "null", "﻿" + json.dumps(rows)])
        yield page, "places", rng.choice([json.dumps({"rows": rows, "people": [{"name": "Faraj"}, {"Name": "Salim", "rows": rows}, "x"]}), json.dumps({"places": rows}), "[1"])
        yield page, "classify", rng.choice([json.dumps({"should_extract": rng.choice(VALUES + [False]), "skip_reason": rng.choice(["index", ""]), "elapsed_seconds": rng.choice([1.257, "x", "2"]), "model_calls": rng.choice([1, "2", "x"])}), "{", None])


def test_rows_and_names_of_artifacts(spark):
    rows = list(files())
    table = spark.createDataFrame([("d", *r) for r in rows], artifacts.FILES)
    for kind, found, items in (("meta", artifacts.details(table), plain.detail_items), ("places", artifacts.places(table), plain.place_items)):
        got = [r.asDict() for r in found.collect()]
        want = [{"doc_id": "d", "file_page": p, "ord": k} | r for p, name, x in rows if name == kind for k, r in enumerate(items(artifacts._json(x), p))]
        order = lambda r: (r["file_page"], r["ord"])
        assert len(want) > 60 and sorted(got, key=order) == sorted(want, key=order)
    facts = {r.page: r.asDict() for r in artifacts.facts(table).collect()}
    assert facts == {p: {"doc_id": "d", "page": p} | plain.page_facts(artifacts._json(x), None) for p, name, x in rows if name == "classify"}
    # Rows of a page aren't told apart after this: a spelling is one row a table, at the first of its rows.
    details, places = artifacts.details(table), artifacts.places(table)
    names = aggregate.all_names(details, places)
    raws = [r.raw for r in names.collect()]
    assert sorted(raws) == sorted([r.name for t in (details, places) for r in t.select("name").distinct().collect()])
    firsts = {r.name: (r.at.rank, r.at.nth_row >> 32, r.at.nth_row & 0xFFFFFFFF) for r in names.orderBy("at", ascending=False).collect()}
    want = {}
    for rank, t in enumerate((details, places)):
        for r in sorted(t.collect(), key=lambda r: (r.file_page, r.ord)):
            want.setdefault(plain.name(r.name), (rank, r.file_page, r.ord))
    assert firsts == want
