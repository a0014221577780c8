"""Decisions on candidates in SQL against the same on Python values."""

import itertools
import random

from foliant.functions import plain
from foliant.operators import people, roles

NAMES = ["Faraj bin Said", "faraj", "Mubarak", "Abu-Bakr", "Amina (alias X) bint Yusuf", "Owner", "Zaid 7", "Šālim"]
SAID = ["Statement of slave {n}, aged 30", "He was sold to {n} for 200 dollars.", "1 slave of Bahrain, named {n}", "Letter  from {n} to the Resident", "{n} is free born and not a slave", "I recommend that a certificate be issued for {n}.", "The Political Agent met {n} at noon", "A refugee slave came; {n} was absent", "{n} went home.", "", "for delivery to {n} and belonging to {n}", "manumission\nof him and {n}", "free born, not a slave", "statement made by\n{n}; sold to {n}", "{n} requests repatriation", "grant a certificate to one {n}", "Shaikh {n} signed before me by {n}", "slave {n}", "named {n}, a slave of Dubai", "owner named {n}"]


def test_against_plain(spark):
    rng, rows, pages = random.Random(2), [], []
    for page, (name, told) in enumerate(itertools.product(NAMES, SAID)):
        spelt = lambda: rng.choice([name, name.upper(), plain.name(name).replace(" ", rng.choice([", ", "  ", "\n"])), "Nobody"])
        text = rng.choice([None, "", "x " * 100 + rng.choice(SAID).format(n=spelt()) + " y" * 90 + rng.choice(SAID).format(n=spelt()) + " z" * 150 + rng.choice(SAID).format(n=spelt()), "No name at all. " * 3])
        rows.append(("d", page, 0, name, rng.choice([told.format(n=spelt()), told.format(n=plain.name(name)), None])))
        pages.append(("d", page, text))
    df = spark.createDataFrame(rows + rows[:5], "doc_id string, page int, ord int, name string, evidence string")
    got = people.judged(df, spark.createDataFrame(pages, "doc_id string, page int, text string"))
    kinds = set()
    for r in got.collect():
        want = plain.decision(r.name, r.evidence, pages[r.page][2])
        assert (r.keep, r.reason_type, r.reason, r.excerpt) == tuple(want[k] for k in ("keep", "reason_type", "reason", "excerpt")), (r, pages[r.page])
        kinds.add(r.reason_type)
    assert got.count() == len(rows) + 5 and kinds == {"freeborn_not_slave", "positive_rule", "negative_rule", "strong_local_signal", "invalid_name", "ambiguous_subject_role"}
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and roles.MARK
