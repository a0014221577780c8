"""Allowed lists in one pass against the two passes over them: what is kept, and what is gone."""

import random

from foliant.operators import people

NAMES = ["mariam   BINT YUSUF", "Mariam bint Yusuf", "the slave āmina ibn salim", "Amina bin Salim", "", "Faraj (alias F) bin Said", "FARAJ BIN SAID", "محمد بن علي", "Nguyễn Văn"]


def lists(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["d", "e", None]), page, k, rng.choice(NAMES), rng.choice(["", "he  said so", " ".join(["word"] * 40)])) for page in (1, 2, None) for k in range(rng.randint(2, 12))]
    return spark.createDataFrame(rows, "doc_id string, page int, ord int, name string, evidence string")


def test_one_pass_keeps_and_tells_what_two_do(spark):
    picks, allowed = people.keyed(lists(spark, 1)).dropDuplicates(["doc_id", "page", "ord"]), people.keyed(lists(spark, 2)).dropDuplicates(["doc_id", "page", "ord"])
    picks, allowed = spark.createDataFrame(picks.collect(), picks.schema), spark.createDataFrame(allowed.collect(), allowed.schema)
    columns = ["doc_id", "page", "ord", "name", "evidence"]
    kept = people.restricted(picks.drop("key"), allowed.drop("key"), fall_back=False)
    gone = people.removed(picks.drop("key"), kept, "filter")
    want = [(*r, True) for r in kept.select(columns).collect()] + [(*r, False) for r in gone.select(columns).collect()]
    found = people.sifted(picks, allowed)
    assert len({w[-1] for w in want}) == 2
    assert sorted(map(str, (tuple(r) for r in found.select(*columns, "kept").collect()))) == sorted(map(str, want))
    # Both lists' rows move once, and no name is made normal in a row of its own.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "ArrowEval" not in plan
