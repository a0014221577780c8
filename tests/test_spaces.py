"""White space and first words in SQL against the same on Python values, for every kind of white space alone and beside others."""

import random

from foliant.functions import plain
from foliant.functions import scalar as S
from foliant.plans.dialect import SPARK

SPACES = list(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def test_spaces_and_first_words(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "a", "a b", " a  b ", *(f"{a}x{a}y" for a in SPACES), *(f"x{a}{b}y {b}" for a in SPACES for b in SPACES)]
    texts += ["".join(rng.choice([*"ab漢", " ", " ", rng.choice(SPACES)]) for _ in range(rng.randint(1, 150))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", f"{S.spaced(SPARK, 't')} as s", f"{S.first_words(SPARK, 't')} as w")
    for r in df.collect():
        assert (r.s, r.w) == (plain.spaced(r.t), plain.first_words(r.t)), repr(r.t)
    # First words are told without a function for each word.
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
