"""Operators against brute force on small tables with nulls, empty texts, ties, repeated rows and odd characters."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from foliant.llm import bpe, ngram_join, pii, suffix_dedup
from foliant.llm.shingles import linked, need, parities, shingles

TEXTS = [None, "", "a", "a b c", "A  b\tc", "a" * 99, "ab" * 300, "x" * 5000, "é😀 漢字 <|endoftext|> it's 12"]
rng = random.Random(4)
BASE = [" ".join(rng.choice("red blue green one two three four".split()) for _ in range(60)) for _ in range(3)]
TEXTS += BASE + [b + " tail" for b in BASE] + ["head " + b for b in BASE] + [BASE[0]]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, size string")


def test_bpe(spark):
    path = bpe.vocabulary_file()
    tk = Tokenizer.from_file(path)
    rows = {r.doc_id: r for r in bpe.decode_column(bpe.encode_column(frame(spark), path), path).collect()}
    for i, t in enumerate(TEXTS):
        ids = tk.encode(t or "", add_special_tokens=False).ids
        assert list(rows[i].ids) == ids and rows[i].decoded == tk.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("run", [lambda s, d: ngram_join.ngram_groups(s, d), lambda s, d: suffix_dedup.remove_repeats(s, d), lambda s, d: pii.redacted(d)])
def test_empty_table(spark, run):
    assert run(spark, frame(spark).limit(0)).count() == 0


def test_parities_lose_no_link():
    """Texts with up to 12 edits: bits of linked sets never differ in more places than their sizes allow."""
    pick, words, found = random.Random(1), [str(i) for i in range(40)], 0
    for _ in range(1500):
        a = [pick.choice(words) for _ in range(pick.randint(1, 300))]
        b = list(a)
        for _ in range(pick.randint(0, 12)):
            b[pick.randrange(len(b))] = pick.choice(words)
            b.insert(pick.randrange(len(b) + 1), pick.choice(words))
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        if linked(x, y):
            p, q = sorted((parities(x), parities(y)), key=len)
            q = q if len(p) == len(q) else q[: len(p)] ^ q[len(p) :]
            assert len(p) == len(q) and np.bitwise_count((p ^ q).view(np.uint64)).sum() <= len(x) + len(y) - 2 * need(len(x), len(y))
            found += 1
    assert found > 100


def test_bpe_keeps_short_words_alone():
    from foliant.llm import bpe

    with open(bpe.vocabulary_file(), encoding="utf-8") as f:
        coder = bpe.Bpe(f.read())
    assert coder.decode(np.frombuffer(coder.encode("short " + "long" * 100), np.int32).tolist()) == "short " + "long" * 100
    assert "short" in coder and all(len(w.encode()) <= bpe.SHORT for w in coder)


def test_small_batches_respect_the_user(spark):
    from foliant.llm.common import small_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "12345b")
        small_batches(spark)
        assert spark.conf.get(key) == "12345b"
        spark.conf.unset(key)
        small_batches(spark)
        assert spark.conf.get(key) in ("4194304", "4194304b")
    finally:
        spark.conf.set(key, before)
