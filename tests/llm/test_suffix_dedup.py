"""Removal of repeated strings against a set of all strings seen: odd and long texts, repeated and null ids, shared passages."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from foliant.llm import suffix_dedup

rng = random.Random(9)
WORDS = ["red", "blue", "green", "one", "two", "é", "漢字", "😀", "three", "four"]


def prose(n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(100)) for _ in range(n))


def brute(texts):
    """Results of the texts in the order of their documents."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, np.int64)
        for p in range(len(b) - 99):
            x = hash(b[p : p + 100])
            if x in seen:
                gone[p] += 1
                gone[p + 100 if p + 100 <= len(b) else len(b)] -= 1
            seen.add(x)
        cut = np.cumsum(gone)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], cut.astype(int)])) == 1).sum())
        out.append((len(b), int(cut.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~cut].tobytes()).hexdigest()))
    return out


def found(spark, rows, schema="doc_id long, text string, tag string"):
    df = spark.createDataFrame([(*r, "kept") for r in rows], schema).repartition(3)
    return [(r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(spark, df).collect()]


def test_against_all_strings(spark):
    passage = prose(60)
    texts = [None, "", "a", "ab" * 300, "x" * 5000, "a" * 99, "b" * 100, "b" * 101]
    texts += ["".join(rng.choice("ab") for _ in range(300)) for _ in range(3)]
    texts += [texts[-1][50:] + "q" * 150, texts[-2] + texts[-1]]
    texts += [prose(rng.randrange(5, 60)) + " " + passage[rng.randrange(50) : -rng.randrange(1, 50)] + prose(rng.randrange(30)) for _ in range(25)]
    texts += [passage, passage, passage + "!"]
    got = {r[0]: r[1:] for r in found(spark, list(enumerate(texts)))}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_long_texts_in_pieces(spark):
    a = prose(80_000)
    assert len(a.encode()) > suffix_dedup.BLOCK
    texts = [a, "start " + a[300_000:300_400] + " end", a[:2000] + "x" + a[-2000:]]
    got = {r[0]: r[1:] for r in found(spark, list(enumerate(texts)))}
    assert [got[i] for i in range(3)] == brute(texts)


def test_periodic_texts(spark):
    """Texts of a short period, alone and beside others; a long one is few rows, and ends soon."""
    short = ["x" * 700, "ab" * 400 + "c" * 300, "x" * 150 + "Ha " * 200, "Shti " * 90 + "end", "y" * 100, "y" * 101 + "x" * 120]
    got = {r[0]: r[1:] for r in found(spark, list(enumerate(short)))}
    assert [got[i] for i in range(len(short))] == brute(short)
    long = ["q" * 3_000_000, "Ha " * 1_000_000, "pre" + "q" * 1_000_000 + "post" * 50]
    for batch in suffix_dedup._scan([pa.RecordBatch.from_pylist([{"id": 1, "tag": 0, "text": x}]) for x in long[:2]]):
        assert batch.num_rows < 300
    got = {r[0]: r[1:] for r in found(spark, list(enumerate(long)))}
    assert got[0][:3] == (3_000_000, 3_000_000 - 1, 1) and got[1][:3] == (3_000_000, 3_000_000 - 3, 1)
    assert got[0][3] == hashlib.sha256(b"q").hexdigest() and got[1][3] == hashlib.sha256(b"Ha ").hexdigest()
    assert got[2] == (1_000_203, *brute_tail())


def brute_tail():
    """(removed, spans, hash) of the last text after one that is all q: its q go, and of its end what repeats."""
    last = "pre" + "q" * 300 + "post" * 50
    n, removed, spans, sha = brute(["q" * 400, last])[1]
    return removed + 999_700, spans, sha


def test_repeated_and_null_ids(spark):
    x, y = prose(60), prose(60)
    rows = [(1, x), (1, x), (1, y), (2, x), (None, x), (None, None), (3, y), (1, x)]
    got = sorted(found(spark, rows), key=str)
    whole = lambda i, t: (i, *brute([t])[0])
    gone = lambda i, t: (i, *brute([t, t])[1])
    assert got == sorted([whole(1, x)] * 3 + [whole(1, y), gone(2, x), whole(None, x), whole(None, None), gone(3, y)], key=str)


def test_empty_table(spark):
    assert found(spark, []) == []
