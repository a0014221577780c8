"""Line dedup against plain Python: nulls, repeats, ties, lines of all documents, groups that are split, long texts."""

import random
from collections import defaultdict

import pytest

from foliant.llm import line_dedup as op

rng = random.Random(5)
SHARED = [f"A line that stands in many documents, number {k}" for k in range(12)]
COMMON = "the one line that nearly all of the documents hold"


def texts(n=240):
    for i in range(n):
        lines = [COMMON.upper() if i % 7 else "\t" + COMMON + " \r"] if i % 9 else []
        lines += rng.sample(SHARED, rng.randint(0, 5)) + [f"own line of document {i} and nobody else"] * rng.randint(0, 2) + rng.choice([[], ["short"], [""], ["", "\x1c" + COMMON]])
        rng.shuffle(lines)
        yield i, "\n".join(lines)


ROWS = [*texts(), (240, None), (241, ""), (242, "\n\n"), (243, COMMON + "\n" + COMMON), (10, COMMON), (11, None), (None, COMMON), (None, COMMON), (None, None)]
ROWS += [r for r in ROWS[:30]] + [(500, SHARED[0]), (500, SHARED[0]), (500, SHARED[1]), (244, "é" * 20), (245, "É" * 20 + "\n" + "é" * 20), (246, "é" * 20), (247, "é" * 20 + " \v\f"), (248, "x" * 19), (249, "x" * 19), (250, "x" * 19)]


def key(line):
    line = line.strip("\t\n\x0b\x0c\r ")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)


def plain(rows, least=20, documents=3):
    where = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= least:
                where[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stays = [i is None or len(key(x)) < least or len(where[key(x)]) < documents or i == max(where[key(x)]) for x in lines]
        out.append((i, len(lines), stays.count(False), "\n".join(x for x, s in zip(lines, stays) if s)))
    return sorted(out, key=repr)


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, 1, 2, "k", [3]) for i, t in rows], "doc_id long, text string, h1 long, salt int, drop string, keep array<int>")


def found(df):
    return sorted(((r.id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=repr)


def test_against_plain_lines(spark):
    assert found(op.kept_texts(spark, frame(spark))) == plain(ROWS)


def test_lines_of_a_third_of_all_are_split(spark, monkeypatch):
    monkeypatch.setattr(op, "LOOK", 1)
    monkeypatch.setattr(op, "SHARE", 40)
    monkeypatch.setattr(op, "GROUP", 4)
    lines = op.hashed_lines(frame(spark))
    assert op._salted(lines, lines.count()).groupBy("h1").agg({"salt": "max"}).where("`max(salt)` > 9").count() >= 1
    assert found(op.kept_texts(spark, frame(spark))) == plain(ROWS)
    assert found(op.kept_texts(spark, frame(spark), least=5, documents=2)) == plain(ROWS, 5, 2)


def test_bitmaps_are_runs_of_lines_that_stay(spark):
    rows = {(r.id, r.tag): r for r in op.keep_bitmaps(spark, frame(spark)).collect()}
    assert len(rows) == len({(i, t or "") for i, t in ROWS})
    for r in rows.values():
        assert sum(k.lines for k in r.keep) == r.n_lines - r.n_dropped
        assert all(a.at + a.lines < b.at for a, b in zip(r.keep, r.keep[1:])) and all(k.lines > 0 for k in r.keep)


def test_no_rows_no_python_and_long_texts(spark):
    assert op.kept_texts(spark, frame(spark).limit(0)).count() == 0
    assert op.keep_bitmaps(spark, frame(spark).where("text is null")).where("n_lines = 1 and n_dropped = 0").count() == 3
    long = [(1, "\n".join(f"line {k % 500} of a very long document" for k in range(60_000))), (2, "z" * 3_000_000), (3, "z" * 3_000_000), (4, "z" * 3_000_000 + " " * 100_000 + "."), (5, "Z" * 3_000_000)]
    long += [(6, long[0][1][:9000]), (7, long[0][1])]
    df = op.kept_texts(spark, frame(spark, long))
    assert found(df) == plain(long)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("order", [1, -1])
def test_order_of_rows_plays_no_part(spark, order):
    assert found(op.kept_texts(spark, frame(spark, ROWS[::order]).repartition(3))) == plain(ROWS)
