"""Fill-in-the-middle against a regular expression; texts come back; checkpoints of every stride."""

import hashlib
import random
import re

import pytest

from foliant.llm import fill_middle as op

rng = random.Random(8)
TEXTS = [None, "", "a", "é", "ab", "a b", "<P>", "x <S> y", "<M", "<" * 50, "<P" * 30, "word " * 4000, "é😀 漢字\n\t" * 300, "q" * 700_000, ("x" * 5000 + "é") * 60, "1" * 300_000, "a<\n" * 999]
TEXTS += ["".join(rng.choice("ab <PSM>é\n漢z") for _ in range(rng.randint(1, 400))) for _ in range(150)]
ROWS = [*enumerate(TEXTS), (None, "text of no id"), (None, None), (3, "a b"), (-5, "minus five is an id"), (5, "a b"), (5, "a b")]


def plain(i, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(units)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return text, "plain", n, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (f"<S>{s}<P>{p}<M>{m}", "spm", n, len(p), len(m)) if h4 % 100 < 20 else (f"<P>{p}<S>{s}<M>{m}", "psm", n, len(p), len(m))


def test_against_the_expression(spark):
    df = spark.createDataFrame([(i, t, "f", "o", 1) for i, t in ROWS], "doc_id long, text string, form string, output string, restored int")
    rows = op.restore(spark, op.fill_in_middle(spark, df)).collect()
    assert sorted((r.doc_id, r.text, r.output, r.form, r.n, r.prefix_chars, r.middle_chars) for r in rows if r.doc_id is not None and r.text is not None) == sorted((i, t, *plain(i, t)) for i, t in ROWS if i is not None and t is not None)
    assert len(rows) == len(ROWS) and all(r.restored == (r.text or "") for r in rows) and {r.form for r in rows} == {"plain", "psm", "spm"}
    assert all((r.output, r.form, r.n, r.prefix_chars, r.middle_chars) == plain(r.doc_id, r.text) for r in rows)


def test_query_on_its_table(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, n int")
    monkeypatch.setattr(op, "table", lambda *a: df)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, p[2], p[1], p[3], p[4], sha(p[0]), sha(t or "")) for i, t in ROWS for p in [plain(i, t)]]
    assert sorted(map(tuple, op.op13_fill_in_middle(spark, "").collect()), key=repr) == sorted(want, key=repr)
    monkeypatch.setattr(op, "table", lambda *a: df.limit(0))
    assert op.op13_fill_in_middle(spark, "").count() == 0


@pytest.mark.parametrize("stride, piece", [(1, 1), (2, 3), (3, 7), (64, 100), (512, 1 << 18)])
def test_checkpoints(stride, piece):
    for text in ["", "abc", "é", "a1b2", "漢字 ab 漢", *TEXTS[12:13], *TEXTS[17:40]]:
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        index = op.Checkpoints(text.encode(), stride, piece)
        assert index.n == len(units) and index.points_all == len(text) and index.units == list(range(0, max(1, len(units)), stride))
        for k in {0, 1, len(units) // 2, len(units) - 1, len(units)}:
            if 0 <= k <= len(units):
                head = "".join(units[:k])
                assert index.cut(k) == (len(head.encode()), len(head))
