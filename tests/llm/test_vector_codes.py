"""Product codes against plain whole scans: ties, odd vectors, few rows, bounds that may never skip a part that changes."""

import hashlib
import math
import random

import numpy as np

from foliant.llm import vector_codes as op


def plain(rows, rounds=2):
    """rows of (id, vector, label) -> (id, code, error, label_error, codebooks' hash), by scanning all entries each time."""
    kept = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // 16)) * 16
    ints = [[max(-op.MOST, min(op.MOST, math.floor(256 * x))) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    d = width // 16
    parts = [[tuple(v[p * d : p * d + d]) for v in ints] for p in range(16)]
    books = [part[:64] for part in parts]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        codes = [[min(range(len(book)), key=lambda k: far(x, book[k])) for x in part] for part, book in zip(parts, books)]
        if turn < rounds:
            for p, book in enumerate(books):
                own = [[x for x, c in zip(parts[p], codes[p]) if c == k] for k in range(len(book))]
                books[p] = [tuple(sum(c) // len(m) for c in zip(*m)) if m else old for m, old in zip(own, book)]
    name = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    errors = [sum(far(parts[p][n], books[p][codes[p][n]]) for p in range(16)) for n in range(len(kept))]
    of = {}
    for (_, _, g), e in zip(kept, errors):
        of[g] = of.get(g, 0) + e
    return sorted(((i, "".join(f"{codes[p][n]:02x}" for p in range(16)), errors[n], of[g], name) for n, (i, _, g) in enumerate(kept)), key=repr)


def ran(spark, rows, monkeypatch, label="int"):
    df = spark.createDataFrame([(i, v, g, "x") for i, v, g in rows], f"vec_id long, embedding array<float>, label {label}, code string")
    monkeypatch.setattr(op, "table", lambda *a: df)
    return sorted((tuple(r) for r in op.op12_vector_codes(spark, "").collect()), key=repr)


def rows_of(n, dim=32, seed=1, centres=9):
    rng = random.Random(seed)
    mid = [[rng.gauss(0, 0.2) for _ in range(dim)] for _ in range(centres)]
    return [(i, [float(np.float32(m + rng.gauss(0, 0.03))) for m in rng.choice(mid)], rng.choice([None, 0, 1, 2])) for i in range(n)]


def test_against_whole_scans(spark, monkeypatch):
    rows = rows_of(400)
    odd = [(900, None, 1), (901, [None] * 32, 1), (902, [float("nan")] * 32, 2), (903, [float("inf")] + [0.0] * 31, 2), (None, [0.25] * 32, None), (904, [], 0), (905, [0.5] * 5, 0), (906, [-1e30] * 32, 5), (3, rows[3][1], 1), (3, [0.0] * 32, 1)]
    rows += odd + rows[10:40]
    monkeypatch.setattr(op, "BLOCK", 70)
    assert ran(spark, rows, monkeypatch) == plain(rows)


def test_few_rows_ties_and_none(spark, monkeypatch):
    for rows in (rows_of(1), rows_of(5, 16), [(i, [0.1] * 20, 1) for i in range(90)], [(i, [i % 2 * 1.0] * 16, None) for i in range(300)]):
        assert ran(spark, rows, monkeypatch) == plain(rows)
    assert ran(spark, [], monkeypatch) == [] and ran(spark, [(1, None, 1)], monkeypatch) == []


def test_labels_are_texts_too(spark, monkeypatch):
    rows = [(i, v, None if g is None else f"label {g}") for i, v, g in rows_of(100)]
    assert ran(spark, rows, monkeypatch, "string") == plain(rows)


def test_bounds_skip_most_parts_once_entries_are_still():
    """Ten rounds on one block: codes as those of whole scans each time, fewer and fewer parts measured, sums as if counted anew."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(20, 64))[rng.integers(0, 20, 3000)] * 60 + rng.normal(size=(3000, 64)) * 9).astype(np.int32)
    block, d = op.Block(x), 4
    books = np.stack([x[:64, p * d : p * d + d] for p in range(16)]).astype(np.int64)
    drift, sums, looks = np.zeros((16, 64)), np.zeros((16, 64, d + 1), np.int64), []
    for _ in range(10):
        change, looked = block.assign(books, drift)
        sums += change
        looks.append(looked)
        again = op.Block.of(3000, 64, *block.state())
        assert again.heaps == block.heaps and (again.codes == block.codes).all()
        block = again
        for p in range(16):
            d2 = ((block.part(p)[:, None].astype(np.int64) - books[p][None]) ** 2).sum(2)
            assert (d2.argmin(1) == block.codes[:, p]).all()
            assert (np.bincount(block.codes[:, p], minlength=64) == sums[p, :, -1]).all()
        new = np.where(sums[..., -1:] > 0, sums[..., :-1] // np.maximum(sums[..., -1:], 1), books)
        drift, books = drift + op.drifts(books, new), new
    assert looks[0] == 48_000 and looks[-1] < 24_000


def test_large_components_are_exact():
    x = np.array([[op.MOST, -op.MOST], [op.MOST, 1 - op.MOST]], np.int32)
    assert op.distances(x, x.astype(np.int64)).tolist() == [[0, 1], [1, 0]]
    assert op.distances(x, -x.astype(np.int64))[0, 0] == 8 * op.MOST**2
