"""Lattice near-dedup against all pairs: links, components, copies, repeated ids, odd vectors."""

import numpy as np
import pytest

from foliant.llm import lattice

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, threshold=0.93):
    """(id, n_links, component) of each row over distinct (id, label, vector)."""
    fit = lambda r: r[0] is not None and r[1] is not None and r[2] is not None and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])
    nodes = list(dict.fromkeys((i, y, tuple(v)) for i, v, y in filter(fit, rows)))
    n = len(nodes)
    near = np.zeros((n, n), bool)
    for d in {len(v) for _, _, v in nodes}:
        at = [k for k in range(n) if len(nodes[k][2]) == d]
        u = np.array([nodes[k][2] for k in at])
        u /= np.abs(u).max(axis=1)[:, None]
        u /= np.linalg.norm(u, axis=1)[:, None]
        y = np.array([nodes[k][1] for k in at])
        near[np.ix_(at, at)] = (u @ u.T >= threshold) & (y[:, None] == y)
    np.fill_diagonal(near, False)
    root = np.array([i for i, _, _ in nodes], np.int64)
    while n:
        new = np.minimum(root, np.where(near, root[None, :], 2**62).min(1))
        if (new == root).all():
            break
        root = new
    of = {x: (int(near[k].sum()), int(root[k])) for k, x in enumerate(nodes)}
    return sorted(((r[0], *(of[r[0], r[2], tuple(r[1])] if fit(r) else (0, r[0]))) for r in rows), key=str)


def found(spark, rows):
    return sorted(((r.id, r.n_links, r.component) for r in lattice.near_vectors(spark, spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def test_against_all_pairs(spark):
    g = np.random.default_rng(2)
    x = g.normal(size=(120, 16))
    x[30:60] = x[0] + g.normal(size=(30, 16)) * 0.15
    x[60:70] = x[1]  # copies
    rows = [(i, v.tolist(), int(i % 2 if i < 30 else i == 65)) for i, v in enumerate(x)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, x[0].tolist(), None), (204, [], 0), (205, [None] * 16, 0), (206, [float("inf")] + [1.0] * 15, 0), (None, x[0].tolist(), 0)]
    rows += [(207, x[0][:8].tolist(), 0), (208, (x[0][:8] * 1e-300).tolist(), 0), (209, (x[0] * 1e200).tolist(), 0)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[(2, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (3, [1.0, 2.0], 0)], [(2, [1.0, 2.0], 0), (2, [1.0, 2.1], 0), (3, [1.0, 2.05], 0), (4, [-1.0, 0.5], 0)], [(5, [1.0], 0)] * 4])
def test_repeated_ids(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_a_large_group_of_copies_is_one_class(spark):
    rows = [(i, [1.0, 2.0, 3.0], 7) for i in range(5000)] + [(6000, [1.0, 2.0, 3.1], 7)]
    got = found(spark, rows)
    assert {x[1:] for x in got} == {(5000, 0)} and len(got) == 5001


def test_empty_table(spark):
    assert found(spark, []) == []


def test_nearest_lattice_points():
    g = np.random.default_rng(5)
    x = g.normal(size=(200, 8)) * 2
    near = lattice.nearest(x)
    assert (((near * 2) % 2).sum(1) % 8 == 0).all() and (near.sum(1) % 2 == 0).all()
    assert ((x - near) ** 2).sum(1).max() <= 1 + 1e-9  # the covering radius
    for r in lattice.ROOTS:
        assert (((x - near) ** 2).sum(1) <= ((x - near - r) ** 2).sum(1) + 1e-9).all()
