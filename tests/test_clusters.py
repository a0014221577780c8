"""First-fit clusters against plain ones: of one document with many spellings, of many documents, and by every way of dealing names out."""

import random
import time

import numpy as np
import pytest

from foliant.functions import plain
from foliant.operators import clusters as C

FIRST = "mariam marium maryam miriam faraj farraj faraji juma jumah said saeed salim saleem ali aly khamis khamees abdulla abdullah abdallah yusuf yousuf yousof mubarak mabruk bilal almas zaid zayd".split()
LAST = "said salim yusuf muhammad mohamed ahmad ahmed hasan hassan zanzibari swahili nubi habashi juma khamis nasib feruz".split()


def spellings(n, seed=1, letters="abcdefghijklmnopqrstuvwxyz", first=FIRST):
    rng, out = random.Random(seed), {}
    while len(out) < n:
        words = [rng.choice(first), *(x for _ in range(rng.randint(0, 3)) for x in (rng.choice(["bin", "bint", "al", ""]), rng.choice(LAST)) if x)]
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            k = rng.randrange(len(words))
            at = rng.randrange(len(words[k]) + 1)
            words[k] = words[k][:at] + rng.choice(letters) + words[k][at + rng.randint(0, 1) :]
        out.setdefault(plain.name(" ".join(words)), None)
    return [n for n in out if n]


def first_fit(names):
    return {names[i]: names[c[0]] for c in plain.clusters(names) for i in c}


def ran(spark, rows):
    made = C.canonical_names(spark.createDataFrame(rows, "doc_id string, ord long, name string, begun int, word string")).collect()
    assert len({(r.doc_id, r.name) for r in made}) == len(made)
    return {(r.doc_id, r.name): r.canonical for r in made}


def test_one_large_document_is_dealt_out(spark, monkeypatch):
    """Chunks of 60 names: hot first words meet chunk by chunk."""
    monkeypatch.setattr(C, "CHUNK", 60)
    names = spellings(900)
    want = first_fit(names)
    rows = [("d", k, n, 1, "x") for k, n in enumerate(names)] + [("d", 5000 + k, n, 1, None) for k, n in enumerate(names[:100])] + [("d", 1, None, 1, ""), ("d", 0, "", 1, "")]
    random.Random(2).shuffle(rows)
    assert ran(spark, rows) == {("d", n): c for n, c in want.items()}
    assert len(set(want.values())) < len(want)


def test_large_and_small_documents_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 40)
    docs = {f"d{k}": spellings(n, seed=k, first=FIRST[:k + 3]) for k, n in enumerate((1, 5, 39, 40, 41, 120))} | {None: spellings(7, 9)}
    rows = [(d, k * 3, n, 1, "") for d, names in docs.items() for k, n in enumerate(names)]
    assert ran(spark, rows) == {(d, n): c for d, names in docs.items() if d is not None for n, c in first_fit(names).items()} | {(None, n): c for n, c in first_fit(docs[None]).items()}


def test_chains_of_names_join_the_first_cluster_that_they_reach(spark, monkeypatch):
    """Each name matches the one before alone; the last ones match two clusters and join the earlier."""
    monkeypatch.setattr(C, "CHUNK", 4)
    names = [plain.name(f"Faraj {'abcdefghijklmnopqrstuvwxyz'[k : k + 12]}") for k in range(12)] + ["Zubair", "Zubairu bin Faraj"]
    order = random.Random(4).sample(range(len(names)), len(names))
    mixed = [names[k] for k in order]
    assert ran(spark, [("d", k, n, 1, "") for k, n in enumerate(mixed)]) == {("d", n): c for n, c in first_fit(mixed).items()}


@pytest.mark.parametrize("letters", ["ae", "abcdefghijklmnopqrstuvwxyz", "éß漢ا'.-"])
def test_bounds_exclude_no_match(letters):
    names = spellings(150, 3, letters) + ["Ali", "Ali Al", "Al", "Bin", "A", "Ali Muhammadali", "Khalid Al Ali", "Ali " * 90 + "Said"]
    names = [plain.name(n) for n in dict.fromkeys(names)]
    may = C.Names(names).may_match(C.Names(names))
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            assert may[i, j] or not plain.same_person(a, b), (a, b)
    assert may.mean() < 0.6


def test_no_rows(spark):
    assert ran(spark, []) == {}


def test_pairs_are_cut_before_letters_are_compared():
    names = spellings(2000, 5)
    begin = time.time()
    later, earlier = C.links(names, np.arange(len(names)))
    took = time.time() - begin
    assert (later > earlier).all() and took < 60
    rng = random.Random(1)
    found = set(zip(later.tolist(), earlier.tolist()))
    for _ in range(3000):
        i, j = sorted(rng.sample(range(len(names)), 2))
        assert ((j, i) in found) == plain.same_person(names[j], names[i])


def test_names_of_one_place_in_the_order(spark, monkeypatch):
    """Equal ord: the first by letter counts as the earlier, in small documents and in large ones."""
    names = sorted(spellings(90, 6))
    want = first_fit(names)
    for chunk in (2048, 30):
        monkeypatch.setattr(C, "CHUNK", chunk)
        assert ran(spark, [("d", 7, n, 1, "") for n in names]) == {("d", n): c for n, c in want.items()}
