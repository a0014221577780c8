"""Personal data: base spans against plain Python, estimated reliabilities, what the classifier takes and leaves, redaction."""

import random
import re

import pytest

from foliant.llm import pii

rng = random.Random(11)
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "", re.A) if holds(k, m.group())]


def card():
    d = [rng.randrange(10) for _ in range(15)]
    s = sum(sum(divmod(2 * c, 10)) if i % 2 == 0 else c for i, c in enumerate(reversed(d)))
    return "".join(map(str, d)) + str(-s % 10)


def ip():
    return ".".join(str(rng.randrange(256)) for _ in range(4))


ODD = [None, "", "no data", "a@b", "a@b.c", "x@y@z.de", "1.2.3.4.5.6.7.8", "300.1.1.1 0255.1.2.3", "+1 (743) 555-3824 and +12", "4111 1111 1111 1111-", "é😀 " + card() + " é", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.3.4", "+1 (555) 555-0100. +12345678", "9" * 20000]
LONG = "é ".join(f"{ip()}, m{i}@mail.example.com {card()}" for i in range(700))
MIXED = ["".join(rng.choice(["a", "@", ".", "1", "2.", "+3", "-", " ", "\n", "(", "b.c", "55.6.7.8", "x@y.zz"]) for _ in range(60)) for _ in range(200)]


def test_base_spans(spark):
    texts = [*ODD, *MIXED, LONG, LONG]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, email string")
    got = {r.doc_id: ([(x.kind, x.s, x.e) for x in r.found if x.kind in pii.BASE], r.email) for r in pii.find(df).collect()}
    assert got == {i: (base(t), "kept") for i, t in enumerate(texts)}


def test_reliabilities_of_simulated_votes():
    truth = [(0.05, 0.9), (0.2, 0.7), (0.1, 0.8), (0.3, 0.6)]
    counts = {}
    for _ in range(20_000):
        hit = rng.random() < 0.35
        p = tuple(-1 if rng.random() < 0.2 else int(rng.random() < t[hit]) for t in truth)
        counts[p] = counts.get(p, 0) + 1
    share, rate, post = pii.reliabilities(counts)
    assert abs(share - 0.35) < 0.03
    assert all(abs(a - b) < 0.05 for t, r in zip(truth, rate) for a, b in zip(t, r))
    assert post[1, 1, 1, 1] > 0.95 and post[0, 0, 0, 0] < 0.05


def test_ends_of_sentences(spark):
    """A sign after a candidate belongs to the sentence; runs that are too short without it are none."""
    ids = ["123-45-6789", "DE89370400440532013000", "a@localhost", "13.12.1970"]
    hits = [(f"His {cue} is: {cue} {v}", end) for cue in ("ssn", "account", "contact", "born") for v in ids for end in (".", ":", "-", "...", ". Then", "")]
    texts = [a + end for a, end in hits] + [f"see {w} v1.2.34{end}" for w in ("version", "release", "section") for end in (".", "")] * 4 + ["no 12-. no 1. no 123456."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(x.s, x.e) for x in r.found if x.kind == "id"] for r in pii.find(docs).collect()}
    assert all(got[i] == [(a.rindex(" ") + 1, len(a))] for i, (a, _) in enumerate(hits))
    assert not any(got[i] for i in range(len(hits), len(texts) - 1))
    tried = pii.scanned(docs).where(f"row.doc_id = {len(texts) - 1}").first()
    assert [x.v for x in tried["id"]] == ["123456"]


HEX = "0123456789abcdef"
GOOD = [
    *((f'red green token = "{"".join(rng.choice(HEX) for _ in range(40))}" blue', "id") for _ in range(12)),
    *((f"His SSN is {rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}. Then", "id") for _ in range(12)),
    *((f"account DE{rng.randrange(10, 99)}37040044{rng.randrange(10**9, 10**10)}.", "id") for _ in range(12)),
    *((f"with a password={''.join(rng.choice(HEX) for _ in range(17))}7 set", "id") for _ in range(12)),
    *((f"Dear {g} {f}, we met", "name") for g in ("Anna", "Peter", "Fatima", "Thomas") for f in ("Winterhill", "Okafor", "Lindqvist")),
    *((f"the patient Mr. {g} Moore said", "name") for g in ("James", "Robert", "Ahmed")),
]
DECOYS = [
    *(f"Version {a}.{b} of the release" for a in range(1, 5) for b in range(5)),
    *(f"see section {n} and page {n + 100}" for n in range(200, 220)),
    *("under the Apache License of the General Public License" for _ in range(8)),
    *(f"in the United States in chapter 1{n}" for n in range(100, 110)),
    "In 1999 and 2004 there was the Creative Commons Foundation",
]


def test_classifier_takes_planted_data_and_leaves_decoys(spark):
    rows = [(i, t) for i, t in enumerate([*(t for t, _ in GOOD), *DECOYS])]
    found = {r.doc_id: [x.kind for x in r.found] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = [found[i] == [kind] for i, (_, kind) in enumerate(GOOD)]
    alarms = [found[len(GOOD) + i] for i in range(len(DECOYS)) if found[len(GOOD) + i]]
    assert sum(caught) >= 0.95 * len(GOOD), [GOOD[i] for i, c in enumerate(caught) if not c]
    assert not alarms


def cut(text, spans):
    out, at, spans = [], 0, sorted((s, e, k) for k, s, e in spans)
    while spans:
        s, e, k = spans.pop(0)
        while spans and spans[0][0] < e:
            e = max(e, spans.pop(0)[1])
        out += [text[at:s], f"[{k}]"]
        at = e
    return "".join(out) + text[at:]


def test_redaction(spark):
    texts = [*ODD, *MIXED, LONG, "1.2.3.4@example.com 4111111111111111@b.cc"]
    df = spark.createDataFrame([(i, t, i, None) for i, t in enumerate(texts)], "doc_id long, text string, found long, row string")
    spans = {r.doc_id: [(x.kind, x.s, x.e) for x in r.found] for r in pii.find(df.select("doc_id", "text")).collect()}
    rows = pii.redacted(df).collect()
    assert pii.redacted(df).columns == df.columns
    assert {r.doc_id: r.text for r in rows} == {i: t if t is None else cut(t, spans[i]) for i, t in enumerate(texts)}
    assert all(r.found == r.doc_id for r in rows)


@pytest.mark.parametrize("run", [pii.find, pii.redacted])
def test_empty_and_null_tables(spark, run):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert run(df).collect() == []
    nulls = spark.createDataFrame([(None, None), (1, None), (1, "a@b.cc"), (1, "a@b.cc")], "doc_id long, text string")
    assert run(nulls).count() == 4
