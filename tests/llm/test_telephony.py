"""Telephony audio: stored bytes come back; companding against formulas, ADPCM and resampling against scalar versions."""

import hashlib
import random
import struct
import zlib

import numpy as np

from foliant.llm import telephony as t

rng = random.Random(3)
TEXTS = [None, "", "a", "a" * 63, "a" * 64, "a" * 65, "é😀 漢字", "ab" * 300, "".join(rng.choice("abc é\n") for _ in range(1_300_000)), "ab" * 300]


def mulaw(code):
    """G.711 without a table: sign, exponent and mantissa of the inverted byte."""
    c = ~code & 255
    size = ((2 * (c % 16) + 33) << (c // 16 % 8)) - 33
    return -4 * size if c >= 128 else 4 * size


def alaw(code):
    c = code ^ 0x55
    power, low = c // 16 % 8, 2 * (c % 16) + 1
    size = low if power == 0 else (low + 32) << (power - 1)
    return 8 * size if c >= 128 else -8 * size


def adpcm(block):
    """One IMA block, a code at a time."""
    value, index = struct.unpack("<h", block[:2])[0], min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step, add = int(t.STEPS[index]), int(t.STEPS[index]) >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                add += part if code & bit else 0
            value = max(-32768, min(32767, value - add if code & 8 else value + add))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(value)
    return out


def resampled(line):
    at = lambda i: line[max(0, min(len(line) - 1, i))]
    return [y for i, x in enumerate(line) for y in (x, max(-32768, min(32767, (9 * (x + at(i + 1)) - at(i - 1) - at(i + 2) + 8) >> 4)))]


def described(samples, frame):
    rows = [samples[a : a + frame] for a in range(0, len(samples), frame)]
    return f"{sum(x * x for x in samples)},{max(map(abs, samples))},{sum((a < 0) != (b < 0) for r in rows for a, b in zip(r, r[1:]))}"


def test_companding():
    assert t.MULAW_TABLE.tolist() == [mulaw(c) for c in range(256)]
    assert t.ALAW_TABLE.tolist() == [alaw(c) for c in range(256)]


def test_adpcm_across_blocks():
    blocks = [bytes(rng.randrange(256) for _ in range(64)) for _ in range(50)] + [bytes(64), b"\xff" * 64, b"\x00\x80" + b"\x77" * 62]
    got = t.decode_adpcm(np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 64))
    assert got.tolist() == [adpcm(b) for b in blocks]


def test_resampling(monkeypatch):
    for n in (1, 2, 3, 100, 1001):
        line = [rng.choice([-32768, 32767, 0, 5]) for _ in range(n)]
        for piece in (7, 1 << 20):
            monkeypatch.setattr(t, "PIECE", piece)
            assert t.resample(np.array(line, np.int16)).tolist() == resampled(line)


def test_stored_bytes_come_back(spark):
    src = spark.createDataFrame([(i, x, "kept") for i, x in enumerate(TEXTS)], "doc_id long, text string, feature2 string").selectExpr("doc_id", "cast(text as binary) as payload", "feature2")
    stored = t.store_payload(src, "payload")
    rows = {r.doc_id: r for r in t.read_media(t.resample_media(stored)).collect()}
    media = {r.doc_id: r.media for r in stored.collect()}
    for i, x in enumerate(TEXTS):
        b = (x or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature2) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), "kept")
        assert (r.media_bytes, r.media_sha256) == (len(media[i]), hashlib.sha256(media[i]).hexdigest())
        form, rate, data = t.read_wav(r.pcm)
        line = [mulaw(c) for c in p]
        assert (form, rate, len(data)) == (t.PCM, 16000, 4 * len(p))
        if len(p) < 10_000:
            assert np.frombuffer(data, "<i2").tolist() == resampled(line)
            blocks = [y for a in range(0, len(p), 64) for y in adpcm(p[a : a + 64])]
            assert r.feature == f"mulaw={described(line, 64)};alaw={described([alaw(c) for c in p], 64)};adpcm={described(blocks, len(blocks) * 64 // len(p))}"
    assert rows[7].feature == rows[9].feature


def test_foreign_and_broken_media(spark):
    data = bytes(rng.randrange(256) for _ in range(150))
    files = [t.write_wav(data), t.write_wav(data, t.ALAW), t.write_wav(data, t.IMA), t.write_wav(data, t.PCM, width=2), None, b"", b"RIFF1234WAVE", t.write_wav(data)[:-1]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(files)], "id long, media binary")
    got = {r.id: r for r in t.read_media(rows).collect()}
    assert got[0].payload_bytes == 150 and got[0].payload_sha256 == hashlib.sha256(data).hexdigest() and got[0].tail_crc32 == zlib.crc32(data[-64:])
    assert all(got[i].payload_bytes is None and got[i].feature is None for i in range(1, 8))
    pcm = {r.id: r.pcm for r in t.resample_media(rows).collect()}
    whole = data + bytes(42)
    want = [[mulaw(c) for c in data], [alaw(c) for c in data], [y for a in range(0, 192, 64) for y in adpcm(whole[a : a + 64])]]
    assert [np.frombuffer(t.read_wav(pcm[i])[2], "<i2").tolist() for i in range(3)] == [resampled(x) for x in want]
    assert all(pcm[i] is None for i in range(3, 8))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, payload binary")
    out = t.read_media(t.resample_media(t.store_payload(df, "payload")))
    assert out.collect() == [] and {"doc_id", "pcm", "feature", "media_sha256"} <= set(out.columns)
