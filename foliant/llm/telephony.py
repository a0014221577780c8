"""Telephony audio as columns: companded samples in WAV containers, expansion by table, ADPCM blocks, resampled PCM.

store_payload() keeps any bytes losslessly as 8-bit mu-law samples of a WAV file; resample_media() stores the signal of such files as 16-bit PCM at twice the rate; read_media()
gives back the stored bytes, and describes the signal that they are when read as mu-law, as A-law and as IMA ADPCM blocks. All are
sums, extremes and filters of integers, so that equal payloads have equal results wherever they are computed.

Nulls: a null payload counts as empty; null or broken media give null columns. Rows are taken one by one, so ids may repeat, be null or tie, and empty tables give no rows. The
other columns stay, whatever their names; a column that has the name of a new one is replaced. Of media whose size is no multiple of FRAME, all bytes count as
payload; the last frame is described, and decoded as ADPCM, with zeros for what it lacks. Memory follows PIECE, beside the longest payload and its PCM themselves.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, small_batches, table, text_of
from .slices import replaced, sliced

RATE, UP, FRAME, PIECE = 8000, 2, 64, 1 << 20
PCM, ALAW, MULAW, IMA = 1, 6, 7, 17

# The step sizes of IMA ADPCM and what each code adds to the index.
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    power = code >> 4 & 7
    size = np.where(power > 0, ((code & 15) << 4) + 264 << np.maximum(power - 1, 0), ((code & 15) << 4) + 8)
    return np.where(code & 128, size, -size).astype(np.int16)


def _adpcm() -> tuple[np.ndarray, np.ndarray]:
    """What a code adds to the sample, and the next index, by 16 * index + code."""
    index, code = np.divmod(np.arange(len(STEPS) * 16), 16)
    step = STEPS[index]
    size = (step >> 3) + step * (code >> 2 & 1) + (step >> 1) * (code >> 1 & 1) + (step >> 2) * (code & 1)
    return np.where(code & 8, -size, size).astype(np.int32), (np.clip(index + MOVES[code & 7], 0, len(STEPS) - 1) * 16).astype(np.int32)


MULAW_TABLE, ALAW_TABLE = _mulaw(), _alaw()
_ADD, _NEXT = _adpcm()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks, one block a row: a header of sample, index and a spare byte, then two codes a byte, the low one first."""
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(body), len(blocks)), np.int16)
    out[0] = head
    for k, both in enumerate(body):
        for half, code in ((1, both & 15), (2, both >> 4)):
            at = index + code
            head = head + _ADD[at]
            np.clip(head, -32768, 32767, out=head)
            index = _NEXT[at]
            out[2 * k + half] = head
    return out.T


def write_wav(data: bytes, tag: int = MULAW, rate: int = RATE, width: int = 1) -> bytes:
    """A RIFF file of one channel; formats other than PCM have a fact chunk with the number of samples."""
    form = struct.pack("<HHIIHH", tag, 1, rate, rate * width, width, 8 * width) + (b"" if tag == PCM else b"\0\0")
    fact = b"" if tag == PCM else b"fact" + struct.pack("<II", 4, len(data) // width)
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + fact + b"data" + struct.pack("<I", len(data) & 0xFFFFFFFF)
    return b"".join((b"RIFF", struct.pack("<I", 4 + len(chunks) + len(data) + len(data) % 2 & 0xFFFFFFFF), b"WAVE", chunks, data, b"\0" * (len(data) % 2)))


def read_wav(media: bytes) -> tuple[int, int, memoryview] | None:
    """(format, rate, data), or None if it isn't such a file."""
    view = memoryview(media)
    if len(view) < 12 or view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack("<I", view[at + 4 : at + 8])[0]
        if name == b"fmt " and size >= 16:
            form = struct.unpack("<HHI", view[at + 8 : at + 16])
        elif name == b"data" and form:
            return (form[0], form[2], view[at + 8 : at + 8 + size]) if at + 8 + size <= len(view) else None
        at += 8 + size + size % 2
    return None


def expand(data: np.ndarray, tag: int) -> np.ndarray:
    """Samples of mu-law, A-law or ADPCM bytes."""
    if tag == IMA:
        whole = np.frombuffer(data.tobytes() + bytes(-len(data) % FRAME), np.uint8)
        return decode_adpcm(whole.reshape(-1, FRAME)).ravel()
    return (MULAW_TABLE if tag == MULAW else ALAW_TABLE)[data]


def resample(line: np.ndarray) -> np.ndarray:
    """Twice the rate by a half-band filter: the samples, and between neighbours a, b (-1 before, 9, 9, -1 after) / 16; the ends repeat."""
    out = np.empty(len(line) * UP, "<i2")
    out[::2] = line
    for a in range(0, len(line), PIECE):
        b = min(len(line), a + PIECE)
        at = np.arange(a - 1, b + 2).clip(0, len(line) - 1)
        x = line[at].astype(np.int32)
        out[2 * a + 1 : 2 * b : 2] = np.clip((9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4, -32768, 32767)
    return out


def _describe(payloads: list[memoryview]) -> list[str]:
    """A feature string for each payload; the payloads are taken together, long ones in pieces."""
    n = len(payloads)
    energy, peak, turns = np.zeros((3, n), np.int64), np.zeros((3, n), np.int64), np.zeros((3, n), np.int64)

    def run(pieces):
        """(payload, bytes), each of whole frames."""
        owner = np.array([i for i, _ in pieces])
        sizes = np.array([len(x) for _, x in pieces])
        data = np.frombuffer(b"".join(x for _, x in pieces), np.uint8)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        blocks = data.reshape(-1, FRAME)
        for k, x in enumerate((MULAW_TABLE[data], ALAW_TABLE[data], decode_adpcm(blocks))):
            frames = x.reshape(len(blocks), -1).astype(np.int32)
            sign = frames < 0
            at = starts // FRAME
            np.add.at(energy[k], owner, np.add.reduceat((frames.astype(np.int64) ** 2).sum(1), at))
            np.maximum.at(peak[k], owner, np.maximum.reduceat(np.abs(frames).max(1), at))
            np.add.at(turns[k], owner, np.add.reduceat((sign[:, 1:] != sign[:, :-1]).sum(1), at))
    held, size = [], 0
    for i, p in enumerate(payloads):
        for a in range(0, len(p), PIECE):
            piece = _padded(bytes(p[a : a + PIECE])) if len(p) - a < PIECE else p[a : a + PIECE]
            if held and size + len(piece) > PIECE:
                run(held)
                held, size = [], 0
            held.append((i, piece))
            size += len(piece)
    if held:
        run(held)
    names = ("mulaw", "alaw", "adpcm")
    return [";".join(f"{m}={energy[k, i]},{peak[k, i]},{turns[k, i]}" for k, m in enumerate(names)) for i in range(n)]


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % FRAME or (0 if data else FRAME))


def _store(batches):
    for batch in sliced(batches, -1):
        data = [x.as_py() or b"" for x in batch.column(batch.num_columns - 1).cast(pa.binary())]
        yield replaced(batch.select(batch.schema.names[:-1]), n_bytes=pa.array(map(len, data), pa.int64()), media=pa.array([write_wav(_padded(x)) for x in data], pa.binary()))


def _with(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    new = dict(fields)
    return T.StructType([*(T.StructField(f.name, f.dataType) for f in df.schema if f.name not in new), *(T.StructField(k, v) for k, v in fields)])


def store_payload(df: DataFrame, payload: str) -> DataFrame:
    """df without the payload column and with n_bytes and media: the payload's bytes, then zeros up to a positive multiple of FRAME, as 8-bit mu-law WAV."""
    small_batches(df.sparkSession)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (payload, "n_bytes", "media")]
    src = df.select(*rest, F.col(f"`{payload}`").cast("binary").alias("__payload"))
    return src.mapInArrow(_store, _with(src.drop("__payload"), ("n_bytes", T.LongType()), ("media", T.BinaryType())))


def _read(batches):
    for batch in sliced(batches, -1):
        media = [x.as_py() for x in batch.column(batch.num_columns - 1)]
        found = [read_wav(x) if x is not None else None for x in media]
        data = [x[2] if x and x[0] == MULAW else None for x in found]
        good = [i for i, x in enumerate(data) if x is not None]
        features: list = [None] * len(data)
        for i, text in zip(good, _describe([data[i] for i in good])):
            features[i] = text
        each = lambda f, kind, of=data: pa.array([None if x is None else f(x) for x in of], kind)
        yield replaced(
            batch.select(batch.schema.names[:-1]),
            payload_bytes=each(len, pa.int64()),
            payload_sha256=each(lambda x: hashlib.sha256(x).hexdigest(), pa.string()),
            tail_crc32=each(lambda x: zlib.crc32(x[-FRAME:]), pa.int64()),
            media_bytes=each(len, pa.int64(), media),
            media_sha256=each(lambda x: hashlib.sha256(x).hexdigest(), pa.string(), media),
            feature=pa.array(features, pa.string()),
        )


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """df without the media column and with what its stored bytes and its signals are."""
    new = (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))
    src = df.select(*(F.col(f"`{c}`") for c in df.columns if c != media and c not in dict(new)), F.col(f"`{media}`").alias("__media"))
    return src.mapInArrow(_read, _with(src.drop("__media"), *new))


def _resample(batches):
    for batch in sliced(batches, -1, 1 << 20):  # PCM is four times as long
        out = []
        for x in batch.column(batch.num_columns - 1):
            wav = read_wav(x.as_py()) if x.is_valid else None
            if wav is None or wav[0] not in (MULAW, ALAW, IMA):
                out.append(None)
                continue
            out.append(write_wav(resample(expand(np.frombuffer(wav[2], np.uint8), wav[0])).tobytes(), PCM, wav[1] * UP, 2))
        yield replaced(batch.select(batch.schema.names[:-1]), pcm=pa.array(out, pa.binary()))
    give_back()


def resample_media(df: DataFrame, media: str = "media") -> DataFrame:
    """df with pcm, the signal of the media (mu-law, A-law, or ADPCM in blocks of FRAME bytes) as 16-bit PCM WAV at twice the rate; other media give null."""
    src = df.select(*(F.col(f"`{c}`") for c in df.columns if c != "pcm"), F.col(f"`{media}`").alias("__media"))
    return src.mapInArrow(_resample, _with(src.drop("__media"), ("pcm", T.BinaryType())))


def op1_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of().cast("binary").alias("payload"))
    stored = resample_media(store_payload(docs, "payload"))
    stored = stored.withColumns({"pcm_bytes": F.length("pcm").cast("long"), "pcm_sha256": F.sha2("pcm", 256)}).drop("pcm")
    out = read_media(stored).withColumn("feature", F.concat("feature", F.lit(";pcm16k="), F.substring("pcm_sha256", 1, 16)))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256")
