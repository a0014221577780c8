"""Fill-in-the-middle: texts are cut at two units into prefix, middle and suffix, and put together again in another order.

Units are runs of ASCII letters and single other code points. They are counted over the UTF-8 bytes, a piece at a time; at every STRIDE units a checkpoint keeps
the number of units, bytes and code points so far. A cut is found by binary search among the checkpoints and a scan of the few units behind it, so no list of
units is ever made.

Defined results: a null text is empty; an empty text, one that holds a marker, and one whose draw says so stay as they are (plain); a null id draws as the empty
string does; equal rows give equal results; a table without rows gives none; other columns come along, and those called like results are replaced."""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, small_batches, table, text_of
from .slices import replaced, sliced

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Units between checkpoints, and bytes that are counted at once.
STRIDE, PIECE = 512, 1 << 18


def _starts(data: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Of UTF-8 bytes: whether a code point begins, and whether a unit does; before is the byte ahead of them (0: none)."""
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    after = np.empty(len(data), bool)
    after[:1] = 97 <= before | 32 <= 122
    after[1:] = letter[:-1]
    point = (data & 0xC0) != 0x80
    return point, point & ~(letter & after)


class Checkpoints:
    """Offsets of every STRIDE-th unit of a text: units, bytes and points are ascending lists; n and points_all count the whole."""

    def __init__(self, text: bytes, stride: int = STRIDE, piece: int = PIECE):
        self.text, self.units, self.bytes, self.points = text, [0], [0], [0]
        data, n, seen = np.frombuffer(text, np.uint8), 0, 0
        for at in range(0, len(data), piece):
            point, unit = _starts(data[at : at + piece], text[at - 1] if at else 0)
            where = np.flatnonzero(unit)
            nth = np.arange(-n % stride, len(where), stride)
            ahead = np.cumsum(point)
            for k in nth[(n + nth) > 0].tolist():
                self.units.append(n + k)
                self.bytes.append(at + int(where[k]))
                self.points.append(seen + int(ahead[where[k]]) - 1)
            n, seen = n + len(where), seen + int(ahead[-1])
        self.n, self.points_all = n, seen

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points before the unit of that number."""
        if units >= self.n:
            return len(self.text), self.points_all
        k = bisect.bisect_right(self.units, units) - 1
        at, points, left, before = self.bytes[k], self.points[k], units - self.units[k] + 1, 0
        while True:  # a unit may be long: 4 kB at a time
            point, unit = _starts(np.frombuffer(self.text, np.uint8, min(4096, len(self.text) - at), at), before)
            where = np.flatnonzero(unit)
            if left <= len(where):
                end = int(where[left - 1])
                return at + end, points + int(point[:end].sum())
            at, points, left, before = at + len(point), points + int(point.sum()), left - len(where), self.text[at + len(point) - 1]


def draws(key: str, salt: str = "1:") -> list[int]:
    name = hashlib.sha256((salt + key).encode()).hexdigest()
    return [int(name[8 * k : 8 * k + 8], 16) for k in range(4)]


def transformed(text: bytes, key: str, plain: int = 10, spm: int = 20) -> tuple[bytes, str, int, int | None, int | None]:
    """(output, form, units, code points of the prefix, of the middle); plain and spm are per cent."""
    index = Checkpoints(text)
    h1, h2, h3, h4 = draws(key)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - plain:
        return text, "plain", index.n, None, None
    (a, pa_), (b, pb) = map(index.cut, sorted((h1 % (index.n + 1), h2 % (index.n + 1))))
    first, middle, last = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < spm else "psm"
    out = (SUFFIX, last, PREFIX, first, MIDDLE, middle) if form == "spm" else (PREFIX, first, SUFFIX, last, MIDDLE, middle)
    return b"".join(out), form, index.n, pa_, pb - pa_


def restored(output: bytes, form: str) -> bytes:
    """The text behind an output; it holds no marker of its own where the form isn't plain, so each marker's first place is its own."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    b = output.index(second)
    c = output.index(MIDDLE, b)
    x, y, middle = output[len(first) : b], output[b + len(second) : c], output[c + len(MIDDLE) :]
    return y + middle + x if form == "spm" else x + middle + y


NEW = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}


def _transform(plain: int, spm: int):
    def run(batches):
        for batch in sliced(batches, -1):
            keys, texts = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            rows = [transformed(t.as_py(), k.as_py() or "", plain, spm) for k, t in zip(keys, texts)]
            out, form, n, first, middle = zip(*rows) if rows else ((),) * 5
            new = dict(n=pa.array(n, pa.int64()), form=pa.array(form, pa.string()), prefix_chars=pa.array(first, pa.int64()), middle_chars=pa.array(middle, pa.int64()), output=pa.array(out, pa.binary()).cast(pa.string()))
            yield replaced(batch.select(batch.schema.names[:-2]), **new)
        give_back()

    return run


def fill_in_middle(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain: int = 10, spm: int = 20, keep_text: bool = True) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output, which holds the text in the order that the form says; without the text column if it isn't to be kept."""
    small_batches(spark)
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in NEW and (keep_text or c != text_col)]
    src = docs.select(*keep, F.col(f"`{id_col}`").cast("string").alias("__key"), text_of(F.col(f"`{text_col}`")).cast("binary").alias("__text"))
    return src.mapInArrow(_transform(plain, spm), T.StructType([*src.schema.fields[:-2], *(T.StructField(k, t) for k, t in NEW.items())]))


def _restore(batches):
    for batch in sliced(batches, -1):
        out = [None if not t.is_valid else restored(t.as_py(), f.as_py()) for f, t in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1))]
        yield replaced(batch.select(batch.schema.names[:-2]), restored=pa.array(out, pa.binary()).cast(pa.string()))
    give_back()


def restore(spark: SparkSession, made: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """made with restored, the text behind each output."""
    small_batches(spark)
    keep = [F.col(f"`{c}`") for c in made.columns if c != "restored"]
    src = made.select(*keep, F.col(f"`{form}`").alias("__form"), F.col(f"`{output}`").cast("binary").alias("__output"))
    return src.mapInArrow(_restore, T.StructType([*src.schema.fields[:-2], T.StructField("restored", T.StringType())]))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    back = restore(spark, made)
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = r"""
with drawn as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
told as (select *, len(units) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from drawn),
formed as (select *, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form,
  least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from told),
cut as (select *, coalesce(array_to_string(units[1:a], ''), '') as p, coalesce(array_to_string(units[a + 1:b], ''), '') as m, coalesce(array_to_string(units[b + 1:], ''), '') as s from formed)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256
from cut
"""
