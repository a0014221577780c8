"""Byte-level BPE with a given vocabulary: encoding by a contiguous rank array, and decoding.

A word's parts lie in one array of boundaries beside one of the ranks of neighbouring parts. The least rank is sought by a scan, its
boundary deleted and the two ranks beside it refreshed. Words of over SHORT bytes, for which scans cost their square, use a heap
over the same parts. Words repeat, so each worker keeps those seen last, up to 2 * WORDS of them, with their ids.

Nulls in text: empty, with no ids; null ids decode to null. Ids of rows may repeat or be null, and rows that repeat are encoded alike: rows are taken one by one. Empty
tables give no rows. A long text takes memory in step with its own length. Other columns stay, whatever their names; a column with the name of a new one is replaced.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, small_batches, table
from .slices import replaced, sliced

SHORT, WORDS = 96, 150_000
#: Stands for the rank of a pair that doesn't merge.
NONE = 1 << 60
#: Fixed value: the pattern that byte-level BPE splits text by.
PATTERN = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte: itself if it prints, else the next free one from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe(dict):
    """From word to the bytes of its ids (32-bit); missing words are encoded and kept. Of WORDS words and more, those not asked for since the last WORDS new ones go."""

    def __init__(self, spec: str):
        super().__init__()
        loaded = json.loads(spec)
        model, signs = loaded["model"], _byte_signs()
        vocab = model["vocab"]
        self.older: dict[str, bytes] = {}
        self.of_byte = [0] * 256
        for sign, b in signs.items():
            self.of_byte[b] = vocab[sign]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merged, self.ranks = [], {}
        for rank, (a, b) in enumerate(pairs):
            self.ranks[vocab[a], vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.first = {(a, b): self.ranks.get((a, b), NONE) for a in self.of_byte for b in self.of_byte}
        self.bytes_of = {i: (bytes(signs[c] for c in t) if all(c in signs for c in t) else t.encode()) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in loaded.get("added_tokens", ())}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.decimal = {i: b"%d" % i for i in self.bytes_of}
        self.words = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            parts = [self.of_byte[b] for b in word.encode("utf-8", "replace")]
            if len(parts) > SHORT:  # long words seldom come again
                return array("i", self.merge_long(parts)).tobytes()
            ids = array("i", self.merge(parts)).tobytes()
        if len(self) >= WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def merge(self, parts: list[int]) -> list[int]:
        get, merged = self.ranks.get, self.merged
        ranks = list(map(self.first.__getitem__, zip(parts, parts[1:])))
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            at = ranks.index(least)
            one = merged[least]
            parts[at : at + 2] = [one]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = get((one, parts[at + 1]), NONE)
            if at:
                ranks[at - 1] = get((parts[at - 1], one), NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := get((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
            if (h := before[i]) >= 0 and (r := get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> bytes:
        """The text's ids as bytes; special tokens in it count as such."""
        find = self.words.findall
        if self.specials is None or not self.specials.search(text):
            return b"".join(map(self.__getitem__, find(text)))
        out = []
        for k, piece in enumerate(self.specials.split(text)):
            out.append(np.int32(self.special[piece]).tobytes() if k % 2 else b"".join(map(self.__getitem__, find(piece))))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """Ids that the vocabulary doesn't have are left out."""
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")

    def digests(self, ids: list[int]) -> tuple[str, str]:
        """SHA-256 of the ids in decimal, joined by commas, and of the text that they decode to."""
        listed = b",".join([self.decimal[i] for i in ids])
        return hashlib.sha256(listed).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


@functools.lru_cache(2)
def _bpe(spec: str) -> Bpe:
    return Bpe(spec)


def _encode(spec, new: tuple[str, ...]):
    def run(batches):
        bpe = _bpe(spec.value)
        for batch in sliced(batches, -1):
            texts = batch.column(batch.num_columns - 1)
            made: dict[str, list] = {name: [] for name in new}
            for x in texts:
                ids = bpe.encode(x.as_py() or "")
                if "ids" in made:
                    made["ids"].append(ids)
                if "n_tokens" in made:
                    made["n_tokens"].append(len(ids) // 4)
                listed = array("i", ids).tolist() if {"decoded", "ids_sha256"} & made.keys() else []
                if "decoded" in made:
                    made["decoded"].append(bpe.decode(listed))
                if "ids_sha256" in made:
                    a, b = bpe.digests(listed)
                    made["ids_sha256"].append(a)
                    made["decoded_sha256"].append(b)
            if "ids" in made:
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in made["ids"]])]).astype(np.int32)
                made["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made["ids"]), np.int32)))
            kinds = {"decoded": pa.string(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
            yield replaced(batch.select(batch.schema.names[:-1]), **{k: v if k == "ids" else pa.array(v, kinds[k]) for k, v in made.items()})
        give_back()

    return run


def _decode(spec):
    def run(batches):
        bpe = _bpe(spec.value)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for a in range(0, len(column), 1000):
                part = batch.slice(a, 1000)
                texts = [bpe.decode(x.values.to_numpy().tolist()) if x.is_valid else None for x in column.slice(a, 1000)]
                yield replaced(part, decoded=pa.array(texts, pa.string()))

    return run


def _spec(spark: SparkSession, path: str):
    """The vocabulary file's text, read by the driver: its size is fixed."""
    small_batches(spark)
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_column(df: DataFrame, path: str, text: str = "text", ids: bool = True, decoded: bool = False, digests: bool = False) -> DataFrame:
    """df without the text column and with ids, an array of its token ids; with decoded, what those ids decode to; with digests, n_tokens and the SHA-256 of
    the ids in decimal, joined by commas (ids_sha256), and of the decoded text (decoded_sha256). All are made in the same worker."""
    kinds = {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    new = [k for k in kinds if {"ids": ids, "decoded": decoded}.get(k, digests)]
    src = df.select(*(F.col(f"`{c}`") for c in df.columns if c != text and c not in new), F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in src.schema[:-1]), *(T.StructField(k, kinds[k]) for k in new)])
    return src.mapInArrow(_encode(_spec(df.sparkSession, path), tuple(new)), schema)


def decode_column(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """df with decoded, the text of its ids; the ids come last but that."""
    src = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in (ids, "decoded")), F.col(f"`{ids}`").cast("array<int>").alias(ids))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in src.schema), T.StructField("decoded", T.StringType())])
    return src.mapInArrow(_decode(_spec(df.sparkSession, path)), schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_column(docs, vocabulary_file(), ids=False, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
