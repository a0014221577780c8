"""Artifacts of a document's pages as tables: decisions, names, metadata and places in JSON files named p<page>.<kind>.json, read by Spark as whole files.

A file that can't be read as JSON counts as absent, an alternate spelling of a key counts where the first is empty."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import columns as C
from foliant.functions import plain
from foliant.sources.scans import page_of

KINDS = ("classify", "names", "meta", "places")
DETAIL = {"name": "string", "page": "int"} | dict.fromkeys(plain.FIELDS, "string")
PLACE = {"name": "string", "page": "int", "place": "string", "order": "int"} | dict.fromkeys(("arrival_date", "date_confidence", "time_info", "evidence"), "string")
FACTS = {"status": "string", "named_people": "int", "model_calls": "int", "repair_calls": "int", "elapsed_seconds": "double", "note": "string"}
FILES = "doc_id string, page int, kind string, content string"


def _json(x: str | None):
    if not x:
        return None
    try:
        return json.loads(x.removeprefix("﻿"))
    except ValueError:
        return None


_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}


def _rows(pages: DataFrame, items, fields: dict[str, str], **keys: str) -> DataFrame:
    """The rows (fields) that items makes of the other columns of each page, beside its keys (a type each: doc_id, then the page) and ord. Rows come and go as columns of Arrow batches."""
    keep = len(keys)

    def made(batches):
        for batch in batches:
            own, ords, rows = [], [], []
            for i, values in enumerate(zip(*(c.to_pylist() for c in batch.columns[keep - 1 :]))):
                found = items(*values)
                own += [i] * len(found)
                ords += range(len(found))
                rows += found
            at = pa.array(own, pa.int64())
            columns = [c.take(at) for c in batch.columns[:keep]] + [pa.array(ords, pa.int32())] + [pa.array([r[f] for r in rows], _ARROW[t]) for f, t in fields.items()]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "ord", *fields])

    return pages.mapInArrow(made, ", ".join(f"`{k}` {t}" for k, t in (keys | {"ord": "int"} | fields).items()))


is_object = C.arrow(lambda x: isinstance(_json(x), dict), "boolean")
is_json = C.arrow(lambda x: x is not None and (x.strip() == "null" or _json(x) is not None), "boolean")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """SRC8, SRC9: (doc_id, page, kind, content) of the files p<page>.<kind>.json or p<page>.json below folder/<doc_id>/; pages have three digits at least."""
    files = spark.read.option("pathGlobFilter", "p*.json").option("recursiveFileLookup", "true").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    found = files.select(F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1).alias("doc_id"), F.regexp_extract(path, r"/(p[0-9]{3,}(?:\..+)?\.json)$", 1).alias("file"), F.col("value").alias("content")).where("file <> ''")
    doc = F.call_function("url_decode", F.replace(F.col("doc_id"), F.lit("+"), F.lit("%2B")))
    return found.select(doc.alias("doc_id"), F.regexp_extract("file", "^p([0-9]+)", 1).cast("int").alias("page"), F.regexp_extract("file", r"^p[0-9]+\.(.+)\.json$", 1).alias("kind"), "content")


def pages(files: DataFrame) -> DataFrame:
    """SET4: the pages that have any artifact."""
    return files.select("doc_id", "page").distinct()


def _of(files: DataFrame, kind: str) -> DataFrame:
    return files.where(F.col("kind") == kind).select("doc_id", "page", "content")


def details(files: DataFrame) -> DataFrame:
    """SRC10, SRC11: rows of metadata artifacts: doc_id, file_page, ord, name, page and the fields."""
    return _rows(_of(files, "meta"), lambda page, x: plain.detail_items(_json(x), page), DETAIL, doc_id="string", file_page="int")


def places(files: DataFrame) -> DataFrame:
    """SRC12: rows of place artifacts: those of the page, of its people, and an empty one for each person without any."""
    return _rows(_of(files, "places"), lambda page, x: plain.place_items(_json(x), page), PLACE, doc_id="string", file_page="int")


def facts(files: DataFrame) -> DataFrame:
    """What the status row of each page takes from its decision and its names; pages without either have no status, no people and no calls."""
    by = files.groupBy("doc_id", "page").agg(*(F.max(F.when(F.col("kind") == k, F.col("content"))).alias(k) for k in ("classify", "names")))
    return _rows(by, lambda page, classify, names: [plain.page_facts(_json(classify), _json(names))], FACTS, doc_id="string", page="int").drop("ord")


def named(files: DataFrame) -> DataFrame:
    """The candidates that names artifacts hold: doc_id, page, ord, name, evidence."""
    people = C.arrow(lambda x: [{"name": str(p.get("name") or ""), "evidence": str(p.get("evidence") or "")} for p in plain.rows_of(_json(x), "named_people") if isinstance(p, dict)], f"array<{C.PERSON}>")
    rows = _of(files, "names").select("doc_id", "page", F.posexplode(people("content")).alias("ord", "p"))
    return rows.select("doc_id", "page", "ord", "p.name", "p.evidence")


def decisions(files: DataFrame) -> DataFrame:
    """FLT1, FLT3: (doc_id, page, should_extract, report_type, evidence); should_extract holds for whatever isn't empty, zero, false or missing (Q10)."""
    told = C.arrow(lambda x: {"should_extract": bool(d.get("should_extract")), "skip_reason": d.get("skip_reason") and str(d["skip_reason"]), "report_type": d.get("report_type") and str(d["report_type"]), "evidence": plain.first_words(d.get("evidence"))} if isinstance(d := _json(x), dict) else None, C.PAGE)
    return _of(files, "classify").select("doc_id", "page", told("content").alias("d")).select("doc_id", "page", "d.*")


def extractable(pages: DataFrame, decisions: DataFrame, stage: str) -> DataFrame:
    """FLT3: pages with the report type that a stage works with, and why one can't be worked on (error). Metadata takes any unknown type as a statement; the other stages take a missing one as correspondence."""
    both = pages.join(decisions, ["doc_id", "page"], "left")
    kind = C.allowed("report_type", plain.S.REPORT_TYPES) if stage == "meta" else F.coalesce(F.nullif("report_type", F.lit("")), F.lit("correspondence"))
    kind = F.coalesce(F.nullif(kind, F.lit("")), F.lit("statement")) if stage == "meta" else kind
    error = F.when(F.col("should_extract").isNull(), "missing decision").when(~F.col("should_extract"), "page is not extractable")
    return both.withColumns({"report_type": kind, "error": error})


def is_valid(kind: str, content: Column, size: Column) -> Column:
    """SRC18: text that isn't blank, JSON that can be read, or any file of some size."""
    if kind in ("text", "ocr_text"):
        return F.coalesce(C.spaced(content) != "", F.lit(False))
    return is_json(content) if kind == "json" else F.coalesce(size > 0, F.lit(False))


def resumed(pages: DataFrame, files: DataFrame, kind: str) -> DataFrame:
    """JN4, ST6: pages without a valid artifact of a kind."""
    done = _of(files, kind).where(is_json("content")).select("doc_id", "page")
    return pages.join(done, ["doc_id", "page"], "left_anti")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """SRC5, SRC6: (doc_id, page, text) of the files p*.txt below folder/<doc_id>/; bytes that are no UTF-8 become marks."""
    files = spark.read.option("pathGlobFilter", "p*.txt").option("recursiveFileLookup", "true").format("binaryFile").load(folder)
    text = C.arrow(lambda b: (b or b"").decode("utf-8", "replace"), "string")("content")
    return files.select(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("doc_id"), page_of("path").alias("page"), text.alias("text"))


def listing(files: DataFrame) -> DataFrame:
    """SRC17: documents with how many pages and people they have."""
    people = named(files).groupBy("doc_id").agg(F.countDistinct(F.lower(F.trim("name"))).alias("people"))
    return pages(files).groupBy("doc_id").agg(F.count("*").alias("pages")).join(people, "doc_id", "left").select("doc_id", "pages", F.coalesce("people", F.lit(0)).alias("people"))
