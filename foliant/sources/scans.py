"""Scanned documents: PDF files and page images as tables, with fingerprints and page ranges; a library that renders PDFs is handed in, none is needed to import this."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import scalar as S
from foliant.plans.dialect import SPARK

IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")
RENDERED = "doc_id string, page int, page_count int, png binary, width int, height int, error string"
#: Of a PDF's bytes and dpi: the number of pages, and a function from a page's number (from 0) to (png, width, height).
Renderer = Callable[[bytes, int], tuple[int, Callable[[int], tuple[bytes, int, int]]]]


def page_of(path: str | Column = "path") -> Column:
    """SRC6: the number of a page's file name: after a p, else its first digits, else 0."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^/.]*)?$", 1)
    return F.coalesce(F.nullif(F.regexp_extract(stem, r"p([0-9]+)", 1), F.lit("")), F.nullif(F.regexp_extract(stem, "([0-9]+)", 1), F.lit("")), F.lit("0")).cast("int")


def pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """SRC1, SRC2: (doc_id, path, size_bytes, sha256, content) of the PDF files below a folder; other files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.lower("path").endswith(".pdf"))
    stem = F.call_function("url_decode", F.replace(F.regexp_extract("path", r"([^/]+)\.[pP][dD][fF]$", 1), F.lit("+"), F.lit("%2B")))
    named = files.withColumn("stem", stem)
    return named.select(F.expr(S.doc_id(SPARK, "stem")).alias("doc_id"), "path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """SRC4: (page, path, content) of the image files of a folder, by path."""
    files = spark.read.format("binaryFile").load(folder).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGES))
    return files.select(page_of().alias("page"), "path", "content").orderBy("path")


def page_range(count: int, start: int | None = 1, end: int | None = None) -> list[int]:
    """SRC3: the pages start..end of so many; bounds outside of them raise."""
    first, last = start or 1, count if end is None else end
    if not 1 <= first <= count:
        raise ValueError(f"the first page has to be between 1 and {count}")
    if not first <= last <= count:
        raise ValueError(f"the last page has to be between {first} and {count}")
    return list(range(first, last + 1))


def rendered(files: DataFrame, renderer: Renderer, dpi: int = 300, start: int = 1, end: int | None = None) -> DataFrame:
    """SRC1: the pages of each PDF as images, a row a page; what can't be rendered is a row with an error. dpi has to be between 72 and 600. One page is held at a time."""
    if not 72 <= dpi <= 600:
        raise ValueError("dpi has to be between 72 and 600")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RENDERED.split(", ")]
        for batch in batches:
            for doc, content in zip(batch["doc_id"], batch["content"]):
                try:
                    count, page = renderer(content, dpi)
                    asked = page_range(count, start, end)
                except Exception as e:  # a broken file is a row, not a lost task
                    yield pd.DataFrame([(doc, None, None, None, None, None, str(e))], columns=names)
                    continue
                for n in asked:
                    try:
                        png, width, height = page(n - 1)
                        row = (doc, n, count, png, width, height, None)
                    except Exception as e:
                        row = (doc, n, count, None, None, None, str(e))
                    yield pd.DataFrame([row], columns=names)

    return files.select("doc_id", "content").mapInPandas(run, RENDERED)


def manifest(found: DataFrame, before: DataFrame | None, dpi: int, files: DataFrame | None = None) -> DataFrame:
    """JN15, SNK11: (doc_id, page, filename, status, ...) for the pages of found (doc_id, sha256, page_count). The entries of an earlier manifest (doc_id, sha256, page_count, dpi, page, status) count
    where fingerprint, pages and dpi are the same; those that are done need a file (doc_id, filename, size) of some size, else they are pending."""
    pages = found.select("doc_id", "sha256", "page_count", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page")).withColumn("dpi", F.lit(dpi))
    number = F.col("page").cast("string")
    pages = pages.withColumn("filename", F.concat(F.lit("p"), F.when(F.col("page") < 1000, F.lpad(number, 3, "0")).otherwise(number), F.lit(".png")))
    if before is None:
        return pages.withColumn("status", F.lit("pending"))
    keys = ["doc_id", "sha256", "page_count", "dpi", "page"]
    out = pages.join(before.select(*keys, F.col("status").alias("was")), keys, "left")
    there = files.where("size > 0").select("doc_id", "filename", F.lit(True).alias("there")) if files is not None else None
    out = out.join(there, ["doc_id", "filename"], "left") if there is not None else out.withColumn("there", F.lit(True))
    return out.withColumn("status", F.when((F.col("was") == "done") & F.col("there").isNull(), "pending").otherwise(F.coalesce("was", F.lit("pending")))).drop("was", "there")
