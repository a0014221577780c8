"""PDF pages as a data source, format "foliant_pdf": a row a page, rendered by a function that the caller names.

Options: root, a folder of PDF files; renderer, "module:function" (scans.Renderer), importable by executors; dpi (300); task_bytes (4 MB), the bytes of a file for
which one task is planned, so that the pages of a large file are shared among tasks. Filters on page and doc_id reach the source where
spark.sql.python.filterPushdown.enabled is set: files of other documents aren't opened and other pages aren't rendered."""

from __future__ import annotations

import importlib
import re
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from foliant.functions import plain
from foliant.sources.scans import RENDERED

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def doc_id(stem: str) -> str:
    """The document of a file's name without its ending, as scans.pdfs tells it."""
    return plain.spaced(re.sub(r'[\\/:*?"<>|\x00-\x1f]+', "_", stem)).strip(" .")


@dataclass
class Part(InputPartition):
    """The nth of so many equal parts of the pages of a file that are asked for."""

    doc_id: str
    path: str
    nth: int
    of: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.renderer = options["root"], options["renderer"]
        self.dpi, self.task = int(options.get("dpi", 300)), int(options.get("task_bytes", 4 << 20))
        if not 72 <= self.dpi <= 600:
            raise ValueError("dpi has to be between 72 and 600")
        self.first, self.last, self.pages, self.docs = 1, 1 << 30, None, None

    def pushFilters(self, filters):
        for f in filters:
            path = getattr(f, "attribute", ())
            column = path[0] if len(path) == 1 else ""
            some = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if column == "doc_id" and some is not None:
                self.docs = some if self.docs is None else self.docs & some
            elif column == "page" and some is not None:
                self.pages = some if self.pages is None else self.pages & some
            elif column == "page" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif column == "page" and isinstance(f, (LessThan, LessThanOrEqual)):
                self.last = min(self.last, f.value - isinstance(f, LessThan))
            yield f  # Spark checks rows, too

    def _store(self):
        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def partitions(self) -> list[Part]:
        store, folder = self._store()
        out = []
        for f in store.get_file_info(fs.FileSelector(folder, recursive=True)):
            doc = doc_id(f.base_name[:-4])
            if f.type == fs.FileType.File and f.extension.lower() == "pdf" and (self.docs is None or doc in self.docs):
                n = 1 if self.pages is not None and len(self.pages) == 1 else max(1, -(-f.size // self.task))
                out += [Part(doc, f.path, k, n) for k in range(n)]
        return out or [Part("", "", 0, 1)]

    def read(self, partition: Part):
        if not partition.path:
            return
        module, _, name = self.renderer.partition(":")
        store, _ = self._store()
        with store.open_input_file(partition.path) as f:
            content = f.read()
        try:
            count, page = getattr(importlib.import_module(module), name)(content, self.dpi)
        except Exception as e:  # a broken file is a row, not a lost task
            if partition.nth == 0:
                yield partition.doc_id, None, None, None, None, None, str(e)
            return
        asked = [n for n in range(max(1, self.first), min(count, self.last) + 1) if self.pages is None or n in self.pages]
        for n in asked[len(asked) * partition.nth // partition.of : len(asked) * (partition.nth + 1) // partition.of]:
            try:
                yield partition.doc_id, n, count, *page(n - 1), None
            except Exception as e:
                yield partition.doc_id, n, count, None, None, None, str(e)


class PdfPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "foliant_pdf"

    def schema(self) -> str:
        return RENDERED

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def pdf_pages(spark: SparkSession, root: str, renderer: str, dpi: int = 300, task_bytes: int = 4 << 20) -> DataFrame:
    """SRC1, SRC3: the pages of the PDF files below a folder; where("page between 2 and 5") and where("doc_id = 'x'") are what is rendered."""
    spark.dataSource.register(PdfPages)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format(PdfPages.name()).options(root=root, renderer=renderer, dpi=dpi, task_bytes=task_bytes).load()
