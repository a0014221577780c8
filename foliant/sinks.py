"""Where tables go: JSON and CSV files that are there whole or not at all, folders that Spark commits, and what may be cleared."""

from __future__ import annotations

import csv
import io
import json
import os
import shutil
import tempfile
import zipfile
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import plain
from foliant.operators.aggregate import PLACE


def write_text(path: str | Path, text: str) -> None:
    """SNK1: a file beside the target takes its name at the end."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, made = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with open(handle, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        os.chmod(made, 0o644)
        os.replace(made, path)
    except BaseException:
        Path(made).unlink(missing_ok=True)
        raise


def write_json(path: str | Path, value) -> None:
    """SNK2: two blanks a level, signs beyond ASCII as they are."""
    write_text(path, json.dumps(value, indent=2, ensure_ascii=False))


def csv_text(rows: Iterable[Mapping], columns: Iterable[str]) -> str:
    """SNK3: a header, the columns alone, empty for what is missing, CRLF line ends, quotes where needed."""
    out = io.StringIO()
    writer = csv.DictWriter(out, list(columns), restval="", extrasaction="ignore")
    writer.writeheader()
    writer.writerows({k: "" if v is None else v for k, v in r.items()} for r in rows)
    return out.getvalue()


def write_csv(rows: DataFrame, folder: str, columns: Iterable[str], order: Iterable[str] = ()) -> None:
    """SNK3 for large tables: CSV parts that Spark writes, each with a header, sorted over all parts if an order is given."""
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns]
    sorted_rows = rows.orderBy(*order) if order else rows
    sorted_rows.select(*text).write.mode("overwrite").options(header=True, escape='"', emptyValue="", nullValue="", lineSep="\r\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)


def local_rows(rows: DataFrame, order: Iterable[str]) -> Iterable[dict]:
    """The rows of one document, a partition at a time."""
    return (r.asDict() for r in rows.orderBy(*order).toLocalIterator())


def zipped(path: str | Path, files: Iterable[str | Path]) -> None:
    """SNK5: the files that are there, by name."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in map(Path, files):
            if f.exists():
                z.write(f, f.name)


def place_csv(artifact: dict, person: str | None = None) -> str:
    """SNK6, PRJ5: the place rows of a page, or of one of its people, with name and page filled in; a mark of byte order comes first."""
    rows, name = plain.rows_of(artifact, "rows"), ""
    if person is not None:
        own = next((p for p in plain.rows_of(artifact, "people") if str(p.get("name") or "").casefold() == person.casefold()), None)
        rows, name = (plain.rows_of(own, "rows"), str(own.get("name") or person)) if own else ([], person)
    page = artifact.get("page") or ""
    filled = [r | {"Name": r.get("Name") or name, "Page": page if r.get("Page") in (None, "") else r["Page"]} for r in rows]
    return "﻿" + csv_text(filled, PLACE)


def place_csv_name(doc_id: str, page: int, person: str | None = None) -> str:
    """SNK6: the file name of a page's or a person's place rows."""
    return f"{doc_id}_p{page:03d}" + (f"_{plain.slug(person)}" if person else "") + "_places.csv"


def clear_places(folder: str | Path) -> int:
    """SNK9: the place artifacts of one document go; how many there were."""
    found = list(Path(folder).glob("p*.places.json"))
    for f in found:
        f.unlink()
    return len(found)


def clear_results(root: str | Path, folders: Iterable[str | Path], active: bool = False) -> list[str]:
    """SNK10: folders below the root go, whatever they hold; refused while a job runs, and for any folder that isn't below the root. The source files of a document are in none of them."""
    if active:
        raise RuntimeError("a job of this document is active")
    root, found = Path(root).resolve(), [Path(f).resolve() for f in folders]
    outside = [f for f in found if root == f or root not in f.parents]
    if outside:
        raise ValueError(f"not below {root}: {outside[0]}")
    gone = [str(f) for f in found if f.exists()]
    for f in found:
        shutil.rmtree(f, ignore_errors=True)
    return gone
