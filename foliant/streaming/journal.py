"""The journal of a job: one line of JSON an event, only ever appended to; a job's record is what its events add up to.

Journals are tailed by byte offsets: a stream's offsets are the bytes of each journal that have been read, up to the end of the last whole line, so that a query
that begins again from its checkpoint reads each line once. Long backlogs are cut into pieces of PIECE bytes."""

from __future__ import annotations

import io
import json
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

EVENTS = "doc_id string, job_id string, seq bigint, ts timestamp, event string, stage string, page int, state string, detail string, error string, message string, body string"
NAME = "events.jsonl"
PIECE = 8 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it; a path without a scheme is local or mounted."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def whole_lines(path: str) -> int:
    """Bytes up to the end of the last whole line."""
    store, name = _open(path)
    size = store.get_file_info(name).size or 0
    with store.open_input_file(name) as f:
        at = size
        while at > 0:
            begin = max(0, at - 65536)
            end = f.read_at(at - begin, begin).rfind(b"\n")
            if end >= 0:
                return begin + end + 1
            at = begin
    return 0


def journals(root: str) -> list[str]:
    """The journals of the documents below a folder."""
    store, name = _open(root)
    if store.get_file_info(name).type != fs.FileType.Directory:
        return []
    scheme = root[: len(root) - len(name)] if "://" in root else ""
    found = [f"{d.path}/{NAME}" for d in store.get_file_info(fs.FileSelector(name)) if d.type == fs.FileType.Directory]
    return sorted(scheme + p for p in found if store.get_file_info(p).type == fs.FileType.File)


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    end: int


def pieces(path: str, start: int, end: int) -> list[Piece]:
    return [Piece(path, at, min(at + PIECE, end)) for at in range(start, end, PIECE)]


def lines(piece: Piece):
    """Lines that begin inside of a piece; the last one may end behind it."""
    store, name = _open(piece.path)
    with store.open_input_file(name) as raw, io.BufferedReader(raw, 1 << 16) as f:
        at = piece.start
        if at > 0:
            f.seek(at - 1)
            at += len(f.readline()) - 1  # what began before belongs to the piece before
        while at < piece.end:
            line = f.readline()
            if not line:
                return
            at += len(line)
            yield line


def _row(line: bytes) -> tuple | None:
    """An event as a row; what isn't a line of an event is passed over."""
    from datetime import datetime

    try:
        e = json.loads(line)
        ts = datetime.fromisoformat(str(e["ts"]).replace("Z", "+00:00"))
        page = e.get("page")
        text = lambda k: None if e.get(k) is None else str(e[k])
        return (text("doc_id"), text("job_id"), int(e["seq"]), ts, text("event"), text("stage"), None if page is None else int(page), text("state"), text("detail"), text("error"), text("message"), line.decode().strip())
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def _rows(piece: Piece):
    for line in lines(piece):
        row = _row(line)
        if row is not None:
            yield row


class _Stream(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: n for p in journals(self.root) if (n := whole_lines(p))}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return [x for p, n in sorted(end.items()) for x in pieces(p, start.get(p, 0), n)]

    def read(self, partition: Piece):
        return _rows(partition)


class _Table(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Piece]:
        return [x for p in journals(self.root) for x in pieces(p, 0, whole_lines(p))] or [Piece("", 0, 0)]

    def read(self, partition: Piece):
        return _rows(partition) if partition.path else iter(())


class Journal(DataSource):
    """Source "foliant_journal" of the journals below the folder root, as a table or as a stream."""

    @classmethod
    def name(cls) -> str:
        return "foliant_journal"

    def schema(self) -> str:
        return EVENTS

    def reader(self, schema) -> DataSourceReader:
        return _Table(self.options["root"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["root"])
