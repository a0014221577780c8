"""Jobs over documents, run by one driver: stages in turn, with requests to pause or cancel that hold between them.

Nothing is ever rewritten: each change is an event in the document's journal, and a job's record is the sum of its events. So what two hands change at a time
both counts, as long as it isn't the same field. The journals are also read as a table or a stream of all documents (journal.py, states.py)."""

from __future__ import annotations

import copy
import functools
import json
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from foliant.functions import plain
from foliant.sinks import write_json
from foliant.streaming.journal import NAME, Piece, lines, whole_lines
from foliant.streaming.states import CLOSED, ORPHANED, SILENCE, utc_now

STAGES = ("ingest", "ocr", "classify", "names", "meta", "places", "aggregate")
WORKING = {"pending": "pending", "running": "running", "pausing": "running", "cancelling": "running"}
LOG, ERRORS = 120, 20
#: ST7, fixed values: what a rerun of a pass makes anew beside merging and the rule filter, which are always made anew.
RERUN = {
    "pass1": {"pass1", "pass1_filter", "verify"},
    "pass1_filter": {"pass1_filter", "verify"},
    "recall": {"recall", "recall_filter", "verify"},
    "recall_filter": {"recall_filter", "verify"},
    "verify": {"verify"},
}
#: Of a report's event: the state of its page.
REPORTED = {"done": "done", "skip": "skipped", "error": "failed"}


def stages_to_run(start: str | None, stored: set[str]) -> list[str]:
    """ST7: of the passes over names, those that a rerun from start has to make: what isn't stored, what start bears on; all without a start."""
    order = ("pass1", "pass1_filter", "recall", "recall_filter", "merged", "verify", "rule_filter")
    return [s for s in order if s in ("merged", "rule_filter") or s not in stored or start is None or s in RERUN[start]]


def _fresh() -> dict:
    return dict.fromkeys(("started_at", "finished_at", "error", "detail"), "") | {"state": "pending", "elapsed_seconds": 0.0}


def grid(pages: list[dict], total: int) -> list[dict]:
    """JN16: pages 1..total, each with what is known of its stages."""
    known = {plain.whole(p.get("page")): p for p in pages if isinstance(p, dict)}
    stages = lambda old: {s: _fresh() | (old.get(s) if isinstance(old.get(s), dict) else {}) for s in STAGES}
    return [{"page": n, "note": str(known.get(n, {}).get("note") or ""), **stages(known.get(n, {}))} for n in range(1, total + 1)]


def progress(job: dict) -> list[dict]:
    """AGG16: each stage's completed, total, failed and percent."""
    pages, out = job.get("pages") or [], []
    for s in STAGES:
        states = [job.get("aggregate", {}).get("state", "pending")] * len(pages) if s == "aggregate" else [(p.get(s) or {}).get("state", "pending") for p in pages]
        done = sum(x in ("done", "skipped") for x in states)
        failed = int("failed" in states) if s == "aggregate" else states.count("failed")
        out.append({"stage": s, "completed": done, "total": len(states), "failed": failed, "percent": round(100 * done / len(states)) if states else 0})
    return out


# --- how an event changes a record ---


def _created(job: dict, e: dict) -> dict:
    return copy.deepcopy(e["record"])


def _changed(job: dict, e: dict) -> dict:
    return job | copy.deepcopy(e["fields"])


def _grown(job: dict, e: dict) -> dict:
    return job | {"pages": grid(job.get("pages") or [], e["total"]), "total_pages": e["total"]}


def _page(job: dict, e: dict) -> dict:
    """ST2: a stage of a page, or the aggregate of the document: first begin, last end, and what took between them."""
    n, state, at = e.get("page"), e["state"], e["ts"]
    if n is not None and n > len(job["pages"]):
        job = _grown(job, {"total": n})
    own = job["aggregate"] if n is None else job["pages"][n - 1][e["stage"]]
    over = state in REPORTED.values()
    begun = own["started_at"] or (at if over or state == "running" else "")
    own.update(state=state, started_at=begun, **{k: e[k] for k in ("detail", "error") if e.get(k)})
    if over:
        own.update(finished_at=at, elapsed_seconds=plain.elapsed(begun, at))
    return job


def _asked(job: dict, e: dict) -> dict:
    """A request: it takes the place of another one, and a job that hasn't begun is paused at once."""
    pause = e["what"] == "pause"
    flags = {"pause_requested": pause, "cancel_requested": not pause}
    if job.get("status") == "pending" and pause:
        return job | flags | {"status": "paused", "pause_requested": False, "finished_at": e["ts"]}
    return job | flags | ({"status": "pausing" if pause else "cancelling"} if WORKING.get(job.get("status")) == "running" else {})


def _closed(job: dict, e: dict) -> dict:
    told = [*job.get("errors", []), *filter(None, [e.get("error")])][-ERRORS:]
    return job | {"status": e["state"], "errors": told, "current_stage": "", "finished_at": e["ts"], "cancel_requested": False, "pause_requested": False}


def _logged(job: dict, e: dict) -> dict:
    return job | {"log_tail": [*job.get("log_tail", []), e["message"]][-LOG:]}


EFFECTS = {"created": _created, "changed": _changed, "grown": _grown, "page": _page, "asked": _asked, "done": _closed, "log": _logged}


def after(job: dict, e: dict) -> dict:
    """A record after one more event."""
    return EFFECTS.get(e["event"], lambda j, _: j)(job, e) | {"updated_at": e["ts"]} if job or e["event"] == "created" else {}


class Record(dict):
    """A job's record as it was handed out, which base still says when it has been changed."""

    base: dict = {}


class Jobs:
    """The jobs below a folder, one a document. Records that are handed out are copies; save() tells the journal which fields differ from what was handed out."""

    def __init__(self, root: str | Path):
        self.root, self.lock = Path(root), threading.RLock()
        self.workers: dict[str, threading.Thread] = {}
        self.read: dict[str, tuple[int, dict]] = {}  # of each journal: bytes that are summed up, and the record

    def journal(self, doc: str) -> Path:
        return self.root / doc / NAME

    # --- events in, records out ---

    def emit(self, job: dict, event: str, **more) -> dict:
        """SNK7: one event, in one write to the end of the journal."""
        e = {"ts": utc_now(), "seq": time.time_ns(), "event": event, "job_id": job.get("job_id", ""), "doc_id": job["doc_id"], **more}
        line = json.dumps(e, ensure_ascii=False).encode() + b"\n"
        with self.lock, self.journal(job["doc_id"]).open("ab", buffering=0) as f:
            f.write(line)
        return e

    def load(self, doc: str) -> dict:
        """The record of a document's job: what is new in its journal is added to what is known."""
        with self.lock:
            path = str(self.journal(doc))
            if not os.path.exists(path):
                return {}
            end, (at, job) = whole_lines(path), self.read.get(doc, (0, {}))
            if end < at:  # another job has begun here
                at, job = 0, {}
            for line in lines(Piece(path, at, end)) if end > at else ():
                try:
                    job = after(job, json.loads(line))
                except (ValueError, KeyError, TypeError, IndexError):
                    continue  # not an event of a job
            self.read[doc] = end, job
            out = Record(copy.deepcopy(job))
            out.base = copy.deepcopy(job)
            return out

    def _settle(self, job: dict) -> dict:
        """The caller's record becomes what the journal adds up to."""
        now = self.load(job["doc_id"])
        job.clear()
        job.update(now)
        if isinstance(job, Record):
            job.base = now.base
        write_json(self.root / job["doc_id"] / "job.json", now)
        return job

    def create(self, doc: str, **options) -> dict:
        at = utc_now()
        record = {"job_id": uuid.uuid4().hex[:12], "doc_id": doc, "status": "pending", "resume": True, **options, "pages": [], "total_pages": 0, "aggregate": _fresh(), "errors": [], "log_tail": []}
        record |= {"created_at": at, "updated_at": at} | dict.fromkeys(("current_stage", "started_at", "finished_at"), "") | dict.fromkeys(("cancel_requested", "pause_requested"), False)
        with self.lock:
            self.journal(doc).parent.mkdir(parents=True, exist_ok=True)
            self.journal(doc).write_bytes(b"")
            self.read.pop(doc, None)
            self.emit(record, "created", state="pending", record=record)
            return self._settle(Record(record))

    def save(self, job: dict) -> None:
        """SNK8: the fields that were changed here; requests that have come meanwhile stay, since they are events of their own."""
        known = job.base if isinstance(job, Record) else self.load(job["doc_id"])
        fields = {k: v for k, v in job.items() if k != "updated_at" and v != known.get(k)}
        if fields:
            self.emit(job, "changed", fields=fields)
        self._settle(job)

    def all(self) -> list[dict]:
        """SRC19: records, the one that changed last first."""
        found = sorted(self.root.glob(f"*/{NAME}"), key=lambda p: p.stat().st_mtime_ns, reverse=True)
        return [j for p in found if (j := self.load(p.parent.name))]

    def find(self, job_id: str) -> dict:
        return {j["job_id"]: j for j in self.all()}.get(job_id, {})

    # --- stages ---

    def extend(self, job: dict, total: int) -> None:
        self.save(job)
        self.emit(job, "grown", total=max(0, total))
        self._settle(job)

    def mark(self, job: dict, stage: str, page: int | None, state: str, detail: str = "", error: str = "") -> dict:
        self.emit(job, "page", stage=stage, page=page, state=state, detail=detail, error=error)
        self._settle(job)
        return job["aggregate"] if page is None else job["pages"][page - 1][stage]

    def reporter(self, job: dict, stage: str, total: int) -> Callable[[str, int], None]:
        """ST3: a function of (event, page) that marks a page and sets the next one running; events are done, skip and error."""

        def told(event: str, page: int) -> None:
            self.mark(job, stage, page, REPORTED.get(event, "running"))
            waiting = [p["page"] for p in job["pages"][page:total] if p[stage]["state"] == "pending"]
            if event in REPORTED and waiting:
                self.mark(job, stage, waiting[0], "running")

        return told

    def run(self, job: dict, steps: list[tuple[str, Callable[[], None]]]) -> str:
        """ST4: the stages in turn; requests are looked at between them. The status that the job ends with (AGG17)."""
        job.update(status="running", started_at=job["started_at"] or utc_now())
        self.save(job)
        self.emit(job, "status", state="running")
        for stage, step in steps:
            if ended := self.stopped(job):
                return ended
            job["current_stage"] = stage
            self.save(job)
            try:
                step()
            except Exception as e:
                return self.end(job, "failed", f"{stage}: {e}")
        self._settle(job)
        failed = any(p[s]["state"] == "failed" for p in job["pages"] for s in STAGES)
        return self.end(job, "done_with_errors" if failed else "done")

    def stopped(self, job: dict) -> str | None:
        now = self.load(job["doc_id"])
        for flag, status, word in (("pause_requested", "paused", "Pause"), ("cancel_requested", "cancelled", "Cancellation")):
            if now.get(flag):
                self.log(job, f"{word} requested; stopping after current stage.")
                return self.end(job, status)
        return None

    def end(self, job: dict, status: str, error: str = "") -> str:
        self.emit(job, "done", state=status, error=error)
        self._settle(job)
        return status

    def request(self, doc: str, what: str) -> dict:
        """what: pause or cancel."""
        job = self.load(doc)
        self.emit(job, "asked", what=what)
        return self._settle(job)

    def start(self, job: dict, steps) -> threading.Thread:
        self.workers[job["job_id"]] = thread = threading.Thread(target=functools.partial(self.run, job, steps), daemon=True)
        thread.start()
        return thread

    def adopt(self, job: dict, silence: float = SILENCE) -> dict:
        """ST5: a job that should be at work, has no worker here and has given no sign for a while, is paused and can be resumed; states.job_states does the same for all journals."""
        alone = not getattr(self.workers.get(job.get("job_id")), "is_alive", bool)()
        if alone and job.get("status") in WORKING and plain.elapsed(job.get("updated_at"), utc_now()) >= silence:
            job = Record(job)
            self.end(job, "paused", ORPHANED)
        return job

    # --- logs ---

    def log(self, job: dict, message: str) -> None:
        self.save(job)
        e = self.emit(job, "log", message=f"[{utc_now()}] {message}")
        with self.lock, (self.root / job["doc_id"] / "pipeline.log").open("a", encoding="utf-8") as f:
            f.write(e["message"] + "\n")
        self._settle(job)

    def tail(self, doc: str, limit: int = 60) -> list[str]:
        """LIM3: the last lines that were logged."""
        return self.load(doc).get("log_tail", [])[-max(1, limit) :]

    def events(self, doc: str, wait: float = 1.0, idle: int = 2) -> Iterator[dict]:
        """ST1 for one document, as a server would send them: events as they come; ends after so many turns without any once the job has ended. Many documents: states.events."""
        at, quiet, path = 0, 0, str(self.journal(doc))
        while quiet < idle or self.load(doc).get("status") not in CLOSED:
            end = whole_lines(path)
            for line in lines(Piece(path, at, end)) if end > at else ():
                yield json.loads(line)
            quiet, at = (quiet + 1 if end <= at else 0), end
            time.sleep(wait)
