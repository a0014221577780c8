"""States of jobs from their events, kept by the stream: of each stage of a page, and of each job, which is paused when it gives no sign.

Events come in any order and more than once. The state of a stage is that of its greatest seq; it began when it was first seen at work or ended, and its end is that
of the event whose state counts. Keys are pages of jobs, and jobs; what is kept of one is bounded."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliant.streaming.journal import Journal

ENDED = ("done", "skipped", "failed")
CLOSED = ("done", "done_with_errors", "failed", "paused", "cancelled")
SILENCE = 15.0
#: Fixed value: what is told of a job that nobody works on any more.
ORPHANED = "Job was paused because the orchestrator service restarted or lost its worker thread."
STAGE_STATE = "job_id string, page int, stage string, state string, seq bigint, started_at timestamp, finished_at timestamp, elapsed_seconds double, detail string, error string"
JOB_STATE = "job_id string, doc_id string, status string, seq bigint, seen_at timestamp, error string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(spark: SparkSession, root: str) -> DataFrame:
    """The stream of all journals below a folder."""
    spark.dataSource.register(Journal)
    return spark.readStream.format("foliant_journal").option("root", root).load()


def table(spark: SparkSession, root: str) -> DataFrame:
    """The events so far, as a table."""
    spark.dataSource.register(Journal)
    return spark.read.format("foliant_journal").option("root", root).load()


def _micros(ts) -> int:
    return int(pd.Timestamp(ts).tz_localize("UTC").value // 1000) if pd.Timestamp(ts).tzinfo is None else int(pd.Timestamp(ts).value // 1000)


def _when(micros: int):
    return None if micros < 0 else pd.Timestamp(micros, unit="us")


class StageStates(StatefulProcessor):
    """For a page of a job: a map of its stages."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stages = handle.getMapState("stages", "stage string", "state string, seq bigint, began bigint, ended bigint, detail string, error string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changed: dict[str, tuple] = {}
        for batch in rows:
            for stage, state, seq, ts, detail, error in zip(batch["stage"], batch["state"], batch["seq"], batch["ts"], batch["detail"], batch["error"]):
                stage = str(stage)
                was = changed.get(stage) or (tuple(self.stages.getValue((stage,))) if self.stages.containsKey((stage,)) else ("pending", -1, -1, -1, "", ""))
                now = self.after(was, str(state), int(seq), _micros(ts), detail if isinstance(detail, str) else "", error if isinstance(error, str) else "")
                if now != was:
                    changed[stage] = now
        out = []
        for stage, s in changed.items():
            self.stages.updateValue((stage,), s)
            took = round(max(0, s[3] - s[2]) / 1e6, 2) if s[3] >= 0 else 0.0
            out.append((key[0], int(key[1]), stage, s[0], s[1], _when(s[2]), _when(s[3]), took, s[4], s[5]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STAGE_STATE.split(", ")])

    @staticmethod
    def after(was: tuple, state: str, seq: int, ts: int, detail: str, error: str) -> tuple:
        """What a stage is after one more event; the same whatever the order of events, and for repeats."""
        last, n, began, ended, old_detail, old_error = was
        if state == "running" or state in ENDED:
            began = ts if began < 0 else min(began, ts)
        if seq > n:
            last, n, ended = state, seq, ts if state in ENDED else -1
            old_detail, old_error = detail or old_detail, error or old_error
        return last, n, began, ended, old_detail, old_error

    def close(self) -> None:
        pass


class JobStates(StatefulProcessor):
    """For a job: its status, and a timer that pauses it when no event has come for a while. An event that comes later than that, and isn't an end, doesn't wake it; a start does."""

    def __init__(self, silence: float):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "doc_id string, status string, seq bigint, seen bigint, error string")
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was = tuple(self.job.get()) if self.job.exists() else ("", "pending", -1, -1, "")
        now = was
        for batch in rows:
            for doc, event, state, seq, ts, error in zip(batch["doc_id"], batch["event"], batch["state"], batch["seq"], batch["ts"], batch["error"]):
                now = self.after(now, str(doc), str(event), state if isinstance(state, str) else "", int(seq), _micros(ts), error if isinstance(error, str) else "")
        self.job.update(now)
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if now[1] not in CLOSED:
            at = timerValues.getCurrentProcessingTimeInMs() + int(self.silence * 1000)
            self.handle.registerTimer(at)
            self.timer.update((at,))
        yield self._told(key, now) if now != was else self._told(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        doc, status, seq, seen, _ = self.job.get()
        if status in CLOSED:
            yield self._told(key)
            return
        now = (doc, "paused", seq, seen, ORPHANED)
        self.job.update(now)
        yield self._told(key, now)

    @staticmethod
    def _told(key, job: tuple | None = None) -> pd.DataFrame:
        rows = [] if job is None else [(key[0], job[0], job[1], job[2], _when(job[3]), job[4])]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in JOB_STATE.split(", ")])

    @staticmethod
    def after(was: tuple, doc: str, event: str, state: str, seq: int, ts: int, error: str) -> tuple:
        """Status by the greatest seq of the events that tell one: state of created, status and done. seen is the last sign of life."""
        known, status, n, seen, old = was
        if event in ("created", "status", "done") and state and seq > n:
            status, n, old = state, seq, error
        return known or doc, status, n, max(seen, ts), old

    def close(self) -> None:
        pass


def _ready(stream: DataFrame) -> None:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def stage_states(stream: DataFrame) -> DataFrame:
    """ST2, ST3: a row whenever the state of a stage of a page changes; for the update mode."""
    _ready(stream)
    told = stream.where("event = 'page' and page is not null and stage is not null and state is not null and seq is not null and ts is not null")
    return told.groupBy("job_id", "page").transformWithStateInPandas(StageStates(), STAGE_STATE, "Update", "ProcessingTime")


def job_states(stream: DataFrame, silence: float = SILENCE) -> DataFrame:
    """ST5: a row whenever a job's record changes, also when it gives no sign for so many seconds of processing time and is paused."""
    _ready(stream)
    return stream.where("job_id is not null and seq is not null and ts is not null").groupBy("job_id").transformWithStateInPandas(JobStates(silence), JOB_STATE, "Update", "ProcessingTime")


def latest(changes: DataFrame, *keys: str) -> DataFrame:
    """Of a table of changes, the one that counts for each key: of the greatest seq, then the latest end, then that which was written last (batch)."""
    extra = [c for c in ("finished_at", "batch") if c in changes.columns]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in changes.columns if c not in keys)), F.struct("seq", *extra)).alias("r")).select(*keys, "r.*")


def utc_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
