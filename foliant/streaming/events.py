"""The event log of a run as a stream: the latest state of each stage of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "seq bigint, job_id string, page int, stage string, state string, ts timestamp"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of JSON lines, one file a batch of events: files are read once, so a writer adds files and doesn't append to them."""
    return spark.readStream.schema(EVENTS).json(folder)


def stage_states(events: DataFrame) -> DataFrame:
    """For each (job, page, stage): the state of the greatest seq, when it first ran and when it ended; the same for a table or a stream (in update or complete mode)."""
    last = F.max_by("state", "seq")
    ended = F.max(F.when(F.col("state").isin("done", "failed", "skipped"), F.col("ts")))
    return events.groupBy("job_id", "page", "stage").agg(last.alias("state"), F.min(F.when(F.col("state") == "running", F.col("ts"))).alias("started_at"), ended.alias("finished_at"))
