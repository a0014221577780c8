"""The engine as a user calls it: documents below a root folder, their artifacts as tables, and what is made of them.

root/pages/<doc>, root/ocr_text/<doc>, root/intermediate/<doc>, root/output/<doc> and root/logs/<doc> hold a document's images, texts, artifacts, tables and jobs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import sinks
from foliant.functions import columns, plain
from foliant.operators import aggregate, model
from foliant.operators.steps import written
from foliant.snapshots import Snapshots
from foliant.sources import artifacts
from foliant.streaming.jobs import Jobs

OUTPUTS = ("Detailed info.csv", "name place.csv", "run_status.csv", "aggregation_summary.json")


class Engine:
    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, Path(root)
        self.functions = columns.register(spark)

    # --- tables ---

    def artifacts(self, doc: str | None = None) -> DataFrame:
        """The artifacts of all documents, or of one."""
        where = self.root / "intermediate"
        where = where / doc if doc else where
        if not where.exists():
            return self.spark.createDataFrame([], artifacts.FILES)
        return artifacts.scan(self.spark, str(where))

    def texts(self) -> DataFrame:
        return artifacts.texts(self.spark, str(self.root / "ocr_text"))

    def documents(self) -> DataFrame:
        return artifacts.listing(self.artifacts())

    def tables(self, files: DataFrame | None = None) -> dict[str, DataFrame]:
        """details, places, status, stats and actions of all documents that files (doc_id, page, kind, content) has artifacts of."""
        files = self.artifacts() if files is None else files
        details, places = written(artifacts.details(files)), written(artifacts.places(files))  # read by several tables
        everyone = written(aggregate.all_names(details, places))
        names = aggregate.name_map(everyone)
        spelt = written(aggregate.spellings(everyone, names))
        out = {"details": aggregate.detail_table(details, spelt), "places": aggregate.place_table(places, spelt), "status": aggregate.status_table(artifacts.pages(files), details, places, artifacts.facts(files))}
        return out | {"stats": aggregate.stats(out["details"], out["places"], out["status"]), "actions": aggregate.actions(everyone, names)}

    def commit_tables(self) -> int:
        """SNK4 for all documents at once: the tables as one version of root/tables (snapshots.py); its number."""
        return self.versions.update(lambda base: self.tables())

    @property
    def versions(self) -> Snapshots:
        return Snapshots(self.spark, str(self.root / "tables"))

    def views(self, files: DataFrame | None = None) -> list[str]:
        """The tables as views of SQL: foliant_details and so on."""
        for name, df in self.tables(files).items():
            df.createOrReplaceTempView(f"foliant_{name}")
        return [f"foliant_{n}" for n in ("details", "places", "status", "stats", "actions")]

    def status(self, doc: str) -> dict:
        """The job of a document, with the progress of its stages."""
        job = self.jobs.adopt(self.jobs.load(doc))
        return job | {"progress": progress} if job and (progress := _progress(job)) else job

    @property
    def jobs(self) -> Jobs:
        return Jobs(self.root / "logs")

    # --- SNK4 ---

    def aggregate(self, doc: str) -> dict:
        """The three tables and the summary of one document, written to root/output/<doc>; the summary."""
        files = self.artifacts(doc).cache()
        try:
            tables = self.tables(files)
            target = self.root / "output" / doc
            rows = {n: list(sinks.local_rows(tables[n], order)) for n, order in (("details", ["nth"]), ("places", ["nth"]), ("status", ["page"]))}
            for name, (key, columns_) in zip(OUTPUTS, (("details", aggregate.DETAIL), ("places", aggregate.PLACE), ("status", aggregate.STATUS))):
                sinks.write_text(target / name, sinks.csv_text(rows[key], columns_))
            found = tables["stats"].drop("doc_id").first()
            empty = {"pages_processed": 0, "skip_rate": 0, "unique_people": 0, "unique_places": 0, "detail_rows": 0, "place_rows": 0, "status_rows": 0, "report_types": {}, "crime_types": {}, "statuses": {}}
            told = [r["action"] for r in tables["actions"].orderBy("canonical").collect()]  # the merged names of one document
            summary = {"doc_id": doc, "stats": found.asDict() if found else empty, "cleanup_actions": told}
            sinks.write_json(target / OUTPUTS[3], summary)
            return summary
        finally:
            files.unpersist()

    def download(self, doc: str, to: str | Path) -> None:
        sinks.zipped(to, [self.root / "output" / doc / n for n in OUTPUTS[:3]])

    def clear(self, doc: str) -> list[str]:
        active = self.jobs.load(doc).get("status") in ("running", "pausing", "cancelling")
        return sinks.clear_results(self.root, [self.root / d / doc for d in ("pages", "ocr_text", "intermediate", "output")], active)

    # --- single values ---

    def normalize_name(self, x: str) -> str:
        return plain.name(x)

    def normalize_place(self, x: str) -> str:
        return plain.place(x)

    def normalize_date(self, x: str, year: int | None = None) -> tuple[str, str]:
        return plain.iso_date(x, year)

    def compare_names(self, a: str, b: str) -> bool:
        return plain.same_person(a, b)

    # --- passes ---

    def desk(self, client, store: str | Path, **how) -> model.Desk:
        return model.Desk(str(store), client, **how)

    def write_pages(self, rows: DataFrame, kind: str) -> None:
        """Artifacts as files: rows (doc_id, page, content) of one kind, a file a page; for documents of a size that one machine lists."""
        for r in rows.select("doc_id", "page", F.col("content").cast("string")).toLocalIterator():
            sinks.write_text(self.root / "intermediate" / r["doc_id"] / f"p{r['page']:03d}.{kind}.json", r["content"])


def _progress(job: dict) -> list[dict]:
    from foliant.streaming.jobs import progress

    return progress(job)
