"""Calls of a language model as an operator: prompts are rows, replies are a table, and what has been answered once is never asked again.

A client is made once a partition by a function that the caller hands in; recorded replies alone need none. Distinct prompts are asked once; their replies are
appended to a folder of Parquet files (prompt_hash, response, error, seconds) before anything reads them, so that a lost executor costs its own calls at most
and a run can be replayed without a model. Concurrency is the number of partitions."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import columns as C
from foliant.functions import plain
from foliant.functions import scalar as S
from foliant.operators import images, people, places
from foliant.operators.steps import written
from foliant.plans.dialect import SPARK

REPLIES = "prompt_hash string, response string, error string, seconds double"
#: How many tokens each pass may take, and the form of reply that it asks for.
BUDGETS = {"ocr": 1200, "classify": 500, "pass1": 900, "filter": 900, "recall": 900, "verify": 900, "meta": 1000, "place_pass": 1000, "place_recall": 1000, "place_verify": 1200, "place_date": 900, "repair": 800}
FORMS = {
    "classify": '{"should_extract":true,"skip_reason":null,"report_type":"statement","evidence":"..."}',
    "names": '{"named_people":[{"name":"...","evidence":"..."}]}',
}


class Client(Protocol):
    def generate(self, prompt: str, budget: int, image: bytes | None = None) -> str: ...


class Recorded:
    """A client that knows its replies: by prompt, else in turn."""

    def __init__(self, by_prompt: dict[str, str] | None = None, in_turn: list[str] | None = None):
        self.by_prompt, self.in_turn = by_prompt or {}, list(in_turn or [])

    def generate(self, prompt: str, budget: int, image: bytes | None = None) -> str:
        if prompt in self.by_prompt:
            return self.by_prompt[prompt]
        if not self.in_turn:
            raise KeyError("no reply is recorded for this prompt")
        return self.in_turn.pop(0)


def patient(client: Client, prompt: str, budget: int, image: bytes | None = None, attempts: int = 3, wait: float = 2.0) -> str:
    """The reply after at most so many attempts; the wait grows in step with the attempt."""
    for k in range(1, attempts + 1):
        try:
            return client.generate(prompt, budget, image)
        except Exception:
            if k == attempts:
                raise
            time.sleep(wait * k)
    raise AssertionError


@dataclass
class Desk:
    """Where replies are kept, who answers, and how often one is asked."""

    store: str
    client: Callable[[], Client]
    repair: str = ""
    partitions: int = 1
    attempts: int = 3
    wait: float = 2.0

    def _known(self, df: DataFrame) -> DataFrame:
        """All replies so far. Each call has a folder of its own and folders are named one by one, since scans of one path count as equal to Spark whenever they were listed."""
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.store)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [str(f.getPath()) for f in files.listStatus(path) if f.isDirectory()] if files.exists(path) else []
        return spark.read.schema(REPLIES).parquet(*found) if found else spark.createDataFrame([], REPLIES)

    def answers(self, rows: DataFrame, prompt: str, budget: int, image: str | None = None) -> DataFrame:
        """rows with raw, error and seconds: the reply to each prompt (and image). What failed is asked again in a later run."""
        made, attempts, wait = self.client, self.attempts, self.wait
        key = F.sha2(F.concat(F.encode(prompt, "UTF-8"), F.coalesce(F.unhex(F.sha2(image, 256)), F.lit(b""))), 256) if image else F.sha2(prompt, 256)
        asked = rows.withColumn("prompt_hash", key)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = None
            for batch in batches:
                out = []
                for h, text, picture in zip(batch["prompt_hash"], batch["prompt"], batch["image"]):
                    client = client or made()
                    begin = time.time()
                    try:
                        out.append((h, patient(client, text, budget, picture, attempts, wait), None, round(time.time() - begin, 2)))
                    except Exception as e:
                        out.append((h, None, str(e) or type(e).__name__, round(time.time() - begin, 2)))
                yield pd.DataFrame(out, columns=["prompt_hash", "response", "error", "seconds"])

        done = self._known(rows).where("response is not null")
        picture = F.col(image) if image else F.lit(None).cast("binary")
        new = asked.select("prompt_hash", F.col(prompt).alias("prompt"), picture.alias("image")).where("prompt is not null").join(done, "prompt_hash", "left_anti").dropDuplicates(["prompt_hash"])
        new.repartition(self.partitions).mapInPandas(run, REPLIES).write.parquet(f"{self.store}/call-{uuid.uuid4().hex}")
        best = self._known(rows).groupBy("prompt_hash").agg(F.max_by(F.struct("response", "error", "seconds"), F.col("response").isNotNull()).alias("r"))
        return asked.join(best, "prompt_hash", "left").withColumns({"raw": F.col("r.response"), "error": F.col("r.error"), "seconds": F.col("r.seconds")}).drop("r", "prompt_hash")

    def ask(self, rows: DataFrame, prompt: Column, budget: int, form: Column | str = "") -> DataFrame:
        """LM12: rows with reply (JSON or null), error, model_calls, repair_calls and elapsed_seconds; a reply without JSON is sent back once to be put right."""
        # Generators keep the replies apart from functions in Python that read them.
        got = self.answers(rows.withColumn("__prompt", prompt), "__prompt", budget)
        got = got.select("*", F.inline(F.array(F.struct(C.found_json("raw").alias("reply")))))
        fix = C.filled(F.lit(self.repair or "{schema}\n{bad}"), schema=F.lit(form) if isinstance(form, str) else form, bad=F.col("raw"))
        got = got.withColumn("__fix", F.when(F.col("reply").isNull() & F.col("raw").isNotNull(), fix)).withColumnsRenamed({"raw": "__raw", "error": "__error", "seconds": "__seconds"})
        got = self.answers(got, "__fix", BUDGETS["repair"])
        again = F.col("__fix").isNotNull()
        got = got.withColumnRenamed("reply", "__reply").select("*", F.inline(F.array(F.struct(F.coalesce("__reply", C.found_json("raw")).alias("reply")))))
        out = got.withColumns({
            "error": F.coalesce("__error", "error"),
            "model_calls": F.lit(1) + again.cast("int"),
            "repair_calls": again.cast("int"),
            "elapsed_seconds": F.coalesce("__seconds", F.lit(0.0)) + F.coalesce("seconds", F.lit(0.0)),
        })
        return out.drop("__prompt", "__fix", "__raw", "__error", "__seconds", "__reply", "raw", "seconds")


_json_list = C.arrow(lambda items: json.dumps([i.asDict() if hasattr(i, "asDict") else i for i in items or []], ensure_ascii=False, indent=2), "string")


def classify(desk: Desk, pages: DataFrame, prompt: str, forced: str | None = None) -> DataFrame:
    """LM2, R4, R1: pages (doc_id, page, text) with should_extract, skip_reason, report_type, evidence, initial_type, applied (whether the rules changed the type) and calls.
    A forced type asks no model."""
    if forced:
        told = {"should_extract": F.lit(True), "skip_reason": F.lit(None).cast("string"), "report_type": F.lit(forced), "evidence": F.lit("")}
        return pages.withColumns(told | {"initial_type": F.lit(forced), "applied": F.lit(False), "model_calls": F.lit(0), "repair_calls": F.lit(0)})
    got = desk.ask(pages, C.filled(F.lit(prompt), ocr=C.page_text("text")), BUDGETS["classify"], FORMS["classify"]).withColumn("d", C.page_decision("reply"))
    out = got.withColumns({"should_extract": F.col("d.should_extract"), "skip_reason": F.col("d.skip_reason"), "initial_type": F.col("d.report_type"), "evidence": F.col("d.evidence")}).drop("d", "reply")
    out = out.withColumn("report_type", F.expr(S.overridden(SPARK, "text", "initial_type")))
    return out.withColumn("applied", F.col("report_type") != F.col("initial_type"))


def names(desk: Desk, pages: DataFrame, prompts: dict[str, str]) -> dict[str, DataFrame]:
    """LM3-LM7: the candidates of each page after pass1, pass1_filter, recall, recall_filter, merged, verify and rule_filter, and removed, the audit of all of them.
    prompts: pass1, recall, filter, verify. Each page costs five calls, whatever is found. Each pass is written before the next one reads it."""
    out: dict[str, DataFrame] = {}
    text = C.page_text("text")

    def free(stage: str) -> DataFrame:
        return people.from_replies(desk.ask(pages, C.filled(F.lit(prompts[stage]), ocr=text), BUDGETS[stage], FORMS["names"]))

    def asked(stage: str, kind: str, before: DataFrame) -> DataFrame:
        listed = pages.join(people._listed(before), people.PAGE, "left").withColumn("__list", _json_list("people"))
        prompt = C.filled(F.lit(prompts[kind]), stage=F.lit(stage), candidate_names_json=F.col("__list"), ocr=text)
        return people.restricted(people.from_replies(desk.ask(listed, prompt, BUDGETS[kind], FORMS["names"])), before)

    for stage in ("pass1", "recall"):
        out[stage] = written(free(stage))
        out[f"{stage}_filter"] = written(asked(f"{stage}_filter", "filter", out[stage]))
    both = people.union(out["pass1_filter"], out["recall_filter"])
    out["merged"] = written(people.merged(both))
    out["verify"] = written(asked("verify", "verify", out["merged"]))
    out["rule_filter"], gone = map(written, people.rule_filter(out["verify"], pages))
    audits = [people.removed(out[s], out[f"{s}_filter"], f"{s}_filter") for s in ("pass1", "recall")] + [people.merge_audit(both, out["merged"]), people.removed(out["merged"], out["verify"], "verify"), gone]
    columns = [*people.PAGE, "ord", "name", "evidence", "stage", "reason_type", "reason", "excerpt"]
    out["removed"] = audits[0].select(columns)
    for a in audits[1:]:
        out["removed"] = out["removed"].unionByName(a.select(columns))
    out["removed"] = written(out["removed"])
    return out


def metadata(desk: Desk, persons: DataFrame, prompt: str) -> DataFrame:
    """LM8, CV7: persons (doc_id, page, name, text, report_type, evidence) with detail: the row, its validation, raw values and evidence; one call each."""
    form = F.to_json(F.struct("name", "page", *(F.lit("...").alias(f) for f in plain.FIELDS)))
    asked = C.filled(F.lit(prompt), name=F.col("name"), page=F.col("page"), report_type=F.col("report_type"), ocr=C.page_text("text"))
    got = desk.ask(persons, asked, BUDGETS["meta"], form)
    return got.withColumn("detail", C.detail_row("reply", "name", "page", "report_type", "evidence")).drop("reply")


def routes(desk: Desk, persons: DataFrame, prompts: dict[str, str]) -> dict[str, DataFrame]:
    """LM9-LM11: place rows of persons (doc_id, page, name, text) after candidates, verify, enrich and reconciled. prompts: place_pass, place_recall, place_verify, place_date.
    Without candidates no further call is made; a verified list that fails its checks is asked for once more, with what is wrong, and the last one counts."""
    keys, out = places.KEYS, {}
    persons = persons.withColumn("doc_year", F.expr(S.year(SPARK, "text"))).withColumn("__text", C.page_text("text"))
    fill = lambda kind, **more: C.filled(F.lit(prompts[kind]), name=F.col("name"), page=F.col("page"), **more, ocr=F.col("__text"))
    first = places.candidates(desk.ask(persons, fill("place_pass"), BUDGETS["place_pass"]))
    second = places.final(desk.ask(persons, fill("place_recall"), BUDGETS["place_recall"]))
    out["candidates"] = written(places.folded(first, second))
    some = persons.join(places.for_prompt(out["candidates"]), keys)

    def verified(rows: DataFrame, extra: Column) -> DataFrame:
        return places.final(desk.ask(rows, F.concat(fill("place_verify", candidate_places_json=F.col("places_json")), extra), BUDGETS["place_verify"]))

    once = written(verified(some, F.lit("")))
    checks = some.select(*keys).join(places.gathered(once), keys, "left").withColumn("issue", issue("rows"))
    wrong = some.join(checks.where("issue is not null").select(*keys, "issue"), keys)
    twice = verified(wrong, F.concat(F.lit("\nIssues to fix:\n- "), F.col("issue")))
    last = twice.unionByName(once.join(wrong.select(*keys), keys, "left_anti"))
    # An empty answer leaves the candidates.
    last = written(last)
    out["verify"] = written(last.unionByName(out["candidates"].select(last.columns).join(last.select(*keys).distinct(), keys, "left_anti")))
    base = persons.join(places.for_prompt(out["verify"]), keys)
    more = places.final(desk.ask(base, fill("place_date", places_json=F.col("places_json")), BUDGETS["place_date"]))
    out["enrich"] = written(places.enriched(out["verify"], more))
    out["reconciled"] = places.reconciled(out["enrich"], persons.select("doc_id", "page", "text", "doc_year").dropDuplicates(["doc_id", "page"]))
    return out


def _issue(rows) -> str | None:
    """The first rule that a person's rows break. The messages."""
    rows = [r.asDict() if hasattr(r, "asDict") else dict(r) for r in rows or []]
    if not rows:
        return "Verifier returned no places."
    route = [r for r in rows if r["order"] > 0]
    seen, twice = set(), []
    for r in rows:
        low = r["place"].strip().lower()
        if low and low in seen and low not in twice:
            twice.append(r["place"])
        seen.add(low)
    unsure = [r["place"] for r in rows if not r["arrival_date"] and r["date_confidence"]]
    dates = [r["arrival_date"] for r in route if r["arrival_date"]]
    odd = [r["place"] for r in rows if not plain.valid_place(r["place"])]
    if [r["order"] for r in route] != list(range(1, len(route) + 1)):
        return "Positive orders must be consecutive 1..n."
    if twice:
        return f"Duplicate final places remain: {', '.join(twice)}."
    if unsure:
        return f"Date confidence must be blank when arrival_date is blank: {', '.join(unsure)}."
    if dates != sorted(dates):
        return "Positive route order conflicts with arrival dates."
    return f"Invalid place-like text remains: {', '.join(odd)}." if odd else None


issue = C.arrow(_issue, "string")


def transcribed(desk: Desk, pages: DataFrame, prompt: str, tile: bool = True) -> DataFrame:
    """LM1: pages (doc_id, page, png) with text: each tile is read by itself; a page of which no tile gives text is read whole; still nothing gives the mark of an empty page."""
    tiles = pages.select("doc_id", "page", F.posexplode(images.tiles_of("png", F.lit(tile))).alias("tile", "image"))
    read = lambda rows: desk.answers(rows.withColumn("__prompt", F.lit(prompt)), "__prompt", BUDGETS["ocr"], "image").withColumn("part", C.transcript("raw"))
    parts = read(tiles).where("part <> ''").groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "part"))), lambda x: x["part"]), "\n\n").alias("text"))
    got = pages.join(parts, ["doc_id", "page"], "left")
    if tile:
        empty = got.where("text is null").select("doc_id", "page", images.tiles_of("png", F.lit(False))[0].alias("image"))
        whole = read(empty).select("doc_id", "page", F.nullif("part", F.lit("")).alias("again"))
        got = got.join(whole, ["doc_id", "page"], "left").withColumn("text", F.coalesce("text", "again")).drop("again")
    text = F.trim(F.coalesce("text", F.lit("")))
    return got.withColumn("text", F.when(F.length(text) < 5, S.EMPTY_PAGE).otherwise(text)).drop("png")
