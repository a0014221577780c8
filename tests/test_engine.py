"""The engine on files and tables: artifacts to tables and outputs, passes with recorded replies, jobs, images, sources and sinks."""

import csv
import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant import cli, sinks
from foliant.engine import OUTPUTS, Engine
from foliant.functions import plain
from foliant.operators import aggregate, evidence, images, model, people, places
from foliant.sources import artifacts, scans, vocabulary
from foliant.streaming import jobs as J


def put(root, doc, name, value):
    path = root / "intermediate" / doc / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")


@pytest.fixture()
def root(tmp_path):
    detail = {"Name": "Mariam bint Yusuf", "Page": 1, "Report Type": "statement", "Crime Type": "kidnapping", "Whether abuse": "", "Conflict Type": "", "Trial": "", "Amount paid": "Rs, 40\n\"net\""}
    put(tmp_path, "Doc A", "p001.classify.json", "﻿" + json.dumps({"should_extract": True, "report_type": "statement", "evidence": "made by her", "model_calls": 1, "elapsed_seconds": 3.4}))
    put(tmp_path, "Doc A", "p001.names.json", {"named_people": [{"name": "Mariam bint Yusuf"}], "model_calls": 5, "repair_calls": 1, "elapsed_seconds": 18.7})
    put(tmp_path, "Doc A", "p001.meta.json", {"rows": [detail, detail | {"Name": "Marium bint Yousuf"}, {"name": ""}]})
    row = {"Name": "Mariam bint Yusuf", "Page": 1, "Place": "shargah", "Order": 2, "Arrival Date": "", "Time Info": "None"}
    put(tmp_path, "Doc A", "p001.places.json", {"rows": [row], "people": [{"name": "Mariam bint Yusuf", "rows": [row | {"Order": 1, "Arrival Date": "1931-05-17", "Date Confidence": "explicit"}]}, {"name": "Faraj", "rows": []}]})
    put(tmp_path, "Doc A", "p002.classify.json", {"should_extract": False, "skip_reason": "index"})
    put(tmp_path, "Doc A", "p003.meta.json", "{broken")
    put(tmp_path, "Doc A", "p12.meta.json", [])  # two digits: no page
    put(tmp_path, "b", "p1000.names.json", {"people": [{}, {}], "note": "n"})
    return tmp_path


def read(path):
    return list(csv.reader(io.StringIO(path.read_bytes().decode(), newline="")))


def test_aggregate_end_to_end(spark, root):
    engine = Engine(spark, root)
    summary = engine.aggregate("Doc A")
    out = root / "output" / "Doc A"
    assert read(out / OUTPUTS[0]) == [list(aggregate.DETAIL), ["Mariam bint Yusuf", "1", "statement", "kidnapping", "", "", "", 'Rs, 40\n"net"']]
    assert b"\r\n" in (out / OUTPUTS[0]).read_bytes()
    assert read(out / OUTPUTS[1]) == [list(aggregate.PLACE), ["Faraj", "1", "", "0", "", "", ""], ["Mariam bint Yusuf", "1", "Sharjah", "1", "1931-05-17", "explicit", ""]]
    assert read(out / OUTPUTS[2]) == [
        list(aggregate.STATUS),
        ["1", "p001", "ok", "1", "3", "3", "6", "1", "22.1", "made by her"],
        ["2", "p002", "skip:index", "0", "0", "0", "0", "0", "", ""],
        ["3", "p003", "no_named_people", "0", "0", "0", "0", "0", "", ""],
    ]
    assert summary["stats"] == {"pages_processed": 3, "skip_rate": 0.333, "unique_people": 1, "unique_places": 1, "detail_rows": 1, "place_rows": 2, "status_rows": 3, "report_types": {"statement": 1}, "crime_types": {"kidnapping": 1}, "statuses": {"no_named_people": 1, "ok": 1, "skip:index": 1}}
    assert summary["cleanup_actions"] == ['Merged name variants into "Mariam bint Yusuf": Mariam bint Yusuf, Marium bint Yousuf']
    assert json.loads((out / OUTPUTS[3]).read_text()) == summary
    engine.download("Doc A", root / "all.zip")
    assert zipfile.ZipFile(root / "all.zip").namelist() == list(OUTPUTS[:3])
    assert {(r.doc_id, r.pages, r.people) for r in engine.documents().collect()} == {("Doc A", 3, 1), ("b", 1, 0)}
    assert engine.aggregate("nothing here")["stats"]["pages_processed"] == 0
    assert [r.filename for r in engine.tables()["status"].where("doc_id = 'b'").collect()] == ["p1000"]
    engine.views()
    assert spark.sql("select normal_name('the slave AMINA') n, one_space(' a  b') s, iso_date('17th May', 1931) d, same_person('Mariam bint Yusuf', 'Marium bint Yousuf') p from foliant_stats where doc_id = 'b'").first().asDict() == {"n": "Amina", "s": "a b", "d": "1931-05-17", "p": True}
    assert len(engine.clear("Doc A")) == 2 and not (root / "intermediate" / "Doc A").exists()


def test_gates_and_resume(spark, root):
    files = artifacts.scan(spark, str(root / "intermediate"))
    pages = artifacts.pages(files)
    assert {(r.doc_id, r.page) for r in pages.collect()} == {("Doc A", 1), ("Doc A", 2), ("Doc A", 3), ("b", 1000)}
    assert {(r.doc_id, r.page) for r in artifacts.resumed(pages, files, "meta").collect()} == {("Doc A", 2), ("Doc A", 3), ("b", 1000)}
    got = {(r.doc_id, r.page): (r.report_type, r.error) for r in artifacts.extractable(pages, artifacts.decisions(files), "names").collect()}
    assert got[("Doc A", 1)] == ("statement", None) and got[("Doc A", 2)][1] == "page is not extractable" and got[("b", 1000)] == ("correspondence", "missing decision")
    odd = spark.createDataFrame([("d", 1, True, "memo"), ("d", 2, True, None)], "doc_id string, page int, should_extract boolean, report_type string")
    assert [r.report_type for r in artifacts.extractable(odd.select("doc_id", "page"), odd, "meta").orderBy("page").collect()] == ["statement", "statement"]
    valid = spark.createDataFrame([(" ", 1), ("[OCR_EMPTY]", 1), ("{}", 2), ("{", 1), (None, 0), ("null", 4)], "content string, size long")
    assert [[r[0] for r in valid.select(artifacts.is_valid(k, F.col("content"), F.col("size"))).collect()] for k in ("text", "json", "png")] == [[False, True, True, True, False, True], [False, False, True, False, False, True], [True, True, True, True, False, True]]


def test_page_texts(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "p007.txt").write_bytes(b"a\xffb")
    (tmp_path / "d" / "page12.txt").write_text("é")
    assert {(r.doc_id, r.page, r.text) for r in artifacts.texts(spark, str(tmp_path)).collect()} == {("d", 7, "a�b"), ("d", 12, "é")}


def candidates(spark, rows, page=1):
    return spark.createDataFrame([("d", page, i, n, e) for i, (n, e) in enumerate(rows)], "doc_id string, page int, ord long, name string, evidence string")


def test_allowed_list_and_audits(spark):
    allowed = candidates(spark, [("Mariam bint Yusuf", "a"), ("Faraj", "b  c")])
    picks = candidates(spark, [("FARAJ", ""), ("faraj", "late"), ("Salim", "")])
    assert [(r.name, r.evidence) for r in people.restricted(picks, allowed).collect()] == [("Faraj", "b c")]
    assert {r.name for r in people.restricted(candidates(spark, [("Salim", "")]), allowed).collect()} == {"Mariam bint Yusuf", "Faraj"}
    assert people.restricted(candidates(spark, [("Salim", "")]), allowed, fall_back=False).count() == 0
    gone = people.removed(allowed, candidates(spark, [("faraj", "")]), "pass1_filter").collect()
    assert [(r.name, r.stage, r.excerpt) for r in gone] == [("Mariam bint Yusuf", "pass1_filter", "a")]
    before = candidates(spark, [("Mariam bint Yusuf", "e"), ("Marium bint Yousuf", ""), ("Faraj", ""), ("Faraj", "x")])
    after = people.merged(before)
    assert [r.name for r in after.orderBy("ord").collect()] == ["Faraj", "Marium bint Yousuf"]
    audit = people.merge_audit(before, after).orderBy("ord").collect()
    assert [(r.name, r.reason_type, r.kept_as) for r in audit][-1] == ("Faraj", "merged_duplicate", None) or ("Mariam bint Yusuf", "merged_duplicate", None) in [(r.name, r.reason_type, r.kept_as) for r in audit]
    listed = people.listed_names(candidates(spark, [(" Faraj ", ""), ("FARAJ", ""), ("", ""), ("Ali", "")]))
    assert [r.name for r in listed.orderBy("ord").collect()] == ["Faraj", "Ali"]
    asked = spark.createDataFrame([("d", 1, " faraj")], "doc_id string, page int, name string")
    assert people.resolved(asked, listed).first().person == "Faraj"
    with pytest.raises(Exception, match="no such person"):
        people.resolved(asked.withColumn("name", F.lit("Zaid")), listed).collect()


PAGE = "Statement of slave Mariam bint Yusuf. I was sold to Sheikh Rashid and taken to Dubai on 17th May 1931."
NAMES = {"pass1": "P1 {ocr}", "recall": "R {ocr}", "filter": "F {stage} {candidate_names_json} {ocr}", "verify": "V {candidate_names_json} {ocr}"}


def test_names_passes_with_recorded_replies(spark, tmp_path):
    reply = json.dumps({"named_people": [{"name": "Mariam bint Yusuf", "evidence": "Statement of slave Mariam"}, {"name": "Sheikh Rashid", "evidence": "sold to Sheikh Rashid"}]})
    pages = spark.createDataFrame([("d", 1, PAGE)], "doc_id string, page int, text string")
    told = {"first": [reply, "```json\n" + reply + "\n```", "no json at all", reply, reply, '{"named_people": []}']}

    def client():
        class Talk:
            def generate(self, prompt, budget, image=None):
                if prompt.startswith("put right"):
                    return '{"named_people": []}'
                return told["first"][2] if prompt.startswith("R ") else reply

        return Talk()

    desk = model.Desk(str(tmp_path / "replies"), client, repair="put right {schema} {bad}")
    out = model.names(desk, pages, NAMES)
    names = lambda stage: [r.name for r in out[stage].orderBy("ord").collect()]
    assert names("pass1") == names("pass1_filter") == ["Mariam bint Yusuf", "Sheikh Rashid"]
    assert names("recall") == names("recall_filter") == []
    assert names("merged") == names("verify") == ["Mariam bint Yusuf", "Sheikh Rashid"]
    assert names("rule_filter") == ["Mariam bint Yusuf"]
    removed = out["removed"].collect()
    assert [(r.name, r.stage, r.reason_type) for r in removed] == [("Sheikh Rashid", "rule_filter", "negative_rule")]
    replies = lambda: spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "replies")).count()
    calls = replies()
    assert calls == 6  # five passes and one repair, each prompt once

    def silent():
        raise AssertionError("a recorded prompt was asked again")

    again = model.names(model.Desk(str(tmp_path / "replies"), silent, repair="put right {schema} {bad}"), pages, NAMES)
    assert [r.name for r in again["rule_filter"].collect()] == ["Mariam bint Yusuf"] and replies() == calls


def test_calls_that_fail_are_rows_and_asked_again(spark, tmp_path):
    pages = spark.createDataFrame([("d", 1, "x"), ("d", 2, "y")], "doc_id string, page int, text string")

    def broken():
        class Talk:
            def generate(self, prompt, budget, image=None):
                if "y" in prompt:
                    raise RuntimeError("no answer")
                return '{"should_extract": true, "report_type": "statement", "skip_reason": "bad_ocr"}'

        return Talk()

    desk = model.Desk(str(tmp_path / "r"), broken, attempts=2, wait=0.0)
    got = {r.page: r for r in model.classify(desk, pages, "c {ocr}").collect()}
    assert (got[1].should_extract, got[1].skip_reason, got[1].model_calls, got[1].repair_calls) == (False, "bad_ocr", 1, 0)
    assert got[2].error == "no answer" and got[2].should_extract is True and got[2].report_type == "correspondence"
    well = model.Desk(str(tmp_path / "r"), lambda: model.Recorded({"c y": '{"report_type": "statement"}'}))
    assert {r.page: r.report_type for r in model.classify(well, pages, "c {ocr}").collect()}[2] == "statement"
    assert [r.report_type for r in model.classify(well, pages, "", forced="statement").collect()] == ["statement"] * 2


def test_metadata_and_routes_with_recorded_replies(spark, tmp_path):
    persons = spark.createDataFrame([("d", 1, "Mariam bint Yusuf", PAGE, "statement", "Statement of"), ("d", 1, "Nobody", PAGE, "statement", "")], "doc_id string, page int, name string, text string, report_type string, evidence string")
    def client():
        class Talk:
            def generate(self, prompt, budget, image=None):
                kind, who = prompt.split()[:2]
                if kind == "meta":
                    return '{"crime_type": "kidnapping", "evidence": {"crime_type": "sold"}}'
                if who == "Nobody":
                    return '{"places": []}'
                if kind == "verify" and "Issues to fix" not in prompt:
                    return '{"places": [{"place": "Dubai", "order": 1}, {"place": "Muscat", "order": 1, "date_confidence": "explicit", "arrival_date": "1931-01-01"}, {"place": "Basra", "order": 2, "arrival_date": "1930-01-01"}]}'
                if kind == "date":
                    return '{"places": [{"place": "Dubai", "arrival_date": "17th May 1931", "time_text": "on 17th May"}]}'
                return '{"places": [{"place": "Dubai", "order": 1, "evidence": "taken to Dubai"}, {"place": "H.M.S. Fox"}]}'

        return Talk()

    desk = model.Desk(str(tmp_path / "r"), client)
    detail = {r.name: r.detail for r in model.metadata(desk, persons, "meta {name} {page} {report_type} {ocr}").collect()}
    assert detail["Mariam bint Yusuf"].row["crime_type"] == "kidnapping" and detail["Mariam bint Yusuf"].validation["trial"].status == "empty"
    prompts = {"place_pass": "pass {name} {ocr}", "place_recall": "recall {name} {ocr}", "place_verify": "verify {name} {page} {candidate_places_json} {ocr}", "place_date": "date {name} {places_json} {ocr}"}
    prompts = {k: v.replace("{name}", "{name}") for k, v in prompts.items()}
    persons = persons.withColumn("name", F.regexp_replace("name", "^Mariam.*", "Mariam"))
    out = model.routes(desk, persons, prompts)
    rows = [(r.name, r.place, r.order, r.arrival_date, r.date_confidence, r.time_info) for r in out["reconciled"].collect()]
    assert rows == [("Mariam", "Dubai", 1, "1931-05-17", "", "on 17th May")]
    assert [r.places_json for r in places.for_prompt(out["reconciled"]).collect()] == ['[{"place":"Dubai","order":1,"arrival_date":"1931-05-17","date_confidence":null,"time_text":"on 17th May","evidence":"taken to Dubai"}]']


def test_issues_of_verified_places():
    row = lambda p, o, d="", c="": plain.place_row(p, o, d, c)
    assert model._issue([]) == "Verifier returned no places."
    assert model._issue([row("Dubai", 2)]) == "Positive orders must be consecutive 1..n."
    assert model._issue([row("Dubai", 1), row("dubai", 0)]) == "Duplicate final places remain: dubai."
    assert model._issue([row("Dubai", 1, "", "explicit")]).endswith("blank: Dubai.")
    assert model._issue([row("Dubai", 1, "1931-05-17"), row("Basra", 2, "1930-01-01")]) == "Positive route order conflicts with arrival dates."
    assert model._issue([row("agency", 0)]) == "Invalid place-like text remains: agency."
    assert model._issue([row("Dubai", 1, "1931-05-17", "explicit")]) is None


def test_evidence_spans(spark):
    page = "A   Āmina was <sold> at Dubai. amina, again"
    assert evidence.find_span("WAS <SOLD>", page) == (10, 20)
    assert evidence.find_span("amina was sold", page) == (4, 20)
    assert evidence.find_span("nowhere", page) is None and evidence.find_span("", page) is None
    spans = [{"s": 0, "e": 5, "label": "a", "priority": 1}, {"s": 3, "e": 8, "label": "b", "priority": 0}, {"s": 8, "e": 9, "label": "c", "priority": 2}]
    assert [x["label"] for x in evidence.chosen(spans)] == ["b", "c"]
    assert evidence.marked("a<b>c", [{"s": 1, "e": 4, "label": 'x"', "priority": 0}]) == 'a<mark title="x&quot;">&lt;b&gt;</mark>c'
    pages = spark.createDataFrame([("d", 1, page), ("d", 2, None)], "doc_id string, page int, text string")
    told = spark.createDataFrame([("d", 1, 0, "crime", "was <sold>"), ("d", 1, 1, "place", "Dubai"), ("d", 1, 2, "x", "sold> at")], "doc_id string, page int, ord int, label string, quotation string")
    got = {r.page: r for r in evidence.highlighted(pages, told).collect()}
    assert [(x.s, x.e, x.label) for x in got[1].spans] == [(10, 20, "crime"), (24, 29, "place")] and "&lt;sold&gt;</mark>" in got[1].markup and got[2].markup == ""


def test_jobs(tmp_path):
    jobs = J.Jobs(tmp_path)
    job = jobs.create("d", dpi=300)
    jobs.extend(job, 2)
    seen = []

    def work():
        told = jobs.reporter(job, "names", 2)
        told("done", 1)
        seen.append(job["pages"][1]["names"]["state"])
        told("error", 2)

    assert jobs.run(job, [("names", work)]) == "done_with_errors" and seen == ["running"]
    assert [(p["stage"], p["completed"], p["failed"], p["percent"]) for p in J.progress(job) if p["stage"] in ("names", "ocr")] == [("ocr", 0, 0, 0), ("names", 1, 1, 50)]
    job["pages"][0]["note"] = "kept"
    jobs.extend(job, 3)
    assert job["pages"][0]["note"] == "kept" and job["pages"][0]["names"]["state"] == "done" and len(job["pages"]) == 3
    other = jobs.create("e")
    assert jobs.run(other, [("ocr", lambda: jobs.request("e", "pause")), ("names", lambda: seen.append("never"))]) == "paused" and "never" not in seen
    assert [j["doc_id"] for j in jobs.all()] == ["e", "d"] and jobs.find(job["job_id"])["doc_id"] == "d" and jobs.find("x") == {}
    third = jobs.create("f")
    third["status"] = "running"
    jobs.save(third)
    jobs.request("f", "cancel")
    third["current_stage"] = "names"
    jobs.save(third)  # the request of another hand stays
    assert (third["cancel_requested"], third["status"]) == (True, "cancelling")
    assert jobs.adopt(third)["status"] == "cancelling"
    assert jobs.adopt(dict(third, updated_at="2020-01-01T00:00:00Z"))["status"] == "paused"
    assert jobs.request(jobs.create("g")["doc_id"], "pause")["status"] == "paused"
    for i in range(130):
        job["log_tail"] = [*job["log_tail"], str(i)][-J.LOG :]
    jobs.log(job, "hello")
    assert len(job["log_tail"]) == J.LOG and jobs.tail("d", 1)[0].endswith("hello")
    events = list(jobs.events("d", wait=0, idle=1))
    assert events[0]["event"] == "created" and {"page", "done", "log"} <= {e["event"] for e in events}
    failed = jobs.create("h")
    assert jobs.run(failed, [("ingest", lambda: 1 / 0)]) == "failed" and failed["errors"] == ["ingest: division by zero"]
    assert J.stages_to_run("recall", {"pass1", "pass1_filter", "recall", "recall_filter", "verify"}) == ["recall", "recall_filter", "merged", "verify", "rule_filter"]
    assert J.stages_to_run("verify", set()) == ["pass1", "pass1_filter", "recall", "recall_filter", "merged", "verify", "rule_filter"]


def test_images(spark):
    g = np.random.default_rng(0)
    for img in (g.integers(0, 256, (37, 53), np.uint8), g.integers(0, 256, (20, 31, 3), np.uint8)):
        assert (images.decode_png(images.encode_png(img)) == img).all()
    assert [t.shape[0] for t in images.split(np.zeros((1000, 10), np.uint8))] == [700, 700] and len(images.split(np.zeros((899, 10), np.uint8))) == 1
    assert images.fitted(np.zeros((3600, 100), np.uint8)).shape == (1800, 50) and images.fitted(np.zeros((100, 50), np.uint8)).shape == (100, 50)
    flat = images._resized(np.full((30, 20), 77, np.uint8), 7, 11)
    assert (flat == 77).all()
    page = np.full((1200, 900), 230, np.uint8)
    for y in range(300, 900, 40):
        page[y : y + 12, 200:700] = 20
    part, box = images.cropped(page)
    assert box == (140, 240, 620, 692) and part.shape == (692, 620)
    y, x = np.mgrid[0:600, 0:600] - 300
    t = np.radians(5)
    bars = np.where((np.abs(np.cos(t) * x + np.sin(t) * y) < 200) & (np.abs(-np.sin(t) * x + np.cos(t) * y) < 80), 20, 230).astype(np.uint8)
    assert abs(abs(images.skew(bars)) - 5) < 0.3 and abs(images.skew(images.deskewed(bars))) < 0.7
    assert images.otsu(np.array([[10, 12, 200, 210]], np.uint8)) in range(12, 200)
    even = images.equalised(np.tile(np.arange(100, 140, dtype=np.uint8), (64, 2)))
    assert even.max() - even.min() > 40
    tiles = spark.createDataFrame([(images.encode_png(page),), (None,)], "png binary").select(images.tiles_of("png", F.lit(True)).alias("t")).collect()
    assert [len(r.t) for r in tiles] == [1, 0] and images.decode_png(bytes(tiles[0].t[0])).ndim == 2


def test_transcription(spark, tmp_path):
    page = np.full((300, 200), 230, np.uint8)
    page[100:110, 50:150] = 0
    pages = spark.createDataFrame([("d", 1, images.encode_png(page)), ("d", 2, images.encode_png(np.full_like(page, 230)))], "doc_id string, page int, png binary")
    desk = model.Desk(str(tmp_path / "r"), lambda: type("T", (), {"generate": lambda self, p, b, image=None: "Here is the text\nfour words of text" if images.decode_png(image).shape != (300, 200) else ""})())
    assert {r.page: r.text for r in model.transcribed(desk, pages, "read").collect()} == {1: "four words of text", 2: "[OCR_EMPTY]"}


def test_scans(spark, tmp_path):
    (tmp_path / "My File.pdf").write_bytes(b"%PDF one")
    (tmp_path / "broken.pdf").write_bytes(b"x")
    (tmp_path / "notes.txt").write_text("no")
    (tmp_path / "p002.png").write_bytes(b"2")
    (tmp_path / "p010.JPG").write_bytes(b"10")

    def renderer(content, dpi):
        if not content.startswith(b"%PDF"):
            raise ValueError("not a PDF")

        def page(i):
            if i == 2:
                raise ValueError("page 3 is broken")
            return b"png%d" % i, dpi, dpi

        return 4, page

    files = scans.pdfs(spark, str(tmp_path))
    assert {(r.doc_id, r.size_bytes) for r in files.collect()} == {("My File", 8), ("broken", 1)}
    got = scans.rendered(files, renderer, dpi=72, start=2).collect()
    assert sorted((r.doc_id, r.page or 0, bytes(r.png or b""), r.error) for r in got) == [("My File", 2, b"png1", None), ("My File", 3, b"", "page 3 is broken"), ("My File", 4, b"png3", None), ("broken", 0, b"", "not a PDF")]
    with pytest.raises(ValueError):
        scans.rendered(files, renderer, dpi=71)
    assert scans.page_range(5, 2) == [2, 3, 4, 5] and scans.page_range(5, None, 1) == [1]
    for bad in ((5, 6), (5, 2, 1), (5, 1, 6), (0,)):
        with pytest.raises(ValueError):
            scans.page_range(*bad)
    assert [r.page for r in scans.images(spark, str(tmp_path)).collect()] == [2, 10]
    found = files.where("doc_id = 'My File'").select("doc_id", "sha256", F.lit(3).alias("page_count"))
    first = scans.manifest(found, None, 300)
    assert [(r.page, r.filename, r.status) for r in first.orderBy("page").collect()] == [(1, "p001.png", "pending"), (2, "p002.png", "pending"), (3, "p003.png", "pending")]
    before = first.withColumn("status", F.when(F.col("page") < 3, "done").otherwise("error"))
    there = spark.createDataFrame([("My File", "p001.png", 5), ("My File", "p002.png", 0)], "doc_id string, filename string, size long")
    assert [r.status for r in scans.manifest(found, before, 300, there).orderBy("page").collect()] == ["done", "pending", "error"]
    assert [r.status for r in scans.manifest(found, before, 200, there).orderBy("page").collect()] == ["pending"] * 3


def test_vocabulary_prompts_and_previews(tmp_path):
    (tmp_path / "v.yaml").write_text("# words\nname_stopwords:\n  - Clerk # late\ncrime_types:\n- theft\n- Theft\n- 'illegal detention'\nwhether_abuse_values:\n  - yes\n  - \"no\"\nplace_map:\n  basrah: Basra\n  dubai: Dibba\nversion: 2\n")
    v = vocabulary.Vocabulary.read(tmp_path / "v.yaml")
    assert {"clerk", "slave"} <= v.name_stopwords and v.place_map["basrah"] == "Basra" and v.place_map["dubai"] == "Dibba" and v.place_map["shargah"] == "Sharjah"
    assert v.categories["crime_types"] == ["theft", "illegal detention"] and v.categories["whether_abuse_values"] == ["yes", "no"] and len(v.categories["conflict_types"]) == 7
    assert vocabulary.Vocabulary.read(tmp_path / "none.yaml") == vocabulary.Vocabulary()
    (tmp_path / "old.txt").write_text(" legacy \n")
    assert vocabulary.prompt(tmp_path, "new", "a.txt", legacy=["none.txt", "old.txt"]) == "legacy" and vocabulary.prompt(tmp_path, "a.txt", fallback=" f ") == "f"
    (tmp_path / "t.csv").write_text("a,b\r\n1,\r\n2,x\r\n3,y\r\n")
    assert vocabulary.preview(tmp_path / "t.csv", 2) == [{"a": "1", "b": ""}, {"a": "2", "b": "x"}] and vocabulary.preview(tmp_path / "no.csv") == []
    assert vocabulary.counted_preview(tmp_path / "t.csv", 1) == {"exists": True, "headers": ["a", "b"], "rows": [{"a": "1", "b": ""}], "row_count": 3, "preview_truncated": True}


def test_sinks(spark, tmp_path):
    sinks.write_json(tmp_path / "x" / "a.json", {"é": [1]})
    assert (tmp_path / "x" / "a.json").read_text() == '{\n  "é": [\n    1\n  ]\n}' and len(list((tmp_path / "x").iterdir())) == 1
    assert sinks.csv_text([{"a": 1, "z": 2}, {"b": 'x"\n'}], ["a", "b"]) == 'a,b\r\n1,\r\n,"x""\n"\r\n'
    artifact = {"page": 3, "rows": [{"Name": "", "Place": "Dubai", "Page": None}], "people": [{"name": "Amina", "rows": [{"Place": "Muscat"}]}]}
    assert sinks.place_csv(artifact).splitlines()[1] == ",3,Dubai,,,," and sinks.place_csv(artifact, "AMINA").splitlines()[1] == "Amina,3,Muscat,,,,"
    assert sinks.place_csv(artifact).startswith("﻿Name,") and sinks.place_csv_name("d", 3, "Āmina B") == "d_p003_amina_b_places.csv"
    (tmp_path / "d").mkdir()
    for n in ("p001.places.json", "p001.meta.json"):
        (tmp_path / "d" / n).write_text("{}")
    assert sinks.clear_places(tmp_path / "d") == 1 and (tmp_path / "d" / "p001.meta.json").exists()
    with pytest.raises(RuntimeError):
        sinks.clear_results(tmp_path, [tmp_path / "d"], active=True)
    with pytest.raises(ValueError):
        sinks.clear_results(tmp_path / "d", [tmp_path / "x"])
    assert sinks.clear_results(tmp_path, [tmp_path / "d"]) and not (tmp_path / "d").exists()
    rows = spark.createDataFrame([(2, None), (1, 'q"')], "a int, b string")
    sinks.write_csv(rows.coalesce(1), str(tmp_path / "csv"), ["a", "b"], ["a"])
    assert "".join(p.read_bytes().decode() for p in sorted((tmp_path / "csv").glob("part*"))).count('1,"q"""\r\n') == 1


def test_cli(spark, root, capsys):
    for args, want in ((["normalize", "name", "the slave amina"], '"Amina"'), (["normalize", "date", "17th May", "--year", "1931"], "1931-05-17"), (["compare", "Faraj", "Salim"], "false"), (["--root", str(root), "documents"], '"Doc A"'), (["--root", str(root), "pages", "Doc A", "--stage", "meta"], "2"), (["--root", str(root), "aggregate", "Doc A"], '"unique_people": 1')):
        assert cli.main(args) == 0
        assert want in capsys.readouterr().out


def test_people_of_pages_and_upserts(spark):
    listed = candidates(spark, [("Faraj", ""), ("Ali", "")]).select("doc_id", "page", "ord", "name")
    pages = spark.createDataFrame([("d", 1, "text"), ("d", 2, "none")], "doc_id string, page int, text string")
    assert {(r.page, r.name, r.text) for r in people.with_text(listed, pages).collect()} == {(1, "Faraj", "text"), (1, "Ali", "text")}
    record = "doc_id string, page int, name string, record string"
    stored = spark.createDataFrame([("d", 1, "Ali", "old"), ("d", 1, "Zaid", "z"), ("d", 1, "Bilal", "b")], record)
    new = spark.createDataFrame([("d", 1, "ALI", "new"), ("d", 1, "Faraj", "f")], record)
    assert [(r.name, r.record) for r in people.upserted(stored, new, listed).orderBy("nth").collect()] == [("Faraj", "f"), ("ALI", "new"), ("Bilal", "b"), ("Zaid", "z")]


def test_totals_and_summaries(spark):
    calls = spark.createDataFrame([("d", 1, 2, 1, 1.25), ("d", 1, 4, 0, 2.5)], "doc_id string, page int, model_calls int, repair_calls int, elapsed_seconds double")
    assert tuple(aggregate.page_totals(calls).first()) == ("d", 1, 6, 1, 3.75)
    rows = [("a", 1, "done"), ("a", 2, "skipped"), ("b", 1, "done"), ("b", 2, "error"), ("c", 1, "done"), ("c", 2, "pending"), ("e", None, None)]
    got = {r.doc_id: r.status for r in aggregate.stage_summary(spark.createDataFrame(rows, "doc_id string, page int, state string")).collect()}
    assert got == {"a": "complete", "b": "partial_with_errors", "c": "partial", "e": "empty"}


def test_events_as_a_stream(spark, tmp_path):
    from foliant.streaming import events

    folder = tmp_path / "events"
    folder.mkdir()
    lines = [{"seq": i, "job_id": "j", "page": 1 + i % 2, "stage": "names", "state": s, "ts": f"2020-01-01T00:00:0{i}Z"} for i, s in enumerate(["running", "running", "done", "failed"])]
    for i in (0, 2):  # a file a batch of events
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, lines[i : i + 2])))
    states = events.stage_states(events.read_events(spark, str(folder)))
    query = states.writeStream.outputMode("complete").format("memory").queryName("stage_states_test").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.page: (r.state, r.started_at is not None, r.finished_at is not None) for r in spark.table("stage_states_test").collect()}
    assert got == {1: ("done", True, True), 2: ("failed", True, True)}
    same = events.stage_states(spark.read.schema(events.EVENTS).json(str(folder)))
    assert {r.page: r.state for r in same.collect()} == {1: "done", 2: "failed"}
