"""Journals as streams: offsets over a run that is killed, states from late and repeated events, a job without a sign of life, new artifacts alone."""

import json
import random
import time

import pytest

from foliant.streaming import follow, journal, states
from foliant.streaming.jobs import Jobs


def write(root, doc, events, end="\n"):
    (root / doc).mkdir(parents=True, exist_ok=True)
    with (root / doc / journal.NAME).open("ab") as f:
        f.write("".join(json.dumps(e, ensure_ascii=False) + "\n" for e in events).encode()[: None if end else -1])


def event(seq, page=1, state="running", stage="names", job="j", second=None, **more):
    return {"ts": f"2020-01-01T00:00:{(seq if second is None else second) % 60:02d}Z", "seq": seq, "event": "page", "job_id": job, "doc_id": job + "doc", "stage": stage, "page": page, "state": state} | more


def test_pieces_of_a_journal_have_each_line_once(tmp_path, monkeypatch):
    write(tmp_path, "d", [event(k, detail="é" * (k % 40)) for k in range(200)])
    with (tmp_path / "d" / journal.NAME).open("ab") as f:
        f.write(b"\nnot json\n{}\n" + json.dumps(event(200)).encode() + b"\n" + b'{"a line that isn')
    path = str(tmp_path / "d" / journal.NAME)
    end = journal.whole_lines(path)
    assert journal.journals(str(tmp_path)) == [path] and journal.journals(str(tmp_path / "none")) == []
    for size in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(journal, "PIECE", size)
        rows = [r for p in journal.pieces(path, 0, end) for r in journal._rows(p)]
        assert [r[2] for r in rows] == list(range(201))


def test_a_run_that_is_killed_neither_loses_nor_repeats(spark, tmp_path):
    root, out, check = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "check")
    write(root, "a", [event(k) for k in range(50)])

    def failing(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        raise RuntimeError("killed after it has written")

    query = follow.into(states.events(spark, str(root)), out, check, each=failing, mode="append")
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination(120)
    write(root, "a", [event(k) for k in range(50, 80)])
    write(root, "b", [event(k, job="k") for k in range(20)])
    for _ in range(2):  # the second finds nothing new
        follow.into(states.events(spark, str(root)), out, check, mode="append").awaitTermination(180)
    write(root, "b", [event(20, job="k")], end="")  # not a whole line yet
    follow.into(states.events(spark, str(root)), out, check, mode="append").awaitTermination(180)
    rows = [(r.job_id, r.seq) for r in follow.written(spark, out).collect()]
    assert sorted(rows) == [("j", k) for k in range(80)] + [("k", k) for k in range(20)]
    assert {(r.job_id, r.seq) for r in states.table(spark, str(root)).collect()} == set(rows)


def test_states_of_late_and_repeated_events(spark, tmp_path):
    """Events are cut into runs of the stream in a shuffled order, with repeats; the states are those of the whole list in order."""
    rng, all_events, want = random.Random(4), [], {}
    for page in range(1, 7):
        for stage in ("ocr", "names"):
            for seq, state in enumerate(rng.choice([["running", "done"], ["running", "failed", "running", "done"], ["skipped"], ["running"]])):
                all_events.append(event(seq * 10 + page, page, state, stage, error="bad" if state == "failed" else ""))
    for e in sorted(all_events, key=lambda e: e["seq"]):
        key = e["page"], e["stage"]
        began = want.get(key, (None, e["seq"]))[1]
        want[key] = (e["state"], began, e["seq"] if e["state"] in states.ENDED else None, "bad" if e["error"] or want.get(key, ("",) * 4)[3] else "")
    mixed = all_events + rng.sample(all_events, 8)
    rng.shuffle(mixed)
    root, out, check = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "check")
    for part in (mixed[:10], mixed[10:]):
        write(root, "d", part + [{"ts": "2020-01-01T00:00:00Z", "seq": 1, "event": "log", "job_id": "j", "doc_id": "d"}])
        follow.into(states.stage_states(states.events(spark, str(root))), out, check).awaitTermination(300)
    rows = states.latest(follow.written(spark, out), "job_id", "page", "stage").collect()
    got = {(r.page, r.stage): (r.state, r.started_at.second, r.finished_at.second if r.finished_at else None, r.error) for r in rows}
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items()}
    for r in rows:
        assert r.elapsed_seconds == (0 if r.finished_at is None else (r.finished_at - r.started_at).total_seconds())


def test_a_job_without_a_sign_of_life_is_paused(spark, tmp_path):
    root, out, check = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "check")
    jobs = Jobs(root)
    quiet, ended = jobs.create("quiet"), jobs.create("ended")
    for job in (quiet, ended):
        jobs.emit(job, "status", state="running")
    jobs.end(ended, "done")
    query = follow.into(states.job_states(states.events(spark, str(root)), silence=3), out, check, forever=True)
    try:
        until, found = time.time() + 150, {}
        while time.time() < until and found.get("quiet") != ("paused", states.ORPHANED):
            time.sleep(1)
            if query.exception():
                raise query.exception()
            if (tmp_path / "out").exists() and list((tmp_path / "out").glob("*/*.parquet")):
                found = {r.doc_id: (r.status, r.error) for r in states.latest(follow.written(spark, out), "doc_id").collect()}
    finally:
        query.stop()
    assert found == {"quiet": ("paused", states.ORPHANED), "ended": ("done", "")}


def test_states_do_not_depend_on_order():
    told = [("running", 1, 10, "", ""), ("done", 2, 20, "x", ""), ("running", 3, 30, "", ""), ("failed", 4, 40, "", "bad")]
    for _ in range(30):
        state = ("pending", -1, -1, -1, "", "")
        for s in random.sample(told * 2, 8):
            state = states.StageStates.after(state, *s)
        assert state[:4] == ("failed", 4, 10, 40) and state[5] == "bad"


def test_new_artifacts_alone(spark, tmp_path):
    root, out, check = tmp_path / "intermediate", str(tmp_path / "out"), str(tmp_path / "check")
    (root / "d 1").mkdir(parents=True)
    for page in (1, 2):
        (root / "d 1" / f"p{page:03d}.names.json").write_text(json.dumps({"page": page}))
    seen = []

    def count(batch, number):
        seen.append(batch.count())
        return batch

    for more in ([], [3], []):
        for page in more:
            (root / "d 1" / f"p{page:03d}.names.json").write_text('{"page":\n 3}')
        (root / "d 1" / "p009.meta.json").write_text("{}")
        follow.into(follow.new_artifacts(spark, str(root), "names"), out, check, each=count, mode="append").awaitTermination(120)
    assert sorted((r.doc_id, r.page, json.loads(r.content)["page"]) for r in follow.written(spark, out).collect()) == [("d 1", 1, 1), ("d 1", 2, 2), ("d 1", 3, 3)]
    assert sum(seen) == 3


def test_two_hands_on_one_job(tmp_path):
    """What each changes counts, and a request of a third stays."""
    one, two = Jobs(tmp_path), Jobs(tmp_path)
    job = one.create("d")
    other = two.load("d")
    job["note"], other["model"] = "mine", "yours"
    one.save(job)
    two.save(other)
    Jobs(tmp_path).request("d", "cancel")
    job["status"] = "running"
    one.save(job)
    assert (job["note"], job["model"], job["cancel_requested"]) == ("mine", "yours", True) and two.load("d") == job
    again = Jobs(tmp_path).load("d")
    assert again == job
