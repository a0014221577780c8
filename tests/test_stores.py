"""Pages of PDF files as a source that opens what is asked for; versions of tables that are there whole or not at all."""

import threading

import pytest
from pyspark.sql import functions as F

from foliant.snapshots import Conflict, Snapshots
from foliant.sources.pdf_pages import doc_id, pdf_pages


@pytest.fixture
def paper(tmp_path):
    folders = {}
    for name, count, size in (("My File", 40, 5000), ("other.v2", 3, 10), ("sub/deep", 2, 10)):
        seen = folders[name] = tmp_path / "seen" / name.replace("/", "_").replace(" ", "_")
        seen.mkdir(parents=True)
        path = tmp_path / "in" / f"{name}.PDF"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(f"%PDF {count} {seen} ".encode() + b"x" * size)
    (tmp_path / "in" / "broken.pdf").write_bytes(b"x")
    (tmp_path / "in" / "notes.txt").write_text("no")
    count = lambda name, kind: len(list(folders[name].glob(f"{kind}-*")))
    return str(tmp_path / "in"), count


def test_all_pages_of_large_files_are_shared_among_tasks(spark, paper):
    root, count = paper
    df = pdf_pages(spark, root, "tests.paper:renderer", dpi=72, task_bytes=1000)
    rows = df.collect()
    got = sorted((r.doc_id, r.page or 0, bytes(r.png or b""), r.error) for r in rows)
    want = [(d, n, b"" if n == 7 else b"png %d" % n, "page 7 is broken" if n == 7 else None) for d, c in (("My File", 40), ("deep", 2), ("other.v2", 3)) for n in range(1, c + 1)]
    assert got == sorted([*want, ("broken", 0, b"", "not a PDF")]) and {(r.width, r.height) for r in rows if r.png} == {(72, 144)}
    assert count("My File", "open") == 6 and count("My File", "page") == 39
    assert max(df.groupBy(F.spark_partition_id()).count().toPandas()["count"]) <= 8


def test_only_what_is_asked_for_is_rendered(spark, paper):
    root, count = paper
    df = pdf_pages(spark, root, "tests.paper:renderer", dpi=72, task_bytes=1000)
    rows = df.where("doc_id = 'My File' and page between 3 and 6 and page <> 4").collect()
    assert sorted(r.page for r in rows) == [3, 5, 6]
    assert (count("My File", "page"), count("other.v2", "open"), count("sub/deep", "open")) == (4, 0, 0)
    assert [r.page for r in df.where("page = 2").collect()] == [2, 2, 2] and count("My File", "page") == 5
    assert sorted(r.page for r in df.where("page in (1, 2) and doc_id = 'deep'").collect()) == [1, 2]
    assert df.where("doc_id = 'none'").count() == 0 and doc_id(" a:b .") == "a_b"
    with pytest.raises(Exception, match="between 72 and 600"):
        pdf_pages(spark, root, "tests.paper:renderer", dpi=10).count()


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_a_failed_commit_leaves_all_tables_as_they_were(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "t"))
    assert s.version() == 0 and s.tables() == {}
    assert s.commit({"a": spark.createDataFrame([(1, "x")], "k int, v string"), "b": spark.createDataFrame([], "k int")}, 0) == 1
    bad = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise("ok").alias("v"))
    with pytest.raises(Exception, match="lost"):
        s.commit({"a": spark.createDataFrame([(2, "y")], "k int, v string"), "b": bad}, 1)
    assert s.version() == 1 and rows_of(s.read("a")) == [(1, "x")] and rows_of(s.read("b")) == [] and s.read("b").columns == ["k"]
    assert {n.split("-")[0] for n in s.unnamed()} == {"a", "b"}
    assert s.commit({"a": spark.createDataFrame([(2, "y")], "k int, v string")}, 1) == 2
    assert rows_of(s.read("a")) == [(2, "y")] and rows_of(s.read("a", 1)) == [(1, "x")] and s.tables()["b"] == s.tables(1)["b"]
    with pytest.raises(Conflict):
        s.commit({"a": spark.range(1)}, 1)
    with pytest.raises(KeyError):
        s.read("c")


def test_two_writers_lose_no_row_and_no_flag(spark, tmp_path):
    root, failed = str(tmp_path / "t"), []

    def work(who):
        try:
            for n in range(4):
                rows = [("job", f"flag {who}", n), (f"page {n}", "state", who), (None, who, n)]
                Snapshots(spark, root).merge("jobs", spark.createDataFrame([(a, b, str(c)) for a, b, c in rows], "k string, field string, v string"), ["k", "field"])
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(w,)) for w in ("one", "two")]
    for t in threads:
        t.start()
    for t in threads:
        t.join(240)
    assert not failed
    s = Snapshots(spark, root)
    rows = {(r.k, r.field): r.v for r in s.read("jobs").collect()}
    assert s.version() == 8 and len(rows) == s.read("jobs").count() == 8
    assert all(rows["job", f"flag {w}"] == rows[None, w] == "3" for w in ("one", "two")) and {rows[f"page {n}", "state"] for n in range(4)} <= {"one", "two"}
