"""Queries over artifacts and replies against SQL written by hand on the tables; the entry module without the operators of llm."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from foliant.plans import catalogue, documents, journeys, records

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", [*documents.QUERIES, "folded_places", "skip_propagation", "gated_pages", "name_roles"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    found = con.execute(__spark_entry__.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, found.fetchall()))


def test_every_query_of_the_core_has_sql():
    core = catalogue.QUERIES | records.QUERIES | documents.QUERIES | journeys.QUERIES
    assert set(core) == set(catalogue.SQL | records.SQL | documents.SQL | journeys.SQL)


@pytest.mark.parametrize("missing", ["foliant.llm", "xxhash", "corpus_pipeline"])
def test_entry_works_without(missing):
    code = f"import sys; sys.modules[{missing!r}] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), 'pipeline' in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    n, pipeline = done.stdout.split()
    assert int(n) >= len(catalogue.QUERIES | records.QUERIES | documents.QUERIES) and pipeline == "False"
