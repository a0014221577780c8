"""Golden cases of the scalar functions, the fold and the clusters, and the catalogue against its oracle."""

import duckdb
import pytest

import __spark_entry__
from foliant.functions import scalar as S
from foliant.operators.clusters import canonical_names
from foliant.operators.folds import fold_places
from foliant.plans import catalogue
from foliant.plans.dialect import SPARK

SF = "/root/testdata/sf0.001"


def one(spark, f, x, *more):
    return spark.createDataFrame([(x,)], "x string").selectExpr(f"{f(SPARK, 'x', *more)} as y").first().y


@pytest.mark.parametrize("raw, want", [("  mariam   BINT   YUSUF  ", "Mariam bint Yusuf"), ("the slave āmina ibn salim", "Amina bin Salim"), (None, ""), ("", "")])
def test_name(spark, raw, want):
    assert one(spark, S.name, raw) == want


@pytest.mark.parametrize("raw, want", [("shargah", "Sharjah"), ("busheir", "Bushehr"), ("ras ul khaimah", "Ras al Khaimah"), (None, "")])
def test_place(spark, raw, want):
    assert one(spark, S.place, raw) == want


@pytest.mark.parametrize("raw, want", [("H.M.S. Lawrence", False), ("Agency", False), ("Without The Slightest Pressure On Either", False), ("Sharjah", True)])
def test_valid_place(spark, raw, want):
    assert one(spark, S.valid_place, raw) is want


@pytest.mark.parametrize("raw, year, want", [("17-5-1931", "null", ("1931-05-17", "explicit")), ("17th May 1931", "null", ("1931-05-17", "explicit")), ("May 17, 1931", "null", ("1931-05-17", "explicit")), ("17th May", "1931", ("1931-05-17", "derived_from_doc")), ("arrived 1931-05-17", "null", ("1917-05-31", "derived_from_doc")), ("5 of 17 May", "1931", ("", "")), ("31-2-1931", "null", ("1931-02-31", "explicit")), ("1/2/193", "null", ("0193-02-01", "explicit"))])
def test_date(spark, raw, year, want):
    iso, confidence = S.iso_date(SPARK, "x", f"cast({year} as int)")
    assert tuple(spark.createDataFrame([(raw,)], "x string").selectExpr(f"{iso} as a", f"{confidence} as b").first()) == want


def test_fold(spark):
    rows = [(1, 1, "A", "Sharjah", 2, "", "", "", ""), (1, 2, "A", "Sharjah", 1, "1931-05-17", "explicit", "", ""), (1, 3, "A", "Dubai", 2, "", "", "", ""), (1, 4, "A", "Muscat", -1, "", "", "", "")]
    df = spark.createDataFrame(rows, "page int, ord int, name string, place string, pos int, arrival string, confidence string, time string, evidence string")
    got = {r.place: (r.pos, r.arrival, r.confidence) for r in fold_places(df, "page").collect()}
    assert got == {"Sharjah": (1, "1931-05-17", "explicit"), "Dubai": (2, "", "")}


def test_clusters(spark):
    df = spark.createDataFrame([("d", 1, "Mariam bint Yusuf"), ("d", 2, "Marium bint Yousuf"), ("d", 3, "Faraj")], "doc_id string, ord int, name string")
    assert {r.name: r.canonical for r in canonical_names(df).collect()} == {"Mariam bint Yusuf": "Mariam bint Yusuf", "Marium bint Yousuf": "Mariam bint Yusuf", "Faraj": "Faraj"}


@pytest.mark.parametrize("name", ["status_rows", "dates_iso", "reranked_places", "rule_hints", "route_validation", "route_retries", "histograms"])
def test_catalogue(spark, name):
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    found = con.execute(catalogue.SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, found.fetchall()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("text,confident,uncertain", [("He ARRIVED at Muscat", True, False), ("wished to be sent to Dubai", True, True), ("requested leave and reached Basra", True, False), ("certificate for  delivery", False, True), ("", False, False), ("an arrival", False, False)])
def test_move_texts(spark, text, confident, uncertain):
    assert (one(spark, S.confident_move, text), one(spark, S.uncertain_move, text)) == (confident, uncertain)
