"""Golden cases of name roles, senders and arrivals; queries over records against the oracle."""

import duckdb
import pytest

from foliant.functions import scalar as S
from foliant.plans import catalogue, records
from foliant.plans.dialect import SPARK as D

SF = "/root/testdata/sf0.001"
NAME = "Mariam bint Yusuf"


def value(spark, text, expression):
    return spark.createDataFrame([(text, NAME)], "x string, n string").selectExpr(f"{S.marked(D, 'x', 'n')} as m", "x").selectExpr(f"{expression} as y").first().y


@pytest.mark.parametrize("text, speaking, against", [("Statement of slave Mariam  bint Yusuf, aged 30", "statement_of_subject", ""), ("sold me to one MARIAM BINT YUSUF.", "", "sold_to_buyer"), ("a letter from Māriam bint Yusuf", "", "letter_from"), ("a slave of X, named Mariam bint Yusufi", "", ""), ("manumission of Mariam bint Yusuf by her master Said", "manumission_context", ""), ("", "", ""), (None, "", "")])
def test_roles(spark, text, speaking, against):
    assert (value(spark, text, S.first_role(D, "m", S.ROLES_FOR)), value(spark, text, S.first_role(D, "m", S.ROLES_AGAINST))) == (speaking, against)


def test_free_born(spark):
    assert value(spark, "She is Free Born and not a slave", S.free_born(D, "m")) is True
    assert value(spark, "She is free", S.free_born(D, "m")) is False


@pytest.mark.parametrize("text, place, when", [("arrived at Dubai on 17th May 1931, well", "Dubai", " 17th May 1931"), ("arriving in Ras al Khaimah about the 20th.", "Ras al Khaimah", " 20th"), ("Arrived Kuwait.", "Kuwait", ""), ("left Kuwait.", "", "")])
def test_arrival(spark, text, place, when):
    assert (value(spark, text, D.extract("x", S.ARRIVING, 1)), value(spark, text, D.extract("x", S.ARRIVING_WHEN, 2))) == (place, when)


@pytest.mark.parametrize("name", sorted(records.QUERIES))
def test_records(spark, name):
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = records.QUERIES[name](spark, SF)
    found = con.execute(records.SQL[name])
    names = [x[0] for x in found.description]
    rows = found.fetchall()
    assert rows and sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, rows))


def test_every_role_occurs(spark):
    kinds = {r.reason_type for r in records.QUERIES["name_roles"](spark, SF).select("reason_type").distinct().collect()}
    assert kinds >= {"freeborn_not_slave", "positive_rule", "negative_rule", "strong_local_signal", "ambiguous_subject_role"}


def test_routes_are_numbered(spark):
    df = records.QUERIES["reconciled_routes"](spark, SF)
    assert df.where("pos > 1").count() > 0 and df.where("pos = 0").count() > 0
    assert df.where("pos > 0").groupBy("page", "name").agg({"pos": "max", "*": "count"}).where("`max(pos)` <> `count(1)`").count() == 0


def test_values_of_common_keys_are_broadcast_and_others_made_in_place(spark, monkeypatch):
    """No join by a value with few keys moves the rows; keys beyond the common ones give the same."""
    from foliant.plans import dialect
    from foliant.plans.dialect import SPARK

    spark.range(60).selectExpr("id", "concat('n', pmod(id * id, 7)) as raw", "if(id % 9 = 0, null, id % 4) as k").createOrReplaceTempView("given")
    told = {"a": (("raw",), "upper(raw)"), "b": (("raw", "k"), "concat(raw, coalesce(k, -1))"), "c": ((), "id + 1")}
    whole = {(r.id, r.raw.upper(), r.raw + str(-1 if r.k is None else r.k), r.id + 1) for r in spark.table("given").collect()}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (20_000, 2):
            monkeypatch.setattr(dialect, "COMMON", most)
            for sql in (SPARK.over("given", "id", **told), f"select id, a, b, id + 1 as c from ({SPARK.mapped('given', 's.id, s.b', ('raw',), a='upper(raw)').replace('s.b', 's.raw, s.k')}) join (select id as i, concat(raw, coalesce(k, -1)) as b from given) on id = i"):
                assert {tuple(r) for r in spark.sql(sql).select("id", "a", "b", "c").collect()} == whole
        plan = spark.sql(SPARK.over("given", "id", **told))._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
