"""Every query that has SQL gives the rows of DuckDB on the same tables; the others run and have rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from tessera.plans import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool | str):
        return value
    if isinstance(value, int | float):
        return round(float(value), 9)
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return str(value)


def ordered(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    run, sql = QUERIES[name]
    df = run(spark, sf_dir)
    r = duck.execute(sql)
    names = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(names)
    assert ordered([tuple(x) for x in df.collect()], df.columns) == ordered(r.fetchall(), names)


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0


def test_sql_keys_are_queries():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", ["q15_questionnaire", "b03_within_set_permutation", "b04_sign_flip", "l17_raster_quality", "l18_aligned_average", "q07_adjusted_effect_hc3"])
def test_other_queries_run(spark, sf_dir, name):
    assert QUERIES[name][0](spark, sf_dir).count() > 0


def test_whole_orders_are_used(spark, sf_dir):
    from pyspark.sql import functions as F

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("g", (F.col("o_orderstatus") == "F").cast("int"))
    sets = orders.groupBy("o_custkey").agg(F.min("g").alias("a"), F.max("g").alias("b")).filter("a = 0 and b = 1").count()
    assert QUERIES["b06_set_bootstrap"][0](spark, sf_dir).first()["n_sets"] == sets
    means = orders.groupBy("g").agg(F.avg("o_totalprice").alias("m")).orderBy("g").collect()
    found = {r["metric"]: r["difference"] for r in QUERIES["b03_within_set_permutation"][0](spark, sf_dir).collect()}
    assert abs(abs(found["m1"]) - abs(means[1]["m"] - means[0]["m"])) < 1e-3
    counts = {r["o_orderstatus"]: r["count"] for r in orders.groupBy("o_orderstatus").count().collect()}
    assert {r["group"]: r["n"] for r in QUERIES["q04_fairness_table"][0](spark, sf_dir).collect()} == counts | {"Overall": sum(counts.values())}
