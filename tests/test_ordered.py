"""Ordered scans against plain loops: hot keys, sparse positions, nulls, several batches and tasks."""

import random

import pytest
from pyspark.sql import functions as F

from rdspark.operators.ordered import ordered_scan


def plain(rows):
    """(key, position, value, step, id) to (number, sum before, carried) by id."""
    seen, out = {}, {}
    for k, p, v, s, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[4])):
        n, total, last = seen.get(k, (0, 0, None))
        last = v if v is not None else last
        out[i] = (n, total, last)
        seen[k] = (n + 1, total + (s or 0), last)
    return out


def made(n: int, seed: int, hot: float):
    r = random.Random(seed)
    return [("hot" if r.random() < hot else r.choice(["a", "b", "c", None, f"k{r.randrange(60)}"]),
             r.choice([None, r.randrange(50), r.randrange(10 ** 15)]), r.choice([None] * 30 + ["x", "y", "z"]), r.choice([None, 0, 1, 5]), i) for i in range(n)]


@pytest.mark.parametrize("n,hot,batch,parts", [(3000, 0.4, 10_000, 7), (3000, 0.95, 16, 5), (40, 0.5, 1, 13), (500, 0.0, 100, 4), (1, 1.0, 10, 4)])
def test_scan_equals_a_loop(spark, n, hot, batch, parts):
    rows = made(n, n + parts, hot)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "k string, p long, v string, s int, id int").repartition(3)
        got = ordered_scan(df, ["k"], ["p", "id"], number="n", sums={"before": "s"}, carry={"last": "v", "pair": F.when(F.col("v").isNotNull(), F.struct("v", "id"))})
        rows_of = {r["id"]: r for r in got.collect()}
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)
    want = plain(rows)
    assert {i: (r["n"], r["before"], r["last"]) for i, r in rows_of.items()} == want
    assert all((r["pair"] and r["pair"]["v"]) == r["last"] for r in rows_of.values())
    assert got.columns == ["k", "p", "v", "s", "id", "n", "before", "last", "pair"]


def test_whole_table_and_clashing_names(spark):
    df = spark.createDataFrame([(float(k % 5), k, "x") for k in range(200)], "number double, at int, s0 string")
    got = ordered_scan(df, [], [F.col("at").desc()], number="number")
    assert sorted((r["at"], r["number"]) for r in got.collect()) == [(k, 199 - k) for k in range(200)]
    assert ordered_scan(df.limit(0), ["s0"], ["at"], number="n", carry={"c": "number"}).count() == 0


def test_one_scan_and_many_tasks(spark):
    """One shuffle of the rows, written once; a hot key is dealt out over the tasks."""
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 97).otherwise(-1).alias("k"), (F.col("id") * F.col("id")).alias("p"))
    got = ordered_scan(df, ["k"], ["p"], number="n")
    assert got.where("k = -1").select("__part" if "__part" in got.columns else F.spark_partition_id().alias("t")).distinct().count() > 1
    assert got.where("k = -1").agg(F.max("n"), F.countDistinct("n")).first()[:] == (13332, 13333)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.count("Scan parquet") <= 3
