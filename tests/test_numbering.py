import random

import pytest
from pyspark.sql import functions as F

from rdspark.operators import numbering as nb, ordered, packets as pk, structure as st


@pytest.fixture(scope="module")
def hot(spark):
    """One key owns most rows, positions are sparse and repeat."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else rng.choice("abc"), rng.randrange(0, 5000), i) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k string, pos int, id int")


@pytest.mark.parametrize("span", [1, 64, 1000, 65536])
def test_number_within_equals_a_plain_count(hot, span):
    rows, df = hot
    got = {r["id"]: (r["n"], r["t"]) for r in nb.number_within(df, ["k"], ["pos", "id"], "pos", out="n", span=span, total="t").collect()}
    for key in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == key], key=lambda r: r[1:])
        assert [got[r[2]] for r in mine] == [(i, len(mine)) for i in range(len(mine))]


def test_number_within_whole_table(hot):
    rows, df = hot
    got = nb.number_within(df, [], ["pos", "id"], "pos", out="n", span=100).orderBy("n").collect()
    assert [(r["pos"], r["id"]) for r in got] == sorted((r[1], r[2]) for r in rows)
    assert [r["n"] for r in got] == list(range(len(rows)))


def test_contiguous_prefix(spark):
    rows = [("a", i) for i in (1, 2, 3, 5, 6)] + [("b", i) for i in (2, 3)] + [("c", i) for i in range(0, 200)]
    df = spark.createDataFrame(rows, "s string, n int")
    got = ordered.contiguous_prefix(df, ["s"], "n", start=1).groupBy("s").agg(F.max("n").alias("m"), F.count("*").alias("c")).collect()
    assert {(r["s"], r["m"], r["c"]) for r in got} == {("a", 3, 3), ("c", 199, 199)}


def test_unfold_large_row(spark):
    df = spark.createDataFrame([("a", 100000), ("b", 3), ("c", 0)], "k string, n int")
    got = nb.unfold(df, "n", "i", block=1000)
    assert {(r["k"], r["c"], r["lo"], r["hi"]) for r in got.groupBy("k").agg(
        F.countDistinct("i").alias("c"), F.min("i").alias("lo"), F.max("i").alias("hi")).collect()} == {("a", 100000, 0, 99999), ("b", 3, 0, 2)}
    parts = got.filter("k = 'a'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1


def test_spread_join_keeps_every_row(hot, spark):
    rows, df = hot
    facts = spark.createDataFrame([("hot", 1), ("a", 2)], "k string, f int")
    left = nb.spread_join(df, facts, ["k"], "id")
    assert left.count() == len(rows)
    assert left.filter("f = 1").count() == sum(r[0] == "hot" for r in rows)
    assert nb.spread_join(df, facts, ["k"], "id", how="inner").count() == sum(r[0] in ("hot", "a") for r in rows)


def walk(frames: int, period: int, delay: int, interval: int):
    """The unit rule, frame by frame."""
    out, idx, unit = [], 0, 0
    while idx < frames:
        intra = idx == 0 or period == 1 or (period > 1 and idx != 1 and idx % period == 1)
        size = 1 if intra else min(delay, frames - idx)
        reset = int(not intra and interval > 0 and (idx + delay) % interval == 1)
        out += [(idx + k, 0 if intra else 1, unit, idx, k, size, reset) for k in range(size)]
        idx, unit = idx + size, unit + 1
    return out


@pytest.mark.parametrize("delay", [1, 8])
def test_coding_units_follow_the_walk(spark, delay):
    cases = [(n, p) for n in (1, 2, 8, 9, 10, 33, 34, 65, 97, 150) for p in (-1, 0, 1, 8, 16, 32, 64)] + ([(60, 2), (60, 3)] if delay == 1 else [])
    jobs = spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(cases)], "job int, frame_num int, intra_period int")
    got = {}
    for r in st.coding_units(st.expand_frames(jobs), delay=delay).collect():
        got.setdefault(r["job"], []).append((r["frame_idx"], r["frame_type"], r["unit_no"], r["unit_start"], r["unit_pos"], r["unit_frames"], r["reset"]))
    for i, (n, p) in enumerate(cases):
        assert sorted(got[i]) == walk(n, p, delay, 32), (n, p)


def test_coding_units_reject_a_misfit_period(spark):
    jobs = spark.createDataFrame([(20, 12)], "frame_num int, intra_period int")
    with pytest.raises(Exception, match="multiple of the unit length"):
        st.coding_units(st.expand_frames(jobs), delay=8).collect()


def test_active_sets_and_ids(spark):
    rows = [("s", 0, 0, 0, 64, 64), ("s", 1, 1, 0, None, None), ("s", 2, 2, 1, None, None), ("s", 3, 0, 0, 80, 96), ("s", 4, 2, 0, None, None)]
    df = spark.createDataFrame(rows, "stream string, unit_no int, nal_type int, sps_id int, height int, width int")
    got = {r["unit_no"]: (r["sps_unit"], r["height"], r["width"], r["valid"]) for r in pk.active_parameter_set(df).collect()}
    assert got == {1: (0, 64, 64, True), 2: (None, None, None, False), 4: (3, 80, 96, True)}
    many = spark.createDataFrame([("s", i, 16 * (i % 17), 16) for i in range(40)], "stream string, unit_no int, height int, width int")
    ids = {r["unit_no"]: (r["sps_id"], r["sps_new"]) for r in pk.allocate_ids(many, strict=False).collect()}
    assert ids == {i: (i % 17, i < 17) for i in range(40)}
    with pytest.raises(Exception, match="parameter sets"):
        pk.allocate_ids(many).collect()
