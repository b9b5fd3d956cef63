import pytest
from pyspark.sql import functions as F

from rdspark.operators import curation as cu


def ping_pong(length, n):
    """The walk, step by step; a single frame repeats."""
    out, at, up = [], 0, True
    while len(out) < n:
        out.append(at)
        if length == 1:
            continue
        if up and at == length - 1 or not up and at == 0:
            up = not up
        at += 1 if up else -1
    return out


def test_clips(spark):
    df = spark.createDataFrame([(i, length, 300, 200) for i, length in enumerate([1, 2, 3, 5, 16, 17, 18, 60])], "seq_id bigint, seq_length int, width int, height int")
    got = cu.sample_clips(df, 17, 256, 256, (1.0, 768.0), epoch=2, seed=5)
    for r in got.collect():
        if r["seq_length"] <= 17:
            assert r["frame_indexes"] == ping_pong(r["seq_length"], 17)
        else:
            first = r["frame_indexes"][0]
            assert 0 <= first <= r["seq_length"] - 17 - 1 and r["frame_indexes"] == list(range(first, first + 17))
        assert 0 <= r["crop_x"] <= 300 - 256 and r["crop_y"] == 0 and (r["pad_top"], r["pad_bottom"], r["pad_left"]) == (28, 28, 0)
        assert 0 <= r["qp"] < 64 and r["lam"] == pytest.approx(768 ** (r["qp"] / 63))
    starts = cu.sample_clips(spark.range(3000).select(F.col("id").alias("seq_id"), F.lit(20).alias("seq_length"), F.lit(300).alias("width"), F.lit(300).alias("height")),
                             17, 256, 256, (1.0, 2.0)).groupBy("clip_start").count().collect()
    assert {r["clip_start"] for r in starts} == {0, 1, 2} and all(800 < r["count"] < 1200 for r in starts)


def test_groups(spark):
    df = spark.createDataFrame([(1, list(range(10))), (2, [7]), (3, [1, 2, 3])], "id int, frame_indexes array<int>")
    got = {(r["id"], r["group_no"]): r["frames"] for r in cu.clip_groups(df, 4).collect()}
    assert got == {(1, 0): [0], (1, 1): [1, 2, 3, 4], (1, 2): [5, 6, 7, 8], (2, 0): [7], (3, 0): [1]}


@pytest.mark.parametrize("n,world", [(100, 7), (3, 8), (64, 8), (1, 5)])
def test_shards_cover_everything(spark, n, world):
    s = cu.shard(cu.shuffle_order(spark.range(n), "id", 1, 3, buckets=16), world).collect()
    per = -(-n // world)
    assert len(s) == per * world and {r["id"] for r in s} == set(range(n))
    assert all(sorted(r["rank_pos"] for r in s if r["rank"] == k) == list(range(per)) for k in range(world))
    extra = per * world - n
    assert sum(1 for r in s if r["place"] < n) == n and sum(1 for r in s if r["place"] >= n) == extra
    order = [r["id"] for r in sorted(s, key=lambda r: r["place"])]
    assert order[n:] == (order[:n] * world)[:extra]


def test_epochs_reshuffle(spark):
    order = lambda e: [r["id"] for r in cu.shuffle_order(spark.range(200), "id", e, 3).orderBy("rn").collect()]
    assert order(1) == order(1) and order(1) != order(2) and sorted(order(2)) == list(range(200))


def test_batches(spark):
    b = cu.batches(cu.shard(cu.shuffle_order(spark.range(103), "id", 1, 3), 4), 20, 4)
    sizes = {(r["rank"], r["batch_no"]): r["count"] for r in b.groupBy("rank", "batch_no").count().collect()}
    assert sizes == {(k, n): 5 for k in range(4) for n in range(5)}
    with pytest.raises(ValueError):
        cu.batches(cu.shard(cu.shuffle_order(spark.range(10), "id", 1, 3), 3), 20, 3)


@pytest.mark.parametrize("n,world", [(1, 3), (2, 2), (5, 2), (99, 7), (100, 7), (101, 8), (1000, 1)])
def test_permutations_are_exact(spark, n, world):
    rows = lambda e: [r["rn"] for r in cu.permuted(spark.range(n).select(F.col("id").alias("index"), F.lit(n).cast("long").alias("total")), e, 3).orderBy("index").collect()]
    assert sorted(rows(1)) == list(range(n)) and rows(1) == rows(1)
    if n > 50:
        a, b = rows(1), rows(2)
        assert a != b and sum(x == k for k, x in enumerate(a)) < 8 and sum(abs(x - y) == 1 for x, y in zip(a, a[1:])) < n / 5


def test_file_index_counts_over_files_and_moves_nothing(spark, tmp_path):
    spark.range(0, 5000, numPartitions=4).write.option("maxRecordsPerFile", 700).parquet(f"{tmp_path}/s")
    got = cu.permuted(cu.file_index(spark.read.parquet(f"{tmp_path}/s")), 1, 3)
    rows = got.collect()
    assert sorted(r["index"] for r in rows) == list(range(5000)) == sorted(r["rn"] for r in rows) and {r["total"] for r in rows} == {5000}
    assert {r["id"]: r["index"] for r in rows} == {r["id"]: r["index"] for r in cu.file_index(spark.read.parquet(f"{tmp_path}/s")).collect()}
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1      # counts of the files only


def test_schedules(spark):
    stretches = [("a", 10, 0.5), ("a", 0, 1.0), ("b", 3, 0.1), ("a", 12, 0.25)]
    table = spark.createDataFrame(stretches, "plan string, first_epoch int, lr double")
    df = spark.createDataFrame([("a", e) for e in (0, 9, 10, 11, 12, 900)] + [("b", 3), ("b", 4)], "plan string, epoch int").withColumn("lr", F.lit("old"))
    got = {(r["plan"], r["epoch"]): r["lr"] for r in cu.with_schedule(df, table, ["plan"]).collect()}
    assert got == {("a", 0): 1.0, ("a", 9): 1.0, ("a", 10): 0.5, ("a", 11): 0.5, ("a", 12): 0.25, ("a", 900): 0.25, ("b", 3): 0.1, ("b", 4): 0.1}
    one = cu.with_schedule(df.where("plan = 'a'"), table.where("plan = 'a'").drop("plan"))
    assert {r["epoch"]: r["lr"] for r in one.collect()} == {e: v for (p, e), v in got.items() if p == "a"}
    for rows, schedule in (([("b", 2)], stretches), ([("c", 2)], stretches), ([("a", None)], stretches), ([("a", 1)], [*stretches, ("a", 10, 3.0)])):
        with pytest.raises(Exception, match="stretch"):
            cu.with_schedule(spark.createDataFrame(rows, "plan string, epoch int"), spark.createDataFrame(schedule, "plan string, first_epoch int, lr double"), ["plan"]).collect()


def test_plans(spark):
    rows = cu.standard_schedules()
    last = {r[:2]: r[2] for r in rows}
    assert last["ld", "stage0"] == 55 and last["ht", "stage0"] == 45 and last["image", "stage0"] == 105
    df = spark.createDataFrame([(e,) for e in (0, 9, 14, 500)], "epoch int")
    for unit in (8, 4):
        got = cu.with_epoch_plan(df, "ht", "stage0", unit_frames=unit).orderBy("epoch").collect()
        assert [r["frame_num"] for r in got] == [1 + unit, 1 + 2 * unit, 1 + 4 * unit, 1 + 4 * unit]
    with pytest.raises(ValueError):
        cu.with_epoch_plan(df, "ht", "stage9")
