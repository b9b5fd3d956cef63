import datetime as dt
import random

from pyspark.sql import functions as F

from rdspark.operators.packets import active_parameter_set
from rdspark.sources.storage import scratch_path
from rdspark.streaming import packets as sp, results as sr


SCHEMA = "stream bigint, unit_no bigint, nal_type int, sps_id int, height int, width int"
COLS = ["stream", "unit_no", "sps_id", "sps_unit", "height", "width", "valid"]


def units(n):
    return [(u % 3, u, 0 if u % 13 < 2 else 2, u % 4, 64 + u if u % 13 < 2 else None, 32 + u if u % 13 < 2 else None) for u in range(n)]


def run(spark, base, batches, **options):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{base}/in")
        sp.stateful_packets(stream, f"{base}/out", f"{base}/cp", **options).awaitTermination()
    rows = [tuple(r) for r in spark.read.parquet(f"{base}/out/slices").select(*COLS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_parameter_sets_live_on_between_batches(spark):
    rows = units(200)
    got = run(spark, scratch_path(spark, "st"), [rows[k:k + 50][::-1] for k in range(0, 200, 50)])
    assert got == {tuple(r) for r in active_parameter_set(spark.createDataFrame(rows, SCHEMA)).select(*COLS).collect()}


def test_settled_slices():
    import numpy as np
    found = sp.settled_slices(np.array([1, 3, 9, 4]), np.array([2, 4]), np.array([10, 20]), np.array([5, 6]))
    assert [x.tolist() for x in found][1:3] == [[10, 10, 20, 10], [5, 5, 6, 5]] and found[3].tolist() == [False, True, True, True]
    assert not sp.settled_slices(np.array([1]), *[np.zeros(0, np.int64)] * 3)[3].any()


def test_units_out_of_order_across_batches(spark):
    """Units come up to 30 numbers late, so sets arrive behind slices that need them; a later batch settles what waits."""
    r = random.Random(4)
    rows = units(180)
    late = sorted(rows, key=lambda x: x[1] + r.random() * 30)
    closing = [(s, 1000 + 4 * k + i, 2, i, None, None) for k, s in enumerate(range(3)) for i in range(4)]
    got = run(spark, scratch_path(spark, "late"), [late[:60], late[60:120], [*late[120:], *closing]], disorder=30)
    want = {tuple(r) for r in active_parameter_set(spark.createDataFrame([*rows, *closing], SCHEMA)).select(*COLS).collect()}
    assert {g for g in got if g[1] < 900} == {w for w in want if w[1] < 900}


POINTS = "method string, dataset string, sequence string, rate_idx int, i_frame_num bigint, p_frame_num bigint, frame_num bigint"


def test_ingest_takes_each_point_once(spark):
    """Ten micro-batches with points that come again; buckets are compacted on the way, and old parts can go."""
    base = scratch_path(spark, "in")
    part = lambda lo, hi, short: spark.createDataFrame([("m", "d", f"s{i}", 0, 1, 9 - (i in short), 10) for i in range(lo, hi)], POINTS)
    for k in range(7):
        part(3 * k, 3 * k + 6, {3 * k + 5}).coalesce(1).write.mode("append").json(f"{base}/landing")
        sr.ingest_results(sr.point_stream(spark, f"{base}/landing"), f"{base}/store", f"{base}/cp", buckets=4, every=2).awaitTermination()
    want = sorted(f"s{i}" for i in range(23))      # the last one never was complete
    read = lambda: sorted(r["sequence"] for r in sr.read_store(spark, f"{base}/store", every=2).collect())
    assert read() == want
    levels = {r[0] for r in spark.read.parquet(f"{base}/store").select("level").distinct().collect()}
    assert levels == {"base", "batch"} and sr.drop_old_parts(spark, f"{base}/store", 8, every=2) > 0 and read() == want


def test_a_micro_batch_reads_its_buckets_only(spark):
    base = scratch_path(spark, "pruned")
    rows = spark.createDataFrame([("m", "d", f"s{i}", 0, 1, 9, 10) for i in range(200)], POINTS)
    sr._write(rows.withColumn("bucket", sr.bucket_of(sr.POINT_KEYS, 16)), f"{base}/store", "batch", 1)
    some = sr.read_store(spark, f"{base}/store", 2, [3, 5])
    assert {r[0] for r in some.select("bucket").distinct().collect()} == {3, 5}
    plan = some._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in filters and "3,5" in filters.replace(" ", "")
    # A replay of a micro-batch overwrites its own parts and no others.
    sr._write(rows.limit(0).withColumn("bucket", sr.bucket_of(sr.POINT_KEYS, 16)), f"{base}/store", "batch", 2)
    sr._write(rows.withColumn("bucket", sr.bucket_of(sr.POINT_KEYS, 16)), f"{base}/store", "batch", 1)
    assert sr.read_store(spark, f"{base}/store").count() == 200


def test_late_rows_are_dropped_but_windows_stay_whole(spark):
    base = scratch_path(spark, "live")
    t0 = dt.datetime(2024, 1, 1)
    schema = "sequence string, event_ts timestamp, bits bigint, pixel_num bigint, psnr double"
    batches = [[("s", t0 + dt.timedelta(minutes=m), 10, 100, 30.0) for m in range(0, 50, 10)],
               [("s", t0 + dt.timedelta(minutes=m), 10, 100, 40.0) for m in (45, 180)],
               [("s", t0, 1000, 100, 1.0), ("s", t0 + dt.timedelta(minutes=190), 10, 100, 40.0)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        sr.write_updates(sr.live_quality(stream, "1 hour"), f"{base}/out", f"{base}/cp").awaitTermination()
    got = {r["window_start"].hour: (r["frames"], r["bits"]) for r in sr.latest_updates(spark, f"{base}/out", ["window_start", "window_end", "sequence"]).collect()}
    assert got == {0: (6, 60), 3: (2, 20)}
