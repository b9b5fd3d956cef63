"""Queries that run as streams over the given tables and read back what the stream wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rdspark.plans.catalog import points, POINTS_SQL, Query, rd
from rdspark.plans.derived import VIEWS, view, view_sql
from rdspark.plans.queries_pixels import ACTIVE_SQL
from rdspark.sources.storage import scratch_path, stored
from rdspark.streaming import packets as sp, results as sr

LIVE = view_sql("live")
FILE_POINTS = 100_000      # points of a landed file
BUCKET_UNITS = 50_000      # units of a bucket of the state, over all micro-batches


def view_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view of a given table as a stream of its files."""
    source, exprs = VIEWS[name]
    path = f"{folder}/{source}.parquet"
    # One file or a folder of part files: a pattern that only this name matches stands for either.
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.selectExpr(*[f"{e} AS {c}" for c, e in exprs.items()])


def _ingest(spark, sf):
    """Point files that land twice, some of them incomplete, end up in the store once. Three runs of several micro-batches; buckets are compacted on the way."""
    base = scratch_path(spark, "ingest")
    p = points(spark, sf).select("method", "dataset", "sequence", "rate_idx", "i_frame_num", "p_frame_num", "ave_all_frame_bpp",
                                 (F.col("i_frame_num") + F.col("p_frame_num") + F.when(F.col("i_frame_num") == 0, 1).otherwise(0)).alias("frame_num"))
    p, keys = stored(p, "points"), ["method", "dataset", "sequence", "rate_idx"]
    part = F.pmod(F.xxhash64("sequence"), F.lit(2))
    for rows in (p.where(part == 0), p, p.where(part == 1)):
        half = -(-rows.count() // (2 * FILE_POINTS)) or 1      # files of a micro-batch, of which a run has two
        rows.repartition(2 * half, *keys).write.mode("append").json(f"{base}/landing")
        sr.ingest_results(sr.point_stream(spark, f"{base}/landing", files_per_batch=half), f"{base}/store", f"{base}/checkpoint", buckets=8, every=3).awaitTermination()
    return sr.read_store(spark, f"{base}/store", every=3).select("method", "dataset", "sequence", "rate_idx", "i_frame_num", "p_frame_num", rd("ave_all_frame_bpp", 9).alias("ave_all_frame_bpp"))


def _live(spark, sf, window, slide=None):
    base = scratch_path(spark, "live")
    # The stored times have no zone; they are taken as UTC whatever the zone of the session is.
    here, utc = F.current_timezone(), F.lit("UTC")
    frames = view_stream(spark, sf, "live").withColumn("event_ts", F.convert_timezone(utc, here, F.col("event_ts")).cast("timestamp"))
    running = sr.live_quality(frames, window, slide)
    sr.write_updates(running, f"{base}/windows", f"{base}/checkpoint").awaitTermination()
    keys = ["window_start", "window_end", "sequence"]
    ntz = [F.convert_timezone(here, utc, F.col(c).cast("timestamp_ntz")).alias(c) for c in keys[:2]]
    return sr.latest_updates(spark, f"{base}/windows", keys).select(*ntz, "sequence", "frames", "bits", "bpp", "psnr")


def _stateful(spark, sf):
    """Units that land in three parts, by their number; sets of an earlier part hold for slices of a later one."""
    base, units = scratch_path(spark, "state"), view(spark, sf, "units")
    most, n = units.agg(F.max("unit_no"), F.count(F.lit(1))).first()
    most, buckets = most or 0, max(128, n // BUCKET_UNITS)
    for k in range(3):
        units.where((F.col("unit_no") * 3 >= k * (most + 1)) & (F.col("unit_no") * 3 < (k + 1) * (most + 1))).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(units.schema).parquet(f"{base}/in")
        sp.stateful_packets(stream, base, f"{base}/checkpoint", buckets=buckets).awaitTermination()
    return spark.read.parquet(f"{base}/slices").drop("batch_id")


_LIVE_SELECT = ("sequence, count(*) AS frames, CAST(sum(bits) AS BIGINT) AS bits, CAST(sum(bits) AS DOUBLE) / CAST(sum(pixel_num) AS DOUBLE) AS bpp, avg(psnr) AS psnr")
QUERIES = {
    "ingested_points": Query(_ingest, f"""WITH {POINTS_SQL} SELECT method, dataset, sequence, rate_idx, i_frame_num, p_frame_num,
  round(ave_all_frame_bpp, 9) AS ave_all_frame_bpp FROM points WHERE i_frame_num > 0"""),
    "live_quality": Query(lambda s, f: _live(s, f, "1 hour"), f"""WITH {LIVE} SELECT time_bucket(INTERVAL '1 hour', event_ts) AS window_start,
  time_bucket(INTERVAL '1 hour', event_ts) + INTERVAL '1 hour' AS window_end, {_LIVE_SELECT} FROM live GROUP BY ALL"""),
    "live_quality_sliding": Query(lambda s, f: _live(s, f, "6 hours", "2 hours"), f"""WITH {LIVE}, w AS (SELECT *,
  time_bucket(INTERVAL '2 hours', event_ts) - k.k * INTERVAL '2 hours' AS window_start FROM live, range(3) k(k))
SELECT window_start, window_start + INTERVAL '6 hours' AS window_end, {_LIVE_SELECT} FROM w GROUP BY ALL"""),
    "stateful_packets": Query(_stateful, ACTIVE_SQL.replace("f.unit_bytes, ", "")),
}
