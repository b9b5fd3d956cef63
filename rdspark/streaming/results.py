"""Result files and frame measurements as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rdspark.sources.result_logs import POINT_DDL
from rdspark.sources.storage import stored

POINT_KEYS = ["method", "dataset", "sequence", "rate_idx"]
POINT_FILES = ", ".join([p for p in POINT_DDL.split(", ") if not p.startswith("rate_idx ")]
                        + ["rate_idx INT, method STRING, dataset STRING, sequence STRING, frame_num BIGINT"])


def point_stream(spark: SparkSession, folder: str, schema: str = POINT_FILES, files_per_batch: int = 1000) -> DataFrame:
    """Per-point JSON files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def complete_points(points: DataFrame) -> DataFrame:
    """Points whose frame counts add up to the requested number."""
    return points.filter(F.col("i_frame_num") + F.col("p_frame_num") == F.col("frame_num"))


#: Buckets of a store, and micro-batches from one compaction of a bucket to the next.
BUCKETS, COMPACT_EVERY = 64, 16


def bucket_of(keys: Sequence[str], buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def base_before(batch_id: int, bucket, every: int = COMPACT_EVERY):
    """Number of the last compaction of a bucket before a micro-batch: buckets take turns, so no micro-batch rewrites more than its share of the store."""
    return F.lit(batch_id) - 1 - F.pmod(F.lit(batch_id - 1) - bucket, F.lit(every))


def read_store(spark: SparkSession, store: str, before: int | None = None, buckets: Sequence[int] | None = None, every: int = COMPACT_EVERY) -> DataFrame:
    """Rows of a store as they are before a micro-batch (all of them if None), from the given buckets only: other folders are not read.

    Of each bucket that is its last compaction and the micro-batches since; earlier ones are in it.
    """
    rows = spark.read.option("mergeSchema", "false").parquet(store)
    if before is None:
        before = (rows.agg(F.max("n")).first()[0] or 0) + 1
    base = base_before(before, F.col("bucket"), every)
    has_base = base > every      # buckets are first compacted after that many micro-batches
    now = (((F.col("level") == "base") & (F.col("n") == base)) | ((F.col("level") == "batch") & ((F.col("n") >= base) | ~has_base))) & (F.col("n") < before)
    picked = rows if buckets is None else rows.where(F.col("bucket").isin([int(b) for b in buckets]))
    return picked.where(now)


def ingest_results(points: DataFrame, store: str, checkpoint: str, keys: Sequence[str] = tuple(POINT_KEYS), once: bool = True, buckets: int = BUCKETS,
                   every: int = COMPACT_EVERY) -> StreamingQuery:
    """Append complete points to a Parquet store, each key once.

    The store has a folder for each bucket of keys, with a part for each micro-batch (``level=batch/n=...``) and now and then one that holds all before it
    (``level=base``). A micro-batch reads only the buckets of its own keys, and of these only what came since their last compaction, and writes under its own number,
    so a replay reads the same and overwrites itself. Within a batch the first of equal keys is kept by an aggregate, and the comparison is an anti join. Buckets take
    turns to be compacted, one of ``every`` in each micro-batch. Parts that a compaction has taken in stay for replays; ``drop_old_parts`` removes them.
    """
    keys = list(keys)

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark, number = batch.sparkSession, batch_id + 1      # numbers begin at 1: compaction 0 is none
        rest = [c for c in batch.columns if c not in keys]
        fresh = stored(complete_points(batch).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("r"))
                       .select(*keys, "r.*").withColumn("bucket", bucket_of(keys, buckets)), "fresh")
        known = _exists(spark, store)
        mine = [r[0] for r in fresh.select("bucket").distinct().collect()]      # at most ``buckets`` numbers
        if known:
            fresh = fresh.join(read_store(spark, store, number, mine, every).select(*keys), keys, "left_anti")
        _write(fresh, store, "batch", number)
        turn = [b for b in range(buckets) if (number - b) % every == 0]
        if known and turn and number > every:
            due = spark.read.parquet(store).where(F.col("bucket").isin(turn))
            if not due.limit(1).isEmpty():
                _write(read_store(spark, store, number, turn, every).drop("level", "n"), store, "base", number)

    writer = points.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _write(rows: DataFrame, store: str, level: str, number: int) -> None:
    placed = rows.withColumns({"level": F.lit(level), "n": F.lit(number)})
    # Only the folders of this number are replaced.
    placed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "level", "n").parquet(store)


def _exists(spark: SparkSession, store: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return files.exists(path) and any(s.isDirectory() for s in files.listStatus(path))


def drop_old_parts(spark: SparkSession, store: str, before: int, every: int = COMPACT_EVERY) -> int:
    """Removes the parts that the compactions before a micro-batch have taken in, once no micro-batch before it can be replayed. Returns their number."""
    base = base_before(before, F.col("bucket"), every)
    old = spark.read.parquet(store).select("bucket", "level", "n").distinct().where((base > every) & (F.col("n") < base))
    gone = 0
    for r in old.collect():      # a row a folder
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/bucket={r['bucket']}/level={r['level']}/n={r['n']}")
        gone += bool(path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True))
    return gone


def live_quality(frames: DataFrame, window: str, slide: str | None = None, delay: str = "10 minutes",
                 keys: Sequence[str] = ("sequence",), ts: str = "event_ts") -> DataFrame:
    """Running rate and quality per point and time window. Works on streams and on tables.

    On a stream, rows later than ``delay`` behind the newest time are dropped by the watermark.
    """
    timed = frames.withWatermark(ts, delay) if frames.isStreaming else frames
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    g = timed.groupBy(span.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("frames"), F.sum("bits").alias("bits"), F.sum("pixel_num").alias("pixels"),
        F.avg("psnr").alias("psnr"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "frames",
                    "bits", (F.col("bits") / F.col("pixels")).alias("bpp"), "psnr")


def write_updates(running: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the windows that changed in each micro-batch, under the batch number (replays overwrite)."""
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    writer = running.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_updates(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """The newest state of every window written by ``write_updates``."""
    rows = spark.read.parquet(folder)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")
