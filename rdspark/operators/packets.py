"""Operators on unit rows: active parameter sets, id allocation, byte accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from rdspark.operators.numbering import spread_join
from rdspark.operators.ordered import ordered_scan

SPS_TYPE = 0
MAX_SPS = 16   # fixed: an id has four bits


def active_parameter_set(packets: DataFrame, fields: Sequence[str] = ("height", "width"), stream: str = "stream",
                         unit_no: str = "unit_no") -> DataFrame:
    """Slices with the latest parameter set of their id that came before them in the stream.

    A later set with the same id replaces the earlier one. ``valid`` is false for a slice without one.
    """
    is_sps = F.col("nal_type") == SPS_TYPE
    found = F.when(is_sps, F.struct(F.col(unit_no).alias("sps_unit"), *[F.col(f) for f in fields]))
    filled = ordered_scan(packets, [stream, "sps_id"], [unit_no], carry={"__sps": found})
    keep = [c for c in packets.columns if c not in fields]
    return (filled.filter(~is_sps)
            .select(*keep, F.col("__sps.sps_unit").alias("sps_unit"), *[F.col(f"__sps.{f}").alias(f) for f in fields],
                    F.col("__sps").isNotNull().alias("valid")))


def allocate_ids(frames: DataFrame, key: Sequence[str] = ("height", "width"), stream: str = "stream",
                 unit_no: str = "unit_no", strict: bool = True) -> DataFrame:
    """Parameter-set id of each frame: a new id (last + 1) when its key first appears, reused afterwards.

    Keys are reduced to their first appearance before they are numbered, so the numbering sees one row
    per distinct key. ``sps_new`` marks the first appearance. ``strict`` fails on a 17th id.
    """
    first = frames.groupBy(stream, *key).agg(F.min(unit_no).alias("__first"))
    number = F.row_number().over(W.partitionBy(stream).orderBy("__first")) - 1
    ids = first.withColumn("sps_id", number)
    if strict:
        over = F.raise_error(F.lit(f"more than {MAX_SPS} parameter sets in a stream")).cast("int")
        ids = ids.withColumn("sps_id", F.when(F.col("sps_id") < MAX_SPS, F.col("sps_id")).otherwise(over))
    out = spread_join(frames.drop("sps_id"), ids, [stream, *key], unit_no, how="inner")
    return out.withColumn("sps_new", F.col(unit_no) == F.col("__first")).drop("__first")


def packet_summary(packets: DataFrame, stream: str = "stream") -> DataFrame:
    """Units, bytes, bits and header overhead per stream and unit type."""
    return (packets.groupBy(stream, "nal_type")
            .agg(F.count(F.lit(1)).alias("units"), F.sum("unit_bytes").alias("bytes"),
                 F.sum(F.coalesce("payload_len", F.lit(0))).alias("payload_bytes"))
            .withColumns({"bits": F.col("bytes") * 8, "header_bytes": F.col("bytes") - F.col("payload_bytes")}))


def stream_rate(packets: DataFrame, stream: str = "stream") -> DataFrame:
    """Size of each stream, its slices as frames, and its rate at the fixed frame rate."""
    from rdspark.functions.results import kilobits_per_second
    frames = F.when(F.col("nal_type") == SPS_TYPE, 0).otherwise(F.coalesce("frame_num", F.lit(1)))
    g = packets.groupBy(stream).agg(F.sum("unit_bytes").alias("bytes"), F.sum(frames).alias("frames"))
    return g.withColumn("kbps", kilobits_per_second("bytes", "frames"))


def coded_frames(packets: DataFrame) -> DataFrame:
    """One row per coded frame: a unit of several frames becomes one row per frame with its own set id."""
    ids = F.coalesce("sps_ids", F.array("sps_id"))
    return (packets.select("*", F.posexplode(ids).alias("unit_pos", "__id"))
            .withColumn("sps_id", F.col("__id")).drop("__id"))
