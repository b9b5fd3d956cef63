"""Plane tables laid out for repeated scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rdspark.operators.planes import convert_frames, plane_rows
from rdspark.operators.quality import FRAME_KEYS


def write_rgb_planes(frames: DataFrame, path: str) -> None:
    """4:2:0 frames, as the sources read them, as a Parquet table of red, green and blue planes. A projection: frames stay in the task that read them."""
    plane_rows(convert_frames(frames, "420", "rgb")).write.mode("error").parquet(path)


def write_planes(planes: DataFrame, table: str, path: str, buckets: int) -> None:
    """Plane rows as a table bucketed and sorted by (sequence, frame_idx, plane).

    Two tables written with the same number of buckets meet in ``quality.pair_planes`` without moving
    a pixel: the shuffle is paid once, at write time. A bucket holds frames of all sequences, so a long
    sequence fills all buckets alike. Choose ``buckets`` so that one bucket is a few hundred MB.
    """
    placed = planes.repartition(buckets, *FRAME_KEYS)
    (placed.write.mode("error").option("path", path).bucketBy(buckets, *FRAME_KEYS).sortBy(*FRAME_KEYS)
     .saveAsTable(table))
