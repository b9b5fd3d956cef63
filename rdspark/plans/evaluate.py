"""Evaluation planning, scoring and summarising: configuration -> jobs -> (external coder) -> frame log -> points."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from rdspark.functions import ladders
from rdspark.operators import framelog, planes, planning, quality, structure, summary
from rdspark.sinks.planes import write_planes
from rdspark.sources.storage import scratch_path


def plan_evaluation(sequences: DataFrame, done: DataFrame | None = None, **options) -> DataFrame:
    """Jobs still to run for a configuration. ``options`` are those of ``job_matrix``."""
    jobs = planning.job_matrix(sequences, **options)
    return jobs if done is None else planning.remaining_jobs(jobs, done)


def plan_frames(jobs: DataFrame, delay: int = 1, reset_interval: int = 32) -> DataFrame:
    """Every frame of every job with its unit, type and reset flag."""
    return structure.coding_units(structure.expand_frames(jobs), delay=delay, reset_interval=reset_interval)


def summarise(frames: DataFrame, include_planes: bool = True) -> DataFrame:
    """Points of a frame log, keyed as in a result log."""
    points = summary.sequence_summary(frames, include_planes=include_planes)
    return points.withColumn("rate_key", ladders.rate_key("rate_idx"))


def bucketed_planes(frames: DataFrame, buckets: int) -> DataFrame:
    """Planes of frames as a bucketed table in the scratch folder: every later join by frame and plane leaves them where they are."""
    spark, name = frames.sparkSession, f"planes_{uuid.uuid4().hex}"
    carried = [c for c in ("rate_idx",) if c in frames.columns]
    write_planes(planes.plane_rows(frames, carry=carried), name, scratch_path(spark, "planes"), buckets)
    return spark.table(name)


def frame_log(jobs: DataFrame, source: DataFrame, recon: DataFrame, packets: DataFrame, method: str, delay: int = 8, reset_interval: int = 32) -> DataFrame:
    """The frame log of ``jobs`` (dataset, sequence, rate_idx, width, height, frame_num, intra_period).

    ``source`` has plane rows of the sequences, ``recon`` those of each rate (``rate_idx``), ``packets`` the units of the streams (sequence, rate_idx).
    Tables written by ``bucketed_planes`` meet without moving pixels. Structural similarity is not scored here and stands as 0.
    """
    keys = ["sequence", "rate_idx"]
    own = jobs.withColumn("pixel_num", F.col("width").cast("long") * F.col("height")).select("dataset", *keys, "pixel_num", "frame_num", "intra_period")
    frames = plan_frames(own, delay, reset_interval).select("dataset", *keys, "frame_idx", "pixel_num", "frame_type", "unit_no", "unit_pos")
    errors = quality.plane_error(quality.pair_planes(source, recon, carry=["rate_idx"]))
    log = framelog.assembled_frames(frames, framelog.unit_sizes(packets, keys), quality.merged_scores(errors, [*keys, "frame_idx"]), keys)
    return log.drop("unit_no", "unit_pos").withColumns({"method": F.lit(method), **{m: F.lit(0.0) for m in ("msssim", "msssim_y", "msssim_u", "msssim_v")}})
