"""Frame structure of a coded sequence: units, intra refresh, resets, bit placement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rdspark.functions.results import col
from rdspark.operators.numbering import unfold
from rdspark.operators.ordered import ordered_scan

FRAME_I, FRAME_P = 0, 1


def number_frames(df: DataFrame, keys: Sequence[str], order: Sequence, out: str = "frame_idx") -> DataFrame:
    """0-based position of every row in its sequence."""
    return ordered_scan(df, keys, order, number=out)


def expand_frames(jobs: DataFrame, frame_num: str = "frame_num", out: str = "frame_idx") -> DataFrame:
    """One row per frame of each job."""
    return unfold(jobs, frame_num, out)


def coding_units(frames: DataFrame, frame_num="frame_num", period="intra_period", delay: int = 1,
                 frame_idx: str = "frame_idx", reset_interval: int = 32) -> DataFrame:
    """Adds frame_type, unit_no, unit_start, unit_pos, unit_frames and reset. A projection, no shuffle.

    Chunks of ``delay`` frames follow a single intra frame at 0. A refresh falls due on a chunk start
    with ``start % period == 1`` other than start 1. With one frame per chunk that repeats every
    period. With longer chunks the one-frame refresh at ``period + 1`` moves all later starts off the
    grid (the period is a multiple of the chunk), so it happens exactly once.
    """
    if delay < 1:
        raise ValueError("a coding unit has at least one frame")
    i, n, p = col(frame_idx).cast("bigint"), col(frame_num).cast("bigint"), col(period).cast("bigint")
    d = F.lit(delay).cast("bigint")
    step = lambda since: F.floor(since / d).cast("bigint")

    if delay == 1:
        intra = (i == 0) | (p == 1) | ((p > 1) & (i != 1) & (F.pmod(i, F.greatest(p, F.lit(1))) == 1))
        start, unit = i, i
    else:
        misfit = F.when((p > 1) & (F.pmod(p, d) != 0),
                        F.raise_error(F.lit("the intra period must be a multiple of the unit length")))
        p = F.coalesce(misfit.cast("bigint"), p)
        refresh = p + 1
        plain_start, plain_unit = 1 + step(i - 1) * d, 1 + step(i - 1)
        late = i - refresh - 1
        intra = (i == 0) | (p == 1) | ((p > 1) & (i == refresh))
        start = (F.when((i == 0) | (p == 1), i)
                 .when((p > 1) & (i > refresh), refresh + 1 + step(late) * d)
                 .when((p > 1) & (i == refresh), i)
                 .otherwise(plain_start))
        unit = (F.when((i == 0) | (p == 1), i)
                .when((p > 1) & (i > refresh), 2 + step(p) + step(late))
                .when((p > 1) & (i == refresh), 1 + step(p))
                .otherwise(plain_unit))
    out = (frames.withColumn("unit_start", start).withColumn("unit_no", unit)
           .withColumn("frame_type", F.when(intra, F.lit(FRAME_I)).otherwise(F.lit(FRAME_P)))
           .withColumn("unit_pos", i - F.col("unit_start"))
           .withColumn("unit_frames", F.when(F.col("frame_type") == FRAME_I, F.lit(1).cast("bigint"))
                       .otherwise(F.least(d, n - F.col("unit_start")))))
    return out.withColumn("reset", reset_flag("unit_start", "frame_type", delay, reset_interval))


def unit_inputs(frames: DataFrame, delay: int, frame_idx: str = "frame_idx") -> DataFrame:
    """Source frames each unit is coded from, one row per input.

    A predicted unit always takes ``delay`` inputs: a short last one repeats its last frame. ``frames``
    comes from ``coding_units``; the last frame of a unit adds the repeats, so nothing is grouped.
    """
    missing = F.lit(delay) - F.col("unit_frames")
    is_last = (F.col("frame_type") == FRAME_P) & (F.col("unit_pos") == F.col("unit_frames") - 1)
    copies = F.when(is_last, 1 + missing).otherwise(F.lit(1)).cast("int")
    return (frames.withColumn("__copy", F.explode(F.sequence(F.lit(0), copies - 1)))
            .withColumn("input_pos", F.col("unit_pos") + F.col("__copy"))
            .withColumn("repeated", F.col("__copy") > 0).drop("__copy"))


def reset_flag(position, frame_type, delay: int = 1, interval: int = 32) -> Column:
    """1 on a predicted unit whose end falls just past a multiple of the interval."""
    if interval <= 0:
        return F.lit(0)
    due = (col(frame_type) != FRAME_I) & (F.pmod(col(position) + delay, F.lit(interval)) == 1)
    return F.when(due, F.lit(1)).otherwise(F.lit(0))


def reset_flag_plain(frame_idx, frame_type, interval: int = 32) -> Column:
    """The older per-frame rule, without a unit length."""
    return reset_flag(frame_idx, frame_type, 0, interval)


def regular_frame_type(frame_idx, period, open_ended: bool = False) -> Column:
    """The older rule: an intra frame at every multiple of the period.

    ``open_ended`` allows periods below 1, which leave frame 0 as the only intra frame.
    """
    i = col(frame_idx).cast("bigint")
    p = (F.lit(period) if isinstance(period, int) else col(period)).cast("bigint")
    due = F.pmod(i, F.when(p > 0, p)) == 0
    if open_ended:
        due = (i == 0) | F.coalesce(due, F.lit(False))
    return F.when(due, F.lit(FRAME_I)).otherwise(F.lit(FRAME_P))


def group_number(frame_idx, period) -> Column:
    p = (F.lit(period) if isinstance(period, int) else col(period)).cast("bigint")
    return F.floor(col(frame_idx).cast("bigint") / p).cast("bigint")


def place_unit_bits(frames: DataFrame, unit_bytes="unit_bytes", header_bytes="header_bytes",
                    position="unit_pos", out: str = "bits") -> DataFrame:
    """The bits of a unit (and of a new header before it) belong to its first frame, the others get 0."""
    total = (F.coalesce(col(unit_bytes), F.lit(0)) + F.coalesce(col(header_bytes), F.lit(0))).cast("bigint") * 8
    return frames.withColumn(out, F.when(col(position) == 0, total).otherwise(F.lit(0).cast("bigint")))
