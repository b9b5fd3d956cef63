"""The frame log of an evaluation: frame types, bits and scores of every frame of every job, put together from where each is known.

Three things meet: the structure of a job (``structure.coding_units``, one row a frame), the units of its stream (one row a unit) and the scores of
its frames (merged errors of their planes). Pixels stay behind: planes are scored where they lie (``sinks.planes.write_planes``), and what
travels is a few numbers a frame. A frame without a unit or a score, and a unit or a score without a frame, is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rdspark.operators.ordered import ordered_scan
from rdspark.operators.packets import SPS_TYPE
from rdspark.operators.structure import place_unit_bits

POINT = ["dataset", "sequence", "rate_idx"]


def unit_sizes(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, unit_no, unit_bytes, header_bytes) of the coding units of streams, from their units in stream order.

    A parameter set counts as header bytes of the unit behind it, so both are placed on that unit's first frame.
    """
    is_set = F.col("nal_type") == SPS_TYPE
    placed = ordered_scan(packets.select(*keys, "unit_no", "nal_type", "unit_bytes"), keys, ["unit_no"], sums={"__unit": (~is_set).cast("int")})
    return (placed.groupBy(*keys, F.col("__unit").alias("unit_no"))
            .agg(F.sum(F.when(~is_set, F.col("unit_bytes"))).alias("unit_bytes"), F.sum(F.when(is_set, F.col("unit_bytes"))).alias("header_bytes")))


def _named(keys: Sequence[str], what: str) -> Column:
    return F.concat_ws(" ", F.lit(what), *[F.col(k).cast("string") for k in keys])


def assembled_frames(structure: DataFrame, units: DataFrame, scores: DataFrame, keys: Sequence[str] = POINT) -> DataFrame:
    """One row a frame: the columns of ``structure``, ``bits`` and the scores.

    ``structure`` has keys, frame_idx, unit_no and unit_pos; ``units`` keys, unit_no, unit_bytes and header_bytes; ``scores`` keys, frame_idx and any
    score columns. All three are spread by frame or unit, so a job with a third of all frames is spread as well.
    """
    keys = list(keys)
    has = lambda name: F.lit(True).alias(name)
    # Only the first frame of a unit meets it; the others have no bits of their own.
    first = structure.where("unit_pos = 0").select(*keys, "unit_no", F.col("frame_idx").alias("__first"), has("__frame"))
    met = first.join(units.select(*keys, "unit_no", "unit_bytes", "header_bytes", has("__unit")), [*keys, "unit_no"], "full")
    wrong = (F.when(F.col("__unit").isNull() | F.col("unit_bytes").isNull(), F.raise_error(_named([*keys, "unit_no"], "no coded unit for")))
             .when(F.col("__frame").isNull(), F.raise_error(_named([*keys, "unit_no"], "no frame for coded unit"))).otherwise(F.col("__first")))
    sizes = met.select(*keys, wrong.alias("frame_idx"), "unit_bytes", "header_bytes")
    names = [c for c in scores.columns if c not in (*keys, "frame_idx")]
    rows = structure.withColumn("__frame", F.lit(True)).join(sizes, [*keys, "frame_idx"], "left").join(scores.withColumn("__score", F.lit(True)), [*keys, "frame_idx"], "full")
    lost = (F.when(F.col("__frame").isNull(), F.raise_error(_named([*keys, "frame_idx"], "no frame for score")))
            .when(F.col("__score").isNull(), F.raise_error(_named([*keys, "frame_idx"], "no score for frame"))).otherwise(F.col("frame_type")))
    placed = place_unit_bits(rows.withColumn("frame_type", lost))
    return placed.select(*structure.columns, "bits", *names)
