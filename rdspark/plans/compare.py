"""The comparison report: every metric, frame group and method in one lazily evaluated plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from rdspark.operators import comparison as c
from rdspark.sources.storage import stored


def compare(points: DataFrame, anchor: str, between: str = "class", metrics: Sequence[str] = ("psnr",),
            groups: Sequence[str] = tuple(c.FRAME_GROUPS), rate_exclude: Sequence[str] | None = None) -> DataFrame:
    """BD-rates of all methods against the anchor, per class or per sequence.

    Per sequence the ``* Overall`` and ``* Average`` rows of each dataset are added. ``points`` should
    be a written table: it is read once per class curve and once per sequence curve.
    """
    if between not in ("class", "sequence"):
        raise ValueError("compare between 'class' or 'sequence'")
    points = c.exclude_rates(points, rate_exclude)
    class_bd = c.bd_rate(stored(c.class_mean(points, metrics, groups), "class-curves"), anchor, ["dataset"])
    if between == "class":
        return class_bd
    seq_bd = stored(c.bd_rate(c.metric_rows(points, metrics, groups), anchor, ["dataset", "sequence"]), "sequence-bd")
    return c.with_overall_rows(seq_bd, c.bd_summary(class_bd, seq_bd))
