"""Shared pieces of the query modules: the entry type and number rounding."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from rdspark.plans.derived import view, view_sql
from rdspark.plans.evaluate import summarise
from rdspark.sources.storage import stored


class Query(NamedTuple):
    """A named query on the given tables and, where SQL can say it, the checking statement."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


# Engines add in different orders, so results are compared at a fixed number of decimals. Means of few
# values often end exactly in a 5 there; a small offset keeps the last bit from deciding such ties.
OFFSET = 1e-11


def rd(value, digits: int):
    return F.round((F.col(value) if isinstance(value, str) else value) + F.lit(OFFSET), digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles of a result at a fixed number of decimals."""
    return df.select(*[rd(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
                       for f in df.schema.fields])


def offset_rounding(sql: str) -> str:
    """The same offset inside every ``round(value, digits)`` of a checking statement."""
    out = []
    for m in re.finditer(r"\bround\(", sql):
        depth, comma, k = 1, None, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            if sql[k] == "," and depth == 1:
                comma = k
            k += 1
        out.append((comma, f" + {OFFSET}"))
    for comma, text in sorted(out, reverse=True):
        sql = sql[:comma] + text + sql[comma:]
    return sql


def points(spark: SparkSession, folder: str) -> DataFrame:
    return summarise(view(spark, folder, "frames"))


def stored_points(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a written table: comparisons read the points several times, the frames only once."""
    return stored(points(spark, folder), "points")


METRICS = ["psnr", "msssim", "psnr_y", "psnr_u", "psnr_v", "msssim_y", "msssim_u", "msssim_v"]
KEYS = "method, dataset, sequence, rate_idx"


def summary_columns_sql(metrics=METRICS, digits: int | None = None) -> str:
    """Select list of the I, P and all-frame means over a frame log."""
    out = []
    for tag, cond in (("i", "frame_type = 0"), ("p", "frame_type <> 0"), ("all", "true")):
        n = f"count(*) FILTER ({cond})"
        exprs = {"bpp": f"CAST(sum(bits) FILTER ({cond}) AS DOUBLE) / {n} / max(pixel_num)"}
        exprs |= {m: f"sum({m}) FILTER ({cond}) / nullif(count({m}) FILTER ({cond}), 0)" for m in metrics}
        for m, e in exprs.items():
            e = f"CASE WHEN {n} > 0 THEN {e} ELSE 0e0 END"
            out.append(f"{f'round({e}, {digits})' if digits else e} AS ave_{tag}_frame_{m}")
    return ", ".join(out)


POINTS_SQL = (f"{view_sql('frames')}, points AS (SELECT {KEYS}, printf('%03d', rate_idx) AS rate_key, "
              f"max(pixel_num) AS frame_pixel_num, count(*) FILTER (frame_type = 0) AS i_frame_num, "
              f"count(*) FILTER (frame_type <> 0) AS p_frame_num, {summary_columns_sql()} FROM frames GROUP BY {KEYS})")
