"""Rate ladders, size and naming rules of evaluation jobs."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from rdspark.functions.results import col

QP_COUNT = 64          # number of quality indexes a method knows
MAX_LADDER = QP_COUNT  # a generated ladder never has more steps than indexes

# Fixed range of a stored quantiser scale.
SCALE_LOW, SCALE_HIGH = 0.01, 655.0


def uniform_qp(rate_idx, steps: int, qp_count: int = QP_COUNT) -> Column:
    """Quality index of one step of an evenly spaced ladder. The operand order matters for exactness."""
    if not 2 <= steps <= qp_count:
        raise ValueError(f"a generated ladder has 2 to {qp_count} steps, not {steps}")
    return F.floor(col(rate_idx) * F.lit((qp_count - 1) / (steps - 1)) + 0.5).cast("int")


def uniform_ladder(steps: int, qp_count: int = QP_COUNT) -> list[int]:
    if not 2 <= steps <= qp_count:
        raise ValueError(f"a generated ladder has 2 to {qp_count} steps, not {steps}")
    return [int(i * ((qp_count - 1) / (steps - 1)) + 0.5) for i in range(steps)]


def choose_ladder(steps: int, qp_i=None, qp_p=None, force_intra: bool = False):
    """(I ladder, P ladder). An explicit list wins and must have one entry per step; P follows I."""
    for given in (qp_i, qp_p):
        if given is not None and len(given) != steps:
            raise ValueError(f"expected {steps} quality indexes, got {len(given)}")
    intra = list(qp_i) if qp_i is not None else uniform_ladder(steps)
    if force_intra:
        return intra, None
    return intra, list(qp_p) if qp_p is not None else intra


def log_spaced(index, steps: int, low: float, high: float, descending: bool = False) -> Column:
    """Step ``index`` of a logarithmic ladder from ``low`` to ``high`` (reversed when descending)."""
    if not 0 < low < high:
        raise ValueError("a logarithmic ladder needs 0 < low < high")
    start, stop = (high, low) if descending else (low, high)
    return log_between(index, steps, start, stop)


def log_between(index, steps: int, start: float, stop: float) -> Column:
    """Same without an order between the ends: the table of rate multipliers over quality indexes."""
    a, b = math.log(start), math.log(stop)
    gap = (b - a) / (steps - 1) if steps > 1 else 0.0
    return F.exp(F.lit(a) + col(index) * F.lit(gap))


def rounded_scale(scale) -> Column:
    """Stored form of a quantiser scale: struct(index, value), half-even at two decimals."""
    clipped = F.least(F.greatest(col(scale).cast("double"), F.lit(SCALE_LOW)), F.lit(SCALE_HIGH))
    index = F.rint(clipped * 100).cast("int")
    return F.struct(index.alias("index"), (index / F.lit(100.0)).alias("value"))


def effective_intra_period(period, force_intra: bool = False, force_intra_period: int = -1) -> Column:
    """Forced intra sets 1, but an explicit forced period wins over it."""
    if force_intra_period > 0:
        return F.lit(force_intra_period)
    return F.lit(1) if force_intra else col(period)


def effective_frame_num(frames, force_frame_num: int = -1) -> Column:
    return F.lit(force_frame_num) if force_frame_num > 0 else col(frames)


def padding(width, height, multiple: int = 64, centred: bool = False) -> Column:
    """struct(left, right, top, bottom, width, height) that brings a picture to a multiple."""
    def up(c):
        return (F.ceil(col(c).cast("double") / multiple) * multiple).cast("int")
    w, h = up(width), up(height)
    dw, dh = w - col(width), h - col(height)
    left = F.floor(dw / 2).cast("int") if centred else F.lit(0)
    top = F.floor(dh / 2).cast("int") if centred else F.lit(0)
    return F.struct(left.alias("left"), (dw - left).cast("int").alias("right"), top.alias("top"),
                    (dh - top).cast("int").alias("bottom"), w.alias("width"), h.alias("height"))


def rate_key(rate_idx) -> Column:
    return F.format_string("%03d", col(rate_idx).cast("int"))


def stream_name(sequence, qp) -> Column:
    return F.concat(col(sequence), F.lit("_q"), col(qp).cast("string"), F.lit(".bin"))


def sibling_name(path, extension: str) -> Column:
    """The same path with its ``.bin`` parts replaced."""
    return F.replace(col(path), F.lit(".bin"), F.lit(extension))


def join_path(*parts) -> Column:
    """Path join: an absolute later part replaces what came before it."""
    out = col(parts[0])
    for p in parts[1:]:
        nxt = col(p)
        out = (F.when(nxt.startswith("/") | (out == ""), nxt)
               .when(out.endswith("/"), F.concat(out, nxt))
               .otherwise(F.concat(out, F.lit("/"), nxt)))
    return out
