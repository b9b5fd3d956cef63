"""Method comparison: class means, rate-distortion curves, BD-rate, report shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rdspark.functions.results import fixed_digits
from rdspark.operators.numbering import spread_join

ALL_METRICS = ["psnr", "msssim", "psnr_y", "psnr_u", "psnr_v", "msssim_y", "msssim_u", "msssim_v"]
FRAME_GROUPS = ["i", "p", "all"]
SAMPLES = 100      # quality samples of the integral
MIN_POINTS = 3     # points a tested curve needs
CURVE = ["frame_group", "metric"]


def unify_logs(logs: Sequence[DataFrame]) -> DataFrame:
    """All method logs in one table; columns a log lacks become NULL."""
    if not logs:
        raise ValueError("at least one result log is needed")
    out = logs[0]
    for nxt in logs[1:]:
        out = out.unionByName(nxt, allowMissingColumns=True)
    return out


def exclude_rates(points: DataFrame, rates: Sequence[str] | None) -> DataFrame:
    """Drop listed rate keys, compared as text."""
    return points.filter(~F.col("rate_key").isin(list(rates))) if rates else points


def sequence_set_mismatch(points: DataFrame) -> DataFrame:
    """Sequences of a dataset that some methods with that dataset have and others lack.

    One row per (dataset, sequence) with the number of methods on each side; empty when consistent.
    Counting replaces collected sets, so a huge dataset is just more rows.
    """
    present = points.groupBy("dataset", "sequence", "method").agg(F.lit(1).alias("__x"))
    have = present.groupBy("dataset", "sequence").agg(F.count(F.lit(1)).alias("methods_with"))
    expected = (points.groupBy("dataset", "method").agg(F.lit(1).alias("__x"))
                .groupBy("dataset").agg(F.count(F.lit(1)).alias("methods_of_dataset")))
    both = spread_join(have, expected, ["dataset"], F.xxhash64("sequence"), how="inner")
    return (both.filter(F.col("methods_with") < F.col("methods_of_dataset"))
            .select("dataset", "sequence", "methods_with", "methods_of_dataset"))


def metric_rows(points: DataFrame, metrics: Sequence[str] = ("psnr",), groups: Sequence[str] = tuple(FRAME_GROUPS),
                ids: Sequence[str] = ("method", "dataset", "sequence", "rate_key"), fill_missing: bool = False) -> DataFrame:
    """Long form: one row per point, frame group and metric with bpp, value and frame count.

    All metrics and groups come out of one ``explode`` of a literal array, so the points are read once.
    A metric column that the table lacks is NULL, or 0 with ``fill_missing``.
    """
    have = set(points.columns)
    count = {"i": F.col("i_frame_num"), "p": F.col("p_frame_num"), "all": F.col("i_frame_num") + F.col("p_frame_num")}

    def value(g: str, m: str) -> Column:
        name = f"ave_{g}_frame_{m}"
        got = F.col(name).cast("double") if name in have else F.lit(None).cast("double")
        return F.coalesce(got, F.lit(0.0)) if fill_missing else got

    entries = [F.struct(F.lit(g).alias("frame_group"), F.lit(m).alias("metric"),
                        F.col(f"ave_{g}_frame_bpp").cast("double").alias("bpp"), value(g, m).alias("value"),
                        count[g].cast("bigint").alias("frames"))
               for g in groups for m in metrics]
    return points.select(*ids, F.inline(F.array(*entries)))


def class_mean(points: DataFrame, metrics: Sequence[str] = ("psnr",),
               groups: Sequence[str] = tuple(FRAME_GROUPS)) -> DataFrame:
    """Means per method, dataset and rate, weighted by frame counts; missing metrics count as 0.

    A group without frames has denominator 1.
    """
    rows = metric_rows(points, metrics, groups, fill_missing=True)
    weight = F.col("frames")
    g = rows.groupBy("method", "dataset", "rate_key", *CURVE).agg(
        F.sum("frames").alias("frames"), F.sum(F.col("bpp") * weight).alias("__b"),
        F.sum(F.col("value") * weight).alias("__v"))
    n = F.greatest(F.col("frames"), F.lit(1))
    return g.select("method", "dataset", "rate_key", *CURVE, "frames",
                    (F.col("__b") / n).alias("bpp"), (F.col("__v") / n).alias("value"))


def class_mean_wide(points: DataFrame, metric: str = "psnr") -> DataFrame:
    """The same in the shape of a stored point: one row per method, dataset and rate."""
    rows = metric_rows(points, [metric], fill_missing=True)
    aggs = []
    for g in FRAME_GROUPS:
        here = F.col("frame_group") == g
        n = F.greatest(F.sum(F.when(here, F.col("frames"))), F.lit(1))
        if g != "all":
            aggs.append(F.sum(F.when(here, F.col("frames"))).alias(f"{g}_frame_num"))
        aggs += [(F.sum(F.when(here, F.col("bpp") * F.col("frames"))) / n).alias(f"ave_{g}_frame_bpp"),
                 (F.sum(F.when(here, F.col("value") * F.col("frames"))) / n).alias(f"ave_{g}_frame_{metric}")]
    return rows.groupBy("method", "dataset", "rate_key").agg(*aggs)


def image_rate_means(images: DataFrame) -> DataFrame:
    """Unweighted mean bpp and PSNR per class and rate; the rate is ``rate_idx``, else ``qp``."""
    rate = F.coalesce(F.col("rate_idx"), F.col("qp"))
    return (images.groupBy(F.col("dataset"), rate.alias("rate"))
            .agg(F.avg("bpp").alias("bpp"), F.avg("psnr").alias("psnr"), F.count(F.lit(1)).alias("images")))


def curve_series(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points of each curve with their place in rate-key order, in the long form plots consume."""
    order = W.partitionBy("method", *keys, *CURVE).orderBy("rate_key")
    return rows.select("method", *keys, *CURVE, "rate_key", "bpp", "value",
                       (F.row_number().over(order) - 1).alias("point_no"))


def curve_arrays(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per curve with parallel lists in rate-key order. A curve has one entry per rate key."""
    packed = (rows.groupBy("method", *keys, *CURVE)
              .agg(F.array_sort(F.collect_list(F.struct("rate_key", "bpp", "value"))).alias("c")))
    return packed.select("method", *keys, *CURVE, F.col("c.bpp").alias("bpp"), F.col("c.value").alias("value"))


# --------------------------------------------------------------------------- BD-rate


def eligible_pairs(rows: DataFrame, anchor: str, keys: Sequence[str]) -> DataFrame:
    """(tested method, curve) combinations that may be compared, with the shared quality range.

    The tested curve needs three points and a positive first quality, the anchor the same curve with a
    positive first rate. "First" is the smallest rate key. The points are aggregated once; the anchor's aggregate meets the others
    by a window over the aggregates of a curve.
    """
    shared = [*keys, *CURVE]
    ends = rows.groupBy("method", *shared).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("bpp", "rate_key").alias("first_bpp"),
        F.min_by("value", "rate_key").alias("first_value"),
        F.min("value").alias("low"), F.max("value").alias("high"))
    usable = (F.col("method") == anchor) & (F.col("first_bpp") > 0)
    base = F.first(F.when(usable, F.struct("low", "high")), ignorenulls=True).over(W.partitionBy(*shared))
    tested = (ends.withColumn("a", base).filter(F.col("a").isNotNull() & (F.col("method") != anchor)
                                                & (F.col("n") >= MIN_POINTS) & (F.col("first_value") > 0)))
    return tested.select("method", *shared, F.greatest("low", "a.low").alias("lo"), F.least("high", "a.high").alias("hi"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _knots(points: Column) -> Column:
    """Points of a curve as (q, r), r = ln(bpp), in order of quality. Equal qualities are averaged; a rate of zero has no logarithm
    and makes its knot NULL."""
    logs = F.array_sort(F.transform(F.filter(points, lambda p: p["value"].isNotNull()), lambda p: F.struct(
        p["value"].cast("double").alias("q"), F.when(p["bpp"] > 0, F.log(p["bpp"])).alias("r"))))
    same = lambda q: F.filter(logs, lambda p: p["q"] == q)
    mean = lambda q: F.aggregate(same(q), F.lit(0.0), lambda t, p: t + p["r"]) / F.size(same(q))
    return F.transform(F.array_distinct(F.transform(logs, lambda p: p["q"])), lambda q: F.struct(q.alias("q"), mean(q).alias("r")))


def _steps(knots: Column) -> Column:
    """(h, d) of neighbouring knots: distance and slope of the chord."""
    return F.transform(F.sequence(F.lit(1), F.size(knots) - 1), lambda k: _let(
        F.struct(F.get(knots, k - 1).alias("a"), F.get(knots, k).alias("b")),
        lambda s: F.struct((s["b"]["q"] - s["a"]["q"]).alias("h"), ((s["b"]["r"] - s["a"]["r"]) / (s["b"]["q"] - s["a"]["q"])).alias("d"))))


def _slopes(steps: Column) -> Column:
    """Slope at each knot: weighted harmonic means of the two chords inside, 0 at a turning point; the three-point rule with its limits at the ends."""
    n = F.size(steps)

    def slope(k):
        before, after = F.get(steps, k - 1), F.get(steps, k)
        inner = _inner_slope(before["h"], after["h"], before["d"], after["d"])
        end = lambda x, y: F.when(n == 1, F.get(steps, F.lit(0))["d"]).otherwise(_end_slope(x["h"], y["h"], x["d"], y["d"]))
        return (F.when(k == 0, end(F.get(steps, F.lit(0)), F.get(steps, F.lit(1))))
                .when(k == n, end(F.get(steps, n - 1), F.get(steps, n - 2))).otherwise(inner))
    return F.transform(F.sequence(F.lit(0), n), slope)


def _inner_slope(hm: Column, hp: Column, dm: Column, dp: Column) -> Column:
    w1, w2 = 2 * hp + hm, hp + 2 * hm
    harmonic = (w1 + w2) / (w1 / dm + w2 / dp)
    return F.when(dm.isNull() | dp.isNull(), F.lit(None)).when(dm * dp > 0, harmonic).otherwise(F.lit(0.0))


def _end_slope(a: Column, b: Column, s: Column, t: Column) -> Column:
    raw = ((2 * a + b) * s - a * t) / (a + b)
    return (F.when(raw.isNull(), F.lit(None)).when(F.sign(raw) != F.sign(s), F.lit(0.0))
            .when((F.sign(s) != F.sign(t)) & (F.abs(raw) > 3 * F.abs(s)), 3 * s).otherwise(raw))


def _sample_sum(knots: Column, steps: Column, slopes: Column, lo: Column, hi: Column) -> Column:
    """Trapezoid sum of a curve at the samples of [lo, hi]; NULL where the range is empty or a piece in it is unknown.

    The samples in a piece are evenly spaced values of a cubic, so their sum is a formula: with y = p0 + p1 i + p2 i^2 + p3 i^3 for
    the i-th of them, it takes the sums of powers of i. No sample becomes a row or an array entry.
    """
    step = (hi - lo) / (SAMPLES - 1)
    pieces = F.size(steps)

    def first_sample(k):
        """Samples before knot k; all of them before the last one, none before the first."""
        inside = F.least(F.greatest(F.ceil((F.get(knots, k)["q"] - lo) / step), F.lit(0)), F.lit(SAMPLES)).cast("int")
        return F.when(k == 0, 0).when(k == pieces, SAMPLES).otherwise(inside)

    def piece(k):
        given = F.struct(F.get(knots, k).alias("a"), F.get(knots, k + 1).alias("b"), F.get(steps, k)["h"].alias("h"), F.get(slopes, k).alias("m"),
                         F.get(slopes, k + 1).alias("m1"), first_sample(k).alias("from"), first_sample(k + 1).alias("to"))

        def cubic(g):
            rise, gap = g["h"] * g["m"], g["b"]["r"] - g["a"]["r"]
            return F.struct(g["a"]["r"].alias("c0"), rise.alias("c1"), (3 * gap - 2 * rise - g["h"] * g["m1"]).alias("c2"),
                            (rise + g["h"] * g["m1"] - 2 * gap).alias("c3"), ((lo + g["from"] * step - g["a"]["q"]) / g["h"]).alias("t"),
                            (step / g["h"]).alias("u"), (g["to"] - g["from"]).cast("double").alias("n"), g["from"].alias("from"), g["to"].alias("to"))

        def powers(c):
            t, u = c["t"], c["u"]
            return F.struct((c["c0"] + t * (c["c1"] + t * (c["c2"] + t * c["c3"]))).alias("p0"),
                            (u * (c["c1"] + t * (2 * c["c2"] + t * 3 * c["c3"]))).alias("p1"), (u * u * (c["c2"] + 3 * t * c["c3"])).alias("p2"),
                            (u * u * u * c["c3"]).alias("p3"), c["n"].alias("n"), (c["n"] - 1).alias("e"), c["from"].alias("from"), c["to"].alias("to"))

        def total(p):
            n, e = p["n"], p["e"]
            s1 = n * e / 2
            whole = n * p["p0"] + s1 * p["p1"] + s1 * (2 * n - 1) / 3 * p["p2"] + s1 * s1 * p["p3"]
            last = p["p0"] + e * (p["p1"] + e * (p["p2"] + e * p["p3"]))
            return whole - F.when(p["from"] == 0, p["p0"] / 2).otherwise(0.0) - F.when(p["to"] == SAMPLES, last / 2).otherwise(0.0)
        return _let(given, lambda g: F.when(g["to"] <= g["from"], F.lit(0.0)).otherwise(_let(_let(cubic(g), powers), total)))
    return F.when((hi > lo) & (F.size(knots) > 1), F.aggregate(F.sequence(F.lit(0), pieces - 1), F.lit(0.0), lambda s, k: s + piece(k)))


def bd_rate(rows: DataFrame, anchor: str, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Average rate difference to the anchor at equal quality, in percent, per tested method and curve.

    Monotone piecewise-cubic ln(bpp) over quality; trapezoid integrals of both curves over the shared quality range. NULL where the
    ranges do not overlap or a rate is not positive. ``rows`` is read once and shuffled once, by curve: a curve's points become one
    array, no longer than its ladder, and the anchor's array meets those of the other methods by a window in the same partition.
    """
    shared = [*keys, *CURVE]
    placed = rows.select("method", *shared, F.struct("rate_key", "bpp", "value").alias("p")).repartition(*shared)
    curves = placed.groupBy("method", *shared).agg(F.collect_list("p").alias("c")).select(
        "method", *shared, F.size("c").alias("n"), F.array_min("c").alias("first"), _knots(F.col("c")).alias("knots"))
    usable = (F.col("method") == anchor) & (F.col("first.bpp") > 0)
    base = F.first(F.when(usable, F.col("knots")), ignorenulls=True).over(W.partitionBy(*shared))
    pairs = (curves.withColumn("base", base).filter(F.col("base").isNotNull() & (F.col("method") != anchor) & (F.col("n") >= MIN_POINTS)
                                                    & (F.col("first.value") > 0)))
    ends = lambda k, at: F.element_at(F.col(f"{k}.q"), at)
    pairs = pairs.filter((F.size("knots") > 0) & (F.size("base") > 0)).withColumns({
        "lo": F.greatest(ends("knots", 1), ends("base", 1)), "hi": F.least(ends("knots", -1), ends("base", -1))})
    for side in ("knots", "base"):
        pairs = pairs.withColumn(f"{side}_h", F.when(F.size(side) > 1, _steps(F.col(side))))
        pairs = pairs.withColumn(f"{side}_m", F.when(F.size(side) > 1, _slopes(F.col(f"{side}_h"))))
        pairs = pairs.withColumn(f"{side}_s", _sample_sum(F.col(side), F.col(f"{side}_h"), F.col(f"{side}_m"), F.col("lo"), F.col("hi")))
    # The mean difference is sum * step / (hi - lo), and step is the range over the number of intervals.
    diff = (F.col("knots_s") - F.col("base_s")) / (SAMPLES - 1)
    return pairs.select("method", *shared, ((F.exp(diff) - 1) * 100).alias("bd_rate"))


def bd_summary(class_bd: DataFrame, sequence_bd: DataFrame) -> DataFrame:
    """Per dataset and method: mean of the sequence values next to the value of the class curve."""
    mean = (sequence_bd.groupBy("method", "dataset", *CURVE)
            .agg(F.avg("bd_rate").alias("average"), F.count("bd_rate").alias("sequences")))
    overall = class_bd.select("method", "dataset", *CURVE, F.col("bd_rate").alias("overall"))
    return overall.join(mean, ["method", "dataset", *CURVE], "left")


# --------------------------------------------------------------------------- report shapes


def rotate(bd: DataFrame, names: Sequence[str], rows: Sequence[str] = ("dataset",), across: str = "method",
           value: str = "bd_rate") -> DataFrame:
    """A report as a table: ``across`` becomes columns, ``rows`` stay rows.

    Groups by methods or methods by groups, as asked. The names of the columns are given, so no extra
    pass over the data finds them.
    """
    return bd.groupBy(*rows, *CURVE).pivot(across, list(names)).agg(F.first(value))


def with_overall_rows(sequence_bd: DataFrame, summary: DataFrame) -> DataFrame:
    """Sequence rows followed by the ``* Overall`` and ``* Average`` rows of their dataset."""
    extra = summary.select("method", "dataset", *CURVE, F.expr("inline(array(struct('* Overall' AS sequence, overall AS bd_rate), struct('* Average' AS sequence, average AS bd_rate)))"))
    return sequence_bd.select("method", "dataset", *CURVE, "sequence", "bd_rate").unionByName(extra)


def report_order(df: DataFrame, name: str) -> list[Column]:
    """Names ascending, starred rows last, ``* Overall`` before ``* Average``."""
    star = F.col(name).startswith("*")
    return [star.asc(), F.when(star, F.lit(None).cast("string")).otherwise(F.col(name)).asc(),
            F.when(star, F.col(name)).desc()]


def flatten_datasets(points: DataFrame, strict_names: bool = True) -> DataFrame:
    """Sequence-level view. Default keeps (dataset, sequence).

    ``strict_names=False`` keys by sequence alone; where two datasets share a name the later dataset
    (by name) replaces the earlier one for that method.
    """
    if strict_names:
        return points
    last = (points.groupBy("method", "sequence").agg(F.max("dataset").alias("dataset")))
    return points.join(last, ["method", "sequence", "dataset"], "left_semi").drop("dataset")


def report_cells(df: DataFrame, value: str = "bd_rate", digits: int = 1) -> DataFrame:
    """Report text of a value, with the fixed number of digits."""
    return df.withColumn(value, fixed_digits(value, digits))
