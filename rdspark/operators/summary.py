"""Frame log -> results per rate point. Conditional aggregates only, so every shuffle carries partial sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from rdspark.functions.results import bits_per_pixel, chunk_weight, col, fixed_digits

POINT_KEYS = ["method", "dataset", "sequence", "rate_idx"]
PLANES = ["y", "u", "v"]
COMPONENTS = ["mv_y", "mv_z", "y", "z"]
GROUPS = ["i", "p", "all"]
ARRAY_CHUNK = 4096   # frames per row in the array form


def metric_names(include_planes: bool = True) -> list[str]:
    base = ["psnr", "msssim"]
    return base + [f"{b}_{p}" for b in base for p in PLANES] if include_planes else base


def _is_intra() -> Column:
    return F.col("frame_type") == 0


def _mean(total: Column, count: Column) -> Column:
    return F.when(count > 0, total.cast("double") / count).otherwise(F.lit(0.0))


def sequence_summary(frames: DataFrame, keys: Sequence[str] = POINT_KEYS, include_planes: bool = True,
                     extra: dict[str, Column] | None = None) -> DataFrame:
    """Counts and means of rate and quality over I, P and all frames of each point.

    A group without frames counts as 0. A mean is over the frames that have the value; a metric that no frame of the group has is
    NULL. Every frame type other than 0 is a P frame. ``extra`` adds aggregates.
    """
    names = metric_names(include_planes)
    intra = _is_intra()
    aggs = [F.max("pixel_num").alias("frame_pixel_num"),
            F.count_if(intra).alias("i_frame_num"), F.count_if(~intra).alias("p_frame_num")]
    for tag, cond in (("i", intra), ("p", ~intra)):
        for m in ["bits", *names]:
            aggs += [F.sum(F.when(cond, F.col(m))).alias(f"__{tag}_{m}"), F.count(F.when(cond, F.col(m))).alias(f"__{tag}_{m}_n")]
    aggs += [c.alias(n) for n, c in (extra or {}).items()]
    g = frames.groupBy(*keys).agg(*aggs)

    px, ni, np_ = F.col("frame_pixel_num"), F.col("i_frame_num"), F.col("p_frame_num")
    counts = {"i": ni, "p": np_, "all": ni + np_}

    def mean(tag: str, what: str) -> Column:
        parts = ["i", "p"] if tag == "all" else [tag]
        add = lambda end: sum((F.coalesce(F.col(f"__{t}_{what}{end}"), F.lit(0)) for t in parts[1:]), F.coalesce(F.col(f"__{parts[0]}_{what}{end}"), F.lit(0)))
        return F.when(counts[tag] == 0, F.lit(0.0)).when(add("_n") > 0, add("").cast("double") / add("_n"))

    cols = [*keys, "frame_pixel_num", "i_frame_num", "p_frame_num"]
    for tag in GROUPS:
        cols.append((mean(tag, "bits") / px).alias(f"ave_{tag}_frame_bpp"))
        cols += [mean(tag, m).alias(f"ave_{tag}_frame_{m}") for m in names]
    return g.select(*cols, *(extra or {}))


def frame_arrays(frames: DataFrame, keys: Sequence[str] = POINT_KEYS, include_planes: bool = False,
                 chunk: int = ARRAY_CHUNK, frame_idx: str = "frame_idx") -> DataFrame:
    """Ordered per-frame lists, cut into rows of at most ``chunk`` frame positions.

    Rows of one point in ``chunk_no`` order, put end to end, are its whole lists.
    """
    names = metric_names(include_planes)
    packed = frames.select(
        *keys, F.floor(F.col(frame_idx) / chunk).cast("bigint").alias("chunk_no"),
        F.struct(F.col(frame_idx).alias("k"), bits_per_pixel("bits", "pixel_num").alias("bpp"),
                 *[F.col(m) for m in names], F.col("frame_type")).alias("f"))
    lists = packed.groupBy(*keys, "chunk_no").agg(F.array_sort(F.collect_list("f")).alias("f"))
    return lists.select(*keys, "chunk_no", F.col("f.k")[0].alias("first_frame"),
                        F.col("f.bpp").alias("frame_bpp"),
                        *[F.col(f"f.{m}").alias(f"frame_{m}") for m in names],
                        F.col("f.frame_type").alias("frame_type"))


def whole_lists(points: DataFrame, chunks: DataFrame, keys: Sequence[str] = POINT_KEYS) -> DataFrame:
    """``points`` with the whole per-frame lists put together from the chunks of ``frame_arrays``, in chunk order.

    A point's lists become cells of its row, so a point is bounded by what a cell holds (2 GB); longer ones are written by chunks
    (``sinks.results.write_result_document``). A point without chunks is an error.
    """
    names = [c for c in chunks.columns if c not in (*keys, "chunk_no", "first_frame")]
    packed = chunks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("chunk_no", *names))).alias("__c"))
    met = points.join(packed, list(keys), "left")
    lost = F.raise_error(F.concat_ws(" ", F.lit("no frames for point"), *[F.col(k).cast("string") for k in keys]))
    checked = met.withColumn("__c", F.when(F.col("__c").isNull(), lost).otherwise(F.col("__c")))
    return checked.select(*points.columns, *[F.flatten(F.col(f"__c.{n}")).alias(n) for n in names])


def component_summary(frames: DataFrame, keys: Sequence[str] = POINT_KEYS) -> DataFrame:
    """Mean bits per pixel of each stream component over the P frames; 0 where there are none."""
    p = ~_is_intra()
    g = frames.groupBy(*keys).agg(
        F.max("pixel_num").alias("__px"), F.count_if(p).alias("p_frame_num"),
        F.sum(F.when(p, F.col("bits"))).alias("__bits"),
        *[F.sum(F.when(p, F.col(f"bits_{c}"))).alias(f"__{c}") for c in COMPONENTS])
    pixels = F.col("p_frame_num") * F.col("__px")
    share = lambda c: F.when(pixels > 0, F.coalesce(F.col(c), F.lit(0)) / pixels).otherwise(F.lit(0.0))
    return g.select(*keys, "p_frame_num", share("__bits").alias("ave_p_frame_bpp"),
                    *[share(f"__{c}").alias(f"ave_p_frame_bpp_{c}") for c in COMPONENTS])


def recombine(points: DataFrame, metrics: Sequence[str] = ("bpp", "psnr", "msssim")) -> DataFrame:
    """All-frame values of a stored point from its I and P means."""
    i, p = F.col("i_frame_num"), F.col("p_frame_num")
    for m in metrics:
        total = i * F.col(f"ave_i_frame_{m}") + p * F.col(f"ave_p_frame_{m}")
        points = points.withColumn(f"ave_all_frame_{m}", _mean(total, i + p))
    return points


def keep_columns(points: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Only the listed columns that exist, in table order."""
    return points.select(*[c for c in points.columns if c in set(allowed)])


def unit_timing(units: DataFrame, keys: Sequence[str] = POINT_KEYS, unit_no: str = "unit_no", skip: int = 4,
                enabled: bool = True) -> DataFrame:
    """Mean coding times per point without the first ``skip`` units.

    NULL unless measuring is on and the point has more units than are skipped. ``unit_no`` counts the
    units of a point from 0, so the warm-up is a condition on a column and no window is needed.
    """
    warm = F.col(unit_no) >= skip
    g = units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unit_num"),
        F.avg(F.when(warm, F.col("enc_s"))).alias("__e"), F.avg(F.when(warm, F.col("dec_s"))).alias("__d"))
    usable = (F.col("unit_num") > skip) & F.lit(bool(enabled))
    return g.select(*keys, "unit_num", F.when(usable, F.col("__e")).alias("avg_frame_encoding_time"),
                    F.when(usable, F.col("__d")).alias("avg_frame_decoding_time"))


def timing_report(points: DataFrame, dataset: str | None = None, delay: int = 1,
                  keys: Sequence[str] = ("method",)) -> DataFrame:
    """Unweighted mean of the unit times of one dataset, in ms and as frames per second."""
    rows = points if dataset is None else points.filter(F.col("dataset") == dataset)
    g = rows.groupBy(*keys).agg(F.avg("avg_frame_encoding_time").alias("__e"),
                                F.avg("avg_frame_decoding_time").alias("__d"))
    rate = lambda c: F.when(F.col(c) > 0, delay / F.col(c))
    return g.select(*keys, (F.col("__e") * 1000).alias("encode_ms"), rate("__e").alias("encode_fps"),
                    (F.col("__d") * 1000).alias("decode_ms"), rate("__d").alias("decode_fps"))


def predicted_frame_time(frames: DataFrame, keys: Sequence[str] = POINT_KEYS) -> DataFrame:
    """Mean coding milliseconds over the P frames only."""
    p = ~_is_intra()
    return frames.groupBy(*keys).agg(
        F.count_if(p).alias("p_frame_num"),
        (F.avg(F.when(p, F.col("enc_s"))) * 1000).alias("encode_ms"),
        (F.avg(F.when(p, F.col("dec_s"))) * 1000).alias("decode_ms"))


def rate_quality_label(frames: DataFrame, keys: Sequence[str] = POINT_KEYS) -> DataFrame:
    """Mean rate and quality as a run label ``{rate}_{bpp:.4f}_{psnr:.4f}``."""
    g = frames.groupBy(*keys).agg(
        (F.avg("bits") / F.max("pixel_num")).alias("avg_bpp"), F.avg("psnr").alias("avg_psnr"))
    return g.withColumn("label", F.concat_ws("_", "rate_idx", fixed_digits("avg_bpp", 4), fixed_digits("avg_psnr", 4)))


def frame_type_groups(frames: DataFrame, keys: Sequence[str] = POINT_KEYS) -> DataFrame:
    """The same summary for the groups i, p and all, in one pass over the frames (grouping sets)."""
    kind = F.when(_is_intra(), F.lit("i")).otherwise(F.lit("p"))
    typed = frames.select(*keys, kind.alias("__kind"), "bits", "pixel_num", "psnr", "msssim")
    sets = [[*[F.col(k) for k in keys], F.col("__kind")], [F.col(k) for k in keys]]
    g = typed.groupingSets(sets, *[F.col(k) for k in keys], F.col("__kind")).agg(
        F.count(F.lit(1)).alias("frame_num"), (F.avg("bits") / F.max("pixel_num")).alias("bpp"),
        F.avg("psnr").alias("psnr"), F.avg("msssim").alias("msssim"),
        F.grouping("__kind").alias("__all"))
    tag = F.when(F.col("__all") == 1, F.lit("all")).otherwise(F.col("__kind"))
    return g.select(*keys, tag.alias("frame_group"), "frame_num", "bpp", "psnr", "msssim")


def run_totals(points: DataFrame) -> DataFrame:
    """Frames, sequences and points of a run in one row, with the summed test time in minutes."""
    keyed = points.groupBy("dataset", "sequence").agg(
        F.sum("frame_num").alias("f"), F.count(F.lit(1)).alias("n"), F.sum("test_time").alias("t"))
    return keyed.agg(F.sum("f").alias("frames"), F.count(F.lit(1)).alias("sequences"),
                     F.sum("n").alias("points"), (F.sum("t") / 60).alias("minutes"))


def observe_totals(points: DataFrame, name: str = "run_totals") -> tuple[DataFrame, Observation]:
    """Same counters collected on the way, while the points are written by someone else's action."""
    seen = Observation(name)
    return points.observe(seen, F.sum("frame_num").alias("frames"), F.count(F.lit(1)).alias("points")), seen


def best_rate_per_multiplier(points: DataFrame, keys: Sequence[str], lam: Column | str = "lam") -> DataFrame:
    """Mean and smallest cost ``lam * mse + bpp`` per group and multiplier, with the point that reaches it."""
    cost = col(lam).cast("double") * F.col("mse") + F.col("bpp")
    return points.withColumn("cost", cost).groupBy(*keys).agg(
        F.avg("cost").alias("mean_cost"), F.min("cost").alias("best_cost"),
        F.min_by("rate_idx", F.struct("cost", "rate_idx")).alias("best_rate_idx"))


def chunk_distortion(frames: DataFrame, keys: Sequence[str], position: str = "frame_idx") -> DataFrame:
    """Weighted error of each chunk of eight frames. A chunk that lacks or repeats a frame is reported with NULL and its row count."""
    g = (frames.withColumn("chunk_no", F.floor(F.col(position) / 8).cast("bigint"))
         .groupBy(*keys, "chunk_no")
         .agg(F.sum(F.col("mse") * chunk_weight(position)).alias("__e"), F.count(F.lit(1)).alias("frames"),
              F.bit_or(F.call_function("shiftleft", F.lit(1), F.pmod(F.col(position), F.lit(8)).cast("int"))).alias("__seen")))
    whole = (F.col("frames") == 8) & (F.col("__seen") == 255)
    return g.select(*keys, "chunk_no", "frames", F.when(whole, F.col("__e")).alias("weighted_mse"))


def symbol_information(df: DataFrame, group: Sequence[str], symbol: str) -> DataFrame:
    """Bits needed for the symbols of each group under its own empirical frequencies.

    With n of T symbols alike, sum of -n log2(n / T) is T log2 T - sum of n log2 n: symbols are counted, the counts are summed, and nothing
    is joined. Both aggregates combine before they shuffle.
    """
    counts = df.groupBy(*group, symbol).agg(F.count(F.lit(1)).cast("double").alias("__n"))
    total = F.sum("__n")
    return counts.groupBy(*group).agg(total.cast("bigint").alias("symbols"), F.count(F.lit(1)).alias("distinct_symbols"),
                                      F.greatest(total * F.log2(total) - F.sum(F.col("__n") * F.log2("__n")), F.lit(0.0)).alias("bits"))
