"""Evaluation planning: which points to run, which results to reuse, where results belong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from rdspark.functions import ladders
from rdspark.operators.numbering import spread_join
from rdspark.operators.ordered import ordered_scan


def enabled_only(sequences: DataFrame) -> DataFrame:
    """Sequences of the datasets that are switched on."""
    return sequences.filter(F.col("enabled"))


def expand_image_folders(sequences: DataFrame, files: DataFrame) -> DataFrame:
    """Configuration rows where an image folder is replaced by its files, one "sequence" per picture.

    ``files`` lists paths. A picture belongs to the folder it lies in and must end in the source type. A folder without
    pictures is an error.
    """
    folder = lambda c: F.regexp_replace(F.regexp_replace(c, r"^file:/+", "/"), r"/+$", "")
    listed = files.select(folder(F.regexp_replace("path", r"/[^/]*$", "")).alias("__folder"),
                          F.element_at(F.split("path", "/"), -1).alias("sequence"))
    folders = sequences.filter("img_folder").drop("sequence").withColumn("__folder", folder(F.col("base_path")))
    pictures = spread_join(listed, folders, ["__folder"], F.xxhash64("sequence"), how="inner")
    pictures = pictures.filter(F.col("sequence").endswith(F.col("src_type")))
    lost = F.raise_error(F.concat(F.lit("no pictures in "), F.col("__folder"))).cast("string")
    empty = (folders.join(pictures.select("__folder").distinct(), "__folder", "left_anti").withColumn("sequence", lost)
             .select(*sequences.columns))
    return sequences.filter(~F.col("img_folder")).unionByName(pictures.drop("__folder")).unionByName(empty)


def select_dataset(df: DataFrame, dataset: str) -> DataFrame:
    return df.filter(F.col("dataset") == dataset)


def job_matrix(sequences: DataFrame, steps: int = 4, qp_i: Sequence[int] | None = None,
               qp_p: Sequence[int] | None = None, force_intra: bool = False, force_intra_period: int = -1,
               force_frame_num: int = -1) -> DataFrame:
    """Every enabled sequence at every rate.

    The ladder is a literal array inside the plan, so each row unfolds locally: no join, no shuffle.
    """
    intra, inter = ladders.choose_ladder(steps, qp_i, qp_p, force_intra)
    as_array = lambda values: F.lit(list(values)) if values else F.lit(None).cast("array<int>")
    steps_ = F.transform(as_array(intra), lambda q, i: F.struct(
        i.cast("int").alias("rate_idx"), q.cast("int").alias("qp_i"),
        (F.get(as_array(inter), i) if inter else F.lit(None)).cast("int").alias("qp_p")))
    jobs = enabled_only(sequences).select("*", F.inline(steps_))
    return jobs.withColumns({
        "intra_period": ladders.effective_intra_period("intra_period", force_intra, force_intra_period),
        "frame_num": ladders.effective_frame_num("frame_num", force_frame_num),
        "rate_key": ladders.rate_key("rate_idx"),
        "bin_name": ladders.stream_name("sequence", "qp_i"),
        "json_name": ladders.sibling_name(ladders.stream_name("sequence", "qp_i"), ".json")})


def remaining_jobs(jobs: DataFrame, done: DataFrame, keys: Sequence[str] = ("dataset", "sequence", "qp_i")) -> DataFrame:
    """Jobs that must run: no stored point whose frame counts add up to the request and whose stream exists."""
    return jobs.join(_complete(done, keys), [*keys, "frame_num"], "left_anti")


def reusable_points(jobs: DataFrame, done: DataFrame, keys: Sequence[str] = ("dataset", "sequence", "qp_i")) -> DataFrame:
    """Stored points that answer a job."""
    counted = done.withColumn("frame_num", F.col("i_frame_num") + F.col("p_frame_num"))
    if "stream_exists" in done.columns:
        counted = counted.filter("stream_exists")
    return counted.join(jobs.select(*keys, "frame_num"), [*keys, "frame_num"], "left_semi")


def _complete(done: DataFrame, keys: Sequence[str]) -> DataFrame:
    if "stream_exists" in done.columns:
        done = done.filter("stream_exists")
    return done.select(*keys, (F.col("i_frame_num") + F.col("p_frame_num")).alias("frame_num"))


def place_results(scaffold: DataFrame, results: DataFrame,
                  keys: Sequence[str] = ("dataset", "sequence", "rate_idx")) -> DataFrame:
    """Configured points with their results; a point without a result keeps NULLs."""
    return scaffold.join(results, list(keys), "left")


def place_by_prefix(scaffold: DataFrame, results: DataFrame, checkpoints: DataFrame, order: str = "result_no") -> DataFrame:
    """Results placed by name prefix: the last result whose name starts with the checkpoint name wins.

    ``q1`` also matches a result of ``q10``. The prefix test is an equi join: each name is unfolded
    into its prefixes of the lengths that checkpoints really have, and joined on the prefix. So no
    name meets a checkpoint it does not match.
    """
    ckpt = checkpoints.select("checkpoint").distinct()
    lengths = ckpt.agg(F.collect_set(F.length("checkpoint")).alias("__lengths"))  # distinct lengths: at most one per character
    named = results.withColumn("__lengths", lengths.scalar())
    cut = F.transform(F.filter("__lengths", lambda n: n <= F.length("name")), lambda n: F.substring(F.col("name"), F.lit(1), n))
    matched = named.withColumn("checkpoint", F.explode(cut)).drop("__lengths").join(ckpt, "checkpoint", "left_semi")
    payload = [c for c in results.columns if c not in ("dataset", "sequence")]
    won = (matched.groupBy("dataset", "sequence", "checkpoint")
           .agg(F.max_by(F.struct(*payload), order).alias("r"))
           .select("dataset", "sequence", "checkpoint", "r.*"))
    return scaffold.join(won, ["dataset", "sequence", "checkpoint"], "left")


def latest_runs(files: DataFrame, keys: Sequence[str] = (), keep: int = 2) -> DataFrame:
    """The newest ``keep`` files (per key), newest first. ``files`` has path and modification time.

    Each task keeps its own best first (a limit for the whole table, a bounded merge per key), so only
    ``keep`` rows per key travel.
    """
    if not keys:
        return files.orderBy(F.desc("modificationTime"), F.desc("path")).limit(keep)
    rank = W.partitionBy(*keys).orderBy(F.desc("modificationTime"), F.desc("path"))
    return files.withColumn("__r", F.row_number().over(rank)).filter(F.col("__r") <= keep).drop("__r")


def number_jobs(jobs: DataFrame, order: Sequence[str]) -> DataFrame:
    """Global 0-based submission number."""
    return ordered_scan(jobs, [], order, number="job_no")
