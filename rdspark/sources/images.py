"""Image folders: listings and numbered frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from rdspark.operators.numbering import spread_join
from rdspark.operators.ordered import contiguous_prefix


def list_images(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Files of a folder with a suffix, by name. Only the listing is read, never the contents."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
             .select("path", "length", "modificationTime"))
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1)).orderBy("name")


def _numbered(df: DataFrame, path: str) -> DataFrame:
    """Sequence (folder name) and number text of paths that look like a numbered picture."""
    digits = F.regexp_extract(path, r"/im(\d+)\.png$", 1)
    return (df.withColumns({"sequence": F.element_at(F.split(path, "/"), -2), "digits": digits})
            .filter(F.col("digits") != "").withColumn("frame_no", F.col("digits").cast("int")))


def _fits(short) -> Column:
    """The number text follows the rule of its folder: plain, or padded to five digits."""
    plain = F.col("frame_no").cast("string")
    padded = F.when(F.length(plain) < 5, F.lpad(plain, 5, "0")).otherwise(plain)
    return F.col("digits") == F.when(short, plain).otherwise(padded)


def usable_ranges(spark: SparkSession, folder: str, start: int = 1) -> DataFrame:
    """Per sequence folder its naming rule and the last number before the first gap, from the listing alone."""
    names = _numbered(spark.read.format("binaryFile").load(folder).select("path"), "path").select("sequence", "digits", "frame_no")
    # The first picture tells the rule of its folder: "1" is plain, "00001" has five digits.
    rule = names.groupBy("sequence").agg(F.max(F.col("digits") == "1").alias("short"), F.max(F.col("digits") == "00001").alias("long"))
    unknown = F.raise_error(F.concat(F.lit("unknown image naming convention in "), F.col("sequence"))).cast("boolean")
    rule = rule.select("sequence", F.when(F.col("short") | F.col("long"), F.col("short")).otherwise(unknown).alias("short"))
    named = spread_join(names, rule, ["sequence"], "frame_no", how="inner").filter(_fits(F.col("short")))
    kept = contiguous_prefix(named, ["sequence"], "frame_no", start)
    return kept.groupBy("sequence").agg(F.max("frame_no").alias("stop"), F.max("short").alias("short"))


def read_png_frames(spark: SparkSession, folder: str, width: int | None = None, height: int | None = None,
                    start: int = 1) -> DataFrame:
    """Numbered pictures ``im1.png`` or ``im00001.png`` as frame rows, from ``start`` to the first gap.

    ``folder`` may be a glob over many sequence folders; the folder name is the sequence. Pictures are
    decoded once, by Spark's image source; rules and gaps come from the listing. A size other than the
    expected one is an error, as is a folder that follows neither naming rule.
    """
    images = _numbered(spark.read.format("image").load(folder).select("image.*"), "origin")
    frames = spread_join(images, usable_ranges(spark, folder, start), ["sequence"], "frame_no", how="inner")
    frames = frames.filter(F.col("frame_no").between(F.lit(start), F.col("stop")) & _fits(F.col("short")))
    if width is not None and height is not None:
        wrong = F.raise_error(F.concat(F.lit("unexpected picture size in "), F.col("sequence"))).cast("int")
        frames = frames.withColumn("width", F.when((F.col("width") == width) & (F.col("height") == height), F.col("width")).otherwise(wrong))
    return frames.select("sequence", (F.col("frame_no") - start).cast("bigint").alias("frame_idx"), "width", "height", "nChannels", "data")


def split_bgr(frames: DataFrame) -> DataFrame:
    """Interleaved BGR bytes as three planes p0 (red), p1 (green), p2 (blue)."""
    @pandas_udf("p0 binary, p1 binary, p2 binary")
    def split(data: pd.Series, channels: pd.Series) -> pd.DataFrame:
        rows = []
        for d, n in zip(data, channels):
            a = np.frombuffer(d, np.uint8).reshape(-1, n)
            order = [2, 1, 0] if n >= 3 else [0, 0, 0]
            rows.append([np.ascontiguousarray(a[:, k]).tobytes() for k in order])
        return pd.DataFrame(rows, columns=["p0", "p1", "p2"])

    out = frames.withColumn("__p", split("data", "nChannels"))
    return out.select("sequence", "frame_idx", "width", "height", F.lit(8).alias("bit_depth"), F.lit("rgb").alias("layout"), "__p.*")
