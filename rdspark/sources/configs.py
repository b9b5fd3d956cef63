"""Test configurations: nested JSON -> one row per sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rdspark.functions.ladders import join_path

_SEQUENCE = "STRUCT<width INT, height INT, frames INT, intra_period INT, gop INT>"
_CLASS = f"STRUCT<test INT, base_path STRING, src_type STRING, img_folder INT, sequences MAP<STRING, {_SEQUENCE}>>"
WRAPPED = f"root_path STRING, test_classes MAP<STRING, {_CLASS}>"
PLAIN = f"MAP<STRING, {_CLASS}>"


def parse_test_config(texts: DataFrame, text: str = "value", root_path: str | None = None) -> DataFrame:
    """Sequences of configuration documents, one document per row.

    Documents with ``root_path``/``test_classes`` and older ones with the classes at top level are both
    understood, as are ``gop`` for the period and a missing ``test`` switch. Image-folder classes give
    one row with a NULL sequence.
    """
    strict = {"mode": "FAILFAST"}
    wrapped = F.from_json(text, WRAPPED, strict)
    is_plain = wrapped["test_classes"].isNull()
    plain = F.when(is_plain, F.from_json(text, PLAIN, strict))
    # An older document has no root, and its class map is the document itself.
    src = texts.select(F.when(is_plain, plain).otherwise(wrapped["test_classes"]).alias("classes"),
                       F.coalesce(F.lit(root_path), wrapped["root_path"], F.lit("")).alias("root"))
    classes = src.select("root", F.explode("classes").alias("dataset", "c"))
    seqs = classes.select("root", "dataset", "c", F.explode_outer("c.sequences").alias("sequence", "s"))
    return seqs.select(
        "dataset", "sequence", F.coalesce("c.src_type", F.lit("png")).alias("src_type"),
        join_path("root", F.coalesce("c.base_path", F.lit(""))).alias("base_path"),
        F.col("s.width").alias("width"), F.col("s.height").alias("height"), F.col("s.frames").alias("frame_num"),
        F.coalesce("s.intra_period", "s.gop").alias("intra_period"),
        (F.coalesce("c.test", F.lit(1)) != 0).alias("enabled"),
        (F.coalesce("c.img_folder", F.lit(0)) == 1).alias("img_folder"))


def read_test_config(spark: SparkSession, path: str, root_path: str | None = None, lines: bool = False) -> DataFrame:
    """Sequences of a configuration file or folder. ``lines`` reads one document per line.

    A configuration is one JSON document per file; many files are read in parallel.
    """
    return parse_test_config(spark.read.text(path, wholetext=not lines), root_path=root_path)
