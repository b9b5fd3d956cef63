"""Training manifests: JSON descriptions of image and video folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rdspark.functions.ladders import join_path
from rdspark.operators.ordered import ordered_scan
from rdspark.sources.split_json import SPLIT_BYTES, enclosed, json_elements
from rdspark.sources.storage import stored

_SEQS = "ARRAY<STRUCT<path STRING, width INT, height INT, seq_length INT>>"
VIDEO_TYPE = f"seqs {_SEQS}, frames ARRAY<STRING>"
STRICT = {"mode": "FAILFAST"}


def _keyed(texts: DataFrame) -> list[str]:
    """The column that names a document, where the texts have one."""
    return ["manifest"] if "manifest" in texts.columns else []


def parse_image_manifest(texts: DataFrame, root: str, text: str = "value") -> DataFrame:
    """Images of JSON arrays of relative paths, numbered in array order; text that is not such an array is an error."""
    paths = texts.select(*_keyed(texts), F.posexplode(F.from_json(text, "ARRAY<STRING>", STRICT)).alias("image_id", "name"))
    return paths.select(*_keyed(texts), "image_id", "name", join_path(F.lit(root), "name").alias("path"))


def parse_video_manifest(texts: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(sequences, shared frame names) of description documents. A ``manifest`` column of the texts is carried into both, so that
    the names of one document never meet the sequences of another."""
    d = texts.select(*_keyed(texts), F.from_json(text, VIDEO_TYPE, STRICT).alias("d"))

    def items(field: str, number: str, item: str) -> DataFrame:
        # From an inner explode Spark takes a filter on the size of the list, which it puts before the texts are spread over tasks: each would be made and parsed there as well.
        return d.select(*_keyed(texts), F.posexplode_outer(f"d.{field}").alias(number, item)).where(F.col(number).isNotNull())
    seqs = items("seqs", "seq_id", "s").select(*_keyed(texts), "seq_id", "s.*")
    names = items("frames", "frame_no", "frame_name")
    return seqs, names


def _listed(spark: SparkSession, path: str, lists: list[str], split_bytes: int) -> DataFrame:
    """(manifest, name, place, text): the items of the lists of description documents, with their number in the list."""
    if lists:
        items = enclosed(json_elements(spark, path, 2, strict=False, split_bytes=split_bytes), ["name"]).where(F.col("name").isin(lists) & F.col("key").isNull())
    else:
        items = enclosed(json_elements(spark, path, 1, split_bytes=split_bytes), []).withColumn("name", F.lit("")).where(F.col("key").isNull())
    return ordered_scan(items, ["doc", "name"], ["pos"], number="place").select(F.col("doc").alias("manifest"), "name", F.col("place").cast("int").alias("place"), "text")


def _string(text: str):
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), "ARRAY<STRING>", STRICT)[0]


def read_image_manifest(spark: SparkSession, root: str, name: str = "description.json", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Images of a description below ``root``, a JSON array of relative paths; read by byte ranges, whatever its size."""
    items = _listed(spark, f"{root}/{name}", [], split_bytes)
    return items.select("manifest", F.col("place").alias("image_id"), _string("text").alias("name")).withColumn("path", join_path(F.lit(root), "name"))


def read_video_manifest(spark: SparkSession, root: str, name: str = "description.json", split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(sequences, shared frame names) of a description below ``root``, read by byte ranges."""
    items = stored(_listed(spark, f"{root}/{name}", ["seqs", "frames"], split_bytes), "manifest")
    # Stored alone: a filter on what is parsed may be put before the one on the name, and a frame's name is no sequence.
    seqs = stored(items.where("name = 'seqs'"), "seqs").select("manifest", F.col("place").alias("seq_id"), F.from_json("text", "path STRING, width INT, height INT, seq_length INT", STRICT).alias("s"))
    names = items.where("name = 'frames'").select("manifest", F.col("place").alias("frame_no"), _string("text").alias("frame_name"))
    return seqs.select("manifest", "seq_id", "s.*"), names
