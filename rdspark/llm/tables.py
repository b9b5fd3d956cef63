"""Reading the given tables, shared folders, and the switch of settings around a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rdspark.sources.storage import scratch_path

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The result as a Parquet table in the shared folder: read often, computed once, safe when executors go."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns(df: DataFrame) -> list:
    """All columns by their literal names."""
    return [F.col(f"`{c}`") for c in df.columns]


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, text): null texts as empty ones. Rows with equal ids and texts share their row_key."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64(F.col("doc_id").cast("long"), F.col("text").isNull(), F.coalesce("text", F.lit(""))).alias("row_key"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold(doc_id: str, n: int):
    """crc32 of the id as text, modulo n. Rows without an id are in fold -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(n)), F.lit(-1)).cast("int")


def buckets(spark: SparkSession, at_least: float = 1) -> int:
    """Partitions for keyed work: the session's setting, more where the data need more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(at_least), 1)
