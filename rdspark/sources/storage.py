"""Where jobs put intermediate tables, and file access that works inside tasks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Mapping
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder path below the shared folder named by ``spark.checkpoint.dir``.

    Without that setting a folder of this machine will do if the master is local, and only then: elsewhere every
    executor would write to a disk of its own, so this raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = _local_base(spark.sparkContext.master)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


_made: list[str] = []


def _local_base(master: str) -> str:
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="rdspark-")


def clear_scratch(spark: SparkSession) -> int:
    """Remove the intermediate folders this process has made; results read from them must be stored before. Returns their number."""
    n = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def stored(df: DataFrame, name: str) -> DataFrame:
    """A result as a Parquet table in the scratch folder, for plans that read it more than once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_store(path: str):
    """(file system, path inside it) for a local path or URI, usable on executors."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if path.startswith(("s3a:", "s3n:")):   # Spark's names for the same store
        path = "s3" + path[3:]
    return fs.FileSystem.from_uri(path)


def full_path(path: str) -> str:
    """A path that means the same in every process."""
    return path if re.match(r"[A-Za-z][\w+.-]*:", path) else os.path.abspath(path)


_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def folder_name(values: Mapping[str, object]) -> str:
    """``name=value`` folders, spelled like those of Spark's ``partitionBy``."""
    spell = lambda v: _NO_VALUE if v is None or v == "" else re.sub(r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]", lambda m: f"%{ord(m[0]):02X}", str(v))
    return "/".join(f"{k}={spell(v)}" for k, v in values.items())


def folder_values(path: str) -> dict[str, str | None]:
    """What the ``name=value`` folders of a path say."""
    pairs = [p.split("=", 1) for p in path.split("/")[:-1] if "=" in p]
    return {k: None if v == _NO_VALUE else unquote(v) for k, v in pairs}
