"""Result logs: nested JSON (dataset -> sequence -> rate key -> numbers) -> ``points`` rows."""

from __future__ import annotations

import io
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from rdspark.operators.comparison import unify_logs
from rdspark.sources.split_json import SPLIT_BYTES, enclosed, json_elements
from rdspark.sources.storage import folder_values, full_path, open_store

PLANES = ("y", "u", "v")
_AVERAGES = [f"ave_{g}_frame_{m}" for g in ("i", "p", "all")
             for m in ["bpp", "psnr", "msssim", *[f"{b}_{p}" for b in ("psnr", "msssim") for p in PLANES], "quality"]]
_COMPONENTS = [f"ave_p_frame_bpp_{c}" for c in ("mv_y", "mv_z", "y", "z")]
_LISTS = ["frame_bpp", "frame_psnr", "frame_msssim", *[f"frame_{b}_{p}" for b in ("psnr", "msssim") for p in PLANES]]

POINT_DDL = ", ".join(
    ["frame_pixel_num BIGINT", "i_frame_num BIGINT", "p_frame_num BIGINT", "test_time DOUBLE",
     *[f"{c} DOUBLE" for c in _AVERAGES + _COMPONENTS],
     "avg_frame_encoding_time DOUBLE", "avg_frame_decoding_time DOUBLE",
     *[f"{c} ARRAY<DOUBLE>" for c in _LISTS], "frame_type ARRAY<INT>",
     "ds_name STRING", "seq STRING", "rate_idx INT", "qp INT", "bpp DOUBLE", "psnr DOUBLE", "msssim DOUBLE",
     "img_path STRING"])
LOG_TYPE = f"MAP<STRING, MAP<STRING, MAP<STRING, STRUCT<{POINT_DDL}>>>>"


def parse_result_log(texts: DataFrame, method: str, text: str = "value") -> DataFrame:
    """Points of log documents, one document (or fragment) per row. Text that is not such a document is an error."""
    log = texts.filter(F.trim(F.regexp_replace(text, r"\s+", " ")) != "").select(F.from_json(text, LOG_TYPE, {"mode": "FAILFAST"}).alias("log"))
    d = log.select(F.explode("log").alias("dataset", "d"))
    s = d.select("dataset", F.explode("d").alias("sequence", "s"))
    r = s.select("dataset", "sequence", F.explode("s").alias("rate_key", "p"))
    return r.select(F.lit(method).alias("method"), "dataset", "sequence", "rate_key", "p.*")


def _is_object(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False


def read_result_log(spark: SparkSession, method: str, path: str, lines: bool | None = None) -> DataFrame:
    """Points of one method.

    ``lines``: one fragment per line, as ``sinks.write_result_log`` writes them, split over tasks like any text; else one document per
    file, read by byte ranges whatever its form and size (``split_json``). Left open, the first line of the log decides, whatever the path is called: a line that is a JSON object of its own means lines.
    """
    if lines is None:
        first = spark.read.text(path).filter("trim(value) <> ''").first()
        lines = first is not None and _is_object(first["value"])
    if lines:
        return parse_result_log(spark.read.text(path), method)
    return read_split_log(spark, method, path)


def read_split_log(spark: SparkSession, method: str, path: str, joined: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Points of nested documents of any size, read by many tasks. ``joined``: the files of a folder, end to end, are one document."""
    rows = enclosed(json_elements(spark, path, 3, joined, split_bytes=split_bytes), ["dataset", "sequence"])
    points = rows.withColumn("p", F.from_json("text", POINT_DDL, {"mode": "FAILFAST"}))
    return points.select(F.lit(method).alias("method"), "dataset", "sequence", F.col("key").alias("rate_key"), "p.*")


def read_result_logs(spark: SparkSession, logs: Mapping[str, str] | Sequence[str], anchor: str | None = None,
                     lines: bool | None = None) -> DataFrame:
    """All methods in one table. ``logs`` maps names to paths, or alternates name, path, name, path."""
    if not isinstance(logs, Mapping):
        if len(logs) % 2:
            raise ValueError("logs must alternate between a method name and a path")
        logs = dict(zip(logs[0::2], logs[1::2]))
    if anchor is not None and anchor not in logs:
        raise ValueError(f"the anchor {anchor} is not among the logs")
    return unify_logs([read_result_log(spark, m, p, lines) for m, p in logs.items()])


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Per-point JSON files written by ``sinks.write_point`` (dataset, sequence and qp are folders).

    The driver lists the first level of folders; tasks list what is below them and read it, so files may come by the million.
    """
    folders = ["dataset", "sequence", "qp_i"]
    schema = ", ".join([POINT_DDL, "method STRING, rate_key STRING, dataset STRING, sequence STRING, qp_i INT"])
    root = full_path(path)
    base = open_store(root)[1].rstrip("/")
    visible = lambda info: info.base_name[0] not in "._"
    tops = spark.createDataFrame([(i.path,) for i in _listing(root, base) if visible(i)], "path string")
    tasks = spark.sparkContext.defaultParallelism * 4

    def below(batches):
        import pyarrow as pa
        for batch in batches:
            for top in batch.column("path").to_pylist():
                found = [i.path for i in _listing(root, top) if visible(i)]
                for k in range(0, len(found), 10_000):
                    yield pa.record_batch([pa.array(found[k:k + 10_000], pa.string())], names=["path"])

    def lines(batches):
        import pyarrow as pa
        from pyarrow import fs
        store, _ = open_store(root)

        def packed(rows):
            return pa.RecordBatch.from_pylist(rows, pa.schema([*((n, pa.string()) for n in folders), ("value", pa.string())]))
        rows = []
        for batch in batches:
            for top in batch.column("path").to_pylist():
                for info in _listing(root, top, recursive=True):
                    inner = info.path[len(base) + 1:]
                    if info.type != fs.FileType.File or any(p[0] in "._" for p in inner.split("/")):
                        continue
                    values = folder_values(inner)
                    with store.open_input_stream(info.path) as f:
                        for line in io.TextIOWrapper(io.BufferedReader(f), "utf-8"):
                            if line.strip():
                                rows.append({**{n: values.get(n) for n in folders}, "value": line})
                            if len(rows) == 1000:
                                yield packed(rows)
                                rows = []
        yield packed(rows)
    spread = tops.repartition(tasks, "path").mapInArrow(below, "path string").repartition(tasks, "path")
    text = spread.mapInArrow(lines, ", ".join(f"{n} string" for n in [*folders, "value"]))
    parsed = text.withColumn("p", F.from_json("value", schema))
    body = [f for f in parsed.schema["p"].dataType.names if f not in folders]
    return parsed.select(*[F.col(f"p.{f}") for f in body], *[F.coalesce(F.col(n).cast(parsed.schema["p"].dataType[n].dataType), F.col(f"p.{n}")).alias(n) for n in folders])


def _listing(root: str, path: str, recursive: bool = False):
    """What stands in a folder of the store of ``root``; a file is itself."""
    from pyarrow import fs
    store, _ = open_store(root)
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=recursive))


def parse_rd_tables(texts: DataFrame, metric: str = "psnr", text: str = "value") -> DataFrame:
    """RD tables held as text: rows (method, dataset, {"bpp": [...], "PSNR": [...]}) become rows in curve form. Lists of different length are an error."""
    lists = F.from_json(text, "MAP<STRING, ARRAY<DOUBLE>>", {"mode": "FAILFAST"})
    named = texts.select("method", "dataset", F.transform_keys(lists, lambda k, _: F.lower(k)).alias("__t"))
    bpp, value = F.col("__t")["bpp"], F.col("__t")[metric]
    wrong = F.raise_error(F.concat(F.lit("the lists differ in length or are missing: "), F.col("method")))
    points = named.select("method", "dataset", F.posexplode(F.when(F.size(bpp) == F.size(value), F.arrays_zip(bpp.alias("bpp"), value.alias("value"))).otherwise(wrong)).alias("rate_idx", "p"))
    return points.select("method", "dataset", F.format_string("%03d", "rate_idx").alias("rate_key"), F.lit("all").alias("frame_group"), F.lit(metric).alias("metric"),
                         F.col("p")["bpp"].alias("bpp"), F.col("p")["value"].alias("value"))


def read_rd_table(spark: SparkSession, tables: Mapping[str, Mapping[str, Sequence[float]]], dataset: str,
                  metric: str = "psnr") -> DataFrame:
    """Literal RD tables: method -> parallel lists ``bpp`` and ``PSNR``. Rows in curve form.

    The lists travel as one array row per method and unfold on the executors.
    """
    rows = []
    for method, t in tables.items():
        value = next(v for k, v in t.items() if k.lower() == metric)
        if len(t["bpp"]) != len(value):
            raise ValueError(f"the lists of {method} differ in length")
        rows.append((method, [float(x) for x in t["bpp"]], [float(x) for x in value]))
    src = spark.createDataFrame(rows, "method string, bpp array<double>, value array<double>")
    points = src.select("method", F.posexplode(F.arrays_zip("bpp", "value")).alias("rate_idx", "p"))
    return points.select("method", F.lit(dataset).alias("dataset"), F.format_string("%03d", "rate_idx").alias("rate_key"),
                         F.lit("all").alias("frame_group"), F.lit(metric).alias("metric"), "p.bpp", "p.value")
