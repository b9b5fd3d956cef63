"""Result sinks: nested logs, per-point files, averaged curves, report tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import DataFrame, functions as F

from rdspark.functions.results import fixed_digits, round_exact
from rdspark.operators import comparison
from rdspark.operators.numbering import spread_join
from rdspark.sources.storage import folder_name, full_path, open_store

LOG_DIGITS = 6
_KEYS = ("method", "dataset", "sequence", "rate_key")


def _bodies(points: DataFrame, digits: int) -> DataFrame:
    """Keys of each point and its numbers as JSON text: doubles at a fixed number of decimals, no NULLs.

    The doubles are rounded in one array, so the plan carries the rounding rule once and not per column.
    """
    fields = [f for f in points.schema.fields if f.name not in _KEYS]
    kinds = {f.name: f.dataType.simpleString() for f in fields}
    doubles = [n for n, k in kinds.items() if k == "double"]
    rule = lambda v: round_exact(v, digits)
    staged = points.withColumn("__d", F.transform(F.array(*doubles), rule)) if doubles else points
    body = []
    for name, kind in kinds.items():
        c = F.col(name)
        if kind == "double":
            c = F.col("__d")[doubles.index(name)]
        elif kind == "array<double>":
            c = F.transform(c, rule)
        body.append(c.alias(name))
    return staged.select(*[k for k in _KEYS if k in points.columns], F.to_json(F.struct(*body)).alias("j"))


def _quoted(column: str):
    """A text column as a JSON string."""
    doc = F.to_json(F.struct(F.col(column).alias("k")))
    return doc.substr(F.lit(6), F.length(doc) - 6)


def log_fragments(points: DataFrame, digits: int = LOG_DIGITS) -> DataFrame:
    """Each point as a nested document dataset -> sequence -> rate key. A projection, no grouping.

    Any union of such fragments is the nested log, which is what the reader makes of it.
    """
    text = F.concat(F.lit("{"), _quoted("dataset"), F.lit(":{"), _quoted("sequence"), F.lit(":{"), _quoted("rate_key"),
                    F.lit(":"), "j", F.lit("}}}"))
    return _bodies(points, digits).select(text.alias("value"))


def write_result_log(points: DataFrame, path: str, digits: int = LOG_DIGITS) -> None:
    """The log of one method as text lines, one fragment per point."""
    log_fragments(points, digits).write.mode("error").text(path)


_LISTS = ("frame_bpp", "frame_psnr", "frame_msssim", *[f"frame_{m}_{p}" for m in ("psnr", "msssim") for p in "yuv"], "frame_type")


def list_lines(chunks: DataFrame, keys: Sequence[str], digits: int = LOG_DIGITS) -> DataFrame:
    """Per-frame lists of points as pieces of JSON text: one row for each list and chunk (keys, part, chunk_no, value).

    In (part, chunk_no) order the pieces of a point are its lists, each with a comma before it. A list of any length is written chunk by chunk.
    """
    ends = chunks.groupBy(*keys).agg(F.min("chunk_no").alias("__a"), F.max("chunk_no").alias("__b"))
    rows = spread_join(chunks, ends, keys, "chunk_no", how="inner")
    first, last = F.col("chunk_no") == F.col("__a"), F.col("chunk_no") == F.col("__b")
    pieces = []
    for k, name in enumerate(n for n in _LISTS if n in chunks.columns):
        values = F.col(name) if name == "frame_type" else F.transform(F.col(name), lambda v: round_exact(v, digits))
        text = F.to_json(F.struct(F.coalesce(values, F.array()).alias("k")))      # {"k":[...]}
        inner = text.substr(F.lit(7), F.length(text) - 8)
        pieces.append(F.struct(F.lit(k + 1).alias("part"), F.concat(F.when(first, f',"{name}":[').otherwise(F.lit(",")), inner, F.when(last, "]").otherwise("")).alias("value")))
    return rows.select(*keys, F.col("chunk_no").cast("long").alias("chunk_no"), F.inline(F.array(*pieces)))


def document_lines(points: DataFrame, digits: int = LOG_DIGITS, lists: DataFrame | None = None) -> DataFrame:
    """Lines that, read in (dataset, sequence, rate_key, part, chunk_no) order, are one JSON document in the nested form.

    ``lists`` has the per-frame lists of the points in chunks (``summary.frame_arrays`` with the key ``rate_key``); they become lines of their own
    inside their point, so no cell holds a whole list. Where a dataset or a sequence opens and closes is found from the smallest and largest key of each
    level, so the document is assembled without gathering it anywhere.
    """
    keys = ["dataset", "sequence", "rate_key"]
    body = _bodies(points, digits)
    seqs = body.groupBy("dataset", "sequence").agg(F.min("rate_key").alias("r0"), F.max("rate_key").alias("r1"))
    sets = seqs.groupBy("dataset").agg(F.min("sequence").alias("s0"), F.max("sequence").alias("s1"))
    ends = sets.agg(F.min("dataset").alias("d0"), F.max("dataset").alias("d1"))
    levels = (spread_join(seqs, sets, ["dataset"], F.xxhash64("sequence"), how="inner")
              .withColumn("d0", ends.select("d0").scalar()).withColumn("d1", ends.select("d1").scalar()))
    rows = spread_join(body, levels, ["dataset", "sequence"], F.xxhash64("rate_key"), how="inner")
    r_first, r_last = F.col("rate_key") == F.col("r0"), F.col("rate_key") == F.col("r1")
    s_first, s_last = r_first & (F.col("sequence") == F.col("s0")), r_last & (F.col("sequence") == F.col("s1"))
    first, last = s_first & (F.col("dataset") == F.col("d0")), s_last & (F.col("dataset") == F.col("d1"))
    opening = F.concat(F.when(first, "{\n").otherwise(""),
                       F.when(s_first, F.concat(F.lit("  "), _quoted("dataset"), F.lit(": {\n"))).otherwise(""),
                       F.when(r_first, F.concat(F.lit("    "), _quoted("sequence"), F.lit(": {\n"))).otherwise(""))
    closing = (F.when(last, "\n    }\n  }\n}").when(s_last, "\n    }\n  },").when(r_last, "\n    },").otherwise(","))
    text = F.concat(opening, F.lit("      "), _quoted("rate_key"), F.lit(": "), "j", closing)
    if lists is None:
        return rows.select(*keys, F.lit(0).alias("part"), F.lit(0).cast("long").alias("chunk_no"), text.alias("value"))
    head = F.concat(opening, F.lit("      "), _quoted("rate_key"), F.lit(": "), F.col("j").substr(F.lit(1), F.length("j") - 1))
    pieces = F.array(F.struct(F.lit(0).alias("part"), head.alias("value")), F.struct(F.lit(len(_LISTS) + 1).alias("part"), F.concat(F.lit("}"), closing).alias("value")))
    outer = rows.select(*keys, F.lit(0).cast("long").alias("chunk_no"), F.inline(pieces))
    return outer.unionByName(list_lines(lists, keys, digits))


def write_result_document(points: DataFrame, path: str, digits: int = LOG_DIGITS, lists: DataFrame | None = None, compact: bool = False) -> None:
    """Text parts that, put end to end in name order, are one nested JSON document, on one line if ``compact``.

    ``result_logs.read_split_log`` reads the folder, or the joined file, with many tasks; so does ``indented_logs`` where no lists are in it.
    """
    order = ["dataset", "sequence", "rate_key", "part", "chunk_no"]
    lines = document_lines(points, digits, lists)
    value = F.regexp_replace("value", r"\n *", "") if compact else F.col("value")
    sorted_ = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_.select(value.alias("value")).write.mode("error").option("lineSep", " " if compact else "\n").text(path)


def write_point(points: DataFrame, path: str) -> None:
    """Per-point JSON, in folders by dataset, sequence and quality index.

    The points of a folder come together first, so a folder gets one file and not one per task. Tasks write the files, of which there may
    be a million: no folder passes through the driver. A file has the name of this call, so a repeated task overwrites its own
    and earlier files of a folder stay.
    """
    folders, root, name = ["dataset", "sequence", "qp_i"], full_path(path), f"part-{uuid.uuid4().hex}.json"
    body = F.to_json(F.struct(*[F.col(c) for c in points.columns if c not in folders]))
    rows = points.select(*folders, body.alias("value")).repartition(*folders).sortWithinPartitions(*folders)

    def run(part):
        store, base = open_store(root)
        for values, group in groupby(part, key=lambda r: tuple(r)[:3]):
            folder = f"{base}/{folder_name(dict(zip(folders, values)))}"
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{folder}/{name}") as out:
                for row in group:
                    out.write(f"{row['value']}\n".encode())
    rows.foreachPartition(run)


def write_points_table(points: DataFrame, path: str) -> None:
    """The production form: a Parquet table partitioned by method and dataset."""
    points.write.mode("append").partitionBy("method", "dataset").parquet(path)


def average_curves(images: DataFrame) -> DataFrame:
    """Per class the mean bpp and PSNR as lists in rate order (a class has one entry per rate)."""
    m = comparison.image_rate_means(images)
    packed = m.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("rate", "bpp", "psnr"))).alias("c"))
    return packed.select("dataset", F.col("c.bpp").alias("bpp"), F.col("c.psnr").alias("psnr"))


def average_path(path: str) -> str:
    """Sibling of a log with ``_avg`` before its ending."""
    folder, _, name = path.rpartition("/")
    stem, dot, ending = name.rpartition(".")
    named = f"{stem}_avg.{ending}" if dot else f"{name}_avg"
    return f"{folder}/{named}" if folder else named


def write_average_curves(images: DataFrame, log_path: str, digits: int = LOG_DIGITS) -> str:
    """Averaged curves next to the log they came from; gives the path back."""
    out = average_path(log_path)
    doc = average_curves(images).select(F.to_json(F.create_map("dataset", F.struct(
        F.transform("bpp", lambda v: round_exact(v, digits)).alias("bpp"),
        F.transform("psnr", lambda v: round_exact(v, digits)).alias("psnr")))).alias("value"))
    doc.write.mode("error").text(out)
    return out


def report_table(bd: DataFrame, names: Sequence[str], rows: Sequence[str] = ("dataset",), across: str = "method",
                 digits: int = 1) -> DataFrame:
    """``comparison.rotate`` as text with fixed digits; missing values are empty."""
    wide = comparison.rotate(bd, names, rows, across)
    cells = [F.coalesce(fixed_digits(n, digits), F.lit("")).alias(n) for n in names]
    return wide.select("metric", "frame_group", *rows, *cells)


def write_report(bd: DataFrame, path: str, names: Sequence[str], rows: Sequence[str] = ("dataset",),
                 across: str = "method", digits: int = 1) -> None:
    """The report as CSV with a header, in report order."""
    table = report_table(bd, names, rows, across, digits)
    order = [*rows[:-1], *comparison.report_order(table, rows[-1])]
    table.orderBy("metric", "frame_group", *order).write.mode("error").csv(path, header=True)
