"""Media-shaped views of the given tables.

The given tables hold orders, suppliers, texts and vectors. These projections read them as frame logs,
sequences, clips, planes and coded streams, without moving a row. Each view is a list of SQL
expressions that mean the same in Spark and in the checking engine. Values that get averaged are
multiples of powers of two, so sums are exact in any order.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from rdspark.functions import pixels
from rdspark.operators import planes
from rdspark.operators.ordered import ordered_scan

PLANE_BYTES = 1 << 20      # of the enlarged planes of a batch

LOG_FRAMES = {
    "method": "l_returnflag",
    "dataset": "'class_' || CAST(l_suppkey % 6 AS STRING)",
    "sequence": "'seq_' || CAST(l_suppkey AS STRING)",
    "rate_idx": "l_linenumber - 1",
    "frame_idx": "l_orderkey",
    "frame_type": "CASE WHEN l_orderkey % 8 = 0 THEN 0 ELSE 1 END",
    "pixel_num": "CAST(99840 AS BIGINT)",
    "bits": "CAST(floor(l_extendedprice * (1 + l_linenumber)) AS BIGINT)",
    "bits_mv_y": "CASE WHEN l_orderkey % 8 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 4 END",
    "bits_mv_z": "CASE WHEN l_orderkey % 8 = 0 THEN 0 ELSE l_partkey % 64 END",
    "bits_y": "CASE WHEN l_orderkey % 8 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 100 END",
    "bits_z": "CASE WHEN l_orderkey % 8 = 0 THEN 0 ELSE l_suppkey % 32 + 1 END",
    "psnr": "26e0 + 2e0 * l_linenumber + (l_partkey % 128) / 128e0",
    "psnr_y": "26e0 + 2e0 * l_linenumber + (l_partkey % 64) / 64e0",
    "psnr_u": "28e0 + 2e0 * l_linenumber + (l_partkey % 32) / 32e0",
    "psnr_v": "29e0 + 2e0 * l_linenumber + (l_partkey % 16) / 16e0",
    "msssim": "75e-2 + l_linenumber / 64e0 + (l_partkey % 32) / 2048e0",
    "msssim_y": "75e-2 + l_linenumber / 64e0 + (l_partkey % 16) / 1024e0",
    "msssim_u": "75e-2 + l_linenumber / 64e0 + (l_partkey % 8) / 1024e0",
    "msssim_v": "75e-2 + l_linenumber / 64e0 + (l_partkey % 64) / 4096e0",
    "mse": "(l_partkey % 1024) / 1024e0",
    "enc_s": "l_quantity / 1024e0",
    "dec_s": "l_quantity / 2048e0 + l_linenumber / 4096e0",
    "event_ts": "l_shipdate",
}

SEQUENCES = {
    "dataset": "'class_' || CAST(s_suppkey % 6 AS STRING)",
    "sequence": "'seq_' || CAST(s_suppkey AS STRING)",
    "seq_no": "s_suppkey",
    "src_type": "CASE WHEN s_suppkey % 3 = 0 THEN 'png' ELSE 'yuv420' END",
    "base_path": "'class_' || CAST(s_suppkey % 6 AS STRING)",
    "width": "CAST(400 + (s_suppkey * 7) % 97 AS INT)",
    "height": "CAST(230 + (s_suppkey * 5) % 61 AS INT)",
    "frame_num": "CAST(1 + (s_suppkey * 37) % 200 AS INT)",
    "intra_period": "CAST(CASE s_suppkey % 4 WHEN 0 THEN -1 WHEN 1 THEN 1 WHEN 2 THEN 32 ELSE 8 END AS INT)",
    "enabled": "s_suppkey % 6 <> 5",
}

CLIP_SOURCES = {
    "seq_id": "p_partkey",
    "path": "'part_' || CAST(p_partkey AS STRING)",
    "width": "CAST(200 + (p_partkey * 13) % 400 AS INT)",
    "height": "CAST(180 + (p_partkey * 11) % 300 AS INT)",
    "seq_length": "p_size",
}

UNITS = {
    "stream": "user_id",
    "unit_no": "event_id",
    "nal_type": "CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END",
    "sps_id": "CAST(event_id % 4 AS INT)",
    "height": "CASE WHEN event_type = 'error' THEN CAST(64 + 16 * (event_id % 7) AS INT) END",
    "width": "CASE WHEN event_type = 'error' THEN CAST(64 + 16 * (event_id % 11) AS INT) END",
    "unit_bytes": "CAST(floor(value * 100) AS BIGINT) + 4",
}

LIVE_FRAMES = {
    "sequence": "'user_' || CAST(user_id AS STRING)",
    "event_ts": "ts",
    "bits": "CAST(floor(value * 100) AS BIGINT)",
    "pixel_num": "CAST(4096 AS BIGINT)",
    "psnr": "30e0 + (event_id % 64) / 64e0",
}

VIEWS = {"frames": ("lineitem", LOG_FRAMES), "sequences": ("supplier", SEQUENCES), "clip_sources": ("part", CLIP_SOURCES),
         "units": ("events", UNITS), "live": ("events", LIVE_FRAMES)}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    source, exprs = VIEWS[name]
    return table(spark, folder, source).selectExpr(*[f"{e} AS {c}" for c, e in exprs.items()])


def view_sql(name: str) -> str:
    """The view as a common table expression for the checking SQL."""
    source, exprs = VIEWS[name]
    return f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in exprs.items())} FROM {source})"


# --------------------------------------------------------------------------- planes from vectors


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector as the 8x8 block of 8-bit samples of one frame; the label is the sequence."""
    e = table(spark, folder, "embeddings")
    block = F.transform("embedding", lambda v: F.least(F.lit(255.0), F.greatest(
        F.lit(0.0), F.floor(v.cast("double") * 256.0 + 128.0).cast("double"))).cast("int"))
    return e.select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("sequence"),
                    F.col("vec_id").alias("frame_idx"), block.alias("s"))


def small_frames(spark: SparkSession, folder: str) -> DataFrame:
    """8x8 frames with 4:2:0 chroma: luma is the block, chroma are its first and last 16 samples."""
    s = samples(spark, folder)
    pack = planes.plane_from_samples
    return s.select("sequence", "frame_idx", F.lit("420").alias("layout"), F.lit(8).alias("width"), F.lit(8).alias("height"),
                    F.lit(8).alias("bit_depth"), pack(F.col("s")).alias("p0"), pack(F.slice("s", 1, 16)).alias("p1"),
                    pack(F.slice("s", 49, 16)).alias("p2"))


def rgb_frames(spark: SparkSession, folder: str) -> DataFrame:
    """8x8 RGB frames from all samples: the block, the block reversed, and the block turned."""
    s = samples(spark, folder)
    pack = planes.plane_from_samples
    turned = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.get(F.col("s"), turned_place(k)))
    return s.select("sequence", "frame_idx", F.lit("rgb").alias("layout"), F.lit(8).alias("width"), F.lit(8).alias("height"),
                    F.lit(8).alias("bit_depth"), pack(F.col("s")).alias("p0"), pack(F.reverse("s")).alias("p1"), pack(turned).alias("p2"))


def turned_place(k):
    """Where sample k of a turned 8x8 block stands in the block."""
    return ((k % 8) * 8 + 7 - F.floor(k / 8)).cast("int")


# Samples in the checking SQL: one row per vector and position, numbered from 0.
SAMPLES_SQL = (
    "samples AS (SELECT 'label_' || CAST(label AS STRING) AS sequence, vec_id AS frame_idx, i - 1 AS i, "
    "CAST(least(255e0, greatest(0e0, floor(CAST(embedding[i] AS DOUBLE) * 256e0 + 128e0))) AS INT) AS s "
    "FROM embeddings, range(1, 65) t(i))")
# The three channels of the RGB frames, a row for each sample.
CHANNELS_SQL = (f"{SAMPLES_SQL}, blocks AS (SELECT sequence, frame_idx, list(s ORDER BY i) AS s FROM samples GROUP BY ALL), "
                "channels AS (SELECT sequence, frame_idx, k.k AS k, s[k.k + 1] AS r, s[64 - k.k] AS g, s[(k.k % 8) * 8 + 8 - k.k // 8] AS b FROM blocks, range(64) k(k))")


# --------------------------------------------------------------------------- coded streams from texts


def _bytes(n, width: int):
    return F.lpad(F.hex(n), 2 * width, "0")


def length_hex(n, dialect: str = "current"):
    """Hex text of a length field: the inverse of the packet reader's rule."""
    if dialect == "sps_qp":
        return F.when(n <= 32767, _bytes(n, 2)).otherwise(_bytes(n + F.lit(1 << 31), 4))
    return (F.when(n < 128, _bytes(n, 1)).when(n < 16384, _bytes(n + F.lit(0x8000), 2))
            .otherwise(_bytes(n + F.lit(0xC0000000), 4)))


def streams(spark: SparkSession, folder: str, dialect: str = "current") -> DataFrame:
    """Each document as a coded stream: a parameter set, then one unit per text line.

    The first line is an intra unit, the others are predicted. The payload is the UTF-8 text.
    """
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("stream"), F.split("text", "\n").alias("lines"))
    doc = F.col("stream")
    size = F.concat(length_hex(64 + doc % 200, dialect), length_hex(64 + doc % 300, dialect))
    head = F.concat(_bytes(doc % 16, 1), size)
    if dialect == "sps_qp":
        head = F.concat(head, _bytes(F.shiftleft(doc % 64, 2) + doc % 4, 1))
    elif dialect == "sps_flags":
        head = F.concat(head, _bytes(F.shiftleft(doc % 2, 2) + F.floor(doc / 2) % 2, 1))

    def unit(line, i):
        body = F.hex(F.encode(line, "UTF-8"))
        kind = F.when(i == 0, 1).otherwise(2)
        parts = [_bytes(kind * 16 + doc % 16, 1)]
        if dialect != "sps_qp":
            parts.append(_bytes((doc + i) % 64, 1))
        if dialect == "current":
            parts.append(_bytes((i % 3) * 2 + F.when(i % 4 == 3, 1).otherwise(0), 1))
        return F.concat(*parts, length_hex(F.length(body) / 2, dialect), body)

    body = F.array_join(F.transform("lines", unit), "")
    return d.select("stream", F.unhex(F.concat(head, body)).alias("content"))


# --------------------------------------------------------------------------- files from rows


def write_files(df: DataFrame, root: str, name: str = "name", content: str = "content") -> str:
    """One file per row below ``root``, written by the tasks. Rerun tasks overwrite their own files."""
    def run(rows):
        from rdspark.sources.storage import open_store
        store, base = open_store(root)
        for row in rows:
            path = f"{base}/{row[name]}"
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(path) as out:
                out.write(bytes(row[content]))

    df.select(name, content).foreachPartition(run)
    return root


def numbered(frames: DataFrame) -> DataFrame:
    """Frames with their position in the sequence as ``frame_idx``."""
    return ordered_scan(frames, ["sequence"], ["frame_idx"], number="__pos").withColumn("frame_idx", F.col("__pos")).drop("__pos")


def png_files(frames: DataFrame) -> DataFrame:
    """RGB frames as PNG bytes (stored without prediction), named by sequence and number."""
    @pandas_udf("binary")
    def encode(p0: pd.Series, p1: pd.Series, p2: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        def chunk(kind: bytes, body: bytes) -> bytes:
            return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        out = []
        for r, g, b, w, h in zip(p0, p1, p2, width, height):
            rgb = np.stack([np.frombuffer(x, np.uint8).reshape(h, w) for x in (r, g, b)], axis=2)
            lines = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, w * 3)], axis=1)
            out.append(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                       + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b""))
        return pd.Series(out)

    name = F.concat("sequence", F.format_string("/im%05d.png", F.col("frame_idx") + 1))
    return frames.select(name.alias("name"), encode("p0", "p1", "p2", "width", "height").alias("content"))


def large_planes(frames: DataFrame, doublings: int) -> DataFrame:
    """Luma of the 8x8 frames as a plane of 8 * 2**doublings samples per side, linearly enlarged."""
    side = 8 * 2 ** doublings
    step = max(1, PLANE_BYTES // side ** 2)

    def grow(batches):
        # A batch of thousands of small blocks makes a thousand times the bytes: planes leave the worker some at a time.
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out = []
                for data in part.column("p0").to_pylist():
                    plane = np.frombuffer(data, np.uint8).reshape(8, 8)
                    for _ in range(doublings):
                        plane = pixels.double(plane, 1)
                    out.append(np.rint(plane).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("sequence"), part.column("frame_idx"), pa.array(out, pa.binary())], names=["sequence", "frame_idx", "data"])

    # Small rows make heavy ones here: spread the small ones over the cores first.
    cores = frames.sparkSession.sparkContext.defaultParallelism
    spread = frames.repartition(2 * cores, "sequence", "frame_idx").select("sequence", "frame_idx", "p0")
    schema = T.StructType([spread.schema["sequence"], spread.schema["frame_idx"], T.StructField("data", T.BinaryType())])
    return spread.mapInArrow(grow, schema).select("sequence", "frame_idx", F.lit("y").alias("plane"), F.lit(side).alias("width"), F.lit(side).alias("height"),
                                                  F.lit(8).alias("bit_depth"), "data")
