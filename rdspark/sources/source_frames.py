"""Raw sources of a configuration as frame rows: sequences of different sizes, layouts and depths in one read.

``sequences`` says where each sequence lies and how it is stored. Its files are looked up in parallel, cut into ranges of at most ``split_bytes``, and the ranges
are packed into splits in order: each costs its bytes and ``open_bytes`` for opening, and a split takes what begins below its share of the running sum. So many small
sequences make a few tasks, and a large one makes many. What is left out of ``sequences`` by a filter is never opened, and ``first_frame`` and
``frame_num`` keep bytes outside the wanted frames from being read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rdspark.operators.ordered import ordered_scan
from rdspark.sources.rawvideo import BATCH_BYTES, OPEN_BYTES, SCHEMA, SPLIT_BYTES, frame_batches, plane_sizes, video_files, whole_frames

WANTED = ["path", "sequence", "width", "height", "layout", "bit_depth", "first_frame", "frame_num"]


def source_paths(sequences: DataFrame) -> DataFrame:
    """Configuration rows (``configs.parse_test_config``) with the columns that ``read_source_frames`` wants: 8-bit 4:2:0 files, by their name."""
    def missing(name: str, value):
        return value if name not in sequences.columns else F.coalesce(F.col(name), value)
    return sequences.withColumns({
        "path": F.concat(F.regexp_replace("base_path", "/+$", ""), F.lit("/"), F.col("sequence")), "layout": missing("layout", F.lit("420")),
        "bit_depth": missing("bit_depth", F.lit(8)), "first_frame": missing("first_frame", F.lit(0).cast("long"))})


def frame_ranges(sequences: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(sequence, file, first_idx, at, count, bytes, ...) of every range to read. A sequence that ends before ``frame_num`` is an error."""
    rows = sequences.select(*WANTED).distinct()
    spark = sequences.sparkSession
    spread = rows.repartition(spark.sparkContext.defaultParallelism * 4, "path", "sequence")

    def run(batches):
        import pyarrow as pa
        names = ["sequence", "width", "height", "layout", "bit_depth", "file", "first_idx", "at", "count", "bytes"]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                sizes = plane_sizes(r["width"], r["height"], r["layout"], r["bit_depth"])
                frame, skip = sum(sizes), r["first_frame"] or 0
                end = None if r["frame_num"] is None or r["frame_num"] < 0 else skip + r["frame_num"]
                per, seen = max(1, split_bytes // frame), 0
                for path, _, first, size in sorted(video_files(r["path"]), key=lambda f: f[2]):
                    count = whole_frames(size, sizes)
                    low, high = max(0, skip - first), count if end is None else min(count, end - first)
                    seen = max(seen, first + count)
                    for at in range(low, high, per):
                        n = min(per, high - at)
                        out.append((r["sequence"], r["width"], r["height"], r["layout"], r["bit_depth"], path, first + at - skip, at, n, n * frame))
                if end is not None and seen < end:
                    raise ValueError(f"{r['path']} has {seen} frames, {end} are wanted")
            cols = list(zip(*out)) or [[] for _ in names]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 4]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
    return spread.mapInArrow(run, "sequence string, width int, height int, layout string, bit_depth int, file string, first_idx long, at long, count long, bytes long")


def splits(ranges: DataFrame, split_bytes: int = SPLIT_BYTES, open_bytes: int = OPEN_BYTES) -> DataFrame:
    """(split, ranges): ranges packed in order. A split holds at most split_bytes / open_bytes + 1 of them."""
    cost = F.col("bytes") + open_bytes
    placed = ordered_scan(ranges, [], ["file", "at", "sequence"], sums={"ahead": cost})
    split = F.call_function("div", "ahead", F.lit(split_bytes).cast("long")).alias("split")
    return placed.groupBy(split).agg(F.collect_list(F.struct(*ranges.columns)).alias("ranges"))


def read_source_frames(sequences: DataFrame, split_bytes: int = SPLIT_BYTES, open_bytes: int = OPEN_BYTES) -> DataFrame:
    """Frames of ``sequences`` (path, sequence, width, height, layout, bit_depth, first_frame, frame_num), one row a frame as in ``rawvideo``.

    A path is a file, a name without ``.yuv`` or a folder of segments. Sequences are told apart by name and size; frames are numbered from 0 at ``first_frame``.
    A null ``first_frame`` is 0, a null or negative ``frame_num`` means all.
    """
    packed = splits(frame_ranges(sequences, split_bytes), split_bytes, open_bytes)
    number = packed.agg(F.coalesce(F.max("split") + 1, F.lit(1))).first()[0]
    dealt = packed.repartitionByRange(int(number), "split")

    def run(batches):
        for batch in batches:
            for row in batch.column("ranges").to_pylist():
                for r in row:
                    yield from frame_batches(r["file"], r["sequence"], r["at"], r["first_idx"], r["count"], r["width"], r["height"], r["layout"], r["bit_depth"], BATCH_BYTES)
    return dealt.mapInArrow(run, SCHEMA)
