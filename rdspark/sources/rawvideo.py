"""Raw planar video as a Spark data source, for reading and writing.

``register(spark)`` then ``spark.read.format("rawvideo")`` (or ``"yuv420"``) with options

``path``            file, folder or ``name`` without the ``.yuv`` ending
``width, height``   picture size
``layout``          "420" (default), "444" or "rgb"
``bit_depth``       8 (default) to 16; above 8 samples are 16-bit little-endian
``skip_frame``      frames to leave out at the start of each sequence
``max_frames``      frames to keep after that (default all)

A read is cut into frame ranges of about 64 MB, so one long sequence is read by many tasks, and ranges of small files share
a task. Sequences of different sizes are read together by ``source_frames``. On the way
out a sequence becomes a folder of segments of ``segment_frames`` frames; put end to end in name order
they are the raw file. The reader accepts plain files and such folders.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from rdspark.sources.storage import open_store

SCHEMA = ("sequence string, frame_idx bigint, layout string, width int, height int, bit_depth int, "
          "p0 binary, p1 binary, p2 binary")
SPLIT_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
OPEN_BYTES = 1 << 18     # what opening a file costs, as bytes read
SEGMENT_FRAMES = 256
_SEGMENT = re.compile(r"seg-(\d+)\.yuv$")


def plane_sizes(width: int, height: int, layout: str, bit_depth: int) -> list[int]:
    """Bytes of the three planes of a frame."""
    if layout not in ("420", "444", "rgb"):
        raise ValueError(f"unknown layout {layout}")
    if not 8 <= bit_depth <= 16:
        raise ValueError("samples have 8 to 16 bits")
    step = 1 if bit_depth == 8 else 2
    chroma = (width // 2) * (height // 2) if layout == "420" else width * height
    return [width * height * step, chroma * step, chroma * step]


def whole_frames(size: int, sizes: list[int]) -> int:
    """Frames of a file. A tail without chroma ends the stream, a tail with partial chroma is an error."""
    frame = sum(sizes)
    tail = size % frame
    if tail > sizes[0]:
        raise ValueError(f"the file ends inside the chroma of its last frame ({tail} of {frame} bytes)")
    return size // frame


def video_files(path: str):
    """(path, sequence, first frame number of the file, bytes) of a file, a name without ending or a folder. Only the listing is read."""
    from pyarrow import fs
    store, inner = open_store(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        info = store.get_file_info(inner + ".yuv")
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner, recursive=True))
    prefix = path[:len(path) - len(inner)] if path.endswith(inner) else ""
    for f in files:
        if f.type != fs.FileType.File or not f.path.endswith(".yuv"):
            continue
        segment = _SEGMENT.search(f.path)
        parts = f.path.split("/")
        name = parts[-2] if segment else parts[-1][:-len(".yuv")]
        yield prefix + f.path, name, int(segment.group(1)) if segment else 0, f.size


def frame_batches(path: str, sequence: str, at: int, first_idx: int, count: int, width: int, height: int, layout: str, depth: int, batch_bytes: int) -> Iterator:
    """Frames of a file from frame ``at`` on, in batches of about ``batch_bytes``."""
    import pyarrow as pa
    store, inner = open_store(path)
    sizes = plane_sizes(width, height, layout, depth)
    frame = sum(sizes)
    per = max(1, batch_bytes // frame)
    a, b = sizes[0], sizes[0] + sizes[1]
    with store.open_input_file(inner) as handle:
        handle.seek(at * frame)
        for k in range(0, count, per):
            n = min(per, count - k)
            data = handle.read(n * frame)
            views = [data[j * frame:(j + 1) * frame] for j in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([sequence] * n), pa.array([first_idx + k + j for j in range(n)], pa.int64()), pa.array([layout] * n),
                 pa.array([width] * n, pa.int32()), pa.array([height] * n, pa.int32()), pa.array([depth] * n, pa.int32()),
                 pa.array([v[:a] for v in views], pa.binary()), pa.array([v[a:b] for v in views], pa.binary()), pa.array([v[b:] for v in views], pa.binary())],
                names=["sequence", "frame_idx", "layout", "width", "height", "bit_depth", "p0", "p1", "p2"])


@dataclass
class FrameRanges(InputPartition):
    """(path, sequence, first frame in the file, first frame number, frames) of the ranges that one task reads."""
    ranges: list

    def __post_init__(self):
        super().__init__(None)


class RawVideo(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawvideo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema)


class Yuv420(RawVideo):
    """The same under the name of its default layout."""

    @classmethod
    def name(cls) -> str:
        return "yuv420"


def register(spark: SparkSession) -> None:
    """Make the formats ``rawvideo`` and ``yuv420`` known to a session."""
    for source in (RawVideo, Yuv420):
        spark.dataSource.register(source)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.width, self.height = int(options["width"]), int(options["height"])
        self.layout = options.get("layout", "420")
        self.depth = int(options.get("bit_depth", 8))
        self.skip = int(options.get("skip_frame", 0))
        self.limit = int(options.get("max_frames", -1))
        self.sizes = plane_sizes(self.width, self.height, self.layout, self.depth)

    def partitions(self):
        frame = sum(self.sizes)
        per = max(1, SPLIT_BYTES // frame)
        end = None if self.limit < 0 else self.skip + self.limit
        splits, room = [FrameRanges([])], SPLIT_BYTES
        for path, sequence, first, size in video_files(self.path):
            count = whole_frames(size, self.sizes)
            low = max(0, self.skip - first)
            high = count if end is None else min(count, end - first)
            for at in range(low, high, per):
                n = min(per, high - at)
                cost = n * frame + OPEN_BYTES
                if cost > room and splits[-1].ranges:
                    splits.append(FrameRanges([]))
                    room = SPLIT_BYTES
                # Numbers start at 0 after the skipped frames, like a reader that opened the file there.
                splits[-1].ranges.append((path, sequence, at, first + at - self.skip, n))
                room -= cost
        return splits

    def read(self, part: FrameRanges) -> Iterator:
        for path, sequence, at, first_idx, count in part.ranges:
            yield from frame_batches(path, sequence, at, first_idx, count, self.width, self.height, self.layout, self.depth, BATCH_BYTES)


@dataclass
class Written(WriterCommitMessage):
    files: list


class _Writer(DataSourceWriter):
    """Writes the segments of one partition under temporary names; the commit gives them their names."""

    def __init__(self, options, schema):
        self.path = options["path"].rstrip("/")
        self.segment = int(options.get("segment_frames", SEGMENT_FRAMES))
        self.columns = [f.name for f in schema.fields]

    def write(self, rows) -> Written:
        store, root = open_store(self.path)
        at = {c: i for i, c in enumerate(self.columns)}
        done, handle, current, expected = [], None, None, 0
        try:
            for row in rows:
                sequence, idx = row[at["sequence"]], row[at["frame_idx"]]
                key = (sequence, idx // self.segment)
                if key != current:
                    if handle is not None:
                        handle.close()
                    folder = f"{root}/{sequence}"
                    store.create_dir(folder, recursive=True)
                    temp = f"{folder}/.tmp-{uuid.uuid4().hex}"
                    final = f"{folder}/seg-{idx:012d}.yuv"
                    handle, current, expected = store.open_output_stream(temp), key, idx
                    done.append((temp, final))
                if idx != expected:
                    raise ValueError(f"sequence {sequence} has a gap or a repeat at frame {expected}")
                sizes = plane_sizes(row[at["width"]], row[at["height"]], row[at["layout"]], row[at["bit_depth"]])
                for plane, size in zip(("p0", "p1", "p2"), sizes):
                    if len(row[at[plane]]) != size:
                        raise ValueError(f"plane {plane} of {sequence} frame {idx} has the wrong size")
                    handle.write(row[at[plane]])
                expected += 1
        finally:
            if handle is not None:
                handle.close()
        return Written(done)

    def commit(self, messages) -> None:
        store, _ = open_store(self.path)
        for message in messages:
            for temp, final in (message.files if message else []):
                store.move(temp, final)

    def abort(self, messages) -> None:
        store, _ = open_store(self.path)
        for message in messages:
            for temp, _final in (message.files if message else []):
                try:
                    store.delete_file(temp)
                except FileNotFoundError:
                    pass


def read_raw_video(spark: SparkSession, path: str, width: int, height: int, layout: str = "420", bit_depth: int = 8,
                   skip_frame: int = 0, max_frames: int = -1) -> DataFrame:
    register(spark)
    return (spark.read.format("rawvideo").option("width", width).option("height", height).option("layout", layout)
            .option("bit_depth", bit_depth).option("skip_frame", skip_frame).option("max_frames", max_frames).load(path))


def write_raw_video(frames: DataFrame, path: str, segment_frames: int = SEGMENT_FRAMES) -> None:
    """Write frames as raw video, at most ``segment_frames`` frames per file.

    Work is spread by (sequence, segment), so a long sequence is written by many tasks.
    """
    spark = frames.sparkSession
    register(spark)
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    segment = F.floor(F.col("frame_idx") / segment_frames)
    placed = (frames.select(*names).withColumn("__s", segment).repartition("sequence", "__s")
              .sortWithinPartitions("sequence", "frame_idx").drop("__s"))
    placed.write.format("rawvideo").option("segment_frames", segment_frames).mode("append").save(path)
