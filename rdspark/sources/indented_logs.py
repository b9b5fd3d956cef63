"""Large nested result logs in one indented JSON file, read by many tasks.

An indented log shows its nesting by the indent of each line: datasets one step in, sequences two, rate keys three. The step is
read from the first lines; a log without line breaks is an error here, as is a file without entries. So a file can be cut anywhere. Each task reads the lines that begin in
its byte range and finishes the rate entry it has begun. Which dataset and sequence an entry belongs to
may have been said long before the range; that is an as-of lookup over byte positions afterwards.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rdspark.operators.ordered import ordered_scan
from rdspark.sources.result_logs import POINT_DDL
from rdspark.sources.storage import open_store

SCHEMA = "file string, pos bigint, level int, key string, body string"
SPLIT_BYTES = 64 << 20
LINE_BYTES = 256 << 20     # a longer line is not part of an indented log
_ENTRY = re.compile(rb'( *)("(?:[^"\\]|\\.)*"): *(\{.*)$')


@dataclass
class ByteRange(InputPartition):
    path: str
    base: int       # bytes of the files before this one
    start: int
    end: int
    indent: int     # spaces of one step

    def __post_init__(self):
        super().__init__(None)


class IndentedLog(DataSource):
    """Entries of indented logs: level 0 dataset, 1 sequence, 2 rate key with its numbers as JSON."""

    @classmethod
    def name(cls) -> str:
        return "indentedlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))

    def _files(self):
        """(path, bytes) of the document: one file, or the parts of a folder in name order."""
        from pyarrow import fs
        store, inner = open_store(self.path)
        info = store.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [(self.path, info.size)]
        prefix = self.path[:len(self.path.rstrip("/")) - len(inner.rstrip("/"))]
        parts = [f for f in store.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File]
        return [(prefix + f.path, f.size) for f in sorted(parts, key=lambda f: f.path) if f.base_name[0] not in "._"]

    def partitions(self):
        ranges, base, files = [], 0, [f for f in self._files() if f[1]]
        indent = _step(files[0][0]) if files else 0
        for path, size in files:
            ranges += [ByteRange(path, base, at, min(at + self.split, size), indent) for at in range(0, size, self.split)]
            base += size
        return ranges or [ByteRange("", 0, 0, 0, 0)]

    def read(self, part: ByteRange) -> Iterator[tuple]:
        if part.start == part.end:
            return
        store, inner = open_store(part.path)
        with store.open_input_file(inner) as raw:
            lines = _lines(raw, part.start)
            for pos, line in lines:
                if pos >= part.end:
                    return
                found = _ENTRY.match(line)
                if not found:
                    continue
                level, rest = len(found.group(1)) // part.indent - 1, found.group(3).rstrip()
                if level not in (0, 1, 2) or len(found.group(1)) % part.indent:
                    continue
                body = None
                if level == 2:
                    parts = [rest]
                    if not rest.rstrip(b",").endswith(b"}"):
                        closing = found.group(1) + b"}"
                        for _, more in lines:
                            parts.append(more)
                            if more.startswith(closing):
                                break
                    body = b"".join(p.strip() for p in parts).rstrip(b",").decode()
                yield (self.path, part.base + pos, level, json.loads(found.group(2)), body)


def _step(path: str) -> int:
    """Spaces of one step: those of the first key of the document, which is a dataset."""
    store, inner = open_store(path)
    with store.open_input_file(inner) as raw:
        head = raw.read(1 << 16)
    if not head.strip(b"{} \r\n\t"):
        return 1      # a document without entries
    found = re.search(rb'^( +|\t+)"', head, re.MULTILINE)
    if not found or found.group(1).startswith(b"\t"):
        raise ValueError(f"{path} is not indented by spaces; read it with read_result_log")
    return len(found.group(1))


def _lines(raw, start: int, block: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that begin at ``start`` or later."""
    at = max(start - 1, 0)
    raw.seek(at)
    held = b""
    skip = start > 0     # what begins before the range belongs to the task before
    while True:
        data = raw.read(block)
        pieces = (held + data).split(b"\n")
        held = pieces.pop()
        if len(held) > LINE_BYTES:
            raise ValueError(f"a line of more than {LINE_BYTES} bytes: not an indented log")
        for piece in pieces:
            if not skip:
                yield at, piece
            skip = False
            at += len(piece) + 1
        if not data:
            if held and not skip:
                yield at, held
            return


def read_indented_log(spark: SparkSession, method: str, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Points of one large log: a file, or a folder of parts. Same columns as ``result_logs.read_result_log``."""
    spark.dataSource.register(IndentedLog)
    rows = spark.read.format("indentedlog").option("split_bytes", split_bytes).load(path)
    said = {name: F.when(F.col("level") == level, F.col("key")) for level, name in ((0, "dataset"), (1, "sequence"))}
    rows = ordered_scan(rows, [], ["pos"], carry=said)      # positions go on over the parts of a folder
    points = rows.filter("level = 2").withColumn("p", F.from_json("body", POINT_DDL))
    return points.select(F.lit(method).alias("method"), "dataset", "sequence", F.col("key").alias("rate_key"), "p.*")
