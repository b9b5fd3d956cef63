"""Coded streams as rows, one row per unit. Payload bytes are skipped, not read, unless asked for.

Dialects differ in how lengths are written and where flags live:

``current``     lengths of 1, 2 or 4 bytes; quality index and flags in every slice
``sps_flags``   same lengths; two flags in the parameter set, quality index in every slice
``sps_qp``      lengths of 2 or 4 bytes; quality index and frame class in the parameter set; units of
                several frames
``fixed_i`` / ``fixed_p``      one coded picture per file, fixed-width header with one stream
``fixed_i2`` / ``fixed_p4``    the oldest form: picture size, then two or four streams
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from rdspark.sources.storage import open_store

# Fixed unit types of a stream.
SPS, INTRA, INTER, MULTI = 0, 1, 2, 3

PACKET_FIELDS = ("unit_no bigint, byte_offset bigint, unit_bytes bigint, nal_type int, sps_id int, "
                 "sps_ids array<int>, frame_num int, height int, width int, qp int, qp_p int, fa_idx int, ec_part int, "
                 "reset int, use_ada_i int, payload_len bigint, part_lens array<bigint>, payload binary")
COLUMNS = [part.split()[0] for part in PACKET_FIELDS.split(", ")]
BATCH_ROWS = 4096


class BadStream(ValueError):
    pass


class _Cursor:
    """Byte reader over any seekable file that fails loudly on a short read."""

    def __init__(self, handle, size: int):
        self.handle, self.size, self.at = handle, size, 0

    def take(self, n: int) -> bytes:
        got = self.handle.read(n)
        if len(got) != n:
            raise BadStream(f"stream ends at {self.size} inside a unit, {n} bytes wanted at {self.at}")
        self.at += n
        return got

    def u8(self) -> int:
        return self.take(1)[0]

    def skip(self, n: int) -> None:
        if self.at + n > self.size:
            raise BadStream(f"payload of {n} bytes at {self.at} passes the end {self.size}")
        self.at += n
        self.handle.seek(self.at)


def _length_1_2_4(c: _Cursor) -> int:
    """Top bits 0, 10 or 11 announce 1, 2 or 4 big-endian bytes."""
    lead = c.u8()
    if lead < 0x80:
        return lead
    more = c.take(1 if lead < 0xC0 else 3)
    return int.from_bytes(bytes([lead & 0x3F]) + more, "big")


def _length_2_4(c: _Cursor) -> int:
    """The top bit announces 4 instead of 2 big-endian bytes."""
    two = c.take(2)
    if two[0] < 0x80:
        return int.from_bytes(two, "big")
    return int.from_bytes(bytes([two[0] & 0x7F, two[1]]) + c.take(2), "big")


def iter_units(handle, size: int, dialect: str = "current", payload: bool = False) -> Iterator[dict]:
    """Units of one stream in order, as dicts of the fields that its dialect has."""
    c = _Cursor(handle, size)
    if dialect.startswith("fixed"):
        yield _fixed(c, dialect, payload)
        return
    if dialect not in ("current", "sps_flags", "sps_qp"):
        raise ValueError(f"unknown dialect {dialect}")
    length = _length_2_4 if dialect == "sps_qp" else _length_1_2_4
    number = 0
    while c.at < size:
        u = {"unit_no": number, "byte_offset": c.at}
        lead = c.u8()
        kind, low = lead >> 4, lead & 0x0F
        u["nal_type"] = kind
        if kind == MULTI and dialect == "sps_qp":
            packed = c.take((low + 2) // 2)
            u["frame_num"] = low + 1
            u["sps_ids"] = [n for byte in packed for n in (byte >> 4, byte & 0x0F)][:low + 1]
        elif kind > INTER:
            raise BadStream(f"unit type {kind} at {u['byte_offset']} is unknown in dialect {dialect}")
        else:
            u["sps_id"] = low
        if kind == SPS:
            u["height"], u["width"] = length(c), length(c)
            if dialect == "sps_qp":
                flags = c.u8()
                u["qp"], u["fa_idx"] = flags >> 2, flags & 0x03
            elif dialect == "sps_flags":
                flags = c.u8()
                u["ec_part"], u["use_ada_i"] = (flags >> 2) & 1, flags & 1
        else:
            if dialect != "sps_qp":
                u["qp"] = c.u8()
            if dialect == "current":
                flags = c.u8()
                u["ec_part"], u["reset"] = flags >> 1, flags & 1
            _body(c, u, [length(c)], payload)
        u["unit_bytes"] = c.at - u["byte_offset"]
        yield u
        number += 1


def _fixed(c: _Cursor, dialect: str, payload: bool) -> dict:
    u = {"unit_no": 0, "byte_offset": 0, "nal_type": INTRA if dialect.startswith("fixed_i") else INTER}
    if dialect == "fixed_i":
        u["height"], u["width"], u["qp"], n = struct.unpack(">IIHI", c.take(14))
        parts = [n]
    elif dialect == "fixed_p":
        u["qp"], u["qp_p"], n = struct.unpack(">HHI", c.take(8))
        parts = [n]
    elif dialect in ("fixed_i2", "fixed_p4"):
        count = int(dialect[-1])
        u["height"], u["width"], *parts = struct.unpack(f">{2 + count}I", c.take(4 * (2 + count)))
    else:
        raise ValueError(f"unknown dialect {dialect}")
    _body(c, u, list(parts), payload)
    u["unit_bytes"] = c.at
    return u


def _body(c: _Cursor, u: dict, parts: list[int], payload: bool) -> None:
    total = sum(parts)
    u["payload_len"], u["part_lens"] = total, parts
    if payload:
        u["payload"] = c.take(total)
    else:
        c.skip(total)


def _frames(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """Bounded batches, so a stream of any length passes through a task in constant memory."""
    batch = []
    for row in rows:
        batch.append(row)
        if len(batch) == BATCH_ROWS:
            yield pd.DataFrame(batch, columns=names, dtype=object)
            batch = []
    if batch:
        yield pd.DataFrame(batch, columns=names, dtype=object)


def parse_packets(streams: DataFrame, stream: str = "stream", content: str = "content", dialect: str = "current",
                  payload: bool = False) -> DataFrame:
    """Units of streams that are held as binary values, one value per stream."""
    key = streams.schema[stream].dataType.simpleString()

    def run(batches):
        def rows():
            for pdf in batches:
                for name, data in zip(pdf[stream], pdf[content]):
                    for u in iter_units(io.BytesIO(data), len(data), dialect, payload):
                        yield (name, *[u.get(k) for k in COLUMNS])
        yield from _frames(rows(), ["stream", *COLUMNS])

    return streams.select(stream, content).mapInPandas(run, f"stream {key}, {PACKET_FIELDS}")


def read_packets(spark: SparkSession, path: str, dialect: str = "current", payload: bool = False,
                 glob: str = "*.bin") -> DataFrame:
    """Units of stream files. Spark lists the files; each task opens its own and hops over the payloads.

    Lengths are variable, so one file is walked by one task, but it reads a few bytes per unit and
    holds none of the file.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
             .load(path).select("path", "length"))
    spread = files.repartition(spark.sparkContext.defaultParallelism * 4, "path")

    def run(batches):
        def rows():
            for pdf in batches:
                for name, size in zip(pdf["path"], pdf["length"]):
                    store, inner = open_store(name)
                    with store.open_input_file(inner) as handle:
                        for u in iter_units(handle, int(size), dialect, payload):
                            yield (name, *[u.get(k) for k in COLUMNS])
        yield from _frames(rows(), ["stream", *COLUMNS])

    return spread.mapInPandas(run, f"stream string, {PACKET_FIELDS}")
