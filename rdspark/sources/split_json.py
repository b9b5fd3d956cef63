"""Elements of JSON documents of any size and form, read by many tasks.

A document may be one line or a million. It is cut into byte ranges anywhere, inside strings too. First each range says what it does to the state of a reader: whether it
turns "inside a string" around (its unescaped quotes), and by how much it changes the nesting, if it begins outside a string and if it begins inside one. Running sums
over these few numbers give the state at the start of every range. Then each range emits the elements that begin in it, and reads on for the last one. Which keys
enclose an element may have been said long before; that is a scan in order afterwards (``ordered_scan``).
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from rdspark.operators.ordered import ordered_scan
from rdspark.sources.storage import open_store

SPLIT_BYTES = 8 << 20
BLOCK = 1 << 20      # bytes of a step when a task reads on behind its range
_MARKS = np.zeros(256, np.int8)
_MARKS[[0x7B, 0x5B]], _MARKS[[0x7D, 0x5D]], _MARKS[0x2C], _MARKS[0x3A] = 1, -1, 2, 3      # open, close, comma, colon
_STEP = np.array([0, 1, 0, 0, -1], np.int64)      # by mark


def _documents(path: str, joined: bool) -> dict[str, list[tuple[str, int, int]]]:
    """Document to its parts (path, bytes before, bytes). A folder holds a document a file, or the parts of one document in name order."""
    from pyarrow import fs
    store, inner = open_store(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return {path: [(path, 0, info.size)]}
    prefix = path[:len(path.rstrip("/")) - len(inner.rstrip("/"))]
    files = sorted((f for f in store.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.path)
    if not joined:
        return {prefix + f.path: [(prefix + f.path, 0, f.size)] for f in files}
    parts, base = [], 0
    for f in files:
        parts.append((prefix + f.path, base, f.size))
        base += f.size
    return {path: parts}


def _read(parts: list[tuple[str, int, int]], at: int, n: int) -> bytes:
    """``n`` bytes of a document from ``at`` on, fewer at its end."""
    out, k = [], max(0, bisect_right(parts, at, key=lambda p: p[1]) - 1)
    while n > 0 and k < len(parts):
        path, base, size = parts[k]
        take = min(n, base + size - at)
        if take > 0:
            store, inner = open_store(path)
            with store.open_input_file(inner) as f:
                f.seek(at - base)
                out.append(f.read(take))
            at, n = at + take, n - take
        k += 1
    return b"".join(out)


def _odd_escape(parts, at: int) -> bool:
    """Whether the byte at ``at`` is escaped: an odd number of backslashes stands before it."""
    count, step = 0, 64
    while at - count > 0:
        low = max(0, at - count - step)
        data = _read(parts, low, at - count - low)
        run = len(data) - len(data.rstrip(b"\\"))
        count += run
        if run < len(data):
            break
        step = 1 << 16
    return count % 2 == 1


def _structure(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of brackets, commas and colons, their marks, and the parity of the quotes before them; at the end the parity of all quotes."""
    quotes = np.flatnonzero(data == 0x22)
    slashes = data == 0x5C
    if len(quotes) and (escaped or slashes.any()):
        clear = np.maximum.accumulate(np.where(slashes, -1, np.arange(len(data), dtype=np.int32)))      # last byte that is no backslash
        before = np.where(quotes > 0, clear[np.maximum(quotes - 1, 0)], -1)
        run = quotes - 1 - before + np.where(before < 0, int(escaped), 0)
        quotes = quotes[run % 2 == 0]
    marks = _MARKS[data]
    at = np.flatnonzero(marks)
    return at, marks[at], np.append(np.searchsorted(quotes, at) & 1, len(quotes) & 1)


def _ranges(spark: SparkSession, documents: dict, split: int) -> DataFrame:
    """(doc, start, stop, inside, depth): the byte ranges of all documents and the state in which they begin."""
    rows = spark.createDataFrame([(d, p[-1][1] + p[-1][2]) for d, p in documents.items() if p], "doc string, size long").where("size > 0")
    cut = rows.select("doc", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    cut = cut.withColumn("stop", F.least(F.col("start") + split, "size")).repartition(spark.sparkContext.defaultParallelism * 4, "doc", "start")

    def summarise(batches):
        import pyarrow as pa
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                parts = documents[r["doc"]]
                raw = _read(parts, r["start"], r["stop"] - r["start"])
                if r["start"] == 0 and raw.strip()[:1] not in (b"", b"{", b"["):
                    raise ValueError(f"{r['doc']} is neither a JSON object nor a list")
                data = np.frombuffer(raw, np.uint8)
                _, marks, parity = _structure(data, _odd_escape(parts, r["start"]))
                step = _STEP[marks]
                out.append((int(parity[-1]), int(step[parity[:-1] == 0].sum()), int(step[parity[:-1] == 1].sum())))
            cols = [pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], []))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "size", "start", "stop")), *cols], names=["doc", "size", "start", "stop", "turns", "outside", "within"])
    told = cut.mapInArrow(summarise, "doc string, size long, start long, stop long, turns long, outside long, within long")
    before = W.partitionBy("doc").orderBy("start").rowsBetween(W.unboundedPreceding, -1)      # a few numbers a range
    inside = told.withColumn("inside", F.pmod(F.coalesce(F.sum("turns").over(before), F.lit(0)), F.lit(2)))
    step = inside.withColumn("step", F.when(F.col("inside") == 0, F.col("outside")).otherwise(F.col("within")))
    placed = step.withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0)))
    open_ = (F.col("stop") == F.col("size")) & ((F.col("depth") + F.col("step") != 0) | (F.pmod(F.col("inside") + F.col("turns"), F.lit(2)) != 0))
    wrong = F.when(open_ | (F.col("depth") < 0), F.raise_error(F.concat(F.lit("not a JSON document, or one that is cut off: "), F.col("doc"))).cast("long"))
    return placed.select("doc", "start", "stop", "inside", F.coalesce(wrong, F.col("depth")).alias("depth"))


class _Walker:
    """The structural characters of a document from a place on, a block at a time, outside strings, with the depth before each."""

    def __init__(self, parts, start: int, stop: int, inside: int, depth: int):
        self.parts, self.start, self.inside, self.depth = parts, start, inside, depth
        self.data, self.at, self.mark, self.before = b"", np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int64)
        self.ended = False
        self.more(stop - start)

    def more(self, n: int = BLOCK) -> None:
        """Reads on, keeping what was read."""
        here = self.start + len(self.data)
        block = _read(self.parts, here, n)
        self.ended = len(block) < n
        at, mark, parity = _structure(np.frombuffer(block, np.uint8), _odd_escape(self.parts, here) if block else False)
        real = (parity[:-1] ^ self.inside) == 0
        at, mark = at[real], mark[real]
        step = _STEP[mark]
        before = self.depth + np.cumsum(step) - step
        self.at, self.mark, self.before = (np.concatenate(x) for x in ((self.at, at + len(self.data)), (self.mark, mark), (self.before, before)))
        self.data += block
        self.inside ^= int(parity[-1])
        self.depth += int(step.sum())

    def ending(self, k: int, level: int) -> int:
        """Index of the mark that ends the element which begins at mark k; reads on as far as needed."""
        at = k + 1
        while True:
            ends = np.flatnonzero((self.before[at:] == level) & ((self.mark[at:] == 2) | (self.mark[at:] == -1)))
            if len(ends):
                return at + int(ends[0])
            if self.ended:
                raise ValueError("the document ends inside an element")
            at = len(self.at)
            self.more()

    def following(self, k: int) -> int:
        """Index of the mark behind mark k."""
        while k + 1 >= len(self.at):
            if self.ended:
                raise ValueError("the document ends inside an element")
            self.more()
        return k + 1


def _elements(parts, start: int, stop: int, inside: int, depth: int, level: int, strict: bool) -> Iterator[tuple]:
    """(place, level, key, text): elements at ``level`` that begin in the range, and the keys that enclose them, without text."""
    w = _Walker(parts, start, stop, inside, depth)
    count = len(w.at)
    within = np.where(w.mark == 1, w.before + 1, w.before)      # level of the elements that begin behind a mark
    begins = ((w.mark == 1) | (w.mark == 2)) & (within >= 1) & (within <= level)
    ends = np.flatnonzero((w.before == level) & ((w.mark == 2) | (w.mark == -1)))
    nearest = np.searchsorted(ends, np.arange(count), "right")
    for k in np.flatnonzero(begins).tolist():
        here, at = int(within[k]), int(w.at[k])
        colon = w.following(k)
        keyed = w.mark[colon] == 3
        key = json.loads(w.data[at + 1:int(w.at[colon])]) if keyed else None
        if here < level:
            first = w.following(colon) if keyed else colon
            if w.mark[first] == 1:
                if keyed:
                    yield start + at, here, key, None
            elif strict and (keyed or w.data[at + 1:int(w.at[first])].strip()):
                raise ValueError(f"no object or list below {key!r} at byte {start + at}")
            continue
        end = int(ends[nearest[k]]) if nearest[k] < len(ends) else w.ending(k, level)
        text = w.data[(int(w.at[colon]) if keyed else at) + 1:int(w.at[end])].strip()
        if text or keyed:
            yield start + at, here, key, text.decode()


def json_elements(spark: SparkSession, path: str, level: int, joined: bool = False, strict: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(doc, pos, level, key, text): what stands ``level`` brackets deep in the documents of ``path``, as JSON text with its key or null, and above it the enclosing keys.

    ``path`` is a file or a folder, whose files are documents of their own or, ``joined``, one document in parts. With ``strict``, a value above ``level`` that is neither object
    nor list is an error; else it is passed over. A document that does not close is an error. The list of files is the driver's; their bytes are not.
    """
    documents = _documents(path, joined)
    ranges = _ranges(spark, documents, split_bytes).repartition(spark.sparkContext.defaultParallelism * 4, "doc", "start")

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for r in batch.to_pylist():
                rows = []
                found = _elements(documents[r["doc"]], r["start"], r["stop"], r["inside"], r["depth"], level, strict)
                for row in found:
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield _batch(pa, r["doc"], rows)
                        rows = []
                yield _batch(pa, r["doc"], rows)
    return ranges.mapInArrow(run, "doc string, pos long, level int, key string, text string")


def _batch(pa, doc: str, rows: list):
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array([doc] * len(rows), pa.string()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()),
                                       pa.array(cols[3], pa.string())], names=["doc", "pos", "level", "key", "text"])


def enclosed(elements: DataFrame, names: list[str]) -> DataFrame:
    """The deepest of ``json_elements`` with the keys that enclose them: ``names`` from the outermost on."""
    said = {n: F.when(F.col("level") == k + 1, F.col("key")) for k, n in enumerate(names)}
    return ordered_scan(elements, ["doc"], ["pos"], carry=said).where(F.col("level") == len(names) + 1)
