"""Removal of repeated passages: every window of 20 words whose words also start earlier is cut out.

1. Anchors. Each window names its least 8-word hash as anchor; equal windows have equal anchors. Anchor hashes are met in packed form, and those
   that stand at two or more places set bits in a bitmap of fixed size. Windows whose anchor is unique cannot repeat.
2. Pieces. The windows of a document that follow one another with one surviving anchor are a piece; a piece goes to the shard of its anchor.
   A task sends equal pieces once, the earliest; the later ones repeat it whole.
3. Shards. Each shard indexes its distinct pieces in order of their first places with a compressed FM-index and streams them through it: the
   interval of each window tells its least place, so a window that is not at that place repeats an earlier one.
4. The covered words of a document are cut from its text.

The bitmap only saves work: bits set by chance send more pieces to the shards, where windows are compared in full.
Words are compared by 64-bit hashes. Order is (doc_id, row key, start); rows without an id come last.

Defined results: null texts have no words (kept_sha256 is that of the empty text); repeated rows, equal in id and text, are one document and
get equal results; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rdspark.llm.fmindex import FMIndex, matching_windows
from rdspark.llm.tables import buckets, texts
from rdspark.llm.words import grams, mix, slabs, spans, word_hashes

WINDOW, ANCHOR = 20, 8
#: Bits of the bitmap of anchors that repeat.
BITS = 1 << 25
#: Words that an index holds at most, unless one anchor alone has more.
SHARD_WORDS = 1 << 20
HELD = 1 << 21
_NONE = np.iinfo(np.int64).max


def _sliding(a: np.ndarray, k: int, best) -> np.ndarray:
    """best over every k consecutive values."""
    n = len(a) - k + 1
    if n <= 0:
        return a[:0]
    width = 1
    while 2 * width <= k:
        a = best(a[:-width], a[width:])
        width *= 2
    return best(a[:n], a[k - width:k - width + n]) if width < k else a[:n]


def anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of each window, hashes at the places that are anchors) of one document's words."""
    if len(h) < window:
        return h[:0], h[:0]
    g = grams(h, ANCHOR)
    span = window - ANCHOR + 1
    least = _sliding(g, span, np.minimum)
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    return least, g[_sliding(padded, span, np.maximum) == g]


def _documents(batch: pa.RecordBatch):
    """(row of the batch, word hashes) of each document."""
    for first, _, data, offs in slabs(batch):
        h, before = word_hashes(data, offs)
        for k in range(len(offs) - 1):
            yield first + k, h[before[k]:before[k + 1]]


def repeated_anchors(docs: DataFrame, window: int) -> tuple[np.ndarray, int]:
    """(bitmap of anchor hashes that stand at several places, number of such places)."""
    n_buckets = buckets(docs.sparkSession)

    def pack(batches):
        held, size = [], 0

        def flush():
            keys = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            # Of equal keys two are enough to tell that there are several; the rest is their count.
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
            many = np.diff(np.r_[first, len(keys)]) > 1 if len(keys) else np.zeros(0, bool)
            keys = np.concatenate([keys[first], keys[first[many]]])
            bucket = (keys % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keys, bucket = keys[order], bucket[order]
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, int)
            ends = np.r_[cut[1:], len(keys)].astype(int)
            return pa.record_batch([pa.array(bucket[cut], pa.int32()), pa.array([keys[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())],
                                   names=["bucket", "keys"])
        for batch in batches:
            for _, h in _documents(batch):
                held.append(anchors(h, window)[1])
                size += len(held[-1])
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        yield flush()

    def meet(table: pa.Table) -> pa.Table:
        keys = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")] or [np.zeros(0, np.uint64)]))
        same = keys[1:] == keys[:-1]
        several = keys[np.r_[same, False] | np.r_[False, same]] if len(keys) else keys
        at = np.unique(several % np.uint64(BITS)).astype(np.int64)
        part = at >> 15
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(at) else np.zeros(0, int)
        out = []
        for a, b in zip(cut, np.r_[cut[1:], len(at)].astype(int)):
            bits = np.zeros(1 << 15, bool)
            bits[at[a:b] & 0x7FFF] = True
            out.append(np.packbits(bits, bitorder="little").tobytes())
        return pa.table({"part": pa.array(part[cut], pa.int64()), "bits": pa.array(out, pa.binary()),
                         "places": pa.array([len(several)] + [0] * (len(cut) - 1) if len(cut) else [], pa.int64())})
    blobs = texts(docs).select("text").mapInArrow(pack, "bucket int, keys binary")
    parts = blobs.groupBy("bucket").applyInArrow(meet, "part long, bits binary, places long").groupBy("part").agg(
        F.bitmap_or_agg("bits").alias("bits"), F.sum("places").alias("places")).collect()      # BITS / 8 bytes at most
    bitmap = np.zeros(BITS >> 3, np.uint8)
    for p in parts:
        bitmap[p["part"] << 12:(p["part"] + 1) << 12] = np.frombuffer(p["bits"], np.uint8)
    return bitmap, sum(p["places"] for p in parts)


PIECES = "kind int, shard int, doc_id long, row_key long, a binary, b binary, c binary, d binary"
RANGES = "bucket int, keys binary, ranges binary"


def _pieces(h: np.ndarray, bitmap: np.ndarray, window: int):
    """(anchor, first window, last window + 1) of the pieces of a document."""
    least, _ = anchors(h, window)
    at = (least % np.uint64(BITS)).astype(np.int64)
    hit = (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    change = np.flatnonzero(np.r_[True, least[1:] != least[:-1]]) if len(least) else np.zeros(0, int)
    ends = np.r_[change[1:], len(least)].astype(int)
    keep = hit[change] if len(change) else np.zeros(0, bool)
    return least[change[keep]] if len(change) else least, change[keep], ends[keep]


def repeated_ranges(docs: DataFrame, bitmap: np.ndarray, places: int, window: int) -> DataFrame:
    """(row_key, ranges): starts and ends of the repeated stretches of a row, as pairs of 32-bit integers; one row a document that has any.

    Shards hand on packed ranges by bucket of the row key, so their number of rows does not depend on how many shards a document is in.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bitmap)      # BITS / 8 bytes
    shards, n_buckets = buckets(spark, places * (window + 8) / SHARD_WORDS), buckets(spark)

    def cut(batches):
        """Pieces by shard, columns packed: words, piece ends, places, documents; and ranges that repeat within the task's stretch."""
        held: dict = {}
        size, own = 0, {}

        def flush():
            by = {}
            for anchor, text, doc, key, start in held.values():
                by.setdefault(anchor % shards, []).append((text, doc, key, start))
            rows = [(0, shard, None, None, b"".join(p[0] for p in ps), np.array([len(p[0]) >> 3 for p in ps], np.int32).tobytes(),
                     np.array([(p[1], p[2]) for p in ps], np.int64).tobytes(), np.array([p[3] for p in ps], np.int32).tobytes()) for shard, ps in by.items()]
            rows += [(1, k % shards, None, k, np.array(r, np.int32).tobytes(), None, None, None) for k, r in own.items()]
            return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(
                (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))],
                names=["kind", "shard", "doc_id", "row_key", "a", "b", "c", "d"])
        for batch in batches:
            ids = batch.column("doc_id").fill_null(_NONE).to_numpy()
            keys = batch.column("row_key").to_numpy()
            for row, h in _documents(batch):
                doc, key = int(ids[row]), int(keys[row])
                for anchor, first, last in zip(*_pieces(h, shared.value, window)):
                    text = h[first:last + window - 1].tobytes()
                    before = held.get(text)
                    piece = (int(anchor), text, doc, key, int(first))
                    if before is None:
                        held[text] = piece
                        size += len(text) >> 3
                        continue
                    late = piece if before[2:] <= piece[2:] else before
                    if late is before:
                        held[text] = piece
                    if before[2:] != piece[2:]:      # equal: a repeated row
                        own.setdefault(late[3], []).append((late[4], late[4] + (len(text) >> 3)))
                if size >= HELD:
                    yield flush()
                    held, own, size = {}, {}, 0
        yield flush()

    def search(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        found = [np.zeros((0, 3), np.int64)]
        done = table.filter(pa.array(kind == 1))
        for key, ranges in zip(done.column("row_key").to_pylist(), done.column("a")):
            r = np.frombuffer(ranges.as_buffer(), np.int32).reshape(-1, 2)
            found.append(np.column_stack([np.full(len(r), key), r]))
        blobs = table.filter(pa.array(kind == 0))
        if blobs.num_rows:
            col = lambda name, t: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in blobs.column(name)])
            words, lengths, doc, at = col("a", np.uint64), col("b", np.int32), col("c", np.int64).reshape(-1, 2), col("d", np.int32)
            found.append(_repeats(words, lengths.astype(np.int64), doc, at.astype(np.int64), window))
        rows = _joined(np.concatenate(found))
        bucket = np.mod(rows[:, 0], n_buckets)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(rows) else np.zeros(0, int)
        parts = list(zip(cut, np.r_[cut[1:], len(rows)].astype(int)))
        return pa.table({"bucket": pa.array(bucket[cut], pa.int32()), "keys": pa.array([rows[x:y, 0].tobytes() for x, y in parts], pa.binary()),
                         "ranges": pa.array([rows[x:y, 1:].astype(np.int32).tobytes() for x, y in parts], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("keys")])
        ranges = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in table.column("ranges")]).reshape(-1, 2)
        rows = _joined(np.column_stack([keys, ranges]))
        cut = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]]) if len(rows) else np.zeros(0, int)
        return pa.table({"row_key": pa.array(rows[cut, 0], pa.int64()), "ranges": pa.array(
            [rows[x:y, 1:].astype(np.int32).tobytes() for x, y in zip(cut, np.r_[cut[1:], len(rows)].astype(int))], pa.binary())})
    packed = texts(docs).mapInArrow(cut, PIECES)
    return packed.groupBy("shard").applyInArrow(search, RANGES).groupBy("bucket").applyInArrow(merge, "row_key long, ranges binary")


def _joined(rows: np.ndarray) -> np.ndarray:
    """(key, start, end) rows with the ranges of a key joined where they meet."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    if not len(rows):
        return rows
    first = np.r_[True, rows[1:, 0] != rows[:-1, 0]]
    # Furthest end so far within a key: ends are shifted by the key's number, so that a running maximum starts anew with each key.
    group = np.cumsum(first) - 1
    wide = int(rows[:, 2].max()) + 1
    reach = np.maximum.accumulate(rows[:, 2] + group * wide) - group * wide
    start = np.flatnonzero(first | np.r_[True, rows[1:, 1] > reach[:-1]])
    end = np.r_[start[1:], len(rows)] - 1
    return np.column_stack([rows[start, 0], rows[start, 1], reach[end]])


def _repeats(words: np.ndarray, lengths: np.ndarray, doc: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """(row key, start, end) of the repeated windows among pieces."""
    order = np.lexsort((at, doc[:, 1], doc[:, 0]))
    begin = np.r_[0, np.cumsum(lengths)[:-1]]
    # Equal pieces: by two hashes over all their words and the length; the first in order stays.
    power = mix(np.arange(int(lengths.max()), dtype=np.uint64)) | np.uint64(1)
    inside = np.arange(len(words)) - np.repeat(begin, lengths)
    sums = [np.add.reduceat(mix(words ^ np.uint64(salt)) * power[inside], begin) for salt in (1, 2)]
    names = np.stack([sums[0], sums[1], lengths.astype(np.uint64)], 1)[order]
    _, first, inverse = np.unique(names, axis=0, return_index=True, return_inverse=True)
    inverse = inverse.ravel()
    out_key, out_from, out_to = [], [], []
    same_row = (doc[order] == doc[order[first[inverse]]]).all(1) & (at[order] == at[order[first[inverse]]])
    late = order[(first[inverse] != np.arange(len(order))) & ~same_row]
    out_key.append(doc[late, 1])
    out_from.append(at[late])
    out_to.append(at[late] + lengths[late])
    chosen = order[np.sort(first)]
    # Distinct pieces go in chunks of whole anchors only if one index would get too large; a shard is sized to hold one.
    parts = [words[begin[p]:begin[p] + lengths[p]] for p in chosen]
    sizes = lengths[chosen]
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    text = np.zeros(int(ends[-1]) + 1, np.uint64)
    flat = np.concatenate(parts)
    _, ids = np.unique(flat, return_inverse=True)
    body = np.ones(len(text), bool)
    body[ends] = False
    text = text.astype(np.int64)
    text[body] = ids.ravel() + 1
    where, least = matching_windows(FMIndex(text, window), text, starts, ends, window)
    late = where > least
    piece = np.searchsorted(ends, where[late])
    place = at[chosen[piece]] + where[late] - starts[piece]
    out_key.append(doc[chosen[piece], 1])
    out_from.append(place)
    out_to.append(place + window)
    return np.column_stack([np.concatenate(x) for x in (out_key, out_from, out_to)]).astype(np.int64)


RESULT = "doc_id long, row_key long, n_words long, n_removed long, kept_sha256 string, kept string"


def without_repeats(docs: DataFrame, window: int = WINDOW, text: bool = True) -> DataFrame:
    """(doc_id, row_key, n_words, n_removed, kept_sha256, kept), one row per row of ``docs`` (doc_id, text).

    ``kept`` is the text that is left, words joined by one space; null unless ``text``.
    """
    if window < ANCHOR or window > 32:
        raise ValueError(f"window must be {ANCHOR} to 32 words")
    bitmap, places = repeated_anchors(docs, window)
    ranges = repeated_ranges(docs, bitmap, places, window)
    met = texts(docs).join(ranges, "row_key", "left").select("doc_id", "row_key", "text", "ranges")

    def cut(batches):
        for batch in batches:
            for first, part, data, offs in slabs(batch):
                starts, ends, before = spans(data, offs)
                found = part.column("ranges")
                rows = ([], [], [], [])
                for k in range(len(offs) - 1):
                    a, b = before[k], before[k + 1]
                    n, keep = int(b - a), None
                    if found[k].is_valid:
                        step = np.zeros(n + 1, np.int64)
                        r = np.frombuffer(found[k].as_buffer(), np.int32).reshape(-1, 2)
                        np.add.at(step, r[:, 0], 1)
                        np.add.at(step, r[:, 1], -1)
                        keep = np.cumsum(step[:-1]) == 0
                    left = data[offs[k]:offs[k + 1]].tobytes().split()
                    if keep is not None:
                        left = [w for w, stays in zip(left, keep) if stays]
                    kept = b" ".join(left)
                    rows[0].append(n)
                    rows[1].append(n - len(left))
                    rows[2].append(hashlib.sha256(kept).hexdigest())
                    rows[3].append(kept.decode("utf-8", "replace") if text else None)
                yield pa.record_batch([part.column("doc_id"), part.column("row_key"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()),
                                       pa.array(rows[2], pa.string()), pa.array(rows[3], pa.string())],
                                      names=["doc_id", "row_key", "n_words", "n_removed", "kept_sha256", "kept"])
    return met.mapInArrow(cut, RESULT)


