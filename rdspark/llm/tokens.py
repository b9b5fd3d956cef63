"""Token ids in Arrow files of equal-length sequences with masks, and reading them back.

Layout of a folder: one ``ids-*.arrow`` and one ``docs-*.arrow`` for each range of doc_id. ``ids`` files are Arrow IPC files (the stream
format with a footer of batch offsets); each batch holds fixed-size lists: ``ids`` of ``sequence`` unsigned integers and ``mask`` of as many
booleans. All batches but the last have ``BATCH`` rows, so sequence i is row i mod BATCH of batch i div BATCH and a memory-mapped reader
gets it without a copy. The last sequence of a file is padded, mask false. ``docs`` files hold (doc_id, n_tokens) in order.

Rows are range-partitioned by (doc_id, row key), so order does not depend on how many rows share an id. A task writes under a name of its own and
returns it; the manifest, a Parquet table committed by Spark, names the files that count. A task that runs twice leaves a file that nobody reads.

Defined results: null texts are empty and give the end id only; rows without an id come first; repeated rows are repeated; an empty table
gives an empty manifest; other columns are not looked at.
"""

from __future__ import annotations

import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rdspark.llm.tables import texts, written
from rdspark.llm.words import slabs
from rdspark.sources.storage import open_store, scratch_path

END_ID = 1
SEQUENCE = 1024
BATCH = 256
#: Entries of each memory of a task; it starts anew beyond. One text may add its own chunks to that. Most chunks of a large corpus are rare, so more would hardly be used.
MEMORY = 100_000
_encoders: dict = {}


class Encoder:
    """Ids of texts from a tokenizer file, as packed unsigned integers.

    The tokenizer never joins what a space parts, so the ids of a text are those of its chunks between spaces, and those are remembered.
    Many chunks are letters with punctuation behind them, perhaps with capitals: letters before ASCII punctuation are a piece of their
    own for this tokenizer, and lower case is its normal form, so ``The,`` is looked up as ``the`` and ``,``; such a word goes to the
    library's model directly, without its rules for what is no word. All other chunks go through the whole tokenizer.
    Whether these rules hold is tried on samples when a file is opened; else no chunk is taken apart.
    """

    PUNCTUATION = ".,;:!?%&$#*()|=\"-"
    SAMPLES = ("Ab", "word", "Été", "straßes", "año", "x", "Zzyzxqk", "ÀÿÖþ", "internationalisation")

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code, self.model = "H" if self.dtype.itemsize == 2 else "I", self.tokenizer.model
        self.chunks: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {"": b""}
        # Latin-1 letters as the byte-level alphabet writes them: printable bytes stand for themselves, the others from 256 on.
        other = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
        letter = {b: chr(256 + other.index(b)) if b in other else chr(b) for b in range(256)}
        self.table = {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}
        self.plain = False
        self.plain = all(self._whole(w + p) == self._word(w.lower()) + self._whole(p) for w in self.SAMPLES for p in ("", *self.PUNCTUATION))

    def _pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        return self._pack([t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.table))])

    def _learn(self, chunk: str) -> bytes:
        core = chunk.rstrip(self.PUNCTUATION)
        if not self.plain or not core or not core.isalpha() or max(core) > "ÿ" or "µ" in core:
            return self._whole(chunk)
        word, tail, pieces = core.lower(), chunk[len(core):], self.pieces
        if word not in pieces:
            if len(pieces) > MEMORY:
                pieces.clear()
            pieces[word] = self._word(word)
        if not tail:
            return pieces[word]
        end = pieces.get(tail)
        if end is None:
            end = pieces[tail] = self._whole(tail)
        return pieces[word] + end

    def forget(self) -> None:
        """Workers outlive their task, and stages that know nothing of tokens run beside what one leaves behind."""
        self.chunks, self.pieces = {"": b""}, {"": b""}

    def encode(self, texts: list[str]) -> list[bytes]:
        out, end = [], self._pack([END_ID])
        for text in texts:
            chunks, known = text.split(" "), self.chunks
            try:
                ids = b"".join([known[c] for c in chunks])
            except KeyError:
                if len(known) > MEMORY:
                    known.clear()
                for c in chunks:
                    if c not in known:
                        known[c] = self._learn(c)
                ids = b"".join([known[c] for c in chunks])
            out.append(ids + end)
        return out


def encoder(path: str) -> Encoder:
    """One encoder for each worker process; who is done with it lets it forget."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class _Writer:
    """One ids file: packs ids into sequences, a batch at a time."""

    def __init__(self, sink, dtype, sequence: int):
        self.dtype, self.sequence, self.rest = dtype, sequence, b""
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.kind, self.schema = kind, pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.out = pa.ipc.new_file(sink, self.schema)

    def _batch(self, ids: np.ndarray, n: int) -> None:
        mask = np.arange(len(ids)) < n
        self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids, self.kind), self.sequence),
                                              pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence)], schema=self.schema))

    def add(self, parts: list[bytes]) -> None:
        data, full = b"".join([self.rest, *parts]), BATCH * self.sequence * self.dtype.itemsize
        k = 0
        while len(data) - k >= full:
            self._batch(np.frombuffer(data[k:k + full], self.dtype), BATCH * self.sequence)
            k += full
        self.rest = data[k:]

    def close(self) -> None:
        ids = np.frombuffer(self.rest, self.dtype)
        if len(ids):
            padded = np.zeros(-(-len(ids) // self.sequence) * self.sequence, self.dtype)
            padded[:len(ids)] = ids
            self._batch(padded, len(ids))
        self.out.close()


MANIFEST = "shard int, ids_file string, docs_file string, n_docs long, n_tokens long"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """Write the ids of all texts to ``path``; returns the manifest (shard, ids_file, docs_file, n_docs, n_tokens), one row per range."""
    ranged = texts(docs).repartitionByRange("doc_id", "row_key").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row_key")

    def write(batches):
        from pyspark import TaskContext
        shard, own = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        enc, ids, doc_file, n_docs, n_tokens = encoder(tokenizer), None, None, 0, 0
        names = [f"{kind}-{shard:06d}-{own}.arrow" for kind in ("ids", "docs")]
        for batch in batches:
            if not batch.num_rows:
                continue
            if ids is None:
                fs, at = open_store(path)
                fs.create_dir(at, recursive=True)
                sinks = [fs.open_output_stream(f"{at}/{name}") for name in names]
                ids = _Writer(sinks[0], enc.dtype, sequence)
                doc_file = pa.ipc.new_file(sinks[1], pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())]))
            for _, part, _, _ in slabs(batch, size=1 << 21):
                coded = enc.encode(part.column("text").to_pylist())
                lengths = np.fromiter((len(x) // enc.dtype.itemsize for x in coded), np.int64, len(coded))
                ids.add(coded)
                doc_file.write_batch(pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(lengths)], names=["doc_id", "n_tokens"]))
                n_docs, n_tokens = n_docs + len(coded), n_tokens + int(lengths.sum())
        if ids is not None:
            ids.close()
            doc_file.close()
            for sink in sinks:
                sink.close()
        enc.forget()
        if ids is not None:
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([names[0]]), pa.array([names[1]]), pa.array([n_docs]), pa.array([n_tokens])],
                                  names=["shard", "ids_file", "docs_file", "n_docs", "n_tokens"])
    return written(ranged.mapInArrow(write, MANIFEST), "token-manifest")


def _source(fs, path: str):
    from pyarrow.fs import LocalFileSystem
    return pa.memory_map(path) if isinstance(fs, LocalFileSystem) else fs.open_input_file(path)


def sequence_at(source, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of sequence k of an ids file; the ids are a view of the file's memory if it is mapped."""
    reader = pa.ipc.open_file(source)
    batch, row = reader.get_batch(k // BATCH), k % BATCH
    return (batch.column("ids").slice(row, 1).flatten().to_numpy(), batch.column("mask").slice(row, 1).flatten().to_numpy(zero_copy_only=False))


def read_documents(manifest: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files: ``start`` counts the ids of all documents before it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)      # one row a file
    files = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    files = files.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), "shard")

    def read(batches):
        fs, at = open_store(path)
        for batch in batches:
            for row in batch.to_pylist():
                docs = pa.ipc.open_file(_source(fs, f"{at}/{row['docs_file']}"))
                ids = pa.ipc.open_file(_source(fs, f"{at}/{row['ids_file']}"))
                pieces = _real_ids(ids)
                start, held, at_id = row["first"], np.zeros(0, "<u4"), 0
                for k in range(docs.num_record_batches):
                    part = docs.get_batch(k)
                    lengths = part.column("n_tokens").to_numpy()
                    crcs = np.zeros(len(lengths), np.int64)
                    for j, n in enumerate(lengths):
                        parts = []
                        while n > 0:
                            if at_id == len(held):
                                held, at_id = next(pieces), 0
                            take = min(int(n), len(held) - at_id)
                            parts.append((at_id, at_id + take, held))
                            at_id, n = at_id + take, n - take
                        crc = 0
                        for a, b, source in parts:
                            crc = zlib.crc32(source[a:b], crc)
                        crcs[j] = crc
                    starts = start + np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
                    start += int(lengths.sum())
                    yield pa.record_batch([part.column("doc_id"), pa.array(starts), pa.array(lengths), pa.array(crcs)],
                                          names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _real_ids(reader):
    """The ids of a file that the masks mark as real, a batch at a time, as little-endian 32-bit integers."""
    for k in range(reader.num_record_batches):
        batch = reader.get_batch(k)
        ids = batch.column("ids").flatten().to_numpy()
        mask = batch.column("mask").flatten().to_numpy(zero_copy_only=False)
        yield np.ascontiguousarray(ids if mask.all() else ids[mask], "<u4")


def encoded_documents(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """Write and read back: the files go to a folder below the shared one."""
    path = scratch_path(docs.sparkSession, "tokens")
    return read_documents(write_tokens(docs, path, tokenizer, sequence), path)
