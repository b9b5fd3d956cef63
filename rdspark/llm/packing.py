"""Vector bin packing of tokenised examples into training sequences under limits on tokens, segments and loss-bearing tokens.

An example is a text, with a prompt before it if there is one, and the end id behind; the ids of the text and the end id bear loss, those of the
prompt do not. A sequence holds pieces of examples. Its capacity is a vector (``Limits``): tokens, segments (pieces) and loss-bearing tokens.

Sequences are filled one at a time by the dot-product heuristic: of the pieces that fit into what is left, the one whose demand vector has
the greatest product with the vector of what is left goes in, each dimension in shares of its limit and weighted by how much of the limit the
pieces at hand need on average. A task holds ``HELD`` pieces to choose from and hands on sequences as they close, so memory is bounded, nothing is
shuffled, and a long text passes through as full sequences.

With ``cut`` examples may be cut anywhere: what is left of a sequence takes the head of a piece, and a sequence that closes short of its tokens goes
back to the last power of two, where none is padded; the rest returns to the pieces at hand. Without ``cut`` only examples beyond a limit are cut,
and short sequences are padded.

Ids are those of a byte-level tokenizer file of the tokenizers library. The library itself takes some 1,100 CPU seconds a GB of text, so texts go
through tiktoken, which takes the file's vocabulary as ranks, a fifth of that. Whether both agree is tried on samples when the file is opened, and
whether its merges are in the order of its ids; else, and for texts that hold a special token, the library does the work.

Defined results: null texts are empty and give the end id alone; null prompts are empty; rows without an id, repeated rows and equal ids are
packed like all others (``row_key`` tells rows apart, equal rows share it); an empty table gives no rows; other columns are not looked at.
Sequences are numbered by task and by order in the task, and the pieces are written to the shared folder once, so a repeated task changes nothing.
"""

from __future__ import annotations

import json
from array import array
from collections import deque
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rdspark.llm.tables import texts, written
from rdspark.llm.words import slabs

END_ID = 1
#: Pieces that a task chooses from.
HELD = 4096
#: Fixed value: how byte-level tokenizers of this family cut a text before they merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict = {}


class Limits(NamedTuple):
    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


class ByteEncoder:
    """Ids of texts from a byte-level tokenizer file, as little-endian unsigned 32-bit integers."""

    SAMPLES = ("", "a", " a  b\n\nc \n d\t", "Été straßes año ÀÿÖþ", "don't we'll I'M 's", "x1 22\u00b2 \u0661 1,000.50", "日本語 текст \U0001f642\u200d\u2028",
               "internationalisation, Zzyzxqk!? (a) \x00\x1c\x85\xa0 end ", "a" * 300, "\r\n \r\n")

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._ranked(path)
        if self.fast and any(self.encode(x) != self._whole(x) for x in self.SAMPLES):
            self.fast = None

    @staticmethod
    def _ranked(path: str):
        """The same vocabulary as ranks, or None if the file is of another kind."""
        import tiktoken
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # The byte-level alphabet: printable bytes stand for themselves, the others are numbered from 256 on.
        other = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
        byte = {chr(256 + other.index(b)) if b in other else chr(b): b for b in range(256)}
        vocab, merges = model.get("vocab"), model.get("merges") or []
        if not isinstance(vocab, dict) or not all(c in byte for token in vocab for c in token):
            return None
        made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in merges]
        if made != list(range(256, 256 + len(made))) or len(vocab) != 256 + len(made):
            return None
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={bytes(byte[c] for c in token): k for token, k in vocab.items()}, special_tokens={})

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(x in text for x in self.special):
            return self._whole(text)
        return array("I", self.fast.encode_ordinary(text)).tobytes()


def encoder(path: str) -> ByteEncoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


class Piece(NamedTuple):
    """Ids ``start`` to ``stop`` of an example whose ids before ``free`` bear no loss."""
    example: object
    start: int
    stop: int
    free: int

    @property
    def tokens(self) -> int:
        return self.stop - self.start

    @property
    def loss(self) -> int:
        return max(0, self.stop - max(self.start, self.free))

    def head(self, tokens: int, loss: int) -> int:
        """How many ids from the start need at most so many tokens and so much loss."""
        return max(0, min(self.tokens, tokens, max(self.start, self.free) + loss - self.start))


class Packer:
    """Fills sequences, one at a time, from the pieces it holds."""

    def __init__(self, limits: Limits = Limits(), cut: bool = True, held: int = HELD):
        if min(limits) < 1:
            raise ValueError("limits are 1 at least")
        self.limits, self.cut, self.held = limits, cut, held
        self.kinds: dict[tuple[int, int], int] = {}      # (tokens, loss) to its place in the arrays
        self.queues: list[deque] = []
        self.tokens, self.loss, self.count = (np.zeros(64, np.int64) for _ in range(3))
        self.n, self.sums = 0, [0, 0]

    def _put(self, piece: Piece) -> None:
        kind = piece.tokens, piece.loss
        k = self.kinds.get(kind)
        if k is None:
            if len(self.kinds) > 4 * self.held:      # kinds that ran out go
                self._tidy()
            k = self.kinds[kind] = len(self.queues)
            if k == len(self.tokens):
                self.tokens, self.loss, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.tokens, self.loss, self.count))
            self.queues.append(deque())
            self.tokens[k], self.loss[k] = kind
        self.queues[k].append(piece)
        self.count[k] += 1
        self.n += 1
        self.sums = [self.sums[0] + kind[0], self.sums[1] + kind[1]]

    def _tidy(self) -> None:
        pieces = [p for q in self.queues for p in q]
        self.kinds, self.queues, self.n, self.sums = {}, [], 0, [0, 0]
        self.count[:] = 0
        for p in pieces:
            self._put(p)

    def _take(self, k: int) -> Piece:
        piece = self.queues[k].popleft()
        self.count[k] -= 1
        self.n -= 1
        self.sums = [self.sums[0] - piece.tokens, self.sums[1] - piece.loss]
        return piece

    def add(self, example, n: int, free: int):
        """Takes an example of n ids and gives the sequences that close. An example beyond a limit is cut at it."""
        at = 0
        while at < n:
            whole = Piece(example, at, n, free)
            stop = at + whole.head(self.limits.tokens, self.limits.loss)
            piece = Piece(example, at, stop, free)
            if piece.tokens == self.limits.tokens:
                yield [piece]      # full by itself
            else:
                self._put(piece)
            at = stop
        while self.n > self.held:
            yield self._sequence()

    def finish(self):
        while self.n:
            yield self._sequence()

    def _sequence(self) -> list[Piece]:
        most = self.limits
        left, pieces = list(most), []
        weight = (self.sums[0] / most.tokens ** 2, self.sums[1] / most.loss ** 2)
        while self.n and min(left[:2]) > 0:
            used = len(self.queues)
            tokens, loss, there = self.tokens[:used], self.loss[:used], self.count[:used] > 0
            # A piece is one segment, whichever it is: that dimension adds the same to every product and only limits.
            product = tokens * (weight[0] * left[0]) + loss * (weight[1] * left[2])
            fits = there & (tokens <= left[0]) & (loss <= left[2])
            if fits.any():
                piece = self._take(int(np.argmax(np.where(fits, product, -1.0))))
            elif self.cut:
                k = int(np.argmax(np.where(there, product, -1.0)))
                n = self.queues[k][0].head(left[0], left[2])
                if not n:
                    break
                whole = self._take(k)
                piece = whole._replace(stop=whole.start + n)
                self._put(whole._replace(start=piece.stop))
            else:
                break
            pieces.append(piece)
            left = [left[0] - piece.tokens, left[1] - 1, left[2] - piece.loss]
        total = most.tokens - left[0]
        if self.cut and left[0] and total & (total - 1):
            over = total - (1 << total.bit_length() - 1)
            while over:
                last = pieces.pop()
                gone = min(over, last.tokens)
                if gone < last.tokens:
                    pieces.append(last._replace(stop=last.stop - gone))
                self._put(last._replace(start=last.stop - gone))
                over -= gone
        return pieces


PIECES = "doc_id long, row_key long, start long, length long, loss long, doc_tokens long, sequence_id long, offset long, ids binary"


def packed_pieces(examples: DataFrame, tokenizer: str, limits: Limits = Limits(), cut: bool = True, prompt: str | None = None, held: int = HELD) -> DataFrame:
    """(doc_id, row_key, start, length, loss, doc_tokens, sequence_id, offset, ids) of each piece of ``examples`` (doc_id, text, perhaps a prompt).

    ``start`` counts the ids of the example before the piece, ``offset`` those of its sequence; ``ids`` are 32-bit little-endian integers.
    """
    rows = texts(examples)
    if prompt:
        key = F.xxhash64(F.col("doc_id").cast("long"), "text", prompt)
        rows = examples.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("row_key"), F.coalesce("text", F.lit("")).alias("text"),
                               F.coalesce(prompt, F.lit("")).alias("prompt"))

    def run(batches):
        from pyspark import TaskContext
        enc, packer = encoder(tokenizer), Packer(limits, cut, held)
        number, end, out, size = TaskContext.get().partitionId() << 40, array("I", [END_ID]).tobytes(), [], 0

        def rows_of(pieces):
            nonlocal number, size
            offset = 0
            for p in pieces:
                doc, key, ids = p.example
                part = ids[4 * p.start:4 * p.stop]
                out.append((doc, key, p.start, p.tokens, p.loss, len(ids) // 4, number, offset, part))
                offset, size = offset + p.tokens, size + len(part)
            number += 1

        def batch_of():
            nonlocal out, size
            cols, out, size = list(zip(*out)), [], 0
            return pa.record_batch([*(pa.array(c, pa.int64()) for c in cols[:8]), pa.array(cols[8], pa.binary())],
                                   names=["doc_id", "row_key", "start", "length", "loss", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for _, part, _, _ in slabs(batch, size=1 << 21):
                ahead = part.column("prompt").to_pylist() if prompt else [""] * part.num_rows
                for doc, key, text, before in zip(part.column("doc_id").to_pylist(), part.column("row_key").to_pylist(), part.column("text").to_pylist(), ahead):
                    lead = enc.encode(before) if before else b""
                    ids = lead + enc.encode(text) + end
                    for pieces in packer.add((doc, key, ids), len(ids) // 4, len(lead) // 4):
                        rows_of(pieces)
                        if size > 1 << 22:
                            yield batch_of()
        for pieces in packer.finish():
            rows_of(pieces)
            if size > 1 << 22:
                yield batch_of()
        if out:
            yield batch_of()
    return written(rows.mapInArrow(run, PIECES), "packed-pieces")


def sequences(pieces: DataFrame, tokens: int = Limits().tokens) -> DataFrame:
    """(sequence_id, n_tokens, n_segments, n_loss, ids, segments): one row a sequence, padded to ``tokens`` unless its length is a power of two.

    ``ids`` are 32-bit integers in binary form with zeros as padding; ``segments`` holds (doc_id, start, length, offset) of the pieces in order.
    A sequence has a bounded number of pieces, so a group is small.
    """
    part = F.struct("offset", "ids", "doc_id", "start", "length")
    one = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.count(F.lit(1)).alias("n_segments"), F.sum("loss").alias("n_loss"),
                                            F.sort_array(F.collect_list(part)).alias("p"))
    joined = F.unhex(F.array_join(F.transform("p", lambda p: F.hex(p["ids"])), ""))
    padded = F.when(F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0, F.lit(0)).otherwise(F.lit(tokens) - F.col("n_tokens"))
    return one.select("sequence_id", "n_tokens", "n_segments", "n_loss",
                      F.unhex(F.concat(F.hex(joined), F.repeat(F.lit("00000000"), padded.cast("int")))).alias("ids"),
                      F.transform("p", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["length"].alias("length"), p["offset"].alias("offset"))).alias("segments"))
