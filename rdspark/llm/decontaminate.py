"""Benchmark passages in documents: latent semantic retrieval, then longest common subsequence and answer words.

1. Document frequencies of hashed words are counted over all documents.
2. A latent space is fitted by randomised SVD of TF-IDF passages: the benchmark's and those of all documents, which weigh as much as
   ``FIT_DOCUMENTS`` of them. Tasks multiply their passages with the test matrix and send sums by feature; the driver holds FEATURES x RANK numbers.
3. Every document is read whole: windows of 16 to 64 words, every 8 words, go into the latent space and meet all benchmark passages of their
   length by cosine. Stretches around windows above ``COSINE`` are candidates.
   Passages under EXACT words are thin in a window of 16, so each run of words equal to one is a candidate too, with cosine 1.
4. A candidate counts if the longest common subsequence covers ``SHARE`` of the passage's words and at least half of its answer words occur
   nearby: the words of an ``answer`` column, or else five of the passage's rarest words.

The benchmark is dealt in blocks of ``BLOCK`` passages, each one scan, so what is broadcast is bounded. Items of more than 48 words are several passages.

Defined results: null or empty documents and items match nothing; passages under eight words must occur in full (as a run, or
with words between where a window finds them); rows without doc_id are reported with a
null id, items without item_id too, one row for each such item; rows with one item_id are one item, whose answers each go with their own text; repeated rows are reported each; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rdspark.llm.cnn import word_ids
from rdspark.llm.tables import columns, fresh, texts, written
from rdspark.llm.words import LOWER, NOT_ALNUM, _STEP as GRAM, hashes, slabs, spans

FEATURES, RANK = 1 << 15, 64
FIT_DOCUMENTS, BENCHMARK_WEIGHT, PASSAGE, STEP = 200, 6, 48, 8
COSINE, SHARE, ANSWER_WORDS = 0.35, 0.6, 5
WINDOW_BLOCKS = (2, 3, 4, 6, 8)
BLOCK = 20_000
SUMMED = 1 << 11      # words whose products a task forms at once
#: Passages of fewer words are also looked up as runs of words. Bits of the bitmap that sieves them.
EXACT, SIEVE = 16, 20


def _hashed(data, offs):
    data = LOWER[data]
    starts, ends, before = spans(data, offs, NOT_ALNUM)
    return hashes(data, starts, ends), before


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold each feature, documents)."""
    def run(batches):
        total = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for _, _, data, offs in slabs(batch):
                ids, before = word_ids(data, offs, FEATURES)
                key = np.sort(np.repeat(np.arange(len(offs) - 1), np.diff(before)) * FEATURES + ids)
                key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
                total[:FEATURES] += np.bincount(key % FEATURES, minlength=FEATURES)
                total[FEATURES] += len(offs) - 1
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["feature", "n"])
    got = texts(docs).select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(FEATURES + 1, np.int64)      # FEATURES + 1 rows at most
    out[got.column("feature").to_numpy()] = got.column("n").to_numpy()
    return out[:FEATURES], int(out[FEATURES])


def passages(docs: DataFrame, key: str, most: int = PASSAGE) -> DataFrame:
    """(key, part, words): passages of at most ``most`` words as 64-bit word hashes."""
    def run(batches):
        for batch in batches:
            for _, part, data, offs in slabs(batch):
                h, before = _hashed(data, offs)
                rows = []
                for k, (a, b) in enumerate(zip(before[:-1], before[1:])):
                    pieces = max(1, -(-int(b - a) // most))
                    edges = np.linspace(a, b, pieces + 1).astype(int)
                    rows += [(k, j, h[x:y].tobytes()) for j, (x, y) in enumerate(zip(edges[:-1], edges[1:])) if y > x]
                yield pa.record_batch([part.column(key).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int32()),
                                       pa.array([r[2] for r in rows], pa.binary())], names=[key, "part", "words"])
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, f"{key} long, part int, words binary")


def _products(ids: np.ndarray, before: np.ndarray, weight: np.ndarray, matrix: np.ndarray, total: np.ndarray, touched: np.ndarray) -> None:
    """Adds A'(A M) of passages to ``total``: rows of A are their vectors of TF-IDF, ``matrix`` is M. Every passage has words."""
    features, place = np.unique(ids, return_inverse=True)
    rows = len(before) - 1
    # The passages as a small dense matrix over the features they hold.
    x = np.bincount(np.repeat(np.arange(rows), np.diff(before)) * len(features) + place, minlength=rows * len(features)).reshape(rows, -1) * weight[features]
    # A word that a passage repeats is one entry for each time: its norm is that of the sequence.
    norm = np.add.reduceat(weight[ids] ** 2, before[:-1])
    x = (x / np.sqrt(np.maximum(norm, 1e-24))[:, None]).astype(np.float32)
    total[features] += x.T @ (x @ matrix[features])
    touched[features] = True


def _passage_ends(before: np.ndarray, most: int = PASSAGE) -> np.ndarray:
    """Where passages of at most ``most`` words begin, rows cut evenly, and the end of the last one."""
    n = np.diff(before)
    pieces = -(-n // most)
    j = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.r_[np.repeat(before[:-1], pieces) + j * np.repeat(n, pieces) // np.repeat(np.maximum(pieces, 1), pieces), before[-1]]


def _summed(rows: DataFrame, weight: np.ndarray, width: int, seed: int) -> np.ndarray:
    """FEATURES x width: A'(A M) of all passages of the texts of ``rows``, M the test matrix. Tasks send the features they have touched, in blocks of 1024."""
    def run(batches):
        total, touched = None, np.zeros(FEATURES, bool)
        for batch in batches:
            for _, _, data, offs in slabs(batch):
                h, before = _hashed(data, offs)
                if not len(h):
                    continue
                if total is None:
                    total = np.zeros((FEATURES, width), np.float32)
                ids, ends = (h % np.uint64(FEATURES)).astype(np.int64), _passage_ends(before)
                k = 0
                while k + 1 < len(ends):      # some passages at a time, so their products stay small
                    last = max(k + 1, int(np.searchsorted(ends, ends[k] + SUMMED, "right")) - 1)
                    _products(ids[ends[k]:ends[last]], ends[k:last + 1] - ends[k], weight, _test_matrix(width, seed), total, touched)
                    k = last
        if total is not None:
            at = np.flatnonzero(touched)
            for part in np.split(at, np.flatnonzero(np.diff(at >> 10)) + 1):
                yield pa.record_batch([pa.array([part[0] >> 10], pa.int32()), pa.array([part.astype(np.int32).tobytes()], pa.binary()),
                                       pa.array([total[part].tobytes()], pa.binary())], names=["block", "at", "sums"])

    def add(table: pa.Table) -> pa.Table:
        sums = np.zeros((1024, width), np.float32)
        for at, x in zip(table.column("at"), table.column("sums")):
            sums[np.frombuffer(at.as_buffer(), np.int32) & 1023] += np.frombuffer(x.as_buffer(), np.float32).reshape(-1, width)
        return pa.table({"block": table.column("block").slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())})
    got = rows.select("text").mapInArrow(run, "block int, at binary, sums binary").groupBy("block").applyInArrow(add, "block int, sums binary").toArrow()
    out = np.zeros((FEATURES, width))
    for b, x in zip(got.column("block").to_pylist(), got.column("sums")):
        out[b << 10:(b + 1) << 10] = np.frombuffer(x.as_buffer(), np.float32).reshape(1024, width)
    return out


def latent_space(docs: DataFrame, items: DataFrame, weight: np.ndarray, n: int, rank: int = RANK, seed: int = 5) -> np.ndarray:
    """FEATURES x rank: right singular vectors of the TF-IDF passages of all documents and all items, times the weights; a passage's vector is the sum over
    its words. Documents count together like FIT_DOCUMENTS of them, items BENCHMARK_WEIGHT fold: their passages are to be told apart."""
    y = BENCHMARK_WEIGHT * _summed(items, weight, rank + 8, seed) + min(1.0, FIT_DOCUMENTS / max(n, 1)) * _summed(docs, weight, rank + 8, seed)
    # One pass (Nystroem): the products with the test matrix give the leading singular vectors by the test matrix's view of them.
    small = _test_matrix(rank + 8, seed).T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    good = values > 1e-6 * max(values.max(), 1e-12)
    if not good.any():
        return np.zeros((FEATURES, 1), np.float32)
    v = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)[0][:, :rank]
    return (v * weight[:, None]).astype(np.float32)


@lru_cache(maxsize=2)
def _test_matrix(width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(FEATURES, width)).astype(np.float32)


def common_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each word of a."""
    where: dict[int, int] = {}
    for k, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << k
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


class Passages:
    """A block of benchmark passages, ready to meet windows."""

    def __init__(self, items, parts, words, answers, space, weight):
        self.item, self.words = items, words      # (id, key)
        self.space = np.concatenate([space, np.zeros((1, space.shape[1]), np.float32)])
        z = np.stack([space[(w % np.uint64(FEATURES)).astype(int)].sum(0) for w in words]) if words else np.zeros((0, space.shape[1]), np.float32)
        self.unit = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        n = np.array([len(w) for w in words])
        self.blocks = np.array([next(w for w in WINDOW_BLOCKS if w * STEP >= x or w == WINDOW_BLOCKS[-1]) for x in n])
        self.answers = []
        for w, answer in zip(words, answers):
            if not len(answer):
                # Rarest first, by steps of a factor of four; among equals the last in the passage, where answers stand.
                distinct, last = np.unique(w[::-1], return_index=True)
                rarity = np.round(np.cbrt(weight[(distinct % np.uint64(FEATURES)).astype(int)]) / np.log(4))
                answer = distinct[np.lexsort((last, -rarity))[:ANSWER_WORDS]]
            self.answers.append(set(answer.tolist()))
        # Answer words, sorted, with the passages of each.
        self.needed = np.array([-(-len(a) // 2) for a in self.answers], np.int64)
        pairs = sorted((w, k) for k, a in enumerate(self.answers) for w in a)
        self.answer_words = np.unique(np.array([w for w, _ in pairs], np.uint64))
        self.answer_from = np.searchsorted(np.array([w for w, _ in pairs], np.uint64), self.answer_words) if pairs else np.zeros(0, int)
        self.answer_passage = np.array([k for _, k in pairs], np.int64)

        # Short passages as grams: for each number of words the sorted hashes and their passages.
        self.grams, self.sieve = {}, np.zeros(1 << SIEVE, bool)
        for length in sorted({len(w) for w in words if len(w) < EXACT}):
            own = np.array([k for k, w in enumerate(words) if len(w) == length], np.int64)
            g = np.zeros(len(own), np.uint64)
            for j in range(length):
                g = g * GRAM + np.array([words[k][j] for k in own], np.uint64)
            order = np.argsort(g, kind="stable")
            self.grams[length] = (g[order], own[order])
            self.sieve[g & np.uint64((1 << SIEVE) - 1)] = True

    def runs(self, h: np.ndarray, before: np.ndarray) -> set:
        """(row, passage, start of the step) of each run of words that is a short passage."""
        found: set = set()
        g = np.zeros(len(h), np.uint64)
        for length in range(1, max(self.grams, default=0) + 1):
            if length > len(h):
                break
            g = g[:len(h) - length + 1] * GRAM + h[length - 1:]
            if length not in self.grams:
                continue
            known, passage = self.grams[length]
            at = np.flatnonzero(self.sieve[g & np.uint64((1 << SIEVE) - 1)])
            first, last = np.searchsorted(known, g[at], "left"), np.searchsorted(known, g[at], "right")
            row = np.searchsorted(before, at, "right") - 1
            hit = np.flatnonzero((last > first) & (at + length <= before[row + 1]))
            steps = (at[hit] - before[row[hit]]) // STEP * STEP
            for r, s, a, b in set(zip(row[hit].tolist(), steps.tolist(), first[hit].tolist(), last[hit].tolist())):
                found.update((r, p, s) for p in passage[a:b].tolist())
        return found

    def answered(self, h: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Rows x passages: whether a document holds at least half of a passage's answer words anywhere."""
        rows, known = len(before) - 1, self.answer_words
        count = np.zeros((rows, len(self.answers)), np.int64)
        if len(known) and len(h):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = np.flatnonzero(known[at] == h)
            row = np.searchsorted(before, hit, "right") - 1
            pair = np.unique(row * len(known) + at[hit])
            row, word = pair // len(known), pair % len(known)
            n = np.diff(np.r_[self.answer_from, len(self.answer_passage)])[word]
            first = np.repeat(self.answer_from[word] - np.r_[0, np.cumsum(n)[:-1]], n)
            np.add.at(count, (np.repeat(row, n), self.answer_passage[first + np.arange(len(first))]), 1)
        return count >= self.needed

    def matches(self, h: np.ndarray, before: np.ndarray):
        """(row, passage, cosine, common words) of the passages found in the documents of a slab."""
        rows, n = len(before) - 1, np.diff(before)
        blocks = -(-n // STEP)
        gap = WINDOW_BLOCKS[-1] - 1
        first = np.r_[0, np.cumsum(blocks + gap)]      # blocks of zeros part the documents
        padded = np.full(int(blocks.sum()) * STEP, FEATURES, np.int64)
        own = np.r_[0, np.cumsum(blocks)]
        place = np.arange(len(h)) + np.repeat(own[:-1] * STEP - before[:-1], n)
        padded[place] = (h % np.uint64(FEATURES)).astype(np.int64)
        sums = self.space[padded].reshape(-1, STEP, self.space.shape[1]).sum(1)
        spread = np.zeros((int(first[-1]) + gap + 1, self.space.shape[1]), np.float32)
        spread[np.arange(len(sums)) + np.repeat(gap * np.arange(rows), blocks)] = sums
        hits: dict[tuple[int, int], list] = {}
        possible = self.answered(h, before)
        sums_of = {1: spread}      # of 1, 2, 4 and 8 blocks from each block on
        for k in (1, 2, 4):
            sums_of[2 * k] = sums_of[k][:-k] + sums_of[k][k:]
        for want in WINDOW_BLOCKS:
            pick = np.flatnonzero(self.blocks == want)
            if not len(pick):
                continue
            window = sums_of[want] if want in sums_of else sums_of[2 * want // 3][:len(spread) - want + 1] + sums_of[want // 3][2 * want // 3:]
            norm = np.linalg.norm(window, axis=1)
            live = np.flatnonzero(norm > 1e-6)
            cos = window[live] @ self.unit[pick].T
            at, which = np.nonzero(cos >= (COSINE * norm[live])[:, None])
            row = np.searchsorted(first, live[at], "right") - 1
            keep = possible[row, pick[which]]
            at, which, row = at[keep], which[keep], row[keep]
            start = (live[at] - first[row]) * STEP
            for r, p, s, c in zip(row.tolist(), pick[which].tolist(), start.tolist(), (cos[at, which] / norm[live[at]]).tolist()):
                hits.setdefault((r, p), []).append((s, c, want * STEP))
        for r, p, s in self.runs(h, before):      # from the step of its start on, a window of 16 and the words around it hold the run
            if possible[r, p]:
                hits.setdefault((r, p), []).append((s, 1.0, WINDOW_BLOCKS[0] * STEP))
        for (r, p), found in hits.items():
            a, b, words = int(before[r]), int(before[r + 1]), self.words[p].tolist()
            need = len(words) if len(words) < 8 else -(-len(words) * int(SHARE * 100) // 100)
            best, end, stretch = (0, 0.0), -1, []
            for s, c, w in sorted(found):      # windows that meet are one stretch, with some words around
                x, y = max(0, s - STEP), s + w + STEP
                if stretch and x <= stretch[-1][1] and y - stretch[-1][0] <= 4 * max(len(words), 16):
                    stretch[-1] = (stretch[-1][0], y, max(c, stretch[-1][2]))
                else:
                    stretch.append((x, y, c))
            for x, y, c in stretch:
                near = h[a + x:min(b, a + y)].tolist()
                if len(self.answers[p] & set(near)) >= self.needed[p]:
                    best = max(best, (common_length(words, near), c))
            if best[0] >= need:
                yield r, p, best[1], best[0]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, row_key, item_id, cosine, common_words, item_words): the benchmark items found in each row of ``docs``; the best passage of an item counts."""
    spark = docs.sparkSession
    frequency, n = document_frequencies(docs)
    weight = np.log((n + 1) / (frequency + 1)) ** 3 + 0.01      # cubed: common words of a language say nothing about a passage
    answer = F.coalesce(F.col("answer").cast("string"), F.lit("")) if "answer" in benchmark.columns else F.lit("")
    # Each distinct row has a key of its own, so texts and answers meet whatever their ids are; an answer comes with all its words.
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"), answer.alias("answer")).select(
        "*", F.xxhash64("item_id", F.col("item_id").isNull(), "text", "answer").alias("item_key")).dropDuplicates(["item_key"])
    answers = passages(items.select("item_key", F.col("answer").alias("text")), "item_key", 1 << 31).select("item_key", F.col("words").alias("answer"))
    parts = written(passages(items, "item_key").join(answers, "item_key", "left").join(items.select("item_key", "item_id"), "item_key"), "items")
    source = texts(docs)
    space = latent_space(source, items, weight, n)
    blocks = max(1, -(-parts.count() // BLOCK))
    found = None
    for block in range(blocks):
        got = parts.where(F.pmod(F.xxhash64("item_key", "part"), F.lit(blocks)) == block).toArrow().sort_by(
            [("item_id", "ascending"), ("item_key", "ascending"), ("part", "ascending")])
        unpack = lambda c: [np.frombuffer(x.as_buffer(), np.uint64) if x.is_valid else np.zeros(0, np.uint64) for x in got.column(c)]
        shared = spark.sparkContext.broadcast(Passages(list(zip(got.column("item_id").to_pylist(), got.column("item_key").to_pylist())), got.column("part").to_pylist(), unpack("words"), unpack("answer"),
                                                       space, weight))

        def run(batches, shared=shared):
            known = shared.value
            for batch in batches:
                for _, part, data, offs in slabs(batch):
                    h, before = _hashed(data, offs)
                    rows = list(known.matches(h, before)) if len(known.item) else []
                    at = pa.array([r[0] for r in rows], pa.int64())
                    yield pa.record_batch([part.column("doc_id").take(at), part.column("row_key").take(at), pa.array([known.item[r[1]][0] for r in rows], pa.int64()),
                                           pa.array([known.item[r[1]][1] for r in rows], pa.int64()),
                                           pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()),
                                           pa.array([len(known.words[r[1]]) for r in rows], pa.int64())],
                                          names=["doc_id", "row_key", "item_id", "item_key", "cosine", "common_words", "item_words"])
        one = source.mapInArrow(run, "doc_id long, row_key long, item_id long, item_key long, cosine double, common_words long, item_words long")
        found = one if found is None else found.unionByName(one)
    best = F.max(F.struct("common_words", "cosine", "item_words")).alias("best")
    return found.groupBy("doc_id", "row_key", "item_id", F.when(F.col("item_id").isNull(), F.col("item_key")).alias("item_key")).agg(best).select(
        "doc_id", "row_key", "item_id", F.col("best.cosine").alias("cosine"), F.col("best.common_words").alias("common_words"),
        F.col("best.item_words").alias("item_words"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item. Their keys are few rows; Spark picks the join."""
    name = fresh(docs, "_row_key")
    bad = contaminated(docs, benchmark).select(F.col("row_key").alias(name)).distinct()
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").isNull(), F.coalesce("text", F.lit("")))
    return docs.select(*columns(docs), key.alias(name)).join(bad, name, "left_anti").select(*columns(docs))
