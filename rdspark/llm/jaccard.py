"""Exact Jaccard self-join of documents on word shingles by parity sketches.

A document's set of shingle hashes is cut by hash range into m blocks, and the hashes of a block are XORed to one word: a sketch whose words
are parities of tokens. Two words differ only if some token of the symmetric difference falls into the block, so the number of differing
words bounds the symmetric difference from below. Sets that link have a symmetric difference of at most
D = (1 - t) / (1 + t) * (|A| + |B|); with m > D blocks at least m - D words are equal (pigeonhole). Words of non-empty blocks are the join keys.

* Size bands. Sets of 2^b .. 2^(b+1) - 1 shingles meet under one D; pairs across a border meet under keys of their own, which only sets within
  the similarity of the border get.
* Common shingles. Those that a sample of the corpus finds in many documents are left out of the words: dropping the same tokens from
  both sets cannot raise their difference, so nothing is lost, and a passage that many documents share makes no keys. Which tokens
  are dropped decides the cost, never the result.
* A set with too few non-empty blocks (D or fewer) also joins under the words of all its tokens; if these are too few as well,
  under its tokens themselves. Two sets that both lack blocks meet there.
* Documents with equal sets are one class before anything is joined, and a task gives the keys of a class once.
* Of the documents that share a word only pairs with one leader are checked, the same leader wherever it occurs, so a group of near copies
  costs about one pair a member. Where a run, the documents that share a word with one leader, is then not in one component, its sketches meet inside a task, long
  runs in blocks of bounded bytes: only pairs across components within D become rows, first the nearest of any two components, then what is left.

Candidates must pass by their sizes and by the Hamming distance of longer sketches, of 2 to 4 bits a token; the rest are verified by the sizes of the true
intersections. Classes are named by a 64-bit hash of the set.

Defined results: null and empty texts have no shingles and are linked with nothing; rows with equal sets are linked whatever their ids;
rows without an id take part but name no component, unless none in it has an id (then null); an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rdspark.llm.components import components
from rdspark.llm.keys import BLOB, Packer, names_of, unpacked
from rdspark.llm.tables import buckets, columns, fresh, texts, written
from rdspark.llm.words import mix, shingle_sets, slabs, word_hashes

SIMILARITY, SHINGLE = 80, 5
#: The sample that finds common shingles is one document in SAMPLE_SHARE, and SAMPLE at least; a shingle in HEAVY of them is common. So a shingle becomes
#: common at the same number of documents in corpora of any size. At most HEAVY_LIST are left out.
SAMPLE, SAMPLE_SHARE, HEAVY, HEAVY_LIST = 4000, 12, 8, 1 << 19
#: Least and most bits of a bitmap, both as powers of two.
BITS, MOST_BITS = 23, 28
#: Keys that a task holds before it hands them on, and about as many as a bucket gets.
HELD, BUCKET_KEYS = 1 << 19, 1 << 20
#: Rounds of the nearest pair between two components before all that are left are verified.
PAIR_ROUNDS = 1
#: Bytes of sketches of one block of a run, and pairs that a task holds before it reduces them.
BLOCK_BYTES, HELD_PAIRS = 1 << 21, 1 << 17
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def most_different(size_sum: int, similarity: int) -> int:
    """Largest symmetric difference of two linked sets with these sizes together."""
    return (100 - similarity) * size_sum // (100 + similarity)


def spaces(n: int, similarity: int) -> list[tuple[int, int]]:
    """(key space, D) that a set of n shingles joins in."""
    band = n.bit_length() - 1
    low, high = 1 << band, (2 << band) - 1
    out = [(2 * band, most_different(2 * high, similarity))]
    if 100 * n >= similarity * (high + 1):
        out.append((2 * band + 1, most_different(high + 100 * high // similarity, similarity)))
    if low > 1 and similarity * n <= 100 * (low - 1):
        out.append((2 * band - 1, most_different(low - 1 + 100 * (low - 1) // similarity, similarity)))
    return out


def block_words(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, word) of the non-empty blocks of a sorted set."""
    if not len(s):
        return np.zeros(0, np.uint64), s
    block = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    return block[first], np.bitwise_xor.reduceat(s, first)


def keys_of(s: np.ndarray, common: np.ndarray, similarity: int) -> np.ndarray:
    """All join keys of a set."""
    rest = s
    if len(common) and len(s):
        rest = s[common[np.minimum(np.searchsorted(common, s), len(common) - 1)] != s]
    out = []

    def add(space, level, block, word):
        out.append(mix(word ^ mix((block << np.uint64(12)) + np.uint64(space * 4 + level)) * _GOLD))
    for space, d in spaces(len(s), similarity):
        m = 1 if d == 0 else d + 1 + -(-3 * d // 10)
        block, word = block_words(rest, m)
        add(space, 0, block, word)
        if len(block) <= d:
            block, word = block_words(s, m)
            add(space, 1, block, word)
            if len(block) <= d:
                add(space, 2, np.zeros(len(s), np.uint64), s)
    return np.concatenate(out)


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """Bits of a set: bit k is the parity of the tokens whose hash is k modulo the number of bits, a power of two from 2 n to 4 n."""
    bits = 1 << max(8, int(2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little")


def hamming(a: np.ndarray, b: np.ndarray) -> int:
    """Distance of two sketches; the longer one is folded to the length of the shorter, which is its sketch of that length."""
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def set_class(s: np.ndarray) -> int:
    """64-bit name of a set; 0 for the empty one."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        both = np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s)), np.bitwise_xor.reduce(mix(s ^ _GOLD))], np.uint64)
    name = int(mix(np.array([both[0] ^ (mix(both[1:])[0])], np.uint64))[0])
    return (name or 1) - (1 << 64 if name >= 1 << 63 else 0)


def _sets(batch: pa.RecordBatch):
    for _, part, data, offs in slabs(batch):
        h, before = word_hashes(data, offs, lower=True)
        yield part, shingle_sets(h, before, SHINGLE)


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, class, n, sample) of each row: ``sample`` holds the set of the rows drawn to find common shingles."""
    n = docs.select(F.lit(1)).count()
    share = min(1.0, max(SAMPLE, n / SAMPLE_SHARE) / max(n, 1))

    def run(batches):
        for batch in batches:
            for part, sets in _sets(batch):
                drawn = mix(part.column("row_key").to_numpy().view(np.uint64)).astype(np.float64) < share * 2.0 ** 64
                names, sizes, sample = [], [], []
                for s, d in zip(sets, drawn):
                    names.append(set_class(s))
                    sizes.append(len(s))
                    sample.append(s.tobytes() if d else None)
                yield pa.record_batch([part.column("doc_id"), part.column("row_key"), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()),
                                       pa.array(sample, pa.binary())], names=["doc_id", "row_key", "class", "n", "sample"])
    return written(texts(docs).mapInArrow(run, "doc_id long, row_key long, class long, n long, sample binary"), "classes")


def common_shingles(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that many sampled documents hold; a list of bounded length."""
    def run(batches):
        for batch in batches:
            for x in batch.column("sample"):
                yield pa.record_batch([pa.array(np.frombuffer(x.as_buffer(), np.int64))], names=["s"])
    found = (rows.where("sample is not null").dropDuplicates(["class"]).select("sample").mapInArrow(run, "s long")
             .groupBy("s").count().where(F.col("count") >= HEAVY).orderBy(F.desc("count"), "s").limit(HEAVY_LIST))
    return np.sort(found.select("s").toArrow().column("s").to_numpy().view(np.uint64))


class Representatives(NamedTuple):
    """Rows (class, row_key, n) of the classes that are not empty, their number and that of the shingles of all of them."""

    rows: DataFrame
    number: int
    shingles: int


def representatives(rows: DataFrame) -> Representatives:
    """Each class that is not empty; the row with the least key stands for it."""
    found = written(rows.where("n > 0").groupBy("class").agg(F.min("row_key").alias("row_key"), F.max("n").alias("n")), "representatives")
    total = found.agg(F.count(F.lit(1)).alias("number"), F.coalesce(F.sum("n"), F.lit(0)).alias("shingles")).first()
    return Representatives(found, total["number"], total["shingles"])


def candidates(docs: DataFrame, reps: Representatives, common: np.ndarray, similarity: int) -> DataFrame:
    """(a, b): pairs of a run's leader and another class of it, where a run is the classes that have a key in common.

    Keys are made from the rows that stand for their class, and there are as many buckets as the shingles of all classes need. Where keys meet, owners
    are known by number; the pairs get the names after.
    """
    spark = docs.sparkSession
    n_buckets = buckets(spark, reps.shingles / BUCKET_KEYS)
    shared = spark.sparkContext.broadcast(common)      # bounded by HEAVY_LIST
    chosen = spark.sparkContext.broadcast(_bitmap(reps.rows.select("row_key"), _bits(reps.number)))

    def pack(batches):
        packer, seen = Packer(n_buckets), set()
        for batch in batches:
            batch = _chosen(batch, chosen.value)
            for _, sets in _sets(batch):
                for s in sets:
                    if len(s):
                        name = set_class(s)
                        if name not in seen:
                            seen.add(name)
                            packer.add(name & 0xFFFFFFFFFFFFFFFF, keys_of(s, shared.value, similarity))
                            if packer.full or packer.held >= HELD:
                                yield packer.blobs()
                                seen = set()
        yield packer.blobs()

    def meet(table: pa.Table) -> pa.Table:
        named = table.column("bucket")[0].as_py() >= n_buckets
        pairs = np.stack(names_of(table), 1) if named else star(*unpacked(table))
        return pa.table({"a": pa.array(pairs[:, 0].view(np.int64)), "b": pa.array(pairs[:, 1].view(np.int64)), "named": pa.array(np.full(len(pairs), named))})
    blobs = texts(docs).mapInArrow(pack, BLOB)
    met = written(blobs.groupBy("bucket").applyInArrow(meet, "a long, b long, named boolean"), "candidates")
    names = met.where("named").select("a", "b").distinct()
    missing = F.raise_error(F.lit("an owner of keys has no name: the rows of documents changed while they were read")).cast("long")
    one = lambda k: names.select(F.col("a").alias(k), F.col("b").alias(f"n{k}"))
    found = met.where("not named").select("a", "b").distinct().join(one("a"), "a", "left").join(one("b"), "b", "left")
    return found.select(F.coalesce("na", missing).alias("a"), F.coalesce("nb", missing).alias("b")).where("a <> b").distinct()


def star(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Rows (leader, other) of the owners of each key, sorted by key; the leader is the owner with the least rank, which is the same for all keys."""
    rank = mix(owner)
    order = np.lexsort((rank, key))
    key, owner = key[order], owner[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    leader = np.repeat(owner[first], np.diff(np.r_[first, len(key)]).astype(int))
    pairs = np.stack([leader, owner], 1)[leader != owner]
    return np.ascontiguousarray(np.unique(pairs, axis=0)) if len(pairs) else np.zeros((0, 2), np.uint64)


def _bits(count: int) -> int:
    """Bits of a bitmap for so many values: a power of two, about 16 to 32 a value between the least and most allowed."""
    return 1 << min(max(BITS, (16 * count).bit_length()), MOST_BITS)


def _bitmap(values: DataFrame, n_bits: int) -> np.ndarray:
    """Packed bits, those at the values of the one column modulo ``n_bits`` set: at most 2^MOST_BITS of them."""
    at = F.pmod(F.col(values.columns[0]), F.lit(n_bits))
    parts = values.groupBy(F.floor(at / 32768).alias("part")).agg(F.bitmap_construct_agg(at % 32768).alias("bits")).collect()
    bits = np.zeros(n_bits >> 3, np.uint8)
    for p in parts:
        bits[p["part"] << 12:(p["part"] + 1) << 12] = np.frombuffer(p["bits"], np.uint8)
    return bits


def _is_set(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.mod(values, len(bits) << 3)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _chosen(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    return batch.filter(pa.array(_is_set(bits, batch.column("row_key").to_numpy()), pa.bool_()))


def sets_of(docs: DataFrame, reps: Representatives, wanted: DataFrame, sketch: bool) -> DataFrame:
    """(class, n, value) of the wanted classes, each from the row that stands for it: the sketch of its set, or the set. A bitmap spares other rows."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(reps.rows.join(wanted, "class").select("row_key"), _bits(reps.number)))

    def run(batches):
        seen = set()      # a task gives a class once; what several tasks give is equal
        for batch in batches:
            batch = _chosen(batch, shared.value)
            for _, sets in _sets(batch):
                rows_ = []
                for s in sets:
                    name = set_class(s)
                    if len(s) and name not in seen:
                        seen.add(name)
                        rows_.append((name, len(s), parity_sketch(s).tobytes() if sketch else s.tobytes()))
                yield pa.record_batch([pa.array([r[k] for r in rows_], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["class", "n", "value"])
    return written(texts(docs).mapInArrow(run, "class long, n long, value binary"), "sets")


def _classes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()


def near_pairs(pairs: DataFrame, sketches: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b, ...) that sizes and the Hamming distance of the sketches leave possible, with that ``distance``."""
    one = lambda k: sketches.select(F.col("class").alias(k), F.col("n").alias(f"n{k}"), F.col("value").alias(f"s{k}")).dropDuplicates([k])
    met = pairs.join(one("a"), "a").join(one("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * similarity)
    keep = pairs.columns

    def run(batches):
        for batch in batches:
            d = [hamming(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) for x, y in zip(batch.column("sa"), batch.column("sb"))]
            most = [most_different(x + y, similarity) for x, y in zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist())]
            out = batch.select(keep).append_column("distance", pa.array(d, pa.int64()))
            yield out.filter(pa.array([x <= m for x, m in zip(d, most)], pa.bool_()))
    return met.mapInArrow(run, pairs.withColumn("distance", F.lit(0).cast("long")).schema)


class ClassSets:
    """The sets of classes, written when a pair first needs them and kept for later rounds."""

    def __init__(self, docs: DataFrame, reps: Representatives):
        self.docs, self.reps, self.made = docs, reps, None

    def of(self, wanted: DataFrame) -> DataFrame:
        """(class, value) of at least the wanted classes, one row each."""
        if self.made is not None:
            wanted = wanted.join(self.made.select("class").distinct(), "class", "left_anti")
        if self.made is None or not wanted.isEmpty():
            new = sets_of(self.docs, self.reps, wanted, sketch=False)
            self.made = new if self.made is None else self.made.unionByName(new)
        return self.made.select("class", "value").dropDuplicates(["class"])


def linked(sets: ClassSets, pairs: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b, ...) of classes whose sets are similar enough. Only the sets of these pairs are made and moved."""
    wanted = written(_classes_of(pairs), "wanted")
    values = sets.of(wanted).join(wanted, "class", "left_semi")
    met = pairs.join(values.select(F.col("class").alias("b"), F.col("value").alias("tb")), "b").join(
        values.select(F.col("class").alias("a"), F.col("value").alias("ta")), "a")
    keep = pairs.columns

    def run(batches):
        for batch in batches:
            similar = []
            for x, y in zip(batch.column("ta"), batch.column("tb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                similar.append(100 * common >= similarity * (len(x) + len(y) - common))
            yield batch.select(keep).filter(pa.array(similar, pa.bool_()))
    return met.select(*keep, "ta", "tb").mapInArrow(run, pairs.schema)


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` with the roots ra and rb of their components."""
    side = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"r{k}"))
    met = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return met.withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")})


def _with_roots(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` of different components, with their roots ra and rb."""
    return _rooted(pairs, roots).where("ra <> rb")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots after links (ra, rb) between components: a small graph."""
    moved = components(links, "ra", "rb").select(F.col("node").alias("old"), F.col("root").alias("new"))
    return written(roots.join(moved, roots["root"] == moved["old"], "full").select(
        F.coalesce("node", "old").alias("node"), F.coalesce("new", "root").alias("root")), "roots")


def settled(sets: ClassSets, roots: DataFrame, pairs: DataFrame, similarity: int) -> DataFrame:
    """Components after all links among ``pairs`` (a, b, distance): of the pairs between two components the nearest is tried first."""
    for turn in range(PAIR_ROUNDS + 1):
        pairs = written(_with_roots(pairs.select("a", "b", "distance"), roots), "pairs")
        if pairs.isEmpty():
            return roots
        last = turn == PAIR_ROUNDS
        tried = pairs if last else written(_nearest(pairs), "tried")
        roots = _joined(sets, roots, tried, similarity)
        if last:
            return roots
        pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
    return roots


def _nearest(pairs: DataFrame) -> DataFrame:
    """The nearest of the pairs (a, b, distance, ra, rb) between any two components."""
    return pairs.groupBy(F.least("ra", "rb").alias("x"), F.greatest("ra", "rb").alias("y")).agg(
        F.min(F.struct("distance", "a", "b", "ra", "rb")).alias("p")).select("p.*")


def _joined(sets: ClassSets, roots: DataFrame, tried: DataFrame, similarity: int) -> DataFrame:
    """Roots after the links among the written pairs ``tried`` (a, b, ra, rb)."""
    return _merged(roots, linked(sets, tried.select("a", "b", "ra", "rb"), similarity).select("ra", "rb"))


def open_runs(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(run, class) of the leaders among ``pairs`` (a, b) that have two classes or more, some of them in another component. A run goes by its leader, so
    the runs of one leader are one: a class is in it once, however many keys it shares."""
    several = _rooted(pairs.select("a", "b"), roots).groupBy(F.col("a").alias("run")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("ra") != F.col("rb")).alias("apart")).where("n > 1 and apart").select("run")
    others = pairs.select(F.col("a").alias("run"), F.col("b").alias("class")).join(several, "run", "left_semi")
    return others.unionByName(several.select("run", F.col("run").alias("class")))


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    while len(sketch) > size:
        sketch = sketch[:len(sketch) // 2] ^ sketch[len(sketch) // 2:]
    return sketch


def sieved(names: np.ndarray, roots: np.ndarray, sizes: np.ndarray, sides: np.ndarray, sketches: list, similarity: int):
    """Arrays (a, b, ra, rb, distance) of the pairs across components that sizes and sketches leave possible, a row of the block at a time.

    If both sides, 0 and 1, occur, pairs are between them. Rows go by the length of their sketch; those of longer ones are folded to it.
    """
    lengths = np.array([len(x) for x in sketches])
    order = np.argsort(lengths, kind="stable")
    names, roots, sizes, sides, lengths = names[order], roots[order], sizes[order], sides[order], lengths[order]
    both = len(np.unique(sides)) > 1
    for length in np.unique(lengths):
        first, end = np.searchsorted(lengths, length), np.searchsorted(lengths, length, "right")
        table = np.stack([_folded(np.frombuffer(sketches[k], np.uint8), length) for k in order[first:]]).view(np.uint64)
        for i in range(first, end):
            j = np.flatnonzero(roots[i + 1:] != roots[i]) + i + 1
            if both:
                j = j[sides[j] != sides[i]]
            j = j[100 * np.minimum(sizes[j], sizes[i]) >= similarity * np.maximum(sizes[j], sizes[i])]
            if len(j):
                distance = np.bitwise_count(table[j - first] ^ table[i - first]).sum(1, dtype=np.int64)
                near = distance <= (100 - similarity) * (sizes[j] + sizes[i]) // (100 + similarity)
                j = j[near]
                if len(j):
                    yield np.full(len(j), names[i]), names[j], np.full(len(j), roots[i]), roots[j], distance[near]


def _nearest_pairs(found: list) -> list:
    """Of the arrays (a, b, ra, rb, distance) the nearest pair of any two components."""
    a, b, ra, rb, d = (np.concatenate(x) for x in zip(*found))
    x, y = np.minimum(ra, rb), np.maximum(ra, rb)
    order = np.lexsort((d, y, x))
    keep = order[np.r_[True, (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])]]
    return [(a[keep], b[keep], ra[keep], rb[keep], d[keep])]


def across(runs: DataFrame, sketches: DataFrame, similarity: int, nearest: bool) -> DataFrame:
    """(a, b, ra, rb, distance) of the pairs in the runs (run, class, root) that lie across components and may be similar; ``nearest``: one of
    any two components and block. The members of a run meet in blocks of BLOCK_BYTES of sketches, each two blocks of a long run in a task of their own."""
    return across_and_runs(runs, sketches, similarity, nearest).where("run is null").drop("run")


def across_and_runs(runs: DataFrame, sketches: DataFrame, similarity: int, nearest: bool) -> DataFrame:
    """The rows of ``across`` with an empty column ``run``, and rows of ``run`` alone that name the runs with such pairs."""
    spark = runs.sparkSession
    one = sketches.select("class", "n", "value").dropDuplicates(["class"])
    met = written(runs.join(one, "class"), "run-sketches")
    parts = met.groupBy("run").agg(F.ceil(F.sum(F.length("value")) / BLOCK_BYTES).cast("int").alias("parts")).where("parts > 1")
    placed = met.join(parts, "run", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("p", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    dealt = placed.select("run", "class", "root", "n", "value", "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q")).select(
        "run", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), F.when(F.col("p") > F.col("q"), 1).otherwise(0).alias("side"), "class", "root", "n", "value")
    dealt = dealt.repartition(buckets(spark), "run", "x", "y").sortWithinPartitions("run", "x", "y")

    def groups(batches):
        held, name = [], None
        for batch in batches:
            ids = np.stack([batch.column(k).to_numpy() for k in range(3)]) if batch.num_rows else np.zeros((3, 0), np.int64)
            cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1), batch.num_rows]
            for k, end in zip(cuts[:-1], cuts[1:]):
                if end > k:
                    if held and tuple(ids[:, k]) != name:
                        yield held
                        held = []
                    held.append(batch.slice(k, end - k))
                    name = tuple(ids[:, k])
        if held:
            yield held

    def run(batches):
        names = ["a", "b", "ra", "rb", "distance", "run"]

        def batch_of(found):
            cols = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found)]
            return pa.record_batch([*cols, pa.nulls(len(cols[0]), pa.int64())], names=names)

        def named(runs_):
            return pa.record_batch([*[pa.nulls(len(runs_), pa.int64())] * 5, pa.array(runs_, pa.int64())], names=names)
        out, count, with_pairs = [], 0, []
        for group in groups(batches):
            run_, any_ = group[0].column(0)[0].as_py(), False
            side, name, root, n = (np.concatenate([b.column(k).to_numpy() for b in group]).astype(np.int64) for k in range(3, 7))
            if (group[0].column(1)[0] != group[0].column(2)[0]) and len(np.unique(side)) < 2:
                continue      # no member of one of the two blocks
            values = [v.as_buffer() for b in group for v in b.column(7)]
            for pairs in sieved(name, root, n, side, values, similarity):
                out.append(pairs)
                count, any_ = count + len(pairs[0]), True
                if count >= HELD_PAIRS:
                    if nearest:
                        out = _nearest_pairs(out)
                        count = len(out[0][0])
                    if count >= HELD_PAIRS // 2:
                        yield batch_of(out)
                        out, count = [], 0
            if any_:
                with_pairs.append(run_)
                if len(with_pairs) >= HELD_PAIRS:
                    yield named(with_pairs)
                    with_pairs = []
        if out:
            yield batch_of(_nearest_pairs(out) if nearest else out)
        if with_pairs:
            yield named(with_pairs)
    return dealt.mapInArrow(run, "a long, b long, ra long, rb long, distance long, run long")


def class_links(docs: DataFrame, rows: DataFrame, similarity: int) -> DataFrame:
    """(node, root): components of the classes that have links."""
    reps = representatives(rows)
    pairs = written(candidates(docs, reps, common_shingles(rows), similarity), "star-pairs")
    sketches, sets = sets_of(docs, reps, _classes_of(pairs), sketch=True), ClassSets(docs, reps)
    near = written(near_pairs(pairs, sketches, similarity), "near")
    # One leader for each member first, the nearest; what that leaves apart is tried after.
    first = near.groupBy("b").agg(F.min(F.struct("distance", F.xxhash64("a").alias("h"), "a"))["a"].alias("a"))
    roots = written(components(linked(sets, written(first.select("a", "b"), "first"), similarity), "a", "b"), "roots")
    roots = settled(sets, roots, near, similarity)
    runs = written(open_runs(pairs, roots), "runs")
    for nearest in (True, False):
        named = runs.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        if not nearest:      # runs that are not in one component yet; at first all are apart
            open_ = named.groupBy("run").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("run")
            named = named.join(open_, "run")
        found = written(across_and_runs(named.select("run", "class", "root"), sketches, similarity, nearest), "found")
        # A run without a pair that may be similar has none either when more components are one.
        runs = runs.join(found.where("run is not null").select("run").distinct(), "run", "left_semi")
        left = found.where("run is null")
        left = written(_nearest(left) if nearest else left.select("a", "b", "ra", "rb").distinct(), "across")
        if left.isEmpty():
            break
        roots = _joined(sets, roots, left, similarity)
    return roots


def _rows_and_roots(docs: DataFrame, similarity: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row_key, class, n), one row per row of ``docs``, and (class, root) of the classes that have links. The root names the component
    whether its rows have ids or not."""
    if not 50 <= similarity <= 100:
        raise ValueError("similarity must be 50 to 100 percent")
    rows = classes(docs)
    roots = class_links(docs, rows, similarity)
    return rows.select("doc_id", "row_key", "class", "n"), roots.withColumnRenamed("node", "class")


def similar_documents(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, row_key, n_shingles, component_id), one row per row of ``docs`` (doc_id, text)."""
    rows, roots = _rows_and_roots(docs, similarity)
    per_class = rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    named = per_class.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("class", "component_id")
    return rows.join(named, "class", "left").select(
        "doc_id", "row_key", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def kept_documents(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (then row key). Rows without words stay; repeated rows come once."""
    rows, roots = _rows_and_roots(docs, similarity)
    # The least row of each class, a row without words by itself; then of each component.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    first = rows.groupBy("class", F.when(F.col("n") == 0, F.col("row_key")).alias("alone")).agg(least.alias("first"))
    first = first.join(roots, "class", "left").groupBy(F.coalesce("root", "class").alias("root"), "alone").agg(F.min("first")["row_key"].alias("row_key"))
    name = fresh(docs, "_row_key")
    keep = first.select(F.col("row_key").alias(name))
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").isNull(), F.coalesce("text", F.lit("")))
    return docs.select(*columns(docs), key.alias(name)).join(keep, name).dropDuplicates([name]).select(*columns(docs))
