"""Keys cost the same bytes however many buckets there are, a leader's runs are one, and workers keep no chunks of texts after their task."""

from __future__ import annotations

import random

import numpy as np
import plain
import pyarrow as pa
import pytest
from rdspark.llm import jaccard, keys, tokens
from rdspark.llm.queries import tokenizer_path


def packed(sets, buckets):
    packer = keys.Packer(buckets)
    for name, s in sets:
        packer.add(name, s)
    return packer.blobs()


@pytest.mark.parametrize("buckets", [1, 7, 3000])
def test_packed_keys_meet_as_the_keys_do(buckets):
    r = np.random.default_rng(buckets)
    pool = r.integers(0, 1 << 64, 4000, dtype=np.uint64)
    sets = [(int(n), pool[r.permutation(4000)[:int(k)]]) for n, k in zip(r.integers(0, 1 << 64, 900, dtype=np.uint64), r.integers(0, 9, 900))]
    table = pa.Table.from_batches([packed(sets[:500], buckets), packed(sets[500:], buckets)])
    number = np.array(table.column("bucket"))
    local, name = keys.names_of(table.filter(pa.array(number >= buckets)))
    names = dict(zip(local.tolist(), name.tolist()))
    assert len(names) == 900
    got: set = set()
    for b in np.unique(number[number < buckets]):
        key, owner = keys.unpacked(table.filter(pa.array(number == b)))
        got |= {(k, names[o]) for k, o in zip(key.tolist(), owner.tolist())}
    owners: dict = {}
    for n, s in sets:
        for k in s.tolist():
            owners.setdefault(k, set()).add(n)
    assert got == {(k >> 32, n) for k, ns in owners.items() if len(ns) > 1 for n in ns}


def test_key_costs_no_more_with_more_buckets():
    r = np.random.default_rng(3)
    sets = [(k + 1, r.integers(0, 1 << 64, 120, dtype=np.uint64)) for k in range(3000)]
    for buckets in (8, 2000):
        blobs = packed(sets, buckets)
        assert sum(blobs.column(k).nbytes for k in (2, 3)) < 5.2 * 120 * 3000 + 16 * len(blobs) + 8 * 3000


@pytest.mark.parametrize("which", [[0, 0, 0, 1, 254, 255, 510, 511, 1021, 59_999], [700], []])
def test_steps(which):
    assert keys.from_steps(np.frombuffer(keys.steps(np.array(which, np.int64)), np.uint8)).tolist() == which


def test_same_owners_in_two_tasks_are_the_same():
    one, two, other = (packed([(n, np.arange(9, dtype=np.uint64)) for n in names], 3) for names in ([5, 6], [5, 6], [6, 5]))
    assert one.column("parcel")[0] == two.column("parcel")[0] != other.column("parcel")[0]


def test_runs_of_a_leader_are_one(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (5, 6), (7, 8), (7, 9)], "a long, b long")
    roots = spark.createDataFrame([(1, 1), (2, 1), (7, 7), (8, 7), (9, 7)], "node long, root long")
    # 5 and 6 were tried as a pair, and 7, 8 and 9 are in one component.
    assert sorted(map(tuple, jaccard.open_runs(pairs, roots).collect())) == [(1, 1), (1, 2), (1, 3), (1, 4)]


def test_pairs_have_names_and_stars_one_leader(spark, monkeypatch):
    """Small parcels and many buckets; a class that comes twice is no pair with itself."""
    monkeypatch.setattr(jaccard, "HELD", 300)
    monkeypatch.setattr(jaccard, "BUCKET_KEYS", 16)
    r = random.Random(8)
    rows = []
    for k in range(90):
        words = [f"w{k % 30}_{j}" for j in range(40)]
        for _ in range(k % 3):
            words[r.randrange(40)] = f"x{k}"
        rows.append((k, " ".join(words)))
    rows += rows[:20]
    got = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(tuple(x) for x in got.select("doc_id", "n_shingles", "component_id").collect()) == sorted(plain.jaccard_components(rows))


def test_workers_keep_no_chunks(spark, tmp_path):
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(50))) for k in range(200)], "doc_id long, text string")
    tokens.write_tokens(docs, f"{tmp_path}/ids", tokenizer_path()).count()

    def held(_):
        from rdspark.llm import tokens as here
        return sum(len(e.chunks) + len(e.pieces) for e in here._encoders.values())
    assert spark.sparkContext.parallelize(range(32), 16).map(held).max() <= 2
