"""The sieve of runs inside tasks: no linked pair across components is lost, blocks or not, and groups of near copies do not become pairs."""

from __future__ import annotations

import random

import numpy as np
import plain
import pytest
from rdspark.llm import jaccard



def sets_near(r, groups: int, members: int):
    """Sets around the threshold: each member of a group changes some tokens of its base."""
    out = []
    for _ in range(groups):
        base = r.integers(1, 1 << 63, int(r.choice([3, 20, 90, 400])), dtype=np.uint64)
        for _ in range(members):
            x = base.copy()
            change = int(r.integers(0, max(1, len(x) // 6) + 1))
            x[r.permutation(len(x))[:change]] = r.integers(1, 1 << 63, change, dtype=np.uint64)
            out.append(np.unique(x))
    return out


def linked_pairs(sets, roots):
    found = set()
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(np.intersect1d(a, sets[j]))
            if roots[i] != roots[j] and 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                found.add((j, i))
    return found


@pytest.mark.parametrize("seed", range(4))
def test_sieve_keeps_every_linked_pair(seed):
    r = np.random.default_rng(seed)
    sets = sets_near(r, 6, 8)
    n = len(sets)
    roots = r.integers(0, 12, n)
    sketches = [jaccard.parity_sketch(s).tobytes() for s in sets]
    got = [x for x in jaccard.sieved(np.arange(n), roots, np.array([len(s) for s in sets]), np.zeros(n, int), sketches, 80)]
    pairs = {(min(a, b), max(a, b)): d for x in got for a, b, d in zip(x[0].tolist(), x[1].tolist(), x[4].tolist())}
    assert linked_pairs(sets, roots) <= set(pairs)
    for (a, b), d in pairs.items():
        assert roots[a] != roots[b] and d == jaccard.hamming(*(np.frombuffer(sketches[k], np.uint8) for k in (a, b)))
        assert d <= jaccard.most_different(len(sets[a]) + len(sets[b]), 80)


@pytest.mark.parametrize("block", [1 << 21, 600])
def test_runs_in_blocks_give_the_same_pairs(spark, monkeypatch, block):
    """Runs cut into many blocks, and held pairs handed on early, find what one block finds."""
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", block)
    r = np.random.default_rng(9)
    sets = sets_near(r, 3, 14)
    roots = [int(x) for x in r.integers(0, 9, len(sets))]
    runs = spark.createDataFrame([(k % 2, c, roots[c]) for k in range(2) for c in range(len(sets))], "run long, class long, root long")
    sketches = spark.createDataFrame([(c, len(s), bytearray(jaccard.parity_sketch(s).tobytes())) for c, s in enumerate(sets)], "class long, n long, value binary")
    rows = jaccard.across(runs, sketches, 80, nearest=False).distinct().collect()
    found = {(min(x["a"], x["b"]), max(x["a"], x["b"])) for x in rows}
    assert linked_pairs(sets, roots) <= found
    best = jaccard.across(runs, sketches, 80, nearest=True).collect()
    least: dict = {}
    for x in rows:
        key = tuple(sorted((x["ra"], x["rb"])))
        least[key] = min(least.get(key, 1 << 60), x["distance"])
    got: dict = {}
    for x in best:
        key = tuple(sorted((x["ra"], x["rb"])))
        got[key] = min(got.get(key, 1 << 60), x["distance"])
    assert got == least


def test_large_group_of_near_copies_with_strangers(spark):
    """One group with most of the rows, and rows that share a passage with it without being similar."""
    r = random.Random(5)
    base = [f"w{r.randrange(900)}" for _ in range(120)]
    rows = []
    for k in range(240):
        words = list(base)
        for _ in range(k % 4):
            words[r.randrange(len(words))] = f"x{r.randrange(10 ** 6)}"
        if k % 6 == 0:
            words = words[:70] + [f"y{r.randrange(10 ** 6)}" for _ in range(50)]
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(x) for x in jaccard.similar_documents(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == sorted(plain.jaccard_components(rows))


def test_bitmap_grows_with_its_values():
    assert jaccard._bits(0) == 1 << jaccard.BITS and jaccard._bits(1 << 21) == 1 << 26 and jaccard._bits(1 << 40) == 1 << jaccard.MOST_BITS
