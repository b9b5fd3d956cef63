"""Spelling variants against removals of single letters; all near pairs of hard words; odd rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from test_llm_operators import DOCS, EXTRA, corpus

from rdspark.llm import queries, spelling


def counted(rows, damage: int | None) -> dict:
    count: Counter = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damage and len(run) >= 6 and h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def grouped(words: dict, ratio: int = 5) -> dict:
    """Word to (form, root, n, n_near, form_n), by one removed letter."""
    by: dict = {}
    for w in words:
        for i in range(len(w)):
            by.setdefault((w[:i], w[i + 1:]), set()).add(w)
    near: dict = {w: set() for w in words}
    for (a, z), members in by.items():
        for w in members:
            near[w] |= members - {w}
            if a + z in words:
                near[w].add(a + z)
                near[a + z].add(w)
    best = {w: min(x, key=lambda y: (-words[y], y)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if words[b] >= ratio * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {w: (form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def found(df) -> dict:
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("letters", ["ab", "abcdeé", "ÿa×÷"])
def test_all_neighbours(spark, letters):
    """Runs of equal letters, many words that lie close together, and chains of forms."""
    r = random.Random(len(letters))
    words = {"".join(r.choice(letters) for _ in range(r.randint(1, 7))): r.choice([5, 6, 25, 26, 124, 125, 130, 625, 4000]) for _ in range(500)}
    got = found(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)))
    assert got == grouped(words)


def test_a_group_as_large_as_the_alphabet(spark):
    """All words that differ in one letter, with the word without it: one group, no pairs."""
    letters = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))]
    words = {f"abc{x}def": 5 + 7 * k for k, x in enumerate(letters)} | {"abcdef": 9000}
    got = found(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == grouped(words) and got["abcxdef"][3] == len(letters)


def test_chains_follow_to_the_last(spark):
    words = {"abcdef" + "g" * k: 5 ** (k + 1) for k in range(9)}
    got = found(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == grouped(words) and got["abcdef"][1] == "abcdefgggggggg"


def test_words_of_texts(spark):
    texts = ["Straße STRASSE straße çava ÇAVA naïveté " * 3, "don't co-operate x" + "y" * 50, None, "", "  ", "größer größte größter " * 5, "naïvete " * 30 + "日本語 текст"]
    rows = [(k % 4 or None, t) for k, t in enumerate(texts * 3)] + [(r[0], r[1]) for r in corpus()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for damage in (None, 2, 7):
        got = {r["word"]: r["n"] for r in spelling.word_counts(df, damage=damage).collect()}
        assert got == counted(rows, damage)
        assert found(spelling.variants(spelling.word_counts(df, damage=damage))) == grouped(counted(rows, damage))


def test_odd_tables(spark):
    rows = [(r[0], *r[1:], *(["x"] * len(EXTRA.split(",")))) for r in corpus()[:8]] * 2
    clash = spark.createDataFrame(rows, f"{DOCS}, {EXTRA}").withColumnRenamed("key", "word").withColumnRenamed("bin", "run")
    assert found(spelling.variants(spelling.word_counts(clash))) == grouped(counted([(r[0], r[1]) for r in rows], None))
    assert spelling.variants(spelling.word_counts(spark.createDataFrame([], DOCS))).count() == 0


def test_query_on_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op13_spelling(spark, folder)) == grouped(counted(rows, 199))
