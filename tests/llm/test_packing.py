"""Packing: every id in one piece, limits kept, no padding where examples may be cut; ids of the library; odd rows."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_llm_operators import DOCS, EXTRA, corpus

from rdspark.llm import packing, queries

PATH = queries.byte_tokenizer_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def checked(rows: list, limits: packing.Limits, cut: bool) -> tuple[dict, dict]:
    """Pieces by example and by sequence; asserts the limits and that there are no gaps."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["row_key"], r["doc_id"], r["doc_tokens"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] == len(p["ids"]) // 4 > 0
            at += p["length"]
        assert at <= limits.tokens and len(pieces) <= limits.segments and sum(p["loss"] for p in pieces) <= limits.loss
        if cut:
            assert at == limits.tokens or at & (at - 1) == 0
    return by_doc, by_sequence


@pytest.mark.parametrize("limits,cut", [(packing.Limits(), True), (packing.Limits(64, 4, 40), True), (packing.Limits(50, 3, 1), True), (packing.Limits(200, 8, 100), False)])
def test_every_id_is_in_one_piece(spark, library, limits, cut):
    rows = [(r[0], r[1]) for r in corpus()] + [(1000 + k, "tiny") for k in range(40)] + [(2000, ""), (None, "no id"), (5, "<|endoftext|> is text\n\n<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    by_doc, by_sequence = checked(packing.packed_pieces(df, PATH, limits, cut, held=16).collect(), limits, cut)
    want = defaultdict(int)
    for d, t in rows:
        ids = library(t) + [1]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = defaultdict(int)
    for (_, d, n), pieces in by_doc.items():
        pieces.sort(key=lambda p: p["start"])
        per = [p for k, p in enumerate(pieces) if k == 0 or p["start"] != pieces[k - 1]["start"]]
        assert sum(p["length"] for p in pieces) % n == 0
        if len(per) == len(pieces):
            assert [p["start"] for p in pieces] == [0, *np.cumsum([p["length"] for p in pieces])[:-1]]
            got[d, n, zlib.crc32(b"".join(p["ids"] for p in pieces))] += 1
    assert {k: v for k, v in want.items() if v == 1} == {k: v for k, v in got.items() if want[k] == 1}
    if cut and limits.loss >= limits.tokens:
        total = sum(n * count for (_, n, _), count in want.items())
        assert len(by_sequence) <= total / limits.tokens + 12 * 3      # a few short ones for each task


def test_prompts_bear_no_loss(spark, library):
    r = random.Random(3)
    rows = [(k, " ".join(["ask"] * r.randint(0, 30)) or None, " ".join(["answer"] * r.randint(0, 20))) for k in range(300)]
    limits = packing.Limits(64, 4, 24)
    df = spark.createDataFrame(rows, "doc_id long, prompt string, text string").repartition(2)
    for cut in (True, False):
        pieces = packing.packed_pieces(df, PATH, limits, cut, prompt="prompt", held=64).collect()
        by_doc, by_sequence = checked(pieces, limits, cut)
        for (_, d, n), parts in by_doc.items():
            ask, answer = library(rows[d][1]), library(rows[d][2])
            assert n == len(ask) + len(answer) + 1 and sum(p["loss"] for p in parts) == len(answer) + 1
            if not cut and n <= limits.tokens and len(answer) + 1 <= limits.loss:
                assert len(parts) == 1
        least = max(sum(p["length"] for p in pieces) / limits.tokens, sum(p["loss"] for p in pieces) / limits.loss)
        assert len(by_sequence) <= 1.35 * least


def test_dot_product_fills_what_is_scarce():
    """Pieces rich in loss and pieces poor in it go together; by tokens alone the loss would be used up first."""
    packer = packing.Packer(packing.Limits(100, 10, 50), cut=False)
    out = []
    for k in range(200):
        out += list(packer.add(k, 50, 50 - 45 if k % 2 else 0) if k % 2 == 0 else packer.add(k, 50, 50))
    out += list(packer.finish())
    assert len(out) == 100 and all(sum(p.loss for p in s) == 50 for s in out)


def test_memory_is_bounded():
    packer, most = packing.Packer(held=50), 0
    for k in range(3000):
        for _ in packer.add(k, 1 + k * 37 % 5000, 0):
            most = max(most, packer.n)
    assert most <= 60 and sum(p.tokens for s in packer.finish() for p in s) < 60 * 2048


def test_tokenizers_that_differ_are_left_to_the_library(tmp_path, library):
    import public_tokenizers
    other = packing.ByteEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert other.fast is None and np.frombuffer(other.encode("A  b<|x|>"), "<u4").tolist() == other.tokenizer.encode("A  b<|x|>", add_special_tokens=False).ids
    own = packing.encoder(PATH)
    assert own.fast is not None
    r = random.Random(5)
    for _ in range(3000):
        s = "".join(r.choice(" \n\t'ab.S1é<|>日\x1c ,\x00") for _ in range(r.randint(0, 14)))
        assert np.frombuffer(own.encode(s), "<u4").tolist() == library(s)


def test_sequences_are_padded(spark):
    df = spark.createDataFrame([(k, "word " * (k * 13 % 70)) for k in range(50)], "doc_id long, text string").coalesce(1)
    pieces = packing.packed_pieces(df, PATH, packing.Limits(64, 8, 64), cut=False)
    for r in packing.sequences(pieces, 64).collect():
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == (r["n_tokens"] if r["n_tokens"] & (r["n_tokens"] - 1) == 0 else 64) and not ids[r["n_tokens"]:].any()
        assert [s["offset"] for s in r["segments"]] == [0, *np.cumsum([s["length"] for s in r["segments"]])[:-1]]


def test_odd_tables(spark):
    rows = [(r[0], *r[1:], *(["x"] * len(EXTRA.split(",")))) for r in corpus()[:8]] * 2 + [(None, None, None, None, None, *(["x"] * len(EXTRA.split(","))))]
    clash = spark.createDataFrame(rows, f"{DOCS}, {EXTRA}").withColumnRenamed("key", "ids").withColumnRenamed("bin", "start")
    pieces = packing.packed_pieces(clash, PATH)
    plain = packing.packed_pieces(spark.createDataFrame([r[:5] for r in rows], DOCS), PATH)
    per = lambda df: sorted((str(r["doc_id"]), r["s"]) for r in df.groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "s").collect())
    assert per(pieces) == per(plain)
    assert packing.packed_pieces(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_query_on_the_given_table(spark, library):
    folder = "/root/testdata/sf0.001"
    got = queries.op11_packing(spark, folder).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(pieces) == len(rows)
    for d, text in rows:
        ids, at = np.array(library(text) + [1], "<u4"), 0
        for p in sorted(pieces[d], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at:at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
