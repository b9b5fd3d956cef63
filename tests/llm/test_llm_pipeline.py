"""The pipeline's stages one by one against plain versions, and the whole on the smallest data."""

from __future__ import annotations

import re

import pandas as pd
import plain
import pytest

import corpus_pipeline
from rdspark.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def passes(spark):
    """What each stage was given and what it kept."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        docs = stage(spark, docs, FOLDER)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        out.append((name, given.toPandas(), docs.toPandas()))
    return {n: (a, b) for n, a, b in out}


def test_order_and_columns(passes):
    assert list(passes) == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_ids"]
    for name, (given, kept) in passes.items():
        if name != "token_ids":
            assert list(kept.columns) == list(given.columns) and len(kept)


def test_toxic_documents_go(passes):
    given, kept = passes["toxicity"]
    labels = pd.read_parquet(f"{FOLDER}/labels.parquet")
    gone = set(given.doc_id) - set(kept.doc_id)
    toxic, clean = set(labels[labels.toxic == 1].doc_id), set(labels[labels.toxic == 0].doc_id)
    assert len(gone & toxic) >= 0.7 * len(toxic) and len(gone & clean) <= 0.05 * len(clean)


def test_one_of_each_group_stays(passes):
    given, kept = passes["near_duplicates"]
    want = {d for d, _, c in plain.jaccard_components(list(given[["doc_id", "text"]].itertuples(index=False, name=None))) if d == c}
    assert set(kept.doc_id) == want and kept.doc_id.is_unique


def test_benchmark_passages_go(passes):
    given, kept = passes["decontamination"]
    words = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [words(t) for t in pd.read_parquet(f"{FOLDER}/benchmark.parquet").text]
    leaks = {d for d, t in given[["doc_id", "text"]].itertuples(index=False) if any(i in words(t) for i in items)}
    assert set(kept.doc_id) == set(given.doc_id) - leaks


def test_the_mix_comes_near_its_targets(passes):
    given, kept = passes["mixing"]
    size = lambda t: len(plain.WORD.findall(t))
    given, kept = given.assign(size=given.text.map(size)), kept.assign(size=kept.text.map(size))
    want = plain.mix_targets(list(given.groupby("source")["size"].sum().items()))
    got = kept.groupby("source")["size"].sum()
    most = given.groupby("source")["size"].max()
    assert all(abs(got.get(s, 0) - t) <= most[s] for s, t in want.items()) and kept.doc_id.value_counts().max() <= 2


def test_ids_of_the_mix(passes):
    given, kept = passes["token_ids"]
    rows = sorted(given[["doc_id", "text"]].itertuples(index=False, name=None))
    want = plain.tokens(rows, queries.tokenizer_path())
    assert sorted(kept.itertuples(index=False, name=None)) == sorted(want)


def test_stages_handle_odd_tables(spark):
    docs = "doc_id long, text string, lang string, source string, n_chars long, score double, _row_key string, _mix_key string"
    rows = [(None, None, None, None, None, None, None, None), (1, "", "x", "s", 0, 0.1, "k", "m"), (1, "", "x", "s", 0, 0.1, "k", "m"),
            (2, "a word", None, None, 6, None, None, None), (3, "one more text of a few words here", "en", "s", 1, 1.0, "k", "m")]
    for data in (rows, []):
        df = spark.createDataFrame(data, docs)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, df, FOLDER)
            assert got.count() >= 0 and (k == 4 or got.columns == df.columns)
