"""Cases of the third review's check: bounded batches, runs looked at once, labels that meet word ids, searches by blocks."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rdspark import shipping
from rdspark.llm import cnn, jaccard, topk


def test_batches_are_bounded_by_bytes(spark):
    own, other = spark.newSession(), spark.newSession()
    other.conf.set(shipping.BATCH, "123456")

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])
    for session, most in ((own, shipping.BATCH_BYTES), (other, 123456)):
        shipping.ship(session)
        got = session.range(4000, numPartitions=1).selectExpr("repeat('x', 5000) AS text").mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r["n"] for r in got) == 4000 and max(r["bytes"] for r in got) < most + 20_000, (most, got)


def test_runs_without_near_pairs_are_not_named(spark):
    """Only a run with a pair that may be similar is looked at again; blocks of a run name it as well."""
    r = np.random.default_rng(3)
    near = r.integers(1, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(near), np.unique(np.r_[near[:-4], r.integers(1, 1 << 63, 4, dtype=np.uint64)])]
    sets += [np.unique(r.integers(1, 1 << 63, 300, dtype=np.uint64)) for _ in range(4)]
    runs = spark.createDataFrame([(7, 0, 0), (7, 1, 1), (7, 2, 2), (8, 2, 2), (8, 3, 3), (8, 4, 4), (9, 5, 5), (9, 0, 0), (9, 3, 3)], "run long, class long, root long")
    sketches = spark.createDataFrame([(c, len(s), bytearray(jaccard.parity_sketch(s).tobytes())) for c, s in enumerate(sets)], "class long, n long, value binary")
    for nearest in (True, False):
        got = jaccard.across_and_runs(runs, sketches, 80, nearest).collect()
        assert [x["run"] for x in got if x["run"] is not None] == [7]
        assert [{x["a"], x["b"]} for x in got if x["run"] is None] == [{0, 1}]
        assert [{x["a"], x["b"]} for x in jaccard.across(runs, sketches, 80, nearest).collect()] == [{0, 1}]


@pytest.mark.parametrize("buckets", [1 << 15, 1 << 17])
def test_labels_meet_word_ids_dealt_by_id(spark, buckets):
    s = cnn.Settings(buckets=buckets)
    docs = spark.createDataFrame([(1, "One two, two"), (2, None), (3, "not labelled"), (None, "no id"), (1, "one more"), (4, "bad label")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (4, 7), (5, 1), (None, 1)], "doc_id long, toxic int")
    rows = cnn.labelled(docs, labels, "toxic", F.lit(True), s)
    want = []
    for doc, label, text in ((1, 1, "One two, two"), (1, 1, "one more"), (2, 0, "")):
        ids, _ = cnn.word_ids(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), buckets)
        want.append((doc, label, ids.tolist()))
    got = [(r["doc_id"], r["label"], np.frombuffer(r["ids"], cnn._stored(s)).tolist()) for r in rows.collect()]
    assert sorted(got) == sorted(want)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    # Texts do not lie above the map that makes ids of them, so no exchange moves them.
    assert "text#" not in plan[:plan.index("MapInArrow")]


@pytest.mark.parametrize("scale", [3.0, 2.0 ** 24])
@pytest.mark.parametrize("cells", [1, 900, 1 << 20])
def test_search_takes_queries_by_steps(monkeypatch, scale, cells):
    """Ties, repeated ids, fewer rows than k, and scores beyond exact floats: the same answers by any step."""
    monkeypatch.setattr(topk, "CELLS", cells)
    r = np.random.default_rng(4)
    for rows in (0, 5, 30, 400):
        x = np.rint(r.normal(size=(rows, 32)) * scale).astype(np.int64)
        x[rows // 2:] = x[:rows - rows // 2]
        ids = np.sort(np.r_[np.arange(rows - rows // 10), np.arange(rows // 10)])
        q_ids, q = np.r_[ids[:9], 10_000], np.r_[x[:9], np.ones((1, 32), np.int64)][:len(ids[:9]) + 1]
        got = list(topk.block_top(q_ids, q, ids, x, 20))
        assert [a for a, *_ in got] == list(range(len(q_ids)))
        for a, found, s in got:
            all_ = x @ q[a]
            order = [i for i in np.lexsort((ids, -all_)) if ids[i] != q_ids[a]][:20]
            assert found.tolist() == ids[order].tolist() and s.tolist() == all_[order].tolist()
