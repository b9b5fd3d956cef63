"""Findings of the fourth review."""

import random
import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
import pytest

from rdspark.functions import pixels
from rdspark.operators import curation as cu
from rdspark.operators.packets import active_parameter_set
from rdspark.plans import derived, queries_curation as qc
from rdspark.sources.manifests import parse_video_manifest
from rdspark.sources.storage import scratch_path
from rdspark.streaming import packets as sp

SEQS, NAMES = "manifest long, path string, seq_length int", "manifest long, frame_no int, frame_name string, size int"


def named(spark, seqs, names):
    return cu.manifest_frames(spark.createDataFrame(seqs, SEQS), spark.createDataFrame(names, NAMES))


def test_names_and_sequences_meet_by_blocks(spark, monkeypatch):
    """Lists of several blocks, one that comes twice, names in any order, rows without a key or a length."""
    monkeypatch.setattr(cu, "NAMES", 4)
    seqs = [(1, "a", 11), (1, "b", 4), (2, "c", 5), (2, "c", 5), (3, "d", 1), (4, "e", None), (None, "f", 0)]
    names = [(m, k, f"{m}-{k}", k * m) for m, n in ((1, 13), (2, 5), (2, 5), (3, 2), (5, 9)) for k in range(n)] + [(None, 0, "none", 0), (1, None, "none", 0), (1, -1, "none", 0)]
    want = sorted((m, k, p, n, x[2], x[3]) for m, p, n in seqs for k in range(n or 0) for x in names if x[:2] == (m, k))
    for given in (names, names[::-1], names[1::2] + names[::2]):
        met = named(spark, seqs, given)
        assert met.columns == ["manifest", "frame_no", "path", "seq_length", "frame_name", "size"] and dict(met.dtypes)["frame_no"] == "int"
        assert sorted(map(tuple, met.collect())) == want
    alone = cu.manifest_frames(spark.createDataFrame(seqs[:2], SEQS).drop("manifest"), spark.createDataFrame(names[:13], NAMES).drop("manifest"))
    assert sorted((r["path"], r["frame_name"]) for r in alone.collect()) == sorted((p, f"1-{k}") for p, n in (("a", 11), ("b", 4)) for k in range(n))


@pytest.mark.parametrize("gone", [0, 3, 4, 6, 10])
def test_a_name_that_lacks_fails(spark, monkeypatch, gone):
    monkeypatch.setattr(cu, "NAMES", 4)
    names = [(1, k, f"{k}", k) for k in range(11) for _ in range(2) if k != gone]      # a list twice makes up for nothing
    with pytest.raises(Exception, match=f"no file name for frame {gone} of a"):
        named(spark, [(1, "a", 11)], names).collect()
    with pytest.raises(Exception, match=f"no file name for frame {gone} of a"):
        named(spark, [(1, "a", 11)], [*names, (1, gone, None, 0)]).collect()
    assert named(spark, [(1, "a", gone)], names).count() == 2 * gone


def test_texts_are_made_in_many_tasks_and_frames_are_not_moved(spark, tmp_path):
    spark.range(300).selectExpr("id AS p_partkey", "CAST(id % 50 + 1 AS INT) AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    texts = qc._video_texts(spark, str(tmp_path))
    assert texts.rdd.getNumPartitions() > 1
    seqs, names = parse_video_manifest(texts)
    plan = cu.manifest_frames(seqs, names)._jdf.queryExecution().executedPlan().toString()
    assert "format_string" not in plan and not re.search(r"hashpartitioning\([^)]*frame_no", plan)
    # No text is parsed before the rows are spread: below the shuffles by part key stand the files only.
    assert not any("from_json" in x for x in re.findall(r"Exchange hashpartitioning\(p_partkey.*?FileScan", plan, re.S))
    rows = qc._manifest_frames(spark, str(tmp_path)).agg(F.count(F.lit(1)), F.max("frame_name"), F.countDistinct("path")).first()
    assert tuple(rows) == (sum(k % 50 + 1 for k in range(300)), "im00050.png", 300)


def test_enlarged_planes_leave_the_worker_some_at_a_time(spark, monkeypatch):
    blocks = [bytes((k * 7 + i * (k % 5)) % 256 for i in range(64)) for k in range(300)]
    frames = spark.createDataFrame([("s", k, bytearray(b)) for k, b in enumerate(blocks)], "sequence string, frame_idx long, p0 binary")
    made, kind = [], type(frames)
    before = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **b: made.append(f) or before(self, f, *a, **b))
    got = {r["frame_idx"]: r for r in derived.large_planes(frames, 4).collect()}
    assert len(got) == 300 and {(r["sequence"], r["plane"], r["width"], r["height"], r["bit_depth"]) for r in got.values()} == {("s", "y", 128, 128, 8)}
    for k in (0, 77, 299):
        plane = np.frombuffer(blocks[k], np.uint8).reshape(8, 8)
        for _ in range(4):
            plane = pixels.double(plane, 1)
        assert bytes(got[k]["data"]) == np.rint(plane).astype(np.uint8).tobytes()
    batch = pa.RecordBatch.from_pydict({"sequence": ["s"] * 300, "frame_idx": list(range(300)), "p0": blocks})
    out = list(made[0](iter([batch])))
    assert len(out) > 1 and max(b.nbytes for b in out) <= derived.PLANE_BYTES + 16_384 and sum(b.num_rows for b in out) == 300


FIELDS = ["unit_no", "nal_type", "sps_id", "height", "width"]
UNITS = ", ".join(f"{c} int" for c in FIELDS)
ROWS = ["stream", "unit_no", "nal_type", "sps_id", "sps_unit", "height", "width", "valid"]


@pytest.mark.parametrize(["kind", "name"], [("bigint", lambda k: (1 << 60) + k if k else None), ("string", lambda k: f"s{k}" if k else None), ("binary", lambda k: bytearray([255, k]))])
def test_one_call_of_the_state_takes_many_streams(spark, kind, name):
    """Sets late and early, of streams with and without a name, that share five buckets; numbers come up to 25 late."""
    r, last, base = random.Random(7), {}, scratch_path(spark, "many")
    rows = []
    for u in range(900):
        s, i, is_set = r.randrange(12), r.randrange(3), r.random() < 0.3
        rows.append((name(s), u, 0 if is_set else 2, i, 64 + u if is_set and u % 9 else None, 32 + u if is_set else None))
    rows += [rows[5], rows[6], rows[7]]      # units that come twice
    closing = [(name(s), 2000 + 3 * s + i, 2, i, None, None) for s in range(12) for i in range(3)]
    schema = f"stream {kind}, {UNITS}"
    late = sorted(rows, key=lambda x: x[1] + r.random() * 25)
    for part in (late[:300], late[300:600], [*late[600:], *closing]):
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(f"{base}/in")
        query = sp.stateful_packets(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/cp", disorder=25, buckets=5)
        query.awaitTermination()
        last = query.lastProgress
    assert 0 < last["stateOperators"][0]["numRowsTotal"] <= 5
    out = spark.read.parquet(f"{base}/out/slices").drop("batch_id")
    assert out.columns == ROWS and out.dtypes[0][1] == kind
    unique = spark.createDataFrame([x for k, x in enumerate([*rows, *closing]) if x[2] or x not in rows[:k]], schema)
    told = lambda df: sorted(map(str, df.where("unit_no < 1900").select(ROWS).collect()))
    assert told(out) == told(active_parameter_set(unique))


def test_slices_that_wait_are_settled_by_a_timer(spark):
    base, schema = scratch_path(spark, "patience"), f"stream string, {UNITS}"
    rows = [("a", 1, 0, 0, 64, 32), ("a", 3, 2, 0, None, None), ("b", 2, 2, 1, None, None), ("b", 90, 2, 2, None, None), ("b", 40, 2, 2, None, None), ("b", 39, 0, 2, 8, 8)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in")
    query = sp.stateful_packets(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/cp", once=False, disorder=20, patience_ms=3000, buckets=1)
    try:
        got, until = [], time.time() + 90
        while len(got) < 4 and time.time() < until:
            time.sleep(1)
            try:
                got = sorted((x["unit_no"], x["batch_id"] > 0, x["sps_unit"], x["valid"]) for x in spark.read.parquet(f"{base}/out/slices").collect())
            except Exception:      # nothing is written yet
                pass
    finally:
        query.stop()
    assert got == [(2, True, None, False), (3, True, 1, True), (40, False, 39, True), (90, True, 39, True)]


def test_a_state_for_each_key_gives_the_same(spark):
    base, schema = scratch_path(spark, "each"), f"stream bigint, {UNITS}"
    rows = [(u % 2, u, 0 if u % 7 < 2 else 2, u % 3, 64 + u if u % 7 < 2 else None, 32 + u if u % 7 < 2 else None) for u in range(60)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in")
    sp.stateful_packets(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/cp", buckets=None).awaitTermination()
    told = lambda df: sorted(map(str, df.select(ROWS).collect()))
    assert told(spark.read.parquet(f"{base}/out/slices")) == told(active_parameter_set(spark.createDataFrame(rows, schema)))
