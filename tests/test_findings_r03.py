"""Cases of the third review: whole jobs, skew and files by the thousand."""

import glob

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rdspark.llm import cnn, decontaminate
from rdspark.operators import curation as cu, quality
from rdspark.operators.numbering import spread_join
from rdspark.plans import queries_curation as qc, queries_streaming as qs
from rdspark.sinks.results import write_point
from rdspark.sources.result_logs import read_points
from rdspark.streaming import packets as sp


def _table(spark, folder, name, rows, ddl):
    spark.createDataFrame(rows, ddl).write.parquet(f"{folder}/{name}.parquet")


def test_batches_hold_every_order_line(spark, tmp_path):
    """Batches are made of order lines; equal lines are one, with the sum of their quantities."""
    lines = [(o, n, float(o % 7 + n)) for o in range(1, 113) for n in (1, 2)]
    _table(spark, tmp_path, "lineitem", lines + lines[:1], "l_orderkey long, l_linenumber int, l_quantity double")
    got = qc._batches(spark, str(tmp_path)).agg(F.sum("size"), F.sum("ids"), F.sum("quantity"), F.sum("places")).first()
    assert tuple(got) == (224, sum(o * 8 + n for o, n, _ in lines), sum(q for *_, q in lines) + lines[0][2], sum(range(224)))


def test_point_files_pass_no_folder_through_the_driver(spark, tmp_path):
    odd = ["a b", "x/y=z", "100%", "ü[1]", None]
    rows = [(m, d, f"s:{k}", k, f"{k:03d}", float(k), m == "A") for m in "AB" for d in odd for k in range(3)]
    p = spark.createDataFrame(rows, "method string, dataset string, sequence string, qp_i int, rate_key string, ave_all_frame_bpp double, no boolean")
    out = f"{tmp_path}/points"
    write_point(p.drop("no"), out)
    write_point(p.where("no").drop("no"), out)      # a second call adds to the folders
    got = read_points(spark, out)
    files = glob.glob(f"{out}/*/*/*/*.json")
    assert len(files) == 2 * 15
    plain = spark.read.schema(got.schema).json(out)
    columns = ["method", "dataset", "sequence", "rate_key", "qp_i", "ave_all_frame_bpp"]
    told = lambda df: sorted(map(str, df.select(columns).collect()))
    assert told(got) == told(plain) == told(p.unionByName(p.where("no"))) and got.columns == plain.columns
    assert "FileScan" not in got._jdf.queryExecution().toString()


def test_names_are_repeated_only_where_rows_meet_them(spark):
    big = spark.createDataFrame([(k % 3, k) for k in range(100)], "key int, row int")
    facts = spark.range(50).selectExpr("CAST(id AS INT) AS key", "id AS fact")
    got = spread_join(big, facts, ["key"], F.xxhash64("row"), copies=64, many=True)
    assert sorted(map(tuple, got.select("key", "row", "fact").collect())) == sorted((k % 3, k, k % 3) for k in range(100))
    seqs = spark.createDataFrame([(m, f"p{m}", 2) for m in range(5)], "manifest long, path string, seq_length int")
    names = spark.createDataFrame([(m, k, f"{m}-{k}") for m in range(5) for k in range(4)], "manifest long, frame_no int, frame_name string")
    met = cu.manifest_frames(seqs, names)
    assert sorted(r["frame_name"] for r in met.collect()) == sorted(f"{m}-{k}" for m in range(5) for k in range(2))
    assert "explode(array(0, 1, 2" not in met._jdf.queryExecution().toString() and "explode([0,1,2" not in met._jdf.queryExecution().toString()


def test_training_takes_every_labelled_row(spark, monkeypatch):
    """2,100 rows of a class; the word that marks the last 40 by hash, beyond the first 2,000, is learned as well."""
    rows = [(k, "filler words of no matter here" + (" good" if k % 2 else " awful")) for k in range(4200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    late = [r["doc_id"] for r in docs.where("doc_id % 2 = 0").orderBy(F.xxhash64("doc_id").desc()).limit(40).collect()]
    docs = docs.withColumn("text", F.when(F.col("doc_id").isin(late), "zork zork filler words of no matter here").otherwise(F.col("text")))
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 = 0 AS INT) AS toxic")
    asked = spark.createDataFrame([(1, "filler words zork zork of no matter"), (2, "filler words good of no matter here")], "doc_id long, text string")
    for shard in (8000, 1000):      # in one task, and joined from several
        monkeypatch.setattr(cnn, "SHARD", shard)
        model = cnn.fit(docs, labels)
        got = {r["doc_id"]: r["score"] for r in cnn.score(asked, model, "doc_id").collect()}
        assert got[1] > 0.5 > got[2], (shard, got)


def test_latent_space_takes_every_document(spark):
    """The products of the fit are those of all passages of all documents, more of them than FIT_DOCUMENTS."""
    r = np.random.default_rng(1)
    rows = [(k, " ".join(f"w{x}" for x in r.integers(0, 90, r.integers(0, 120)))) for k in range(3 * decontaminate.FIT_DOCUMENTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weight, width = r.random(decontaminate.FEATURES) + 0.1, 8
    matrix, want = decontaminate._test_matrix(width, 5), np.zeros((decontaminate.FEATURES, width))
    for x in decontaminate.passages(docs, "doc_id").select("words").toArrow().column("words").to_pylist():
        ids = (np.frombuffer(x, np.uint64) % np.uint64(decontaminate.FEATURES)).astype(int)
        a = weight[ids] / np.linalg.norm(weight[ids])
        np.add.at(want, ids, a[:, None] * (a @ matrix[ids])[None, :])
    got = decontaminate._summed(docs, weight, width, 5)
    assert np.abs(want).max() > 1 and np.allclose(got, want, atol=1e-3 * np.abs(want).max())


def test_ms_ssim_blurs_four_planes_a_level(monkeypatch):
    calls, blur = [], quality._blur
    monkeypatch.setattr(quality, "_blur", lambda *a: calls.append(1) or blur(*a))
    r = np.random.default_rng(2)
    a, b = r.integers(0, 256, (2, 100, 120)).astype(np.uint8)
    first = quality.ms_ssim_planes(a, a)
    score = quality.ms_ssim_planes(a, b)
    assert abs(first - 1) < 1e-12 and len(calls) == 2 * 4 * 4

    def plain(x, y):
        taps, total = np.outer(quality._taps(), quality._taps()), []
        for w in (x, y, x * x, y * y, x * y):
            total.append((np.lib.stride_tricks.sliding_window_view(w, (11, 11)) * taps).sum((2, 3)))
        mx, my, xx, yy, xy = total
        c = (2 * (xy - mx * my) + 58.5225) / (xx - mx * mx + yy - my * my + 58.5225)
        return ((2 * mx * my + 6.5025) / (mx * mx + my * my + 6.5025) * c).mean(), c.mean()
    want, x, y = 1.0, a.astype(float), b.astype(float)
    with np.errstate(invalid="ignore"):
        for k, weight in enumerate(quality.FOUR_LEVELS):
            full, contrast = plain(x, y)
            want *= np.power(full if k == 3 else contrast, weight)
            x, y = quality._shrink(x), quality._shrink(y)
    assert np.isclose(score, want, atol=1e-12, equal_nan=True)


class _Handle:
    """State of one key, counting the calls that write it."""

    def __init__(self):
        self.kept, self.writes = {}, 0

    def getMapState(self, *_):
        handle = self

        class Sets:
            def iterator(self):
                return iter(handle.kept.items())

            def updateValue(self, key, value):
                handle.writes += 1
                handle.kept[key] = value

            def removeKey(self, key):
                handle.writes += 1
                del handle.kept[key]
        return Sets()

    def getListState(self, *_):
        class Waiting:
            def exists(self):
                return False
        return Waiting()

    def getValueState(self, *_):
        class Newest:
            value = None

            def get(self):
                return self.value

            def update(self, value):
                self.value = value
        return Newest()


def test_state_is_written_once_a_set_that_stays():
    handle, active = _Handle(), sp._ActiveSets(0, None)
    active.init(handle)
    for low in (0, 1000):
        units = np.arange(low, low + 1000)
        pdf = pd.DataFrame({"unit_no": units, "nal_type": np.where(units % 2 == 0, sp.SPS_TYPE, 2), "height": units.astype(float), "width": units.astype(float)})
        out = pd.concat(active.handleInputRows((1, 0), iter([pdf]), None))
        assert out["sps_unit"].tolist() == (out["unit_no"] - 1).tolist()
    assert handle.kept == {(1998,): (1998, 1998)} and handle.writes == 3      # each round its last set, and the one before it goes


def test_landed_files_grow_in_number(spark, tmp_path, monkeypatch):
    """No task writes half of all points, whatever their number: a run lands as many files as its points need."""
    rows = [(o, 0, s, 1 + o % 7, 5.0, 100.0 * o, "A") for o in range(64) for s in range(20)]
    _table(spark, tmp_path, "lineitem", rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string")
    spark.read.parquet(f"{tmp_path}/lineitem.parquet").withColumn("l_shipdate", F.current_timestamp()).write.mode("error").parquet(f"{tmp_path}/new/lineitem.parquet")

    class Done:
        def awaitTermination(self):
            pass
    base = f"{tmp_path}/scratch"
    monkeypatch.setattr(qs, "scratch_path", lambda *_: base)
    monkeypatch.setattr(qs, "FILE_POINTS", 10)
    monkeypatch.setattr(qs.sr, "ingest_results", lambda *a, **k: Done())
    monkeypatch.setattr(qs.sr, "read_store", lambda *a, **k: spark.read.schema("method string, dataset string, sequence string, rate_idx int, i_frame_num long, p_frame_num long, ave_all_frame_bpp double").json(f"{base}/landing"))
    assert qs._ingest(spark, f"{tmp_path}/new").count() == 2 * 140
    assert len(glob.glob(f"{base}/landing/*.json")) > 6
