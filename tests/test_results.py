import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rdspark.operators import comparison as c, planning, summary
from rdspark.plans.compare import compare
from rdspark.plans.evaluate import plan_evaluation, summarise
from rdspark.sinks import results as sinks
from rdspark.sources import configs, result_logs as rl

# Published rate-distortion points of three models on one image set.
TABLES = {
    "large": {"bpp": [0.328361083, 0.500810833, 0.731926708, 0.981324417], "PSNR": [32.47535863, 34.47508771, 36.41845, 37.86458587]},
    "medium": {"bpp": [0.332920792, 0.505808708, 0.738309958, 0.987386125], "PSNR": [32.46911329, 34.42935488, 36.34560738, 37.75338558]},
    "small": {"bpp": [0.339319125, 0.51432875, 0.750090625, 1.001192042], "PSNR": [32.31969629, 34.24087479, 36.08858388, 37.40119083]},
}


def test_bd_rate_on_published_points(spark):
    rows = rl.read_rd_table(spark, TABLES, "kodak")
    vs = lambda a: {r["method"]: r["bd_rate"] for r in c.bd_rate(rows, a).collect()}
    large = vs("large")
    assert large["medium"] == pytest.approx(2.1063, abs=1e-4) and large["small"] == pytest.approx(8.5738, abs=1e-4)
    medium = vs("medium")
    assert (1 + large["medium"] / 100) * (1 + medium["large"] / 100) == pytest.approx(1)
    twin = rows.unionByName(rows.filter("method = 'large'").withColumn("method", F.lit("twin")))
    assert {r["method"]: r["bd_rate"] for r in c.bd_rate(twin, "large").collect()}["twin"] == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError):
        rl.read_rd_table(spark, {"x": {"bpp": [1.0], "psnr": [1.0, 2.0]}}, "d")


def pchip(xs, ys, at):
    """Monotone cubic interpolation, written out on its own."""
    h, d = np.diff(xs), np.diff(ys) / np.diff(xs)
    n = len(xs)
    m = np.zeros(n)
    if n == 2:
        m[:] = d[0]
    else:
        for i in range(1, n - 1):
            if d[i - 1] * d[i] > 0:
                a, b = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
                m[i] = (a + b) / (a / d[i - 1] + b / d[i])
        for i, (h0, h1, s, t) in ((0, (h[0], h[1], d[0], d[1])), (n - 1, (h[-1], h[-2], d[-1], d[-2]))):
            v = ((2 * h0 + h1) * s - h0 * t) / (h0 + h1)
            if np.sign(v) != np.sign(s):
                v = 0
            elif np.sign(s) != np.sign(t) and abs(v) > 3 * abs(s):
                v = 3 * s
            m[i] = v
    k = np.clip(np.searchsorted(xs, at, side="right") - 1, 0, n - 2)
    t = (at - xs[k]) / h[k]
    return ((1 + 2 * t) * (1 - t) ** 2 * ys[k] + t * (1 - t) ** 2 * h[k] * m[k] + t * t * (3 - 2 * t) * ys[k + 1]
            + t * t * (t - 1) * h[k] * m[k + 1])


def bd_plain(anchor, test):
    lo, hi = max(min(anchor)[0], min(test)[0]), min(max(anchor)[0], max(test)[0])
    if hi <= lo:
        return None
    xs = np.linspace(lo, hi, 100)
    area = []
    for curve in (anchor, test):
        q, r = zip(*sorted(curve))
        y = pchip(np.array(q), np.log(np.array(r)), xs)
        area.append(((y[1:] + y[:-1]) / 2).sum() * (xs[1] - xs[0]))
    return (math.exp((area[1] - area[0]) / (hi - lo)) - 1) * 100


def test_bd_rate_on_random_curves(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for g in range(30):
        curves = {}
        for m in ("base", "m1", "m2"):
            n = rng.choice([3, 4, 7]) if m != "base" else rng.choice([2, 4, 6])
            q0 = 60 if (m == "m2" and g % 7 == 0) else 30
            q = sorted(rng.uniform(q0, q0 + 10) for _ in range(n))
            rng.shuffle(q)   # quality need not follow the rate
            curves[m] = [(v, rng.uniform(0.05, 3)) for v in q]
            rows += [(m, f"g{g}", f"{k:03d}", "all", "psnr", b, v) for k, (v, b) in enumerate(curves[m])]
        for m in ("m1", "m2"):
            want[(m, f"g{g}")] = bd_plain(curves["base"], curves[m])
    df = spark.createDataFrame(rows, "method string, dataset string, rate_key string, frame_group string, metric string, bpp double, value double")
    got = {(r["method"], r["dataset"]): r["bd_rate"] for r in c.bd_rate(df, "base").collect()}
    assert got.keys() == want.keys()
    assert any(v is None for v in want.values())
    for k, v in want.items():
        assert (got[k] is None) if v is None else got[k] == pytest.approx(v, rel=1e-9), k


def test_eligibility(spark):
    def curve(m, g, pts):
        return [(m, g, f"{k:03d}", "all", "psnr", b, v) for k, (b, v) in enumerate(pts)]
    fine = [(1.0, 30.0), (2.0, 32.0), (3.0, 34.0)]
    rows = (curve("a", "g1", fine) + curve("a", "g2", [(0.0, 1.0)] + fine) + curve("a", "g3", fine)
            + curve("b", "g1", fine) + curve("b", "g2", fine) + curve("b", "g3", fine[:2]) + curve("b", "g4", fine)
            + curve("c", "g1", [(1.0, 0.0), *fine[1:]]) + curve("d", "g1", [(1.0, None), *fine[1:]]))
    df = spark.createDataFrame(rows, "method string, dataset string, rate_key string, frame_group string, metric string, bpp double, value double")
    assert {(r["method"], r["dataset"]) for r in c.bd_rate(df, "a").collect()} == {("b", "g1")}


def frame_log(n_points=6, seed=2):
    rng = random.Random(seed)
    rows = []
    for p in range(n_points):
        for i in range(rng.randrange(1, 40)):
            kind = 1 if p == 0 else (0 if i % 5 == 0 else rng.choice([1, 2]))
            rows.append(("m", "d", f"s{p}", 0, i, kind, 1000, rng.randrange(1, 9999), *[rng.uniform(20, 50) for _ in range(8)]))
    names = ("method string, dataset string, sequence string, rate_idx int, frame_idx int, frame_type int, pixel_num bigint, bits bigint, "
             + ", ".join(f"{m} double" for m in summary.metric_names()))
    return rows, names


def test_summary_matches_a_plain_loop(spark):
    rows, names = frame_log()
    got = {r["sequence"]: r for r in summarise(spark.createDataFrame(rows, names)).collect()}
    for s, r in got.items():
        mine = [x for x in rows if x[2] == s]
        i, p = [x for x in mine if x[5] == 0], [x for x in mine if x[5] != 0]
        assert (r["i_frame_num"], r["p_frame_num"]) == (len(i), len(p))
        for tag, part in (("i", i), ("p", p), ("all", mine)):
            assert r[f"ave_{tag}_frame_bpp"] == pytest.approx(sum(x[7] for x in part) / len(part) / 1000 if part else 0)
            for k, m in enumerate(summary.metric_names()):
                assert r[f"ave_{tag}_frame_{m}"] == pytest.approx(sum(x[8 + k] for x in part) / len(part) if part else 0)
    assert got["s0"]["i_frame_num"] == 0 and got["s0"]["ave_i_frame_psnr"] == 0


def test_arrays_join_to_whole_lists(spark):
    rows, names = frame_log()
    a = summary.frame_arrays(spark.createDataFrame(rows, names), chunk=7).orderBy("sequence", "chunk_no").collect()
    for s in {r["sequence"] for r in a}:
        psnr = [v for r in a if r["sequence"] == s for v in r["frame_psnr"]]
        assert psnr == [x[8] for x in sorted((x for x in rows if x[2] == s), key=lambda x: x[4])]
        assert max(len(r["frame_psnr"]) for r in a) <= 7


def test_recombined_equals_direct(spark):
    rows, names = frame_log()
    p = summarise(spark.createDataFrame(rows, names))
    both = p.join(summary.recombine(p).select("sequence", F.col("ave_all_frame_psnr").alias("again")), "sequence")
    assert all(r["ave_all_frame_psnr"] == pytest.approx(r["again"]) for r in both.collect())


def test_unit_timing_is_null_when_short(spark):
    df = spark.createDataFrame([("m", "d", "s", 0, i, float(i), 1.0) for i in range(4)] + [("m", "d", "t", 0, i, float(i), 2.0) for i in range(6)],
                               "method string, dataset string, sequence string, rate_idx int, unit_no int, enc_s double, dec_s double")
    got = {r["sequence"]: r["avg_frame_encoding_time"] for r in summary.unit_timing(df).collect()}
    assert got == {"s": None, "t": 4.5}
    assert summary.unit_timing(df, enabled=False).filter("avg_frame_encoding_time is not null").count() == 0


def test_class_mean_fills_missing_metrics(spark):
    df = spark.createDataFrame([("m", "d", "s1", "000", 2, 0, 1.0, 0.0, 1.0), ("m", "d", "s2", "000", 1, 0, 4.0, 0.0, 4.0)],
                               "method string, dataset string, sequence string, rate_key string, i_frame_num int, p_frame_num int, "
                               "ave_i_frame_bpp double, ave_p_frame_bpp double, ave_all_frame_bpp double")
    got = {r["frame_group"]: r for r in c.class_mean(df, ["msssim"]).collect()}
    assert got["i"]["bpp"] == 2.0 and got["p"]["bpp"] == 0.0 and got["i"]["value"] == 0.0
    assert [r["value"] for r in c.metric_rows(df, ["msssim"]).collect()] == [None] * 6


POINT = {"frame_pixel_num": 100, "i_frame_num": 1, "p_frame_num": 2, "test_time": 1.5, "ave_i_frame_bpp": 1 / 3, "ave_p_frame_bpp": 0.1,
         "ave_all_frame_bpp": 0.2, "ave_i_frame_psnr": 28.47625, "ave_p_frame_psnr": 30.0, "ave_all_frame_psnr": 30.5, "frame_type": [0, 1, 1]}


def test_reading_nested_logs(spark, tmp_path):
    for name, keys in (("a", ["000", "001"]), ("b", ["000"])):
        log = {"D": {"s1": {k: POINT for k in keys}, "s2": {"000": POINT}}, "E": {"s1": {"010": POINT}}}
        (tmp_path / f"{name}.json").write_text(json.dumps(log, indent=2))
    df = rl.read_result_logs(spark, ["a", str(tmp_path / "a.json"), "b", str(tmp_path / "b.json")], anchor="a")
    assert df.count() == 7 and df.filter("dataset = 'E'").first()["rate_key"] == "010"
    r = df.filter("method = 'a' and sequence = 's2'").first()
    assert r["ave_i_frame_bpp"] == 1 / 3 and r["frame_type"] == [0, 1, 1] and r["ave_i_frame_psnr_y"] is None
    with pytest.raises(ValueError):
        rl.read_result_logs(spark, ["a", "x", "b"])
    with pytest.raises(ValueError):
        rl.read_result_logs(spark, {"a": "x"}, anchor="z")


@pytest.mark.parametrize("split", [17, 200, 1 << 20])
def test_large_indented_log_is_cut_anywhere(spark, tmp_path, split):
    from rdspark.sources.indented_logs import read_indented_log
    rng = random.Random(8)
    log = {d: {s: {f"{k:03d}": {**POINT, "ave_i_frame_bpp": rng.random(), "frame_psnr": [rng.random() for _ in range(k)], "ds_name": d}
                   for k in range(rng.randrange(0, 4))} for s in ("x", 'y "z"', "w: {")} for d in ("A", "B\\", "C")}
    log["D"] = {}
    path = tmp_path / "log.json"
    path.write_text(json.dumps(log, indent=2))
    whole = rl.read_result_log(spark, "m", str(path)).orderBy("dataset", "sequence", "rate_key").collect()
    cut = read_indented_log(spark, "m", str(path), split_bytes=split).orderBy("dataset", "sequence", "rate_key").collect()
    assert len(whole) == sum(len(r) for d in log.values() for r in d.values()) and cut == whole


def test_document_lines_are_one_document(spark, tmp_path):
    rows = [("m", d, s, f"{k:03d}", 1 / (k + 3), None if k else 2.5, k) for d in ('A "q"', "B") for s in ("x", "y\\z") for k in range(3)]
    df = spark.createDataFrame(rows, "method string, dataset string, sequence string, rate_key string, ave_i_frame_bpp double, ave_p_frame_bpp double, rate_idx int")
    sinks.write_result_document(df, str(tmp_path / "doc"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    want = {}
    for _, d, s, k, b, p, i in rows:
        want.setdefault(d, {}).setdefault(s, {})[k] = {"ave_i_frame_bpp": float(f"{b:.6f}"), **({"ave_p_frame_bpp": p} if p else {}), "rate_idx": i}
    assert json.loads(text) == want
    from rdspark.sources.indented_logs import read_indented_log
    again = read_indented_log(spark, "m", str(tmp_path / "doc"), split_bytes=100)
    assert {(r["dataset"], r["sequence"], r["rate_key"], r["rate_idx"]) for r in again.collect()} == {(d, s, k, i) for _, d, s, k, _, _, i in rows}
    sinks.write_result_log(df, str(tmp_path / "lines"))
    back = rl.read_result_log(spark, "m", str(tmp_path / "lines"))
    assert {(r["dataset"], r["sequence"], r["rate_key"], r["ave_i_frame_bpp"]) for r in back.collect()} == {
        (d, s, k, float(f"{b:.6f}")) for _, d, s, k, b, *_ in rows}


def test_average_path():
    assert sinks.average_path("/x/y/log.json") == "/x/y/log_avg.json"
    assert sinks.average_path("log.v1.json") == "log.v1_avg.json"


def test_report_order_and_cells(spark):
    df = spark.createDataFrame([("* Average", 1.0), ("b", -0.04), ("* Overall", None), ("a", 0.25)], "sequence string, bd_rate double")
    got = c.report_cells(df).orderBy(*c.report_order(df, "sequence")).collect()
    assert [(r[0], r[1]) for r in got] == [("a", "0.2"), ("b", "-0.0"), ("* Overall", None), ("* Average", "1.0")]


def test_compare_sequence_has_summary_rows(spark):
    rows = []
    for m, f in (("a", 1.0), ("b", 1.1)):
        for s in ("s1", "s2"):
            for k in range(4):
                rows.append((m, "D", s, f"{k:03d}", 1, 3, *[f * (k + 1)] * 3, *[30.0 + k] * 3))
    df = spark.createDataFrame(rows, "method string, dataset string, sequence string, rate_key string, i_frame_num int, p_frame_num int, "
                               "ave_i_frame_bpp double, ave_p_frame_bpp double, ave_all_frame_bpp double, ave_i_frame_psnr double, ave_p_frame_psnr double, ave_all_frame_psnr double")
    got = {(r["sequence"], r["frame_group"]): r["bd_rate"] for r in compare(df, "a", "sequence").collect()}
    assert len(got) == 12 and all(v == pytest.approx(10) for v in got.values())
    assert compare(df, "a", rate_exclude=["000", "001"]).count() == 0
    with pytest.raises(ValueError):
        compare(df, "a", "frame")


def test_configs(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"root_path": "/r/", "test_classes": {
        "U": {"test": 1, "base_path": "U", "src_type": "yuv420", "sequences": {"x.yuv": {"width": 8, "height": 4, "frames": 10, "intra_period": -1}}},
        "V": {"test": 0, "base_path": "V", "src_type": "png", "sequences": {"y": {"width": 8, "height": 4, "frames": 5, "gop": 12}}},
        "K": {"test": 1, "base_path": "k", "src_type": "png", "img_folder": 1}}}, indent=4))
    (tmp_path / "b.json").write_text(json.dumps({"W": {"base_path": "/d/W/", "sequences": {"z": {"frames": 96, "gop": 10}}}}))
    df = configs.read_test_config(spark, str(tmp_path))
    got = {r["dataset"]: r.asDict() for r in df.collect()}
    assert got["U"]["base_path"] == "/r/U" and got["U"]["intra_period"] == -1 and got["U"]["enabled"]
    assert not got["V"]["enabled"] and got["V"]["intra_period"] == 12
    assert got["K"]["img_folder"] and got["K"]["sequence"] is None
    assert got["W"]["base_path"] == "/d/W/" and got["W"]["enabled"] and got["W"]["intra_period"] == 10 and got["W"]["width"] is None
    moved = configs.read_test_config(spark, str(tmp_path / "a.json"), root_path="/else")
    assert moved.filter("dataset = 'U'").first()["base_path"] == "/else/U"
    jobs = plan_evaluation(moved.filter("sequence is not null"), steps=4)
    assert [(r["qp_i"], r["bin_name"]) for r in jobs.orderBy("rate_idx").collect()] == [(q, f"x.yuv_q{q}.bin") for q in (0, 21, 42, 63)]


def test_resume(spark):
    jobs = spark.createDataFrame([("d", "s", q, 10) for q in (0, 21, 42)], "dataset string, sequence string, qp_i int, frame_num int")
    done = spark.createDataFrame([("d", "s", 0, 1, 9, True), ("d", "s", 21, 1, 8, True), ("d", "s", 42, 1, 9, False)],
                                 "dataset string, sequence string, qp_i int, i_frame_num int, p_frame_num int, stream_exists boolean")
    assert [r["qp_i"] for r in planning.remaining_jobs(jobs, done).orderBy("qp_i").collect()] == [21, 42]
    assert [r["qp_i"] for r in planning.reusable_points(jobs, done).collect()] == [0]


def test_latest_runs(spark):
    import datetime as dt
    rows = [(f"status_epo{i}", dt.datetime(2024, 1, 1 + i)) for i in range(5)]
    df = spark.createDataFrame(rows, "path string, modificationTime timestamp")
    assert [r["path"] for r in planning.latest_runs(df).collect()] == ["status_epo4", "status_epo3"]


def test_observed_totals(spark):
    df = spark.createDataFrame([("d", "s", 5), ("d", "t", 7)], "dataset string, sequence string, frame_num int")
    out, seen = summary.observe_totals(df)
    assert out.count() == 2 and seen.get == {"frames": 12, "points": 2}


def test_whole_lists_reach_a_stored_point(spark, tmp_path):
    frames = [("m", "d", s, 0, k, int(k > 0), 8 * (k + 1), 64, 30.0 + k, 0.5, "000") for s, n in (("a", 11), ("b\"c", 3), ("z", 4)) for k in range(n)]
    f = spark.createDataFrame(frames, "method string, dataset string, sequence string, rate_idx int, frame_idx int, frame_type int, bits long, pixel_num long, psnr double, msssim double, rate_key string").repartition(5)
    keys = ["dataset", "sequence", "rate_key"]
    p = f.groupBy(*keys).agg(F.sum("bits").alias("frame_pixel_num"))
    chunks = summary.frame_arrays(f, keys, chunk=4)
    want = {s: [30.0 + k for k in range(n)] for s, n in (("a", 11), ("b\"c", 3), ("z", 4))}
    assert {r["sequence"]: r["frame_psnr"] for r in summary.whole_lists(p, chunks, keys).collect()} == want
    with pytest.raises(Exception, match="no frames for point"):
        summary.whole_lists(p, chunks.where("sequence <> 'a'"), keys).collect()
    for name, options in (("plain", {}), ("line", {"compact": True})):
        sinks.write_result_document(p, str(tmp_path / name), lists=chunks, **options)
        back = rl.read_split_log(spark, "m", str(tmp_path / name), joined=True, split_bytes=50).collect()
        assert {r["sequence"]: r["frame_psnr"] for r in back} == want and {r["sequence"]: len(r["frame_type"]) for r in back} == {s: len(v) for s, v in want.items()}


def test_rd_tables_from_text(spark):
    df = lambda text: spark.createDataFrame([("m", "d", text)], "method string, dataset string, value string")
    got = rl.parse_rd_tables(df('{"bpp": [0.1, 0.2], "PSNR": [30, 32.5], "other": [1]}')).collect()
    assert [(r["rate_key"], r["bpp"], r["value"], r["metric"]) for r in got] == [("000", 0.1, 30.0, "psnr"), ("001", 0.2, 32.5, "psnr")]
    for bad in ('{"bpp": [1], "psnr": [1, 2]}', '{"bpp": [1]}', "words"):
        with pytest.raises(Exception):
            rl.parse_rd_tables(df(bad)).collect()
