"""Rows and values that must not get lost in silence: either they are there, or the job fails."""

import json

import numpy as np
import pytest

from rdspark.operators import curation as cu, planes, planning, quality as q, summary
from rdspark.plans.evaluate import summarise
from rdspark.sources import configs, manifests, result_logs as rl, storage
from rdspark.sources.indented_logs import read_indented_log

LOG = {d: {s: {f"{k:03d}": {"ave_i_frame_bpp": k + 0.5, "rate_idx": k} for k in range(3)} for s in ("x", "y")} for d in ("A", "B")}


def keys(df):
    return {(r["dataset"], r["sequence"], r["rate_key"], r["ave_i_frame_bpp"]) for r in df.collect()}


EXPECTED = {(d, s, f"{k:03d}", k + 0.5) for d in "AB" for s in "xy" for k in range(3)}


@pytest.mark.parametrize("indent", [1, 2, 4, 7])
def test_logs_of_any_indent(spark, tmp_path, indent):
    (tmp_path / "log").write_text(json.dumps(LOG, indent=indent))
    assert keys(read_indented_log(spark, "m", str(tmp_path / "log"), split_bytes=64)) == EXPECTED
    assert keys(rl.read_result_log(spark, "m", str(tmp_path / "log"))) == EXPECTED


def test_compact_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text(json.dumps(LOG))
    assert keys(rl.read_result_log(spark, "m", str(tmp_path / "log.txt"))) == EXPECTED
    with pytest.raises(Exception, match="not indented"):
        read_indented_log(spark, "m", str(tmp_path / "log.txt")).collect()


def test_folder_of_documents(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    for d in LOG:
        (tmp_path / "logs" / f"{d}.json").write_text(json.dumps({d: LOG[d]}, indent=2))
    assert keys(rl.read_result_log(spark, "m", str(tmp_path / "logs"))) == EXPECTED


def test_malformed_documents_fail(spark):
    bad = spark.createDataFrame([('{"A": [1, 2',)], "value string")
    for parse in (lambda: rl.parse_result_log(bad, "m"), lambda: configs.parse_test_config(bad), lambda: manifests.parse_image_manifest(bad, "/r"),
                  lambda: manifests.parse_video_manifest(bad)[0]):
        with pytest.raises(Exception):
            parse().collect()


def test_missing_metrics(spark):
    cols = "method string, dataset string, sequence string, rate_idx int, frame_idx int, frame_type int, pixel_num bigint, bits bigint, " + ", ".join(
        f"{m} double" for m in summary.metric_names())
    none = [None] * (len(summary.metric_names()) - 1)
    rows = [("m", "d", "s", 0, 0, 0, 100, 50, None, *none), ("m", "d", "s", 0, 1, 1, 100, 50, 30.0, *none), ("m", "d", "s", 0, 2, 1, 100, 50, None, *none)]
    r = summarise(spark.createDataFrame(rows, cols)).first()
    assert r["ave_i_frame_psnr"] is None and r["ave_p_frame_psnr"] == 30.0 and r["ave_all_frame_psnr"] == 30.0
    assert r["ave_i_frame_msssim"] is None and r["ave_p_frame_msssim"] is None and r["ave_all_frame_msssim"] is None
    assert r["ave_all_frame_bpp"] == 0.5


def test_information_has_no_floor(spark):
    """Three million symbols, a thousand of them single."""
    df = spark.range(3_000_000).selectExpr("'g' AS g", "CASE WHEN id < 1000 THEN id ELSE -1 END AS s")
    r = summary.symbol_information(df, ["g"], "s").first()
    n = 3_000_000
    want = 1000 * np.log2(n) - (n - 1000) * np.log2((n - 1000) / n)
    assert r["bits"] == pytest.approx(want, rel=1e-9) and r["symbols"] == n and r["distinct_symbols"] == 1001


def test_chunks_that_are_short_or_repeat(spark):
    rows = [("s", k, 1.0) for k in range(11)] + [("t", k % 7, 1.0) for k in range(8)]
    got = {(r["sequence"], r["chunk_no"]): (r["frames"], r["weighted_mse"]) for r in summary.chunk_distortion(
        spark.createDataFrame(rows, "sequence string, frame_idx int, mse double"), ["sequence"]).collect()}
    assert got["s", 0][0] == 8 and got["s", 0][1] > 0 and got["s", 1] == (3, None) and got["t", 0] == (8, None)


def test_manifests_stay_apart(spark):
    doc = lambda tag: json.dumps({"seqs": [{"path": f"{tag}{k}", "width": 8, "height": 8, "seq_length": 2} for k in range(2)], "frames": [f"{tag}_1", f"{tag}_2"]})
    seqs, names = manifests.parse_video_manifest(spark.createDataFrame([("a", doc("a")), ("b", doc("b"))], "manifest string, value string"))
    got = [(r["path"], r["frame_name"]) for r in cu.manifest_frames(seqs, names).collect()]
    assert len(got) == 8 and all(p[0] == n[0] for p, n in got)


def test_short_name_list_fails(spark):
    doc = json.dumps({"seqs": [{"path": "a", "width": 8, "height": 8, "seq_length": 3}], "frames": ["1", "2"]})
    with pytest.raises(Exception, match="no file name for frame 2 of a"):
        cu.manifest_frames(*manifests.parse_video_manifest(spark.createDataFrame([(doc,)], "value string"))).collect()


def plane(spark, rows):
    return spark.createDataFrame(rows, "sequence string, frame_idx int, plane string, width int, height int, bit_depth int, data binary")


def deep(value):
    return np.full((2, 2), value, "<u2").tobytes()


def test_psnr_follows_the_bit_depth(spark):
    a, b = (plane(spark, [("s", 0, "y", 2, 2, 10, bytearray(deep(v)))]) for v in (100, 104))
    r = q.plane_psnr(q.plane_error(q.pair_planes(a, b))).first()
    assert r["mse"] == 16 and r["psnr"] == pytest.approx(10 * np.log10(1023 ** 2 / 16))
    shallow = plane(spark, [("s", 0, "y", 2, 2, 8, bytearray(b"\1\2\3\4"))])
    with pytest.raises(Exception, match="two bit depths"):
        q.plane_error(q.pair_planes(a, shallow)).collect()


def test_a_missing_frame_fails(spark):
    a = plane(spark, [("s", k, "y", 2, 2, 8, bytearray(b"\1\2\3\4")) for k in range(2)])
    with pytest.raises(Exception, match="no pair for plane"):
        q.plane_error(q.pair_planes(a, a.filter("frame_idx = 0"))).collect()
    assert q.pair_planes(a, a.filter("frame_idx = 0"), only_common=True).count() == 1


def test_an_empty_image_folder_fails(spark):
    conf = configs.parse_test_config(spark.createDataFrame([(json.dumps({"root_path": "/r", "test_classes": {"K": {"base_path": "k", "img_folder": 1}}}),)], "value string"))
    with pytest.raises(Exception, match="no pictures in"):
        planning.expand_image_folders(conf, spark.createDataFrame([("/r/other/a.png",)], "path string")).collect()


def test_a_clip_without_its_picture_fails(spark):
    clips = spark.createDataFrame([(1, "s", 0, 0, False, 0, 0, 0, 0, [0, 1])], "sample_id int, sequence string, crop_x int, crop_y int, flip boolean, pad_left int, pad_right int, "
                                  "pad_top int, pad_bottom int, frame_indexes array<int>")
    frames = spark.createDataFrame([("s", 0, 2, 2, 8, *[bytearray(b"\1\2\3\4")] * 3)], "sequence string, frame_idx int, width int, height int, bit_depth int, p0 binary, p1 binary, p2 binary")
    with pytest.raises(Exception, match="no picture for frame 1 of s"):
        planes.extract_patches(clips, frames, 2, 2).collect()


def test_a_long_ladder_is_no_special_case(spark):
    conf = spark.createDataFrame([("d", "s", True, 8, 4)], "dataset string, sequence string, enabled boolean, frame_num int, intra_period int")
    jobs = planning.job_matrix(conf, qp_i=list(range(5000)), steps=5000)
    assert jobs.count() == 5000


def test_scratch_needs_a_shared_folder_on_a_cluster():
    assert storage._local_base("local[4]")
    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage._local_base(master)


def test_scratch_is_tidied(spark):
    df = storage.stored(spark.range(3), "tidy")
    path = df.inputFiles()[0]
    assert storage.clear_scratch(spark) > 0
    import os
    assert not os.path.exists(path.removeprefix("file://"))
