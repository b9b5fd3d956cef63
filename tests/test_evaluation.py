"""Sources of several sizes in one read, splits, and the frame log put together from its parts."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rdspark.operators import framelog, quality
from rdspark.operators.planes import plane_rows
from rdspark.plans.evaluate import bucketed_planes, frame_log, summarise
from rdspark.sources import source_frames as sf
from rdspark.sources.rawvideo import plane_sizes, read_raw_video

WANTED = "path string, sequence string, width int, height int, layout string, bit_depth int, first_frame long, frame_num long"


def write(path, width, height, layout, depth, frames, seed):
    size = sum(plane_sizes(width, height, layout, depth))
    data = np.random.default_rng(seed).integers(0, 256, size * frames, dtype=np.uint8).tobytes()
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return [data[k * size:(k + 1) * size] for k in range(frames)]


def test_sizes_layouts_and_ranges_in_one_read(spark, tmp_path):
    kinds = [("a", 8, 6, "420", 8, 9, None, None), ("b", 16, 4, "444", 8, 5, 2, None), ("c", 4, 4, "rgb", 10, 7, 1, 3), ("d", 6, 8, "420", 16, 4, None, -1)]
    want, rows = {}, []
    for name, w, h, layout, depth, n, first, count in kinds:
        frames = write(f"{tmp_path}/{name}.yuv", w, h, layout, depth, n, ord(name))
        low = first or 0
        high = n if count is None or count < 0 else low + count
        want |= {(name, k - low): frames[k] for k in range(low, high)}
        rows.append((f"{tmp_path}/{name}" + (".yuv" if name < "c" else ""), name, w, h, layout, depth, first, count))
    df = spark.createDataFrame(rows, WANTED)
    for split, cost in ((1 << 20, 1), (150, 1), (400, 200)):      # all in one split; a large sequence cut; small ones packed
        got = {(r["sequence"], r["frame_idx"]): bytes(r["p0"]) + bytes(r["p1"]) + bytes(r["p2"]) for r in sf.read_source_frames(df, split, cost).collect()}
        assert got == want
    assert {r["sequence"] for r in sf.read_source_frames(df.where("sequence = 'b'")).collect()} == {"b"}
    with pytest.raises(Exception, match="frames"):
        sf.read_source_frames(df.withColumn("frame_num", F.lit(10).cast("long"))).collect()
    with pytest.raises(Exception, match="nowhere"):
        sf.read_source_frames(spark.createDataFrame([(f"{tmp_path}/nowhere", "x", 8, 8, "420", 8, 0, 1)], WANTED)).collect()


def test_segments_of_a_folder(spark, tmp_path):
    parts = [write(f"{tmp_path}/s/seg-{at:012d}.yuv", 8, 8, "420", 8, n, at) for at, n in ((0, 4), (4, 4), (8, 3))]
    every = [f for p in parts for f in p]
    got = sf.read_source_frames(spark.createDataFrame([(f"{tmp_path}/s", "s", 8, 8, "420", 8, 3, 6)], WANTED)).collect()
    assert {r["frame_idx"]: bytes(r["p0"]) for r in got} == {k: every[k + 3][:64] for k in range(6)}


def test_many_small_files_make_few_tasks(spark, tmp_path):
    for k in range(300):
        write(f"{tmp_path}/f{k:03d}.yuv", 8, 8, "420", 8, 1, k)
    rows = [(f"{tmp_path}/f{k:03d}.yuv", f"f{k:03d}", 8, 8, "420", 8, 0, 1) for k in range(300)]
    packed = sf.splits(sf.frame_ranges(spark.createDataFrame(rows, WANTED).repartition(4)), 100 * 96 + 100 * 104, 104).collect()
    assert [len(r["ranges"]) for r in sorted(packed)] == [100, 100, 100]
    got = sf.read_source_frames(spark.createDataFrame(rows, WANTED), 200 * 96)
    assert got.count() == 300
    assert read_raw_video(spark, str(tmp_path), 8, 8).rdd.getNumPartitions() == 2      # 64 MB of opening costs


# --------------------------------------------------------------------------- the frame log


STRUCTURE = "dataset string, sequence string, rate_idx int, frame_idx int, frame_type int, unit_no long, unit_pos long, pixel_num long"
PACKETS = "sequence string, rate_idx int, unit_no long, nal_type int, unit_bytes long"
SCORES = "sequence string, rate_idx int, frame_idx int, psnr double"
KEYS = ["sequence", "rate_idx"]


def parts(spark, frames=5):
    structure = [("d", "s", q, k, int(k > 0), (k + 3) // 4, (k - 1) % 4 if k else 0, 64) for q in (0, 1) for k in range(frames)]
    packets = [("s", q, 0, 0, 3) for q in (0, 1)] + [("s", q, 1, 1, 100 + q) for q in (0, 1)] + [("s", q, 2, 0, 5) for q in (0, 1)] + [("s", q, 3, 2, 50) for q in (0, 1)]
    scores = [("s", q, k, 30.0 + k) for q in (0, 1) for k in range(frames)]
    return structure, packets, scores


def test_parts_meet(spark):
    s, p, c = parts(spark)
    df = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    log = framelog.assembled_frames(df(s, STRUCTURE), framelog.unit_sizes(df(p, PACKETS), KEYS), df(c, SCORES), KEYS)
    got = {(r["rate_idx"], r["frame_idx"]): (r["bits"], r["psnr"]) for r in log.collect()}
    assert got == {(q, k): (8 * (103 + q) if k == 0 else 8 * 55 if k == 1 else 0, 30.0 + k) for q in (0, 1) for k in range(5)}
    for broken in ((s[1:], p, c), (s, p[:-1], c), (s, p, c[1:]), (s, [*p, ("s", 0, 4, 2, 9)], c), (s, p, [*c, ("s", 1, 9, 1.0)]), (s, [*p, ("s", 0, 4, 0, 9)], c)):
        with pytest.raises(Exception, match="no (coded unit|frame|score) for"):
            framelog.assembled_frames(df(broken[0], STRUCTURE), framelog.unit_sizes(df(broken[1], PACKETS), KEYS), df(broken[2], SCORES), KEYS).collect()


def test_partial_errors_merge_before_they_are_scored(spark):
    rows = [("s", 0, p, float(e), n, 8) for p, e, n in (("y", 100, 50), ("y", 300, 50), ("u", 0, 25), ("v", 50, 25))] + [("t", 0, p, 30.0, 10, 10) for p in "rgb"]
    got = {r["sequence"]: r for r in quality.merged_scores(spark.createDataFrame(rows, "sequence string, frame_idx int, plane string, sse double, n long, bit_depth int"), ["sequence", "frame_idx"]).collect()}
    y, v = 10 * np.log10(255 ** 2 / 4), 10 * np.log10(255 ** 2 / 2)
    assert got["s"]["psnr_y"] == pytest.approx(y) and got["s"]["psnr_u"] == 99.9 and got["s"]["psnr"] == pytest.approx((6 * y + 99.9 + v) / 8)
    assert got["t"]["psnr"] == pytest.approx(10 * np.log10(1023 ** 2 / 3)) and got["t"]["psnr_y"] is None


def test_planes_do_not_move_to_be_scored(spark):
    """One rate of two loses a frame: an error. Otherwise bucketed planes meet without an exchange of pixels."""
    r = random.Random(1)
    frame = lambda k, c: ("s", k, 8, 8, 8, bytes(min(255, b + c) for b in base[k][:64]), bytes(base[k][64:80]), bytes(base[k][80:]))
    base = [[r.randrange(250) for _ in range(96)] for _ in range(9)]
    schema = "sequence string, frame_idx long, width int, height int, bit_depth int, p0 binary, p1 binary, p2 binary"
    src = spark.createDataFrame([frame(k, 0) for k in range(9)], schema)
    rec = spark.createDataFrame([(*frame(k, q + 1), q) for k in range(9) for q in (0, 1)], f"{schema}, rate_idx int")
    jobs = spark.createDataFrame([("d", "s", q, 8, 8, 9, -1) for q in (0, 1)], "dataset string, sequence string, rate_idx int, width int, height int, frame_num int, intra_period int")
    packets = spark.createDataFrame([("s", q, u, 1 + (u > 0), 10 + u) for q in (0, 1) for u in (0, 1)], PACKETS)
    src, rec = src.withColumn("layout", F.lit("420")), rec.withColumn("layout", F.lit("420"))
    a, b = bucketed_planes(src, 3), bucketed_planes(rec, 3)
    log = frame_log(jobs, a, b, packets, "m")
    points = {p["rate_idx"]: p for p in summarise(log).collect()}
    for q in (0, 1):
        y = 10 * np.log10(255 ** 2 / (q + 1) ** 2)
        assert points[q]["ave_all_frame_psnr_y"] == pytest.approx(y) and points[q]["ave_i_frame_bpp"] == 10 * 8 / 64 and points[q]["p_frame_num"] == 8
        assert points[q]["ave_all_frame_bpp"] == pytest.approx(21 * 8 / 64 / 9)
    pairs = quality.plane_error(quality.pair_planes(a, b, carry=["rate_idx"]))
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="no score for"):
        frame_log(jobs, a, bucketed_planes(rec.where("rate_idx = 0 or frame_idx < 8"), 3), packets, "m").collect()
    assert plane_rows(rec, "420", ["rate_idx"]).count() == 54
