import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rdspark.functions import pixels as px
from rdspark.operators import planes, quality as q


def plain_ms_ssim(a, b, peak=255.0):
    """Direct form: the full two-dimensional window at every position, loops over levels."""
    k = np.arange(11) - 5
    win = np.exp(-(k[:, None] ** 2 + k[None, :] ** 2) / (2 * 1.5 ** 2))
    win /= win.sum()

    def conv(x):
        v = np.lib.stride_tricks.sliding_window_view(x, (11, 11))
        return np.einsum("ijkl,kl->ij", v, win)

    small = min(a.shape) < 176
    w = [0.0517, 0.3295, 0.3462, 0.2726] if small else [0.0448, 0.2856, 0.3001, 0.2363, 0.1333]
    a, b = a.astype(float), b.astype(float)
    out = 1.0
    for i, e in enumerate(w):
        m1, m2 = conv(a), conv(b)
        s1, s2, s12 = conv(a * a) - m1 * m1, conv(b * b) - m2 * m2, conv(a * b) - m1 * m2
        c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
        cs = (2 * s12 + c2) / (s1 + s2 + c2)
        ss = (2 * m1 * m2 + c1) * (2 * s12 + c2) / ((m1 ** 2 + m2 ** 2 + c1) * (s1 + s2 + c2))
        out *= (ss.mean() if i == len(w) - 1 else cs.mean()) ** e
        h, v = a.shape
        shrink = lambda x: np.array([[np.mean([x[min(y + dy, h - 1), min(z + dz, v - 1)] for dy in (0, 1) for dz in (0, 1)])
                                      for z in range(0, v, 2)] for y in range(0, h, 2)])
        if i < len(w) - 1:
            a, b = shrink(a), shrink(b)
    return out


@pytest.mark.parametrize("shape", [(88, 88), (89, 101), (176, 180)])
def test_ms_ssim(shape):
    rng = np.random.default_rng(4)
    a = np.clip(rng.normal(120, 40, shape), 0, 255).astype(np.uint8)
    b = np.clip(a + rng.normal(0, 12, shape), 0, 255).astype(np.uint8)
    assert q.ms_ssim_planes(a, b) == pytest.approx(plain_ms_ssim(a, b), rel=1e-9)
    assert q.ms_ssim_planes(a, a) == pytest.approx(1)
    with pytest.raises(ValueError):
        q.ms_ssim_planes(a[:87], b[:87])


def test_chroma_sizes():
    a = np.arange(12, dtype=float).reshape(3, 4)
    assert px.double(a).tolist() == [[a[y // 2, x // 2] for x in range(8)] for y in range(6)]
    line = px.double(a, 1)
    assert line.shape == (6, 8) and line[0, 0] == a[0, 0] and line[-1, -1] == a[-1, -1]
    assert line[0].tolist() == pytest.approx(np.interp(np.arange(8) * 3 / 7, range(4), a[0]).tolist())
    mid = px.double_centred(a)
    assert mid[0, :3].tolist() == pytest.approx([0, 0.25, 0.75])
    assert px.halve(px.double(a)).tolist() == a.tolist()
    with pytest.raises(ValueError):
        px.halve(a)


def test_colour_round_trip():
    rgb = np.random.default_rng(0).random((3, 6, 8))
    assert np.allclose(px.planes_to_rgb(px.planes_to_ycbcr(rgb)), rgb)
    white = px.planes_to_ycbcr(np.ones((3, 1, 1))).ravel()
    assert white.tolist() == pytest.approx([1, 0.5, 0.5])


def rows(spark, n, w, h, depth=8, seed=0, layout="420"):
    rng = np.random.default_rng(seed)
    t = px.sample_type(depth)
    make = lambda s: rng.integers(0, 1 << depth, s).astype(t)
    half = (h // 2, w // 2) if layout == "420" else (h, w)
    data = [[make((h, w)), make(half), make(half)] for _ in range(n)]
    df = spark.createDataFrame([("s", i, layout, w, h, depth, *[p.tobytes() for p in d]) for i, d in enumerate(data)],
                               "sequence string, frame_idx bigint, layout string, width int, height int, bit_depth int, p0 binary, p1 binary, p2 binary")
    return data, df


def test_scores_of_frames(spark):
    a, fa = rows(spark, 3, 16, 12, seed=1)
    b, fb = rows(spark, 3, 16, 12, seed=2)
    pa, pb = planes.plane_rows(fa, "420"), planes.plane_rows(fb, "420")
    got = {r["frame_idx"]: r for r in q.frame_scores(q.plane_psnr(q.plane_error(q.pair_planes(pa, planes.pad_planes(pb, 16)))), "psnr").collect()}
    for i in range(3):
        s = [10 * math.log10(255 ** 2 / np.mean((x.astype(float) - y) ** 2)) for x, y in zip(a[i], b[i])]
        assert [got[i][f"psnr_{k}"] for k in "yuv"] == pytest.approx(s)
        assert got[i]["psnr"] == pytest.approx((6 * s[0] + s[1] + s[2]) / 8)
    same = q.plane_psnr(q.plane_error(q.pair_planes(pa, pa)))
    assert {r["psnr"] for r in same.collect()} == {99.9}


def test_colour_planes_average(spark):
    a, fa = rows(spark, 1, 88, 88, seed=1, layout="rgb")
    b, fb = rows(spark, 1, 88, 88, seed=1, layout="rgb")
    near = [np.clip(p.astype(int) + 9, 0, 255).astype(np.uint8) for p in a[0]]
    fb = fb.select("sequence", "frame_idx", "layout", "width", "height", "bit_depth", *[F.lit(p.tobytes()).alias(f"p{k}") for k, p in enumerate(near)])
    pairs = q.pair_planes(planes.plane_rows(fa, "rgb"), planes.plane_rows(fb, "rgb"))
    got = q.average_planes(q.plane_ms_ssim(pairs), "msssim").first()["msssim"]
    assert got == pytest.approx(np.mean([q.ms_ssim_planes(x, y) for x, y in zip(a[0], near)]))


def test_tiles_merge(spark):
    e = spark.createDataFrame([("s", 0, "y", 10.0, 4), ("s", 0, "y", 30.0, 4)], "sequence string, frame_idx int, plane string, sse double, n bigint")
    assert q.plane_psnr(e).first()["mse"] == 5.0


def test_pad_and_crop(spark):
    data, f = rows(spark, 1, 10, 6)
    p = planes.plane_rows(f, "420").filter("plane = 'y'")
    big = planes.pad_planes(p, 16).first()
    grown = np.frombuffer(big["data"], np.uint8).reshape(16, 16)
    assert (big["width"], big["height"]) == (16, 16)
    assert (grown[:6, :10] == data[0][0]).all() and (grown[6:, :10] == data[0][0][-1]).all() and (grown[:6, 10:] == data[0][0][:, -1:]).all()
    back = planes.crop_planes(planes.pad_planes(p, 16), 10, 6).first()
    assert back["data"] == data[0][0].tobytes()
    centred = np.frombuffer(planes.pad_planes(p, 16, "constant", centred=True).first()["data"], np.uint8).reshape(16, 16)
    assert (centred[5:11, 3:13] == data[0][0]).all() and centred[:5].sum() == 0


def test_convert_identity_and_depth(spark):
    data, f = rows(spark, 2, 8, 4, depth=10, layout="444")
    up = planes.convert_frames(f, "444", "444", out_depth=16).orderBy("frame_idx").collect()
    assert np.frombuffer(up[0]["p0"], "<u2").tolist() == np.rint(data[0][0] / 1023 * 65535).astype(int).ravel().tolist()
    with pytest.raises(ValueError):
        planes.convert_frames(f, "444", "411")


def test_patches(spark):
    data, f = rows(spark, 1, 6, 4, layout="rgb", seed=9)
    clips = spark.createDataFrame([(1, "s", [0, 0], 1, 2, True, 1, 1, 2, 2)], "sample_id int, sequence string, frame_indexes array<int>, crop_x int, crop_y int, "
                                  "flip boolean, pad_left int, pad_right int, pad_top int, pad_bottom int")
    got = planes.extract_patches(clips, f, 7, 6).orderBy("clip_pos").collect()
    rgb = np.pad(np.stack(data[0])[:, :, ::-1], ((0, 0), (2, 2), (1, 1)))[:, 2:8, 1:8]
    want = (px.planes_to_ycbcr(rgb / 255.0) - 0.5).astype("<f4")
    assert len(got) == 2 and np.allclose(np.frombuffer(got[0]["patch"], "<f4").reshape(3, 6, 7), want)


def test_mismatched_scores(spark):
    e = spark.createDataFrame([("s", i, float(i)) for i in range(4)], "sequence string, frame_idx int, psnr double")
    d = e.filter("frame_idx < 3").withColumn("psnr", F.when(F.col("frame_idx") == 1, 9.0).otherwise(F.col("psnr")))
    assert {r["frame_idx"] for r in q.score_mismatches(e, d).collect()} == {1, 3}


def test_bucketed_planes_meet_without_a_shuffle(spark, tmp_path):
    from rdspark.sinks.planes import write_planes
    _, fa = rows(spark, 12, 16, 12, seed=1)
    _, fb = rows(spark, 12, 16, 12, seed=2)
    for name, f in (("planes_src", fa), ("planes_rec", fb)):
        write_planes(planes.plane_rows(f, "420"), name, str(tmp_path / name), 4)
    errors = q.plane_error(q.pair_planes(spark.table("planes_src"), spark.table("planes_rec")))
    plan = errors._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    loose = q.plane_error(q.pair_planes(planes.plane_rows(fa, "420"), planes.plane_rows(fb, "420")))
    key = lambda d: {(r["frame_idx"], r["plane"]): (r["sse"], r["n"]) for r in d.collect()}
    assert key(errors) == key(loose) and len(key(errors)) == 36
