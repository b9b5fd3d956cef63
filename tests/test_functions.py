import math
import random

import pytest
from pyspark.sql import functions as F

from rdspark.functions import draws, ladders, results as fr


def column(spark, values, expr, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr.alias("r")).collect()]


def test_fixed_digits_match_exact_decimal_rounding(spark):
    rng = random.Random(1)
    values = [rng.uniform(-200, 200) for _ in range(400)] + [k / 1024 for k in range(-300, 300, 7)]
    values += [28.47625, 2.675, 1.005, 0.125, -0.125, -0.04, 0.0, 1e-9, -1e-9, 123456789.5, 33.3333335, 0.5, 1.5, 2.5]
    for digits in (1, 4, 6):
        assert column(spark, values, fr.fixed_digits("v", digits)) == [f"{v:.{digits}f}" for v in values]


def test_psnr_edges(spark):
    mse = [0.0, 1e-10, 2e-10, 1.0, 65025.0, float("nan"), float("inf"), None]
    got = column(spark, mse, fr.psnr_from_mse("v"))
    assert got[:3] == [99.9, 99.9, 99.9]
    assert got[3] == pytest.approx(10 * math.log10(65025)) and got[4] == pytest.approx(0)
    assert got[5:] == [-999.9, -999.9, None]
    open_ = column(spark, [0.0, 0.25], fr.psnr_unclamped("v"))
    assert open_[0] == float("inf") and open_[1] == pytest.approx(20 * math.log10(2))


def test_bool_words(spark):
    words = ["Yes", "y", "TRUE", "t", "1", "no", "0", "maybe", None]
    assert column(spark, words, fr.parse_bool("v"), "string") == [True] * 5 + [False] * 4
    assert column(spark, words[:7], fr.parse_bool("v", strict=True), "string") == [True] * 5 + [False] * 2
    with pytest.raises(Exception, match="Boolean value expected"):
        column(spark, ["maybe"], fr.parse_bool("v", strict=True), "string")


def test_uniform_ladder():
    assert ladders.uniform_ladder(4) == [0, 21, 42, 63]
    import numpy as np
    for n in range(2, 65):
        assert ladders.uniform_ladder(n) == [int(x + 0.5) for x in np.linspace(0, 63, n)]
    with pytest.raises(ValueError):
        ladders.uniform_ladder(1)
    with pytest.raises(ValueError):
        ladders.choose_ladder(3, [1, 2])
    assert ladders.choose_ladder(2, [1, 2]) == ([1, 2], [1, 2])
    assert ladders.choose_ladder(2, [1, 2], [3, 4]) == ([1, 2], [3, 4])
    assert ladders.choose_ladder(2, force_intra=True) == ([0, 63], None)


def test_uniform_qp_column(spark):
    for n in (2, 4, 27, 53, 64):
        got = [r[0] for r in spark.range(n).select(ladders.uniform_qp("id", n)).collect()]
        assert got == ladders.uniform_ladder(n)


def test_log_ladder(spark):
    got = [r[0] for r in spark.range(3).select(ladders.log_spaced("id", 3, 1.0, 100.0, descending=True)).collect()]
    assert got == pytest.approx([100, 10, 1])
    with pytest.raises(ValueError):
        ladders.log_spaced("id", 3, 5.0, 1.0)


def test_rounded_scale(spark):
    values = [0.001, 0.285, 0.125, 3.14159, 700.0, 2.345]
    want = []
    for v in values:
        q = min(max(v, 0.01), 655.0)
        want.append((round(q * 100), round(q * 100) / 100))
    got = column(spark, values, ladders.rounded_scale("v"))
    assert [(r["index"], r["value"]) for r in got] == want


def test_overrides_and_names(spark):
    df = spark.createDataFrame([(32, 10)], "p int, n int")
    pick = lambda **k: df.select(ladders.effective_intra_period("p", **k)).first()[0]
    assert (pick(), pick(force_intra=True), pick(force_intra=True, force_intra_period=8)) == (32, 1, 8)
    assert df.select(ladders.effective_frame_num("n", 5)).first()[0] == 5
    name = spark.createDataFrame([("a.yuv", 21)], "s string, q int").select(ladders.stream_name("s", "q").alias("n"))
    assert name.select("n", ladders.sibling_name("n", ".json")).first() == ("a.yuv_q21.bin", "a.yuv_q21.json")
    paths = spark.createDataFrame([("/r/", "a"), ("/r", "a"), ("/r", "/a"), ("", "a")], "x string, y string")
    assert [r[0] for r in paths.select(ladders.join_path("x", "y")).collect()] == ["/r/a", "/r/a", "/a", "a"]


def test_draws_spread_and_repeat(spark):
    df = spark.range(100000)
    bits = df.select(draws.below(10, "id", 0, 1, 1).alias("d")).groupBy("d").count().collect()
    assert len(bits) == 10 and all(9000 < r["count"] < 11000 for r in bits)
    both = df.select(F.corr(draws.below(1000, "id", 0, 1, 3), draws.below(1000, "id", 0, 1, 4))).first()[0]
    assert abs(both) < 0.02
    a = df.limit(5).select(draws.mix("id", 0, 1, 1)).collect()
    assert a == df.limit(5).select(draws.mix("id", 0, 1, 1)).collect()
    assert a != df.limit(5).select(draws.mix("id", 1, 1, 1)).collect()
