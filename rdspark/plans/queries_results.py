"""Queries on frame logs: summaries, timing, structure, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from rdspark.functions import ladders, results as fr
from rdspark.operators import structure, summary
from rdspark.plans.catalog import KEYS, METRICS, points, POINTS_SQL, Query, rd, rounded, summary_columns_sql
from rdspark.plans.derived import LOG_FRAMES, table, view, view_sql

FRAMES = view_sql("frames")
POINT = ["method", "dataset", "sequence", "rate_idx"]
ORDER = ["frame_idx", *[c for c in LOG_FRAMES if c not in (*POINT, "frame_idx")]]
NUMBERED = (f"{FRAMES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY {', '.join(ORDER)}) - 1 AS pos "
            "FROM frames)")


def frames(spark, sf):
    return view(spark, sf, "frames")


def numbered(spark, sf):
    return structure.number_frames(frames(spark, sf), POINT, ORDER, out="pos")


def _summary(spark, sf):
    return summary.sequence_summary(frames(spark, sf))


def _recombined(spark, sf):
    kept = summary.keep_columns(points(spark, sf), [*POINT, "i_frame_num", "p_frame_num",
                                                    *[f"ave_{g}_frame_{m}" for g in "ip" for m in ("bpp", "psnr", "msssim")]])
    cols = [f"ave_all_frame_{m}" for m in ("bpp", "psnr", "msssim")]
    return summary.recombine(kept).select(*POINT, *cols)


def _arrays(spark, sf):
    a = summary.frame_arrays(numbered(spark, sf), chunk=64, frame_idx="pos")
    lists = F.arrays_zip("frame_bpp", "frame_psnr", "frame_msssim", "frame_type")
    return (a.select(*POINT, "chunk_no", "first_frame", F.posexplode(lists).alias("at", "f"))
            .select(*POINT, "chunk_no", "first_frame", "at", "f.frame_bpp", "f.frame_psnr", "f.frame_msssim",
                    "f.frame_type"))


def _unit_timing(spark, sf):
    return summary.unit_timing(numbered(spark, sf), unit_no="pos")


def _timing_report(spark, sf):
    timed = summary.unit_timing(numbered(spark, sf), unit_no="pos")
    return rounded(summary.timing_report(timed, "class_1", delay=8), 6)


def _frame_columns(spark, sf):
    f = frames(spark, sf)
    log = lambda c: rd(c, 6)
    edge = F.when(F.col("frame_type") == 0, float("nan")).otherwise(F.col("mse") * 1e-9)
    return f.select(
        *POINT, "frame_idx", "bits", fr.bits_per_pixel("bits", "pixel_num").alias("bpp"),
        fr.weighted_plane_mean("psnr_y", "psnr_u", "psnr_v").alias("psnr_yuv"),
        fr.weighted_plane_mean("msssim_y", "msssim_u", "msssim_v").alias("msssim_yuv"),
        log(fr.psnr_from_mse("mse")).alias("psnr_255"), log(fr.psnr_from_mse(edge, 1.0)).alias("psnr_edge"),
        log(F.coalesce(F.nullif(fr.psnr_unclamped("mse"), F.lit(float("inf"))), F.lit(-1.0))).alias("psnr_open"),
        log(fr.combined_mse("mse", F.col("mse") / 2, F.col("mse") * F.col("mse"), F.col("mse") + 1)).alias("mixed"),
        fr.hierarchy_weight("frame_idx").alias("weight8"), fr.hierarchy_weight("frame_idx", 4).alias("weight4"),
        log(fr.information_bits(F.col("mse"))).alias("info"), fr.rd_cost("psnr", "mse", F.lit(3.5)).alias("cost"))


_FRAME_COLUMNS_SQL = f"""WITH {FRAMES}
SELECT {KEYS}, frame_idx, bits, CAST(bits AS DOUBLE) / pixel_num AS bpp,
  (6 * psnr_y + psnr_u + psnr_v) / 8 AS psnr_yuv, (6 * msssim_y + msssim_u + msssim_v) / 8 AS msssim_yuv,
  round(least(CASE WHEN mse > 1e-10 THEN 10 * log10(65025e0 / mse) ELSE 999.9e0 END, 99.9e0), 6) AS psnr_255,
  round(CASE WHEN frame_type = 0 THEN -999.9e0 ELSE
    least(CASE WHEN mse * 1e-9 > 1e-10 THEN 10 * log10(1e0 / (mse * 1e-9)) ELSE 999.9e0 END, 99.9e0) END, 6) AS psnr_edge,
  round(CASE WHEN mse = 0 THEN -1e0 ELSE 20 * log10(1 / sqrt(mse)) END, 6) AS psnr_open,
  round(0.8e0 * 3 * exp(0.0833e0 * (10 * ln(greatest(mse, 1e-6)) + ln(greatest(mse / 2, 1e-6))
    + ln(greatest(mse * mse, 1e-6)))) + 0.2e0 * (mse + 1), 6) AS mixed,
  CASE frame_idx % 8 WHEN 1 THEN 1.33e0 WHEN 3 THEN 0.83e0 WHEN 5 THEN 0.83e0 WHEN 7 THEN 0.83e0 ELSE 0.52e0 END AS weight8,
  CASE frame_idx % 4 WHEN 1 THEN 1.33e0 WHEN 3 THEN 0.83e0 ELSE 0.52e0 END AS weight4,
  round(greatest(-log2(greatest(mse, 1e-6)), 0e0), 6) AS info, 3.5e0 * mse + psnr AS cost
FROM frames"""


def _kbps(spark, sf):
    g = frames(spark, sf).groupBy(*POINT).agg(F.sum("bits").alias("b"), F.count(F.lit(1)).alias("frames"))
    return g.select(*POINT, "frames", fr.kilobits_per_second(F.floor(F.col("b") / 8), "frames").alias("kbps"),
                    fr.fixed_digits(F.col("b") / 1024, 1).alias("kbit_text"))


WORDS = ("CASE o_orderkey % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN 'y' WHEN 2 THEN 'TRUE' WHEN 3 THEN 't' WHEN 4 THEN '1' "
         "WHEN 5 THEN 'No' ELSE o_orderpriority END")


def _flags(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", f"{WORDS} AS word")
    return o.select("o_orderkey", "word", fr.parse_bool("word").alias("flag"))


def _best_rate(spark, sf):
    """Cheapest rate of every sequence under the multiplier of each rate's own quality index."""
    g = (frames(spark, sf).groupBy(*POINT).agg(F.avg("mse").alias("mse"), (F.avg("bits") / 99840).alias("bpp"))
         .withColumn("lam", ladders.log_between(ladders.uniform_qp("rate_idx", 7), 64, 10.0, 1500.0)))
    return rounded(summary.best_rate_per_multiplier(g, ["method", "dataset", "sequence"]), 6)


def _chunks(spark, sf):
    return rounded(summary.chunk_distortion(numbered(spark, sf), POINT, "pos"), 11)


def _totals(spark, sf):
    p = points(spark, sf).withColumn("frame_num", F.col("i_frame_num") + F.col("p_frame_num"))
    timed = p.withColumn("test_time", F.col("frame_num") * F.lit(0.25))
    return rounded(summary.run_totals(timed), 6)


def _symbols(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.explode(F.split("text", "")).alias("ch"))
    return rounded(summary.symbol_information(d, ["lang"], "ch"), 3)


def _first_frames(spark, sf):
    """The first 16 frames of each point after skipping 4."""
    n = numbered(spark, sf).filter(F.col("pos").between(4, 19))
    return n.groupBy(*POINT).agg(F.count(F.lit(1)).alias("frames"), F.sum("bits").alias("bits"))


def _regular_types(spark, sf):
    f = frames(spark, sf)
    period = F.when(F.col("rate_idx") == 0, -1).otherwise((F.col("rate_idx") + 1) * 4)
    plain = structure.regular_frame_type("frame_idx", 12)
    return f.select(*POINT, "frame_idx", "bits", plain.alias("plain_type"), structure.group_number("frame_idx", 12).alias("gop_no"),
                    structure.regular_frame_type("frame_idx", period, open_ended=True).alias("open_type"),
                    structure.reset_flag_plain("frame_idx", plain, 32).alias("reset"))


QUERIES = {
    "sequence_summary": Query(_summary, f"""WITH {FRAMES}
SELECT {KEYS}, max(pixel_num) AS frame_pixel_num, count(*) FILTER (frame_type = 0) AS i_frame_num,
  count(*) FILTER (frame_type <> 0) AS p_frame_num, {summary_columns_sql(METRICS)} FROM frames GROUP BY {KEYS}"""),
    "frame_type_groups": Query(
        lambda s, f: summary.frame_type_groups(frames(s, f)),
        f"""WITH {FRAMES}, tagged AS (SELECT *, 'all' AS frame_group FROM frames UNION ALL
  SELECT *, CASE WHEN frame_type = 0 THEN 'i' ELSE 'p' END FROM frames)
SELECT {KEYS}, frame_group, count(*) AS frame_num, avg(bits) / max(pixel_num) AS bpp, avg(psnr) AS psnr,
  avg(msssim) AS msssim FROM tagged GROUP BY {KEYS}, frame_group"""),
    "component_summary": Query(
        lambda s, f: summary.component_summary(frames(s, f)),
        f"""WITH {FRAMES}
SELECT {KEYS}, count(*) FILTER (frame_type <> 0) AS p_frame_num, """ + ", ".join(
            f"CASE WHEN count(*) FILTER (frame_type <> 0) > 0 THEN CAST(sum({c}) FILTER (frame_type <> 0) AS DOUBLE) / "
            f"(count(*) FILTER (frame_type <> 0) * max(pixel_num)) ELSE 0e0 END AS ave_p_frame_bpp{n}"
            for c, n in [("bits", "")] + [(f"bits_{k}", f"_{k}") for k in ("mv_y", "mv_z", "y", "z")])
        + f" FROM frames GROUP BY {KEYS}"),
    "recombined_means": Query(_recombined, f"WITH {POINTS_SQL} SELECT {KEYS}, " + ", ".join(
        f"(i_frame_num * ave_i_frame_{m} + p_frame_num * ave_p_frame_{m}) / (i_frame_num + p_frame_num) AS ave_all_frame_{m}"
        for m in ("bpp", "psnr", "msssim")) + " FROM points"),
    "number_frames": Query(lambda s, f: numbered(s, f).select(*POINT, "frame_idx", "bits", "pos"),
                           f"WITH {NUMBERED} SELECT {KEYS}, frame_idx, bits, pos FROM numbered"),
    "frame_arrays": Query(_arrays, f"""WITH {NUMBERED}
SELECT {KEYS}, CAST(floor(pos / 64) AS BIGINT) AS chunk_no, CAST(floor(pos / 64) * 64 AS BIGINT) AS first_frame,
  CAST(pos % 64 AS INT) AS at, CAST(bits AS DOUBLE) / pixel_num AS frame_bpp, psnr AS frame_psnr,
  msssim AS frame_msssim, frame_type FROM numbered"""),
    "first_frames": Query(_first_frames, f"""WITH {NUMBERED}
SELECT {KEYS}, count(*) AS frames, CAST(sum(bits) AS BIGINT) AS bits FROM numbered WHERE pos >= 4 AND pos < 20 GROUP BY {KEYS}"""),
    "unit_timing": Query(_unit_timing, f"""WITH {NUMBERED}
SELECT {KEYS}, count(*) AS unit_num, CASE WHEN count(*) > 4 THEN avg(enc_s) FILTER (pos >= 4) END AS avg_frame_encoding_time,
  CASE WHEN count(*) > 4 THEN avg(dec_s) FILTER (pos >= 4) END AS avg_frame_decoding_time FROM numbered GROUP BY {KEYS}"""),
    "timing_report": Query(_timing_report, f"""WITH {NUMBERED}, timed AS (SELECT {KEYS}, avg(enc_s) FILTER (pos >= 4) AS e,
  avg(dec_s) FILTER (pos >= 4) AS d FROM numbered GROUP BY {KEYS} HAVING count(*) > 4)
SELECT method, round(avg(e) * 1000, 6) AS encode_ms, round(8 / avg(e), 6) AS encode_fps, round(avg(d) * 1000, 6) AS decode_ms,
  round(8 / avg(d), 6) AS decode_fps FROM timed WHERE dataset = 'class_1' GROUP BY method"""),
    "predicted_frame_time": Query(
        lambda s, f: summary.predicted_frame_time(frames(s, f)),
        f"""WITH {FRAMES}
SELECT {KEYS}, count(*) FILTER (frame_type <> 0) AS p_frame_num, avg(enc_s) FILTER (frame_type <> 0) * 1000 AS encode_ms,
  avg(dec_s) FILTER (frame_type <> 0) * 1000 AS decode_ms FROM frames GROUP BY {KEYS}"""),
    "rate_quality_label": Query(
        lambda s, f: summary.rate_quality_label(frames(s, f)),
        f"""WITH {FRAMES}, m AS (SELECT {KEYS}, avg(bits) / max(pixel_num) AS b, avg(psnr) AS q FROM frames GROUP BY {KEYS})
SELECT {KEYS}, b AS avg_bpp, q AS avg_psnr, printf('%d_%.4f_%.4f', rate_idx, b, q) AS label FROM m"""),
    "frame_score_columns": Query(_frame_columns, _FRAME_COLUMNS_SQL),
    "stream_kbps": Query(_kbps, f"""WITH {FRAMES}
SELECT {KEYS}, count(*) AS frames,
  CAST(floor(floor(CAST(sum(bits) AS DOUBLE) / 8) * 8 / (count(*) / 30e0) / 1000) AS BIGINT) AS kbps,
  printf('%.1f', CAST(sum(bits) AS DOUBLE) / 1024) AS kbit_text FROM frames GROUP BY {KEYS}"""),
    "parse_flags": Query(_flags, f"""SELECT o_orderkey, {WORDS} AS word,
  lower({WORDS}) IN ('yes', 'y', 'true', 't', '1') AS flag FROM orders"""),
    "best_rate": Query(_best_rate, f"""WITH {FRAMES}, p AS (SELECT {KEYS}, avg(mse) AS mse, avg(bits) / 99840 AS bpp FROM frames
  GROUP BY {KEYS}), c AS (SELECT *, exp(ln(10e0) + floor(rate_idx * (63e0 / 6e0) + 0.5e0) * ((ln(1500e0) - ln(10e0)) / 63))
  * mse + bpp AS cost FROM p)
SELECT method, dataset, sequence, round(avg(cost), 6) AS mean_cost, round(min(cost), 6) AS best_cost,
  arg_min(rate_idx, cost) AS best_rate_idx FROM c GROUP BY method, dataset, sequence"""),
    "chunk_distortion": Query(_chunks, f"""WITH {NUMBERED}
SELECT {KEYS}, CAST(floor(pos / 8) AS BIGINT) AS chunk_no, count(*) AS frames, CASE WHEN count(*) = 8 AND count(DISTINCT pos) = 8 THEN round(sum(mse * CASE WHEN pos % 8 = 7 THEN 1.5e0
  WHEN pos % 2 = 0 THEN 0.16e0 ELSE 0.4e0 END), 11) END AS weighted_mse
FROM numbered GROUP BY {KEYS}, floor(pos / 8)"""),
    "run_totals": Query(_totals, f"""WITH {POINTS_SQL}
SELECT CAST(sum(i_frame_num + p_frame_num) AS BIGINT) AS frames, count(DISTINCT dataset || '/' || sequence) AS sequences,
  count(*) AS points, round(sum((i_frame_num + p_frame_num) * 0.25e0) / 60, 6) AS minutes FROM points"""),
    "symbol_information": Query(_symbols, """WITH c AS (SELECT lang, ch, count(*) AS n FROM
  (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents) GROUP BY lang, ch),
t AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS total FROM c)
SELECT lang, CAST(sum(n) AS BIGINT) AS symbols, count(*) AS distinct_symbols,
  round(sum(n * -log2(CAST(n AS DOUBLE) / total)), 3) AS bits FROM t GROUP BY lang"""),
    "regular_frame_types": Query(_regular_types, f"""WITH {FRAMES}
SELECT {KEYS}, frame_idx, bits, CASE WHEN frame_idx % 12 = 0 THEN 0 ELSE 1 END AS plain_type,
  CAST(floor(frame_idx / 12) AS BIGINT) AS gop_no,
  CASE WHEN frame_idx = 0 OR (rate_idx > 0 AND frame_idx % CASE WHEN rate_idx = 0 THEN 1 ELSE (rate_idx + 1) * 4 END = 0)
    THEN 0 ELSE 1 END AS open_type,
  CASE WHEN frame_idx % 12 <> 0 AND frame_idx % 32 = 1 THEN 1 ELSE 0 END AS reset FROM frames"""),
}
