"""Queries that compare methods: class means, curves, BD-rate, reports, result logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rdspark.operators import comparison as c
from rdspark.operators.ordered import ordered_scan
from rdspark.operators.summary import frame_arrays
from rdspark.plans.catalog import POINTS_SQL, Query, points, rounded, stored_points
from rdspark.plans.compare import compare
from rdspark.plans.derived import LOG_FRAMES, view, view_sql
from rdspark.sinks import results as sinks
from rdspark.sources.indented_logs import read_indented_log
from rdspark.sources.result_logs import parse_rd_tables, read_points, read_result_logs, read_split_log
from rdspark.sources.storage import scratch_path, stored

ANCHOR = "A"
ALL_METRICS = c.ALL_METRICS
GROUPS = ("i", "p", "all")
# By number, then by what frames of one number have: they are told apart whatever the engine.
FRAME_ORDER = ["frame_idx", *[k for k in LOG_FRAMES if k not in ("method", "dataset", "sequence", "rate_idx", "frame_idx")]]


def values_of(df, column: str) -> list[str]:
    """The methods or classes of a table of points, in order: they name columns and files, so they are few."""
    return sorted(r[0] for r in df.select(column).distinct().collect())


def tested(df) -> list[str]:
    return [m for m in values_of(df, "method") if m != ANCHOR]


# --------------------------------------------------------------------------- checking SQL


def rows_sql(metrics=("psnr",), groups=GROUPS) -> str:
    """Long form of the points, as a union."""
    count = {"i": "i_frame_num", "p": "p_frame_num", "all": "i_frame_num + p_frame_num"}
    return " UNION ALL ".join(
        f"SELECT method, dataset, sequence, rate_key, '{g}' AS frame_group, '{m}' AS metric, ave_{g}_frame_bpp AS bpp, "
        f"ave_{g}_frame_{m} AS value, {count[g]} AS frames FROM points" for g in groups for m in metrics)


def class_sql(metrics=("psnr",), groups=GROUPS) -> str:
    return (f"prows AS ({rows_sql(metrics, groups)}), crows AS (SELECT method, dataset, rate_key, frame_group, metric, "
            "CAST(sum(frames) AS BIGINT) AS frames, sum(bpp * frames) / greatest(sum(frames), 1) AS bpp, "
            "sum(value * frames) / greatest(sum(frames), 1) AS value FROM prows "
            "GROUP BY method, dataset, rate_key, frame_group, metric)")


def bd_sql(rows: str, keys: str, tag: str) -> str:
    """BD-rate as plain SQL: piecewise-cubic curves through ln(bpp), 100 samples, trapezoid rule."""
    shared = f"{keys}, frame_group, metric"
    curve = f"method, {shared}"
    join = " AND ".join(f"x.{k.strip()} = y.{k.strip()}" for k in shared.split(","))
    end = lambda h0, h1, d0, d1: (
        f"CASE WHEN {d1} IS NULL THEN {d0} WHEN sign(((2*{h0}+{h1})*{d0}-{h0}*{d1})/({h0}+{h1})) <> sign({d0}) THEN 0 "
        f"WHEN sign({d0}) <> sign({d1}) AND abs(((2*{h0}+{h1})*{d0}-{h0}*{d1})/({h0}+{h1})) > 3*abs({d0}) THEN 3*{d0} "
        f"ELSE ((2*{h0}+{h1})*{d0}-{h0}*{d1})/({h0}+{h1}) END")
    return f"""
{tag}_ends AS (SELECT {curve}, count(*) AS n, arg_min(bpp, rate_key) AS fb, arg_min(value, rate_key) AS fv,
  min(value) AS lo, max(value) AS hi FROM {rows} GROUP BY {curve}),
{tag}_pairs AS (SELECT x.method, {", ".join("x." + k.strip() for k in shared.split(","))}, greatest(x.lo, y.lo) AS lo, least(x.hi, y.hi) AS hi
  FROM {tag}_ends x JOIN {tag}_ends y ON {join} WHERE y.method = '{ANCHOR}' AND x.method <> '{ANCHOR}' AND y.fb > 0
  AND x.n >= 3 AND x.fv > 0),
{tag}_pts AS (SELECT {curve}, value AS q, CASE WHEN min(bpp) > 0 THEN avg(ln(CASE WHEN bpp > 0 THEN bpp END)) END AS r
  FROM {rows} GROUP BY {curve}, value),
{tag}_h AS (SELECT *, lead(q) OVER w - q AS h, (lead(r) OVER w - r) / (lead(q) OVER w - q) AS d FROM {tag}_pts
  WINDOW w AS (PARTITION BY {curve} ORDER BY q)),
{tag}_n AS (SELECT *, lag(h) OVER w AS hm, lag(d) OVER w AS dm, lag(h, 2) OVER w AS hmm, lag(d, 2) OVER w AS dmm,
  lead(h) OVER w AS hn, lead(d) OVER w AS dn FROM {tag}_h WINDOW w AS (PARTITION BY {curve} ORDER BY q)),
{tag}_s AS (SELECT *, CASE WHEN hm IS NOT NULL AND h IS NOT NULL THEN CASE WHEN d IS NULL OR dm IS NULL THEN NULL
    WHEN d * dm > 0 THEN 3 * (h + hm) / ((2 * h + hm) / dm + (h + 2 * hm) / d) ELSE 0 END
  WHEN h IS NOT NULL THEN {end('h', 'hn', 'd', 'dn')} WHEN hm IS NOT NULL THEN {end('hm', 'hmm', 'dm', 'dmm')} END AS m
  FROM {tag}_n),
{tag}_seg AS (SELECT *, lead(q) OVER w AS q1, lead(r) OVER w AS r1, lead(m) OVER w AS m1, lead(q, 2) OVER w IS NULL AS is_last
  FROM {tag}_s WINDOW w AS (PARTITION BY {curve} ORDER BY q)),
{tag}_x AS (SELECT p.*, k.k, CASE WHEN k.k = 99 THEN hi ELSE lo + k.k * ((hi - lo) / 99) END AS x,
  CASE WHEN k.k IN (0, 99) THEN 0.5e0 ELSE 1e0 END AS w FROM {tag}_pairs p, range(100) k(k) WHERE hi > lo),
{tag}_y AS (SELECT x.*, y.method AS curve_method,
    (1 + 2 * (x.x - y.q) / h) * power(1 - (x.x - y.q) / h, 2) * r + ((x.x - y.q) / h) * power(1 - (x.x - y.q) / h, 2) * h * m
    + power((x.x - y.q) / h, 2) * (3 - 2 * (x.x - y.q) / h) * r1 + power((x.x - y.q) / h, 2) * ((x.x - y.q) / h - 1) * h * m1 AS y
  FROM {tag}_x x JOIN {tag}_seg y ON {join} AND y.method IN (x.method, '{ANCHOR}') AND y.q1 IS NOT NULL AND x.x >= y.q
  AND (x.x < y.q1 OR y.is_last)),
{tag}_i AS (SELECT {curve}, any_value(hi - lo) AS span, count(y) FILTER (curve_method = method) AS nt,
  count(y) FILTER (curve_method <> method) AS na,
  sum(CASE WHEN curve_method = method THEN y * w ELSE -y * w END) / 99 AS diff FROM {tag}_y GROUP BY {curve}),
{tag} AS (SELECT {", ".join("p." + k.strip() for k in curve.split(","))}, CASE WHEN nt = 100 AND na = 100 THEN (exp(diff) - 1) * 100 END AS bd_rate
  FROM {tag}_pairs p LEFT JOIN {tag}_i USING ({curve}))"""


CLASS_BD_SQL = f"WITH {POINTS_SQL}, {class_sql()}, {bd_sql('crows', 'dataset', 'cbd')}"
SEQ_BD_SQL = f"{CLASS_BD_SQL}, {bd_sql('prows', 'dataset, sequence', 'sbd')}"
SUMMARY_SQL = (f"{SEQ_BD_SQL}, bsum AS (SELECT c.method, c.dataset, c.frame_group, c.metric, c.bd_rate AS overall, s.average, s.sequences "
               "FROM cbd c LEFT JOIN (SELECT method, dataset, frame_group, metric, avg(bd_rate) AS average, count(bd_rate) AS sequences "
               "FROM sbd GROUP BY ALL) s USING (method, dataset, frame_group, metric))")


# --------------------------------------------------------------------------- queries


def _class_bd(spark, sf, metrics=("psnr",)):
    return compare(stored_points(spark, sf), ANCHOR, "class", metrics)


def _seq_bd(spark, sf):
    return c.bd_rate(c.metric_rows(stored_points(spark, sf)), ANCHOR, ["dataset", "sequence"])


def _summary(spark, sf):
    p = stored_points(spark, sf)
    sequences = c.bd_rate(c.metric_rows(p), ANCHOR, ["dataset", "sequence"])
    return rounded(c.bd_summary(compare(p, ANCHOR), sequences), 6)


def _report(spark, sf):
    bd = stored(_class_bd(spark, sf), "class-bd")
    return rounded(c.rotate(bd, tested(bd)), 6)


def _report_text(spark, sf):
    bd = compare(stored_points(spark, sf), ANCHOR, "sequence", groups=("all",))
    return c.report_cells(bd)


def _written_report(spark, sf):
    """The report written as CSV and read back."""
    out = scratch_path(spark, "report")
    bd = stored(_class_bd(spark, sf), "class-bd")
    sinks.write_report(bd, out, tested(bd), digits=3)
    return spark.read.csv(out, header=True).select("metric", "frame_group", "dataset", *tested(bd))


def _methods_by_class(spark, sf):
    """The report the other way round: a row per method, a column per class."""
    bd = stored(_class_bd(spark, sf), "class-bd")
    return sinks.report_table(bd, values_of(bd, "dataset"), ["method"], "dataset")


def _report_rows(spark, sf):
    """Sequence report in report order: starred rows behind the sequences of their dataset."""
    bd = compare(stored_points(spark, sf), ANCHOR, "sequence", groups=("all",))
    return rounded(bd.orderBy("dataset", "method", *c.report_order(bd, "sequence")), 6)


def _united_logs(spark, sf):
    """One log per method, each with its own columns, in one table without the last rate."""
    p = stored_points(spark, sf)
    base = ["method", "dataset", "sequence", "rate_key", "i_frame_num", "ave_all_frame_bpp"]
    columns = ([], ["ave_all_frame_psnr"], ["ave_all_frame_psnr", "ave_i_frame_psnr"])
    logs = [p.filter(F.col("method") == m).select(*base, *columns[min(k, 2)]) for k, m in enumerate(values_of(p, "method"))]
    return c.exclude_rates(c.unify_logs(logs), ["006"])


def _mismatch(spark, sf):
    """One method knows some sequences under another name, so their dataset is inconsistent."""
    other = (F.col("method") == "R") & F.col("sequence").endswith("7")
    p = points(spark, sf).withColumn("sequence", F.when(other, F.concat("sequence", F.lit("_cut"))).otherwise(F.col("sequence")))
    return c.sequence_set_mismatch(p)


def _flat(spark, sf):
    """Sequence names shortened so that datasets share them; the last dataset keeps the name."""
    p = points(spark, sf).withColumn("sequence", F.concat(F.lit("s"), F.substring("sequence", -1, 1)))
    one = p.groupBy("method", "dataset", "sequence").agg(F.sum("i_frame_num").alias("i_frames"), F.sum("p_frame_num").alias("p_frames"))
    return c.flatten_datasets(one, strict_names=False)


def _arrays(spark, sf):
    a = c.curve_arrays(c.class_mean(points(spark, sf), ["psnr"], ["all"]), ["dataset"])
    rows = a.select("method", "dataset", F.posexplode(F.arrays_zip("bpp", "value")).alias("point_no", "p"))
    return rounded(rows.select("method", "dataset", "point_no", "p.bpp", "p.value"), 6)


def _series(spark, sf):
    return rounded(c.curve_series(c.metric_rows(points(spark, sf), ["psnr", "msssim_v"], ["all", "p"]), ["dataset", "sequence"]), 9)


def _eligible(spark, sf):
    rows = c.metric_rows(points(spark, sf), ALL_METRICS)
    return c.eligible_pairs(rows, ANCHOR, ["dataset", "sequence"])


IMAGES = ("CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_linenumber - 1 END AS rate_idx, "
          "CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber - 1 ELSE 99 END AS qp, "
          "CAST(l_partkey % 4096 AS DOUBLE) / 1024e0 AS bpp, 26e0 + 2e0 * l_linenumber + (l_partkey % 128) / 128e0 AS psnr, "
          "'class_' || CAST(l_suppkey % 6 AS STRING) AS dataset")


def _images(spark, sf):
    from rdspark.plans.derived import table
    return table(spark, sf, "lineitem").selectExpr(*IMAGES.split(", "))


def _average_curves(spark, sf):
    """Averaged curves written beside a log and read back, one row per class and rate."""
    log = f"{scratch_path(spark, 'images')}/log.json"
    out = sinks.write_average_curves(_images(spark, sf), log)
    doc = spark.read.text(out).select(F.explode(F.from_json("value", "MAP<STRING, STRUCT<bpp ARRAY<DOUBLE>, psnr ARRAY<DOUBLE>>>")).alias("dataset", "d"))
    rows = doc.select("dataset", F.posexplode(F.arrays_zip("d.bpp", "d.psnr")).alias("rate", "v"))
    return rounded(rows.select("dataset", "rate", F.col("v.bpp").alias("bpp"), F.col("v.psnr").alias("psnr")), 4)


def _log_round_trip(spark, sf):
    """The log of every method written as fragments, then read as one table."""
    base = scratch_path(spark, "logs")
    p = stored_points(spark, sf)
    for m in values_of(p, "method"):
        sinks.write_result_log(p.filter(F.col("method") == m).drop("method"), f"{base}/{m}")
    got = read_result_logs(spark, {m: f"{base}/{m}" for m in values_of(p, "method")}, ANCHOR)
    return got.select("method", "dataset", "sequence", "rate_key", "i_frame_num", "p_frame_num",
                      "ave_i_frame_bpp", "ave_p_frame_psnr_u", "ave_all_frame_msssim")


def _document_round_trip(spark, sf):
    """One nested document per method, written in parts and read by byte ranges."""
    base = scratch_path(spark, "documents")
    p = stored_points(spark, sf)
    back = []
    for m in values_of(p, "method"):
        sinks.write_result_document(p.filter(F.col("method") == m).drop("method"), f"{base}/{m}")
        back.append(read_indented_log(spark, m, f"{base}/{m}"))
    return c.unify_logs(back).select("method", "dataset", "sequence", "rate_key", "i_frame_num", "p_frame_num",
                                     "ave_i_frame_bpp", "ave_p_frame_psnr_u", "ave_all_frame_msssim")


def _compact_round_trip(spark, sf):
    """One document per method on a single line, written in parts and read by byte ranges that begin anywhere in it."""
    base = scratch_path(spark, "compact")
    p = stored_points(spark, sf)
    back = []
    for m in values_of(p, "method"):
        sinks.write_result_document(p.filter(F.col("method") == m).drop("method"), f"{base}/{m}", compact=True)
        back.append(read_split_log(spark, m, f"{base}/{m}", joined=True, split_bytes=1 << 17))
    return c.unify_logs(back).select("method", "dataset", "sequence", "rate_key", "i_frame_num", "p_frame_num",
                                     "ave_i_frame_bpp", "ave_p_frame_psnr_u", "ave_all_frame_msssim")


def _stored_lists(spark, sf):
    """Points with their whole per-frame lists, written as a document list by list and read back."""
    base = scratch_path(spark, "lists")
    f = ordered_scan(view(spark, sf, "frames").where("method = 'A'"), ["method", "dataset", "sequence", "rate_idx"], FRAME_ORDER, number="pos")
    f = stored(f.withColumn("rate_key", F.format_string("%03d", "rate_idx")), "numbered")
    keys = ["dataset", "sequence", "rate_key"]
    p = f.groupBy(*keys).agg(F.count_if(F.col("frame_type") == 0).alias("i_frame_num"), F.count_if(F.col("frame_type") != 0).alias("p_frame_num"))
    sinks.write_result_document(p, base, lists=frame_arrays(f, keys, chunk=4, frame_idx="pos"))
    back = read_split_log(spark, "A", base, joined=True, split_bytes=1 << 17)
    lists = F.arrays_zip("frame_bpp", "frame_psnr", "frame_msssim", "frame_type")
    return back.select(*keys, "i_frame_num", "p_frame_num", F.posexplode(lists).alias("at", "f")).select(
        *keys, "i_frame_num", "p_frame_num", "at", "f.frame_bpp", "f.frame_psnr", "f.frame_msssim", "f.frame_type")


def _rd_table(spark, sf):
    """Curves of every class as literal lists, read as a table of rate points."""
    curves = c.class_mean(points(spark, sf), ["psnr"]).where("frame_group = 'all'").groupBy("method", "dataset").agg(
        F.sort_array(F.collect_list(F.struct("bpp", "value"))).alias("c"))
    texts = curves.select("method", F.col("dataset").alias("d"), F.to_json(F.struct(F.col("c.bpp").alias("bpp"), F.col("c.value").alias("PSNR"))).alias("value"))
    return rounded(parse_rd_tables(texts.withColumnRenamed("d", "dataset")).select("method", "dataset", "rate_key", "metric", "bpp", "value"), 6)


def _point_files(spark, sf):
    """Per-point files, one folder per dataset, sequence and quality index."""
    out = scratch_path(spark, "points")
    sinks.write_point(points(spark, sf).withColumn("qp_i", F.col("rate_idx") * 10), out)
    got = read_points(spark, out)
    return rounded(got.select("method", "dataset", "sequence", "rate_key", "qp_i", "i_frame_num", "ave_all_frame_bpp"), 6)


_CLASSES = [f"class_{k}" for k in range(6)]      # of the frames view; the checking SQL has to name its columns
_SHAPE = "method, dataset, frame_group, metric"
_LOG_SQL = f"""WITH {POINTS_SQL} SELECT method, dataset, sequence, rate_key, i_frame_num,
  p_frame_num, {", ".join(f"CAST(printf('%.6f', {m}) AS DOUBLE) AS {m}" for m in ("ave_i_frame_bpp", "ave_p_frame_psnr_u", "ave_all_frame_msssim"))}
FROM points"""

QUERIES = {
    "class_mean": Query(
        lambda s, f: rounded(c.class_mean(points(s, f), ALL_METRICS), 7),
        f"WITH {POINTS_SQL}, {class_sql(ALL_METRICS)} SELECT method, dataset, rate_key, frame_group, metric, frames, "
        "round(bpp, 7) AS bpp, round(value, 7) AS value FROM crows"),
    "class_mean_wide": Query(
        lambda s, f: rounded(c.class_mean_wide(points(s, f), "msssim"), 7),
        f"WITH {POINTS_SQL} SELECT method, dataset, rate_key, CAST(sum(i_frame_num) AS BIGINT) AS i_frame_num, "
        "CAST(sum(p_frame_num) AS BIGINT) AS p_frame_num, " + ", ".join(
            f"round(sum(ave_{g}_frame_{m} * ({n})) / greatest(sum({n}), 1), 7) AS ave_{g}_frame_{m}"
            for g, n in (("i", "i_frame_num"), ("p", "p_frame_num"), ("all", "i_frame_num + p_frame_num")) for m in ("bpp", "msssim"))
        + " FROM points GROUP BY method, dataset, rate_key"),
    "metric_rows": Query(lambda s, f: c.metric_rows(points(s, f), ALL_METRICS), f"WITH {POINTS_SQL} {rows_sql(ALL_METRICS)}"),
    "curve_series": Query(_series, f"""WITH {POINTS_SQL}, r AS ({rows_sql(("psnr", "msssim_v"), ("all", "p"))})
SELECT method, dataset, sequence, frame_group, metric, rate_key, round(bpp, 9) AS bpp, round(value, 9) AS value,
  CAST(row_number() OVER (PARTITION BY method, dataset, sequence, frame_group, metric ORDER BY rate_key) - 1 AS INT) AS point_no FROM r"""),
    "curve_arrays": Query(_arrays, f"""WITH {POINTS_SQL}, {class_sql(groups=("all",))}
SELECT method, dataset, CAST(row_number() OVER (PARTITION BY method, dataset ORDER BY rate_key) - 1 AS INT) AS point_no,
  round(bpp, 6) AS bpp, round(value, 6) AS value FROM crows"""),
    "eligible_pairs": Query(_eligible, f"""WITH {POINTS_SQL}, prows AS ({rows_sql(ALL_METRICS)}), {bd_sql('prows', 'dataset, sequence', 'e')}
SELECT method, dataset, sequence, frame_group, metric, lo, hi FROM e_pairs"""),
    "bd_rate_class": Query(lambda s, f: rounded(_class_bd(s, f, ALL_METRICS), 5),
                           f"WITH {POINTS_SQL}, {class_sql(ALL_METRICS)}, {bd_sql('crows', 'dataset', 'cbd')} "
                           f"SELECT {_SHAPE}, round(bd_rate, 5) AS bd_rate FROM cbd"),
    "bd_rate_sequence": Query(lambda s, f: rounded(_seq_bd(s, f), 5),
                              f"{SEQ_BD_SQL} SELECT {_SHAPE}, sequence, round(bd_rate, 5) AS bd_rate FROM sbd"),
    "bd_summary": Query(_summary, f"{SUMMARY_SQL} SELECT {_SHAPE}, round(overall, 6) AS overall, round(average, 6) AS average, "
                                  "sequences FROM bsum"),
    "bd_rate_report": Query(_report, f"""{CLASS_BD_SQL} SELECT dataset, frame_group, metric,
  round(max(bd_rate) FILTER (method = 'N'), 6) AS N, round(max(bd_rate) FILTER (method = 'R'), 6) AS R
FROM cbd GROUP BY dataset, frame_group, metric"""),
    "bd_report_text": Query(_report_text, f"""{SUMMARY_SQL}, lines AS (SELECT {_SHAPE}, sequence, bd_rate FROM sbd UNION ALL
  SELECT {_SHAPE}, '* Overall', overall FROM bsum UNION ALL SELECT {_SHAPE}, '* Average', average FROM bsum)
SELECT {_SHAPE}, sequence, printf('%.1f', bd_rate) AS bd_rate FROM lines WHERE frame_group = 'all'"""),
    "bd_report_rows": Query(_report_rows, f"""{SUMMARY_SQL}, lines AS (SELECT {_SHAPE}, sequence, bd_rate FROM sbd UNION ALL
  SELECT {_SHAPE}, '* Overall', overall FROM bsum UNION ALL SELECT {_SHAPE}, '* Average', average FROM bsum)
SELECT {_SHAPE}, sequence, round(bd_rate, 6) AS bd_rate FROM lines WHERE frame_group = 'all'"""),
    "written_report": Query(_written_report, f"""{CLASS_BD_SQL} SELECT dataset, frame_group, metric,
  printf('%.3f', max(bd_rate) FILTER (method = 'N')) AS N, printf('%.3f', max(bd_rate) FILTER (method = 'R')) AS R
FROM cbd GROUP BY dataset, frame_group, metric"""),
    "methods_by_class": Query(_methods_by_class, f"{CLASS_BD_SQL} SELECT method, frame_group, metric, " + ", ".join(
        f"coalesce(printf('%.1f', max(bd_rate) FILTER (dataset = '{d}')), '') AS {d}" for d in _CLASSES) + " FROM cbd GROUP BY method, frame_group, metric"),
    "united_logs": Query(_united_logs, f"""WITH {POINTS_SQL} SELECT method, dataset, sequence, rate_key, i_frame_num, ave_all_frame_bpp,
  CASE WHEN method <> 'A' THEN ave_all_frame_psnr END AS ave_all_frame_psnr,
  CASE WHEN method = 'R' THEN ave_i_frame_psnr END AS ave_i_frame_psnr FROM points WHERE rate_key <> '006'"""),
    "sequence_set_mismatch": Query(_mismatch, f"""WITH {POINTS_SQL}, p AS (SELECT dataset, method,
  sequence || CASE WHEN method = 'R' AND sequence LIKE '%7' THEN '_cut' ELSE '' END AS sequence FROM points),
m AS (SELECT DISTINCT dataset, method FROM p), s AS (SELECT DISTINCT dataset, sequence FROM p),
have AS (SELECT DISTINCT dataset, method, sequence FROM p)
SELECT s.dataset, s.sequence, count(h.method) AS methods_with, count(*) AS methods_of_dataset FROM s JOIN m USING (dataset)
LEFT JOIN have h ON h.dataset = s.dataset AND h.sequence = s.sequence AND h.method = m.method
GROUP BY s.dataset, s.sequence HAVING count(h.method) < count(*)"""),
    "flattened_datasets": Query(_flat, f"""WITH {POINTS_SQL}, one AS (SELECT method, dataset, 's' || right(sequence, 1) AS sequence,
  CAST(sum(i_frame_num) AS BIGINT) AS i_frames, CAST(sum(p_frame_num) AS BIGINT) AS p_frames FROM points GROUP BY ALL)
SELECT method, sequence, i_frames, p_frames FROM one QUALIFY dataset = max(dataset) OVER (PARTITION BY method, sequence)"""),
    "image_rate_means": Query(lambda s, f: c.image_rate_means(_images(s, f)), f"""WITH im AS (SELECT {IMAGES} FROM lineitem)
SELECT dataset, coalesce(rate_idx, qp) AS rate, avg(bpp) AS bpp, avg(psnr) AS psnr, count(*) AS images FROM im GROUP BY ALL"""),
    "average_curves": Query(_average_curves, f"""WITH im AS (SELECT {IMAGES} FROM lineitem),
m AS (SELECT dataset, coalesce(rate_idx, qp) AS rate, round(avg(bpp), 6) AS bpp, round(avg(psnr), 6) AS psnr FROM im GROUP BY ALL)
SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY rate) - 1 AS INT) AS rate, round(bpp, 4) AS bpp,
  round(psnr, 4) AS psnr FROM m"""),
    "result_log_round_trip": Query(_log_round_trip, _LOG_SQL),
    "result_document": Query(_document_round_trip, _LOG_SQL),
    "rd_table": Query(_rd_table, f"""WITH {POINTS_SQL}, {class_sql(["psnr"])}
SELECT method, dataset, printf('%03d', row_number() OVER (PARTITION BY method, dataset ORDER BY bpp, value) - 1) AS rate_key, metric, round(bpp, 6) AS bpp, round(value, 6) AS value
FROM crows WHERE frame_group = 'all'"""),
    "compact_log": Query(_compact_round_trip, _LOG_SQL),
    "stored_lists": Query(_stored_lists, f"""WITH {view_sql('frames')}, n AS (SELECT *, row_number() OVER (PARTITION BY dataset, sequence, rate_idx ORDER BY {', '.join(FRAME_ORDER)}) - 1 AS pos
  FROM frames WHERE method = 'A')
SELECT dataset, sequence, printf('%03d', rate_idx) AS rate_key, count(*) FILTER (frame_type = 0) OVER w AS i_frame_num, count(*) FILTER (frame_type <> 0) OVER w AS p_frame_num,
  CAST(pos AS INT) AS at, CAST(printf('%.6f', CAST(bits AS DOUBLE) / pixel_num) AS DOUBLE) AS frame_bpp, CAST(printf('%.6f', psnr) AS DOUBLE) AS frame_psnr,
  CAST(printf('%.6f', msssim) AS DOUBLE) AS frame_msssim, frame_type FROM n WINDOW w AS (PARTITION BY dataset, sequence, rate_idx)"""),
    "point_files": Query(_point_files, f"""WITH {POINTS_SQL} SELECT method, dataset, sequence, rate_key, rate_idx * 10 AS qp_i,
  i_frame_num, round(ave_all_frame_bpp, 6) AS ave_all_frame_bpp FROM points"""),
}
