"""Queries that plan evaluations: configurations, jobs, resume, units, placement of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from rdspark.functions import ladders
from rdspark.operators import planning, structure
from rdspark.plans.catalog import Query, rd
from rdspark.plans.derived import table, view, view_sql
from rdspark.plans.evaluate import plan_frames
from rdspark.sources.configs import parse_test_config, read_test_config
from rdspark.sources.storage import scratch_path

SEQS = view_sql("sequences")
LADDER = ladders.uniform_ladder(4)


def seqs(spark, sf):
    return view(spark, sf, "sequences")


def _config_texts(spark, sf):
    """Each sequence as a configuration document: the current form, or the older ones without some fields."""
    q = seqs(spark, sf)
    entry = F.struct(F.col("width"), F.col("height"), F.col("frame_num").alias("frames"), F.col("intra_period"))
    old_entry = F.struct(F.col("frame_num").alias("frames"), F.col("intra_period").alias("gop"))
    cls = F.struct(F.col("enabled").cast("int").alias("test"), "base_path", "src_type", F.create_map("sequence", entry).alias("sequences"))
    old = F.struct(F.concat(F.lit("/old/"), "base_path").alias("base_path"), F.create_map("sequence", old_entry).alias("sequences"))
    new = F.to_json(F.struct(F.lit("/data/").alias("root_path"), F.create_map("dataset", cls).alias("test_classes")))
    return q.select(F.when(F.col("seq_no") % 4 == 1, F.to_json(F.create_map("dataset", old))).otherwise(new).alias("value"))


_CONFIG_SQL = f"""WITH {SEQS}
SELECT dataset, sequence, CASE WHEN seq_no % 4 = 1 THEN 'png' ELSE src_type END AS src_type,
  CASE WHEN seq_no % 4 = 1 THEN '/old/' ELSE '/data/' END || base_path AS base_path,
  CASE WHEN seq_no % 4 <> 1 THEN width END AS width, CASE WHEN seq_no % 4 <> 1 THEN height END AS height, frame_num, intra_period,
  enabled OR seq_no % 4 = 1 AS enabled, false AS img_folder FROM sequences"""


def _config_file(spark, sf):
    out = scratch_path(spark, "config")
    _config_texts(spark, sf).write.text(out)
    return read_test_config(spark, out, lines=True)


def _jobs(spark, sf):
    return planning.job_matrix(seqs(spark, sf), 4).drop("enabled", "base_path")


JOBS_SQL = (f"{SEQS}, ladder(rate_idx, qp) AS (VALUES {', '.join(f'({i}, {q})' for i, q in enumerate(LADDER))}), "
            "jobs AS (SELECT dataset, sequence, seq_no, src_type, width, height, frame_num, intra_period, rate_idx, qp AS qp_i, qp AS qp_p, "
            "printf('%03d', rate_idx) AS rate_key, sequence || '_q' || qp || '.bin' AS bin_name, "
            "sequence || '_q' || qp || '.json' AS json_name FROM sequences, ladder WHERE enabled)")


def _forced_jobs(spark, sf):
    jobs = planning.job_matrix(seqs(spark, sf), 3, qp_i=[5, 20, 50], force_intra=True, force_intra_period=16, force_frame_num=96)
    return jobs.select("dataset", "sequence", "rate_idx", "qp_i", "qp_p", "intra_period", "frame_num", "rate_key")


def _done(jobs):
    """Stored points: half of them complete, some cut short, some without a stream file."""
    short = F.when(F.col("seq_no") % 8 == 0, 1).when(F.col("seq_no") % 2 == 1, 3).otherwise(0)
    return jobs.select("dataset", "sequence", "qp_i", F.lit(1).cast("bigint").alias("i_frame_num"),
                       (F.col("frame_num") - 1 - short).cast("bigint").alias("p_frame_num"),
                       ((F.col("seq_no") + F.col("rate_idx")) % 5 != 0).alias("stream_exists"))


_DONE_SQL = ("done AS (SELECT dataset, sequence, qp_i, 1 AS i_frame_num, frame_num - 1 - CASE WHEN seq_no % 8 = 0 THEN 1 WHEN seq_no % 2 = 1 THEN 3 ELSE 0 END "
             "AS p_frame_num, (seq_no + rate_idx) % 5 <> 0 AS stream_exists FROM jobs)")


def _remaining(spark, sf):
    jobs = _jobs(spark, sf)
    return planning.remaining_jobs(jobs, _done(jobs)).select("dataset", "sequence", "rate_idx", "qp_i", "frame_num")


def _reused(spark, sf):
    jobs = _jobs(spark, sf)
    return planning.reusable_points(jobs, _done(jobs)).select("dataset", "sequence", "qp_i", F.col("i_frame_num").cast("int").alias("i_frame_num"),
                                                              F.col("p_frame_num").cast("int").alias("p_frame_num"))


def _placed(spark, sf):
    """Results of the whole frame log in the places a configuration has for them; two rates have none."""
    scaffold = planning.job_matrix(seqs(spark, sf), 9).select("dataset", "sequence", "rate_idx")
    r = view(spark, sf, "frames").groupBy("dataset", "sequence", "rate_idx").agg(F.count(F.lit(1)).alias("frames"), F.sum("bits").alias("bits"))
    return planning.place_results(scaffold, r)


NAMES = "'ckpt_' || CAST(l_linenumber * 5 AS STRING) || '_' || 'seq_' || CAST(l_suppkey AS STRING)"
RESULTS = (f"'class_' || CAST(l_suppkey % 6 AS STRING) AS dataset, 'seq_' || CAST(l_suppkey AS STRING) AS sequence, {NAMES} AS name, "
           "l_orderkey * 1000 + l_partkey % 1000 AS result_no, l_extendedprice AS price")


def _prefixed(spark, sf):
    """Checkpoints named ckpt_1 .. ckpt_35 by rate: short names are prefixes of long ones."""
    r = table(spark, sf, "lineitem").selectExpr(*[p.strip() for p in RESULTS.split(", ")])
    one = r.groupBy("dataset", "sequence", "name").agg(F.max_by("price", F.struct("result_no", "price")).alias("price"), F.max("result_no").alias("result_no"))
    ckpt = table(spark, sf, "lineitem").selectExpr("'ckpt_' || CAST(l_linenumber AS STRING) AS checkpoint").distinct()
    scaffold = seqs(spark, sf).select("dataset", "sequence", F.explode(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.concat(F.lit("ckpt_"), i.cast("string")))).alias("checkpoint"))
    ranked = one.withColumn("result_no", F.struct("result_no", "name"))
    out = planning.place_by_prefix(scaffold, ranked, ckpt)
    return out.select("dataset", "sequence", "checkpoint", "name", "price")


_PREFIX_SQL = f"""WITH {SEQS}, r AS (SELECT {RESULTS} FROM lineitem), one AS (SELECT dataset, sequence, name,
  arg_max(price, (result_no, price)) AS price, max(result_no) AS result_no FROM r GROUP BY ALL),
sc AS (SELECT dataset, sequence, 'ckpt_' || i AS checkpoint FROM sequences, range(1, 8) t(i)),
m AS (SELECT sc.*, name, price, row_number() OVER (PARTITION BY sc.dataset, sc.sequence, checkpoint ORDER BY result_no DESC, name DESC) AS k
  FROM sc LEFT JOIN one ON one.dataset = sc.dataset AND one.sequence = sc.sequence AND starts_with(name, checkpoint))
SELECT dataset, sequence, checkpoint, name, price FROM m WHERE k = 1"""


def _padding(spark, sf):
    q = seqs(spark, sf)
    a, b = ladders.padding("width", "height", 16), ladders.padding("width", "height", 64, centred=True)
    cut = lambda n, p: F.col(n)[p].alias(f"{n}_{p}")
    return (q.withColumns({"a": a, "b": b})
            .select("sequence", cut("a", "right"), cut("a", "bottom"), cut("a", "width"), *[cut("b", p) for p in ("left", "right", "top", "bottom", "height")]))


_PADDING_SQL = f"""WITH {SEQS}, p AS (SELECT *, CAST(ceil(width / 16) * 16 AS INT) AS w16, CAST(ceil(height / 16) * 16 AS INT) AS h16,
  CAST(ceil(width / 64) * 64 AS INT) AS w64, CAST(ceil(height / 64) * 64 AS INT) AS h64 FROM sequences)
SELECT sequence, w16 - width AS a_right, h16 - height AS a_bottom, w16 AS a_width, (w64 - width) // 2 AS b_left,
  w64 - width - (w64 - width) // 2 AS b_right, (h64 - height) // 2 AS b_top, h64 - height - (h64 - height) // 2 AS b_bottom, h64 AS b_height FROM p"""


def _scales(spark, sf):
    """Quantiser scales of a five-step ladder per sequence, in their stored form, and rounded prices."""
    step = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("step")
    q = seqs(spark, sf).select("sequence", "seq_no", step)
    value = ladders.log_spaced("step", 5, 0.5, 16.0, descending=True) * (1 + F.col("seq_no") / 64)
    s = q.withColumn("v", value).withColumn("s", ladders.rounded_scale("v"))
    return s.select("sequence", "step", rd("v", 6).alias("scale"), F.col("s.index").alias("scale_index"), F.col("s.value").alias("stored"))


def _units(spark, sf, delay):
    jobs = planning.job_matrix(seqs(spark, sf), 2).select("sequence", "rate_idx", "frame_num", "intra_period")
    return plan_frames(jobs, delay=delay).select("sequence", "rate_idx", F.col("frame_idx"), "frame_type", "unit_no", "unit_start", "unit_pos", "unit_frames", "reset")


# The unit rule walked frame by frame: the next start is the end of the unit, an intra unit has one frame.
def _units_sql(delay: int) -> str:
    intra = ("(st = 0 OR intra_period = 1 OR (intra_period > 1 AND st <> 1 AND st % intra_period = 1))")
    return f"""WITH RECURSIVE {SEQS}, s AS (SELECT sequence, frame_num, intra_period FROM sequences WHERE enabled),
u AS (SELECT sequence, frame_num, intra_period, 0 AS unit_no, 0 AS st, 1 AS n, true AS intra FROM s UNION ALL
  SELECT sequence, frame_num, intra_period, unit_no + 1, st + n,
    CASE WHEN {intra.replace('st', '(st + n)')} THEN 1 ELSE least({delay}, frame_num - (st + n)) END,
    {intra.replace('st', '(st + n)')} FROM u WHERE st + n < frame_num)
SELECT sequence, r.rate_idx, CAST(u.st + k.k AS INT) AS frame_idx, CASE WHEN intra THEN 0 ELSE 1 END AS frame_type,
  CAST(unit_no AS BIGINT) AS unit_no, CAST(u.st AS BIGINT) AS unit_start, CAST(k.k AS BIGINT) AS unit_pos, CAST(n AS BIGINT) AS unit_frames,
  CASE WHEN NOT intra AND (u.st + {delay}) % 32 = 1 THEN 1 ELSE 0 END AS reset
FROM u, range({delay}) k(k), (VALUES (0), (1)) r(rate_idx) WHERE k.k < n"""


def _unit_bits(spark, sf):
    f = _units(spark, sf, 8).withColumns({
        "unit_bytes": F.col("unit_no") * 13 + F.col("rate_idx") * 7 + 20,
        "header_bytes": F.when(F.col("unit_no") == 0, 5)})
    b = structure.place_unit_bits(f)
    return b.groupBy("sequence", "rate_idx", "frame_type").agg(F.sum("bits").alias("bits"), F.count_if(F.col("bits") > 0).alias("first_frames"), F.count(F.lit(1)).alias("frames"))


def _inputs(spark, sf):
    jobs = planning.job_matrix(seqs(spark, sf), 2).select("sequence", "rate_idx", "frame_num", "intra_period")
    return structure.unit_inputs(plan_frames(jobs, delay=8), 8).select("sequence", "rate_idx", "unit_no", "input_pos", F.col("frame_idx").cast("bigint").alias("frame_idx"), "repeated")


def _latest(spark, sf):
    """The two newest orders of every customer, read as status files with a modification time."""
    o = table(spark, sf, "orders").select("o_custkey", F.format_string("status_epo%09d", "o_orderkey").alias("path"), F.col("o_orderdate").alias("modificationTime"))
    return planning.latest_runs(o, ["o_custkey"]).select("o_custkey", "path")


def _numbered_jobs(spark, sf):
    jobs = planning.job_matrix(seqs(spark, sf), 4).withColumn("at", F.col("seq_no") * 4 + F.col("rate_idx"))
    return planning.number_jobs(jobs, ["at"]).select("sequence", "rate_idx", "job_no")


QUERIES = {
    "test_config": Query(lambda s, f: parse_test_config(_config_texts(s, f)), _CONFIG_SQL),
    "test_config_file": Query(_config_file, _CONFIG_SQL),
    "job_matrix": Query(_jobs, f"WITH {JOBS_SQL} SELECT * FROM jobs"),
    "forced_jobs": Query(_forced_jobs, f"""WITH {SEQS}, l(rate_idx, qp_i) AS (VALUES (0, 5), (1, 20), (2, 50))
SELECT dataset, sequence, rate_idx, qp_i, CAST(NULL AS INT) AS qp_p, 16 AS intra_period, 96 AS frame_num, printf('%03d', rate_idx) AS rate_key
FROM sequences, l WHERE enabled"""),
    "remaining_jobs": Query(_remaining, f"""WITH {JOBS_SQL}, {_DONE_SQL} SELECT dataset, sequence, rate_idx, qp_i, frame_num FROM jobs j
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.dataset = j.dataset AND d.sequence = j.sequence AND d.qp_i = j.qp_i
  AND d.stream_exists AND d.i_frame_num + d.p_frame_num = j.frame_num)"""),
    "reusable_points": Query(_reused, f"""WITH {JOBS_SQL}, {_DONE_SQL} SELECT d.dataset, d.sequence, d.qp_i, d.i_frame_num, d.p_frame_num
FROM done d JOIN jobs j USING (dataset, sequence, qp_i) WHERE d.stream_exists AND d.i_frame_num + d.p_frame_num = j.frame_num"""),
    "placed_results": Query(_placed, f"""WITH {SEQS}, {view_sql('frames')}, r AS (SELECT dataset, sequence, rate_idx, count(*) AS frames,
  CAST(sum(bits) AS BIGINT) AS bits FROM frames GROUP BY ALL)
SELECT s.dataset, s.sequence, i.i AS rate_idx, frames, bits FROM sequences s CROSS JOIN (SELECT CAST(i AS INT) AS i FROM range(9) t(i)) i
LEFT JOIN r ON r.dataset = s.dataset AND r.sequence = s.sequence AND r.rate_idx = i.i WHERE enabled"""),
    "placed_by_prefix": Query(_prefixed, _PREFIX_SQL),
    "padded_sizes": Query(_padding, _PADDING_SQL),
    "stored_scales": Query(_scales, f"""WITH {SEQS}, v AS (SELECT sequence, CAST(k AS INT) AS step,
  exp(ln(16e0) + k * ((ln(0.5e0) - ln(16e0)) / 4)) * (1 + seq_no / 64) AS v FROM sequences, range(5) t(k))
SELECT sequence, step, round(v, 6) AS scale, CAST(round_even(least(greatest(v, 0.01e0), 655e0) * 100, 0) AS INT) AS scale_index,
  round_even(least(greatest(v, 0.01e0), 655e0) * 100, 0) / 100 AS stored FROM v"""),
    "coding_units_single": Query(lambda s, f: _units(s, f, 1), _units_sql(1)),
    "coding_units_chunked": Query(lambda s, f: _units(s, f, 8), _units_sql(8)),
    "unit_bits": Query(_unit_bits, f"""WITH f AS ({_units_sql(8)}) SELECT sequence, rate_idx, frame_type,
  CAST(sum(CASE WHEN unit_pos = 0 THEN 8 * (unit_no * 13 + rate_idx * 7 + 20 + CASE WHEN unit_no = 0 THEN 5 ELSE 0 END) ELSE 0 END) AS BIGINT) AS bits,
  count(*) FILTER (unit_pos = 0) AS first_frames, count(*) AS frames FROM f GROUP BY sequence, rate_idx, frame_type"""),
    "unit_inputs": Query(_inputs, f"""WITH f AS ({_units_sql(8)}), u AS (SELECT DISTINCT sequence, rate_idx, unit_no, unit_start, unit_frames, frame_type FROM f)
SELECT sequence, rate_idx, unit_no, k.k AS input_pos, unit_start + least(k.k, unit_frames - 1) AS frame_idx, k.k >= unit_frames AS repeated
FROM u, range(8) k(k) WHERE frame_type = 1 OR k.k = 0"""),
    "latest_runs": Query(_latest, """SELECT o_custkey, printf('status_epo%09d', o_orderkey) AS path FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, printf('status_epo%09d', o_orderkey) DESC) <= 2"""),
    "numbered_jobs": Query(_numbered_jobs, f"""WITH {JOBS_SQL} SELECT sequence, rate_idx,
  row_number() OVER (ORDER BY seq_no, rate_idx) - 1 AS job_no FROM jobs"""),
}
