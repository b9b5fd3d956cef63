"""Queries that run an evaluation from a configuration and files to points, and sources of several sizes in one read."""

from __future__ import annotations

from pyspark.sql import functions as F

from rdspark.operators import planning
from rdspark.operators.planes import plane_from_samples
from rdspark.plans import derived
from rdspark.plans.catalog import Query, rounded, summary_columns_sql
from rdspark.plans.derived import CHANNELS_SQL, SAMPLES_SQL, length_hex, table, turned_place
from rdspark.plans.evaluate import bucketed_planes, frame_log, plan_frames, summarise
from rdspark.sources.configs import parse_test_config
from rdspark.sources.packets import read_packets
from rdspark.sources.rawvideo import write_raw_video
from rdspark.sources.source_frames import read_source_frames, source_paths
from rdspark.sources.storage import scratch_path, stored

RATES = 2
# How the sequences of the given vectors are stored: label -> width, height and how it is coded.
WIDE = "label % 4 >= 2"
PERIODS = "CASE label % 4 WHEN 0 THEN -1 WHEN 1 THEN 8 WHEN 2 THEN 16 ELSE 32 END"


def _blocks(spark, sf):
    """64 samples a vector, numbered in their sequence, with the size and kind of that sequence."""
    s = derived.numbered(derived.samples(spark, sf)).withColumn("label", F.substring_index("sequence", "_", -1).cast("int"))
    return s.withColumns({"width": F.expr(f"CASE WHEN {WIDE} THEN 16 ELSE 8 END"), "height": F.expr(f"CASE WHEN {WIDE} THEN 4 ELSE 8 END")})


def _channels(s):
    turned = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.get(s, turned_place(k)))
    return s, F.reverse(s), turned


def _stored(blocks, sf_layout, depth=None):
    """Raw frames: 4:2:0 planes are the block and its first and last 16 samples, full planes the block, reversed and turned."""
    s = F.col("s")
    quarter = sf_layout == "420"
    small, full = (s, F.slice(s, 1, 16), F.slice(s, 49, 16)), _channels(s)
    planes = [F.when(quarter, plane_from_samples(a)).otherwise(plane_from_samples(b)) for a, b in zip(small, full)]
    depth = F.lit(8) if depth is None else depth
    wide = lambda p: F.when(depth == 8, p).otherwise(F.unhex(F.regexp_replace(F.hex(p), "(..)", "$1$1")))
    return blocks.select("sequence", "frame_idx", sf_layout.alias("layout"), "width", "height", depth.alias("bit_depth"), *[wide(p).alias(f"p{k}") for k, p in enumerate(planes)])


# --------------------------------------------------------------------------- sources of several sizes


def _mixed(spark, sf):
    """Two sizes, three layouts and two depths in one read, from the third frame of each sequence on."""
    b, root = _blocks(spark, sf), scratch_path(spark, "mixed")
    layout = F.expr("CASE label % 4 WHEN 1 THEN '444' WHEN 3 THEN 'rgb' ELSE '420' END")
    depth = F.expr("CASE label % 4 WHEN 2 THEN 16 ELSE 8 END")
    write_raw_video(_stored(b, layout, depth), root, segment_frames=16)
    rows = b.select("sequence", "width", "height", layout.alias("layout"), depth.alias("bit_depth")).distinct().withColumns(
        {"path": F.concat(F.lit(f"{root}/"), F.col("sequence")), "first_frame": F.lit(2).cast("long"), "frame_num": F.lit(None).cast("long")})
    f = read_source_frames(rows)
    return f.select("sequence", "frame_idx", "layout", "width", "height", "bit_depth", *[F.hex(p).alias(p) for p in ("p0", "p1", "p2")])


_BLOCKS_SQL = (f"{CHANNELS_SQL}, seqs AS (SELECT label, 'label_' || label AS sequence, count(*) AS frame_num, CASE WHEN {WIDE} THEN 16 ELSE 8 END AS width, "
               f"CASE WHEN {WIDE} THEN 4 ELSE 8 END AS height, {PERIODS} AS intra_period FROM embeddings GROUP BY label), "
               "nos AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx FROM embeddings), "
               "raw AS (SELECT n.label, n.frame_idx, c.k, c.r AS s, c.g, c.b FROM channels c JOIN nos n ON n.vec_id = c.frame_idx)")
_HEX = "CASE WHEN label % 4 = 2 THEN printf('%02X%02X', {0}, {0}) ELSE printf('%02X', {0}) END"
_MIXED_SQL = f"""WITH {_BLOCKS_SQL}, h AS (SELECT label, frame_idx, {", ".join(f"string_agg({_HEX.format(c)}, '' ORDER BY k) AS {n}" for c, n in (("s", "a"), ("g", "b"), ("b", "c")))},
  string_agg({_HEX.format('s')}, '' ORDER BY k) FILTER (k < 16) AS u, string_agg({_HEX.format('s')}, '' ORDER BY k) FILTER (k >= 48) AS v FROM raw GROUP BY ALL)
SELECT sequence, frame_idx - 2 AS frame_idx, CASE label % 4 WHEN 1 THEN '444' WHEN 3 THEN 'rgb' ELSE '420' END AS layout, width, height,
  CASE label % 4 WHEN 2 THEN 16 ELSE 8 END AS bit_depth, a AS p0, CASE WHEN label % 2 = 0 THEN u ELSE b END AS p1, CASE WHEN label % 2 = 0 THEN v ELSE c END AS p2
FROM h JOIN seqs USING (label) WHERE frame_idx >= 2"""


# --------------------------------------------------------------------------- configuration and files to points


def _configuration(spark, sf, root):
    """One configuration document a sequence: even labels are 4:2:0, odd ones RGB."""
    q = table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).cast("int").alias("frames"))
    entry = F.struct(F.expr(f"CASE WHEN {WIDE} THEN 16 ELSE 8 END").alias("width"), F.expr(f"CASE WHEN {WIDE} THEN 4 ELSE 8 END").alias("height"), "frames", F.expr(PERIODS).alias("intra_period"))
    dataset = F.when(F.col("label") % 2 == 0, "class_yuv").otherwise("class_rgb")
    kind = F.struct(F.lit(1).alias("test"), F.lit("source").alias("base_path"), F.when(F.col("label") % 2 == 0, "yuv420").otherwise("png").alias("src_type"),
                    F.create_map(F.concat(F.lit("label_"), F.col("label").cast("string")), entry).alias("sequences"))
    return q.select(F.to_json(F.struct(F.lit(root).alias("root_path"), F.create_map(dataset, kind).alias("test_classes"))).alias("value"))


def _coded(spark, sf, root):
    """Sources, reconstructions and streams of all jobs as files below ``root``: samples lose their low bits, payloads have lengths by unit."""
    b = stored(_blocks(spark, sf), "blocks")
    layout = F.when(F.col("label") % 2 == 0, "420").otherwise("rgb")
    write_raw_video(_stored(b, layout), f"{root}/source", segment_frames=16)
    step = F.expr("shiftleft(2, rate_idx)")
    rates = b.withColumn("rate_idx", F.explode(F.array(*[F.lit(k) for k in range(RATES)])))
    coarse = rates.withColumns({"s": F.transform("s", lambda v: (v - F.pmod(v, step)).cast("int")), "sequence": F.concat_ws("_r", "sequence", F.col("rate_idx").cast("string"))})
    write_raw_video(_stored(coarse, layout), f"{root}/recon", segment_frames=32)

    byte = lambda n: F.lpad(F.hex(n), 2, "0")
    units = plan_frames(_jobs(spark, sf, root), delay=8).where("unit_pos = 0")
    size = (F.col("unit_no") * 13 + F.col("rate_idx") * 7) % 300 + 1
    head = F.when(F.col("unit_no") % 5 == 0, F.concat(F.lit("00"), length_hex(F.col("height")), length_hex(F.col("width")))).otherwise(F.lit(""))
    body = F.concat(head, F.when(F.col("frame_type") == 0, "10").otherwise("20"), byte(F.col("rate_idx").cast("long")), F.lit("00"), length_hex(size), F.repeat(F.lit("AA"), size.cast("int")))
    streams = units.groupBy("sequence", "rate_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("unit_no", body.alias("x")))), lambda u: u["x"]), "").alias("x"))
    name = F.concat("sequence", F.lit("_r"), F.col("rate_idx").cast("string"), F.lit(".bin"))
    derived.write_files(streams.select(name.alias("name"), F.unhex("x").alias("content")), f"{root}/streams")


def _jobs(spark, sf, root):
    jobs = planning.job_matrix(parse_test_config(_configuration(spark, sf, root)), RATES)
    return jobs.withColumn("layout", F.when(F.col("src_type") == "png", "rgb").otherwise("420"))


def evaluated_log(spark, sf):
    """The frame log of a configuration whose sources, reconstructions and streams lie in files."""
    root = scratch_path(spark, "evaluation")
    _coded(spark, sf, root)
    jobs = _jobs(spark, sf, root)
    sources = source_paths(jobs).dropDuplicates(["sequence"])
    recon = source_paths(jobs).withColumns({"path": F.concat_ws("_r", F.concat(F.lit(f"{root}/recon/"), F.col("sequence")), F.col("rate_idx").cast("string")),
                                            "sequence": F.concat_ws("_r", "sequence", F.col("rate_idx").cast("string"))})
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coarse = read_source_frames(recon).withColumns({"rate_idx": F.regexp_extract("sequence", r"_r(\d+)$", 1).cast("int"), "sequence": F.regexp_replace("sequence", r"_r\d+$", "")})
    packets = read_packets(spark, f"{root}/streams").withColumns({"rate_idx": F.regexp_extract("stream", r"_r(\d+)\.bin$", 1).cast("int"),
                                                                 "sequence": F.regexp_extract("stream", r"([^/]+)_r\d+\.bin$", 1)})
    return frame_log(jobs, bucketed_planes(read_source_frames(sources), buckets), bucketed_planes(coarse, buckets), packets, "coder")


def _frames(spark, sf):
    return rounded(evaluated_log(spark, sf).select("dataset", "sequence", "rate_idx", "frame_idx", "frame_type", "pixel_num", "bits", "psnr", "psnr_y", "psnr_u", "psnr_v"), 6)


def _points(spark, sf):
    return rounded(summarise(evaluated_log(spark, sf)), 6)


_INTRA = "(st = 0 OR intra_period = 1 OR (intra_period > 1 AND st <> 1 AND st % intra_period = 1))"
_PSNR = "least(CASE WHEN {0} > 1e-10 THEN 10 * log10(65025e0 / {0}) ELSE 999.9e0 END, 99.9e0)"
_FRAMES_SQL = f"""RECURSIVE {_BLOCKS_SQL},
u AS (SELECT label, frame_num, intra_period, 0 AS unit_no, 0 AS st, 1 AS n, true AS intra FROM seqs UNION ALL
  SELECT label, frame_num, intra_period, unit_no + 1, st + n, CASE WHEN {_INTRA.replace('st', '(st + n)')} THEN 1 ELSE least(8, frame_num - (st + n)) END,
    {_INTRA.replace('st', '(st + n)')} FROM u WHERE st + n < frame_num),
log AS (SELECT label, r.rate_idx, u.st + k.k AS frame_idx, CASE WHEN intra THEN 0 ELSE 1 END AS frame_type, (unit_no * 13 + r.rate_idx * 7) % 300 + 1 AS size,
  CASE WHEN k.k = 0 THEN 8 * (3 + CASE WHEN (unit_no * 13 + r.rate_idx * 7) % 300 + 1 < 128 THEN 1 ELSE 2 END + (unit_no * 13 + r.rate_idx * 7) % 300 + 1
    + CASE WHEN unit_no % 5 = 0 THEN 3 ELSE 0 END) ELSE 0 END AS bits FROM u, range(8) k(k), (VALUES (0), (1)) r(rate_idx) WHERE k.k < n),
e AS (SELECT label, frame_idx, rate_idx, avg((s % m) * (s % m)) AS y, avg((s % m) * (s % m)) FILTER (k < 16) AS u, avg((s % m) * (s % m)) FILTER (k >= 48) AS v
  FROM raw, (VALUES (0, 2), (1, 4)) r(rate_idx, m) GROUP BY ALL),
frames AS (SELECT 'coder' AS method, CASE WHEN label % 2 = 0 THEN 'class_yuv' ELSE 'class_rgb' END AS dataset, sequence, log.rate_idx, CAST(log.frame_idx AS BIGINT) AS frame_idx, frame_type,
  CAST(width * height AS BIGINT) AS pixel_num, CAST(bits AS BIGINT) AS bits, CASE WHEN label % 2 = 0 THEN (6 * {_PSNR.format('e.y')} + {_PSNR.format('e.u')} + {_PSNR.format('e.v')}) / 8
    ELSE {_PSNR.format('e.y')} END AS psnr, {", ".join(f"CASE WHEN label % 2 = 0 THEN {_PSNR.format('e.' + p)} END AS psnr_{p}" for p in "yuv")},
  0e0 AS msssim, 0e0 AS msssim_y, 0e0 AS msssim_u, 0e0 AS msssim_v FROM log JOIN e USING (label, rate_idx, frame_idx) JOIN seqs USING (label))"""

QUERIES = {
    "source_frames": Query(_mixed, _MIXED_SQL),
    "evaluated_frames": Query(_frames, f"""WITH {_FRAMES_SQL} SELECT dataset, sequence, rate_idx, frame_idx, frame_type, pixel_num, bits,
  round(psnr, 6) AS psnr, round(psnr_y, 6) AS psnr_y, round(psnr_u, 6) AS psnr_u, round(psnr_v, 6) AS psnr_v FROM frames"""),
    "evaluated_points": Query(_points, f"""WITH {_FRAMES_SQL} SELECT method, dataset, sequence, rate_idx, printf('%03d', rate_idx) AS rate_key, max(pixel_num) AS frame_pixel_num,
  count(*) FILTER (frame_type = 0) AS i_frame_num, count(*) FILTER (frame_type <> 0) AS p_frame_num, {summary_columns_sql(digits=6)} FROM frames
  GROUP BY method, dataset, sequence, rate_idx"""),
}
