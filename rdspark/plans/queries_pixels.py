"""Queries on planes, raw video, pictures and coded streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from rdspark.functions import pixels
from rdspark.operators import packets as pk, planes, quality
from rdspark.plans import derived
from rdspark.plans.catalog import Query, rd, rounded
from rdspark.plans.derived import SAMPLES_SQL, table, view, view_sql
from rdspark.sources.images import list_images, read_png_frames, split_bgr
from rdspark.sources.packets import parse_packets, read_packets
from rdspark.sinks.planes import write_rgb_planes
from rdspark.sources.rawvideo import read_raw_video, write_raw_video
from rdspark.sources.source_frames import read_source_frames
from rdspark.sources.storage import scratch_path, stored

UNITS = view_sql("units")
NUMBERED_SQL = (f"{SAMPLES_SQL}, pos AS (SELECT sequence, frame_idx AS id, dense_rank() OVER (PARTITION BY sequence ORDER BY frame_idx) - 1 AS frame_idx "
                "FROM (SELECT DISTINCT sequence, frame_idx FROM samples))")
# Samples of the three planes of a 4:2:0 frame: luma is the block, chroma its first and last 16 samples.
PLANES_SQL = (f"{NUMBERED_SQL}, pl AS (SELECT p.sequence, p.frame_idx, q.plane, s.i - q.low AS i, s.s FROM pos p "
              "JOIN samples s ON s.frame_idx = p.id JOIN (VALUES ('y', 0, 64), ('u', 0, 16), ('v', 48, 64)) q(plane, low, high) "
              "ON s.i >= q.low AND s.i < q.high)")
SCORES_SQL = (f"{PLANES_SQL}, e AS (SELECT a.sequence, a.frame_idx, a.plane, CAST(sum((a.s - b.s) * (a.s - b.s)) AS DOUBLE) / count(*) AS mse "
              "FROM pl a JOIN pl b ON b.sequence = a.sequence AND b.frame_idx = a.frame_idx + 1 AND b.plane = a.plane AND b.i = a.i GROUP BY ALL), "
              "sc AS (SELECT *, least(CASE WHEN mse > 1e-10 THEN 10 * log10(65025e0 / mse) ELSE 999.9e0 END, 99.9e0) AS psnr FROM e)")
NUMBERED_RGB_SQL = NUMBERED_SQL.replace(SAMPLES_SQL, derived.CHANNELS_SQL)


def frames420(spark, sf):
    return derived.numbered(derived.small_frames(spark, sf))


def _pairs(spark, sf, pad: bool = False):
    """Each frame against the next one of its sequence."""
    p = planes.plane_rows(frames420(spark, sf), "420")
    recon = p.withColumn("frame_idx", F.col("frame_idx") - 1)
    return quality.pair_planes(p, planes.pad_planes(recon, 16) if pad else recon, only_common=True)      # a last frame has no next one


def _plane_psnr(spark, sf, pad=False):
    return rounded(quality.plane_psnr(quality.plane_error(_pairs(spark, sf, pad))), 6)


_PSNR_SQL = f"WITH {SCORES_SQL} SELECT sequence, frame_idx, plane, round(mse, 6) AS mse, round(psnr, 6) AS psnr FROM sc"


def _frame_psnr(spark, sf):
    return rounded(quality.frame_scores(quality.plane_psnr(quality.plane_error(_pairs(spark, sf))), "psnr"), 6)


def _ms_ssim(spark, sf):
    """Four-level and five-level scores of neighbouring frames, enlarged to 128 and 256 samples a side."""
    f = frames420(spark, sf)
    out = None
    for doublings in (4, 5):
        p = derived.large_planes(f, doublings)
        s = quality.plane_ms_ssim(quality.pair_planes(p, p.withColumn("frame_idx", F.col("frame_idx") - 1), only_common=True))
        s = s.select("sequence", "frame_idx", "width", rd("msssim", 9).alias("msssim"))
        out = s if out is None else out.unionByName(s)
    return out


def _mismatches(spark, sf):
    """Decoder scores that differ for some frames and carry other numbers for some."""
    e = table(spark, sf, "embeddings").selectExpr("CAST(label AS STRING) AS sequence", "vec_id AS frame_idx", "(vec_id % 64) / 64e0 AS psnr")
    changed = F.when(F.col("frame_idx") % 5 == 0, F.col("psnr") + 1).otherwise(F.col("psnr"))
    moved = F.when(F.col("frame_idx") % 11 == 0, -1 - F.col("frame_idx")).otherwise(F.col("frame_idx"))
    return quality.score_mismatches(e, e.withColumn("psnr", changed).withColumn("frame_idx", moved))


PIXELS_SQL = (f"{derived.CHANNELS_SQL}, px AS (SELECT frame_idx, k, r / 255e0 AS r, g / 255e0 AS g, b / 255e0 AS b FROM channels), "
              "yy AS (SELECT *, 0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b AS y FROM px), "
              "ycc AS (SELECT *, 0.5e0 * (b - y) / (1 - 0.0722e0) + 0.5e0 AS cb, 0.5e0 * (r - y) / (1 - 0.2126e0) + 0.5e0 AS cr FROM yy)")


def _pixel_rows(spark, sf):
    s = derived.samples(spark, sf)
    p = s.select("frame_idx", "s", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    k = F.col("k")
    return p.select("frame_idx", "k", *[(F.get(F.col("s"), at) / 255.0).alias(c) for c, at in (("r", k), ("g", 63 - k), ("b", derived.turned_place(k)))])


def _to_ycbcr(spark, sf):
    p = _pixel_rows(spark, sf).withColumns({"c": pixels.rgb_to_ycbcr("r", "g", "b"), "q": pixels.rgb_to_ycbcr("r", "g", "b", quantise=True)})
    return rounded(p.select("frame_idx", "k", "c.*", F.rint(F.col("q.y") * 255).cast("int").alias("y8")), 7)


def _to_rgb(spark, sf):
    p = _pixel_rows(spark, sf).withColumns({"a": pixels.ycbcr_to_rgb("r", "g", "b"), "o": pixels.ycbcr_to_rgb("r", "g", "b", clamp=False)})
    return rounded(p.select("frame_idx", "k", F.col("a.r").alias("r"), F.col("a.g").alias("g"), F.col("a.b").alias("b"), F.col("o.g").alias("open_g")), 7)


def _converted(spark, sf, src, dst, frames):
    c = planes.convert_frames(frames, src, dst)
    return planes.sample_rows(planes.plane_rows(c, dst), ["sequence", "frame_idx", "plane"])


def _to_444(spark, sf):
    return _converted(spark, sf, "420", "444", derived.small_frames(spark, sf))


def _rgb_to_420(spark, sf):
    return _converted(spark, sf, "rgb", "420", derived.rgb_frames(spark, sf))


def _420_to_rgb(spark, sf):
    return _converted(spark, sf, "420", "rgb", derived.small_frames(spark, sf))


_TO_444_SQL = f"""WITH {SAMPLES_SQL} SELECT sequence, frame_idx, 'y' AS plane, CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y, s AS value FROM samples
UNION ALL SELECT a.sequence, a.frame_idx, q.plane, CAST(k.k % 8 AS INT), CAST(k.k // 8 AS INT), a.s FROM range(64) k(k), (VALUES ('u', 0), ('v', 48)) q(plane, low), samples a
WHERE a.i = q.low + (k.k // 16) * 4 + (k.k % 8) // 2"""

_RGB_420_SQL = f"""WITH {PIXELS_SQL}, lum AS (SELECT frame_idx, 'y' AS plane, k % 8 AS x, k // 8 AS y, CAST(round_even(y * 255, 0) AS INT) AS value FROM ycc),
q AS (SELECT frame_idx, (k % 8) // 2 AS x, k // 16 AS y, (k // 8) % 2 * 2 + k % 2 AS c, cb, cr FROM ycc),
h AS (SELECT frame_idx, x, y, (max(cb) FILTER (c = 0) + max(cb) FILTER (c = 1) + max(cb) FILTER (c = 2) + max(cb) FILTER (c = 3)) / 4 AS u,
  (max(cr) FILTER (c = 0) + max(cr) FILTER (c = 1) + max(cr) FILTER (c = 2) + max(cr) FILTER (c = 3)) / 4 AS v FROM q GROUP BY ALL),
o AS (SELECT * FROM lum UNION ALL SELECT frame_idx, 'u', x, y, CAST(round_even(u * 255, 0) AS INT) FROM h
  UNION ALL SELECT frame_idx, 'v', x, y, CAST(round_even(v * 255, 0) AS INT) FROM h)
SELECT 'label_' || label AS sequence, frame_idx, plane, CAST(x AS INT) AS x, CAST(y AS INT) AS y, value FROM o JOIN embeddings ON vec_id = frame_idx"""

_420_RGB_SQL = f"""WITH {SAMPLES_SQL}, l AS (SELECT sequence, frame_idx, list(s / 255e0 ORDER BY i) AS s FROM samples GROUP BY ALL),
k AS (SELECT CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y, CAST(floor((i % 8) * (3 / 7e0)) AS INT) AS lx, CAST(floor((i // 8) * (3 / 7e0)) AS INT) AS ly,
  (i % 8) * (3 / 7e0) - floor((i % 8) * (3 / 7e0)) AS tx, (i // 8) * (3 / 7e0) - floor((i // 8) * (3 / 7e0)) AS ty FROM range(64) t(i)),
g AS (SELECT *, least(lx + 1, 3) AS hx, least(ly + 1, 3) AS hy FROM k),
p AS (SELECT sequence, frame_idx, x, y, s[y * 8 + x + 1] AS l, {", ".join(
    f"(s[ly * 4 + lx + {o}] * (1 - ty) + s[hy * 4 + lx + {o}] * ty) * (1 - tx) + (s[ly * 4 + hx + {o}] * (1 - ty) + s[hy * 4 + hx + {o}] * ty) * tx AS {n}"
    for n, o in (("cb", 1), ("cr", 49)))} FROM l, g),
c AS (SELECT *, l + (2 - 2 * 0.2126e0) * (cr - 0.5e0) AS r, l + (2 - 2 * 0.0722e0) * (cb - 0.5e0) AS b FROM p),
d AS (SELECT *, (l - 0.2126e0 * r - 0.0722e0 * b) / 0.7152e0 AS g FROM c)
SELECT sequence, frame_idx, n AS plane, x, y, CAST(round_even(least(greatest(v, 0e0), 1e0) * 255, 0) AS INT) AS value
FROM (SELECT sequence, frame_idx, x, y, unnest(['r', 'g', 'b']) AS n, unnest([r, g, b]) AS v FROM d)"""


def _file_to_rgb(spark, sf):
    """Raw 4:2:0 files read by their configuration, converted and written as a table of RGB planes."""
    root = scratch_path(spark, "files")
    write_raw_video(frames420(spark, sf), root, segment_frames=16)
    rows = table(spark, sf, "embeddings").select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("sequence")).distinct().withColumns({
        "path": F.concat(F.lit(f"{root}/"), F.col("sequence")), "width": F.lit(8), "height": F.lit(8), "layout": F.lit("420"), "bit_depth": F.lit(8),
        "first_frame": F.lit(None).cast("long"), "frame_num": F.lit(None).cast("long")})
    out = scratch_path(spark, "rgb")
    write_rgb_planes(read_source_frames(rows), out)
    return planes.sample_rows(spark.read.parquet(out), ["sequence", "frame_idx", "plane"])


def _hex_planes(df):
    return df.select("sequence", "frame_idx", *[F.hex(p).alias(p) for p in ("p0", "p1", "p2")])


def _raw_round_trip(spark, sf):
    """All frames written as raw 4:2:0 video in segments of 16 frames, then read back."""
    out = scratch_path(spark, "video")
    write_raw_video(frames420(spark, sf), out, segment_frames=16)
    return _hex_planes(read_raw_video(spark, out, 8, 8))


def _raw_range(spark, sf):
    """The same video without its first 5 frames, at most 20 frames per sequence."""
    out = scratch_path(spark, "video")
    write_raw_video(frames420(spark, sf), out, segment_frames=16)
    return _hex_planes(read_raw_video(spark, out, 8, 8, skip_frame=5, max_frames=20))


def _deep_video(spark, sf):
    """RGB frames stored with 10 bits per sample."""
    out = scratch_path(spark, "deep")
    f = planes.convert_frames(derived.numbered(derived.rgb_frames(spark, sf)), "rgb", "rgb", out_depth=10)
    write_raw_video(f, out)
    return _hex_planes(read_raw_video(spark, out, 8, 8, layout="rgb", bit_depth=10))


_RAW_SQL = (f"WITH {PLANES_SQL} SELECT sequence, frame_idx, " + ", ".join(
    f"string_agg(printf('%02X', s), '' ORDER BY i) FILTER (plane = '{p}') AS p{k}" for k, p in enumerate("yuv")) + " FROM pl GROUP BY sequence, frame_idx")


def _png_folder(spark, sf):
    f = derived.numbered(derived.rgb_frames(spark, sf))
    behind = (F.col("sequence") == "label_3") & (F.col("frame_idx") >= 6)
    with_gap = f.withColumn("frame_idx", F.col("frame_idx") + F.when(behind, 1).otherwise(0))
    return derived.write_files(derived.png_files(with_gap), scratch_path(spark, "png"))


def _png_frames(spark, sf):
    """Pictures of every sequence up to the first missing number, 8x8 each."""
    return _hex_planes(split_bgr(read_png_frames(spark, _png_folder(spark, sf) + "/*", 8, 8)))


def _picture_names(spark, sf):
    return list_images(spark, _png_folder(spark, sf) + "/*", ".png").groupBy("name").agg(F.count(F.lit(1)).alias("sequences"))


_RGB_HEX = ", ".join(f"string_agg(printf('%02X', {c}), '' ORDER BY k) AS p{n}" for n, c in enumerate("rgb"))


# --------------------------------------------------------------------------- coded streams

LINES_SQL = ("t AS (SELECT doc_id AS stream, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), "
             "l AS (SELECT stream, i, octet_length(encode(line)) AS n FROM t)")


def _units_sql(head: int, fixed: int, low: str, fields: str, sps_fields: str) -> str:
    """Rows of all units: ``head`` bytes of set, ``fixed`` bytes before each length, ``low`` bytes of length."""
    size = f"({head} + CASE WHEN 64 + stream % 200 >= 128 THEN {0 if head > 5 else 1} ELSE 0 END + CASE WHEN 64 + stream % 300 >= 128 THEN {0 if head > 5 else 1} ELSE 0 END)"
    return f"""WITH {LINES_SQL}, b AS (SELECT *, {fixed} + {low} + n AS unit_bytes FROM l),
o AS (SELECT *, {size} + coalesce(sum(unit_bytes) OVER (PARTITION BY stream ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM b)
SELECT stream, CAST(i + 1 AS BIGINT) AS unit_no, CAST(off AS BIGINT) AS byte_offset, CAST(unit_bytes AS BIGINT) AS unit_bytes, CASE WHEN i = 0 THEN 1 ELSE 2 END AS nal_type,
  CAST(stream % 16 AS INT) AS sps_id, {fields}, CAST(n AS BIGINT) AS payload_len FROM o
UNION ALL SELECT DISTINCT stream, 0, 0, CAST({size} AS BIGINT), 0, CAST(stream % 16 AS INT), {sps_fields}, NULL FROM l"""


LOW = "CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 ELSE 4 END"
_CURRENT_SQL = _units_sql(3, 3, LOW, "NULL AS height, NULL AS width, CAST((stream + i) % 64 AS INT) AS qp, CAST(i % 3 AS INT) AS ec_part, CASE WHEN i % 4 = 3 THEN 1 ELSE 0 END AS reset",
                          "CAST(64 + stream % 200 AS INT), CAST(64 + stream % 300 AS INT), NULL, NULL, NULL")
_FLAGS_SQL = _units_sql(4, 2, LOW, "CAST((stream + i) % 64 AS INT) AS qp, NULL AS ec_part, NULL AS use_ada_i",
                        "NULL, CAST(stream % 2 AS INT), CAST(stream // 2 % 2 AS INT)")
_SPS_QP_SQL = _units_sql(6, 1, "CASE WHEN n <= 32767 THEN 2 ELSE 4 END", "NULL AS qp, NULL AS fa_idx", "CAST(stream % 64 AS INT), CAST(stream % 4 AS INT)")
_BASE = ["stream", "unit_no", "byte_offset", "unit_bytes", "nal_type", "sps_id"]


def _packets(spark, sf, dialect, fields):
    return parse_packets(derived.streams(spark, sf, dialect), dialect=dialect).select(*_BASE, *fields, "payload_len")


def _packet_files(spark, sf):
    """Every stream as a file of its own, read by walking the headers."""
    s = derived.streams(spark, sf).select(F.concat(F.lit("s"), F.col("stream").cast("string"), F.lit(".bin")).alias("name"), "content")
    out = derived.write_files(s, scratch_path(spark, "bin"))
    return pk.stream_rate(read_packets(spark, out)).select(F.regexp_extract("stream", r"s(\d+)\.bin$", 1).cast("bigint").alias("stream"), "bytes", F.col("frames").cast("bigint").alias("frames"), "kbps")


def _fixed_headers(spark, sf):
    """Documents as single-picture files of the four fixed-width forms."""
    d = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("body"))
    h = lambda n, w: F.lpad(F.hex(n), 2 * w, "0")
    size, n = F.concat(h(F.col("doc_id") % 500 + 1, 4), h(F.col("doc_id") % 300 + 1, 4)), F.length("body")
    forms = {"fixed_i": F.concat(size, h(F.col("doc_id") % 600, 2), h(n, 4)), "fixed_p": F.concat(h(F.col("doc_id") % 600, 2), h(F.col("doc_id") % 77, 2), h(n, 4)),
             "fixed_i2": F.concat(size, h(F.floor(n / 2), 4), h(n - F.floor(n / 2), 4)),
             "fixed_p4": F.concat(size, h(F.floor(n / 2), 4), h(F.lit(0), 4), h(F.lit(0), 4), h(n - F.floor(n / 2), 4))}
    out = None
    for dialect, head in forms.items():
        s = d.select(F.col("doc_id").alias("stream"), F.unhex(F.concat(head, F.hex("body"))).alias("content"))
        p = parse_packets(s, dialect=dialect).select("stream", F.lit(dialect).alias("dialect"), "nal_type", "height", "width", "qp", "qp_p", "unit_bytes", "payload_len", F.size("part_lens").alias("parts"))
        out = p if out is None else out.unionByName(p)
    return out


_FIXED_SQL = " UNION ALL ".join(
    f"SELECT doc_id AS stream, '{d}' AS dialect, {t} AS nal_type, {hw[0]} AS height, {hw[1]} AS width, {qp} AS qp, {qpp} AS qp_p, octet_length(encode(text)) + {n} AS unit_bytes, "
    f"octet_length(encode(text)) AS payload_len, {parts} AS parts FROM documents"
    for d, t, hw, qp, qpp, n, parts in [
        ("fixed_i", 1, ("CAST(doc_id % 500 + 1 AS INT)", "CAST(doc_id % 300 + 1 AS INT)"), "CAST(doc_id % 600 AS INT)", "NULL", 14, 1),
        ("fixed_p", 2, ("NULL", "NULL"), "CAST(doc_id % 600 AS INT)", "CAST(doc_id % 77 AS INT)", 8, 1),
        ("fixed_i2", 1, ("CAST(doc_id % 500 + 1 AS INT)", "CAST(doc_id % 300 + 1 AS INT)"), "NULL", "NULL", 16, 2),
        ("fixed_p4", 2, ("CAST(doc_id % 500 + 1 AS INT)", "CAST(doc_id % 300 + 1 AS INT)"), "NULL", "NULL", 24, 4)])


def _active_sets(spark, sf):
    return pk.active_parameter_set(view(spark, sf, "units"))


ACTIVE_SQL = f"""WITH {UNITS}, f AS (SELECT *, last_value(CASE WHEN nal_type = 0 THEN unit_no END IGNORE NULLS) OVER
  (PARTITION BY stream, sps_id ORDER BY unit_no ROWS UNBOUNDED PRECEDING) AS sps_unit FROM units)
SELECT f.stream, f.unit_no, f.nal_type, f.sps_id, f.unit_bytes, f.sps_unit, s.height, s.width, f.sps_unit IS NOT NULL AS valid
FROM f LEFT JOIN units s ON s.stream = f.stream AND s.unit_no = f.sps_unit WHERE f.nal_type <> 0"""


def _allocated(spark, sf):
    f = view(spark, sf, "units").withColumns({"height": F.expr("64 + 16 * (unit_no % 3)"), "width": F.expr("64 + 16 * (unit_no * stream % 5)")})
    return pk.allocate_ids(f).select("stream", "unit_no", "sps_id", "sps_new")


QUERIES = {
    "plane_psnr": Query(_plane_psnr, _PSNR_SQL),
    "padded_plane_psnr": Query(lambda s, f: _plane_psnr(s, f, pad=True), _PSNR_SQL),
    "frame_psnr": Query(_frame_psnr, f"""WITH {SCORES_SQL}, w AS (SELECT sequence, frame_idx, max(psnr) FILTER (plane = 'y') AS y,
  max(psnr) FILTER (plane = 'u') AS u, max(psnr) FILTER (plane = 'v') AS v FROM sc GROUP BY ALL)
SELECT sequence, frame_idx, round(y, 6) AS psnr_y, round(u, 6) AS psnr_u, round(v, 6) AS psnr_v, round((6 * y + u + v) / 8, 6) AS psnr FROM w"""),
    "plane_ms_ssim": Query(_ms_ssim),
    "score_mismatches": Query(_mismatches, """WITH d AS (SELECT CAST(label AS STRING) AS sequence, vec_id,
  (vec_id % 64) / 64e0 AS psnr, (vec_id % 64) / 64e0 + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END AS other FROM embeddings)
SELECT sequence, vec_id AS frame_idx, psnr AS encoded, CASE WHEN vec_id % 11 <> 0 THEN other END AS decoded FROM d WHERE vec_id % 5 = 0 OR vec_id % 11 = 0
UNION ALL SELECT sequence, -1 - vec_id, NULL, other FROM d WHERE vec_id % 11 = 0"""),
    "rgb_to_ycbcr": Query(_to_ycbcr, f"""WITH {PIXELS_SQL} SELECT frame_idx, CAST(k AS INT) AS k, round(y, 7) AS y, round(cb, 7) AS cb, round(cr, 7) AS cr,
  CAST(round_even(y * 255, 0) AS INT) AS y8 FROM ycc"""),
    "ycbcr_to_rgb": Query(_to_rgb, f"""WITH {PIXELS_SQL}, c AS (SELECT frame_idx, k, r + (2 - 2 * 0.2126e0) * (b - 0.5e0) AS r2, r + (2 - 2 * 0.0722e0) * (g - 0.5e0) AS b2, r FROM px),
o AS (SELECT *, (r - 0.2126e0 * r2 - 0.0722e0 * b2) / 0.7152e0 AS g2 FROM c)
SELECT frame_idx, CAST(k AS INT) AS k, round(least(greatest(r2, 0e0), 1e0), 7) AS r, round(least(greatest(g2, 0e0), 1e0), 7) AS g,
  round(least(greatest(b2, 0e0), 1e0), 7) AS b, round(g2, 7) AS open_g FROM o"""),
    "chroma_up": Query(_to_444, _TO_444_SQL),
    "chroma_down": Query(_rgb_to_420, _RGB_420_SQL),
    "file_to_rgb": Query(_file_to_rgb, f"""WITH {NUMBERED_SQL}, q AS ({_420_RGB_SQL})
SELECT q.sequence, pos.frame_idx, plane, x, y, value FROM q JOIN pos ON pos.id = q.frame_idx"""),
    "video_to_rgb": Query(_420_to_rgb, _420_RGB_SQL),
    "raw_video_round_trip": Query(_raw_round_trip, _RAW_SQL),
    "raw_video_range": Query(_raw_range, f"WITH r AS ({_RAW_SQL}) SELECT sequence, frame_idx - 5 AS frame_idx, p0, p1, p2 FROM r WHERE frame_idx >= 5 AND frame_idx < 25"),
    "deep_raw_video": Query(_deep_video, f"""WITH {NUMBERED_RGB_SQL}, d AS (SELECT p.sequence, p.frame_idx, k, {", ".join(f"CAST(round_even({c} / 255e0 * 1023, 0) AS INT) AS {c}" for c in "rgb")}
  FROM pos p JOIN channels s ON s.frame_idx = p.id)
SELECT sequence, frame_idx, """ + ", ".join(
        f"string_agg(printf('%02X%02X', {c} % 256, {c} // 256), '' ORDER BY k) AS p{n}" for n, c in enumerate("rgb")) + " FROM d GROUP BY ALL"),
    "png_frames": Query(_png_frames, f"""WITH {NUMBERED_RGB_SQL} SELECT p.sequence, p.frame_idx, {_RGB_HEX} FROM pos p JOIN channels s ON s.frame_idx = p.id
WHERE p.sequence <> 'label_3' OR p.frame_idx < 6 GROUP BY ALL"""),
    "picture_names": Query(_picture_names, f"""WITH {NUMBERED_SQL} SELECT printf('im%05d.png', frame_idx + CASE WHEN sequence = 'label_3' AND frame_idx >= 6
  THEN 2 ELSE 1 END) AS name, count(*) AS sequences FROM pos GROUP BY ALL"""),
    "parse_packets": Query(lambda s, f: _packets(s, f, "current", ["height", "width", "qp", "ec_part", "reset"]), _CURRENT_SQL),
    "parse_packets_sps_flags": Query(lambda s, f: _packets(s, f, "sps_flags", ["qp", "ec_part", "use_ada_i"]), _FLAGS_SQL),
    "parse_packets_sps_qp": Query(lambda s, f: _packets(s, f, "sps_qp", ["qp", "fa_idx"]), _SPS_QP_SQL),
    "fixed_headers": Query(_fixed_headers, _FIXED_SQL),
    "packet_summary": Query(lambda s, f: pk.packet_summary(parse_packets(derived.streams(s, f))), f"""WITH u AS ({_CURRENT_SQL})
SELECT stream, nal_type, count(*) AS units, CAST(sum(unit_bytes) AS BIGINT) AS bytes, CAST(sum(coalesce(payload_len, 0)) AS BIGINT) AS payload_bytes,
  CAST(sum(unit_bytes) * 8 AS BIGINT) AS bits, CAST(sum(unit_bytes) - sum(coalesce(payload_len, 0)) AS BIGINT) AS header_bytes FROM u GROUP BY stream, nal_type"""),
    "packet_files": Query(_packet_files, f"""WITH u AS ({_CURRENT_SQL}), g AS (SELECT stream, CAST(sum(unit_bytes) AS BIGINT) AS bytes,
  CAST(count(*) FILTER (nal_type <> 0) AS BIGINT) AS frames FROM u GROUP BY stream)
SELECT stream, bytes, frames, CAST(floor(bytes * 8 / (frames / 30e0) / 1000) AS BIGINT) AS kbps FROM g"""),
    "active_parameter_sets": Query(_active_sets, ACTIVE_SQL),
    "allocated_ids": Query(_allocated, f"""WITH {UNITS}, f AS (SELECT stream, unit_no, 64 + 16 * (unit_no % 3) AS h, 64 + 16 * (unit_no * stream % 5) AS w FROM units),
k AS (SELECT stream, h, w, min(unit_no) AS first FROM f GROUP BY ALL), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY stream ORDER BY first) - 1 AS INT) AS sps_id FROM k)
SELECT f.stream, f.unit_no, n.sps_id, f.unit_no = n.first AS sps_new FROM f JOIN n USING (stream, h, w)"""),
}
