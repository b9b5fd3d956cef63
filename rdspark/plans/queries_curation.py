"""Queries that curate training sets: manifests, clips, epoch plans, shards, batches, patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from rdspark.functions.draws import mix_sql
from rdspark.operators import curation as cu, planes
from rdspark.plans import derived
from rdspark.plans.catalog import Query, rd
from rdspark.plans.derived import table, view, view_sql
from rdspark.sources.manifests import parse_image_manifest, parse_video_manifest

SEED, EPOCH, FRAMES = 7, 3, 17
PATCH_W, PATCH_H = 256, 256
LAMBDAS = (1.0, 768.0)
CLIPS = view_sql("clip_sources")


def sources(spark, sf):
    return view(spark, sf, "clip_sources")


def clips(spark, sf):
    return cu.sample_clips(sources(spark, sf), FRAMES, PATCH_W, PATCH_H, LAMBDAS, EPOCH, SEED)


def draw(use: int, id_: str = "seq_id", epoch: str = str(EPOCH)) -> str:
    return mix_sql(id_, epoch, SEED, use)


# Frame k of a clip: a window from the drawn start, or the walk over 2(L-1) positions.
_WALK = ("CASE WHEN seq_length > {n} THEN CAST(({draw}) % (seq_length - {n}) AS INT) + k WHEN seq_length = 1 THEN 0 "
         "WHEN k % (2 * (seq_length - 1)) < seq_length THEN k % (2 * (seq_length - 1)) "
         "ELSE 2 * (seq_length - 1) - k % (2 * (seq_length - 1)) END")
CLIP_FRAMES_SQL = (f"cf AS (SELECT seq_id, k, CAST({_WALK.format(n=FRAMES, draw=draw(1))} AS INT) AS frame_idx "
                   f"FROM clip_sources, (SELECT CAST(k AS INT) AS k FROM range({FRAMES}) t(k)))")


def _clip_frames(spark, sf):
    return clips(spark, sf).select("seq_id", F.posexplode("frame_indexes").alias("k", "frame_idx"))


def _clip_geometry(spark, sf):
    return clips(spark, sf).select("seq_id", "clip_start", "pad_left", "pad_right", "pad_top", "pad_bottom", "crop_x", "crop_y", "flip", "qp",
                                   rd("lam", 6).alias("lam"))


_GEOMETRY_SQL = f"""WITH {CLIPS}, p AS (SELECT *, greatest({PATCH_W} - width, 0) AS pw, greatest({PATCH_H} - height, 0) AS ph,
  CAST({draw(5)} % 64 AS INT) AS qp FROM clip_sources)
SELECT seq_id, CASE WHEN seq_length > {FRAMES} THEN CAST(({draw(1)}) % (seq_length - {FRAMES}) AS INT) ELSE 0 END AS clip_start,
  CAST(pw // 2 AS INT) AS pad_left, CAST(pw - pw // 2 AS INT) AS pad_right, CAST(ph // 2 AS INT) AS pad_top, CAST(ph - ph // 2 AS INT) AS pad_bottom,
  CAST({draw(3)} % (width + pw - {PATCH_W} + 1) AS INT) AS crop_x, CAST({draw(4)} % (height + ph - {PATCH_H} + 1) AS INT) AS crop_y,
  {draw(2)} % 2 = 1 AS flip, qp, round(exp(ln(1e0) + qp * ((ln(768e0) - ln(1e0)) / 63)), 6) AS lam FROM p"""


def _groups(spark, sf):
    g = cu.clip_groups(clips(spark, sf).select("seq_id", F.expr(f"slice(frame_indexes, 1, 1 + CAST(seq_id % {FRAMES} AS INT))").alias("frame_indexes")), 4)
    return g.select("seq_id", "group_no", F.posexplode("frames").alias("at", "frame_idx"))


_GROUPS_SQL = f"""WITH {CLIPS}, {CLIP_FRAMES_SQL}, c AS (SELECT *, seq_id % {FRAMES} AS extra FROM cf WHERE k <= seq_id % {FRAMES})
SELECT seq_id, CASE WHEN k = 0 THEN 0 ELSE (k - 1) // 4 + 1 END AS group_no, CASE WHEN k = 0 THEN 0 ELSE (k - 1) % 4 END AS at, frame_idx
FROM c WHERE k = 0 OR (k - 1) // 4 < extra // 4"""


def _epoch_plan(spark, sf):
    """Every order as a training step of some epoch, with the plan row of that epoch."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 120).cast("int").alias("epoch"))
    parts = [cu.with_epoch_plan(o, s, g).withColumns({"structure": F.lit(s), "stage": F.lit(g)})
             for s, g in (("ld", "stage0"), ("ht", "stage0"), ("ht", "stage2"), ("image", "stage0"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("o_orderkey", "structure", "stage", "epoch", "lr", "frame_num", "patch_w")


def _plan_sql(structure, stage, rows) -> str:
    """Stretches of a plan, written out by their last epoch."""
    pick = lambda i: "CASE " + " ".join(f"WHEN epoch < {r[0]} THEN {r[i]}" for r in rows[:-1]) + f" ELSE {rows[-1][i]} END"
    return (f"SELECT o_orderkey, '{structure}' AS structure, '{stage}' AS stage, epoch, CAST({pick(1)} AS DOUBLE) AS lr, "
            f"CAST({pick(2)} AS INT) AS frame_num, {pick(3)} AS patch_w FROM o")


_PLAN_SQL = "WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 120 AS INT) AS epoch FROM orders) " + " UNION ALL ".join([
    _plan_sql("ld", "stage0", [(5, "1e-4", 2, 256), (10, "1e-4", 3, 256), (0, "1e-4", 6, 256)]),
    _plan_sql("ht", "stage0", [(5, "1e-4", 9, 256), (10, "1e-4", 17, 256), (0, "1e-4", 33, 256)]),
    _plan_sql("ht", "stage2", [(10, "5e-5", 33, 512), (20, "5e-5", 49, 512), (32, "1e-5", 65, 512), (0, "2e-6", 65, 512)]),
    _plan_sql("image", "stage0", [(45, "2e-4", "NULL", 256), (70, "5e-5", "NULL", 256), (90, "1e-5", "NULL", 256),
                                  (95, "2e-4", "NULL", 512), (99, "5e-5", "NULL", 512), (103, "1e-5", "NULL", 512),
                                  (0, "1e-6", "NULL", 512)])])


def _multipliers(spark, sf):
    """Multiplier of each drawn quality index, by lookup in the table and in closed form."""
    drawn = sources(spark, sf).select("seq_id", cu.draw_qp("seq_id", EPOCH, SEED).alias("qp"))
    looked = cu.lookup_multiplier(drawn, cu.multiplier_table(spark, *LAMBDAS))
    return cu.with_multiplier(looked.withColumnRenamed("lam", "looked"), *LAMBDAS).select(
        "seq_id", "qp", rd("lam", 6).alias("lam"), rd("looked", 6).alias("looked"))


def _video_texts(spark, sf):
    """One description per part: its sequence, and its frame names."""
    parts = table(spark, sf, "part").select("p_partkey", "p_size")
    # Small rows make texts of a kilobyte here: they are spread over the cores first.
    dealt = parts.repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey", "p_size")
    s = dealt.select(F.col("p_partkey").alias("manifest"), F.struct(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("path"), F.lit(640).alias("width"), F.lit(360).alias("height"), F.col("p_size").alias("seq_length")).alias("s"))
    names = F.array(*[F.lit(f"im{i:05d}.png") for i in range(1, 65)])      # literals: formatted once, not for every part
    return s.select("manifest", F.to_json(F.struct(F.array("s").alias("seqs"), names.alias("frames"))).alias("value"))


def _manifest_frames(spark, sf):
    """Every frame of every sequence with its file name."""
    seqs, names = parse_video_manifest(_video_texts(spark, sf))
    return cu.manifest_frames(seqs, names).select("path", "frame_no", "frame_name")


def _image_manifest(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", F.concat(F.lit("img_"), F.col("doc_id").cast("string"), F.lit(".png"))).alias("n"))
    texts = d.select(F.to_json(F.array("n", F.concat(F.lit("/abs/"), "n"))).alias("value"))
    return parse_image_manifest(texts, "/root/images").select("image_id", "path")


def _image_samples(spark, sf):
    """Every document as a picture of a size of its own, cropped for training."""
    d = table(spark, sf, "documents").selectExpr("doc_id AS image_id", "CAST(100 + n_chars % 500 AS INT) AS width", "CAST(100 + n_chars % 400 AS INT) AS height")
    s = cu.sample_images(d, PATCH_W, PATCH_H, LAMBDAS, EPOCH, SEED)
    return s.select("image_id", "pad_left", "pad_bottom", "crop_x", "crop_y", "flip", "qp", rd("lam", 6).alias("lam"))


_IMAGE_SQL = f"""WITH d AS (SELECT doc_id AS id, CAST(100 + n_chars % 500 AS INT) AS w, CAST(100 + n_chars % 400 AS INT) AS h FROM documents),
p AS (SELECT *, greatest({PATCH_W} - w, 0) AS pw, greatest({PATCH_H} - h, 0) AS ph, CAST({draw(5, 'id')} % 64 AS INT) AS qp FROM d)
SELECT id AS image_id, CAST(pw // 2 AS INT) AS pad_left, CAST(ph - ph // 2 AS INT) AS pad_bottom, CAST({draw(3, 'id')} % (w + pw - {PATCH_W} + 1) AS INT) AS crop_x,
  CAST({draw(4, 'id')} % (h + ph - {PATCH_H} + 1) AS INT) AS crop_y, {draw(2, 'id')} % 2 = 1 AS flip, qp, round(exp(qp * (ln(768e0) / 63)), 6) AS lam FROM p"""


WORLD, BATCH = 7, 56


def _shards(spark, sf):
    """Orders in the random order of an epoch, dealt out to ranks; the order is worked out row by row."""
    order = cu.permuted(cu.file_index(table(spark, sf, "orders")), EPOCH, SEED)
    return cu.shard(order, WORLD).select("o_orderkey", "rank", "rank_pos", "rank_total")


def _drawn_shards(spark, sf):
    """The same for samples without a place of their own: parts in the order of a draw."""
    order = cu.shuffle_order(table(spark, sf, "part").select("p_partkey"), "p_partkey", EPOCH, SEED)
    return cu.shard(order, WORLD).select("p_partkey", "rank", "rank_pos", "rank_total")


def _batches(spark, sf):
    """Order lines (rows of one order and line number are one) in the order of a draw, dealt out to ranks and cut into batches."""
    lines = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")).agg(F.sum("l_quantity").alias("q"))
    b = cu.batches(cu.shard(cu.shuffle_order(lines, "id", EPOCH, SEED), WORLD), BATCH, WORLD)
    return b.groupBy("rank", "batch_no").agg(F.count(F.lit(1)).alias("size"), F.sum("id").alias("ids"), F.sum("q").alias("quantity"), F.sum("rn").alias("places"))


# The given orders lie in their file in the order of their keys.
_INDEXED = "i AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS index, count(*) OVER () AS total FROM orders), "
_DEALT = (f"d AS (SELECT r.*, rn + c.c * total AS place, CAST(ceil(total / {WORLD}) AS BIGINT) AS rank_total FROM {{0}} r, range(2) c(c) "
          f"WHERE rn + c.c * total < ceil(total / {WORLD}) * {WORLD})")
_PLACES = f"{_INDEXED}{cu.permuted_sql(str(EPOCH), SEED, 'i')}, {_DEALT.format('permuted')}"


STAGED = "CAST(n_regionkey AS INT) AS stage, CAST((n_nationkey - n_regionkey) // 5 * (3 + n_regionkey) AS INT) AS first_epoch, 1e-4 / (1 + n_nationkey) AS lr, CAST(2 + n_nationkey AS INT) AS frame_num"


def _schedules(spark, sf):
    """Orders as training steps of five stages, with the settings of a schedule that is a table of its own."""
    schedule = table(spark, sf, "nation").selectExpr("CAST(n_regionkey AS INT) AS stage", "CAST((n_nationkey - n_regionkey) div 5 * (3 + n_regionkey) AS INT) AS first_epoch",
                                                     "1e-4D / (1 + n_nationkey) AS lr", "CAST(2 + n_nationkey AS INT) AS frame_num")
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "CAST(o_custkey % 5 AS INT) AS stage", "CAST(o_orderkey % 60 AS INT) AS epoch")
    return cu.with_schedule(o, schedule, ["stage"]).select("o_orderkey", "stage", "epoch", rd(F.col("lr") * 1e6, 6).alias("lr"), "frame_num")


_SCHEDULES_SQL = f"""WITH s AS (SELECT {STAGED} FROM nation), o AS (SELECT o_orderkey, CAST(o_custkey % 5 AS INT) AS stage, CAST(o_orderkey % 60 AS INT) AS epoch FROM orders)
SELECT o_orderkey, o.stage, epoch, round(lr * 1e6, 6) AS lr, frame_num FROM o ASOF JOIN s ON o.stage = s.stage AND o.epoch >= s.first_epoch"""


def _patches(spark, sf):
    """7x7 patches of the 8x8 RGB frames: the mean of each channel."""
    f = derived.rgb_frames(spark, sf)
    one = f.select("sequence", "width", "height", F.col("frame_idx").alias("sample_id"), F.array(F.col("frame_idx").cast("int")).alias("frame_indexes"))
    c = cu.crop_geometry(one, 7, 7, "sample_id", EPOCH, SEED).withColumn("flip", cu.flip_flag("sample_id", EPOCH, SEED))
    p = planes.extract_patches(c, f, 7, 7).withColumn("v", planes.patch_values())
    mean = lambda k: rd(F.aggregate(F.slice("v", 49 * k + 1, 49), F.lit(0.0), lambda a, x: a + x.cast("double")) / 49, 6)
    return p.select("sample_id", mean(0).alias("y"), mean(1).alias("cb"), mean(2).alias("cr"))


_PATCH_SQL = f"""WITH {derived.CHANNELS_SQL}, px AS (SELECT frame_idx AS id, k // 8 AS y, k % 8 AS x, r / 255e0 AS r, g / 255e0 AS g, b / 255e0 AS b FROM channels),
yy AS (SELECT *, 0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b AS l FROM px),
cc AS (SELECT *, CASE WHEN {draw(2, 'id')} % 2 = 1 THEN 7 - x ELSE x END AS fx, {draw(3, 'id')} % 2 AS cx, {draw(4, 'id')} % 2 AS cy,
  CAST(l - 0.5e0 AS FLOAT) AS v0, CAST(0.5e0 * (b - l) / (1 - 0.0722e0) AS FLOAT) AS v1, CAST(0.5e0 * (r - l) / (1 - 0.2126e0) AS FLOAT) AS v2 FROM yy)
SELECT id AS sample_id, round(avg(CAST(v0 AS DOUBLE)), 6) AS y, round(avg(CAST(v1 AS DOUBLE)), 6) AS cb, round(avg(CAST(v2 AS DOUBLE)), 6) AS cr
FROM cc WHERE fx >= cx AND fx < cx + 7 AND y >= cy AND y < cy + 7 GROUP BY id"""


QUERIES = {
    "clip_frames": Query(_clip_frames, f"WITH {CLIPS}, {CLIP_FRAMES_SQL} SELECT seq_id, k, frame_idx FROM cf"),
    "clip_geometry": Query(_clip_geometry, _GEOMETRY_SQL),
    "clip_groups": Query(_groups, _GROUPS_SQL),
    "epoch_plan": Query(_epoch_plan, _PLAN_SQL),
    "multipliers": Query(_multipliers, f"""WITH {CLIPS}, q AS (SELECT seq_id, CAST({draw(5)} % 64 AS INT) AS qp FROM clip_sources)
SELECT seq_id, qp, round(exp(ln(1e0) + qp * ((ln(768e0) - ln(1e0)) / 63)), 6) AS lam,
  round(exp(ln(1e0) + qp * ((ln(768e0) - ln(1e0)) / 63)), 6) AS looked FROM q"""),
    "manifest_frames": Query(_manifest_frames, """SELECT 'part_' || p_partkey AS path, CAST(k AS INT) AS frame_no, printf('im%05d.png', k + 1) AS frame_name
FROM part, range(64) t(k) WHERE k < p_size"""),
    "image_manifest": Query(_image_manifest, """SELECT 0 AS image_id, '/root/images/' || source || '/img_' || doc_id || '.png' AS path FROM documents
UNION ALL SELECT 1, '/abs/' || source || '/img_' || doc_id || '.png' FROM documents"""),
    "image_samples": Query(_image_samples, _IMAGE_SQL),
    "schedules": Query(_schedules, _SCHEDULES_SQL),
    "shards": Query(_shards, f"""WITH {_PLACES}
SELECT id AS o_orderkey, CAST(place % {WORLD} AS INT) AS rank, CAST(place // {WORLD} AS BIGINT) AS rank_pos, rank_total FROM d"""),
    "drawn_shards": Query(_drawn_shards, "WITH s AS (SELECT p_partkey AS id, " + draw(6, "p_partkey") + f""" AS draw FROM part),
r AS (SELECT *, row_number() OVER (ORDER BY draw, id) - 1 AS rn, count(*) OVER () AS total FROM s), {_DEALT.format('r')}
SELECT id AS p_partkey, CAST(place % {WORLD} AS INT) AS rank, CAST(place // {WORLD} AS BIGINT) AS rank_pos, rank_total FROM d"""),
    "batches": Query(_batches, "WITH g AS (SELECT l_orderkey * 8 + l_linenumber AS id, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), s AS (SELECT id, q, "
                     + draw(6, "id") + f""" AS draw FROM g),
r AS (SELECT *, row_number() OVER (ORDER BY draw, id) - 1 AS rn, count(*) OVER () AS total FROM s), {_DEALT.format('r')}
SELECT CAST(place % {WORLD} AS INT) AS rank, CAST(place // {WORLD} // {BATCH // WORLD} AS BIGINT) AS batch_no, count(*) AS size,
  CAST(sum(id) AS BIGINT) AS ids, sum(q) AS quantity, CAST(sum(rn) AS BIGINT) AS places FROM d WHERE place // {WORLD} // {BATCH // WORLD} < rank_total // {BATCH // WORLD} GROUP BY 1, 2"""),
    "patches": Query(_patches, _PATCH_SQL),
}
