"""Training-set curation: clip manifests, crop geometry, epoch plans, shards and batches.

Every draw is a pure function of (seed, epoch, sample id), see ``functions.draws``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from rdspark.functions import draws, ladders
from rdspark.functions.results import col
from rdspark.operators.numbering import number_within, spread_join
from rdspark.operators.ordered import changes

# Which use a draw is for; part of the mix so that the draws of one sample are independent.
USE_START, USE_FLIP, USE_X, USE_Y, USE_QP, USE_ORDER = 1, 2, 3, 4, 5, 6

SHUFFLE_BUCKETS = 65536
NAMES = 1024   # positions of a block of file names
ROUNDS = 4     # of the permutation of places; each mixes columns and rows of a square of all places once


# --------------------------------------------------------------------------- schedules


def standard_schedules(unit_frames: int = 8) -> list[tuple]:
    """Stretches (structure, stage, first_epoch, lr, frame_num, cascade, patch_w, patch_h) of the fixed training plans.

    ``unit_frames`` is the number of frames in a coding unit of structure "ht".
    """
    unit = unit_frames
    # Epochs, learning rate, frames, cascaded, patch width, patch height. The last stretch holds for all later epochs.
    plans = {
        ("ld", "stage0"): [(5, 1e-4, 2, False, 256, 256), (5, 1e-4, 3, False, 256, 256), (45, 1e-4, 6, False, 256, 256), (1, 1e-4, 6, False, 256, 256)],
        ("ld", "stage1"): [(5, 5e-5, 8, True, 256, 256), (5, 5e-5, 16, True, 256, 256), (5, 5e-5, 24, True, 256, 256), (15, 5e-5, 32, True, 256, 256),
                           (7, 5e-6, 32, True, 256, 256), (1, 5e-6, 32, True, 256, 256)],
        ("ld", "stage2"): [(14, 5e-5, 33, True, 512, 512), (4, 5e-6, 33, True, 512, 512), (7, 2e-5, 49, True, 512, 512), (2, 2e-6, 49, True, 512, 512),
                           (7, 5e-6, 65, True, 512, 512), (6, 2e-6, 65, True, 512, 512), (1, 2e-6, 65, True, 512, 512)],
        ("ld", "stage3"): [(2, 2e-6, 97, True, 512, 512), (2, 5e-7, 129, True, 512, 512), (1, 5e-7, 129, True, 512, 512)],
        ("ht", "stage0"): [(5, 1e-4, 1 + 1 * unit, False, 256, 256), (5, 1e-4, 1 + 2 * unit, False, 256, 256), (35, 1e-4, 1 + 4 * unit, False, 256, 256),
                           (1, 1e-4, 1 + 4 * unit, False, 256, 256)],
        ("ht", "stage1"): [(2, 5e-5, 17, True, 256, 256), (1, 5e-5, 25, True, 256, 256), (3, 5e-5, 33, True, 256, 256), (4, 5e-6, 33, True, 256, 256),
                           (1, 5e-6, 33, True, 256, 256)],
        ("ht", "stage2"): [(10, 5e-5, 33, True, 512, 512), (10, 5e-5, 49, True, 512, 512), (12, 1e-5, 65, True, 512, 512), (8, 2e-6, 65, True, 512, 512),
                           (1, 2e-6, 65, True, 512, 512)],
        ("ht", "stage3"): [(2, 1e-5, 97, True, 512, 512), (2, 2e-6, 129, True, 512, 512), (1, 2e-6, 129, True, 512, 512)],
        ("image", "stage0"): [(45, 2e-4, None, None, 256, 256), (25, 5e-5, None, None, 256, 256), (20, 1e-5, None, None, 256, 256), (5, 2e-4, None, None, 512, 512),
                              (4, 5e-5, None, None, 512, 512), (4, 1e-5, None, None, 512, 512), (2, 1e-6, None, None, 512, 512), (1, 1e-6, None, None, 512, 512)],
    }
    rows = []
    for (structure, stage), stretches in plans.items():
        first = 0
        for epochs, *settings in stretches:
            rows.append((structure, stage, first, *settings))
            first += epochs
    return rows


SCHEDULE = "structure string, stage string, first_epoch int, lr double, frame_num int, cascade boolean, patch_w int, patch_h int"


def standard_schedule(spark: SparkSession, unit_frames: int = 8) -> DataFrame:
    """The fixed plans as a schedule table (a few dozen rows)."""
    return spark.createDataFrame(standard_schedules(unit_frames), SCHEDULE)


def with_schedule(df: DataFrame, schedule: DataFrame, by: Sequence[str] = (), epoch: str = "epoch", first: str = "first_epoch") -> DataFrame:
    """``df`` with the settings of the stretch that each epoch lies in, from the caller's table of stretches.

    ``schedule`` has the columns ``by``, the first epoch of each stretch, and settings; a stretch ends where the next one begins, and the last one never does.
    Stretches may come in any order and be as uneven as they like. An epoch before the first stretch, or a plan that is not in the table, is an error; two
    stretches of a plan that begin together are one too. The stretches of a plan become one sorted array, a scalar of the query where there is
    one plan, else a few facts joined over a salt; so ``df`` does not move for one plan, and no plan's rows meet in one task for several.
    """
    settings = [c for c in schedule.columns if c not in (*by, first)]
    entry = F.struct(F.col(first).alias("first"), F.struct(*settings).alias("settings"))
    sorted_ = F.sort_array(F.collect_list(entry))
    twice = F.size(F.array_distinct(F.transform("__s", lambda s: s["first"]))) < F.size("__s")
    plans = schedule.groupBy(*by).agg(sorted_.alias("__s")).withColumn(
        "__s", F.when(twice, F.raise_error(F.lit("two stretches begin at one epoch"))).otherwise(F.col("__s")))
    if by:
        met = spread_join(df, plans, by, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c not in by] or [F.lit(0)]))
    else:
        met = df.withColumn("__s", plans.select("__s").scalar())
    found = F.element_at(F.filter("__s", lambda s: s["first"] <= F.col(epoch)), -1)
    lost = F.raise_error(F.concat(F.lit("no stretch of the schedule for epoch "), F.coalesce(F.col(epoch).cast("string"), F.lit("null"))))
    begun = F.coalesce(F.exists("__s", lambda s: s["first"] <= F.col(epoch)), F.lit(False))
    return met.withColumn("__p", F.when(begun, found["settings"]).otherwise(lost)).select(*[F.col(f"`{c}`") for c in df.columns if c not in settings], "__p.*")


def with_epoch_plan(df: DataFrame, structure: str, stage: str, epoch: str = "epoch", unit_frames: int = 8) -> DataFrame:
    """Settings of each epoch in one of the fixed plans; epochs past the end use the last row."""
    plan = standard_schedule(df.sparkSession, unit_frames).where((F.col("structure") == structure) & (F.col("stage") == stage)).drop("structure", "stage")
    if plan.isEmpty():
        raise ValueError(f"no plan for {structure} {stage}")
    return with_schedule(df, plan, epoch=epoch)


def multiplier_table(spark: SparkSession, low: float, high: float, qp_count: int = ladders.QP_COUNT) -> DataFrame:
    """Rate multiplier of each quality index, evenly spaced in the logarithm."""
    return spark.range(qp_count).select(F.col("id").cast("int").alias("qp"),
                                        ladders.log_between("id", qp_count, low, high).alias("lam"))


def with_multiplier(df: DataFrame, low: float, high: float, qp: str = "qp",
                    qp_count: int = ladders.QP_COUNT) -> DataFrame:
    """The multiplier of each row's quality index. The table has a closed form, so the lookup is a column."""
    valid = F.col(qp).between(0, qp_count - 1)
    return df.withColumn("lam", F.when(valid, ladders.log_between(qp, qp_count, low, high)))


def lookup_multiplier(df: DataFrame, table: DataFrame, qp: str = "qp") -> DataFrame:
    """The same against a table given by the caller; the plan decides how to join it."""
    return df.join(table.withColumnRenamed("qp", qp), qp, "left")


# --------------------------------------------------------------------------- clips


def clip_start(length, frames, id_, epoch, seed: int) -> Column:
    """First frame of a clip. The last possible window is never drawn; short sequences start at 0."""
    room = col(length) - col(frames)
    return F.when(room > 0, draws.below(room, id_, epoch, seed, USE_START)).otherwise(F.lit(0)).cast("int")


def clip_frames(length, frames, start) -> Column:
    """Frame indexes of a clip: a window, or a walk back and forth when the sequence is not longer.

    The walk over L frames has period 2(L-1); a single-frame sequence repeats its frame.
    """
    n, size, first = col(frames), col(length), col(start)
    steps = F.sequence(F.lit(0), n.cast("int") - 1)
    top = size - 1
    window = F.transform(steps, lambda i: (first + i).cast("int"))
    walk = F.transform(steps, lambda i: F.when(top <= 0, F.lit(0)).otherwise(
        top - F.abs(top - F.pmod(i, F.greatest(2 * top, F.lit(1))))).cast("int"))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n < size, window).otherwise(walk)


def crop_geometry(df: DataFrame, patch_w, patch_h, id_: str, epoch, seed: int) -> DataFrame:
    """Zero padding up to the patch (split evenly) and a random offset in the padded picture."""
    pw = F.lit(patch_w) if isinstance(patch_w, int) else col(patch_w)
    ph = F.lit(patch_h) if isinstance(patch_h, int) else col(patch_h)
    pad_w = F.greatest(pw - F.col("width"), F.lit(0)).cast("int")
    pad_h = F.greatest(ph - F.col("height"), F.lit(0)).cast("int")
    room = lambda size, pad, patch: F.col(size) + pad - patch + 1
    return df.withColumns({
        "pad_left": F.floor(pad_w / 2).cast("int"), "pad_right": (pad_w - F.floor(pad_w / 2)).cast("int"),
        "pad_top": F.floor(pad_h / 2).cast("int"), "pad_bottom": (pad_h - F.floor(pad_h / 2)).cast("int"),
        "crop_x": draws.below(room("width", pad_w, pw), id_, epoch, seed, USE_X).cast("int"),
        "crop_y": draws.below(room("height", pad_h, ph), id_, epoch, seed, USE_Y).cast("int")})


def flip_flag(id_, epoch, seed: int) -> Column:
    return draws.below(2, id_, epoch, seed, USE_FLIP) == 1


def draw_qp(id_, epoch, seed: int, qp_count: int = ladders.QP_COUNT) -> Column:
    return draws.below(qp_count, id_, epoch, seed, USE_QP).cast("int")


def sample_clips(sequences: DataFrame, frames, patch_w, patch_h, multipliers: tuple[float, float],
                 epoch=0, seed: int = 0, id_: str = "seq_id") -> DataFrame:
    """One training sample per sequence and epoch: frames, crop, flip, quality index, multiplier.

    A projection: the manifest is read once and nothing moves.
    """
    n = F.lit(frames) if isinstance(frames, int) else col(frames)
    out = sequences.withColumn("clip_start", clip_start("seq_length", n, id_, epoch, seed))
    out = out.withColumn("frame_indexes", clip_frames("seq_length", n, "clip_start"))
    out = crop_geometry(out, patch_w, patch_h, id_, epoch, seed)
    out = out.withColumns({"flip": flip_flag(id_, epoch, seed), "qp": draw_qp(id_, epoch, seed)})
    return with_multiplier(out, *multipliers)


def sample_images(images: DataFrame, patch_w, patch_h, multipliers: tuple[float, float], epoch=0, seed: int = 0,
                  id_: str = "image_id") -> DataFrame:
    """One training sample per picture and epoch: crop, flip, quality index, multiplier."""
    out = crop_geometry(images, patch_w, patch_h, id_, epoch, seed)
    out = out.withColumns({"flip": flip_flag(id_, epoch, seed), "qp": draw_qp(id_, epoch, seed)})
    return with_multiplier(out, *multipliers)


def clip_groups(clips: DataFrame, group: int) -> DataFrame:
    """First frame alone as group 0, then groups of ``group`` frames; an incomplete last group is dropped."""
    if group < 1:
        raise ValueError("a group has at least one frame")
    full = F.floor((F.size("frame_indexes") - 1) / group).cast("int")
    numbers = F.sequence(F.lit(0), F.greatest(full, F.lit(0)))
    member = F.transform(numbers, lambda k: F.struct(
        k.alias("group_no"),
        F.when(k == 0, F.slice("frame_indexes", 1, 1))
        .otherwise(F.slice("frame_indexes", (2 + (k - 1) * group).cast("int"), F.lit(group))).alias("frames")))
    kept = clips.filter(F.size("frame_indexes") > 0).withColumn("__g", member)
    return kept.select("*", F.inline("__g")).drop("__g")


def _name_pieces(names: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __block, __first, __stop, one list for each other column): runs of consecutive positions inside a block of ``NAMES`` positions, and the
    first position of the block without a name.

    Runs are made inside the Arrow batches in which the names come, so what moves is a row a list and not a row a name. Runs may overlap (a list that comes twice).
    """
    others = [f for f in names.schema.fields if f.name not in (*keys, "frame_no")]
    kept = [f for f in names.schema.fields if f.name in keys]
    schema = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in ("__block", "__first", "__size")), *(T.StructField(f.name, T.ArrayType(f.dataType)) for f in others)])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("__at").to_numpy(zero_copy_only=False)
            new = changes(batch, keys, None)
            new[1:] |= (np.diff(at) != 1) | (at[1:] % NAMES == 0)
            first = np.flatnonzero(new)
            ends = np.append(first[1:], batch.num_rows)
            offsets = pa.array(np.append(first, batch.num_rows), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, batch.column(f.name)) for f in others]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(first)) for k in keys), pa.array(at[first] // NAMES), pa.array(at[first]), pa.array(ends - first), *lists],
                                             names=schema.names)
    placed = names.where(F.col("frame_no") >= 0)
    placed = placed.dropna(subset=keys) if keys else placed      # a null key meets nothing
    runs = placed.select(*keys, F.col("frame_no").cast("bigint").alias("__at"), *[F.col(f"`{f.name}`") for f in others]).mapInArrow(run, schema)
    block = W.partitionBy(*keys, "__block")
    reached = F.greatest(F.col("__block") * NAMES, F.max(F.col("__first") + F.col("__size")).over(block.orderBy("__first").rowsBetween(W.unboundedPreceding, -1)))
    marked = runs.withColumn("__gap", F.when(F.col("__first") > reached, reached))
    return marked.withColumn("__stop", F.coalesce(F.min("__gap").over(block), F.max(F.col("__first") + F.col("__size")).over(block))).drop("__gap", "__size")


def manifest_frames(seqs: DataFrame, names: DataFrame) -> DataFrame:
    """Every frame of every sequence with its shared file name: position below the sequence length.

    Where the tables have a ``manifest`` column, names are those of the sequence's own manifest. A sequence that is longer than
    the list of names is an error.

    Sequences and names meet by blocks of ``NAMES`` positions, and unfold to frames where they have met: what moves and is sorted is a row for each
    sequence and list, not one for each frame. A long sequence has many blocks. Every sequence has a frame 0, so the blocks may be few and
    hot: the names are repeated over a salt taken from the sequence path, for the salts that occur.
    """
    keys = ["manifest"] if "manifest" in seqs.columns and "manifest" in names.columns else []
    length = F.col("seq_length").cast("bigint")
    last = F.call_function("div", length - 1, F.lit(NAMES).cast("bigint"))
    of_seq = [c for c in seqs.columns if c not in (*keys, "frame_no")]
    others = [c for c in names.columns if c not in (*keys, "frame_no")]
    blocks = seqs.filter(length > 0).select(*keys, F.struct(*[F.col(f"`{c}`") for c in of_seq]).alias("__seq"), length.alias("__length"), F.xxhash64("path").alias("__mixed"),
                                            F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("__block"))
    met = spread_join(blocks, _name_pieces(names, keys), [*keys, "__block"], "__mixed", how="left", copies=64, many=True)

    def lost(frame):
        return F.raise_error(F.concat(F.lit("no file name for frame "), frame.cast("string"), F.lit(" of "), F.col("__seq.path")))
    start, end = F.col("__block") * NAMES, F.least((F.col("__block") + 1) * NAMES, F.col("__length"))
    stop = F.coalesce("__stop", start)
    used = F.when(stop < end, lost(stop)).otherwise(F.slice(others[0], F.lit(1), F.greatest(F.lit(0), F.least(F.size(others[0]).cast("bigint"), end - F.col("__first"))).cast("int")))
    frames = met.select("*", F.posexplode(used).alias("__k", "__item"))
    at = (F.col("__first") + F.col("__k")).cast("int")
    item = lambda c: F.col("__item") if c == others[0] else F.get(F.col(f"`{c}`"), F.col("__k"))
    named = lambda c: F.when(item(c).isNull(), lost(at)).otherwise(item(c)) if c == "frame_name" else item(c)
    return frames.select(*keys, at.alias("frame_no"), *[F.col("__seq")[c].alias(c) for c in of_seq], *[named(c).alias(c) for c in others])


# --------------------------------------------------------------------------- order, shards, batches


def shuffle_order(samples: DataFrame, id_: str, epoch, seed: int, buckets: int = SHUFFLE_BUCKETS) -> DataFrame:
    """Random order of an epoch as a global row number ``rn`` plus the row count ``total``.

    The draw is uniform, so equal slices of its range are equal buckets of rows: windows number the
    rows of a bucket, one count per bucket gives the offsets. ``id_`` breaks ties.
    """
    drawn = samples.withColumn("__draw", draws.mix(id_, epoch, seed, USE_ORDER))
    return number_within(drawn, [], ["__draw", id_], "__draw", out="rn",
                         span=draws.PRIME // buckets + 1, total="total").drop("__draw")


def file_index(rows: DataFrame) -> DataFrame:
    """``rows``, as read from files, with ``index`` 0, 1, 2 ... in the order of files and rows, and the row count ``total``.

    The position of a row in its file is known to the reader, so only the counts of the files are put in order (a row a file); no sample moves.
    """
    placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    counts = placed.groupBy("__file").agg((F.max("__row") + 1).alias("__n"))
    files = W.orderBy("__file").rowsBetween(W.unboundedPreceding, -1)      # one row a file
    ahead = counts.select("__file", F.coalesce(F.sum("__n").over(files), F.lit(0)).alias("__ahead"), F.sum("__n").over(W.partitionBy(F.lit(0))).alias("total"))
    # One row a file: no more than Spark's driver has in its own listing of the files.
    return placed.join(F.broadcast(ahead), "__file").withColumn("index", F.col("__ahead") + F.col("__row")).drop("__file", "__row", "__ahead")


def permuted(samples: DataFrame, epoch, seed: int, index: str = "index", total: str = "total") -> DataFrame:
    """Random order of an epoch as ``rn``, a permutation of 0 .. total - 1 that each row works out by itself: nothing is sorted or moved.

    The places form a square, row by row, whose last row may be short. A round turns every column by a number drawn for the column, then every row by
    one drawn for the row; columns and rows turn within their own length, so every place has one source whatever the count.
    """
    out = samples.withColumns({"__x": F.col(index).cast("long"), "__b": F.greatest(F.ceil(F.sqrt(F.col(total).cast("double"))), F.lit(1)).cast("long")})
    div = lambda a, b: F.call_function("div", a, b)
    x, b, n = F.col("__x"), F.col("__b"), F.col(total).cast("long")
    for k in range(ROUNDS):
        column, high = F.pmod(x, b), div(n - F.pmod(x, b) + b - 1, b)
        out = out.withColumn("__x", F.pmod(div(x, b) + draws.mix(column, epoch, seed, USE_ORDER + 10 + 2 * k), high) * b + column)
        row, wide = div(x, b), F.least(b, n - div(x, b) * b)
        out = out.withColumn("__x", row * b + F.pmod(F.pmod(x, b) + draws.mix(row, epoch, seed, USE_ORDER + 11 + 2 * k), wide))
    return out.withColumn("rn", x).drop("__x", "__b")


def permuted_sql(epoch: str, seed: int, source: str) -> str:
    """The same as common table expressions over ``source`` (index, total), the last one called ``permuted``."""
    steps = [f"x0 AS (SELECT *, index AS x, greatest(CAST(ceil(sqrt(CAST(total AS DOUBLE))) AS BIGINT), 1) AS b FROM {source})"]
    for k in range(ROUNDS):
        steps.append(f"y{k} AS (SELECT * REPLACE ((x // b + {draws.mix_sql('(x % b)', epoch, seed, USE_ORDER + 10 + 2 * k)}) % ((total - x % b + b - 1) // b) * b + x % b AS x) FROM x{k})")
        steps.append(f"x{k + 1} AS (SELECT * REPLACE (x // b * b + (x % b + {draws.mix_sql('(x // b)', epoch, seed, USE_ORDER + 11 + 2 * k)}) % least(b, total - x // b * b) AS x) FROM y{k})")
    return ", ".join([*steps, f"permuted AS (SELECT * EXCLUDE (x, b), x AS rn FROM x{ROUNDS})"])


def shard(ordered: DataFrame, world: int) -> DataFrame:
    """Rows dealt out to ``world`` ranks; leading rows repeat so that every rank gets the same number."""
    if world < 1:
        raise ValueError("at least one rank is needed")
    padded = (F.ceil(F.col("total") / world) * world).cast("bigint")
    places = F.sequence(F.col("rn"), padded - 1, F.col("total"))
    out = ordered.withColumn("place", F.explode(places))
    return out.withColumns({"rank": F.pmod("place", F.lit(world)).cast("int"),
                            "rank_pos": F.floor(F.col("place") / world).cast("bigint"),
                            "rank_total": (padded / world).cast("bigint")})


def batches(sharded: DataFrame, batch_size: int, world: int) -> DataFrame:
    """Batches of ``batch_size / world`` rows per rank; an incomplete last batch is dropped."""
    if batch_size % world:
        raise ValueError("the batch size must divide by the number of ranks")
    per = batch_size // world
    full = F.floor(F.col("rank_total") / per)
    out = sharded.withColumn("batch_no", F.floor(F.col("rank_pos") / per).cast("bigint"))
    return out.filter(F.col("batch_no") < full)
