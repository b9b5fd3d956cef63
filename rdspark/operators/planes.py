"""Conversions of whole frames in the ``planes`` layout, and patches cut from them.

A frame row carries its planes as bytes: y, u, v (or r, g, b in the same columns for layout "rgb").
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from rdspark.functions import pixels
from rdspark.functions.ladders import padding

LAYOUTS = ("420", "444", "rgb")
FRAME_TYPE = "p0 binary, p1 binary, p2 binary"


def _load(p, w, h, depth, layout):
    half = layout == "420"
    sizes = [(h, w)] + [(h // 2, w // 2) if half else (h, w)] * 2
    return [pixels.to_unit(pixels.unpack(b, *s, depth), depth) for b, s in zip(p, sizes)]


def convert(planes: list[np.ndarray], src: str, dst: str, order: int) -> list[np.ndarray]:
    """Three planes in [0, 1] from one layout to another."""
    if src == dst:
        return planes
    if src == "420":
        planes = [planes[0], pixels.double(planes[1], order), pixels.double(planes[2], order)]
    if src == "rgb":
        # Samples in [0, 1] give luma and chroma in [0, 1], so clamping before or after the mean is the same.
        planes = list(pixels.planes_to_ycbcr(np.stack(planes)))
    if dst == "rgb":
        return list(pixels.planes_to_rgb(np.stack(planes)))
    if dst == "420":
        planes = [planes[0], pixels.halve(planes[1]), pixels.halve(planes[2])]
    return planes


def convert_frames(frames: DataFrame, src_layout: str, dst_layout: str, order: int | None = None,
                   out_depth: int | None = None) -> DataFrame:
    """Frames in another layout. Columns p0, p1, p2 hold the planes, ``layout`` the new name.

    Chroma grows linearly (order 1) on the way to RGB and by repetition (order 0) to 4:4:4 unless
    ``order`` says otherwise.
    """
    if src_layout not in LAYOUTS or dst_layout not in LAYOUTS:
        raise ValueError(f"layouts are {LAYOUTS}")
    if order is None:
        order = 1 if dst_layout == "rgb" else 0

    @pandas_udf(FRAME_TYPE)
    def run(p0: pd.Series, p1: pd.Series, p2: pd.Series, width: pd.Series, height: pd.Series,
            depth: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b, c, w, h, d in zip(p0, p1, p2, width, height, depth):
            planes = convert(_load((a, b, c), w, h, d, src_layout), src_layout, dst_layout, order)
            rows.append([pixels.from_unit(x, out_depth or int(d)).tobytes() for x in planes])
        return pd.DataFrame(rows, columns=["p0", "p1", "p2"])

    out = frames.withColumn("__c", run("p0", "p1", "p2", "width", "height", "bit_depth"))
    depth = F.lit(out_depth) if out_depth else F.col("bit_depth")
    return (out.withColumns({p: F.col(f"__c.{p}") for p in ("p0", "p1", "p2")})
            .withColumns({"layout": F.lit(dst_layout), "bit_depth": depth}).drop("__c"))


def plane_rows(frames: DataFrame, layout: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """One row per plane in the canonical ``planes`` schema. The layout is that of each row unless one is given; ``carry`` names columns that stay."""
    kind = F.lit(layout) if layout else F.col("layout")
    half = lambda c: F.when(kind == "420", (F.col(c) / 2).cast("int")).otherwise(F.col(c))
    entry = lambda i: F.struct(
        F.when(kind == "rgb", "rgb"[i]).otherwise("yuv"[i]).alias("plane"), (F.col("width") if i == 0 else half("width")).alias("width"),
        (F.col("height") if i == 0 else half("height")).alias("height"),
        F.col("bit_depth").alias("bit_depth"), F.col(f"p{i}").alias("data"))
    return frames.select("sequence", "frame_idx", *(carry or []), F.inline(F.array(entry(0), entry(1), entry(2))))


def sample_rows(planes: DataFrame, keys: list[str], bit_depth: int = 8) -> DataFrame:
    """Plane bytes as pixel rows (x, y, value)."""

    @pandas_udf("array<int>")
    def values(data: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(d, pixels.sample_type(bit_depth)).astype(np.int32) for d in data])

    spread = planes.select(*keys, "width", F.posexplode(values("data")).alias("__i", "value"))
    return spread.select(*keys, (F.col("__i") % F.col("width")).alias("x"),
                         F.call_function("div", F.col("__i"), F.col("width")).cast("int").alias("y"), "value")


def plane_from_samples(samples: Column) -> Column:
    """array<int> of 8-bit samples as bytes, inside the JVM."""
    return F.unhex(F.array_join(F.transform(samples, lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")), ""))


def pad_planes(planes_: DataFrame, multiple: int = 16, mode: str = "replicate", centred: bool = False) -> DataFrame:
    """Plane rows grown to a multiple of a size: right and below by default, or split evenly."""

    @pandas_udf("binary")
    def run(data: pd.Series, width: pd.Series, height: pd.Series, depth: pd.Series, left: pd.Series, right: pd.Series,
            top: pd.Series, bottom: pd.Series) -> pd.Series:
        return pd.Series([pixels.pad_crop(pixels.unpack(d, h, w, b), l, r, t, m, mode).tobytes() for d, w, h, b, l, r, t, m
                          in zip(data, width, height, depth, left, right, top, bottom)])

    grown = planes_.withColumn("__p", padding("width", "height", multiple, centred))
    side = lambda n: F.col(f"__p.{n}")
    return grown.withColumn("data", run("data", "width", "height", "bit_depth", side("left"), side("right"), side("top"), side("bottom"))
                            ).withColumns({"width": side("width"), "height": side("height")}).drop("__p")


def crop_planes(planes_: DataFrame, width: int, height: int, left: int = 0, top: int = 0) -> DataFrame:
    """Plane rows cut back to a size."""

    @pandas_udf("binary")
    def run(data: pd.Series, w: pd.Series, h: pd.Series, depth: pd.Series) -> pd.Series:
        return pd.Series([np.ascontiguousarray(pixels.unpack(d, b, a, k)[top:top + height, left:left + width]).tobytes()
                          for d, a, b, k in zip(data, w, h, depth)])

    return planes_.withColumn("data", run("data", "width", "height", "bit_depth")).withColumns(
        {"width": F.lit(width), "height": F.lit(height)})


def patch_values(patch: str = "patch") -> Column:
    """A patch as an array of its float samples, channel by channel."""

    @pandas_udf("array<float>")
    def run(p: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(v, "<f4") for v in p])

    return run(patch)


def extract_patches(clips: DataFrame, frames: DataFrame, patch_w: int, patch_h: int) -> DataFrame:
    """Training patches of each clip frame: pad, flip, crop, to YCbCr, centred on 0.

    ``clips`` carries sample_id, sequence, frame_indexes, crop and padding; ``frames`` RGB planes.
    The clip frames are unfolded first and meet their picture by (sequence, frame_idx), which spreads a
    long sequence over many tasks. The patch is float32 bytes of shape (3, patch_h, patch_w).
    """
    wanted = clips.select("sample_id", "sequence", "crop_x", "crop_y", "flip", "pad_left", "pad_right", "pad_top",
                          "pad_bottom", F.posexplode("frame_indexes").alias("clip_pos", "frame_idx"))
    pictures = frames.select("sequence", "frame_idx", "width", "height", "bit_depth", "p0", "p1", "p2")

    @pandas_udf("binary")
    def cut(p0: pd.Series, p1: pd.Series, p2: pd.Series, width: pd.Series, height: pd.Series, depth: pd.Series,
            x: pd.Series, y: pd.Series, flip: pd.Series, left: pd.Series, right: pd.Series, top: pd.Series,
            bottom: pd.Series) -> pd.Series:
        out = []
        for a, b, c, w, h, d, cx, cy, fl, pl, pr, pt, pb in zip(p0, p1, p2, width, height, depth, x, y, flip, left,
                                                               right, top, bottom):
            rgb = np.stack([pixels.unpack(v, h, w, d) for v in (a, b, c)])
            rgb = rgb[:, :, ::-1] if fl else rgb
            rgb = np.pad(rgb, ((0, 0), (pt, pb), (pl, pr)))[:, cy:cy + patch_h, cx:cx + patch_w]
            patch = pixels.planes_to_ycbcr(pixels.to_unit(rgb, d)) - 0.5
            out.append(np.ascontiguousarray(patch, dtype="<f4").tobytes())
        return pd.Series(out)

    met = wanted.join(pictures, ["sequence", "frame_idx"], "left")
    lost = F.raise_error(F.concat_ws(" ", F.lit("no picture for frame"), F.col("frame_idx").cast("string"), F.lit("of"), F.col("sequence")))
    met = met.withColumn("p0", F.when(F.col("p0").isNull(), lost).otherwise(F.col("p0")))
    patch = cut("p0", "p1", "p2", "width", "height", "bit_depth", "crop_x", "crop_y", "flip", "pad_left", "pad_right",
                "pad_top", "pad_bottom")
    return met.select("sample_id", "clip_pos", "sequence", "frame_idx", patch.alias("patch"))
