"""Column functions on measurements. All of them stay inside JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the quality measure: the score of an unusable error, the error below which two
# planes count as equal, the score of equal planes and the ceiling of every score.
PSNR_INVALID = -999.9
PSNR_MSE_FLOOR = 1e-10
PSNR_IDENTICAL = 999.9
PSNR_CEILING = 99.9

# Fixed values of the frame hierarchy: position in a group -> weight class, and the class weights.
HIERARCHY_OF_8 = [0, 1, 0, 2, 0, 2, 0, 2]
HIERARCHY_OF_4 = [0, 1, 0, 2]
HIERARCHY_WEIGHTS = [0.52, 1.33, 0.83]

# Fixed weights of the eight frames of one chunk.
CHUNK_WEIGHTS = [0.16, 0.4, 0.16, 0.4, 0.16, 0.4, 0.16, 1.5]

# Fixed spellings of a true / false option.
TRUE_WORDS = ["yes", "y", "true", "t", "1"]
FALSE_WORDS = ["no", "n", "false", "f", "0"]

ASSUMED_FPS = 30


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bits_per_pixel(bits, pixels) -> Column:
    """Bits over pixels; 0 when there are no pixels."""
    b, p = col(bits).cast("double"), col(pixels).cast("double")
    return F.when(p > 0, b / p).otherwise(F.lit(0.0))


def kilobits_per_second(total_bytes, frames) -> Column:
    """Whole kbit/s at the fixed 30 frames per second, truncated."""
    seconds = col(frames).cast("double") / F.lit(float(ASSUMED_FPS))
    return F.when(col(frames) > 0,
                  F.floor(col(total_bytes).cast("double") * 8 / seconds / 1000)).cast("bigint")


def weighted_plane_mean(y, u, v) -> Column:
    """(6 Y + U + V) / 8, for PSNR and MS-SSIM alike."""
    return (F.lit(6.0) * col(y) + col(u) + col(v)) / 8.0


def psnr_from_mse(mse, peak: float | Column = 255.0) -> Column:
    m = col(mse).cast("double")
    bad = F.isnan(m) | (m == float("inf")) | (m == float("-inf"))
    score = F.when(m > PSNR_MSE_FLOOR, 10.0 * F.log10((peak * peak if isinstance(peak, Column) else F.lit(peak * peak)) / m))
    return F.when(m.isNull(), F.lit(None)).when(bad, F.lit(PSNR_INVALID)).otherwise(
        F.least(F.coalesce(score, F.lit(PSNR_IDENTICAL)), F.lit(PSNR_CEILING)))


def psnr_unclamped(mse) -> Column:
    """Score of samples in [0, 1] without a ceiling; identical planes give +Infinity."""
    m = col(mse).cast("double")
    return F.when(m == 0, F.lit(float("inf"))).when(m > 0, -10.0 * F.log10(m))


def parse_bool(text, strict: bool = False) -> Column:
    """True for the known true words. ``strict`` raises for a word that is in neither list."""
    word = F.lower(col(text).cast("string"))
    known = word.isin(TRUE_WORDS)
    if not strict:
        return F.coalesce(known, F.lit(False))
    complaint = F.raise_error(F.concat(F.lit("Boolean value expected: "), F.coalesce(word, F.lit("null"))))
    return (F.when(known, F.lit(True)).when(word.isin(FALSE_WORDS), F.lit(False))
            .otherwise(complaint.cast("boolean")))


def round_exact(value, digits: int) -> Column:
    """Rounded at a number of decimals by the exact binary value, ties to even.

    Built-in rounding looks at the shortest decimal text, so 28.47625 (a little above that text) would
    count as a tie. Here the product with the power of ten is split into its rounded part and its exact
    error, and the sum of both decides. Values too large for that have no decimals to round.
    """
    x = col(value).cast("double")
    scale = float(10 ** int(digits))
    p = x * scale
    split = lambda c: c * 134217729.0 - (c * 134217729.0 - c)  # noqa: E731  upper half of the mantissa
    s_hi = scale * 134217729.0 - (scale * 134217729.0 - scale)
    x_hi = split(x)
    x_lo, s_lo = x - x_hi, scale - s_hi
    error = ((x_hi * s_hi - p) + x_hi * s_lo + x_lo * s_hi) + x_lo * s_lo
    low = F.floor(p).cast("double")
    over = (p - low - 0.5) + error
    up = (over > 0) | ((over == 0) & (F.pmod(low, F.lit(2.0)) == 1))
    n = F.when(up, low + 1).otherwise(low)
    out = F.when((n == 0) & (x < 0), F.lit(-0.0)).otherwise(n / scale)
    return F.when(F.abs(p) < 2.0 ** 51, out).otherwise(x)


def fixed_digits(value, digits: int) -> Column:
    """Text with a fixed number of decimals (6 in logs, 1 in reports)."""
    text = F.format_string(f"%.{int(digits)}f", round_exact(value, digits))
    return F.when(col(value).isNotNull(), text)


def rd_cost(bpp, mse, lam) -> Column:
    return col(lam).cast("double") * col(mse) + col(bpp)


def combined_mse(mse_y, mse_u, mse_v, mse_rgb) -> Column:
    """Geometric-style mix of the plane errors (weights 10:1:1, floor 1e-6) plus a share of RGB error."""
    def safe_log(c):
        return F.log(F.greatest(col(c).cast("double"), F.lit(1e-6)))
    planes = F.exp(F.lit(0.0833) * (10.0 * safe_log(mse_y) + safe_log(mse_u) + safe_log(mse_v))) * 3.0
    return planes * 0.8 + col(mse_rgb) * 0.2


def hierarchy_class(frame_idx, group: int = 8) -> Column:
    steps = {8: HIERARCHY_OF_8, 4: HIERARCHY_OF_4}[group]
    return F.element_at(F.array(*[F.lit(s) for s in steps]), (F.pmod(col(frame_idx), F.lit(group)) + 1).cast("int"))


def hierarchy_weight(frame_idx, group: int = 8) -> Column:
    weights = F.array(*[F.lit(w) for w in HIERARCHY_WEIGHTS])
    return F.element_at(weights, (hierarchy_class(frame_idx, group) + 1).cast("int"))


def chunk_weight(position) -> Column:
    weights = F.array(*[F.lit(w) for w in CHUNK_WEIGHTS])
    return F.element_at(weights, (F.pmod(col(position), F.lit(8)) + 1).cast("int"))


def information_bits(probability) -> Column:
    """-log2(p) with p not below 1e-6 and the result not below 0."""
    p = F.greatest(col(probability).cast("double"), F.lit(1e-6))
    return F.greatest(-F.log2(p), F.lit(0.0))
