"""Building blocks for groups that may own a third of all rows: numbers of evenly spread positions, salted joins, unfolding.

Numbers and carried values in any order are in ``ordered``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rdspark.functions.results import col

SPAN = 65536        # positions per bucket
SALT_COPIES = 16    # copies of a small side in a spread join


def bucket_of(position, span: int = SPAN) -> Column:
    return F.call_function("div", col(position).cast("bigint"), F.lit(span).cast("bigint"))


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence, position, out: str = "row_no",
                  span: int = SPAN, total: str | None = None) -> DataFrame:
    """Exact 0-based row number per group, for positions that are spread evenly (random draws).

    ``order`` must begin with (or be monotone in) ``position``, an integer. A bucket is a fixed span of it. Rows that share a bucket
    are numbered by a window, buckets are offset by the running count of the buckets before them.
    """
    b = "__bucket"
    keys = list(keys)
    spread = df.withColumn(b, bucket_of(position, span))
    local = W.partitionBy(*keys, b).orderBy(*[o if isinstance(o, Column) else F.col(o) for o in order])
    numbered = spread.withColumn(out, F.row_number().over(local).cast("bigint") - 1)

    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = whole.orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    sizes = spread.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    columns = [*keys, b, "__offset"]
    if total:
        sizes = sizes.withColumn(total, F.sum("__n").over(whole))
        columns.append(total)
    joined = numbered.join(sizes.select(*columns), [*keys, b], "left")
    return joined.withColumn(out, F.col(out) + F.coalesce(F.col("__offset"), F.lit(0))).drop(b, "__offset")


def spread_join(big: DataFrame, facts: DataFrame, keys: Sequence[str], salt, how: str = "left",
                copies: int = SALT_COPIES, many: bool = False) -> DataFrame:
    """Join a few facts per key onto a table where one key may own a third of the rows.

    ``salt`` is a well-mixed integer of the big side; every fact is repeated once per salt value, so the
    rows of a hot key meet it in ``copies`` different tasks. Where facts may be as ``many`` as the rows, a fact is
    repeated only for the salt values its key has, which are never more than the rows of the key.
    """
    left = big.withColumn("__salt", F.pmod(col(salt).cast("bigint"), F.lit(copies)).cast("int"))
    if many:
        right = facts.join(left.select(*keys, "__salt").distinct(), list(keys))
    else:
        right = facts.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(copies)])))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def unfold(df: DataFrame, count, out: str, block: int = SPAN) -> DataFrame:
    """One row per number below ``count``, which may be huge for a few rows.

    Rows unfold to blocks first; the few block rows are dealt out over the cluster before each block
    unfolds to its numbers, so a third of the output may come from one row without staying in one task.
    """
    n = col(count).cast("bigint")
    blocks = df.filter(n > 0).withColumn("__first", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(block).cast("bigint"))))
    plain = [f.name for f in blocks.schema.fields if f.dataType.simpleString().split("<")[0] not in ("map", "struct", "array", "variant")]
    dealt = blocks.repartition(df.sparkSession.sparkContext.defaultParallelism, *plain)
    stop = F.least(F.col("__first") + block, n) - 1
    spread = dealt.withColumn("__n", F.explode(F.sequence(F.col("__first"), stop)))
    return spread.withColumn(out, F.col("__n").cast("int")).drop("__first", "__n")
