"""Mixing of sources to target weights by weighted sampling without replacement, in DataFrame functions only.

Every source has a target number of words: its share of the mix by weight, at most ``most_epochs`` times its size; what a source
cannot take is shared again by weight. A source first gives its complete epochs; the rest is a weighted sample: each document draws
u in (0, 1) and gets the exponential key -ln(u) / quality weight; the smallest keys come first, until the prefix sum of sizes reaches the rest.
The draw is a function of seed, id and text, so reruns and lost executors change nothing.

Prefix sums are made on two levels: keys fall into ordered bins, bins are summed before anything is shuffled, and only the bin
that holds the end of the selection needs an order inside. So a source that holds most rows is spread over its bins.

Defined results: null texts have size 0; sources that are null are one source, last in order; rows without an id draw by their text; equal
rows share their key and are taken one after the other; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rdspark.llm.tables import WORD, columns, fresh, written

#: Weights by position of the source, repeated.
WEIGHTS = (3, 1, 2)
#: Rows that one bin of one source has on average, at most.
BIN_ROWS = 20_000


def word_count(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def letter_weight(text="text"):
    """Quality weight in 0.05 .. 1: the share of ASCII letters among the characters."""
    letters = F.length(F.regexp_replace(text, r"[^A-Za-z]+", ""))
    return F.when(F.length(text) > 0, F.greatest(F.lit(0.05), letters / F.length(text))).otherwise(F.lit(0.05))


def draw(seed: str, *cols):
    """u in (0, 1) from the md5 of seed and values."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def row_key():
    return F.xxhash64("doc_id", "source", F.col("text").isNull(), "text").alias("row_key")


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """(doc_id, source, row_key, size, key) per row."""
    return docs.select("doc_id", "source", row_key(), word_count().alias("size"),
                       (-F.log(draw(seed, "doc_id", "text")) / letter_weight()).alias("key"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most_epochs: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size). There are few sources: the windows below see one row for each.

    Water filling: sources ordered by cap / weight; the first k are at their cap, where k is the least for which the next source's
    share of what is left stays within its cap.
    """
    n, order = len(weights), Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int"))
    every, capped = Window.partitionBy(), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    cap = (F.col("source_size") * most_epochs).cast("double")
    s = (sizes.withColumn("w", w).withColumn("ratio", cap / F.col("w"))
         .withColumn("total", F.sum("source_size").over(every) * F.lit(share)).withColumn("weight", F.sum("w").over(every))
         .withColumn("left", F.col("total") - F.coalesce(F.sum(cap).over(capped.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("open", F.col("weight") - F.coalesce(F.sum("w").over(capped.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("level", F.col("left") / F.col("open"))
         .withColumn("k", F.row_number().over(capped))
         .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("k", "level"))).over(every)["level"]))
    return s.select("source", "source_size", F.least(cap, F.coalesce(F.col("level") * F.col("w"), cap)).alias("target"))


def taken(rows: DataFrame, goals: DataFrame, bins: int) -> DataFrame:
    """Words taken of each row of (doc_id, source, size, key), given the targets of the sources."""
    spread = F.floor((1 - F.exp(-F.col("key"))) * bins).cast("int")
    rows = rows.withColumn("bin", spread)
    sums = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    sums = (sums.withColumn("bin_start", F.coalesce(F.sum("bin_size").over(before), F.lit(0)))
            .join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    # Read by both parts below: a row for each source and bin, stored so that neither plan holds the targets.
    one = written(sums.select(F.col("source").alias("s"), F.col("bin").alias("b"), "bin_size", "bin_start", "source_size", "target", "epochs", "rest"), "mix-bins")
    joined = rows.join(one, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    inside = (F.col("bin_start") < F.col("rest")) & (F.col("bin_start") + F.col("bin_size") > F.col("rest"))
    # Only the bin with the end of the selection is ordered: one bin a source.
    edge = Window.partitionBy("source", "bin").orderBy("key", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    fraction = F.greatest(F.lit(0.0), F.least(F.col("size").cast("double"), F.col("rest") - F.col("start")))
    whole = F.when(F.col("bin_start") < F.col("rest"), F.col("size")).otherwise(0)
    out = joined.where(~inside).withColumn("part", whole.cast("long")).unionByName(
        joined.where(inside).withColumn("start", F.col("bin_start") + F.coalesce(F.sum("size").over(edge), F.lit(0)))
        .withColumn("part", F.floor(fraction).cast("long")).drop("start"))
    return out.select("doc_id", "source", "row_key", "size", "source_size", "target",
                      (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def mix_sources(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, share: float = 1.5, most_epochs: int = 2) -> DataFrame:
    """(doc_id, source, row_key, size, source_size, target, taken), one row per row of ``docs`` (doc_id, text, source).

    ``taken`` counts words: complete epochs plus the selected part; at the end of the selection one document is taken in part.
    """
    rows = written(sized(docs, seed), "mix-rows")      # the texts are read once
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return taken(rows, targets(sizes, weights, share, most_epochs), max(16, -(-rows.count() // BIN_ROWS)))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself with the columns of ``docs``: a row for each time a document is taken, whole ones only.

    The document at the end of a selection comes once more if half of it or more was taken. Equal rows come equally often. Rows without words
    come as often as their source is taken whole, and once if no row of the source has words.
    """
    key, times = fresh(docs, "_mix_key"), fresh(docs, "_mix_times")
    plan = mix_sources(docs, **options).groupBy(F.col("row_key").alias(key)).agg(
        F.round(F.avg(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                      .otherwise(1))).cast("int").alias(times)).where(F.col(times) > 0)
    keyed = docs.select(*columns(docs), row_key().alias(key))
    return keyed.join(plan, key).withColumn(fresh(docs, "_mix_copy"), F.explode(F.sequence(F.lit(1), F.col(times)))).select(*columns(docs))
