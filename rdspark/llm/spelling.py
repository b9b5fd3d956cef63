"""Spelling variants of a corpus' words by permuterm rotations: neighbours one edit away, the form a rare word stands for, and its root.

Each word gets a terminator and is rotated to every place: ``x`` + ``y`` becomes ``y$x``. A rotation without its last character, ``y$x'`` of the word
``x' c y``, is a prefix that skips the edited character: words that differ by a replaced character share it with another character
behind, and the word without that character, ``x' y``, is the rotation that equals the prefix. So a group of equal prefixes holds the word
itself (no character skipped) and at most one word for each letter of the alphabet: its size is bounded by the alphabet, whatever the corpus.
Rotations are dealt out by prefix and sorted; a scan of each group gives every member its number of neighbours and its most frequent one, not the pairs.
In a run of equal letters only one removal counts, as the others give the same word again.

Defined results: null and empty texts have no words; rows without an id count under an empty id; repeated rows count as often as they stand; words of equal
count are ordered by code points; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rdspark.llm.tables import written

#: What a word consists of, and the letters that are lowered.
LETTERS, UPPER, LOWER = r"([A-Za-zÀ-ÿ]+)", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, FEWEST, RATIO = 6, 5, 5
TERMINATOR = "$"


def word_counts(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, damage: int | None = None) -> DataFrame:
    """(word, n): the words of at least ``shortest`` letters and ``fewest`` occurrences in ``docs`` (doc_id, text).

    With ``damage`` a word whose checksum with its document's id is divisible by it loses one letter: misspellings to test with.
    """
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    run = F.col("run")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(LETTERS), F.lit(1))).alias("run"))
    runs = runs.where(F.length(run) >= shortest)
    if damage:
        runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
        at = (F.col("h") % F.length(run)).cast("int")
        runs = runs.withColumn("run", F.when(F.col("h") % damage == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run))
    counts = runs.groupBy(run.alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") >= fewest) & (F.length("word") >= shortest))


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, skipped, n): all rotations of the words, whole (nothing skipped) and without their last character (the skipped one)."""
    w, size = F.col("word"), F.length("word")

    def prefix(left: Column, right: Column) -> Column:
        """What stands behind the first ``right`` letters, the terminator, the first ``left`` letters."""
        return F.concat(F.substring(w, right + 1, size), F.lit(TERMINATOR), F.substring(w, F.lit(1), left))
    whole = F.transform(F.sequence(F.lit(0), size), lambda k: F.struct(prefix(k, k).alias("prefix"), F.lit("").alias("skipped")))
    short = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.struct(prefix(k, k + 1).alias("prefix"), F.substring(w, k + 1, F.lit(1)).alias("skipped")))
    return words.select("n", F.explode(F.concat(whole, short)).alias("r")).select("r.prefix", "r.skipped", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n) of the words (word, n) that have neighbours: how many, and the most frequent one."""
    word = F.concat(F.substring_index("prefix", TERMINATOR, -1), "skipped", F.substring_index("prefix", TERMINATOR, 1))
    dealt = rotations(words).repartition("prefix").select("*", word.alias("word"))
    group = Window.partitionBy("prefix").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one, before = F.struct("skipped", "n", "word"), F.substring(F.col("prefix"), -1, 1)      # the letter before the skipped one
    is_whole, is_run = F.col("skipped") == "", F.col("skipped") == before
    scanned = dealt.select("word", "skipped", before.alias("before"), F.count(F.lit(1)).over(group).alias("size"),
                           F.max(is_whole).over(group).alias("has_whole"), F.max(is_run).over(group).alias("has_run"),
                           *[F.nth_value(one, k).over(group).alias(f"o{k}") for k in (1, 2, 3)]).where("size > 1")
    # The word itself and the one that repeats the letter before are neighbours too, by a removal that counts elsewhere.
    apart = F.when(F.col("skipped") == "", F.col("has_run")).when(F.col("skipped") == F.col("before"), F.col("has_whole")).otherwise(False)
    def near(k: int) -> Column:
        o = F.col(f"o{k}")["skipped"]
        meets = ((o == "") & (F.col("skipped") == F.col("before"))) | ((F.col("skipped") == "") & (o == F.col("before")))
        return F.when((o != F.col("skipped")) & ~meets, F.struct((-F.col(f"o{k}")["n"]).alias("n"), F.col(f"o{k}")["word"].alias("word")))
    found = scanned.select("word", (F.col("size") - 1 - apart.cast("int")).alias("n_near"), F.coalesce(near(1), near(2), near(3)).alias("best")).where("n_near > 0")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")).select(
        "word", "n_near", F.col("best.word").alias("near"), (-F.col("best.n")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words (word, form): forms followed to the last, each round twice as far. A form is several times as frequent
    as its word, so chains are short and never close."""
    links = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("far"))
        if links.join(onward, "root", "left_semi").isEmpty():
            return links
        links = written(links.join(onward, "root", "left").select("word", F.coalesce("far", "root").alias("root")), "forms")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words (word, n), which are distinct. A form occurs ``ratio`` times as often as its word."""
    if ratio < 2:
        raise ValueError("ratio is 2 at least")
    words = written(words.select("word", "n"), "words")
    near = written(words.join(neighbours(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        *[F.when(F.col("near_n") >= ratio * F.col("n"), F.col(c)).alias(k) for c, k in (("near", "form"), ("near_n", "form_n"))]), "near")
    ends = roots(near.where("form is not null"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
