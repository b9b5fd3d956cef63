"""Secrets in texts: patterns propose candidates, a random forest removes false ones. DataFrame functions and Spark ML only.

Candidates are long runs of token characters, and whatever is assigned to a secret's name ('password: "..."', 'API_KEY=...'). The value alone is
the candidate; its name counts as the text before it.

Features of a candidate: length, shares of characters, changes between kinds of characters, coverage by common word parts, the words around it and
the path (or source) it stands in. The forest is trained on labelled findings, a bounded sample of each class (``SAMPLE``).

Defined results: null and empty texts have no findings; a null path has no path features; repeated rows are repeated; with labels of one class or
none, the score is the share of label 1 (0.5 without labels); an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from rdspark.llm.pii import spans_of
from rdspark.llm.tables import written

#: Formats of issuers.
ISSUER = r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[0-9a-zA-Z]{20,}|xox[abp]-[0-9A-Za-z-]{10,})"
#: A run of 16 or more token characters that holds a digit or begins as an issuer's. An inner '=' parts a name from its value; '=' at the end is padding.
CANDIDATE = (r"(?<![A-Za-z0-9_+/-])(?=AKIA|gh[pousr]_|sk_live_|xox[abp]-|[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+"
             r"(?:={1,2}+(?![A-Za-z0-9_+/=-]))?+")
#: Words that say what follows is a secret; words that say it is an example. Fixed values.
NAMES = r"(?:token|secret|passw(?:or)?d|pwd|api.?key|access.?key|private.?key|auth|credential|bearer)"
KEYWORD = rf"(?i){NAMES}[\"']?\s{{0,3}}[=:]?\s{{0,3}}[\"']?$"
#: A secret's name with its separator, and any value behind it: what stands in quotes, or else up to a space, a closing quote, the next
#: assignment ('&user=') or the punctuation that ends a sentence or a list.
LEAD = rf"(?i:(?:{NAMES}[\"']?\s{{0,3}}[=:]\s{{0,3}}|bearer\s{{1,3}})(?:(?:bearer|basic)\s{{1,3}})?)"
NAMED = (LEAD + r"(?:\"(?:[^\"\\\r\n]|\\.)++\"|'(?:[^'\\\r\n]|\\.)++'|"
         r"[\"']?(?:(?![;,&][A-Za-z_][A-Za-z0-9_.-]{0,40}[=:]|[\"'`](?![A-Za-z0-9])|[,;.)\]}>]{1,8}+(?:[\"'`\s]|$))\S)++)")
EXAMPLE = r"(?i)example|sample|dummy|changeme|placeholder|test|xxxx|0000|1234567"
PARTS = r"the|and|ing|tion|ent|ion|ver|ter|ich|sch|eit|ung|ment|eur|que|ado|con|des|ble|est|for|tha|ere|her|ate"
NEAR, SAMPLE, TREES, DEPTH = 32, 5000, 20, 6


def _share(value: Column, pattern: str) -> Column:
    return (F.length(value) - F.length(F.regexp_replace(value, pattern, ""))) / F.length(value)


def _assigned(text: Column) -> Column:
    """Array of (start, end, value) of the values behind a secret's name, without their quotes."""
    def value(s):
        rest = F.substring(s["value"], F.length(F.regexp_extract(s["value"], f"^{LEAD}", 0)) + 1, F.length(s["value"]))
        quote = F.substring(rest, 1, 1)
        opened, closed = quote.isin('"', "'"), quote.isin('"', "'") & (F.length(rest) > 2) & rest.endswith(quote)
        start = s["end"] - F.length(rest) + opened.cast("int")
        end = s["end"] - closed.cast("int")
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.substring(text, start + 1, end - start).alias("value"))
    return F.transform(spans_of(text, NAMED, text.rlike(LEAD)), value)


def _proposed(text: Column) -> Column:
    """Array of (start, end, value) by position: runs and assigned values. A run that is the beginning of an assigned value is not one of its own."""
    every = F.array_sort(F.concat(spans_of(text, CANDIDATE, text.rlike(CANDIDATE)), _assigned(text)))
    # Bound to a name, so that it is made once a text: of spans with one start the last is the longest.
    return F.transform(F.array(every), lambda a: F.filter(a, lambda s, k: (k == F.size(a) - 1) | (F.get(a, k + 1)["start"] != s["start"])))[0]


def findings(docs: DataFrame, path: str = "source") -> DataFrame:
    """(doc_id, start, end, value, features): one row per candidate."""
    text, place = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    found = docs.select("doc_id", place.alias("_path"), text.alias("_text"), _proposed(text).alias("_spans")).where(F.size("_spans") > 0)
    near = F.transform("_spans", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
        F.substring("_text", F.greatest(s["start"] - NEAR + 1, F.lit(1)), F.least(F.lit(NEAR), s["start"])).alias("before"),
        F.substring("_text", s["end"] + 1, F.lit(NEAR)).alias("after")))
    one = found.select("doc_id", "_path", F.explode(near).alias("s")).select("doc_id", "_path", "s.*")
    v, low = F.col("value"), F.lower("value")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[A-Z]+", "A"), "[a-z]+", "a"), "[0-9]+", "1")
    sounds = F.regexp_replace(F.regexp_replace(low, "[aeiou]+", "1"), "[a-z]+", "a")
    flag = lambda c: c.cast("double")
    features = [F.length(v).cast("double"), F.size(F.array_distinct(F.split(v, ""))) / F.length(v), _share(v, "[0-9]"), _share(v, "[A-Z]"), _share(v, "[a-z]"),
                _share(v, "[A-Za-z0-9]"), F.length(kinds) / F.length(v), F.length(sounds) / F.length(v), _share(low, PARTS), flag(v.rlike("^[0-9a-fA-F]+$")),
                flag(v.rlike(r"(.)\1\1\1")), flag(v.rlike(EXAMPLE)), flag(F.col("before").rlike(KEYWORD)), flag(F.col("before").rlike(r"[=:]\s{0,3}[\"']?$")),
                flag(F.col("before").rlike("[\"']$")), flag(F.col("after").rlike("^[\"']")), flag(F.col("before").rlike(EXAMPLE)),
                flag(F.col("_path").rlike("(?i)test|example|doc|sample|readme")), flag(F.col("_path").rlike(r"(?i)env|conf|secret|ya?ml|\bkey"))]
    return one.select("doc_id", "start", "end", "value", "before", "after", F.array(*features).alias("features"))


def train(labelled: DataFrame, sample: int = SAMPLE, seed: int = 11):
    """A forest from (features, value, label), or the share of label 1 where there is one class or none."""
    good = labelled.where(F.col("label").isin(0, 1)).select("features", F.col("label").cast("double").alias("label"),
                                                           F.xxhash64("value", "features").alias("_at")).dropDuplicates(["_at", "label"])      # equal findings count once
    picked = [good.where(F.col("label") == k).orderBy("_at").limit(sample) for k in (0, 1)]
    few = written(picked[0].unionByName(picked[1]).select("features", "label").coalesce(1), "labelled")      # 2 x sample rows
    rows = few.select(array_to_vector("features").alias("features"), "label")
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(n) < 2:
        return 0.5 if not n else float(next(iter(n)))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, probabilityCol="_probability", rawPredictionCol="_raw",
                                  predictionCol="_predicted").fit(rows)


def scored(found: DataFrame, forest) -> DataFrame:
    """``found`` with ``score``, the forest's probability that a finding is a secret."""
    if isinstance(forest, float):
        return found.withColumn("score", F.lit(forest))
    vector = found.withColumn("_values", F.col("features")).withColumn("features", array_to_vector("features"))
    return forest.transform(vector).withColumn("score", vector_to_array("_probability")[1]).withColumn("features", F.col("_values")).drop(
        "_values", "_probability", "_raw", "_predicted")


def labelled_by_rule(found: DataFrame) -> DataFrame:
    """Labels for findings where no reviewer gave any: 1 for issuer formats and for mixed or quoted values assigned to a secret's name; 0 for
    examples, for values without any such name nearby, for plain words, names and calls, and for long numbers."""
    v = F.col("value")
    quoted = F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']") & (F.length(v) >= 8)
    mixed = v.rlike("[0-9]") | v.rlike(r"[^A-Za-z0-9_.:/()\[\]{}<>$,;'\"-]") | v.rlike("^[A-Za-z]{16,}$")
    named = F.col("before").rlike(KEYWORD) & v.rlike(r"[^\W\d_]") & (quoted | mixed)
    return found.withColumn("label", F.when(v.rlike(EXAMPLE), 0).when(v.rlike(f"^{ISSUER}") | named, 1).otherwise(0))
