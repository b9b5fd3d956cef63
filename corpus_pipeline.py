"""A training-corpus pipeline: toxic documents go, one of each group of near duplicates stays, benchmark passages go, sources are mixed, ids are written.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rdspark.llm import cnn, decontaminate, jaccard, mixing, tokens
from rdspark.llm.queries import tokenizer_path
from rdspark.llm.tables import fresh, table, written
from rdspark.shipping import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is below 0.5. The classifier learns from the labelled rows among ``docs``; without labels of both classes
    among them there is nothing to tell rows apart by, and all rows stay."""
    model = cnn.fit(docs, table(spark, sf_dir, "labels"), "toxic")
    if model.constant is not None:
        return docs
    name = fresh(docs, "score")
    return cnn.score(docs, model, *docs.columns, out=name).where(F.col(name) < 0.5).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.kept_documents(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row, read back from the files."""
    return tokens.encoded_documents(docs, tokenizer_path())


def _shipped(stage):
    """The stage with the package sent to the Python workers first."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


STAGES = [(name, _shipped(stage)) for name, stage in [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark), ("mixing", mix), ("token_ids", write_ids)]]
#: The first stage is a trained network, so SQL cannot give the rows; the stages are tested one by one against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
