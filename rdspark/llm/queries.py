"""The named queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rdspark.llm import cnn, decontaminate, dialogue, gam, jaccard, mixing, packing, pii, secrets, spelling, substrings, tokens, topk
from rdspark.llm.oracles import ORACLE_SQL  # noqa: F401  with QUERIES: what the entry registers
from rdspark.llm.tables import fold, table, written

BASE_KINDS = ("email", "ip", "card", "phone")


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_data(table(spark, folder, "documents"))
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in BASE_KINDS]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = cnn.fit(docs, table(spark, folder, "labels"), "toxic", fold("doc_id", 5) != 0)
    return cnn.score(docs, model, "doc_id").select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
                                                   (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("row_key")


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = written(secrets.findings(docs), "findings")      # read by each pass of the forest
    forest = secrets.train(secrets.labelled_by_rule(found))
    return secrets.scored(found, forest).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
                                                F.sha2("value", 256).alias("value_sha256"), "score", (F.col("score") >= 0.5).cast("int").alias("is_secret"))


def op5_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op6_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encoded_documents(table(spark, folder, "documents"), tokenizer_path())


def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.without_repeats(table(spark, folder, "documents"), text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = gam.fit(docs, table(spark, folder, "labels"), "quality", fold("doc_id", 3) != 1)
    return gam.score(docs, model, "doc_id").select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score",
                                                   (F.col("score") >= 0.5).cast("int").alias("predicted"))


def byte_tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.packed_pieces(table(spark, folder, "documents"), byte_tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return dialogue.repaired_conversations(dialogue.damaged(rows), ids=rows, copies="copies")


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, folder, "documents"), damage=199))


QUERIES = {f.__name__: f for f in (op1_pii, op2_toxicity, op3_decontamination, op4_secrets, op5_top_k, op6_tokens, op7_jaccard_join, op8_substring_dedup,
                                   op9_mixing, op10_quality, op11_packing, op12_conversation_repair, op13_spelling)}
