"""The corpus pipeline: documents in, token ids of the documents worth training on out.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it kept, and returns a
DataFrame. All stages but the last return the columns of ``documents``, and any others that it has.

Null texts count as empty in every stage; rows without an id are kept; repeated rows are judged alike
(the near-duplicate stage keeps one of them); an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import decontaminate, pieces, secrets, simhash, toxicity
from freshet.llm.common import discard_scratch, materialize, scratch


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier chain holds for toxic."""
    return toxicity.drop_toxic(docs, toxicity.fitted(spark, sf_dir))


def near_duplicates_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similarity 0.8 or more) the document
    of the smallest id stays. SimHash fingerprints within 4 bits link documents, checked by their
    shingles; near copies whose fingerprints are farther apart are found by shared shingles."""
    return simhash.keep_one(docs, simhash.similar_groups(docs, words=5, similarity=0.8, radius=4))


def benchmark_passages_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of ten words of a benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_are_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts and counts their characters anew; all documents stay."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pieces_of_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, and whether decoding the ids gives the text again."""
    model = pieces.public_model()
    own = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    coded = pieces.encode(docs.select(*own, "text"), model, round_trip="round_trip")
    return coded.select(*own, F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


STAGES = [
    ("toxicity", toxic_documents_go),
    ("simhash_near_dedup", near_duplicates_go),
    ("decontamination", benchmark_passages_go),
    ("secret_scan", secrets_are_masked),
    ("sentencepiece", pieces_of_texts),
]

#: SQL expresses neither the classifier, nor the chained groups, nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written as Parquet in the shared folder and reread. What a
    stage made on the way, and the stage before it, go once it is written."""
    docs, made = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(scratch(spark))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard_scratch(spark, but=docs, since=made)
    return STAGES[-1][1](spark, docs, sf_dir)
