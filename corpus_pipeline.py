"""From documents to packed sequences: quality, near copies, repeated passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.functions.materialize import materialize
from tripledger.llm import minhash, packing, pii, quality, queries, suffix_dedup


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts are judged as texts without words; repeated rows each by
    themselves; an empty table gives an empty one."""
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies; of a repeated doc_id, one row. Rows without doc_id stay, as do
    null and empty texts, which are like nothing. An empty table gives an empty one."""
    kept = minhash.near_copies(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(docs.columns).unionByName(docs.filter("doc_id is null"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; a character that loses bytes goes whole. A null text stays null; of
    repeated rows the first keeps its passages; an empty table gives an empty one."""
    cut = suffix_dedup.remove(docs, with_columns=True)
    text = F.when(F.col("key.text").isNotNull(), F.col("kept_text"))
    return cut.select(text.alias("new"), "key.*").withColumn("text", F.col("new")).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind. Null texts stay null; every row is redacted by itself; an empty table gives an empty one."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with the sequence and place each goes to. A null or empty text is one piece with the end id alone, every repeated row
    has pieces of its own, an empty table gives none."""
    return packing.pack(packing.pieces(docs, queries.VOCABULARY, end_id=0, capacity=queries.SEQUENCE), queries.SEQUENCE)


STAGES = [
    ("quality_rules", keep_good),
    ("minhash_near_dedup", one_of_each_group),
    ("suffix_array_dedup", without_repeats),
    ("pii", without_personal_data),
    ("best_fit_packing", packed),
]
# Boosted trees, evolved packings and samples of suffixes are no SQL: tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
