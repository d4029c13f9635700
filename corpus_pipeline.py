"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's docs.
All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from branchlight.llm.common import dropped, written
from branchlight.llm.decontamination import clean
from branchlight.llm.packing import pack
from branchlight.llm.pii import pseudonymise
from branchlight.llm.quality import quality_model, score_column
from branchlight.llm.queries import pseudonym_key, read, tokenizer
from branchlight.llm.simhash import near_texts

#: No SQL: a discriminant, fingerprints and a tokenizer's merges are beyond it. The tests hold each stage against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3 go."""
    model = quality_model(docs, read(spark, sf_dir, "labels"), label_col="quality", folds=5, fold=0)
    return docs.where(score_column(model, F.col("text")) >= 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least doc_id, once: five-word shingles, similarity 0.8. Rows of null doc_id stay."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    own = F.when(F.col("doc_id").isNotNull(), F.concat_ws("|", F.col("doc_id").cast("string"), digest))
    found = near_texts(docs.where("doc_id is not null").select(F.struct("doc_id", digest.alias("digest")).alias("row"), "text"), shingle=5, similarity=0.8, id_col="row")
    found = written(found.select("row", F.concat_ws("|", F.col("row.doc_id").cast("string"), "row.digest").alias("own"), (F.col("row") == F.col("component")).alias("first")), "pipeline-near")
    repeated = found.where("first").groupBy("own").agg(F.count("*").alias("n")).where("n > 1").select(F.col("own").alias("__own"))
    kept = docs.withColumn("__own", own).join(found.where("not first").select(F.col("own").alias("__own")).distinct(), "__own", "left_anti")
    if not repeated.isEmpty():
        once = kept.join(repeated, "__own", "left_semi").withColumn("__turn", F.row_number().over(Window.partitionBy("__own").orderBy(F.lit(0)))).where("__turn = 1").drop("__turn")
        kept = kept.join(repeated, "__own", "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return clean(docs, read(spark, sf_dir, "benchmark"), n=3, least=0.5)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms under the key in spark.branchlight.pseudonyms.key; n_chars follows the text."""
    return pseudonymise(docs, secret=pseudonym_key(spark)).withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars").cast("int")).cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4,096 ids, along the Hilbert curve."""
    return pack(docs, tokenizer("word_bpe_49k.json"), end_id=2, length=4096).drop("ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        was, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        dropped(was)
    return STAGES[-1][1](spark, docs, sf_dir)
