"""The queries opN_<name>: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pseudonym_key(spark: SparkSession) -> str:
    """The key in spark.branchlight.pseudonyms.key. Where it is unset, a public one for test data, under which pseudonyms hide nothing."""
    return spark.conf.get("spark.branchlight.pseudonyms.key", None) or "public key for test data"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), n=3, least=0.5)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    found = substring_dedup(read(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2, length=4096).drop("ids")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash

    found = simhash(read(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import licenses

    return licenses(read(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonym_report

    return pseudonym_report(read(spark, sf_dir, "documents"), secret=pseudonym_key(spark))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(read(spark, sf_dir, "embeddings"), cosine=0.98).withColumnRenamed("component", "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), label_col="quality", folds=5, fold=0, threshold=0.3)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=512)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), label_col="toxic", folds=4, fold=2, threshold=0.3)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: The contract in SQL: windows as strings, the least document of each, the words that later ones cover.
OP2_SQL = """WITH P AS (SELECT doc_id, ws, len(ws) AS n FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)),
W AS (SELECT doc_id, k, array_to_string(ws[k:k + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, n - 11)) AS k FROM P WHERE n >= 13)),
L AS (SELECT s, min(doc_id) AS f FROM W GROUP BY s),
C AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS pos FROM W JOIN L USING (s) WHERE f < doc_id),
X AS (SELECT doc_id, unnest(range(1, n + 1)) AS pos, unnest(ws) AS w FROM P),
K AS (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS kept, count(*) AS n_kept FROM X ANTI JOIN C USING (doc_id, pos) GROUP BY doc_id)
SELECT P.doc_id, n::BIGINT AS n_words, (n - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM P LEFT JOIN K ON P.doc_id = K.doc_id"""
#: The contract in SQL: all pairs inside a label, and what they reach.
OP7_SQL = """WITH RECURSIVE V AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
P AS (SELECT a.vec_id AS a, b.vec_id AS b FROM V a JOIN V b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
R AS (SELECT DISTINCT a AS id, a AS hop FROM P UNION SELECT R.id, P.b FROM R JOIN P ON R.hop = P.a),
M AS (SELECT id, min(hop) AS c FROM R GROUP BY id), N AS (SELECT a, count(*) AS n FROM P GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN M ON vec_id = id LEFT JOIN N ON vec_id = a"""


def oracle_sql() -> dict[str, str]:
    """The others need a hash, a tokenizer, an alignment, look-around or a fit that SQL hasn't: the tests hold them against recomputation."""
    return {"op2_substring_dedup": OP2_SQL, "op7_embedding_dedup": OP7_SQL}
