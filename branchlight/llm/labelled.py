"""Bounded samples of labelled texts, for the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def bucket(id_col: str, of: int):
    """crc32 of the id as text, modulo `of`; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, *, held_out, at_most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label, half) of about `at_most` labelled rows that aren't held out, chosen by a hash of the id.

    The chosen ids are broadcast: their number is bounded by at_most, whatever the size of the tables. half is 0 or 1 by
    another hash. Labels other than 0 and 1 are left out; an id that is labelled twice counts twice.
    """
    mine = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    mine = mine.where(~held_out("id"))
    n = mine.count()
    share = 1.0 if n <= at_most else at_most / n
    chosen = mine.where(F.pmod(F.xxhash64("id", F.lit(99)), F.lit(1 << 62)) < round(share * (1 << 62)))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("text", "label", F.pmod(F.xxhash64("id", F.lit(98)), F.lit(2)).cast("int").alias("half"))
