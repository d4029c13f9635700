"""Trees as text: display labels, collapsed chains, outlines. nodes(path, label), items(path, seq, text); paths are arrays of ordinals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import short


def prefixes(path: str = "path"):
    """Each prefix of a path, the empty one first."""
    return F.transform(F.sequence(F.lit(0), F.size(path)), lambda i: F.slice(path, F.lit(1), i))


def display_labels(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """Nodes with name: the own label; else the leftmost leaf's first text; else (unlabeled)."""
    kind = nodes.schema["path"].dataType
    texts = items.where(F.length(F.coalesce("text", F.lit(""))) > 0).select(F.col("path").cast(kind).alias("path"), "seq", "text")
    first = texts.select(F.explode(prefixes()).alias("path"), F.struct("path", "seq").alias("o"), "text").groupBy("path").agg(F.min_by("text", "o").alias("__text"))
    named = nodes.join(first, "path", "left")
    return named.withColumn("name", F.coalesce("label", short(F.col("__text")), F.lit("(unlabeled)"))).drop("__text")


def collapsed(nodes: DataFrame) -> DataFrame:
    """nodes(path) -> (path, shown): a node with exactly one leaf below it is shown as that leaf; the root too if all is one chain."""
    inner = nodes.where(F.size("path") > 0).select(F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).distinct()
    leaves = nodes.select("path").join(inner, "path", "left_anti").select(F.explode(prefixes()).alias("path"), F.col("path").alias("leaf"))
    below = leaves.groupBy("path").agg(F.count("*").alias("n"), F.min("leaf").alias("leaf"))
    return nodes.join(below, "path", "left").select(*nodes.columns, F.when(F.col("n") == 1, F.col("leaf")).otherwise(F.col("path")).alias("shown"))


def outline(nodes: DataFrame, items: DataFrame, max_items: int | None = 3) -> DataFrame:
    """B2: (path, is_item, ordinal, line), in the order of (path, is_item, ordinal): two spaces a level, a count, up to max_items texts a leaf."""
    kind = nodes.schema["path"].dataType
    items = items.withColumn("path", F.col("path").cast(kind))
    counts = items.select(F.explode(prefixes()).alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    rows = display_labels(nodes, items).join(counts, "path", "left")
    heads = rows.select("path", F.lit(0).alias("is_item"), F.lit(0).cast("bigint").alias("ordinal"), F.concat(F.repeat(F.lit("  "), F.size("path")), F.lit("- "), F.col("name"), F.lit(" ["), F.coalesce("n", F.lit(0)), F.lit("]")).alias("line"))
    ranked = items.withColumn("ordinal", F.row_number().over(Window.partitionBy("path").orderBy("seq")).cast("bigint"))
    if max_items is not None:
        ranked = ranked.where(F.col("ordinal") <= max_items)
    lines = ranked.select("path", F.lit(1).alias("is_item"), "ordinal", F.concat(F.repeat(F.lit("  "), F.size("path")), F.lit("    · "), short(F.col("text"))).alias("line"))
    return heads.unionByName(lines)
