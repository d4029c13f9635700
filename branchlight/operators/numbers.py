"""Row numbers without a task that sees all rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.shared import written


def numbered_in(rows: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """rows with `out`, from 1 in the given order among the rows of equal keys.

    Rows are dealt to ranges of (keys, order) and numbered there; a key that goes over several ranges goes on from the counts of the earlier ones, one
    row a key and range. The dealt rows are written first, since ranges come from samples that differ from run to run.
    """
    dealt = written(rows.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()), "dealt")
    here = dealt.withColumn("__i", F.row_number().over(Window.partitionBy("__range", *keys).orderBy(*order)))
    names = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    counts = dealt.groupBy(F.col("__range").alias("__r"), *names).agg(F.count("*").alias("__n"))
    own = [f"__k{i}" for i in range(len(keys))]
    before = Window.partitionBy(*own).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__r", *own, F.sum("__n").over(before).alias("__start")).where("__start > 0")
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return here.join(starts, same, "left").select(*rows.columns, (F.col("__i") + F.coalesce("__start", F.lit(0))).cast("long").alias(out))
