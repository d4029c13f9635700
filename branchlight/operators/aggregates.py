"""Vector aggregates over groups: sums, centroids, dispersions, split scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.vectors import distance

#: Groups whose sums a task holds before it passes them on.
HELD = 20_000


def long_form(df: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """One row per component: keys, pos, x."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "x"))


def vector_sums(df: DataFrame, keys: list[str], vector: str = "vector", weight: str | None = None) -> DataFrame:
    """G1: (keys, count, vsum). Each task adds up the vectors of its batches, so one row a group and task is shuffled, whole; then the parts are added.

    weight: a column of counts, where the vectors are sums themselves.
    """
    one = df.select(*keys, (F.col(weight) if weight else F.lit(1)).cast("long").alias("count"), F.col(vector).cast("array<double>").alias("vsum"))
    schema = StructType([*one.select(*keys).schema.fields, *one.select("count", "vsum").schema.fields])
    arrow = to_arrow_schema(schema)
    plain = lambda v: tuple(map(plain, v)) if isinstance(v, list) else v

    def add(batches):
        import pyarrow as pa

        place: dict = {}
        names: list = []
        totals = None

        def out(used):
            cols = [pa.array([n[i] for n in names], f.type) for i, f in enumerate(list(arrow)[: len(keys)])]
            return pa.RecordBatch.from_arrays([*cols, pa.array(totals[:used, 0].astype(np.int64)), pa.array(list(totals[:used, 1:]), pa.list_(pa.float64()))], schema=arrow)

        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(len(keys) + 1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            n = b.column(len(keys)).to_numpy()
            key = list(zip(*(b.column(i).to_pylist() for i in range(len(keys))), strict=True)) if keys else [()] * b.num_rows
            at = np.empty(b.num_rows, np.int64)
            for i, k in enumerate(key):
                h = plain(list(k))
                at[i] = place.setdefault(h, len(place))
                if at[i] == len(names):
                    names.append(k)
            if totals is None:
                totals = np.zeros((256, x.shape[1] + 1))
            if len(names) > len(totals):
                totals = np.concatenate([totals, np.zeros((max(len(names), 2 * len(totals)) - len(totals), totals.shape[1]))])
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            totals[at[order][first], 0] += np.add.reduceat(n[order], first)
            totals[at[order][first], 1:] += np.add.reduceat(x[order], first, axis=0)
            if len(names) > HELD:
                yield out(len(names))
                place, names, totals = {}, [], None
        if names:
            yield out(len(names))

    # after the shuffle a group's parts lie in one task, in order, so they are never held longer than a group goes on
    def added(batches):
        import pyarrow as pa

        last, n, x, rows = None, 0, None, []

        def out():
            return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow))], schema=arrow)

        for b in batches:
            for *k, m, v in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                if k != last:
                    if x is not None:
                        rows.append([*last, n, x.tolist()])
                    last, n, x = k, 0, np.zeros(len(v))
                n += m
                x += v
            if rows:
                yield out()
                rows = []
        if x is not None:
            rows.append([*last, n, x.tolist()])
            yield out()

    parts = one.mapInArrow(add, schema)
    return (parts.repartition(*keys).sortWithinPartitions(*keys) if keys else parts.coalesce(1)).mapInArrow(added, schema)


def centroids(df: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """(keys, count, vsum, centroid)."""
    return vector_sums(df, keys, vector).withColumn("centroid", F.transform("vsum", lambda x: x / F.col("count")))


def dispersions(df: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """(keys, count, dispersion), the mean distance to the centroid. The centroids, one row per group, join the vectors."""
    c = centroids(df, keys, vector).select(*keys, "centroid")
    return df.join(c, keys).groupBy(*keys).agg(F.count("*").alias("count"), F.avg(distance(F.col(vector), F.col("centroid"))).alias("dispersion"))


def roll_up(df: DataFrame, path: str = "path", vector: str = "vector") -> DataFrame:
    """(prefix, count, vsum) for each node on the way to an item: sums of the leaves, then of the leaves' sums along their paths."""
    prefixes = F.transform(F.sequence(F.lit(0), F.size(path)), lambda i: F.slice(path, F.lit(1), i))
    leaves = vector_sums(df, [path], vector)
    return vector_sums(leaves.select(F.explode(prefixes).alias("prefix"), "count", "vsum"), ["prefix"], "vsum", weight="count")


def candidate_scores(df: DataFrame, group: list[str], bucket: str = "bucket", vector: str = "vector", separation_weight: float = 0.05, imbalance_weight: float = 0.05) -> DataFrame:
    """C3c-C3e: (group, k, n, least, parent_dispersion, child_dispersion, gain, gain_ratio, separation, imbalance, score) of a given bucketing."""
    parent = dispersions(df, group, vector).select(*group, F.col("dispersion").alias("parent_dispersion"))
    keys = [*group, bucket]
    child = dispersions(df, keys, vector)
    parts = child.groupBy(*group).agg(F.count("*").alias("k"), F.sum("count").alias("n"), F.min("count").alias("least"), (F.sum(F.col("count") * F.col("dispersion")) / F.sum("count")).alias("child_dispersion"), (F.stddev_pop("count") / F.avg("count")).alias("imbalance"))
    c = centroids(df, keys, vector).select(*keys, "centroid")
    # a handful of rows a group: each bucket's centroid against the later ones
    a, b = (c.select(*group, F.col(bucket).alias(f"b{i}"), F.col("centroid").alias(f"c{i}")) for i in (1, 2))
    apart = a.join(b, group).where("b1 < b2").groupBy(*group).agg(F.avg(distance(F.col("c1"), F.col("c2"))).alias("separation"))
    out = parts.join(parent, group).join(apart, group, "left").withColumn("separation", F.coalesce("separation", F.lit(0.0)))
    out = out.withColumn("gain", F.col("parent_dispersion") - F.col("child_dispersion"))
    out = out.withColumn("gain_ratio", F.when(F.col("parent_dispersion") > 0, F.col("gain") / F.col("parent_dispersion")).otherwise(0.0))
    return out.withColumn("score", F.col("gain") + separation_weight * F.col("separation") - imbalance_weight * F.col("imbalance"))


def nearest(df: DataFrame, centers: DataFrame, vector: str = "vector", on: list[str] | None = None) -> DataFrame:
    """Df with the id of its nearest centre and the distance; ties go to the first ordinal.

    centers(center_id, ordinal, centroid) of one parent, at most max_branches or k of them, become one row with an array, so that no row of df is
    multiplied. Without `on` that one row goes to all tasks; with it the rows of all parents are an equi-join, which Spark broadcasts only where they are small.
    """
    table = centers.groupBy(*(on or [])).agg(F.collect_list(F.struct("ordinal", "center_id", "centroid")).alias("__centers"))
    joined = df.join(table, on) if on else df.join(F.broadcast(table))
    best = lambda v: F.array_min(F.transform("__centers", lambda c: F.struct(distance(v, c["centroid"]).alias("d"), c["ordinal"].alias("o"), c["center_id"].alias("i"))))
    return joined.withColumn("__best", best(F.col(vector))).withColumn("center_id", F.col("__best.i")).withColumn("distance", F.col("__best.d")).drop("__best", "__centers")


def weighted_mean(value: Column, weight: Column) -> Column:
    """G4."""
    return F.sum(value * weight) / F.sum(weight)
