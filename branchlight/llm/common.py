"""What the operators of this subpackage share: the shared folder, written tables, word splitting, connected components."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.shared import dropped, written  # noqa: F401

#: ASCII white space as ``bytes.split()`` takes it, which is ``[\\x20\\x09-\\x0D]``.
WORD = r"[^\x20\x09-\x0D]+"
#: A component search goes on in one task when no more links than these are left.
FINISH_EDGES = 12_000
#: Rows of one key that a join leaves in one task; the key's other rows go to more tasks.
HEAVY = 2_048


_KEPT: dict = {}


def kept(key, make):
    """make() once for each key and Python worker, since Spark goes on using its workers from task to task. What another operator kept there goes, so that a
    worker that serves one operator after another doesn't fill with all of their tables."""
    if key not in _KEPT:
        kind = key[0].split()[0]
        for old in [k for k in _KEPT if k[0].split()[0] != kind or k[0] == key[0]]:
            del _KEPT[old]
        _KEPT[key] = make()
    return _KEPT[key]


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of jobs whose results are already written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def rows_of(batches, *names: str):
    """Lists of the named columns from each Arrow batch."""
    for batch in batches:
        yield [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def spread(*cols: str) -> Column:
    """A 64-bit order of the values in cols that has nothing to do with their own order."""
    return F.xxhash64(*[F.col(c) for c in cols], F.lit(0x5BD1))


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner", heavy: int = HEAVY) -> DataFrame:
    """left join right on key, right having at most one row of a key: a key with over `heavy` rows in left is dealt to several tasks by a hash of `by`.

    The heavy keys, fewer than left's rows / heavy, are broadcast up to 100,000 of them, some MB; beyond that all keys are dealt to 16 tasks each.
    """
    sizes = written(left.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > heavy).select(key, F.ceil(F.col("__n") / heavy).cast("int").alias("__copies")), "heavy")
    n = sizes.count()
    if not n:
        return left.join(right, key, how)
    if n <= 100_000:
        left, right = (t.join(F.broadcast(sizes), key, "left").withColumn("__copies", F.coalesce("__copies", F.lit(1))) for t in (left, right))
    else:
        left, right = (t.withColumn("__copies", F.lit(16)) for t in (left, right))
    left = left.withColumn("__part", F.pmod(F.xxhash64(by, F.lit(77)), F.col("__copies")).cast("int")).drop("__copies")
    right = right.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1))).drop("__copies")
    return left.join(right, [key, "__part"], how).drop("__part")


def connected_components(edges: DataFrame, finish: int = FINISH_EDGES) -> DataFrame:
    """edges(u, v), any direction and with repeats -> (node, root), one row per node of an edge.

    Nodes are contracted onto the neighbour that comes first in an order drawn anew each round, so that
    the graph shrinks by a constant factor a round whatever its shape. Each round is a group-by with
    map-side combine and two joins over what is left; when at most `finish` links are left, one task ends
    the search. root names the component and is one of its nodes, not always the least.
    """
    spark = edges.sparkSession
    kind = edges.schema["u"].dataType
    left = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    steps: list[DataFrame] = []
    for turn in range(200):
        n = left.count()
        if n <= finish:
            break
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.xxhash64(F.col(c), F.lit(turn * 7919 + 1))
        best = both.groupBy("u").agg(F.min(F.struct(rank("v").alias("h"), F.col("v").alias("v"))).alias("b"))
        here = F.struct(rank("u").alias("h"), F.col("u").alias("v"))
        to = written(best.select(F.col("u").alias("node"), F.least(F.col("b"), here)["v"].alias("root")), "contract")
        steps.append(to)
        a, b = to.select(F.col("node").alias("u"), F.col("root").alias("ru")), to.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        one = spread_join(left, a, "u", "v")
        moved = spread_join(one, b, "v", "u").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        was, left = left, written(moved, "edges")
        dropped(was)
    else:
        raise RuntimeError("the contraction did not end")

    def end(key, table):
        import pandas as pd

        parent: dict = {}

        def find(x):
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for u, v in zip(table["u"].tolist(), table["v"].tolist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        return pd.DataFrame({"node": list(parent), "root": [find(x) for x in parent]})

    last = left.groupBy(F.lit(0).alias("one")).applyInPandas(end, f"node {kind.simpleString()}, root {kind.simpleString()}")
    last = written(last, "contract")
    dropped(left)
    # from the last round back: where a root of round i has gone since
    for to in reversed(steps):
        gone = last.select(F.col("node").alias("root"), F.col("root").alias("top"))
        now = spread_join(to, gone, "root", "node", "left").select("node", F.coalesce("top", "root").alias("root"))
        was, last = last, written(now.unionByName(last.join(to.select("node"), "node", "left_anti")), "contract")
        dropped(was, to)
    return last


def component_ids(nodes: DataFrame, roots: DataFrame, least: str, out: str = "component") -> DataFrame:
    """nodes(node, least, ...), one row a node, roots(node, root) -> nodes with `out`, the least `least` among the nodes of a root; a node without root is alone."""
    rooted = written(nodes.join(roots, "node"), "rooted")
    tops = written(rooted.groupBy("root").agg(F.min(least).alias(out)), "tops")
    linked = spread_join(rooted, tops, "root", "node").select(*nodes.columns, out)
    return linked.unionByName(nodes.join(roots, "node", "left_anti").withColumn(out, F.col(least)).select(*nodes.columns, out))
