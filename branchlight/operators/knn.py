"""Nearest neighbours: exact over all items, or over the leaf that a query is routed to."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import distance, normalise

#: Queries that stand in one broadcast block, and numbers in all blocks up to which queries are broadcast; more are dealt to item buckets of BUCKET rows.
BLOCK, BROADCAST, BUCKET = 1_024, 1 << 22, 20_000


def check_k(k: int) -> None:
    if k < 0:
        raise ValueError(f"k must not be negative: {k}")


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, content_id, distance), ties by content id."""
    if not k:  # Spark refuses a rank limit of 0
        return pairs.select("*", F.lit(0).alias("rank")).where(F.lit(False))
    order = Window.partitionBy("query_id").orderBy("distance", "content_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def closest(x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, item row, distance) of at least the k nearest rows of x for each row of q; ties at the edge all come along."""
    near = x @ q.T
    out = []
    for j in range(len(q)):
        take = np.argpartition(-near[:, j], min(k + 8, len(x)) - 1)[: k + 8] if len(x) > k + 8 else np.arange(len(x))
        edge = near[take, j].min()
        take = np.flatnonzero(near[:, j] >= edge - 1e-9)
        d = np.sqrt(((x[take] - q[j]) ** 2).sum(1))
        if len(take) > k:  # no more than what can be among the k nearest
            ok = d <= np.partition(d, k - 1)[k - 1] + 1e-12
            take, d = take[ok], d[ok]
        out.append((np.full(len(take), j), take, d))
    return tuple(np.concatenate([o[c] for o in out]) for c in range(3))


def knn_exact(items: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "content_id", vector_col: str = "vector", query_id: str = "query_id", query_vector: str = "vector", broadcast: int = BROADCAST, bucket: int = BUCKET) -> DataFrame:
    """(query_id, rank, content_id, distance) of the k nearest items of each query.

    Up to `broadcast` numbers of query vectors are taken in blocks of BLOCK rows that every task has. More queries stay where they are: items are dealt to
    buckets, queries to all buckets, and a task streams the queries past its bucket. Either way a batch of items returns its k nearest for
    each query, so at most k rows (and ties) per query and batch are shuffled on, never the product of both sides.
    """
    check_k(k)
    kind, q_kind = items.schema[id_col].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    arrow_id = to_arrow_type(queries.schema[query_id].dataType)
    asked = queries.select(F.col(query_id).alias("query_id"), normalise(query_vector).alias("q"))
    source = items.select(F.col(id_col).alias("content_id"), normalise(vector_col).alias("v")).where("v is not null")
    schema = f"query_id {q_kind}, content_id {kind}, distance double"
    if not k:
        return ranked(source.limit(0).join(asked.limit(0), F.lit(True)).select("query_id", "content_id", F.lit(0.0).alias("distance")), k)
    if (asked.agg(F.sum(F.size("q"))).first()[0] or 0) > broadcast:
        return ranked(_dealt(source, asked, k, schema, arrow_id, bucket), k)
    rows = sorted(((r[0], r[1]) for r in asked.collect()), key=lambda r: (r[0] is None, r[0]))  # bounded by `broadcast`
    found = None
    for at in range(0, max(1, len(rows)), BLOCK):
        block = rows[at : at + BLOCK]

        def run(batches, block=block):
            import pyarrow as pa

            q = np.array([v for _, v in block]).reshape(len(block), -1)
            names = pa.array([i for i, _ in block], arrow_id)
            for b in batches:
                if b.num_rows and len(block):
                    j, take, d = closest(np.array(b.column(1).to_pylist()), q, k)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(j)), b.column(0).take(pa.array(take)), pa.array(d)], ["query_id", "content_id", "distance"])

        part = source.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return ranked(found, k)


def _dealt(source: DataFrame, asked: DataFrame, k: int, schema: str, arrow_id, bucket: int) -> DataFrame:
    """A bucket's items stand before the queries in its task."""
    buckets = max(1, -(-source.count() // bucket))
    mine = source.select(F.pmod(F.xxhash64("content_id", F.lit(4)), F.lit(buckets)).alias("b"), F.lit(0).alias("side"), F.lit(None).cast(asked.schema["query_id"].dataType).alias("query_id"), "content_id", "v")
    all_ = asked.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)).cast("array<bigint>")).alias("b"), F.lit(1).alias("side"), "query_id", F.lit(None).cast(source.schema["content_id"].dataType).alias("content_id"), F.col("q").alias("v"))

    def run(batches):
        import pyarrow as pa

        key, ids, x = None, [], []
        for batch in batches:
            b, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(b) | np.diff(side)) + 1
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)], strict=True):
                if to == at:
                    continue
                part = batch.slice(at, to - at)
                if b[at] != key:
                    key, ids, x = b[at], [], []
                v = np.array(part.column(4).to_pylist())
                if side[at] == 0:
                    ids.append(part.column(3))
                    x.append(v)
                elif x:
                    x, ids = [np.concatenate(x)], [pa.concat_arrays(ids)]
                    for from_ in range(0, len(v), BLOCK):
                        j, take, d = closest(x[0], v[from_ : from_ + BLOCK], k)
                        yield pa.RecordBatch.from_arrays([part.column(2).slice(from_, BLOCK).take(pa.array(j)), ids[0].take(pa.array(take)), pa.array(d)], ["query_id", "content_id", "distance"])

    return mine.unionByName(all_).repartition("b").sortWithinPartitions("b", "side").mapInArrow(run, schema)


def knn_leaf(items: DataFrame, routed: DataFrame, k: int = 10) -> DataFrame:
    """items(leaf_id, content_id, vector) and routed queries (leaf_id, query_id, vector) meet in the leaf, which holds few items."""
    check_k(k)
    q = routed.select("leaf_id", "query_id", F.col("vector").alias("q"))
    pairs = items.join(q, "leaf_id").select("query_id", "content_id", distance(F.col("vector"), F.col("q")).alias("distance"))
    return ranked(pairs, k)
