"""Principal components from moments: one distributed pass, a small eigenproblem on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import project


def moments(df: DataFrame, vector: str = "vector") -> DataFrame:
    """(i, j, n, xi, xj, xy) for i <= j: sums of products, combined within each partition, dim * dim numbers each."""

    def run(batches):
        import pyarrow as pa

        n, s, p = 0, None, None
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float)
            if len(x):
                s = x.sum(0) + (0 if s is None else s)
                p = x.T @ x + (0 if p is None else p)
                n += len(x)
        if n:
            i, j = np.triu_indices(len(s))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(i), n), pa.int64()), pa.array(s[i]), pa.array(s[j]), pa.array(p[i, j])], ["i", "j", "n", "xi", "xj", "xy"])

    part = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "i int, j int, n long, xi double, xj double, xy double")
    return part.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "xi", "xj", "xy")])


@dataclass
class PCAState:
    """Running moments, and the axes drawn from them. Moments add up, so an incremental fit is exact for any batches."""

    n: int = 0
    total: np.ndarray | None = field(default=None, repr=False)
    products: np.ndarray | None = field(default=None, repr=False)
    mean: np.ndarray | None = field(default=None, repr=False)
    components: np.ndarray | None = field(default=None, repr=False)

    @property
    def is_fitted(self) -> bool:
        return self.components is not None

    def add(self, df: DataFrame, vector: str = "vector") -> PCAState:
        rows = moments(df, vector).collect()  # dim * (dim + 1) / 2 rows
        if rows:
            d = max(r["j"] for r in rows) + 1
            total, products = np.zeros(d), np.zeros((d, d))
            for r in rows:
                products[r["i"], r["j"]] = products[r["j"], r["i"]] = r["xy"]
                if r["i"] == r["j"]:
                    total[r["i"]] = r["xi"]
            self.n += rows[0]["n"]
            self.total = total if self.total is None else self.total + total
            self.products = products if self.products is None else self.products + products
        return self

    def add_rows(self, x: np.ndarray) -> PCAState:
        """The rows of an array."""
        x = np.asarray(x, float)
        self.n += len(x)
        self.total = x.sum(0) if self.total is None else self.total + x.sum(0)
        self.products = x.T @ x if self.products is None else self.products + x.T @ x
        return self

    def transform(self, x: np.ndarray) -> np.ndarray:
        if not self.is_fitted:
            raise RuntimeError("the reducer isn't fitted")
        return (np.asarray(x, float) - self.mean) @ self.components.T

    def solve(self, dims: int) -> PCAState:
        if not self.n:
            raise RuntimeError("no vectors to fit")
        self.mean = self.total / self.n
        cov = self.products / self.n - np.outer(self.mean, self.mean)
        values, axes = np.linalg.eigh(cov)
        order = np.argsort(-values)[: min(dims, self.n, len(values))]
        self.components = axes[:, order].T
        # a fixed sign: the largest entry of an axis is positive
        self.components *= np.sign(self.components[np.arange(len(order)), np.abs(self.components).argmax(1)])[:, None]
        return self

    def to_dict(self) -> dict:
        return {k: (v.tolist() if isinstance(v, np.ndarray) else v) for k, v in vars(self).items()}

    @classmethod
    def from_dict(cls, d: dict) -> PCAState:
        return cls(**{k: (np.array(v) if isinstance(v, list) else v) for k, v in d.items()})


def fit_pca(df: DataFrame, dims: int, vector: str = "vector") -> PCAState:
    return PCAState().add(df, vector).solve(dims)


def transform_pca(df: DataFrame, state: PCAState, vector: str = "vector", out: str = "reduced") -> DataFrame:
    """(x - mean) times the axes, in the JVM. Spark's own PCA model doesn't centre."""
    if not state.is_fitted:
        raise RuntimeError("the reducer isn't fitted")
    spark = df.sparkSession
    one = spark.createDataFrame([(state.mean.tolist(), state.components.tolist())], "__mean array<double>, __axes array<array<double>>")
    return df.join(F.broadcast(one)).withColumn(out, project(F.col(vector), F.col("__mean"), F.col("__axes"))).drop("__mean", "__axes")
