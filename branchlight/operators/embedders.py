"""Text to vectors: any embedder in Arrow batches, with a cache, retries and normalisation."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache
from typing import Any, Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


@runtime_checkable
class TextEmbedder(Protocol):
    """Texts to vectors; what an executor needs is embed_batch."""

    def embed(self, text: str) -> np.ndarray: ...

    def embed_batch(self, texts: Sequence[str]) -> np.ndarray: ...

    def __call__(self, text: str) -> np.ndarray: ...


class BaseTextEmbedder:
    """What embedders share. A subclass has vectors(texts), one row a text, in order.

    cache: each worker, and a tree over all of its batches, remembers texts. normalize: rows of length 1, zero rows stay. Failed calls are made again
    up to max_retries times. Objects go to the executors by pickling, without what they remember.
    """

    def __init__(self, *, cache: bool = True, normalize: bool = False, max_retries: int = 5, backoff_base: float = 0.5):
        self.cache, self.normalize, self.max_retries, self.backoff_base = cache, normalize, max_retries, backoff_base
        self._known: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_known": {}}

    def vectors(self, texts: list[str]) -> Any:
        raise NotImplementedError

    def embed_batch(self, texts: Sequence[str]) -> np.ndarray:
        """One call for the distinct texts that aren't remembered; float32."""
        texts = list(texts)
        found = {t: self._known[t] for t in texts if t in self._known}
        fresh = [t for t in dict.fromkeys(texts) if t not in found]
        if fresh:
            x = np.asarray(retried(self.vectors, fresh, self.max_retries, self.backoff_base), np.float32).reshape(len(fresh), -1)
            found |= zip(fresh, unit_rows(x) if self.normalize else x, strict=True)
            if self.cache:
                self._known |= {t: found[t] for t in fresh}
        return np.stack([found[t] for t in texts]) if texts else np.zeros((0, 0), np.float32)

    def embed(self, text: str) -> np.ndarray:
        return self.embed_batch([text])[0]

    __call__ = embed

    def cache_clear(self) -> None:
        self._known.clear()


class TagSetEmbedder(BaseTextEmbedder):
    """1 for each tag that a text holds, or that a list, or a mapping's list under "tags", names. In DataFrames: multi_hot_text and multi_hot_list."""

    def __init__(self, tags: Sequence[str], *, unknown: str = "ignore", **settings: Any):
        super().__init__(**settings)
        if unknown not in ("ignore", "error"):
            raise ValueError(f"unknown must be 'ignore' or 'error', not {unknown!r}")
        self.tags, self.unknown = list(dict.fromkeys(tags)), unknown

    def vectors(self, texts: list) -> np.ndarray:
        return np.array([self._row(t) for t in texts], np.float32).reshape(len(texts), len(self.tags))

    def embed_batch(self, texts: Sequence) -> np.ndarray:
        x = self.vectors(list(texts))
        return unit_rows(x) if self.normalize else x

    def embed(self, item: Any) -> np.ndarray:
        return self.embed_batch([item])[0]

    __call__ = embed

    def _row(self, item: Any) -> list[float]:
        if isinstance(item, str):
            return [float(t.lower() in item.lower()) for t in self.tags]
        own = [str(t) for t in (item.get("tags") or [] if hasattr(item, "get") else item)]
        odd = [t for t in own if t not in self.tags]
        if odd and self.unknown == "error":
            raise ValueError(f"unknown tags: {', '.join(odd)}")
        return [float(t in own) for t in self.tags]


class HuggingFaceTextEmbedder(BaseTextEmbedder):
    """A sentence-transformers model, loaded once for each worker; or model_obj, an object with encode(texts, convert_to_numpy=True)."""

    def __init__(self, model: str = "BAAI/bge-small-en-v1.5", *, device: str | None = "auto", cache_folder: str | None = None, model_obj: Any = None, encode_kwargs: dict | None = None, **settings: Any):
        super().__init__(**settings)
        self.model_name, self.device, self.cache_folder, self.model_obj, self.encode_kwargs = model, device, cache_folder, model_obj, dict(encode_kwargs or {})

    def vectors(self, texts: list[str]) -> Any:
        model = self.model_obj or _sentence_model(self.model_name, best_device() if self.device == "auto" else self.device, self.cache_folder)
        return model.encode(texts, convert_to_numpy=True, **self.encode_kwargs)


def best_device() -> str | None:
    """mps, cuda or cpu; None without torch."""
    try:
        import torch
    except ImportError:
        return None
    mps = getattr(torch.backends, "mps", None)
    return "mps" if mps is not None and mps.is_available() else "cuda" if torch.cuda.is_available() else "cpu"


@cache
def _sentence_model(name: str, device: str | None, folder: str | None):
    try:
        from sentence_transformers import SentenceTransformer
    except ImportError as e:
        raise ImportError("HuggingFaceTextEmbedder needs the package sentence-transformers, or a model_obj") from e
    return SentenceTransformer(name, device=device, cache_folder=folder)


class OpenAITextEmbedder(BaseTextEmbedder):
    """E5: a hosted model, one call a batch; client: an object with embeddings.create, which must pickle, or a function that makes one on a worker."""

    def __init__(self, model: str = "text-embedding-3-small", *, api_key: str | None = None, dimensions: int | None = None, client: Any = None, **settings: Any):
        super().__init__(**settings)
        self.model, self.api_key, self.dimensions, self.client = model, api_key, dimensions, client

    def vectors(self, texts: list[str]) -> list:
        client = self.client if hasattr(self.client, "embeddings") else self.client() if callable(self.client) else _hosted_client(self.api_key)
        more = {"dimensions": self.dimensions} if self.dimensions else {}
        got = client.embeddings.create(model=self.model, input=texts, **more)
        return [d.embedding for d in got.data]


@cache
def _hosted_client(api_key: str | None):
    try:
        from openai import OpenAI
    except ImportError as e:
        raise ImportError("OpenAITextEmbedder needs the package openai, or a client") from e
    return OpenAI(**({"api_key": api_key} if api_key else {}))


def embed_texts(embedder: Any, texts: list[str]) -> np.ndarray:
    """By an embedder's own batches, or one text after another by any function."""
    batch = getattr(embedder, "embed_batch", None)
    return np.asarray(batch(texts) if callable(batch) else [embedder(t) for t in texts])


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(n > 0, n, 1)).astype(x.dtype)


def embedded(rows: DataFrame, embedder: Any, *, text_col: str = "text", out: str = "embedding", cache: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows with `out` filled where it is null, and the cache(text_md5, vector) for the next batch, None if the embedder keeps none.

    The vectors of new texts are written by `keep` before they are used, so that no call is made twice.
    """
    texts = rows.withColumn(text_col, F.coalesce(text_col, F.lit("")))

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in parts:
            yield pd.Series(list(np.asarray(embed_texts(embedder, t.tolist()), np.float32).reshape(len(t), -1)))

    run_ = run
    known = cache if cache is not None else rows.sparkSession.createDataFrame([], "text_md5 string, vector array<float>")
    fresh = cache_misses(texts.where(F.col(out).isNull()), known, text_col).select("text_md5", run_("text").alias("vector"))
    fresh = keep(fresh) if keep else fresh
    table = known.unionByName(fresh)
    filled = rows.where(F.col(out).isNull()).drop(out).withColumn("__md5", F.md5(F.coalesce(text_col, F.lit("")).cast("binary"))).join(table.withColumnRenamed("text_md5", "__md5"), "__md5", "left").withColumnRenamed("vector", out).drop("__md5")
    kind = rows.schema[out].dataType
    done = rows.where(F.col(out).isNotNull()).unionByName(filled.select(*[F.col(c).cast(kind) if c == out else F.col(c) for c in rows.columns]))
    return done, table if getattr(embedder, "cache", True) else None


def cache_misses(docs: DataFrame, cache: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_md5, text) of each text that cache(text_md5, ...) lacks, once."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.md5(F.col(text_col).cast("binary")).alias("text_md5"), F.col(text_col).alias("text"))
    return rows.groupBy("text_md5").agg(F.first("text").alias("text")).join(cache.select("text_md5").distinct(), "text_md5", "left_anti")


def merged(*maps: Column) -> Column:
    """Maps merged from left to right, later values win."""
    def two(a: Column, b: Column) -> Column:
        b = F.coalesce(b, F.map_filter(a, lambda k, v: F.lit(False)))
        return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)

    out = maps[0]
    for m in maps[1:]:
        out = two(out, m)
    return out


def retried(f: Callable, texts: list[str], max_retries: int = 5, base: float = 0.5):
    """f(texts), up to max_retries more times, waiting base * 2 ** attempt and up to a tenth of a second."""
    for attempt in range(max_retries + 1):
        try:
            return f(texts)
        except Exception:
            if attempt == max_retries:
                raise
            time.sleep(base * 2**attempt + random.uniform(0, 0.1))


def embed(docs: DataFrame, make: Callable[[], Callable[[list[str]], Iterable]], *, text_col: str = "text", out: str = "embedding", cache: DataFrame | None = None, normalise: bool = False, max_retries: int = 5, backoff_base: float = 0.5) -> DataFrame:
    """Docs with `out` filled where it is null or absent. make() gives a worker's function from a list of texts to vectors.

    Each distinct text is embedded once, in Arrow batches; vectors that docs or cache(text_md5, vector) already have aren't computed.
    """

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = make()
        for t in parts:
            x = np.asarray(list(retried(f, t.tolist(), max_retries, backoff_base)), np.float32).reshape(len(t), -1)
            if normalise:
                n = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.where(n > 0, x / np.where(n > 0, n, 1), x)
            yield pd.Series(list(x))

    rows = docs if out in docs.columns else docs.withColumn(out, F.lit(None).cast("array<float>"))
    given, open_ = rows.where(F.col(out).isNotNull()), rows.where(F.col(out).isNull())
    known = cache if cache is not None else docs.sparkSession.createDataFrame([], "text_md5 string, vector array<float>")
    fresh = cache_misses(open_, known, text_col).select("text_md5", run("text").alias("vector"))
    table = known.select("text_md5", F.col("vector").cast("array<float>").alias("vector")).dropDuplicates(["text_md5"]).unionByName(fresh)
    filled = open_.drop(out).withColumn("text_md5", F.md5(F.col(text_col).cast("binary"))).join(table, "text_md5", "left").withColumnRenamed("vector", out).drop("text_md5")
    return given.unionByName(filled.select(*given.columns))
