"""Where trees are kept: Parquet folders, JSON files, SQL tables. Each has load() and save(state)."""

from __future__ import annotations

import json
import os
import sqlite3
import uuid
from pathlib import Path
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.tree import ITEMS, NODES, REMOVED, RETIRED, Branch, tree_from_dict, tree_to_dict
from .shared import folder_of, read_table, write_table

@runtime_checkable
class TreeLoader(Protocol):
    """Something that a tree, or its state, comes from; None if there is none yet."""

    def load(self) -> Branch | dict | None: ...


@runtime_checkable
class TreePersister(Protocol):
    """K1: something that a tree, or its state, goes to."""

    def save(self, state: Any) -> None: ...


@runtime_checkable
class TreeReconciler(Protocol):
    """Makes the tree to go on with from the one that holds and, if there is one, what can be used again."""

    def reconcile(self, ground_truth: TreeLoader, reusable: TreeLoader | None = None, *, embedder: Any = None, config: Any = None) -> Any: ...


class DefaultTreeReconciler:
    """What holds, as it is."""

    def reconcile(self, ground_truth: TreeLoader, reusable: TreeLoader | None = None, *, embedder: Any = None, config: Any = None) -> Any:
        return ground_truth.load()


TABLES = {"items": ITEMS, "nodes": NODES}


class ParquetState:
    """K8: tables that are written once, and manifests that name those of a version.

    A commit writes a manifest under a name of its own and renames it to the next number, which fails if that is taken; so there is always a whole
    version to load, and two writers can't overwrite each other. Tables and manifests older than the version before last are then deleted.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _listed(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def _numbers(self) -> list[int]:
        return [int(n[9:-5]) for n in self._listed("manifests") if n.startswith("manifest-") and n.endswith(".json")]

    def _manifest(self, number: int) -> dict:
        stream = self.fs.open(self._path(f"manifests/manifest-{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        """df as a table in this state's folder; a commit names it, or it goes."""
        return write_table(df, f"{self.path}/data/{what}-{uuid.uuid4().hex}")

    def load(self) -> dict | None:
        numbers = self._numbers()
        if not numbers:
            return None
        found = self._manifest(max(numbers))
        table = lambda name, schema: None if name is None else read_table(self.spark, f"{self.path}/data/{name}", schema)
        segments = [(v, table(n, ITEMS)) for v, n in found["segments"]]
        return found["meta"] | {"segments": segments} | {k: table(found["tables"].get(k), s) for k, s in (("nodes", NODES), ("retired", RETIRED), ("removed", REMOVED))}

    def save(self, state: dict) -> None:
        """A state as other stores take it: items and nodes in whole."""
        self.commit({k: v for k, v in state.items() if k not in TABLES}, [(state.get("items_version", 0), state["items"])], {"nodes": state["nodes"]})

    def commit(self, meta: dict, segments: list[tuple[int, DataFrame]], tables: dict[str, DataFrame | None]) -> None:
        def name(t: DataFrame | None, what: str) -> str | None:
            if t is None:
                return None
            at = folder_of(t) or ""
            return (at if at.startswith(f"{self.path}/data/") else folder_of(self.keep(t, what))).rsplit("/", 1)[1]

        found = {"meta": meta, "segments": [[v, name(t, "items")] for v, t in segments], "tables": {k: name(t, k) for k, t in tables.items()}}
        numbers = self._numbers()
        number = max(numbers, default=0) + 1
        draft, last = self._path(f"manifests/draft-{uuid.uuid4().hex}"), self._path(f"manifests/manifest-{number:012d}.json")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps(found).encode()))
        out.close()
        if self.fs.exists(last) or not self.fs.rename(draft, last):
            raise RuntimeError(f"version {number} of {self.path} was written by another")
        # what neither this version nor the one before names
        used = {found["tables"][k] for k in found["tables"]} | {n for _, n in found["segments"]}
        if numbers:
            before = self._manifest(max(numbers))
            used |= set(before["tables"].values()) | {n for _, n in before["segments"]}
        for n in self._listed("data"):
            if n not in used:
                self.fs.delete(self._path(f"data/{n}"), True)
        for n in numbers:
            if n < max(numbers):
                self.fs.delete(self._path(f"manifests/manifest-{n:012d}.json"), False)


def _plain(state: dict) -> dict:
    """For interchange: rows as lists, on the driver, so only for trees of a size that a JSON file suits."""
    return {k: ([r.asDict(True) for r in v.collect()] if isinstance(v, DataFrame) else v) for k, v in state.items()}


def _frames(spark: SparkSession, d: dict) -> dict:
    return d | {t: spark.createDataFrame([tuple(r.get(c.split()[0]) for c in s.split(", ")) for r in d.get(t, [])], s) for t, s in TABLES.items()}


def pack_state(state: Any) -> dict:
    if isinstance(state, Branch):
        return {"kind": "branch", "tree": tree_to_dict(state)}
    return {"kind": "materialized_tree_state", "state": _plain(state)}


def unpack_state(spark: SparkSession, d: dict) -> Any:
    """Wrapped or bare trees, wrapped states, or the data as they are."""
    if d.get("kind") == "materialized_tree_state":
        return _frames(spark, d["state"])
    if d.get("kind") == "branch":
        return tree_from_dict(d)
    return d


class JsonState:
    """K2, K3: a file, replaced in one step."""

    def __init__(self, spark: SparkSession, path: str, wrapped: bool = True):
        self.spark, self.path, self.wrapped = spark, Path(path), wrapped

    def load(self) -> Any:
        return unpack_state(self.spark, json.loads(self.path.read_text(encoding="utf-8"))) if self.path.exists() else None

    def save(self, state: Any) -> None:
        d = pack_state(state)
        self.path.parent.mkdir(parents=True, exist_ok=True)
        tmp = self.path.with_name(f".{self.path.name}.{uuid.uuid4().hex}")
        with tmp.open("w", encoding="utf-8") as f:
            json.dump(d if self.wrapped or "tree" not in d else d["tree"], f, ensure_ascii=False)
            f.flush()
            os.fsync(f.fileno())
        tmp.replace(self.path)


class SQLiteState:
    """One row per key in a table (cache_key, kind, payload), replaced in one transaction."""

    def __init__(self, spark: SparkSession, path: str, cache_key: str = "default", table: str = "tree_cache"):
        self.spark, self.path, self.key, self.table = spark, path, cache_key, table
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        with self._db() as db:
            db.execute(f'create table if not exists "{table}" (cache_key text primary key, kind text, payload text)')

    def _db(self) -> sqlite3.Connection:
        return sqlite3.connect(self.path)

    def load(self) -> Any:
        with self._db() as db:
            row = db.execute(f'select payload from "{self.table}" where cache_key = ?', (self.key,)).fetchone()
        return unpack_state(self.spark, json.loads(row[0])) if row else None

    def save(self, state: Any) -> None:
        d = pack_state(state)
        with self._db() as db:
            db.execute(f'delete from "{self.table}" where cache_key = ?', (self.key,))
            db.execute(f'insert into "{self.table}" values (?, ?, ?)', (self.key, d["kind"], json.dumps(d, ensure_ascii=False)))


def content_from(rows: DataFrame, id_column: str, text_column: str, metadata_columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Any table, file or JDBC source as content(content_id, text, metadata); predicate and columns go down to the scan."""
    rows = rows.where(where) if where else rows
    others = metadata_columns if metadata_columns is not None else [c for c in rows.columns if c not in (id_column, text_column)]
    meta = F.to_json(F.struct(*others)) if others else F.lit("{}")
    return rows.select(F.col(id_column).cast("string").alias("content_id"), F.col(text_column).alias("text"), meta.alias("metadata"))


def contents_to_table(content: DataFrame, path: str) -> None:
    """K5: (id, text, metadata) of each content, replacing what was there."""
    content.select(F.col("content_id").alias("id"), "text", "metadata").write.mode("overwrite").parquet(path)
