"""Folders as content, and trees as folders.

Plans are DataFrames; files are touched on the driver only, once, in plan order, never inside a task that Spark may repeat.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import warnings
from collections.abc import Callable, Sequence
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.numbers import numbered_in
from .shared import written

CONTENT = "content_id string, text string, metadata string, path array<int>"
BRANCH = "node_id string, parent_id string, ordinal int, depth int, path array<int>, label string, metadata string"
_MD5 = re.compile(r"[0-9a-fA-F]{32}")


class MissingNodeFileError(FileNotFoundError):
    """A content node has no file, and the policy is to raise."""


def deduped(rows: DataFrame, parent: list[str], name: str, order: list[str], out: str) -> DataFrame:
    """K6h: equal names under one parent get -2, -3 and so on, in the given order, passing over names that are taken by then.

    Counting is enough unless a numbered name is another's own; such names, without their numbers, are few, and each is gone through in order in a task of its own.
    """
    counted = numbered_in(rows, [*parent, name], order, "__r").withColumn(out, F.when(F.col("__r") == 1, F.col(name)).otherwise(F.concat(name, F.lit("-"), F.col("__r")))).drop("__r")
    counted = counted.withColumn("__stem", F.regexp_replace(name, "(-[0-9]+)+$", ""))
    keys = [*parent, "__stem"]
    odd = written(counted.groupBy(*keys, out).agg(F.count("*").alias("n")).where("n > 1").select(*keys).distinct(), "odd-names")
    if odd.isEmpty():
        return counted.drop("__stem")
    same = lambda how: counted.alias("c").join(odd.alias("o"), [F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys], how)

    def again(table: pd.DataFrame) -> pd.DataFrame:
        table, used, names = table.sort_values(order, ignore_index=True), {None}, []
        turns: dict = {}
        for n in table[name]:
            new, turn = n, turns.get(n, 1)
            while new in used and n is not None:
                turn += 1
                new = f"{n}-{turn}"
            turns[n] = turn
            used.add(new)
            names.append(new)
        table[out] = names
        return table

    return same("left_anti").unionByName(same("left_semi").groupBy(*keys).applyInPandas(again, counted.schema)).drop("__stem")


def plan_actions(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """K6b-K6e: nodes(seq, md5, ...), files(md5, path) -> nodes with path and action: the first node of a file moves it, later ones copy, others miss it."""
    first = nodes.where("md5 is not null").groupBy(F.lower("md5").alias("md5")).agg(F.min("seq").alias("__first"))
    rows = nodes.withColumn("md5", F.lower("md5")).join(files.withColumn("md5", F.lower("md5")), "md5", "left").join(first, "md5", "left")
    return rows.withColumn("action", F.when(F.col("path").isNull(), "missing").when(F.col("seq") == F.col("__first"), "move").otherwise("copy")).drop("__first")


def _hidden(parts: Sequence[str]) -> bool:
    return any(p.startswith(".") for p in parts)


def read_folder(spark: SparkSession, root: str, *, include_suffixes: Sequence[str] | None = None, encoding: str = "utf-8", include_hidden: bool = False, text_generator: Callable[[str, str], str] | None = None, additional_metadata_derivers: Sequence[Callable[[str, str], dict]] = ()) -> tuple[DataFrame, DataFrame] | None:
    """(content, branches) of a folder, None if it isn't there.

    The folder is listed on the driver, since Spark's listing drops names that begin with _ or a dot and empty folders; files are read on the
    executors, so the folder must be mounted under the same path on all of them, as a network file system is. Texts in a store that only Spark reads come by
    spark.read and content_from(). Files that don't decode are left out. Ids are MD5 sums of the bytes.
    """
    if callable(additional_metadata_derivers):
        raise TypeError("additional_metadata_derivers must be a sequence of functions")
    top = Path(root)
    if not top.is_dir():
        return None
    suffixes = {s.lower() for s in include_suffixes} if include_suffixes else None
    found: list[tuple[str, list[int]]] = []
    branches = [(".", None, 0, 0, [], top.name, json.dumps({"path": str(top), "relative_path": "."}))]

    def walk(folder: Path, path: list[int]) -> None:
        n = 0
        for p in sorted(folder.iterdir(), key=lambda p: p.name):
            rel = p.relative_to(top)
            if not include_hidden and _hidden(p.relative_to(folder).parts):
                continue
            if p.is_dir():
                parent = str(rel.parent)
                branches.append((str(rel), parent, n, len(path) + 1, [*path, n], p.name, json.dumps({"path": str(p), "relative_path": str(rel)})))
                walk(p, [*path, n])
                n += 1
            elif p.is_file() and (suffixes is None or p.suffix.lower() in suffixes):
                found.append((str(rel), [*path, n]))
                n += 1

    walk(top, [])
    base, derivers = str(top), list(additional_metadata_derivers)

    def load(batches):
        import pyarrow as pa

        for b in batches:
            out = [[], [], [], []]
            for rel, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                file = os.path.join(base, rel)
                with open(file, "rb") as f:
                    data = f.read()
                try:
                    raw = re.sub("\r\n?", "\n", data.decode(encoding))
                except UnicodeDecodeError:
                    continue
                text = text_generator(file, raw) if text_generator else raw
                if not isinstance(text, str):
                    raise TypeError("text_generator must return a string")
                digest = hashlib.md5(data).hexdigest()
                meta: dict[str, Any] = {"path": file, "relative_path": rel, "filename": os.path.basename(rel), "version": digest}
                for derive in derivers:
                    more = derive(file, raw)
                    if not isinstance(more, dict):
                        raise TypeError("a metadata deriver must return a mapping")
                    meta |= more
                for col, x in zip(out, (digest, text, json.dumps(meta, ensure_ascii=False), path), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in out[:3]), pa.array(out[3], pa.list_(pa.int32()))], ["content_id", "text", "metadata", "path"])

    files = spark.createDataFrame(found, "rel string, path array<int>")
    return files.mapInArrow(load, CONTENT), spark.createDataFrame(branches, BRANCH)


def safe_name(name: str) -> str:
    t = re.sub(r"\s+", " ", re.sub(r'[\\/:*?"<>|#\[\]^\n\r\t]+', " ", name)).strip(". ")
    return t or "untitled"


def unique_path(target: Path, reserved: set[Path], own: Path | None = None) -> Path:
    """K6i: target, or with -2, -3 and so on where it is taken."""
    n, at = 1, target
    while at in reserved or (at.exists() and at != own):
        n += 1
        at = target.with_name(f"{target.stem}-{n}{target.suffix}")
    return at


def write_folder(tree: dict, root: str, *, include_suffixes: Sequence[str] | None = None, encoding: str = "utf-8", include_hidden: bool = False, missing_node_file: str = "skip") -> list[tuple[str, str, str]]:
    """K6: files of root moved and copied into folders named by a tree's labels; (action, source, target) of each file.

    tree is nested: branches {"label", "children"}, contents {"id", "text", "metadata"}. The root's label is no folder. missing_node_file:
    skip with a warning, create a snapshot, or raise.
    """
    if missing_node_file not in ("skip", "create", "raise"):
        raise ValueError(f"missing_node_file must be skip, create or raise, not {missing_node_file!r}")
    top = Path(root)
    top.mkdir(parents=True, exist_ok=True)
    suffixes = {s.lower() for s in include_suffixes} if include_suffixes else None
    at: dict[str, Path] = {}
    for p in sorted(top.rglob("*"), key=lambda p: p.relative_to(top).parts):
        if p.is_file() and (include_hidden or not _hidden(p.relative_to(top).parts)) and (suffixes is None or p.suffix.lower() in suffixes):
            at.setdefault(hashlib.md5(p.read_bytes()).hexdigest(), p)
    done: list[tuple[str, str, str]] = []
    reserved: set[Path] = set()
    moved: dict[str, Path] = {}

    def identity(node: dict) -> str | None:
        meta = node.get("metadata") or {}
        for v in [node["id"], *(meta.get(k) for k in ("md5", "file_md5", "content_md5", "content_id"))]:
            if isinstance(v, str) and _MD5.fullmatch(v):
                return v.lower()
        return None

    def outside(meta: dict, digest: str | None) -> Path | None:
        first = next((meta[k] for k in ("path", "relative_path", "source_path") if meta.get(k)), None)
        p = (top / first) if first else None
        return p if p and digest and p.is_file() and hashlib.md5(p.read_bytes()).hexdigest() == digest else None

    def put(node: dict, folder: Path) -> None:
        meta, digest = node.get("metadata") or {}, identity(node)
        source = moved.get(digest) or at.get(digest) if digest else None
        other = None if source else outside(meta, digest)
        named = next((Path(str(meta[k])).name for k in ("filename", "relative_path", "output_path", "path") if meta.get(k)), None)
        name = safe_name(str(meta.get("new_file_name") or (source or other or Path(named or str(node["id"]))).name))
        action = "move" if source and digest not in moved else "copy" if source or other else "missing"
        if action == "missing":
            if missing_node_file == "raise":
                raise MissingNodeFileError(f"no file for {node['id']}")
            if missing_node_file == "skip":
                warnings.warn(f"no file for {node['id']}", RuntimeWarning, stacklevel=2)
                done.append(("skip", str(node["id"]), ""))
                return
            name = f"{Path(name).stem}.txt"
        target = unique_path(folder / name, reserved, source if action == "move" else None)
        reserved.add(target)
        target.parent.mkdir(parents=True, exist_ok=True)
        if action == "move":
            if source != target:
                shutil.move(source, target)
            moved[digest] = target
        elif action == "copy":
            shutil.copy2(source or other, target)
        else:
            target.write_text(json.dumps({"metadata": meta, "text": node.get("text")}, sort_keys=True, indent=2, ensure_ascii=False, default=str), encoding=encoding)
            action = "create"
        done.append((action, str(source or other or node["id"]), str(target)))

    def branch(node: dict, folder: Path) -> None:
        taken: dict[str, int] = {}
        for i, child in enumerate(node.get("children") or []):
            if "children" in child:
                name = safe_name(child.get("label") or f"topic-{i + 1}")
                taken[name] = taken.get(name, 0) + 1
                while taken[name] > 1 and f"{name}-{taken[name]}" in taken:
                    taken[name] += 1
                own = name if taken[name] == 1 else f"{name}-{taken[name]}"
                taken.setdefault(own, 1)
                branch(child, folder / own)
            else:
                put(child, folder)

    branch(tree, top)
    for p in sorted((p for p in top.rglob("*") if p.is_dir()), key=lambda p: -len(p.parts)):
        if (include_hidden or not _hidden(p.relative_to(top).parts)) and not any(p.iterdir()):
            p.rmdir()
    return done
