"""Benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment (operator 1).

Each test item's n-grams of words that few other items share are its seeds; an item of which most n-grams are common keeps all of them. A
document's n-grams are joined to the seeds; around each place where they meet, the item and the document's words are
aligned locally, so edited, shortened and paraphrased copies score by what is left in order. Scores are shares of an item's own best. Items of fewer than n
words have one seed, all of their words, and are found where these stand together.
The items stand in an index of bounded size, sorted arrays, that every task has; larger benchmarks are taken in blocks of items, one pass over the
documents each, with the same result. Narrow: documents are never shuffled, and a common passage costs only its own rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import kept
from .substring_dedup import grams

TOKEN = re.compile(r"\w+")
#: Bytes of item texts in a block's index.
BLOCK_BYTES = 16 << 20
#: An n-gram that more items have is no seed of those items that have rarer ones.
RARE = 3
MEMO = 600_000


class TokenHashes(dict):
    """A white-space-separated piece's tokens as 8 bytes each."""

    def __missing__(self, piece: bytes) -> bytes:
        import xxhash

        got = b"".join(xxhash.xxh64_digest(t.encode(), 5) for t in TOKEN.findall(piece.decode().lower()))
        if len(self) >= MEMO:
            self.clear()
        if len(piece) <= 64:
            self[piece] = got
        return got

    def of(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, (text or "").encode().split())), np.uint64)


class Index:
    """Items by seed, in arrays: the seeds of each length in ascending order, with item and place."""

    def __init__(self, items: list[tuple], n: int, rare: int = RARE):
        hashes = TokenHashes()
        self.ids, self.tokens = [i for i, _ in items], [hashes.of(t) for _, t in items]
        self.seeds: dict[int, tuple] = {}
        for k in range(1, n + 1):
            mine = [i for i, t in enumerate(self.tokens) if (len(t) >= n if k == n else len(t) == k)]
            if not mine:
                continue
            own = [grams(self.tokens[i], k, 51) for i in mine]
            seed, item, place = np.concatenate(own), np.repeat(np.array(mine, np.int32), [len(g) for g in own]), np.concatenate([np.arange(len(g), dtype=np.int32) for g in own])
            if k == n:
                # how many items have a seed, each counted once
                one = np.unique(np.stack((seed, item.astype(np.uint64))), axis=1)[0]
                known, count = np.unique(one, return_counts=True)
                few = count[np.searchsorted(known, seed)] <= rare
                most = np.bincount(item[few], minlength=len(items)) * 2 >= np.bincount(item, minlength=len(items))
                keep = few | ~most[item]
                seed, item, place = seed[keep], item[keep], place[keep]
            order = np.argsort(seed, kind="stable")
            some = np.zeros(1 << 20, bool)
            some[seed >> np.uint64(44)] = True
            self.seeds[k] = seed[order], item[order], place[order], some

    def hits(self, tokens: np.ndarray) -> dict[int, list[int]]:
        """item -> where in tokens the item would begin, by each seed that they share."""
        out: dict[int, list[int]] = {}
        for k, (seed, item, place, some) in self.seeds.items():
            if len(tokens) < k:
                continue
            g = grams(tokens, k, 51)
            at = np.flatnonzero(some[g >> np.uint64(44)])
            left, right = np.searchsorted(seed, g[at], "left"), np.searchsorted(seed, g[at], "right")
            n = right - left
            if not n.any():
                continue
            ends = np.cumsum(n)
            which = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(left, n)
            begin = np.repeat(at, n) - place[which]
            for i, s in zip(item[which].tolist(), begin.tolist(), strict=True):
                out.setdefault(i, []).append(s)
        return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: the best local score of a and b (match 2, mismatch and gap -1), and where it lies in b, [from, to)."""
    n = len(b)
    score, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    step = np.arange(n + 1)
    best = (0, 0, 0)
    for x in a:
        diag = score[:-1] + np.where(b == x, 2, -1)
        up = score[1:] - 1
        t = np.maximum(diag, up)
        from_ = np.where(diag >= up, start[:-1], start[1:])
        zero = t <= 0
        t = np.where(zero, 0, t)
        from_ = np.where(zero, step[1:], from_)
        # a gap in a: the best of what stands to the left, less 1 a step
        lifted = t + step[1:]
        top = np.maximum.accumulate(lifted)
        where = np.maximum.accumulate(np.where(lifted == top, step[:-1], 0))
        score[1:], start[1:] = top - step[1:], from_[where]
        j = int(score.argmax())
        if score[j] > best[0]:
            best = (int(score[j]), int(start[j]), j)
    return best


def leaks(tokens: np.ndarray, index: Index, n: int, least: float) -> list[tuple[int, float, int, int]]:
    """(item, score, from, to) of each item found in a document's tokens, at its best place."""
    out = []
    for k, begins in index.hits(tokens).items():
        item = index.tokens[k]
        size, slack = len(item), len(item) // 2 + 1
        if size < n:
            out.append((k, 1.0, begins[0], begins[0] + size))
            continue
        spans: list[list[int]] = []
        for s in sorted(begins):
            a, b = max(0, s - slack), min(len(tokens), s + size + slack)
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        best = (0, 0, 0)
        words = np.unique(item)
        for a, b in spans:
            part = tokens[a:b]
            # no alignment has more matches than words in common
            if 2 * int((words[np.minimum(np.searchsorted(words, part), len(words) - 1)] == part).sum()) < least * 2 * size:
                continue
            s, i, j = align(item, part)
            if s > best[0]:
                best = (s, a + i, a + j)
        if best[0] >= least * 2 * size:
            out.append((k, best[0] / (2 * size), best[1], best[2]))
    return out


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, n: int, block_bytes: int):
    """Indexes of at most about block_bytes of item texts each."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    for k in range(blocks):
        yield Index(sorted(((r["item"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).distinct().collect()), key=lambda x: (x[0] is None, str(x[0]), x[1])), n)


def contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = 3, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, benchmark -> (id, item, score, word_from, word_to): each item that a document holds, at its best place.

    score: the alignment's share of the item's score with itself, at least `least`. Words are runs of letters, digits and _,
    compared in lower case. Null texts hold nothing; items with fewer than n words are found where all of them stand together, and items without words nowhere.
    A null id keeps its rows; repeated rows repeat; empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    kinds = rows.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    arrow_item = to_arrow_type(benchmark.schema[item_col].dataType)
    found = None
    for index in blocks_of(benchmark, item_col, item_text_col, n, block_bytes):
        held = spark.sparkContext.broadcast(index)

        def run(batches, held=held):
            import pyarrow as pa

            hashes = kept(("tokens",), TokenHashes)
            for b in batches:
                got = [(i, *x) for i, t in enumerate(b.column(1)) for x in leaks(hashes.of(t.as_py()), held.value, n, least)]
                ids = [held.value.ids[x[1]] for x in got]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([x[0] for x in got], pa.int64())), pa.array(ids, arrow_item), pa.array([x[2] for x in got], pa.float64()), pa.array([x[3] for x in got], pa.int64()), pa.array([x[4] for x in got], pa.int64())], ["id", "item", "score", "word_from", "word_to"])

        part = rows.mapInArrow(run, f"id {kinds[0]}, item {kinds[1]}, score double, word_from long, word_to long")
        found = part if found is None else found.unionByName(part)
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def clean(docs: DataFrame, benchmark: DataFrame, *, n: int = 3, least: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows whose text holds an item, all columns as they were. Null texts stay."""
    for index in blocks_of(benchmark, item_col, item_text_col, n, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.where(~leaked_column(held, n, least, text_col))
    return docs


def leaked_column(held, n: int, least: float, text_col: str):
    def leaked(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = kept(("tokens",), TokenHashes)
        for t in parts:
            yield pd.Series([bool(leaks(hashes.of(x), held.value, n, least)) for x in t], dtype=bool)

    # the annotations are strings here, which pandas_udf can't resolve inside a function
    leaked.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(leaked, "boolean")(F.coalesce(F.col(text_col), F.lit("")))
