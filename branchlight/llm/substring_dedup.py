"""Removal of repeated word windows across documents, by seed and extend (operator 2).

Seeds: each run of `window` consecutive words is represented by the least hash among its `k`-word grams, its
winnowed anchor. Equal windows have equal anchors, so a window that stands in two documents has an anchor that does:
only windows whose anchor is shared can repeat. Extension: the windows around an anchor that stand for it make a run, the anchor
extended both ways as far as it goes. Equal runs are matched first, each to the least document that has it, which settles most copied
text; only the first of equal runs, and only where an anchor has runs that differ, is then matched window by
window. That is whole: a window that repeats has a run that repeats, or its first runs are both among those compared.
Covered windows that adjoin make the maximal repeats that are cut out.

All groups ask only for a least and a greatest id, so they combine before the shuffle and no group is ever gathered.
Joins back to the rows are equi-joins of two written tables, which adaptive execution splits when a key is hot. The
texts are shuffled twice, by id; written tables go once nothing reads them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import dropped, kept, release, written

MEMO = 500_000
#: Windows in a run at most; longer runs are cut.
RUN = 200


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


#: A factor for each place in a run.
PLACES = _odd(RUN, 41)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        h = xxhash.xxh64_digest(word, 11)
        if len(self) >= MEMO:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64)


def grams(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive word hashes. Groups also have the anchor's hash in their key, 128 bits in all."""
    n = len(h) - k + 1
    total = np.zeros(n, np.uint64)
    for j, c in enumerate(_odd(k, seed)):
        total += h[j : j + n] * c
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def anchors(h: np.ndarray, window: int, k: int) -> np.ndarray:
    """The anchor of each window."""
    g = grams(h, k, 21)
    n, w = len(h) - window + 1, window - k + 1
    least = g[:n].copy()
    for j in range(1, w):
        np.minimum(least, g[j : j + n], out=least)
    return least


def run_hashes(w: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run: of all its n windows w[first : first + n], each by its place there. The first and the last don't hold all words of a long run."""
    mixed = w * PLACES[np.arange(len(w)) - np.repeat(first, n)]
    mixed ^= mixed >> np.uint64(32)
    return np.add.reduceat(mixed * np.uint64(0x9E3779B97F4A7C15), first) + n.astype(np.uint64)


def substring_dedup(docs: DataFrame, *, window: int = 13, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (id, n_words, n_removed, kept, spans), one row per input row.

    A word goes if a window of `window` words that covers it also starts in a row with a smaller id; windows are those of
    the input. kept: the other words joined by a space. spans: [from, to) in words of each maximal repeat that went,
    flat. Null texts have no words. Rows of null id neither lose words nor make others lose them; rows
    of one id don't make each other lose words. Repeated rows give repeated results; an empty table gives none.
    """
    assert 0 < k <= window
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    valid = rows.where("id is not null and text is not null")

    def anchored(batches):
        import pyarrow as pa

        memo = kept(("hashes",), WordHashes)
        for b in batches:
            index, found = [], []
            for i, t in enumerate(b.column(1)):
                words = t.as_py().encode().split()
                if len(words) >= window:
                    a = np.unique(anchors(memo.of(words), window, k))
                    index.append(np.full(len(a), i))
                    found.append(a)
            if found:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(index))), pa.array(np.concatenate(found).view(np.int64))], ["id", "anchor"])

    seeds = written(valid.mapInArrow(anchored, f"id {kind}, anchor long"), "anchors")
    shared = written(seeds.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("anchor"), "shared")
    release(spark)
    per_doc = written(seeds.join(shared, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("anchors")), "seeds")
    dropped(seeds, shared)
    release(spark)

    def extended(batches):
        import pyarrow as pa

        memo = kept(("hashes",), WordHashes)
        for b in batches:
            index, cols, wins, sizes = [], [[], [], []], [], []
            for i in range(b.num_rows):
                text, seeds = b.column(1)[i].as_py(), np.sort(b.column(2)[i].values.to_numpy().view(np.uint64))
                words = text.encode().split()
                if len(words) < window:
                    continue
                h = memo.of(words)
                a = anchors(h, window, k)
                at = np.flatnonzero(seeds[np.minimum(np.searchsorted(seeds, a), len(seeds) - 1)] == a)
                if not len(at):
                    continue
                w = grams(h, window, 31)[at]
                new = np.concatenate(([True], (np.diff(at) != 1) | (a[at][1:] != a[at][:-1])))
                first = np.flatnonzero(new)
                first = np.flatnonzero(new | ((np.arange(len(at)) - first[np.cumsum(new) - 1]) % RUN == 0))
                n = np.diff(np.concatenate((first, [len(at)])))
                index.append(np.full(len(first), i))
                one = run_hashes(w, first, n)
                mark = at[first].astype(np.int64) | (n.astype(np.int64) << 32) | (row_tag(text) << 40)
                for col, x in zip(cols, (a[at][first], one, mark), strict=True):
                    col.append(x.view(np.int64))
                wins.append(w)
                sizes.append(n)
            if index:
                offs = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(wins).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(index))), *(pa.array(np.concatenate(c)) for c in cols), lists], ["id", "anchor", "one", "mark", "wins"])

    runs = written(valid.join(per_doc, "id").select("id", "text", "anchors").mapInArrow(extended, f"id {kind}, anchor long, one long, mark long, wins array<bigint>"), "runs")
    dropped(per_doc)
    release(spark)
    first = written(runs.groupBy("anchor", "one").agg(F.min("id").alias("first"), F.max("id").alias("last")), "first")
    many = written(first.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", F.lit(True).alias("many")), "many")
    of_run = written(first.join(many, "anchor", "left").where("many or first < last").select("anchor", "one", "first", F.coalesce("many", F.lit(False)).alias("many")), "of-run")
    settled = runs.join(of_run, ["anchor", "one"]).where("id > first or many")
    settled = written(settled.select("id", "anchor", "mark", (F.col("id") > F.col("first")).alias("covered"), F.expr("if(id > first, null, wins)").alias("wins")), "settled")
    dropped(runs, first, many, of_run)
    release(spark)
    windows = settled.where("not covered").select("id", "anchor", "mark", F.posexplode("wins").alias("k", "win")).select("id", "anchor", "win", F.expr(f"(mark & {~(0xFF << 32)}L) + k + {1 << 32}L").alias("mark"))
    least = written(windows.groupBy("anchor", "win").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last"), "least")
    covered = windows.join(least, ["anchor", "win"]).where("first < id").select("id", "mark").unionByName(settled.where("covered").select("id", "mark"))
    covered = written(covered.groupBy("id").agg(F.collect_list("mark").alias("marks")), "marks")
    dropped(settled, least)
    release(spark)

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            out = [[], [], [], []]
            for i in range(b.num_rows):
                text, marks = b.column(1)[i].as_py(), b.column(2)[i]
                words = (text or "").encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                if marks.is_valid and len(words) >= window:
                    m = marks.values.to_numpy()
                    m = m[(m >> 40) == row_tag(text)]
                    at = m & 0xFFFFFFFF
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + ((m >> 32) & 0xFF) + window - 1, -1)
                covered = np.cumsum(gone)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
                kept, at = [], 0
                for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    kept += words[at:s]
                    at = e
                kept += words[at:]
                for col, x in zip(out, (len(words), len(words) - len(kept), b" ".join(kept).decode(), edge), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.list_(pa.int64()))], ["id", "n_words", "n_removed", "kept", "spans"])

    schema = f"id {kind}, n_words long, n_removed long, kept string, spans array<bigint>"
    whole = valid.join(covered, "id", "left").select("id", "text", "marks").mapInArrow(cut, schema)
    rest = rows.where("id is null or text is null").select("id", "text", F.lit(None).cast("array<bigint>").alias("marks")).mapInArrow(cut, schema)
    return whole.unionByName(rest).withColumnRenamed("id", id_col)


def row_tag(text: str) -> int:
    """Tells rows of one id apart."""
    import xxhash

    return xxhash.xxh32_intdigest(text.encode()) >> 9
