"""SimHash near-duplicates (operator 4).

simhash(): fingerprints of 64 bits link at `radius` or fewer differing bits, an exact search. Equal fingerprints become one row first. The bits are
shared out to radius + k blocks; two fingerprints that link agree in k whole blocks at least, so fingerprints are dealt by (choice of k blocks,
their bits) and every link lies in some such group: an exact cover, not a sample. k grows with the table, so that groups don't.
A group is cut into tiles by population count, and a population count with too many fingerprints further by a hash, so that no tile grows
with its group. Tiles are compared in numpy by exclusive-or and bit counts; tile pairs whose population
counts differ by more than the radius are skipped, since their fingerprints differ by at least as many bits. Each tile
pair returns a spanning forest of its links, never all pairs. Components come from contraction.

near_texts(): texts link whose sets of word shingles are alike by `similarity`, an estimate from fingerprints of WIDE bits: two sets at Jaccard index s differ
in a share acos(2s / (1 + s)) / pi of the bits. Such fingerprints are too far apart for a cover, so documents meet by least hashes of their shingles,
BANDS keys of ROWS least hashes each; inside a key's group the fingerprints are compared as above.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import component_ids, connected_components, dropped, kept, release, written
from .substring_dedup import WordHashes, grams

SEED = 42
#: Fingerprints of a (band, bits) group that are compared in one task; larger groups are cut into tiles of about TILE.
TILE = 4_096
CHUNK = 1_024
#: Fingerprints that a (blocks, bits) group of random fingerprints has at most before keys take one block more.
PER_GROUP = 64
#: Rows of a cell that near_texts() compares in one go.
NEAR_TILE = 1_024
#: Of near_texts(): bits of a fingerprint, keys of a text, least hashes of a key. Two texts at Jaccard index 0.8 share a key with probability 0.995.
WIDE, BANDS, ROWS = 512, 10, 4
#: Rows of a large group that each of its tiles has besides its own, about.
PIVOTS = 16


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Bit k is set where over half of the shingles' XXH64 have it; shingles count as often as they stand there."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total = np.zeros(64, np.int64)
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist(), strict=True)], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """docs -> (id, fp): the fingerprint as a signed 64-bit number, one row per input row; null or wordless texts have 0."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def band_masks(radius: int, k: int = 1) -> list[int]:
    """Masks of each choice of k blocks, of radius + k blocks that share out the 64 bits, interleaved."""
    blocks = [sum(1 << i for i in range(b, 64, radius + k)) for b in range(radius + k)]
    return [sum(c) for c in combinations(blocks, k)]


def blocks_for(n: int, radius: int) -> int:
    """k such that n random fingerprints make groups of PER_GROUP at most."""
    return next((k for k in range(1, 64 - radius) if n >> (64 * k // (radius + k)) <= PER_GROUP), 1)


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links inside a, or between a and b. Both are sorted by population count."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    right = a if b is None else b
    pa, pr = np.bitwise_count(a), np.bitwise_count(right)
    for i in range(0, len(a), CHUNK):
        x, px = a[i : i + CHUNK], pa[i : i + CHUNK].astype(int)
        for j in range(i if b is None else 0, len(right), CHUNK):
            y, py = right[j : j + CHUNK], pr[j : j + CHUNK].astype(int)
            if px[0] - py[-1] > radius or py[0] - px[-1] > radius:
                continue
            r, c = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            for u, v in zip(x[r].tolist(), y[c].tolist(), strict=True):
                if u != v and (p := find(u)) != (q := find(v)):
                    parent[p] = q
                    out.append((u, v))
    return out


def links(fps: DataFrame, radius: int = 4, tile: int = TILE, k: int | None = None) -> DataFrame:
    """fps(fp), distinct -> (u, v): links whose components are those of all pairs at `radius` or fewer differing bits."""
    masks = band_masks(radius, blocks_for(fps.count(), radius) if k is None else k)
    banded = fps.select("fp", F.bit_count("fp").alias("pop"), F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])).alias("band", "bits"))
    # a group over `tile` is cut by population count, and a population count over it by a hash
    sizes = written(banded.groupBy("band", "bits", "pop").agg(F.count("*").alias("n")), "sizes")
    large = sizes.groupBy("band", "bits").agg(F.sum("n").alias("all")).where(F.col("all") > tile)
    large = written(sizes.join(large, ["band", "bits"]).select("band", "bits", "pop", F.ceil(F.col("n") / tile).cast("int").alias("cuts")), "large")
    small = banded.join(F.broadcast(large.select("band", "bits").distinct()) if large.count() < 50_000 else large.select("band", "bits").distinct(), ["band", "bits"], "left_anti")

    def edges(a, b):
        import pandas as pd

        got = forest(a, b, radius)
        u = np.array([x for x, _ in got], np.uint64).view(np.int64)
        v = np.array([y for _, y in got], np.uint64).view(np.int64)
        return pd.DataFrame({"u": u, "v": v})

    def in_order(x):
        x = x.to_numpy(np.int64).view(np.uint64)
        return x[np.argsort(np.bitwise_count(x), kind="stable")]

    def whole(batches):
        """Sorted by group, and there by population count; a group may go over from one batch to the next."""
        import pyarrow as pa

        kept, key = [], None
        for b in batches:
            bits, band = b.column(2).to_numpy(), b.column(1).to_numpy()
            fp = b.column(0).to_numpy().view(np.uint64)
            cuts = np.flatnonzero((bits[1:] != bits[:-1]) | (band[1:] != band[:-1])) + 1
            out = []
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bits)], strict=True):
                if to == at:
                    continue
                if key != (bits[at], band[at]):
                    out += forest(np.concatenate(kept), None, radius) if sum(map(len, kept)) > 1 else []
                    kept, key = [], (bits[at], band[at])
                kept.append(fp[at:to])
            yield table(pa, out)
        if sum(map(len, kept)) > 1:
            yield table(pa, forest(np.concatenate(kept), None, radius))

    def table(pa, got):
        cols = [np.array([x[k] for x in got], np.uint64).view(np.int64) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u", "v"])

    dealt = small.repartition("band", "bits").sortWithinPartitions("band", "bits", "pop").select("fp", "band", "bits")
    found = dealt.mapInArrow(whole, "u long, v long")
    if large.isEmpty():
        return found
    tiles = large.select("band", "bits", "pop", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    a, b = (tiles.select("band", "bits", F.col("pop").alias(f"p{k}"), F.col("cut").alias(f"c{k}")) for k in (1, 2))
    pairs = a.join(b, ["band", "bits"]).where(f"struct(p1, c1) <= struct(p2, c2) and p2 - p1 <= {radius}").withColumn("pair", F.xxhash64("band", "bits", "p1", "c1", "p2", "c2"))
    at = banded.join(large, ["band", "bits", "pop"]).withColumn("cut", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    sides = [pairs.select("pair", "band", "bits", F.col(f"p{k}").alias("pop"), F.col(f"c{k}").alias("cut"), F.lit(k).alias("side")) for k in (1, 2)]
    sides[1] = sides[1].join(pairs.where("p1 = p2 and c1 = c2").select("pair"), "pair", "left_anti")

    def two(key, x):
        left, right = in_order(x.fp[x.side == 1]), in_order(x.fp[x.side == 2])
        return edges(left, right if len(right) else None)

    far = at.join(sides[0].unionByName(sides[1]), ["band", "bits", "pop", "cut"]).select("pair", "side", "fp")
    return found.unionByName(far.groupBy("pair").applyInPandas(two, "u long, v long"))


def simhash(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """docs -> (id, fp, component): one row per input row, component the least id of the fingerprints reachable.

    Null and wordless texts have fingerprint 0, linked like any other. A null id keeps its row; it counts in no
    component's least id, and its component is null if only null ids are reachable. Repeated rows repeat.
    """
    spark = docs.sparkSession
    each = written(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    least = written(each.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = connected_components(links(least.select("fp"), radius))
    named = written(component_ids(least.withColumnRenamed("fp", "node"), roots, "least").select(F.col("node").alias("fp"), "component"), "named")
    dropped(least, roots)
    release(spark)
    return each.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component")


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing step of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEPS = np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def sketch(text: str | None, shingle: int, words: WordHashes) -> tuple[bytes, np.ndarray]:
    """A text's wide fingerprint, and its keys: those of the set of its shingles, of all its words if they are fewer; of nothing if there are none."""
    w = (text or "").encode().lower().split()
    if w:
        h = np.unique(grams(words.of(w), min(shingle, len(w)), 61))
    else:
        h = np.zeros(1, np.uint64)
    ones = np.zeros(WIDE, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1 << 13):
        part = h[at : at + (1 << 13), None]
        bits = np.unpackbits(mixed(part + _STEPS[None, : WIDE // 64]).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.uint16)
        least = np.minimum(least, mixed(part ^ _STEPS[None, : BANDS * ROWS] * np.uint64(3)).min(0))
    keys = mixed((least.reshape(BANDS, ROWS) * _STEPS[None, :ROWS]).sum(1, dtype=np.uint64) + _STEPS[:BANDS])
    return np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), keys.view(np.int64)


def wide_radius(similarity: float) -> int:
    """Differing bits up to which two texts link: what `similarity` leads to one expects, and a standard deviation for chance."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(WIDE * p + np.sqrt(WIDE * p * (1 - p)))


def spanning(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows of x, (n, words): a row that is reached is compared with those that are not yet, so that a
    group in which all are near its first costs one comparison a row. Rows are in order of population count, which bounds the rows to compare."""
    pop = np.bitwise_count(x).sum(1, dtype=np.int64)
    rest = np.argsort(pop, kind="stable")
    out: list = []
    while len(rest):
        found, rest = rest[:1], rest[1:]
        while len(found) and len(rest):
            some, found = found[:64], found[64:]
            p = pop[rest]
            a, b = np.searchsorted(p, pop[some].min() - radius, "left"), np.searchsorted(p, pop[some].max() + radius, "right")
            got = []
            for c in range(a, b, CHUNK):
                near = rest[c : min(b, c + CHUNK)]
                hit = np.bitwise_count(x[some][:, None, :] ^ x[near][None, :, :]).sum(2, dtype=np.uint16) <= radius
                k = np.flatnonzero(hit.any(0))
                out += zip(some[hit[:, k].argmax(0)].tolist(), near[k].tolist(), strict=True)
                got.append(c + k)
            at = np.concatenate(got) if got else np.zeros(0, int)
            found, rest = np.concatenate((found, rest[at])), np.delete(rest, at)
    return out


def near_texts(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", tile: int = NEAR_TILE) -> DataFrame:
    """docs -> (id, component): one row per input row, component the least id of the texts reachable by links of `similarity` or more.

    Null and wordless texts are alike. Texts of fewer words than a shingle are alike only if their words are the same. A null id keeps its row; it counts in
    no component's least id, and its component is null if only null ids are reachable. Repeated rows repeat; an empty table gives none.
    """
    spark, radius = docs.sparkSession, wide_radius(similarity)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa

        words = kept(("hashes",), WordHashes)
        for b in batches:
            got = [sketch(t.as_py(), shingle, words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f for f, _ in got], pa.binary()), pa.array([k for _, k in got], pa.list_(pa.int64()))], ["id", "fp", "keys"])

    each = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp binary, keys array<bigint>")
    each = written(each.withColumn("node", F.unhex(F.md5("fp"))), "sketches")
    texts = written(each.groupBy("node").agg(F.min("id").alias("least"), F.min("fp").alias("fp"), F.min("keys").alias("keys")), "texts")
    keyed = texts.select("node", F.explode("keys").alias("key"))
    sizes = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("cuts", F.ceil(F.col("n") / tile).cast("int")), "sizes")
    # only texts that meet others carry their fingerprints on
    meet = written(keyed.join(sizes, "key").join(texts.select("node", "fp"), "node"), "meet")
    cut = F.pmod(F.xxhash64("node", F.lit(9)), F.col("cuts")).cast("int")
    pivot = (F.col("cuts") > 1) & (F.pmod(F.xxhash64("node", F.lit(8)), F.col("n")) < PIVOTS)
    cells = F.when(pivot, F.sequence(F.lit(0), F.col("cuts") - 1)).otherwise(F.array(cut))
    edges = written(compared(meet.select("key", F.explode(cells).alias("a"), F.lit(0).alias("b"), "node", "fp"), radius), "near")
    large = meet.where("cuts > 1")
    if not large.isEmpty():
        # most of a large group has one root by now; the others are compared with all of it, and no two rows of that root
        roots = connected_components(edges)
        rooted = written(large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "large")
        counts = rooted.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.sum("n").alias("all"), F.max("n").alias("n0"))
        counts = counts.where("n0 < all").select("key", "most", F.ceil(F.col("n0") / tile).cast("int").alias("c0"), F.ceil((F.col("all") - F.col("n0")) / tile).cast("int").alias("c1"))
        other = F.col("root") != F.col("most")
        # tiles of the others come first, then those of the most frequent root
        mine = F.when(other, F.pmod(F.xxhash64("node", F.lit(9)), F.col("c1"))).otherwise(F.col("c1") + F.pmod(F.xxhash64("node", F.lit(9)), F.col("c0"))).cast("int")
        far = rooted.join(written(counts, "counts"), "key").withColumns({"mine": mine, "to": F.when(other, F.col("c1") + F.col("c0")).otherwise(F.col("c1"))})
        far = far.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("to") - 1)))
        more = compared(far.select("key", F.least("mine", "with").alias("a"), F.greatest("mine", "with").alias("b"), "node", "fp"), radius)
        edges = edges.unionByName(written(more, "near"))
    roots = connected_components(edges)
    named = written(component_ids(texts.select("node", "least"), roots, "least").select("node", "component"), "named")
    dropped(texts, sizes, meet, roots)
    release(spark)
    return each.join(named, "node").select(F.col("id").alias(id_col), "component")


def compared(cells: DataFrame, radius: int) -> DataFrame:
    """cells(key, a, b, node, fp) -> (u, v): a spanning forest of the links inside each (key, a, b)."""

    def run(batches):
        """Sorted by cell; a cell may go over from one batch to the next."""
        import pyarrow as pa

        key, nodes, fps = None, [], []

        def ended():
            x = np.frombuffer(b"".join(fps), np.uint64).reshape(len(fps), -1)
            got = spanning(x, radius) if len(fps) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[e[k]] for e in got], pa.binary()) for k in (0, 1)], ["u", "v"])

        for b in batches:
            for k, a, c, node, fp in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if (k, a, c) != key:
                    if len(fps) > 1:
                        yield ended()
                    key, nodes, fps = (k, a, c), [], []
                nodes.append(node)
                fps.append(fp)
        if len(fps) > 1:
            yield ended()

    return cells.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(run, "u binary, v binary")
