"""Splits of vectors into branches: k-means, the fixed and the adaptive rule, and the divisive build of whole trees.

The rule is one function, judge(), which asks for the statistics of a bucketing into k. Small groups answer it from an array in one task, large
groups from sums over all executors, so a group's size decides only where the sums are made, not what is decided.
"""

from __future__ import annotations

import base64
import json
import logging
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..config import TreeConfig
from .aggregates import centroids, nearest

log = logging.getLogger("branchlight.split")
#: Groups with more rows are split by passes over all executors; smaller ones are finished, with all below them, in one task.
LOCAL_MAX = 20_000
#: Large groups that go through a pass together: their centres are broadcast, at most GROUPS * (2 + ... + max_branches) vectors.
GROUPS = 256
#: Rows of a large group from which its first centres are drawn, by a hash. All rows take part in what follows.
SEED_ROWS = 2_000
#: Rows of a large group up to which one task goes through its rounds of k-means, rows of larger ones for each of the tasks that share them, and rows of a step.
ALONE, DEALT, BLOCK = 2_000_000, 200_000, 4_096


def coherence_threshold(depth: Column, least: float, decay: float) -> Column:
    """A node with less dispersion than this isn't split."""
    return F.lit(least) * F.pow(F.lit(decay), depth)


def lloyd(items: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """items(content_id, vector) with center_id after so many assignments; the first is to the seeds themselves."""
    centers = seeds
    for turn in range(rounds):
        found = nearest(items, centers)
        if turn < rounds - 1:
            centers = centroids(found, ["center_id"]).select("center_id", F.col("center_id").alias("ordinal"), "centroid")
    return found


def distinct_rows(x: np.ndarray, most: int) -> int:
    """The number of distinct rows, or `most` if there are at least so many; as a rule the first rows tell."""
    return len(_distinct(x, most))


def _distinct(x: np.ndarray, most: int) -> list[np.ndarray]:
    """The first distinct rows, at most `most`."""
    seen: list[np.ndarray] = []
    for at in range(0, len(x), 256):
        part = np.asarray(x[at : at + 256])
        for one in seen:
            part = part[(part != one).any(1)]
        while len(part):
            seen.append(part[0])
            if len(seen) >= most:
                return seen
            part = part[(part != part[0]).any(1)]
    return seen


def kmeans(x: np.ndarray, k: int, seed: int = 0, max_iter: int = 300, tol: float = 1e-4) -> np.ndarray:
    """Labels by seeded k-means++ and Lloyd's iterations; at most as many clusters as distinct rows. Empty clusters take the farthest row."""
    rng = np.random.default_rng(seed)
    k = distinct_rows(x, k)
    if k < 2:
        return np.zeros(len(x), int)
    x = x - x.mean(0)  # else distances within a narrow group far from zero are lost in rounding, and its rounds and levels don't end
    centers = x[[int(rng.integers(len(x)))]]
    near = ((x - centers[0]) ** 2).sum(1)
    while len(centers) < k:
        tries = rng.choice(len(x), size=2 + int(np.log(k)), p=near / near.sum())
        cost = [np.minimum(near, ((x - x[t]) ** 2).sum(1)) for t in tries]
        best = int(np.argmin([c.sum() for c in cost]))
        near, centers = cost[best], np.vstack([centers, x[tries[best]]])
    limit = tol * float(x.var(0).mean())
    labels, size = None, (x * x).sum(1)[:, None]
    for _ in range(max_iter):
        d = size - 2 * x @ centers.T + (centers * centers).sum(1)[None, :]
        new = d.argmin(1)
        if not np.bincount(new, minlength=k).all():
            for c in range(k):
                if not (new == c).any():
                    new[int(d[np.arange(len(x)), new].argmax())] = c
        moved = np.array([x[new == c].mean(0) if (new == c).any() else centers[c] for c in range(k)])
        shift = float(((moved - centers) ** 2).sum())
        done = labels is not None and (new == labels).all() or shift <= limit
        labels, centers = new, moved
        if done:
            break
    return labels


def buckets(x: np.ndarray, k: int, config: TreeConfig) -> list[np.ndarray]:
    """Row numbers of each cluster, clusters in order of first appearance."""
    args = config.model_args
    labels = kmeans(x, k, int(args.get("random_state") or 0), int(args.get("max_iter", 300)), float(args.get("tol", 1e-4)))
    first = sorted(set(labels.tolist()), key=lambda c: int(np.argmax(labels == c)))
    return [np.flatnonzero(labels == c) for c in first]


def dispersion(x: np.ndarray) -> float:
    return float(np.linalg.norm(x - x.mean(0), axis=1).mean())


@dataclass
class Decision:
    split: bool
    reason: str
    parts: list = field(default_factory=list)
    metrics: dict = field(default_factory=dict)


@dataclass
class Bucketing:
    """What a rule needs to know of a group cut into buckets. parts: what stands for the buckets where the group lives."""

    sizes: list[int]
    dispersions: list[float]
    means: np.ndarray
    parts: list


def judge(n: int, depth: int, config: TreeConfig, parent: Callable[[], float], distinct: Callable[[], int], cut: Callable[[int], Bucketing]) -> list[Decision]:
    """What the configured rule says of a group; the last decision counts, the others are candidates it looked at."""
    if n <= config.leaf_target:
        return [Decision(False, "within_leaf_target", metrics={"leaf_target": config.leaf_target})]
    if config.split_mode == "fixed":
        found = cut(min(config.max_branches, n))
        if len(found.sizes) < 2:
            return [Decision(False, "unsplittable")]
        return [Decision(True, "accept", found.parts, {"k": len(found.sizes), "sizes": found.sizes})]
    spread = parent()
    limit = config.min_parent_dispersion * config.parent_dispersion_decay**depth
    if spread < limit:
        return [Decision(False, "coherent", metrics={"parent_dispersion": spread, "min_parent_dispersion": limit})]
    most = min(config.max_branches, n // config.min_cluster_size, distinct())
    if most < 2:
        return [Decision(False, "unsplittable" if distinct() < 2 else "too_few_supported_clusters", metrics={"parent_dispersion": spread})]
    seen: list[Decision] = []
    for k in range(2, most + 1):
        found = cut(k)
        sizes = found.sizes
        if len(sizes) < 2 or min(sizes) < config.min_cluster_size:
            seen.append(Decision(False, "single_cluster" if len(sizes) < 2 else "small_cluster", metrics={"k": k, "sizes": sizes}))
            continue
        child = sum(m / n * d for m, d in zip(sizes, found.dispersions, strict=True))
        i, j = np.triu_indices(len(sizes), 1)
        separation = float(np.linalg.norm(found.means[i] - found.means[j], axis=1).mean())
        imbalance = float(np.std(sizes) / np.mean(sizes))
        gain = spread - child
        score = gain + config.separation_weight * separation - config.imbalance_weight * imbalance
        seen.append(Decision(True, "candidate", found.parts, {"k": k, "sizes": sizes, "parent_dispersion": spread, "child_dispersion": child, "gain": gain, "gain_ratio": gain / spread if spread else 0.0, "separation": separation, "imbalance": imbalance, "score": score}))
    valid = [d for d in seen if d.split]
    if not valid:
        return [*seen, Decision(False, "no_valid_split")]
    best = max(valid, key=lambda d: (d.metrics["score"], -d.metrics["k"]))
    ratio = config.min_split_gain_ratio
    if best.metrics["gain"] >= config.min_split_gain or (ratio is not None and best.metrics["gain_ratio"] >= ratio):
        return [*seen, Decision(True, "accept", best.parts, best.metrics)]
    return [*seen, Decision(False, "low_gain", metrics=best.metrics)]


def decide(x: np.ndarray, depth: int, config: TreeConfig) -> list[Decision]:
    """The rule on an array; parts are row numbers."""

    def cut(k: int) -> Bucketing:
        parts = buckets(x, k, config)
        return Bucketing([len(p) for p in parts], [dispersion(x[p]) for p in parts], np.array([x[p].mean(0) for p in parts]), parts)

    return judge(len(x), depth, config, lambda: dispersion(x), lambda: distinct_rows(x, config.max_branches), cut)


@runtime_checkable
class SplitStrategy(Protocol):
    """C4: whether and how to split an array of vectors; the last decision counts."""

    def __call__(self, x: np.ndarray, depth: int, config: TreeConfig) -> list[Decision]: ...


def make_splitter(config: TreeConfig) -> SplitStrategy:
    """The strategy for a configuration: the fixed and the adaptive rule are one function."""
    return decide


def described(decision: Decision, config: TreeConfig, n: int, depth: int) -> dict:
    """A decision as a record, with one line of key=value pairs, floats with six digits."""
    kind = {"accept": "accept", "candidate": "candidate", "single_cluster": "reject", "small_cluster": "reject"}.get(decision.reason, "skip")
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else "[" + ",".join(map(show, v)) + "]" if isinstance(v, list) else str(v)
    pairs = {"n": n, "depth": depth} | ({} if kind in ("accept", "candidate") else {"reason": decision.reason}) | decision.metrics
    event = f"split.{config.split_mode}.{kind}"
    return {"event": event, "reason": decision.reason, "n": n, "depth": depth, "k": decision.metrics.get("k"), "gain": decision.metrics.get("gain"), "score": decision.metrics.get("score"), "line": f"{event} " + " ".join(f"{k}={show(v)}" for k, v in pairs.items())}


#: The records of described(), as split_decisions() gives them.
DECISIONS = "path array<int>, event string, reason string, n long, depth int, k int, gain double, score double, line string"


def grow(x: np.ndarray, depth: int, config: TreeConfig, strategy: SplitStrategy | None = None, said: list | None = None) -> list[tuple[list[int], bool, np.ndarray]]:
    """(path below, unsplittable, row numbers) of each leaf of the whole subtree of x. said takes the decisions' records, with their paths below."""
    out: list = []
    todo = [([], np.arange(len(x)), depth)]
    while todo:
        path, rows, d = todo.pop()
        found = (strategy or make_splitter(config))(x[rows], d, config)
        if said is not None and config.log_split_decisions:
            said += [{"path": path, **described(f, config, len(rows), d)} for f in found]
        last = found[-1]
        if not last.split:
            out.append((path, last.reason == "unsplittable", rows))
            continue
        todo += [([*path, i], rows[p], d + 1) for i, p in enumerate(last.parts)]
    return out


def divisive(items: DataFrame, config: TreeConfig, local_max: int = LOCAL_MAX, strategy: SplitStrategy | None = None, keep: Callable[[DataFrame], DataFrame] | None = None, said: list | None = None, below: bool = False) -> DataFrame:
    """items(seq, vector, ...) -> the same with path array<int>, unsplittable and decisions (see split_decisions()): the tree built from the top.

    A level's groups over local_max rows go together through passes over all executors: k-means for each k that the rule asks for, then the
    statistics of its buckets, by which the rule decides. Each group that is small enough is finished in one task, with the whole subtree below it.
    below: items have a path already, and the subtree of each path's items is built below it. keep: writes a table and reads it again, between levels. said takes the records of the large groups' decisions. A strategy of one's own sees only groups of up to local_max rows, so local_max must then cover all.
    """
    keep = keep or (lambda df: df)
    rows = items.withColumnRenamed("path", "__at") if below else items.withColumn("__at", F.array().cast("array<int>"))
    own = [c for c in items.columns if not (below and c == "path")]
    done: list[DataFrame] = []
    while True:
        sizes = rows.groupBy("__at").agg(F.count("*").alias("n")).where(F.col("n") > max(local_max, config.leaf_target))
        large = [(list(r["__at"]), r["n"]) for r in sizes.collect()]  # fewer than rows / local_max groups
        if large and strategy is not None:
            raise ValueError(f"a strategy of one's own needs local_max to cover the largest group, {max(n for _, n in large)} rows")
        if not large:
            done.append(_finished(rows, config, strategy))
            break
        names = rows.sparkSession.createDataFrame([(p, i) for i, (p, _) in enumerate(sorted(large))], "__at array<int>, __group int")
        done.append(_finished(rows.join(F.broadcast(names), "__at", "left_anti"), config, None))
        said = said if said is not None else []
        big = rows.join(F.broadcast(names), "__at")
        cut = [_large(big.where(F.col("__group").between(at, at + GROUPS - 1)), sorted(large)[at : at + GROUPS], at, config, said) for at in range(0, len(large), GROUPS)]
        placed = cut[0]
        for c in cut[1:]:
            placed = placed.unionByName(c)
        placed = keep(placed.drop("__group"))
        columns = [*own, "path", "unsplittable", F.lit(None).cast("array<string>").alias("decisions")]
        done.append(placed.where("__end").select(*columns))
        rows = placed.where("not __end").select(*own, F.col("path").alias("__at"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def split_decisions(grown: DataFrame, said: list = ()) -> DataFrame:
    """The decisions that divisive() wrote, and those it said of large groups, one row each; none unless config.log_split_decisions."""
    spark = grown.sparkSession
    one = grown.where("decisions is not null").select(F.explode("decisions").alias("d"))
    if said:
        one = one.unionByName(spark.createDataFrame([(json.dumps(d),) for d in said], "d string"))
    return one.select(F.from_json("d", DECISIONS).alias("d")).select("d.*")


def _finished(rows: DataFrame, config: TreeConfig, strategy: SplitStrategy | None) -> DataFrame:
    """Each group's whole subtree. Only seq and vector go to Python; the rest is joined back by seq."""
    schema = "seq long, path array<int>, unsplittable boolean, decisions array<string>"

    def run(table):
        seq, x = table.column("seq").to_numpy(), np.array(table.column("vector").combine_chunks().flatten(), float).reshape(table.num_rows, -1)
        order = np.argsort(seq, kind="stable")
        seq, at, said = seq[order], table.column("__at")[0].as_py(), []
        leaves = grow(x[order], len(at), config, strategy, said)
        leaf = pa.array(np.repeat(np.arange(len(leaves)), [len(r) for _, _, r in leaves]))
        told = [json.dumps({**d, "path": [*at, *d["path"]]}) for d in said] or None
        cols = [
            pa.array(seq[np.concatenate([r for _, _, r in leaves])], pa.int64()),
            pa.array([[*at, *p] for p, _, _ in leaves], pa.list_(pa.int32())).take(leaf),
            pa.array([u for _, u, _ in leaves], pa.bool_()).take(leaf),
            pa.array([told, *[None] * (len(seq) - 1)], pa.list_(pa.string())),
        ]
        return pa.table(cols, ["seq", "path", "unsplittable", "decisions"])

    placed = rows.select("seq", "vector", "__at").groupBy("__at").applyInArrow(run, schema)
    return rows.drop("__at").join(placed, "seq")


def _large(rows: DataFrame, groups: list[tuple[list[int], int]], base: int, config: TreeConfig, records: list) -> DataFrame:
    """One level of large groups: rows(seq, vector, __at, __group, ...) with path, __end, unsplittable."""
    spark = rows.sparkSession
    narrow = rows.select((F.col("__group") - base).alias("g"), "seq", "vector")
    known, centers, stats = {}, {}, {}
    slots = _slots(spark)
    wide = [g for g, (_, n) in enumerate(groups) if n > ALONE and slots > 1]
    alone = [g for g in range(len(groups)) if g not in wide]
    if alone:
        for r in _whole(narrow.where(F.col("g").isin(alone)) if wide else narrow, groups, config):
            if r["k"]:
                centers[r["g"], r["k"]] = np.array(r["centers"], float).reshape(r["k_found"], -1)
            else:
                known[r["g"]] = r["k_found"]
            means = np.array(r["means"], float).reshape(len(r["n"]), -1)
            stats[r["g"], r["k"]] = [{"bucket": b, "n": n, "first": first, "mean": mean, "dispersion": d} for b, (n, first, mean, d) in enumerate(zip(r["n"], r["first"], means, r["d"], strict=True)) if n]
    if wide:
        args = config.model_args
        seed, rounds, tol = int(args.get("random_state") or 0), int(args.get("max_iter", 300)), float(args.get("tol", 1e-4))
        rest = narrow.where(F.col("g").isin(wide)) if alone else narrow
        known |= {r["g"]: r["d"] for r in rest.groupBy("g").agg(F.count_distinct(F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector")).alias("d")).collect()}
        # as many buckets as centres, from k-means on the first rows
        own: dict[tuple[int, int], np.ndarray] = {}
        for r in _seeds(rest, groups):
            most = min(known[r["g"]], config.max_branches)
            while distinct_rows(r["seqs"], most) < most:  # as in _whole()
                held = F.array(*[F.lit(v.tolist()) for v in _distinct(r["seqs"], most)])
                other = rest.where((F.col("g") == r["g"]) & ~F.array_contains(held, F.col("vector"))).agg(F.min_by("vector", "seq")).first()[0]
                if other is None:
                    break
                r["seqs"] = np.concatenate([r["seqs"], [other]])
            for k in _wanted(groups[r["g"]][1], known[r["g"]], config):
                own[r["g"], k] = _seeded(r["seqs"], k, seed, rounds, tol)
        own = _settled(rest, own, {g: groups[g][1] for g in wide}, rounds, tol)
        # the buckets as the centres have them, then distances to the buckets' own means
        centers |= own
        stats |= _measured(rest, own, wide)
    ks = {g: _wanted(n, known[g], config) for g, (_, n) in enumerate(groups)}
    orders, ends = {}, {}
    for g, (path, n) in enumerate(groups):
        whole = stats[g, 0]

        def cut(k: int, g=g, n=n) -> Bucketing:
            if (g, k) not in stats:
                return Bucketing([n], [stats[g, 0][0]["dispersion"]], np.zeros((1, 1)), [0])
            own = sorted((b for b in stats[g, k] if b["n"]), key=lambda b: b["first"])
            return Bucketing([b["n"] for b in own], [b["dispersion"] for b in own], np.array([b["mean"] for b in own]), [(k, b["bucket"]) for b in own])

        said = judge(n, len(path), config, lambda: whole[0]["dispersion"], lambda g=g: known[g], lambda k, g=g, f=cut: f(max(ks[g], default=1) if config.split_mode == "fixed" else k))
        last = said[-1]
        ends[g] = last.reason == "unsplittable" if not last.split else None
        if last.split:
            k = last.parts[0][0]
            orders[g] = (k, [next((i for i, (_, b) in enumerate(last.parts) if b == c), 0) for c in range(len(centers[g, k]))])
        if config.log_split_decisions:
            records += [{"path": path, **described(d, config, n, len(path))} for d in said]
    chosen = {(g, k): centers[g, k] for g, (k, _) in orders.items()}

    @F.arrow_udf("int")
    def ordinal(group: pa.Array, vector: pa.Array) -> pa.Array:
        out = np.full(len(group), -1)
        g = group.to_numpy() - base
        x = vector.flatten().to_numpy(zero_copy_only=False).reshape(len(g), -1)
        for one in np.unique(g):
            if one in orders:
                k, order = orders[one]
                at = np.flatnonzero(g == one)
                out[at] = np.array(order)[_closest(x[at], chosen[one, k])]
        return pa.array(out, pa.int32())

    table = spark.createDataFrame([(g + base, ends[g]) for g in range(len(groups))], "__group int, __stuck boolean")
    out = rows.withColumn("__o", ordinal("__group", "vector")).join(F.broadcast(table), "__group")
    end = F.col("__stuck").isNotNull()
    return out.withColumns({"path": F.when(end, F.col("__at")).otherwise(F.concat("__at", F.array("__o"))), "__end": end, "unsplittable": F.coalesce("__stuck", F.lit(False))}).drop("__o", "__stuck")


def _wanted(n: int, known: int, config: TreeConfig) -> list[int]:
    """The numbers of buckets that the rule will ask for in a group of n rows, `known` of them distinct."""
    if config.split_mode == "fixed":
        most = min(config.max_branches, known)
        return [most] if most > 1 else []
    return list(range(2, min(config.max_branches, n // config.min_cluster_size, known) + 1))


def _seeded(first: np.ndarray, k: int, seed: int, rounds: int, tol: float) -> np.ndarray:
    labels = kmeans(first, k, seed, rounds, tol)
    return np.array([first[labels == c].mean(0) for c in sorted(set(labels.tolist()))])


def _sampled(n: Column | int) -> Column:
    """The rows of a group of n from which its first centres are drawn, by a hash."""
    return F.pmod(F.xxhash64("seq", F.lit(12)), F.lit(1 << 40)) < F.least(F.lit(1.0), F.lit(SEED_ROWS) / n) * (1 << 40)


#: One row a group and k; k 0 is the whole group, whose k_found is the number of distinct rows, up to max_branches.
WHOLE = "g int, k int, k_found int, centers array<double>, n array<long>, first array<long>, d array<double>, means array<double>"


def _whole(narrow: DataFrame, groups: list[tuple[list[int], int]], config: TreeConfig) -> list:
    """What the rule needs to know of groups of up to ALONE rows: each group lies in one task, which draws the first centres, settles them and measures the
    buckets, so that a level of such groups is one job. Rows wait in a file without a name."""
    args = config.model_args
    seed, rounds, tol = int(args.get("random_state") or 0), int(args.get("max_iter", 300)), float(args.get("tol", 1e-4))
    sizes = narrow.sparkSession.createDataFrame([(g, n) for g, (_, n) in enumerate(groups)], "g int, __n long")
    rows = narrow.join(F.broadcast(sizes), "g").select("g", "seq", "vector", _sampled(F.col("__n")).alias("drawn"))

    def split(g: int, seq: np.ndarray, drawn: np.ndarray, x: np.ndarray):
        known = distinct_rows(x, config.max_branches)
        yield [g, 0, known, [], *measured(seq, x, None)]
        first = np.array(x[np.flatnonzero(drawn)])
        if distinct_rows(first, known) < known:  # else a few rows among many copies get no centre, and the group ends whole
            first = np.concatenate([first, _distinct(x, known)])
        todo = {(g, k): _seeded(first, k, seed, rounds, tol) for k in _wanted(len(x), known, config)}
        for (_, k), c in _rounds(x, [(g, 0, len(x))], todo, rounds, tol).items():
            yield [g, k, len(c), c.ravel().tolist(), *measured(seq, x, c)]

    def measured(seq: np.ndarray, x: np.ndarray, c: np.ndarray | None):
        size = 1 if c is None else len(c)
        label = np.zeros(len(x), np.int32)
        n, total, d = np.zeros(size, np.int64), np.zeros((size, x.shape[1])), np.zeros(size)
        first = np.full(size, np.iinfo(np.int64).max)
        for at in range(0, len(x), BLOCK):
            part = x[at : at + BLOCK]
            own = label[at : at + BLOCK] = np.zeros(len(part), np.int32) if c is None else _closest(part, c)
            for b in np.unique(own).tolist():
                n[b] += (own == b).sum()
                total[b] += part[own == b].sum(0)
                first[b] = min(first[b], seq[at : at + BLOCK][own == b].min())
        means = total / np.maximum(n, 1)[:, None]
        for at in range(0, len(x), BLOCK):
            own = label[at : at + BLOCK]
            d += np.bincount(own, np.linalg.norm(x[at : at + BLOCK] - means[own], axis=1), size)
        return n.tolist(), first.tolist(), (d / np.maximum(n, 1)).tolist(), means.ravel().tolist()

    def run(batches):
        def out(g: int, parts: list, file):
            file.flush()
            seq, drawn = (np.concatenate([p[i] for p in parts]) for i in range(2))
            found = list(split(g, seq, drawn, np.memmap(file, float, "r", shape=(len(seq), parts[0][2]))))
            file.close()
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(kinds)], [c.split()[0] for c in WHOLE.split(", ")])

        last, parts, file = None, [], None
        for b in batches:
            g = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for at, to in zip(cuts, cuts[1:], strict=False):
                if to == at:
                    continue
                if g[at] != last:
                    if parts:
                        yield out(last, parts, file)
                    last, parts, file = int(g[at]), [], tempfile.TemporaryFile()
                x = b.column(2).slice(at, to - at).flatten().to_numpy(zero_copy_only=False).astype(float)
                parts.append((b.column(1).to_numpy()[at:to].copy(), b.column(3).to_numpy(zero_copy_only=False)[at:to].copy(), len(x) // (to - at)))
                file.write(x.tobytes())
        if parts:
            yield out(last, parts, file)

    # the largest groups first, each to the task that has the fewest rows
    load = [0] * min(len(groups), 4 * max(2, _slots(narrow.sparkSession)))
    task = [0] * len(groups)
    for g in sorted(range(len(groups)), key=lambda g: -groups[g][1]):
        task[g] = load.index(min(load))
        load[task[g]] += groups[g][1]
    dealt = rows.repartitionById(len(load), F.array(*map(F.lit, task))[F.col("g")])
    return dealt.sortWithinPartitions("g", "seq").mapInArrow(run, WHOLE).collect()


def _seeds(narrow: DataFrame, groups: list[tuple[list[int], int]]) -> list[dict]:
    """About SEED_ROWS vectors of each group, in order of seq."""
    spark = narrow.sparkSession
    sizes = spark.createDataFrame([(g, n) for g, (_, n) in enumerate(groups)], "g int, __n long")
    some = narrow.join(F.broadcast(sizes), "g").where(_sampled(F.col("__n")))
    out: dict[int, list] = {}
    for r in some.select("g", "seq", "vector").collect():
        out.setdefault(r["g"], []).append((r["seq"], r["vector"]))
    return [{"g": g, "seqs": np.array([v for _, v in sorted(rows)], float)} for g, rows in out.items()]


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    x, c = x - c.mean(0), c - c.mean(0)  # as in kmeans()
    return ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]).argmin(1)


def _partials(narrow: DataFrame, of: Callable, schema: str) -> DataFrame:
    """of(g, x, seq) -> rows, for the rows of each group in each Arrow batch."""

    def run(batches):
        kinds = None
        for b in batches:
            if not b.num_rows:
                continue
            g, seq, x = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            got = [row for one in np.unique(g).tolist() for row in of(one, x[g == one], seq[g == one])]
            kinds = kinds or [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], t) for i, t in enumerate(kinds)], ["g", "k", "bucket", "n", "first", "d", "total"])

    return narrow.select("g", "seq", "vector").mapInArrow(run, schema)


PARTIAL = "g int, k int, bucket int, n long, first long, d double, total array<double>"


def _summed(parts: DataFrame) -> list:
    """Partial sums added up: one row a group, k and bucket, some hundreds a group."""

    def add(batches):
        sums: dict = {}
        for b in batches:
            for g, k, c, n, first, d, total in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                old = sums.get((g, k, c))
                t = np.array(total)
                sums[g, k, c] = (n, first, d, t) if old is None else (old[0] + n, min(old[1], first), old[2] + d, old[3] + t)
        keys = sorted(sums)
        cols = [[k[i] for k in keys] for i in range(3)] + [[sums[k][i] for k in keys] for i in range(3)] + [[sums[k][3].tolist() for k in keys]]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["g", "k", "bucket", "n", "first", "d", "total"])

    return parts.mapInArrow(add, PARTIAL).repartition("g", "k", "bucket").mapInArrow(add, PARTIAL).collect()


def _settled(narrow: DataFrame, centers: dict, sizes: dict[int, int], rounds: int, tol: float, alone: int = ALONE) -> dict:
    """(group, k) -> its centres after Lloyd's rounds over all rows of the group. All rounds are one job, not one job each.

    A group of up to `alone` rows stays in one task. Larger ones are dealt to tasks that run at the same time and pass each other their sums after each
    round (a barrier stage, whose rounds take a second each). Rows wait for the next round in a file without a name; in memory are 20 bytes a row and k.
    """
    slots = _slots(narrow.sparkSession)
    wide = [g for g, n in sizes.items() if n > alone and slots > 1 and any(own == g for own, _ in centers)]
    small = {key: c for key, c in centers.items() if key[0] not in wide}
    large = {key: c for key, c in centers.items() if key[0] in wide}
    out = dict(centers)
    parts = []
    if small:
        mine = narrow.where(F.col("g").isin(sorted({g for g, _ in small}))).repartition("g").sortWithinPartitions("g", "seq")
        parts.append(mine.mapInArrow(_settling(small, rounds, tol, False), SETTLED))
    if large:
        tasks = min(slots, -(-sum(sizes[g] for g in wide) // DEALT))
        dealt = narrow.where(F.col("g").isin(wide)).repartition(tasks, "seq").sortWithinPartitions("g", "seq")
        parts.append(dealt.mapInArrow(_settling(large, rounds, tol, True), SETTLED, barrier=True))
    for part in parts:
        for r in part.collect():
            out[r["g"], r["k"]] = np.array(r["centers"], float).reshape(r["k_found"], -1)
    return out


SETTLED = "g int, k int, k_found int, centers array<double>"


def _slots(spark) -> int:
    """Tasks that run at the same time; 1 where that number changes, and a barrier stage isn't allowed."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 1
    context = spark.sparkContext._jsc.sc()
    return max(1, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))


def _rounds(x: np.ndarray | None, runs: list[tuple[int, int, int]], todo: dict, rounds: int, tol: float, together: Callable[[dict], dict] = lambda sums: sums) -> dict:
    """(group, k) -> centres after Lloyd's rounds over the rows of x that runs (group, start, end) give each group."""
    settled, todo = dict(todo), dict(todo)
    held = {key: _Rows(x[start:end]) for g, start, end in runs for key in todo if key[0] == g}
    for _ in range(rounds):
        if not todo:
            break
        sums = together({key: held[key].sums(c) if key in held else (np.zeros(len(c)), np.zeros_like(c)) for key, c in todo.items()})
        for key, c in list(todo.items()):
            n, total = sums[key]
            moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
            settled[key] = todo[key] = moved
            if ((moved - c) ** 2).sum() <= tol * float(c.var(0).mean() + 1e-12):
                del todo[key]
                held.pop(key, None)
    return settled


def _settling(centers: dict, rounds: int, tol: float, shared: bool) -> Callable:
    """Rows (g, seq, vector) in order of g -> the settled centres; shared: other tasks have rows of the same groups."""

    def settle(x: np.ndarray | None, runs: list[tuple[int, int, int]], todo: dict) -> dict:
        return _rounds(x, runs, todo, rounds, tol, together)

    def together(sums: dict) -> dict:
        if not shared:
            return sums
        from pyspark import BarrierTaskContext

        # every task adds up the same parts in the same order, so that all go on with the same centres
        said = base64.b64encode(np.concatenate([np.column_stack(sums[key]).ravel() for key in sums]).tobytes()).decode()
        flat = sum(np.frombuffer(base64.b64decode(t)) for t in BarrierTaskContext.get().allGather(said))
        out, at = {}, 0
        for key, (n, total) in sums.items():
            both = flat[at : at + len(n) * (1 + total.shape[1])].reshape(len(n), -1)
            out[key], at = (both[:, 0], both[:, 1:]), at + both.size
        return out

    def run(batches):
        def rows(found: dict):
            keys = sorted(found)
            cols = [[g for g, _ in keys], [k for _, k in keys], [len(found[key]) for key in keys]]
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols), pa.array([found[key].ravel().tolist() for key in keys], pa.list_(pa.float64()))], ["g", "k", "k_found", "centers"])

        def stored(file, n: int):
            file.flush()
            return np.memmap(file, float, "r", shape=(n, len(next(iter(centers.values()))[0]))) if n else None

        file, runs, n = tempfile.TemporaryFile(), [], 0
        for b in batches:
            g = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for at, to in zip(cuts, cuts[1:], strict=False):
                if to == at:
                    continue
                if runs and runs[-1][0] != g[at]:
                    if not shared:  # this group is whole
                        yield rows(settle(stored(file, n), runs, {key: c for key, c in centers.items() if key[0] == runs[-1][0]}))
                        file.close()
                        file, runs, n = tempfile.TemporaryFile(), [], 0
                if not runs or runs[-1][0] != g[at]:
                    runs.append((int(g[at]), n, n))
                file.write(b.column(2).slice(at, to - at).flatten().to_numpy(zero_copy_only=False).astype(float).tobytes())
                n += to - at
                runs[-1] = (runs[-1][0], runs[-1][1], n)
        if shared:
            found = settle(stored(file, n), runs, dict(centers))
            from pyspark import BarrierTaskContext

            if BarrierTaskContext.get().partitionId() == 0:
                yield rows(found)
        elif runs:
            yield rows(settle(stored(file, n), runs, {key: c for key, c in centers.items() if key[0] == runs[-1][0]}))
        file.close()

    return run


class _Rows:
    """The rows of a group in a task, and what is known of them from the round before: by how far a row's own centre and the next one can have moved, most
    rows keep their centre without being measured again (Hamerly), and only those that change it change the sums."""

    def __init__(self, x: np.ndarray):
        self.x, self.centers = x, None

    def sums(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and sums of the rows closest to each of c."""
        if self.centers is None:
            self.label, self.own, self.next = np.full(len(self.x), -1, np.int32), np.zeros(len(self.x)), np.zeros(len(self.x))
            self.n, self.total, self.slack = np.zeros(len(c)), np.zeros_like(c), 0.0
            look = np.arange(len(self.x))
        else:
            moved = np.sqrt(((c - self.centers) ** 2).sum(1))
            self.own += moved[self.label]
            self.next -= moved.max()
            look = np.flatnonzero(self.own + self.slack >= self.next)
        self.centers = c
        origin = c.mean(0)
        near = c - origin  # as in kmeans()
        length = (near * near).sum(1)
        for at in range(0, len(look), BLOCK):
            rows = look[at : at + BLOCK]
            part = self.x[rows]
            off = part - origin
            size = (off * off).sum(1)
            self.slack = max(self.slack, 1e-6 * float(np.sqrt(size.max())))
            far = size[:, None] - 2 * off @ near.T + length
            new, old = far.argmin(1), self.label[rows]
            far = np.sqrt(np.maximum(far, 0))
            self.own[rows] = far[np.arange(len(rows)), new]
            far[np.arange(len(rows)), new] = np.inf
            self.next[rows] = far.min(1)
            self.label[rows] = new
            other = np.flatnonzero(new != old)
            change = np.zeros((len(other), len(c)))
            change[np.arange(len(other)), new[other]] = 1
            left = np.flatnonzero(old[other] >= 0)
            change[left, old[other][left]] -= 1
            self.n += change.sum(0)
            self.total += change.T @ part[other]
        return self.n.copy(), self.total.copy()


def _measured(narrow: DataFrame, centers: dict, groups: list[int]) -> dict:
    """(group, k) -> the buckets with n, first seq, mean and mean distance to it; k 0 is the whole group."""
    zero = {(g, 0): np.zeros((1, 1)) for g in groups}
    every = {**centers, **zero}

    def bucketed(x, key):
        return np.zeros(len(x), int) if key[1] == 0 else _closest(x, every[key])

    def sums(g, x, seq):
        for key in every:
            if key[0] == g:
                label = bucketed(x, key)
                for j in np.unique(label).tolist():
                    yield g, key[1], j, int((label == j).sum()), int(seq[label == j].min()), 0.0, x[label == j].sum(0).tolist()

    found = {(r["g"], r["k"], r["bucket"]): r for r in _summed(_partials(narrow, sums, PARTIAL))}
    means = {key: np.array(r["total"]) / r["n"] for key, r in found.items()}

    def distances(g, x, seq):
        for key in every:
            if key[0] == g:
                label = bucketed(x, key)
                for j in np.unique(label).tolist():
                    d = np.linalg.norm(x[label == j] - means[g, key[1], j], axis=1)
                    yield g, key[1], j, len(d), 0, float(d.sum()), [0.0]

    spread = {(r["g"], r["k"], r["bucket"]): r["d"] for r in _summed(_partials(narrow, distances, PARTIAL))}
    out: dict = {}
    for key, r in found.items():
        out.setdefault(key[:2], []).append({"bucket": key[2], "n": r["n"], "first": r["first"], "mean": means[key], "dispersion": spread[key] / r["n"]})
    return out
