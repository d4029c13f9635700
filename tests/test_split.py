import numpy as np
import pytest

from branchlight.config import TreeConfig
from branchlight.operators.split import _closest, _settled, decide, dispersion, divisive, grow, kmeans, split_decisions


def topics(n=10, jitter=0.01, seed=0):
    rng = np.random.default_rng(seed)
    x = np.repeat(np.eye(3), n, axis=0) + rng.uniform(-jitter, jitter, (3 * n, 3))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_fixed_leaves_are_topics():
    leaves = grow(topics(), 0, TreeConfig(max_branches=3, leaf_target=10))
    assert sorted(len(r) for _, _, r in leaves) == [10, 10, 10]
    assert all(len({i // 10 for i in r.tolist()}) == 1 for _, _, r in leaves)


def test_equal_vectors_are_one_unsplittable_leaf():
    assert [(p, u, len(r)) for p, u, r in grow(np.ones((50, 4)), 0, TreeConfig(leaf_target=10, max_branches=3))] == [([], True, 50)]


def test_equal_vectors_are_coherent_in_adaptive_mode():
    assert decide(np.ones((30, 4)), 0, TreeConfig(split_mode="adaptive", leaf_target=6, min_parent_dispersion=0.01))[-1].reason == "coherent"


def test_adaptive_finds_natural_branches():
    c = TreeConfig(split_mode="adaptive", max_branches=5, leaf_target=6, min_cluster_size=3, min_split_gain=0.01, model_args={"random_state": 0})
    leaves = grow(topics(jitter=0.0), 0, c)
    assert sorted(len(r) for _, _, r in leaves) == [10, 10, 10]


def test_sizes_and_fan_out():
    x = np.random.default_rng(1).standard_normal((47, 12))
    leaves = grow(x / np.linalg.norm(x, axis=1, keepdims=True), 0, TreeConfig())
    assert sum(len(r) for _, _, r in leaves) == 47
    assert all(u or len(r) <= 10 for _, u, r in leaves)
    children = {}
    for p, _, _ in leaves:
        for i in range(len(p)):
            children.setdefault(tuple(p[:i]), set()).add(p[i])
    assert all(2 <= len(c) <= 5 for c in children.values())


def test_low_gain_and_ratio():
    rng = np.random.default_rng(2)
    x = np.array([[1, 0, 0.02 * s, 0] for s in (1, -1) for _ in range(6)]) + rng.uniform(-1e-4, 1e-4, (12, 4))
    c = dict(split_mode="adaptive", leaf_target=4, max_branches=2, min_parent_dispersion=0.001, min_split_gain=0.05)
    assert decide(x, 0, TreeConfig(**c))[-1].reason == "low_gain"
    assert [len(p) for p in decide(x, 0, TreeConfig(**c, min_split_gain_ratio=0.5))[-1].parts] == [6, 6]


def test_kmeans_is_seeded_and_caps_k():
    x = topics()
    assert (kmeans(x, 3, 5) == kmeans(x, 3, 5)).all()
    assert len(set(kmeans(np.repeat(np.eye(2), 5, axis=0), 7).tolist())) == 2
    assert dispersion(np.ones((3, 2))) == 0


@pytest.mark.parametrize("settings", [{"max_branches": 3}, {"split_mode": "adaptive", "max_branches": 5, "leaf_target": 6, "min_cluster_size": 3, "min_split_gain": 0.01}, {"split_mode": "adaptive", "min_parent_dispersion": 5.0}, {"split_mode": "adaptive", "min_split_gain": 9.0}, {}])
def test_large_groups_follow_the_same_rule(spark, settings):
    """Passes over all executors take the decisions that one task takes, in both modes."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.repeat(np.eye(6)[:4], 60, 0) + 0.05 * rng.standard_normal((240, 6)), np.ones((40, 6)), 4 + 0.3 * rng.standard_normal((30, 6))])
    c = TreeConfig.of(log_split_decisions=True, **settings)
    rows = spark.createDataFrame([(i, v.tolist(), f"t{i}") for i, v in enumerate(x)], "seq long, vector array<double>, text string")
    got = []
    for local_max in (10_000, 45):
        said = []
        grown = divisive(rows, c, local_max, said=said)
        table = {r["seq"]: (tuple(r["path"]), r["unsplittable"], r["text"]) for r in grown.collect()}
        logged = split_decisions(grown, said).collect()
        got.append((table, sorted((tuple(r["path"]), r["event"], r["reason"], r["n"], r["k"] or 0) for r in logged)))
    assert got[0] == got[1] and len(got[0][0]) == len(x)
    want = {tuple(p): (u, r.tolist()) for p, u, r in grow(x, 0, c)}
    leaves = {}
    for i, (p, u, _) in got[0][0].items():
        leaves.setdefault(p, (u, []))[1].append(i)
    assert {p: (u, sorted(r)) for p, (u, r) in leaves.items()} == {p: (u, sorted(r)) for p, (u, r) in want.items()}
    if settings.get("split_mode"):
        assert {r[1] for r in got[0][1]} <= {f"split.adaptive.{k}" for k in ("skip", "reject", "candidate", "accept")}


def test_deep_trees_have_no_depth_limit():
    leaves = grow(np.array([[3.0**k] for k in range(90)]), 0, TreeConfig(max_branches=2, leaf_target=1))
    assert all(len(r) == 1 for _, _, r in leaves) and max(len(p) for p, _, _ in leaves) > 60


def test_rejections_are_told_apart_and_lines_are_formatted():
    x = np.concatenate([np.zeros((12, 2)), np.ones((1, 2))]) + np.random.default_rng(0).uniform(0, 1e-3, (13, 2))
    said = []
    grow(x, 0, TreeConfig(split_mode="adaptive", leaf_target=4, min_cluster_size=2, min_parent_dispersion=0.01, log_split_decisions=True, max_branches=2), said=said)
    assert said[0]["reason"] == "small_cluster" and said[0]["line"] == "split.adaptive.reject n=13 depth=0 reason=small_cluster k=2 sizes=[12,1]"
    assert said[-1]["reason"] == "no_valid_split" and said[-1]["event"] == "split.adaptive.skip"


def lloyd(x, c, rounds, tol=1e-4):
    for _ in range(rounds):
        label = _closest(x, c)
        moved = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(len(c))])
        done, c = ((moved - c) ** 2).sum() <= tol * float(c.var(0).mean() + 1e-12), moved
        if done:
            break
    return c


@pytest.mark.parametrize(("rounds", "alone"), [(300, 10_000), (3, 100)])
def test_rounds_in_one_job_are_lloyds(spark, rounds, alone):
    """In one task a group, and shared by tasks that pass each other their sums; a centre without rows stays."""
    x = np.random.default_rng(5).standard_normal((2_000, 6))
    rows = spark.createDataFrame([(i % 2, i, v.tolist()) for i, v in enumerate(x)], "g int, seq long, vector array<double>")
    centers = {(g, k): np.concatenate([x[g::2][: k - 1], np.full((1, 6), 90.0)]) for g in (0, 1) for k in (2, 5)}
    got = _settled(rows, centers, {0: 1_000, 1: 1_000}, rounds, 1e-4, alone)
    assert set(got) == set(centers)
    for (g, k), c in centers.items():
        assert np.allclose(got[g, k], lloyd(x[g::2], c, rounds), atol=1e-9)


@pytest.mark.parametrize("mode", ["fixed", "adaptive"])
def test_large_groups_take_few_jobs(spark, mode, monkeypatch):
    """As many answers to the driver whatever number of rounds k-means needs."""
    x = np.random.default_rng(6).standard_normal((6_000, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "seq long, vector array<double>")
    kind, asked = type(rows), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: asked.append(1) or collect(self))
    placed = divisive(rows, TreeConfig.of(split_mode=mode, max_branches=3, min_split_gain=0.0, model_args={"tol": 0.0, "max_iter": 40}), 4_000)
    assert placed.count() == 6_000
    assert 0 < len(asked) < 15
