"""What grows with the number of batches or of rows does so no faster than they do."""

import numpy as np
import pytest
from pyspark.sql import DataFrame, functions as F

from branchlight.config import TreeConfig
from branchlight.operators import labels, split
from branchlight.plans import queries
from branchlight.plans.tree import Tree

SF = "/root/testdata/sf0.001"


@pytest.fixture
def built(monkeypatch):
    """The number of rows of each build of a tree, from the top or below leaves."""
    sizes = []

    def counted(self, rows, below=False, grown=Tree._grown):
        sizes.append(rows.count())
        return grown(self, rows, below)

    monkeypatch.setattr(Tree, "_grown", counted)
    return sizes


def often() -> TreeConfig:
    return TreeConfig.of(leaf_target=40, max_branches=4, rebalance={"every_n_inserts": 100})


def in_batches(spark, t: Tree, n: int = 3) -> DataFrame:
    rows = queries.content_rows(spark, SF)
    for i in range(n):
        t.ingest(rows.where(F.col("ordinal") % n == i))
    return rows


def test_batches_that_each_make_a_rebalance_due_are_built_once(spark, built):
    t = Tree(spark, often())
    n = in_batches(spark, t).count()
    assert len(t) == n and built == []
    root = t.nodes.where(F.size("path") == 0).first()
    assert root["count"] == n and built == [n]
    assert t.items.where("path is null").count() == 0 and t.items.select("seq").distinct().count() == n and built == [n]
    # a batch that makes none due is led to leaves of the whole tree
    t.ingest(queries.content_rows(spark, SF).where("ordinal < 3"))
    assert t.nodes.where("is_leaf").agg(F.sum("count")).first()[0] == n + 3


def test_a_small_batch_finds_the_rebalance_done(spark, built):
    t = Tree(spark, often())
    rows = queries.content_rows(spark, SF)
    t.ingest(rows.where("ordinal < 300"))
    t.ingest(rows.where("ordinal between 300 and 309"))
    assert built[0] == 300 and t.nodes.where(F.size("path") == 0).first()["count"] == 310


def test_a_level_of_large_groups_is_measured_in_one_job(spark, monkeypatch):
    """The same buckets, means and dispersions as by hand; no pass for first rows, distinct rows or sums."""
    for name in ("_seeds", "_settled", "_measured"):
        monkeypatch.setattr(split, name, None)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4)) + 6 * rng.normal(size=(6, 4))[np.arange(90) % 6]
    x[60:] = x[0]  # the second group: copies of one row
    rows = spark.createDataFrame([(i, v.tolist(), [] if i < 60 else [0]) for i, v in enumerate(x)], "seq long, vector array<double>, __at array<int>")
    narrow = rows.select(F.size("__at").alias("g"), "seq", "vector")
    got = {(r["g"], r["k"]): r for r in split._whole(narrow, [([], 60), ([0], 30)], TreeConfig(split_mode="adaptive", leaf_target=5))}
    assert sorted(got) == [(0, 0), (0, 2), (0, 3), (0, 4), (0, 5), (1, 0)] and got[0, 0]["k_found"] == 5 and got[1, 0]["k_found"] == 1
    for (g, k), r in got.items():
        own = x[:60] if g == 0 else x[60:]
        label = split._closest(own, np.array(r["centers"]).reshape(k, -1)) if k else np.zeros(len(own), int)
        for b in range(max(k, 1)):
            part = own[label == b]
            assert r["n"][b] == len(part) and r["first"][b] == np.flatnonzero(label == b)[0] + 60 * g
            assert abs(r["d"][b] - split.dispersion(part)) < 1e-9
    grown = split.divisive(rows.drop("__at"), TreeConfig.of(split_mode="adaptive", leaf_target=5), local_max=20)
    assert grown.count() == 90 and grown.where("seq >= 60 or seq = 0").select("path").distinct().count() == 1


def test_distinct_rows():
    x = np.repeat(np.arange(700.0), 3)[:, None] * np.ones((1, 2))
    assert split.distinct_rows(x, 5) == 5 and split.distinct_rows(x[:6], 5) == 2 and split.distinct_rows(x[:0], 5) == 0
    late = np.zeros((1_000, 2))
    late[999] = 1
    assert split.distinct_rows(late, 5) == 2


def test_words_are_counted_before_they_are_shuffled(spark, monkeypatch):
    """Keywords without a row for each word; the same by broadcast and by a join, with stop words, copies, blanks and a group without a name."""
    texts = [(1, "tin tin oak"), (1, "oak elm Elm"), (1, "  "), (2, "elm elm fir the"), (2, None), (3, "a b"), (None, "ash ash")]
    docs = spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(texts)], "content_id long, node int, text string")
    monkeypatch.setattr(labels.F, "explode", None)
    got = []
    for limit in (1 << 20, 0):
        monkeypatch.setattr(labels, "BROADCAST", limit)
        found = labels.keywords(docs, "node", top_k=2, stop_words=["the"]).collect()
        got.append(sorted((r["node"], r["rank"], r["term"], round(r["score"], 9)) for r in found))
    one = labels.KeywordLabeler(top_k=2, stop_words=["the"])
    for node in (1, 2):
        asked = labels.LabelRequest([labels.LabelCandidate(i, t) for i, (g, t) in enumerate(texts) if g == node and t])
        assert ", ".join(t for n, _, t, _ in got[0] if n == node) == one.label(asked)
    assert got[0] == got[1] and {n for n, *_ in got[0]} == {1, 2}


def test_copies_up_to_rounding_make_no_deep_tree():
    """Rows that differ in their last bits are told apart by the bits in which they differ; a level takes off no mere handful of them."""
    rng = np.random.default_rng(1)
    one = rng.normal(size=64)
    x = one * rng.uniform(0.5, 2, (500, 1))
    x /= np.linalg.norm(x, axis=1)[:, None]
    leaves = split.grow(x, 0, TreeConfig())
    assert max(len(path) for path, _, _ in leaves) <= 10 and sorted(np.concatenate([r for _, _, r in leaves])) == list(range(500))
    # the same in the steps for large groups
    y = one + 1e-9 * rng.normal(size=(300, 64))
    c = y[:5].copy()
    nearest = ((y[:, None] - c[None]) ** 2).sum(2).argmin(1)
    assert (split._closest(y, c) == nearest).all()
    held = split._Rows(y)
    for _ in range(3):
        nearest = ((y[:, None] - c[None]) ** 2).sum(2).argmin(1)
        n, total = held.sums(c)
        assert n.tolist() == np.bincount(nearest, minlength=5).tolist()
        c = total / n[:, None]


def test_a_batch_is_written_as_numbered_and_as_items(spark, monkeypatch):
    """Not once more in between; the numbered rows go when the batch is done."""
    from branchlight.plans import tree

    kept, gone = [], []
    monkeypatch.setattr(tree, "written", lambda df, what, f=tree.written: kept.append((what, f(df, what))) or kept[-1][1])
    monkeypatch.setattr(tree, "dropped", lambda *tables, f=tree.dropped: gone.extend(map(tree.folder_of, tables)) or f(*tables))
    t = Tree(spark, often())
    rows = queries.content_rows(spark, SF)
    t.ingest(rows)
    assert [what for what, _ in kept] == ["tree-numbered", "tree-items"] and gone[0] == tree.folder_of(kept[0][1])
    assert [tuple(r) for r in t.items.select("seq", "content_id").orderBy("seq").collect()] == [(i, str(i)) for i in range(rows.count())]


@pytest.mark.parametrize("alone", [split.ALONE, 100])
def test_few_rows_among_many_copies_are_split_off(spark, monkeypatch, alone):
    """In a large group, too, whose first centres are drawn from rows that are all alike."""
    monkeypatch.setattr(split, "ALONE", alone)
    monkeypatch.setattr(split, "SEED_ROWS", 20)
    x = np.zeros((400, 3))
    x[[7, 190, 333]] = np.eye(3)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "seq long, vector array<double>")
    leaf = {r["seq"]: tuple(r["path"]) for r in split.divisive(rows, TreeConfig(max_branches=4), local_max=50).collect()}
    want = {int(i): tuple(p) for p, _, found in split.grow(x, 0, TreeConfig(max_branches=4)) for i in found}
    assert leaf == want and len(set(leaf.values())) == 4


def test_ids_to_remove_do_not_pass_through_the_driver(spark, monkeypatch):
    """What the driver collects doesn't grow with what is removed, and the first item of each id goes, as by remove()."""
    rows = queries.content_rows(spark, SF)
    kind, asked = type(rows), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: asked.append(collect(self)) or asked[-1])
    t = queries.tree_nodes(spark, SF, "ordinal % 3 = 0")
    assert max(map(len, asked), default=0) < 50
    n = rows.count()
    left = n - -(-n // 3)
    assert len(t) == t.items.count() == left == t.nodes.where(F.size("path") == 0).first()["count"] and t.items.where("cast(content_id as long) % 3 = 0").count() == 0
    t.ingest(rows.where("ordinal in (1, 2)"))
    ids = spark.createDataFrame([("1",), ("1",), ("7",), ("none",)], "content_id string")
    assert [t.remove_all(ids), t.remove(1, 7), t.remove_all(ids), len(t)] == [2, 1, 0, left - 1]
    assert sorted(r[0] for r in t.items.where("content_id in ('1', '2', '7')").select("content_id").collect()) == ["2", "2"]
