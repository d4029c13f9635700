import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from branchlight.config import RebalanceConfig, TreeConfig
from branchlight.plans.tree import Branch, Content, Tree, tree_from_dict, tree_to_dict
from branchlight.sources.states import JsonState, ParquetState, SQLiteState


def clusters(n=40, k=5, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((k, dim))
    return [Content(f"{c}:{i}", f"{c}:{i}", {"cluster": c}, (centers[c] + 0.05 * rng.standard_normal(dim)).tolist()) for c in range(k) for i in range(n)], centers


@pytest.fixture(scope="module")
def tree(spark):
    contents, _ = clusters()
    t = Tree(spark, TreeConfig(leaf_target=20))
    assert t.add(contents) == [c.id for c in contents]
    return t


def sums_match(tree):
    rows = tree.items.toPandas()
    for n in tree.nodes.toPandas().itertuples():
        own = rows[[list(p[: len(n.path)]) == list(n.path) for p in rows.path]] if len(rows) else rows
        assert n.count == len(own)
        if len(own):
            np.testing.assert_allclose(n.vsum, np.sum(own.vector.tolist(), axis=0), atol=1e-9)


def test_grows_and_counts(tree):
    assert len(tree) == 200
    assert tree.nodes.where(F.size("path") == 1).count() > 1
    sums_match(tree)
    assert tree.items.groupBy("path").count().where("count > 20").count() == 0


def test_query_leads_to_the_cluster(tree):
    _, centers = clusters()
    for exhaustive in (False, True):
        got = tree.nearest_to(centers[2], 5, exhaustive)
        assert len(got) == 5 and sum(m["cluster"] == 2 for _, _, m in got) >= 4
        assert [d for _, d, _ in got] == sorted(d for _, d, _ in got)
    assert tree.nearest_to(centers[0], 0) == []
    with pytest.raises(ValueError):
        tree.nearest_to(centers[0], -1)


def test_exact_equals_brute_force(tree):
    _, centers = clusters()
    got = tree.nearest_to(centers[1], 300, True)
    rows = tree.items.toPandas()
    q = centers[1] / np.linalg.norm(centers[1])
    d = np.linalg.norm(np.array(rows.vector.tolist()) - q, axis=1)
    assert len(got) == 200
    np.testing.assert_allclose([x for _, x, _ in got], np.sort(d), atol=1e-12)


def test_second_batch_and_removal(spark):
    contents, _ = clusters(n=12)
    t = Tree(spark, TreeConfig(leaf_target=8))
    t.add(contents[:40])
    t.add(contents[40:])
    sums_match(t)
    assert len(t) == 60
    assert [t.remove("0:0"), t.remove("0:0"), t.remove("no")] == [1, 0, 0]
    assert t.remove(*[c.id for c in contents[1:30]]) == 29
    sums_match(t)
    assert t.remove(*[c.id for c in contents]) == 30
    assert len(t) == 0 and [(r["path"], r["is_leaf"], r["count"]) for r in t.nodes.collect()] == [([], True, 0)]
    assert t.add([]) == []


def test_ids_come_back_as_they_were(spark):
    t = Tree(spark, TreeConfig(leaf_target=100))
    assert t.add([Content(10, "a", {"k": 1}, [1.0, 0]), Content("md5-b", "b", {}, [0, 1.0])]) == [10, "md5-b"]
    assert t.nearest_to([1.0, 0.1], 2)[0][0] == 10 and t.nearest_to([1.0, 0.1], 2)[0][2] == {"k": 1}
    with pytest.raises(ValueError):
        t.add([Content(1, "c", {}, [1.0, 2.0, 3.0])])


@pytest.mark.parametrize("mode", ["freeze", "incremental"])
def test_reducer(spark, mode):
    contents, centers = clusters(n=16, dim=24)
    t = Tree(spark, TreeConfig(leaf_target=20, pca_dims=6, pca_mode=mode, pca_warmup=40, pca_batch_size=16))
    t.add(contents[:30])
    assert t.nodes.isEmpty() and len(t) == 30 and len(t.nearest_to(centers[0], 3)) == 3
    t.add(contents[30:])
    assert not t.nodes.isEmpty() and len(t) == 80
    t.rebalance()
    assert len(t) == 80 and len(t.items.first()["vector"]) == 6
    assert sum(m["cluster"] == 2 for _, _, m in t.nearest_to(centers[2], 5)) >= 4


def test_labels_outline_and_collapse(spark):
    rng = np.random.default_rng(0)
    names = ["animal", "language", "food"]
    contents = [Content(f"{n}{i}", f"{n} topic", {}, (np.eye(3)[k] + rng.uniform(0, 0.01, 3)).tolist()) for k, n in enumerate(names) for i in range(10)]
    t = Tree(spark, TreeConfig(max_branches=3, leaf_target=10))
    t.add(contents)
    t.organize(lambda texts: texts[0].split()[0])
    assert sorted(r["label"] for r in t.nodes.where("is_leaf").collect()) == sorted(names)
    text = t.show(max_items=1)
    assert "- animal [10]" in text and text.count("·") == 3
    t.label()
    assert any("animal" in (r["label"] or "") for r in t.nodes.collect())
    t.remove(*[c.id for c in contents if "animal" in c.id or "food" in c.id])
    b = t.to_branch(collapse_single_leaf=True)
    assert b.count == 10 and all(isinstance(c, Content) for c in b.children)
    assert t.show(collapse_single_leaf=True).count("- ") == 1


@pytest.mark.parametrize("kind", ["parquet", "json", "sqlite"])
def test_states(spark, tmp_path, kind):
    state = {"parquet": lambda: ParquetState(spark, f"file://{tmp_path}/s"), "json": lambda: JsonState(spark, f"{tmp_path}/s.json"), "sqlite": lambda: SQLiteState(spark, f"{tmp_path}/s.db")}[kind]()
    assert state.load() is None
    contents, centers = clusters(n=6)
    t = Tree(spark, TreeConfig(leaf_target=8), state=state)
    t.add(contents)
    back = Tree(spark, TreeConfig(leaf_target=8), state=state)
    assert len(back) == 30 and back.nearest_to(centers[1], 3) == t.nearest_to(centers[1], 3)
    assert back.next_seq == 30


def test_branch_codec():
    b = Branch("r", "root", [Branch("a", None, [Content("x", "t", {"k": [1]}, np.array([1, 2], np.float32))]), Content("y", "u")])
    d = tree_to_dict(b)
    assert d["count"] == 2 and tree_from_dict({"kind": "branch", "tree": d}).count == 2
    assert [c.id for c in tree_from_dict(d).contents()] == ["x", "y"]
    assert hashlib.md5(str(d).encode()).hexdigest()


def test_auto_rebalance(spark):
    contents, _ = clusters(n=4)
    t = Tree(spark, TreeConfig.of(leaf_target=8, rebalance={"every_n_inserts": 15}))
    t.add(contents[:10])
    assert t.inserts == 10
    t.add(contents[10:])
    assert t.inserts == 0 and len(t) == 20


def same_as_rebuilt(tree):
    """Nodes kept by sums against the items as they are: counts, sums, leaves, parents, ids."""
    sums_match(tree)
    rows, nodes = tree.items.collect(), tree.nodes.collect()
    paths = {tuple(r["path"]) for r in rows}
    by = {tuple(n["path"]): n for n in nodes}
    assert len(by) == len(nodes) == len({n["node_id"] for n in nodes}) and len(rows) == len(tree) == len({r["seq"] for r in rows})
    assert {p for p, n in by.items() if n["is_leaf"]} == (paths or {()}) and set(by) == {p[:k] for p in paths for k in range(len(p) + 1)} | {()}
    assert all(n["parent_id"] == (by[p[:-1]]["node_id"] if p else None) for p, n in by.items())


@pytest.mark.parametrize("settings", [{}, {"split_mode": "adaptive", "min_split_gain": 0.01, "min_parent_dispersion": 0.01}, {"pca_dims": 3, "pca_mode": "incremental", "pca_warmup": 30, "pca_batch_size": 20}])
def test_batches_splits_and_removals_keep_sums(spark, tmp_path, monkeypatch, settings):
    from branchlight.plans import tree as module

    monkeypatch.setattr(module, "SEGMENTS", 3)
    contents, centers = clusters(n=24, k=4)
    rng = np.random.default_rng(2)
    contents = [contents[i] for i in rng.permutation(len(contents))]
    state = ParquetState(spark, f"file://{tmp_path}/s")
    t = Tree(spark, TreeConfig.of(leaf_target=6, max_branches=3, **settings), state=state)
    at, left = 0, []
    for k, n in enumerate((9, 40, 1, 17, 20, 9)):
        t.add(contents[at : at + n])
        left += [c.id for c in contents[at : at + n]]
        at += n
        if k in (1, 3, 4):
            gone = [left[i] for i in rng.choice(len(left), 7, replace=False)]
            assert t.remove(*gone, "nobody") == 7
            left = [i for i in left if i not in gone]
        if not settings.get("pca_dims") or t.pca.is_fitted:
            same_as_rebuilt(t)
    assert {json.loads(r["content_id"]) for r in t.items.collect()} == set(left)
    back = Tree(spark, t.config, state=state)
    same_as_rebuilt(back)
    assert back.nearest_to(centers[1], 5) == t.nearest_to(centers[1], 5) and len(t.segments) <= 4
    t.rebalance()
    same_as_rebuilt(t)
    assert [n["node_id"] for n in t.nodes.orderBy("path").collect()] == list(range(t.nodes.count()))


def test_a_batch_rewrites_only_the_leaves_it_overfills(spark):
    contents, _ = clusters(n=30, k=4)
    t = Tree(spark, TreeConfig(leaf_target=40, max_branches=4))
    t.add(contents)
    v, first = t.segments[0]
    t.add([Content(f"n{i}", "x", {}, contents[0].embedding) for i in range(3)])
    assert len(t.segments) == 2 and t.segments[0] == (v, first) and t.segments[1][1].count() == 3 and t.retired is None
    t.add([Content(f"m{i}", "x", {}, (np.array(contents[0].embedding) + 0.01 * i).tolist()) for i in range(30)])
    assert t.retired.count() == 1 and t.segments[2][1].count() == 30 + 3 + 30
    same_as_rebuilt(t)


def test_states_are_whole_versions_and_old_ones_go(spark, tmp_path):
    import os

    state = ParquetState(spark, f"file://{tmp_path}/s")
    contents, _ = clusters(n=10, k=3)
    t = Tree(spark, TreeConfig(leaf_target=5), state=state)
    for k in range(6):
        t.add(contents[5 * k : 5 * k + 5])
    assert len([n for n in os.listdir(tmp_path / "s/manifests") if n.startswith("manifest")]) == 2
    named = {n for f in os.listdir(tmp_path / "s/manifests") if f.startswith("manifest") for n in json.dumps(json.load(open(tmp_path / "s/manifests" / f))).split('"') if "-" in n and len(n) > 32}
    assert set(os.listdir(tmp_path / "s/data")) == named
    # a draft that was never renamed, as after a crash, doesn't count
    (tmp_path / "s/manifests/draft-x").write_text("{")
    (tmp_path / "s/data/items-lost").mkdir()
    assert len(Tree(spark, TreeConfig(leaf_target=5), state=state)) == 30
    # of two writers of one version the later one fails and changes nothing
    numbers = state._numbers
    state._numbers = lambda: numbers()[:-1]
    with pytest.raises(RuntimeError, match="by another"):
        t.add(contents[:1])
    state._numbers = numbers
    assert len(Tree(spark, TreeConfig(leaf_target=5), state=state)) == 30


def test_a_replayed_stream_batch_is_left_out_after_a_restart(spark, tmp_path):
    from branchlight.streaming.ingest import stream_into

    schema = "ordinal long, content_id string, text string, metadata string, embedding array<double>"
    rng = np.random.default_rng(0)
    for part in range(3):
        rows = [(i, json.dumps(i), f"t{i}", "{}", rng.standard_normal(4).tolist()) for i in range(part * 10, part * 10 + 10)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    new = lambda: Tree(spark, TreeConfig(leaf_target=5), state=ParquetState(spark, f"file://{tmp_path}/state"))
    t = new()
    stream_into(t, source(), f"file://{tmp_path}/marks").awaitTermination()
    assert len(t) == 30 and t.batches == {f"file://{tmp_path}/marks": 2}
    # the marks of the last batches are lost, so they are run again, by a new process
    import os

    for name in os.listdir(tmp_path / "marks/commits"):
        if "1" in name or "2" in name:
            os.remove(tmp_path / "marks/commits" / name)
    again = new()
    stream_into(again, source(), f"file://{tmp_path}/marks").awaitTermination()
    assert len(again) == 30 and again.items.select("content_id").distinct().count() == 30
    same_as_rebuilt(again)


class Letters:
    """A text's vowels and length."""

    cache = True

    def embed_batch(self, texts):
        return np.array([[t.count(v) for v in "aeiou"] + [len(t)] for t in texts], float)


def test_embedders_and_labelers_in_a_tree(spark, tmp_path):
    from branchlight.config import LLMConfig
    from branchlight.operators.labels import FunctionLabeler, KeywordLabeler

    calls = tmp_path / "calls"
    calls.write_text("")

    def counted(text):
        with open(calls, "a") as f:
            f.write(text + "\n")
        return Letters().embed_batch([text])[0]

    texts = ["banana cat", "avocado cat", "bee seed", "tree seed", "moon door", "wood door"] * 3
    t = Tree(spark, TreeConfig(leaf_target=6, max_branches=3), embedder=counted)
    t.add([Content(i, x) for i, x in enumerate(texts)])
    t.add([Content(100, "banana cat"), Content(101, "given", {}, [1.0] * 6)])
    assert sorted(calls.read_text().split("\n")[:-1]) == sorted(set(texts))
    assert t.nearest_to("bee seed", 3, exhaustive=True)[0][1] == pytest.approx(0) and len(t) == 20
    other = Tree(spark, TreeConfig(leaf_target=6, max_branches=3), embedder=Letters())
    other.add([Content(i, x) for i, x in enumerate(texts)])
    assert len(other.nearest_to("tree", 2)) == 2
    other.label()
    assert any("seed" in (r["label"] or "") for r in other.nodes.collect())
    other.label(FunctionLabeler(lambda r: f"{len(r.candidates)} texts"))
    assert {r["label"] for r in other.nodes.where("label is not null").collect()} <= {f"{n} texts" for n in range(16)}
    made = Tree(spark, TreeConfig(leaf_target=6, max_branches=3, llm=LLMConfig(provider="openai")), embedder=Letters(), labeler=KeywordLabeler(top_k=1))
    made.add([Content(i, x) for i, x in enumerate(texts)])
    made.organize()
    assert all("," not in (r["label"] or "") for r in made.nodes.collect())
    made.labeler = None
    with pytest.raises(Exception, match="openai"):
        made.label()
    assert made.node_items([]).count() == len(made) and made.node_items([0]).count() == made.nodes.where("path = array(0)").first()["count"]


def test_exports_have_routing_vectors(spark):
    contents, _ = clusters(n=10, k=3)
    t = Tree(spark, TreeConfig(leaf_target=10, pca_dims=3, pca_warmup=10))
    t.add(contents)
    b = t.to_branch()
    leaves = [c for c in b.contents()]
    assert len(leaves) == 30 and {len(c.embedding) for c in leaves} == {3} and b.count == 30
    np.testing.assert_allclose(np.sum([c.embedding for c in leaves], axis=0), b.vector_sum, atol=1e-9)


def test_decisions_of_a_tree(spark, caplog):
    contents, _ = clusters(n=10, k=3)
    t = Tree(spark, TreeConfig(leaf_target=10, max_branches=3, log_split_decisions=True))
    with caplog.at_level("INFO", logger="branchlight.split"):
        t.add(contents)
    rows = t.decisions.collect()
    assert any(r["event"] == "split.fixed.accept" and r["n"] == 30 and list(r["path"]) == [] for r in rows)
    assert any(m.startswith("split.fixed.accept n=30 depth=0 k=3 sizes=[") for m in caplog.messages) and len(caplog.messages) == len(rows)


def test_a_batch_whose_rebalance_is_due_is_built_once(spark, monkeypatch):
    """It isn't led to leaves before the whole tree is built anew, and the tree is the one that a rebalance gives."""
    x = np.random.default_rng(8).standard_normal((60, 5))
    rows = spark.createDataFrame([(i, str(i), f"t{i}", "{}", v.tolist()) for i, v in enumerate(x)], "ordinal long, content_id string, text string, metadata string, embedding array<double>")
    parts = [rows.where("ordinal < 35"), rows.where("ordinal >= 35")]
    want = Tree(spark, TreeConfig(rebalance=RebalanceConfig(every_n_inserts=None)))
    for p in parts:
        want.ingest(p)
    want.rebalance()
    monkeypatch.setattr(Tree, "_insert", lambda *a: pytest.fail("led to leaves"))
    got = Tree(spark, TreeConfig(rebalance=RebalanceConfig(every_n_inserts=20)))
    for p in parts:
        got.ingest(p)
    where = lambda t: sorted((r["seq"], tuple(r["path"])) for r in t.items.collect())
    assert where(got) == where(want) and len(got) == 60 and got.inserts == 0
    counts = lambda t: sorted((tuple(r["path"]), r["count"], r["is_leaf"]) for r in t.nodes.collect())
    assert counts(got) == counts(want)
