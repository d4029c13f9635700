import json
import sqlite3

import pytest

from branchlight.plans.tree import Branch, Content, Tree
from branchlight.sources.sql import Database, JdbcDatabase, SQLContents, SQLState, contents_to_jdbc, database, read_content
from branchlight.sources.states import DefaultTreeReconciler, JsonState, TreeLoader, TreePersister, TreeReconciler, content_from

TREE = Branch("root", "r", [Branch("a", None, [Content("x", "hello", {"k": "v"})]), Content("y", "ü'\"", {})])


@pytest.fixture(params=["sqlite", "jdbc", "connection"])
def address(request, tmp_path):
    if request.param == "connection":
        return Database(lambda: sqlite3.connect(tmp_path / "c.db"))
    return f"sqlite:///{tmp_path}/t.db" if request.param == "sqlite" else f"jdbc:derby:{tmp_path}/derby;create=true"


def test_states(spark, address):
    one, other = SQLState(spark, address), SQLState(spark, address, cache_key="other")
    assert one.load() is None
    one.save(TREE)
    other.save(Branch("o", "o", []))
    one.save(TREE)
    back = one.load()
    assert isinstance(back, Branch) and [(c.id, c.text) for c in back.contents()] == [("x", "hello"), ("y", "ü'\"")] and other.load().id == "o"
    t = Tree(spark, state=SQLState(spark, address, cache_key="state"))
    t.add([Content(i, f"t{i}", {}, [1.0, float(i)]) for i in range(15)])
    assert len(Tree(spark, state=SQLState(spark, address, cache_key="state"))) == 15
    assert isinstance(one, TreeLoader) and isinstance(one, TreePersister)


def test_a_failed_save_changes_nothing(spark, tmp_path):
    one = SQLState(spark, f"sqlite:///{tmp_path}/t.db")
    one.save(TREE)
    with pytest.raises(ZeroDivisionError), one.db.transaction() as run:
        run(f"delete from {one.table}")
        1 / 0  # noqa: B018
    assert one.load().id == "root"


def test_contents(spark, address):
    sink = SQLContents(spark, address, "source_docs")
    with pytest.raises(TypeError):
        sink.save({"items": []})
    for _ in range(2):
        sink.save(TREE)
    with sink.db.transaction() as run:
        rows = run("select id, text, metadata from source_docs")
    assert sorted((i, t, json.loads(m)) for i, t, m in rows) == [("x", "hello", {"k": "v"}), ("y", "ü'\"", {})]
    sink.save(Branch("e", "e", []))
    with sink.db.transaction() as run:
        assert run("select id from source_docs") == []


def test_content_of_tables(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/content;create=true"
    rows = spark.createDataFrame([(f"{i}", f"text {i}", "x" if i % 2 else "y") for i in range(30)], "id string, text string, tag string")
    contents_to_jdbc(content_from(rows, "id", "text", ["tag"]), url, "docs")
    contents_to_jdbc(content_from(rows.where("tag = 'x'"), "id", "text", ["tag"]), url, "docs")
    got = read_content(spark, url, "docs", metadata_columns=["metadata"], where="id < '2'")
    assert {r["content_id"] for r in got.collect()} == {str(i) for i in range(1, 30, 2) if str(i) < "2"}
    with sqlite3.connect(tmp_path / "c.db") as db:
        db.execute("create table docs (id integer, text text, tag text)")
        db.executemany("insert into docs values (?, ?, ?)", [(i, f"text {i}", "x" if i % 2 else None) for i in range(30)])
    got = read_content(spark, f"sqlite:///{tmp_path}/c.db", "docs", metadata_columns=["tag"], where="tag = 'x'", parts=4)
    assert sorted((int(r["content_id"]), r["text"], r["metadata"]) for r in got.collect()) == [(i, f"text {i}", '{"tag":"x"}') for i in range(1, 30, 2)]
    assert read_content(spark, f"sqlite:///{tmp_path}/c.db", "docs", where="1 = 0").count() == 0


def test_addresses(spark, tmp_path):
    assert isinstance(database(spark, f"jdbc:derby:{tmp_path}/d"), JdbcDatabase)
    with pytest.raises(ImportError, match="sqlalchemy"):
        database(spark, "mysql://u@h/d")
    with pytest.raises(ValueError):
        SQLState(spark, f"sqlite:///{tmp_path}/t.db", table="x; drop table y")


def test_reconciler(spark, tmp_path):
    state = JsonState(spark, f"{tmp_path}/s.json")
    state.save(TREE)
    made = DefaultTreeReconciler()
    assert isinstance(made, TreeReconciler) and made.reconcile(state, embedder=lambda t: [1.0]).id == "root"
