import hashlib
import json

import pytest

from branchlight.sources.folders import MissingNodeFileError, read_folder, write_folder
from branchlight.sources.states import content_from, contents_to_table


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


@pytest.fixture
def docs(tmp_path):
    top = tmp_path / "docs"
    (top / "guides").mkdir(parents=True)
    (top / "empty").mkdir()
    (top / "intro.md").write_text("hello")
    (top / "_note.MD").write_bytes(b"a\r\nb")
    (top / ".hidden.md").write_text("no")
    (top / "bad.md").write_bytes(b"\xff\xfe\xfa")
    (top / "guides" / "setup.md").write_text("install")
    return top


def test_read(spark, docs):
    assert read_folder(spark, str(docs / "none")) is None
    content, branches = read_folder(spark, str(docs), include_suffixes=[".md"], additional_metadata_derivers=[lambda p, t: {"n": len(t), "filename": "x"}])
    rows = {r["content_id"]: r for r in content.collect()}
    assert set(rows) == {md5("hello"), md5("install"), hashlib.md5(b"a\r\nb").hexdigest()}
    assert rows[hashlib.md5(b"a\r\nb").hexdigest()]["text"] == "a\nb"
    assert json.loads(rows[md5("hello")]["metadata"])["filename"] == "x"
    assert {r["label"] for r in branches.collect()} == {"docs", "guides", "empty"}
    with pytest.raises(TypeError):
        read_folder(spark, str(docs), additional_metadata_derivers=lambda p, t: {})


def test_write(tmp_path, docs):
    tree = {"label": "root", "children": [{"label": "A/B", "children": [{"id": md5("hello"), "text": "hello", "metadata": {"new_file_name": "new.md"}}, {"id": md5("hello"), "text": "hello"}]}, {"label": "A B", "children": [{"id": "none", "text": "t"}]}]}
    with pytest.warns(RuntimeWarning):
        done = write_folder(tree, str(docs), include_suffixes=[".md"])
    assert [d[0] for d in done] == ["move", "copy", "skip"]
    assert (docs / "A B" / "new.md").read_text() == "hello" and not (docs / "intro.md").exists() and not (docs / "empty").exists()
    done = write_folder({"children": [{"label": "X", "children": [{"id": "none", "text": "é"}]}]}, str(docs), missing_node_file="create")
    assert done[0][0] == "create" and "é" in (docs / "X" / "none.txt").read_text()
    with pytest.raises(MissingNodeFileError):
        write_folder({"children": [{"id": "gone", "text": ""}]}, str(docs), missing_node_file="raise")
    with pytest.raises(ValueError):
        write_folder(tree, str(docs), missing_node_file="x")


def test_content_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, body string, tag string")
    content = content_from(rows, "id", "body", where="tag = 'x'")
    assert [tuple(r) for r in content.collect()] == [("1", "a", '{"tag":"x"}')]
    contents_to_table(content, f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t").columns == ["id", "text", "metadata"]
