import numpy as np
import pytest
from pyspark.sql import functions as F

from branchlight.functions import text as tx
from branchlight.functions.vectors import distance, normalise
from branchlight.operators.embedders import BaseTextEmbedder, embed, retried
from branchlight.operators.labels import keywords
from branchlight.operators.pca import PCAState, fit_pca, transform_pca


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(c)) for c in x])
    assert one(spark, normalise(v(3, 4))) == [0.6, 0.8]
    assert one(spark, normalise(v(0, 0))) == [0, 0]
    assert one(spark, distance(v(0, 0), v(3, 4))) == 5


def test_text(spark):
    assert one(spark, tx.clean_label(F.lit('"Animal Topics."\nmore'))) == "Animal Topics"
    assert one(spark, tx.clean_label(F.lit("one two three four"), 3)) == "one two three"
    assert one(spark, tx.clean_label(F.lit(""))) == ""
    assert one(spark, tx.safe_name(F.lit(' a/b:c?. '))) == "a b c" and one(spark, tx.safe_name(F.lit("..."))) == "untitled"
    assert len(one(spark, tx.short(F.lit("x " * 80)))) == 60
    assert one(spark, tx.multi_hot_list(F.array(F.lit("b"), F.lit("z")), ["a", "b", "b"])) == [0, 1]
    assert one(spark, tx.multi_hot_text(F.lit("Docs here"), ["docs", "ingest"])) == [1, 0]
    with pytest.raises(Exception, match="unknown tags"):
        one(spark, tx.multi_hot_list(F.array(F.lit("z")), ["a"], "error"))
    with pytest.raises(ValueError):
        tx.multi_hot_list(F.array(F.lit("z")), ["a"], "x")


def test_keywords(spark):
    rows = spark.createDataFrame([(1, "g", "python code"), (2, "g", "python script"), (3, "g", "python module"), (4, "h", "  ")], "content_id long, g string, text string")
    got = keywords(rows, "g", top_k=2).orderBy("rank").collect()
    assert got[0]["term"] == "python" and {r["g"] for r in got} == {"g"}


def test_pca_round_trip(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((40, 3)) * [3, 2, 0.1]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    state = fit_pca(rows, 2)
    got = np.array([r["reduced"] for r in transform_pca(rows, PCAState.from_dict(state.to_dict())).orderBy("id").collect()])
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    np.testing.assert_allclose(np.abs(got), np.abs((x - x.mean(0)) @ vt[:2].T), atol=1e-8)
    halves = PCAState().add(rows.where("id < 20")).add(rows.where("id >= 20")).solve(2)
    np.testing.assert_allclose(halves.components, state.components, atol=1e-8)
    with pytest.raises(RuntimeError):
        transform_pca(rows, PCAState())


def test_embed_fills_only_what_is_missing(spark):
    rows = spark.createDataFrame([(1, "a", [9.0]), (2, "bb", None), (3, "bb", None), (4, "c", None)], "id long, text string, embedding array<float>")
    cache = spark.createDataFrame([("c", [7.0])], "t string, vector array<float>").select(F.md5("t").alias("text_md5"), "vector")
    got = {r["id"]: r["embedding"] for r in embed(rows, lambda: lambda texts: [[float(len(t))] for t in texts], cache=cache).collect()}
    assert got == {1: [9.0], 2: [2.0], 3: [2.0], 4: [7.0]}


def test_retry():
    calls = []

    def f(x):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return x

    assert retried(f, ["a"], base=0.001) == ["a"] and len(calls) == 3
    with pytest.raises(OSError):
        retried(lambda x: (_ for _ in ()).throw(OSError()), [], max_retries=1, base=0.001)


def test_many_queries_are_dealt_and_not_collected(spark):
    from branchlight.operators.knn import knn_exact

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((300, 5)), np.ones((40, 5))])
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "content_id long, vector array<double>")
    asked = items.where("content_id % 3 = 0").selectExpr("concat('q', content_id) as query_id", "vector")
    few, many = (sorted(map(tuple, knn_exact(items, asked, 7, broadcast=b, bucket=50).select("query_id", "rank", "content_id", F.round("distance", 9)).collect())) for b in (1 << 20, 10))
    assert few == many and len(few) == 7 * asked.count()
    assert knn_exact(items, asked, 0).count() == 0


def test_reducers_and_projector():
    from branchlight.config import TreeConfig
    from branchlight.operators.reducers import FreezePCAReducer, IdentityReducer, PCAConfig, PCAProjector, Reducer, VectorProjector

    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 5)) * [5, 3, 1, 0.5, 0.1]
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    for mode in ("freeze", "incremental"):
        r = Reducer.from_config(TreeConfig(pca_dims=2, pca_mode=mode))
        with pytest.raises(RuntimeError):
            r.transform(x)
        for part in (x[:20], x[20:45], x[45:]) if mode == "incremental" else (x[:9], x):
            r.partial_fit(part)
        np.testing.assert_allclose(np.abs(r.transform(x)), np.abs((x - x.mean(0)) @ vt[:2].T), atol=1e-8)
        np.testing.assert_allclose(Reducer.from_dict(r.to_dict()).transform(x), r.transform(x))
        r.fit(x[:10])
        assert r.state.n == 10
    assert isinstance(Reducer.from_config(TreeConfig()), IdentityReducer) and Reducer.from_dict({"kind": "identity"}).is_fitted
    with pytest.raises(ValueError, match="unknown reducer kind"):
        Reducer.from_dict({"kind": "x"})
    p = PCAProjector(PCAConfig(dims=3))
    assert isinstance(p, VectorProjector) and not p.is_fitted
    p.fit(x)
    assert PCAProjector.from_dict(p.to_dict())(x).shape == (60, 3) and FreezePCAReducer(9).is_fitted is False
    with pytest.raises(ValueError):
        PCAProjector(PCAConfig(dims=1))


class Lengths(BaseTextEmbedder):
    def vectors(self, texts):
        if self.__dict__.setdefault("broken", 0):
            self.broken -= 1
            raise OSError
        self.calls = getattr(self, "calls", 0) + 1
        return [[len(t), 1.0] for t in texts]


def test_embedder_objects():
    from types import SimpleNamespace as S

    from branchlight.operators.embedders import HuggingFaceTextEmbedder, OpenAITextEmbedder, TagSetEmbedder, TextEmbedder, embed_texts

    e = Lengths(backoff_base=0.001)
    e.broken = 2
    assert isinstance(e, TextEmbedder) and e.embed_batch(["a", "bb", "a"]).tolist() == [[1, 1], [2, 1], [1, 1]] and e("bb").dtype == np.float32 and e.calls == 1
    e.cache_clear()
    e("bb")
    assert e.calls == 2
    bad = Lengths(max_retries=1, backoff_base=0.001)
    bad.broken = 5
    with pytest.raises(OSError):
        bad("a")
    assert np.allclose(np.linalg.norm(Lengths(normalize=True).embed_batch(["abc"]), axis=1), 1)
    t = TagSetEmbedder(["docs", "api", "docs"])
    assert t("The DOCS").tolist() == [1, 0] and t(["api", "x"]).tolist() == [0, 1] and t({"tags": ["docs"]}).tolist() == [1, 0] and t({}).tolist() == [0, 0]
    with pytest.raises(ValueError, match="unknown tags: x"):
        TagSetEmbedder(["docs"], unknown="error")(["x"])
    seen = []
    model = S(encode=lambda texts, convert_to_numpy, **k: seen.append((list(texts), k)) or np.ones((len(texts), 2)))
    assert HuggingFaceTextEmbedder(model_obj=model, encode_kwargs={"batch_size": 4}).embed_batch(["a", "b"]).tolist() == [[1, 1], [1, 1]] and seen == [(["a", "b"], {"batch_size": 4})]
    client = S(embeddings=S(create=lambda **k: seen.append(k) or S(data=[S(embedding=[0.5, 0.5]) for _ in k["input"]])))
    assert OpenAITextEmbedder(client=client, dimensions=2).embed_batch(["a", "b"]).shape == (2, 2) and seen[-1] == {"model": "text-embedding-3-small", "input": ["a", "b"], "dimensions": 2}
    assert OpenAITextEmbedder(client=lambda: client)("a").tolist() == [0.5, 0.5]
    with pytest.raises(ImportError):
        HuggingFaceTextEmbedder(max_retries=0)("a")
    assert embed_texts(lambda s: [len(s)], ["a", "bb"]).tolist() == [[1], [2]] and embed_texts(e, ["a"]).tolist() == [[1, 1]]


def test_labelers(spark):
    from types import SimpleNamespace as S

    from branchlight.config import LLMConfig
    from branchlight.operators.labels import FunctionLabeler, KeywordLabeler, LabelCandidate, Labeler, LabelRequest, LLMLabeler, english_stop_words, keyword_labels, labels_by

    request = lambda *texts, n=6: LabelRequest([LabelCandidate(i, t) for i, t in enumerate(texts)], n)
    assert KeywordLabeler(top_k=2).label(request("the python code", "and a python script", "python module")).startswith("python")
    assert KeywordLabeler().label(request()) == KeywordLabeler().label(request("", " ")) == KeywordLabeler().label(request("the and of")) == ""
    stop = english_stop_words()
    assert {"the", "and", "of", "across", "whereupon", "will"} <= stop and not {"cat", "python", "did", "having"} & stop and 280 < len(stop) < 360
    asked = []
    client = S(chat=S(completions=S(create=lambda **k: asked.append(k) or S(choices=[S(message=S(content='"Animal Topics."\nmore'))]))))
    made = LLMLabeler(LLMConfig(provider="openai"), client=client)
    assert isinstance(made, Labeler) and made.label(request(*"abc")) == "Animal Topics" and list(made.stream(request("a"))) == ["Animal Topics"]
    assert (asked[0]["model"], asked[0]["temperature"], asked[0]["max_tokens"]) == ("gpt-4o-mini", 0, 24)
    made.label(request(*map(str, range(40))))
    assert asked[-1]["messages"][0]["content"].count("\n- ") == 20
    local = lambda prompt, **k: [{"generated_text": "one two three four"}]
    assert LLMLabeler(LLMConfig(provider="local"), pipeline=local).label(request("a", n=3)) == "one two three" and LLMLabeler().label(request("a")) == ""
    for p in ("openai", "local"):
        with pytest.raises(ImportError):
            LLMLabeler(LLMConfig(provider=p)).label(request("a"))
    f = FunctionLabeler(lambda r: (c.text for c in r.candidates))
    assert f.label(request(" a", "b ")) == "ab" and list(f.stream(request("a", "b"))) == ["a", "b"] and FunctionLabeler(lambda r: " x ").label(request()) == "x"
    rows = [(n, i + 1, f"c{i}", t, 0.1 * i, '{"k": 1}') for n, texts in {1: ["the cat and a dog", "the cat", "cats"], 2: ["the of"], 3: ["zebra zebra apple", "apple", "pear"]}.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "node_id long, rank int, content_id string, text string, distance double, metadata string")
    want = {n: KeywordLabeler().label(request(*[r[3] for r in rows if r[0] == n])) for n in (1, 2, 3)}
    assert {r["node_id"]: r["label"] for r in keyword_labels(df, KeywordLabeler()).collect()} == want and want[2] == "" and "the" not in want[1]
    got = labels_by(df, FunctionLabeler(lambda r: f"{r.candidates[0].id} {r.candidates[0].metadata['k']} {r.max_words}"), 4).collect()
    assert {r["label"] for r in got} == {"c0 1 4"}


def test_numbers_within_hot_keys(spark):
    from branchlight.operators.numbers import numbered_in
    from branchlight.sources.folders import deduped

    rows = spark.createDataFrame([(i, "hot" if i % 10 else None, (i * 7919) % 5003) for i in range(5000)], "id long, k string, o long")
    got = numbered_in(rows, ["k"], ["o"], "n").collect()
    by = {}
    for r in sorted(got, key=lambda r: r["o"]):
        by.setdefault(r["k"], []).append(r["n"])
    assert len(got) == 5000 and all(n == list(range(1, len(n) + 1)) for n in by.values())
    names = [("p", n) for n in ("x", "x", "x-2", "y", "x", "y-2", "y", "x-2", "z-2", "z", "z-2")] + [("q", "x"), ("q", "x")]
    df = spark.createDataFrame([(i, p, n) for i, (p, n) in enumerate(names)], "i long, p string, n string")
    used, want = {}, []
    for p, n in names:
        new, k = n, 1
        while new in used.setdefault(p, set()):
            k += 1
            new = f"{n}-{k}"
        used[p].add(new)
        want.append(new)
    assert [r["out"] for r in deduped(df, ["p"], "n", ["i"], "out").orderBy("i").collect()] == want
