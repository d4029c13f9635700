"""The queries opN_<name> against plain recomputation over whole tables."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from branchlight.llm import queries as q

SF = "/root/testdata/sf0.01"


def table(name, sf=SF):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs():
    return table("documents")


def least_reachable(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def test_substring_dedup(spark, docs):
    first, words = {}, {d["doc_id"]: (d["text"] or "").encode().split() for d in docs}
    for i, w in words.items():
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    want = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        left = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(left).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in q.op2_substring_dedup(spark, SF).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 1000


def test_substring_dedup_of_records_that_differ_in_the_middle(spark):
    """Lines of one template, whose anchor recurs, so that runs are long; the copy has one other value."""
    from branchlight.llm.substring_dedup import substring_dedup

    rng, texts = np.random.default_rng(6), []
    for p in range(300):
        records = [[*(f"t{p}x{k}" for k in range(5)), f"v{v}"] for v in rng.integers(0, 1 << 40, 12)]
        texts.append([w for r in records for w in r])
        records[int(rng.integers(3, 9))][5] = "edited"
        texts.append([w for r in records for w in r])
    first, want = {}, {}
    for i, w in enumerate(texts):
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), i) < i:
                gone[k : k + 13] = True
        want[i] = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in substring_dedup(docs).collect()} == want


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(q.tokenizer("word_bpe_49k.json"))
    ids = {d["doc_id"]: np.array([*e.ids, 2], "<u4") for d, e in zip(docs, full.encode_batch([d["text"] or "" for d in docs], add_special_tokens=False), strict=True)}
    got = q.op3_hilbert_packing(spark, SF).collect()
    covered, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] > 0 and zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        covered[r["doc_id"]].append((r["start"], r["length"]))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans, n in [*((covered[i], len(x)) for i, x in ids.items()), *((s, None) for s in seqs.values())]:
        at = 0
        for start, k in sorted(spans):
            assert start == at
            at += k
        assert at == n if n else at <= 4096 and at & (at - 1) == 0
    sizes = [sum(k for _, k in s) for s in seqs.values()]
    assert sum(sizes) == sum(map(len, ids.values())) and sum(s < 4096 for s in sizes) <= 12


def test_simhash(spark, docs):
    import xxhash

    fp = {}
    for d in docs:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (d["text"] or "").encode()).split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        fp[d["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(fp)
    x = np.array([fp[i] for i in ids], np.uint64)
    links = [(ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(x[i] ^ x) <= 4) if j > i]
    root = least_reachable(ids, links)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in q.op4_simhash(spark, SF).collect()}
    assert got == {i: (f"{fp[i]:016x}", root[i]) for i in ids} and links


def test_simhash_tiles_find_what_all_pairs_find(spark):
    """Large groups, cut into tiles of 16, against all pairs."""
    from branchlight.llm.simhash import links

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    x = np.unique(np.array([b ^ np.uint64(sum({1 << int(k) for k in rng.integers(0, 64, rng.integers(0, 8))})) for b in base for _ in range(200)], np.uint64))
    signed = x.view(np.int64).tolist()
    want = [(signed[i], signed[j]) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i] ^ x) <= 4) if j > i]
    for k in (1, 2, 3):
        got = [(r["u"], r["v"]) for r in links(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, tile=16, k=k).collect()]
        assert least_reachable(signed, got) == least_reachable(signed, want) and {frozenset(e) for e in got} <= {frozenset(e) for e in want}


def shingles(text):
    w = (text or "").lower().encode().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()}


def test_near_texts_against_jaccard(spark, docs):
    """Groups against those of all pairs at Jaccard index 0.8; what is under 0.65 to all others of its group must not be there."""
    from branchlight.llm.simhash import near_texts

    sets = {d["doc_id"]: shingles(d["text"]) for d in docs}
    inverted = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    common = defaultdict(int)
    for ids in inverted.values():
        for a in range(len(ids)):
            for b in range(a + 1, len(ids)):
                common[ids[a], ids[b]] += 1
    index = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in common.items()}
    got = {r["doc_id"]: r["component"] for r in near_texts(q.read(spark, SF, "documents")).collect()}
    near = [p for p, j in index.items() if j >= 0.8]
    found = [got[a] == got[b] for a, b in near]
    assert near and np.mean(found) >= 0.9 and all(got[a] == got[b] for (a, b), j in index.items() if j >= 0.88)
    fair = least_reachable(list(got), [p for p, j in index.items() if j >= 0.65])
    assert all(fair[i] == fair[c] for i, c in got.items()) and len({c for c in got.values()}) < len(got)


def test_near_texts_in_large_groups(spark):
    """One base text, copies with some words changed and chains of edits, cut into tiles of 8: as in one tile."""
    from branchlight.llm.simhash import near_texts

    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in rng.integers(0, 200, i % 9):
            w[k] = f"x{rng.integers(1 << 30)}"
        rows.append(w)
    w = list(base)
    for i in range(60):  # a chain that leads away
        w[(i * 3) % 200] = f"y{i}"
        rows.append(list(w))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    whole, cut = ({r["doc_id"]: r["component"] for r in near_texts(df, tile=t).collect()} for t in (4096, 8))
    assert whole == cut and sum(c == 0 for c in cut.values()) > 120


def test_spanning_reaches_what_all_pairs_reach():
    from branchlight.llm.simhash import spanning

    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, (5, 2), dtype=np.uint64)[rng.integers(0, 5, 300)]
    x = x ^ np.array([[sum({1 << int(k) for k in rng.integers(0, 63, 5)}) for _ in range(2)] for _ in range(300)], np.uint64)
    pairs = [(i, j) for i in range(300) for j in range(i) if int(np.bitwise_count(x[i] ^ x[j]).sum()) <= 14]
    got = spanning(x, 14)
    assert least_reachable(range(300), got) == least_reachable(range(300), pairs) and {frozenset(e) for e in got} <= {frozenset(e) for e in pairs} and pairs


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_embeddings(spark, sf):
    rows = table("embeddings", sf)
    x = np.array([r["embedding"] if r["embedding"] and all(c is not None for c in r["embedding"]) else [0.0] * 64 for r in rows], float)
    norm = np.linalg.norm(x, axis=1)
    ok = np.isfinite(norm) & (norm > 0) & np.array([r["label"] is not None for r in rows])
    x[~ok] = 0
    x[ok] /= norm[ok, None]
    label = np.array([-1 if r["label"] is None else r["label"] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :]) & ok[:, None] & ok[None, :]
    np.fill_diagonal(near, False)
    ids = [r["vec_id"] for r in rows]
    root = least_reachable(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near), strict=True)])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in q.op7_embedding_dedup(spark, sf).collect()}
    assert got == {i: (int(n), root[i], root[i] == i) for i, n in zip(ids, near.sum(1), strict=True)}


@pytest.mark.parametrize("size", [None, 32, 64, 128])
def test_embedding_recall(spark, size):
    """Pairs at cosines just over the bound, in one label, with large groups cut into tiles, at codebooks of larger tables: recall over 0.99, none below the bound."""
    from branchlight.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(3)
    c = rng.standard_normal((60, 64))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = np.repeat(c, 20, 0) + rng.standard_normal((1200, 64)) * 0.0125
    x = np.concatenate([x, rng.standard_normal((800, 64))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tile=16, size=size).collect()}
    n = near.sum(1)
    assert all(got[i] <= n[i] for i in range(len(x)))
    assert sum(got.values()) >= 0.99 * n.sum() > 0


@pytest.mark.parametrize("kind", ["long", "smallint", "string", "decimal(9,0)"])
def test_embeddings_of_repeated_ids(spark, kind):
    """Each row is a vector of its own, whatever its id: vectors of one id in several labels and directions, against all pairs."""
    from branchlight.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(8)
    base = rng.standard_normal((6, 8))
    rows = [(int(rng.integers(0, 12)), (base[rng.integers(0, 6)] + 0.03 * rng.standard_normal(8) * (k % 3)).tolist(), int(rng.integers(0, 3)) or None) for k in range(90)]
    rows += rows[:9] + [(3, [0.0, -0.0, 1.0], 1), (4, [-0.0, 0.0, 1.0], 1)]
    u = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][2] is not None and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= 0.98]
    root = least_reachable(range(len(rows)), links)
    least, n = {}, defaultdict(int)
    for i, r in root.items():
        least[r] = min(least.get(r, 99), rows[i][0])
    for i, j in links:
        n[i] += 1
        n[j] += 1
    want = sorted((r[0], n[i], least[root[i]]) for i, r in enumerate(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr(f"cast({'lpad(vec_id, 2, 0)' if kind == 'string' else 'vec_id'} as {kind}) as vec_id", "embedding", "label")
    assert sorted((int(r["vec_id"]), r["n_links"], int(r["component"])) for r in near_vectors(df).collect()) == want


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(q.tokenizer("byte_bpe_50k.json"))
    n = [len(e.ids) for e in full.encode_batch([d["text"] or "" for d in docs], add_special_tokens=False)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in q.op9_token_counts(spark, SF).collect()}
    assert got == {d["doc_id"]: (len((d["text"] or "").encode()), k, k > 512) for d, k in zip(docs, n, strict=True)}


def test_odd_texts_encode_as_the_library_does():
    from hypothesis import given, settings, strategies as st
    from tokenizers import Tokenizer

    from branchlight.llm.packing import Words
    from branchlight.llm.token_counts import Counter, whole_tokens

    bpe, word = q.tokenizer("byte_bpe_50k.json"), q.tokenizer("word_bpe_49k.json")
    counter, words = Counter(bpe, whole_tokens(bpe)), Words(word, "<u2")
    libs = Tokenizer.from_file(bpe), Tokenizer.from_file(word)
    bits = st.sampled_from(["the", "'ll", "'LL", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", "\xa0", " ", "﻿", "​", "É", "ß", "İ", "ǆ", "ﬁ", "é", "½", "²", "٣", "日本", "👍🏽", "<|endoftext|>", "<|startoftext|>", "|", "x1y2", "...", "-->", "DON'T", "_", "ª", "ʼ", "İ"])

    @settings(max_examples=1500, deadline=None)
    @given(st.lists(st.one_of(bits, st.text(max_size=6)), max_size=12).map("".join))
    def same(text):
        assert counter.count(text) == len(libs[0].encode(text, add_special_tokens=False).ids)
        assert np.frombuffer(words.ids(text), "<u2").tolist() == libs[1].encode(text, add_special_tokens=False).ids

    same()


def local_alignment(a, b):
    """Smith-Waterman cell by cell."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return best


@pytest.mark.parametrize("n", [3, 5])
def test_decontamination(spark, n):
    import random
    import re

    from branchlight.llm.decontamination import contamination

    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(300)]
    items = [[rng.choice(vocab) for _ in range(rng.randint(8, 40))] for _ in range(12)]
    texts = []
    for k in range(60):
        t = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        if k % 3:
            it = list(items[k % 12])
            for _ in range(rng.randint(0, len(it) // 3)):
                p = rng.randrange(len(it))
                it[p : p + 1] = rng.choice([[], [rng.choice(vocab)], [it[p], rng.choice(vocab)]]) if len(it) > 4 else [it[p]]
            at = rng.randint(0, len(t))
            t[at:at] = it
        texts.append(" ".join(t).title() + ".")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(k, ", ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    want = {}
    for i, t in enumerate(texts):
        d = re.findall(r"\w+", t.lower())
        grams = {tuple(d[k : k + n]) for k in range(len(d) - n + 1)}
        for k, it in enumerate(items):
            if any(tuple(it[p : p + n]) in grams for p in range(len(it) - n + 1)) and (s := local_alignment(it, d)) >= len(it):
                want[i, k] = s / (2 * len(it))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in contamination(docs, bench, n=n).collect()}
    blocks = {(r["doc_id"], r["item_id"]): r["score"] for r in contamination(docs, bench, n=n, block_bytes=400).collect()}
    assert got == want == blocks and len(want) > 20


def test_decontamination_of_edited_and_short_items(spark):
    """Copies with a fifth of the words changed: nearly all that the alignment accepts are found. Short items are found whole, in any type of id."""
    import random

    from branchlight.llm.decontamination import contamination

    rng = random.Random(5)
    items = [[f"v{rng.randrange(5000)}" for _ in range(15)] for _ in range(100)] + [["tiny", "item"], ["single"]]
    texts, accepted = [], 0
    for it in items[:100]:
        c = list(it)
        for p in rng.sample(range(15), 4):
            c[p] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(c))
    texts += ["a tiny item here", "tiny and item", "nothing", "Single."]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for kind in ("smallint", "string", "decimal(9,0)"):
        bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string").selectExpr(f"cast(item_id as {kind}) as item_id", "text")
        got = {(r["doc_id"], int(r["item_id"])) for r in contamination(docs, bench).collect()}
        assert {p for p in got if p[0] >= 100} == {(100, 100), (103, 101)}
        accepted = [i for i in range(100) if local_alignment(items[i], texts[i].split()) >= 15]
        assert sum((i, i) in got for i in accepted) >= 0.97 * len(accepted) and len(accepted) == 100


def test_decontamination_query_finds_whole_items(spark, docs):
    items = [(b["item_id"], " ".join(b["text"].split())) for b in table("benchmark")]
    want = {(d["doc_id"], k) for d in docs for k, t in items if t in " ".join((d["text"] or "").split())}
    got = {(r["doc_id"], r["item_id"]) for r in q.op1_decontamination(spark, SF).collect()}
    assert want and want <= got


def auc(rows):
    pos, neg = ([s for s, y in rows if y == c] for c in (1, 0))
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize(("query", "label", "folds", "fold", "least"), [("op8_quality", "quality", 5, 0, 0.9), ("op10_toxicity", "toxic", 4, 2, 0.9)])
def test_held_out_accuracy(spark, query, label, folds, fold, least):
    sf = "/root/testdata/sf0.1"
    y = {r["doc_id"]: r[label] for r in table("labels", sf)}
    got = getattr(q, query)(spark, sf).collect()
    assert len(got) == len(table("documents", sf))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [(r["score"], r["predicted"], y[r["doc_id"]]) for r in got if r["held_out"] and y.get(r["doc_id"]) is not None]
    a, right = auc([(s, c) for s, _, c in held]), np.mean([p == c for _, p, c in held])
    print(query, len(held), a, right)
    assert a >= least and right >= 0.85
