"""Licences, pseudonyms, densities, term lookups and SQL against plain recomputation."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F

from branchlight.llm import licenses as lic, pii, quality, queries as q, toxicity as tox

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.sql(q.oracle_sql()[name])
    got = getattr(q, name)(spark, SF)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


# licences


def brute_licences(text):
    t = "" if text is None else text.lower()
    t = "\n".join(re.sub(r"^[ \t]*(?:rem|dnl)[ \t]", "", line) for line in t.split("\n"))
    parts = regex.split(r"\n[^\p{L}\p{N}\n]*\n|(?<=[.!?])(?<! v\.)\s", t)
    ids = []
    for part in parts:
        words = regex.sub(r"[^\p{L}\p{N}]+", " ", part).strip().split(" ")
        line = " ".join(words)
        line = regex.sub(r"neither the name of (?:[\p{L}\p{N}]+ ){1,12}?nor the names of (?:its|the) contributors", lic.ANY, line)
        line = regex.sub(r"\b(licensed|released|distributed|available|published|provided) under (the )?(terms of (the )?)?(the )?", "licensed under the ", line)
        words, at = line.split(" "), 0
        while at < len(words):
            # the longest known sentence that begins at this word
            best = max((s for s in lic.SENTENCES if words[at : at + len(s.split())] == s.split() and not (s.endswith("identifier mit") and words[at + 4 : at + 5] == ["0"])), key=len, default=None)
            if best:
                ids.append(lic.SENTENCES[best])
                at += len(best.split())
            else:
                at += 1
    names = set()
    for name, rule, want in lic.RULES:
        want = want.split()
        hit = any(follows(ids, want, k) for k in range(len(ids)))
        if hit and not (name == "BSD-2-Clause" and rule == "full" and any(follows(ids, "ea eb ec ed".split(), k) for k in range(len(ids)))):
            names.add(name)
    return " ".join(ids), ",".join(sorted(names))


def follows(ids, want, k):
    if k >= len(ids) or ids[k] != want[0]:
        return False
    return len(want) == 1 or any(follows(ids, want[1:], j) for j in range(k + 1, min(len(ids), k + 2 + lic.GAP)))


def test_licences_against_recomputation(spark):
    rng = random.Random(3)
    known, texts = list(lic.SENTENCES), [d["text"] for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    want = lambda: rng.choice(lic.RULES)[2].split()
    of = {}
    for s, i in lic.SENTENCES.items():
        of.setdefault(i, []).append(s)
    for _ in range(400):
        lines = []
        for i in want() + want():
            s = rng.choice(of[i]) if rng.random() < 0.9 else rng.choice(known)
            if rng.random() < 0.3:
                s = s.replace("licensed under the", rng.choice(["released under", "Distributed under the terms of the", "available under the"]))
            if rng.random() < 0.3:
                w = s.split()
                w.insert(rng.randrange(len(w)), rng.choice(["\n", ",", "\n# ", "extra"]))
                s = " ".join(w)
            lines.append(rng.choice(["", "Note: ", "// "]) + s.capitalize() + rng.choice([". ", ".\n", "\n\n", " "]))
        texts.append("".join(lines))
    texts += [None, "", "\n\n", ". . ."]
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"]) for r in lic.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: brute_licences(t) for i, t in enumerate(texts)} and sum(bool(x[1]) for x in got.values()) > 200


def test_every_known_sentence_has_a_cue_and_every_rule_known_sentences():
    assert all(regex.search(lic.CUE, s) for s in lic.SENTENCES)
    assert {i for _, _, w in lic.RULES for i in w.split()} <= set(lic.SENTENCES.values()) and len(lic.SENTENCES) < 200


@pytest.mark.parametrize(("text", "name"), [
    ("This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation", "GPL-3.0"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n", "Apache-2.0"),
    ("# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either\n# version 2.1 of the License, or (at your option) any later version.\n#\n# This library is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty of\n# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU\n# Lesser General Public License for more details.", "LGPL-2.1"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\nMERCHANTABILITY AND FITNESS.", "ISC"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
    ("Distributed under the terms of the GPLv3.", "GPL-3.0"),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.", "Unlicense"),
])
def test_common_licences(spark, text, name):
    wide = "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))
    narrow = "\n\n".join(re.sub(r"(.{1,55})( |$)", r"\1\n", " ".join(p.split())).rstrip("\n") for p in text.split("\n\n"))
    rows = [(0, text)] if "#" in text or "*" in text else [(0, text), (1, wide), (2, narrow)]
    assert {r["licenses"] for r in lic.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {name}


# pseudonyms


def feistel(x, sizes, key, undo=False):
    x, half = list(x), len(x) // 2
    for r in range(pii.ROUNDS)[:: -1 if undo else 1]:
        first = r % 2 == 0
        other = x[half:] if first else x[:half]
        text = f"{key},{r},{len(x)},{'.'.join(map(str, other))}"
        stream = hashlib.sha512(text.encode()).hexdigest() + hashlib.sha512((text + "+").encode()).hexdigest()
        for i in range(len(x)):
            if (i < half) == first:
                add = int(stream[(i % 32) * 8 : (i % 32) * 8 + 7], 16)
                x[i] = (x[i] + (-add if undo else add)) % sizes[i]
    return x


def alphabet(c):
    return "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def permuted(body, key, kind, undo=False):
    bare = [c for c in body if c.isascii() and c.isalnum()]
    if kind == "hex":
        joined = "".join(bare)
        one = "0123456789abcdef" if not re.search("[A-F]", joined) else "0123456789ABCDEF" if not re.search("[a-f]", joined) else None
        letters = [one or ("0123456789" if c.isdigit() else "abcdef" if c.islower() else "ABCDEF") for c in bare]
    else:
        letters = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" if kind == "secret" else alphabet(c) for c in bare]
    new = iter(a[v] for a, v in zip(letters, feistel([a.index(c) for a, c in zip(letters, bare, strict=True)], [len(a) for a in letters], f"k:{kind}", undo), strict=True))
    return "".join(next(new) if c.isascii() and c.isalnum() else c for c in body)


def test_pseudonyms_are_the_stated_permutation_and_can_be_undone(spark):
    rng = random.Random(1)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(20)] + [hashlib.md5(str(k).encode()).hexdigest().upper() for k in range(10)]
    keys = ["AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)) for _ in range(10)]
    mails = [f"{rng.choice(['ann', 'Bob.x', 'c_d'])}{digits(3)}@mail.example.org" for _ in range(20)]
    ips = [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(20)]
    ssns = [f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}" for _ in range(10)]
    values = [*(("hex", v) for v in hexes), *(("secret", v) for v in keys), *(("email", v) for v in mails), *(("ip", v) for v in ips), *(("ssn", v) for v in ssns)]
    got = [r["text"] for r in pii.pseudonymise(spark.createDataFrame([(i, v) for i, (_, v) in enumerate(values)], "i int, text string"), secret="k").orderBy("i").collect()]
    for (kind, v), new in zip(values, got, strict=True):
        if kind == "ip":
            a = [int(x) for x in v.split(".")]
            b = feistel([a[0] * 256 + a[1], a[2] * 256 + a[3]], [65536] * 2, "k:ip")
            assert new == ".".join(str(x) for y in b for x in divmod(y, 256))
            assert feistel(b, [65536] * 2, "k:ip", undo=True) == [a[0] * 256 + a[1], a[2] * 256 + a[3]]
            continue
        at, to = {"email": (0, v.find("@")), "secret": (4, len(v))}.get(kind, (0, len(v)))
        assert new == v[:at] + permuted(v[at:to], "k", kind) + v[to:]
        assert v[at:to] == permuted(new[at:to], "k", kind, undo=True)


def test_numbers_are_validated(spark):
    same = ["pages 100-200-3000", "order 1234-5678-90123", "12 345 6789", "no 000-12-3456", "no 666-12-3456", "no 912-12-3456", "no 123-00-4567", "no 123-45-0000", "card 9111111111111111", "not 4111111111111112", "+1 12", "13/32/2001", "00/13/2001"]
    moved = ["call 212-555-0147", "(212) 555-0147", "+1 (017) 555-7713", "+4930123456", "030 1234 5678", "ssn 123-45-6789", "amex 378282246310005", "mc 5555 5555 5555 4444", "on 12/31/1999", "on 31/12/1999"]
    rows = spark.createDataFrame(list(enumerate(same + moved)), "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in pii.pseudonym_report(rows, secret="k").collect()}
    texts = same + moved
    assert [got[i] for i in range(len(same))] == [(t, 0) for t in same]
    for i in range(len(same), len(texts)):
        assert got[i][1] == 1 and got[i][0] != texts[i] and re.sub(r"\d", "9", got[i][0]) == re.sub(r"\d", "9", texts[i]), texts[i]
    assert got[texts.index("mc 5555 5555 5555 4444")][0].startswith("mc 5555 ") and got[texts.index("amex 378282246310005")][0].startswith("amex 3782")


def test_month_first_dates_stay_apart_and_valid(spark):
    days = [f"{m:02d}/{d:02d}/{y}" for y in (1950, 1999, 2024) for m in range(1, 13) for d in range(13, 29)]
    got = [r["text"] for r in pii.pseudonymise(spark.createDataFrame([(d,) for d in days], "text string"), secret="k").collect()]
    assert len(set(got)) == len(days) and all(re.fullmatch(r"(0[1-9]|1[0-2])/(1[3-9]|2\d|3[01])/(19|20)\d\d", g) for g in got)


def test_replaced_values_are_counted_where_they_stand(spark):
    """A new address may hold an old one; repeated values count each time."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["1.2.3.4", "11.2.3.4", "a1@b.de", "4111111111111111", "4111111111111112", "word"]) for _ in range(6)) for _ in range(200)]
    valid = {"1.2.3.4", "11.2.3.4", "a1@b.de", "4111111111111111"}
    got = {r["doc_id"]: (r["n_values"], r["n_replaced"]) for r in pii.pseudonym_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), secret="k").collect()}
    for i, t in enumerate(texts):
        cards = 0 if re.search(r"4\d{15} 4", t) or re.search(r"4\d{15} 1", t) else 1
        if cards:  # numbers side by side are one value
            assert got[i][1] == sum(w in valid for w in t.split()), t


# quality


def test_densities_and_scores(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 6)) @ rng.standard_normal((6, 6)) + 2
    floor = np.full(6, 1e-2)
    g = quality.Gaussian.fit(x, 0.1, floor)
    s = np.cov(x.T, bias=True)
    s = 0.9 * s + 0.1 * np.diag(np.diag(s)) + np.diag(floor)
    d = x - x.mean(0)
    want = -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) + np.linalg.slogdet(s)[1])
    np.testing.assert_allclose(g.log_density(x), want, rtol=1e-8)


def test_statistics_of_small_texts():
    got = quality.statistics("The cat, the CAT!!\nthe cat 42")
    n, b = 7, len("The cat, the CAT!!\nthe cat 42")
    assert got[0] == pytest.approx(np.log1p(n)) and got[4] == pytest.approx(np.sqrt(4 / 18)) and got[5] == pytest.approx(np.sqrt(2 / b))
    assert got[7] == pytest.approx(np.sqrt(2 / n)) and got[8] == pytest.approx(np.sqrt(1 / n)) and got[15] == 1.0
    assert quality.statistics(None) == quality.statistics("") and all(np.isfinite(quality.statistics("")))


def test_quality_query_against_a_plain_fit(spark):
    """The whole of op8: labels, halves, shrunk covariances and the scale, from the definitions."""
    import zlib

    docs = {d["doc_id"]: d["text"] for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    y = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if r["quality"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    half = {r["doc_id"]: r["h"] for r in q.read(spark, SF, "labels").select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(98)), F.lit(2)).alias("h")).collect()}
    ids = sorted(i for i in y if i in docs)
    x = np.array([quality.statistics(docs[i]) for i in ids])
    a, c = np.array([half[i] == 0 for i in ids]), np.array([y[i] for i in ids])
    center, scale = x[a].mean(0), x[a].std(0) + 1e-6

    def density(z, own):
        s = np.cov(own.T, bias=True)
        s = 0.9 * s + 0.1 * np.diag(np.diag(s)) + 0.01 * np.eye(len(s))
        d = z - own.mean(0)
        return -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) + np.linalg.slogdet(s)[1])

    def line(rows):
        z, own = (rows - center) / scale, (x[a] - center) / scale
        d = density(z, own[c[a] == 1]) - density(z, own[c[a] == 0])
        return np.column_stack([np.arcsinh(d), np.clip(d, -20, 20)])

    w = quality.logistic(line(x[~a]), c[~a].astype(float))
    # a minimum of the ridge loss: its gradient is zero
    f = np.column_stack([line(x[~a]), np.ones((~a).sum())])
    np.testing.assert_allclose(f.T @ (1 / (1 + np.exp(-f @ w)) - c[~a]) + np.array([1, 1, 1e-6]) * w, 0, atol=1e-5)
    every = sorted(docs)
    u = np.column_stack([line(np.array([quality.statistics(docs[i]) for i in every])), np.ones(len(every))]) @ w
    want = dict(zip(every, 1 / (1 + np.exp(-np.clip(u, -40, 40))), strict=True))
    got = {r["doc_id"]: r["score"] for r in q.op8_quality(spark, SF).collect()}
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[i] for i in every], [want[i] for i in every], atol=1e-6)


# toxicity


def distance(a, b):
    """Edits from a to b, swapped neighbours counting as one."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_lookup_finds_what_all_distances_find():
    rng = random.Random(6)
    word = lambda lo, hi: "".join(rng.choice("abcd") for _ in range(rng.randint(lo, hi)))
    terms = {(word(2, 12), False): rng.uniform(1, 5) for _ in range(25)} | {(word(4, 6), True): rng.uniform(1, 5) for _ in range(8)} | {("x" * 70, False): 3.0, ("y" * 60, False): 2.0}
    lexicon = tox.Lexicon(terms, forms={"abcd": 0.5})
    near = lambda t: "".join(rng.choice([c, c, c, c, rng.choice("abcd"), "", c + rng.choice("abcd")]) for c in t)
    words = [word(2, 14) for _ in range(600)] + [near(t) for t, _ in terms for _ in range(12)] + ["abcd" * 30, "x" * 70, "x" * 69, "y" * 61, "y" * 64]
    hit = 0
    for w in words:
        best = (0.0, 0)
        for (t, stem), weight in terms.items():
            if not stem and abs(len(w) - len(t)) > 2 or not w:
                continue
            d = min(distance(w[:k], t) for k in range(min(len(w), len(t) + 2) + 1)) if stem else distance(w, t)
            if d <= tox.errors(t, stem):
                best = max(best, (weight / (1 + d) * (0.5 if d and w == "abcd" else 1), d))
        assert lexicon.lookup(w) == best if w else True, w
        hit += best[0] > 0
    assert hit > 200


def test_misspelled_and_short_terms(spark):
    rng = random.Random(8)
    vocab = [f"{a}{b}{c}" for a in "bdfg" for b in ("oru", "ami", "eli", "unu") for c in ("sto", "nan", "per", "lik")]
    fill = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, labels = [], []
    for i in range(900):
        w = fill(40)
        if toxic := i % 6 == 0:
            w[rng.randrange(40)] = rng.choice(["zqxw", "kwyjibo", "qz"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    test = {1000: "zqxw", 1001: "zqxxw", 1002: "zxqw", 1003: "kwyjubo", 1004: "qz", 1005: vocab[0], 1006: "kwyj1bo"}
    rows += [(i, " ".join([*fill(20), t, *fill(20)])) for i, t in test.items()]
    got = {r["doc_id"]: r["predicted"] for r in tox.toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert [got[i] for i in test] == [1, 1, 1, 1, 1, 0, 1] and np.mean([got[i] == y for i, y in labels]) > 0.99


def test_words_that_may_match_pass_the_first_test():
    """Whatever lookup() finds, the test by length and characters lets through."""
    rng = random.Random(12)
    word = lambda lo, hi: "".join(rng.choice("abcdéß日") for _ in range(rng.randint(lo, hi)))
    terms = {(word(4, 11), False): 2.0 for _ in range(30)} | {(word(4, 6), True): 1.5 for _ in range(10)} | {(word(2, 3), False): 1.0 for _ in range(3)}
    lookups = tox.Lookups(tox.Lexicon(terms))
    words = sorted({word(2, 13) for _ in range(3000)} | {t[1:] + t[0] for t, _ in terms} | {t[:2] + t[3:2:-1] + t[4:] + "x" for t, _ in terms} | {t + "ab" for t, _ in terms})
    found = lookups.found([words, [f"({w})!" for w in words]])
    assert {w for w in words if lookups.lexicon.lookup(w)[0]} == {w for w in found if w in words} and len(found) > 200
    assert all(found[f"({w})!"] == found[w] for w in words if w in found)
