"""Nulls, empty and very long texts, repeated rows, empty tables, and extra columns whose names clash."""

import pytest
from pyspark.sql import Row, functions as F

from branchlight.llm import queries as q
from branchlight.llm.decontamination import clean, contamination
from branchlight.llm.embedding_dedup import near_vectors
from branchlight.llm.licenses import licenses
from branchlight.llm.packing import pack
from branchlight.llm.pii import pseudonym_report, pseudonymise
from branchlight.llm.quality import quality_scores
from branchlight.llm.simhash import simhash
from branchlight.llm.substring_dedup import substring_dedup
from branchlight.llm.token_counts import token_counts
from branchlight.llm.toxicity import toxicity_scores

WORDS = " ".join(f"word{k} mail{k}@example.com" if k % 50 == 0 else f"word{k}" for k in range(30_000))
ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, WORDS), (5, ITEM), (5, ITEM), (6, ITEM + " fifteen"), (None, ITEM), (None, None), (7, "x"), (8, WORDS)]
EXTRA = "id part skey tie fp label at component anchor anchors marks held_out score n_tokens item half least".split()


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(EXTRA)], F.lit("en").alias("lang"), F.length("text").cast("long").alias("n_chars"))


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, TEXTS)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short"), (None, "alpha beta gamma delta epsilon zeta"), (1, ITEM)], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (None, 1, 1), (4, None, None), (5, 1, 1), (5, 1, 1), (99, 7, 7)], "doc_id long, quality int, toxic int")


def by_id(rows, *cols):
    return sorted(((r["doc_id"], *(r[c] for c in cols)) for r in rows), key=repr)


IDS = sorted((i for i, _ in TEXTS), key=repr)


def test_decontamination(odd, none, bench):
    got = contamination(odd, bench).collect()
    assert by_id(got, "item_id") == [(5, 1), (5, 1), (6, 1), (None, 1)] and all(r["score"] == 1.0 for r in got)
    left = clean(odd, bench)
    assert left.columns == odd.columns and by_id(left.collect()) == sorted(((i,) for i, t in TEXTS if not t or ITEM not in t), key=repr)
    assert not contamination(none, bench).collect() and not clean(none, bench).collect()
    assert clean(odd, bench.limit(0)).count() == len(TEXTS) and not contamination(odd, bench.limit(0)).collect()


def test_substring_dedup(odd, none):
    got = substring_dedup(odd).collect()
    n = len(WORDS.split())
    want = [(1, 0, 0, ""), (2, 0, 0, ""), (3, 0, 0, ""), (4, n, 0, WORDS), (5, 14, 0, ITEM), (5, 14, 0, ITEM), (6, 15, 14, "fifteen"), (None, 14, 0, ITEM), (None, 0, 0, ""), (7, 1, 0, "x"), (8, n, n, "")]
    assert by_id(got, "n_words", "n_removed", "kept") == sorted(want, key=repr)
    assert {r["doc_id"]: r["spans"] for r in got if r["n_removed"]} == {6: [0, 14], 8: [0, n]}
    assert not substring_dedup(none).collect()


def test_packing(odd, none):
    got = pack(odd, q.tokenizer("word_bpe_49k.json")).collect()
    assert sorted((r["doc_id"] for r in got if r["start"] == 0), key=repr) == IDS
    assert [r["length"] for r in got if r["doc_id"] in (1, 2, 3)] == [1, 1, 1]
    assert not pack(none, q.tokenizer("word_bpe_49k.json")).collect()


def test_simhash(odd, none):
    got = simhash(odd).collect()
    top = {(r["doc_id"], r["fp"] == 0): r["component"] for r in got}
    assert sorted((r["doc_id"] for r in got), key=repr) == IDS
    assert top[1, True] == top[2, True] == top[3, True] == top[None, True] == 1 and top[8, False] == 4 and top[5, False] == top[None, False] == 5
    assert not simhash(none).collect()


def test_licenses_and_pseudonyms(odd, none):
    assert sorted((r["doc_id"] for r in licenses(odd).collect()), key=repr) == IDS and not licenses(none).collect()
    got = pseudonymise(odd, secret="k")
    assert got.columns == odd.columns
    rows = {r["doc_id"]: r["text"] for r in got.collect()}
    assert rows[1] is None and rows[2] == "" and rows[3] == " \n\t " and len(rows[4]) == len(WORDS) and rows[4] == rows[8] != WORDS and "mail50@" not in rows[4]
    assert {(r["n_values"], r["n_replaced"]) for r in pseudonym_report(odd, secret="k").where("doc_id in (4, 8)").collect()} == {(600, 600)}
    assert not pseudonym_report(none, secret="k").collect() and not pseudonymise(none, secret="k").collect()


def test_licence_rules(spark):
    texts = ["Released under the MIT License.", "Intro. Licensed under CC BY-NC 4.0.\nMore.", "This work is licensed under the GNU General Public License, version 3.", "MIT", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."]
    got = [r["licenses"] for r in licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["MIT", "CC-BY-NC-4.0", "GPL-3.0", "", "Apache-2.0"]


MIT = """MIT License

Copyright (c) 2019-2021 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
THIRD = """

3. Neither the name of Example Org, Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


def test_wrapped_licences(spark):
    notes = "\n".join(f"# {line}".rstrip() for line in GPL.split("\n"))
    other = BSD.replace("\n\n2.", "\n\nAll rights reserved.\n\n2.")
    texts = [MIT, BSD, BSD + THIRD, GPL, notes, other, "This code is released under the MIT License.", "// SPDX-License-Identifier: MIT", "SPDX-License-Identifier: MIT-0", "Released under the.\n\nMIT License", "the limit license"]
    got = [r["rules"] for r in licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["MIT:full", "BSD-2-Clause:full", "BSD-3-Clause:full", "GPL-3.0:header", "GPL-3.0:header", "All-Rights-Reserved:notice,BSD-2-Clause:full", "MIT:reference", "MIT:reference", "", "", ""]


def test_pseudonyms_keep_format_and_links(spark):
    import re

    def luhn(s):
        d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
        return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10

    card, bad = "4111 1111 1111 1111", "4111 1111 1111 1112"
    dates = [f"20{y:02d}-02-{d:02d}" for y in range(30) for d in range(1, 29)]
    texts = [f"pay {card} now", f"card: {card}.", f"not {bad}", "born 1984-02-29 or 31/12/1999", "no 2023-02-30", "DE89370400440532013000", "at 192.168.10.1, not 300.1.1.1", "", None, *dates]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in pseudonymise(df, secret="k").orderBy("doc_id").collect()]
    new = got[0][4:-4]
    assert new != card and luhn(new) == 0 and re.fullmatch(r"4\d{3}( \d{4}){3}", new) and got[1] == f"card: {new}." and got[2] == texts[2]
    assert re.fullmatch(r"born (19|20)\d\d-\d\d-\d\d or \d\d/\d\d/(19|20)\d\d", got[3]) and got[4] == texts[4]
    assert re.fullmatch(r"DE\d{20}", got[5]) and int(got[5][4:] + "1314" + got[5][2:4]) % 97 == 1
    assert got[6].endswith(", not 300.1.1.1") and "192.168.10.1," not in got[6] and got[7] == "" and got[8] is None
    moved = got[9:]
    assert len(set(moved)) == len(dates) and all(re.fullmatch(r"(19|20)\d\d-(0[1-9]|1[0-2])-\d\d", m) for m in moved) and moved != dates
    other = [r["text"] for r in pseudonymise(df, secret="other").orderBy("doc_id").collect()]
    assert other[0] != got[0] and [r["text"] for r in pseudonymise(df, secret="k").orderBy("doc_id").collect()] == got


def test_pseudonyms_of_secrets_in_any_writing(spark):
    import re

    low, card, word = "0123456789abcdef" * 2 + "01234567", "4111111111111111", "hunter2Secret"
    mixed = "Ab" + low[2:]
    hexes = [f'token = "{low}"', f'TOKEN = "{low.upper()}"', f"sum {mixed}", low.upper() + low[:24].upper(), f"token={low}"]
    keys = [f"PASSWORD={word}", f'token = "{word}"', f"Secret = {word}", f'"password": "{word}"', f"pwd: {word}", "password=p@ss1word", f"password={word}"]
    cards = [f"{card} 123", f"{card} 7", f"345 {card}", "4111 1111 1111 1111 123", f"2 {card} 98"]
    prose = ["the secret: patience wins", "a token = 5", "4111 1111 1111 1112 123"]
    df = spark.createDataFrame(list(enumerate(hexes + keys + cards + prose)), "doc_id long, text string")
    got = [r["text"] for r in pseudonymise(df, secret="k").orderBy("doc_id").collect()]
    new = got[0][9:-1]
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', got[0]) and new != low and got[4] == f"token={new}"
    assert re.fullmatch(r'TOKEN = "[0-9A-F]{40}"', got[1]) and low.upper() not in got[1]
    assert re.fullmatch(r"sum [A-F][a-f][0-9a-f]{38}", got[2]) and mixed not in got[2] and re.fullmatch("[0-9A-F]{64}", got[3]) and got[3] != hexes[3]
    hidden = got[11][9:]
    assert hidden != word and got[5:10] == [k.replace(word, hidden) for k in keys[:5]]
    assert re.fullmatch(r"password=[a-z]@[a-z]{2}\d[a-z]{4}", got[10]) and "ss1word" not in got[10]
    assert [len(t) for t in got] == [len(t) for t in hexes + keys + cards + prose]
    fake = got[12][:16]
    assert fake != card and got[12:17] == [f"{fake} 123", f"{fake} 7", f"345 {fake}", " ".join(fake[k : k + 4] for k in range(0, 16, 4)) + " 123", f"2 {fake} 98"]
    assert got[17:] == prose


def test_scores(odd, none, labels):
    for f, label in ((quality_scores, "quality"), (toxicity_scores, "toxic")):
        got = f(odd, labels, label_col=label).collect()
        assert sorted((r["doc_id"] for r in got), key=repr) == IDS and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
        assert not f(none, labels, label_col=label).collect()
        assert {r["score"] for r in f(odd, labels.limit(0), label_col=label).collect()} == {0.5}


def test_token_counts(odd, none):
    got = token_counts(odd, q.tokenizer("byte_bpe_50k.json")).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == IDS
    assert {(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got if r["doc_id"] in (1, 2)} == {(0, 0, False)}
    assert {r["n_bytes"] for r in got if r["doc_id"] in (4, 8)} == {len(WORDS)}
    assert not token_counts(none, q.tokenizer("byte_bpe_50k.json")).collect()


def test_embeddings(spark):
    a, b = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0]
    rows = [(1, a, 1), (2, b, 1), (3, a, 1), (4, a, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 0.0], 1), (8, [float("nan"), 0.0, 0.0], 1), (9, a, 2), (None, a, 1), (10, [], 1), (11, [1.0], 1), (3, a, 1), (12, [float("inf"), 1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({n: F.lit(1) for n in ("v", "m", "unit", "filter", "component", "rep")})
    got = sorted(((r["vec_id"], r["n_links"], r["component"], r["kept"]) for r in near_vectors(df).collect()), key=repr)
    want = [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (3, 3, 1, False), *((i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)), (None, 0, None, False)]
    assert got == sorted(want, key=repr)
    assert not near_vectors(df.limit(0)).collect()


def test_components(spark):
    from branchlight.llm.common import connected_components

    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 200), (300, 301), (301, 300)]
    for finish in (5, 1_000):
        got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long"), finish).collect()}
        groups = {}
        for node, root in got.items():
            groups.setdefault(root, set()).add(node)
        assert sorted(map(sorted, groups.values())) == [list(range(41)), list(range(100, 130)), [300, 301]]


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = q.read(spark, sf, "documents")
    state = docs
    for name, stage in p.STAGES[:-1]:
        was, state = state, stage(spark, state, sf)
        assert state.columns == docs.columns and state.dtypes == docs.dtypes, name
        n, left = was.count(), state.count()
        assert (left == n) if name == "pii" else n // 3 < left <= n, name
        state = p.written(state, f"test-{name}")
    ids = {r["doc_id"] for r in state.collect()}
    got = p.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == ids and sum(r["start"] == 0 for r in got) == len(ids)
    own = spark.createDataFrame([Row(doc_id=1, text="word " * 9, lang="en", source="s", n_chars=45)] * 2 + [Row(doc_id=None, text=None, lang="en", source="s", n_chars=0)] * 2, docs.schema)
    assert p.near_duplicates(spark, own, sf).count() == 3
