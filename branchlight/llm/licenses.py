"""Licence recognition by sentence rules (operator 5). DataFrame functions only.

A text is normalised (lower case, marks and white space to single spaces, so that wrapped lines and comment marks don't count), with a
break at blank lines and at . ! ? before white space. Known licence sentences are looked for between the breaks, also inside longer
sentences, the longest at each place, and mapped to identifiers; a holder's name in them may be any, and what a reference begins with
("released under the terms of") is brought to one form. A licence is recognised where
identifiers follow one another as one of its ordered rules asks. Narrow: the table of sentences is a literal of fewer than 200 entries.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

#: Names of licences in normal form, the identifier of a reference to each, its SPDX name.
NAMES: dict[str, tuple[str, str]] = {
    "apache license version 2 0": ("aa", "Apache-2.0"),
    "apache license 2 0": ("aa", "Apache-2.0"),
    "apache 2 0 license": ("aa", "Apache-2.0"),
    "mit license": ("ba", "MIT"),
    "gnu general public license version 3": ("ca", "GPL-3.0"),
    "gnu general public license v3": ("ca", "GPL-3.0"),
    "gnu gpl version 3": ("ca", "GPL-3.0"),
    "gpl v3": ("ca", "GPL-3.0"),
    "gplv3": ("ca", "GPL-3.0"),
    "gnu general public license version 2": ("cf", "GPL-2.0"),
    "gnu general public license v2": ("cf", "GPL-2.0"),
    "gnu gpl version 2": ("cf", "GPL-2.0"),
    "gpl v2": ("cf", "GPL-2.0"),
    "gplv2": ("cf", "GPL-2.0"),
    "gnu lesser general public license version 3": ("fa", "LGPL-3.0"),
    "lgplv3": ("fa", "LGPL-3.0"),
    "gnu lesser general public license version 2 1": ("fb", "LGPL-2.1"),
    "gnu affero general public license version 3": ("ga", "AGPL-3.0"),
    "agplv3": ("ga", "AGPL-3.0"),
    "mozilla public license version 2 0": ("ha", "MPL-2.0"),
    "mozilla public license 2 0": ("ha", "MPL-2.0"),
    "isc license": ("ia", "ISC"),
    "boost software license version 1 0": ("ja", "BSL-1.0"),
    "zlib license": ("ka", "Zlib"),
    "unlicense": ("ua", "Unlicense"),
    "cc by nc 4 0": ("da", "CC-BY-NC-4.0"),
    "creative commons attribution noncommercial 4 0 international license": ("da", "CC-BY-NC-4.0"),
    "cc by 4 0": ("db", "CC-BY-4.0"),
    "creative commons attribution 4 0 international license": ("db", "CC-BY-4.0"),
    "cc by sa 4 0": ("dc", "CC-BY-SA-4.0"),
    "creative commons attribution sharealike 4 0 international license": ("dc", "CC-BY-SA-4.0"),
    "cc0 1 0": ("dd", "CC0-1.0"),
    "bsd 3 clause license": ("ee", "BSD-3-Clause"),
    "bsd 2 clause license": ("ef", "BSD-2-Clause"),
}
#: Sentences of the licences' own texts, in normal form, and their identifiers.
TEXTS: dict[str, str] = {
    "licensed under the apache license version 2 0 the license": "ab",
    "you may not use this file except in compliance with the license": "ac",
    "you may obtain a copy of the license at": "ad",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ae",
    "see the license for the specific language governing permissions and limitations under the license": "af",
    "apache license version 2 0": "ag",
    "apache license version 2 0 january 2004": "ah",
    "terms and conditions for use reproduction and distribution": "ai",
    "the mit license": "bb",
    "mit license": "bb",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "bc",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "bd",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "be",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "cb",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "cc",
    "see the gnu general public license for more details": "cd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "cg",
    "gnu general public license version 3 29 june 2007": "ch",
    "gnu general public license version 2 june 1991": "ci",
    "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work": "dg",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "ea",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "eb",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "ec",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "ed",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "fc",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "fd",
    "see the gnu lesser general public license for more details": "fe",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "ff",
    "gnu lesser general public license version 3 29 june 2007": "fg",
    "gnu lesser general public license version 2 1 february 1999": "fh",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gb",
    "see the gnu affero general public license for more details": "gc",
    "gnu affero general public license version 3 19 november 2007": "gd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "hb",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "hc",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ib",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ic",
    "this is free and unencumbered software released into the public domain": "ub",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "uc",
    "all rights reserved": "za",
}
#: Any reference begins like this; SPDX lines have a rule of their own.
UNDER = "licensed under the "
SPDX = "spdx license identifier "
SENTENCES: dict[str, str] = {
    **{UNDER + name: i for name, (i, _) in NAMES.items()},
    **{SPDX + spdx.lower().replace("-", " ").replace(".", " ") + more: i for i, spdx in NAMES.values() for more in ("", " only", " or later")[: 3 if "GPL" in spdx else 1]},
    **TEXTS,
}

#: Licences and their rules: identifiers that follow one another, with at most GAP other known sentences in between; longer rules of a licence stand first.
RULES: list[tuple[str, str, str]] = [
    ("Apache-2.0", "header", "ab ac ad ae af"),
    ("Apache-2.0", "text", "ah ai"),
    ("Apache-2.0", "short header", "ab ac"),
    ("MIT", "full", "bc bd be"),
    ("GPL-3.0", "header", "cb cc cd"),
    ("GPL-3.0", "title", "ch"),
    ("GPL-2.0", "header", "cg cc cd"),
    ("GPL-2.0", "title", "ci"),
    ("LGPL-2.1", "header", "fc fd fe"),
    ("LGPL-2.1", "title", "fh"),
    ("LGPL-3.0", "header", "ff cc fe"),
    ("LGPL-3.0", "title", "fg"),
    ("AGPL-3.0", "header", "gb cc gc"),
    ("AGPL-3.0", "title", "gd"),
    ("MPL-2.0", "header", "hb hc"),
    ("ISC", "full", "ib ic"),
    ("Unlicense", "full", "ub uc"),
    ("CC0-1.0", "waiver", "dg"),
    ("BSD-3-Clause", "full", "ea eb ec ed"),
    ("BSD-2-Clause", "full", "ea eb ec"),
    *((spdx, "reference", i) for i, spdx in dict.fromkeys(NAMES.values())),
    ("All-Rights-Reserved", "notice", "za"),
]

GAP = 2
#: Blank lines, also those of comments, and . ! ? before white space, but not after "v." for version. "2.0." keeps its inner full stop.
BREAK = r"\n[^\p{L}\p{N}\n]*\n|(?<=[.!?])(?<! v\.)\s"
#: Comment words at the beginning of a line; comment marks go with all other marks.
COMMENT = r"(?m)^[ \t]*(?:rem|dnl)[ \t]"
#: Any text with a known sentence has one of these; others are not normalised.
CUE = r"(?i)licen[sc]e|copyright|permi|redistribut|warrant|rights[^\p{L}\p{N}]+reserved|under[^\p{L}\p{N}]+(?:the[^\p{L}\p{N}]+)?(?:terms[^\p{L}\p{N}]+of[^\p{L}\p{N}]+(?:the[^\p{L}\p{N}]+)?)?(?:gnu[^\p{L}\p{N}]+)?(?:cc|gpl|lgpl|agpl)|free[^\p{L}\p{N}]+software|neither[^\p{L}\p{N}]+the|terms[^\p{L}\p{N}]+and[^\p{L}\p{N}]+conditions|the[^\p{L}\p{N}]+mpl|unencumbered|anyone[^\p{L}\p{N}]+is[^\p{L}\p{N}]+free|distributed[^\p{L}\p{N}]+in[^\p{L}\p{N}]+the[^\p{L}\p{N}]+hope"
#: A holder's name, and what stands in its place in the known sentence; what a reference begins with, and its one form.
HOLDER, ANY = r"neither the name of (?:[\p{L}\p{N}]+[ \x01]+){1,12}?nor the names of (?:its|the) contributors", "neither the name of the copyright holder nor the names of its contributors"
REFERENCE = r"(?<![\p{L}\p{N}])(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:the )?"
#: MIT-0 is another licence.
KNOWN = r"(?<![\p{L}\p{N}])(?:" + "|".join(x + "(?! 0)" * x.endswith("identifier mit") for x in sorted(SENTENCES, key=len, reverse=True)) + r")(?![\p{L}\p{N}])"


def normal(text: Column) -> Column:
    broken = F.regexp_replace(F.regexp_replace(F.lower(text), COMMENT, ""), BREAK, "\x01")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(broken, r"[^\p{L}\p{N}\x01]+", " "), HOLDER, ANY), REFERENCE, UNDER)


def licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (id, n_sentences, sentence_ids, licenses, rules), one row per input row.

    sentence_ids: the known sentences' identifiers, joined by a space, in order. licenses: the recognised names in
    alphabetical order without repeats, joined by a comma; "" if there are none. rules: "name:rule" of each, likewise. Null texts count as
    empty. A rule matches where its identifiers follow one another among the known sentences, with at most GAP others between two.
    """
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(SENTENCES.items())])
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # one regular expression over the whole text tells whether any sentence has a cue; the rest have no identifiers
    some = F.when(F.col("t").rlike(CUE), F.regexp_extract_all(normal(F.col("t")), F.lit(KNOWN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.select(id_col, F.transform(some, lambda s: F.try_element_at(known, s)).alias("ids"))
    rows = rows.select(id_col, F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", " ").alias("sentence_ids"))
    line = F.concat(F.lit(" "), F.col("sentence_ids"), F.lit(" "))
    has = lambda want: line.rlike(" " + f"(?: [a-z]{{2}}){{0,{GAP}}} ".join(want.split()) + " ")
    # the two-clause rule begins the three-clause one
    def found(name, rule, want):
        h = F.when(has(want), F.lit(name if rule is None else f"{name}:{rule}"))
        return F.when(~has("ea eb ec ed"), h) if (name, want) == ("BSD-2-Clause", "ea eb ec") else h

    names = F.array_sort(F.array_distinct(F.array_compact(F.array(*[found(n, None, w) for n, _, w in RULES]))))
    rules = F.array_sort(F.array_distinct(F.array_compact(F.array(*[found(n, r, w) for n, r, w in RULES]))))
    return rows.select(id_col, "n_sentences", "sentence_ids", F.array_join(names, ",").alias("licenses"), F.array_join(rules, ",").alias("rules"))
