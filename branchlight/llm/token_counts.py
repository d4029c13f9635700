"""Token counts by the whole-token shortcut (operator 9).

Offline, every vocabulary string is encoded alone; those that are one pre-token and come out as one token
are *proved* whole and count as one wherever they stand as a pre-token. Only other pre-tokens are merged,
by the tokenizer library's own model. A text is cut before each single space between two characters that
are no white space: the pre-tokenizer always cuts there, so the pieces count independently and a bounded
memo of pieces carries over from text to text. Narrow: no shuffle, no state that grows with the data.
"""

from __future__ import annotations

import json
import re

import regex
from pyspark.sql import DataFrame, functions as F

from .common import kept

#: Pieces that a worker remembers; it forgets all of them at this number.
MEMO = 500_000
#: The pre-tokenizer's pattern. It is used where all characters are below U+0250, whose classes no library disputes.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PLAIN = "\u0250"
#: Before a space with no white space on either side.
CUT = re.compile(r"(?<=[^\s᠎​﻿])(?= [^\s᠎​﻿])")


def whole_tokens(path: str) -> set[str]:
    """The texts that are one pre-token and one token, each proved by encoding it alone."""
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(path)
    texts = list({full.decode([i], skip_special_tokens=False) for i in full.get_vocab(with_added_tokens=False).values()})
    texts = [t for t in texts if t and "�" not in t]
    return {t for t, e in zip(texts, full.encode_batch(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1 and len(full.pre_tokenizer.pre_tokenize_str(t)) == 1}


def shown_bytes() -> dict[int, str]:
    """How a byte-level vocabulary shows the bytes that aren't printable ASCII: as the next free characters from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [i for i in range(256) if i not in plain]
    return {i: chr(i) for i in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Counter(dict):
    """Token counts of pieces; a missing piece is worked out and remembered."""

    def __init__(self, path: str, whole: set[str]):
        from tokenizers import Tokenizer

        super().__init__()
        self.full, self.whole = Tokenizer.from_file(path), whole
        self.special = [t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]]
        assert all("|" in t for t in self.special)
        self.model, self.merges = self.full.model, {}
        self.shown = shown_bytes()
        self.odd = re.compile(r"[\x1c-\x1f\x85\xa0]").search
        self.known = {s for t in whole for s, _ in self.full.pre_tokenizer.pre_tokenize_str(t)}

    def __missing__(self, piece: str) -> int:
        if piece in self.whole:
            n = 1
        elif "|" in piece and any(s in piece for s in self.special):
            n = len(self.full.encode(piece, add_special_tokens=False).ids)
        elif max(piece, default="") < PLAIN and not self.odd(piece):
            n = sum([1 if t in self.whole else self.merged(t.encode().decode("latin-1").translate(self.shown)) for t in SPLIT.findall(piece)])
        else:
            n = sum(1 if s in self.known else len(self.full.model.tokenize(s)) for s, _ in self.full.pre_tokenizer.pre_tokenize_str(piece))
        if len(self) >= MEMO:
            self.clear()
        if len(piece) <= 64:
            self[piece] = n
        return n

    def merged(self, shown: str) -> int:
        """The tokens of a pre-token, given as the bytes are shown in the vocabulary."""
        n = self.merges.get(shown)
        if n is None:
            if len(self.merges) >= MEMO:
                self.merges.clear()
            n = self.merges[shown] = len(self.model.tokenize(shown))
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or not text.replace("\n", "").isprintable():
            return sum(map(self.__getitem__, cut(text)))
        # each space stands between two characters that are no white space
        first, *rest = text.split(" ")
        return self[first] + sum(map(self.__getitem__, map(" ".__add__, rest)))


def cut(text: str):
    """The pieces of any text, one at a time."""
    at = 0
    for m in CUT.finditer(text):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """docs -> (id, n_bytes, n_tokens, over_limit), one row per input row.

    vocabulary: path of a byte-level BPE file of the tokenizers library, readable on every executor.
    A null text counts as empty: 0 bytes, 0 tokens. Special strings inside a text are taken as the library
    takes them by default. Repeated rows stay repeated; a null id stays null; other columns are not read.
    The broadcast set of proved strings is bounded by the vocabulary.
    """
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(whole_tokens(vocabulary))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()

    def count(batches):
        import pyarrow as pa

        counter = kept(("counter", vocabulary), lambda: Counter(vocabulary, whole.value))
        for b in batches:
            n = [counter.count(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
