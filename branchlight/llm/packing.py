"""Packing along a space-filling curve (operator 3).

Each document's hashed token vector is projected to DIMS dimensions and its point turned into a Hilbert key.
Documents are dealt to key ranges and sorted there, so neighbours on the curve become neighbours in the
training sequences. The ids then form one long line that is cut every `length` ids; the last, shorter part is
cut into powers of two, which need no padding. Two passes: the first tokenises, sorts and writes the ids once
with each document's place in its range; the second reads only (range, ids) sums, then cuts.
The ranges come from a sample of keys. They decide only which task sorts which rows: the order is that of
(key, doc_id hash, doc_id) for any ranges, so neither the sample nor the number of partitions changes it.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F

from .common import kept, release, written
from .token_counts import shown_bytes

DIMS, BITS, HASHED = 4, 11, 1024
#: Low bits of the sort key that break ties between equal points, so that many copies of a text spread over ranges.
TIE_BITS = 63 - DIMS * BITS
#: Rows whose keys are sampled for the ranges at least; otherwise SAMPLE_PER_RANGE rows for each range.
SAMPLE, SAMPLE_PER_RANGE, RANGES_PER_PARTITION = 2_000, 4, 8
MEMO = 600_000


def projection(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((HASHED, DIMS))


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Integer points (n, d), each coordinate of `bits` bits, to their index on the Hilbert curve (Skilling 2004)."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def point_of(ids: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Hash the ids to HASHED counts, damp by the square root, scale to length 1, project, and clip 8 deviations to the grid."""
    counts = np.sqrt(np.bincount((ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(22), minlength=HASHED))
    norm = np.sqrt(counts @ counts)
    at = counts @ matrix / (norm or 1.0)
    return np.clip(np.floor((at + 4) / 8 * (1 << BITS)), 0, (1 << BITS) - 1)


#: The vocabulary's split, used where all characters are below U+0250: they are in their composed form and their classes are old.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
ODD = re.compile("[\u0130\x1c-\x1f\x85\xa0|]")


class Words(dict):
    """A word's ids as bytes. The vocabulary drops white space, so ASCII-space-separated words encode independently."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.full, self.kind, self.parts = Tokenizer.from_file(path), kind, {}
        self.model, self.shown, self.code = self.full.model, shown_bytes(), {"<u2": "H", "<u4": "I"}[kind]

    def part(self, text: str) -> bytes:
        got = self.parts.get(text)
        if got is None:
            tokens = self.model.tokenize(text if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(self.shown))
            if len(self.parts) >= MEMO:
                self.parts.clear()
            got = self.parts[text] = struct.pack(f"<{len(tokens)}{self.code}", *[t.id for t in tokens])
        return got

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if text.isalpha() and max(text) < "\u0250" and "\u0130" not in text:
            got = self.part(text.lower())
        elif max(text) < "\u0250" and not ODD.search(text):
            got = b"".join(map(self.part, SPLIT.findall(text.lower())))
        else:
            got = np.array(self.full.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        if len(self) >= MEMO:
            self.clear()
        if len(word) <= 64:
            self[word] = got
        return got

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").encode().split()))


def id_kind(vocabulary: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(vocabulary).get_vocab_size() <= 1 << 16 else "<u4"


def tail_lengths(rest: int) -> list[int]:
    """rest as powers of two, largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, vocabulary: str, *, end_id: int = 2, length: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    A null or empty text is the end id alone. A null id is kept and sorts first. Rows that repeat are packed
    each time. No padding at all: every sequence is full or a power of two. The vocabulary must drop white space.
    An empty table gives no pieces. `ids` holds the piece's ids as little-endian unsigned numbers of 2 bytes, or 4
    for vocabularies over 65,536. The driver holds one sum per range, 8 ranges per shuffle partition.
    """
    spark = docs.sparkSession
    kind = id_kind(vocabulary)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.xxhash64(F.col(id_col)).bitwiseAND((1 << TIE_BITS) - 1)).alias("tie"))
    id_type = rows.schema["id"].dataType.simpleString()
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    matrix = projection()

    def keys(words, texts, ties):
        ids = [words.ids(t) + end for t in texts]
        points = np.array([point_of(np.frombuffer(b, kind), matrix) for b in ids]).reshape(-1, DIMS)
        return ids, (hilbert_keys(points) << TIE_BITS) | np.array(ties, np.int64)

    end = np.array([end_id], kind).tobytes()

    def sampled(batches):
        import pyarrow as pa

        words = kept(("words", vocabulary, kind), lambda: Words(vocabulary, kind))
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(keys(words, b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False))[1], pa.int64())], ["skey"])

    n = docs.count()
    want = max(SAMPLE, SAMPLE_PER_RANGE * ranges)
    sample = rows.select("text", "tie")
    got = (sample.sample(want / n, seed=3) if n > want else sample).mapInArrow(sampled, "skey long")
    # bounded: about SAMPLE_PER_RANGE numbers for each range
    line = np.sort(np.array([r[0] for r in got.collect()], np.int64))
    bounds = np.unique(line[(np.arange(1, ranges) * len(line)) // ranges]) if len(line) else line

    def tokenised(batches):
        import pyarrow as pa

        words = kept(("words", vocabulary, kind), lambda: Words(vocabulary, kind))
        for b in batches:
            for at in range(0, b.num_rows, 512):
                c = b.slice(at, 512)
                ids, key = keys(words, c.column(1).to_pylist(), c.column(2).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, key, "right"), pa.int32()), pa.array(key, pa.int64()), c.column(0), pa.array(ids, pa.binary())], ["part", "skey", "id", "ids"])

    def placed(batches):
        import pyarrow as pa

        part, at = None, 0
        width = np.dtype(kind).itemsize
        for b in batches:
            parts, n = b.column(0).to_numpy(), np.diff(np.frombuffer(b.column(2).buffers()[1], np.int32)[b.column(2).offset :][: b.num_rows + 1]) // width
            offs = []
            for p, k in zip(parts.tolist(), n.tolist(), strict=True):
                if p != part:
                    part, at = p, 0
                offs.append(at)
                at += k
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(offs, pa.int64()), pa.array(n, pa.int64()), b.column(1), b.column(2)], ["part", "at", "n", "id", "ids"])

    dealt = rows.mapInArrow(tokenised, f"part int, skey long, id {id_type}, ids binary").repartition("part").sortWithinPartitions("part", "skey", "id", "ids")
    line = written(dealt.select("part", "id", "ids").mapInArrow(placed, f"part int, at long, n long, id {id_type}, ids binary"), "packing")
    release(spark)
    sums = {r["part"]: r["n"] for r in line.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    first, total = {}, 0
    for p in sorted(sums):
        first[p], total = total, total + sums[p]
    whole = total // length
    tail = np.cumsum([0, *tail_lengths(total - whole * length)]) + whole * length  # where the tail's sequences begin, then the end

    def cut(batches):
        import pyarrow as pa

        width = np.dtype(kind).itemsize
        for b in batches:
            out = [[] for _ in range(8)]
            for p, at, n, i, raw in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                here = first[p] + at
                start = 0
                while start < n:
                    g = here + start
                    if g < whole * length:
                        seq, off = divmod(g, length)
                        room = length - off
                    else:
                        k = int(np.searchsorted(tail, g, "right")) - 1
                        seq, off, room = whole + k, g - int(tail[k]), int(tail[k + 1]) - g
                    m = min(room, n - start)
                    piece = raw[start * width : (start + m) * width]
                    crc = zlib.crc32(np.frombuffer(piece, kind).astype("<u4").tobytes())
                    for col, x in zip(out, (i, start, m, crc, n, seq, off, piece), strict=True):
                        col.append(x)
                    start += m
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.column(3).type), *(pa.array(x, pa.int64()) for x in out[1:7]), pa.array(out[7], pa.binary())], ["id", *NAMES, "ids"])

    return line.mapInArrow(cut, f"id {id_type}, {', '.join(f'{x} long' for x in NAMES)}, ids binary").withColumnRenamed("id", id_col)


NAMES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
