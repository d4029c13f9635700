"""Text expressions: tokens, short forms, safe names, hash seeds, tags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNSAFE = r"[\\/:*?\"<>|#\[\]^\n\r\t]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word characters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def short(text: Column, limit: int = 60) -> Column:
    """V6: white space collapsed; cut to limit - 1 characters and an ellipsis."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("…"))).otherwise(t)


def safe_name(name: Column) -> Column:
    """K6g: a name that any file system takes."""
    t = F.regexp_replace(F.regexp_replace(name, UNSAFE, " "), r"\s+", " ")
    t = F.regexp_replace(t, r"^[. ]+|[. ]+$", "")
    return F.when(F.coalesce(t, F.lit("")) == "", "untitled").otherwise(t)


def hash_seed(text: Column) -> Column:
    """The first four bytes of the MD5 sum as an unsigned number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def multi_hot_text(text: Column, tags: list[str]) -> Column:
    """1.0 for each tag that is a substring of the text, both in lower case."""
    return F.array(*[F.when(F.contains(F.lower(text), F.lit(t.lower())), 1.0).otherwise(0.0) for t in dict.fromkeys(tags)])


def multi_hot_list(items: Column, tags: list[str], unknown: str = "ignore") -> Column:
    """1.0 for each tag in the list, exactly; other items are ignored or, with unknown="error", raise."""
    if unknown not in ("ignore", "error"):
        raise ValueError(f"unknown must be 'ignore' or 'error', not {unknown!r}")
    known = list(dict.fromkeys(tags))
    hot = F.array(*[F.when(F.array_contains(items, t), 1.0).otherwise(0.0) for t in known])
    if unknown == "ignore":
        return hot
    odd = F.array_except(items, F.array(*map(F.lit, known)))
    return F.when(F.size(odd) > 0, F.raise_error(F.concat(F.lit("unknown tags: "), F.array_join(odd, ", ")))).otherwise(hot)


def clean_label(text: Column, max_words: int = 6) -> Column:
    """The first line without outer marks, at most max_words words; empty text gives ""."""
    line = F.regexp_replace(F.split_part(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), F.lit("\n"), F.lit(1)), r"""^[ .:\-"']+|[ .:\-"']+$""", "")
    return F.array_join(F.slice(F.filter(F.split(line, r"\s+"), lambda w: w != ""), 1, max_words), " ")
