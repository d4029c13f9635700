"""Branch names: keywords by TF-IDF, user functions, language models, and which nodes get a name."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cache
from typing import Any, Protocol, runtime_checkable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..config import LLMConfig
from ..functions.text import tokens

#: Terms of all groups up to which they are broadcast; more meet the texts by group.
BROADCAST = 1 << 20
#: English stop words besides those of Spark's own list, and words of that list that are none here.
MORE_STOP_WORDS = frozenset("""
across afterwards almost alone along already also although always among amongst amoungst amount anyhow anyone anything anyway anywhere around
back became become becomes becoming beforehand behind beside besides beyond bill bottom call cannot cant co con could couldnt cry de describe
detail done due eg eight either eleven else elsewhere empty enough etc even ever every everyone everything everywhere except fifteen fifty
fill find fire first five former formerly forty found four front full get give go hasnt hence hereafter hereby herein hereupon however hundred
ie inc indeed interest keep last latter latterly least less ltd made many may meanwhile might mill mine moreover mostly move much must name
namely neither never nevertheless next nine nobody none noone nothing nowhere often one onto others otherwise part per perhaps please put
rather re see seem seemed seeming seems serious several show side since sincere six sixty somehow someone something sometime sometimes
somewhere still system take ten thence thereafter thereby therefore therein thereupon thick thin third though three throughout thru thus
together top toward towards twelve twenty two un upon us via well whatever whence whenever whereafter whereas whereby wherein whereupon
wherever whether whither whoever whole whose within without would yet
""".split())
NO_STOP_WORDS = frozenset("did does doing having just theirs don".split())


@cache
def english_stop_words() -> frozenset[str]:
    from pyspark.ml.feature import StopWordsRemover

    return frozenset(w for w in StopWordsRemover.loadDefaultStopWords("english") if "'" not in w) - NO_STOP_WORDS | MORE_STOP_WORDS


@dataclass(frozen=True)
class LabelCandidate:
    """A content that stands for a node."""

    id: Any
    text: str
    distance: float | None = None
    metadata: dict[str, Any] | None = None


@dataclass(frozen=True)
class LabelRequest:
    """What a labeler gets to see of a node: contents, the nearest to its centroid first."""

    candidates: list[LabelCandidate]
    max_words: int = 6


@runtime_checkable
class Labeler(Protocol):
    """Names a node; stream() gives the name in pieces."""

    def stream(self, request: LabelRequest) -> Iterable[str]: ...

    def label(self, request: LabelRequest) -> str: ...


class _Whole:
    """A labeler whose name comes in one piece."""

    def stream(self, request: LabelRequest) -> Iterable[str]:
        yield self.label(request)


@dataclass
class KeywordLabeler(_Whole):
    """L4: the top_k terms by TF-IDF, joined by commas. Over all nodes at once keyword_labels() does the same in a few joins."""

    top_k: int = 3
    max_features: int = 50
    stop_words: Iterable[str] | None = None  # None: English

    def words(self) -> frozenset[str]:
        return english_stop_words() if self.stop_words is None else frozenset(self.stop_words)

    def label(self, request: LabelRequest) -> str:
        stop = self.words()
        texts = [Counter(t for t in re.findall(r"\w{2,}", c.text.lower()) if t not in stop) for c in request.candidates if c.text.strip()]
        total, df = Counter(), Counter()
        for t in texts:
            total.update(t)
            df.update(t.keys())
        top = sorted(total, key=lambda w: (-total[w], w))[: self.max_features]
        idf = {w: math.log((1 + len(texts)) / (1 + df[w])) + 1 for w in top}
        score: Counter = Counter()
        for t in texts:
            w = {k: t[k] * idf[k] for k in top if k in t}
            length = math.sqrt(sum(v * v for v in w.values()))
            score.update({k: v / length for k, v in w.items()})
        return ", ".join(sorted(score, key=lambda w: (-round(score[w], 9), w))[: self.top_k])


class FunctionLabeler:
    """A function of a request that gives a string or pieces of one."""

    def __init__(self, fn: Callable[[LabelRequest], str | Iterable[str]]):
        self.fn = fn

    def stream(self, request: LabelRequest) -> Iterable[str]:
        got = self.fn(request)
        return iter([got]) if isinstance(got, str) else iter(got)

    def label(self, request: LabelRequest) -> str:
        return "".join(self.stream(request)).strip()


def cleaned(text: str, max_words: int = 6) -> str:
    """The first line without outer marks, at most max_words words."""
    line = next(iter(text.strip().splitlines()), "").strip(" .:-\"'")
    return " ".join(line.split()[:max_words])


@dataclass
class LLMLabeler(_Whole):
    """A language model names a node from at most SAMPLES of its texts.

    client: an object with chat.completions.create, pipeline: a text-generation function; without them config.provider says what is made, once for each
    worker. Injected ones must pickle.
    """

    config: LLMConfig = field(default_factory=LLMConfig)
    client: Any = None
    pipeline: Any = None

    SAMPLES = 20
    TOKENS = 24

    def prompt(self, request: LabelRequest) -> str:
        lines = [f"- {c.text}" for c in request.candidates[: self.SAMPLES]]
        return "\n".join([f"Give this group of texts a name of at most {request.max_words} words.", "Answer with the name alone, without punctuation or explanation.", *lines])

    def label(self, request: LabelRequest) -> str:
        ask = {"openai": self._hosted, "local": self._local}.get(self.config.provider)
        return cleaned(ask(self.prompt(request)), request.max_words) if ask else ""

    def _hosted(self, prompt: str) -> str:
        client = self.client or _hosted_client(self.config.api_key, self.config.base_url)
        got = client.chat.completions.create(model=self.config.model, messages=[{"role": "user", "content": prompt}], temperature=0, max_tokens=self.TOKENS)
        return got.choices[0].message.content or ""

    def _local(self, prompt: str) -> str:
        run = self.pipeline or _local_pipeline(self.config.model)
        got = run(prompt, max_new_tokens=self.TOKENS, do_sample=False, return_full_text=False)
        return got[0]["generated_text"] if isinstance(got, list) else str(got)


@cache
def _hosted_client(api_key: str | None, base_url: str | None):
    try:
        from openai import OpenAI
    except ImportError as e:
        raise ImportError("a labeler with provider openai needs the package openai, or a client") from e
    return OpenAI(**{k: v for k, v in (("api_key", api_key), ("base_url", base_url)) if v})


@cache
def _local_pipeline(model: str):
    try:
        from transformers import pipeline
    except ImportError as e:
        raise ImportError("a labeler with provider local needs the package transformers, or a pipeline") from e
    return pipeline("text-generation", model=model)


def keywords(docs: DataFrame, group: str, *, text: str = "text", id_col: str = "content_id", top_k: int = 3, max_features: int = 50, stop_words: Iterable[str] = ()) -> DataFrame:
    """L4: (group, rank, term, score): the terms with the highest sums of length-normalised TF-IDF within each group.

    Each group keeps its max_features most frequent terms, ties by term; idf is ln((1 + n) / (1 + df)) + 1; each text's weights have length 1.
    Blank texts count for nothing. Texts are read twice, for the counts of terms in groups and for the weights of the terms that are kept; words are counted
    within Arrow batches, so that what is shuffled is one row a batch, group and term.
    """
    from ..sources.shared import written

    stop = list(stop_words)
    rows = docs.where(F.length(F.trim(text)) > 0).select(F.col(group).alias("g"), tokens(F.col(text)).alias("ts"))
    kind = rows.schema["g"].dataType.simpleString()
    n = rows.groupBy("g").agg(F.count("*").alias("n"))
    terms = rows.mapInArrow(_counted, f"g {kind}, term string, total long, df long").groupBy("g", "term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
    if stop:
        terms = terms.where(~F.col("term").isin(stop))
    terms = terms.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("total"), "term"))).where(F.col("r") <= max_features)
    terms = terms.join(n, "g").groupBy("g").agg(F.collect_list(F.struct("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))).alias("k"))
    terms = written(terms.select("g", F.col("k.term").alias("terms"), F.col("k.idf").alias("idf")), "terms")
    few = terms.count() * max_features <= BROADCAST
    sums = rows.join(F.broadcast(terms) if few else terms, "g").mapInArrow(_weighed, f"g {kind}, term string, score double").groupBy("g", "term").agg(F.sum("score").alias("score"))
    order = Window.partitionBy("g").orderBy(F.desc(F.round("score", 9)), "term")
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select(F.col("g").alias(group), "rank", "term", "score")


def _words(texts) -> tuple[np.ndarray, pa.Array]:
    """Of lists of words: the list that each word is from, and the words."""
    return np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)), texts.flatten()


def _counted(batches):
    """(g, words of a text) -> for each group and term of a batch how often it is there, and in how many texts."""
    for b in batches:
        doc, flat = _words(b.column(1))
        if not len(flat):
            continue
        groups, words = b.column(0).dictionary_encode("encode"), flat.dictionary_encode()
        size = len(words.dictionary)
        pairs, often = np.unique(doc * size + words.indices.to_numpy(), return_counts=True)
        of, at = np.unique(groups.indices.to_numpy()[pairs // size].astype(np.int64) * size + pairs % size, return_inverse=True)
        total, df = np.bincount(at, often).astype(np.int64), np.bincount(at)
        yield pa.RecordBatch.from_arrays([groups.dictionary.take(pa.array(of // size)), words.dictionary.take(pa.array(of % size)), pa.array(total), pa.array(df.astype(np.int64))], ["g", "term", "total", "df"])


def _weighed(batches):
    """(g, words of a text, the group's terms, their idf) -> for each group and term of a batch the sum of the texts' weights, each text's of length 1."""
    for b in batches:
        groups = b.column(0).dictionary_encode("encode")
        code = groups.indices.to_numpy()
        for g in np.unique(code).tolist():
            at = np.flatnonzero(code == g)
            terms, idf = b.column(2)[at[0]].values, b.column(3)[at[0]].values.to_numpy()
            doc, flat = _words(b.column(1).take(pa.array(at)))
            place = pc.fill_null(pc.index_in(flat, value_set=terms), -1).to_numpy()
            pairs, often = np.unique(doc[place >= 0] * len(terms) + place[place >= 0], return_counts=True)
            doc, term = pairs // len(terms), pairs % len(terms)
            weight = often * idf[term]
            score = np.bincount(term, weight / np.sqrt(np.bincount(doc, weight * weight))[doc], len(terms))
            used = np.flatnonzero(np.bincount(term, minlength=len(terms)))
            if len(used):
                yield pa.RecordBatch.from_arrays([groups.dictionary.take(pa.array(np.full(len(used), g))), terms.take(pa.array(used)), pa.array(score[used])], ["g", "term", "score"])


def keyword_labels(requests: DataFrame, labeler: KeywordLabeler) -> DataFrame:
    """L4: candidates (node_id, rank, content_id, text) -> (node_id, label): what labeler.label() gives, for all nodes in a few joins; "" without terms."""
    words = keywords(requests, "node_id", id_col="rank", top_k=labeler.top_k, max_features=labeler.max_features, stop_words=sorted(labeler.words()))
    named = words.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t")).select("node_id", F.array_join("t.term", ", ").alias("label"))
    return requests.select("node_id").distinct().join(named, "node_id", "left").select("node_id", F.coalesce("label", F.lit("")).alias("label"))


def should_label(nodes: DataFrame) -> DataFrame:
    """L2: nodes(node_id, parent_id) -> (node_id, child_count, sibling_count, labelled); the root has no siblings."""
    children = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("child_count"))
    siblings = F.when(F.col("parent_id").isNull(), F.lit(0)).otherwise(F.count("*").over(Window.partitionBy("parent_id")))
    out = nodes.withColumn("sibling_count", siblings.cast("bigint")).join(children, "node_id", "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)).cast("bigint"))
    return out.select("node_id", "child_count", "sibling_count", ((F.col("child_count") > 1) | (F.col("sibling_count") > 1)).alias("labelled"))


def candidates(items: DataFrame, centers: DataFrame, max_samples: int = 15) -> DataFrame:
    """L3: items(node_id, content_id, text, vector), centers(node_id, centroid) -> the max_samples nearest with text, by rank, with metadata if there is any."""
    from ..functions.vectors import distance

    rows = items.where(F.length(F.coalesce("text", F.lit(""))) > 0).join(centers, "node_id").withColumn("distance", distance(F.col("vector"), F.col("centroid")))
    order = Window.partitionBy("node_id").orderBy("distance", "content_id")
    more = [c for c in ("metadata",) if c in items.columns]
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_samples).select("node_id", "rank", "content_id", "text", "distance", *more)


def labels_by(requests: DataFrame, labeler: Labeler | Callable[[list[str]], str | Iterable[str]], max_words: int = 6) -> DataFrame:
    """Candidates (node_id, rank, content_id, text, distance) -> (node_id, label), by a labeler or a function of the texts, in one call a node on the
    executors; pieces are joined and stripped."""
    import json

    kind = requests.schema["node_id"].dataType.simpleString()
    rows = requests if "metadata" in requests.columns else requests.withColumn("metadata", F.lit(None).cast("string"))
    rows = rows.withColumn("distance", F.col("distance") if "distance" in requests.columns else F.lit(None).cast("double"))
    rows = rows.withColumn("content_id", F.col("content_id").cast("string") if "content_id" in requests.columns else F.lit(None).cast("string"))

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("rank")
        if hasattr(labeler, "label"):
            told = [LabelCandidate(i, t, d, json.loads(m) if m else None) for i, t, d, m in zip(table["content_id"], table["text"], table["distance"], table["metadata"], strict=True)]
            got = labeler.label(LabelRequest(told, max_words))
        else:
            got = labeler(table["text"].tolist())
        return pd.DataFrame({"node_id": table["node_id"].iloc[:1], "label": [(got if isinstance(got, str) else "".join(got)).strip()]})

    return rows.groupBy("node_id").applyInPandas(run, f"node_id {kind}, label string")


function_labels = labels_by
