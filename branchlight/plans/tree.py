"""The tree of content: ingest, query, maintain, label, browse, persist.

A tree is two tables and a little state on the driver:
items(seq, content_id, text, metadata, raw, vector, path, unsplittable), one row per content, path being null until a reducer is fitted,
and nodes(node_id, parent_id, path, is_leaf, count, vsum, unsplittable, label).

Items lie in segments, one for each batch. A batch is routed against the tree as it is; only leaves that it overfills are read, split and written
anew, with the batch's own rows, as the new segment. Older rows of such leaves are retired by a short list of (path, version), removed ones by a list of seq;
both lists are held under LISTED rows, so that reading joins them by broadcast. When there are too many segments or the lists are full, items are written together.
Nodes take the batch's sums, and lose the sums of what is removed. A rebalance that a batch makes due is done when the tree is next looked at, saved, or
added to by a batch that is led to leaves; batches that each make it due are so built into the tree once, not once each.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..config import TreeConfig
from ..functions.vectors import distance, doubles, normalise
from ..operators import embedders, knn
from ..operators.aggregates import roll_up, vector_sums
from ..operators.labels import KeywordLabeler, LLMLabeler, candidates, keyword_labels, labels_by, should_label
from ..operators.pca import PCAState, transform_pca
from ..operators.split import LOCAL_MAX, divisive, split_decisions
from ..sources.shared import dropped, folder_of, written
from .browse import collapsed, display_labels, outline

ITEMS = "seq long, content_id string, text string, metadata string, raw array<double>, vector array<double>, path array<int>, unsplittable boolean"
NODES = "node_id long, parent_id long, path array<int>, is_leaf boolean, count long, vsum array<double>, unsplittable boolean, label string"
RETIRED, REMOVED = "path array<int>, before long", "seq long"
#: Rows of the lists of retired leaves and removed items, and segments, up to which items aren't written together.
LISTED, SEGMENTS = 10_000, 16
#: Children of a level's nodes that a broadcast may hold; levels with more are joined by path.
TOP = 4_096


@dataclass
class Content:
    """A piece of content; ids may be numbers or strings and come back as they went in."""

    id: Any
    text: str | None = None
    metadata: dict[str, Any] = field(default_factory=dict)
    embedding: Sequence[float] | None = None


@dataclass
class Branch:
    """A nested tree, for export and import. count: the stored one, or the number of contents below."""

    id: Any
    label: str | None = None
    children: list[Branch | Content] = field(default_factory=list)
    metadata: dict[str, Any] = field(default_factory=dict)
    vector_sum: Sequence[float] | None = None
    stored_count: int | None = None

    @property
    def count(self) -> int:
        return self.stored_count if self.stored_count is not None else sum(c.count if isinstance(c, Branch) else 1 for c in self.children)

    def contents(self) -> Iterable[Content]:
        """In pre-order."""
        for c in self.children:
            yield from c.contents() if isinstance(c, Branch) else [c]


def tree_to_dict(node: Branch | Content) -> dict:
    if isinstance(node, Content):
        return {"kind": "content", "id": node.id, "text": node.text, "metadata": node.metadata, "embedding": None if node.embedding is None else [float(v) for v in node.embedding]}
    return {"kind": "branch", "id": node.id, "label": node.label, "metadata": node.metadata, "vector_sum": None if node.vector_sum is None else [float(v) for v in node.vector_sum], "count": node.count, "children": [tree_to_dict(c) for c in node.children]}


def tree_from_dict(d: dict) -> Branch | Content:
    """A missing kind means a branch. A saved tree that is wrapped in {"kind", "tree"} is taken out first."""
    d = d["tree"] if "tree" in d else d
    if d.get("kind") == "content":
        return Content(d["id"], d.get("text"), d.get("metadata") or {}, d.get("embedding"))
    return Branch(d.get("id"), d.get("label"), [tree_from_dict(c) for c in d.get("children") or []], d.get("metadata") or {}, d.get("vector_sum"), d.get("count"))


class Tree:
    """embed: a Column -> Column expression from text to vectors; or embedder: an object with embed_batch(texts), or a function of one text, run in Arrow
    batches on the executors with its own retries, once for each distinct text; or neither, if all contents come with embeddings.

    labeler: an object with label(request), or a function of texts. strategy: how groups split, by default as configured.
    state: an object with load() and save(state dict), such as those of branchlight.sources.states; it is loaded at once. DataFrames that a tree gives
    read its tables; those that two later changes replace are deleted.
    """

    def __init__(self, spark: SparkSession, config: TreeConfig | None = None, embed: Callable[[Column], Column] | None = None, labeler: Any = None, state: Any = None, *, embedder: Any = None, strategy: Any = None):
        self.spark, self.config, self.embed, self.labeler, self.state, self.embedder, self.strategy = spark, config or TreeConfig(), embed, labeler, state, embedder, strategy
        self._due = False
        self.nodes = spark.createDataFrame([], NODES)
        self.pca = PCAState() if self.config.pca_dims else None
        self.next_seq, self.inserts, self.dim, self.fitted_seq, self.version, self.size = 0, 0, None, 0, 0, 0
        self.batches: dict[str, int] = {}
        self.decisions: DataFrame | None = None
        self.cache: DataFrame | None = None
        self._old: list[list[DataFrame]] = [[], []]
        self._one_segment(None)
        saved = state.load() if state is not None else None
        if saved:
            self.restore(saved)

    @property
    def nodes(self) -> DataFrame:
        self._balanced()
        return self._nodes

    @nodes.setter
    def nodes(self, nodes: DataFrame) -> None:
        self._nodes = nodes

    @property
    def segments(self) -> list[tuple[int, DataFrame]]:
        self._balanced()
        return self._segments

    @segments.setter
    def segments(self, segments: list[tuple[int, DataFrame]]) -> None:
        self._segments = segments

    def _balanced(self) -> None:
        """Does the rebalance that a batch has made due, if there is one."""
        if self._due:
            self._due = False
            try:
                self.rebalance()
            except BaseException:
                self._due = True
                raise

    def _one_segment(self, items: DataFrame | None) -> None:
        self._segments = [] if items is None else [(self.version, items)]
        self.retired, self.removed, self.listed = None, None, 0

    @property
    def items(self) -> DataFrame:
        """All contents as they are now."""
        self._balanced()
        return self._rows()

    def _rows(self) -> DataFrame:
        if not self._segments:
            return self.spark.createDataFrame([], ITEMS)
        names = [c.split()[0] for c in ITEMS.split(", ")]
        out = None
        for v, t in self._segments:
            one = t.select(*names, F.lit(v).cast("long").alias("__v"))
            out = one if out is None else out.unionByName(one)
        hint = F.broadcast if self.listed <= LISTED else lambda t: t
        if self.retired is not None:
            gone = hint(self.retired.groupBy(F.col("path").alias("__p")).agg(F.max("before").alias("__b")))
            out = out.join(gone, (F.col("path") == F.col("__p")) & (F.col("__v") < F.col("__b")), "left_anti")
        if self.removed is not None:
            out = out.join(hint(self.removed), "seq", "left_anti")
        return out.select(*names)

    def node_items(self, path: Sequence[int]) -> DataFrame:
        """The contents below a node."""
        return self.items.where(F.slice("path", F.lit(1), F.lit(len(path))) == F.array(*[F.lit(int(i)) for i in path]).cast("array<int>"))

    # -- ingest

    def add(self, contents: Sequence[Content]) -> list[Any]:
        """One batch; returns the ids in order. An empty batch writes nothing."""
        if not contents:
            return []
        rows = [(i, json.dumps(c.id), c.text, json.dumps(c.metadata, ensure_ascii=False, default=str), None if c.embedding is None else [float(v) for v in c.embedding]) for i, c in enumerate(contents)]
        self.ingest(self.spark.createDataFrame(rows, "ordinal long, content_id string, text string, metadata string, embedding array<double>"))
        return [c.id for c in contents]

    def add_branch(self, branch: Branch) -> list[Any]:
        """Its contents in pre-order; the structure isn't kept."""
        return self.add(list(branch.contents()))

    def ingest(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """rows(ordinal, content_id, text, metadata, embedding), a batch of any size; the number of rows.

        batch: a source's name and a number that grows; a batch of a number already seen is left out.
        """
        if batch is not None and self.batches.get(batch[0], -1) >= batch[1]:
            return 0
        rows = rows.select("ordinal", F.col("content_id").cast("string").alias("content_id"), "text", "metadata", doubles("embedding").alias("embedding"))
        numbered, n = self._numbered(self._embedded(rows), ["ordinal"])
        if not n:
            return 0
        first = self.next_seq
        dims, short = numbered.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        if dims != short or (self.dim or dims) != dims:
            raise ValueError(f"vectors of {self.dim or short} and {dims} dimensions don't go together")
        every = self.config.rebalance.every_n_inserts
        due = bool(self.config.rebalance.enabled and every and self.inserts + n >= every)
        if not due:
            self._balanced()
        self.dim = dims
        self.next_seq += n
        self.size += n
        self.version += 1
        if batch is not None:
            self.batches[batch[0]] = batch[1]
        fresh = numbered.select((F.col("n") + first).alias("seq"), "content_id", "text", "metadata", normalise("embedding").alias("raw"))
        none_yet = {"vector": F.col("raw"), "path": F.lit(None).cast("array<int>"), "unsplittable": F.lit(False)}
        warm = self.pca is not None and not self.pca.is_fitted
        if warm or due:  # the rebalance that is due builds the whole tree from these rows, so that they aren't led to leaves before
            self._segments.append((self.version, self._kept(fresh.withColumns(none_yet), "items")))
            if warm and self.size >= self.config.pca_warmup:
                self._fit(self.items)
                if not due:
                    self._rebuild()
        else:
            fresh = self._kept(fresh, "batch")
            self._insert(self._projected(fresh.withColumns(none_yet)), first)
            if self.pca is not None and self.config.pca_mode == "incremental":
                pending = self.items.where(F.col("seq") >= self.fitted_seq)
                if pending.count() >= self.config.pca_batch_size:
                    self._advance(pending)
        dropped(numbered, fresh)
        self.inserts += n
        if due and self._may_wait():
            self._due, self.inserts = True, 0
            self._together()
        elif due and (self.pca is None or self.pca.is_fitted):
            self.rebalance()
        else:
            self._together()
            self.save()
        return n

    def _may_wait(self) -> bool:
        """Whether nothing but the tree's own tables shows when a rebalance is done: no state, reducer, log or strategy."""
        return self.state is None and self.pca is None and self.strategy is None and not self.config.log_split_decisions

    def _embedded(self, rows: DataFrame) -> DataFrame:
        """Only contents that come without a vector are embedded; an embedder sees each distinct text once, and none that it has seen before."""
        if self.embed is not None:
            given = rows.where("embedding is not null")
            return given.unionByName(rows.where("embedding is null").withColumn("embedding", doubles(self.embed(F.col("text")))))
        if self.embedder is None:
            return rows
        done, cache = embedders.embedded(rows, self.embedder, cache=self.cache, keep=lambda t: written(t, "vectors"))
        self.cache = cache
        return done.withColumn("embedding", doubles("embedding"))

    def cache_clear(self) -> None:
        """Forgets the texts that the embedder has seen."""
        self.cache = None

    def _numbered(self, rows: DataFrame, order: list[str], name: str = "n") -> tuple[DataFrame, int]:
        """rows with numbers from 0 in the order given, by a sort over ranges and one count per range, and how many: no task sees all rows."""
        dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        dealt = self._kept(dealt, "numbered")
        before, total = {}, 0
        for p, n in sorted(tuple(r) for r in dealt.groupBy("__p").agg(F.count("*")).collect()):
            before[p], total = total, total + n
        if not before:
            return dealt.select(*rows.columns, F.lit(0).cast("long").alias(name)), 0
        start = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
        out = dealt.select(*rows.columns, (start[F.col("__p")] + F.col("__i")).cast("long").alias(name))
        out._branchlight_folder = folder_of(dealt)
        return out, total

    def _insert(self, fresh: DataFrame, first: int) -> None:
        """The batch's rows, of seq `first` and on, into the leaves they are led to; leaves over leaf_target are split."""
        if self.nodes.isEmpty() or self.size == self.next_seq - first:
            self.segments = [*self.segments, (self.version, self._kept(self._grown(fresh), "items"))]
            self._refresh()
            return
        routed = self._kept(self._routed(fresh), "routed")
        leaves = self.nodes.where("is_leaf and not unsplittable").select("path", F.col("count").alias("had"))
        full = routed.groupBy("path").agg(F.count("*").alias("n")).join(leaves, "path").where(F.col("n") + F.col("had") > self.config.leaf_target)
        full = self._kept(full.select("path"), "full")
        n_full = full.count()
        names = [c.split()[0] for c in ITEMS.split(", ")]
        segment = routed.join(full, "path", "left_anti").select(*names, F.lit(None).cast("int").alias("from_depth"))
        if n_full:
            over = self.items.join(full, "path", "left_semi").select(*names).unionByName(routed.join(full, "path", "left_semi").select(*names))
            split = self._grown(over.withColumn("from_depth", F.size("path")), below=True)
            segment = segment.unionByName(split.select(*segment.columns))
            retired = full.withColumn("before", F.lit(self.version).cast("long"))
            self.retired = self._kept(retired if self.retired is None else self.retired.unionByName(retired), "retired")
            self.listed += n_full
        segment = self._kept(segment, "items")
        self.segments = [*self.segments, (self.version, segment)]
        self._take(segment, first)
        dropped(routed, full)

    def _take(self, segment: DataFrame, first: int) -> None:
        """Nodes with the sums of the segment's new rows on all of their paths, and of its older rows below the leaves that they have left."""
        fresh = roll_up(segment.where(F.col("seq") >= first).select("path", "vector"))
        deeper = segment.where((F.col("seq") < first) & (F.size("path") > F.col("from_depth")))
        sums = vector_sums(deeper, ["path", "from_depth"])
        below = F.transform(F.sequence(F.col("from_depth") + 1, F.size("path")), lambda i: F.slice("path", F.lit(1), i))
        moved = vector_sums(sums.select(F.explode(below).alias("prefix"), "count", "vsum"), ["prefix"], "vsum", weight="count")
        delta = vector_sums(fresh.unionByName(moved), ["prefix"], "vsum", weight="count").select(F.col("prefix").alias("path"), F.col("count").alias("__n"), F.col("vsum").alias("__s"))
        ends = segment.groupBy("path").agg(F.max("unsplittable").alias("__u"))
        inner = segment.where(F.size("path") > F.col("from_depth")).select(F.slice("path", F.lit(1), F.col("from_depth")).alias("path"), F.lit(True).alias("__inner")).distinct()
        both = self.nodes.join(delta, "path", "full_outer").join(ends, "path", "left").join(inner, "path", "left")
        vsum = F.when(F.col("vsum").isNull() | (F.coalesce("count", F.lit(0)) == 0), F.col("__s")).when(F.col("__s").isNull(), F.col("vsum")).otherwise(F.zip_with("vsum", "__s", lambda x, y: x + y))
        both = both.select("node_id", "parent_id", "path", F.when(F.col("__inner"), False).otherwise(F.coalesce("is_leaf", F.col("__u").isNotNull())).alias("is_leaf"), (F.coalesce("count", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("count"), vsum.alias("vsum"), F.coalesce("unsplittable", F.lit(False)).__or__(F.coalesce("__u", F.lit(False))).alias("unsplittable"), "label")
        both = self._kept(both, "nodes")
        self._set_nodes(self._named(both))
        dropped(both)

    def _named(self, nodes: DataFrame) -> DataFrame:
        """nodes in which those without an id get the next ids in the order of paths, and their parents'."""
        top = nodes.agg(F.max("node_id")).first()[0]
        fresh, n = self._numbered(nodes.where("node_id is null"), ["path"])
        if not n:
            return nodes
        fresh = fresh.withColumn("node_id", F.col("n") + (0 if top is None else top + 1)).drop("n")
        known = nodes.where("node_id is not null")
        ids = known.select("path", "node_id").unionByName(fresh.select("path", "node_id")).withColumnsRenamed({"path": "__up", "node_id": "__id"})
        up = F.when(F.size("path") > 0, F.slice("path", F.lit(1), F.size("path") - 1))
        fresh = fresh.withColumn("__up", up).join(ids, "__up", "left").withColumn("parent_id", F.col("__id"))
        return known.unionByName(fresh.select(*nodes.columns))

    def _grown(self, rows: DataFrame, below: bool = False) -> DataFrame:
        """Rows with paths, from the top or below the paths that they have. Decisions that are to be logged go to self.decisions and the log."""
        said: list = []
        rows = rows.drop("unsplittable") if below else rows.drop("path", "unsplittable")
        out = divisive(rows, self.config, 1 << 60 if self.strategy else LOCAL_MAX, self.strategy, keep=lambda t: written(t, "level"), said=said, below=below)
        if self.config.log_split_decisions:
            out = written(out, "grown")
            self.decisions = written(split_decisions(out, said), "decisions")
            from ..operators.split import log

            for r in self.decisions.select("line").toLocalIterator():
                log.info("%s", r["line"])
        return out.drop("decisions")

    def _routed(self, rows: DataFrame) -> DataFrame:
        """T4: rows with the path of the leaf that the nearest centroids lead to, one level at a time.

        The upper levels' children, at most TOP by max_branches, are broadcast; below, where keys are many, rows meet their node's children by path.
        """
        kids = self.nodes.where(F.size("path") > 0).select(F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), F.struct(F.element_at("path", -1).alias("o"), F.expr("transform(vsum, x -> x / greatest(count, 1))").alias("c")).alias("k"))
        kids = self._kept(kids.groupBy("path").agg(F.collect_list("k").alias("__kids")).withColumn("__depth", F.size("path")), "kids")
        depth = kids.agg(F.max("__depth")).first()[0]
        here = rows.withColumn("path", F.array().cast("array<int>"))
        for level in range(0 if depth is None else depth + 1):
            table = kids.where(F.col("__depth") == level).drop("__depth")
            joined = here.join(F.broadcast(table) if self.config.max_branches ** (level + 1) <= TOP else table, "path", "left")
            best = F.array_min(F.transform("__kids", lambda c: F.struct(distance(F.col("vector"), c["c"]).alias("d"), c["o"].alias("o"))))["o"]
            here = joined.withColumn("path", F.when(F.col("__kids").isNull(), F.col("path")).otherwise(F.concat("path", F.array(best)))).drop("__kids")
        return here

    def _projected(self, rows: DataFrame) -> DataFrame:
        """V4: the routing vector of each raw one."""
        if self.pca is None or not self.pca.is_fitted:
            return rows.withColumn("vector", F.col("raw"))
        return transform_pca(rows.drop("vector"), self.pca, "raw", "vector").withColumn("vector", normalise("vector"))

    def _fit(self, rows: DataFrame) -> None:
        self.pca = PCAState().add(rows, "raw").solve(self.config.pca_dims)
        self.fitted_seq = self.next_seq

    def _advance(self, pending: DataFrame) -> None:
        """The moments of the new rows are added; older rows keep their projections until a rebalance."""
        self.pca.add(pending, "raw").solve(self.config.pca_dims)
        self.fitted_seq = self.next_seq

    # -- maintain

    def rebalance(self) -> None:
        """Fit the reducer, project everything anew and build the tree from the top. Labels go."""
        self._due = False
        if self.pca is not None and self.size:
            if self.config.pca_mode == "freeze" or not self.pca.is_fitted:
                self._fit(self.items)
            elif self.fitted_seq < self.next_seq:
                self._advance(self.items.where(F.col("seq") >= self.fitted_seq))
        self._rebuild()
        self.inserts = 0
        self.save()

    def _rebuild(self) -> None:
        if self.size:
            self.version += 1
            names = [c.split()[0] for c in ITEMS.split(", ")]
            self._replace(self._kept(self._grown(self._projected(self.items)).select(*names), "items"))
        self._refresh()

    def _replace(self, items: DataFrame) -> None:
        self._forget(*(t for _, t in self._segments), self.retired, self.removed)
        self._one_segment(items)

    def _together(self) -> None:
        """Writes items together where there are too many segments or listed rows; such a pass comes once in many batches."""
        if len(self._segments) > SEGMENTS or self.listed > LISTED:
            self._replace(self._kept(self._rows(), "items"))

    def _refresh(self) -> None:
        """All nodes anew from all items; the root stays if there are none."""
        placed = self.items.where("path is not null")
        sums = roll_up(placed.select("path", "vector"))
        ends = placed.groupBy(F.col("path").alias("prefix")).agg(F.max("unsplittable").alias("u"))
        rows = self._kept(sums.join(ends, "prefix", "left").select(F.lit(None).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.col("prefix").alias("path"), F.col("u").isNotNull().alias("is_leaf"), "count", "vsum", F.coalesce("u", F.lit(False)).alias("unsplittable"), F.lit(None).cast("string").alias("label")), "nodes")
        self._set_nodes(self._empty() if rows.isEmpty() else self._named(rows))
        dropped(rows)

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([(0, None, [], True, 0, [0.0] * (len(self.pca.components) if self.pca is not None and self.pca.is_fitted else self.dim or 0), False, None)], NODES)

    def _set_nodes(self, nodes: DataFrame) -> None:
        old, self.nodes = self._nodes, self._kept(nodes, "nodes")
        self._forget(old)

    def remove(self, *ids: Any) -> int:
        """Of each id the first item that has it; how many were removed."""
        return self.remove_all(self.spark.createDataFrame([(json.dumps(i),) for i in dict.fromkeys(ids)], "content_id string")) if ids else 0

    def remove_all(self, ids: DataFrame) -> int:
        """remove() for ids(content_id) as items have them, as many as one likes: none passes through the driver. The sums of what is removed leave the nodes
        above it, and nodes without items go, but for the root. Written once, and only if any was. Vectors are read only of what is removed."""
        want = ids.select(F.col("content_id").cast("string").alias("content_id"))
        found = self.items.select("content_id", "seq").join(want, "content_id", "left_semi").groupBy("content_id").agg(F.min("seq").alias("seq"))
        seqs = self._kept(found.select("seq"), "gone")
        n = seqs.count()
        if not n:
            dropped(seqs)
            return 0
        gone = self.items.join(seqs, "seq", "left_semi")
        self.version += 1
        self.size -= n
        self.removed = self._kept(seqs if self.removed is None else self.removed.unionByName(seqs), "removed")
        self.listed += n
        minus = roll_up(gone.where("path is not null").select("path", "vector")).select(F.col("prefix").alias("path"), F.col("count").alias("__n"), F.col("vsum").alias("__s"))
        left = self.nodes.join(minus, "path", "left")
        vsum = F.when(F.col("__s").isNull(), F.col("vsum")).otherwise(F.zip_with("vsum", "__s", lambda x, y: x - y))
        left = left.select(*[F.col(c) if c not in ("count", "vsum") else (F.col("count") - F.coalesce("__n", F.lit(0))).alias("count") if c == "count" else vsum.alias("vsum") for c in self.nodes.columns]).where("count > 0")
        left = self._kept(left, "nodes")
        if left.isEmpty():
            if not self.nodes.isEmpty():
                self._set_nodes(self._empty())
        else:
            self._set_nodes(left)
        self._together()
        dropped(seqs, left)
        self.save()
        return n

    def __len__(self) -> int:
        return self.size

    # -- query

    def query(self, queries: DataFrame, k: int = 10, exhaustive: bool = False) -> DataFrame:
        """queries(query_id, embedding), or (query_id, text) -> (query_id, rank, content_id, distance, metadata).

        Not exhaustive: only the leaf that the query is routed to, so fewer than k may come. Before a reducer is fitted: all items, in raw space.
        """
        knn.check_k(k)
        self._balanced()
        warm = self.pca is not None and not self.pca.is_fitted
        if "embedding" not in queries.columns:
            queries = self._embedded(queries.select("query_id", "text", F.lit(None).cast("array<double>").alias("embedding")))
        asked = self._projected(queries.select("query_id", normalise("embedding").alias("raw")))
        meta = self.items.select("content_id", "metadata").dropDuplicates(["content_id"])
        if warm or exhaustive or self.nodes.isEmpty():
            items = self.items.select("content_id", F.col("raw" if warm else "vector").alias("vector"))
            found = knn.knn_exact(items, asked.select("query_id", F.col("raw" if warm else "vector").alias("vector")), k)
        else:
            q = self._routed(asked).select("query_id", "vector", F.col("path").alias("leaf_id"))
            found = knn.knn_leaf(self.items.select("content_id", "vector", F.col("path").alias("leaf_id")), q, k)
        return found.join(meta, "content_id", "left").select("query_id", "rank", "content_id", "distance", "metadata")

    def nearest_to(self, query: str | Sequence[float], k: int = 10, exhaustive: bool = False) -> list[tuple[Any, float, dict]]:
        """(id, distance, metadata) of the contents nearest to a text or a vector."""
        if isinstance(query, str):
            one = self.spark.createDataFrame([(0, query)], "query_id int, text string")
        else:
            one = self.spark.createDataFrame([(0, [float(v) for v in query])], "query_id int, embedding array<double>")
        rows = self.query(one, k, exhaustive).orderBy("rank").collect()
        return [(json.loads(r["content_id"]), r["distance"], json.loads(r["metadata"] or "{}")) for r in rows]

    # -- labels

    def label(self, labeler: Any = None) -> None:
        """L1: names for nodes that branch or have siblings; others lose theirs. The labeler given here, else the tree's own, else by config.llm: keywords or a model."""
        f = labeler or self.labeler or (KeywordLabeler() if self.config.llm.provider == "none" else LLMLabeler(self.config.llm))
        which = should_label(self.nodes.select("node_id", "parent_id")).where("labelled").select("node_id")
        placed = self.items.where("path is not null").select(F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda i: F.slice("path", F.lit(1), i))).alias("path"), "content_id", "text", "metadata", "vector")
        rows = placed.join(self.nodes.join(which, "node_id", "left_semi").select("path", "node_id"), "path")
        centers = self.nodes.select("node_id", F.expr("transform(vsum, x -> x / greatest(count, 1))").alias("centroid"))
        asked = self._kept(candidates(rows, centers, self.config.llm.max_samples), "asked")
        named = keyword_labels(asked, f) if isinstance(f, KeywordLabeler) else labels_by(asked, f, self.config.llm.max_label_words)
        self._set_nodes(self.nodes.drop("label").join(named, "node_id", "left").select(*self.nodes.columns))
        dropped(asked)
        self.save()

    def organize(self, labeler: Any = None) -> None:
        self.rebalance()
        self.label(labeler)

    # -- browse

    def outline(self, max_items: int | None = 3, collapse_single_leaf: bool = False) -> DataFrame:
        nodes, items = self.nodes.select("path", "label"), self.items.where("path is not null").select("path", "seq", F.coalesce("text", "content_id").alias("text"))
        if collapse_single_leaf:
            shown = collapsed(nodes)
            # below a node that is shown as its leaf nothing more is shown; the leaf's items move up
            top = shown.where("shown <> path").select(F.col("shown").alias("leaf"), "path").groupBy("leaf").agg(F.min(F.struct(F.size("path").alias("s"), "path")).alias("t")).select("leaf", F.col("t.path").alias("top"))
            hidden = shown.join(top, F.col("shown") == F.col("leaf")).where(F.size("path") > F.size("top")).select("path")
            names = nodes.join(top, F.col("path") == F.col("leaf")).select(F.col("top").alias("path"), F.col("label").alias("__l"))
            nodes = nodes.join(hidden, "path", "left_anti").join(names, "path", "left").select("path", F.coalesce("__l", "label").alias("label"))
            items = items.join(top, F.col("path") == F.col("leaf"), "left").select(F.coalesce("top", "path").alias("path"), "seq", "text")
        return outline(nodes, items, max_items)

    def show(self, max_items: int | None = 3, collapse_single_leaf: bool = False) -> str:
        """B2: for people, so of a size that people read."""
        return "\n".join(r["line"] for r in self.outline(max_items, collapse_single_leaf).orderBy("path", "is_item", "ordinal").collect())

    def to_branch(self, max_items: int | None = None, collapse_single_leaf: bool = False) -> Branch:
        """B1: the nested tree on the driver, an export of a bounded size by max_items; embeddings are the routing vectors."""
        items = self.items.where("path is not null")
        if max_items is not None:
            items = items.withColumn("__r", F.row_number().over(Window.partitionBy("path").orderBy("seq"))).where(F.col("__r") <= max_items)
        made: dict[tuple, Branch] = {}
        for r in self.nodes.orderBy("path").collect():
            b = made[tuple(r["path"])] = Branch(r["node_id"], r["label"], vector_sum=r["vsum"], stored_count=r["count"])
            if r["path"]:
                made[tuple(r["path"][:-1])].children.append(b)
        for r in items.orderBy("seq").collect():
            i = json.loads(r["content_id"])
            made[tuple(r["path"])].children.append(Content(i, r["text"] or str(i), json.loads(r["metadata"] or "{}"), r["vector"]))
        root = made.get((), Branch(0, stored_count=0))

        def thin(b: Branch) -> Branch:
            b.children = [thin(c) if isinstance(c, Branch) else c for c in b.children]
            end = b
            while len(end.children) == 1 and isinstance(end.children[0], Branch):
                end = end.children[0]
            return end if end is not b and not any(isinstance(c, Branch) for c in end.children) else b

        return thin(root) if collapse_single_leaf else root

    # -- persist

    def _kept(self, df: DataFrame, what: str) -> DataFrame:
        """df with its lineage cut: in the state's own folder if it has one, else in the shared folder. A tree lives through many batches, and executors may go."""
        keep = getattr(self.state, "keep", None)
        return keep(df, what) if keep else written(df, f"tree-{what}")

    def _forget(self, *tables: DataFrame | None) -> None:
        self._old[-1] += [t for t in tables if t is not None and folder_of(t)]

    def meta(self) -> dict:
        self._balanced()
        return {"version": 2, "next_seq": self.next_seq, "inserts": self.inserts, "dim": self.dim, "fitted_seq": self.fitted_seq, "size": self.size, "items_version": self.version, "batches": self.batches, "pca": None if self.pca is None else self.pca.to_dict()}

    def dump(self) -> dict:
        return {**self.meta(), "items": self.items, "nodes": self.nodes}

    def save(self) -> None:
        """In one commit. A state that keeps tables itself takes only their names; others take all rows."""
        if self.state is not None:
            if hasattr(self.state, "commit"):
                self.state.commit({**self.meta(), "listed": self.listed}, self.segments, {"nodes": self.nodes, "retired": self.retired, "removed": self.removed})
            else:
                self.state.save(self.dump())
        # what the last but one change replaced
        first, *rest = self._old
        used = {folder_of(t) for _, t in self.segments} | {folder_of(t) for t in (self.nodes, self.retired, self.removed) if t is not None}
        dropped(*(t for t in first if folder_of(t) not in used))
        self._old = [*rest, []]

    def restore(self, saved: dict | Branch) -> None:
        """A saved state, or a nested tree whose contents are then ingested."""
        if isinstance(saved, Branch):
            self.add_branch(saved)
            return
        self._due, self.nodes = False, saved["nodes"]
        self.next_seq, self.inserts, self.dim, self.fitted_seq = (saved[k] for k in ("next_seq", "inserts", "dim", "fitted_seq"))
        self.version, self.batches = saved.get("items_version", 0), dict(saved.get("batches") or {})
        self.pca = PCAState.from_dict(saved["pca"]) if saved.get("pca") else None
        self._one_segment(saved.get("items"))
        if "segments" in saved:
            self.segments, self.retired, self.removed, self.listed = saved["segments"], saved.get("retired"), saved.get("removed"), saved.get("listed", 0)
        self.size = saved["size"] if saved.get("size") is not None else self.items.count()


def display(tree: Tree) -> DataFrame:
    return display_labels(tree.nodes, tree.items.where("path is not null"))
