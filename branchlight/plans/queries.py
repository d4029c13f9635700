"""The queries of the engine's own operators, each with the SQL that a database gives the same rows by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as tx
from ..functions.vectors import distance, doubles, normalise, project, rounded
from ..operators import aggregates as ag, knn, labels as lb
from ..sources.shared import application_dir, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(content_id, label, branch, vector): normalised; branch is the label by fives, so root -> 2 branches -> 10 leaves is a given tree."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("content_id"), "label", F.expr("label div 5").cast("int").alias("branch"), normalise("embedding").alias("vector"))


L = """L AS (SELECT vec_id, label, label // 5 AS branch, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
NL AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM L GROUP BY vec_id),
N AS (SELECT L.vec_id, label, branch, pos, CASE WHEN n > 0 THEN x / n ELSE x END AS x FROM L JOIN NL ON L.vec_id = NL.vec_id)"""
C = "C AS (SELECT label, pos, sum(x) AS vs, avg(x) AS c FROM N GROUP BY label, pos)"
D2 = "D AS (SELECT N.vec_id, N.label, sqrt(sum((x - c) * (x - c))) AS d FROM N JOIN C ON N.label = C.label AND N.pos = C.pos GROUP BY N.vec_id, N.label)"


@query(f"WITH {L} SELECT vec_id, pos::INT AS pos, round(x, 6) + 0.0 AS x FROM N")
def vec_normalize(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return ag.long_form(rows, ["content_id"]).select(F.col("content_id").alias("vec_id"), "pos", rounded(F.col("x")).alias("x"))


KNN = """P AS (SELECT q.vec_id AS query_id, i.vec_id AS content_id, sqrt(sum((q.x - i.x) * (q.x - i.x))) AS d FROM N q JOIN N i ON q.pos = i.pos {where} GROUP BY 1, 2),
R AS (SELECT query_id, content_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, content_id) AS rank FROM P)"""
HUNDREDTHS = "query_id % 100 = 0"


def by_hundreds(rows: DataFrame) -> DataFrame:
    """The stated query set of searches: ids divisible by 100, against all rows."""
    return rows.where("content_id % 100 = 0").select(F.col("content_id").alias("query_id"), "label", "branch", "vector")


def hits(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "content_id", rounded(F.col("distance")).alias("distance"))


@query(f"WITH {L}, {KNN.format(where='WHERE q.vec_id % 100 = 0')} SELECT query_id, rank::INT AS rank, content_id, round(d, 6) + 0.0 AS distance FROM R WHERE rank <= 5")
def knn_exact_top5(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return hits(knn.knn_exact(rows, by_hundreds(rows), 5))


@query(f"WITH {L}, {KNN.format(where='WHERE q.vec_id % 100 = 0 AND i.label = 0')} SELECT query_id, rank::INT AS rank, content_id, round(d, 6) + 0.0 AS distance FROM R WHERE rank <= 100000")
def knn_exact_k_gt_n(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return hits(knn.knn_exact(rows.where("label = 0"), by_hundreds(rows), 100_000))


@query(f"WITH {L}, {C} SELECT label, pos::INT AS pos, round(c, 6) + 0.0 AS c FROM C")
def leaf_centroids(spark, sf_dir):
    found = ag.centroids(vectors(spark, sf_dir), ["label"])
    return ag.long_form(found, ["label"], "centroid").select("label", "pos", rounded(F.col("x")).alias("c"))


NODES = """K AS (SELECT vec_id, pos, x, unnest(['/', '/' || branch, '/' || branch || '/' || label]) AS node FROM N)"""


@query(f"WITH {L}, {NODES} SELECT node, pos::INT AS pos, count(*) AS n, round(sum(x), 6) + 0.0 AS vsum FROM K GROUP BY node, pos")
def tree_rollup(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("path", F.array(F.col("branch").cast("string"), F.col("label").cast("string")))
    found = ag.roll_up(rows).withColumn("node", F.concat(F.lit("/"), F.array_join("prefix", "/")))
    return found.select("node", F.col("count").alias("n"), F.posexplode("vsum").alias("pos", "x")).select("node", "pos", "n", rounded(F.col("x")).alias("vsum"))


ROUTE = f"""{L}, B AS (SELECT branch, pos, avg(x) AS c FROM N GROUP BY branch, pos), {C},
D1 AS (SELECT vec_id, B.branch, sqrt(sum((x - c) * (x - c))) AS d FROM N JOIN B ON N.pos = B.pos GROUP BY vec_id, B.branch),
W1 AS (SELECT vec_id, branch FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, branch) AS r FROM D1) WHERE r = 1),
D2 AS (SELECT N.vec_id, C.label AS leaf, sqrt(sum((x - c) * (x - c))) AS d FROM N JOIN W1 ON N.vec_id = W1.vec_id JOIN C ON C.pos = N.pos AND C.label // 5 = W1.branch GROUP BY N.vec_id, C.label),
W2 AS (SELECT vec_id, leaf, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, leaf) AS r FROM D2) WHERE r = 1)"""


def routed(spark, sf_dir) -> DataFrame:
    """Each vector led from the root to a leaf by the nearest centroid at each step."""
    rows = vectors(spark, sf_dir)
    top = ag.centroids(rows, ["branch"]).select(F.col("branch").alias("center_id"), F.col("branch").alias("ordinal"), "centroid")
    low = ag.centroids(rows, ["branch", "label"]).select(F.col("branch").alias("step"), F.col("label").alias("center_id"), F.col("label").alias("ordinal"), "centroid")
    one = ag.nearest(rows, top).withColumnRenamed("center_id", "step").drop("distance")
    return ag.nearest(one, low, on=["step"]).withColumnRenamed("center_id", "leaf_id")


@query(f"WITH {ROUTE} SELECT W2.vec_id, branch, leaf, round(d, 6) + 0.0 AS distance FROM W2 JOIN W1 ON W1.vec_id = W2.vec_id")
def route_two_level(spark, sf_dir):
    return routed(spark, sf_dir).select(F.col("content_id").alias("vec_id"), F.col("step").alias("branch"), F.col("leaf_id").alias("leaf"), rounded(F.col("distance")).alias("distance"))


@query(f"""WITH {ROUTE}, P AS (SELECT q.vec_id AS query_id, i.vec_id AS content_id, sqrt(sum((q.x - i.x) * (q.x - i.x))) AS d FROM N q JOIN W2 ON W2.vec_id = q.vec_id JOIN N i ON i.label = W2.leaf AND i.pos = q.pos WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
R AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, content_id) AS rank FROM P) SELECT query_id, rank::INT AS rank, content_id, round(d, 6) + 0.0 AS distance FROM R WHERE rank <= 5""")
def knn_leaf_top5(spark, sf_dir):
    items = vectors(spark, sf_dir).withColumnRenamed("label", "leaf_id")
    asked = routed(spark, sf_dir).where("content_id % 100 = 0").select(F.col("content_id").alias("query_id"), "leaf_id", "vector")
    return hits(knn.knn_leaf(items, asked, 5))


@query(f"WITH {ROUTE} SELECT leaf, count(*) AS n FROM W2 GROUP BY leaf")
def route_leaf_sizes(spark, sf_dir):
    return routed(spark, sf_dir).groupBy(F.col("leaf_id").alias("leaf")).agg(F.count("*").alias("n"))


@query(f"""WITH {L}, {NODES}, KC AS (SELECT node, pos, avg(x) AS c FROM K GROUP BY node, pos),
KD AS (SELECT K.node, K.vec_id, sqrt(sum((x - c) * (x - c))) AS d FROM K JOIN KC ON K.node = KC.node AND K.pos = KC.pos GROUP BY K.node, K.vec_id)
SELECT node, count(*) AS n, round(avg(d), 6) + 0.0 AS dispersion FROM KD GROUP BY node""")
def dispersion_by_node(spark, sf_dir):
    node = F.explode(F.array(F.lit("/"), F.concat(F.lit("/"), F.col("branch")), F.concat(F.lit("/"), F.col("branch"), F.lit("/"), F.col("label")))).alias("node")
    return ag.dispersions(vectors(spark, sf_dir).select(node, "vector"), ["node"]).select("node", F.col("count").alias("n"), rounded(F.col("dispersion")).alias("dispersion"))


SCORE = f"""{L}, KS AS (SELECT unnest([2, 3, 4, 5]) AS k), A AS (SELECT k, vec_id, label % k AS b, pos, x FROM N JOIN KS ON true),
AC AS (SELECT k, b, pos, avg(x) AS c FROM A GROUP BY k, b, pos),
AD AS (SELECT A.k, A.b, A.vec_id, sqrt(sum((x - c) * (x - c))) AS d FROM A JOIN AC ON A.k = AC.k AND A.b = AC.b AND A.pos = AC.pos GROUP BY 1, 2, 3),
S AS (SELECT k, b, count(*) AS n, avg(d) AS d FROM AD GROUP BY k, b),
PC AS (SELECT pos, avg(x) AS c FROM N GROUP BY pos), PD AS (SELECT avg(d) AS p FROM (SELECT vec_id, sqrt(sum((x - c) * (x - c))) AS d FROM N JOIN PC ON N.pos = PC.pos GROUP BY vec_id)),
SEP AS (SELECT k, avg(d) AS sep FROM (SELECT a.k, a.b AS b1, e.b AS b2, sqrt(sum((a.c - e.c) * (a.c - e.c))) AS d FROM AC a JOIN AC e ON a.k = e.k AND a.pos = e.pos AND a.b < e.b GROUP BY 1, 2, 3) GROUP BY k),
T AS (SELECT S.k, (SELECT p FROM PD) - sum(n * d) / sum(n) AS gain, stddev_pop(n) / avg(n) AS imb, min(n) AS least FROM S GROUP BY S.k),
Z AS (SELECT T.k, gain, gain / (SELECT p FROM PD) AS ratio, sep, imb, gain + 0.05 * sep - 0.05 * imb AS score FROM T JOIN SEP ON T.k = SEP.k)"""


def split_scores(spark, sf_dir) -> DataFrame:
    rows = vectors(spark, sf_dir).select("content_id", "vector", "label", F.explode(F.array(*map(F.lit, (2, 3, 4, 5)))).alias("want")).withColumn("bucket", F.col("label") % F.col("want"))
    return ag.candidate_scores(rows, ["want"])


@query(f"WITH {SCORE} SELECT k, round(gain, 6) + 0.0 AS gain, round(ratio, 6) + 0.0 AS gain_ratio, round(sep, 6) + 0.0 AS separation, round(imb, 6) + 0.0 AS imbalance, round(score, 6) + 0.0 AS score FROM Z")
def split_score_given_k(spark, sf_dir):
    return split_scores(spark, sf_dir).select(F.col("want").alias("k"), *[rounded(F.col(c)).alias(c) for c in ("gain", "gain_ratio", "separation", "imbalance", "score")])


@query(f"WITH {SCORE} SELECT k, round(score, 6) + 0.0 AS score, gain >= 0.05 AS accepted FROM Z ORDER BY score DESC, k LIMIT 1")
def split_choose_k(spark, sf_dir):
    best = split_scores(spark, sf_dir).agg(F.max_by(F.struct("want", "score", "gain"), F.struct("score", -F.col("want"))).alias("b"))
    return best.select(F.col("b.want").alias("k"), rounded(F.col("b.score")).alias("score"), (F.col("b.gain") >= 0.05).alias("accepted"))


@query(f"""WITH {L}, {NODES}, KC AS (SELECT node, pos, avg(x) AS c FROM K GROUP BY node, pos),
KD AS (SELECT K.node, K.vec_id, sqrt(sum((x - c) * (x - c))) AS d FROM K JOIN KC ON K.node = KC.node AND K.pos = KC.pos GROUP BY K.node, K.vec_id),
G AS (SELECT node, avg(d) AS d, CASE WHEN node = '/' THEN 0 ELSE length(node) - length(replace(node, '/', '')) END AS depth FROM KD GROUP BY node)
SELECT node, depth::INT AS depth, round(0.99 * pow(0.999, depth), 6) + 0.0 AS threshold, d < 0.99 * pow(0.999, depth) AS coherent FROM G""")
def coherence_gate_by_depth(spark, sf_dir):
    from ..operators.split import coherence_threshold

    node = F.explode(F.array(F.lit("/"), F.concat(F.lit("/"), F.col("branch")), F.concat(F.lit("/"), F.col("branch"), F.lit("/"), F.col("label")))).alias("node")
    rows = ag.dispersions(vectors(spark, sf_dir).select(node, "vector"), ["node"])
    rows = rows.withColumn("depth", F.when(F.col("node") == "/", 0).otherwise(F.length("node") - F.length(F.replace("node", F.lit("/"), F.lit("")))).cast("int"))
    limit = coherence_threshold(F.col("depth"), 0.99, 0.999)
    return rows.select("node", "depth", rounded(limit).alias("threshold"), (F.col("dispersion") < limit).alias("coherent"))


LLOYD = f"""{L}, C0 AS (SELECT vec_id AS k, pos, x AS c FROM N WHERE vec_id < 5),
E1 AS (SELECT vec_id, k, sqrt(sum((x - c) * (x - c))) AS d FROM N JOIN C0 ON N.pos = C0.pos GROUP BY vec_id, k),
A1 AS (SELECT vec_id, k FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS r FROM E1) WHERE r = 1),
C1 AS (SELECT k, pos, avg(x) AS c FROM N JOIN A1 ON N.vec_id = A1.vec_id GROUP BY k, pos),
E2 AS (SELECT vec_id, k, sqrt(sum((x - c) * (x - c))) AS d FROM N JOIN C1 ON N.pos = C1.pos GROUP BY vec_id, k),
A2 AS (SELECT vec_id, k FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS r FROM E2) WHERE r = 1)"""


@query(f"WITH {LLOYD} SELECT vec_id, k AS cluster FROM A2")
def lloyd_two_iterations(spark, sf_dir):
    from ..operators.split import lloyd

    rows = vectors(spark, sf_dir)
    seeds = rows.where("content_id < 5").select(F.col("content_id").alias("center_id"), F.col("content_id").alias("ordinal"), F.col("vector").alias("centroid"))
    return lloyd(rows.select("content_id", "vector"), seeds, 2).select(F.col("content_id").alias("vec_id"), F.col("center_id").alias("cluster"))


@query("SELECT label, count(DISTINCT embedding) AS n FROM embeddings GROUP BY label")
def distinct_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.countDistinct("embedding").alias("n"))


@query(f"WITH {L}, {NODES} SELECT node, pos::INT AS pos, count(*) AS n, round(sum(x), 6) + 0.0 AS vsum FROM K WHERE vec_id % 7 <> 0 GROUP BY node, pos")
def remove_rollback(spark, sf_dir):
    """Removal by rolling the removed items' sums back along their paths."""
    rows = vectors(spark, sf_dir).withColumn("path", F.array(F.col("branch").cast("string"), F.col("label").cast("string")))
    gone = rows.where("content_id % 7 = 0")
    long = lambda df, sign: ag.roll_up(df).select("prefix", (sign * F.col("count")).alias("n"), F.posexplode("vsum").alias("pos", "x")).withColumn("x", sign * F.col("x"))
    left = long(rows, 1).unionByName(long(gone, -1)).groupBy("prefix", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).where("n > 0")
    return left.select(F.concat(F.lit("/"), F.array_join("prefix", "/")).alias("node"), "pos", "n", rounded(F.col("x")).alias("vsum"))


@query("""WITH K AS (SELECT vec_id, unnest(['/', '/' || (label // 5), '/' || (label // 5) || '/' || label]) AS node FROM embeddings WHERE label NOT IN (3, 4))
SELECT node, count(*) AS n FROM K GROUP BY node""")
def remove_prune(spark, sf_dir):
    """Leaves that removal empties are pruned, then branches without children; the root stays."""
    rows = vectors(spark, sf_dir).withColumn("path", F.array(F.col("branch").cast("string"), F.col("label").cast("string")))
    prefixes = F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda i: F.slice("path", F.lit(1), i))).alias("prefix")
    n = F.sum(F.when(F.col("label").isin(3, 4), 0).otherwise(1)).alias("n")
    left = rows.select("label", prefixes).groupBy("prefix").agg(n).where((F.col("n") > 0) | (F.size("prefix") == 0))
    return left.select(F.concat(F.lit("/"), F.array_join("prefix", "/")).alias("node"), "n")


@query(f"WITH {L} SELECT label, pos::INT AS pos, count(*) AS n, round(sum(x), 6) + 0.0 AS vsum, count(*) FILTER (WHERE vec_id >= 400) AS added FROM N GROUP BY label, pos")
def ingest_batch_update(spark, sf_dir):
    """A tree of the first 400 vectors takes the rest as one batch: sums and counts of both add up."""
    rows = vectors(spark, sf_dir)
    base, batch = (ag.vector_sums(rows.where(c), ["label"]).select("label", F.col("count").alias("n"), F.lit(a).alias("fresh"), F.posexplode("vsum").alias("pos", "x")) for c, a in (("content_id < 400", 0), ("content_id >= 400", 1)))
    both = base.unionByName(batch).groupBy("label", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum(F.col("n") * F.col("fresh")).alias("added"))
    return both.select("label", "pos", "n", rounded(F.col("x")).alias("vsum"), "added")


@query(f"WITH {L}, {C}, {D2}, R AS (SELECT label, vec_id, d, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS rank FROM D) SELECT label, rank::INT AS rank, vec_id, round(d, 6) + 0.0 AS distance FROM R WHERE rank <= 15")
def label_candidates_top15(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.col("label").alias("node_id"), "content_id", F.concat(F.lit("v"), F.col("content_id")).alias("text"), "vector")
    centers = ag.centroids(rows, ["node_id"]).select("node_id", "centroid")
    return lb.candidates(rows, centers, 15).select(F.col("node_id").alias("label"), F.col("rank").cast("int").alias("rank"), F.col("content_id").alias("vec_id"), rounded(F.col("distance")).alias("distance"))


TREE = """E AS (SELECT DISTINCT label, label // 5 AS branch FROM embeddings), T AS (SELECT '/' AS node, NULL AS parent UNION ALL SELECT DISTINCT '/' || branch, '/' FROM E UNION ALL SELECT '/' || branch || '/' || label, '/' || branch FROM E)"""


def given_nodes(spark, sf_dir) -> DataFrame:
    """(node_id, parent_id, path) of the given tree."""
    path = F.explode(F.array(F.array().cast("array<int>"), F.array("branch"), F.array("branch", "label"))).alias("path")
    nodes = vectors(spark, sf_dir).select("branch", "label").distinct().select(path).distinct()
    name = lambda p: F.concat(F.lit("/"), F.array_join(p.cast("array<string>"), "/"))
    return nodes.select(name(F.col("path")).alias("node_id"), F.when(F.size("path") > 0, name(F.slice("path", F.lit(1), F.size("path") - 1))).alias("parent_id"), "path")


@query(f"WITH {TREE} SELECT t.node, (SELECT count(*) FROM T c WHERE c.parent = t.node) AS child_count, CASE WHEN t.parent IS NULL THEN 0 ELSE (SELECT count(*) FROM T s WHERE s.parent = t.parent) END AS sibling_count, ((SELECT count(*) FROM T c WHERE c.parent = t.node) > 1 OR (t.parent IS NOT NULL AND (SELECT count(*) FROM T s WHERE s.parent = t.parent) > 1)) AS labelled FROM T t")
def should_label(spark, sf_dir):
    return lb.should_label(given_nodes(spark, sf_dir)).withColumnRenamed("node_id", "node")


@query("""WITH E AS (SELECT DISTINCT label, label // 5 AS branch FROM embeddings), T AS (SELECT -1 AS b, -1 AS l UNION ALL SELECT DISTINCT branch, -1 FROM E UNION ALL SELECT branch, label FROM E)
SELECT CASE WHEN b < 0 THEN '/' WHEN l < 0 THEN '/' || b ELSE '/' || b || '/' || l END AS node, row_number() OVER (ORDER BY b, l) - 1 AS node_id FROM T""")
def preorder_ids(spark, sf_dir):
    """Ids in pre-order: arrays compare element by element, a prefix first. One row per node, which the leaf size bounds."""
    nodes = given_nodes(spark, sf_dir)
    return nodes.select(F.col("node_id").alias("node"), (F.row_number().over(Window.orderBy("path")) - 1).cast("bigint").alias("node_id"))


@query(f"""WITH {L}, M AS (SELECT pos, avg(x) AS m FROM N GROUP BY pos), P AS (SELECT vec_id, N.pos, x - m AS y FROM N JOIN M ON N.pos = M.pos WHERE N.pos < 8), PN AS (SELECT vec_id, sqrt(sum(y * y)) AS n FROM P GROUP BY vec_id)
SELECT P.vec_id, P.pos::INT AS pos, round(y / n, 6) + 0.0 AS x FROM P JOIN PN ON P.vec_id = PN.vec_id""")
def project_fixed_axes(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    mean = ag.centroids(rows.withColumn("all", F.lit(0)), ["all"]).select(F.col("centroid").alias("mean"))
    axes = F.array(*[F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(64)]) for i in range(8)])
    out = rows.join(F.broadcast(mean)).select("content_id", normalise(project(F.col("vector"), F.col("mean"), axes)).alias("v"))
    return out.select(F.col("content_id").alias("vec_id"), F.posexplode("v").alias("pos", "x")).select("vec_id", "pos", rounded(F.col("x")).alias("x"))


@query(f"WITH {L}, M AS (SELECT pos, avg(x) AS m FROM N GROUP BY pos), Y AS (SELECT vec_id, N.pos, x - m AS y FROM N JOIN M ON N.pos = M.pos) SELECT a.pos::INT AS i, b.pos::INT AS j, round(sum(a.y * b.y) / (count(*) - 1), 6) + 0.0 AS cov FROM Y a JOIN Y b ON a.vec_id = b.vec_id AND a.pos <= b.pos GROUP BY 1, 2")
def covariance_matrix(spark, sf_dir):
    from ..operators.pca import moments

    m = moments(vectors(spark, sf_dir), "vector")
    return m.select("i", "j", rounded((F.col("xy") - F.col("xi") * F.col("xj") / F.col("n")) / (F.col("n") - 1)).alias("cov"))


@query()
def pca_reduced_distances(spark, sf_dir):
    """Distances after a reduction to 8 dimensions: they don't depend on the axes' signs."""
    from ..operators.pca import fit_pca, transform_pca

    rows = vectors(spark, sf_dir)
    reduced = transform_pca(rows, fit_pca(rows, 8), "vector").select("content_id", normalise("reduced").alias("vector"))
    return hits(knn.knn_exact(reduced, reduced.where("content_id % 100 = 0").select(F.col("content_id").alias("query_id"), "vector"), 5))


TOKENS = "SELECT doc_id, lang, source, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents WHERE length(trim(text)) > 0"


def tfidf_sql(g: str) -> str:
    return f"""WITH W AS ({TOKENS}), NN AS (SELECT {g} AS g, count(*) AS n FROM documents WHERE length(trim(text)) > 0 GROUP BY 1),
TF AS (SELECT {g} AS g, doc_id, term, count(*) AS tf FROM W GROUP BY 1, 2, 3),
TT AS (SELECT g, term, total, df FROM (SELECT g, term, sum(tf) AS total, count(*) AS df, row_number() OVER (PARTITION BY g ORDER BY sum(tf) DESC, term) AS r FROM TF GROUP BY g, term) WHERE r <= 50),
ID AS (SELECT TT.g, term, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM TT JOIN NN ON TT.g = NN.g),
WT AS (SELECT TF.g, doc_id, TF.term, tf * idf AS w FROM TF JOIN ID ON TF.g = ID.g AND TF.term = ID.term), LN AS (SELECT g, doc_id, sqrt(sum(w * w)) AS l FROM WT GROUP BY 1, 2),
S AS (SELECT WT.g, term, sum(w / l) AS score FROM WT JOIN LN ON WT.g = LN.g AND WT.doc_id = LN.doc_id GROUP BY 1, 2)
SELECT g AS {g}, rank::INT AS rank, term, round(score, 4) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(score, 9) DESC, term) AS rank FROM S) WHERE rank <= 3"""


def tfidf(spark, sf_dir, group: str) -> DataFrame:
    found = lb.keywords(table(spark, sf_dir, "documents"), group, id_col="doc_id")
    return found.select(group, F.col("rank").cast("int").alias("rank"), "term", rounded(F.col("score"), 4).alias("score"))


@query(tfidf_sql("lang"))
def tfidf_top3_by_lang(spark, sf_dir):
    return tfidf(spark, sf_dir, "lang")


@query(tfidf_sql("source"))
def tfidf_top3_by_source(spark, sf_dir):
    return tfidf(spark, sf_dir, "source")


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS total FROM ({TOKENS}) GROUP BY term")
def tokens_df(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("term"))
    once = words.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return once.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("total"))


TAGS = ["license", "ción", "thing", "Der"]


@query("SELECT doc_id, " + ", ".join(f"CASE WHEN contains(lower(text), '{t.lower()}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS tag{i}" for i, t in enumerate(TAGS)) + " FROM documents")
def tag_multihot_text(spark, sf_dir):
    hot = table(spark, sf_dir, "documents").select("doc_id", tx.multi_hot_text(F.col("text"), TAGS).alias("v"))
    return hot.select("doc_id", *[F.col("v")[i].alias(f"tag{i}") for i in range(len(TAGS))])


@query("SELECT user_id, " + ", ".join(f"max(CASE WHEN event_type = '{t}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS tag{i}" for i, t in enumerate(("click", "view", "purchase"))) + " FROM events GROUP BY user_id")
def tag_multihot_list(spark, sf_dir):
    lists = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("tags"))
    hot = lists.select("user_id", tx.multi_hot_list(F.col("tags"), ["click", "view", "purchase"]).alias("v"))
    return hot.select("user_id", *[F.col("v")[i].alias(f"tag{i}") for i in range(3)])


@query("SELECT event_type, count(*) AS n, sum(CASE WHEN event_type = 'view' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hot FROM events GROUP BY event_type")
def tag_unknown_ignored(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", tx.multi_hot_list(F.array("event_type"), ["view", "view"])[0].alias("hot"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("hot").alias("hot"))


@query("SELECT doc_id, ('0x' || substr(md5(text), 1, 8))::BIGINT AS seed FROM documents")
def hash_seed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.hash_seed(F.col("text")).alias("seed"))


@query("SELECT doc_id, md5(text) AS content_id FROM documents")
def content_identity_md5(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("content_id"))


@query("SELECT md5(text) AS content_id, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("content_id"))
    return rows.groupBy("content_id").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1")


@query("SELECT DISTINCT md5(text) AS text_md5 FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l JOIN documents e ON l.doc_id = e.doc_id WHERE md5(e.text) = md5(d.text))")
def embedding_cache_misses(spark, sf_dir):
    """Texts that a cache, here those of labelled documents, doesn't hold yet, each once."""
    from ..operators.embedders import cache_misses

    docs = table(spark, sf_dir, "documents")
    cache = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select(F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return cache_misses(docs, cache).select("text_md5")


SAFE = """regexp_replace(regexp_replace(regexp_replace({x}, '[\\\\/:*?"<>|#\\[\\]^\\n\\r\\t]+', ' ', 'g'), '\\s+', ' ', 'g'), '^[. ]+|[. ]+$', '', 'g')"""


@query(f"SELECT page_id, CASE WHEN n = '' THEN 'untitled' ELSE n END AS name FROM (SELECT page_id, {SAFE.format(x='url')} AS n FROM pages)")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.safe_name(F.col("url")).alias("name"))


@query("""SELECT doc_id, source, lang, CASE WHEN r = 1 THEN lang ELSE lang || '-' || r END AS folder FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents)""")
def dedupe_folders(spark, sf_dir):
    from ..sources.folders import deduped

    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return deduped(rows, ["source"], "lang", ["doc_id"], "folder")


@query("""WITH M AS (SELECT md5(text) AS m, min(doc_id) AS f FROM documents GROUP BY 1)
SELECT doc_id, CASE WHEN doc_id = f THEN 'move' ELSE 'copy' END AS action, f AS source_doc FROM documents JOIN M ON md5(text) = m""")
def file_plan_action(spark, sf_dir):
    from ..sources.folders import plan_actions

    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.md5(F.col("text").cast("binary")).alias("md5"))
    files = rows.groupBy("md5").agg(F.min("seq").alias("path"))
    return plan_actions(rows, files).select(F.col("seq").alias("doc_id"), "action", F.col("path").alias("source_doc"))


@query("""SELECT conv_id, turn, CASE WHEN length(s) > 60 THEN substr(s, 1, 59) || '…' ELSE s END AS short FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM conversations)""")
def short_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.short(F.col("text")).alias("short"))


@query("SELECT l.doc_id, d.source, md5(d.text) AS content_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1 AND d.lang = 'en'")
def content_load_where(spark, sf_dir):
    """Content of a table under a predicate; the scan reads only the columns asked for, with the filters pushed down."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "source", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return docs.join(good, "doc_id").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("content_id"))


@query("SELECT event_id, event_type AS kind, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def metadata_merge(spark, sf_dir):
    """Two maps of metadata, the later one wins."""
    from ..operators.embedders import merged

    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "map<string,string>").alias("props"))
    both = merged(F.create_map(F.lit("kind"), F.col("event_type"), F.lit("k"), F.lit("none")), F.col("props"))
    return rows.select("event_id", both["kind"].alias("kind"), both["k"].cast("bigint").alias("k"))


@query(f"WITH {L}, {KNN.format(where='WHERE q.vec_id % 100 = 0')} SELECT query_id, rank::INT AS rank, content_id, round(d, 6) + 0.0 AS distance FROM R WHERE rank <= 3")
def warmup_scan(spark, sf_dir):
    """Before a reducer is fitted, queries scan the buffer in raw space: items without a leaf."""
    rows = vectors(spark, sf_dir).withColumn("leaf_id", F.lit(None).cast("bigint"))
    return hits(knn.knn_exact(rows.where("leaf_id is null"), by_hundreds(rows), 3))


SHOW = f"""{TREE}, LF AS (SELECT label // 5 AS branch, label, count(*) AS n FROM embeddings GROUP BY 1, 2)"""


@query("""SELECT node, name FROM (SELECT '/' AS node, 'v' || (SELECT min(vec_id) FROM embeddings WHERE label = (SELECT min(label) FROM embeddings)) AS name
UNION ALL SELECT '/' || (label // 5), 'v' || min_by(m, label) FROM (SELECT label, min(vec_id) AS m FROM embeddings GROUP BY label) GROUP BY label // 5
UNION ALL SELECT '/' || (label // 5) || '/' || label, 'v' || min(vec_id) FROM embeddings GROUP BY label)""")
def display_labels(spark, sf_dir):
    """A node without a label shows its first leaf's first text."""
    from .browse import display_labels as display

    rows = vectors(spark, sf_dir).select(F.array("branch", "label").alias("path"), F.col("content_id").alias("seq"), F.concat(F.lit("v"), F.col("content_id")).alias("text"))
    named = display(given_nodes(spark, sf_dir).withColumn("label", F.lit(None).cast("string")), rows)
    return named.select(F.col("node_id").alias("node"), "name")


@query("""WITH E AS (SELECT vec_id, label, label // 5 AS branch FROM embeddings),
B AS (SELECT branch, label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM E)
SELECT line FROM (SELECT '- root [' || count(*) || ']' AS line FROM E UNION ALL SELECT '  - b' || branch || ' [' || count(*) || ']' FROM E GROUP BY branch
UNION ALL SELECT '    - l' || label || ' [' || count(*) || ']' FROM E GROUP BY label UNION ALL SELECT '        · v' || vec_id FROM B WHERE r <= 3)""")
def outline_lines(spark, sf_dir):
    from .browse import outline

    rows = vectors(spark, sf_dir).select(F.array("branch", "label").alias("path"), F.col("content_id").alias("seq"), F.concat(F.lit("v"), F.col("content_id")).alias("text"))
    nodes = given_nodes(spark, sf_dir).withColumn("label", F.when(F.size("path") == 0, "root").when(F.size("path") == 1, F.concat(F.lit("b"), F.col("path")[0])).otherwise(F.concat(F.lit("l"), F.try_element_at("path", F.lit(2)))))
    return outline(nodes, rows, max_items=3).select("line")


@query("""WITH E AS (SELECT label, label // 5 AS branch, count(*) AS n FROM embeddings WHERE label = 3 OR label >= 5 GROUP BY 1, 2)
SELECT '/' AS node, '/' AS shown UNION ALL SELECT '/' || branch, CASE WHEN count(*) = 1 THEN '/' || branch || '/' || min(label) ELSE '/' || branch END FROM E GROUP BY branch UNION ALL SELECT '/' || branch || '/' || label, '/' || branch || '/' || label FROM E""")
def collapse_single_leaf(spark, sf_dir):
    """A branch with one leaf below it is shown as that leaf."""
    from .browse import collapsed

    rows = vectors(spark, sf_dir).where("label = 3 or label >= 5").select("branch", "label").distinct()
    path = F.explode(F.array(F.array().cast("array<int>"), F.array("branch"), F.array("branch", "label"))).alias("path")
    name = lambda p: F.concat(F.lit("/"), F.array_join(p.cast("array<string>"), "/"))
    found = collapsed(rows.select(path).distinct())
    return found.select(name(F.col("path")).alias("node"), name(F.col("shown")).alias("shown"))


def content_rows(spark, sf_dir, where: str = "true") -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(where)
    return rows.select(F.col("vec_id").alias("ordinal"), F.col("vec_id").cast("string").alias("content_id"), F.concat(F.lit("v"), F.col("vec_id")).alias("text"), F.lit("{}").alias("metadata"), doubles("embedding").alias("embedding"))


def grown(spark, sf_dir, **settings) -> DataFrame:
    """Leaves of a tree built from the top: (depth, leaf size, unsplittable, contents)."""
    from ..config import TreeConfig
    from ..operators.split import divisive

    rows = written(vectors(spark, sf_dir).select(F.col("content_id").alias("seq"), "vector"), "grown")
    leaves = divisive(rows, TreeConfig.of(**settings), keep=lambda t: written(t, "level")).groupBy("path").agg(F.count("*").alias("n"), F.max("unsplittable").alias("unsplittable"))
    return leaves.groupBy(F.size("path").alias("depth"), "n", "unsplittable").agg(F.count("*").alias("leaves"))


@query()
def divisive_fixed_tree(spark, sf_dir):
    return grown(spark, sf_dir)


@query()
def divisive_adaptive_tree(spark, sf_dir):
    return grown(spark, sf_dir, split_mode="adaptive", min_split_gain=0.005)


@query("SELECT count(*) AS items, sum(vec_id)::DOUBLE AS total, max(vec_id) AS last FROM embeddings")
def parquet_state_roundtrip(spark, sf_dir):
    """A tree saved and loaded again: nothing is lost."""
    import uuid

    from ..sources.states import ParquetState
    from .tree import Tree

    state = ParquetState(spark, f"{application_dir(spark)}/state-{uuid.uuid4().hex}")
    Tree(spark, state=state).ingest(content_rows(spark, sf_dir))
    back = Tree(spark, state=state)
    n = F.col("content_id").cast("long")
    return back.items.agg(F.count("*").alias("items"), F.sum(n).cast("double").alias("total"), F.max(n).alias("last"))


def tree_nodes(spark, sf_dir, removed: str | None = None):
    """A tree that takes the table in two batches, and then loses the items that `removed` asks for."""
    from ..config import TreeConfig
    from .tree import Tree

    t = Tree(spark, TreeConfig(leaf_target=40, max_branches=4))
    rows = content_rows(spark, sf_dir)
    t.ingest(rows.where("ordinal % 3 <> 0"))
    t.ingest(rows.where("ordinal % 3 = 0"))
    if removed:
        t.remove_all(rows.where(removed).select("content_id"))
    return t


def sums_of_nodes(t) -> DataFrame:
    """(pos, vsum, n) of the root, and of the sums of all leaves, which must be the same; over all nodes, counts that aren't their children's."""
    root = t.nodes.where(F.size("path") == 0).select(F.lit("root").alias("node"), F.posexplode("vsum").alias("pos", "x"), F.col("count").alias("n"))
    leaves = t.nodes.where("is_leaf").select(F.lit("leaves").alias("node"), F.posexplode("vsum").alias("pos", "x"), F.col("count").alias("n"))
    return root.unionByName(leaves).groupBy("node", "pos").agg(rounded(F.sum("x")).alias("vsum"), F.sum("n").alias("n")).select("node", "pos", "vsum", "n")


@query(f"WITH {L} SELECT node, pos::INT AS pos, round(sum(x), 6) + 0.0 AS vsum, count(*)::BIGINT AS n FROM N, (SELECT unnest(['root', 'leaves']) AS node) GROUP BY node, pos")
def tree_ingest_sums(spark, sf_dir):
    """T1, T4-T6, G8 by the tree itself: two batches, with splits; the root's and the leaves' sums."""
    return sums_of_nodes(tree_nodes(spark, sf_dir))


@query(f"WITH {L} SELECT node, pos::INT AS pos, round(sum(x), 6) + 0.0 AS vsum, count(*)::BIGINT AS n FROM N, (SELECT unnest(['root', 'leaves']) AS node) WHERE vec_id % 7 <> 0 AND label NOT IN (3, 4) GROUP BY node, pos")
def tree_remove_sums(spark, sf_dir):
    """T10-T12 by the tree itself: every seventh vector and two labels go; no empty node stays."""
    t = tree_nodes(spark, sf_dir, "ordinal % 7 = 0 or cast(ordinal as long) in (select vec_id from parquet.`" + f"{sf_dir}/embeddings.parquet" + "` where label in (3, 4))")
    return sums_of_nodes(t)


@query(f"WITH {L}, {KNN.format(where='WHERE q.vec_id % 100 = 0')} SELECT query_id, rank::INT AS rank, content_id::VARCHAR AS content_id, round(d, 6) + 0.0 AS distance FROM R WHERE rank <= 4")
def tree_exact_query(spark, sf_dir):
    """N1 by the tree itself, over two segments."""
    t = tree_nodes(spark, sf_dir)
    asked = content_rows(spark, sf_dir, "vec_id % 100 = 0").select(F.col("ordinal").alias("query_id"), "embedding")
    found = t.query(asked, 6, exhaustive=True)
    # ties by id are by the text of an id there, by number in the other
    order = Window.partitionBy("query_id").orderBy("distance", F.col("content_id").cast("long"))
    return found.select("query_id", F.row_number().over(order).alias("rank"), "content_id", rounded(F.col("distance")).alias("distance")).where("rank <= 4")


@query(f"WITH {L}, {KNN.format(where='WHERE q.vec_id % 100 = 0')} SELECT query_id, rank::INT AS rank, content_id::VARCHAR AS content_id, round(d, 6) + 0.0 AS distance FROM R WHERE rank <= 3")
def tree_warmup_query(spark, sf_dir):
    """N3 by the tree itself: its reducer waits for more items than there are."""
    from ..config import TreeConfig
    from .tree import Tree

    t = Tree(spark, TreeConfig(pca_dims=8, pca_warmup=10_000_000))
    t.ingest(content_rows(spark, sf_dir))
    found = t.query(content_rows(spark, sf_dir, "vec_id % 100 = 0").select(F.col("ordinal").alias("query_id"), "embedding"), 5)
    order = Window.partitionBy("query_id").orderBy("distance", F.col("content_id").cast("long"))
    return found.select("query_id", F.row_number().over(order).alias("rank"), "content_id", rounded(F.col("distance")).alias("distance")).where("rank <= 3")


@query("SELECT doc_id::VARCHAR AS content_id, md5(text) AS text_md5, lang FROM documents WHERE lang = 'de' AND n_chars > 500")
def content_from_table(spark, sf_dir):
    """S6 by content_from(): predicate and columns reach the scan."""
    from ..sources.states import content_from

    rows = content_from(table(spark, sf_dir, "documents"), "doc_id", "text", ["lang"], "lang = 'de' and n_chars > 500")
    return rows.select("content_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.get_json_object("metadata", "$.lang").alias("lang"))


@query("SELECT count(*) AS items, max(vec_id) + 1 AS next_seq, count(*) AS in_root FROM embeddings")
def stream_ingest_counts(spark, sf_dir):
    """The table as a stream, ingested by micro-batches."""
    import uuid

    from ..config import TreeConfig
    from ..streaming.ingest import stream_into
    from .tree import Tree

    at = f"{application_dir(spark)}/stream-{uuid.uuid4().hex}"
    content_rows(spark, sf_dir).repartition(3, "ordinal").write.parquet(f"{at}/in")
    tree = Tree(spark, TreeConfig(leaf_target=40))
    rows = spark.readStream.schema(content_rows(spark, sf_dir).schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    stream_into(tree, rows, f"{at}/marks").awaitTermination()
    root = tree.nodes.where(F.size("path") == 0).select(F.col("count").alias("in_root"))
    counts = tree.items.agg(F.count("*").alias("items"), (F.max("seq") + 1).alias("next_seq"))
    return counts.join(F.broadcast(root)).select("items", "next_seq", "in_root")
