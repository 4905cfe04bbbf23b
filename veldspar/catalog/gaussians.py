"""Queries over vectors and Gaussians."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.catalog.registry import query, rounded
from veldspar.functions import answers
from veldspar.functions import geometry as G
from veldspar.functions import vectors as V
from veldspar.operators import encoding, evaluation, retrieval, store, taxonomy
from veldspar.operators.lexical import ranked
from veldspar.plans import hybrid
from veldspar.session import Workspace, table

# the vectors, and the variances of the learned estimator
BASE = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS m FROM embeddings),
v AS (SELECT vec_id, label, m, list_transform(m, lambda x: greatest(abs(x) / greatest(sqrt(list_dot_product(m, m)), 1e-6), 1e-6)) AS s FROM e),
q AS (SELECT vec_id AS query_id, m AS qm, s AS qs FROM v WHERE vec_id % 50 = 0)"""
ELK = """-0.5 * (greatest(list_sum(list_transform(list_zip(qm, m, qs, s), lambda z: (z[1] - z[2]) * (z[1] - z[2]) / (greatest(z[3], 1e-9) + greatest(z[4], 1e-9)))), 0)
 + list_sum(list_transform(list_zip(qs, s), lambda z: ln(greatest(z[1], 1e-9) + greatest(z[2], 1e-9))))) / len(m)"""


def gaussians(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "embeddings").select("vec_id", "label", V.doubles("embedding").alias("mu"))
    return rows.withColumn("sigma_diag", encoding.learned_variance(F.col("mu")))


def asked(rows: DataFrame) -> DataFrame:
    """The query set: every row whose id is divisible by 50."""
    return rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("mu").alias("q_mu"), F.col("sigma_diag").alias("q_sigma"))


def pairs(spark: SparkSession, root: str) -> DataFrame:
    rows = gaussians(spark, root)
    return retrieval_pairs(rows, asked(rows))


def retrieval_pairs(rows: DataFrame, queries: DataFrame, most: int = 5000) -> DataFrame:
    """A stated query set against all rows, in blocks of at most ``most`` queries that are broadcast."""
    blocks = max(1, -(-queries.count() // most))
    out = None
    for b in range(blocks):
        part = F.broadcast(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b))
        both = rows.join(part)
        out = both if out is None else out.unionByName(both)
    return out


def _nearest(spark, root, metric, keep=None) -> DataFrame:
    rows = gaussians(spark, root)
    q = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "mu")
    rows = rows if keep is None else keep(rows)
    out = retrieval.nearest(rows, q, 10, metric, "vec_id")
    return out.select("query_id", "vec_id", rounded("distance").alias("distance"), "rank")


def _topk(distance: str, where: str = "true") -> str:
    return f"""{BASE}, d AS (SELECT query_id, vec_id, {distance} AS distance FROM q, v WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM d)
SELECT query_id, vec_id, round(distance, 6) + 0.0 AS distance, rank FROM r WHERE rank <= 10"""


@query(_topk("list_distance(qm, m)"))
def dense_l2_topk(spark, root):
    return _nearest(spark, root, "l2")


@query(_topk("CASE WHEN query_id = vec_id THEN 0 ELSE 1 - list_dot_product(qm, m) / (sqrt(list_dot_product(qm, qm)) * sqrt(list_dot_product(m, m))) END"))
def cosine_topk(spark, root):
    return _nearest(spark, root, "cosine")


@query(_topk("list_distance(qm, m)", "label IN (1, 3, 5)"))
def dense_allowlist(spark, root):
    allowed = gaussians(spark, root).where("label in (1, 3, 5)").select("vec_id")
    return _nearest(spark, root, "l2", lambda rows: rows.join(allowed, "vec_id", "left_semi"))


@query(_topk("list_distance(qm, m)", "label NOT IN (1, 3, 5)"))
def dense_excluding(spark, root):
    gone = gaussians(spark, root).where("label in (1, 3, 5)").select("vec_id")
    return _nearest(spark, root, "l2", lambda rows: rows.join(gone, "vec_id", "left_anti"))


@query(f"""{BASE}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(qm, m), vec_id) AS n FROM q, v),
k AS (SELECT query_id, vec_id, {ELK} AS score, 1 / (1 + list_sum(s)) AS confidence FROM c WHERE n <= 30)
SELECT query_id, vec_id, round(score, 6) + 0.0 AS score, round(score * confidence, 6) + 0.0 AS weighted,
 row_number() OVER (PARTITION BY query_id ORDER BY round(-score * confidence, 9), vec_id)::INTEGER AS rank FROM k""")
def elk_diag_rerank(spark, root):
    rows = gaussians(spark, root)
    q = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "mu")
    near = retrieval.nearest(rows, q, 30, "l2", "vec_id").select("query_id", "vec_id")
    both = hybrid.rerank(near.join(asked(rows), "query_id").join(rows, "vec_id"), "elk", "vec_id").withColumn("weighted", -F.col("sort_key")).withColumn("o", F.round("sort_key", 9))
    return ranked(both, ["query_id"], ["o", "vec_id"]).select("query_id", "vec_id", rounded("score").alias("score"), rounded("weighted").alias("weighted"), "rank")


W2 = encoding.rank_weight()


@query(f"""{BASE}, t AS (SELECT query_id, vec_id, len(m) AS d, list_transform(list_zip(qs, s), lambda z: greatest(z[1], 1e-9) + greatest(z[2], 1e-9)) AS p,
 list_transform(list_zip(qm, m), lambda z: z[1] - z[2]) AS g, s FROM q, v),
u AS (SELECT *, list_sum(list_transform(list_zip(g, p), lambda z: z[1] * z[1] / z[2])) AS m0, list_sum(list_transform(list_zip(s, p), lambda z: z[1] * z[1] / z[2])) AS ss,
 list_sum(list_transform(list_zip(s, g, p), lambda z: z[1] * z[2] / z[3])) AS tt, list_sum(list_transform(p, lambda x: ln(x))) AS l FROM t)
SELECT query_id, vec_id, round(-0.5 * (greatest(m0 - {W2!r} * tt * tt / (1 + {W2!r} * ss), 0) + l + ln(1 + {W2!r} * ss)) / d, 6) + 0.0 AS score FROM u""")
def elk_rank_one(spark, root):
    both = pairs(spark, root)
    return both.select("query_id", "vec_id", rounded(G.elk_rank_one("q_mu", "q_sigma", "mu", "sigma_diag", W2)).alias("score"))


@query()
def elk_low_rank(spark, root):
    """Factors of rank 8 on both sides, in Arrow batches; equals ``elk_rank_one`` where only the document has one."""
    rows = gaussians(spark, root).withColumn("sigma_l", encoding.learned_factor(F.col("sigma_diag")))
    q = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("mu").alias("q_mu"), F.col("sigma_diag").alias("q_sigma"), F.col("sigma_l").alias("q_l"))
    near = retrieval.nearest(rows, q.select("query_id", F.col("q_mu").alias("mu")), 30, "l2", "vec_id").select("query_id", "vec_id")
    both = near.join(q, "query_id").join(rows, "vec_id")
    return both.select("query_id", "vec_id", rounded(G.elk_low_rank("q_mu", "q_sigma", "q_l", "mu", "sigma_diag", "sigma_l")).alias("score"))


def _score(expression: str) -> str:
    return f"{BASE} SELECT query_id, vec_id, round({expression}, 6) + 0.0 AS score FROM q, v"


GAP = "list_sum(list_transform(list_zip(qm, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query(_score(f"sqrt({GAP} + greatest(list_sum(qs) + list_sum(s) - 2 * list_sum(list_transform(list_zip(qs, s), lambda z: sqrt(greatest(greatest(z[1], 1e-9) * z[2], 1e-9)))), 0))"))
def w2_diag(spark, root):
    return pairs(spark, root).select("query_id", "vec_id", rounded(G.wasserstein_diagonal("q_mu", "q_sigma", "mu", "sigma_diag")).alias("score"))


@query(_score(f"sqrt({GAP} + list_sum(list_transform(list_zip(qs, s), lambda z: pow(ln(greatest(greatest(z[2], 1e-9) / greatest(z[1], 1e-9), 1e-9)), 2))))"))
def fisher_rao_diag(spark, root):
    return pairs(spark, root).select("query_id", "vec_id", rounded(G.fisher_rao_diagonal("q_mu", "q_sigma", "mu", "sigma_diag")).alias("score"))


@query(_score("0.5 * (ln(greatest(list_product(s), 1e-9)) - ln(greatest(list_product(qs), 1e-9)) - len(m) + list_sum(list_transform(list_zip(qs, s), lambda z: z[1] / z[2])) + list_sum(list_transform(list_zip(qm, m, s), lambda z: (z[1] - z[2]) * (z[1] - z[2]) / z[3])))").replace("6) + 0.0 AS score", "3) + 0.0 AS score"))
def kl_diag(spark, root):
    return pairs(spark, root).select("query_id", "vec_id", rounded(G.kl_diagonal("q_mu", "q_sigma", "mu", "sigma_diag"), 3).alias("score"))


@query(_score("list_sum(list_transform(list_zip(qm, m, qs, s), lambda z: (z[1] - z[2]) * (z[1] - z[2]) / ((z[3] + z[4]) / 2))) / 8 + 0.5 * (ln(greatest(list_product(list_transform(list_zip(qs, s), lambda z: (z[1] + z[2]) / 2)), 1e-9)) - 0.5 * (ln(greatest(list_product(qs), 1e-9)) + ln(greatest(list_product(s), 1e-9))))"))
def bhattacharyya_diag(spark, root):
    return pairs(spark, root).select("query_id", "vec_id", rounded(G.bhattacharyya_diagonal("q_mu", "q_sigma", "mu", "sigma_diag")).alias("score"))


CUT = f"""{BASE}, k AS (SELECT query_id, vec_id, round(list_distance(qm, m), 9) AS d FROM q, v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id)::INTEGER AS rank FROM k),
t AS (SELECT * FROM r WHERE rank <= 30)"""


@query(CUT + """, g AS (SELECT *, lead(d) OVER (PARTITION BY query_id ORDER BY rank) - d AS gap FROM t),
w AS (SELECT query_id, arg_min(rank, (-gap, rank)) AS widest FROM g WHERE gap IS NOT NULL GROUP BY query_id)
SELECT query_id, vec_id, round(d, 6) + 0.0 AS distance, rank FROM g JOIN w USING (query_id) WHERE rank <= widest + 2""")
def adaptive_gap_cut(spark, root):
    rows = gaussians(spark, root)
    q = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "mu")
    near = retrieval.nearest(rows, q, 30, "l2", "vec_id").withColumn("d", F.round("distance", 9)).drop("rank")
    return retrieval.adaptive_cut(near, "vec_id", "d").select("query_id", "vec_id", rounded("distance").alias("distance"), "rank")


@query("""WITH c AS (SELECT chunk_id, {'s': sigma_diag, 'l': sigma_l} AS x FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingest_seq DESC, sigma_diag DESC NULLS LAST, sigma_l DESC NULLS LAST) AS n FROM chunks) WHERE n = 1),
u AS (SELECT chunk_id, list_sum(x.s) + coalesce(list_sum(list_transform(flatten(x.l), lambda v: v * v)), 0) AS tr FROM c
 WHERE len(x.s) = 64 AND len(list_filter(x.s, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0)
SELECT chunk_id, round(tr, 6) + 0.0 AS trace, round(1 / (1 + greatest(tr, 0)), 6) + 0.0 AS confidence,
 CASE WHEN 1 / (1 + greatest(tr, 0)) >= 0.5 THEN 'low' WHEN 1 / (1 + greatest(tr, 0)) >= 0.2 THEN 'medium' ELSE 'high' END AS uncertainty_label FROM u""")
def trace_confidence(spark, root):
    rows = store.latest(table(spark, root, "chunks"), "chunk_id", "ingest_seq", "sigma_diag", "sigma_l").where(V.finite("sigma_diag", 64))
    rows = rows.withColumn("tr", G.trace("sigma_diag", "sigma_l")).withColumn("c", G.confidence(F.col("tr")))
    return rows.select("chunk_id", rounded("tr").alias("trace"), rounded("c").alias("confidence"), G.uncertainty(F.col("c")).alias("uncertainty_label"))


EACH = "WITH x AS (SELECT label, unnest(range(len(embedding)))::INTEGER AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query(EACH + ", d AS (SELECT dim, avg(abs(x)) AS m FROM x GROUP BY dim) SELECT dim, round(greatest(m, 1e-6) / greatest((SELECT sqrt(sum(greatest(m, 1e-6) ** 2)) FROM d), 1e-6), 6) + 0.0 AS scale FROM d")
def learned_sigma_fit(spark, root):
    return encoding.fit_scale(gaussians(spark, root)).select("dim", rounded("scale").alias("scale"))


@query(EACH + " SELECT label, dim, round(greatest(coalesce(var_samp(x), 1e-6), 1e-6), 6) + 0.0 AS variance FROM x GROUP BY label, dim")
def dissolver_variance(spark, root):
    return encoding.group_variance(gaussians(spark, root), "label").select("label", "dim", rounded("variance").alias("variance"))


@query()
def heuristic_sigma(spark, root):
    """Covariance of the views of each evaluation item, as traces of diagonal and factor."""
    out = encoding.encode(table(spark, root, "eval_items").select("item_id", "text"), "item_id", "heuristic", 64, 16)
    return out.select("item_id", rounded(G.trace("sigma_diag")).alias("diagonal"), rounded(G.trace("sigma_diag", "sigma_l")).alias("trace"))


@query()
def entity_aware_sigma(spark, root):
    """The same with five views, narrowed by how few different entities a text has."""
    out = encoding.encode(table(spark, root, "eval_items").select("item_id", "text"), "item_id", "entity_aware", 64, 8)
    return out.select("item_id", rounded(G.trace("sigma_diag")).alias("diagonal"), rounded(G.trace("sigma_diag", "sigma_l")).alias("trace"))


ENTITY_STOP = ", ".join(f"'{w}'" for w in answers.ENTITY_STOP)
ENTITIES = f"""e AS (SELECT item_id, list_filter(regexp_extract_all(text, '\\b([A-Za-z][a-z]*)\\b', 1), lambda w: w ~ '^[A-Z].*' AND NOT list_contains([{ENTITY_STOP}], lower(w))) AS e FROM eval_items)"""


@query(f"WITH {ENTITIES} SELECT item_id, round(CASE WHEN len(e) = 0 THEN 0.5 ELSE greatest(len(list_distinct(list_transform(e, lambda w: lower(w))))::DOUBLE / len(e), 0.1) END, 9) + 0.0 AS scale FROM e")
def entity_density(spark, root):
    return table(spark, root, "eval_items").select("item_id", rounded(encoding.entity_scale(F.col("text")), 9).alias("scale"))


@query(f"""WITH {ENTITIES}, w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS w FROM eval_items),
x AS (SELECT item_id, len(w) AS n, greatest(len(list_distinct(list_transform(w, lambda t: lower(t))))::DOUBLE / greatest(len(w), 1), CASE WHEN len(e) > 0 THEN len(list_distinct(list_transform(e, lambda t: lower(t))))::DOUBLE / len(e) ELSE 0 END) * (1 - exp(-len(w) / 4.0)) AS d FROM w JOIN e USING (item_id)),
t AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS t FROM eval_items),
b AS (SELECT item_id, ('0x' || substr(md5(t), 1, 4))::INTEGER % 64 AS dim, count(*) AS c FROM t GROUP BY ALL), m AS (SELECT item_id, dim, c / sqrt(sum(c * c) OVER (PARTITION BY item_id)) AS m FROM b)
SELECT item_id, dim, round(greatest(CASE WHEN n <= 1 THEN m * 0.01 + 1e-4 ELSE greatest(least(d, 1), 0.05) * (m + 0.01) * 1e-2 END, 1e-6), 9) + 0.0 AS variance FROM m JOIN x USING (item_id)""")
def entity_query_variance(spark, root):
    out = encoding.encode_query(table(spark, root, "eval_items").select("item_id", "text"), "item_id", "entity_aware")
    out = out.select("item_id", F.posexplode(F.arrays_zip("mu", "sigma_diag")).alias("dim", "z")).where("z.mu > 0")
    return out.select("item_id", "dim", rounded(F.col("z.sigma_diag"), 9).alias("variance"))


@query("""WITH t AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS t FROM eval_items),
b AS (SELECT item_id, ('0x' || substr(md5(t), 1, 4))::INTEGER % 64 AS dim, count(*) AS c FROM t GROUP BY ALL)
SELECT item_id, dim, round(c / sqrt(sum(c * c) OVER (PARTITION BY item_id)), 6) + 0.0 AS value FROM b""")
def hashed_encoder(spark, root):
    vec = encoding.hashed(table(spark, root, "eval_items"), "item_id").select("item_id", F.posexplode("mu").alias("dim", "value"))
    return vec.where("value > 0").select("item_id", "dim", rounded("value").alias("value"))


CENTROIDS = """, x AS (SELECT label, unnest(range(len(m)))::INTEGER AS dim, unnest(list_transform(m, lambda t: t / sqrt(list_dot_product(m, m)))) AS x FROM v),
y AS (SELECT label, dim, sum(x) AS x FROM x GROUP BY ALL), c AS (SELECT label AS leaf, list(x ORDER BY dim) AS c FROM y GROUP BY label),
a AS (SELECT vec_id, leaf, list_dot_product(m, c) / (sqrt(list_dot_product(m, m)) * sqrt(list_dot_product(c, c))) AS similarity FROM v, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, leaf)::INTEGER AS rank FROM a)"""


def leaves(spark, root) -> tuple[DataFrame, DataFrame]:
    rows = gaussians(spark, root)
    return rows, taxonomy.centroids(rows, "label")


@query(BASE + CENTROIDS + " SELECT leaf, u.i::INTEGER AS dim, round(c[u.i + 1] / sqrt(list_dot_product(c, c)), 6) + 0.0 AS value FROM c, unnest(range(64)) AS u(i)")
def centroid_update(spark, root):
    return leaves(spark, root)[1].select("leaf", F.posexplode("centroid").alias("dim", "value")).select("leaf", "dim", rounded("value").alias("value"))


@query(BASE + CENTROIDS + " SELECT vec_id, leaf, round(similarity, 6) + 0.0 AS similarity FROM r WHERE rank = 1")
def leaf_assign(spark, root):
    rows, c = leaves(spark, root)
    return taxonomy.assign(rows, c, "vec_id").where("rank = 1").select("vec_id", "leaf", rounded("similarity").alias("similarity"))


@query(BASE + CENTROIDS + ", b AS (SELECT *, max(similarity) OVER (PARTITION BY vec_id) AS best FROM r) SELECT vec_id, leaf, rank = 1 AS is_primary FROM b WHERE rank = 1 OR (rank = 2 AND similarity >= best - 0.025)")
def secondary_membership(spark, root):
    rows, c = leaves(spark, root)
    return taxonomy.memberships(taxonomy.assign(rows, c, "vec_id"), "vec_id").select("vec_id", "leaf", "is_primary")


ROUTE = BASE + CENTROIDS + """, b AS (SELECT *, max(similarity) OVER (PARTITION BY vec_id) AS best FROM r), mem AS (SELECT vec_id, leaf FROM b WHERE rank = 1 OR (rank = 2 AND similarity >= best - 0.025)),
o AS (SELECT vec_id AS query_id, leaf, rank AS place FROM r WHERE vec_id % 50 = 0),
s AS (SELECT query_id, mem.vec_id, min(place) AS place FROM o JOIN mem USING (leaf) GROUP BY ALL), n AS (SELECT query_id, place, count(*) AS new FROM s GROUP BY ALL),
run AS (SELECT o.*, sum(coalesce(new, 0)) OVER (PARTITION BY o.query_id ORDER BY o.place) AS items FROM o LEFT JOIN n ON n.query_id = o.query_id AND n.place = o.place),
st AS (SELECT *, min(CASE WHEN place >= 4 AND items >= 50 THEN place END) OVER (PARTITION BY query_id) AS stop FROM run),
routed AS (SELECT query_id, leaf, place, items FROM st WHERE stop IS NULL OR place <= stop)"""


def _route(spark, root):
    rows, c = leaves(spark, root)
    members = taxonomy.memberships(taxonomy.assign(rows, c, "vec_id"), "vec_id")
    q = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "mu")
    return taxonomy.route(q, c, members, key="vec_id"), members


@query(ROUTE + " SELECT query_id, leaf, place, items::BIGINT AS items FROM routed")
def route_leaves(spark, root):
    return _route(spark, root)[0]


@query(ROUTE + " SELECT query_id, count(DISTINCT vec_id) AS allowed, round(1 - count(DISTINCT vec_id) / (SELECT count(DISTINCT vec_id) FROM mem), 6) + 0.0 AS ratio FROM routed JOIN mem USING (leaf) GROUP BY query_id")
def pruning_ratio(spark, root):
    routed, members = _route(spark, root)
    return taxonomy.pruning(routed, members, "vec_id").select("query_id", "allowed", rounded("ratio").alias("ratio"))


@query()
def taxonomy_kmeans(spark, root):
    """Leaves from spherical k-means, with their sizes."""
    rows = gaussians(spark, root)
    c = taxonomy.spherical_kmeans(rows, 8, "vec_id")
    return taxonomy.assign(rows, c, "vec_id").where("rank = 1").groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("similarity")).alias("similarity"))


@query()
def taxonomy_tree(spark, root):
    """The tree of topics and leaves, with sizes and labels from the vectors' labels."""
    rows = gaussians(spark, root).withColumn("text", F.concat(F.lit("label_"), F.col("label").cast("string"), F.lit(" vector_"), (F.col("vec_id") % 7).cast("string")))
    tree = taxonomy.build(rows, "vec_id", Workspace(spark, "tree"))
    return tree.nodes.select("node", "parent", "depth", "label", "item_count", "assigned_count")


@query()
def elk_dense(spark, root):
    """ELK of full covariances, from diagonals and factors of rank 8, for the 30 nearest rows."""
    rows = gaussians(spark, root).withColumn("sigma_l", encoding.learned_factor(F.col("sigma_diag")))
    q = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("mu").alias("q_mu"), F.col("sigma_diag").alias("q_sigma"), F.col("sigma_l").alias("q_l"))
    near = retrieval.nearest(rows, q.select("query_id", F.col("q_mu").alias("mu")), 30, "l2", "vec_id").select("query_id", "vec_id")
    both = near.join(q, "query_id").join(rows, "vec_id")
    return both.select("query_id", "vec_id", rounded(G.elk_dense("q_mu", "q_sigma", "q_l", "mu", "sigma_diag", "sigma_l")).alias("score"))


@query()
def diversity_greedy(spark, root):
    rows = gaussians(spark, root)
    q = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "mu")
    near = retrieval.nearest(rows, q, 30, "l2", "vec_id").select("query_id", "vec_id", "rank")
    return retrieval.diverse(near.join(rows, "vec_id"), 1.2, 5, "vec_id")


@query(f"""{BASE}, c AS (SELECT query_id, vec_id, m, s, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(qm, m), vec_id) AS n FROM q, v), t AS (SELECT * FROM c WHERE n <= 10),
p AS (SELECT a.query_id, sqrt(list_sum(list_transform(list_zip(a.m, b.m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + greatest(list_sum(a.s) + list_sum(b.s) - 2 * list_sum(list_transform(list_zip(a.s, b.s), lambda z: sqrt(greatest(greatest(z[1], 1e-9) * z[2], 1e-9)))), 0)) AS w
 FROM t a JOIN t b ON a.query_id = b.query_id AND a.vec_id < b.vec_id)
SELECT query_id, round(avg(w), 6) + 0.0 AS coverage FROM p GROUP BY query_id""")
def coverage_score(spark, root):
    rows = gaussians(spark, root)
    q = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "mu")
    near = retrieval.nearest(rows, q, 10, "l2", "vec_id").select("query_id", "vec_id")
    return retrieval.coverage(near.join(rows, "vec_id"), "query_id", "vec_id").select("query_id", rounded("coverage").alias("coverage"))


@query(f"""{BASE}, l AS (SELECT vec_id, label FROM v), c AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(qm, m), vec_id) AS n FROM q, v),
t AS (SELECT c.query_id, c.vec_id, n, a.label = b.label AS hit FROM c JOIN l a ON a.vec_id = c.query_id JOIN l b ON b.vec_id = c.vec_id WHERE n <= 10),
z AS (SELECT a.vec_id AS query_id, count(*) AS total FROM l a JOIN l b ON a.label = b.label WHERE a.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, round(count(*) FILTER (hit) / any_value(total), 6) + 0.0 AS recall,
 round(coalesce(sum(1 / log2(n + 1)) FILTER (hit), 0) / any_value(list_sum(list_transform(range(1, least(total, 10) + 1), lambda i: 1 / log2(i + 1)))), 6) + 0.0 AS ndcg FROM t JOIN z USING (query_id) GROUP BY query_id""")
def recall_ndcg(spark, root):
    rows = gaussians(spark, root)
    q = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "mu", "label")
    run = retrieval.nearest(rows, q, 10, "l2", "vec_id").withColumnRenamed("vec_id", "chunk_id")
    qrels = q.select("query_id", "label").join(rows.select("label", F.col("vec_id").alias("chunk_id")), "label")
    out = evaluation.retrieval(run, qrels, 10)
    return out.select("query_id", rounded("recall").alias("recall"), rounded("ndcg").alias("ndcg"))


OUTCOMES = BASE + ", p AS (SELECT vec_id, round(1 / (1 + list_sum(s) / 10), 9) AS confidence, (label % 2)::INTEGER AS outcome FROM v)"


def outcomes(spark, root):
    rows = gaussians(spark, root)
    c = 1 / (1 + G.trace("sigma_diag") / 10)
    return rows.select("vec_id", F.round(c, 9).alias("confidence"), (F.col("label") % 2).cast("int").alias("outcome"))


@query(OUTCOMES + " SELECT least(floor(confidence * 10), 9)::INTEGER AS bin, count(*) AS n, round(avg(confidence), 6) + 0.0 AS mean_confidence, round(avg(outcome), 6) + 0.0 AS accuracy FROM p GROUP BY 1")
def calibration_bins(spark, root):
    b = evaluation.calibration_bins(outcomes(spark, root))
    return b.select("bin", "n", rounded("mean_confidence").alias("mean_confidence"), rounded("accuracy").alias("accuracy"))


@query(OUTCOMES + ", b AS (SELECT least(floor(confidence * 10), 9) AS bin, count(*) AS n, avg(confidence) AS c, avg(outcome) AS a FROM p GROUP BY 1) SELECT round(sum(n * abs(c - a)) / sum(n), 6) + 0.0 AS ece FROM b")
def expected_calibration_error(spark, root):
    return evaluation.expected_calibration_error(outcomes(spark, root)).select(rounded("ece").alias("ece"))


@query(OUTCOMES + " SELECT round(avg(pow(confidence - outcome, 2)), 6) + 0.0 AS brier FROM p")
def brier_score(spark, root):
    return evaluation.brier(outcomes(spark, root)).select(rounded("brier").alias("brier"))


@query(OUTCOMES + """, w AS (SELECT vec_id, row_number() OVER (ORDER BY confidence DESC, vec_id) AS answered, sum(outcome) OVER (ORDER BY confidence DESC, vec_id ROWS UNBOUNDED PRECEDING) AS s, count(*) OVER () AS n FROM p)
SELECT vec_id, answered, round(answered / n, 6) + 0.0 AS retention, round(s / answered, 6) + 0.0 AS accuracy FROM w""")
def abstention_curve(spark, root):
    out = evaluation.abstention_curve(outcomes(spark, root), "vec_id")
    return out.select("vec_id", "answered", rounded("retention").alias("retention"), rounded("accuracy").alias("accuracy"))


@query(BASE + """, k AS (SELECT query_id, vec_id, label, list_distance(qm, m) AS d FROM q, v WHERE label < 3), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY d, vec_id)::INTEGER AS rank FROM k),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, label, vec_id)::INTEGER AS place FROM r WHERE rank <= 10) SELECT query_id, vec_id, label AS sense, rank AS sense_rank, place AS rank FROM f WHERE place <= 12""")
def multi_sense_interleave(spark, root):
    per = per_sense(spark, root)
    return retrieval.interleave(per, 12, "vec_id").select("query_id", "vec_id", "sense", "sense_rank", "rank")


def per_sense(spark, root):
    """Labels 0 to 2 as the senses of each query, with the ten nearest rows of each."""
    rows = gaussians(spark, root)
    q = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "mu")
    out = None
    for label in range(3):
        near = retrieval.nearest(rows.where(F.col("label") == label), q, 10, "l2", "vec_id").withColumn("sense", F.lit(label)).withColumn("sense_order", F.lit(label))
        out = near if out is None else out.unionByName(near)
    return out


@query(BASE + """, k AS (SELECT query_id, vec_id, label, list_distance(qm, m) AS d FROM q, v WHERE label < 3), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY d, vec_id) AS n FROM k),
f AS (SELECT query_id, vec_id, max((3 - label) / 6.0 * round(1 / (1 + d), 9)) AS fused FROM r WHERE n <= 10 GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, vec_id)::INTEGER AS rank FROM f)
SELECT query_id, vec_id, round(fused, 6) + 0.0 AS fused, rank FROM o WHERE rank <= 12""")
def multi_sense_weighted_max(spark, root):
    per = per_sense(spark, root).withColumn("weight", (3 - F.col("sense")) / 6.0).withColumn("score", F.round(1 / (1 + F.col("distance")), 9))
    out = retrieval.weighted_max(per, None, "vec_id").withColumn("o", F.round("fused", 9)).drop("rank")
    return ranked(out, ["query_id"], [F.desc("o"), "vec_id"], 12).select("query_id", "vec_id", rounded("fused").alias("fused"), "rank")


@query()
def pca_coordinates(spark, root):
    """Three coordinates of each vector; squares, since only the axis counts."""
    out = taxonomy.principal_components(gaussians(spark, root), "vec_id")
    return out.select("vec_id", rounded(F.pow(F.col("components")[0], 2)).alias("x2"), rounded(F.pow(F.col("components")[1], 2)).alias("y2"), rounded(F.pow(F.col("components")[2], 2)).alias("z2"))
