"""Queries of full-text and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.catalog.registry import query, rounded
from veldspar.functions import text as X
from veldspar.functions import vectors as V
from veldspar.operators import encoding, lexical, retrieval, taxonomy
from veldspar.plans import hybrid
from veldspar.session import Workspace, table

TOKENS = "list_filter(regexp_split_to_array(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
BM25 = f"""WITH d AS (SELECT doc_id, {TOKENS} AS ts FROM documents), st AS (SELECT count(*) AS n, avg(coalesce(len(ts), 0)) AS avgdl FROM d),
t AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d), tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM t GROUP BY ALL),
q AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS}) AS term FROM eval_items WHERE item_id % 50 = 0),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), w AS (SELECT term, avgdl, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM df, st),
s AS (SELECT query_id, doc_id, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM q JOIN tf USING (term) JOIN w USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id)::INTEGER AS rank FROM s)"""


def asked(spark, root):
    return table(spark, root, "eval_items").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")


_built: dict[tuple, object] = {}


def once(spark, root, name, make):
    """What is built from a data folder once per session, as a store's index is, and then read by its searches."""
    at = (spark.sparkContext.applicationId, root, name)
    if at not in _built:
        _built[at] = make(Workspace(spark, name))
    return _built[at]


def index(spark, root) -> lexical.Index:
    """The full-text index of the documents."""
    return once(spark, root, "index", lambda w: lexical.Index.write(table(spark, root, "documents").select("doc_id", "text"), w.path("documents"), "doc_id"))


def _bm25(spark, root, top=None):
    out = lexical.bm25(None, asked(spark, root), "doc_id", index=index(spark, root)).withColumn("score", F.round("score", 9)).drop("rank")
    return lexical.ranked(out, ["query_id"], ["score", "doc_id"], top)


@query(BM25 + " SELECT query_id, doc_id, round(score, 6) + 0.0 AS score, rank FROM r WHERE rank <= 10")
def bm25_unindexed(spark, root):
    """The same result from the texts themselves."""
    out = lexical.bm25(table(spark, root, "documents"), asked(spark, root), "doc_id").withColumn("score", F.round("score", 9)).drop("rank")
    return lexical.ranked(out, ["query_id"], ["score", "doc_id"], 10).select("query_id", "doc_id", rounded("score").alias("score"), "rank")


@query(BM25 + " SELECT query_id, doc_id, round(score, 6) + 0.0 AS score, rank FROM r WHERE rank <= 10")
def bm25_topk(spark, root):
    return _bm25(spark, root, 10).select("query_id", "doc_id", rounded("score").alias("score"), "rank")


@query(BM25 + " SELECT query_id, count(*) AS n, round(min(score), 6) + 0.0 AS best, round(sum(score), 3) + 0.0 AS total FROM r GROUP BY query_id")
def bm25_all_scores(spark, root):
    return _bm25(spark, root).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), rounded(F.min("score")).alias("best"), rounded(F.sum("score"), 3).alias("total"))


def _has(*terms):
    return f"WITH d AS (SELECT doc_id, {TOKENS} AS ts FROM documents) SELECT doc_id FROM d WHERE " + " ".join(terms)


@query(_has("list_contains(ts, 'risk') AND list_contains(ts, 'buffer')"))
def fts_and(spark, root):
    return table(spark, root, "documents").where(lexical.match("risk buffer", F.col("text"))).select("doc_id")


@query(_has("list_contains(ts, 'reflex') OR (list_contains(ts, 'vector') AND list_contains(ts, 'store'))"))
def fts_or(spark, root):
    return table(spark, root, "documents").where(lexical.match("reflex OR vector store", F.col("text"))).select("doc_id")


@query(_has("list_contains(ts, 'vector') AND NOT list_contains(ts, 'store')"))
def fts_not(spark, root):
    return table(spark, root, "documents").where(lexical.match("vector NOT store", F.col("text"))).select("doc_id")


@query(_has("contains(' ' || array_to_string(ts, ' ') || ' ', ' risk buffer ')"))
def fts_phrase(spark, root):
    return table(spark, root, "documents").where(lexical.match("risk_buffer", F.col("text"))).select("doc_id")


STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query(f"""WITH r AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z0-9_-]+') AS w FROM eval_items), k AS (SELECT item_id, w, list_filter(w, lambda x: NOT list_contains([{STOP}], lower(x)) AND len(x) > 1) AS k FROM r),
e AS (SELECT item_id, CASE WHEN len(k) > 0 THEN k ELSE list_filter(w, lambda x: len(x) > 1) END AS k FROM k), u AS (SELECT item_id, unnest(k) AS w, unnest(range(len(k))) AS i FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY item_id, lower(w) ORDER BY CASE WHEN w ~ '^[A-Z].*' THEN 0 ELSE 1 END, -len(w), i) AS n FROM u),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN w ~ '^[A-Z].*' THEN 0 ELSE 1 END, -len(w), i) AS p FROM f WHERE n = 1)
SELECT item_id, string_agg(w, ' OR ' ORDER BY p) AS keywords FROM o WHERE p <= 10 GROUP BY item_id""")
def keyword_extract(spark, root):
    return table(spark, root, "eval_items").select("item_id", X.keywords(F.col("text")).alias("keywords"))


TERM_STOP = ", ".join(f"'{w}'" for w in taxonomy.TERM_STOP)
LABELS = f"""WITH t AS (SELECT doc_id, coalesce(lower(trim(domain)), 'none') AS domain, list_filter(list_transform(regexp_extract_all(text, '{taxonomy.TERM}', 1), lambda t: lower(t)), lambda t: NOT list_contains([{TERM_STOP}], t)) AS ts FROM documents WHERE text IS NOT NULL),
k AS (SELECT * FROM t WHERE len(ts) > 0), n AS (SELECT domain, count(*) AS n FROM k GROUP BY domain),
tf AS (SELECT domain, term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, domain, unnest(ts) AS term FROM k) GROUP BY ALL),
s AS (SELECT domain, term, round(tf * ln((n + 1.0) / (df + 1) + 1), 6) AS score FROM tf JOIN n USING (domain)), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, term)::INTEGER AS rank FROM s)"""


def _domains(spark, root):
    return table(spark, root, "documents").withColumn("domain", F.coalesce(F.lower(F.trim("domain")), F.lit("none")))


@query(LABELS + " SELECT * FROM r WHERE rank <= 5")
def tfidf_labels(spark, root):
    return taxonomy.labels(_domains(spark, root), "domain")


@query(LABELS + """ SELECT domain, coalesce(string_agg(term, ' / ' ORDER BY rank) FILTER (rank <= 3), domain) AS label, coalesce(string_agg(term, ', ' ORDER BY rank) FILTER (rank <= 5), domain) AS description
FROM (SELECT DISTINCT domain FROM t) LEFT JOIN r USING (domain) GROUP BY domain""")
def node_labels(spark, root):
    docs = _domains(spark, root).where("text is not null")
    return taxonomy.node_labels(taxonomy.labels(docs, "domain"), docs, "domain")


def encoded(spark, root):
    """Documents and questions by the hashing encoder, with learned variances, encoded once."""

    def make(work):
        docs = table(spark, root, "documents").select("doc_id", "text")
        vec = encoding.hashed(docs, "doc_id").withColumn("sigma_diag", encoding.learned_variance(F.col("mu")))
        q = asked(spark, root)
        return work.cut(docs.join(vec, "doc_id"), "documents"), work.cut(q.join(encoding.hashed(q, "query_id"), "query_id"), "questions")

    return once(spark, root, "encoded", make)


HASHED = """, hb AS (SELECT id, b, count(*) AS c FROM (SELECT id, ('0x' || substr(md5(t), 1, 4))::INTEGER % 64 AS b FROM (SELECT id, unnest(ts) AS t FROM src)) GROUP BY ALL),
hm AS (SELECT id, map_from_entries(list((b, c))) AS m FROM hb GROUP BY id), hv AS (SELECT id, list_transform(range(64), lambda i: coalesce(m[i], 0)::DOUBLE) AS v FROM hm),
hu AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM hv)"""


@query(BM25 + f""", src AS (SELECT 'd' || doc_id AS id, ts FROM d UNION ALL SELECT 'q' || item_id, {TOKENS} FROM eval_items WHERE item_id % 50 = 0){HASHED},
zero AS (SELECT list_transform(range(64), lambda i: 0.0::DOUBLE) AS z),
dv AS (SELECT doc_id, coalesce(v, z) AS v FROM d CROSS JOIN zero LEFT JOIN hu ON id = 'd' || doc_id), qv AS (SELECT item_id AS query_id, coalesce(v, z) AS qv FROM eval_items CROSS JOIN zero LEFT JOIN hu ON id = 'q' || item_id WHERE item_id % 50 = 0),
nd AS (SELECT query_id, doc_id, round(list_distance(qv, v), 9) AS dist FROM qv, dv), nr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, doc_id) AS rank FROM nd),
al AS (SELECT query_id, doc_id, 0 AS arm, rank FROM r WHERE rank <= 15 UNION ALL SELECT query_id, doc_id, 1, rank FROM nr WHERE rank <= 30), fi AS (SELECT query_id, doc_id, min((arm, rank)) AS s FROM al GROUP BY ALL),
pl AS (SELECT query_id, doc_id, s[1]::INTEGER AS arm, row_number() OVER (PARTITION BY query_id ORDER BY s, doc_id)::INTEGER AS place FROM fi) SELECT * FROM pl WHERE place <= 30""")
def hybrid_candidates(spark, root):
    docs, q = encoded(spark, root)
    lex = _bm25(spark, root, 15)
    near = retrieval.nearest(docs, q, 60, "l2", "doc_id").withColumn("distance", F.round("distance", 9)).drop("rank")
    return retrieval.candidates(lex, lexical.ranked(near, ["query_id"], ["distance", "doc_id"], 30), 30, key="doc_id")


@query()
def hybrid_retrieve(spark, root):
    """Keywords and means together, reranked by ELK and cut at the widest gap."""
    docs, q = encoded(spark, root)
    out = hybrid.retrieve(docs, q, key="doc_id", index=index(spark, root))
    return out.select("query_id", "doc_id", "arm", rounded("score").alias("score"), rounded("confidence").alias("confidence"), "uncertainty_label", "rank")


@query()
def hybrid_retrieve_fixed(spark, root):
    """The same by Wasserstein distance and with a fixed number of results, inside an allow-list."""
    docs, q = encoded(spark, root)
    allowed = retrieval_allowed(docs, q)
    out = hybrid.retrieve(docs, q, k=5, metric="w2", adaptive=False, allowed=allowed, key="doc_id", index=index(spark, root))
    return out.select("query_id", "doc_id", rounded("score").alias("score"), "rank")


def retrieval_allowed(docs, q):
    """Documents that share the first letter of a term with the question's keywords: a stand-in for routing."""
    terms = lexical.query_terms(q.select("query_id", X.keywords(F.col("text")).alias("text")))
    hits = docs.select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    return terms.join(hits, "term").select("query_id", "doc_id").distinct()


def _share(found):
    """A deterministic stand-in for a scorer: the share of a question's terms that a passage holds."""
    q, t = X.tokens(F.col("question")), X.tokens(F.col("text"))
    p = F.size(F.array_intersect(q, t)) / F.greatest(F.size(F.array_distinct(q)), F.lit(1))
    out = found.select("query_id", "doc_id", F.coalesce(p, F.lit(0.0)).alias("p"))
    return out.select("query_id", "doc_id", F.col("p").alias("p_rel"), (0.4 + 0.6 * F.col("p")).alias("p_evi"), ((1 - F.col("p")) * 0.6).alias("p_con"), F.lit(3.0).alias("quality"), (F.col("p") >= 0.5).alias("is_relevant"), F.lit(False).alias("is_contradictory"))


@query()
def gated_retrieve(spark, root):
    """Candidates pass a gate before they are reranked."""
    docs, q = encoded(spark, root)
    out = hybrid.retrieve_gated(docs, q, _share, key="doc_id", index=index(spark, root))
    return out.select("query_id", "doc_id", rounded("score").alias("score"), rounded("gating.composite").alias("composite"), F.col("gating.passed").alias("passed"), "rank")


@query()
def diverse_retrieve(spark, root):
    docs, q = encoded(spark, root)
    return hybrid.retrieve_diverse(docs, q, 5, 0.3, key="doc_id", index=index(spark, root))


def _senses(spark, root):
    """Each question by its first and its last words, as two senses."""
    docs, q = encoded(spark, root)
    w = X.words(F.col("text"))
    half = F.greatest(F.floor(F.size(w) / 2).cast("int"), F.lit(1))
    parts = q.select("query_id", F.posexplode(F.array(F.array_join(F.slice(w, F.lit(1), half), " "), F.array_join(F.slice(w, half, F.size(w)), " "))).alias("sense_order", "text"))
    key = F.struct("query_id", "sense_order")
    vec = encoding.hashed(parts.select(key.alias("id"), "text"), "id").select("id.*", "mu")
    return docs, parts.join(vec, ["query_id", "sense_order"]).withColumn("sense", F.concat(F.lit("s"), F.col("sense_order").cast("string"))).withColumn("weight", F.when(F.col("sense_order") == 0, 0.6).otherwise(0.4))


@query()
def sense_retrieve(spark, root):
    """All senses of all questions in one batch, fused by turns, with the senses that found each passage."""
    docs, s = _senses(spark, root)
    shares, _ = hybrid.retrieve_senses(docs, s, key="doc_id", index=index(spark, root))
    return shares.select("query_id", "doc_id", "sense", "rank", "place")


@query("""WITH q AS (SELECT doc_id AS query_id, lower(trim(domain)) AS d, doc_id % 7 AS m FROM documents WHERE domain IS NOT NULL), b AS (SELECT DISTINCT d AS branch FROM q),
p AS (SELECT query_id, branch, round(1.0 / (1 + abs(ascii(branch) - ascii(d)) + m), 6) AS p FROM q CROSS JOIN b WHERE branch <> d), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, branch) AS n FROM p WHERE p >= 0.05)
SELECT query_id, d AS branch, 1 AS place FROM q UNION ALL SELECT query_id, branch, 2 FROM r WHERE n = 1""")
def branch_choice(spark, root):
    """Branches by the probabilities of a stand-in for a decision service."""
    q = table(spark, root, "documents").where("domain is not null").select(F.col("doc_id").alias("query_id"), F.lower(F.trim("domain")).alias("answer"))
    names = q.select(F.col("answer").alias("branch")).distinct()
    listed = F.broadcast(names.agg(F.array_sort(F.collect_set("branch")).alias("bs")))
    p = F.transform("bs", lambda b: F.round(1 / (1 + F.abs(F.ascii(b) - F.ascii("answer")) + F.col("query_id") % 7), 6))
    return taxonomy.branch_choice(q.join(listed).select("query_id", "answer", F.map_from_arrays("bs", p).alias("probabilities")), names)


@query("""WITH w AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '\\b([a-z]{4,})\\b', 1), lambda t: t <> '')[1:4] AS w FROM eval_items) SELECT item_id, array_to_string(w, ' ') AS hints FROM w""")
def context_hints(spark, root):
    return table(spark, root, "eval_items").select("item_id", F.array_join(X.hints(F.col("text")), " ").alias("hints"))


@query("""WITH c AS (SELECT chunk_id, mu FROM (SELECT chunk_id, mu, row_number() OVER (PARTITION BY chunk_id ORDER BY ingest_seq DESC) AS n FROM chunks) WHERE n = 1), u AS (SELECT chunk_id, mu FROM c WHERE len(mu) = 64 AND len(list_filter(mu, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0)
SELECT chunk_id, round(sqrt(list_dot_product(mu, mu)), 6) + 0.0 AS norm FROM u""")
def usable_vectors(spark, root):
    from veldspar.operators.store import latest

    rows = latest(table(spark, root, "chunks"), "chunk_id", "ingest_seq", "mu").where(V.finite("mu", 64))
    return rows.select("chunk_id", rounded(V.norm("mu")).alias("norm"))
