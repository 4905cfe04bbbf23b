"""Queries over senses, gates, contexts and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veldspar.catalog.gaussians import BASE, gaussians
from veldspar.catalog.registry import query, rounded
from veldspar.functions import geometry as G
from veldspar.operators import retrieval, senses, store
from veldspar.session import table

# eight neighbouring vectors are the senses of a packet; their labels modulo 3 are the terms
PACKET = BASE + """, p AS (SELECT vec_id // 8 AS packet_id, vec_id AS sense_id, 't' || (label % 3) AS term, m, s, round(1 / (1 + list_sum(s) / (1 + vec_id % 8)), 9) AS confidence FROM v),
w AS (SELECT *, confidence / sum(confidence) OVER (PARTITION BY packet_id) AS weight FROM p)"""


def packets(spark, root):
    rows = gaussians(spark, root)
    c = F.round(1 / (1 + G.trace("sigma_diag") / (1 + F.col("vec_id") % 8)), 9)
    rows = rows.select(F.floor(F.col("vec_id") / 8).alias("packet_id"), F.col("vec_id").alias("sense_id"), F.concat(F.lit("t"), (F.col("label") % 3).cast("string")).alias("term"), "mu", "sigma_diag", c.alias("confidence"))
    return senses.weights(rows)


@query(PACKET + " SELECT packet_id, round(-sum(weight * log2(weight)), 6) + 0.0 AS entropy FROM w GROUP BY packet_id")
def field_entropy(spark, root):
    return senses.entropy(packets(spark, root)).select("packet_id", rounded("entropy").alias("entropy"))


COMPAT = """exp(-(list_sum(list_transform(list_zip(a.m, b.m, a.s, b.s), lambda z: (z[1] - z[2]) * (z[1] - z[2]) / ((z[3] + z[4]) / 2))) / 8
 + 0.5 * (ln(greatest(list_product(list_transform(list_zip(a.s, b.s), lambda z: (z[1] + z[2]) / 2)), 1e-9)) - 0.5 * (ln(greatest(list_product(a.s), 1e-9)) + ln(greatest(list_product(b.s), 1e-9)))))) * CASE WHEN a.term = b.term THEN 0.1 ELSE 1 END"""


@query(PACKET + f""", u AS (SELECT a.packet_id, a.sense_id, avg(b.weight * {COMPAT}) AS pull FROM w a JOIN w b ON a.packet_id = b.packet_id AND a.sense_id <> b.sense_id GROUP BY ALL),
x AS (SELECT w.packet_id, w.sense_id, 0.7 * weight + 0.3 * coalesce(pull, 0) AS weight FROM w LEFT JOIN u ON u.packet_id = w.packet_id AND u.sense_id = w.sense_id)
SELECT packet_id, sense_id, round(weight / sum(weight) OVER (PARTITION BY packet_id), 6) + 0.0 AS weight FROM x""")
def kernel_smooth(spark, root):
    return senses.smooth(packets(spark, root)).select("packet_id", "sense_id", rounded("weight").alias("weight"))


@query(PACKET + """, h AS (SELECT packet_id, -sum(weight * log2(weight)) AS entropy FROM w GROUP BY packet_id), r AS (SELECT packet_id, sense_id, round(entropy, 6) AS entropy, row_number() OVER (PARTITION BY packet_id ORDER BY weight DESC, sense_id)::INTEGER AS rank FROM w JOIN h USING (packet_id))
SELECT packet_id, sense_id, CASE WHEN entropy <= 1.5 THEN 'single' WHEN entropy <= 2.5 THEN 'dual' ELSE 'fallback' END AS route, rank FROM r WHERE rank <= CASE WHEN entropy <= 1.5 THEN 1 WHEN entropy <= 2.5 THEN 2 ELSE 3 END""")
def sense_router(spark, root):
    return senses.routed(packets(spark, root)).select("packet_id", "sense_id", "route", "rank")


@query(PACKET + ", h AS (SELECT *, sum(CASE WHEN weight > 0.13 THEN 1 ELSE 0 END) OVER (PARTITION BY packet_id, term) AS heavy FROM w) SELECT packet_id, sense_id, term FROM h WHERE heavy >= 2 AND weight > 0.13")
def conflict_flags(spark, root):
    return senses.conflicts(packets(spark, root), threshold=0.13).select("packet_id", "sense_id", "term")


@query(PACKET + """, g AS (SELECT packet_id, sense_id, term, least(confidence + 0.2 / (1 + list_sum(s)), 0.99) AS c FROM w) SELECT packet_id, sense_id, round(least(c / sum(c) OVER (PARTITION BY packet_id, term), 0.99), 6) + 0.0 AS confidence FROM g""")
def ground_senses(spark, root):
    rows = packets(spark, root).withColumn("w2", G.trace("sigma_diag"))
    return senses.ground(rows).select("packet_id", "sense_id", rounded("confidence").alias("confidence"))


# retrieved passages of a conversation with their confidence as a deterministic stand-in for a scorer
HITS = """WITH o AS (SELECT DISTINCT turn_id, retrieved FROM chat_history WHERE retrieved IS NOT NULL), r AS (SELECT turn_id, unnest(retrieved) AS r, unnest(range(len(retrieved)))::INTEGER AS place FROM o),
h AS (SELECT turn_id AS query_id, r.id AS chunk_id, r.text AS text, r.confidence AS c, place FROM r WHERE r.id IS NOT NULL AND r.confidence IS NOT NULL),
f AS (SELECT query_id, chunk_id, min(place) AS place, arg_min(text, place) AS text, arg_min(c, place) AS c FROM h GROUP BY ALL)"""


def hits(spark, root):
    rows = table(spark, root, "chat_history").select("turn_id", F.posexplode("retrieved").alias("place", "r"))
    rows = rows.select(F.col("turn_id").alias("query_id"), F.col("r.id").alias("chunk_id"), F.col("r.text").alias("text"), F.col("r.confidence").alias("c"), "place")
    rows = rows.where("chunk_id is not null and c is not null")
    return rows.groupBy("query_id", "chunk_id").agg(F.min("place").alias("place"), F.min_by("text", "place").alias("text"), F.min_by("c", "place").alias("c"))


GATE = HITS + """, s AS (SELECT query_id, chunk_id, c * (0.4 + 0.6 * c) * (1 - (1 - c) * 0.6) * greatest(least((1 + place % 3) / 3.0, 1), 0.1) AS composite, c, (1 - c) * 0.6 AS p_con, c >= 0.5 AS rel FROM f),
p AS (SELECT *, p_con <= 0.5 AND (rel OR c >= 0.4) AND composite >= 0.15 AS passed FROM s), a AS (SELECT *, bool_or(passed) OVER (PARTITION BY query_id) AS any_passed FROM p),
z AS (SELECT query_id, chunk_id, composite, passed, row_number() OVER (PARTITION BY query_id ORDER BY round(composite, 9) DESC, chunk_id)::INTEGER AS rank FROM a WHERE passed OR NOT any_passed)"""


def scores(spark, root):
    h = hits(spark, root)
    return h.select("query_id", "chunk_id", F.col("c").alias("p_rel"), (0.4 + 0.6 * F.col("c")).alias("p_evi"), ((1 - F.col("c")) * 0.6).alias("p_con"), (1 + F.col("place") % 3).cast("double").alias("quality"), (F.col("c") >= 0.5).alias("is_relevant"), F.lit(False).alias("is_contradictory"))


@query(GATE + " SELECT query_id, chunk_id, round(composite, 6) + 0.0 AS composite, passed, rank FROM z WHERE rank <= 8")
def gate_composite(spark, root):
    g = retrieval.gate(scores(spark, root), most=1000)
    g = g.withColumn("o", F.round("composite", 9)).drop("rank")
    from veldspar.operators.lexical import ranked

    return ranked(g, ["query_id"], [F.desc("o"), "chunk_id"], 8).select("query_id", "chunk_id", rounded("composite").alias("composite"), "passed", "rank")


ASKED = HITS + ", t AS (SELECT turn_id AS query_id, min(user_msg) AS q FROM chat_history GROUP BY turn_id)"
CONTEXT = """'[CONTEXT START]' || chr(10) || chr(10) || '[QUERY] ' || coalesce(q, '') || chr(10) || chr(10) || coalesce(body, '') || '[CONTEXT END]'"""
LISTED = ASKED + """, l AS (SELECT query_id, text, place, c, row_number() OVER (PARTITION BY query_id ORDER BY place, chunk_id) AS n FROM f),
b AS (SELECT query_id, string_agg('[Chunk ' || n || '] — Confidence: ' || CASE WHEN c >= 0.5 THEN 'HIGH' WHEN c >= 0.2 THEN 'MEDIUM' ELSE 'LOW' END || chr(10) || coalesce(text, '') || chr(10) || chr(10), '' ORDER BY n) AS body,
 string_agg('- (' || CASE WHEN c >= 0.5 THEN 'low' WHEN c >= 0.2 THEN 'medium' ELSE 'high' END || ') ' || coalesce(text, ''), chr(10) ORDER BY n) AS listed FROM l GROUP BY query_id)"""


def _listed(spark, root):
    h = hits(spark, root).withColumn("uncertainty_label", G.uncertainty(F.col("c"))).withColumnRenamed("place", "rank")
    return h, table(spark, root, "chat_history").groupBy(F.col("turn_id").alias("query_id")).agg(F.min("user_msg").alias("text"))


@query(LISTED + f" SELECT query_id, {CONTEXT} AS context FROM t LEFT JOIN b USING (query_id)")
def context_build(spark, root):
    return store.context(*_listed(spark, root))


@query(LISTED + f""" SELECT query_id, md5({CONTEXT}) AS context, 'Query: ' || coalesce(q, '') || chr(10) || 'Evidence summary:' || coalesce(chr(10) || listed, '') AS answer FROM t LEFT JOIN b USING (query_id)""")
def extractive_answers(spark, root):
    return store.extractive_answer(*_listed(spark, root)).select("query_id", F.md5("context").alias("context"), "answer")


@query("""WITH t AS (SELECT DISTINCT turn_id, session_id, ts FROM chat_history WHERE session_id IS NOT NULL) SELECT session_id, count(DISTINCT turn_id) AS turns, epoch_us(max(ts)) AS last_us FROM t GROUP BY session_id""")
def session_list(spark, root):
    return table(spark, root, "chat_history").where("session_id is not null").groupBy("session_id").agg(F.countDistinct("turn_id").alias("turns"), F.unix_micros(F.max("ts")).alias("last_us"))


SAID = """WITH t AS (SELECT turn_id, min(user_msg) AS q, min(session_id) AS s FROM chat_history WHERE user_msg IS NOT NULL GROUP BY turn_id),
x AS (SELECT turn_id, lower(split_part(q, ' ', 1)) AS term, s AS domain, lower(regexp_replace(trim(q), '\\s+', ' ', 'g')) AS q, round(0.2 + (turn_id % 80) / 100.0, 6) AS c FROM t)"""


@query(SAID + """, k AS (SELECT * FROM x WHERE turn_id % 3 = 0) SELECT turn_id, round(CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.term = x.term AND (k.turn_id = x.turn_id + 3 AND x.turn_id % 3 = 0 OR k.domain = x.domain AND k.q = x.q)) THEN least(c + 0.15, greatest(0.95, c)) ELSE c END, 6) + 0.0 AS confidence FROM x""")
def session_boost(spark, root):
    """Opening words as senses; those that the cache, every third turn under the id of the turn three before, holds already are raised."""
    rows = table(spark, root, "chat_history").where("user_msg is not null").groupBy("turn_id").agg(F.min("user_msg").alias("retrieval_query"), F.min("session_id").alias("domain"))
    rows = rows.select("turn_id", F.col("turn_id").alias("sense_id"), F.lower(F.split_part("retrieval_query", F.lit(" "), F.lit(1))).alias("term"), "domain", F.lit(1).alias("version"), "retrieval_query", F.round(0.2 + (F.col("turn_id") % 80) / 100, 6).alias("confidence"))
    cached = rows.where("turn_id % 3 = 0").withColumn("sense_id", F.col("turn_id") - 3)
    return senses.remember(rows, cached).select("turn_id", rounded("confidence").alias("confidence"))


@query("""WITH s AS (SELECT session_id, max(ts) AS m FROM chat_history WHERE session_id IS NOT NULL GROUP BY session_id), b AS (SELECT *, min(session_id) OVER (PARTITION BY right(session_id, 1)) AS base FROM s)
SELECT b.session_id, base AS base_id, epoch_us(s.m) AS base_us FROM b JOIN s ON s.session_id = base WHERE b.session_id <> base""")
def session_branches(spark, root):
    """Sessions as branches of the first one whose name ends alike."""
    s = table(spark, root, "chat_history").where("session_id is not null").groupBy("session_id").agg(F.max("ts").alias("mtime"))
    base = F.min("session_id").over(Window.partitionBy(F.right("session_id", F.lit(1))))
    s = s.withColumn("base", base).select("session_id", "mtime", F.when(F.col("base") != F.col("session_id"), F.col("base")).alias("base_id"))
    return store.branches(s).select("session_id", "base_id", F.unix_micros("base_mtime").alias("base_us"))
