"""The retrieval pipeline: route, gather candidates, rerank, cut, and put together a context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.functions import geometry as G
from veldspar.functions import text as X
from veldspar.operators import evaluation, lexical, retrieval, taxonomy


def rerank(pairs: DataFrame, metric: str = "elk", key: str = "chunk_id", low_rank: bool = False) -> DataFrame:
    """Adds score, confidence, label and sort key to ``(query_id, key, q_mu, q_sigma, mu, sigma_diag[, q_l, sigma_l])``.

    Diagonal scores are column expressions; with ``low_rank``, ELK with factors is computed in Arrow batches.  Only the metric
    asked for is in the plan.
    """
    if metric == "elk":
        zero = F.transform("mu", lambda _: F.lit(0.0))
        score = G.elk_low_rank("q_mu", "q_sigma", "q_l", "mu", "sigma_diag", "sigma_l") if low_rank else G.elk_diagonal("q_mu", F.coalesce("q_sigma", zero), "mu", "sigma_diag")
    else:
        spread = F.coalesce("q_sigma", F.transform("mu", lambda _: F.lit(0.0)))
        if metric in ("w2", "wasserstein2"):
            score = G.wasserstein_diagonal("q_mu", spread, "mu", "sigma_diag")
        elif metric in ("fr", "fisher_rao"):
            score = G.fisher_rao_diagonal("q_mu", spread, "mu", "sigma_diag")
        else:
            raise ValueError(f"unknown metric {metric}")
    out = pairs.withColumn("score", score).withColumn("trace", G.trace("sigma_diag", "sigma_l" if "sigma_l" in pairs.columns else None))
    out = out.withColumn("confidence", G.confidence(F.col("trace"))).withColumn("uncertainty_label", G.uncertainty(F.col("confidence")))
    return out.withColumn("sort_key", retrieval.sort_key(metric, F.col("score"), F.col("confidence")))


def _candidates(chunks: DataFrame, queries: DataFrame, pool: int, allowed: DataFrame | None, lexical_top: int, key: str, index: lexical.Index | None) -> DataFrame:
    words = queries.select("query_id", X.keywords(F.col("text")).alias("text"))
    lex = lexical.bm25(None if index else chunks.select(key, "text"), words, key, lexical_top, index)
    if allowed is None:
        return retrieval.candidates(lex, retrieval.nearest(chunks, queries, pool, "l2", key), pool, None, key)
    lex = lex.join(allowed, ["query_id", key], "left_semi")
    return retrieval.candidates(lex, retrieval.nearest_allowed(chunks, queries, allowed, pool, "l2", key), pool, allowed, key)


def _scored(found: DataFrame, chunks: DataFrame, queries: DataFrame, metric: str, key: str) -> DataFrame:
    """Candidates reranked; few beside the chunks, they are broadcast to these where their number shows it, so the vectors are not shuffled."""
    q = queries.select("query_id", F.col("mu").alias("q_mu"), (F.col("sigma_diag") if "sigma_diag" in queries.columns else F.lit(None).cast("array<double>")).alias("q_sigma"))
    pairs = found.join(chunks.select(key, "mu", "sigma_diag"), key).join(q, "query_id")
    return rerank(pairs, metric, key)


def _cut(scored: DataFrame, adaptive: bool, buffer: int, k: int, key: str) -> DataFrame:
    if adaptive:
        return retrieval.adaptive_cut(scored, key, "sort_key", buffer)
    return lexical.ranked(scored, ["query_id"], ["sort_key", key], k)


def routed(queries: DataFrame, leaves: DataFrame, members: DataFrame, key: str = "chunk_id", **options) -> DataFrame:
    """``(query_id, key)``: what a taxonomy's routing leaves of the items for each query."""
    at = taxonomy.route(queries, leaves, members, key=key, **options)
    return at.select("query_id", "leaf").join(members.select("leaf", key), "leaf").select("query_id", key).distinct()


RESULT = ("score", "confidence", "uncertainty_label", "sort_key")


def retrieve(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = 5,
    metric: str = "elk",
    adaptive: bool = True,
    buffer: int = 2,
    allowed: DataFrame | None = None,
    lexical_top: int = 15,
    key: str = "chunk_id",
    index: lexical.Index | None = None,
    tree: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """``(query_id, key, arm, score, confidence, uncertainty_label, sort_key, rank)`` for a batch of queries.

    ``chunks(key, text, mu, sigma_diag)``, ``queries(query_id, text, mu[, sigma_diag])``, ``allowed(query_id, key)``.
    Without ``allowed``, a ``tree`` of ``(leaves, members)`` routes the queries.  Lexical hits come from the keywords of the text, by a stored ``index`` where there is one, dense ones from the means; allowed ids filter the lexical hits after
    their cut and the dense rows before it.  With ``adaptive`` the widest gap decides how many rows stay, not k.
    """
    if allowed is None and tree is not None:
        allowed = routed(queries, *tree, key=key)
    found = _candidates(chunks, queries, max(5 * k, 30 if adaptive else 10), allowed, lexical_top, key, index)
    return _cut(_scored(found, chunks, queries, metric, key).select("query_id", key, "arm", *RESULT), adaptive, buffer, k, key)


def retrieve_by_branch(chunks: DataFrame, queries: DataFrame, answers: DataFrame, leaves: DataFrame, members: DataFrame, most: int = 2, key: str = "chunk_id", **options) -> DataFrame:
    """``retrieve`` among the items of the branches that a decision service chose: ``answers(query_id, answer, probabilities)``, ``leaves(leaf, parent, centroid)``."""
    chosen = taxonomy.branch_choice(answers, leaves.select(F.col("parent").alias("branch")), most)
    return retrieve(chunks, queries, allowed=taxonomy.allowed_by_branch(chosen, leaves, members, key), key=key, **options)


def retrieve_gated(
    chunks: DataFrame,
    queries: DataFrame,
    gate,
    k: int = 5,
    metric: str = "elk",
    adaptive: bool = True,
    buffer: int = 2,
    allowed: DataFrame | None = None,
    pool: int = 30,
    key: str = "chunk_id",
    index: lexical.Index | None = None,
    tree: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """``retrieve`` with the candidates first cut to those that ``gate`` lets pass, at most twice k or 8; adds ``gating``, the scores of the gate.

    ``gate`` takes the candidates ``(query_id, key, question, text)`` and gives ``(query_id, key, p_rel, p_evi, p_con, quality, is_relevant, is_contradictory)``.
    """
    if allowed is None and tree is not None:
        allowed = routed(queries, *tree, key=key)
    found = _candidates(chunks, queries, pool, allowed, 15, key, index)
    asked = found.join(chunks.select(key, "text"), key).join(queries.select("query_id", F.col("text").alias("question")), "query_id")
    passed = retrieval.gate(gate(asked.select("query_id", key, "question", "text")), max(2 * k, 8), key=key)
    fields = [c for c in passed.columns if c not in ("query_id", key, "rank")]
    kept = found.join(passed.select("query_id", key), ["query_id", key], "left_semi")
    out = _cut(_scored(kept, chunks, queries, metric, key).select("query_id", key, "arm", *RESULT), adaptive, buffer, k, key).where(F.col("rank") <= k)
    return out.join(passed.select("query_id", key, F.struct(*fields).alias("gating")), ["query_id", key], "left")


def retrieve_diverse(chunks: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.3, adaptive: bool = True, key: str = "chunk_id", **options) -> DataFrame:
    """``(query_id, key, rank)``: the results of ``retrieve`` that are far enough from better ones, numbered anew; all of them with ``adaptive``, else at most k."""
    found = retrieve(chunks, queries, k, adaptive=adaptive, key=key, **options)
    return retrieval.diverse(found.select("query_id", key, "rank").join(chunks.select(key, "mu", "sigma_diag"), key), threshold, None if adaptive else k, key)


def retrieve_senses(chunks: DataFrame, senses: DataFrame, k: int = 5, metric: str = "elk", fusion: str = "interleave", adaptive: bool = True, key: str = "chunk_id", **options) -> tuple[DataFrame, DataFrame]:
    """(each sense's share, fused): all senses of all queries are retrieved as one batch, then fused per query, ``interleave`` or ``weighted_sum``.

    ``senses(query_id, sense, sense_order, weight, text, mu[, sigma_diag])``.  The fused list is cut to k unless ``adaptive``; see ``retrieval.provenance`` for the shares.
    """
    if fusion not in ("interleave", "weighted_sum"):
        raise ValueError(f"unknown fusion {fusion}")
    pair = senses.withColumn("_id", F.xxhash64("query_id", "sense"))
    found = retrieve(chunks, pair.drop("query_id").withColumnRenamed("_id", "query_id"), k, metric, adaptive, key=key, **options)
    named = found.withColumnRenamed("query_id", "_id").join(pair.select("_id", "query_id", "sense", "sense_order", "weight"), "_id")
    if fusion == "interleave":
        fused = retrieval.interleave(named, None if adaptive else k, key)
    else:
        score = F.col("score") if metric == "elk" else 1 / F.greatest("score", F.lit(1e-9))
        fused = retrieval.weighted_max(named.withColumn("score", score), None if adaptive else k, key)
    weights = senses.select("query_id", "sense", "weight", "sense_order")
    return retrieval.provenance(fused, named.select("query_id", "sense", key, "rank"), weights, key), fused


def evaluate(runs: DataFrame, qrels: DataFrame, k: int, buckets: DataFrame | None = None, key: str = "chunk_id") -> DataFrame:
    """Mean recall and nDCG of each method, and of each bucket of queries where ``buckets(query_id, bucket)`` are given: ``runs(method, query_id, key, rank)``."""
    one = runs.withColumn("_q", F.struct("method", "query_id"))
    rel = qrels.select("query_id", key).join(F.broadcast(runs.select("method").distinct())).select(F.struct("method", "query_id").alias("query_id"), key)
    each = evaluation.retrieval(one.select(F.col("_q").alias("query_id"), key, "rank"), rel, k, key).select(F.col("query_id.method").alias("method"), F.col("query_id.query_id").alias("query_id"), "recall", "ndcg")
    by = ["method"]
    if buckets is not None:
        each, by = each.join(buckets.select("query_id", "bucket"), "query_id"), ["method", "bucket"]
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"))
