"""Candidates, reranking, cuts and fusion, for batches of queries.

Queries are a table with ``query_id``; all results have it, so one job answers a batch.  The query side is broadcast where a
count shows it small, and otherwise joined in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.functions import vectors as V
from veldspar.operators.lexical import ranked

MOST_QUERIES = 5_000


def nearest(chunks: DataFrame, queries: DataFrame, k: int, metric: str = "l2", key: str = "chunk_id", vector: str = "mu") -> DataFrame:
    """``(query_id, key, distance, rank)``: the ``k`` nearest rows of each query, exactly.

    Blocks of at most 5,000 queries are compared with every batch of rows as one matrix product, and only the k best of a task leave
    it.  The metric is ``l2`` or ``cosine`` (1 - cosine, 1 for a zero vector).  Rows and queries with null vectors, or of another length than the
    first query, take no part.  Ties go by the key.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric}")
    qs = queries.select("query_id", F.col(vector).alias("v")).where(F.col("v").isNotNull())
    n = qs.count()
    blocks = max(1, -(-n // MOST_QUERIES))
    kinds = (queries.schema["query_id"].dataType, chunks.schema[key].dataType)
    schema = T.StructType([T.StructField("query_id", kinds[0]), T.StructField(key, kinds[1]), T.StructField("distance", T.DoubleType())])
    out = None
    for b in range(blocks):
        part = qs.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        found = chunks.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(_nearest(part.column("query_id").to_pylist(), part.column("v").to_pylist(), k, metric, key, schema), schema)
        out = found if out is None else out.unionByName(found)
    return ranked(out, ["query_id"], ["distance", key], k)


def nearest_allowed(chunks: DataFrame, queries: DataFrame, allowed: DataFrame, k: int, metric: str = "l2", key: str = "chunk_id", vector: str = "mu") -> DataFrame:
    """``nearest`` among the rows that ``allowed(query_id, key)`` names for each query: every allowed pair is scored before the cut."""
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric}")
    first = queries.where(F.col(vector).isNotNull()).select(F.size(vector).alias("d")).first()
    d = first["d"] if first else 0
    fits = lambda df: df.where(F.size(vector) == d)
    pairs = allowed.select("query_id", key).distinct().join(fits(queries).select("query_id", F.col(vector).alias("_q")), "query_id").join(fits(chunks).select(key, F.col(vector).alias("_x")), key)
    far = 1 - V.cosine("_x", "_q") if metric == "cosine" else F.sqrt(V.squared_distance("_x", "_q"))
    far = F.coalesce(far, F.lit(1.0)) if metric == "cosine" else far
    return ranked(pairs.select("query_id", key, far.cast("double").alias("distance")), ["query_id"], ["distance", key], k)


def _nearest(ids: list, vectors: list, k: int, metric: str, key: str, schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        d = len(vectors[0]) if vectors else 0
        use = [i for i, v in enumerate(vectors) if len(v) == d]
        if not use:
            return
        q = np.array([vectors[i] for i in use], np.float64).reshape(len(use), d)
        if metric == "cosine":
            q = _unit(q)
        size = (q * q).sum(axis=1)
        best = (np.empty(0, np.int64), np.empty(0), np.empty(0, object))  # query, distance, key
        for b in batches:
            at = np.flatnonzero(np.asarray(b.column(1).value_lengths()) == d)
            if not len(at):
                continue
            x = b.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            keys = b.column(0).take(pa.array(at)).to_numpy(zero_copy_only=False)
            if metric == "cosine":
                x = _unit(x)
            rough = -2 * (q @ x.T)  # the squared distance without what all rows of a query share
            rough += (x * x).sum(axis=1)[None]
            edge = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(q), np.inf)
            i, j = np.nonzero(rough <= (edge + 1e-9 * (1 + np.abs(edge) + size))[:, None])
            far = 1 - (x[j] * q[i]).sum(axis=1) if metric == "cosine" else np.sqrt(((x[j] - q[i]) ** 2).sum(axis=1))
            i, far, mine = (np.concatenate(z) for z in zip(best, (i, far, keys[j])))
            order = np.lexsort((mine, far, i))
            i, far, mine = i[order], far[order], mine[order]
            first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            place = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
            best = i[place < k], far[place < k], mine[place < k]
        i, far, mine = best
        if len(i):
            names = pa.array([ids[n] for n in use], arrow.field(0).type)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), pa.array(mine, arrow.field(1).type), pa.array(far)], schema=arrow)

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def candidates(lexical: DataFrame, dense: DataFrame, pool: int = 30, allowed: DataFrame | None = None, key: str = "chunk_id") -> DataFrame:
    """``(query_id, key, place)``: lexical hits first, then dense ones, each once, filled up from the allowed ids, at most ``pool``.

    Both inputs have ``rank``; ``allowed`` is ``(query_id, key)``.  The fill takes allowed ids in order until the pool, or all that is
    allowed, is reached.
    """
    parts = lexical.select("query_id", key, F.lit(0).alias("arm"), "rank").unionByName(dense.select("query_id", key, F.lit(1).alias("arm"), "rank"))
    if allowed is not None:
        fill = ranked(allowed.select("query_id", key).distinct(), ["query_id"], [key], pool)
        parts = parts.join(allowed, ["query_id", key], "left_semi").unionByName(fill.select("query_id", key, F.lit(2).alias("arm"), "rank"))
    first = parts.groupBy("query_id", key).agg(F.min(F.struct("arm", "rank")).alias("s"))
    return ranked(first.select("query_id", key, "s.arm", "s.rank").withColumnRenamed("rank", "r"), ["query_id"], ["arm", "r", key], pool).select("query_id", key, "arm", F.col("rank").alias("place"))


def sort_key(metric: str, score: Column, confidence: Column) -> Column:
    """What candidates are sorted by, ascending: the negative ELK score times the confidence, or a distance over the confidence."""
    if metric == "elk":
        return -score * confidence
    if metric in ("w2", "wasserstein2", "fr", "fisher_rao"):
        return score / F.greatest(confidence, F.lit(1e-9))
    raise ValueError(f"unknown metric {metric}")


def adaptive_cut(scored: DataFrame, key: str = "chunk_id", order: str = "sort_key", buffer: int = 2, by: str = "query_id") -> DataFrame:
    """Rows up to the widest gap between consecutive keys, the first of equal ones, and ``buffer`` more; with ``rank``.

    A query of one row keeps it.  The number kept doesn't depend on any k.
    """
    w = Window.partitionBy(by).orderBy(order, key)
    gaps = scored.withColumn("rank", F.row_number().over(w)).withColumn("gap", F.lead(order).over(w) - F.col(order))
    widest = F.max(F.struct(F.col("gap"), (-F.col("rank")).alias("r"))).over(Window.partitionBy(by))
    return gaps.withColumn("w", widest).where(F.col("w.gap").isNull() | (F.col("rank") <= -F.col("w.r") + buffer)).drop("gap", "w")


def gate(scores: DataFrame, most: int = 8, least_composite: float = 0.15, most_contradiction: float = 0.5, key: str = "chunk_id") -> DataFrame:
    """Passages that a scorer lets pass, best composite first, at most ``most``; if none of a query passes, all count.

    ``scores`` has ``p_rel, p_evi, p_con, quality, is_relevant, is_contradictory``; a null quality counts as 2 and null flags as false.
    """
    q = F.greatest(F.least(F.coalesce("quality", F.lit(2.0)) / 3, F.lit(1.0)), F.lit(0.1))
    out = scores.withColumn("composite", F.col("p_rel") * F.col("p_evi") * (1 - F.col("p_con")) * q)
    passed = (
        (~F.coalesce("is_contradictory", F.lit(False)) | (F.col("p_con") < most_contradiction))
        & (F.col("p_con") <= most_contradiction)
        & (F.coalesce("is_relevant", F.lit(False)) | (F.col("p_rel") >= 0.4))
        & (F.col("composite") >= least_composite)
    )
    out = out.withColumn("passed", passed)
    any_ = F.max(F.col("passed").cast("int")).over(Window.partitionBy("query_id"))
    out = out.withColumn("any", any_).where((F.col("any") == 0) | F.col("passed")).drop("any")
    return ranked(out, ["query_id"], [F.desc("composite"), key], most)


def provenance(fused: DataFrame, per_sense: DataFrame, weights: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``(query_id, sense, key, rank, place)``: every fused passage under each sense that found it, passages in fused order, the senses of one by its rank there, their weight and order.

    ``weights(query_id, sense, weight, sense_order)``.
    """
    both = fused.select("query_id", key, "rank").join(per_sense.select("query_id", "sense", key, F.col("rank").alias("sense_rank")), ["query_id", key]).join(weights, ["query_id", "sense"])
    return ranked(both.withColumnRenamed("rank", "fused_rank"), ["query_id", key], ["sense_rank", F.desc("weight"), "sense_order"]).select("query_id", "sense", key, F.col("fused_rank").alias("rank"), F.col("rank").alias("place"))


def interleave(per_sense: DataFrame, top: int | None = None, key: str = "chunk_id") -> DataFrame:
    """Round robin over the senses of a query, each passage once: ``per_sense(query_id, sense, sense_order, key, rank)``."""
    first = per_sense.groupBy("query_id", key).agg(F.min(F.struct("rank", "sense_order", "sense")).alias("s"))
    flat = first.select("query_id", key, "s.sense", F.col("s.rank").alias("sense_rank"), F.col("s.sense_order").alias("sense_order"))
    return ranked(flat, ["query_id"], ["sense_rank", "sense_order", key], top)


def weighted_max(per_sense: DataFrame, top: int | None = None, key: str = "chunk_id") -> DataFrame:
    """The greatest weight times score of a passage over the senses of a query."""
    best = per_sense.groupBy("query_id", key).agg(F.max(F.col("weight") * F.col("score")).alias("fused"))
    return ranked(best, ["query_id"], [F.desc("fused"), key], top)


def diverse(ranked_rows: DataFrame, threshold: float = 0.3, top: int | None = 5, key: str = "chunk_id") -> DataFrame:
    """Greedily, in order of rank, the rows farther than ``threshold`` (diagonal Wasserstein) from all kept, at most ``top`` unless it is None.

    ``ranked_rows(query_id, key, rank, mu, sigma_diag)`` holds the candidates of each query, a pool of bounded size.
    """
    kinds = {f.name: f.dataType for f in ranked_rows.schema}
    schema = T.StructType([T.StructField("query_id", kinds["query_id"]), T.StructField(key, kinds[key]), T.StructField("rank", T.IntegerType())])

    def pick(pdf):
        import pandas as pd

        kept: list[int] = []
        pdf = pdf.sort_values(["rank", key]).reset_index(drop=True)
        mu, var = np.stack(pdf["mu"].map(np.asarray)), np.stack(pdf["sigma_diag"].map(np.asarray))
        for i in range(len(pdf)):
            if len(kept) == top:
                break
            cross = np.sqrt(np.maximum(np.maximum(var[i], 1e-9) * var[kept], 1e-9)).sum(axis=1) if kept else np.empty(0)
            bures = np.maximum(var[i].sum() + var[kept].sum(axis=1) - 2 * cross, 0)
            if (np.sqrt(((mu[i] - mu[kept]) ** 2).sum(axis=1) + bures) > threshold).all():
                kept.append(i)
        out = pdf.loc[kept, ["query_id", key]].copy()
        out["rank"] = pd.Series(range(1, len(kept) + 1), index=out.index, dtype="int32")
        return out

    return ranked_rows.select("query_id", key, "rank", "mu", "sigma_diag").groupBy("query_id").applyInPandas(pick, schema)


def coverage(rows: DataFrame, by: str, key: str = "chunk_id") -> DataFrame:
    """Mean diagonal Wasserstein distance of the pairs of each result list, 0 for fewer than two rows; lists are of bounded size."""
    from veldspar.functions.geometry import wasserstein_diagonal

    x = rows.select(by, F.col(key).alias("ka"), F.col("mu").alias("ma"), F.col("sigma_diag").alias("sa"))
    y = rows.select(by, F.col(key).alias("kb"), F.col("mu").alias("mb"), F.col("sigma_diag").alias("sb"))
    pairs = x.join(y, by).where("ka < kb")
    mean = pairs.groupBy(by).agg(F.avg(wasserstein_diagonal("ma", "sa", "mb", "sb")).alias("coverage"))
    return rows.select(by).distinct().join(mean, by, "left").fillna(0.0, "coverage")
