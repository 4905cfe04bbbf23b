"""Texts and vectors as Gaussians: a hashing encoder, and the estimators of the covariance."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.functions import text as X
from veldspar.functions.answers import entity_words
from veldspar.functions import vectors as V
from veldspar.functions.geometry import diagonal_plus_low_rank

FLOOR = 1e-6
RANK = 8


def _hashing(d: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(tokens: pd.Series) -> pd.Series:
        seen: dict[str, int] = {}
        out = []
        for ts in tokens:
            v = np.zeros(d)
            for t in ts if ts is not None else ():
                if t not in seen:
                    seen[t] = int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % d
                v[seen[t]] += 1
            n = np.sqrt(v @ v)
            out.append(v / n if n else v)
        return pd.Series(out)

    return embed


def hashed(df: DataFrame, key: str, d: int = 64) -> DataFrame:
    """``(key, mu)``: counts of tokens by the first four digits of their MD5 modulo ``d``, as a unit vector.

    A deterministic stand-in for an embedding model.  Null texts and texts without tokens get the zero vector.
    """
    return df.select(key, _hashing(d)(X.tokens(F.col("text"))).alias("mu"))


def learned_variance(mu: Column, scale: Column | None = None) -> Column:
    """|h| times the fitted scale, ones without one, over its norm, floored: the covariance diagonal of the learned estimator without a network."""
    raw = F.transform(mu, F.abs) if scale is None else F.zip_with(mu, scale, lambda a, s: F.abs(a) * s)
    n = F.greatest(V.norm(raw), F.lit(FLOOR))
    return F.transform(raw, lambda v: F.greatest(v / n, F.lit(FLOOR)))


def learned_factor(variance: Column, rank: int = RANK, ranks: list[float] | None = None) -> Column:
    """Columns of the learned factor: the diagonal times a weight over the rank; weights fall from 1 to a quarter unless fitted ones are given."""
    ranks = ranks or [1.0 - 0.75 * i / max(rank - 1, 1) for i in range(rank)]
    return F.array(*[V.scale(variance, F.lit(float(w) / max(rank, 1))) for w in ranks])


def rank_weight(rank: int = RANK) -> float:
    """Squared norm of these weights, which is all that a rank-one evaluation needs."""
    return float(sum(((1.0 - 0.75 * i / max(rank - 1, 1)) / rank) ** 2 for i in range(rank)))


def fit_scale(df: DataFrame, vector: str = "mu") -> DataFrame:
    """``(dim, scale)``: the mean absolute value of each dimension, floored, over the norm of all; one row per dimension."""
    each = df.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.greatest(F.avg(F.abs("x").cast("double")), F.lit(FLOOR)).alias("m"))
    total = each.agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("t"))
    return each.join(F.broadcast(total)).select("dim", (F.col("m") / F.greatest("t", F.lit(FLOOR))).alias("scale"))


def fit_ranks(scale: DataFrame, rank: int = RANK) -> list[float]:
    """Weights of the factor's columns: evenly from the greatest to the least scale."""
    hi, lo = scale.agg(F.max("scale"), F.min("scale")).first()
    return [max(float(x), FLOOR) for x in np.linspace(hi, lo, rank)] if rank and hi is not None else []


def group_variance(df: DataFrame, by: str, vector: str = "mu") -> DataFrame:
    """``(by, dim, variance)``: the sample variance of each dimension within a group, floored; a lone row gives the floor."""
    each = df.select(by, F.posexplode(vector).alias("dim", "x"))
    v = F.var_samp(F.col("x").cast("double"))
    return each.groupBy(by, "dim").agg(F.greatest(F.coalesce(v, F.lit(FLOOR)), F.lit(FLOOR)).alias("variance"))


def query_variance(text: Column, mu: Column) -> Column:
    """Entity-aware variance of a query: the more different words or entities, and the longer, the wider, along the dimensions of its mean; one word or none, a fixed small one."""
    w = X.words(text)
    n = F.size(w)
    found = entity_words(text)
    kinds = lambda ws: F.size(F.array_distinct(F.transform(ws, F.lower)))
    full = 1 - F.exp(-n / 4)
    share = kinds(w) / F.greatest(n, F.lit(1))
    diversity = F.greatest(share, F.when(F.size(found) > 0, kinds(found) / F.size(found)).otherwise(0.0)) * full
    diversity = F.greatest(F.least(diversity, F.lit(1.0)), F.lit(0.05))
    wide = F.transform(mu, lambda x: F.greatest(diversity * (F.abs(x) + 0.01) * 1e-2, F.lit(FLOOR)))
    narrow = F.transform(mu, lambda x: F.greatest(F.abs(x) * 0.01 + FLOOR * 100, F.lit(FLOOR)))
    return F.when(n <= 1, narrow).otherwise(wide)


def entity_scale(text: Column) -> Column:
    """The share of different ones among the entities of a text, at least a tenth; a half where there is none."""
    found = entity_words(text)
    return F.when(F.size(found) > 0, F.greatest(F.size(F.array_distinct(F.transform(found, F.lower))) / F.size(found), F.lit(0.1))).otherwise(0.5)


def entity_aware(covariance: DataFrame, texts: DataFrame, key: str, weight: float = 0.5) -> DataFrame:
    """``(key, sigma_diag, sigma_l)`` of a document: the covariance of its views (``views(text, short=True)``), narrowed by how few different entities it has."""
    blend = 1 - weight + weight * entity_scale(F.col("text"))
    each = covariance.join(texts.select(key, blend.alias("_b")), key)
    root = F.transform("sigma_l", lambda c: V.scale(c, F.sqrt("_b")))
    return each.select(key, F.transform(V.scale("sigma_diag", F.col("_b")), lambda v: F.greatest(v, F.lit(FLOOR))).alias("sigma_diag"), root.alias("sigma_l"))


def sense_scale(variance: Column, confidence: Column) -> Column:
    return V.scale(variance, 1 / (1 + confidence))


def sense_factor(factor: Column, confidence: Column) -> Column:
    """The factor that goes with ``sense_scale``: scaled by the root."""
    return F.transform(factor, lambda c: V.scale(c, 1 / F.sqrt(1 + confidence)))


def views(text: Column, short: bool = False) -> Column:
    """Variants of a text whose spread stands for its uncertainty: itself, in lower case, its first half, first and last 32 words, distinct words, and its first 64 reversed; ``short`` leaves out the last two."""
    w = X.words(text)
    n = F.size(w)
    joined = lambda x: F.array_join(x, " ")
    out = [
        text,
        F.lower(joined(w)),
        joined(F.slice(w, F.lit(1), F.greatest(F.floor(n / 2).cast("int"), F.lit(1)))),
        joined(F.slice(w, 1, 32)),
        joined(F.slice(w, F.greatest(n - 31, F.lit(1)), F.lit(32))),
    ]
    return F.array(*out, *([] if short else [joined(F.array_distinct(w)), joined(F.reverse(F.slice(w, 1, 64)))]))


def heuristic_covariance(view_vectors: DataFrame, key: str, rank: int = RANK) -> DataFrame:
    """``(key, sigma_diag, sigma_l)`` of ``(key, views)``, an array of the vectors of each text's views that are not empty: their covariance as diagonal and factor.

    A row is computed where it stands, without a shuffle.  Fewer than two views give the floor and no factor.
    """
    kind = view_vectors.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("sigma_diag", T.ArrayType(T.DoubleType())), T.StructField("sigma_l", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def run(frames):
        for pdf in frames:
            out = []
            for x in pdf["views"]:
                x = np.stack([np.asarray(v, float) for v in x]) if x is not None and len(x) else np.zeros((0, 1))
                if len(x) < 2:
                    out.append(([FLOOR] * x.shape[1], []))
                    continue
                var, factor = diagonal_plus_low_rank(np.cov(x.T, ddof=1), min(rank, x.shape[1]))
                out.append((var.tolist(), factor.T.tolist()))
            yield pd.DataFrame({key: pdf[key], "sigma_diag": [o[0] for o in out], "sigma_l": [o[1] for o in out]})

    return view_vectors.select(key, "views").mapInPandas(run, schema)


def view_vectors(texts: DataFrame, key: str, d: int = 64, short: bool = False) -> DataFrame:
    """``(key, views)``: the hashed vectors of the views of each text, those of empty views left out."""
    kept = F.filter(views(F.col("text"), short), lambda v: v != "")
    return texts.select(key, _hashing_all(d)(F.transform(kept, X.tokens)).alias("views"))


def _hashing_all(d: int):
    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def embed(views_: pd.Series) -> pd.Series:
        seen: dict[str, int] = {}

        def one(ts) -> list[float]:
            v = np.zeros(d)
            for t in ts:
                if t not in seen:
                    seen[t] = int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % d
                v[seen[t]] += 1
            n = np.sqrt(v @ v)
            return (v / n if n else v).tolist()

        return views_.map(lambda vs: None if vs is None else [one(ts) for ts in vs])

    return embed


def encode(df: DataFrame, key: str, mode: str = "learned", d: int = 64, rank: int = RANK, encoder=None) -> DataFrame:
    """``(key, mu, sigma_diag, sigma_l)`` of ``(key, text)`` by mode: ``heuristic``, ``learned``, ``dissolver`` or ``entity_aware``.

    ``encoder(df, key)`` gives ``(key, mu)`` of texts and may be any model; the hashing one stands in for it.  Each different text is encoded once.
    With ``dissolver``, ``df`` has ``interpretations array<string>`` beside the text.
    """
    if mode not in ("heuristic", "learned", "dissolver", "entity_aware"):
        raise ValueError(f"unknown mode {mode}")
    encoder = encoder or (lambda rows, k: hashed(rows, k, d))
    once = df.select("text").where(F.col("text").isNotNull()).distinct().withColumn("_t", X.fingerprint(F.col("text")))
    mu = df.withColumn("_t", X.fingerprint(F.col("text"))).join(encoder(once, "_t"), "_t", "left").drop("_t")
    none = F.array().cast("array<array<double>>")
    if mode == "learned":
        out = mu.withColumn("sigma_diag", learned_variance(F.col("mu")))
        return out.select(key, "mu", "sigma_diag", learned_factor(F.col("sigma_diag"), rank).alias("sigma_l"))
    if mode == "dissolver":
        each = df.select(key, F.posexplode("interpretations").alias("_i", "text")).select(F.struct(key, "_i").alias("_id"), "text")
        var = group_variance(encoder(each, "_id").select(F.col(f"_id.{key}").alias(key), "mu"), key)
        var = var.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "variance"))), lambda s: s["variance"]).alias("sigma_diag"))
        out = mu.select(key, "mu").join(var, key, "left")
        return out.select(key, "mu", F.coalesce("sigma_diag", F.transform("mu", lambda _: F.lit(FLOOR))).alias("sigma_diag"), none.alias("sigma_l"))
    cov = heuristic_covariance(view_vectors(df, key, d, mode == "entity_aware"), key, rank)
    if mode == "entity_aware":
        cov = entity_aware(cov, df, key)
    return mu.select(key, "mu").join(cov, key)


def encode_query(df: DataFrame, key: str, mode: str | None = None, d: int = 64) -> DataFrame:
    """A query as a point (null covariance) without a mode, else as a Gaussian; ``dissolver`` counts as ``heuristic`` here, and ``entity_aware`` takes the variance of queries."""
    if mode is None:
        return hashed(df, key, d).select(key, "mu", F.lit(None).cast("array<double>").alias("sigma_diag"), F.lit(None).cast("array<array<double>>").alias("sigma_l"))
    if mode == "entity_aware":
        rows = hashed(df, key, d).join(df.select(key, "text"), key)
        return rows.select(key, "mu", query_variance(F.col("text"), F.col("mu")).alias("sigma_diag"), F.array().cast("array<array<double>>").alias("sigma_l"))
    return encode(df, key, "heuristic" if mode == "dissolver" else mode, d)


def sense_queries(senses: DataFrame, encoded: DataFrame, key: str = "sense_id") -> DataFrame:
    """``(key, mu, sigma_diag, sigma_l)``: a sense's anchors where it has them, else what was encoded, its covariance scaled by 1/(1+confidence)."""
    both = senses.join(encoded.select(key, F.col("mu").alias("_m"), F.col("sigma_diag").alias("_s"), F.col("sigma_l").alias("_l")), key, "left")
    return both.select(
        key,
        F.coalesce("mu_anchor", "_m").alias("mu"),
        F.coalesce("sigma_anchor", sense_scale(F.col("_s"), F.col("confidence"))).alias("sigma_diag"),
        F.coalesce("sigma_l_anchor", sense_factor(F.col("_l"), F.col("confidence"))).alias("sigma_l"),
    )


def head(df: DataFrame, key: str, weights: dict[str, list]) -> DataFrame:
    """``(key, sigma_diag, sigma_l)`` of ``(key, mu)`` by a trained head: a shared rectified layer ``w, b``, a softplus diagonal ``wd, bd`` within [1e-4, 1e2], and a factor ``wl, bl`` within 10.

    Weights are matrices by output and input, of a bounded size, and go to the tasks with the function.
    """
    w = {k: np.asarray(v, float) for k, v in weights.items()}
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("sigma_diag", T.ArrayType(T.DoubleType())), T.StructField("sigma_l", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def run(frames):
        for pdf in frames:
            x = np.stack(pdf["mu"].map(np.asarray)) if len(pdf) else np.zeros((0, w["w"].shape[1]))
            h = np.maximum(x @ w["w"].T + w["b"], 0)
            diagonal = np.clip(np.logaddexp(0, h @ w["wd"].T + w["bd"]), 1e-4, 1e2)
            factor = np.clip(h @ w["wl"].T + w["bl"], -10, 10).reshape(len(x), -1, diagonal.shape[1])
            yield pd.DataFrame({key: pdf[key], "sigma_diag": list(diagonal), "sigma_l": [list(f) for f in factor]})

    return df.where(F.col("mu").isNotNull()).select(key, "mu").mapInPandas(run, schema)
