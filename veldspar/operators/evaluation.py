"""Measures of retrieval and of calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions import text as X


def retrieval(run: DataFrame, qrels: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """``(query_id, recall, ndcg)`` at k of ``run(query_id, key, rank)`` against ``qrels(query_id, key)``.

    Recall is over distinct ids; the gain is binary, and its ideal has min(k, relevant) hits.  A query without relevant ids
    has 0 for both; queries come from either side.
    """
    rel = qrels.select("query_id", key).distinct()
    size = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hit = run.where(F.col("rank") <= k).join(rel, ["query_id", key], "left_semi")
    got = hit.groupBy("query_id").agg(F.countDistinct(key).alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    ids = run.select("query_id").union(qrels.select("query_id")).distinct()
    out = ids.join(size, "query_id", "left").join(got, "query_id", "left")
    recall = F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0))
    ndcg = F.when(F.col("n").isNull(), 0.0).otherwise(F.coalesce(F.col("gain"), F.lit(0.0)) / ideal)
    return out.select("query_id", recall.alias("recall"), ndcg.alias("ndcg"))


def calibration_bins(df: DataFrame, bins: int = 10) -> DataFrame:
    """``(bin, n, mean_confidence, accuracy)`` of ``(confidence, outcome)``; equal widths, the last bin closed."""
    b = F.greatest(F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    ok = df.where(F.col("confidence").isNotNull() & F.col("outcome").isNotNull())
    return ok.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("outcome").cast("double")).alias("accuracy"))


def expected_calibration_error(df: DataFrame, bins: int = 10) -> DataFrame:
    b = calibration_bins(df, bins)
    return b.agg((F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def brier(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col("confidence") - F.col("outcome"), 2)).alias("brier"))


def abstention_curve(df: DataFrame, key: str, steps: int = 10_000) -> DataFrame:
    """``(answered, retention, accuracy)``: the running accuracy as less confident rows are answered too, ties by key.

    Running counts are offset by range: rows are cut into ``steps`` equal ranges of confidence, summed, and ranked within their range
    only, so no single task orders the whole table.
    """
    step = F.least(F.floor((1 - F.col("confidence")) * steps), F.lit(steps)).cast("int")
    rows = df.select(key, "confidence", F.col("outcome").cast("double").alias("outcome"), step.alias("step"))
    sums = rows.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("s"))
    before = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("step", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("s0"), F.sum("n").over(Window.partitionBy()).alias("total"))
    w = Window.partitionBy("step").orderBy(F.desc("confidence"), key).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("i", F.count(F.lit(1)).over(w)).withColumn("c", F.sum("outcome").over(w)).join(F.broadcast(sums), "step")
    answered = F.col("i") + F.col("n0")
    return run.select(key, answered.alias("answered"), (answered / F.col("total")).alias("retention"), ((F.col("c") + F.col("s0")) / answered).alias("accuracy"))


def token_entropy(text: Column) -> Column:
    """Entropy, in bits, of the words of a text; 0 for none."""
    w = X.words(F.lower(F.coalesce(text, F.lit(""))))
    n = F.size(w).cast("double")
    ordered = F.array_sort(w)
    # run lengths of the sorted words, without a quadratic count
    zero = F.struct(F.lit(None).cast("string").alias("p"), F.lit(0.0).alias("c"), F.lit(0.0).alias("h"))
    plogp = lambda c: F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0)

    def step(s, t):
        same = s["p"] == t
        return F.struct(t.alias("p"), F.when(same, s["c"] + 1).otherwise(F.lit(1.0)).alias("c"), F.when(same, s["h"]).otherwise(s["h"] + F.coalesce(plogp(s["c"]), F.lit(0.0))).alias("h"))

    return F.aggregate(ordered, zero, step, lambda s: s["h"] + F.coalesce(plogp(s["c"]), F.lit(0.0)))


def ambiguity(entropy: Column) -> Column:
    return F.when(entropy < 2.5, "low").when(entropy < 4.0, "medium").otherwise("high")
