"""Weights over the senses of a query: normalisation, entropy, smoothing, memory and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldspar.functions import text as X
from veldspar.functions.geometry import bhattacharyya_diagonal
from veldspar.operators.lexical import ranked


def weights(senses: DataFrame, by: str = "packet_id", confidence: str = "confidence") -> DataFrame:
    """Adds ``weight``: the share of the confidence in its packet; all zero where the sum is."""
    total = F.sum(confidence).over(Window.partitionBy(by))
    return senses.withColumn("weight", F.col(confidence) / F.when(total == 0, 1.0).otherwise(total))


def entropy(weighted: DataFrame, by: str = "packet_id") -> DataFrame:
    """``(by, entropy)`` in bits."""
    p = F.when(F.col("weight") > 0, -F.col("weight") * F.log2("weight")).otherwise(0.0)
    return weighted.groupBy(by).agg(F.sum(p).alias("entropy"))


def smooth(weighted: DataFrame, by: str = "packet_id", key: str = "sense_id", alpha: float = 0.3, same_term: float = 0.1) -> DataFrame:
    """``(by, key, weight)``: (1-a) w + a times the mean of the others' w times their compatibility, and then normalised.

    Compatibility is exp(-Bhattacharyya) of the diagonal anchors, a tenth of it between senses of one term.  Packets hold
    the few senses of a query.
    """
    x = weighted.select(by, F.col(key).alias("ka"), F.col("term").alias("ta"), F.col("mu").alias("ma"), F.col("sigma_diag").alias("sa"), F.col("weight").alias("wa"))
    y = weighted.select(by, F.col(key).alias("kb"), F.col("term").alias("tb"), F.col("mu").alias("mb"), F.col("sigma_diag").alias("sb"), F.col("weight").alias("wb"))
    compat = F.exp(-bhattacharyya_diagonal("ma", "sa", "mb", "sb")) * F.when(F.col("ta") == F.col("tb"), same_term).otherwise(1.0)
    pull = x.join(y, by).where("ka <> kb").groupBy(by, "ka").agg(F.avg(F.col("wb") * F.coalesce(F.nanvl(compat, F.lit(0.0)), F.lit(0.0))).alias("pull"))
    out = weighted.select(by, key, "weight").join(pull.withColumnRenamed("ka", key), [by, key], "left")
    out = out.withColumn("weight", (1 - alpha) * F.col("weight") + alpha * F.coalesce("pull", F.lit(0.0)))
    total = F.sum("weight").over(Window.partitionBy(by))
    return out.select(by, key, (F.col("weight") / F.when(total == 0, 1.0).otherwise(total)).alias("weight"))


def conflicts(weighted: DataFrame, by: str = "packet_id", threshold: float = 0.45) -> DataFrame:
    """Senses of a term of which two or more weigh above the threshold."""
    heavy = F.sum((F.col("weight") > threshold).cast("int")).over(Window.partitionBy(by, "term"))
    return weighted.withColumn("heavy", heavy).where((F.col("heavy") >= 2) & (F.col("weight") > threshold)).drop("heavy")


def ground(senses: DataFrame, by: str = "packet_id", boost: float = 0.2, cap: float = 0.99) -> DataFrame:
    """Confidences raised by the nearness ``w2`` of the closest stored passage, then shared within the term."""
    raised = F.least(F.col("confidence") + F.coalesce(boost / (1 + F.col("w2")), F.lit(0.0)), F.lit(cap))
    out = senses.withColumn("confidence", raised)
    total = F.sum("confidence").over(Window.partitionBy(by, "term"))
    return out.withColumn("confidence", F.least(F.col("confidence") / F.when(total == 0, 1.0).otherwise(total), F.lit(cap)))


def routed(weighted: DataFrame, by: str = "packet_id", key: str = "sense_id", single: float = 1.5, dual: float = 2.5) -> DataFrame:
    """The senses a query is sent to, by its entropy: one, two, or three with a wider search; adds ``route`` and ``rank``."""
    e = entropy(weighted, by)
    out = ranked(weighted, [by], [F.desc("weight"), key]).join(e, by)
    route = F.when(F.col("entropy") <= single, "single").when(F.col("entropy") <= dual, "dual").otherwise("fallback")
    keep = F.when(F.col("entropy") <= single, 1).when(F.col("entropy") <= dual, 2).otherwise(3)
    return out.withColumn("route", route).where(F.col("rank") <= keep)


def remember(senses: DataFrame, cached: DataFrame, boost: float = 0.15, cap: float = 0.95, least: float = 0.3) -> DataFrame:
    """Senses with a boosted confidence where the cache holds the same one, and ``upsert``: whether to store it.

    Same means the same term and either the same id, or domain, version and normalised query; null fields equal nothing.
    """
    c = cached.select(F.col("sense_id").alias("cid"), F.col("term").alias("cterm"), F.col("domain").alias("cdomain"), F.col("version").alias("cversion"), X.identity(F.col("retrieval_query")).alias("cquery"))
    same = (F.col("term") == F.col("cterm")) & ((F.col("sense_id") == F.col("cid")) | ((F.col("domain") == F.col("cdomain")) & (F.col("version") == F.col("cversion")) & (X.identity(F.col("retrieval_query")) == F.col("cquery"))))
    known = senses.join(c, same, "left_semi").select("sense_id").distinct().withColumn("known", F.lit(True))
    out = senses.join(known, "sense_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    raised = F.when(F.col("known"), F.least(F.col("confidence") + boost, F.greatest(F.lit(cap), F.col("confidence")))).otherwise(F.col("confidence"))
    return out.withColumn("confidence", raised).withColumn("upsert", F.col("confidence") >= least)


def alive(senses: DataFrame, now: Column | None = None) -> DataFrame:
    """Senses whose time to live, in hours, has not passed at ``now``; the last second still counts."""
    now = F.current_timestamp() if now is None else now
    return senses.where(F.unix_timestamp(now) - F.unix_timestamp("created_at") <= F.col("ttl_hours") * 3600)


def domains(texts: DataFrame, vocabulary: DataFrame, key: str, most: int = 5) -> DataFrame:
    """``(key, domain, hits, rank)``: domains by how many of their keywords a text contains, as substrings; ``general`` where there is none.

    ``vocabulary(domain, keywords)`` is a small table.
    """
    hits = F.size(F.filter("keywords", lambda k: F.contains(F.col("low"), F.lower(k))))
    each = texts.select(key, F.lower("text").alias("low")).crossJoin(F.broadcast(vocabulary)).select(key, "domain", hits.alias("hits")).where("hits > 0")
    top = ranked(each, [key], [F.desc("hits"), "domain"], most)
    none = texts.select(key).distinct().join(top.select(key), key, "left_anti").select(key, F.lit("general").alias("domain"), F.lit(0).alias("hits"), F.lit(1).alias("rank"))
    return top.unionByName(none)


def generated(terms: DataFrame, least: float = 0.3) -> DataFrame:
    """``(sense_id, term, domain, confidence, context_hints, supporting_evidence, retrieval_query)`` of a model's answer ``(term, senses array<struct>)``.

    A term, in lower case, needs two senses or more, whatever their confidence; those below ``least`` are then left out.  The query is the term with its first three hints.
    """
    each = terms.where((F.coalesce("term", F.lit("")) != "") & (F.size("senses") >= 2)).select(F.lower("term").alias("term"), F.explode("senses").alias("s"))
    each = each.select("term", F.coalesce("s.domain", F.lit("unknown")).alias("domain"), F.coalesce("s.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("s.context_hints", F.array().cast("array<string>")).alias("context_hints"), F.coalesce("s.supporting_evidence", F.array().cast("array<string>")).alias("supporting_evidence"))
    key = X.stable_id(F.concat_ws(":", "term", "domain"))
    query_ = F.trim(F.concat_ws(" ", "term", F.array_join(F.slice("context_hints", 1, 3), " ")))
    return each.where(F.col("confidence") >= least).select(key.alias("sense_id"), "*", query_.alias("retrieval_query"))


def light(weighted: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Ids of the senses below the threshold, a missing weight counting as none."""
    return weighted.where(F.coalesce("weight", F.lit(0.0)) < threshold).select("sense_id")


def of_term(cached: DataFrame, term: str, now: Column | None = None) -> DataFrame:
    """The senses of a term that are alive."""
    return alive(cached.where(F.col("term") == term), now)


def chosen(candidates: DataFrame, by: str = "query_id", most: int = 3) -> DataFrame:
    """``(by, label, domain, confidence, context_hints, retrieval_query, rank)``: the likeliest of a query's candidates ``(by, place, label, domain, text, probability)``.

    Confidences are the shares of the probabilities among these, rounded to four digits; those of none are left out, and where nothing is left the first candidate has a confidence of 1.
    """
    p = F.coalesce("probability", F.lit(0.0))
    top = ranked(candidates.withColumn("p", p), [by], [F.desc("p"), "place"], most)
    total = F.sum("p").over(Window.partitionBy(by))
    kept = top.withColumn("confidence", F.round(F.col("p") / F.when(total == 0, 1.0).otherwise(total), 4)).where("p > 0")
    none = ranked(candidates.join(kept.select(by), by, "left_anti"), [by], ["place"], 1).withColumn("confidence", F.lit(1.0))
    columns = [by, "label", "domain", "confidence", X.hints(F.col("text")).alias("context_hints"), F.concat(F.col("text"), F.lit(" ("), F.col("label"), F.lit(")")).alias("retrieval_query"), "rank"]
    return kept.select(*columns).unionByName(none.select(*columns))


def nearest_passage(anchors: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``(sense_id, w2)``: the diagonal Wasserstein distance of each sense's anchor to the passage nearest by its mean, for ``ground``."""
    from veldspar.functions.geometry import wasserstein_diagonal
    from veldspar.operators.retrieval import nearest

    near = nearest(chunks, anchors.select(F.col("sense_id").alias("query_id"), "mu"), 1, "l2", key)
    both = near.select(F.col("query_id").alias("sense_id"), key).join(chunks.select(key, F.col("mu").alias("_m"), F.col("sigma_diag").alias("_s")), key).join(anchors.select("sense_id", "mu", "sigma_diag"), "sense_id")
    return both.select("sense_id", wasserstein_diagonal("mu", "sigma_diag", "_m", "_s").alias("w2"))


def save(senses: DataFrame, path: str) -> None:
    senses.write.mode("overwrite").option("compression", "zstd").parquet(path)


def load(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    """The saved senses that are alive."""
    return alive(spark.read.parquet(path), now)
