"""Keyed tables: latest versions, changes, sessions and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions.answers import prompt
from veldspar.operators.lexical import ranked


def latest(df: DataFrame, key: str, version: str, *columns: str) -> DataFrame:
    """The row of the greatest version of each key, as an aggregate that combines before the shuffle.

    Of equal versions the greatest row counts, so the result is the same in any order; null versions come last, null keys are dropped.
    """
    # fields with a map or variant can't be compared: these are taken with the row that wins, of equal rows any
    rest = [F.col(c) for c in (columns or [c for c in df.columns if c != key])]
    plain = [c for c in (columns or df.columns) if c != key and "map<" not in df.schema[c].dataType.simpleString()]
    pick = F.max_by(F.struct(*rest), F.struct(F.coalesce(F.col(version), F.lit(-(2**62))), *[F.col(c) for c in plain]))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(pick.alias("s")).select(key, "s.*")


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``changes`` instead of those of ``base`` with the same key, and all others."""
    return base.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key).distinct(), key, "left_anti")


def upsert_confident(base: DataFrame, changes: DataFrame, key: str = "sense_id", confidence: str = "confidence") -> DataFrame:
    """Of each key the row of the higher confidence, the newer of equal ones."""
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(confidence), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def in_order(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the wanted ids ``(place, key)``, in their order; unknown ids are ignored."""
    return ids.join(df, key).orderBy("place")


def first_of_equal_texts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The first row by key of each trimmed text; null and blank texts are dropped."""
    t = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    ok = df.where(t != "")
    return ok.groupBy(t.alias("text")).agg(F.min(key).alias(key)).select(key, "text")


def certainty(label: Column) -> Column:
    """HIGH, MEDIUM or LOW as the inverse of an uncertainty; an unknown one is MEDIUM."""
    low = F.lower(label)
    return F.when(low == "low", "HIGH").when(low == "high", "LOW").otherwise("MEDIUM")


def _lines(place: DataFrame, by: str, *line: Column) -> DataFrame:
    each = F.concat_ws("\n", *line)
    return place.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", each.alias("line")))), lambda s: s["line"]).alias("lines"))


def context(hits: DataFrame, queries: DataFrame, by: str = "query_id", order: str = "rank") -> DataFrame:
    """``(by, context)``: for each of ``queries(by, text)`` its passages ``hits(by, order, text, uncertainty_label)`` in order, each with its certainty; result lists are of bounded size."""
    place = ranked(hits.withColumnRenamed(order, "o"), [by], ["o", "chunk_id"])
    body = _lines(place, by, F.concat(F.lit("[Chunk "), F.col("rank").cast("string"), F.lit("] — Confidence: "), certainty(F.col("uncertainty_label"))), F.coalesce("text", F.lit("")), F.lit(""))
    both = queries.select(by, "text").join(body, by, "left")
    head = F.array(F.lit("[CONTEXT START]"), F.lit(""), F.concat(F.lit("[QUERY] "), F.coalesce("text", F.lit(""))), F.lit(""))
    return both.select(by, F.array_join(F.concat(head, F.coalesce("lines", F.array().cast("array<string>")), F.array(F.lit("[CONTEXT END]"))), "\n").alias("context"))


def multi_sense_context(hits: DataFrame, queries: DataFrame, senses: DataFrame, by: str = "query_id", budget: int | None = None) -> DataFrame:
    """``(by, context)``: the passages of each sense under its letter and domain, each passage once over all senses, at most ``budget`` in all.

    ``senses(by, sense_order, domain)`` with orders from 0; ``hits(by, sense_order, rank, chunk_id, text, uncertainty_label)``.  A sense without passages says so.
    """
    mark = F.char(F.col("sense_order") + 65)
    w = Window.partitionBy(by, "chunk_id").orderBy("sense_order", "rank")
    first = hits.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    first = first.withColumn("_at", F.row_number().over(Window.partitionBy(by).orderBy("sense_order", "rank")))
    kept = first if budget is None else first.where(F.col("_at") <= budget)
    line = F.concat_ws("\n", F.concat(F.lit("  [Chunk "), mark, F.col("rank").cast("string"), F.lit("] — Confidence: "), certainty(F.col("uncertainty_label"))), F.concat(F.lit("  "), F.coalesce("text", F.lit(""))), F.lit(""))
    body = kept.groupBy(by, "sense_order").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]).alias("lines"), F.min("_at").alias("_first"))
    any_ = hits.groupBy(by, "sense_order").agg(F.lit(True).alias("_any"))
    shown = kept.select(by, "sense_order", F.lit(1).alias("_k")).groupBy(by, "sense_order").agg(F.sum("_k").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy(by).orderBy("sense_order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = senses.select(by, "sense_order", "domain").join(body, [by, "sense_order"], "left").join(any_, [by, "sense_order"], "left").join(shown, [by, "sense_order"], "left").withColumn("_before", before)
    spent = F.col("_before") >= budget if budget is not None else F.lit(False)
    empty = F.when(F.col("_any").isNull() | spent, "  (no results for this sense)").otherwise("  (no unique results for this sense within top-k budget)")
    lines = F.concat(F.array(F.concat(F.lit("[Sense "), mark, F.lit(": "), F.col("domain"), F.lit("]"))), F.coalesce("lines", F.array(empty, F.lit(""))))
    each = each.groupBy(by).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sense_order", lines.alias("lines")))), lambda s: s["lines"])).alias("lines"))
    both = queries.select(by, "text").join(each, by, "left")
    head = F.array(F.lit("[CONTEXT START — MULTI-SENSE]"), F.lit(""), F.concat(F.lit("[QUERY] "), F.coalesce("text", F.lit(""))), F.lit(""))
    return both.select(by, F.array_join(F.concat(head, F.coalesce("lines", F.array().cast("array<string>")), F.array(F.lit("[CONTEXT END]"))), "\n").alias("context"))


def extractive_answer(hits: DataFrame, queries: DataFrame, by: str = "query_id", order: str = "rank") -> DataFrame:
    """``(by, context, prompt, answer)``: the context, the prompt for a model, and an answer made of the passages themselves."""
    place = ranked(hits.withColumnRenamed(order, "o"), [by], ["o", "chunk_id"])
    body = _lines(place, by, F.concat(F.lit("- ("), F.col("uncertainty_label"), F.lit(") "), F.coalesce("text", F.lit(""))))
    head = F.array(F.concat(F.lit("Query: "), F.coalesce("text", F.lit(""))), F.lit("Evidence summary:"))
    answer = F.array_join(F.concat(head, F.coalesce("lines", F.array().cast("array<string>"))), "\n")
    out = queries.select(by, "text").join(body, by, "left").select(by, "text", answer.alias("answer")).join(context(hits, queries, by, order), by)
    return out.select(by, "context", prompt(F.col("context"), F.coalesce("text", F.lit(""))).alias("prompt"), "answer")


def passage(df: DataFrame, wanted: str, key: str = "chunk_id") -> DataFrame:
    """The text of one passage; no row for an unknown id."""
    return df.where(F.col(key) == wanted).select("text").limit(1)


def serialised(df: DataFrame, by: str = "query_id", order: str = "rank") -> DataFrame:
    """``(by, json)``: the rows of each result list, in order, as a JSON array of objects."""
    return df.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(F.struct(order, *[c for c in df.columns if c not in (by, order)])))).alias("json"))


def branches(sessions: DataFrame) -> DataFrame:
    """Branch chats with their base session, newest first; those without a base are left out."""
    base = sessions.select(F.col("session_id").alias("base_id"), F.col("mtime").alias("base_mtime"))
    return sessions.where(F.col("base_id").isNotNull()).join(base, "base_id").orderBy(F.desc("mtime"), "session_id")


def anchors(nodes: DataFrame) -> DataFrame:
    """Edges from each interpretation to its anchor, by ``metadata.anchor_id``."""
    src = nodes.select(F.col("chunk_id").alias("source"), F.col("metadata")["anchor_id"].alias("anchor")).where("anchor is not null")
    return src.join(nodes.select(F.col("chunk_id").alias("anchor")).distinct(), "anchor").select("source", "anchor")
