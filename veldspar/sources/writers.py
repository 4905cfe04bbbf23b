"""Stores, exports and caches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.functions.text import fingerprint
from veldspar.operators.lexical import Index


def save_store(chunks: DataFrame, path: str, key: str = "chunk_id") -> None:
    """The chunks, and the index for full-text search derived from them, as compressed Parquet."""
    chunks.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/chunks")
    Index.write(chunks.sparkSession.read.parquet(f"{path}/chunks"), f"{path}/index", key)


def load_index(spark: SparkSession, path: str, key: str = "chunk_id") -> Index:
    """The stored index, made anew from the chunks where it is missing."""
    try:
        return Index(spark, f"{path}/index", key)
    except AnalysisException:
        return Index.write(spark.read.parquet(f"{path}/chunks"), f"{path}/index", key)


def load_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/chunks")


def to_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def markdown_lines(docs: DataFrame, order: str, title: str | None = None) -> DataFrame:
    """``(order, value)``: a heading and the text of each document, with rules between."""
    body = F.concat(F.lit("## "), F.coalesce("title", F.lit("Untitled")), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n---\n"))
    out = docs.select(F.col(order).alias("order"), body.alias("value"))
    if title:
        first = docs.sparkSession.createDataFrame([(f"# {title}\n",)], "value string").select(F.lit(None).cast(docs.schema[order].dataType).alias("order"), "value")
        out = first.unionByName(out)
    return out


def to_markdown(docs: DataFrame, path: str, order: str, title: str | None = None) -> None:
    """Part files in order; a range sort, so no task holds them all."""
    markdown_lines(docs, order, title).orderBy(F.asc_nulls_first("order")).select("value").write.mode("overwrite").text(path)


def to_text(docs: DataFrame, path: str, order: str) -> None:
    value = F.concat(F.lit("=== "), F.coalesce("title", F.lit("Untitled")), F.lit(" ===\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    docs.select(F.col(order).alias("order"), value.alias("value")).orderBy("order").select("value").write.mode("overwrite").text(path)


def cached(spark: SparkSession, path: str, texts: DataFrame, version: str, ttl_seconds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Texts split into those with a stored result, with it, and the rest: ``texts(key, text)``, results by the hash of the text.

    An entry counts if its version is the same and, with a time to live, it is not older.
    """
    asked = texts.withColumn("fingerprint", fingerprint(F.col("text")))
    try:
        stored = spark.read.parquet(path)
    except Exception:  # nothing stored yet
        return asked.limit(0).withColumn("result", F.lit(None).cast("string")), asked
    ok = stored.where(F.col("version") == version)
    if ttl_seconds is not None:
        ok = ok.where(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("stored_at") <= ttl_seconds)
    ok = ok.groupBy("fingerprint").agg(F.max_by("result", "stored_at").alias("result"))
    return asked.join(ok, "fingerprint"), asked.join(ok, "fingerprint", "left_anti")


def store_results(results: DataFrame, path: str, version: str) -> None:
    """Append ``(text, result)`` to the cache."""
    out = results.select(fingerprint(F.col("text")).alias("fingerprint"), "result", F.lit(version).alias("version"), F.current_timestamp().alias("stored_at"))
    out.write.mode("append").parquet(path)


def cache_stats(spark: SparkSession, path: str) -> DataFrame:
    """``(entries, bytes)`` of the cache."""
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.length("result")), F.lit(0)).alias("bytes"))


def _rewrite(spark: SparkSession, path: str, keep) -> None:
    """What is kept is written beside the cache first, so that a lost job leaves it whole."""
    jvm = spark.sparkContext._jvm
    old, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, path.rstrip("/") + "-new"))
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    keep(spark.read.parquet(path)).write.mode("overwrite").parquet(new.toString())
    fs.delete(old, True)
    fs.rename(new, old)


def invalidate(spark: SparkSession, path: str, texts: DataFrame) -> None:
    """Drop the entries of the given ``texts (text)``."""
    gone = texts.select(fingerprint(F.col("text")).alias("fingerprint"))
    _rewrite(spark, path, lambda rows: rows.join(gone, "fingerprint", "left_anti"))


def evict(spark: SparkSession, path: str, most: int) -> None:
    """Keep the ``most`` newest entries."""
    _rewrite(spark, path, lambda rows: rows.orderBy(F.desc("stored_at"), "fingerprint").limit(most))


def clear(spark: SparkSession, path: str) -> None:
    _rewrite(spark, path, lambda rows: rows.limit(0))


def append_turns(turns: DataFrame, path: str) -> None:
    """Append saved turns of a chat, each with the time it was saved unless it has one."""
    out = turns if "ts" in turns.columns else turns.withColumn("ts", F.current_timestamp())
    out.write.mode("append").parquet(path)
