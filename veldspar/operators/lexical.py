"""Full-text search: postings, BM25, boolean and phrase matching."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldspar.functions import text as X

K1, B = 1.2, 0.75


def postings(passages: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``(key, term, tf, dl)``: terms of each text with their counts and the text's number of terms."""
    each = passages.select(key, X.tokens(F.col("text")).alias("ts")).where(F.size("ts") > 0)
    each = each.select(key, F.size("ts").alias("dl"), F.explode("ts").alias("term"))
    return each.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def statistics(passages: DataFrame) -> DataFrame:
    """One row ``(n, avgdl)`` over all passages, those without terms included."""
    return passages.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.size(X.tokens(F.col("text"))), F.lit(0)).cast("double")).alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, term)``, each term once per query; an OR between terms is not a term."""
    parts = F.array_distinct(X.tokens(F.regexp_replace("text", r"(^|\s)OR(\s|$)", " ")))
    return queries.select("query_id", F.explode(parts).alias("term"))


def bm25(passages: DataFrame | None, queries: DataFrame, key: str = "chunk_id", top: int | None = None, index: Index | None = None) -> DataFrame:
    """``(query_id, key, score, rank)`` of the passages that hold any term of each query; lower is better.

    An inverse document frequency of zero or less counts as 1e-6.  With an ``index`` only the stored postings of the queries' terms are read, and no text;
    without one, the term table is joined before anything is aggregated, and terms are counted within each text, so nothing but the matching
    postings is shuffled.  Null and empty texts match nothing but count in the number of texts.  Ties go by the key.
    """
    terms = query_terms(queries)
    if index is None:
        wanted = terms.select("term").distinct()
        each = passages.select(key, X.tokens(F.col("text")).alias("ts"))
        hits = each.select(key, F.size("ts").alias("dl"), F.explode("ts").alias("term")).join(wanted, "term", "left_semi")
        tf = hits.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
        df, s = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), F.broadcast(statistics(passages))
    else:
        tf, df, s = index.postings(terms), None, F.broadcast(index.statistics)
    tfn = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = (terms.join(tf, "term") if df is None else terms.join(tf, "term").join(df, "term")).join(s)
    scored = scored.withColumn("idf", F.when(idf > 0, idf).otherwise(1e-6))
    out = scored.groupBy("query_id", key).agg((-F.sum(F.col("idf") * tfn)).alias("score"))
    return ranked(out, ["query_id"], ["score", key], top)


class Index:
    """Stored postings ``(term, df, tf, dl, key)``, a folder per hash of the term and sorted within, and one row of statistics ``(n, avgdl)``.

    A search reads the folders of its terms, and in their files the row groups that these fall into.  A term's document frequency is stored with its postings.
    """

    FOLDERS = 64

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key
        self.statistics = spark.read.parquet(f"{path}/statistics")
        self.rows = spark.read.parquet(f"{path}/postings")

    @classmethod
    def write(cls, passages: DataFrame, path: str, key: str = "chunk_id") -> Index:
        """Build the index anew; a hot term's postings are spread over several tasks, and its frequency is counted before."""
        at = F.pmod(F.xxhash64("term"), F.lit(cls.FOLDERS)).cast("int").alias("folder")
        statistics(passages).write.mode("overwrite").parquet(f"{path}/statistics")
        all_ = postings(passages, key)
        df = all_.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        rows = all_.join(df, "term").select("term", "df", "tf", "dl", key, at)
        rows.repartitionByRange("folder", "term", key).sortWithinPartitions("folder", "term", key).write.mode("overwrite").option("compression", "zstd").partitionBy("folder").parquet(f"{path}/postings")
        return cls(passages.sparkSession, path, key)

    def postings(self, terms: DataFrame, most: int = 2_000) -> DataFrame:
        """Those of the terms of ``terms (term)``: up to ``most`` of them are named to the scan, more are joined."""
        folder = F.pmod(F.xxhash64("term"), F.lit(self.FOLDERS)).cast("int")
        few = terms.select("term", folder.alias("folder")).distinct().limit(most + 1).collect()
        if len(few) <= most:
            return self.rows.where(F.col("folder").isin({r["folder"] for r in few}) & F.col("term").isin([r["term"] for r in few])).drop("folder")
        return self.rows.join(terms.select("term").distinct(), "term", "left_semi").drop("folder")


def ranked(df: DataFrame, by: list[str], order: list, top: int | None = None) -> DataFrame:
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if top is None else out.where(F.col("rank") <= top)


def sanitise(query: str) -> list[tuple[str, str]]:
    """Tokens of a boolean query: ``("op", OR|AND|NOT)`` and ``("phrase", words)``.

    Upper-case operators count after a term only and not after another operator; other words become phrases of their
    letters and digits; a trailing operator goes.
    """
    out: list[tuple[str, str]] = []
    for raw in query.split():
        if raw in ("OR", "AND", "NOT"):
            if out and out[-1][0] == "phrase":
                out.append(("op", raw))
            continue
        for word in re.findall(r"\w+", raw):
            out.append(("phrase", word))
    while out and out[-1][0] == "op":
        out.pop()
    return out


def match(query: str, text: Column) -> Column:
    """Whether a text matches a boolean query: NOT binds tightest, then the implicit AND, AND, and last OR."""
    toks = X.tokens(text)

    def has(phrase: str) -> Column:
        parts = [p for p in re.split(r"_+", phrase.lower().translate(str.maketrans(X.MARKED, X.PLAIN))) if p]
        return phrase_in(parts, toks)

    parsed = sanitise(query)
    if not parsed:
        return F.lit(False)
    groups: list[Column] = []
    current, negate = None, False
    for kind, value in parsed:
        if kind == "op":
            if value == "OR":
                groups.append(current)
                current = None
            negate = value == "NOT"
            continue
        c = has(value)
        c = ~c if negate else c
        current = c if current is None else current & c
        negate = False
    groups.append(current)
    out = groups[0]
    for g in groups[1:]:
        out = out | g
    return F.coalesce(out, F.lit(False))


def phrase_in(parts: list[str], toks: Column) -> Column:
    """Whether the terms occur in a row."""
    if not parts:
        return F.lit(False)
    if len(parts) == 1:
        return F.array_contains(toks, parts[0])
    spots = F.transform(toks, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    return F.exists(spots, lambda p: (p["t"] == parts[0]) & (F.slice(toks, p["i"] + 1, len(parts)) == F.array(*[F.lit(x) for x in parts])))
