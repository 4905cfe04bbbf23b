"""The queries of this subpackage, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm.batch_dedup import History
from veldspar.llm.clusters import similarity_clusters
from veldspar.llm.common import one_row_each
from veldspar.llm.leaks import leaks
from veldspar.llm.near_duplicates import group_pairs, near_duplicate_groups
from veldspar.llm.packing import pack, token_counts
from veldspar.llm.replies import broken_replies
from veldspar.llm.residue import residue
from veldspar.llm.similar import most_similar
from veldspar.llm.splitting import split_documents
from veldspar.session import Workspace, table


def _records(spark: SparkSession, root: str) -> DataFrame:
    chunks = table(spark, root, "chunks").select(F.col("chunk_id").alias("id"), F.col("ingest_seq").alias("version"), "text")
    corpus = table(spark, root, "robust_corpus").select(F.col("sample_id").alias("id"), F.lit(0).cast("bigint").alias("version"), "text")
    return chunks.unionByName(corpus)


def p5_groups(spark: SparkSession, root: str) -> DataFrame:
    work = Workspace(spark, "p5")
    g = near_duplicate_groups(_records(spark, root), work, threshold=0.5, shingle=3)
    return g.select("id", F.hex("cls").alias("class_id"), "rep", "group_id")


def p5_weighted(spark: SparkSession, root: str) -> DataFrame:
    """The same over bags, with counts as weights, at the usual five words and 0.8."""
    g = near_duplicate_groups(_records(spark, root), Workspace(spark, "p5"), multiset=True)
    return g.select("id", F.hex("cls").alias("class_id"), "rep", "group_id")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    work = Workspace(spark, "p5")
    return group_pairs(near_duplicate_groups(_records(spark, root), work, threshold=0.5, shingle=3))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return broken_replies(table(spark, root, "chat_history"))


def _batches(spark: SparkSession, root: str) -> DataFrame:
    part = F.lower(F.regexp_replace("domain", r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", ""))
    part = F.when(F.coalesce(part, F.lit("")) == "", "unknown").otherwise(part)
    return table(spark, root, "robust_corpus").select(F.col("sample_id").alias("id"), part.alias("part"), F.col("batch_no").alias("ord"), "text")


def p4_found(spark: SparkSession, root: str, together: int = 3) -> DataFrame:
    """The first load, and then ``together`` batches at a time, are deliveries to the history that the one before has left in its folder.

    A delivery of several batches gives what they give one by one; rows without a number come last.
    """
    path = Workspace(spark, "p4").path("history")
    rows, out = _batches(spark, root), None
    numbers = sorted((r["ord"] for r in rows.select("ord").distinct().collect()), key=lambda x: (x is None, x or 0))
    none, numbers = numbers[-1:] == [None], [n for n in numbers if n is not None]
    parts = [F.col("ord").isin(p) for p in [numbers[:1], *(numbers[i : i + together] for i in range(1, len(numbers), together))] if p]
    for part in parts + [F.col("ord").isNull()] * none:
        rejected = History(spark, path, threshold=0.5, shingle=3).add(rows.where(part)).where("rejected").select(F.col("id").alias("sample_id"))
        out = rejected if out is None else out.unionByName(rejected)
    return out.distinct() if out is not None else rows.select(F.col("id").alias("sample_id")).limit(0)


def p1_neighbours(spark: SparkSession, root: str) -> DataFrame:
    return most_similar(table(spark, root, "chunks"), Workspace(spark, "p1"), limit=None)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """The pairs within 0.25 alone, which need no search of scattered rows."""
    lo, hi = F.least("id", "neighbour"), F.greatest("id", "neighbour")
    return most_similar(table(spark, root, "chunks"), Workspace(spark, "p1"), limit=0.25).select(lo.alias("chunk_lo"), hi.alias("chunk_hi")).distinct()


def p2_pieces(spark: SparkSession, root: str) -> DataFrame:
    docs = one_row_each(table(spark, root, "corpus_docs"), "id", "text", "structure_type")
    return split_documents(docs, table(spark, root, "chunking_config"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return p2_pieces(spark, root).where("piece = 1").select("id")


def p6_clusters(spark: SparkSession, root: str) -> DataFrame:
    return similarity_clusters(table(spark, root, "chunks"), Workspace(spark, "p6"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return p6_clusters(spark, root).select("cluster_id", F.col("id").alias("chunk_id"))


def p7_packing(spark: SparkSession, root: str) -> DataFrame:
    counts = token_counts(table(spark, root, "documents"), "doc_id")
    return pack(counts, "doc_id", Workspace(spark, "p7"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that fill a container of their own and need more: two or more pieces."""
    return p7_packing(spark, root).where("piece = 1").select("doc_id")


def p8_leaks(spark: SparkSession, root: str) -> DataFrame:
    return leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return p8_leaks(spark, root).where("kind = 'verbatim'").select("doc_id", "item_id")


def p9_residue(spark: SparkSession, root: str) -> DataFrame:
    return residue(table(spark, root, "documents"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return p9_residue(spark, root).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p2_pieces, p3_found, p4_found, p5_found, p5_groups, p5_weighted, p6_found, p6_clusters, p7_found, p7_packing, p8_found, p8_leaks, p9_found, p9_residue)}
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
SQL: dict[str, str] = {
    "p2_found": r"""WITH c AS (SELECT lower(trim(structure_type)) AS kind, max_tokens FROM chunking_config), d AS (SELECT DISTINCT id, text, lower(trim(structure_type)) AS kind FROM corpus_docs WHERE text IS NOT NULL)
SELECT DISTINCT id FROM d LEFT JOIN c USING (kind) WHERE len(regexp_extract_all(text, '[^\t\n\x0b\x0c\r\x{85}\p{Z}]+')) > coalesce(max_tokens, (SELECT max_tokens FROM c WHERE kind = 'default'))""",
    "p7_found": r"""SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]+')) > 1024""",
    "p8_found": f"""WITH i AS (SELECT item_id, {WORDS} AS w FROM eval_items), iw AS (SELECT item_id, least(12, len(w)) AS n, w, unnest(range(1, len(w) - least(12, len(w)) + 2)) AS s FROM i WHERE len(w) > 0),
ik AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM iw), ns AS (SELECT DISTINCT n FROM ik), d AS (SELECT doc_id, {WORDS} AS w FROM documents),
dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n) SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM dw) JOIN ik USING (n, k)""",
}
