"""Queries that clean, split, describe and deduplicate texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.catalog.registry import query, rounded
from veldspar.functions import answers
from veldspar.functions import text as X
from veldspar.operators import encoding, etl, evaluation, store
from veldspar.session import table


def docs(spark, root):
    return table(spark, root, "documents")


def sql_chain(x: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


def measured(name: str, expression: str) -> str:
    return f"SELECT doc_id, length({expression}) AS n, md5({expression}) AS {name} FROM documents WHERE text IS NOT NULL"


def measure(spark, root, name, f):
    return docs(spark, root).where("text is not null").select("doc_id", F.length(f(F.col("text"))).cast("bigint").alias("n"), F.md5(f(F.col("text"))).alias(name))


# the entities that occur in the data, since SQL has no function for all of them
ENTITIES = (("&nbsp;", chr(160)), ("&quot;", '"'), ("&#39;", "''"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&eacute;", "é"), ("&auml;", "ä"), ("&ouml;", "ö"), ("&uuml;", "ü"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def sql_steps(x: str, steps) -> str:
    for pattern, by in steps:
        x = f"regexp_replace({x}, '{pattern}', " + {"\n": "chr(10)"}.get(by, f"'{by}'") + ", 'g')"
    return x


def sql_entities(x: str) -> str:
    for entity, by in ENTITIES:
        x = f"replace({x}, '{entity}', '{by}')"
    return x


@query(measured("cleaned", sql_entities(sql_steps("text", X.HTML_STEPS))))
def html_strip(spark, root):
    return measure(spark, root, "cleaned", X.strip_html)


@query(measured("cleaned", sql_steps("text", X.TIMESTAMP_STEPS)))
def timestamp_strip(spark, root):
    return measure(spark, root, "cleaned", X.strip_timestamps)


@query(measured("cleaned", sql_steps("text", X.PAGE_STEPS)))
def page_mark_strip(spark, root):
    return measure(spark, root, "cleaned", X.strip_page_marks)


@query(measured("cleaned", sql_steps("text", ((r"([a-zA-Z]{2,})-\n\s*([a-zA-Z]{2,})", r"\1\2"),))))
def hyphen_join(spark, root):
    return measure(spark, root, "cleaned", X.join_hyphens)


STRIP = "regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


@query(measured("cleaned", STRIP.format(sql_steps("text", ((r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"))).replace("'\n\n'", "chr(10) || chr(10)"))))
def whitespace_tidy(spark, root):
    return measure(spark, root, "cleaned", X.tidy_space)


LINES = f"list_filter(list_transform(str_split(p, chr(10)), lambda l: {STRIP.format('l')}), lambda l: l <> '')"
UNWRAPPED = f"""array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\\n{{2,}}'), lambda p: array_to_string(list_transform({LINES}, lambda l, i:
 CASE WHEN i = 1 THEN '' WHEN regexp_matches(l, '{X.HEADER_LINE}') OR regexp_matches(l, '{X.LIST_LINE}') OR regexp_matches(({LINES})[i - 1], '{X.HEADER_LINE}') THEN chr(10) ELSE ' ' END || l), '')), lambda p: p <> ''), chr(10) || chr(10))"""


@query(measured("cleaned", UNWRAPPED))
def soft_unwrap(spark, root):
    return measure(spark, root, "cleaned", X.unwrap_lines)


@query()
def clean_full(spark, root):
    """All stages of cleaning, Unicode and soft wraps included."""
    return measure(spark, root, "cleaned", X.clean)


@query("WITH s AS (SELECT doc_id, list_filter(str_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> '') AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(s) AS n, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM s")
def sentence_counts(spark, root):
    s = docs(spark, root).where("text is not null").select("doc_id", X.sentences(F.col("text")).alias("s"))
    longest = F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("bigint")
    return s.select("doc_id", F.size("s").cast("bigint").alias("n"), longest.alias("longest"))


@query("SELECT doc_id, lower(regexp_replace(regexp_replace(title, '[^\\p{L}\\p{N}_]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM documents WHERE title IS NOT NULL")
def slugs(spark, root):
    return docs(spark, root).where("title is not null").select("doc_id", X.slug(F.col("title")).alias("slug"))


@query(f"""WITH f AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda l: {STRIP.format('l')}), lambda l: l <> '')[1] AS l FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, l, trim(regexp_extract(l, '^#+\\s+(.+)$', 1)) AS h FROM f)
SELECT doc_id, CASE WHEN h <> '' THEN h WHEN length(l) < 80 AND NOT regexp_matches(l, '[.:;]$') THEN l END AS title FROM h""")
def title_infer(spark, root):
    return docs(spark, root).where("text is not null").select("doc_id", X.title(F.col("text")).alias("title"))


@query("SELECT doc_id, sha256(text) AS fingerprint FROM documents WHERE text IS NOT NULL")
def fingerprints(spark, root):
    return docs(spark, root).where("text is not null").select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"))


@query("WITH t AS (SELECT doc_id, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ' ') AS t FROM documents) SELECT min(doc_id) AS doc_id, md5(t) AS text FROM t WHERE t <> '' GROUP BY t")
def exact_text_dedupe(spark, root):
    return store.first_of_equal_texts(docs(spark, root), "doc_id").select("doc_id", F.md5("text").alias("text"))


@query("WITH r AS (SELECT chunk_id, ingest_seq, document_id, md5(text) AS text, row_number() OVER (PARTITION BY chunk_id ORDER BY ingest_seq DESC) AS n FROM chunks) SELECT chunk_id, ingest_seq, document_id, text FROM r WHERE n = 1")
def upsert_latest(spark, root):
    rows = table(spark, root, "chunks").select("chunk_id", "ingest_seq", "document_id", F.md5("text").alias("text"))
    return store.latest(rows, "chunk_id", "ingest_seq")


ENTROPY = """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda t: t <> '') AS w FROM documents),
c AS (SELECT doc_id, t, count(*) AS c, any_value(n) AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM w) GROUP BY doc_id, t), e AS (SELECT doc_id, -sum(c / n * log2(c / n)) AS e FROM c GROUP BY doc_id),
a AS (SELECT doc_id, round(coalesce(e, 0), 6) + 0.0 AS entropy FROM w LEFT JOIN e USING (doc_id))"""


@query(ENTROPY + " SELECT doc_id, entropy, CASE WHEN entropy < 2.5 THEN 'low' WHEN entropy < 4 THEN 'medium' ELSE 'high' END AS bucket FROM a")
def lexical_entropy(spark, root):
    e = docs(spark, root).select("doc_id", rounded(evaluation.token_entropy(F.col("text"))).alias("entropy"))
    return e.withColumn("bucket", evaluation.ambiguity(F.col("entropy")))


@query("SELECT id, max(length(text))::BIGINT AS char_count, max(greatest(1, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''))))::BIGINT AS token_estimate FROM corpus_docs WHERE text IS NOT NULL GROUP BY id")
def corpus_counts(spark, root):
    rows = table(spark, root, "corpus_docs").where("text is not null")
    n = F.greatest(F.lit(1), F.size(X.words(F.col("text"))))
    return rows.groupBy("id").agg(F.max(F.length("text")).cast("bigint").alias("char_count"), F.max(n).cast("bigint").alias("token_estimate"))


def corpus(spark, root):
    rows = table(spark, root, "corpus_docs").groupBy("id").agg(F.min("text").alias("text"))
    return rows.where("text is not null")


@query()
def chunk_documents(spark, root):
    return etl.chunks(corpus(spark, root), "id").select("chunk_id", "document_id", "chunk_index", F.md5("text").alias("text"))


@query()
def structure_documents(spark, root):
    return etl.structured(corpus(spark, root), "id").select("id", "part_id", "section_number", "structure_type", "title", F.md5("text").alias("text"))


@query()
def ingest_documents(spark, root):
    """Raw texts cleaned and then structured."""
    return etl.ingested(corpus(spark, root), "id").select("id", "part_id", "section_number", "structure_type", "title", F.md5("text").alias("text"))


@query("""WITH l AS (SELECT id, min(text) AS text FROM corpus_docs GROUP BY id), h AS (SELECT id, regexp_extract_all(text, '(?m)^(#{1,4})\\s+(.+)$', 2) AS t FROM l WHERE text IS NOT NULL AND trim(text) <> '')
SELECT id, len(t) AS headings, coalesce(t[1], '') AS first_heading FROM h WHERE len(t) >= 2""")
def markdown_headings(spark, root):
    hs = F.regexp_extract_all("text", F.lit(f"(?d){etl.MARKDOWN}"), F.lit(2))
    out = corpus(spark, root).where(F.trim("text") != "").select("id", hs.alias("t")).where(F.size("t") >= 2)
    return out.select("id", F.size("t").cast("bigint").alias("headings"), F.element_at("t", 1).alias("first_heading"))


@query()
def markdown_breadcrumbs(spark, root):
    return etl.markdown_sections(corpus(spark, root), "id").select("id", "section", "level", "heading", "breadcrumb")


@query("WITH l AS (SELECT id, min(text) AS text FROM corpus_docs GROUP BY id), x AS (SELECT id, unnest(str_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) AS line FROM l WHERE text IS NOT NULL) SELECT id, count(*) FILTER (regexp_matches(line, '^#{1,6}\\s+\\S')) AS headings, count(*) AS n FROM x GROUP BY id")
def heading_counts(spark, root):
    ls = etl.lines(corpus(spark, root), "id")
    return ls.groupBy("id").agg(F.count_if(F.col("line").rlike(r"^#{1,6}\s+\S")).alias("headings"), F.count(F.lit(1)).alias("n"))


@query("""WITH w AS (SELECT item_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS w FROM eval_items),
u AS (SELECT item_id, w, unnest(w) AS t, unnest(range(len(w))) AS i FROM w), d AS (SELECT item_id, string_agg(t, ' ' ORDER BY i) AS deduped FROM (SELECT item_id, t, min(i) AS i FROM u GROUP BY ALL) GROUP BY item_id)
SELECT item_id, text AS whole, lower(array_to_string(w, ' ')) AS normalised, array_to_string(w[1:greatest(1, len(w) // 2)], ' ') AS shorter, array_to_string(w[1:32], ' ') AS head,
 array_to_string(w[greatest(1, len(w) - 31):], ' ') AS tail, coalesce(deduped, '') AS deduped, array_to_string(list_reverse(w[1:64]), ' ') AS reversed FROM w LEFT JOIN d USING (item_id)""")
def text_views(spark, root):
    v = encoding.views(F.col("text"))
    names = ("whole", "normalised", "shorter", "head", "tail", "deduped", "reversed")
    return table(spark, root, "eval_items").select("item_id", *[v[i].alias(n) for i, n in enumerate(names)])


ENTITY = ", ".join(f"'{w}'" for w in answers.ENTITY_STOP)


@query(f"""WITH r AS (SELECT item_id, regexp_extract_all(text, '\\b([A-Za-z][a-z]*)\\b', 1) AS w FROM eval_items), u AS (SELECT item_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM r),
k AS (SELECT item_id, arg_min(w, i) AS w, min(i) AS i FROM u WHERE w ~ '^[A-Z].*' AND lower(w) NOT IN ({ENTITY}) GROUP BY item_id, lower(w)), s AS (SELECT item_id, string_agg(w, ' ' ORDER BY i) AS e FROM k GROUP BY item_id)
SELECT item_id, coalesce(e, '') AS entities FROM eval_items LEFT JOIN s USING (item_id)""")
def entity_tokens(spark, root):
    return table(spark, root, "eval_items").select("item_id", F.array_join(answers.entities(F.col("text")), " ").alias("entities"))
