"""From documents to sections and chunks."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veldspar.functions import text as X

# Headings of numbered sections and of Markdown, and openings of questions and answers; results must match
NUMBERED = r"(?m)^(?:#{1,3}\s*)?(?:(Law|Rule|Section|Chapter|Article|Item)\s+([0-9IVXLCDM]+)(?:[:.\s-]+([^\n]+))?)"
QUESTION = r"(?is)(?:^|\n+)(?:Q(?:uestion)?[:.]\s*(.*?))\s*\n+(?:A(?:nswer)?[:.]\s*(.*?))(?=(?:\n+Q(?:uestion)?[:.]|\Z))"
MARKDOWN = r"(?m)^(#{1,4})\s+(.+)$"
HEADING = r"^(#{1,6})\s+(.+)$"


def lines(df: DataFrame, key: str) -> DataFrame:
    """``(key, line_no, line)``."""
    return df.select(key, F.posexplode(F.split(X.newlines(F.col("text")), "\n")).alias("line_no", "line"))


def markdown_sections(df: DataFrame, key: str) -> DataFrame:
    """``(key, section, level, heading, breadcrumb, body)``: the texts under headings, with the headings they stand under.

    Text before the first heading is a section of level 0 with a null heading if it isn't blank; sections without text are left out.
    A text is folded as one array, so its lines need not be shuffled.
    """
    each = df.select(key, F.split(X.newlines(F.col("text")), "\n").alias("ls"))
    level = lambda x: F.length(F.regexp_extract(x, HEADING, 1))
    marks = F.filter(F.transform("ls", lambda x, i: F.struct(i.alias("i"), level(x).alias("level"), F.trim(F.regexp_extract(x, HEADING, 2)).alias("title"))), lambda s: s["level"] > 0)
    each = each.withColumn("ms", F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("title"))), marks))
    at = each.select(key, "ls", "ms", F.posexplode("ms").alias("section", "m"))
    stop = F.coalesce(F.try_element_at("ms", F.col("section") + 2)["i"], F.size("ls"))
    body = F.trim(F.array_join(F.slice("ls", F.col("m.i") + 2, F.greatest(stop - F.col("m.i") - 1, F.lit(0))), "\n"))
    # a heading stands under the last one before it of each lower level with none lower still in between
    before = F.slice("ms", F.lit(1), F.col("section") + 1)
    stack = F.aggregate(
        before,
        F.slice("ms", 1, 0),
        lambda s, h: F.concat(F.filter(s, lambda x: x["level"] < h["level"]), F.array(h)),
    )
    crumb = F.array_join(F.transform(F.filter(stack, lambda x: x["title"].isNotNull()), lambda x: x["title"]), " > ")
    return at.select(key, "section", F.col("m.level").alias("level"), F.col("m.title").alias("heading"), crumb.alias("breadcrumb"), body.alias("body")).where("body <> ''")


PART = T.StructType(
    [T.StructField(n, k) for n, k in (("part_id", T.StringType()), ("section_number", T.IntegerType()), ("structure_type", T.StringType()), ("title", T.StringType()), ("text", T.StringType()), ("metadata", T.MapType(T.StringType(), T.StringType())))]
)


def _between(pattern: str, text: str) -> list[tuple[re.Match, str]]:
    """Each heading with the text up to the next; none if there are fewer than two."""
    found = list(re.finditer(pattern, text))
    ends = [m.start() for m in found[1:]] + [len(text)]
    return [(m, text[m.end() : e].strip()) for m, e in zip(found, ends)] if len(found) > 1 else []


def numbered_parts(text: str, prefix: str) -> list[tuple]:
    out = []
    for i, (m, body) in enumerate(_between(NUMBERED, text)):
        kind, number, name = m[1], m[2], (m[3] or "").strip()
        whole = f"{kind} {number}: {name}" if name else f"{kind} {number}"
        if body:
            out.append((f"{prefix}-{number.lower()}", int(number) if number.isdigit() else i + 1, "numbered_section", whole, f"{whole}\n\n{body}", {"section_type": kind.lower(), "section_raw_number": number}))
    return out


def question_parts(text: str, prefix: str) -> list[tuple]:
    found = [(q.strip(), a.strip()) for q, a in re.findall(QUESTION, text)]
    if len(found) < 2:
        return []
    short = lambda q: q if len(q) <= 80 else q[:77] + "..."
    return [(f"{prefix}-qa-{i}", i, "qa_pair", short(q), f"Question: {q}\nAnswer: {a}", {"question": q}) for i, (q, a) in enumerate(found, 1) if q and a]


def markdown_parts(text: str, prefix: str) -> list[tuple]:
    out = []
    for i, (m, body) in enumerate(_between(MARKDOWN, text), 1):
        name = m[2].strip()
        if body:
            slug = re.sub(r"\W+", "-", name).strip("-").lower()
            out.append((f"{prefix}-{slug or i}", i, "markdown_section", name, f"{name}\n\n{body}", {"heading_level": str(len(m[1]))}))
    return out


def chunk_title(chunk: str, other: str) -> str:
    """The first sentence if it is short, else the first eight words."""
    first = re.split(r"[.!?\n]", chunk)[0].strip()
    return (first if len(first) < 60 else " ".join(chunk.split()[:8]) + "...") or other


def chunk_parts(text: str, prefix: str, title: str, most: int, overlap: int) -> list[tuple]:
    return [(f"{prefix}-part-{i + 1}", i + 1, "semantic_chunk", chunk_title(c, f"{title} Part {i + 1}"), c, {"chunk_index": str(i)}) for i, c in enumerate(split_chunks(text, most, overlap))]


def _title(text: str) -> str | None:
    first = next((x.strip() for x in text.splitlines() if x.strip()), "")
    heading = re.match(r"^#+\s+(.+)$", first)
    return heading[1].strip() if heading else first if first and len(first) < 80 and first[-1] not in ".:;" else None


def _parts(df: DataFrame, key: str, f) -> DataFrame:
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *PART.fields])

    def run(batches):
        arrow = to_arrow_schema(schema)
        for b in batches:
            rows = [(k, *p) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t and t.strip() for p in f(str(k), t)]
            cols = list(zip(*rows)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array([list(x.items()) for x in c] if n == "metadata" else list(c), t) for n, t, c in zip(arrow.names, arrow.types, cols)], schema=arrow)

    return df.select(key, "text").mapInArrow(run, schema)


def numbered_sections(df: DataFrame, key: str) -> DataFrame:
    """``(key, part_id, section_number, structure_type, title, text, metadata)`` of texts with at least two headings such as ``Rule 3`` or ``## Chapter IV``; sections without text are left out."""
    return _parts(df, key, lambda k, t: numbered_parts(t, k))


def question_pairs(df: DataFrame, key: str) -> DataFrame:
    """The same of texts with at least two pairs of ``Q: ...`` and ``A: ...``."""
    return _parts(df, key, lambda k, t: question_parts(t, k))


def split_chunks(text: str | None, most: int = 128, overlap: int = 16, least: int = 10) -> list[str]:
    """Paragraphs, then sentences packed up to ``most`` words; a chunk that follows one in its paragraph opens with its last words.

    A sentence is never cut, and a chunk of fewer than ``least`` words joins the one before.
    """
    out: list[str] = []
    for paragraph in re.split(r"\n{2,}", text or ""):
        held: list[str] = []
        count = 0
        for sentence in re.split(r"(?<=[.!?])\s+", paragraph.strip()):
            n = len(sentence.split())
            if not n:
                continue
            if held and count + n > most:
                out.append(" ".join(held))
                tail = " ".join(held).split()[-overlap:] if overlap > 0 else []
                held, count = ([" ".join(tail)] if tail else []), len(tail)
            held.append(sentence)
            count += n
        if held:
            out.append(" ".join(held))
    merged: list[str] = []
    for c in out:
        if merged and len(c.split()) < least:
            merged[-1] += " " + c
        else:
            merged.append(c)
    return merged


def chunks(df: DataFrame, key: str, most: int = 128, overlap: int = 16, least: int = 10) -> DataFrame:
    """``(chunk_id, document_id, chunk_index, text)`` of ``(key, text)``; null and blank texts give none."""

    def run(batches):
        for b in batches:
            ids, no, texts = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, c in enumerate(split_chunks(t, most, overlap, least)):
                    ids.append(k)
                    no.append(i)
                    texts.append(c)
            yield pa.RecordBatch.from_arrays([pa.array([f"{k}-chunk-{i}" for k, i in zip(ids, no)], pa.string()), pa.array(ids, pa.string()), pa.array(no, pa.int32()), pa.array(texts, pa.string())], names=["chunk_id", "document_id", "chunk_index", "text"])

    return df.select(F.col(key).cast("string"), "text").mapInArrow(run, "chunk_id string, document_id string, chunk_index int, text string")


def structured(df: DataFrame, key: str, most: int = 150, overlap: int = 20) -> DataFrame:
    """Each document of ``(key, text)`` by the first structure that it has: numbered sections, questions, Markdown headings, or chunks.

    ``(key, part_id, section_number, structure_type, title, text, metadata)``; ids start with the key, and the metadata have the document's title as ``corpus_title``.
    One pass over the texts without a shuffle; null and blank texts give none.
    """

    def parts(k: str, text: str) -> list[tuple]:
        title = _title(text) or "Document"
        out = numbered_parts(text, k) or question_parts(text, k) or markdown_parts(text, k) or chunk_parts(text, k, title, most, overlap)
        return [(*p[:5], {"corpus_title": title, **p[5]}) for p in out]

    return _parts(df, key, parts)


def ingested(df: DataFrame, key: str, most: int = 150, overlap: int = 20) -> DataFrame:
    """Raw texts cleaned and structured: ``structured`` of ``X.clean``."""
    return structured(df.select(key, X.clean(F.col("text")).alias("text")), key, most, overlap)
