"""Splitting long texts into pieces at natural boundaries."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# White space as Unicode has it: the property White_Space, with U+0085, U+00A0 and U+3000
TOKEN = regex.compile(r"\P{White_Space}+")
PARAGRAPH = regex.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85\u2028])[^\S\n\r\x0b\x0c\x85\u2028]*(?:\r\n|[\n\r\x0b\x0c\x85\u2028])|\u2029")
LINE = regex.compile(r"[\n\r\x0b\x0c\x85\u2028\u2029]")
SENTENCE = regex.compile(r"[.!?…。！？][\"'”’»)\]]*$")
LEVELS = ("paragraph", "line", "sentence", "hard", "end")


def boundaries(text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    """Sorted token numbers before which a paragraph, a line or a sentence begins."""
    out: list[list[int]] = [[], [], []]
    for i in range(1, len(spans)):
        s, e = spans[i - 1][1], spans[i][0]
        gap = text[s:e]
        if PARAGRAPH.search(gap):
            out[0].append(i)
        elif LINE.search(gap):
            out[1].append(i)
        elif SENTENCE.search(text[max(spans[i - 1][0], s - 12) : s]):
            out[2].append(i)
    return out


def cuts(n: int, limit: int, overlap: int, bounds: list[list[int]]) -> list[tuple[int, int, str]]:
    """Pieces ``(first token, one past the last, kind of cut)`` of at most ``limit`` tokens.

    Each piece after the first starts ``overlap`` tokens before the end of the one before.  A piece ends at the last
    paragraph that begins within the limit, else the last line, else the last sentence, else at the limit itself; a
    boundary counts only where the piece gets beyond its overlap, so every piece brings new tokens.
    """
    limit = max(1, limit)
    overlap = min(max(0, overlap), limit - 1)
    out, start = [], 0
    while True:
        end = start + limit
        if end >= n:
            out.append((start, n, "end"))
            return out
        floor, kind = start + overlap if out else start, "hard"
        for level, b in zip(LEVELS, bounds):
            k = bisect_right(b, end) - 1
            if k >= 0 and b[k] > floor:
                end, kind = b[k], level
                break
        out.append((start, end, kind))
        start = end - overlap


def _split(batches):
    for b in batches:
        rows: dict[str, list] = {k: [] for k in ("id", "piece", "first_token", "tokens", "cut", "text", "total")}
        for key, text, limit, overlap in zip(*(b.column(i).to_pylist() for i in range(4))):
            spans = [m.span() for m in TOKEN.finditer(text or "")]
            if not spans:
                continue
            limit = len(spans) if limit is None else limit
            pieces = cuts(len(spans), limit, overlap or 0, boundaries(text, spans) if len(spans) > max(1, limit) else [[], [], []])
            for i, (s, e, kind) in enumerate(pieces):
                for k, v in zip(rows, (key, i, s, e - s, kind, text[spans[s][0] : spans[e - 1][1]], len(spans))):
                    rows[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["id"], pa.string()), *(pa.array(rows[k], pa.int32()) for k in ("piece", "first_token", "tokens")), pa.array(rows["cut"], pa.string()), pa.array(rows["text"], pa.string()), pa.array(rows["total"], pa.int32())],
            names=["id", "piece", "first_token", "tokens", "cut", "text", "total"],
        )


def split_documents(docs: DataFrame, config: DataFrame) -> DataFrame:
    """``(id, piece, first_token, tokens, cut, text, total)`` of ``docs(id, text, structure_type)``.

    Tokens are maximal runs of non-white-space characters; a piece is the text from its first to its last token, with all
    white space between.  ``config`` is a small table by ``structure_type`` (trimmed, lower-cased); a null, empty or unlisted
    type takes the row ``default``.  Texts within the limit come out as one piece; null or blank texts have none.
    Where there is no config row at all, texts stay whole; a limit below 1 counts as 1 and an overlap at or above the limit
    as one less than the limit.  A repeated id must be reduced to one row before.
    """
    kind = lambda c: F.lower(F.regexp_replace(c, r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$", ""))
    conf = config.groupBy(kind(F.col("structure_type")).alias("kind")).agg(F.min(F.struct("max_tokens", "overlap_tokens")).alias("c"))
    other = conf.where("kind = 'default'").select(F.col("c").alias("d"))
    keyed = docs.select("id", "text", kind(F.col("structure_type")).alias("kind")).join(conf, "kind", "left").join(other, F.lit(True), "left")
    c = F.coalesce("c", "d")
    return keyed.select("id", "text", c["max_tokens"].alias("m"), c["overlap_tokens"].alias("o")).mapInArrow(
        _split, "id string, piece int, first_token int, tokens int, cut string, text string, total int"
    )
