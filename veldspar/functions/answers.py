"""Answers of models and decision services, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unfenced(x: Column) -> Column:
    """The text inside a code fence, or all of it."""
    inner = F.regexp_extract(x, r"(?s)```(?:[A-Za-z]+)?\s*(.*?)\s*```", 1)
    return F.trim(F.when(inner != "", inner).otherwise(x))


def parsed(x: Column, schema: str) -> Column:
    """JSON of a model's answer, null where it is none."""
    return F.from_json(unfenced(x), schema)


def yes_or_no(answer: Column, probability: Column) -> Column:
    """``yes`` or ``no`` of a decision, from the probability where there is one."""
    said = F.lower(F.trim(answer)).isin("yes", "true", "1")
    return F.when(F.coalesce(probability >= 0.5, said, F.lit(False)), "yes").otherwise("no")


# Capitalised words that are no entities; results must match
ENTITY_STOP = tuple("the a an of and or in on at to for with by as is are was were be been being it its this that these those".split())


def entity_words(x: Column) -> Column:
    """Capitalised words of ASCII letters with lower-case ones after the first, in order and with repeats; stop words left out."""
    words = F.regexp_extract_all(x, F.lit(r"(?U)\b([A-Za-z][a-z]*)\b"), F.lit(1))
    stop = F.array(*[F.lit(w) for w in ENTITY_STOP])
    return F.filter(words, lambda w: w.rlike("^[A-Z]") & ~F.array_contains(stop, F.lower(w)))


def entities(x: Column) -> Column:
    """The same, each once whatever its case, as it comes first."""
    found = entity_words(x)
    low = F.transform(found, F.lower)
    return F.filter(found, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)


def decided(kind: Column, choice: Column, score: Column, probability: Column) -> Column:
    """The answer of a decision service, as text: a choice as it is, a score as its number, and yes or no by a probability of a half."""
    return F.when(kind == "choice", choice).when(kind == "score", score.cast("string")).otherwise(F.when(F.coalesce(probability, F.lit(0.0)) >= 0.5, "yes").otherwise("no"))


def probabilities(probability: Column) -> Column:
    """Those of yes and no, rounded to four digits."""
    p = F.coalesce(probability, F.lit(0.0))
    return F.struct(F.round(p, 4).alias("yes"), F.round(1 - p, 4).alias("no"))


def prompt(context: Column, query: Column) -> Column:
    """What a model is asked with a context."""
    # The lines of the prompt; results must match
    lines = (
        "You are given retrieved knowledge chunks with confidence labels.",
        "HIGH confidence means well-established evidence.",
        "MEDIUM confidence means some ambiguity remains.",
        "LOW confidence means the evidence is contested or broad.",
        "Answer using the evidence proportionally to its confidence.",
    )
    return F.concat(F.lit("\n".join(lines) + "\n\n"), context, F.lit("\n\nQUERY: "), query)
