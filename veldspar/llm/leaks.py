"""Evaluation texts that occur in training texts, verbatim or with other names and numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.common import GOLDEN, WordHashes, mix, window_hashes, words

# Words that measure something
UNITS = frozenset(
    "cases centimetres cm cycles days degrees entries euros grams hours kg kilometres kilograms km litres metres miles "
    "milligrams millimetres minutes mm months pages percent pounds samples seconds steps units visits weeks years".split()
)
WINDOW = 12
MOST_BROADCAST = 2_000_000
MOST_COMMON = 20_000_000
NUMBER, NAME, UNIT = np.uint64(1), np.uint64(2), np.uint64(3)


class Templates:
    """Typed placeholders for the words of a text: numbers, units, and names.

    A word is a name unless it is common to the evaluation set, that is, in at least two of its items; ``common`` has the sorted hashes of these.  The type
    depends on the lower-cased word alone, so equal passages have equal templates whatever their letter case.
    """

    def __init__(self, common: np.ndarray):
        self.common = common
        self.hashes = WordHashes()
        self.seen: dict[str, int] = {}

    def kind(self, w: str, h: int) -> int:
        if any(c.isdigit() for c in w):
            return 1
        if w in UNITS:
            return 3
        at = int(np.searchsorted(self.common, np.uint64(h)))
        return 0 if at < len(self.common) and int(self.common[at]) == h else 2

    def __call__(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes, and the same with placeholders."""
        exact = self.hashes(tokens)
        if len(self.seen) > 500_000:
            self.seen.clear()
        for t in set(tokens):
            if t not in self.seen:
                self.seen[t] = self.kind(t, self.hashes.seen[t])
        kinds = np.fromiter((self.seen[t] for t in tokens), np.uint64, len(tokens))
        return exact, np.where(kinds == 0, exact, kinds)


class Windows:
    """All windows of some items, each different one once, by template; with the items that hold it.

    ``keys`` are sorted hashes of template and words together, by which an equal window is found at once; ``open`` are the sorted templates of
    the windows that other values can fill: at least 8 words, of which at most half are slots.
    """

    def __init__(self, items: list[tuple[int, str | None]], window: int, templates: Templates):
        rows: dict[tuple[int, int], tuple] = {}
        for key, text in items:
            tokens = words(text)
            n = min(window, len(tokens))
            if n == 0:
                continue
            exact, typed = templates(tokens)
            names, both = hashed(exact, typed, n)
            for i, (t, k) in enumerate(zip(names.tolist(), both.tolist())):
                rows.setdefault((k, n), (t, exact[i : i + n], typed[i : i + n] < 4, []))[3].append(key)
        order = sorted(rows)
        self.lengths = sorted({n for _, n in rows})
        self.keys = np.array([k for k, _ in order], np.uint64)
        self.exact, self.slots = [rows[o][1] for o in order], [rows[o][2] for o in order]
        self.items = [sorted(set(rows[o][3])) for o in order]
        fill = [(rows[o][0], i) for i, o in enumerate(order) if o[1] >= 8 and 2 * rows[o][2].sum() <= o[1]]
        fill.sort()
        self.open, self.place = np.array([t for t, _ in fill], np.uint64), [i for _, i in fill]


def hashed(exact: np.ndarray, typed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of ``n`` words: the hash of its template, and of its template and words."""
    names = mix(window_hashes(typed, n) ^ np.uint64(n))
    return names, mix(names * np.uint64(3) ^ window_hashes(exact, n))


def consistent(item: np.ndarray, doc: np.ndarray, slots: np.ndarray) -> bool:
    """Whether each slot value of the item stands for one value of the document, and the other way round."""
    a, b = item[slots], doc[slots]
    pairs = set(zip(a.tolist(), b.tolist()))
    return len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


def _scan(windows: Windows, common: np.ndarray, key_type: pa.DataType, item_type: pa.DataType):
    def run(batches):
        templates = Templates(common)
        for b in batches:
            keys = b.column(0)
            texts = [words(t) for t in b.column(1).to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            exact, typed = templates([w for t in texts for w in t])
            doc = np.repeat(np.arange(len(texts)), sizes)
            best: dict[tuple[int, object], str] = {}
            for n in windows.lengths:
                if len(typed) < n:
                    continue
                names, both = hashed(exact, typed, n)
                inside = doc[: len(names)] == doc[n - 1 :]
                if len(windows.open):  # other values in the slots of a template
                    lo, hi = (np.searchsorted(windows.open, names, side) for side in ("left", "right"))
                    for p in np.flatnonzero(inside & (lo < hi)).tolist():
                        for i in windows.place[lo[p] : hi[p]]:
                            if len(windows.exact[i]) == n and consistent(windows.exact[i], exact[p : p + n], windows.slots[i]):
                                for item in windows.items[i]:
                                    best.setdefault((int(doc[p]), item), "parameters")
                at = np.minimum(np.searchsorted(windows.keys, both), len(windows.keys) - 1)
                for p in np.flatnonzero(inside & (windows.keys[at] == both)).tolist():
                    if np.array_equal(windows.exact[at[p]], exact[p : p + n]):
                        for item in windows.items[at[p]]:
                            best[int(doc[p]), item] = "verbatim"
            docs, items = [d for d, _ in best], [i for _, i in best]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(docs, pa.int64())), pa.array(items, item_type), pa.array(list(best.values()), pa.string())], names=["doc_id", "item_id", "kind"])

    return run


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, common: int = 2) -> DataFrame:
    """``(doc_id, item_id, kind)``: the documents that contain ``window`` words in a row of an item, or all of a shorter item.

    ``docs(doc_id, text)``, ``items(item_id, text)``.  Words become templates, in which numbers, units and names are typed placeholders, and the templates' windows are
    joined by hash.  A hit is ``verbatim`` if all words are equal, and ``parameters`` if the slots differ but consistently,
    one value for each value in both directions, in a window of at least 8 words of which at most half are slots.  Null or wordless texts and items match nothing; null ids pass through as
    null.  Repeated documents under other ids come out under each.
    Evaluation windows are broadcast if they are at most two million; the set is read in blocks of that size beyond, each
    matched against all documents, so documents are never shuffled.  Words in at least ``common`` items are held as eight bytes each by every task; more than
    twenty million of them are an error, never a shorter list.
    """
    spark = docs.sparkSession
    out = None
    total = items.select(F.sum(F.length("text"))).first()[0] or 0  # windows are fewer than characters
    blocks = max(1, -(-total // MOST_BROADCAST))
    frequent = items.select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("w")).groupBy("w").agg(F.countDistinct("item_id").alias("n"))
    known = [r["w"] for r in frequent.where(F.col("n") >= common).select("w").limit(MOST_COMMON + 1).collect()]
    if len(known) > MOST_COMMON:
        raise ValueError(f"more than {MOST_COMMON} words are common to the evaluation set")
    known = np.sort(WordHashes(len(known) + 1)(known))
    key_type = T_ARROW[docs.schema["doc_id"].dataType.typeName()]
    item_type = T_ARROW[items.schema["item_id"].dataType.typeName()]
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    for k in range(blocks):
        part = [(r["item_id"], r["text"]) for r in items.where(block == k).select("item_id", "text").collect()]
        windows = Windows(part, window, Templates(known))
        schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, kind string"
        found = docs.select("doc_id", "text").mapInArrow(_scan(windows, known, key_type, item_type), schema)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


# Arrow types of key columns
T_ARROW = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string()}
