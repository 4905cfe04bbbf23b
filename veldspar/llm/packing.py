"""Filling containers of fixed capacity, planned on the histogram of lengths."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.session import Workspace

WORD_PUNCT = re.compile(r"\w+|[^\w\s]+")


def word_punct_counter():
    """The public WordPunct rule: runs of letters, digits or underscores, and runs of other non-white-space."""
    return lambda texts: [len(WORD_PUNCT.findall(t)) if t else 0 for t in texts]


def tokenizer_counter(path: str):
    """Counts by the public tokenizer in a file: a ``.model`` of pieces, or a ``.json``."""

    def load():
        if path.endswith(".model"):
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=path)
            return lambda texts: [len(x) for x in p.encode([t or "" for t in texts], num_threads=1)]
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [len(x.ids) for x in t.encode_batch([t or "" for t in texts], add_special_tokens=False)]

    return load


def token_counts(df: DataFrame, key: str, counter=word_punct_counter) -> DataFrame:
    """``(key, tokens)`` of every row, over the whole text; null texts have 0.  ``counter()`` is made once per task."""

    def run(batches):
        count = counter()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count(b.column(1).to_pylist()), pa.int64())], names=["key", "tokens"])

    out = df.select(F.col(key).alias("key"), "text").mapInArrow(run, T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("tokens", T.LongType())]))
    return out.withColumnRenamed("key", key)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows ``(length, first_rank, last_rank, first_container, per_container)``.

    Items of one length are interchangeable, so containers with the same free room are one entry with a count, and a step
    places as many items of a length as fit at once.  Ranks ``first_rank .. last_rank`` of a length go, ``per_container``
    each, to the containers from ``first_container`` on.  The work depends on the number of lengths, not of items.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room -> runs of containers (first, how many)
    rooms: list[int] = []
    out, containers = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room not in free:
            free[room] = []
            insort(room)
        free[room].append((first, n))

    def insort(room: int) -> None:
        from bisect import insort as add

        add(rooms, room)

    from bisect import bisect_left

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                per = capacity // length
                n = -(-left // per)
                full, rest = divmod(left, per)
                out.append((length, rank, rank + left - 1, containers, per))
                if full:
                    put(capacity - per * length, containers, full)
                if rest:
                    put(capacity - rest * length, containers + full, 1)
                containers += n
                left = 0
                continue
            room = rooms[i]
            first, n = free[room].pop()
            if not free[room]:
                del free[room]
                rooms.pop(i)
            per = room // length
            used = min(n, -(-left // per))
            if used < n:
                put(room, first + used, n - used)
            placed = min(left, used * per)
            out.append((length, rank, rank + placed - 1, first, per))
            full, rest = divmod(placed, per)
            if full:
                put(room - per * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            rank += placed
            left -= placed
    return out


def pack(items: DataFrame, key: str, work: Workspace, capacity: int = 1024, salts: int = 256) -> DataFrame:
    """``(key, piece, tokens, container)``: every item of ``(key, tokens)`` in one container, or, where larger, in pieces.

    An item above ``capacity`` fills whole containers of its own (pieces 0, 1, ...), and only its last piece shares one.
    Null or zero tokens need no room: they come out with container null.  Keys must be unique.
    Only the histogram of lengths, at most ``capacity`` numbers, reaches the driver; items take their slots by joining on
    their rank within their length.  Ranks are made per length and salt and offset by the counts, so a length shared by a
    third of all items is ranked in many tasks.
    """
    spark = items.sparkSession
    salt = F.pmod(F.xxhash64(key), F.lit(salts)).cast("int").alias("salt")
    rest = F.pmod(F.col("tokens"), F.lit(capacity))
    base = work.cut(items.select(key, F.coalesce("tokens", F.lit(0)).alias("tokens"), salt), "items")
    whole = F.floor(F.col("tokens") / capacity)
    small = base.where(rest > 0).select(key, "salt", rest.cast("int").alias("length"), whole.alias("piece"))
    counts = small.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    offsets = work.cut(counts.withColumn("offset", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")), "counts")
    histogram = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan(histogram, capacity)
    used = max((c + (b - a) // p + 1 for _, a, b, c, p in slots), default=0)
    table = spark.createDataFrame(slots, "length int, lo bigint, hi bigint, first bigint, per int")
    ranked = small.withColumn("at", F.row_number().over(Window.partitionBy("length", "salt").orderBy(key)) - 1)
    ranked = ranked.join(F.broadcast(offsets.drop("n")), ["length", "salt"]).withColumn("rank", F.col("at") + F.col("offset"))
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & F.col("rank").between(F.col("lo"), F.col("hi")))
    container = F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("per"))
    placed = placed.select(key, "piece", ranked["length"].cast("bigint").alias("tokens"), container.alias("container"))
    # containers of their own: numbered after the planned ones, by running counts per salt
    big = base.where(whole > 0).select(key, "salt", whole.alias("whole"))
    own = big.groupBy("salt").agg(F.sum("whole").alias("n")).withColumn("offset", F.sum("n").over(Window.orderBy("salt")) - F.col("n"))
    run = F.sum("whole").over(Window.partitionBy("salt").orderBy(key)) - F.col("whole")
    alone = big.withColumn("at", run).join(F.broadcast(own.drop("n")), "salt")
    piece = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("piece")
    alone = alone.select(key, piece, F.lit(capacity).cast("bigint").alias("tokens"), (F.col("at") + F.col("offset") + used).alias("start"))
    alone = alone.select(key, "piece", "tokens", (F.col("start") + F.col("piece")).alias("container"))
    empty = base.where("tokens <= 0").select(key, F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("tokens"), F.lit(None).cast("bigint").alias("container"))
    return placed.unionByName(alone).unionByName(empty)
