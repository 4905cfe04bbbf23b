"""A taxonomy over vectors: spherical k-means, a tree of topics and leaves, secondary leaves, labels and routing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veldspar.functions import vectors as V
from veldspar.operators.lexical import ranked
from veldspar.session import Workspace

MARGIN = 0.025
MOST_LEAVES = 20_000


def assign(rows: DataFrame, centroids: DataFrame, key: str, vector: str = "mu", top: int | None = None) -> DataFrame:
    """``(key, leaf, similarity, rank)``: the ``top`` leaves of each row by cosine, or every one; null similarities of zero vectors come last.

    Centroids, in blocks of at most 20,000, are compared with each batch of rows as one matrix product; nothing is shuffled unless there are several blocks.
    """
    n = centroids.count()
    blocks = max(1, -(-n // MOST_LEAVES))
    leaf = centroids.schema["leaf"].dataType
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("leaf", leaf), T.StructField("similarity", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    out = None
    for b in range(blocks):
        part = centroids.select("leaf", "centroid").where(F.pmod(F.xxhash64("leaf"), F.lit(blocks)) == b).orderBy("leaf").collect()
        run = _assign([r["leaf"] for r in part], [r["centroid"] for r in part], top, schema)
        found = rows.where(F.col(vector).isNotNull()).select(key, V.doubles(vector).alias("x")).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if blocks == 1 else ranked(out.drop("rank"), [key], [F.desc_nulls_last("similarity"), "leaf"], top)


def _assign(leaves: list, centroids: list, top: int | None, schema: T.StructType):
    arrow = to_arrow_schema(schema)

    def run(batches):
        if not leaves:
            return
        c = np.array(centroids, float)
        norm = np.sqrt((c * c).sum(axis=1))
        c = np.where(norm[:, None] > 0, c / np.where(norm, norm, 1)[:, None], np.nan)
        k = min(top or len(leaves), len(leaves))
        for b in batches:
            fits = np.flatnonzero(np.asarray(b.column(1).value_lengths()) == c.shape[1])
            x = b.column(1).take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, c.shape[1])
            size = np.sqrt((x * x).sum(axis=1))
            s = np.where(size[:, None] > 0, x / np.where(size, size, 1)[:, None], np.nan) @ c.T
            order = np.argsort(np.where(np.isnan(s), np.inf, -s), axis=1, kind="stable")[:, :k]
            at = np.repeat(fits, k)
            value = np.take_along_axis(s, order, axis=1).reshape(-1)
            flat = order.reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), pa.array(leaves, arrow.field(1).type).take(pa.array(flat)), pa.array(value, mask=np.isnan(value)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(fits)))], schema=arrow
            )

    return run


def memberships(ranks: DataFrame, key: str, margin: float = MARGIN) -> DataFrame:
    """The best leaf of each row, and the second where it is no more than ``margin`` less similar."""
    best = F.max("similarity").over(Window.partitionBy(key))
    return ranks.where("rank <= 2").withColumn("best", best).where((F.col("rank") == 1) | (F.col("similarity") >= F.col("best") - margin)).select(key, "leaf", (F.col("rank") == 1).alias("is_primary"), "similarity")


def centroids(rows: DataFrame, leaf: str = "leaf", vector: str = "mu") -> DataFrame:
    """``(leaf, centroid)``: unit vectors in the direction of the mean of each leaf's rows.

    Sums are per dimension, with partial sums before the shuffle, so a leaf with a third of all rows is no burden.
    """
    each = rows.select(leaf, F.posexplode(V.normalised(V.doubles(vector))).alias("dim", "x")).groupBy(leaf, "dim").agg(F.sum("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "x")))
    return each.groupBy(F.col(leaf).alias("leaf")).agg(V.normalised(F.transform(ordered, lambda s: s["x"])).alias("centroid"))


def _means(units: DataFrame, current: list[tuple[int, list[float]]]) -> dict[int, list[float]]:
    """Unit means of the rows nearest to each centroid: every task sums what it reads, and only sums are shuffled."""
    c = np.array([x for _, x in current])
    c = c / np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-12)
    k, d = c.shape

    def run(batches):
        total = np.zeros((k, d))
        seen = np.zeros(k, bool)
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            own = (x @ c.T).argmax(axis=1)
            np.add.at(total, own, x)
            seen[own] = True
        at = np.flatnonzero(seen)
        leaf, dim = np.repeat(at, d), np.tile(np.arange(d), len(at))
        yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(dim.astype(np.int32)), pa.array(total[at].reshape(-1))], names=["leaf", "dim", "v"])

    sums = units.where(F.size("x") == d).select("x").mapInArrow(run, "leaf int, dim int, v double").groupBy("leaf", "dim").agg(F.sum("v").alias("v")).collect()  # k by d numbers
    out: dict[int, np.ndarray] = {}
    for r in sums:
        out.setdefault(r["leaf"], np.zeros(d))[r["dim"]] = r["v"]
    return {current[i][0]: (v / max(np.sqrt(v @ v), 1e-12)).tolist() for i, v in out.items()}


def spherical_kmeans(rows: DataFrame, k: int, key: str, vector: str = "mu", rounds: int = 30, seeds: int = 1) -> DataFrame:
    """``(leaf, centroid)`` after farthest-first seeding and at most ``rounds`` of assignment, both over all rows.

    The seeds are the row of the least hash, and then, again and again, the one least similar to all before.  A leaf that
    loses its rows gets the row least similar to its own centroid, several such leaves different ones.
    With ``seeds`` above one, a pass takes so many at once, of four times as many rows those least similar to each other.
    """
    spark = rows.sparkSession
    units = rows.select(key, V.normalised(V.doubles(vector)).alias("x")).where(F.col("x").isNotNull())
    order = (F.xxhash64(key), F.col(key))
    head = units.orderBy(*order).select("x").first()
    if head is None:
        return spark.createDataFrame([], "leaf int, centroid array<double>")

    schema = T.StructType([*units.schema.fields, T.StructField("near", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def far(chosen: list[list[float]], count: int) -> list[list[float]]:
        """The ``count`` rows least similar to all the chosen."""
        c = np.array(chosen)

        def run(batches):
            for b in batches:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, c.shape[1])
                near = (x @ c.T).max(axis=1)
                at = np.argsort(near, kind="stable")
                at = at[near[at] <= near[at[: count]].max()] if len(at) else at  # ties of the last are told apart below
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(near[at])], schema=arrow)

        far_ = units.where(F.size("x") == c.shape[1]).mapInArrow(run, schema)
        return [list(r["x"]) for r in far_.orderBy("near", *order).limit(count).select("x").collect()]

    chosen = [list(head["x"])]
    wanted = min(k, units.count())
    while len(chosen) < wanted:
        n = min(seeds, wanted - len(chosen))
        found = far(chosen, n if seeds == 1 else 4 * n)
        for _ in range(n):
            near = (np.array(found) @ np.array(chosen).T).max(axis=1)
            chosen.append(found.pop(int(near.argmin())))
    current = list(enumerate(chosen))
    for _ in range(rounds):
        new = _means(units, current)
        empty = [i for i, _ in current if i not in new]
        if empty:
            new |= dict(zip(empty, far([c for _, c in current], len(empty))))
        moved = [(i, new.get(i, c)) for i, c in current]
        change = max(float(np.abs(np.subtract(a[1], b[1])).max()) for a, b in zip(moved, current))
        current = moved
        if change < 1e-9:
            break
    return spark.createDataFrame(current, "leaf int, centroid array<double>")


# What a term is, and words that are none; results must match
TERM = r"([A-Za-z][A-Za-z0-9_-]{2,}|[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]{2,8})"
TERM_STOP = tuple(
    (
        "the and for with from that this are was were has have had not but can may into than then their there these those using used use between about "
        "what when where which who why how also more such study studies result results effect effects patients patient based data analysis associated "
        "compared however during after before over under through other some each both all"
    ).split()
)


def labels(texts: DataFrame, by: str, top: int = 5) -> DataFrame:
    """``(by, term, score, rank)``: the terms of each node by tf times ln((N+1)/(df+1)+1), with N its texts that have any; whole texts are read."""
    low = F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(1)), F.lower)
    terms = F.filter(low, lambda t: ~F.array_contains(F.array(*[F.lit(w) for w in TERM_STOP]), t))
    each = texts.where(F.col("text").isNotNull()).select(by, terms.alias("ts"), F.monotonically_increasing_id().alias("_i")).where(F.size("ts") > 0)
    n = each.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    counts = each.select(by, "_i", F.explode("ts").alias("term")).groupBy(by, "term", "_i").agg(F.count(F.lit(1)).alias("c"))
    tf = counts.groupBy(by, "term").agg(F.sum("c").alias("tf"), F.count(F.lit(1)).alias("df"))
    score = F.col("tf") * F.ln((F.col("n") + 1) / (F.col("df") + 1) + 1)
    return ranked(tf.join(n, by).select(by, "term", F.round(score, 6).alias("score")), [by], [F.desc("score"), "term"], top)


def node_labels(terms: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """``(by, label, description)`` of all ``nodes``: the first three terms, and all of them; the node's name where it has none."""
    each = terms.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("ts"))
    both = nodes.select(by).distinct().join(each, by, "left")
    name = F.col(by).cast("string")
    return both.select(by, F.coalesce(F.array_join(F.slice("ts", 1, 3), " / "), name).alias("label"), F.coalesce(F.array_join("ts", ", "), name).alias("description"))


def route(queries: DataFrame, leaves: DataFrame, members: DataFrame, least_leaves: int = 4, least_items: int = 50, key: str = "chunk_id", vector: str = "mu") -> DataFrame:
    """``(query_id, leaf, place, items)``: leaves by cosine until at least ``least_leaves`` leaves and ``least_items`` different items are reached, else all.

    Items in two leaves, the most there are, count once: a leaf brings its size less what it shares with better leaves, so only counts of leaves and of
    their overlaps are joined, never members.
    """
    order = assign(queries, leaves, "query_id", vector).select("query_id", "leaf", F.col("rank").alias("place"))
    unique = members.select("leaf", key).distinct()
    size = unique.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    pair = unique.groupBy(key).agg(F.min("leaf").alias("a"), F.max("leaf").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"))
    pair = pair.union(pair.select("b", "a", "m"))
    later = order.select("query_id", F.col("leaf").alias("a"), "place").join(pair, "a").join(order.select("query_id", F.col("leaf").alias("b"), F.col("place").alias("p")), ["query_id", "b"])
    twice = later.where("p < place").groupBy("query_id", "place").agg(F.sum("m").alias("m"))
    w = Window.partitionBy("query_id").orderBy("place")
    new = order.join(size, "leaf", "left").join(twice, ["query_id", "place"], "left").fillna(0, ["n", "m"])
    run = new.select("query_id", "leaf", "place", F.sum(F.col("n") - F.col("m")).over(w).alias("items"))
    enough = F.min(F.when((F.col("place") >= least_leaves) & (F.col("items") >= least_items), F.col("place"))).over(Window.partitionBy("query_id"))
    return run.withColumn("stop", enough).where(F.col("stop").isNull() | (F.col("place") <= F.col("stop"))).select("query_id", "leaf", "place", "items")


def pruning(routed: DataFrame, members: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``(query_id, allowed, ratio)``: the share of items that routing leaves out; ``routed`` has the running number of items."""
    total = members.agg(F.countDistinct(key).alias("n"))
    allowed = routed.groupBy("query_id").agg(F.max("items").alias("allowed"))
    return allowed.join(F.broadcast(total)).select("query_id", "allowed", (1 - F.col("allowed") / F.col("n")).alias("ratio"))


def branch_choice(answers: DataFrame, branches: DataFrame, most: int = 2, least: float = 0.05) -> DataFrame:
    """``(query_id, branch, place)``: the chosen branch first, then others by their probability, those of at least ``least``; the first branch where none is left.

    ``answers(query_id, answer, probabilities map<string,double>)`` of a decision service; unknown branches are ignored, ties go by name.
    """
    known = branches.select("branch").distinct()
    asked = answers.select("query_id", "answer", F.coalesce("probabilities", F.create_map().cast("map<string,double>")).alias("ps"))
    first = asked.select("query_id", F.col("answer").alias("branch"), F.lit(0).alias("later"), F.lit(1.0).alias("p"))
    rest = asked.select("query_id", "answer", F.explode("ps").alias("branch", "p")).where(F.col("branch") != F.coalesce("answer", F.lit(""))).where(F.col("p") >= least)
    both = first.unionByName(rest.select("query_id", "branch", F.lit(1).alias("later"), "p")).join(known, "branch", "left_semi")
    out = ranked(both, ["query_id"], ["later", F.desc("p"), "branch"], most).select("query_id", "branch", F.col("rank").alias("place"))
    none = asked.select("query_id").join(out.select("query_id"), "query_id", "left_anti")
    return out.unionByName(none.join(F.broadcast(known.agg(F.min("branch").alias("branch")))).select("query_id", "branch", F.lit(1).alias("place")))


def allowed_by_branch(chosen: DataFrame, leaves: DataFrame, members: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``(query_id, key)``: the items with any leaf under a chosen branch; ``leaves(leaf, parent)``."""
    under = chosen.select("query_id", F.col("branch").alias("parent")).join(leaves.select("leaf", "parent"), "parent")
    return under.join(members.select("leaf", key), "leaf").select("query_id", key).distinct()


class Taxonomy:
    """A tree of two levels: ``nodes(node, parent, depth, label, description, item_count, assigned_count)``, ``leaves(leaf, parent, centroid)`` and ``members(key, leaf, is_primary, similarity)``."""

    VERSION = 1

    def __init__(self, nodes: DataFrame, leaves: DataFrame, members: DataFrame, items: int):
        self.nodes, self.leaves, self.members, self.items = nodes, leaves, members, items

    def save(self, path: str) -> None:
        for name in ("nodes", "leaves", "members"):
            getattr(self, name).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        self.nodes.sparkSession.createDataFrame([(self.VERSION, self.items)], "version int, items bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, items: int | None = None) -> Taxonomy | None:
        """The saved tree; None where there is none, or it is of another version, or of another number of items than expected."""
        try:
            meta = spark.read.parquet(f"{path}/meta").first()
        except AnalysisException:
            return None
        if meta is None or meta["version"] != cls.VERSION or (items is not None and meta["items"] != items):
            return None
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "leaves", "members")), meta["items"])


def build(rows: DataFrame, key: str, work: Workspace, top_branches: int = 12, leaf_size: int = 64, margin: float = MARGIN, vector: str = "mu") -> Taxonomy:
    """Topics by spherical k-means over all rows, leaves by the same within each topic, labels from the texts, and second leaves within ``margin``.

    ``rows(key, mu, text)``.  A topic of n rows has n / ``leaf_size`` leaves; their seeds are taken several to a pass, so that passes do not grow with the leaves.
    """
    if leaf_size < 2:
        raise ValueError("leaf_size must be at least 2")
    spark = rows.sparkSession
    rows = work.cut(rows.where(F.col(vector).isNotNull()).select(key, V.doubles(vector).alias("mu"), "text"), "rows", True)
    if not rows.rows:
        raise ValueError("cannot build a taxonomy for an empty corpus")
    topics = spherical_kmeans(rows, max(1, min(top_branches, -(-rows.rows // leaf_size))), key)
    placed = work.cut(rows.join(assign(rows, topics, key, top=1).select(key, F.col("leaf").alias("topic")), key), "topics")
    counts = {r["topic"]: r["n"] for r in placed.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most top_branches
    leaves, primary = None, None
    for topic in sorted(counts):
        name = f"topic-{topic + 1:02d}"
        mine = placed.where(F.col("topic") == topic)
        k = -(-counts[topic] // leaf_size)
        found = spherical_kmeans(mine, k, key, seeds=max(1, k // 8))
        own = assign(mine, found, key, top=1).select(key, F.format_string(f"{name}/leaf-%02d", F.col("leaf") + 1).alias("leaf"))
        found = found.select(F.format_string(f"{name}/leaf-%02d", F.col("leaf") + 1).alias("leaf"), F.lit(name).alias("parent"), "centroid")
        leaves = found if leaves is None else leaves.unionByName(found)
        primary = own if primary is None else primary.unionByName(own)
    leaves, primary = work.cut(leaves, "leaves"), work.cut(primary, "primary")
    # the leaf of one's own topic first, and the best other one if it is near enough
    ranks = assign(rows, leaves, key, top=2)
    both = ranks.join(primary.withColumnRenamed("leaf", "own"), key)
    near = rows.join(primary, key).join(leaves.select("leaf", "centroid"), "leaf").select(key, "leaf", V.cosine("mu", "centroid").alias("similarity"))
    other = both.where(F.col("leaf") != F.col("own")).withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("rank"))).where("r = 1").select(key, "leaf", "similarity")
    second = other.join(near.select(key, F.col("similarity").alias("best")), key).where(F.col("similarity") >= F.col("best") - margin)
    members = near.withColumn("is_primary", F.lit(True)).unionByName(second.select(key, "leaf", "similarity", F.lit(False).alias("is_primary")))
    members = work.cut(members.select(key, "leaf", "is_primary", "similarity"), "members")
    texts = placed.select(key, "topic", "text").join(primary, key)
    by_topic = F.format_string("topic-%02d", F.col("topic") + 1)
    each = texts.select(by_topic.alias("node"), "text").unionByName(texts.select(F.col("leaf").alias("node"), "text"))
    sizes = each.groupBy("node").agg(F.count(F.lit(1)).alias("item_count"))
    assigned = members.groupBy(F.col("leaf").alias("node")).agg(F.count(F.lit(1)).alias("assigned_count"))
    inner = node_labels(labels(each, "node"), sizes, "node").join(sizes, "node").join(assigned, "node", "left")
    parent = F.when(F.contains("node", F.lit("/")), F.split_part("node", F.lit("/"), F.lit(1))).otherwise("root")
    inner = inner.select("node", parent.alias("parent"), F.when(F.contains("node", F.lit("/")), 2).otherwise(1).alias("depth"), "label", "description", "item_count", "assigned_count")
    root = [("root", None, 0, "All knowledge", "Root of the automatically generated knowledge taxonomy", rows.rows, None)]
    nodes = work.cut(inner.unionByName(spark.createDataFrame(root, inner.schema)), "nodes")
    return Taxonomy(nodes, leaves, members, rows.rows)


def principal_components(rows: DataFrame, key: str, vector: str = "mu", count: int = 3) -> DataFrame:
    """``(key, components)``: the first coordinates along the directions of the greatest variance, zeros where there are fewer.

    Each batch gives its count, sums and products, a matrix of d by d; only their totals reach the driver.  A direction's sign is
    that which makes its largest entry positive.  Null vectors, and those of another length than the first, take no part.
    """
    first = rows.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    if first is None:
        return rows.select(key, F.array().cast("array<double>").alias("components")).limit(0)
    d = first[0]
    usable = rows.where(F.size(vector) == d).select(key, V.doubles(vector).alias("x"))

    def moments(batches):
        n, p = 0, np.zeros((d + 1, d))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            n += len(x)
            p[:d] += x.T @ x
            p[d] += x.sum(axis=0)
        i, j = np.divmod(np.arange(p.size + 1), d)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.append(p.reshape(-1), n))], names=["i", "j", "v"])

    total = usable.select("x").mapInArrow(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # d by d numbers
    sums = np.zeros((d + 2, d))
    for r in total:
        sums[r["i"], r["j"]] = r["v"]
    p, s, n = sums[:d], sums[d], sums[d + 1, 0]
    mean = np.array(s) / n
    _, v = np.linalg.eigh(p / n - np.outer(mean, mean))
    top = v[:, ::-1][:, :count]
    top = top * np.sign(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])])
    parts = [F.aggregate(F.zip_with(F.zip_with("x", F.array(*map(F.lit, mean.tolist())), lambda a, m: a - m), F.array(*map(F.lit, top[:, j].tolist())), lambda a, w: a * w), F.lit(0.0), lambda a, x: a + x) for j in range(top.shape[1])]
    return usable.select(key, F.array(*parts, *[F.lit(0.0)] * (count - len(parts))).alias("components"))
