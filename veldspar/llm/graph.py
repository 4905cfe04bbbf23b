"""Connected components of an edge list, as DataFrame rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.session import Workspace


def _forest(batches):
    """Per partition, the edges of a spanning forest with each node linked to the least node of its tree.

    It sees a bounded stream at a time: forests of earlier batches are merged with the next batch, and what has grown past
    the bound is sent on.
    """
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while (p := parent.get(x, x)) != root:
            parent[x] = root
            x = p
        return root

    def out():
        nodes = list(parent)
        roots = [find(x) for x in nodes]
        keep = [(r, x) for r, x in zip(roots, nodes) if r != x]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.int64()), pa.array([k[1] for k in keep], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 500_000:
            yield out()
            parent.clear()
    yield out()


def connected_components(edges: DataFrame, work: Workspace, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge list ``(a bigint, b bigint)``; a component's name is its least node.

    Each partition first reduces its edges to a spanning forest, so what is shuffled grows with the nodes, not the edges.
    Then large-star and small-star rounds follow (Kiveris et al. 2014), each written to the shared folder, until nothing
    changes.  Loops and repeated edges are allowed; null ends are dropped.  No component is ever held in one task: the star
    rounds only aggregate minima.
    """
    e = edges.select("a", "b").where("a is not null and b is not null and a <> b").mapInArrow(_forest, "a bigint, b bigint")
    e = work.cut(e.distinct(), "forest")
    for _ in range(most_rounds):
        # large star: every larger neighbour of a node is linked to the node's least neighbour
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: the smaller neighbours of a node, and the node, are linked to the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.select(F.col("m").alias("a"), F.col("a").alias("b")).union(small.select(F.col("m").alias("a"), "b")).where("a <> b").distinct()
        new = work.cut(small, "star")
        # done when each node has one parent and no parent is itself a child
        kids = new.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
        open_ = kids.where("n > 1").select("b").union(new.join(kids.select(F.col("b").alias("a")), "a", "left_semi").select("b"))
        done = open_.isEmpty()
        work.drop(e)
        e = new
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(e.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
