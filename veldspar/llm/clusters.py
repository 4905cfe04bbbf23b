"""Similarity clusters: a neighbour graph by descent, communities by modularity, clusters by transitive links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldspar.llm import vectors as V
from veldspar.llm.graph import connected_components
from veldspar.session import Workspace

MOST_LOCAL = 20_000  # nodes of a graph that one task holds


def direction(mu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ok = np.isfinite(mu).all(axis=1) & (mu != 0).any(axis=1)
    with np.errstate(all="ignore"):
        big = np.abs(mu).max(axis=1, keepdims=True)
        x = mu / np.where(big > 0, big, 1)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True)), ok


def _top(a: np.ndarray, b: np.ndarray, s: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``count`` best of each a, without repeats."""
    o = np.lexsort((b, -s, a))
    a, b, s = a[o], b[o], s[o]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.empty(0, bool)
    a, b, s = a[new], b[new], s[new]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.empty(0, int)
    rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a)))) if len(a) else a
    ok = rank < count
    return a[ok], b[ok], s[ok]


def _start(width: int, halves: int, count: int, floor: float):
    """Neighbours of each row within its bucket, no less similar than ``floor``."""

    def run(batches):
        out, n = [], 0
        for starts, sizes, _, k, vec in V.blocks(batches):
            k = np.asarray(k)
            x = V.decode(vec, width, halves).astype(np.float32)
            for at in V.stacked(starts, sizes):
                own, m = x[at], at.shape[1]
                for s in range(0, m, 1024):
                    c = own[:, s : s + 1024] @ own.transpose(0, 2, 1)
                    i = np.arange(c.shape[1])
                    c[:, i, s + i] = -9
                    if m - 1 > count:
                        edge = np.maximum(-np.partition(-c, count - 1, axis=2)[:, :, count - 1], np.float32(floor))
                    else:
                        edge = np.full(c.shape[:2], floor, np.float32)
                    g, a, b = np.unravel_index(np.flatnonzero(c >= edge[:, :, None]), c.shape)
                    out.append((k[at[g, a + s]], k[at[g, b]], c[g, a, b]))
                    n += len(a)
                if n > 50_000:
                    yield _edges(out)
                    out, n = [], 0
        if out:
            yield _edges(out)

    return run


def _edges(out) -> pa.RecordBatch:
    a, b, s = (np.concatenate(c) for c in zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float32())], names=["a", "b", "s"])


def _local_join(width: int, halves: int, count: int, floor: float):
    """One step of descent at a node: its neighbours, in both directions, are compared with each other.

    What comes out is better than the last of the list it is for.
    """

    def run(batches):
        out, n = [], 0
        for starts, sizes, _, k, vec, worst in V.blocks(batches):
            k, worst = np.asarray(k), np.maximum(np.asarray(worst), np.float32(floor))
            x = V.decode(vec, width, halves).astype(np.float32)
            for at in V.stacked(starts, sizes):
                own, i = x[at], np.arange(at.shape[1])
                c = own @ own.transpose(0, 2, 1)
                c[:, i, i] = -9
                g, a, b = np.unravel_index(np.flatnonzero(c > worst[at][:, :, None]), c.shape)
                out.append((k[at[g, a]], k[at[g, b]], c[g, a, b]))
                n += len(a)
                if n > 50_000:
                    yield _edges([_top(*(np.concatenate(c) for c in zip(*out)), count)])
                    out, n = [], 0
        if out:
            yield _edges([_top(*(np.concatenate(c) for c in zip(*out)), count)])

    return run


def _best(edges: DataFrame, count: int) -> DataFrame:
    """The ``count`` best of each a; one shuffle by a serves the maxima and the ranks."""
    e = edges.repartition("a").groupBy("a", "b").agg(F.max("s").alias("s"))
    return e.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))).where(F.col("r") <= count).select("a", "b", "s")


def descent(store: V.Vectors, work: Workspace, count: int, floor: float, rounds: int, tables: int, settled: float) -> DataFrame:
    """``(a, b, s)``: for each distinct vector its ``count`` most similar, no less than ``floor``, by neighbour descent (Dong et al. 2011).

    The start is not random but from buckets of random hyperplanes, as later versions of the method do; a round compares
    the neighbours of each node, in both directions, with each other, and keeps the best.  Rounds end when a share of no
    more than ``settled`` of the lists changed.  Nodes without any neighbour take no part in the rounds.
    """
    n = store.heads.count()
    bits = tables * V.substring_bits(n)
    width, halves = store.width, store.halves
    planes = np.random.default_rng(11).normal(size=(width, bits)).astype(np.float32)

    def code(batches):
        for b in batches:
            x = V.decode(b.column(1), width, halves).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), V.pack_rows(np.packbits(x @ planes > 0, axis=1))], names=["rid", "code"])

    codes = work.cut(store.rows().mapInArrow(code, "rid bigint, code binary"), "codes")
    near = work.cut(V.active(V.buckets(codes, bits, tables, work), round(0.24 * bits)), "active")
    vec = store.some(work.cut(near.select("rid").distinct(), "nodes"))
    joined = near.join(vec, "rid").select("key", "rid", "vec").repartition("key").sortWithinPartitions("key")
    graph = work.cut(_best(joined.mapInArrow(_start(width, halves, count, floor), "a bigint, b bigint, s float"), count), "graph")
    for i in range(rounds):
        # a node's list, and those that list it, as many at most: the most similar ones first
        back = graph.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("s"), "a"))).where(F.col("r") <= count)
        around = graph.select(F.col("a").alias("v"), F.col("b").alias("rid")).union(back.select(F.col("b").alias("v"), F.col("a").alias("rid")))
        around = around.repartition("rid").distinct()  # by rid, as the joins need it
        lists = graph.groupBy(F.col("a").alias("rid")).agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("n"))
        lists = lists.select("rid", F.when(F.col("n") >= count, F.col("s")).otherwise(F.lit(floor)).cast("float").alias("worst"))
        sent = around.join(vec, "rid").join(lists, "rid", "left").fillna(floor, "worst").select("v", "rid", "vec", "worst").repartition("v").sortWithinPartitions("v")
        new = sent.mapInArrow(_local_join(width, halves, count, floor), "a bigint, b bigint, s float")
        better = work.cut(_best(new.unionByName(graph), count), "graph")
        # nobody asks how much the last round changed
        done = i + 1 == rounds or better.join(graph.select("a", "b"), ["a", "b"], "left_anti").count() <= settled * better.count()
        graph = better
        if done:
            break
    return graph


def _meetings(x: np.ndarray, comp: np.ndarray, least: float):
    """``(a, b, product)``: places of two rows of different components with a product of at least ``least``, each pair once.

    Rows outside the largest component are compared with those that follow them, which end with that component: every pair
    of two components has one of them.
    """
    _, inverse, sizes = np.unique(comp, return_inverse=True, return_counts=True)
    order, rest = np.argsort(inverse == sizes.argmax(), kind="stable"), len(comp) - sizes.max()
    x, inverse = x[order], inverse[order]
    for s in range(0, rest, 256):
        c = (x[s : min(s + 256, rest)] @ x[s:].T).reshape(-1)
        at = np.flatnonzero(c >= least)
        a, b = np.divmod(at, len(x) - s)
        ok = (a < b) & (inverse[a + s] != inverse[b + s])
        if ok.any():
            yield order[a[ok] + s], order[b[ok] + s], c[at[ok]]


def _active_apart(radius: int):
    """``(rid, comp, key)`` of the bucket rows with a row of another component within a Hamming radius; the code ends in the component."""

    def run(batches):
        out, n = [], 0
        for starts, sizes, keys, k, code in V.blocks(batches):
            raw = V.fixed(code, np.uint8, len(code[0].as_py()))
            comp = np.ascontiguousarray(raw[:, -8:]).view(">i8").reshape(-1).astype(np.int64)
            c = 1 - 2 * np.unpackbits(raw[:, :-8], axis=1).astype(np.float32)  # a product is the bits that agree less those that differ
            near = np.zeros(len(c), bool)
            for s, e in zip(starts.tolist(), (starts + sizes).tolist()):
                for a, b, _ in _meetings(c[s:e], comp[s:e], c.shape[1] - 2 * radius - 1):
                    near[a + s] = near[b + s] = True
            if near.any():
                out.append((np.asarray(k)[near], comp[near], keys[near]))
                n += int(near.sum())
            if n > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["rid", "comp", "key"])
                out, n = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["rid", "comp", "key"])

    return run


def _across(width: int, halves: int, similar: float):
    """Per bucket, the best sure link of each two components, and every one at the limit."""

    def run(batches):
        out, n = [], 0
        for starts, sizes, _, k, comp, vec in V.blocks(batches):
            k, comp = np.asarray(k), np.asarray(comp)
            x = V.decode(vec, width, halves).astype(np.float32)
            for a, b, v in ((a + s, b + s, v) for s, e in zip(starts.tolist(), (starts + sizes).tolist()) for a, b, v in _meetings(x[s:e], comp[s:e], similar - 1e-4)):
                swap = comp[a] > comp[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                o = np.lexsort((b, a, -v, comp[b], comp[a]))
                a, b, v = a[o], b[o], v[o]
                first = np.append(True, (comp[a][1:] != comp[a][:-1]) | (comp[b][1:] != comp[b][:-1]))[: len(a)]
                ok = first | (v < similar + 1e-4)
                out.append((k[a[ok]], k[b[ok]], comp[a[ok]], comp[b[ok]], v[ok]))
                n += int(ok.sum())
            if n > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a", "b", "ca", "cb", "s"])
                out, n = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a", "b", "ca", "cb", "s"])

    return run


def across(store: V.Vectors, comp: DataFrame, work: Workspace, similar: float, missed: float) -> DataFrame:
    """``(a, b, s, ca, cb)``: links of at least about ``similar`` between rows of different components, one of each two components and all at the limit.

    All rows take part, those without a neighbour as components of their own.  Substrings of hyperplane codes are four bits
    shorter than those of the start, and there are as many tables as leave a pair of just that cosine unmet with a
    probability of ``missed``, whatever the number of rows; in a bucket every pair of two components is compared, with no cap.
    """
    n = store.heads.count()
    length, agree = max(2, V.substring_bits(n) - 4), 1 - np.arccos(similar) / np.pi
    tables = int(np.ceil(np.log(missed) / np.log1p(-(agree**length))))
    bits = tables * length
    radius = round((1 - agree) * bits + 2.5 * np.sqrt(agree * (1 - agree) * bits))
    width, halves = store.width, store.halves
    planes = np.random.default_rng(13).normal(size=(width, bits)).astype(np.float32)

    def code(batches):
        for b in batches:
            x = V.decode(b.column(1), width, halves).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), V.pack_rows(np.packbits(x @ planes > 0, axis=1))], names=["rid", "code"])

    codes = store.rows().mapInArrow(code, "rid bigint, code binary").join(comp.withColumnRenamed("node", "rid"), "rid", "left")
    own = F.to_binary(F.lpad(F.hex(F.coalesce("component", "rid")), 16, "0"), F.lit("hex"))
    codes = work.cut(codes.select("rid", F.concat("code", own).alias("code")), "codes-across")
    rows = V.buckets(codes, bits, tables, work, whole=True).select("key", "rid", "code").repartition("key").sortWithinPartitions("key")
    near = work.cut(rows.mapInArrow(_active_apart(radius), "rid bigint, comp bigint, key bigint"), "apart")
    vec = store.some(work.cut(near.select("rid").distinct(), "nodes-apart"))
    joined = near.join(vec, "rid").select("key", "rid", "comp", "vec").repartition("key").sortWithinPartitions("key")
    found = work.cut(joined.mapInArrow(_across(width, halves, similar), "a bigint, b bigint, ca bigint, cb bigint, s float"), "across")
    sure = found.where(F.col("s") >= similar + 1e-4).groupBy("ca", "cb").agg(F.max(F.struct("s", "a", "b")).alias("m")).select("m.a", "m.b", "m.s", "ca", "cb")
    out = sure.unionByName(found.where(F.col("s") < similar + 1e-4))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s", "ca", "cb").groupBy("a", "b", "ca", "cb").agg(F.max("s").alias("s"))


def _merged(comp: DataFrame, more: DataFrame, work: Workspace) -> DataFrame:
    """Components after links between them, ``more`` with ``(ca, cb)``: the joined components are the nodes, rows without a component their own."""
    joined = work.cut(connected_components(more.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), work), "joined")
    old = comp.join(joined.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return old.unionByName(joined.join(comp.select("node"), "node", "left_anti"))


def louvain(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, resolution: float = 1.0, graph: np.ndarray | None = None) -> np.ndarray:
    """Communities of an undirected weighted graph by moves that raise modularity, level after level (Blondel et al. 2008).

    ``graph`` names the graph of each node where there are several without links between them: each is moved as if alone.
    """
    label = np.arange(n)
    graph = np.zeros(n, int) if graph is None else graph
    live = np.ones(graph.max() + 1 if n else 0, bool)
    while live.any():
        whole = 2 * np.bincount(graph[a], w, minlength=len(live))
        m2 = np.where(whole > 0, whole, 1)[graph].tolist()
        loops = np.bincount(a[a == b], w[a == b], minlength=n)
        off = a != b
        src = np.concatenate([a[off], b[off]])
        order = np.argsort(src, kind="stable")
        dst, ww = np.concatenate([b[off], a[off]])[order], np.concatenate([w[off], w[off]])[order]
        degree = np.bincount(src, np.concatenate([w[off], w[off]]), minlength=n) + 2 * loops
        src = src[order]
        com, total = list(range(n)), degree.tolist()
        ends, weight, size = dst.tolist(), ww.tolist(), degree.tolist()
        at = np.searchsorted(src, np.arange(n + 1)).tolist()
        ever, lively = np.zeros(len(live), bool), live
        for _ in range(20):
            now, mixed = np.array(com), np.zeros(n, bool)
            mixed[src[now[src] != now[dst]]] = True
            mixed, moved = mixed.tolist(), []  # a node all of whose neighbours share its community stays, unless one of them moves before
            for v in np.flatnonzero(lively[graph]).tolist():
                if not mixed[v]:
                    continue
                s, e = at[v], at[v + 1]
                own = com[v]
                links: dict[int, float] = {}
                for i in range(s, e):
                    u = com[ends[i]]
                    links[u] = links.get(u, 0.0) + weight[i]
                d = size[v]
                total[own] -= d
                pull = d * resolution / m2[v]
                best, gain = own, links.get(own, 0.0) - pull * total[own]
                if len(links) > 1 or own not in links:
                    for c, x in sorted(links.items()):
                        g = x - pull * total[c]
                        if g > gain + 1e-12:
                            best, gain = c, g
                total[best] += d
                if best != own:
                    com[v] = best
                    moved.append(v)
                    for i in range(s, e):
                        mixed[ends[i]] = True
            lively = np.zeros(len(live), bool)
            lively[graph[moved]] = True
            ever |= lively
            if not moved:
                break
        live = ever
        if not live.any():
            break
        names, com = np.unique(np.array(com), return_inverse=True)
        label, graph = com[label], graph[names]
        pair, inverse = np.unique(np.minimum(com[a], com[b]) * len(names) + np.maximum(com[a], com[b]), return_inverse=True)
        w = np.bincount(inverse, w)
        a, b, n = pair // len(names), pair % len(names), len(names)
    return label


def _communities(batches):
    """Per run of one component: its communities, and each node's weighted degree within its own."""
    for starts, sizes, _, ab, s in V.blocks(batches):
        nodes, flat = np.unique(V.fixed(ab, ">i8", 2).astype(np.int64), return_inverse=True)
        flat = flat.reshape(-1, 2)
        w = np.asarray(s).astype(np.float64)
        graph = np.empty(len(nodes), int)
        graph[flat[:, 0]] = graph[flat[:, 1]] = np.repeat(np.arange(len(starts)), sizes)
        com = louvain(flat[:, 0], flat[:, 1], w, len(nodes), graph=graph)
        inner = com[flat[:, 0]] == com[flat[:, 1]]
        degree = np.bincount(flat[inner].reshape(-1), np.repeat(w[inner], 2), minlength=len(nodes))
        lead = np.full(com.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(lead, com, nodes)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(lead[com]), pa.array(degree)], names=["k", "community", "degree"])


def _moved(edges: DataFrame, work: Workspace, settled: float = 0.01, most_rounds: int = 100) -> DataFrame:
    """``(k, c)``: one level of modularity moves for graphs too large for one task, as joins and sums, until no more than a share ``settled`` of the nodes moves.

    In each round half of the nodes, by hash and round, may move, so that two neighbours do not swap for ever.
    """
    loops = edges.where("a = b").select("a", (2 * F.col("s")).alias("s"))
    off = edges.where("a <> b")
    both = work.cut(off.union(off.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")).select("a", "b", "s"), "both")
    degree = work.cut(both.select("a", "s").unionByName(loops).groupBy("a").agg(F.sum("s").alias("d")), "degree", True)
    m2 = degree.agg(F.sum("d")).first()[0]
    label = work.cut(degree.select(F.col("a").alias("k"), F.col("a").alias("c"), "d"), "labels")
    for i in range(most_rounds):
        totals = label.groupBy("c").agg(F.sum("d").alias("t"))
        pull = both.join(label.select(F.col("k").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("s").alias("x"))
        mine = label.select(F.col("k").alias("a"), F.col("c").alias("own"), "d")
        stay = mine.select("a", F.col("own").alias("c"), F.lit(0.0).alias("x"))  # one's own community counts even without a link into it
        pull = pull.unionByName(stay).groupBy("a", "c").agg(F.sum("x").alias("x"))
        gains = pull.join(totals, "c").join(mine, "a")
        gain = F.col("x") - F.col("d") * (F.col("t") - F.when(F.col("c") == F.col("own"), F.col("d")).otherwise(0.0)) / F.lit(m2)
        best = gains.groupBy("a").agg(F.max(F.struct(gain.alias("g"), (F.col("c") == F.col("own")).alias("stay"), (-F.col("c")).alias("c"))).alias("s"))
        may = F.pmod(F.xxhash64("k", F.lit(i)), F.lit(2)) == 0
        new = label.join(best.select(F.col("a").alias("k"), (-F.col("s.c")).alias("to")), "k", "left")
        wish = F.col("to").isNotNull() & (F.col("to") != F.col("c"))
        new = work.cut(new.select("k", F.when(may & wish, F.col("to")).otherwise(F.col("c")).alias("c"), "d", wish.alias("wish")), "labels")
        wishes = new.where("wish").count()
        work.drop(label)
        label = new.drop("wish")
        label.workspace_path = new.workspace_path
        if wishes <= settled * degree.rows:
            break
    return label.select("k", "c")


def _spread(edges: DataFrame, work: Workspace, most_local: int) -> DataFrame:
    """Communities of components too large for one task, by the same levels of moves: a level's communities are the next one's nodes.

    Levels are moved by ``_moved`` until the graph of the communities is small enough to be finished in one task, or no longer shrinks.
    """
    level, names, nodes = work.cut(edges.select("a", "b", "s"), "level"), None, None
    while True:
        moved = work.cut(_moved(level, work), "moved", True)
        names = moved.select("k", "c") if names is None else work.cut(names.withColumnRenamed("c", "m").join(moved.withColumnRenamed("k", "m"), "m").select("k", "c"), "names")
        count = moved.select("c").distinct().count()
        low = level.join(moved.toDF("a", "ca"), "a").join(moved.toDF("b", "cb"), "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("s").alias("s"))
        level = work.cut(low, "level")
        if count <= most_local or count == nodes or count == moved.rows:
            break
        nodes = count
    if count <= most_local and count > 1:
        ab = F.concat(F.to_binary(F.lpad(F.hex("a"), 16, "0"), F.lit("hex")), F.to_binary(F.lpad(F.hex("b"), 16, "0"), F.lit("hex")))
        last = level.select(F.lit(0).cast("bigint").alias("component"), ab.alias("ab"), "s").coalesce(1).mapInArrow(_communities, "k bigint, community bigint, degree double")
        names = names.withColumnRenamed("c", "m").join(last.select(F.col("k").alias("m"), F.col("community").alias("c")), "m", "left").select("k", F.coalesce("c", "m").alias("c"))
    c = work.cut(names, "communities")
    inner = edges.join(c.toDF("a", "ca"), "a").join(c.toDF("b", "cb"), "b").where("ca = cb").select(F.explode(F.array("a", "b")).alias("k"), "s").groupBy("k").agg(F.sum("s").alias("degree"))
    lead = c.groupBy("c").agg(F.min("k").alias("community"))
    return c.join(lead, "c").join(inner, "k", "left").select("k", "community", F.coalesce("degree", F.lit(0.0)).alias("degree"))


def similarity_clusters(
    df: DataFrame,
    work: Workspace,
    key: str = "chunk_id",
    version: str = "ingest_seq",
    similar: float = 0.82,
    least: int = 5,
    d: int = 64,
    neighbours: int = 10,
    rounds: int = 1,
    tables: int = 4,
    settled: float = 0.02,
    missed: float = 0.1,
    typical: int = 3,
    most_local: int = MOST_LOCAL,
) -> DataFrame:
    """``(cluster_id, id, size, community, degree, typical)``: the members of each cluster of at least ``least`` rows.

    Rows are the latest version of each id whose ``mu`` has ``d`` finite numbers, not all zero.  Neighbour descent gives each
    distinct direction its most similar ones; those of a cosine of at least ``similar`` are links, and rows linked directly
    or through others are one cluster, named by its least id.  Links that full lists leave out are found between the components
    of the lists (see ``across``).  Within it, modularity finds communities; a row's ``degree``
    is the weight of its links inside its community, and the cluster's ``typical`` rows are those of the highest degree.
    Equal directions are one node of the graph and come out under every id.  Communities are those of the Louvain levels; a cluster
    of more than ``most_local`` nodes has its levels moved by joins over all tasks, until its communities are few enough for one.
    Null ids are dropped, an empty table gives no rows, and other columns are ignored.
    """
    store = V.Vectors(df, key, version, ["mu"], direction, d, 1, d, work, 1)
    graph = descent(store, work, neighbours, similar - 0.004, rounds, tables, settled)
    links = graph.where(F.col("s") >= similar - 1e-4).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s").groupBy("a", "b").agg(F.max("s").alias("s"))
    links = work.cut(_exact(links, store, df, key, version, similar, work), "links")
    comp = work.cut(connected_components(links, work), "components")
    more = work.cut(_exact(across(store, comp, work, similar, missed), store, df, key, version, similar, work), "links-across")
    if not more.isEmpty():
        links = links.unionByName(more.select("a", "b", "s"))
        comp = work.cut(_merged(comp, more, work), "components")
    # members: every id of a vector, by its class
    node = store.heads.join(comp.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    members = store.names.select("id", "cls").join(node, "cls").withColumnRenamed("rid", "k")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("k").alias("nodes"), F.min("id").alias("cluster_id")).where(F.col("size") >= least)
    sizes = work.cut(sizes, "sizes")
    inside = links.join(comp.select(F.col("node").alias("a"), "component"), "a").join(sizes.select("component", "nodes"), "component")
    small = inside.where(F.col("nodes") <= most_local)
    packed = small.select("component", F.concat(F.to_binary(F.lpad(F.hex("a"), 16, "0"), F.lit("hex")), F.to_binary(F.lpad(F.hex("b"), 16, "0"), F.lit("hex"))).alias("ab"), "s")
    local = packed.repartition("component").sortWithinPartitions("component").mapInArrow(_communities, "k bigint, community bigint, degree double")
    large = inside.where(F.col("nodes") > most_local).select("a", "b", F.col("s").cast("double").alias("s"))
    described = local if large.isEmpty() else local.unionByName(_spread(large, work, most_local))
    out = members.join(sizes, "component").join(described, "k", "left")
    first = F.min("id").over(Window.partitionBy("cluster_id", "community"))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc_nulls_last("degree"), "id"))
    return out.select("cluster_id", "id", "size", F.when(F.col("community").isNull(), F.col("cluster_id")).otherwise(first).alias("community"), F.coalesce("degree", F.lit(0.0)).alias("degree"), (rank <= typical).alias("typical"))


def _exact(links: DataFrame, store: V.Vectors, df: DataFrame, key: str, version: str, similar: float, work: Workspace) -> DataFrame:
    """Links, those at the limit by the doubles of the table."""
    links = work.cut(links, "links")
    edge = work.cut(links.where(F.abs(F.col("s") - similar) < 1e-4), "edge")
    if edge.isEmpty():
        return links
    rids = edge.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    ids = work.cut(V.keep_by(store.names.select("rid", "id"), rids, "rid", "left_semi"), "edge-ids")
    rows = V.keep_by(df.withColumn("id", F.col(key)).select("id", F.col(version).alias("version"), "mu"), ids.select("id"), "id", "left_semi")
    last = rows.groupBy("id").agg(F.max(F.struct("version", "mu")).alias("s")).join(ids, "id").select("rid", F.col("s.mu").alias("x"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    both = edge.join(last.select(F.col("rid").alias("a"), "x"), "a").join(last.select(F.col("rid").alias("b"), F.col("x").alias("y")), "b")
    cosine = dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y"))
    kept = both.where(cosine >= similar).select(links.columns)
    return links.where(F.col("s") >= similar + 1e-4).unionByName(kept)
