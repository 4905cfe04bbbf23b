"""Near-duplicate records by BagMinHash signatures, bands and verified multiset overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldspar.llm.common import GOLDEN, WordHashes, keep_by, mix, shingle_sets, to_lists
from veldspar.llm.graph import connected_components
from veldspar.session import Workspace

BANDS, ROWS = 32, 3


def bag_min_hash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, size: int) -> np.ndarray:
    """BagMinHash signatures (Ertl 2018): two bags agree in a component with a probability equal to their weighted Jaccard.

    Each element owns a Poisson process over time, component and weight; a bag's value in a component is the time of its
    first point below the element's weight.  The weight axis is cut into dyadic intervals [0,1), [1,2), [2,4), ... with one
    process each, thinned in the interval that the weight ends in, so that a heavy element costs the logarithm of its weight.
    Points come in ascending time, and an element is left as soon as its time passes the largest value of its bag, so most
    of the work of hashing every element into every component is never done.
    ``doc`` is ascending; the result has a row of float times per bag, infinite for empty bags.
    """
    sig = np.full((docs, size), np.inf)
    weight = np.asarray(weight, np.float64)
    top = int(np.ceil(np.log2(weight.max()))) if len(weight) and weight.max() > 1 else 0
    d, seed, low, length, w = [], [], [], [], []
    for j in range(top + 1):
        lo, ln = (0.0, 1.0) if j == 0 else (2.0 ** (j - 1), 2.0 ** (j - 1))
        at = np.flatnonzero(weight > lo)
        d.append(doc[at])
        seed.append(mix(element[at] + np.uint64(j * int(GOLDEN) & (2**64 - 1))))
        low.append(np.full(len(at), lo))
        length.append(np.full(len(at), ln))
        w.append(weight[at])
    if not d:
        return sig
    d, seed, low, length, w = (np.concatenate(x) for x in (d, seed, low, length, w))
    t = np.zeros(len(d))
    flat = sig.reshape(-1)
    worst = np.full(docs, np.inf)
    step = 0
    while len(d):
        step += 1
        h = mix(seed + np.uint64(step * int(GOLDEN) & (2**64 - 1)))
        t = t - np.log(((h >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / (length * size)
        comp = ((h & np.uint64(0xFFFFFF)).astype(np.int64) * size) >> 24
        cell = d * size + comp
        ok = t < flat[cell]
        if low[-1] or (w < low + length).any():
            u = (mix(h ^ MIXED) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            ok &= low + u * length < w
        np.minimum.at(flat, cell[ok], t[ok])
        if step % 4 == 0 or step > 12:
            worst = sig.max(axis=1)
        live = t < worst[d]
        if not live.all():
            d, seed, low, length, w, t = d[live], seed[live], low[live], length[live], w[live], t[live]
    return sig


MIXED = np.uint64(0xD6E8FEB86659FD93)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per bag and band."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, rows)
    out = np.tile(mix(np.arange(bands, dtype=np.uint64) + GOLDEN), (len(sig), 1))
    for r in range(rows):
        out = mix(out * np.uint64(3) + bits[:, :, r])
    return out


BITMAP_WORDS = 2


def _bitmaps(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128-bit bitmaps of the sets, as two columns of 64 bits."""
    rows = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(rows), BITMAP_WORDS), np.uint64)
    if len(rows):
        bit = np.uint64(1) << (values & np.uint64(63))
        word = (values >> np.uint64(6)) % np.uint64(BITMAP_WORDS)
        for k in range(BITMAP_WORDS):
            out[:, k] = np.bitwise_or.reduceat(np.where(word == k, bit, np.uint64(0)), offsets[rows])
    return out.view(np.int64)


def _bags(n: int, least: int, multiset: bool):
    def run(batches):
        hashes = WordHashes()
        for b in batches:
            texts = b.column(2).to_pylist()
            values, offsets, counts = shingle_sets(texts, n, least, hashes)
            base, at = values, offsets
            if multiset:  # the i-th occurrence of a shingle is an element of its own, so plain set overlap is multiset overlap
                occurrence = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                values = np.where(occurrence > 0, mix(np.repeat(values, counts) + occurrence.astype(np.uint64) * GOLDEN), np.repeat(values, counts))
                offsets = np.concatenate([[0], np.cumsum(counts)])[offsets]
            some = np.diff(offsets) > 0
            cls = [xxhash.xxh3_128_digest(values[offsets[i] : offsets[i + 1]].tobytes()) if some[i] else None for i in range(len(texts))]
            maps = np.zeros((len(texts), BITMAP_WORDS), np.int64)
            maps[some] = _bitmaps(values, offsets)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cls, pa.binary()), to_lists(values.view(np.int64), offsets, pa.int64()), pa.array(maps[:, 0]), pa.array(maps[:, 1])]
                + ([to_lists(base.view(np.int64), at, pa.int64()), to_lists(counts.astype(np.int32), at, pa.int32())] if multiset else []),
                names=["id", "version", "cls", "bag", "m0", "m1"] + (["element", "weight"] if multiset else []),
            )

    return run


def bags(df: DataFrame, shingle: int = 5, least_words: int = 8, multiset: bool = False) -> DataFrame:
    """``(id, version, cls, bag, m0, m1)`` of ``(id, version, text)``: 64-bit hashes of the word shingles, their bitmap, and a digest equal for equal bags.

    In a multiset the further occurrences of a shingle are elements of their own in ``bag``, and ``element`` and ``weight`` are the distinct ones and their counts.
    Null, empty and short texts have a null digest and an empty bag.
    """
    schema = "id string, version bigint, cls binary, bag array<bigint>, m0 bigint, m1 bigint" + (", element array<bigint>, weight array<int>" if multiset else "")
    return df.select("id", "version", "text").mapInArrow(_bags(shingle, least_words, multiset), schema)


def _bands(bands: int, rows: int):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                rid = np.asarray(part.column(0))
                bag = part.column(1)
                lens = np.asarray(bag.value_lengths().fill_null(0))
                doc = np.repeat(np.arange(len(rid)), lens)
                element = np.asarray(bag.flatten()).view(np.uint64)
                weight = np.asarray(part.column(2).flatten()) if part.num_columns > 2 else np.ones(len(element))
                sig = bag_min_hash(doc, element, weight, len(rid), bands * rows)
                key = band_keys(sig, bands, rows)
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(rid, bands))], names=["key", "rid"])

    return run


def bucket_pairs(cap: int):
    """Pairs of each run of equal keys in a sorted partition; a run above ``cap`` comes out as (key, member) rows with hot set.

    A run is never held: what is kept of it are its first ``cap`` members.
    """

    def flush(key, ids, hot, out):
        n = len(ids)
        if hot or n < 2:
            return
        i, j = np.triu_indices(n, 1)
        out[0].append(ids[i])
        out[1].append(ids[j])

    def batch(out, hot_rows):
        a = np.concatenate(out[0] + [h[0] for h in hot_rows]) if out[0] or hot_rows else np.empty(0, np.int64)
        b = np.concatenate(out[1] + [h[1] for h in hot_rows]) if out[1] or hot_rows else np.empty(0, np.int64)
        n = sum(map(len, out[0]))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.arange(len(a)) >= n)], names=["a", "b", "hot"])

    def run(batches):
        key, kept, hot = None, np.empty(0, np.int64), False
        for b in batches:
            keys, ids = np.asarray(b.column(0)), np.asarray(b.column(1))
            out, hot_rows = ([], []), []
            cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            ends = np.append(cut[1:], len(keys))
            # whole runs of two, the usual case, at once
            simple = np.flatnonzero(ends - cut == 2)
            simple = simple[(simple > 0) & (simple < len(cut) - 1)]
            if len(simple):
                x, y = ids[cut[simple]], ids[cut[simple] + 1]
                out[0].append(np.minimum(x, y))
                out[1].append(np.maximum(x, y))
            todo = np.ones(len(cut), bool)
            todo[1:-1] = (ends - cut)[1:-1] > 2
            for k in np.flatnonzero(todo):
                s, e = cut[k], ends[k]
                mine = ids[s:e]
                if keys[s] != key:
                    flush(key, np.sort(kept), hot, out)
                    key, kept, hot = keys[s], mine[:0], False
                if hot:
                    hot_rows.append((np.full(len(mine), key), mine))
                elif len(kept) + len(mine) > cap:
                    mine = np.concatenate([kept, mine])
                    hot_rows.append((np.full(len(mine), key), mine))
                    kept, hot = mine[:0], True
                else:
                    kept = np.concatenate([kept, mine])
            yield batch(out, hot_rows)
        out = ([], [])
        flush(key, np.sort(kept), hot, out)
        yield batch(out, [])

    return run


def verified(pairs: DataFrame, reps: DataFrame, threshold: float, work: Workspace) -> DataFrame:
    """The pairs ``(a, b)`` whose bags in ``reps(rid, bag, m0, m1)`` have a Jaccard of at least ``threshold``.

    Sizes and bitmaps bound the overlap from above (each bit set in one bitmap alone is an element of one bag alone), so
    most false candidates go before the bags themselves are moved; the bound loses nothing.
    """
    small = lambda x: reps.select(F.col("rid").alias(x), F.size("bag").alias(f"n{x}"), F.col("m0").alias(f"p{x}"), F.col("m1").alias(f"q{x}"))
    both = pairs.join(small("a"), "a").join(small("b"), "b")
    total = F.col("na") + F.col("nb")
    apart = F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) + F.bit_count(F.col("qa").bitwiseXOR(F.col("qb")))
    most = F.least((total - apart) / 2, "na", "nb")
    likely = work.cut(both.where(most >= threshold * (total - most) - 1e-9).select("a", "b"), "likely")
    needed = likely.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    bag = keep_by(reps.select("rid", "bag"), needed, "rid", "left_semi")
    both = likely.join(bag.select(F.col("rid").alias("a"), F.col("bag").alias("x")), "a").join(bag.select(F.col("rid").alias("b"), F.col("bag").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.withColumn("common", common).where(F.col("common") >= threshold * (F.size("x") + F.size("y") - F.col("common")) - 1e-9).select("a", "b")


def near_duplicate_groups(
    df: DataFrame,
    work: Workspace,
    threshold: float = 0.8,
    shingle: int = 5,
    least_words: int = 8,
    bands: int = BANDS,
    rows: int = ROWS,
    cap: int = 64,
    multiset: bool = False,
) -> DataFrame:
    """``(id, cls, rep, group_id)``: one row for every record ``(id string, text string)`` that takes part.

    With a column ``version``, the row of the greatest version of each id counts; of equal versions, or without it, one row.
    Records with equal bags of shingles form a class, whose least id is ``rep``; only representatives are hashed and banded,
    so copies, however many, cost one signature.  Representatives that share a band are verified by exact overlap of their
    bags, and ``group_id`` is the least id of all records connected through links of at least ``threshold``.
    Members of buckets of more than ``cap`` representatives are not paired off but joined exactly on their rarest shingles;
    where such a shingle is hot again, rounds link the members to a few leaders, and in the end only members of different
    groups are compared with each other, so no link that would join two groups is lost.  Null ids, and null, empty or short texts, have no row; a repeated id is one record.
    With ``multiset``, counts of shingles are the weights of the signatures, and the Jaccard is that of multisets, the sum of the least over that of the greatest counts.
    Defaults are five words and 0.8; with 32 bands of 3 a pair of similarity 0.5 is found with a probability of 0.986.
    """
    version = F.col("version").cast("bigint") if "version" in df.columns else F.lit(0).cast("bigint")
    rows_in = df.where("id is not null").select("id", version.alias("version"), "text")
    every = work.cut(bags(rows_in, shingle, least_words, multiset).withColumn("rid", F.monotonically_increasing_id()), "bags")
    # narrow from here: the latest version of each id, then the first record of each class
    last = every.groupBy("id").agg(F.max(F.struct(F.coalesce("version", F.lit(-(2**63))).alias("v"), "cls", "rid")).alias("s"))
    last = work.cut(last.select("id", "s.cls", "s.rid").where("cls is not null"), "latest")
    classes = work.cut(last.groupBy("cls").agg(F.min("rid").alias("rid"), F.min("id").alias("rep")), "classes")
    others = every.select("rid").join(classes.select("rid"), "rid", "left_anti")
    hashed = ["element", "weight"] if multiset else ["bag"]
    reps = keep_by(every.select("rid", "bag", "m0", "m1", *hashed[: 2 * multiset]), work.cut(others, "others"), "rid", "left_anti")
    rows_ = reps.select("rid", *hashed).mapInArrow(_bands(bands, rows), "key bigint, rid bigint")
    found = rows_.repartition("key").sortWithinPartitions("key").mapInArrow(bucket_pairs(cap), "a bigint, b bigint, hot boolean")
    found = work.cut(found, "pairs")
    edges = work.cut(verified(found.where("not hot").select("a", "b").distinct(), reps, threshold, work), "edges")
    hot = found.where("hot").select(F.col("a").alias("key"), F.col("b").alias("rid"))
    if not hot.isEmpty():
        edges = _hot_links(hot, edges, reps, threshold, cap, work)
    comp = work.cut(connected_components(edges, work), "components")
    # names: a group is called by the least id of its records
    named = classes.join(comp.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    names = named.groupBy("component").agg(F.min("rep").alias("group_id"))
    return last.select("id", "cls").join(named.join(names, "component").select("cls", "rep", "group_id"), "cls")


def prefixes(members: DataFrame, threshold: float) -> DataFrame:
    """``(key, rid, n, rem)``: the rarest elements of each bag, as many as two bags of the given similarity must share one of.

    Bags x and y with a Jaccard of t share at least ceil(t|x|) elements, so, in one order of all elements, they share one
    among the first |x| - ceil(t|x|) + 1 of each; the order is by frequency, which keeps the buckets small.
    ``n`` is the size of the bag and ``rem`` the number of its elements from this one on, which bounds what two bags that first meet here have in common.
    """
    each = members.select("rid", F.size("bag").alias("n"), F.explode("bag").alias("key"))
    df = each.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("rid").orderBy("df", "key")
    ranked = each.join(df, "key").withColumn("at", F.row_number().over(order))
    ranked = ranked.where((F.col("at") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1) & (F.col("df") > 1))
    return ranked.select(F.col("key").cast("bigint").alias("key"), "rid", "n", (F.col("n") - F.col("at") + 1).cast("int").alias("rem"))


def _hot_links(hot: DataFrame, edges: DataFrame, reps: DataFrame, threshold: float, cap: int, work: Workspace) -> DataFrame:
    """Edges with the links among members of hot buckets: an exact prefix join, and leaders where its buckets are hot again."""
    members = keep_by(reps.select("rid", "bag"), work.cut(hot.select("rid").distinct(), "hot"), "rid", "left_semi")
    keys = work.cut(prefixes(members, threshold), "hot-keys")
    found = keys.select("key", "rid").repartition("key").sortWithinPartitions("key")
    found = work.cut(found.mapInArrow(bucket_pairs(cap), "a bigint, b bigint, hot boolean"), "hot-pairs")
    edges = work.cut(edges.unionByName(verified(found.where("not hot").select("a", "b").distinct(), reps, threshold, work)), "edges")
    members = keys.join(found.where("hot").select(F.col("a").alias("key")).distinct(), "key", "left_semi")
    # the largest bag that a member can still link with here; one below the least of its key has no partner
    most = F.col("rem") * (1 + threshold) / threshold - F.col("n") + 1e-6
    members = members.join(members.groupBy("key").agg(F.min("n").alias("least")), "key").withColumn("most", most).where("most >= least").select("key", "rid", "n", "most")
    left = members = work.cut(members.distinct(), "hot")
    if members.isEmpty():
        return edges
    leaders = 1
    while True:
        at = left.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("rid")))  # limited before the shuffle, as the filter shows
        lead = at.where(F.col("at") <= leaders).select("key", F.col("rid").alias("a"), F.col("n").alias("na"), F.col("most").alias("ma"))
        pairs = left.join(lead, "key").where("rid > a and n <= ma and na <= most").select("a", F.col("rid").alias("b"))
        if pairs.isEmpty():
            break
        new = work.cut(verified(pairs.distinct(), reps, threshold, work), "leader-edges")
        edges = edges.unionByName(new)
        linked = left.join(lead, "key").join(new.select("a", F.col("b").alias("rid")), ["a", "rid"], "left_semi").select("key", "rid")
        gone = linked.union(lead.select("key", F.col("a").alias("rid"))).distinct()
        left = work.cut(left.join(gone, ["key", "rid"], "left_anti"), "unlinked")
        leaders = min(4 * leaders, 1000)
    edges = work.cut(edges, "edges-hot")
    comp = connected_components(edges, work)
    placed = members.join(comp.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    placed = work.cut(placed, "placed")
    x = placed.select("key", F.col("rid").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("most").alias("ma"))
    y = placed.select("key", F.col("rid").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("most").alias("mb"))
    across = x.join(y, "key").where("ca < cb and nb <= ma and na <= mb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return work.cut(edges.unionByName(verified(across, reps, threshold, work)), "edges-all")


def group_pairs(groups: DataFrame) -> DataFrame:
    """All pairs of records of one group, smaller id first, where a query asks for exactly these."""
    g = groups.select("group_id", "id").distinct()
    sizes = g.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    g = g.join(sizes, "group_id")
    lo, hi = g.select("group_id", F.col("id").alias("rec_lo")), g.select("group_id", F.col("id").alias("rec_hi"))
    return lo.join(hi, "group_id").where("rec_lo < rec_hi").select("rec_lo", "rec_hi")
