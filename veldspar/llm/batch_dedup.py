"""Deduplicating new batches against everything accepted: multi-key sorted neighbourhoods over persisted key ranges."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldspar.llm.common import WordHashes, mix, shingle_sets, to_lists
from veldspar.session import Workspace

SETS = "id string, part string, ord bigint, cls binary, bag array<bigint>"
KEYED = "key bigint, n int, rem int, rid bigint"
COUNTERS = 1 << 20  # of shingle frequencies
BITS = 12  # ranges of keys are told apart by so many leading bits at most


def _sets(shingle: int, least: int):
    """``(id, part, ord, cls, bag)``: the 64-bit hashes of a text's shingles, ascending, and their digest; null and empty where it takes no part."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            for at in range(0, b.num_rows, 4000):
                part = b.slice(at, 4000)
                values, offsets, _ = shingle_sets(part.column(3).to_pylist(), shingle, least, hashes)
                digest = [xxhash.xxh3_128_digest(values[s:e].tobytes()) if e > s else None for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(digest, pa.binary()), to_lists(values.view(np.int64), offsets, pa.int64())], names=["id", "part", "ord", "cls", "bag"])

    return run


def _keys(threshold: float, levels: np.ndarray):
    """Sort keys of ``(rid, part, bag)``: the rarest shingles, as many as two sets of the threshold must share one of.

    Shingles are ordered by the level of their frequency, and within by a hash, which is one order for all records.  ``n`` is the size of the set and
    ``rem`` how many of its shingles come from this key on: two records that first meet here have no more in common.
    """

    def run(batches):
        for b in batches:
            bag, rid = b.column(2), np.asarray(b.column(0))
            n = np.asarray(bag.value_lengths().fill_null(0)).astype(np.int64)
            values = np.asarray(bag.flatten()).view(np.uint64)
            doc = np.repeat(np.arange(len(rid)), n)
            order = np.lexsort((mix(values), levels[values & np.uint64(COUNTERS - 1)], doc))
            place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
            take = place < np.repeat(n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, n)
            part = np.fromiter((xxhash.xxh3_64_intdigest(p) for p in b.column(1).to_pylist()), np.uint64, len(rid))
            key = (mix(values[order] ^ mix(part[doc])) >> np.uint64(1)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[take]) for x in (key, n[doc].astype(np.int32), (n[doc] - place).astype(np.int32), rid[doc])], names=["key", "n", "rem", "rid"]
            )

    return run


def _needed(n1: np.ndarray, n2: np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil(threshold / (1 + threshold) * (n1 + n2) - 1e-9)


def neighbours(threshold: float, cap: int):
    """Windows over rows ``(key, n, rem, rid)`` sorted by key and size: pairs ``(a, b)`` of one key that can still reach the threshold.

    The window of a record are the following ones of its key, up to the size that is too large for it.  A key of more than ``cap`` records comes out as
    rows (key, record) with ``hot`` set; it is never held.
    """

    def window(key, n, rem, rid, out):
        at, step = np.arange(len(key)), 0
        while len(at):
            step += 1
            at = at[at < len(key) - step]
            at = at[(key[at] == key[at + step]) & (n[at] >= threshold * n[at + step] - 1e-9)]
            ok = at[np.minimum(rem[at], rem[at + step]) >= _needed(n[at], n[at + step], threshold)]
            out.append((np.minimum(rid[ok], rid[ok + step]), np.maximum(rid[ok], rid[ok + step]), np.zeros(len(ok), bool)))

    def batch(out):
        a, b, hot = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(hot)], names=["a", "b", "hot"])

    def run(batches):
        kept, hot = None, None
        for b in batches:
            if not b.num_rows:
                continue
            new = [np.asarray(b.column(i)) for i in range(4)]
            out = []
            if hot is not None:  # the rest of a hot key goes on as it comes
                more = new[0] == hot
                out.append((new[0][more], new[3][more], np.ones(int(more.sum()), bool)))
                new = [x[~more] for x in new]
                hot = hot if more.all() else None
            if kept is not None:
                new = [np.concatenate(x) for x in zip(kept, new)]
            starts = np.flatnonzero(np.append(True, new[0][1:] != new[0][:-1])) if len(new[0]) else np.empty(0, int)
            sizes = np.diff(np.append(starts, len(new[0])))
            large = np.repeat(sizes > cap, sizes)
            last = int(starts[-1]) if len(starts) else 0
            if len(sizes) and sizes[-1] > cap:
                hot, last = new[0][-1], len(new[0])
            out.append((new[0][large], new[3][large], np.ones(int(large.sum()), bool)))
            done = np.flatnonzero(~large[:last])
            window(*(x[done] for x in new), out)
            kept = [x[last:] for x in new] if last < len(new[0]) else None
            yield batch(out)
        out = []
        if kept is not None:
            window(*kept, out)
        yield batch(out)

    return run


class History:
    """The accepted records of all deliveries, in files under one folder: sets, sorted runs of keys, and the verdict of every id.

    A run holds the keys of accepted records, sorted by key and set size and cut into ranges of the key, each in a folder of its own; runs of ids
    are kept likewise.  A delivery reads only the ranges that its own keys and ids fall into, and of the sets only the parts that hold a candidate.
    After ``fan_in`` runs of one level these are merged into one of the next, with more ranges.  The order of the shingles is fixed by the frequencies in the first delivery, and
    made anew, with all runs, when the history has grown eightfold or a key was hot, so that a phrase that many records share is never an early key.
    With a ``path``, a manifest there names the tables that count, written anew after each delivery; a later ``History`` on the
    same path goes on from it, and the folder is never deleted.  One writer at a time.  Without a path all goes at exit.
    """

    def __init__(
        self, spark: SparkSession, path: str | None, threshold: float = 0.8, shingle: int = 5, least_words: int = 8, fan_in: int = 8, cap: int = 512, range_rows: int = 2_000_000, most_broadcast: int = 2_000_000
    ):
        self.spark, self.path, self.threshold, self.shingle, self.least_words = spark, path, threshold, shingle, least_words
        self.fan_in, self.cap, self.range_rows, self.most_broadcast = fan_in, cap, range_rows, most_broadcast
        self.work = Workspace(spark, "history")
        self.root = path or f"{self.work.root}/kept"
        self.version, self.records, self.ordered = 0, 0, 0
        self.keys: list[list[dict]] = [[]]
        self.ids: list[list[dict]] = [[]]
        self.sets = 0
        self.order: str | None = None
        self.levels = np.zeros(COUNTERS, np.uint8)
        self.stale = False
        if path is not None:
            self._load()

    # what is kept

    def _form(self) -> dict:
        return {"threshold": self.threshold, "shingle": self.shingle, "least_words": self.least_words}

    def _fs(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _load(self) -> None:
        fs, p = self._fs("")
        names = [str(x.getPath().getName()) for x in fs.listStatus(p)] if fs.exists(p) else []
        names = sorted(n for n in names if n.startswith("manifest-") and n.endswith(".json"))
        if not names:
            return
        stream = fs.open(self._fs(names[-1])[1])
        m = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        if m["form"] != self._form():
            raise ValueError(f"the history in {self.root} was made with {m['form']}")
        self.version, self.records, self.ordered, self.stale = int(names[-1][9:-5]), m["records"], m["ordered"], m["stale"]
        self.keys, self.ids, self.sets = m["keys"], m["ids"], m["sets"]
        if m["order"]:
            self._use(m["order"])

    def _save(self, old: list[str]) -> None:
        """Name the tables that count, in a new manifest; then ``old`` ones, merged into others, can go."""
        fs, _ = self._fs("")
        self.version += 1
        m = {"form": self._form(), "keys": self.keys, "ids": self.ids, "sets": self.sets, "order": self.order, "records": self.records, "ordered": self.ordered, "stale": self.stale}
        _, part = self._fs(f"_manifest-{self.version:09d}")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        _, last = self._fs(f"manifest-{self.version:09d}.json")
        if not fs.rename(part, last):
            raise OSError(f"{last.toString()} could not be written")
        if self.version > 1:
            fs.delete(self._fs(f"manifest-{self.version - 1:09d}.json")[1], False)
        for name in old:
            fs.delete(self._fs(name)[1], True)

    def _name(self, kind: str) -> str:
        return f"{kind}-{uuid.uuid4().hex[:12]}"

    def _run(self, df: DataFrame, rows: int, kind: str, by: list[str]) -> dict:
        """Write a run sorted by its key, the first of ``by``, a folder per range; a hot range takes several tasks."""
        bits = min(BITS, max(0, int(np.ceil(np.log2(max(1, rows / self.range_rows))))))
        name = self._name(kind)
        df = df.withColumn("range", F.shiftright(by[0], 63 - bits).cast("int"))
        df = df.coalesce(1) if rows <= self.range_rows else df.repartitionByRange(*by)
        df.sortWithinPartitions("range", *by).write.option("compression", "zstd").partitionBy("range").parquet(f"{self.root}/{name}")
        fs, p = self._fs(name)
        ranges = [int(x.getPath().getName()[6:]) for x in fs.listStatus(p) if x.getPath().getName().startswith("range=")]
        return {"name": name, "rows": rows, "bits": bits, "ranges": sorted(ranges)}

    def _ranges(self, levels: list[list[dict]], schema: str, wanted: set[int]) -> DataFrame:
        """The rows of the runs in the ranges that the leading bits in ``wanted`` fall into."""
        paths = []
        for run in (r for level in levels for r in level):
            hit = {x >> (BITS - run["bits"]) for x in wanted}
            paths += [f"{self.root}/{run['name']}/range={x}" for x in run["ranges"] if x in hit]
        reader = self.spark.read.schema(schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def _leading(df: DataFrame, column: str) -> set[int]:
        """The leading bits of a column of keys: at most 4,096 numbers."""
        return {r[0] for r in df.select(F.shiftright(column, 63 - BITS).cast("int")).distinct().collect()}

    def _few(self, df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= self.most_broadcast else df

    def _set_rows(self, parts: list[tuple[int, int]] | None = None) -> DataFrame:
        """``(d, a, part, bag)`` of the deliveries' sets, all or those in the given parts ``(d, slab)``."""
        if parts is None:
            paths = [f"{self.root}/d={d}" for d in range(self.sets)]
        else:
            paths = [f"{self.root}/d={d}/slab={k}" for d, k in sorted(parts)]
        rows = self.spark.read.option("basePath", self.root).schema(SETS + ", rid bigint, d int, slab int").parquet(*paths)
        return rows.select("d", F.col("rid").alias("a"), "part", "bag")

    # the order of the shingles

    def _use(self, name: str) -> None:
        rows = self.spark.read.schema("counter int, level int").parquet(f"{self.root}/{name}").toArrow()
        self.order, self.levels = name, np.zeros(COUNTERS, np.uint8)
        if rows.num_rows:
            self.levels[np.asarray(rows.column("counter").combine_chunks())] = np.asarray(rows.column("level").combine_chunks())

    def _new_order(self, bags: DataFrame) -> str:
        """Levels of frequency, the logarithms of a million counters that all shingles share by their hash: a frequent shingle is never taken for a rare one."""
        counter = F.col("h").bitwiseAND(F.lit(COUNTERS - 1)).cast("int").alias("counter")
        each = bags.select(F.explode("bag").alias("h")).groupBy(counter).agg(F.count(F.lit(1)).alias("n"))
        name = self._name("order")
        each.where("n > 1").select("counter", F.floor(F.log2("n")).cast("int").alias("level")).write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return name

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return rows.select("rid", "part", "bag").mapInArrow(_keys(self.threshold, self.levels), KEYED)

    def _reorder(self) -> list[str]:
        """Make the order anew from all accepted records, and write their keys as one run."""
        gone = [r["name"] for level in self.keys for r in level] + [self.order]
        pick = self._ranges(self.keys, "key bigint, n int, rem int, d int, rid bigint", set(range(1 << BITS))).select("d", "rid").distinct()
        rows = self._set_rows().withColumnRenamed("a", "rid").join(pick, ["d", "rid"], "left_semi")
        rows = self.work.cut(rows.select("d", "rid", "part", "bag", F.monotonically_increasing_id().alias("at")), "accepted")
        self._use(self._new_order(rows))
        keyed = self._keyed(rows.select(F.col("at").alias("rid"), "part", "bag")).withColumnRenamed("rid", "at").join(rows.select("at", "d", "rid"), "at")
        keyed = self.work.cut(keyed.select("key", "n", "rem", "d", "rid"), "keys", True)
        self.keys = [[] for _ in self.keys]
        self.keys[-1].append(self._run(keyed, keyed.rows, "keys", ["key", "n"]))
        self.ordered, self.stale = self.records, False
        return gone

    def _compact(self) -> list[str]:
        """Merge runs by levels; returns the tables that are no longer read."""
        gone = []
        for levels, schema, kind, by in ((self.keys, "key bigint, n int, rem int, d int, rid bigint", "keys", ["key", "n"]), (self.ids, "h bigint, id string, rejected boolean", "ids", ["h"])):
            level = 0
            while level < len(levels) and len(levels[level]) >= self.fan_in:
                merged = self._ranges([levels[level]], schema, set(range(1 << BITS)))
                run = self._run(merged, sum(r["rows"] for r in levels[level]), kind, by)
                gone += [r["name"] for r in levels[level]]
                levels[level] = []
                if level + 1 == len(levels):
                    levels.append([])
                levels[level + 1].append(run)
                level += 1
        return gone

    # a delivery

    def add(self, new: DataFrame) -> DataFrame:
        """Take a delivery ``(id string, part string, ord, text string)`` and return ``(id, rejected)`` for each id that takes part.

        Records count in the order ``(ord, id)``; one is rejected if a record accepted before, of this or an earlier delivery
        and of the same ``part``, has a Jaccard of its shingles of at least ``threshold``.  A delivery may hold several batches; the result
        is that of adding them one by one.  A repeated id counts once, at its first place, of several texts there that of the least digest; in a later delivery it keeps its first
        verdict.  Null ids and null, empty or
        short texts take no part and have no row.  Of equal texts in one part only the first is compared; the others follow
        it, since each is at least as similar to it as to anything that rejects it.
        The keys are the rarest shingles, which lose no pair of the threshold; what is compared are the records of a key whose size and remaining
        shingles allow it.  Keys of more than ``cap`` new records are not paired off: their members get keys by their own frequencies,
        and where one is hot again, its first records are compared with the rest, round by round.  No window is cut.
        """
        w = self.work
        source = new.where("id is not null").select("id", F.coalesce("part", F.lit("")).alias("part"), F.col("ord").cast("bigint").alias("ord"), "text")
        name = f"d={self.sets}"
        self._fs("")[0].delete(self._fs(name)[1], True)  # what a delivery that broke off has left
        hashed = source.mapInArrow(_sets(self.shingle, self.least_words), SETS).withColumn("rid", F.monotonically_increasing_id()).withColumn("slab", F.spark_partition_id())
        hashed.write.option("compression", "zstd").partitionBy("slab").parquet(f"{self.root}/{name}")
        every = self.spark.read.option("basePath", f"{self.root}/{name}").schema(SETS + ", rid bigint, slab int").parquet(f"{self.root}/{name}")
        once = every.groupBy("id").agg(F.min(F.struct("ord", "part", "cls", "rid", "slab")).alias("s")).select("id", "s.*")
        once = w.cut(once.withColumn("h", F.shiftrightunsigned(F.xxhash64("id"), 1)), "once", True)
        fresh, again = once, None
        if any(self.ids):
            known = self._ranges(self.ids, "h bigint, id string, rejected boolean", self._leading(once, "h"))
            again = w.cut(known.join(self._few(once.select("h", "id"), once.rows), ["h", "id"]).select("id", "rejected"), "again", True)
            fresh = once.join(again.select("id"), "id", "left_anti") if again.rows else once
        first = fresh.where("cls is not null").groupBy("part", "cls").agg(F.min(F.struct("ord", "id", "rid", "slab")).alias("s"))
        heads = w.cut(first.select("part", "s.*"), "heads", True)
        members = every.join(heads.select("rid"), "rid", "left_semi").select("rid", "part", "bag")
        old = []
        if self.order is None and heads.rows:
            self._use(self._new_order(members))
            self.ordered = heads.rows
        elif self.stale or self.records > 8 * max(self.ordered, 1000):
            old = self._reorder()
        keyed = w.cut(self._keyed(members), "keyed", True)
        rejected = self._rejected(keyed, heads, members).withColumn("no", F.lit(True))
        verdict = fresh.join(rejected, "rid", "left").join(heads.select("rid", F.lit(True).alias("head")), "rid", "left")
        verdict = verdict.select("h", "id", "rid", F.when(F.col("cls").isNotNull(), F.col("no").isNotNull() | F.col("head").isNull()).alias("rejected"))
        verdict = w.cut(verdict, "verdict")
        if once.rows:
            self.sets += 1
            self.ids[0].append(self._run(verdict.select("h", "id", "rejected"), once.rows, "ids", ["h"]))
        else:
            old.append(name)
        if keyed.rows:
            run = keyed.join(verdict.where("not rejected").select("rid"), "rid", "left_semi").select("key", "n", "rem", F.lit(self.sets - 1).alias("d"), "rid")
            self.keys[0].append(self._run(run, keyed.rows, "keys", ["key", "n"]))
            self.records += heads.rows
        self._save(old + self._compact())
        for t in (keyed, once, heads):
            w.drop(t)
        out = verdict.where("rejected is not null").select("id", "rejected")
        return out if again is None or not again.rows else out.unionByName(again.where("rejected is not null"))

    def _similar(self, pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
        """The pairs ``(d, a, b)`` of the same part that reach the threshold; ``left`` has ``d, a, part, bag`` and ``right`` ``b, part, bag``."""
        both = pairs.join(left.withColumnsRenamed({"part": "pa", "bag": "x"}), ["d", "a"]).join(right.withColumnsRenamed({"part": "pb", "bag": "y"}), "b").where("pa = pb")
        common = F.size(F.array_intersect("x", "y"))
        return both.withColumn("c", common).where(F.col("c") >= self.threshold * (F.size("x") + F.size("y") - F.col("c")) - 1e-9).select("d", "a", "b")

    def _met(self, keyed: DataFrame) -> DataFrame | None:
        """``(d, a, b)``: accepted records of deliveries ``d`` in the windows of new ones.

        The ranges of the history are streamed past the new keys, which are broadcast where their number allows it, so the history is not shuffled.
        """
        t = self.threshold
        if not any(self.keys):
            return None
        runs = self._ranges(self.keys, "key bigint, n int, rem int, d int, rid bigint", self._leading(keyed, "key"))
        met = runs.join(self._few(keyed.select("key", F.col("n").alias("nb"), F.col("rem").alias("rb"), F.col("rid").alias("b")), keyed.rows), "key")
        least = F.ceil(t / (1 + t) * (F.col("n") + F.col("nb")) - 1e-9)
        return met.where((F.least("n", "nb") >= t * F.greatest("n", "nb") - 1e-9) & (F.least("rem", "rb") >= least)).select("d", F.col("rid").alias("a"), "b").distinct()

    def _links(self, pairs: DataFrame, heads: DataFrame, members: DataFrame) -> DataFrame:
        """Verified pairs of new records, the older first."""
        new = F.lit(-1).alias("d")
        links = self._similar(pairs.select(new, "a", "b"), members.select(new, F.col("rid").alias("a"), "part", "bag"), members.select(F.col("rid").alias("b"), "part", "bag"))
        return self._in_order(links, heads).select("a", "b")

    def _in_order(self, links: DataFrame, heads: DataFrame) -> DataFrame:
        seq = lambda x: heads.select(F.col("rid").alias(x), F.struct("ord", "id").alias(f"{x}s"))
        swap = (F.col("d") < 0) & (F.col("as") > F.col("bs"))
        links = links.join(seq("a"), "a", "left").join(seq("b"), "b")
        return links.select("d", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))

    def _rejected(self, keyed: DataFrame, heads: DataFrame, members: DataFrame) -> DataFrame:
        """``(rid)`` of the new records that an accepted one, of the history or of this delivery, rejects."""
        w = self.work
        windows = lambda k: k.select("key", "n", "rem", "rid").repartition("key").sortWithinPartitions("key", "n").mapInArrow(neighbours(self.threshold, self.cap), "a bigint, b bigint, hot boolean")
        found, met = windows(keyed).select(F.lit(-1).alias("d"), "a", "b", "hot"), self._met(keyed)
        found = w.cut(found if met is None else found.unionByName(met.withColumn("hot", F.lit(False))), "windows", True)
        none = keyed.select("rid").limit(0)
        if not found.rows:
            return none
        # parts of tables that hold candidates, and whether a key was hot
        slabs = found.where("d >= 0 or hot").select("d", F.when(~F.col("hot"), F.shiftright("a", 33).cast("int")).alias("slab")).distinct().collect()
        sets = members.select(F.lit(-1).alias("d"), F.col("rid").alias("a"), "part", "bag")
        touched = [(r["d"], r["slab"]) for r in slabs if r["d"] >= 0]
        if touched:
            sets = sets.unionByName(self._set_rows(touched))
        links = self._similar(found.where("not hot").select("d", "a", "b").distinct(), sets, members.select(F.col("rid").alias("b"), "part", "bag"))
        links = w.cut(self._in_order(links, heads), "edges", True)
        if links.rows:
            none = links.where("d >= 0").select(F.col("b").alias("rid")).distinct()
        edges = links.where("d < 0").select("a", "b").join(none.withColumnRenamed("rid", "a"), "a", "left_anti").join(none.withColumnRenamed("rid", "b"), "b", "left_anti").select("a", "b")
        if not any(r["d"] < 0 for r in slabs):
            return none.union(self._state(edges).where("not ok").select("rid")) if links.rows else none
        hot = found.where("hot").select(F.col("b").alias("rid")).distinct().join(none, "rid", "left_anti")
        self.stale = True
        own = w.cut(members.join(hot, "rid", "left_semi"), "hot-members")
        found = w.cut(windows(self._own_keys(own)), "hot-windows")
        edges = w.cut(edges.union(self._links(found.where("not hot").select("a", "b").distinct(), heads, members)).distinct(), "edges")
        group = w.cut(found.where("hot").select(F.col("a").alias("key"), F.col("b").alias("rid")).distinct(), "hot")
        leaders = 16
        while not group.isEmpty():
            # the first records of each hot window are compared with all of it; one that is among the first everywhere can be decided
            at = F.row_number().over(Window.partitionBy("key").orderBy("ord", "id"))  # limited before the shuffle, as the filter shows
            lead = w.cut(group.join(heads.select("rid", "ord", "id"), "rid").withColumn("at", at).where(F.col("at") <= leaders).select("key", F.col("rid").alias("a")), "leaders")
            pairs = group.join(lead, "key").where("rid <> a").select(F.least("a", "rid").alias("a"), F.greatest("a", "rid").alias("b")).distinct()
            edges = w.cut(edges.union(self._links(pairs, heads, members)).distinct(), "edges")
            late = w.cut(group.withColumnRenamed("rid", "a").join(lead, ["key", "a"], "left_anti").select(F.col("a").alias("rid")).distinct(), "late")
            state = self._state(edges, late)
            out = w.cut(state.where("not ok").select("rid"), "rejected-hot")
            none = none.union(out)
            edges = w.cut(edges.join(out.select(F.col("rid").alias("a")), "a", "left_anti").join(out.select(F.col("rid").alias("b")), "b", "left_anti").select("a", "b"), "edges")
            decided = group.select("rid").distinct().join(late, "rid", "left_anti").join(state.where("ok is null").select("rid"), "rid", "left_anti")
            group = w.cut(group.join(out, "rid", "left_anti").join(decided, "rid", "left_anti").select("key", "rid"), "hot")
            leaders = min(4 * leaders, 1000)
        return none.union(self._state(edges).where("not ok").select("rid")).distinct()

    def _own_keys(self, rows: DataFrame) -> DataFrame:
        """Keys of hot records by the frequencies of the shingles among themselves."""
        each = rows.select("rid", "part", F.size("bag").alias("n"), F.explode("bag").alias("h"))
        df = each.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
        place = F.row_number().over(Window.partitionBy("rid").orderBy("df", "h")) - 1
        ranked = each.join(df, "h").withColumn("place", place).where((F.col("place") <= F.col("n") - F.ceil(self.threshold * F.col("n") - 1e-9)) & (F.col("df") > 1))
        return ranked.select(F.xxhash64("part", "h").alias("key"), "n", (F.col("n") - F.col("place")).cast("int").alias("rem"), "rid")

    def _state(self, edges: DataFrame, undecided: DataFrame | None = None) -> DataFrame:
        """``(rid, ok)`` of the newer ends of links ``(a older, b newer)``: accepted, rejected, or null where it waits for an ``undecided`` record.

        In each round a record is rejected if an older neighbour is accepted, and accepted if all are rejected.
        """
        w = self.work
        start = edges.select(F.col("a").alias("rid")).join(edges.select(F.col("b").alias("rid")), "rid", "left_anti").distinct()
        if undecided is not None:
            start = start.join(undecided, "rid", "left_anti")
        start = start.select("rid", F.lit(True).alias("ok"))
        known, waiting = start, None
        while True:
            each = edges.join(known.select(F.col("rid").alias("a"), "ok"), "a", "left").groupBy("b").agg(F.max("ok").alias("any"), F.count(F.lit(1)).alias("n"), F.count("ok").alias("k"))
            ok = F.when(F.col("any"), F.lit(False)).when(F.col("n") == F.col("k"), F.lit(True))
            each = each.select(F.col("b").alias("rid"), ok.alias("ok"))
            if undecided is not None:  # it may be rejected, but not yet accepted
                late = undecided.select("rid", F.lit(True).alias("late"))
                each = each.join(late, "rid", "left").select("rid", F.when(F.col("late").isNull() | ~F.col("ok"), F.col("ok")).alias("ok"))
            state = w.cut(each, "state", True)
            left = state.where("ok is null").count() if state.rows else 0
            if left == 0 or left == waiting:
                return state
            waiting, known = left, start.union(state)
