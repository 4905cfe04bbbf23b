"""Compact vectors, learned binary codes and bucket searches shared by the vector operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldspar.llm.common import GOLDEN, keep_by, mix
from veldspar.session import Workspace

TABLES, CAP, SAMPLE = 7, 2048, 20_000


def quantise(x: np.ndarray, halves: int) -> tuple[np.ndarray, np.ndarray]:
    """16-bit block floats: each row's ``halves`` equal parts have a scale of their own."""
    parts = x.reshape(len(x), halves, -1)
    scale = np.maximum(np.abs(parts).max(axis=2), 1e-300) / 32767
    return np.round(parts / scale[:, :, None]).astype(np.int16).reshape(len(x), -1), scale


def restore(q: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """float64 vectors of quantised ones; equal rows give equal vectors."""
    return (q.reshape(len(q), scale.shape[1], -1) * scale[:, :, None]).reshape(len(q), -1)


def fixed(column: pa.Array, dtype, width: int) -> np.ndarray:
    """A column of equally long binaries, none null, as a matrix."""
    if not len(column):
        return np.empty((0, width), dtype)
    if column.null_count:
        raise ValueError("a null among fixed binaries")
    size = width * np.dtype(dtype).itemsize
    flat = column.cast(pa.binary(size))  # an error where the lengths differ
    return np.frombuffer(flat.buffers()[1], np.uint8, len(flat) * size, flat.offset * size).view(dtype).reshape(-1, width)


def pack_rows(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m)
    n = m.shape[1] * m.itemsize
    return pa.Array.from_buffers(pa.binary(n), len(m), [None, pa.py_buffer(m.tobytes())]).cast(pa.binary())


def _arrays(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, rows that have exactly d numbers, none null)."""
    ok = np.asarray(column.value_lengths().fill_null(-1)) == d
    out = np.full((len(column), d), np.nan)
    if ok.any():
        flat = column.take(pa.array(np.flatnonzero(ok))).flatten()
        out[ok] = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return out, ok


def _compact(make: Callable, d: int, columns: int, halves: int, width: int):
    def run(batches):
        for b in batches:
            mats, oks = zip(*(_arrays(b.column(2 + i), d) for i in range(columns)))
            x, ok = make(*mats)
            ok &= np.logical_and.reduce(oks)
            x = np.where(ok[:, None], x, 0.0)
            q, scale = quantise(x, halves)
            raw = np.hstack([q.view(np.uint8), scale.view(np.uint8)])
            cls = [xxhash.xxh3_128_digest(r.tobytes()) for r in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok), pa.array(cls, pa.binary()), pack_rows(raw)], names=["id", "version", "ok", "cls", "vec"])

    return run


class Vectors:
    """The latest usable vector of each id, compact, in a written table.

    ``all``: ``(rid, vec, ...)`` of every row, of which a vector is 16-bit block floats and scales; ``names``: ``(rid, cls, id)``
    of the latest usable ones, and ``heads`` those to be searched.  ``copies`` are the ids of a vector beyond its first
    ``first`` ones: as neighbours they are never needed, and their own nearest are those first ones at distance 0.
    """

    def __init__(self, df: DataFrame, key: str, version: str, columns: list[str], make: Callable, d: int, halves: int, width: int, work: Workspace, first: int):
        self.work, self.width, self.halves = work, width, halves
        schema = "id string, version bigint, ok boolean, cls binary, vec binary"
        src = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(version).cast("bigint").alias("version"), *columns)
        src = src.mapInArrow(_compact(make, d, len(columns), halves, width), schema).withColumn("rid", F.monotonically_increasing_id())
        self.all = work.cut(src, "vectors")
        order = F.struct(F.coalesce("version", F.lit(-(2**63))).alias("v"), "ok", "cls", "rid")
        last = self.all.groupBy("id").agg(F.max(order).alias("s")).where("s.ok").select("id", "s.cls", "s.rid")
        at = F.row_number().over(Window.partitionBy("cls").orderBy("id")).alias("at")
        ranked = work.cut(last.select("id", "cls", "rid", at), "names")
        self.names = ranked.select("rid", "cls", "id")
        self.heads = ranked.where(F.col("at") <= first).select("rid", "cls")
        self.copies = ranked.where(F.col("at") > first).select("rid", "cls")
        self.first = ranked.where(F.col("at") < first).select("rid", "cls")
        self.rest = work.cut(self.all.select("rid").join(self.heads.select("rid"), "rid", "left_anti"), "rest")

    def rows(self) -> DataFrame:
        """``(rid, vec)`` of the heads."""
        return keep_by(self.all.select("rid", "vec"), self.rest, "rid", "left_anti")

    def some(self, rids: DataFrame) -> DataFrame:
        """``(rid, vec)`` of the given ones."""
        return keep_by(self.all.select("rid", "vec"), rids, "rid", "left_semi")

    def decode(self, column: pa.Array) -> np.ndarray:
        return decode(column, self.width, self.halves)


def decode(column: pa.Array, width: int, halves: int) -> np.ndarray:
    raw = fixed(column, np.uint8, width * 2 + halves * 8)
    q = np.ascontiguousarray(raw[:, : width * 2]).view(np.int16)
    return restore(q, np.ascontiguousarray(raw[:, width * 2 :]).view(np.float64))


def fit_rotation(x: np.ndarray, bits: int, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Iterative quantisation (Gong and Lazebnik 2011): the mean, and a projection whose signs are the code.

    Principal directions are turned by the rotation that brings the sample closest to the corners of a cube.  Codes longer
    than the dimension take several rotations.
    """
    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0)
    c = x - mean
    _, v = np.linalg.eigh(c.T @ c)
    v, parts = v[:, ::-1], []
    while bits > 0:
        b = min(bits, x.shape[1])
        p = c @ v[:, :b]
        r = np.linalg.qr(rng.normal(size=(b, b)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(p @ r > 0, 1.0, -1.0).T @ p)
            r = w.T @ u.T
        parts.append(v[:, :b] @ r)
        bits -= b
    return mean, np.hstack(parts)


def substring_bits(n: int) -> int:
    """Bits of a substring, so that a bucket of evenly spread codes holds some 30 of n."""
    return int(np.clip(round(np.log2(max(n, 2))) - 5, 6, 40))


def keys_of(bits: np.ndarray, table: int, length: int, start: int) -> np.ndarray:
    """Hash of ``length`` bits from ``start`` on, around the end of the code, and of the table."""
    at = (start + np.arange(length)) % bits.shape[1]
    h = np.full(len(bits), np.uint64(table + 1) * np.uint64(0x1000003))
    for i in range(0, length, 32):
        part = bits[:, at[i : i + 32]].astype(np.uint64)
        h = mix(h * np.uint64(3) + part @ (np.uint64(1) << np.arange(part.shape[1], dtype=np.uint64)) + GOLDEN)
    return h.view(np.int64)


def _key_rows(bits_total: int, tables: int, length: int, only: bool):
    def run(batches):
        for b in batches:
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1) if b.num_rows else np.empty((0, -(-bits_total // 8)), np.uint8)  # further bytes are carried along
            codes = np.unpackbits(raw[:, : -(-bits_total // 8)], axis=1)[:, :bits_total]
            k = np.asarray(b.column(0))
            s = bits_total // tables
            if only:  # rows of certain tables
                t = np.asarray(b.column(2))
                key = np.empty(len(k), np.int64)
                for j in set(t.tolist()):
                    at = t == j
                    key[at] = keys_of(codes[at], j, length, j * s)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(key)], names=["rid", "code", "t", "key"])
            else:
                key = np.concatenate([keys_of(codes, j, length, j * s) for j in range(tables)])
                idx = pa.array(np.tile(np.arange(len(k)), tables))
                yield pa.RecordBatch.from_arrays([b.column(0).take(idx), b.column(1).take(idx), pa.array(np.repeat(np.arange(tables, dtype=np.int32), len(k))), pa.array(key)], names=["rid", "code", "t", "key"])

    return run


def buckets(codes: DataFrame, bits: int, tables: int, work: Workspace, cap: int = CAP, whole: bool = False) -> DataFrame:
    """``(rid, code, key)``: each row of ``(rid, code)`` once per table, under its substring.

    A bucket of more than ``cap`` rows is cut by further bits of the code, four at a time, unless it is to stay ``whole``; rows
    that agree in the whole code, or of a whole bucket, are spread over blocks, and each pair of blocks is a bucket, so that
    no pair is lost and no bucket exceeds twice the cap.
    """
    schema = "rid bigint, code binary, t int, key bigint"
    length = bits // tables
    rows = codes.mapInArrow(_key_rows(bits, tables, length, False), schema)
    done = None
    while True:
        counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        hot = work.cut(counts.where(F.col("n") > cap), "hot")
        if hot.isEmpty():
            part = rows.select("rid", "code", "key")
            return part if done is None else done.unionByName(part)
        part = keep_by(rows, hot.select("key"), "key", "left_anti").select("rid", "code", "key")
        done = part if done is None else done.unionByName(part)
        if whole or length >= bits:
            break
        length = min(bits, length + 4)
        rows = work.cut(keep_by(rows, hot.select("key"), "key", "left_semi").select("rid", "code", "t"), "hot-rows").mapInArrow(_key_rows(bits, tables, length, True), schema)
    large = keep_by(rows if whole else rows.where("t = 0"), hot.select("key"), "key", "left_semi").join(hot, "key")
    blocks = F.ceil(F.col("n") / cap)
    large = large.withColumn("m", blocks).withColumn("i", F.pmod(F.xxhash64("rid"), blocks)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))
    large = large.select("rid", "code", F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"))
    return done.unionByName(large)


def groups(batches):
    """Runs of equal keys of a stream sorted by its first column, ``(key, *other columns)``; the caps above bound a run."""
    key, kept = None, []

    def run():
        return key, *(pa.concat_arrays([p.column(i) for p in kept]) for i in range(1, kept[0].num_columns))

    for b in batches:
        keys = np.asarray(b.column(0))
        if not len(keys):
            continue
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        ends = np.append(starts[1:], len(keys))
        for s, e in zip(starts.tolist(), ends.tolist()):
            if keys[s] != key:
                if kept:
                    yield run()
                key, kept = keys[s], []
            kept.append(b.slice(s, e - s))
    if kept:
        yield run()


def blocks(batches):
    """The same runs, all that end in a batch at a time: ``(starts, sizes, keys, *other columns)``."""
    kept = []

    def whole():
        columns = [pa.concat_arrays([p.column(i) for p in kept]) for i in range(kept[0].num_columns)]
        keys = np.asarray(columns[0])
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return starts, np.diff(np.append(starts, len(keys))), keys, *columns[1:]

    for b in batches:
        keys = np.asarray(b.column(0))
        if not len(keys):
            continue
        change = np.flatnonzero(keys[1:] != keys[:-1])
        last = int(change[-1]) + 1 if len(change) else 0  # where the run that may go on begins
        if last:
            kept.append(b.slice(0, last))
        if kept and (last or keys[0] != np.asarray(kept[-1].column(0))[-1]):
            yield whole()
            kept = []
        kept.append(b.slice(last))
    if kept:
        yield whole()


def stacked(starts: np.ndarray, sizes: np.ndarray, most: int = 1 << 20):
    """Places of the runs of two rows and more, those of one size together: matrices of a run a row, with no more than ``most`` pairs unless it is one run."""
    for m in np.unique(sizes[sizes > 1]).tolist():
        at = starts[sizes == m][:, None] + np.arange(m)
        step = max(1, most // (m * m))
        for s in range(0, len(at), step):
            yield at[s : s + step]


def active(rows: DataFrame, radius: int) -> DataFrame:
    """``(rid, key)`` of the bucket rows with another row of the bucket within a Hamming radius."""

    def run(batches):
        ks, keys = [], []
        n = 0
        for key, k, code in groups(batches):
            if len(k) < 2:
                continue
            c = np.unpackbits(fixed(code, np.uint8, len(code[0].as_py())), axis=1).astype(np.float32)
            ones = c.sum(axis=1)
            near = np.zeros(len(c), bool)
            for s in range(0, len(c), 1024):
                h = ones[s : s + 1024, None] + ones[None] - 2 * (c[s : s + 1024] @ c.T)
                h[np.arange(len(h)), np.arange(s, s + len(h))] = np.inf
                near[s : s + 1024] = (h <= radius + 0.5).any(axis=1)
            got = np.asarray(k)[near]
            if len(got):
                ks.append(got)
                keys.append(np.full(len(got), key))
                n += len(got)
            if n > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ks)), pa.array(np.concatenate(keys))], names=["rid", "key"])
                ks, keys, n = [], [], 0
        if ks:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ks)), pa.array(np.concatenate(keys))], names=["rid", "key"])

    by_key = rows.select("key", "rid", "code").repartition("key").sortWithinPartitions("key")
    return by_key.mapInArrow(run, "rid bigint, key bigint")
