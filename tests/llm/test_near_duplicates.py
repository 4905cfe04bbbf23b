import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.llm.batch_dedup import History
from veldspar.llm.common import words
from veldspar.llm.near_duplicates import bag_min_hash, group_pairs, near_duplicate_groups
from veldspar.session import Workspace

SCHEMA = "id string, text string, version bigint, cls string, bag string, rid int, a int"


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= max(8, n) else set()


def brute_groups(rows, n, t):
    s = {k: shingles(x, n) for k, x in rows}
    s = {k: v for k, v in s.items() if v}
    par = {k: k for k in s}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in itertools.combinations(s, 2):
        if len(s[a] & s[b]) >= t * len(s[a] | s[b]):
            par[find(a)] = find(b)
    groups = {}
    for k in s:
        groups.setdefault(find(k), []).append(k)
    return {p for g in groups.values() for p in itertools.combinations(sorted(g), 2)}


def edited(rng, w, k):
    w = list(w)
    for _ in range(k):
        i = rng.randrange(len(w))
        rng.choice([lambda: w.__setitem__(i, f"new{rng.random():.6f}".replace(".", "")), lambda: w.pop(i), lambda: w.insert(i, "added")])()
    return " ".join(w)


def corpus(seed=1, families=25):
    rng = random.Random(seed)
    rows = []
    for f in range(families):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 60))]
        for j in range(rng.randrange(1, 6)):
            rows.append((f"r{f:03d}-{j}", edited(rng, base, rng.randrange(0, 3))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 0, "x", "y", 1, 2) for k, t in rows], SCHEMA)


def pairs(spark, rows, **kw):
    g = near_duplicate_groups(frame(spark, rows), Workspace(spark, "t"), **kw)
    return {(r.rec_lo, r.rec_hi) for r in group_pairs(g).collect()}


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    el = rng.integers(0, 2**62, 60).astype(np.uint64)
    wa, wb = rng.integers(0, 6, 60).astype(float), rng.integers(0, 6, 60).astype(float)
    doc = np.concatenate([np.zeros(60, int), np.ones(60, int)])
    keep = np.concatenate([wa, wb]) > 0
    sig = bag_min_hash(doc[keep], np.concatenate([el, el])[keep], np.concatenate([wa, wb])[keep], 3, 4096)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.03)
    assert np.isinf(sig[2]).all()


def test_groups_equal_brute_force(spark):
    rows = corpus()
    assert pairs(spark, rows, threshold=0.5, shingle=3) == brute_groups(rows, 3, 0.5)


def test_hot_buckets_equal_brute_force(spark):
    rng = random.Random(4)
    head = [f"h{i}" for i in range(30)]
    rows = [(f"a{i:03d}", " ".join(head + [f"x{rng.randrange(10**6)}" for _ in range(rng.choice([2, 20]))])) for i in range(60)] + corpus(5, 5)
    assert pairs(spark, rows, threshold=0.5, shingle=3, cap=4) == brute_groups(rows, 3, 0.5)


def test_bags_equal_brute_force(spark):
    from collections import Counter

    rng = random.Random(6)
    rows = []
    for f in range(12):
        base = [f"w{f}-{i}" for i in range(12)]
        rows += [(f"r{f}-{j}", " ".join(base + base[:6] * rng.randrange(0, 4))) for j in range(5)]
    bag = {k: Counter(zip(*(words(t)[i:] for i in range(3)))) for k, t in rows}
    par = {k: k for k in bag}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in itertools.combinations(bag, 2):
        if sum((bag[a] & bag[b]).values()) >= 0.8 * sum((bag[a] | bag[b]).values()):
            par[find(a)] = find(b)
    got = pairs(spark, rows, shingle=3, multiset=True)
    assert got == {(a, b) for a, b in itertools.combinations(sorted(bag), 2) if find(a) == find(b)}
    assert got != pairs(spark, rows, shingle=3)  # counts matter here


def test_odd_rows(spark):
    long = " ".join(f"z{i}" for i in range(30_000))
    t = "one two three four five six seven eight nine ten"
    rows = [("b", t), ("a", t.upper() + "!"), ("b", t), ("n", None), ("e", ""), ("s", "too short"), (None, t), ("l", long), ("m", long + " end")]
    got = near_duplicate_groups(frame(spark, rows), Workspace(spark, "t")).collect()
    assert {(r.id, r.group_id) for r in got} == {("a", "a"), ("b", "a"), ("l", "l"), ("m", "l")} and len(got) == 4
    assert near_duplicate_groups(frame(spark, rows).limit(0), Workspace(spark, "t")).count() == 0


def test_latest_version_counts(spark):
    t = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([("a", 1, t), ("a", 2, None), ("b", 1, t), ("c", None, "x " * 9), ("c", 1, t)], "id string, version bigint, text string")
    assert {r.id for r in near_duplicate_groups(df, Workspace(spark, "t")).collect()} == {"b", "c"}


BATCH = "id string, part string, ord bigint, text string, key string, rid int"


def brute_rejected(rows, t, n):
    kept, out = [], set()
    first = {}
    for k, p, o, x in rows:
        if k is not None and (k not in first or o < first[k][0]):
            first[k] = (o, p, x)
    for k, (o, p, x) in sorted(first.items(), key=lambda r: (r[1][0], r[0])):
        s = shingles(x, n)
        if not s:
            continue
        if any(q == (p or "") and len(s & u) >= t * len(s | u) for q, u in kept):
            out.add(k)
        else:
            kept.append((p or "", s))
    return out


def batches(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for f in range(n // 4):
        base = [f"w{rng.randrange(2000)}" for _ in range(25)]
        for j in range(rng.randrange(1, 7)):
            rows.append((f"r{rng.randrange(10**6):06d}-{f}-{j}", rng.choice(["x", "y", None]), rng.randrange(4), edited(rng, base, rng.randrange(0, 4))))
    return rows + rows[:3]


@pytest.mark.parametrize("cap", [512, 2])
def test_rejections_equal_one_by_one(spark, cap):
    rows = batches(9)
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], BATCH)
    h = History(spark, None, threshold=0.5, shingle=3, cap=cap)
    got = set()
    for part in (df.where("ord = 0"), df.where("ord > 0")):
        got |= {r.id for r in h.add(part).where("rejected").collect()}
    assert got == brute_rejected(rows, 0.5, 3)


def test_deliveries_one_by_one_and_compaction(spark):
    rows = [r for r in batches(3, 40)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], BATCH)
    h = History(spark, None, threshold=0.5, shingle=3, fan_in=2)
    got = set()
    for o in range(4):
        got |= {r.id for r in h.add(df.where(F.col("ord") == o)).where("rejected").collect()}
    assert got == brute_rejected(rows, 0.5, 3)
    assert len(h.keys) > 1 and len(h.ids) > 1


def test_a_small_delivery_reads_few_ranges(spark):
    rng = random.Random(12)
    rows = [(f"r{i:05d}", "p", 0, " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))) for i in range(3000)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], BATCH)
    h = History(spark, None, threshold=0.5, shingle=3, range_rows=500)
    assert not h.add(df).where("rejected").count()
    assert h.keys[0][0]["bits"] >= 6
    again = spark.createDataFrame([("z", "p", 1, rows[7][3] + " more", "k", 1)], BATCH)
    read = []
    ranges = h._ranges
    h._ranges = lambda levels, schema, wanted: read.append(len(wanted)) or ranges(levels, schema, wanted)
    assert [(r.id, r.rejected) for r in h.add(again).collect()] == [("z", True)]
    assert read and max(read) <= 11  # of 4,096 leading bits, those of ten keys


def test_the_order_is_made_anew_when_the_history_grows_or_a_key_is_hot(spark):
    rows = batches(8, 60)
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], BATCH)
    h = History(spark, None, threshold=0.5, shingle=3)
    got = set()
    for o in range(4):
        h.stale = o > 0
        got |= {r.id for r in h.add(df.where(F.col("ord") == o)).where("rejected").collect()}
        assert not h.stale
    assert got == brute_rejected(rows, 0.5, 3)


def test_batches_of_odd_rows(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [("a", None, 1, t), ("a", None, 1, t), ("b", None, 1, t.upper()), (None, "p", 1, t), ("n", "p", 1, None), ("s", "p", 1, "few words"), ("o", None, 0, t)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], BATCH)
    h = History(spark, None)
    assert h.add(df.limit(0)).count() == 0
    assert {(r.id, r.rejected) for r in h.add(df).collect()} == {("o", False), ("a", True), ("b", True)}
    assert {(r.id, r.rejected) for r in h.add(df.where("id = 'b'").withColumn("id", F.lit("z"))).collect()} == {("z", True)}


def test_history_goes_on_in_a_later_session(spark, tmp_path):
    path = f"file://{tmp_path}/history"
    rows = batches(3, 40)
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], BATCH)
    got, want = {}, brute_rejected(rows, 0.5, 3)
    for o in range(4):
        h = History(spark, path, threshold=0.5, shingle=3, fan_in=2)
        got |= {r.id: r.rejected for r in h.add(df.where(F.col("ord") == o)).collect()}
        h.work.close()  # as at exit
    assert {k for k, v in got.items() if v} == want and (tmp_path / "history").exists()
    again = History(spark, path, threshold=0.5, shingle=3, fan_in=2)
    assert {r.id: r.rejected for r in again.add(df).collect()} == got
    with pytest.raises(ValueError):
        History(spark, path, threshold=0.6, shingle=3)


def test_redelivered_ids_keep_their_first_verdict(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [("a", None, 0, t), ("b", None, 0, t), ("n", None, 0, None)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], BATCH)
    h = History(spark, None)
    first = {(r.id, r.rejected) for r in h.add(df).collect()}
    assert first == {("a", False), ("b", True)} == {(r.id, r.rejected) for r in h.add(df.withColumn("ord", F.lit(1)).withColumn("text", F.coalesce("text", F.lit(t)))).collect()}
