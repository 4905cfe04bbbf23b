import numpy as np
import pytest

from veldspar.llm import vectors as V
from veldspar.llm.clusters import _spread, louvain, similarity_clusters
from veldspar.llm.graph import connected_components
from veldspar.llm.similar import most_similar
from veldspar.session import Workspace

SCHEMA = "chunk_id string, ingest_seq bigint, mu array<double>, sigma_diag array<double>, vec string, a int"
D = 16


def clustered(seed=1, clusters=12, size=15, noise=150, spread=0.05):
    rng = np.random.default_rng(seed)
    x = np.vstack([np.repeat(rng.normal(size=(clusters, D)), size, axis=0) + 0, rng.normal(size=(noise, D))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[: clusters * size] += rng.normal(scale=spread, size=(clusters * size, D))
    return x / np.linalg.norm(x, axis=1, keepdims=True), rng.uniform(1e-4, 1e-2, size=x.shape)


def frame(spark, rows):
    return spark.createDataFrame([(k, s, None if m is None else [float(v) for v in m], None if c is None else [float(v) for v in c], "x", 1) for k, s, m, c in rows], SCHEMA)


def rows_of(x, s):
    return [(f"c{i:05d}", 1, x[i], s[i]) for i in range(len(x))]


def brute(x, s, k=5, limit=0.25):
    v = np.hstack([x, np.sqrt(s)])
    d = ((v[:, None] - v[None]) ** 2).sum(-1)
    np.fill_diagonal(d, 9)
    out = set()
    for i in range(len(v)):
        for j in np.lexsort((np.arange(len(v)), np.round(d[i], 12)))[:k]:
            if d[i, j] <= limit:
                out.add((i, int(j)))
    return out


@pytest.mark.parametrize("cap", [2048, 16])
def test_recall_against_brute_force(spark, cap):
    x, s = clustered()
    got = {(int(r.id[1:]), int(r.neighbour[1:])) for r in most_similar(frame(spark, rows_of(x, s)), Workspace(spark, "t"), d=D, cap=cap).collect()}
    want = brute(x, s)
    assert len(got & want) >= 0.95 * len(want)


def test_copies_versions_and_odd_rows(spark):
    one, s = np.eye(D)[0], np.full(D, 0.01)
    rows = [(f"k{i:02d}", 1, one, s) for i in range(20)]
    rows += [("k00", 0, np.eye(D)[1], s), ("k01", 1, one, s), ("n", 1, None, s), ("m", 1, one, None), ("z", 1, np.zeros(D), s), ("w", 1, one[:-1], s), ("g", 1, one, -s), ("f", 1, one * np.nan, s), (None, 1, one, s), ("o", None, np.eye(D)[2], s)]
    got = most_similar(frame(spark, rows), Workspace(spark, "t"), d=D).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append((r["rank"], r.neighbour, r.distance))
    assert set(by) == {f"k{i:02d}" for i in range(20)}
    assert [n for _, n, _ in sorted(by["k19"])] == ["k00", "k01", "k02", "k03", "k04"]
    assert [n for _, n, _ in sorted(by["k02"])] == ["k00", "k01", "k03", "k04", "k05"]
    assert all(d == 0 for v in by.values() for *_, d in v)
    empty = frame(spark, rows).limit(0)
    assert most_similar(empty, Workspace(spark, "t"), d=D).count() == 0
    assert similarity_clusters(empty, Workspace(spark, "t"), d=D).count() == 0


def test_blocks_of_equal_codes_meet(spark):
    df = spark.createDataFrame([(i, bytearray([7, 7])) for i in range(40)], "rid bigint, code binary")
    rows = V.buckets(df, 16, 2, Workspace(spark, "t"), cap=10).collect()
    met, keys = set(), {}
    for r in rows:
        keys.setdefault(r.key, set()).add(r.rid)
    for m in keys.values():
        met |= {(a, b) for a in m for b in m if a < b}
    assert len(met) == 40 * 39 // 2


def test_clusters_equal_transitive_links(spark):
    x, s = clustered(4, spread=0.03)
    x[1] = x[0]
    rows = rows_of(x, s) + [("c00000", 2, 3 * x[0], None), ("n", 1, None, None), ("z", 1, np.zeros(D), None)]
    got = similarity_clusters(frame(spark, rows), Workspace(spark, "t"), d=D).collect()
    par = list(range(len(x)))

    def find(i):
        while par[i] != i:
            i = par[i]
        return i

    c = x @ x.T
    for a, b in zip(*np.where(c >= 0.82)):
        par[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for i in range(len(x)):
        groups.setdefault(find(i), []).append(i)
    want = {(f"c{k:05d}", f"c{i:05d}") for k, g in groups.items() if len(g) >= 5 for i in g}
    assert {(r.cluster_id, r.id) for r in got} == want
    for k in {r.cluster_id for r in got}:
        mine = [r for r in got if r.cluster_id == k]
        assert sum(r.typical for r in mine) == min(3, len(mine)) and {r.size for r in mine} == {len(mine)}


def test_louvain_finds_two_cliques():
    e = [(a, b) for g in (range(5), range(5, 10)) for a in g for b in g if a < b] + [(0, 5)]
    a, b = np.array(e).T
    c = louvain(a, b, np.ones(len(e)), 10)
    assert len(set(c[:5])) == len(set(c[5:])) == 1 and c[0] != c[9]


def test_large_components_over_all_tasks(spark):
    x, s = clustered(6, clusters=3, noise=20, spread=0.03)
    got = similarity_clusters(frame(spark, rows_of(x, s)), Workspace(spark, "t"), d=D, most_local=3).collect()
    assert {r.cluster_id for r in got} == {"c00000", "c00015", "c00030"}


def test_levels_over_all_tasks_reach_the_modularity_of_one_task(spark):
    rng = np.random.default_rng(4)
    block = np.arange(80) // 20
    e = [(a, b) for a in range(80) for b in range(a + 1, 80) if rng.random() < (0.4 if block[a] == block[b] else 0.01)]
    a, b = np.array(e).T

    def modularity(c):
        d = np.bincount(np.concatenate([a, b]), minlength=80)
        return (c[a] == c[b]).mean() - sum((d[c == k].sum() / (2 * len(e))) ** 2 for k in set(c.tolist()))

    df = spark.createDataFrame([(int(x), int(y), 1.0) for x, y in e], "a bigint, b bigint, s double")
    got = {r.k: r.community for r in _spread(df, Workspace(spark, "t"), 10).collect()}
    wide = np.array([got[i] for i in range(80)])
    assert modularity(wide) >= 0.95 * modularity(louvain(a, b, np.ones(len(e)), 80))


def test_components(spark):
    e = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (5, 5)]
    df = spark.createDataFrame([(b, a) if a % 3 else (a, b) for a, b in e], "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(df.repartition(7), Workspace(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert connected_components(df.limit(0), Workspace(spark, "t")).count() == 0


def test_clumps_joined_only_beyond_full_lists(spark):
    rng = np.random.default_rng(8)
    d, near = 64, 0.86
    x, want = [], {}
    for g in range(8):
        u, v = np.linalg.qr(rng.normal(size=(d, 2)))[0].T
        for centre in (u, near * u + np.sqrt(1 - near**2) * v):
            x += [centre + rng.normal(scale=0.004, size=d) for _ in range(25)]
        want |= {f"c{50 * g + i:05d}": f"c{50 * g:05d}" for i in range(50)}
    x += list(rng.normal(size=(1200, d)))
    x = np.array(x)
    got = similarity_clusters(frame(spark, rows_of(x, np.full(x.shape, 0.01))), Workspace(spark, "t"))
    assert {r.id: r.cluster_id for r in got.collect()} == want


def test_every_row_has_its_nearest_without_a_limit(spark):
    from veldspar.llm.queries import QUERIES

    x, s = clustered(3, noise=400)
    got = {(int(r.id[1:]), int(r.neighbour[1:])) for r in most_similar(frame(spark, rows_of(x, s)), Workspace(spark, "t"), d=D, limit=None).collect()}
    want = brute(x, s, limit=9)
    assert len(want) == 5 * len(x) and {i for i, _ in got} == set(range(len(x))) and len(got & want) >= 0.99 * len(want)
    root = "/root/testdata/sf0.001"
    rows = QUERIES["p1_neighbours"](spark, root).groupBy("id").count().collect()
    assert rows and all(r["count"] == 5 for r in rows)


def batches_of(columns, names, size):
    import pyarrow as pa

    return pa.Table.from_arrays(columns, names=names).combine_chunks().to_batches(max_chunksize=size)


def small_groups(seed=5, groups=400):
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    key = np.repeat(np.arange(groups), rng.integers(1, 15, groups))
    x = rng.normal(size=(len(key), D)) + 3 * rng.normal(size=(groups, D))[key] / np.sqrt(D)
    q, scale = V.quantise(x / np.linalg.norm(x, axis=1, keepdims=True), 1)
    vec = V.pack_rows(np.hstack([q.view(np.uint8), scale.view(np.uint8)]))
    return key, V.restore(q, scale), pa.array(key), pa.array(np.arange(len(key))), vec


@pytest.mark.parametrize("step", ["start", "join"])
def test_p6_small_groups_are_compared_many_at_a_time(monkeypatch, step):
    import pyarrow as pa

    from veldspar.llm import clusters as C

    key, x, keys, ids, vec = small_groups()
    worst = np.random.default_rng(1).uniform(0.3, 0.6, len(key)).astype(np.float32)
    calls, decode = [], V.decode
    monkeypatch.setattr(V, "decode", lambda *a: calls.append(1) or decode(*a))
    columns, names = [keys, ids, vec], ["v", "rid", "vec"]
    if step == "join":
        columns, names = [*columns, pa.array(worst)], [*names, "worst"]
    parts = batches_of(columns, names, 500)  # groups go on over the ends of batches
    run = C._start(D, 1, 20, 0.4) if step == "start" else C._local_join(D, 1, 20, 0.4)
    out = list(run(iter(parts)))
    got = {(a, b) for o in out for a, b in zip(o.column(0).to_pylist(), o.column(1).to_pylist())}
    c = x @ x.T
    least = 0.4 if step == "start" else np.maximum(worst, 0.4)[:, None]
    same = (key[:, None] == key[None]) & ~np.eye(len(key), dtype=bool)
    pairs = lambda m: set(zip(*(v.tolist() for v in np.nonzero(m & same))))
    assert len(got) > 1000 and pairs(c > least + 1e-5) <= got <= pairs(c > least - 1e-5)
    assert len(calls) <= len(parts) + 1


def test_p6_start_keeps_the_best_of_a_large_bucket():
    from veldspar.llm import clusters as C

    _, x, keys, ids, vec = small_groups(9, 330)
    one = batches_of([keys.take(np.zeros(len(x), int)), ids, vec], ["key", "rid", "vec"], 700)  # a run of more than one block of rows
    assert len(x) > 2048
    got = {}
    for o in C._start(D, 1, 5, 0.1)(iter(one)):
        for a, b in zip(o.column(0).to_pylist(), o.column(1).to_pylist()):
            got.setdefault(a, set()).add(b)
    c = x @ x.T
    np.fill_diagonal(c, -9)
    for i, row in enumerate(c):
        best = np.sort(row)[::-1]
        sure = {int(j) for j in np.flatnonzero(row > max(best[5], 0.1) + 1e-5)}
        assert sure <= got.get(i, set()) and len(got.get(i, set())) <= 6


def test_p6_meetings_are_all_pairs_of_two_components():
    from veldspar.llm import clusters as C

    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    for comp in (rng.integers(0, 40, 900), np.where(np.arange(900) < 600, 7, np.arange(900)), np.full(900, 3)):
        got = [(min(p), max(p)) for a, b, _ in C._meetings(x, comp, 2.0) for p in zip(a.tolist(), b.tolist())]
        a, b = np.nonzero(np.triu(x @ x.T >= 2.0, 1) & (comp[:, None] != comp[None]))
        assert len(got) == len(set(got)) and set(got) == set(zip(a.tolist(), b.tolist()))


def test_p6_components_are_joined_by_the_links_between_them_alone(spark, monkeypatch):
    from veldspar.llm import clusters as C

    seen, real = [], C.connected_components
    monkeypatch.setattr(C, "connected_components", lambda e, w: seen.append(e.count()) or real(e, w))
    rng = np.random.default_rng(8)
    u, v = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    x = np.array([c + rng.normal(scale=0.004, size=64) for c in (u, 0.86 * u + np.sqrt(1 - 0.86**2) * v) for _ in range(25)])
    got = similarity_clusters(frame(spark, rows_of(x, np.full(x.shape, 0.01))), Workspace(spark, "t")).collect()
    assert {(r.cluster_id, r.size) for r in got} == {("c00000", 50)}
    assert len(seen) == 2 and seen[0] > 100 and seen[1] == 1  # two clumps, one link of them


def test_p6_merged_components_and_rows_without_one(spark):
    from veldspar.llm import clusters as C

    comp = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "node bigint, component bigint")
    more = spark.createDataFrame([(2, 6, 1, 5), (6, 7, 5, 7), (3, 4, 3, 4)], "a bigint, b bigint, ca bigint, cb bigint")
    got = {(r.node, r.component) for r in C._merged(comp, more, Workspace(spark, "t")).collect()}
    assert got == {(1, 1), (2, 1), (5, 1), (6, 1), (7, 1), (8, 8), (9, 8), (3, 3), (4, 3)}


def test_p6_lists_take_one_shuffle(spark):
    from veldspar.llm import clusters as C

    e = spark.range(1000).selectExpr("id % 50 as a", "id % 37 as b", "cast(id as float) as s")
    best = C._best(e, 4)
    assert best._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = {}
    for i in range(1000):
        want.setdefault(i % 50, {})[i % 37] = i
    assert {(r.a, r.b, int(r.s)) for r in best.collect()} == {(a, b, s) for a, m in want.items() for b, s in sorted(m.items(), key=lambda x: -x[1])[:4]}


def test_louvain_of_several_graphs_is_that_of_each():
    rng = np.random.default_rng(2)
    node = rng.permutation(300) % 12  # graphs with their nodes mixed
    a, b = np.array([(i, j) for i in range(300) for j in range(i + 1, 300) if node[i] == node[j] and rng.random() < 0.3]).T
    w = rng.uniform(0.82, 1, len(a))
    com = louvain(a, b, w, 300, graph=node)
    for g in range(12):
        mine = np.flatnonzero(node == g)
        at = node[a] == g
        alone = louvain(np.searchsorted(mine, a[at]), np.searchsorted(mine, b[at]), w[at], len(mine))
        assert len(set(zip(com[mine].tolist(), alone.tolist()))) == len(set(com[mine].tolist())) == len(set(alone.tolist()))
    assert all(len(set(node[com == c])) == 1 for c in set(com.tolist()))


def test_fixed_binaries_of_slices_nulls_and_other_lengths():
    import pyarrow as pa

    rows = pa.array([b"ab", b"cd", b"ef"], pa.binary())
    assert V.fixed(rows.slice(1), np.uint8, 2).tolist() == [[99, 100], [101, 102]]
    assert V.fixed(rows.slice(3), np.uint8, 2).shape == (0, 2)
    for bad in (pa.array([b"ab", None]), pa.array([b"ab", b"c"])):
        with pytest.raises(Exception):
            V.fixed(bad, np.uint8, 2)
