import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.functions import geometry as G
from veldspar.functions import text as X
from veldspar.functions import vectors as V
from veldspar.operators import encoding, etl, evaluation, lexical, retrieval, senses, store, taxonomy
from veldspar.plans import hybrid

RNG = np.random.default_rng(5)


def gaussian(spark, d=6, rank=2):
    m1, m2 = RNG.normal(size=(2, d))
    v1, v2 = RNG.uniform(0.1, 0.5, size=(2, d))
    l1, l2 = RNG.normal(scale=0.1, size=(2, rank, d))
    df = spark.createDataFrame([tuple(x.tolist() for x in (m1, v1, l1, m2, v2, l2))], "ma array<double>, va array<double>, la array<array<double>>, mb array<double>, vb array<double>, lb array<array<double>>")
    return df, (m1, v1, l1.T, m2, v2, l2.T)


def dense_elk(m1, v1, l1, m2, v2, l2):
    s = G.full(v1, l1) + G.full(v2, l2)
    gap = m1 - m2
    return -0.5 * (gap @ np.linalg.solve(s, gap) + np.linalg.slogdet(s)[1]) / len(m1)


def test_low_rank_elk_equals_dense(spark):
    df, g = gaussian(spark)
    got = df.select(G.elk_low_rank("ma", "va", "la", "mb", "vb", "lb")).first()[0]
    assert got == pytest.approx(dense_elk(*g), abs=1e-9)


def test_diagonal_forms_equal_matrix_forms(spark):
    df, (m1, v1, _, m2, v2, _) = gaussian(spark)
    none = np.zeros((6, 0))
    got = df.select(G.elk_diagonal("ma", "va", "mb", "vb"), G.wasserstein_diagonal("ma", "va", "mb", "vb"), G.fisher_rao_diagonal("ma", "va", "mb", "vb"), G.kl_diagonal("ma", "va", "mb", "vb"), G.bhattacharyya_diagonal("ma", "va", "mb", "vb")).first()
    s1, s2 = np.diag(v1), np.diag(v2)
    gap = m1 - m2
    kl = 0.5 * (np.log(np.linalg.det(s2) / np.linalg.det(s1)) - 6 + np.trace(np.linalg.solve(s2, s1)) + gap @ np.linalg.solve(s2, gap))
    mid = (s1 + s2) / 2
    bh = gap @ np.linalg.solve(mid, gap) / 8 + 0.5 * np.log(np.linalg.det(mid) / np.sqrt(np.linalg.det(s1) * np.linalg.det(s2)))
    want = [dense_elk(m1, v1, none, m2, v2, none), G.wasserstein_matrix(m1, s1, m2, s2), G.fisher_rao_matrix(m1, s1, m2, s2), kl, bh]
    assert list(got) == pytest.approx(want, rel=1e-6)


def test_rank_one_elk_equals_low_rank(spark):
    df, (m1, v1, _, m2, v2, _) = gaussian(spark)
    df = df.withColumn("lb", encoding.learned_factor(F.col("vb"))).withColumn("la", F.lit(None).cast("array<array<double>>"))
    a, b = df.select(G.elk_rank_one("ma", "va", "mb", "vb", encoding.rank_weight()), G.elk_low_rank("ma", "va", "la", "mb", "vb", "lb")).first()
    assert a == pytest.approx(b, abs=1e-9)


def test_point_query_uses_the_floor(spark):
    df, (m1, _, _, m2, v2, _) = gaussian(spark)
    a = df.select(G.elk_diagonal("ma", None, "mb", "vb")).first()[0]
    assert a == pytest.approx(dense_elk(m1, np.full(6, 1e-9), np.zeros((6, 0)), m2, v2, np.zeros((6, 0))), abs=1e-9)


def test_geodesic_ends_and_factorisation():
    a = np.cov(RNG.normal(size=(4, 30)))
    b = np.cov(RNG.normal(size=(4, 30)))
    assert np.allclose(G.geodesic(a, b, 0.0), a) and np.allclose(G.geodesic(a, b, 1.0), b)
    assert np.allclose(G.spd_root(a) @ G.spd_root(a), a)
    var, factor = G.diagonal_plus_low_rank(a, 4)
    assert np.trace(np.diag(var) + factor @ factor.T) >= np.trace(a) - 1e-9


def test_vectors_with_nulls_and_zeros(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0]), ([1.0], [1.0, 2.0])], "x array<double>, y array<double>")
    got = df.select(V.cosine("x", "y"), V.finite("x", 2), V.dot("x", "y")).collect()
    assert [r[0] for r in got] == [None, None, None]
    assert [r[1] for r in got] == [True, False, False]
    assert [r[2] for r in got] == [0.0, None, None]


def test_bm25_against_brute_force(spark):
    texts = ["alpha beta", "alpha alpha gamma", "delta", "", None, "beta café"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "alpha OR cafe"), (2, "missing"), (3, None)], "query_id int, text string")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in lexical.bm25(df, q).collect()}
    toks = [(t or "").replace("é", "e").split() for t in texts]
    n, avg = len(texts), sum(map(len, toks)) / len(texts)

    def score(i, terms):
        s = 0.0
        for t in terms:
            dfq = sum(t in x for x in toks)
            idf = math.log((n - dfq + 0.5) / (dfq + 0.5))
            tf = toks[i].count(t)
            if tf:
                s -= (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks[i]) / avg))
        return s

    assert set(got) == {(1, "0"), (1, "1"), (1, "5")}
    assert all(v == pytest.approx(score(int(c), ["alpha", "cafe"])) for (_, c), v in got.items())
    assert lexical.bm25(df.limit(0), q).count() == 0


@pytest.mark.parametrize(
    "text, want",
    [("a OR b", [("phrase", "a"), ("op", "OR"), ("phrase", "b")]), ("NOT x", [("phrase", "x")]), ("a AND NOT b", [("phrase", "a"), ("op", "AND"), ("phrase", "b")]), ("a OR", [("phrase", "a")]), ("OR AND", []), ("x-y", [("phrase", "x"), ("phrase", "y")])],
)
def test_sanitise(text, want):
    assert lexical.sanitise(text) == want


def test_boolean_precedence(spark):
    df = spark.createDataFrame([(1, "baz"), (2, "alpha beta"), (3, "alpha"), (4, None)], "i int, text string")
    assert sorted(r.i for r in df.where(lexical.match("baz OR alpha beta", F.col("text"))).collect()) == [1, 2]
    assert df.where(lexical.match("", F.col("text"))).count() == 0


def test_keywords(spark):
    df = spark.createDataFrame([("What is the Bures metric of bures Gaussians?",), ("the of",), ("",), (None,)], "text string")
    got = [r[0] for r in df.select(X.keywords(F.col("text"))).collect()]
    assert got == ["Gaussians OR Bures OR metric", "the OR of", '""', None]
    texts = ["How should I manage what cannot be around the insecure Mill-House?", "explain just now", "be-or not"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(X.keywords(F.col("text"))).collect()]
    assert got == ["Mill-House OR insecure", "explain OR just OR now", "be-or"]


def test_nearest_with_ties_nulls_and_other_lengths(spark):
    rows = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", None), ("e", [1.0])], "chunk_id string, mu array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, mu array<double>")
    got = [(r.chunk_id, r["rank"]) for r in retrieval.nearest(rows, q, 2).orderBy("rank").collect()]
    assert got == [("a", 1), ("b", 2)]
    assert retrieval.nearest(rows.limit(0), q, 2).count() == 0 and retrieval.nearest(rows, q.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        retrieval.nearest(rows, q, 2, "hamming")


def test_adaptive_cut(spark):
    keys = [0.0, 0.1, 0.2, 5.0, 5.1, 5.2, 5.3]
    df = spark.createDataFrame([(1, str(i), k) for i, k in enumerate(keys)] + [(2, "x", 1.0)], "query_id int, chunk_id string, sort_key double")
    got = retrieval.adaptive_cut(df)
    assert got.where("query_id = 1").count() == 5 and got.where("query_id = 2").count() == 1


def test_candidates_fill_and_cap(spark):
    hit = lambda rows: spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(rows)], "query_id int, chunk_id string, rank int")
    allowed = spark.createDataFrame([(1, c) for c in "abcdz"], "query_id int, chunk_id string")
    got = [r.chunk_id for r in retrieval.candidates(hit(["z", "q"]), hit(["a", "z"]), 4, allowed).orderBy("place").collect()]
    assert got == ["z", "a", "b", "c"]
    got = [r.chunk_id for r in retrieval.candidates(hit(["z", "q"]), hit(["a", "z"]), 3).orderBy("place").collect()]
    assert got == ["z", "q", "a"]


def test_gate_falls_back_to_all(spark):
    rows = [(1, "a", 0.9, 0.9, 0.1, 3.0, True, False), (1, "b", 0.1, 0.1, 0.9, 3.0, False, True), (2, "c", 0.1, 0.1, 0.9, None, None, None)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, p_rel double, p_evi double, p_con double, quality double, is_relevant boolean, is_contradictory boolean")
    assert sorted(r.chunk_id for r in retrieval.gate(df).collect()) == ["a", "c"]


def test_unknown_metric(spark):
    with pytest.raises(ValueError):
        retrieval.sort_key("cosine", F.lit(1.0), F.lit(1.0))


def test_diverse(spark):
    rows = [(1, "a", 1, [0.0, 0.0], [0.1, 0.1]), (1, "b", 2, [0.01, 0.0], [0.1, 0.1]), (1, "c", 3, [1.0, 0.0], [0.1, 0.1])]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, rank int, mu array<double>, sigma_diag array<double>")
    assert [r.chunk_id for r in retrieval.diverse(df).orderBy("rank").collect()] == ["a", "c"]


def test_hybrid_retrieve_prefers_the_lexical_hit_and_checks_metric(spark):
    rows = [("x", "the quorix valve", [0.0, 1.0], [0.1, 0.1]), ("y", "other words", [1.0, 0.0], [0.1, 0.1])]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, mu array<double>, sigma_diag array<double>")
    q = spark.createDataFrame([(1, "quorix", [1.0, 0.0])], "query_id int, text string, mu array<double>")
    got = hybrid.retrieve(chunks, q, adaptive=False, metric="w2").collect()
    assert {r.chunk_id: r.arm for r in got} == {"x": 0, "y": 1}
    with pytest.raises(ValueError):
        hybrid.retrieve(chunks, q, metric="nope")


def test_split_chunks():
    s = " ".join(f"This is sentence number {i}." for i in range(40))
    out = etl.split_chunks(s, 30, 5, 3)
    assert all(len(c.split()) <= 35 for c in out) and len(out) > 5
    assert out[1].split()[:5] == out[0].split()[-5:]
    assert etl.split_chunks(None) == [] and etl.split_chunks("  \n\n ") == []
    assert etl.split_chunks("One long paragraph here with many words indeed yes.\n\nTiny.", 128, 0, 10) == ["One long paragraph here with many words indeed yes. Tiny."]


def test_markdown_sections(spark):
    t = "intro\n# A\ntext a\n## B\ntext b\n# C\n\n## D\ntext d"
    df = spark.createDataFrame([("k", t), ("e", ""), ("n", None)], "id string, text string")
    got = [(r.level, r.breadcrumb, r.body) for r in etl.markdown_sections(df, "id").orderBy("section").collect()]
    assert got == [(0, "", "intro"), (1, "A", "text a"), (2, "A > B", "text b"), (2, "C > D", "text d")]


def test_numbered_and_questions(spark):
    t = "Law 1: First\nbody one\nmore\n\n## Law 2. Second\nbody two\nlaw 3: not one\nLaw IV\nlast"
    q = "Q: What is it?\nA: This.\n\nQuestion: Why?\nAnswer: Because\nof that."
    m = "intro\n## Big Part!\ntext a\n### Empty\n## B #\ntext b"
    df = spark.createDataFrame([("n", t), ("q", q), ("m", m), ("c", "Just a text. With two sentences."), ("one", "Law 1: alone\nbody"), ("e", " "), (None, None)], "id string, text string")
    got = {}
    for r in etl.structured(df, "id").collect():
        got.setdefault(r.id, []).append((r.part_id, r.section_number, r.structure_type, r.title, r.text))
    assert sorted(got["n"]) == [
        ("n-1", 1, "numbered_section", "Law 1: First", "Law 1: First\n\nbody one\nmore"),
        ("n-2", 2, "numbered_section", "Law 2: Second", "Law 2: Second\n\nbody two\nlaw 3: not one"),
    ]  # the heading of "Law IV" takes the next line as its title, as a line break may stand before it
    assert sorted(got["q"]) == [("q-qa-1", 1, "qa_pair", "What is it?", "Question: What is it?\nAnswer: This."), ("q-qa-2", 2, "qa_pair", "Why?", "Question: Why?\nAnswer: Because\nof that.")]
    assert sorted(got["m"]) == [("m-b", 3, "markdown_section", "B #", "B #\n\ntext b"), ("m-big-part", 1, "markdown_section", "Big Part!", "Big Part!\n\ntext a")]
    assert got["c"] == [("c-part-1", 1, "semantic_chunk", "Just a text", "Just a text. With two sentences.")]
    assert got["one"][0][2] == "semantic_chunk" and set(got) == {"n", "q", "m", "c", "one"}
    meta = {r.id: r.metadata for r in etl.structured(df, "id").where("section_number = 1").collect()}
    assert meta["q"] == {"corpus_title": "Q: What is it?", "question": "What is it?"} and meta["c"] == {"corpus_title": "Document", "chunk_index": "0"}
    assert etl.numbered_sections(df, "id").count() == 2 and etl.question_pairs(df, "id").count() == 2
    long = "word " * 20 + "end. " + "More text here."
    assert etl.chunk_title(long, "x") == "word word word word word word word word..." and etl.chunk_title(".", "x") == "x"


@pytest.mark.parametrize(
    "text, want",
    [
        ("<div><script>alert('bad');</script><p>This is &quot;quoted&quot; text &amp; caf&eacute; &mdash; so.<br/>Next line.</p></div>", "This is \"quoted\" text & café -- so. Next line."),
        ("This is a demon-\nstration of infor-\n  mation.", "This is a demonstration of information."),
        ("A single sentence\nbroken across lines by\na reader.\n\nParagraph two\nwith more.", "A single sentence broken across lines by a reader.\n\nParagraph two with more."),
        ("Page 14 of 95\n[10:30:15] Alice: Proceed.\n- 15 -\n[10:31] Bob: Agreed at [11:00 pm] today.\n3 / 9", "Alice: Proceed.\n\nBob: Agreed at today."),
        ("10:15 standup notes (9:30) 2024-01-02T03:04:05.678Z end", "10:15 standup notes (9:30) end"),
        ("Hello\u200bWorld! \u201cSmart\u201d \u2014 dash\u00a0here\u202f\u00ab\u201e\u2032\u201a\u0007", "HelloWorld! \"Smart\" -- dash here \"\"''"),
        ("Law 1: Never\nbody one\ngoes on\nLaw 2: Always\nbody two", "Law 1: Never\nbody one goes on\nLaw 2: Always\nbody two"),
        ("# Title\ntext\nmore\n- a\nb\n1. c\nQ: why\nso", "# Title\ntext more\n- a b\n1. c\nQ: why\nso"),
        ("", ""),
        (None, None),
    ],
)
def test_cleaning_rules(spark, text, want):
    assert spark.createDataFrame([(text,)], "text string").select(X.clean(F.col("text"))).first()[0] == want


def test_cleaning(spark):
    t = "<p>A &amp; B</p><script>x</script>\r\nPage 3 of 9\nhyphen-\nated word\n[00:12] said\nsoft­ wrap\nline “quoted”"
    got = spark.createDataFrame([(t,), (None,)], "text string").select(X.clean(F.col("text"))).collect()
    assert got[0][0] == "A & B\n\nhyphenated word said soft wrap line \"quoted\"" and got[1][0] is None


def test_store(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "z"), (None, 5, "n")], "k string, v bigint, t string")
    assert sorted((r.k, r.t) for r in store.latest(df, "k", "v").collect()) == [("a", "y"), ("b", "z")]
    base, new = df.where("k = 'b'"), df.where("v = 2").limit(1)
    assert sorted(r.k for r in store.upsert(base, new, "k").collect()) == ["a", "b"]
    assert store.delete(base, base, "k").count() == 0
    texts = spark.createDataFrame([(2, " x "), (1, "x"), (3, " "), (4, None)], "id int, text string")
    assert [(r.id, r.text) for r in store.first_of_equal_texts(texts, "id").collect()] == [(1, "x")]


def test_evaluation(spark):
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "z", 1)], "query_id int, chunk_id string, rank int")
    rel = spark.createDataFrame([(1, "b"), (1, "c"), (3, "q")], "query_id int, chunk_id string")
    got = {r.query_id: (r.recall, r.ndcg) for r in evaluation.retrieval(run, rel, 2).collect()}
    assert got[1] == pytest.approx((0.5, (1 / math.log2(3)) / (1 + 1 / math.log2(3)))) and got[2] == (0.0, 0.0) and got[3] == (0.0, 0.0)
    df = spark.createDataFrame([("a", 0.9, 1), ("b", 0.9, 0), ("c", 0.1, 0), ("d", 1.0, 1)], "k string, confidence double, outcome int")
    curve = [r.accuracy for r in evaluation.abstention_curve(df, "k").orderBy("answered").collect()]
    assert curve == pytest.approx([1.0, 1.0, 2 / 3, 0.5])
    e = spark.createDataFrame([("a a b b",), ("",), (None,)], "t string").select(evaluation.token_entropy(F.col("t"))).collect()
    assert [r[0] for r in e] == pytest.approx([1.0, 0.0, 0.0])


def test_senses(spark):
    df = spark.createDataFrame([(1, "a", "t", 0.0), (1, "b", "t", 0.0), (2, "c", "t", 0.5), (2, "d", "u", 0.5)], "packet_id int, sense_id string, term string, confidence double")
    w = senses.weights(df)
    assert {r.packet_id: r.entropy for r in senses.entropy(w).collect()} == {1: 0.0, 2: 1.0}
    assert senses.routed(w.where("packet_id = 2")).count() == 1
    new = spark.createDataFrame([("s1", "t", "d", 1, "Q  q", 0.9), ("s2", "t", None, 1, None, 0.2)], "sense_id string, term string, domain string, version int, retrieval_query string, confidence double")
    old = spark.createDataFrame([("s9", "t", "d", 1, "q q", 0.5)], "sense_id string, term string, domain string, version int, retrieval_query string, confidence double")
    got = {r.sense_id: (round(r.confidence, 6), r.upsert) for r in senses.remember(new, old).collect()}
    assert got == {"s1": (0.95, True), "s2": (0.2, False)}


def test_taxonomy_recovers_clusters(spark):
    rows = [(f"{c}-{i}", (np.eye(5)[c] + RNG.normal(scale=0.03, size=5)).tolist()) for c in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "chunk_id string, mu array<double>")
    leaves = taxonomy.spherical_kmeans(df, 3, "chunk_id")
    own = taxonomy.assign(df, leaves, "chunk_id").where("rank = 1").collect()
    found = {}
    for r in own:
        found.setdefault(r.leaf, set()).add(r.chunk_id[0])
    assert len(found) == 3 and all(len(x) == 1 for x in found.values())
    assert taxonomy.spherical_kmeans(df.limit(0), 3, "chunk_id").count() == 0


def test_principal_components(spark):
    x = RNG.normal(size=(50, 4)) @ np.diag([3.0, 2.0, 1.0, 0.1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [1.0])], "k int, mu array<double>")
    got = np.array([r.components for r in taxonomy.principal_components(df, "k").orderBy("k").collect()])
    c = x - x.mean(axis=0)
    want = c @ np.linalg.svd(c, full_matrices=False)[2][:3].T
    assert np.allclose(np.abs(got), np.abs(want))
    assert taxonomy.principal_components(df.limit(0), "k").count() == 0


def test_answers(spark):
    from veldspar.functions import answers

    df = spark.createDataFrame([('```json\n{"a": 1}\n```', "Yes", None), ("none", "yes", 0.2), (None, None, 0.7)], "t string, a string, p double")
    got = df.select(answers.parsed(F.col("t"), "a int")["a"], answers.yes_or_no(F.col("a"), F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(1, "yes"), (None, "no"), (None, "yes")]


def test_allowed_rows_are_filtered_before_the_dense_cut(spark):
    rows = [(i, "zz", [float(i), 1.0], [0.01, 0.01]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, mu array<double>, sigma_diag array<double>")
    q = spark.createDataFrame([(0, "aa", [0.0, 1.0]), (1, "aa", [0.0, 1.0])], "query_id int, text string, mu array<double>")
    narrow = [(1, i) for i in range(300, 400)]
    allowed = spark.createDataFrame([(0, i) for i in range(300)] + narrow, "query_id int, doc_id int")
    allowed = allowed.unionByName(spark.createDataFrame([(1, 150)], "query_id int, doc_id int"))
    near = retrieval.nearest_allowed(docs, q, allowed, 3, "l2", "doc_id")
    assert {(r.query_id, r.doc_id) for r in near.collect()} == {(0, 0), (0, 1), (0, 2), (1, 150), (1, 300), (1, 301)}
    got = hybrid.retrieve(docs, q, k=3, metric="w2", adaptive=False, allowed=allowed, key="doc_id").where("query_id = 1").collect()
    alone = hybrid.retrieve(docs, q.where("query_id = 1"), k=3, metric="w2", adaptive=False, allowed=allowed.where("query_id = 1"), key="doc_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, alone)) and {r.arm for r in got} == {1}


def test_kmeans_seeds_from_all_rows(spark):
    df = spark.range(2400).withColumnRenamed("id", "k")
    last = df.orderBy(F.xxhash64("k"), "k").tail(1)[0]["k"]  # beyond any sample of the least hashes
    vec = F.when(F.col("k") == last, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.rand(3) * 0.01))
    leaves = taxonomy.spherical_kmeans(df.select("k", vec.alias("mu")), 2, "k").collect()
    assert max(r.centroid[1] for r in leaves) > 0.999


def test_views_and_variances(spark):
    text = " ".join(f"W{i}" for i in range(70)) + " W1"
    df = spark.createDataFrame([(1, text), (2, "one"), (3, ""), (4, None), (5, "Paris Paris Lyon is the city")], "k int, text string")
    v = {r.k: r.v for r in df.select("k", encoding.views(F.col("text")).alias("v")).collect()}
    w = text.split()
    assert v[1] == [text, text.lower(), " ".join(w[:35]), " ".join(w[:32]), " ".join(w[-32:]), " ".join(dict.fromkeys(w)), " ".join(reversed(w[:64]))]
    assert v[2] == ["one"] * 7 and v[3] == [""] * 7
    scale = {r.k: r.s for r in df.select("k", encoding.entity_scale(F.col("text")).alias("s")).collect()}
    assert scale[5] == pytest.approx(2 / 3) and scale[2] == 0.5
    mu = [0.6, 0.8]
    got = {r.k: r.s for r in df.select("k", encoding.query_variance(F.col("text"), F.array(*map(F.lit, mu))).alias("s")).collect()}
    d = max(5 / 6, 2 / 3) * (1 - math.exp(-6 / 4))
    assert got[5] == pytest.approx([d * (m + 0.01) * 1e-2 for m in mu]) and got[2] == pytest.approx([m * 0.01 + 1e-4 for m in mu])
    x = [[0.3, -0.4], [0.1, 0.2]]
    fit = {r.dim: r.scale for r in encoding.fit_scale(spark.createDataFrame([(r,) for r in x], "mu array<double>")).collect()}
    m = np.abs(np.array(x)).mean(axis=0)
    assert [fit[0], fit[1]] == pytest.approx((m / np.linalg.norm(m)).tolist())
    scaled = np.abs([0.3, -0.4]) * np.array([fit[0], fit[1]])
    got = spark.range(1).select(encoding.learned_variance(F.array(F.lit(0.3), F.lit(-0.4)), F.array(F.lit(fit[0]), F.lit(fit[1])))).first()[0]
    assert got == pytest.approx((scaled / np.linalg.norm(scaled)).tolist())


def test_encode_modes(spark):
    df = spark.createDataFrame([(1, "Paris is a city. Paris grows."), (2, "Paris is a city. Paris grows."), (3, "other words entirely here now")], "k int, text string").withColumn("interpretations", F.array(F.lit("one view"), F.lit("another thing")))
    for mode in ("heuristic", "learned", "dissolver", "entity_aware"):
        rows = {r.k: r for r in encoding.encode(df, "k", mode, 16, 4).collect()}
        assert set(rows) == {1, 2, 3} and all(len(r.sigma_diag) == 16 and min(r.sigma_diag) >= 1e-6 for r in rows.values())
        assert rows[1].sigma_diag == rows[2].sigma_diag
    with pytest.raises(ValueError):
        encoding.encode(df, "k", "nope")
    assert all(r.sigma_diag is None for r in encoding.encode_query(df, "k").collect())
    assert all(len(r.sigma_diag) == 64 for r in encoding.encode_query(df, "k", "entity_aware").collect())
    w = {"w": np.eye(4).tolist(), "b": [0.0] * 4, "wd": np.full((4, 4), -1e3).tolist(), "bd": [0.0] * 4, "wl": np.full((8, 4), 1e3).tolist(), "bl": [0.0] * 8}
    r = encoding.head(spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "k int, mu array<double>"), "k", w).first()
    assert r.sigma_diag == [1e-4] * 4 and r.sigma_l == [[10.0] * 4] * 2


def test_general_forms_equal_diagonal_ones(spark):
    df, (m1, v1, l1, m2, v2, l2) = gaussian(spark)
    none = F.array().cast("array<array<double>>")
    got = df.select(G.elk_dense("ma", "va", none, "mb", "vb", none), G.kl("ma", "va", none, "mb", "vb", none), G.bhattacharyya("ma", "va", none, "mb", "vb", none)).first()
    want = df.select(G.elk_diagonal("ma", "va", "mb", "vb"), G.kl_diagonal("ma", "va", "mb", "vb"), G.bhattacharyya_diagonal("ma", "va", "mb", "vb")).first()
    assert list(got) == pytest.approx(list(want), rel=1e-6)
    assert df.select(G.elk_dense("ma", "va", "la", "mb", "vb", "lb")).first()[0] == pytest.approx(dense_elk(m1, v1, l1, m2, v2, l2), abs=1e-9)


def test_contexts(spark):
    hits = spark.createDataFrame([(1, 1, "a", "alpha", "low"), (1, 2, "b", "beta", "strange")], "query_id int, rank int, chunk_id string, text string, uncertainty_label string")
    q = spark.createDataFrame([(1, "why"), (2, None)], "query_id int, text string")
    got = {r.query_id: r.context for r in store.context(hits, q).collect()}
    assert got[1] == "[CONTEXT START]\n\n[QUERY] why\n\n[Chunk 1] — Confidence: HIGH\nalpha\n\n[Chunk 2] — Confidence: MEDIUM\nbeta\n\n[CONTEXT END]"
    assert got[2] == "[CONTEXT START]\n\n[QUERY] \n\n[CONTEXT END]"
    a = {r.query_id: r for r in store.extractive_answer(hits, q).collect()}[1]
    assert a.answer == "Query: why\nEvidence summary:\n- (low) alpha\n- (strange) beta" and a.prompt.endswith("[CONTEXT END]\n\nQUERY: why") and a.prompt.startswith("You are given")
    many = spark.createDataFrame([(1, 0, 1, "a", "alpha", "low"), (1, 1, 1, "a", "alpha", "low"), (1, 1, 2, "b", "beta", "high")], "query_id int, sense_order int, rank int, chunk_id string, text string, uncertainty_label string")
    senses_ = spark.createDataFrame([(1, 0, "law"), (1, 1, "tech"), (1, 2, "none")], "query_id int, sense_order int, domain string")
    got = store.multi_sense_context(many, q.where("query_id = 1"), senses_).first().context
    assert got == (
        "[CONTEXT START — MULTI-SENSE]\n\n[QUERY] why\n\n[Sense A: law]\n  [Chunk A1] — Confidence: HIGH\n  alpha\n\n"
        "[Sense B: tech]\n  [Chunk B2] — Confidence: LOW\n  beta\n\n[Sense C: none]\n  (no results for this sense)\n\n[CONTEXT END]"
    )


def test_index_reads_only_what_a_search_needs(spark, tmp_path):
    texts = [(str(i), f"term{i % 50} filler words number{i}") for i in range(300)] + [("x", None)]
    df = spark.createDataFrame(texts, "chunk_id string, text string")
    q = spark.createDataFrame([(1, "term7 OR number9"), (2, "absent")], "query_id int, text string")
    index = lexical.Index.write(df, str(tmp_path / "index"))
    key = lambda d: sorted((r.query_id, r.chunk_id, round(r.score, 9)) for r in d.collect())
    want = lexical.bm25(df, q)
    got = lexical.bm25(None, q, index=index)
    assert key(got) == key(want) and len(key(got)) == 7
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters: [In(term" in plan
    assert key(lexical.bm25(None, q, index=lexical.Index(spark, str(tmp_path / "index"), "chunk_id"))) == key(want)


def test_routing_counts_items_of_two_leaves_once(spark):
    leaves = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.8, 0.6]), (2, [0.0, 1.0])], "leaf int, centroid array<double>")
    members = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b"), (1, "c"), (2, "c"), (2, "d"), (2, "e")], "leaf int, chunk_id string")
    q = spark.createDataFrame([(1, [1.0, 0.1])], "query_id int, mu array<double>")
    got = [(r.leaf, r.items) for r in taxonomy.route(q, leaves, members, 1, 3).orderBy("place").collect()]
    assert got == [(0, 2), (1, 3)]
    assert taxonomy.route(q, leaves, members, 1, 50).count() == 3
    assert taxonomy.pruning(taxonomy.route(q, leaves, members, 1, 3), members).first().ratio == pytest.approx(0.4)
    answers_ = spark.createDataFrame([(1, "t1", {"t1": 0.6, "t2": 0.3, "t3": 0.02}), (2, "gone", {}), (3, None, {"t2": 0.9})], "query_id int, answer string, probabilities map<string,double>")
    b = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "branch string")
    chosen = taxonomy.branch_choice(answers_, b)
    assert sorted((r.query_id, r.branch, r.place) for r in chosen.collect()) == [(1, "t1", 1), (1, "t2", 2), (2, "t1", 1), (3, "t2", 1)]
    under = spark.createDataFrame([(0, "t1"), (1, "t1"), (2, "t2")], "leaf int, parent string")
    assert taxonomy.allowed_by_branch(chosen.where("query_id = 3"), under, members).count() == 3


def test_tree_of_topics_and_leaves(spark, tmp_path):
    from veldspar.session import Workspace

    rows = [(f"{c}-{i}", (np.eye(8)[c] + RNG.normal(scale=0.04, size=8)).tolist(), f"theme{'abc'[c]} words") for c in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "chunk_id string, mu array<double>, text string")
    tree = taxonomy.build(df, "chunk_id", Workspace(spark, "t"), 3, 10)
    nodes = {r.node: r for r in tree.nodes.collect()}
    assert nodes["root"].item_count == 60 and sum(r.item_count for r in nodes.values() if r.depth == 1) == 60 == sum(r.item_count for r in nodes.values() if r.depth == 2)
    assert {r.label.split(" / ")[0] for r in nodes.values() if r.depth == 1} == {"themea", "themeb", "themec"}
    m = tree.members.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_primary").cast("int")).alias("p")).collect()
    assert len(m) == 60 and all(r.p == 1 and r.n <= 2 for r in m)
    tree.save(str(tmp_path / "tree"))
    again = taxonomy.Taxonomy.load(spark, str(tmp_path / "tree"), 60)
    assert again.members.count() == tree.members.count() and taxonomy.Taxonomy.load(spark, str(tmp_path / "tree"), 61) is None and taxonomy.Taxonomy.load(spark, str(tmp_path / "none")) is None
    with pytest.raises(ValueError):
        taxonomy.build(df.limit(0), "chunk_id", Workspace(spark, "t"))
    # routing leaves out the other two thirds
    q = spark.createDataFrame([(1, "themea", np.eye(8)[0].tolist())], "query_id int, text string, mu array<double>")
    leaves = again.leaves.select("leaf", "centroid")
    allowed = hybrid.routed(q, leaves, again.members, least_leaves=1, least_items=8)
    assert 1 - allowed.count() / 60 >= 0.6 and {r.chunk_id[0] for r in allowed.collect()} == {"0"}
    full = df.withColumn("sigma_diag", F.array(*[F.lit(0.1)] * 8))
    got = hybrid.retrieve(full, q, 5, adaptive=False, tree=(leaves, again.members))
    assert got.count() == 5
    by = hybrid.retrieve_by_branch(full, q, spark.createDataFrame([(1, "topic-01", {})], "query_id int, answer string, probabilities map<string,double>"), again.leaves, again.members, adaptive=False)
    assert {r.chunk_id[0] for r in by.collect()} and by.count() == 5


def test_gate_diversity_and_senses(spark):
    rows = [("x", "quorix valve", [0.0, 1.0]), ("y", "quorix other", [1.0, 0.0]), ("z", "quorix bad", [0.9, 0.1]), ("w", "quorix valve", [0.0, 1.0])]
    chunks = spark.createDataFrame([(*r, [0.1, 0.1]) for r in rows], "chunk_id string, text string, mu array<double>, sigma_diag array<double>")
    q = spark.createDataFrame([(1, "quorix", [1.0, 0.0])], "query_id int, text string, mu array<double>")

    def scorer(found):
        bad = F.contains("text", F.lit("bad"))
        return found.select("query_id", "chunk_id", F.lit(0.9).alias("p_rel"), F.lit(0.9).alias("p_evi"), F.when(bad, 0.9).otherwise(0.0).alias("p_con"), F.lit(3.0).alias("quality"), F.lit(True).alias("is_relevant"), bad.alias("is_contradictory"))

    got = hybrid.retrieve_gated(chunks, q, scorer, 5, adaptive=False).collect()
    assert {r.chunk_id for r in got} == {"x", "y", "w"} and all(r.gating.passed for r in got)
    assert {r.chunk_id for r in hybrid.retrieve_diverse(chunks, q, 5, 0.3, adaptive=False).collect()} in ({"y", "x"}, {"y", "w"})
    s = spark.createDataFrame([(1, "s0", 0, 0.7, "valve", [0.0, 1.0]), (1, "s1", 1, 0.3, "other", [1.0, 0.0])], "query_id int, sense string, sense_order int, weight double, text string, mu array<double>")
    shares, fused = hybrid.retrieve_senses(chunks, s, 2, adaptive=False)
    assert fused.count() == 2 and {r.sense for r in shares.collect()} == {"s0", "s1"}
    assert hybrid.retrieve_senses(chunks, s, 2, fusion="weighted_sum", adaptive=False)[1].count() == 2
    with pytest.raises(ValueError):
        hybrid.retrieve_senses(chunks, s, fusion="nope")
    runs = spark.createDataFrame([("a", 1, "x", 1), ("b", 1, "y", 1)], "method string, query_id int, chunk_id string, rank int")
    rel = spark.createDataFrame([(1, "x")], "query_id int, chunk_id string")
    buckets = spark.createDataFrame([(1, "low")], "query_id int, bucket string")
    assert {(r.method, r.bucket): r.recall for r in hybrid.evaluate(runs, rel, 3, buckets).collect()} == {("a", "low"): 1.0, ("b", "low"): 0.0}


def test_senses_generated_chosen_and_kept(spark, tmp_path):
    schema = "term string, senses array<struct<domain:string,confidence:double,context_hints:array<string>,supporting_evidence:array<string>>>"
    two = [("law", 0.9, ["court", "bench", "judge", "plea"], None), ("tech", 0.1, None, None)]
    got = senses.generated(spark.createDataFrame([("Bar", two), ("one", two[:1]), ("", two), (None, two)], schema)).collect()
    assert [(r.term, r.domain, r.retrieval_query, len(r.sense_id)) for r in got] == [("bar", "law", "bar court bench judge", 16)]
    c = spark.createDataFrame([(1, 0, "a", "d", "the Bar exam now", 0.2), (1, 1, "b", "e", "t", 0.6), (1, 2, "c", "f", "t", 0.0), (2, 0, "z", "g", "t", None)], "query_id int, place int, label string, domain string, text string, probability double")
    got = {(r.query_id, r.label): (r.confidence, r.retrieval_query) for r in senses.chosen(c).collect()}
    assert got == {(1, "b"): (0.75, "t (b)"), (1, "a"): (0.25, "the Bar exam now (a)"), (2, "z"): (1.0, "t (z)")}
    w = spark.createDataFrame([("s", 0.05), ("t", 0.5), ("u", None)], "sense_id string, weight double")
    assert sorted(r.sense_id for r in senses.light(w).collect()) == ["s", "u"]
    kept = spark.createDataFrame([("s", "bar", 1), ("t", "bar", 48)], "sense_id string, term string, ttl_hours int").withColumn("created_at", F.timestamp_seconds(F.lit(1_700_000_000)))
    senses.save(kept, str(tmp_path / "s"))
    later = F.timestamp_seconds(F.lit(1_700_000_000 + 7200))
    assert [r.sense_id for r in senses.load(spark, str(tmp_path / "s"), later).collect()] == ["t"] == [r.sense_id for r in senses.of_term(kept, "bar", later).collect()]
    anchors_ = spark.createDataFrame([("s", [1.0, 0.0], [0.1, 0.1])], "sense_id string, mu array<double>, sigma_diag array<double>")
    chunks = spark.createDataFrame([("c", [1.0, 0.0], [0.1, 0.1]), ("d", [5.0, 0.0], [0.1, 0.1])], "chunk_id string, mu array<double>, sigma_diag array<double>")
    assert senses.nearest_passage(anchors_, chunks).first().w2 == pytest.approx(0.0, abs=1e-6)
    nodes = spark.createDataFrame([("a", {}), ("i", {"anchor_id": "a"}), ("j", {"anchor_id": "gone"})], "chunk_id string, metadata map<string,string>")
    assert [tuple(r) for r in store.anchors(nodes).collect()] == [("i", "a")]
    text = spark.createDataFrame([(1, "Court and Judge"), (2, "none")], "k int, text string")
    words = spark.createDataFrame([("law", ["court", "judge"]), ("tech", ["chip"])], "domain string, keywords array<string>")
    assert {(r.k, r.domain, r.hits) for r in senses.domains(text, words, "k").collect()} == {(1, "law", 2), (2, "general", 0)}
    old = spark.createDataFrame([("s", 0.5, "old")], "sense_id string, confidence double, t string")
    new = spark.createDataFrame([("s", 0.5, "new"), ("u", 0.1, "u")], "sense_id string, confidence double, t string")
    assert sorted((r.sense_id, r.t) for r in store.upsert_confident(old, new).collect()) == [("s", "new"), ("u", "u")]
    ids = spark.createDataFrame([(1, "u"), (2, "s"), (3, "none")], "place int, sense_id string")
    assert [r.sense_id for r in store.in_order(new, ids, "sense_id").collect()] == ["u", "s"]
    chats = spark.createDataFrame([("b", None, 1), ("x", "b", 5), ("y", "b", 9)], "session_id string, base_id string, mtime int")
    assert [r.session_id for r in store.branches(chats).collect()] == ["y", "x"]
