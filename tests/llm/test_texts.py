import random

import pytest
import regex
from pyspark.sql import functions as F

from veldspar.llm import replies, residue, splitting
from veldspar.llm.common import words
from veldspar.llm.leaks import leaks
from veldspar.llm.packing import pack, plan, token_counts
from veldspar.session import Workspace


def check_pieces(text, limit, overlap):
    toks = regex.findall(r"\P{White_Space}+", text)
    spans = [m.span() for m in splitting.TOKEN.finditer(text)]
    out = splitting.cuts(len(spans), limit, overlap, splitting.boundaries(text, spans))
    assert out[0][0] == 0 and out[-1][1] == len(toks)
    assert all(e - s <= limit for s, e, _ in out)
    for (s0, e0, _), (s1, e1, _) in zip(out, out[1:]):
        assert s1 == e0 - min(overlap, limit - 1) and e1 > e0
    return out


def test_pieces_keep_to_limit_overlap_and_boundaries():
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(f"w{i}" + rng.choice([" ", " ", " ", ". ", "\n", "\n\n", "　", " ", "! "]) for i in range(rng.randrange(1, 300)))
        for limit, overlap in ((10, 3), (1, 0), (5, 9), (50, 0)):
            check_pieces(text, limit, overlap)
    kinds = [k for *_, k in check_pieces("a b.\n\nc d e f\ng h. i j k l m n o p", 5, 0)]
    assert kinds == ["paragraph", "line", "sentence", "hard", "end"]


def test_split_documents(spark):
    docs = spark.createDataFrame([("a", "x " * 30, " QA_Pair "), ("b", "y " * 3, None), ("c", None, "qa_pair"), ("d", "", ""), ("e", "z　z z", "none such")], "id string, text string, structure_type string")
    docs = docs.withColumn("piece", F.lit("clash"))
    conf = spark.createDataFrame([("default", 4, 1), ("qa_pair", 10, 2)], "structure_type string, max_tokens int, overlap_tokens int")
    got = splitting.split_documents(docs, conf).collect()
    assert {r.id: r.total for r in got} == {"a": 30, "b": 3, "e": 3}
    assert max(r.piece for r in got if r.id == "a") == 3
    assert splitting.split_documents(docs.limit(0), conf).count() == 0
    assert splitting.split_documents(docs, conf.limit(0)).count() == 3


def test_plan_fills_every_slot_once():
    rng = random.Random(2)
    hist = {n: rng.randrange(1, 60) for n in rng.sample(range(1, 101), 50)}
    rooms: dict[int, int] = {}
    placed = dict.fromkeys(hist, 0)
    for length, lo, hi, first, per in plan(hist, 100):
        assert lo == placed[length]
        placed[length] += hi - lo + 1
        for r in range(lo, hi + 1):
            c = first + (r - lo) // per
            rooms[c] = rooms.get(c, 0) + length
    assert placed == hist and max(rooms.values()) <= 100
    assert len(rooms) <= 11 / 9 * sum(k * v for k, v in hist.items()) / 100 + 1  # the bound of best fit by decreasing length
    assert plan({}, 10) == []


def test_pack(spark):
    rows = [(i, [3, 5, 10, 11, 25, 0, None][i % 7]) for i in range(140)]
    df = spark.createDataFrame(rows, "k int, tokens bigint")
    got = pack(df, "k", Workspace(spark, "t"), capacity=10).collect()
    size = {}
    for r in got:
        if r.container is not None:
            size[r.container] = size.get(r.container, 0) + r.tokens
    assert max(size.values()) <= 10
    by = {}
    for r in got:
        by.setdefault(r.k, []).append(r)
    assert all(sum(x.tokens for x in by[k]) == (t or 0) for k, t in rows)
    assert all(len(by[k]) == {25: 3, 11: 2}.get(t, 1) for k, t in rows)
    assert pack(df.limit(0), "k", Workspace(spark, "t")).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Don't stop_now, é!"), (2, None), (3, "")], "doc_id int, text string").withColumn("tokens", F.lit("clash"))
    assert {r.doc_id: r.tokens for r in token_counts(df, "doc_id").collect()} == {1: 7, 2: 0, 3: 0}


def test_leaks(spark):
    item = "The quorix valve near Marwell cost 40 days more than the brisk fund of Tarn while stocks last"
    other = "The quorix valve near Bolder cost 77 days more than the brisk fund of Sarn while stocks last"
    items = spark.createDataFrame([(1, item), (2, "short item text here"), (3, None), (4, ""), (5, item.replace("Marwell", "Yyy"))], "item_id bigint, text string")
    docs = [(1, f"Before it. {item.upper()}! After."), (2, " ".join(item.split()[2:14])), (3, " ".join(item.split()[2:13])), (4, f"x SHORT,item\ntext_here y"), (5, None), (6, ""), (7, other), (1, f"Before it. {item.upper()}! After.")]
    df = spark.createDataFrame([(k, t, "clash") for k, t in docs], "doc_id bigint, text string, item_id string")
    got = leaks(df, items)
    assert {(r.doc_id, r.item_id) for r in got.where("kind = 'verbatim'").collect()} >= {(1, 1), (2, 1), (4, 2)}
    assert not {r.doc_id for r in got.where("kind = 'verbatim'").collect()} & {3, 5, 6, 7}
    assert 7 in {r.doc_id for r in got.where("kind = 'parameters'").collect()}
    assert leaks(df.limit(0), items).count() == 0
    assert leaks(df, items.limit(0)).count() == 0


Q = "What does the quorix do to the retroactive appeal bundle?"
ANSWER = "The quorix limits the appeal bundle by 40 units, and clerks notice at first light."


@pytest.mark.parametrize(
    "question, answer, want",
    [
        (Q, None, "empty"), (Q, "", "empty"), (Q, " ​\t", "empty"), (Q, "N/A", "empty"), (Q, "<empty>", "empty"), (Q, "...", "empty"),
        (Q, ANSWER, None), (None, ANSWER, None), (Q, "12 days", None), (Q, "No.", None), (Q, "Twice a week", None), (Q, ANSWER + " [2][3]", None), (Q, f"“{ANSWER}”", None),
        (Q, ANSWER + " The other clerk of the market hall", "truncated"), (Q, ANSWER + "\n```\nset a = 4\nset b =", "truncated"), (Q, ANSWER + "\n```\nset a = 4\n```", None),
        (Q, "Key points:\n- first valve at the mill\n- second valve at the dock", None), (Q, "Key points:\n- first valve at the mill\n- second valve at the", "truncated"), (Q, ANSWER + " It stops because:", "truncated"), (Q, "Key points:\n- sheltered otter den at the dock\n* frost hollow at the office", None),
        (Q, "I'm sorry, but I can't help with that.", "refusal"), (Q, "Request refused.", "refusal"), (Q, "As an assistant, I must decline to discuss it. Try rephrasing the question.", "refusal"), (Q, "Sorry for the wait. " + ANSWER, None),
        (Q, "I can't give an exact figure, but the quorix limits the bundle steadily.", None), ("Warum?", "Diese Anfrage darf ich nicht beantworten.", "refusal"), (Q, "The old mill cannot provide it to clerks; it must decline any request. " + ANSWER, None),
        (Q, Q, "copy"), (Q, Q.upper().replace("?", "?!"), "copy"), (Q, f"You asked: {Q}", "copy"), (Q, f"{Q}\n{Q}", "copy"), (Q, f"You asked: {Q} {ANSWER}", None),
        (Q, "Der Bericht von Marn ist nicht bei der Klausel, und das Moor bleibt unverändert.", "language"), ("Say this in German: " + Q, "Der Bericht von Marn ist nicht bei der Klausel, und das Moor bleibt unverändert.", None), (Q, "По данным станции, клапан остаётся прежним.", "language"),
    ],
)
def test_replies(question, answer, want):
    assert replies.defect(question, answer) == want


def test_replies_table(spark):
    rows = [(1, Q, ANSWER), (1, Q, ANSWER), (2, Q, None), (None, Q, None), (3, None, None), (4, None, "x " * 50_000 + ".")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "turn_id bigint, user_msg string, ai_msg string, defect string")
    assert sorted((r.turn_id, r.defect) for r in replies.broken_replies(df).collect()) == [(2, "empty"), (3, "empty")]
    assert replies.broken_replies(df.limit(0)).count() == 0


def residue_rows():
    rng = random.Random(3)
    w = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    say = lambda: " ".join(rng.choices(w, k=12)).capitalize() + "."
    out, bad = [], set()
    errors = ["404 not found", "503 service unavailable.", "Access denied.", "Internal server error.", "Page not found"]
    notes = ["Please enable JavaScript to view this page.", "This page requires scripts.", "Your browser blocks scripts."]
    for i in range(400):
        text = " ".join(say() for _ in range(rng.randrange(1, 6)))
        kind = i % 8
        if kind == 0:
            text, _ = text + " " + rng.choice(["Dear {{ name }}, we are ready.", "According to [INSERT DATE], it stops.", "${email} keeps the stock.", "Contact: TODO: add title"]), bad.add(i)
        elif kind == 1:
            text, _ = "Home | About | Contact\n" + rng.choice(errors), bad.add(i)
        elif kind == 2:
            text, _ = rng.choice(notes) + "\nPowered by x gateway", bad.add(i)
        elif kind == 3:
            text += " The template engine swaps a tag such as {{ title }} for the stored value."
        out.append((i, text, f"host{i % 20}", "clash"))
    return out, bad


def test_residue(spark):
    rows, bad = residue_rows()
    rows += [(1000, None, None, "c"), (1001, "", None, "c"), (1002, "lorem ipsum dolor sit amet " * 2000, None, "c"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, kind string")
    got = {r.doc_id for r in residue.residue(df).collect()}
    bad = bad | {1002}
    assert len(got & bad) >= 0.95 * len(bad) and len(got - bad) <= 0.05 * len(bad)
    _, figures = residue.train(df)
    assert figures["accuracy"] > 0.95
    assert residue.residue(df.limit(0)).count() == 0


def test_words():
    assert words("Foo_bar é1, x") == ["foo", "bar", "é1", "x"] and words(None) == []


def test_answers_cut_inside_open_markup():
    from veldspar.llm.replies import is_truncated

    for cut in ("See the **final", "Run `make inst", "<ul><li>Mix the flour.</li>\n<li>Bake it.", "It is <b>done now."):
        assert is_truncated(cut), cut
    for whole in ("See the **final** part.", "Run `make install`.", "<ul><li>Mix the flour.</li>\n<li>Bake it.</li></ul>", "<p>One.\n<p>Two.", "2 ** 3 is 8.", "Use `a ** b` here.", "**Note** and `x`, 5 < 6.", "Line one.<br>Line two."):
        assert not is_truncated(whole), whole
