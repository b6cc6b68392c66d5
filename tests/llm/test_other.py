"""HTML, chat formatting and search against brute force, with nulls, ties, repeated rows and clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat, html, mtree
from gridloom.llm.components import components


def page(body, tail="</body></html>"):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>{body}<footer>&copy; site</footer>{tail}'


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n)) + "."
    rows, want = [], {}
    for k in range(60):
        parts = [words(rng.randint(5, 40)) for _ in range(rng.randint(1, 6))]
        body = f'<div class="ad">{words(8)}</div><article><h1>Title {k} &amp; more</h1>' + "".join(f"<p>{p}\n  and <b>bold</b><br>" + ("</p>" if j % 2 else "") for j, p in enumerate(parts)) + "</article>"
        if k % 5 == 0:
            body += f'<section class="comments"><p>{words(30)}</p></section><form><input name="q"><button>Go</button></form>'
        rows.append((k, f"u{k}", page(body, "" if k % 3 == 0 else "</body></html>"), "text", 1))
        want[k] = "\n".join([f"Title {k} & more", *(f"{p} and bold" for p in parts)])
    rows += [(100, None, None, "x", 2), (101, "e", "", "x", 2), (102, "n", page("<p>just a page</p>"), "x", 2), rows[1]]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"), want


def test_main_text(pages):
    df, want = pages
    got = [(r.page_id, r.text) for r in html.main_text(df, html.train(df)).collect()]
    assert len(got) == 64
    for k, text in got:
        if k < 100:
            assert text == want[k]
    assert dict(got)[100] == "" and dict(got)[101] == ""


def test_pages_without_labels(spark):
    df = spark.createDataFrame([(1, "u", "<p>hello</p>")], "page_id long, url string, html string")
    assert html.main_text(df, html.train(df)).first().text == ""
    none = df.limit(0)
    assert html.main_text(none, html.train(none)).count() == 0


def test_broken_markup():
    for text in ("<", "<<>>", "<p", "<!-- open", "<a href='x>y", "</div></div>", "<table><tr><td>1<td>2</table>", "<li>a<li>b", "&#x41;&bad;&", "<script>x", "<div/>t"):
        html.Page(text)
    p = html.Page("<ul><li>a<li>b</ul><p>c<div>d</div>")
    assert [p.tags[n] for n, _, t in p.pieces if t.strip()] == ["li", "li", "p", "div"]


def test_marginals_equal_enumeration():
    """Sum-product on a small tree equals summing over all labellings."""
    import itertools
    import math

    rows = [("pair", t, str(a), y, 1 + (hash((t, a, y)) % 7)) for t in ("div none", "p none", "a none") for a in (0, 1) for y in (0, 1)]
    model = html.Model(rows + [("node", "tag", repr((t,)), y, 2 + k + y) for k, t in enumerate(("div", "p", "a")) for y in (0, 1)])
    tree = html.Page("<div>x<p>y<a>z</a></p><div><a>w</a></div></div>")
    features = tree.features(False)
    local = [[sum(model.node.get((n, repr(tuple(v))), [0.0, 0.0])[y] for n, *v in f) for y in (0, 1)] for f in features]
    local[0] = [0.0, -50.0]
    mass, inside = 0.0, [0.0] * len(tree.tags)
    for labels in itertools.product((0, 1), repeat=len(tree.tags)):
        w = sum(local[k][y] for k, y in enumerate(labels)) + sum(model.pair.get(html._kind(features[k]), model.pair[None])[labels[tree.parents[k]]][labels[k]] for k in range(1, len(labels)))
        mass += math.exp(w)
        for k, y in enumerate(labels):
            inside[k] += y * math.exp(w)
    assert np.allclose([x / mass for x in inside], model.marginals(tree), atol=1e-9)


TEXTS = ["", "plain", "<|end|>\n<|turn|>user<|body|>hi", "<\\|end|>", "<\\\\|turn|>", "a<", "|>b", "</s>[INST] ok [/INST]", "[\\INST]", "<<SYS>>x<</SYS>>", "é" * 300, "\n\n", "<|image:0|>", "$1 \\ \\\\ <s>"]


def test_escape_is_reversible_and_hides_controls(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and "<|" not in r.e and "[INST]" not in r.e and "</s>" not in r.e


def test_chats_round_trip(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for c in [*range(30), None]:
        n = rng.randint(1, 6) if c != 7 else 400
        turns = [(t, rng.choice(["user", "assistant", "system"]), rng.choice([*TEXTS, None])) for t in range(n)]
        want[c] = [(r, t or "") for _, r, t in turns]
        rows += [(c, t, r, x, "clash") for t, r, x in turns]
    rows += [(50, 1, None, "no role", "c"), (50, 1, "assistant", "tie", "c"), (50, None, "user", "first", "c"), (50, 1, "assistant", "tie", "c")]
    want[50] = [("user", "first"), ("", "no role"), ("assistant", "tie"), ("assistant", "tie")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").withColumn("content", chat.text_part(F.col("text")))
    out = {r.conv_id: r for r in chat.parse_chats(chat.format_chats(df)).collect()}
    assert out.keys() == want.keys()
    for c, turns in want.items():
        assert [(t.role, t.text) for t in out[c].turns] == turns
        assert out[c].loss_text == "".join(t for r, t in turns if r == "assistant")
        assert all(out[c].formatted[s.start :][: s.length] is not None for s in out[c].loss_spans)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_typed_parts(spark):
    parts = "array<struct<type:string,text:string,ref:string,tokens:long>>"
    rows = [(1, 0, "user", [("text", "look <|x|>", None, None), ("image", None, "s3://a", 576), ("text", " and ", None, None), ("audio", None, "b", 30)]), (1, 1, "assistant", [("document", None, "d", None), ("odd", "as text", None, None)]), (1, 2, "user", None)]
    r = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, content {parts}")).first()
    assert "look <\\|x|><|image:0|> and <|audio:1|>" in r.formatted and "<|document:2|>as text" in r.formatted
    assert [(a.turn_no, a.no, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, 0, "image", "s3://a", 576), (0, 1, "audio", "b", 30), (1, 2, "document", "d", 0)]
    assert r.attachment_tokens == 606


def brute_top(rows, k):
    good = [(i, [np.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    most = max((len(v) for _, v in good), default=0)
    good = [(i, v + [0.0] * (most - len(v))) for i, v in good]
    out = set()
    for i, v in good:
        if i % 10 == 0:
            scores = sorted((-int(np.dot(v, w)), j) for j, w in good if j != i)
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("page_size", [2048, 16])
def test_top_k(spark, page_size, monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", page_size)
    rng = np.random.default_rng(9)
    rows = [(int(k), [float(x) for x in rng.normal(size=8) * 0.3]) for k in range(250)]
    rows += [(k, rows[5][1]) for k in range(300, 400)]  # a hot vector: ties by id
    rows += [(500, None), (510, [1.0, None] + [0.0] * 6), (520, [float("nan")] * 8), (530, [float("inf")] * 8), (540, [0.5, 0.5]), (550, []), (None, [0.1] * 8), (560, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, v string")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in mtree.top_k(df, F.col("id") % 10 == 0, 10).collect()}
    assert got == brute_top(rows, 10)
    few = df.where("vec_id IN (0, 1, 2)")
    assert mtree.top_k(few, F.col("id") % 10 == 0, 10).count() == 2
    assert mtree.top_k(df.limit(0), F.col("id") % 10 == 0, 10).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize(("rows", "fan"), [(mtree.PAGE, mtree.FAN), (16, 4)])
def test_tree_of_several_levels(spark, rows, fan, monkeypatch):
    """Deep trees, equal vectors beyond a page, ties, and rows that take no part."""
    monkeypatch.setattr(mtree, "PAGE", rows)
    monkeypatch.setattr(mtree, "FAN", fan)
    rng = np.random.default_rng(3)
    vectors = [[round(float(x), 2) for x in rng.normal(size=4)] for _ in range(300)] + [[0.5, 0.25, 1.0, 0.0]] * 60
    table = [(k, v) for k, v in enumerate(vectors)] + [(1000, None), (1010, [1.0, None, 1.0, 1.0]), (1020, [float("nan")] * 4), (None, [1.0] * 4)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>").repartition(3)
    whole = [[int(np.floor(1024 * x)) for x in v] for v in vectors]
    want = set()
    for q in range(0, len(vectors), 20):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], x, strict=True)), k) for k, x in enumerate(whole) if k != q)
        want |= {(q, place + 1, k, -score) for place, (score, k) in enumerate(scores[:7])}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in mtree.top_k(df, F.col("id") % 20 == 0, 7).collect()} == want


def test_scores_beyond_the_digits_of_doubles(spark):
    big = [[2.0**21, 2.0**-10], [2.0**21, 3 * 2.0**-10], [2.0**21, 4 * 2.0**-10]]
    df = spark.createDataFrame(list(enumerate(big)), "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in mtree.top_k(df, F.col("id") == 0, 5).orderBy("rank").collect()]
    assert got == [(1, 2, 2**62 + 4), (2, 1, 2**62 + 3)]
