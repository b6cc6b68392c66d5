"""Registered queries on whole tables against SQL or a brute-force version."""

import hashlib
import os
import zlib
from collections import Counter
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest

from gridloom.llm import html, queries

SF = "/root/testdata/sf0.001"


def tokenizer(name):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path(name))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(queries.ORACLE[name])
    assert sorted(want.columns) == columns
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want.select(*columns).fetchall(), key=str)


def test_op1(spark, texts):
    t = tokenizer("byte_bpe_50k.json")
    want = {}
    for d, text in texts.items():
        ids = t.encode(text, add_special_tokens=False).ids
        want[d] = (len(ids), digest(np.array(ids, "<u4").tobytes()), digest(t.decode(ids, skip_special_tokens=False).encode()))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_bpe(spark, SF).collect()}
    assert got == want


def test_op2(spark, texts):
    rows = queries.op2_language_id(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert {r.doc_id: r.held_out for r in rows} == {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in texts}
    assert all(0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.held_out and lang[r.doc_id] and texts[r.doc_id].strip()]
    assert judged and np.mean([r.lang_pred == lang[r.doc_id] for r in judged]) >= 0.95


def test_op4(spark, texts):
    t = tokenizer("word_bpe_49k.json")
    want = {}
    for d, text in texts.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for k, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[d, k] = (start, len(part), zlib.crc32(part.tobytes()))
    rows = queries.op4_best_fit_packing(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(w[1] for w in want.values()) // 2048) + 2


class Article(HTMLParser):
    """Blocks of what an article holds, for pages whose mark-up names it."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("article", "h1", "p", "footer", "div"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in ("article", "h1", "p", "footer", "div"):
            self.blocks.append("")
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data

    def text(self):
        return "\n".join(b for b in (" ".join(b.split()) for b in self.blocks) if b)


@pytest.mark.parametrize("sf_dir", [SF, "/root/testdata/sf0.01"])
def test_op6(spark, sf_dir):
    """Every whole page against another parser."""
    rows = queries.op6_html_extraction(spark, sf_dir).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text) == (pages[r.page_id].url, Article(pages[r.page_id].html or "").text()) and r.n_chars == len(r.text)


def test_op6_marginals_of_whole_pages(spark):
    """Of every element of real pages: the sum over all labellings in which it is content, by the sum over all; an upward pass each."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = html.train(pages)

    def total(page, features, pairs, fixed):
        n = len(page.tags)
        up = np.zeros((n, 2))
        for k in range(n - 1, -1, -1):
            for name, *value in features[k]:
                up[k] += model.node.get((name, repr(tuple(value))), [0, 0])
            if k == 0 or page.tags[k] in html.SILENT:
                up[k] = 0, -50
            for c in range(k + 1, n):
                if page.parents[c] == k:
                    up[k] += [np.logaddexp(*(pairs[c][y] + up[c])) for y in (0, 1)]
            if k == fixed:
                up[k][0] = -np.inf
        return np.logaddexp(*up[0])

    for r in pages.orderBy("page_id").limit(6).collect():
        page = html.Page(r.html)
        features = page.features(False)
        pairs = [np.array(model.pair.get(html._kind(f), model.pair[None])) for f in features]
        whole = total(page, features, pairs, None)
        want = [np.exp(total(page, features, pairs, k) - whole) for k in range(len(page.tags))]
        assert np.allclose(model.marginals(page), want, atol=1e-9)


def test_op10(spark, texts):
    data, size = {d: t.encode() for d, t in texts.items()}, 400
    windows = {d: [hash(b[k : k + size]) for k in range(len(b) - size + 1)] for d, b in data.items()}
    counts = Counter(h for w in windows.values() for h in w)
    want = {}
    for d, b in data.items():
        gone = np.zeros(len(b) + 1, np.int64)
        for k, h in enumerate(windows[d]):
            if counts[h] > 1:
                gone[k] += 1
                gone[min(k + size, len(b))] -= 1
        cover = np.cumsum(gone)[: len(b)] > 0
        kept = np.frombuffer(b, np.uint8)[~cover].tobytes()
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        want[d] = (len(b), int(cover.sum()), spans, digest(kept))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op10_suffix_array_dedup(spark, SF).collect()}
    assert got == want and any(w[1] for w in want.values())
