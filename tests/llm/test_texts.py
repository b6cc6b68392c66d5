"""Operators over documents against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import bpe, langid, neardup, packing, quality, repeats, sharding, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, kept string, mixture string, _h string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["the", "ta", "ri", "mon", "el", "qua", "so"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(30, 300)) for _ in range(30)]
    passage = prose(rng, 120)
    out = list(base)
    for k in range(12):  # near copies, exact copies, a common passage, a repeated line
        words = base[k].split()
        words[len(words) // 2] = "changed"
        out += [" ".join(words), base[k].upper() if k % 2 else base[k], prose(rng, 20) + " " + passage + " " + prose(rng, 15)]
    line = prose(rng, 9)
    out += [None, "", "   \n\t", "one", "two words", "ab" * 600, "\n".join([line] * 90), prose(rng, 8000), "é" * 500 + " ñ ü ß", "1234 5678 !!"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en", "s", 0, "x", "y", "z", "w") for k, t in enumerate(texts)]
    rows += [rows[3], (None, "a text without an id the of and", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_measures(docs, texts):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for k, t in enumerate(texts):
        ws = (t or "").split()
        grams = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
        covered = {i + j for i in range(len(ws) - 7) if grams[tuple(ws[i : i + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if x.split()]
        assert (got[k].n_words, got[k].word_chars, got[k].n_repeat_words, got[k].n_dup_lines) == (len(ws), sum(map(len, ws)), len(covered), len(lines) - len(set(lines)))
        assert got[k].base_failed == (len(ws) < 20 or 100 * len(covered) > 30 * len(ws))
        assert not (got[k].kept and got[k].base_failed)


def test_bpe_equals_library(docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = bpe.encode_decode(docs, path).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is not None:
            ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
            assert np.frombuffer(r.ids, "<u4").tolist() == ids
            assert r.decoded == tok.decode(ids, skip_special_tokens=False)


def test_bpe_odd_white_space(spark):
    odd = ["  a  b", "x\xa0 \xa0y", "a\x1c b\x85c", "hi<|endoftext|>  there <|endoftext|>", "don't\n\n  stop\t\tnow ", "　漢字 かな  ", "é ́x", "1234 ５６ ½", "🎉 🎉🎉\r\n\r\nz", "'s 's  's", "﻿q", "\x0b \x0c v"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for name, run in (("byte_bpe_50k.json", lambda p: {r.doc_id: r.ids for r in bpe.encode_decode(df, p).collect()}), ("word_bpe_49k.json", lambda p: {r.doc_id: r.ids[:-4] for r in packing.tokenise_pieces(df, p).collect()})):
        path = public_tokenizers.path(name)
        tok, got = Tokenizer.from_file(path), run(path)
        for k, t in enumerate(odd):
            assert np.frombuffer(got[k], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, (name, t)


def test_lower_encoder_equals_library():
    """Latin-1 and other characters, marks after words and inside, control strings, all kinds of white space; batches of known words only."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, rng = Tokenizer.from_file(path), random.Random(4)
    parts = [*map(chr, range(256)), "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "e\u0301", "\u0130", "\u1e9e", "\u212a", "\ufb01", "漢", "###", "$$$", "&&&", "|||", "!?", "the", "Über"]
    gaps = [" ", " ", " ", "\n", "  ", "\t", "\xa0", "\x85", "\u3000", "\u200b", "\r\n"]
    texts = [None, "", " ", "\n"]
    for k in range(3000):
        letters = [*words.LETTERS, *words.MARKS[: k % 13], "A", "É"] if k % 2 else parts
        texts.append("".join("".join(rng.choices(letters, k=rng.randint(0, 6))) + rng.choice(gaps[: 4 if k % 3 else None]) for _ in range(rng.randint(0, 10))))
    texts += ["abc" + a + b for a in words.MARKS for b in words.MARKS + "x1"]
    want = [np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for most in (400_000, 40):
        encoder, column = words.lower_encoder(path, most), pa.array(texts)
        for k in [*range(0, len(texts), 700)] * 2:
            assert encoder.batch(column.slice(k, 700)) == want[k : k + 700]
    assert encoder.batch(pa.array([], pa.string())) == [] and encoder.batch(pa.array([None, ""])) == [b"", b""]


def test_spellings_are_merged_once():
    """What precedes different marks is merged once, in every batch, and however many words there are."""
    path, merged = public_tokenizers.path("word_bpe_49k.json"), []

    class Model:
        def tokenize(self, word):
            merged.append(word)
            return words.load(path).model.tokenize(word)

    stems = ["".join(t) for t in product("abcdefg", repeat=3)]
    encoder = words.lower_encoder(path, 400)
    encoder.model = Model()
    for mark in ["", ".", "###", "$$$", "&&&"]:
        encoder.batch(pa.array([" ".join(w + mark for w in stems)]))
    assert sorted(merged) == stems


def test_pieces_without_ids(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.tokenise_pieces(docs, path).collect()
    short = packing.tokenise_pieces(docs, path, keep_ids=False)
    assert short.columns == ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, short.collect())) == sorted(str(Row(**{c: r[c] for c in short.columns})) for r in rows)
    assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in rows)


def test_packing(docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.pack(docs, path).toPandas()
    for doc, own in rows[rows.doc_id.notna() & (rows.doc_id != 3)].groupby("doc_id"):
        ids = tok.encode(texts[int(doc)] or "", add_special_tokens=False).ids + [0]
        own = own.sort_values("piece")
        assert np.frombuffer(b"".join(own.ids), "<u4").tolist() == ids
        assert own.start.tolist() == list(range(0, len(ids), 2048))
        assert own.ids_crc32.tolist() == [packing.crc32_of(ids[k : k + 2048]) for k in range(0, len(ids), 2048)]
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() <= 2048
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 2048) + 1


def test_fullest_bin_is_optimal():
    rng = random.Random(1)
    for _ in range(60):
        counts = {n: rng.randint(1, 3) for n in rng.sample(range(1, 40), 5)}
        lengths = sorted(counts, reverse=True)
        chosen = packing.fullest(lengths, counts, 50)
        sums = {0}
        for n in lengths:
            for _ in range(counts[n] - (n == lengths[0])):
                sums |= {s + n for s in sums if s + n <= 50 - lengths[0]}
        assert sum(n * k for n, k in chosen.items()) == lengths[0] + max(sums)
        assert all(k <= counts[n] for n, k in chosen.items())


def brute_components(texts, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))], [len(s) for s in sets]


def test_near_duplicates(docs, texts):
    want, sizes = brute_components(texts, 85)
    rows = neardup.near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], sizes[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicate_chains(spark):
    """Chains of edits link far ends through the middle; many texts share each bucket."""
    rng = random.Random(8)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    texts = []
    for k in range(60):
        words = list(words)
        words[(k * 7) % 120] = f"new{k}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, _ = brute_components(texts, 85)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == dict(enumerate(want))


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        mask = np.zeros(len(d) + 1, int)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                mask[k] += 1
                mask[k + length] -= 1
        mask = np.cumsum(mask)[:-1] > 0
        out.append((np.frombuffer(d, np.uint8)[~mask].tobytes(), int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())))
    return out


@pytest.mark.parametrize("most", [4000, 1])
def test_repeats(docs, texts, most, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_MAX", most)
    all_texts = [*texts, texts[3], "a text without an id the of and"]
    want = brute_repeats(all_texts, 400)
    rows = repeats.remove_repeats(docs.select("doc_id", "text", "source")).collect()
    assert len(rows) == len(all_texts)
    for r in rows:
        k = len(texts) + 1 if r.doc_id is None else r.doc_id
        assert (r.kept_bytes, len(r.removed)) == want[k], k
        assert r.source == ("s" if r.doc_id is not None else None)


def test_long_text_in_pieces(spark, monkeypatch):
    """Pieces that are shorter than the text still see every window."""
    rng = random.Random(3)
    long = prose(rng, 3000)
    texts = [long, prose(rng, 50) + long[5000:9000] + prose(rng, 50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_repeats(texts, 400)
    got = {r.doc_id: (r.kept_bytes, len(r.removed)) for r in repeats.remove_repeats(df).collect()}
    assert got == dict(enumerate(want))


def test_index_on_repetitive_texts():
    rng = random.Random(11)
    for k in range(30):
        length = rng.choice([3, 50, 400])
        parts = [bytes(rng.choices(b"ab", k=rng.randint(1, 700))) for _ in range(4)]
        texts = [b"".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(6)]
        seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
        index = repeats.build_index([np.frombuffer(t, np.uint8).astype(np.uint8 if k % 2 else np.uint64) for t in texts])
        assert len(index.heads) < sum(map(len, texts))
        for t, spans in zip(texts, repeats.stream(index, length), strict=True):
            want, got = np.zeros((2, len(t)), bool)
            for k in range(len(t) - length + 1):
                if seen[t[k : k + length]] > 1:
                    want[k : k + length] = True
            for s, e in spans:
                got[s:e] = True
            assert (got == want).all()


def test_repeats_with_clashing_columns(spark):
    twin = "x" * 450
    df = spark.createDataFrame([(1, twin, "d", "h", "k", 7), (2, twin + "y", "e", "i", "l", 8)], "doc_id long, text string, doc string, row string, kept_text string, start int")
    got = sorted(repeats.remove_repeats(df).collect())
    assert [(r.doc_id, r.doc, r.row, r.start, r.kept_text) for r in got] == [(1, "d", "h", 7, ""), (2, "e", "i", 8, "y")]


def test_language(spark, docs):
    rng = random.Random(2)
    kinds = {"xx": ["the", "and", "ing", "tion"], "yy": ["der", "ung", "sch", "ein"]}
    made = [(k, " ".join("".join(rng.choices(kinds[lang], k=2)) for _ in range(rng.randint(5, 60))), lang) for k in range(200) for lang in [rng.choice(list(kinds))]]
    made += [(900, None, "xx"), (901, "", "xx"), (902, "123 !?", "yy"), (903, "theand " * 40 + "derung " * 20, None)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = langid.train(df.where(~langid.held_out(F.col("doc_id"))))
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    held = [m for m in made if m[0] < 900]
    assert sum(got[k].lang_pred == lang for k, _, lang in held) >= 0.98 * len(held)
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert got[903].lang_pred == "xx" and len(got[903].mixture) == 2 and 0.6 < got[903].score < 0.75
    assert set(docs.columns) <= set(langid.predict(docs, model).columns)


@pytest.mark.parametrize("n", [1, 3, 24])
def test_sharding(docs, texts, n):
    rows = sharding.shard_by_bytes(docs, n).toPandas()
    assert len(rows) == len(texts) + 2 and rows["shard"].between(0, n - 1).all()
    for _, own in rows.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    sizes = rows.groupby("shard")["size"].sum().reindex(range(n), fill_value=0)
    assert sizes.max() - sizes.min() <= 2 * rows["size"].max()


def test_sharding_splits_a_hot_text(spark):
    df = spark.createDataFrame([(k, "same text again" if k % 3 == 0 else f"text {k} " * 3) for k in range(3000)], "doc_id long, text string")
    rows = sharding.shard_by_bytes(df, 8).toPandas()
    sizes = rows.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() <= 1.02 * sizes.mean()
    split = rows[rows["text"] != "same text again"].groupby("text")["shard"].nunique()
    assert (split == 1).all()


def test_empty_tables(empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert quality.quality_rules(empty).count() == 0
    assert bpe.encode_decode(empty, path).count() == 0
    assert packing.pack(empty, path).count() == 0
    assert neardup.near_duplicates(empty).count() == 0
    assert repeats.remove_repeats(empty).count() == 0
    assert sharding.shard_by_bytes(empty, 24).count() == 0
    model = langid.train(empty)
    assert langid.predict(empty, model).count() == 0
    assert hashlib.sha256(b"").hexdigest()
