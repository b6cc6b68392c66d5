"""Stages of the corpus pipeline on planted cases."""

import hashlib
import random

import corpus_pipeline
import numpy as np

from gridloom.llm import neardup, queries, repeats
from tests.llm.test_texts import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA).repartition(3)


def words(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randint(0, 999)}" for _ in range(n)]


def brute_passages(texts, n):
    """Per text, whether a word is covered by n words that start at two places."""
    split, places = [t.split() for t in texts], {}
    for k, w in enumerate(split):
        for i in range(len(w) - n + 1):
            places.setdefault(tuple(w[i : i + n]), []).append((k, i))
    gone = {(k, i + j) for found in places.values() if len(found) > 1 for k, i in found for j in range(n)}
    return [[(k, i) in gone for i in range(len(w))] for k, w in enumerate(split)]


def test_passages_of_51_words(spark):
    rng = random.Random(51)
    own = [words(rng, 70) for _ in range(4)]
    passage, short = words(rng, 51), words(rng, 50)
    texts = [" ".join([*own[k][:35], *(passage if k < 2 else short), *own[k][35:]]) for k in range(4)]
    texts[1] = texts[1].replace(" ".join(passage), "\n".join(passage))  # white space does not count
    assert len(" ".join(passage).encode()) < repeats.LENGTH
    stage = dict(corpus_pipeline.STAGES)["repeated strings"]
    got = {r.doc_id: r for r in stage(spark, frame(spark, texts), "").collect()}
    assert [got[k].text.split() for k in range(4)] == [*own[:2], texts[2].split(), texts[3].split()]
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_passages_against_brute_force(spark):
    """Overlapping and adjoining passages, and a text of more than one piece."""
    rng = random.Random(7)
    parts = [words(rng, rng.randint(20, 90)) for _ in range(12)]
    texts = [" ".join(w for p in rng.choices(parts, k=rng.randint(1, 6)) for w in [*p, *words(rng, rng.randint(0, 30))]) for _ in range(25)]
    long = words(rng, repeats._WORD_PIECE + 5000)
    texts += ["", " \n", "ein Wort", " ".join(long), " ".join(long[repeats._WORD_PIECE - 100 : repeats._WORD_PIECE + 100])]
    got = [[False] * len(t.split()) for t in texts]
    for r in repeats.repeated_spans(frame(spark, texts).selectExpr("doc_id AS doc", "text"), repeats.measures(400, 51)).where("words").collect():
        got[r.doc][r.start : r.stop] = [True] * (r.stop - r.start)
    assert got == brute_passages(texts, 51)


def test_short_texts_in_an_index(spark):
    """Windows of two bytes: an index may have fewer letters than the first step of sorting takes at once."""
    texts = ["ab", "xab", "ab", "q"]
    got = repeats.remove_repeats(frame(spark, texts).select("doc_id", "text"), length=2).collect()
    assert {r.doc_id: r.kept_text for r in got} == {0: "", 1: "x", 2: "", 3: "q"}
    assert repeats.build_index([np.array([0, 1], np.uint8), np.array([0], np.uint8)]).sizes.tolist() == [2, 1]


def test_suffixes_in_order():
    """Suffixes, marks by text, and ranks by the letters of each level, against plain sorting."""
    rng = np.random.default_rng(5)
    for k in range(40):
        base = rng.integers(1, 4, 60)
        parts = [base[s : s + rng.integers(1, 50)] for s in rng.integers(0, 40, 1 + k % 6)]
        x = np.concatenate([np.append(p, 0) for p in [*parts, parts[0]]])
        plain = [[(v, i * (v == 0)) for i, v in enumerate(x.tolist())][i:] for i in range(len(x))]
        order, levels = repeats.suffix_ranks(x)
        assert order.tolist() == sorted(range(len(x)), key=plain.__getitem__)
        for span, ranks in levels:
            for a, b in rng.integers(0, len(x), (60, 2)):
                assert (ranks[a] == ranks[b]) == (a == b or plain[a][:span] == plain[b][:span])


def test_op10_passages(spark, tmp_path):
    """Passages of over 50 words and under 400 bytes go from kept_text alone; a string of 400 bytes goes from all columns."""
    rng = random.Random(10)
    own, passage, long = [words(rng, 60) for _ in range(4)], words(rng, 51), " ".join(words(rng, 120))
    texts = [" ".join([*own[k][:30], *(passage if k < 2 else []), *own[k][30:]]) for k in range(4)]
    texts[2], texts[3] = texts[2] + " " + long, long + " " + texts[3]
    assert len(" ".join(passage)) < 398 < len(long)
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op10_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert [got[k].kept_text.split() for k in range(4)] == own
    assert [(got[k].n_bytes, got[k].n_removed) for k in range(2)] == [(len(t), 0) for t in texts[:2]]
    assert all(len(long) <= got[k].n_removed <= len(long) + 1 for k in (2, 3))
    assert all(got[k].kept_sha256 == hashlib.sha256(texts[k].encode()).hexdigest() for k in range(2))


def test_near_copies_at_80_to_85(spark):
    """Pairs between the two percentages are linked, those below are not."""
    rng = random.Random(80)
    texts, similarity = [], []
    for k in range(40):
        base = words(rng, 304)  # 300 shingles; each change takes 5 of them out and 5 in
        changed = list(base)
        for i in range(6 + k % 4):  # 0.82, 0.79, 0.76 and 0.74
            changed[10 + 25 * i] = f"new{k}x{i}"
        texts += [" ".join(base), " ".join(changed)]
        similarity.append((300 - 5 * (6 + k % 4)) / (300 + 5 * (6 + k % 4)))
    assert min(similarity) < 0.75 and 0.8 < max(similarity) < 0.85
    want, _ = brute_components(texts, 80)
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    assert sorted(r.doc_id for r in stage(spark, frame(spark, texts), "").collect()) == [k for k, c in enumerate(want) if c == k]
    assert len(set(want)) == 70


def test_bands_follow_the_percentage():
    assert neardup.plan(85) == (25, 5, 0.68)
    for percent in (1, 30, 50, 70, 80, 85, 90, 95, 100):
        own = neardup.plan(percent)
        p = min(percent, 99) / 100
        assert (1 - p**own.rows) ** own.bands <= neardup.MISS and 0 <= own.agree < p
