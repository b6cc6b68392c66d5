"""Language of mixed texts by expectation-maximisation.

Training counts hashed byte trigrams of lower-case words for each language over all training rows, in Spark; the model is a
table of log probabilities whose size is fixed by the number of buckets.  A text is a mixture: each word has a likelihood
under every language (the sum over its trigrams), and expectation-maximisation estimates the proportions of languages over
the words.  Sets of languages, the best one, the best two, and so on, compete by penalised likelihood, and the proportions
are those of the winning set.

Defined results: a text that is null or holds no letter gets ``und`` with score 0 and no proportions, and so does every text
where nothing was learned; very long texts are used whole; repeated rows are treated row by row; ties between languages go
to the smaller name; an empty table gives an empty result; other columns do not take part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of hashed trigrams.
BUCKETS = 1 << 16
SMOOTHING = 0.5
STEPS = 6
#: Weight of one more language against the log likelihood, in units of log(number of words) / 2.
PENALTY = 6.0
#: Characters handled at once by a task, divided by the number of languages.
SLICE_CHARS = 6_000_000
UNKNOWN = "und"
# Bytes that end a word: ASCII other than letters.
_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # buckets x languages


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all trigrams, the first trigram of each word, and the words of each text.  A word is framed by one space on either side."""
    words = [t.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b" " + b" ".join(w for x in words for w in x) + b" ", np.uint8).astype(np.uint32)
    if not n.sum():
        return np.empty(0, np.uint32), np.empty(0, np.int64), n
    code = (data[:-2] * np.uint32(0x9E3779B1)) ^ (data[1:-1] * np.uint32(0x85EBCA6B)) ^ (data[2:] * np.uint32(0xC2B2AE35))
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    code = (code >> np.uint32(16)) & np.uint32(BUCKETS - 1)
    # A trigram belongs to the word that its middle letter stands in; those on a space belong to none.
    inside = data[1:-1] != 32
    first = np.flatnonzero(inside & (data[:-2] == 32))
    keep = np.flatnonzero(inside)
    return code[keep], np.searchsorted(keep, first), n


def _tally(batches):
    total: dict[str, np.ndarray] = {}
    for b in batches:
        texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lang in set(langs):
            code, _, _ = trigrams([t for t, x in zip(texts, langs, strict=True) if x == lang])
            total[lang] = total.get(lang, np.zeros(BUCKETS, np.int64)) + np.bincount(code, minlength=BUCKETS)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(counts[at])], ["lang", "bucket", "n"])


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts over all rows with a text and a label; at most BUCKETS numbers a language reach the driver."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text), F.col(lang))
    counted = rows.mapInArrow(_tally, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    counts = np.zeros((BUCKETS, len(languages)))
    for k, name in enumerate(languages):
        own = counted[counted["lang"] == name]
        counts[own["bucket"].to_numpy(), k] = own["n"].to_numpy()
    counts += SMOOTHING
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32)) if languages else Model([], np.zeros((BUCKETS, 0), np.float32))


def has_letter(text: str) -> bool:
    """Whether a character of one of the Unicode letter categories is in the text; numerals like ½ are none."""
    return any(map(str.isalpha, text))


def _fit(p: np.ndarray, top: np.ndarray, doc: np.ndarray, starts: np.ndarray, n: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages) of the allowed languages and the log likelihood."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(STEPS):
        r = p * share[doc]
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
        share = np.add.reduceat(r, starts, axis=0) / n[:, None]
    return share, np.add.reduceat(np.log(np.maximum((p * share[doc]).sum(axis=1), 1e-300)) + top, starts)


def mixtures(texts: list[str], model: Model) -> np.ndarray:
    """Proportions of the languages in each text; all zero where there is nothing to tell."""
    out = np.zeros((len(texts), len(model.languages)))
    code, first, n = trigrams(texts)
    used = np.flatnonzero(n)
    if not len(used) or not model.languages:
        return out
    ll = np.add.reduceat(model.log_p[code], first, axis=0).astype(np.float64)
    top = ll.max(axis=1)
    p = np.exp(ll - top[:, None])
    n = n[used]
    doc, starts = np.repeat(np.arange(len(used)), n), np.cumsum(n) - n
    full, _ = _fit(p, top, doc, starts, n, np.ones((len(used), p.shape[1])))
    order = np.argsort(-full, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    best, cost = np.zeros_like(full), np.full(len(used), np.inf)
    for k in range(1, p.shape[1] + 1):
        # A language of next to no share in the full fit can't pay for itself.
        try_ = np.flatnonzero(np.take_along_axis(full, order[:, k - 1 : k], axis=1)[:, 0] * n > (0.5 if k > 1 else -1))
        if not len(try_):
            break
        rows = np.isin(doc, try_) if len(try_) < len(used) else slice(None)
        sizes = n[try_]
        share, fit = _fit(p[rows], top[rows], np.repeat(np.arange(len(try_)), sizes), np.cumsum(sizes) - sizes, sizes, (rank[try_] < k).astype(float))
        penalised = -2 * fit + PENALTY * (k - 1) * np.log(sizes + 1)
        better = penalised < cost[try_]
        best[try_[better]], cost[try_[better]] = share[better], penalised[better]
    out[used] = best
    return out


def _predict(shared, names: list[str]):
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches):
        model = shared.value
        size = max(1000, SLICE_CHARS // max(1, len(model.languages)))
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= size):
                    chars += len(texts[end])
                    end += 1
                part = texts[at:end]
                langs, scores, tops = [], [], []
                for t, s in zip(part, mixtures(part, model), strict=True):
                    if not s.any() or not has_letter(t):
                        langs.append(UNKNOWN), scores.append(0.0), tops.append([])
                        continue
                    k = int(np.argmax(s))
                    langs.append(model.languages[k]), scores.append(float(min(1.0, s[k])))
                    tops.append([{"lang": model.languages[j], "share": float(s[j])} for j in np.argsort(-s, kind="stable") if s[j] > 0])
                kept = [b.column(k + 1).slice(at, end - at) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(tops, kind)], [*names, "lang_pred", "score", "mixture"])
                at = end

    return run


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) with lang_pred, score and mixture (languages of the selected set and their shares)."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "mixture")]
    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in names)
    rows = docs.select(F.col(text).alias("__gl_text"), *[F.col(f"`{c}`") for c in names])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language
    return rows.mapInArrow(_predict(shared, names), f"{schema}, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: every fourth by checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
