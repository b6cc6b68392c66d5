"""Quality rules: a threshold table compiled into one Spark projection.

The rules are rows ``(metric, low, high)``; a document is kept when every metric lies inside its closed range.  All
metrics are built-in expressions, so nothing leaves the JVM and the scan is the only stage.

Defined results: a null text counts as an empty one (zero everywhere, rejected by the length rule); an empty text
likewise; very long texts are measured whole; repeated rows are measured row by row; an empty table gives an empty
result; other columns of the input pass through untouched, and our own column names replace clashing ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import SPACE

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for was on with as by be this are at from not or an he she they we you his her "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es "
    "de la le et les des en un du une que pour est dans qui par sur pas au avec il elle ce "
    "el y los se las del por con no una su para al es lo como más"
).split()

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Windows of so many words are compared within a text.
REPEAT_WORDS = 8

#: metric, smallest and largest value that is kept (None: open).
BASE_RULES = (
    ("n_words", 20, None),
    ("repeat_ratio", None, 0.30),
)
RULES = BASE_RULES + (
    ("mean_word_chars", 2.5, 10.0),
    ("symbol_ratio", None, 0.10),
    ("stop_ratio", 0.05, None),
    ("dup_line_ratio", None, 0.50),
)


def stop_forms(words=STOP_WORDS) -> list[str]:
    """Stop words as they stand in prose: small or capitalised, alone or before a comma or full stop."""
    base = dict.fromkeys(words)
    cased = dict.fromkeys([*base, *(w[:1].upper() + w[1:] for w in base)])
    return [w + end for w in cased for end in ("", ",", ".")]


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_stop and n_repeat_words (all long)."""
    mine = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_stop", "n_repeat_words"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in mine]
    t = F.coalesce(F.col(text), F.lit(""))
    # Steps in separate projections: an array that several expressions read is built once.
    split = docs.select(
        *kept,
        F.filter(F.split(t, SPACE), lambda w: w != "").alias("__gl_words"),
        F.filter(F.split(t, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("__gl_lines"),
        t.alias("__gl_text"),
    )
    hashed = split.withColumn("__gl_grams", F.transform("__gl_words", lambda w: F.xxhash64(w)))
    # Hash of every 8-word window by doubling: pairs, fours, eights.
    mix = lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))
    shifted = lambda c, k: F.slice(F.col(c), k + 1, F.greatest(F.size(c) - k, F.lit(0)))
    short = lambda c, k: F.slice(F.col(c), 1, F.greatest(F.size(c) - k, F.lit(0)))
    grams = hashed
    for k in (1, 2, 4):
        grams = grams.withColumn("__gl_grams", F.when(F.size("__gl_grams") > k, F.zip_with(short("__gl_grams", k), shifted("__gl_grams", k), mix)).otherwise(F.array().cast("array<bigint>")))
    measured = grams.select(
        *kept,
        F.size("__gl_words").cast("long").alias("n_words"),
        F.aggregate("__gl_words", F.lit(0).cast("long"), lambda acc, w: acc + F.length(w)).alias("word_chars"),
        _symbols(F.col("__gl_text")).cast("long").alias("n_symbols"),
        (F.size("__gl_lines") - F.size(F.array_distinct("__gl_lines"))).cast("long").alias("n_dup_lines"),
        F.size("__gl_lines").cast("long").alias("n_lines"),
        F.size(F.filter("__gl_words", lambda w: w.isin(stop_forms()))).cast("long").alias("n_stop"),
        F.when(F.size(F.array_distinct("__gl_grams")) == F.size("__gl_grams"), F.lit(0).cast("long")).otherwise(_covered(F.col("__gl_grams"))).alias("n_repeat_words"),
    )
    return measured


def _symbols(t: Column) -> Column:
    """Characters of SYMBOLS; each is one byte, so lengths in bytes tell."""
    total = F.lit(0)
    for c in SYMBOLS:
        total = total + (F.octet_length(t) - F.octet_length(F.replace(t, F.lit(c), F.lit(""))))
    return total


def _covered(h: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: sort (hash, position), keep those equal to a neighbour, then add up the union of their spans."""
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    n = F.size(h)
    nxt = F.slice(pairs, 2, n)
    prv = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), pairs)
    near = F.zip_with(F.zip_with(pairs, nxt, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.slice(prv, 1, n), lambda x, p: F.when((x["a"]["h"] == x["b"]["h"]) | (x["a"]["h"] == p["h"]), x["a"]["i"]))
    at = F.array_sort(F.array_compact(near))
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end"))
    step = lambda acc, i: F.struct((acc["n"] + (i + REPEAT_WORDS - F.greatest(i, acc["end"]))).cast("long").alias("n"), (i + REPEAT_WORDS).alias("end"))
    return F.aggregate(at, state, step, lambda acc: acc["n"])


def compile_rules(rules) -> Column:
    """One boolean expression for a threshold table over the measures."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    metric = {
        "n_words": F.col("n_words"),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "mean_word_chars": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / words,
        "stop_ratio": F.col("n_stop") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }
    ok = F.lit(True)
    for name, low, high in rules:
        if low is not None:
            ok = ok & (metric[name] >= F.lit(low))
        if high is not None:
            ok = ok & (metric[name] <= F.lit(high))
    return ok


def quality_rules(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Measures of every document with ``base_failed`` and ``kept``."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = measures(docs, text).withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def keep(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows that pass, with their own columns.  The verdict goes through a generator and not a filter: the optimizer would
    push a filter below the projections and copy all measures, and what they are made of, into it."""
    judged = quality_rules(docs, text, rules)
    names = [c for c in docs.columns if c in judged.columns]
    return judged.select(*[F.col(f"`{c}`") for c in names], F.explode(F.when(F.col("kept"), F.array(F.lit(1)))).alias("__gl_kept")).select(*[F.col(f"`{c}`") for c in names])
