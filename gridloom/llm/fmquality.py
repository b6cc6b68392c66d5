"""Quality of texts by a factorisation machine (MLlib).

A text's features are hashed words (frequencies, of length one), structure statistics and metadata.  Statistics and metadata are cut into bins
at quantiles of the training rows, one indicator a bin, so that the pairwise interactions, of low rank, can tell any combination of them.
MLlib fits the machine; a text is scored in time linear in its features by the sum-of-squares identity: the sum over pairs of <v_i, v_j> x_i x_j is
half of (the square of the sum of v_i x_i less the sum of their squares), summed over the factors.  All of it runs in the JVM.

Training takes at most TRAIN_ROWS labelled documents of each label, those with the smallest hashes of their ids, and the score's odds are set
back to the proportion that the labels have in all training rows.

Defined results: null texts are empty ones, and empty texts are scored like others; very long texts are used whole; rows are scored one by one, repeated
or not; a repeated id is learned once a label, with its smallest text; labels other than 0 and 1 and ids without a document teach nothing; with one label
only, or none, every score is that label's share after adding one row of each (so 0.5 for none); an empty table gives an empty result; other columns do not take part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import FMClassificationModel, FMClassifier
from pyspark.ml.feature import Bucketizer, HashingTF, Normalizer, OneHotEncoder, OneHotEncoderModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import NOT_SPACE, cut, discard

#: Labelled documents of each label that are learned from, at most.
TRAIN_ROWS = 4000
WORD_BUCKETS = 1 << 12
BINS = 12
FACTORS = 6
STEPS = 60
RATE = 0.1
DECAY = 1e-2
#: Files of the training sample, so partitions of every training step.
PARTS = 8


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: every third by checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({NOT_SPACE})"), 1)


def statistics(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Structure statistics; ratios of nothing are zero."""
    chars, n = F.length(text), F.size(words)
    share = lambda part, of: F.when(of > 0, part.cast("double") / of).otherwise(0.0)
    left = lambda pattern: chars - F.length(F.regexp_replace(text, pattern, ""))
    return {
        "words": F.log1p(n.cast("double")),
        "word_chars": share(chars, n),
        "symbols": share(left(r"[#*$%&|<>{}=_^~\\]+"), chars),
        "marks": share(left(r"[.,;:!?]+"), n),
        "capitals": share(left(r"\p{Lu}+"), chars),
        "digits": share(left(r"[0-9]+"), chars),
        "new_words": share(F.size(F.array_distinct(words)), n),
        "word_of_line": share(n, F.size(lines)),
        "new_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "runs": share(F.size(F.filter(F.zip_with(words, F.slice(words, F.lit(2), F.greatest(n, F.lit(1))), lambda a, b: a == b), lambda same: same)), n),
    }


def features(docs: DataFrame, text: str, metadata: list[str]) -> DataFrame:
    """``docs`` (with columns named __gl_...) with words and the numbers to be cut into bins."""
    whole = docs.withColumn("__gl_text", F.coalesce(F.col(text), F.lit("")))
    split = whole.withColumn("__gl_words", words(F.col("__gl_text"))).withColumn("__gl_lines", F.split("__gl_text", "\n"))
    found = statistics(F.col("__gl_text"), F.col("__gl_words"), F.col("__gl_lines"))
    extra = {f"meta_{k}": F.coalesce(F.signum(F.col(m).cast("double")) * F.log1p(F.abs(F.col(m).cast("double"))), F.lit(-1e9)) for k, m in enumerate(metadata)}
    numbers = {f"__gl_n_{k}": c for k, c in (found | extra).items()}
    return split.withColumns(numbers).withColumn("__gl_words", F.transform("__gl_words", F.lower)).drop("__gl_text", "__gl_lines")


@dataclass
class Model:
    machine: FMClassificationModel | None
    bins: Bucketizer | None
    ones: OneHotEncoderModel | None
    metadata: list[str]
    #: What is added to the margin, or the margin of all texts where there is no machine.
    offset: float

    def vectors(self, rows: DataFrame) -> DataFrame:
        hashed = HashingTF(numFeatures=WORD_BUCKETS, inputCol="__gl_words", outputCol="__gl_counts").transform(rows)
        unit = Normalizer(inputCol="__gl_counts", outputCol="__gl_unit").transform(hashed)
        binned = self.ones.transform(self.bins.transform(unit))
        return VectorAssembler(inputCols=["__gl_unit", *self.ones.getOutputCols()], outputCol="__gl_features").transform(binned)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", metadata: list[str] | None = None) -> Model:
    """``labels``: doc_id and ``label`` of the rows that may be learned from."""
    metadata = list(metadata or [])
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__gl_id"), F.col(label).cast("int").alias("__gl_label")).distinct()
    pool = known.join(docs.select(F.col(doc_id).alias("__gl_id")), "__gl_id", "left_semi")
    counts = {r[0]: r[1] for r in pool.groupBy("__gl_label").count().collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        return Model(None, None, None, metadata, math.log((n1 + 1) / (n0 + 1)))
    order = [F.xxhash64("__gl_id"), F.col("__gl_id")]
    chosen = pool.where("__gl_label = 0").orderBy(*order).limit(TRAIN_ROWS).unionByName(pool.where("__gl_label = 1").orderBy(*order).limit(TRAIN_ROWS))
    own = docs.select(F.col(doc_id).alias("__gl_id"), F.col(text).alias("__gl_raw"), *[F.col(m) for m in metadata])
    one = own.join(F.broadcast(chosen), "__gl_id").groupBy("__gl_id", "__gl_label").agg(F.min(F.struct("__gl_raw", *metadata)).alias("d")).select("__gl_label", "d.*")
    sample = cut(features(one, "__gl_raw", metadata).drop("__gl_raw", *metadata), PARTS)
    names = [c for c in sample.columns if c not in ("__gl_label", "__gl_words")]
    cuts = sample.select(*[F.percentile(c, F.array(*[F.lit(k / BINS) for k in range(1, BINS)])).alias(c) for c in names]).first()
    splits = [[-math.inf, *sorted(set(cuts[c])), math.inf] for c in names]
    bins = Bucketizer(splitsArray=splits, inputCols=names, outputCols=[f"{c}_bin" for c in names])
    # Bins that the sample leaves empty still have a place.
    frame = sample.sparkSession.createDataFrame([tuple(float(min(k, len(s) - 2)) for s in splits) for k in range(BINS)], [f"{c}_bin" for c in names])
    ones = OneHotEncoder(inputCols=bins.getOutputCols(), outputCols=[f"{c}_one" for c in names], dropLast=False).fit(frame)
    model = Model(None, bins, ones, metadata, 0.0)
    ready = cut(model.vectors(sample).select(F.col("__gl_label").cast("double").alias("label"), F.col("__gl_features").alias("features")), PARTS)
    took = {int(r[0]): r[1] for r in ready.groupBy("label").count().collect()}
    machine = FMClassifier(factorSize=FACTORS, maxIter=STEPS, stepSize=RATE, regParam=DECAY, initStd=0.05, seed=7, tol=0.0, solver="adamW").fit(ready.coalesce(PARTS))
    model.machine = machine
    model.offset = math.log(n1 / n0) - math.log(took[1] / took[0])
    discard(sample, ready)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1, and ``predicted``."""
    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    if model.machine is None:
        margin = docs.withColumn("__gl_margin", F.lit(model.offset))
    else:
        model.machine.setFeaturesCol("__gl_features").setRawPredictionCol("__gl_raw").setProbabilityCol("").setPredictionCol("")
        margin = model.machine.transform(model.vectors(features(docs, text, model.metadata))).withColumn("__gl_margin", vector_to_array("__gl_raw")[1] + model.offset)
    scored = margin.withColumn("__gl_score", 1 / (1 + F.exp(-F.col("__gl_margin"))))
    return scored.select(*names, F.col("__gl_score").alias("score"), (F.col("__gl_score") >= 0.5).cast("int").alias("predicted"))
