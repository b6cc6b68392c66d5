"""A corpus pipeline: quality rules, language ID, near-duplicates, repeated strings, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Between stages the documents are written as Parquet to the shared folder and read again, so a lost executor costs no more
than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import langid, neardup, packing, quality, repeats
from gridloom.llm.common import cut, prepare, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose main language has less than this share is rejected.
LEAST_SHARE = 0.5
#: Passages of over 50 words that repeat are cut out.
PASSAGE_WORDS = 51
#: Texts are near copies from this percentage of common word shingles on.
NEAR_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what passes the quality rules; null and empty texts do not.  Repeated rows are judged one by one."""
    prepare(spark)
    return quality.keep(docs).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts with a language that makes up at least half of them; learns from the stage's own labelled documents.
    Null texts and texts without letters go; repeated rows are judged one by one."""
    prepare(spark)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs, model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies, and documents without an id.  Rows that share an id
    are one document: they stay together, each text of it once.  Texts without words are no one's copies and stay."""
    prepare(spark)
    kept = neardup.near_duplicates(docs, NEAR_PERCENT).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    one = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return one.unionByName(docs.where("doc_id IS NULL")).select(*COLUMNS)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated strings and passages out of the texts; every document stays, a null text as an empty one.  A character of
    which a byte went goes too; rows that repeat each other lose what they share."""
    prepare(spark)
    done = repeats.remove_repeats(docs, words=PASSAGE_WORDS)
    return done.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences; a null text is an empty one, and repeated rows are packed each."""
    import public_tokenizers

    prepare(spark)
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_stage),
    ("language id", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("repeated strings", repeat_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
