"""The corpus pipeline: language ID, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``. A stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimcheck.llm.common import shared_path, unused
from claimcheck.llm.decontaminate import drop_contaminated
from claimcheck.llm.langid import UNKNOWN, predicted, train
from claimcheck.llm.neardup import drop_near_duplicates
from claimcheck.llm.packing import packed


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; ``und`` and ambiguous ones go. Fitted on a bounded sample of ``docs``.

    Null, empty and letterless texts are ``und``; repeated rows are judged one by one; columns of any
    name pass unchanged; an empty table, or one without labels, keeps nothing.
    """
    into = unused(docs, "language")
    found = predicted(docs, train(docs), into=into)
    return found.where((F.col(f"{into}.lang") != UNKNOWN) & ~F.col(f"{into}.ambiguous")).drop(into)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group linked by five-word shingles at a similarity of 0.8 or more.

    Texts without words and rows without an id are in no group; of rows that repeat an id the one
    with the smallest text stays; an empty table gives no rows.
    """
    return drop_near_duplicates(docs, shingle=5, similarity=(80, 100))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a whole window of eight words (or a whole shorter item) of the benchmark.

    Null and empty texts stay; repeated rows are judged one by one; columns of any name pass unchanged.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_items=1)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of at most 2048 tokens.

    A null or empty text is one end token; repeated rows are packed as often; an empty table gives no rows.
    """
    return packed(docs, tokenizer="word_bpe_49k.json", end_id=0)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: The classifier and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = shared_path(spark, f"stage-{name}")
            out.write.parquet(path)
            out = spark.read.parquet(path)
        docs = out
    return docs
