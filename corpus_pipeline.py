"""The corpus pipeline: each stage is one operator over all rows its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of docs. Stages are written as Parquet and read again, so each starts from a finished table. What
a stage writes for itself is deleted when its result is written, and a stage's result when the
next one's is; only the last stage's input stays, as the pieces are made from it when they are read.

All stages: a null or empty text is a document without words, which no stage fails on; repeated
rows are judged alike; an empty table gives an empty table; columns other than doc_id and text,
whatever their names, pass through unchanged (but for n_chars, see line_dedup).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm import decontam, linededup, ngramjoin, packing, quality
from calibra.llm.tables import cleaned, discard, released, saved, scratch, table

#: Near copies share 80 % of their five-word shingles; op9's four words and 85 % are that query's own.
SHINGLE, PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, learned from the labels of docs, rejects.

    Texts without words get the sigmoid of the bias, like one another. Rows without a doc_id or a
    label are judged, not learned from; without any labels every document scores 0.5 and stays.
    """
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines found in ten documents or more; n_chars, where there is one, follows the text.

    All rows stay. A text whose lines all go becomes empty, a null text is one empty line and becomes
    the empty text; every row counts as a document, also repeated ones and ones without a doc_id.
    """
    out = linededup.dedup_lines(docs).select(*(f"`{c}`" for c in docs.columns))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least doc_id, of each group of near copies.

    Texts without words are linked with nothing and all stay. Rows without a doc_id take part and
    give way to ones that have one; of rows equal in doc_id and text one stays.
    """
    return ngramjoin.one_of_each(docs, SHINGLE, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which a twentieth or more lies in benchmark passages.

    Texts without words hold no passage and stay, as all do if the benchmark is empty or null.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: one row for each piece, with its token ids.

    A text without words has the end id alone, one piece of length 1; a null doc_id stays null.
    """
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _fresh(stage: Stage) -> Stage:
    """The stage, begun with executors that have given back the heap of the stage before."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        released(spark)
        return stage(spark, docs, sf_dir)

    return begun


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", _fresh(quality_classifier)),
    ("line_dedup", _fresh(line_dedup)),
    ("near_duplicates", _fresh(near_duplicates)),
    ("decontamination", _fresh(decontamination)),
    ("packing", _fresh(pack)),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        with cleaned(spark):
            docs = saved(stage(spark, docs, sf_dir), name, path)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
