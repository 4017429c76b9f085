"""From raw documents to packed training sequences: language ID, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which `run` writes as Parquet and reads as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lagweave.llm.decontaminate import decontaminated
from lagweave.llm.jaccard_join import one_of_each
from lagweave.llm.language_id import recognised
from lagweave.llm.packing import packed
from lagweave.llm.queries import table, tokenizer_file
from lagweave.llm.runtime import delete, shared_dir
from lagweave.llm.substring_dedup import deduplicated


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters, and ambiguous ones, go.

    Null, empty and letterless texts go; a text of any length is judged as a whole; rows that repeat stay or go together; a null doc_id teaches nothing but is judged;
    equal losses go to the language that sorts first; without a labelled row no language is known, and all go; other columns are kept as they are, whatever their names.
    """
    return recognised(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity 0.8.

    Null and empty texts are like nothing and stay; a text of any length is one set; the smallest doc_id of a group stays, of rows repeated whole one; rows with null doc_id stay;
    rows of one doc_id are told apart by their texts; an empty table gives none; other columns are kept, whatever their names.
    """
    return one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words or more that stand in more than one place.

    Null and empty texts have no words and stay; texts that lose nothing keep their white space, others are joined by single blanks; a text that loses all its words goes;
    rows repeated whole are two places and lose what they share; windows are judged on the input; an empty table gives none; n_chars follows the text, other columns stay as they are.
    """
    return deduplicated(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item.

    Null and empty texts hold none and stay, as do all if the benchmark is empty or its texts are null; items of fewer than ten words count as a whole; rows that repeat are judged alike;
    a text of any length is searched to its end; other columns are kept, whatever their names.
    """
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2,048 tokens.

    A null or empty text is its end id alone; a long text is cut into pieces; rows that repeat are packed each; ties go by the pieces' order; an empty table gives none; only the id is kept of the columns.
    """
    return packed(docs, tokenizer_file())


STAGES = [("language ID", language), ("near copies", near_copies), ("passages", passages), ("benchmark", benchmark), ("packing", packing)]

#: Language ID and packing can't be told in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/lagweave-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            delete(spark, f"{base}/{k - 1}")
    return docs
