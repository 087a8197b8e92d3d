"""Corpus pipeline: five stages over `documents`, each written and read again before the next.

1. quality: rows that the classifier rejects go.
2. exact: of equal texts the row with the largest doc_id stays.
3. near: of each group of near copies (five-word shingles, similarity 0.8 or more) one document stays.
4. mix: each source comes near its target share; a row for each time the mix passes over a document.
5. pack: token pieces, with their ids (input_ids) and their place in sequences of at most 4096 tokens; `row` is the same for
   the pieces of one row of the mix, so the passes over a document are told apart.

Null columns, empty texts, repeated rows, empty tables and columns with clashing names are as each operator defines them. The stages
learn and decide by hashes and fitted models that SQL cannot express, so there is no ORACLE_SQL;
tests compare exact and near with brute force, mix and pack with a plain reconstruction from their input, and quality with labels. A stage's
table is removed once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayforge.llm import exact_dedup, mixing, ngram_join, packing, quality
from wayforge.llm.common import Scratch, table
from wayforge.llm.queries import vocabulary


def _of(scratch: Scratch, out: DataFrame) -> DataFrame:
    """A stage's result with the tables it rests on, which go once it is written."""
    out._scratch = scratch
    return out


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "exact")
    return _of(scratch, exact_dedup.keep_unique(docs, scratch))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "near")
    return _of(scratch, ngram_join.keep_one(docs, scratch, k=5, num=80, den=100))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "mix")
    return _of(scratch, mixing.mixed_documents(docs, scratch))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pack")
    return _of(scratch, packing.pack_documents(docs, scratch, vocabulary("word_bpe_49k.json"), with_ids=True))


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("mix", mix_stage), ("pack", pack_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, out = docs, stage(spark, docs, sf_dir)
        docs = scratch.write(out, name)
        if i:
            scratch.drop(before)
        if hasattr(out, "_scratch"):
            out._scratch.close()
    return STAGES[-1][1](spark, docs, sf_dir)
