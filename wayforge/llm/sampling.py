"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayforge.llm.common import crc32_mod

#: Rows with this remainder of crc32(doc_id as text) mod 3 are held out; their labels are never read.
FOLDS, HELD = 3, 1


def held_out(doc_id: Column) -> Column:
    return crc32_mod(doc_id, FOLDS) == HELD


def pick(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """The ids of at most `most` rows, by a keyed hash of the id; a top-k over ids only."""
    return rows.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)


def with_texts(docs: DataFrame, ids: DataFrame, tag: str) -> DataFrame:
    """(tag, text) of the documents with these ids; ids is at most a sample, so it is broadcast."""
    return docs.join(F.broadcast(ids), "doc_id").select(F.lit(tag).alias("tag"), "text")
