"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its own content says so (after a line end or the end of a sentence, once a
chunk has MIN characters, at MAX at the latest), so that chunks joined give the text back. Chunks
are deduplicated by (SHA-256, content): each distinct chunk moves once, and where two different
chunks ever share a digest they get different numbers. The recipe of a text is the ordered list of
its chunk identifiers; two texts are equal exactly when their recipes are. Long texts themselves
are never shuffled or compared again.

Defined cases: a null text counts as empty; an empty text has the empty recipe and all of them are
equal; of equal rows the largest doc_id stays (null ids last), and of repeated rows with that
doc_id exactly one (any one, if they differ in other columns); very long texts are cut like others; other columns, whatever their names,
are left alone.

Groups are counted before anything moves, and joined back by `join_groups`: the few large ones by broadcast, so a text
that a third of all rows share is not gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayforge.llm.common import Scratch, hidden, join_groups

MIN_CHARS, MAX_CHARS = 1024, 8192


def chunk_pattern(least: int = MIN_CHARS, most: int = MAX_CHARS) -> str:
    return rf"(?s).{{{least},{most}}}?(?<=\n|[.!?] )|.{{1,{most}}}"


def chunks(text: Column, least: int = MIN_CHARS, most: int = MAX_CHARS) -> Column:
    """Content-defined chunks of a text, in order."""
    return F.regexp_extract_all(text, F.lit(chunk_pattern(least, most)), F.lit(0))


def chunk_store(docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest, chunk): each distinct chunk once; combined before the shuffle, so a chunk that many
    documents share moves once for each task."""
    return docs.select(F.explode(chunks(F.coalesce(F.col(text), F.lit("")))).alias("chunk")).select(
        F.sha2("chunk", 256).alias("digest"), "chunk"
    ).distinct()


def colliding(store: DataFrame) -> DataFrame:
    """(digest, chunk, number) of chunks that share their digest with a different chunk."""
    ranked = store.select(
        "digest", "chunk", F.row_number().over(W.partitionBy("digest").orderBy("chunk")).alias("number"), F.count(F.lit(1)).over(W.partitionBy("digest")).alias("n")
    )
    return ranked.where("n > 1").select("digest", "chunk", "number")


def recipes(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_sha256, recipe): recipe lists the verified identifiers of the chunks in order."""
    body = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    clashes = scratch.write(colliding(chunk_store(body)), "clashes")
    plain = body.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.transform(chunks(F.col("text")), lambda c: F.sha2(c, 256)).alias("recipe"))
    if clashes.isEmpty():
        return plain
    # Two chunks share a digest: the number that tells them apart becomes part of the identifier.
    numbered = (
        body.withColumn("row", F.monotonically_increasing_id())
        .select("row", "doc_id", F.sha2("text", 256).alias("text_sha256"), F.posexplode_outer(chunks(F.col("text"))).alias("at", "chunk"))
        .withColumn("digest", F.sha2("chunk", 256))
    )
    return (
        numbered.join(clashes, ["digest", "chunk"], "left")
        .groupBy("row", "doc_id", "text_sha256")
        .agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", F.concat_ws("/", "digest", "number").alias("id"))))).alias("list"))
        .select("doc_id", "text_sha256", F.col("list.id").alias("recipe"))
    )


def dedup_exact(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    listed = scratch.write(recipes(docs, scratch, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "recipes")
    scratch.settle()
    groups = listed.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    joined = join_groups(scratch.again(listed), scratch.write(groups, "groups"), "recipe", "group_size")
    alone = F.col("keep").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep.row") == F.col("row"))).alias("kept"), "text_sha256",
    )


def keep_unique(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    x = hidden(docs)
    kept = dedup_exact(docs, scratch, doc_id, text).where("kept").select(F.col("doc_id").alias(f"{x}id"), F.col("text_sha256").alias(f"{x}sha"))
    marked = docs.withColumn(f"{x}key", F.sha2(F.coalesce(docs[text], F.lit("")), 256))
    return (
        marked.join(kept, marked[f"{x}key"].eqNullSafe(kept[f"{x}sha"]) & marked[doc_id].eqNullSafe(kept[f"{x}id"]), "left_semi")
        .dropDuplicates([doc_id, f"{x}key"]).select(*docs.columns)
    )
