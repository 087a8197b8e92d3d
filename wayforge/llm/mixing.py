"""Mixing sources to target weights.

Each source is a stream of words: its documents in a pseudorandom order, packed into blocks of a
fixed number of words (the last may be shorter). The plan draws, shard by shard, multinomial
counts of blocks for each source with chances in proportion to what is left of each quota, so
that quotas come out exactly. The r-th draw of a source takes block P(r) of a keyed permutation of
its block numbers, one permutation for each pass, so no block is drawn more often than
ceil(target / size) times. Drawn block numbers are then joined with the blocks.

Bounds: the driver holds a row for each source and a count for each shard and source.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a source
without words has target 0; an empty table gives an empty result; repeated rows are separate rows; very long
texts are streams of blocks like others; ties in the pseudorandom order go by doc_id and size, and rows equal in these
are alike to the mix; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayforge.llm.common import Scratch, hidden

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight, none above most times its own size; excess is reshared."""
    total, capped = float(sum(sizes)), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(most * sizes[i] for i in sorted(capped))
        unit = left / sum(weights[i] for i in free) if free else 0.0
        over = [i for i in free if weights[i] * unit > most * sizes[i]]
        if not over:
            return [most * sizes[i] if i in capped else weights[i] * unit for i in range(len(sizes))]
        capped.update(over)


def draw_plan(quota: list[int], shards: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(shard, source, first draw, draws); sums over shards are the quotas."""
    rng, left = np.random.Generator(np.random.PCG64(seed)), np.array(quota, np.int64)
    first, out = np.zeros(len(quota), np.int64), []
    for shard in range(shards):
        n = int(left.sum() // (shards - shard))
        if shard == shards - 1 or n >= left.sum():
            take = left.copy()
        else:
            take = np.zeros(len(quota), np.int64)
            while (short := n - int(take.sum())) > 0:
                rest = left - take
                take += np.minimum(rng.multinomial(short, rest / rest.sum()), rest)
        out += [(shard, i, int(first[i]), int(t)) for i, t in enumerate(take) if t]
        first, left = first + take, left - take
    return out


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Keyed permutation of 0..n-1, elementwise: a Feistel network, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    n, key = n.astype(np.uint64), key.astype(np.uint64)
    while todo.any():
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(rounds):
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((r + 1) * 0xC2B2AE3D27D4EB4F % 2**64)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & m)
        out[todo] = (left << h) | right
        todo = out >= n
    return out.astype(np.int64)


def mix(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        block_words: int = 128, most: float = 3.0, shard_slots: int = 65536, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, placed, slots).

    sources: sidx, source, source_size, target, blocks. placed: doc_id, sidx, size and start (place of
    its first word in the stream of its source). slots: shard, sidx, draw and block: the mix itself.
    """
    spark = docs.sparkSession
    sized = scratch.write(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")), "sized")
    per = sorted(
        ((r["source"], r["rows"], r["words"]) for r in sized.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words")).collect()),
        key=lambda r: (r[0] is None, (r[0] or "").encode()),
    )
    target = water_fill([r[2] for r in per], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(per))], most)
    blocks = [-(-r[2] // block_words) for r in per]
    quota = [min(int(most * b), round(t * b / r[2])) if r[2] else 0 for r, t, b in zip(per, target, blocks, strict=True)]
    buckets = [1 + r[1] // 1_000 for r in per]
    kind = sized.schema["source"].dataType.simpleString()
    sources = spark.createDataFrame(
        [(i, r[0], r[2], t, b, n) for i, (r, t, b, n) in enumerate(zip(per, target, blocks, buckets, strict=True))],
        f"sidx int, source {kind}, source_size long, target double, blocks long, buckets int",
    )
    known = F.broadcast(sources.select("sidx", F.col("source").alias("__s"), "buckets"))  # a row for each source
    order = sized.join(known, F.col("source").eqNullSafe(F.col("__s"))).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size"))
    order = order.select("doc_id", "sidx", "size", "h", F.pmod("h", "buckets").cast("int").alias("bucket"))
    at = W.partitionBy("sidx").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = order.groupBy("sidx", "bucket").agg(F.sum("size").alias("words")).select("sidx", "bucket", F.coalesce(F.sum("words").over(at), F.lit(0)).alias("before"))
    within = W.partitionBy("sidx", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = scratch.write(
        order.join(before, ["sidx", "bucket"]).select("doc_id", "sidx", "size", (F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))).alias("start")), "placed"
    )
    scratch.drop(sized)
    plan = draw_plan(quota, max(1, -(-sum(quota) // shard_slots)), seed)
    rows = spark.createDataFrame([(s, i, f, n, blocks[i]) for s, i, f, n in plan], "shard int, sidx int, first long, n long, blocks long")
    drawn = rows.select("shard", "sidx", "blocks", F.explode(F.expr("sequence(first, first + n - 1)")).alias("draw"))

    def choose(batches):
        for p in batches:
            turn = (p["draw"] // p["blocks"]).to_numpy(np.int64)
            p["block"] = permute((p["draw"] % p["blocks"]).to_numpy(np.int64), p["blocks"].to_numpy(np.int64), turn * 1_000_003 + p["sidx"].to_numpy(np.int64) * 7919 + seed)
            yield p[["shard", "sidx", "draw", "block"]]

    return sources.drop("buckets"), placed, drawn.mapInPandas(choose, "shard int, sidx int, draw long, block long")


def spans(placed: DataFrame, block_words: int) -> DataFrame:
    """(doc_id, sidx, start, size, block, words): which part of each block is of which document."""
    inner = placed.where("size > 0").select("*", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")).alias("block"))
    lo, hi = F.greatest("start", F.col("block") * block_words), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return inner.select("doc_id", "sidx", "start", "size", "block", (lo - F.col("start")).alias("first_word"), (hi - lo).alias("words"))


def taken_words(docs: DataFrame, scratch: Scratch, block_words: int = 128, **kw) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of docs."""
    sources, placed, slots = mix(docs, scratch, block_words=block_words, **kw)
    draws = slots.groupBy("sidx", "block").agg(F.count(F.lit(1)).alias("draws"))
    taken = (
        spans(placed, block_words).join(draws, ["sidx", "block"], "left")
        .groupBy("doc_id", "sidx", "start", "size").agg(F.sum(F.col("words") * F.coalesce("draws", F.lit(0))).alias("taken"))
        .select("doc_id", "sidx", "size", "taken")
        .unionByName(placed.where("size = 0").select("doc_id", "sidx", "size", F.lit(0).cast("long").alias("taken")))
    )
    return taken.join(F.broadcast(sources), "sidx").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, scratch: Scratch, block_words: int = 128, **kw) -> DataFrame:
    """Columns of docs: a row for each time the mix passes over a document, with the words that pass takes.

    Where it takes the whole document the text is unchanged; else its words are joined by spaces.
    Rows that the mix takes no word of are gone. n_chars, if there is one, follows the text.
    """
    _, placed, slots = mix(docs, scratch, block_words=block_words, **kw)
    draws = slots.groupBy("sidx", "block").agg(F.count(F.lit(1)).cast("int").alias("draws"))
    x = hidden(docs)
    parts = (
        spans(placed, block_words).join(draws, ["sidx", "block"])
        .select("doc_id", "start", "sidx", "size", "first_word", "words", F.explode(F.expr("sequence(1, draws)")).alias("pass"))
        .groupBy("doc_id", "sidx", "start", "size", "pass")
        .agg(F.sum("words").alias("n"), F.array_sort(F.collect_list(F.struct("first_word", "words"))).alias("parts"))
        .groupBy("doc_id", "sidx", "start", "size").agg(F.collect_list(F.struct("n", "parts")).alias("passes"))
    )
    nth = W.partitionBy("doc_id", "size").orderBy("sidx", "start")
    parts = parts.select(F.col("doc_id").alias(f"{x}id"), F.col("size").alias(f"{x}size"), F.col("passes").alias(f"{x}passes"), F.row_number().over(nth).alias(f"{x}nth"))
    marked = docs.withColumn(f"{x}words", n_words(F.col("text"))).where(f"{x}words > 0")
    marked = marked.withColumn(f"{x}n", F.row_number().over(W.partitionBy("doc_id", f"{x}words").orderBy(F.col("source").asc_nulls_last())))
    joined = marked.join(parts, marked["doc_id"].eqNullSafe(parts[f"{x}id"]) & (F.col(f"{x}words") == F.col(f"{x}size")) & (F.col(f"{x}n") == F.col(f"{x}nth")))
    out = joined.select(*docs.columns, f"{x}words", F.explode(f"{x}passes").alias(f"{x}pass"))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    some = F.array_join(F.flatten(F.transform(F.col(f"{x}pass.parts"), lambda p: F.slice(words, (p["first_word"] + 1).cast("int"), p["words"].cast("int")))), " ")
    text = F.when(F.col(f"{x}pass.n") == F.col(f"{x}words"), F.col("text")).otherwise(some)
    out = out.withColumn(f"{x}text", text)
    cols = {"text": F.col(f"{x}text")} | ({"n_chars": F.length(f"{x}text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[cols.get(c, F.col(c)).alias(c) for c in docs.columns])
