"""Largest inner products by an inverted multi-index.

Each vector is cut in two halves, and each half quantised by its own k-means codebook (fitted on at
most `sample` vectors, picked by a keyed hash of the id); the pair of centroid numbers is its cell.
A query orders the centroids of each half by distance (the negated inner product, as that is what is searched)
and walks pairs of centroids by summed distance with a heap, from the best on, until the cells it
has visited hold enough entries; these are reranked by the exact measure on the original vectors.
How many are enough is measured on the fitting sample against brute force, for a given recall.

Every row that takes part is in the index. Of exactly equal vectors only the k + 1 with the smallest ids can be
among anyone's k nearest (ties go to smaller ids), so only these are entries. Entries and queries
meet in blocks of neighbouring cells, of a bounded number of entries and of queries each. A query goes only to blocks
that hold a cell it visits, with a bit for each cell of that block, and is multiplied with the entries of its cells alone.
The scores of what is nearest in a block are then summed again in the order of the components, so they depend on the two
vectors only and equal vectors tie wherever they stand.

Bounds on the driver: two codebooks and a count for each cell, at most MOST_CENTROIDS squared.

Defined cases: vectors that are null, zero, of another length than the commonest, or hold null or
non-finite components take no part, nor do rows without an id; fewer than k candidates give all of
them; an empty table gives no rows. Rows that share a vec_id are rows of their own: each is a candidate for the other, and
each query row has its own list, under the same query_id. Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayforge.llm.common import Scratch

MOST_CENTROIDS, SAMPLE, BLOCK, QUERIES = 1024, 20_000, 20_000, 5_000


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part; v in double precision."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null)")
    rows = rows.where("not exists(v, x -> isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = assign(x, c)
        n = np.bincount(a, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, a, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * x @ c.T, 1)


def walk(d1: np.ndarray, d2: np.ndarray, count: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Pairs of centroids by summed distance, from the least on, until their cells hold enough."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap, got, out = [(s1[0] + s2[0], 0, 0)], 0, []
    reach = [0] * len(o1)
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        a, b = int(o1[i]), int(o2[j])
        if count[a, b]:
            got += int(count[a, b])
            out.append((a, b))
        if j + 1 < len(s2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return out


def centroids_for(n: int) -> int:
    return int(min(MOST_CENTROIDS, max(4, 2 ** round(np.log2(max(1.0, n / 10)) / 2))))


def enough_for(sample: np.ndarray, c1: np.ndarray, c2: np.ndarray, half: int, k: int, recall: float, asked: int = 200) -> float:
    """Share of the entries that queries have to visit for this recall, measured on the fitting
    sample against brute force. Of more vectors the k nearest are nearer, so the share errs upwards."""
    q = sample[: min(asked, len(sample))]
    s = q @ sample.T
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf
    top = np.argsort(-s, 1)[:, : min(k, max(1, len(sample) - 1))]
    a1, a2 = assign(sample[:, :half], c1), assign(sample[:, half:], c2)
    near = (q[:, :half] @ c1.T)[:, a1] + (q[:, half:] @ c2.T)[:, a2]
    place = np.empty_like(near)
    np.put_along_axis(place, np.argsort(-near, 1), np.arange(len(sample))[None, :] * np.ones((len(q), 1)), 1)
    return float(np.quantile(np.take_along_axis(place, top, 1), recall)) / len(sample)


def blocks_of(count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells in blocks of about `most` entries: first block and number of blocks of each cell, and first cell and number of cells of each block."""
    first, parts = np.zeros(count.size, np.int64), np.ones(count.size, np.int64)
    at, size = 0, 0
    for i, n in enumerate(count.ravel().tolist()):
        if n > most:
            at += size > 0
            first[i], parts[i], size = at, -(-n // most), 0
            at += parts[i]
            continue
        if size + n > most:
            at, size = at + 1, 0
        first[i] = at
        size += n
    cells = np.zeros((int(max(at, (first + parts - 1).max(initial=0))) + 1, 2), np.int64)
    for b in range(len(cells)):
        lo, hi = np.searchsorted(first, b, "left"), np.searchsorted(first, b, "right")
        cells[b] = (lo, hi - lo) if hi > lo else (cells[b - 1][0] + cells[b - 1][1] - 1, 1)  # a cell of several blocks
    return first, parts, cells


def search(vectors: DataFrame, scratch: Scratch, every: int = 20, k: int = 20, recall: float = 0.96, sample: int = SAMPLE, seed: int = 9) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, its k nearest."""
    spark = vectors.sparkSession
    rows = scratch.write(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    few = W.partitionBy("v").orderBy("vec_id", "row")
    entries = scratch.again(rows).withColumn("__r", F.row_number().over(few)).where(f"__r <= {k + 1}").drop("__r")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    picked = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(sample).select("v").distinct().collect()
    raw = np.random.Generator(np.random.PCG64(seed)).permutation(np.array(sorted(list(r["v"]) for r in picked)))
    half, kc = max(1, raw.shape[1] // 2), centroids_for(n)
    c1 = kmeans(raw[:, :half], kc, seed)
    c2 = kmeans(raw[:, half:], kc, seed + 1) if raw.shape[1] > 1 else np.zeros((1, 0))
    share = enough_for(raw, c1, c2, half, k, recall)

    def code(batches):
        for p in batches:
            v = np.stack(p["v"].to_numpy())
            p["cell"] = (assign(v[:, :half], c1) * len(c2) + assign(v[:, half:], c2)).astype(np.int32)
            yield p

    indexed = scratch.write(entries.mapInPandas(code, "vec_id long, v array<double>, row long, cell int"), "entries")
    count = np.zeros(len(c1) * len(c2), np.int64)
    for r in indexed.groupBy("cell").count().collect():  # at most a number for each cell
        count[r["cell"]] = r["count"]
    first, parts, cells = blocks_of(count, BLOCK)
    total = int(count.sum())
    enough = min(total, max(50 * k, int(np.ceil(share * total))))
    q_parts = int(max(1, -(-queries.count() // QUERIES)))
    plan = spark.sparkContext.broadcast((count.reshape(len(c1), len(c2)), first, parts, cells))

    def go(batches):
        count, first, parts, cells = plan.value
        for p in batches:
            out = []
            for q, row, v in zip(p["vec_id"], p["row"], p["v"], strict=True):
                v = np.asarray(v)
                seen = np.array([a * len(c2) + b for a, b in walk(-(c1 @ v[:half]), -(c2 @ v[half:]), count, enough)])
                seen.sort()
                to, at = np.unique(first[seen], return_index=True)
                for b, some in zip(to, np.split(seen, at[1:]), strict=True):
                    bits = np.zeros(cells[b, 1], bool)
                    bits[some - cells[b, 0]] = True
                    bits = np.packbits(bits).tobytes()
                    out += [(int(b + j), row // 31 % q_parts, q, row, v, bits) for j in range(parts[some[0]] if len(some) == 1 else 1)]
            yield pd.DataFrame(out, columns=["block", "p", "query_id", "query_row", "q", "cells"])

    def deal(batches):
        _, first, parts, cells = plan.value
        for p in batches:
            cell, row = p["cell"].to_numpy(), p["row"].to_numpy()
            p["block"] = first[cell] + (row * 0x9E3779B1 >> 7) % parts[cell]
            p["cell"] = cell - cells[p["block"].to_numpy(), 0]
            for part in range(q_parts):
                p["p"] = part
                yield p[["block", "p", "vec_id", "row", "v", "cell"]]

    asked = queries.mapInPandas(go, "block long, p long, query_id long, query_row long, q array<double>, cells binary")
    dealt = indexed.mapInPandas(deal, "block long, p long, vec_id long, row long, v array<double>, cell long")

    def rerank(left, right):
        found = []
        if len(left) and len(right):
            ids, row, v, cell = right["vec_id"].to_numpy(), right["row"].to_numpy(), np.stack(right["v"].to_numpy()), right["cell"].to_numpy()
            for q, own, x, bits in zip(left["query_id"], left["query_row"], left["q"], left["cells"], strict=True):
                seen = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
                at = np.flatnonzero(seen[cell] & (row != own))
                s = v[at] @ x
                if len(s) > k:
                    # Whatever rounding may have put below the last of k is scored again too.
                    at = at[s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9 * (1 + np.abs(s).max())]
                s = np.cumsum(v[at] * x, axis=1)[:, -1] if len(at) else np.zeros(0)
                best = np.lexsort((ids[at], -s))[:k]
                found.append((np.full(len(best), q), np.full(len(best), own), ids[at][best], s[best]))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "query_row", "vec_id", "score"), cols, strict=True)))

    best = asked.groupBy("block", "p").cogroup(dealt.groupBy("block", "p")).applyInPandas(rerank, "query_id long, query_row long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
