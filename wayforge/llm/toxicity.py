"""Toxicity by a factorisation machine over hashed terms.

A text is the set of its terms, hashed to 2^22 slots: its words (letters and digits in any script, A-Z and the
capitals of Latin-1 lower-cased) and, as inflected languages put endings on insults, the beginnings of its words.
Slots that the fitting sample shows to go with a label, by a likelihood-ratio test with a floor on how many
different texts have them, enter the model; it has a weight and a vector for each, and adds the
inner product of the vectors of each pair present, so an insult next to a group mention can score above what
either adds alone. Vectors are learned with the weights by gradient steps on the logistic loss.

Fitting uses at most `most` texts of each label outside the held-out fold, picked by a keyed hash of the
id; repeated texts count once. Weights of rows undo the different rates of picking.

Defined cases: a null, empty or blank text has no terms and gets the score of the intercept; without
toxic or without clean rows to learn from, every score is the share of toxic rows (0 without any); an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayforge.llm.common import Scratch, session_ready
from wayforge.llm.quality import _adam, _sigmoid
from wayforge.llm.sampling import held_out, pick, with_texts
from wayforge.llm.words import LOWER, hash_spans, texts_of

SAMPLE, SLOTS, FACTORS, LEAST, MOST_TERMS = 4_000, 1 << 22, 4, 4, 4096
STEMS = (4, 5, 6, 7, 8)  # bytes of a word's beginning
STEM_KEY = np.uint64(0xD6E8FEB86659FD93)
INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[97:123] = INSIDE[128:] = True


def terms(raw: bytes) -> np.ndarray:
    """Sorted distinct slots of the terms of a text."""
    data = LOWER[np.frombuffer(raw, np.uint8)]
    if not len(data):
        return np.zeros(0, np.int32)
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1  # capitals of Latin-1 in two bytes
    lead = lead[(data[lead] < 0x9F) & (data[lead] != 0x97)]
    data[lead] += 0x20
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = INSIDE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    found = [hash_spans(data, start, end)]
    for n in STEMS:
        long = end - start > n
        found.append(hash_spans(data, start[long], start[long] + n) * STEM_KEY)
    return np.unique(np.concatenate(found) >> np.uint64(42)).astype(np.int32)


def fit(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = 3, steps: int = 500) -> dict:
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    with1, with0 = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
    for bag, label in zip(bags, y, strict=True):  # a bag holds each slot once
        (with1 if label else with0)[bag] += 1
    some = np.flatnonzero(with1 + with0 >= LEAST)
    with1, with0 = with1[some].astype(float), with0[some].astype(float)
    p1, p0, p = (with1 + 0.5) / (n1 + 1), (with0 + 0.5) / (n0 + 1), (with1 + with0 + 1) / (n1 + n0 + 2)
    g2 = 2 * (with1 * np.log(p1 / p) + (n1 - with1) * np.log((1 - p1) / (1 - p)) + with0 * np.log(p0 / p) + (n0 - with0) * np.log((1 - p0) / (1 - p)))
    good = np.flatnonzero(g2 > 12)
    slots = np.sort(some[good[np.argsort(-g2[good], kind="stable")[:MOST_TERMS]]]).astype(np.int32)
    cols = [np.searchsorted(slots, bag[np.isin(bag, slots)]) for bag in bags]
    rows = np.array([len(x) for x in cols])
    col, doc = np.concatenate([*cols, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(bags)), rows)
    order = np.argsort(col, kind="stable")
    edges = np.concatenate([[0], np.cumsum(rows)])
    total = weight.sum()

    def by_doc(x):
        c = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0)])
        return c[edges[1:]] - c[edges[:-1]]

    starts = np.searchsorted(col[order], np.arange(len(slots) + 1))

    def by_col(x):
        c = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x[order], 0)])
        return c[starts[1:]] - c[starts[:-1]]

    def grad(params):
        w, v, b = params
        s = by_doc(v[col])
        z = b[0] + by_doc(w[col]) + 0.5 * ((s * s).sum(1) - by_doc((v * v).sum(1)[col]))
        e = (_sigmoid(z) - y) * weight / total
        gw = by_col(e[doc])
        gv = by_col(e[doc, None] * s[doc]) - v * gw[:, None]
        return [gw + 1e-5 * w, gv + 3e-2 * v, np.array([e.sum()])]

    rng = np.random.Generator(np.random.PCG64(seed))
    share = float((weight * y).sum() / total)
    start = [np.zeros(len(slots)), rng.normal(0, 0.02, (len(slots), FACTORS)), np.array([np.log((share + 1e-6) / (1 - share + 1e-6))])]
    w, v, b = _adam(grad, start, steps, 0.08)
    return {"slots": slots, "w": w, "v": v, "b": float(b[0])}


def predict(model: dict, bag: np.ndarray) -> float:
    slots = model["slots"]
    if not len(slots) or not len(bag):
        return float(_sigmoid(np.array(model["b"])))
    at = np.minimum(np.searchsorted(slots, bag), len(slots) - 1)
    at = at[slots[at] == bag]
    v = model["v"][at]
    s = v.sum(0)
    return float(_sigmoid(np.array(model["b"] + model["w"][at].sum() + 0.5 * ((s * s).sum() - (v * v).sum()))))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> dict:
    body = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").join(docs.select("doc_id"), "doc_id", "left_semi")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.countDistinct("doc_id").alias("n")).collect()}
    picked = [with_texts(body, pick(known.where(F.col("toxic") == t), most, 21 + t), str(t)) for t in (0, 1)]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([terms(t).tobytes() for t in texts_of(b.column(1))], pa.binary())], names=["tag", "x"])

    got = picked[0].union(picked[1]).mapInArrow(run, "tag string, x binary").toArrow()  # at most 2 * most rows
    rows = sorted(set(zip(got.column("tag").to_pylist(), got.column("x").to_pylist(), strict=True)))
    del got
    y = np.array([float(t) for t, _ in rows])
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return {"slots": np.zeros(0, np.int32), "w": np.zeros(0), "v": np.zeros((0, FACTORS)), "b": float(np.log((share + 1e-9) / (1 - share + 1e-9)))}
    rate = np.array([counts[int(t)] / max(1, (y == t).sum()) for t in y])
    return fit([np.frombuffer(x, np.int32) for _, x in rows], y, rate)


def score(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None, most: int = SAMPLE, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs."""
    spark = docs.sparkSession
    session_ready(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, most))

    def run(batches):
        for b in batches:
            s = pa.array([predict(model.value, terms(t)) for t in texts_of(b.column(1))], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), s], names=["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    body = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return body.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
