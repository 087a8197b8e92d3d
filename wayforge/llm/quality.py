"""Quality classifier by positive-unlabelled learning.

Trusted positives are the labelled rows of quality 1 outside the held-out fold; unlabelled text is any
other row outside it, labels unread. Models of positives against unlabelled text, each scoring texts
it was not fitted on, first give an estimate of the class prior: the ratio of the tails of these scores
where its upper bound is least. Then a small network minimises the non-negative unbiased risk with that
prior: when the risk of negatives, unlabelled minus prior times positives, falls below zero,
the step goes against it. Inputs are measures of the whole text only: shares of kinds of characters, word and
line shapes, and how much repeats.

Fitting uses at most `most` positives and `most` unlabelled texts, picked by a keyed hash of the id.

Defined cases: a null text is empty; an empty or blank text is scored by the same model, on zero
measures; without a single positive or unlabelled row every score is 0.5 (kept); an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayforge.llm.common import Scratch, session_ready
from wayforge.llm.sampling import held_out, pick, with_texts
from wayforge.llm.words import hash_spans, spans, texts_of

SAMPLE = 12_000


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


UPPER, LOWERS, DIGIT = (_class(x) for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"))
KINDS = [UPPER, DIGIT, *(_class(x) for x in ("!", "?", ".", ",;:", "'\"()-", "|", "$%&*#@^~+=<>", "{}[]\\/_`", " ", "\n"))]
KIND_TABLE = np.zeros(256, np.int64)
for _i, _k in enumerate(KINDS, 1):
    KIND_TABLE[_k] = _i


def measures(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    out = np.zeros(27)
    if not n:
        return out
    count = np.bincount(KIND_TABLE[data], minlength=len(KINDS) + 1)
    out[: len(KINDS)] = count[1:] / n
    high = data >= 128
    wide = np.flatnonzero(data[:-1] == 0xC3)
    big = int((data[wide + 1] < 0x9F).sum()) if len(wide) else 0
    letters = count[1] + int(LOWERS[data].sum()) + len(wide)
    out[12] = (count[1] + big) / max(1, letters)
    out[13] = high.mean()
    out[14] = letters / n
    s, e = spans(data)
    w = len(s)
    out[15] = np.log1p(w) / 10
    if not w:
        return out
    size = (e - s).astype(float)
    h = hash_spans(data, s, e)
    lone = np.unique(h)
    out[16], out[17] = np.minimum(size.mean(), 40) / 10, np.minimum(size.std(), 40) / 10
    out[18] = UPPER[data[s]].mean()
    out[19] = len(lone) / w
    out[20] = len(lone) / w**0.8
    out[21] = (~(UPPER | LOWERS | DIGIT)[data[e - 1]] & ~high[e - 1]).mean()
    if w > 1:
        out[22] = (h[1:] == h[:-1]).mean()
        pairs = h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1]
        out[23] = len(np.unique(pairs)) / (w - 1)
    lines = count[12] + 1
    out[24] = np.log1p(n / lines) / 10
    out[25] = (size == 1).mean()
    out[26] = 1.0
    return out


def _adam(grad, params: list[np.ndarray], steps: int, rate: float) -> list[np.ndarray]:
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for i, g in enumerate(grad(params)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return params


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _net(p, x):
    h = np.tanh(x @ p[0] + p[1])
    return h, h @ p[2] + x @ p[3] + p[4]


def _start(d: int, hidden: int, rng) -> list[np.ndarray]:
    return [rng.normal(0, 0.3, (d, hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), np.zeros(d), np.zeros(1)]


def _backward(p, x, h, g):
    """Gradient of sum(g * output)."""
    gh = np.outer(g, p[2]) * (1 - h * h)
    return [x.T @ gh, gh.sum(0), h.T @ g, x.T @ g, np.array([g.sum()])]


def _against(pos: np.ndarray, un: np.ndarray, decay: float):
    """Gradient of the logistic loss of positives against unlabelled texts."""

    def grad(p):
        hp, fp = _net(p, pos)
        hu, fu = _net(p, un)
        gp, gu = -_sigmoid(-fp) / len(pos), _sigmoid(fu) / len(un)
        return [a + b + decay * w for a, b, w in zip(_backward(p, pos, hp, gp), _backward(p, un, hu, gu), p, strict=True)]

    return grad


def prior_of(score_pos: np.ndarray, score_un: np.ndarray) -> float:
    """Share of positives in the unlabelled scores: the ratio of the tails at the bin where its upper bound is least."""
    slack = np.sqrt(np.log(40) / (2 * len(score_pos))) + np.sqrt(np.log(40) / (2 * len(score_un)))
    tails = [((score_pos >= c).mean(), (score_un >= c).mean()) for c in np.quantile(score_pos, np.linspace(0, 0.9, 37))]
    return min(((u + slack) / p, u / p) for p, u in tails)[1]


def estimate_prior(pos: np.ndarray, un: np.ndarray, rng, hidden: int, decay: float, repeats: int = 3, most: int = 4000) -> float:
    """Median over repeats; each scores every text by a model fitted without it, in three folds."""
    found = []
    for _ in range(repeats):
        a, b = pos[rng.permutation(len(pos))[:most]], un[rng.permutation(len(un))[:most]]
        sa, sb = np.zeros(len(a)), np.zeros(len(b))
        for fold in range(3):
            ta, tb = np.arange(len(a)) % 3 == fold, np.arange(len(b)) % 3 == fold
            if ta.all() or tb.all():
                continue
            net = _adam(_against(a[~ta], b[~tb], decay), _start(a.shape[1], hidden, rng), 200, 0.02)
            sa[ta], sb[tb] = _net(net, a[ta])[1], _net(net, b[tb])[1]
        found.append(prior_of(sa, sb))
    return float(min(0.98, max(0.05, np.median(found))))


def fit(pos: np.ndarray, un: np.ndarray, seed: int = 5, hidden: int = 8, steps: int = 700, decay: float = 0.02) -> dict:
    """Positive-unlabelled model: normalisation, network and the estimated prior."""
    rng = np.random.Generator(np.random.PCG64(seed))
    both = np.concatenate([pos, un])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    pos, un = (_scaled(x, mean, scale) for x in (pos, un))
    prior = estimate_prior(pos, un, rng, hidden, decay)

    def risk(p):
        # sigmoid loss l(z) = sigmoid(-z): unbiased risk with a non-negative part for negatives
        hp, fp = _net(p, pos)
        hu, fu = _net(p, un)
        sp, su = _sigmoid(fp), _sigmoid(fu)
        dp, du = sp * (1 - sp) / len(pos), su * (1 - su) / len(un)
        if su.mean() - prior * sp.mean() >= 0:
            gp, gu = -2 * prior * dp, du
        else:
            gp, gu = prior * dp, -du
        return [a + b + 0.1 * decay * w for a, b, w in zip(_backward(p, pos, hp, gp), _backward(p, un, hu, gu), p, strict=True)]

    p = _adam(_against(pos, un, decay), _start(pos.shape[1], hidden, rng), 200, 0.02)
    return {"mean": mean, "scale": scale, "net": _adam(risk, p, steps, 0.01), "prior": prior}


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def predict(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    return _sigmoid(_net(model["net"], _scaled(x, model["mean"], model["scale"]))[1])


def _measured(rows: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([measures(t).tolist() for t in texts_of(b.column(1))], pa.list_(pa.float64()))], names=["tag", "x"])

    return rows.mapInArrow(run, "tag string, x array<double>")


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> dict | None:
    open_docs = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    good = labels.where(~held_out(F.col("doc_id")) & (F.col("quality") == 1))
    pos = pick(good.join(docs.select("doc_id"), "doc_id", "left_semi"), most, 11)
    un = pick(open_docs, most, 12)
    rows = _measured(with_texts(open_docs, pos, "p").union(with_texts(open_docs, un, "u"))).collect()  # at most 2 * most rows
    x = {t: np.array(sorted(list(r["x"]) for r in rows if r["tag"] == t)) for t in "pu"}
    return fit(x["p"], x["u"]) if len(x["p"]) and len(x["u"]) else None


def score(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None, most: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs."""
    spark = docs.sparkSession
    session_ready(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, most))

    def run(batches):
        for b in batches:
            x = np.array([measures(t) for t in texts_of(b.column(1))]).reshape(-1, 27)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(predict(model.value, x))], names=["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    body = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return body.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """Rows of docs that the classifier accepts, with all their columns, in one pass."""
    from pyspark.sql.types import BooleanType

    spark = docs.sparkSession
    session_ready(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, most))

    @F.pandas_udf(BooleanType())
    def good(text):
        import pandas as pd

        x = np.array([measures(t.encode("utf-8", "replace") if isinstance(t, str) else b"") for t in text]).reshape(-1, 27)
        return pd.Series(predict(model.value, x) >= threshold)

    return docs.where(good("text"))
