"""Language-model scores: marginal likelihood of a text over all its segmentations into subwords.

The pieces are those of an existing public vocabulary (a `word_begin` mark and pieces that never span
white space, with byte pieces as fallback). Its scores come from the file (get_score). The public vocabulary at hand is
of the merge kind, whose scores are orders of merges and no log-probabilities, so a piece with score s starts at the
probability that its rank has in a Zipf law, in proportion to 1 / (10 - s). A documented learning step follows:
rounds of expectation maximisation on the training documents, where each distinct word weights all its
segmentations (forward and backward recursions in log space) and gives expected piece counts, times how often it occurs.

The score of a text is the log-space forward recursion over all segmentations into pieces, and nothing else: no words, only
pieces have probabilities. As no piece spans white space, the probability of a text is the product of the marginals
of its words and of the end, so each distinct word is worked out once however often it occurs; all counts of words and
pieces cover all training documents.

Documents go in runs of bounded size; a run sends each of its distinct words once, with counts, and
each document as counts of the run's words. Words meet by their text (combined before the shuffle),
get their corpus count and log-probability, and go back to the runs that have them.

Defined cases: a null text counts as empty: one end token; an empty table gives no rows; without any
training text, the starting scores hold; very long words are worked out like others, in
memory proportional to the word; repeated rows and doc_ids are separate rows, ties there are none, and other columns are
not read. Words are told apart by their text, within one run by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wayforge.llm.common import Scratch, crc32_mod
from wayforge.llm.words import LOWER, hash_spans, spans, texts_of

RUN_BYTES = 24 << 20
SMOOTH, MARK = 1.0, "▁"
_PIECES: dict = {}
_K = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Pieces of a SentencePiece vocabulary by hash of their characters, longest first in `lengths`."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.byte = np.zeros(256, np.int64)
        text, ids = [], []
        for i in range(self.size):
            s = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(s[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)) and MARK not in s[1:]:
                text.append(s)
                ids.append(i)
        self.end = sp.eos_id()
        size = np.array([len(s) for s in text])
        key = np.array([_hash(np.array([ord(c) for c in s], np.uint32)) for s in text], np.uint64)
        order = np.argsort(key)
        self.key, self.id, self.longest = key[order], np.array(ids, np.int64)[order], int(size.max())
        # Scores of the vocabulary are orders of merges (0, -1, ..): each as the probability of its rank. Byte pieces have none, so they come last.
        own = np.array([-float(self.size) if sp.is_byte(i) else sp.get_score(i) for i in range(self.size)])
        self.start = -np.log(10.0 - np.minimum(own, 0.0))
        self.start -= np.log(np.exp(self.start).sum())


def _hash(points: np.ndarray) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for p in points:
        h = _step(h, np.array([p], np.uint32))
    return h[0]


def _step(h: np.ndarray, point: np.ndarray) -> np.ndarray:
    h = (h ^ (point.astype(np.uint64) + np.uint64(0x51ED27))) * _K
    return h ^ (h >> np.uint64(29))


def pieces_of(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


class Lattice:
    """All edges (from, to, piece) of the words of a batch, over one array of characters.

    Words are laid side by side; a word of n characters (its mark included) has n + 1 nodes.
    """

    def __init__(self, v: Pieces, words: list[str]):
        text = [MARK + w for w in words]
        self.n = np.array([len(t) for t in text], np.int64)
        flat = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum(self.n)
        self.first = ends - self.n
        self.node0 = self.first + np.arange(len(words))  # first node of each word
        at = np.arange(len(flat))
        word = np.repeat(np.arange(len(words)), self.n)
        node = at + word
        room = ends[word] - at
        src, dst, piece = [], [], []
        h = np.zeros(len(flat), np.uint64)
        live = at
        for k in range(1, v.longest + 1):
            live = live[room[live] >= k]
            if not len(live):
                break
            h[live] = _step(h[live], flat[live + k - 1])
            i = np.minimum(np.searchsorted(v.key, h[live]), len(v.key) - 1)
            hit = v.key[i] == h[live]
            src.append(node[live[hit]])
            dst.append(src[-1] + k)
            piece.append(v.id[i[hit]])
        self.src, self.dst, self.piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (src, dst, piece))
        # Byte pieces: one edge for each character, of several pieces.
        self.raw = flat
        self.char_node = node
        self.nodes = len(flat) + len(words)
        order = np.argsort(self.dst, kind="stable")
        self.src, self.dst, self.piece = self.src[order], self.dst[order], self.piece[order]

    def char_bytes(self):
        """(node, byte) of the UTF-8 bytes of each character."""
        p, n = self.raw.astype(np.int64), self.char_node
        one, two, three, four = p < 0x80, (p >= 0x80) & (p < 0x800), (p >= 0x800) & (p < 0x10000), p >= 0x10000
        yield n[one], p[one]
        for m, lead, shifts in ((two, 0xC0, (6, 0)), (three, 0xE0, (12, 6, 0)), (four, 0xF0, (18, 12, 6, 0))):
            for i, s in enumerate(shifts):
                yield n[m], ((lead | (p[m] >> s)) if i == 0 else (0x80 | ((p[m] >> s) & 0x3F)))

    def byte_scores(self, v: Pieces, score: np.ndarray) -> np.ndarray:
        out = np.full(self.nodes, -np.inf)
        out[self.char_node] = 0
        for node, byte in self.char_bytes():
            out[node] += score[v.byte[byte]]
        return out

    def sweep(self, v: Pieces, score: np.ndarray, back: bool = False) -> np.ndarray:
        """Log-space forward (or backward) recursion: all words advance by one node at a time."""
        jump = self.byte_scores(v, score)
        alpha = np.full(self.nodes, -np.inf)
        last = self.node0 + self.n
        alpha[last if back else self.node0] = 0
        near, far = (self.dst, self.src) if back else (self.src, self.dst)
        depth = far - self.node0[np.searchsorted(self.node0, far, "right") - 1]
        if back:
            depth = self.n[np.searchsorted(self.node0, far, "right") - 1] - depth
        order = np.argsort(depth, kind="stable")
        near, far, w, depth = near[order], far[order], score[self.piece[order]], depth[order]
        cut = np.searchsorted(depth, np.arange(1, int(self.n.max(initial=0)) + 2))
        longest = np.argsort(-self.n, kind="stable")
        sizes = -self.n[longest]
        for d in range(1, int(self.n.max(initial=0)) + 1):
            live = longest[: np.searchsorted(sizes, -d, "right")]
            node = (last[live] - d) if back else (self.node0[live] + d)
            here = alpha[node + 1] + jump[node] if back else alpha[node - 1] + jump[node - 1]
            lo, hi = cut[d - 1], cut[d]
            x = alpha[near[lo:hi]] + w[lo:hi]
            top = here.copy()
            slot = np.empty(hi - lo, np.int64)
            where = np.searchsorted(np.sort(node), far[lo:hi])
            slot = np.argsort(node, kind="stable")[where]
            np.maximum.at(top, slot, x)
            total = np.exp(here - top)
            np.add.at(total, slot, np.exp(x - top[slot]))
            alpha[node] = top + np.log(total)
        return alpha

    def marginals(self, v: Pieces, score: np.ndarray) -> np.ndarray:
        return self.sweep(v, score)[self.node0 + self.n] if len(self.n) else np.zeros(0)

    def expected(self, v: Pieces, score: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected count of each piece over all segmentations, words weighted."""
        if not len(self.n):
            return np.zeros(v.size)
        a, b = self.sweep(v, score), self.sweep(v, score, back=True)
        z = a[self.node0 + self.n]
        word = np.searchsorted(self.node0, self.src, "right") - 1
        out = np.bincount(self.piece, weight[word] * np.exp(a[self.src] + score[self.piece] + b[self.dst] - z[word]), minlength=v.size)
        jump = self.byte_scores(v, score)
        word = np.searchsorted(self.node0, self.char_node, "right") - 1
        share = np.zeros(self.nodes)
        share[self.char_node] = weight[word] * np.exp(a[self.char_node] + jump[self.char_node] + b[self.char_node + 1] - z[word])
        for node, byte in self.char_bytes():
            out += np.bincount(v.byte[byte], share[node], minlength=v.size)
        return out


def batches_of(words: list[str], chars: int = 60_000):
    """Index ranges of about so many characters; words of like length together keep sweeps short."""
    at, size = 0, 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size >= chars:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(words):
        yield at, len(words)


def _read(kind: str, id_type: pa.DataType):
    """Rows of three sorts from one pass over the texts.

    sort 0: a document: run, doc_id, held_out, n_tokens, idx and tf (its words as numbers within
    the run, and how often). sort 1: a word of a run: run, number, word, n (in training documents).
    """
    names = ["sort", "run", "doc_id", "held_out", "n_tokens", "idx", "tf", "number", "word", "n"]

    def run(batches):
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0
        state = {"hash": np.zeros(0, np.uint64), "id": np.zeros(0, np.int64), "words": [], "n": [], "bytes": 0}

        def close():
            nonlocal serial
            k = len(state["words"])
            for i in range(0, k, 50_000):
                j = min(k, i + 50_000)
                m = j - i
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(m, np.int32)), pa.array(np.full(m, (part << 24) + serial)), pa.nulls(m, id_type), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()),
                     pa.array(np.arange(i, j, dtype=np.int32)), pa.array(state["words"][i:j], pa.binary()).cast(pa.string()), pa.array(np.asarray(state["n"][i:j], np.int64))], names=names)
            serial += 1
            state.update(hash=np.zeros(0, np.uint64), id=np.zeros(0, np.int64), words=[], n=[], bytes=0)

        for b in batches:
            held = b.column(2).to_pylist()
            rows, hashes, tfs, total = [], [], [], []
            raws = list(texts_of(b.column(1)))
            firsts = []
            for raw in raws:
                data = LOWER[np.frombuffer(raw, np.uint8)]
                s, e = spans(data)
                h = hash_spans(data, s, e)
                u, first, tf = np.unique(h, return_index=True, return_counts=True)
                hashes.append(u)
                tfs.append(tf)
                total.append(len(h) + 1)
                firsts.append((s[first], e[first], data))
            every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            doc = np.repeat(np.arange(len(raws)), [len(x) for x in hashes])
            uniq, where, back = np.unique(every, return_index=True, return_inverse=True)
            at = np.searchsorted(state["hash"], uniq)
            known = np.zeros(len(uniq), bool)
            if len(state["hash"]):
                known = state["hash"][np.minimum(at, len(state["hash"]) - 1)] == uniq
            number = np.empty(len(uniq), np.int64)
            if known.any():
                number[known] = state["id"][at[known]]
            fresh = np.flatnonzero(~known)
            number[fresh] = len(state["words"]) + np.arange(len(fresh))
            offset = np.concatenate([[0], np.cumsum([len(x) for x in hashes])])
            for w in where[fresh]:
                d = doc[w]
                s, e, data = firsts[d]
                k = w - offset[d]
                state["words"].append(data[s[k] : e[k]].tobytes())
            state["n"].extend([0] * len(fresh))
            train = np.concatenate([t if not x else np.zeros(len(t), np.int64) for t, x in zip(tfs, held, strict=True)]) if tfs else np.zeros(0, np.int64)
            add = np.bincount(back, train, minlength=len(uniq)).astype(np.int64) if len(uniq) else np.zeros(0, np.int64)
            n = np.asarray(state["n"], np.int64)
            n[number] += add
            state["n"] = list(n)
            keep = np.insert(state["hash"], at[fresh], uniq[fresh]) if len(state["hash"]) else uniq
            state["id"] = np.insert(state["id"], at[fresh], number[fresh]) if len(state["hash"]) else number
            state["hash"] = keep
            idx = number[back].astype("<u4")
            m = len(raws)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(m, np.int32)), pa.array(np.full(m, (part << 24) + serial)), b.column(0), pa.array(held, pa.bool_()), pa.array(np.asarray(total, np.int64)),
                 pa.array([idx[offset[i] : offset[i + 1]].tobytes() for i in range(m)], pa.binary()), pa.array([tfs[i].astype("<u4").tobytes() for i in range(m)], pa.binary()),
                 pa.nulls(m, pa.int32()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64())], names=names)
            state["bytes"] += sum(map(len, raws))
            if state["bytes"] >= RUN_BYTES:
                yield from close()
        yield from close()

    return run, f"sort int, run long, doc_id {kind}, held_out boolean, n_tokens long, idx binary, tf binary, number int, word string, n long"


def score_documents(docs: DataFrame, scratch: Scratch, vocabulary: str, folds: int = 7, held: int = 2, rounds: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs."""
    spark = docs.sparkSession
    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (crc32_mod(F.col(doc_id), folds) == held).alias("held"))
    kind = body.schema["doc_id"].dataType.simpleString()
    run, schema = _read(kind, to_arrow_type(body.schema["doc_id"].dataType))
    both = scratch.write(body.mapInArrow(run, schema), "runs")
    documents, used = both.where("sort = 0"), scratch.again(both).where("sort = 1").select("run", "number", "word", "n")
    words = scratch.write(used.groupBy("word").agg(F.sum("n").alias("c")), "words")
    seen = words.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    ends, runs = documents.agg(F.sum((~F.col("held_out")).cast("long")), F.countDistinct("run")).first()
    ends = ends or 0
    train_tokens, distinct = (seen[0] or 0) + ends, (seen[1] or 0) + (1 if ends else 0)
    score = learned(words.where("c > 0"), vocabulary, rounds, ends)
    table = spark.sparkContext.broadcast(score)  # one number for each piece of the vocabulary
    end = float(score[pieces_of(vocabulary).end]) / np.log(10)
    floor = float(np.log10(float(train_tokens) + SMOOTH * (distinct + 1)))

    def marginal(batches):
        v = pieces_of(vocabulary)
        for b in batches:
            w = b.column(0).to_pylist()
            out = np.zeros(len(w))
            order = sorted(range(len(w)), key=lambda i: len(w[i]))
            text = [w[i] for i in order]
            for i, j in batches_of(text):
                out[order[i:j]] = Lattice(v, text[i:j]).marginals(v, table.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out / np.log(10))], names=["word", "c", "lp"])

    known = words.mapInArrow(marginal, "word string, c long, lp double")
    found = used.select("run", "number", "word").join(known, "word").select("run", "number", "c", "lp")

    def finish(left, right):
        import pandas as pd

        n = int(right["number"].max()) + 1 if len(right) else 0
        c, lp = np.zeros(n, np.int64), np.zeros(n)
        c[right["number"]], lp[right["number"]] = right["c"], right["lp"]
        base, rows = np.log10(c + SMOOTH), []
        for idx, tf in zip(left["idx"], left["tf"], strict=True):
            idx, tf = np.frombuffer(idx, "<u4"), np.frombuffer(tf, "<u4").astype(np.int64)
            rows.append((int(tf[c[idx] > 0].sum()), float((base[idx] * tf).sum()), float((lp[idx] * tf).sum())))
        r = np.array(rows, np.float64).reshape(-1, 3)
        e = np.log10(ends + SMOOTH)
        return pd.DataFrame({
            "doc_id": left["doc_id"], "held_out": left["held_out"], "n_tokens": left["n_tokens"], "n_known": r[:, 0].astype(np.int64) + (1 if ends else 0),
            "train_tokens": train_tokens, "base_score": r[:, 1] + e - left["n_tokens"].to_numpy() * floor, "score": r[:, 2] + end,
        })

    # A run's rows are of bounded size; as many tasks as runs keep what a task reads bounded too.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), runs or 0)
    left, right = documents.select("run", "doc_id", "held_out", "n_tokens", "idx", "tf").repartition(parts, "run"), found.repartition(parts, "run")
    return left.groupBy("run").cogroup(right.groupBy("run")).applyInPandas(
        finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def learned(words: DataFrame, vocabulary: str, rounds: int, ends: int) -> np.ndarray:
    """Log-probabilities of the pieces after so many rounds of expectation maximisation over words (word, c): each
    counts c times, and the end once for each of `ends` documents."""
    v = pieces_of(vocabulary)
    score = v.start.copy()
    for _ in range(rounds if ends else 0):
        table = words.sparkSession.sparkContext.broadcast(score)

        def expect(batches, table=table):
            v = pieces_of(vocabulary)
            total = np.zeros(v.size)
            for b in batches:
                w, c = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False).astype(float)
                order = sorted(range(len(w)), key=lambda i: len(w[i]))
                text, c = [w[i] for i in order], c[order]
                for i, j in batches_of(text):
                    total += Lattice(v, text[i:j]).expected(v, table.value, c[i:j])
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["piece", "n"])

        got = words.select("word", "c").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
        score = _shares(v, {r["piece"]: r["n"] for r in got}, ends)
    return score


def _shares(v: Pieces, found: dict[int, float], ends: int) -> np.ndarray:
    count = np.full(v.size, 0.01)
    for piece, n in found.items():
        count[piece] += n
    count[v.end] += ends
    return np.log(count / count.sum())
