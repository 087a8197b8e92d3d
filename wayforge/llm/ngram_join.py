"""N-gram Jaccard self-join and its components, as a blocked sparse matrix product.

Think of a 0/1 matrix of documents by n-grams. Pairs that reach the threshold t must share an n-gram
among the first n - ceil(t n) + 1 of each, in any one order of all n-grams; only these entries of the
matrix are multiplied. The order is rare first, by a table of counts over all documents (a fixed
number of slots, so neither memory nor what is broadcast grows); ties in the table or its noise change
the work, never the result. Entries meet in blocks of columns (by n-gram); a pair counts in a column only if its sizes fit and the
n-gram stands early enough in both for their size-derived bound. Overlap counts are accumulated over
all columns, and pairs whose count plus what can still follow is below the bound are discarded. The
rest is checked on whole sets.

Documents with the same set are one class. Frequent n-grams among near copies: first each column links its members
with its hub, the class that shares most entries with others (a group's original, as a rule); then only
pairs of different components are multiplied. So a
group of near copies costs about its size and not its square, and no link between components is lost.

N-grams are compared by 64-bit hashes. Defined cases: a null or blank text has an empty set and
links with nothing; a text with fewer words than n has one n-gram, the whole sequence; repeated
rows are copies; a null doc_id is a row like others, but never the smallest id of a component
unless all its ids are null, and doc_id may be of any plain type; very long texts are hashed window by window, whole; pairs
exactly at the threshold link; other columns are not read by the join, and kept as they are by `keep_one`; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wayforge.llm.common import Scratch, hidden, join_groups
from wayforge.llm.components import connected_components
from wayforge.llm.words import mix, text_shingles, texts_of

SLOT_BITS, SLICES = 20, 64
BLOOM_BITS_LOG2 = 24


def class_of(grams: np.ndarray) -> int:
    """64-bit identity of a set (signed), from its sorted hashes."""
    i = np.arange(1, len(grams) + 1, dtype=np.uint64)
    return int(mix(np.array([(mix(grams + i * np.uint64(0x9E3779B97F4A7C15))).sum()], np.uint64)).view(np.int64)[0])


def _sets(docs: DataFrame, scratch: Scratch, k: int) -> tuple[DataFrame, np.ndarray]:
    """The table (doc_id, n, cls), and how many sets fall on each slot of the table of counts."""
    kind, id_type = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches):
        slots, seen = np.zeros(1 << SLOT_BITS, np.int64), set()
        for b in batches:
            n, cls = [], []
            for raw in texts_of(b.column(1)):
                g = text_shingles(raw, k)
                n.append(len(g))
                cls.append(class_of(g) if len(g) else None)
                if len(g) and cls[-1] not in seen:
                    if len(seen) < 100_000:
                        seen.add(cls[-1])
                    slots += np.bincount((g >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=1 << SLOT_BITS) if len(g) > 5000 else 0
                    if len(g) <= 5000:
                        np.add.at(slots, (g >> np.uint64(64 - SLOT_BITS)).astype(np.int64), 1)
            none = pa.nulls(len(n), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), none, pa.nulls(len(n), pa.binary())], names=["doc_id", "n", "cls", "slice", "counts"])
        parts = np.minimum(slots, 65535).astype("<u2").reshape(SLICES, -1)  # what one task can add to a slot
        some = [i for i in range(SLICES) if parts[i].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(some), id_type), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())],
            names=["doc_id", "n", "cls", "slice", "counts"],
        )

    both = scratch.write(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, cls long, slice int, counts binary"), "sets")

    def add(p):
        total = sum(np.frombuffer(x, "<i4").astype(np.int64) for x in p["counts"])
        p = p.iloc[:1].copy()
        p["counts"] = [total.astype("<i8").tobytes()]
        return p[["slice", "counts"]]

    def partial(batches):
        import pandas as pd

        have: dict = {}
        for p in batches:
            for s, x in zip(p["slice"], p["counts"], strict=True):
                have[s] = have.get(s, 0) + np.frombuffer(x, "<u2").astype(np.int64)
        yield pd.DataFrame({"slice": list(have), "counts": [np.minimum(v, 2**31 - 1).astype("<i4").tobytes() for v in have.values()]})

    small = both.where("slice is not null").select("slice", "counts").mapInPandas(partial, "slice int, counts binary")
    counts = np.zeros((SLICES, (1 << SLOT_BITS) // SLICES), np.int64)
    for r in small.groupBy("slice").applyInPandas(add, "slice int, counts binary").collect():
        counts[r["slice"]] = np.frombuffer(bytes(r["counts"]), "<i8")
    return both.where("slice is null").select("doc_id", "n", "cls"), np.minimum(counts.ravel(), 2**31 - 1).astype(np.int32)


def need(n_a, n_b, num: int, den: int):
    """Least overlap of sets of these sizes with den * overlap >= num * union."""
    return -((-num * (n_a + n_b)) // (num + den))


def _prefix(docs: DataFrame, counts: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """(gram, cls, n, pos) for the first n - ceil(t n) + 1 n-grams of each set, rare first."""
    table = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        freq, seen = table.value, set()
        for b in batches:
            grams, cls, size, pos = [], [], [], []
            for raw in texts_of(b.column(0)):
                g = text_shingles(raw, k)
                if not len(g) or (c := class_of(g)) in seen:
                    continue
                if len(seen) < 100_000:  # copies in one task are sent once; elsewhere they meet later
                    seen.add(c)
                p = len(g) + (-num * len(g)) // den + 1
                f = freq[(g >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                pick = np.lexsort((g, f))[:p]
                grams.append(g[pick])
                cls.append(np.full(p, c, np.int64))
                size.append(np.full(p, len(g), np.int32))
                pos.append(np.arange(p, dtype=np.int32))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([g.view(np.int64) for g in grams], cls, size, pos)], names=["gram", "cls", "n", "pos"])

    return docs.select("text").mapInArrow(run, "gram long, cls long, n int, pos int")


def _columns(prefix: DataFrame) -> DataFrame:
    """(gram, cls, n, pos) of n-grams that at least two classes have. Rows stream in order, and one row is kept back: the last
    entry, until it shows whether its column has another."""

    def run(batches):
        last, shown = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)], True
        for b in batches:
            gram, cls, n, pos = (np.concatenate([x, b.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate(last))
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (cls[1:] != cls[:-1])
            gram, cls, n, pos = gram[new], cls[new], n[new], pos[new]
            if not len(gram):
                continue
            many = np.zeros(len(gram), bool)
            same = gram[1:] == gram[:-1]
            many[1:] |= same
            many[:-1] |= same
            held, end = len(last[0]) == 1, bool(many[-1]) or (len(gram) == 1 and len(last[0]) == 1 and shown)
            last = [x[-1:] for x in (gram, cls, n, pos)]
            if held and shown:
                many[0] = False  # went out before
            shown = end
            yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (gram, cls, n, pos)], names=["gram", "cls", "n", "pos"])

    return prefix.repartition("gram").sortWithinPartitions("gram", "cls").mapInArrow(run, "gram long, cls long, n int, pos int")


def _open(columns: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Entries of the columns that still hold several components, with their roots."""
    if labels is None:
        return columns.withColumn("root", F.col("cls"))
    named = columns.join(labels.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    several = named.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gram")
    return named.join(several, "gram", "left_semi")


def _hub_pairs(entries: DataFrame, hubs: int, num: int, den: int) -> DataFrame:
    """(a, b, n_a, n_b, shared): members of a column with its first hubs; entries have weight w."""
    best = F.row_number().over(W.partitionBy("gram").orderBy(F.desc("w"), "cls"))
    first = entries.withColumn("r", best).where(f"r <= {hubs}").select("gram", F.col("cls").alias("hub"), F.col("n").alias("hub_n"), F.col("root").alias("hub_root"))
    pairs = entries.join(first, "gram").where(f"root <> hub_root and {den} * least(n, hub_n) >= {num} * greatest(n, hub_n)")
    low, one = F.col("cls") < F.col("hub"), F.struct(F.col("cls"), F.col("n"))
    other = F.struct(F.col("hub").alias("cls"), F.col("hub_n").alias("n"))
    ends = pairs.select(F.when(low, one).otherwise(other).alias("x"), F.when(low, other).otherwise(one).alias("y"))
    return ends.groupBy(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).agg(F.max("x.n").alias("n_a"), F.max("y.n").alias("n_b"), F.count(F.lit(1)).alias("shared"))


def _cross_pairs(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, n_a, n_b): pairs of different components that share an n-gram early enough in both."""
    a, b = entries.alias("a"), entries.alias("b")
    least = f"ceil({num} * (a.n + b.n) / {num + den})"
    pairs = a.join(b, F.expr(
        f"a.gram = b.gram and a.cls < b.cls and a.root <> b.root and {den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n) "
        f"and a.pos <= a.n - {least} and b.pos <= b.n - {least}"
    ))
    return pairs.groupBy(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).agg(F.max("a.n").alias("n_a"), F.max("b.n").alias("n_b"))


def _counted(pairs: DataFrame, columns: DataFrame) -> DataFrame:
    """Adds shared, the overlap of the two prefixes."""
    rows = columns.groupBy("cls").agg(F.collect_list("gram").alias("grams"))  # at most a prefix
    x, y = rows.select(F.col("cls").alias("a"), F.col("grams").alias("x")), rows.select(F.col("cls").alias("b"), F.col("grams").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", F.size(F.array_intersect("x", "y")).alias("shared"))


def _bounded(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose overlap can still reach the bound: what they share so far, and the tails behind the prefixes."""
    tail = lambda n: f"(ceil({num} * {n} / {den}) - 1)"
    return pairs.where(f"shared + greatest({tail('n_a')}, {tail('n_b')}) >= ceil({num} * (n_a + n_b) / {num + den})")


def _verified(docs: DataFrame, pairs: DataFrame, scratch: Scratch, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold on whole sets."""
    pairs = scratch.write(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    bits = np.zeros((1 << BLOOM_BITS_LOG2) // 8, np.uint8)

    def slots(cls: np.ndarray) -> np.ndarray:
        h = mix(cls.view(np.uint64))
        return np.stack([(h >> np.uint64(s)) & np.uint64((1 << BLOOM_BITS_LOG2) - 1) for s in (0, 20, 40)], 1).astype(np.int64)

    # A filter of fixed size saves sending sets that no pair needs; what it lets through in excess is joined away.
    def fill(batches):
        own = np.zeros(1 << BLOOM_BITS_LOG2, bool)
        for b in batches:
            own[slots(b.column(0).to_numpy(zero_copy_only=False)).ravel()] = True
        packed = np.packbits(own).reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in packed], pa.binary())], names=["slice", "bits"])

    def either(p):
        p2 = p.iloc[:1].copy()
        p2["bits"] = [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in p["bits"]]).tobytes()]
        return p2

    for r in wanted.mapInArrow(fill, "slice int, bits binary").groupBy("slice").applyInPandas(either, "slice int, bits binary").collect():
        w = len(bits) // SLICES
        bits[r["slice"] * w : (r["slice"] + 1) * w] = np.frombuffer(bytes(r["bits"]), np.uint8)
    table = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        have, seen = table.value, set()
        for b in batches:
            cls, sets = [], []
            for raw in texts_of(b.column(0)):
                g = text_shingles(raw, k)
                if not len(g):
                    continue
                c = np.array([class_of(g)], np.int64)
                at = slots(c)[0]
                if ((have[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all() and int(c[0]) not in seen:
                    if len(seen) < 100_000:
                        seen.add(int(c[0]))
                    cls.append(int(c[0]))
                    sets.append(g.tobytes())
            for i in range(0, len(cls), 256):
                yield pa.RecordBatch.from_arrays([pa.array(cls[i : i + 256], pa.int64()), pa.array(sets[i : i + 256], pa.binary())], names=["cls", "grams"])

    sets = docs.select("text").mapInArrow(run, "cls long, grams binary").join(wanted, "cls", "left_semi")
    sets = scratch.write(sets.groupBy("cls").agg(F.first("grams").alias("grams")), "grams")

    def check(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(y) < len(x):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                ok.append(den * both >= num * (len(x) + len(y) - both))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    both = (
        pairs.select("a", "b").join(sets.select(F.col("cls").alias("a"), F.col("grams").alias("x")), "a")
        .join(sets.select(F.col("cls").alias("b"), F.col("grams").alias("y")), "b").select("a", "b", "x", "y")
    )
    links = scratch.write(both.mapInArrow(check, "a long, b long"), "links")
    scratch.drop(sets, pairs)
    return links


def ngram_components(docs: DataFrame, scratch: Scratch, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, cls, component_id: one row per row of docs."""
    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sets, counts = _sets(body, scratch, k)
    columns = scratch.write(_columns(_prefix(body, counts, k, num, den)), "columns")
    scratch.settle()
    size = columns.groupBy("gram").agg(F.count(F.lit(1)).alias("m"))
    weight = columns.join(size, "gram").groupBy("cls").agg(F.sum("m").alias("w"))
    weighted = scratch.write(columns.join(weight, "cls"), "weighted")
    # What the bound discards here for want of counts in other columns, the exact round takes up again.
    likely = _bounded(_hub_pairs(_open(weighted, None), 1, num, den), num, den)
    links = _verified(body, likely, scratch, k, num, den).select("a", "b")
    labels = connected_components(links, scratch)
    scratch.settle()
    entries = scratch.write(_open(columns, labels), "open")
    cross = scratch.write(_cross_pairs(entries, num, den), "cross")
    scratch.settle()
    rest = _bounded(_counted(cross, columns), num, den)
    links = links.unionByName(_verified(body, rest, scratch, k, num, den).select("a", "b"))
    labels = connected_components(links, scratch)
    scratch.drop(weighted, entries, cross)
    scratch.drop(columns)
    # Copies are counted before they meet, so that what many rows share is joined back without gathering it.
    classes = sets.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    classes = scratch.write(classes.join(labels.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls")), "classes")
    lows = scratch.write(classes.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("members")).where("members > 1"), "lows")
    named = join_groups(classes, lows, "root", "members").select("cls", F.when(F.col("members").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"), "copies")
    back = join_groups(sets, scratch.write(named, "named"), "cls", "copies")
    return back.select("doc_id", F.col("n").alias("n_shingles"), "cls", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, scratch: Scratch, **kw) -> DataFrame:
    """Rows of docs with one document of each component: the one with the smallest id. Rows that share a doc_id stay or go together."""
    got = ngram_components(docs, scratch, **kw)
    x = hidden(docs) + "id"
    keep = got.where("doc_id <=> component_id").select(F.col("doc_id").alias(x)).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep[x]), "left_semi")
