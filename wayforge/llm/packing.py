"""Best-fit packing of token pieces into sequences of a fixed capacity, by swap-based local search.

Only the histogram of piece lengths (at most `capacity` numbers) reaches the driver: pieces of one
length are alike, so the packing works on classes of equal bins (a pattern of lengths and how many bins have it), and
their size depends on the capacity and not on the number of documents. It starts from best fit in an order that has
nothing to do with length, as if documents came as they come, and local search does the rest: the emptiest bins
move a document, exchange one for one, two for one or one for two with another underfull bin, wherever this raises the
sum of squared fills, tightest receiver first, until no sequence more could be saved or no exchange helps. The sum of
squares rises with each step, so it ends by itself; there is no limit on steps, bins or documents tried. If it
ends above the bound that the sum of lengths sets, the same search runs from best fit by decreasing length
too, and the packing with fewer sequences is taken. Pieces then find their place by their rank among the pieces of their length:
a task counts the pieces of each length as it cuts them, and those of the tasks before are added, so no length, however
frequent, has to meet in one task. Token ids are not moved to be ranked; they join their place by row.

Defined cases: a null text counts as empty and gives one piece that holds the end id only; an empty
table gives no rows; rows that repeat are separate documents; very long texts are cut into pieces
of `capacity` tokens, the last may be shorter; other columns are not read; ties between equal lengths go by the
order of rows in the table.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayforge.llm.common import Scratch, session_ready
from wayforge.llm.words import texts_of

CAPACITY, END_ID = 4096, 1
#: Bits of a row number within its task.
PART = 33
_TOKENIZERS: dict = {}
_KNOWN: dict = {}
#: Words whose ids a worker remembers at a time; a working set, not a limit on what is encoded.
REMEMBER = 800_000
#: A full stop or comma after a-z is a token of its own, so it is cut off before words are looked up.
TAIL = re.compile(rb"[.,](?<=[a-z][.,])(?=[ \n]|$)")


def batch_ids(vocabulary: str, raws: list[bytes]) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit. The vocabulary folds case, drops white space
    and joins nothing across it, so a text's ids are those of its words in order; a word is encoded
    when a worker meets it first, and words it has not met for long are forgotten. Added tokens are matched before case
is folded, so a text that may hold one is encoded as it stands."""
    if vocabulary not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(vocabulary)
        _TOKENIZERS[vocabulary] = t, [x.content.lower().encode() for x in t.get_added_tokens_decoder().values()]
    tokenizer, added = _TOKENIZERS[vocabulary]
    known, old = _KNOWN.get(vocabulary, ({}, {}))
    if len(known) > REMEMBER:
        known, old = {}, known
    _KNOWN[vocabulary] = known, old
    lows = [raw.lower() for raw in raws]
    special = {i for i, low in enumerate(lows) if any(x in low for x in added)}
    texts = [[] if i in special else TAIL.sub(rb" \g<0>", low).split() for i, low in enumerate(lows)]
    found = [list(map(known.get, words)) for words in texts]
    holes = [i for i, ids in enumerate(found) if None in ids]
    unmet = []
    for w in {w for i in holes for w, x in zip(texts[i], found[i], strict=True) if x is None}:
        if (x := old.get(w)) is None:
            unmet.append(w)
        else:
            known[w] = x
    for i in range(0, len(unmet), 10_000):
        part = unmet[i : i + 10_000]
        for w, e in zip(part, tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False), strict=True):
            known[w] = array("I", e.ids).tobytes()
    for i in holes:
        found[i] = [known[w] if x is None else x for w, x in zip(texts[i], found[i], strict=True)]
    for i in special:
        found[i] = [array("I", tokenizer.encode(raws[i].decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()]
    return [b"".join(ids) for ids in found]


def in_portions(raws, most: int = 2 << 20):
    """Texts in lists of about so many bytes."""
    part, size = [], 0
    for raw in raws:
        part.append(raw)
        size += len(raw)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, row, nth and, if asked for, input_ids of each piece of each text. row is the same for
    the pieces of one row of docs and differs between rows, so copies of a document can be told apart; its bits from PART on are the
    number of the task. nth counts the pieces of one length in one task, from 0."""
    session_ready(docs.sparkSession)
    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [body.schema["doc_id"].dataType.simpleString(), "int", "long", "long", "long", "long", "long"] + ["array<int>"] * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "row", "nth"] + ["input_ids"] * with_ids
    end, step = END_ID.to_bytes(4, "little"), 4 * capacity

    def run(batches):
        from pyspark import TaskContext

        before, met = TaskContext.get().partitionId() << PART, [0] * (capacity + 1)
        for b in batches:
            first = 0
            # A batch goes out for each portion of texts, so a worker holds the ids of one portion at a time.
            for part in in_portions(texts_of(b.column(1))):
                rows, cut = [], [[], [], [], [], [], []]
                for row, ids in enumerate(batch_ids(vocabulary, part), first):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), step)):
                        piece = ids[at : at + step]
                        n = len(piece) // 4
                        rows.append(row)
                        for c, v in zip(cut, (k, at // 4, n, zlib.crc32(piece), met[n], piece), strict=True):
                            c.append(v)
                        met[n] += 1
                first += len(part)
                longs = [*(pa.array(c, pa.int64()) for c in cut[1:4]), pa.array(np.array(rows, np.int64) + before), pa.array(cut[4], pa.int64())]
                cols = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(cut[0], pa.int32()), *longs]
                if with_ids:
                    flat = np.frombuffer(b"".join(cut[5]), "<i4")
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(cut[2])]).astype(np.int32)), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(cols, names=names)
            before += b.num_rows

    return body.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, fields, strict=True)))


class Bins:
    """Classes of equal bins: `items` (length -> how many in each bin), free room and how many bins."""

    def __init__(self, capacity: int):
        self.capacity, self.count, self.by_room = capacity, {}, {}
        self.rooms: list[int] = []

    def room(self, items: tuple) -> int:
        return self.capacity - sum(x * k for x, k in items)

    def add(self, items: tuple, n: int) -> None:
        if n and items:
            if items not in self.count:
                r = self.room(items)
                if r not in self.by_room:
                    insort(self.rooms, r)
                self.by_room.setdefault(r, {})[items] = None
            self.count[items] = self.count.get(items, 0) + n

    def take(self, items: tuple, n: int) -> None:
        self.count[items] -= n
        if not self.count[items]:
            r = self.room(items)
            del self.count[items], self.by_room[r][items]
            if not self.by_room[r]:
                del self.by_room[r]
                self.rooms.pop(bisect_left(self.rooms, r))


def _with(items: tuple, plus: tuple = (), minus: tuple = ()) -> tuple:
    d = dict(items)
    for x in plus:
        d[x] = d.get(x, 0) + 1
    for x in minus:
        d[x] -= 1
    return tuple(sorted(((x, k) for x, k in d.items() if k), reverse=True))


def any_order(x: int) -> int:
    """A fixed key that orders lengths without regard to size."""
    return (x * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64 >> 13


def best_fit(histogram: dict[int, int], capacity: int, key=None) -> Bins:
    """Best fit, whole classes of bins at a time; lengths in decreasing order, or by key."""
    bins = Bins(capacity)
    for x in sorted(histogram, key=key, reverse=key is None):
        left = histogram[x]
        while left:
            i = bisect_left(bins.rooms, x)
            if i == len(bins.rooms):
                k = capacity // x
                bins.add(((x, k),), left // k)
                if left % k:
                    bins.add(((x, left % k),), 1)
                break
            items = next(iter(bins.by_room[bins.rooms[i]]))
            k = bins.rooms[i] // x
            full = min(bins.count[items], left // k)
            if full:
                bins.take(items, full)
                bins.add(_with(items, (x,) * k), full)
                left -= full * k
            else:
                bins.take(items, 1)
                bins.add(_with(items, (x,) * left), 1)
                left = 0
    return bins


def _parts(items: tuple, most: int):
    """What a bin can give: nothing, each document, and each two if most is 2."""
    yield ()
    for i, (x, k) in enumerate(items):
        yield (x,)
        if most == 2:
            if k > 1:
                yield x, x
            for y, _ in items[i + 1 :]:
                yield x, y


class Receivers:
    """Underfull bins by the documents they can take in: the room once they have given something back.

    Slot k holds (bin, what it gives) with room + sum(given) = k, apart for at most one document given and for two; a
    mask of bits finds the next slot in use.
    """

    def __init__(self, capacity: int):
        self.slots = [[{} for _ in range(2 * capacity + 1)] for _ in range(2)]
        self.masks = [0, 0]

    def add(self, items: tuple, room: int) -> None:
        for g in _parts(items, 2) if room else ():
            two, k = len(g) == 2, room + sum(g)
            self.slots[two][k][items, g] = room
            self.masks[two] |= 1 << k

    def drop(self, items: tuple, room: int) -> None:
        for g in _parts(items, 2) if room else ():
            two, k = len(g) == 2, room + sum(g)
            del self.slots[two][k][items, g]
            if not self.slots[two][k]:
                self.masks[two] &= ~(1 << k)

    def tightest(self, offer: tuple, below: int, usable):
        """(room left, bin, given) of the receiver that offer fills most, with less room left than below; None without one."""
        size, best = sum(offer), None
        for two in range(1 if len(offer) == 2 else 2):
            k, mask = size, self.masks[two] >> size
            while mask:
                skip = (mask & -mask).bit_length() - 1
                k, mask = k + skip, mask >> skip
                if k - size >= below:
                    break
                # More comes in than goes out: what is left is less than the room there was.
                hit = next((e for e, room in self.slots[two][k].items() if room > k - size and usable(e[0])), None)
                if hit:
                    below, best = k - size, (k - size, *hit)
                    break
                k, mask = k + 1, mask >> 1
        return best


def local_search(bins: Bins) -> int:
    """Improve until the bound on sequences is met or no exchange helps. Returns the steps made."""
    total = sum(n * (bins.capacity - bins.room(b)) for b, n in bins.count.items())
    least, sequences, steps = -(-total // bins.capacity), sum(bins.count.values()), 0
    receivers = Receivers(bins.capacity)
    for b in bins.count:
        receivers.add(b, bins.room(b))
    while sequences > least:
        move = _improving(bins, receivers)
        if not move:
            break
        donor, offer, taker, back = move
        n = bins.count[donor] // 2 if taker == donor else min(bins.count[donor], bins.count[taker])
        for b in (donor, taker):
            bins.take(b, n)
            if b not in bins.count:
                receivers.drop(b, bins.room(b))
        for b in (_with(donor, back, offer), _with(taker, offer, back)):
            if b and b not in bins.count:
                receivers.add(b, bins.room(b))
            bins.add(b, n)
            sequences -= 0 if b else n
        steps += 1
    return steps


def _improving(bins: Bins, receivers: Receivers):
    """(donor, offer, taker, given back) of the emptiest bin that has an exchange which raises the sum of squared fills."""
    for room in reversed(bins.rooms):
        for donor in bins.by_room[room] if room else ():
            best, usable = None, lambda b, d=donor: b != d or bins.count[d] > 1
            # Squares rise where the receiver ends fuller than the donor began.
            below = room
            for offer in _parts(donor, 2):
                if offer and below and (found := receivers.tightest(offer, below, usable)):
                    below, best = found[0], (donor, offer, found[1], found[2])
            if best:
                return best
    return None


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, end rank, documents a bin, offset, first sequence), sorted."""
    bins = best_fit(histogram, capacity, any_order)
    local_search(bins)
    if sum(bins.count.values()) > -(-sum(x * n for x, n in histogram.items()) // capacity):
        other = best_fit(histogram, capacity)
        local_search(other)
        bins = min(bins, other, key=lambda b: sum(b.count.values()))
    used, rows, sequence = dict.fromkeys(histogram, 0), [], 0
    for items, n in bins.count.items():
        at = 0
        for x, k in items:
            rows.append((x, used[x], used[x] + n * k, k, at, sequence))
            used[x] += n * k
            at += x * k
        sequence += n
    if used != histogram:
        raise AssertionError("the plan has to place each piece once")
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut: a table of pieces, written out. Adds sequence_id and offset; nth goes."""
    spark = cut.sparkSession
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    table = spark.sparkContext.broadcast(plan(histogram, capacity))  # bounded by the capacity
    part = F.shiftright("row", PART).alias("__part")
    before = W.partitionBy("length").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row for each task
    base = cut.groupBy("length", part).count().select("length", "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    narrow = [c for c in cut.columns if c not in ("nth", "input_ids")]
    ranked = cut.select(*narrow, "nth", part).join(base, ["length", "__part"]).select(*narrow, (F.col("__base") + F.col("nth")).alias("__rank"))

    def place(batches):
        rows = table.value
        edge = rows[:, 0] * (1 << 40) + rows[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(zero_copy_only=False), b.column("__rank").to_numpy(zero_copy_only=False)
            r = rows[np.searchsorted(edge, length * (1 << 40) + rank, "right") - 1]
            j = rank - r[:, 1]
            cols = [b.column(c) for c in narrow] + [pa.array(r[:, 5] + j // r[:, 3]), pa.array(r[:, 4] + j % r[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[*narrow, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in narrow)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, scratch: Scratch, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    cut = scratch.write(pieces(docs, vocabulary, capacity, with_ids), "pieces")
    placed = pack(cut, capacity)
    return placed.join(scratch.again(cut).select("row", "piece", "input_ids"), ["row", "piece"]) if with_ids else placed
