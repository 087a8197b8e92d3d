"""Exact dedup, near duplicates, lines, language model: brute-force versions and odd inputs."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from shared import SF
from llm_helpers import docs_of, odd_docs

from wayforge.llm import exact_dedup, lattice_lm, line_dedup, ngram_join, words
from wayforge.llm.components import connected_components
from wayforge.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in t)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def union_find(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# exact dedup


def test_chunks_join_to_the_text(spark):
    df = odd_docs(spark).union(documents(spark).limit(50))
    from pyspark.sql import functions as F

    back = df.where("text is not null").select("text", F.array_join(exact_dedup.chunks(F.col("text"), 20, 60), "").alias("t"))
    assert back.where("t <> text").count() == 0


def test_exact_dedup_of_odd_rows(spark, scratch):
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup_exact(odd_docs(spark), scratch).collect()), key=str)
    assert (1, 2, 3, False) in got and (2, 2, 3, True) in got and (3, 4, 2, False) in got and (4, 4, 2, True) in got and (None, None, 1, True) in got
    assert len(got) == 10 and sum(g[3] for g in got) == 7
    assert exact_dedup.dedup_exact(odd_docs(spark).limit(0), scratch).count() == 0


def test_colliding_digests_are_told_apart(spark, scratch):
    store = spark.createDataFrame([("d", "one"), ("d", "two"), ("e", "three")], "digest string, chunk string")
    assert {(r["chunk"], r["number"]) for r in exact_dedup.colliding(store).collect()} == {("one", 1), ("two", 2)}


def test_keep_unique_keeps_columns(spark, scratch):
    df = odd_docs(spark).withColumnRenamed("lang", "kept")
    got = exact_dedup.keep_unique(df, scratch)
    assert got.columns == df.columns and got.count() == 7


# n-gram join


def brute_components(texts, k, num, den):
    sets = []
    for t in texts:
        w = WORD.findall(low(t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    return union_find(len(texts), links), [len(s) for s in sets]


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_ngram_components_against_brute_force(spark, scratch, k, num):
    rows = documents(spark).select("doc_id", "text").orderBy("doc_id").collect()
    want, sizes = brute_components([r["text"] for r in rows], k, num, 100)
    got = {r["doc_id"]: r for r in ngram_join.ngram_components(documents(spark), scratch, k=k, num=num).collect()}
    for i, r in enumerate(rows):
        assert got[r["doc_id"]]["component_id"] == rows[want[i]]["doc_id"] and got[r["doc_id"]]["n_shingles"] == sizes[i]


def test_group_of_near_copies_and_threshold_ties(spark, scratch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    shared = " ".join(f"p{i}" for i in range(50))
    texts += [shared + " " + " ".join(f"q{k}-{i}" for i in range(60)) for k in range(30)]
    texts += [" ".join(f"t{i}" for i in range(20)), " ".join(f"t{i}" for i in range(23)), "A b C", "a B c", "", None]
    want, _ = brute_components(texts, 4, 85, 100)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(docs_of(spark, texts), scratch, k=4, num=85).collect()}
    assert got == dict(enumerate(want))
    assert len({got[i] for i in range(40)}) < 30 and len({got[i] for i in range(40, 70)}) == 30


def test_ngram_odd_rows(spark, scratch):
    rows = ngram_join.ngram_components(odd_docs(spark), scratch).collect()
    assert len(rows) == 10 and {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert [r["n_shingles"] for r in rows if r["doc_id"] in (3, 4, 5)] == [0, 0, 0]
    assert ngram_join.ngram_components(odd_docs(spark).limit(0), scratch).count() == 0
    kept = ngram_join.keep_one(odd_docs(spark), scratch)
    assert kept.columns == odd_docs(spark).columns


def test_hashes_do_not_depend_on_windows(monkeypatch):
    raw = " ".join(f"word{i}" for i in range(5000)).encode() + b" " + b"z" * 3000
    whole = words.text_shingles(raw, 4)
    monkeypatch.setattr(words, "WINDOW", 997)
    data = np.frombuffer(raw, np.uint8)
    s, e = words.spans(data)
    small = words.hash_spans(data, s[:-1], e[:-1])
    monkeypatch.undo()
    assert (small == words.hash_spans(data, s[:-1], e[:-1])).all() and len(whole) == 5001 - 3


def test_components(spark, scratch):
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    want = union_find(200, links)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    assert got == {i: want[i] for i in range(200) if want[i] != i}


# lines


def brute_lines(texts):
    lines = [(i, k, ln) for i, t in enumerate(texts) for k, ln in enumerate(t.split("\n")) if ln.strip(" ")]
    different = sorted({ln for *_, ln in lines})
    sets = [{ln[j : j + 5] for j in range(len(ln) - 4)} if len(ln) > 5 else {ln} for ln in different]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    root = union_find(len(different), links)
    at = {ln: root[i] for i, ln in enumerate(different)}
    first = {}
    for i, k, ln in lines:
        first.setdefault(at[ln], (i, k))
    return {(i, k): first[at[ln]] for i, k, ln in lines}, len(links)


def test_lines_against_brute_force(spark, scratch):
    rng = random.Random(8)
    texts = []
    for i in range(60):
        long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(40))
        short = "".join(rng.choice("abcdefgh ") for _ in range(60)).strip()
        texts += [f"{long}\n{short}\n\nfooter line of the site", f"{long} more\n{short[:30]}X{short[31:]}\n{i}"]
    want, n = brute_lines(texts)
    got = {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"]) for r in line_dedup.dedup_lines(docs_of(spark, texts), scratch).collect()}
    wrong = [k for k in want if got[k] != want[k]]
    assert n >= 90 and len(wrong) <= 0.02 * n


def test_template_lines_against_brute_force(spark, scratch):
    """Lines that share a long opening meet in the same buckets; similar ones there are mostly not neighbours."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    opening, texts = word(80), []
    for _ in range(300):
        end = word(16)
        texts += [opening + end, opening + end[:-2] + word(2)]
    rng.shuffle(texts)
    want, n = brute_lines(texts)
    got = {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"]) for r in line_dedup.dedup_lines(docs_of(spark, texts), scratch).collect()}
    assert n >= 250 and len([k for k in want if got[k] != want[k]]) <= 0.01 * n


def all_links(lines):
    """All pairs at 0.8 or more, by counts of shared shingles over an inverted index; no candidates are left out."""
    sets = [{ln[j : j + 5] for j in range(len(ln) - 4)} if len(ln) > 5 else {ln} for ln in lines]
    links: list = []
    having: dict = {}
    for i, s in enumerate(sets):
        if i:
            found = [having[g] for g in s if g in having]
            if found:
                other, shared = np.unique(np.concatenate([np.array(x) for x in found]), return_counts=True)
                links += [(i, int(j)) for j, n in zip(other, shared, strict=True) if 10 * n >= 8 * (len(s) + len(sets[j]) - n)]
        for g in s:
            having.setdefault(g, []).append(i)
    return links


def test_lines_of_documents_against_all_pairs(spark, scratch):
    """Every link of an all-pairs join over the lines of documents is found: the components are the same."""
    df = spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet")
    lines = [(r["doc_id"], k, ln) for r in df.select("doc_id", "text").orderBy("doc_id").collect() for k, ln in enumerate((r["text"] or "").split("\n")) if ln.strip(" ")]
    different = sorted({ln for *_, ln in lines})
    links = all_links(different)
    root = union_find(len(different), links)
    at, first = {ln: root[i] for i, ln in enumerate(different)}, {}
    for i, k, ln in lines:
        first.setdefault(at[ln], (i, k))
    got = {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"]) for r in line_dedup.dedup_lines(df, scratch).collect()}
    assert len(links) > 200 and [x for x in lines if got[x[:2]] != first[at[x[2]]]] == []


def test_repeated_rows_keep_one_line(spark, scratch):
    df = docs_of(spark, ["one line here\n\nand a second line", "and a second line"]).withColumn("root", F.lit(1)).withColumn("line_id", F.lit("x"))
    rows = line_dedup.dedup_lines(df.union(df), scratch).collect()
    assert len(rows) == 8 and sum(r["kept"] for r in rows) == 4
    assert sorted((r["doc_id"], r["line_no"]) for r in rows if r["kept"]) == [(0, 0), (0, 1), (0, 1), (0, 2)]


def test_large_buckets_and_hot_lines(spark, scratch, monkeypatch):
    """Small limits send buckets through two bands and blocks; a line that most rows share is joined by broadcast."""
    monkeypatch.setattr(line_dedup, "LARGE", 4)
    monkeypatch.setattr(line_dedup, "BLOCK", 3)
    rng = random.Random(4)
    opening = "".join(rng.choice("abcdefgh") for _ in range(60))
    texts = []
    for _ in range(60):
        end = "".join(rng.choice("ijklmnop") for _ in range(14))
        texts += [opening + end + "\nthe same footer on each page", opening + end[:-1] + "z"]
    want, n = brute_lines(texts)
    got = {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"]) for r in line_dedup.dedup_lines(docs_of(spark, texts), scratch).collect()}
    assert n >= 60 and len([k for k in want if got[k] != want[k]]) <= 0.02 * n


def test_pairs_that_share_one_large_bucket_only(spark, scratch, monkeypatch):
    """With one bucket of all lines, and that large, every pair of it is tested still."""
    def one(signed, scratch):
        rows = signed.select("line_id").agg(F.min("line_id").alias("low"), F.count(F.lit(1)).alias("n"))
        return scratch.write(signed.select("line_id", F.lit(7).cast("long").alias("band")).crossJoin(rows), "near")

    monkeypatch.setattr(line_dedup, "buckets", one)
    monkeypatch.setattr(line_dedup, "LARGE", 4)
    monkeypatch.setattr(line_dedup, "BLOCK", 3)
    rng = random.Random(6)
    texts = []
    for _ in range(12):
        line = "".join(rng.choice("abcdefgh") for _ in range(70))
        texts += [line, line[:-2] + "zz"]
    want, n = brute_lines(texts)
    got = {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"]) for r in line_dedup.dedup_lines(docs_of(spark, texts), scratch).collect()}
    assert n == 12 and got == want


def test_sketches_never_exceed_the_difference(spark):
    """Copies changed each in its own way: sketches differ in no more bits than the sets do, and tell most that are apart."""
    rng = random.Random(9)
    first = [rng.choice("abcdefghijklmnop") for _ in range(300)]
    lines = ["".join(rng.choice("qrstuvwxyz") if rng.random() < 0.02 * (i % 3) else c for c in first) for i in range(24)]
    rows = line_dedup.sketches(spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")).collect()
    of, sets = {r["line_id"]: r for r in rows}, [{ln[i : i + 5] for i in range(len(ln) - 4)} for ln in lines]
    assert [of[i]["size"] for i in range(24)] == [len(s) for s in sets]
    far = told = 0
    for a in range(24):
        for b in range(a):
            bits = sum(((of[a][o] ^ of[b][o]) & (2**64 - 1)).bit_count() for o in line_dedup.ODDS)
            assert bits <= len(sets[a] ^ sets[b])
            if len(sets[a] & sets[b]) < 0.6 * len(sets[a] | sets[b]):
                far, told = far + 1, told + (9 * bits > len(sets[a]) + len(sets[b]))
    assert far > 50 and told > 0.9 * far


def test_signatures_hash_each_shingle_without_sorting_texts(spark):
    """The hashes of wide lines tell shingles apart as the shingles themselves do (no half of a character beyond
    the first 65,536 is one), at every length around a chunk; copies of a line are signed as one."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    lines = ["".join(rng.choice("abß日😀 ") for _ in range(n)) for n in (1, 4, 5, 6, 19, 20, 21, 35, 36, 37, 300)]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    chunks = {}
    for r in line_dedup.chunked_hashes(df).collect():
        chunks.setdefault(r[0], set()).update(r[1:])
    of = {}
    for r in df.select("line_id", line_dedup.all_shingles(F.col("line")).alias("s"), line_dedup.shingle_hashes(F.col("line")).alias("h")).collect():
        ln = lines[r["line_id"]]
        assert r["s"] == [ln[i : i + 5] for i in range(max(1, len(ln) - 4))] and set(r["h"]) == chunks[r["line_id"]]
        assert all(of.setdefault(s, h) == h for s, h in zip(r["s"], r["h"], strict=True))
    assert len(set(of.values())) == len(of) > 300
    signed = line_dedup.signatures(df.union(df))
    assert signed.count() == len(lines) and "SortAggregate" not in signed._jdf.queryExecution().toString()


def test_long_lines_without_words(spark, scratch):
    """Tables of short words, text without white space, and rules of several lengths have candidates too."""
    rng = random.Random(12)
    table_, text = " ".join(str(rng.randrange(1000)) for _ in range(80)), "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(300))
    texts = [table_, table_[:100] + "#" + table_[101:], text, "\u4e01" + text[1:], "=" * 100, "=" * 150]
    short = " ".join(rng.choice(["a", "of", "to", "is", "it", "we", "no", "up", "my", "at"]) for _ in range(100))
    texts += [short, short[:130] + "q" + short[131:]]
    got = {r["doc_id"]: r["keep_doc_id"] for r in line_dedup.dedup_lines(docs_of(spark, texts), scratch).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 6}


def test_lines_odd_rows(spark, scratch):
    rows = line_dedup.dedup_lines(odd_docs(spark), scratch).collect()
    assert all(r["kept"] for r in rows if r["doc_id"] in (4, 5)) and not [r for r in rows if r["doc_id"] == 3]
    assert [r["keep_doc_id"] for r in rows if r["doc_id"] == 2] == [1]
    assert line_dedup.dedup_lines(odd_docs(spark).limit(0), scratch).count() == 0


def test_shingles_with_the_mark_itself(spark):
    from pyspark.sql import functions as F

    rows = [("abcdefg",), ("ab\u0001cdefg",), ("abcde",), ("日本語テキスト",)]
    got = [list(r["s"]) for r in spark.createDataFrame(rows, "t string").select(line_dedup.all_shingles(F.col("t")).alias("s")).collect()]
    assert got == [[t[i : i + 5] for i in range(max(1, len(t) - 4))] for (t,) in rows]


# language model


def pieces_by_text():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    return {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not sp.is_byte(i) and not sp.is_control(i) and not sp.is_unknown(i)}


def brute_edges(v, score, t, ids):
    """(from, to, pieces, probability) of all edges of a word with its mark."""
    n = len(t)
    out = [(i, i + 1, [v.byte[b] for b in t[i].encode()]) for i in range(n)]
    out += [(i, j, [ids[t[i:j]]]) for i in range(n) for j in range(i + 1, min(n, i + v.longest) + 1) if t[i:j] in ids]
    return [(i, j, p, math.exp(sum(score[x] for x in p))) for i, j, p in out]


def brute_marginal(v, score, word, ids=None):
    t = "▁" + word
    a = [1.0] + [0.0] * len(t)
    for i, j, _, p in sorted(brute_edges(v, score, t, ids or pieces_by_text()), key=lambda e: e[0]):
        a[j] += a[i] * p
    return math.log(a[-1])


def brute_expected(v, score, word, ids):
    """Expected pieces, by listing every segmentation."""
    t = "▁" + word
    by, total, out = {}, 0.0, Counter()
    for e in brute_edges(v, score, t, ids):
        by.setdefault(e[0], []).append(e)

    def walk(at, p, used):
        nonlocal total
        if at == len(t):
            total += p
            for x in used:
                out[x] += p
        for _, j, pieces, q in by.get(at, ()):
            walk(j, p * q, used + pieces)

    walk(0, 1.0, [])
    return {x: n / total for x, n in out.items()}


def test_lattice_marginals_and_expectations():
    v = lattice_lm.pieces_of(vocabulary("piece_bpe_32k.model"))
    text = ["the", "internation", "é", "", "日x", "a" * 25]
    lat = lattice_lm.Lattice(v, text)
    got = lat.marginals(v, v.start)
    assert got == pytest.approx([brute_marginal(v, v.start, w) for w in text])
    assert lat.sweep(v, v.start, back=True)[lat.node0] == pytest.approx(got)
    ids = pieces_by_text()
    for w in ("the", "é", "nation"):
        want, found = brute_expected(v, v.start, w, ids), lattice_lm.Lattice(v, [w]).expected(v, v.start, np.array([2.0]))
        assert {x: found[x] for x in np.flatnonzero(found)} == pytest.approx({x: 2 * n for x, n in want.items()})
    assert lattice_lm.Lattice(v, []).marginals(v, v.start).size == 0


def test_lm_counts_and_scores(spark, scratch):
    """Base columns by counting, and scores by a sum over all segmentations of each word, with pieces learned by the same rounds over all training words."""
    rows = documents(spark).select("doc_id", "text").collect()
    path = vocabulary("piece_bpe_32k.model")
    got = {r["doc_id"]: r for r in lattice_lm.score_documents(documents(spark), scratch, path).collect()}
    tokens = {r["doc_id"]: [*WORD.findall(low(r["text"])), None] for r in rows}
    counts = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    p, ends = lattice_lm.pieces_of(path), counts[None]
    trained = sorted((w for w in counts if w is not None), key=len)
    score = p.start
    for _ in range(2):
        found = np.zeros(p.size)
        for i, j in lattice_lm.batches_of(trained):
            found += lattice_lm.Lattice(p, trained[i:j]).expected(p, score, np.array([counts[w] for w in trained[i:j]], float))
        score = lattice_lm._shares(p, dict(enumerate(found)), ends)
    ids = pieces_by_text()
    marginal = {w: brute_marginal(p, score, w, ids) / math.log(10) for w in {w for i, t in tokens.items() if i % 5 == 0 for w in t if w}}
    for i, t in tokens.items():
        if i % 5 == 0:
            assert got[i]["score"] == pytest.approx(sum(marginal[w] for w in t if w is not None) + score[p.end] / math.log(10))
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2) and got[i]["score"] < 0


def test_lm_odd_rows(spark, scratch):
    rows = {r["doc_id"]: r for r in lattice_lm.score_documents(odd_docs(spark), scratch, vocabulary("piece_bpe_32k.model"), rounds=1).collect()}
    assert rows[3]["n_tokens"] == rows[4]["n_tokens"] == rows[5]["n_tokens"] == 1 and rows[6]["n_tokens"] == 30_001 and math.isfinite(rows[8]["score"])
    assert lattice_lm.score_documents(odd_docs(spark).limit(0), scratch, vocabulary("piece_bpe_32k.model")).count() == 0


def test_columns_stream(spark):
    """Entries of shared n-grams, whatever batches they come in."""
    rng = random.Random(9)
    rows = [(rng.randrange(40), rng.randrange(6), 5, rng.randrange(3)) for _ in range(150)]
    df = spark.createDataFrame(rows, "gram long, cls long, n int, pos int")
    having = {}
    for g, c, *_ in rows:
        having.setdefault(g, set()).add(c)
    want = sorted((g, c) for g, cs in having.items() if len(cs) > 1 for c in cs)
    for size in ("1", "2", "7", "1000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert sorted((r["gram"], r["cls"]) for r in ngram_join._columns(df).collect()) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def test_ids_of_any_plain_type(spark, scratch):
    df = docs_of(spark, ["one two three four five six", "one two three four five six", "x"]).withColumn("doc_id", F.col("doc_id").cast("smallint"))
    assert sorted(r["component_id"] for r in ngram_join.ngram_components(df, scratch).collect()) == [0, 0, 2]
    assert lattice_lm.score_documents(df, scratch, vocabulary("piece_bpe_32k.model"), rounds=0).count() == 3
