"""Packing, mixing, tool calls, search, classifiers and the pipeline."""

import json
import random
import zlib

import numpy as np
import pytest
from shared import SF
from llm_helpers import docs_of, odd_docs
from pyspark.sql import functions as F

from wayforge.llm import mixing, multi_index, packing, quality, tool_calls, toxicity
from wayforge.llm.queries import QUERIES, vocabulary

BPE = "word_bpe_49k.json"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# packing


def check_layout(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_are_those_of_the_tokenizer(spark, scratch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(BPE))
    odd = ["It's a.b, c... d,, e.\n\nF. <|endoftext|> x", "ÀÉ, ñandú. ÷. éx. 日本,語.", "don't, we'll. I'VE!", "a b, c. İSTANBUL ß", "", None, "x" * 9000, "1,2. 3.4, v2.", "<|ENDOFTEXT|> a <|EndOfText|> b.", "A <|endoftext|>b, <|STARTOFTEXT|>", "tab\tand\x0bvt\x1cfs\x85nel"]
    texts = odd + [r["text"] for r in documents(spark).limit(60).collect()]
    got = {}
    for r in packing.pieces(docs_of(spark, texts), vocabulary(BPE), capacity=64, with_ids=True).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        parts = sorted(got[i], key=lambda r: r["piece"])
        assert [x for p in parts for x in p["input_ids"]] == ids
        for p in parts:
            assert p["ids_crc32"] == zlib.crc32(np.array(p["input_ids"], "<u4").tobytes()) and p["start"] == 64 * p["piece"] and p["length"] == len(p["input_ids"])


def brute_search(hist, cap):
    """Sequences after the same kinds of exchange, on single bins, each tried against each."""
    bins = [[x] for x, n in hist.items() for _ in range(n)]
    fill = lambda b: sum(b)
    again = True
    while again:
        again = False
        bins.sort(key=fill)
        for d in bins:
            for t in reversed(bins):
                if t is d or fill(t) == cap:
                    continue
                gives = [[x] for x in d] + [[x, y] for i, x in enumerate(d) for y in d[i + 1 :]]
                backs = [[], *([x] for x in t), *([x, y] for i, x in enumerate(t) for y in t[i + 1 :])]
                good = [(g, b) for g in gives for b in backs if len(g) + len(b) <= 3 and 0 < sum(g) - sum(b) <= cap - fill(t) and fill(t) + sum(g) - sum(b) > fill(d)]
                if good:
                    g, b = max(good, key=lambda m: sum(m[0]) - sum(m[1]))
                    for x in g:
                        d.remove(x)
                    for x in b:
                        t.remove(x)
                    d += b
                    t += g
                    again = True
                    break
            if again:
                break
        bins = [b for b in bins if b]
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_tight(seed):
    rng = random.Random(seed)
    cap = 100
    hist = {}
    for _ in range(120):
        x = rng.choice([rng.randrange(1, 101), rng.randrange(30, 55), 100])
        hist[x] = hist.get(x, 0) + 1
    rows = packing.plan(hist, cap)
    bins = packing.best_fit(hist, cap, packing.any_order)
    before, squares = sum(bins.count.values()), lambda: sum(n * (cap - bins.room(b)) ** 2 for b, n in bins.count.items())
    start = squares()
    steps = packing.local_search(bins)
    after = sum(bins.count.values())
    assert after <= before and (squares() > start) == (steps > 0) and sum((r[2] - r[1]) for r in rows) == sum(hist.values())
    assert after <= brute_search(hist, cap) + 1
    assert after <= -(-sum(x * n for x, n in hist.items()) // cap) * 1.05 + 1


def test_local_search_empties_bins():
    bins = packing.Bins(10)
    for items in (((6, 1), (3, 1)), ((5, 1), (4, 1)), ((1, 2),)):
        bins.add(items, 1)
    packing.local_search(bins)
    assert sum(bins.count.values()) == 2


def test_search_does_the_packing(spark):
    """On the lengths of documents the search makes steps, and no fewer sequences are possible."""
    n = {}
    for r in packing.pieces(spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet"), vocabulary(BPE)).groupBy("length").count().collect():
        n[r["length"]] = r["count"]
    bins = packing.best_fit(n, 4096, packing.any_order)
    assert packing.local_search(bins) > 0 and sum(bins.count.values()) == -(-sum(x * k for x, k in n.items()) // 4096)


def test_packing_layout_and_odd_rows(spark, scratch):
    rows = packing.pack_documents(documents(spark), scratch, vocabulary(BPE)).collect()
    n = check_layout(rows, 4096)
    assert n <= -(-sum(r["length"] for r in rows) // 4096) * 1.02 + 1
    odd = packing.pack_documents(odd_docs(spark), scratch, vocabulary(BPE)).collect()
    check_layout(odd, 4096)
    assert len({(r["doc_id"], r["piece"]) for r in odd if r["doc_id"] in (3, 4)}) == 2 and sum(r["doc_id"] == 1 for r in odd) == 2
    assert packing.pack_documents(odd_docs(spark).limit(0), scratch, vocabulary(BPE)).count() == 0


# mixing


def test_water_filling():
    assert mixing.water_fill([100, 100], [5, 2]) == pytest.approx([1000 / 7, 400 / 7])
    got = mixing.water_fill([10, 100, 100], [5, 2, 1])
    assert got[0] == 30 and sum(got) == pytest.approx(210) and got[1] == pytest.approx(2 * got[2])
    assert mixing.water_fill([], []) == [] and mixing.water_fill([0, 5], [5, 2]) == [0, 5]


def test_permutations_and_draws():
    n = np.full(1000, 1000)
    assert sorted(mixing.permute(np.arange(1000), n, np.full(1000, 3))) == list(range(1000))
    assert list(mixing.permute(np.array([0]), np.array([1]), np.array([9]))) == [0]
    plan = mixing.draw_plan([50, 7, 0, 200], 6, 1)
    assert [sum(p[3] for p in plan if p[1] == i) for i in range(4)] == [50, 7, 0, 200] and plan == mixing.draw_plan([50, 7, 0, 200], 6, 1)


def test_mixing_meets_targets_and_limits(spark, scratch):
    df = documents(spark)
    rows = mixing.taken_words(df, scratch).collect()
    src = {r["doc_id"]: r["source"] for r in df.collect()}
    total, taken = {}, {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        total[src[r["doc_id"]]] = r["target"]
        taken[src[r["doc_id"]]] = taken.get(src[r["doc_id"]], 0) + r["taken"]
    assert len(rows) == len(src) and sum(total.values()) == pytest.approx(sum(r["size"] for r in rows))
    assert all(abs(taken[s] - t) <= 0.05 * t + 128 for s, t in total.items())
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.taken_words(df, scratch).collect()), key=str)


def test_mixed_documents_have_the_taken_words(spark, scratch):
    df = docs_of(spark, [" ".join(f"d{i}w{k}" for k in range(40 + i)) for i in range(30)] + ["", None], ["a", "b", None][:1] * 10 + ["b"] * 10 + [None] * 12)
    want = {r["doc_id"]: r["taken"] for r in mixing.taken_words(df, scratch, block_words=16).collect()}
    got = {}
    for r in mixing.mixed_documents(df, scratch, block_words=16).collect():
        w = r["text"].split()
        assert all(x.startswith(f"d{r['doc_id']}w") for x in w) and r["n_chars"] == len(r["text"]) and len(set(w)) == len(w)
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(w)
    assert got == {k: v for k, v in want.items() if v}


def test_mixing_odd_rows(spark, scratch):
    assert mixing.taken_words(odd_docs(spark), scratch).count() == 10
    assert mixing.taken_words(odd_docs(spark).limit(0), scratch).count() == 0
    assert mixing.mixed_documents(odd_docs(spark), scratch).columns == odd_docs(spark).columns


# tool calls

CALLS = "conv_id long, call_id string, seq long, name string, arguments string, after array<string>"
RESULTS = "conv_id long, call_id string, seq long, content string"
TOOLS = {"add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "array", "items": {"enum": ["x", "y"]}}}}}


def test_linking(spark, scratch):
    calls = spark.createDataFrame([
        (1, "p", 1, "add", '{"b":["x"],"a":1}', ["q"]), (1, "q", 2, "add", '{"a":-1,"z":0}', []), (1, "q", 3, "add", '{"a":1}', []), (1, "r", 4, "nope", "{", ["gone"]),
        (2, "p", 1, "add", '{"a":"é"}', ["s"]), (2, "s", 2, "add", '{"a":2,"b":["n"]}', ["p"]), (2, "t", 3, "add", '{"a":3.0}', []), (None, None, 1, None, None, None),
    ], CALLS)
    results = spark.createDataFrame([(1, "p", 5, "late"), (1, "p", 4, "first"), (1, "zz", 6, "lost"), (2, "s", 9, None)], RESULTS)
    rows = tool_calls.link(calls, results, TOOLS, scratch).collect()
    got = {(r["conv_id"], r["call_id"], r["seq"]): r for r in rows}
    assert got[1, "p", 1]["level"] == 1 and got[2, "p", 1]["level"] is None and got[1, "q", 2]["level"] == 0 and got[1, "p", 1]["n_results"] == 2
    assert json.loads(got[1, "p", 1]["json"])["result"] == "first" and got[1, "p", 1]["json"].startswith('{"call":{"arguments":{"a":1,"b":["x"]},"id":"p"')
    assert got[1, "q", 2]["errors"] == "a: below minimum; z: unknown" and got[1, "q", 3]["errors"] == "identifier used before"
    assert got[1, "r", 4]["errors"] == "arguments: not JSON; unknown dependency; unknown tool"
    assert got[2, "p", 1]["errors"] == "a: not integer; cyclic dependency" and got[2, "s", 2]["errors"] == "b[0]: not in enum; cyclic dependency" and got[2, "t", 3]["valid"]
    assert got[1, "zz", 6]["kind"] == "orphan" and "no id" in got[None, None, 1]["errors"] and len(rows) == 9
    lines = {r["conv_id"]: r["calls"].split("\n") for r in tool_calls.conversation_json(tool_calls.link(calls, results, TOOLS, scratch)).collect()}
    assert [json.loads(x)["call"]["id"] for x in lines[1]] == ["q", "q", "r", "p"]
    assert tool_calls.link(calls.limit(0), results.limit(0), TOOLS, scratch).count() == 0


@pytest.mark.parametrize("group", [2, 1000])
def test_levels_against_brute_force(spark, scratch, monkeypatch, group):
    """Random dependencies in either direction, cycles too; by groups and by rounds."""
    rng, edges = random.Random(6), set()
    for conv in range(6):
        edges |= {(conv, f"c{a}", f"c{b}") for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(4 + 2 * conv))}
    edges |= {(9, f"c{i}", f"c{i - 1}") for i in range(1, 8)}

    def depth(conv, call, path=()):
        if call in path:
            return None
        below = [depth(conv, d, (*path, call)) for c, a, d in edges if (c, a) == (conv, call)]
        return None if None in below else max(below, default=-1) + 1

    df = spark.createDataFrame(sorted(edges), "conv_id long, call_id string, dep string")
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in tool_calls.levels(df, scratch, group).collect()}
    assert got == {(c, a): depth(c, a) for c, a, _ in edges}
    assert got[9, "c7"] == 7 and None in got.values()


def test_arguments_that_are_no_json(spark, scratch):
    odd = ['{"a":1e999}', '{"a":NaN}', '{"a":-Infinity}', '{"a":"\\ud800"}', "[" * 100_000, '{"a":' * 50_000, "1" * 6000, "", "nul", None, '{"a":1}x', '{"a":1,"b":["\\ud83d\\ude00"]}', '{"a":1.5}', '{"a":true}']
    calls = spark.createDataFrame([(1, f"c{i}", i, "add", x, None) for i, x in enumerate(odd)], CALLS)
    rows = {r["seq"]: r for r in tool_calls.link(calls, spark.createDataFrame([], RESULTS), {"add": {"type": ["object", "null"], "properties": {"a": {"type": "number"}}}}, scratch).collect()}
    assert all(rows[i]["errors"] == "arguments: not JSON" and json.loads(rows[i]["json"])["call"]["arguments"] is None for i in range(11))
    assert rows[11]["valid"] and json.loads(rows[11]["json"])["call"]["arguments"] == {"a": 1, "b": ["😀"]} and rows[12]["valid"] and rows[13]["errors"] == "a: not number"
    assert all(r["level"] == 0 for r in rows.values())


def test_canonical_json():
    assert tool_calls.canonical({"b": [1, 2.5, None, True], "a": 'é"\n'}) == '{"a":"é\\"\\n","b":[1,2.5,null,true]}'
    with pytest.raises(ValueError):
        tool_calls.canonical(float("nan"))


# search


def test_search_recall_and_scores(spark, scratch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(np.float32).astype(float)
    got = {}
    for r in multi_index.search(df, scratch).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit = total = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        best = [j for j in np.lexsort((np.arange(3000), -s)) if j != q][:20]
        mine = [got[q][k] for k in range(1, 21)]
        hit += len({v for v, _ in mine} & set(best))
        total += 20
        assert all(abs(sc - s[v]) < 1e-9 for v, sc in mine) and [m[1] for m in mine] == sorted((m[1] for m in mine), reverse=True)
    assert hit / total >= 0.9


@pytest.mark.parametrize("block", [50, 20_000])
def test_equal_vectors_tie_across_blocks(spark, scratch, monkeypatch, block):
    """Scores depend on the two vectors alone, and ties go to smaller ids, in whatever blocks the vectors stand."""
    monkeypatch.setattr(multi_index, "BLOCK", block)
    monkeypatch.setattr(multi_index, "QUERIES", 7)
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(150, 64)), 4, axis=0)[rng.permutation(600)]
    df = spark.createDataFrame([(i, [float(v) for v in r], "clash") for i, r in enumerate(x)], "vec_id long, embedding array<double>, row string")
    got, vec = {}, {i: tuple(r) for i, r in enumerate(x)}
    for r in multi_index.search(df, scratch, recall=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q, rows in got.items():
        rows.sort()
        same = {}
        for _, v, s in rows:
            same.setdefault(vec[v], []).append((s, v))
        assert all(len({s for s, _ in e}) == 1 and [v for _, v in e] == sorted(v for _, v in e) for e in same.values())
        exact = sorted((-float(np.cumsum(x[q] * x[j])[-1]), j) for j in range(600) if j != q)[:20]
        hit += len({v for _, v, _ in rows} & {j for _, j in exact})
    assert len(got) == 30 and hit >= 0.95 * 600


def test_recall_on_embeddings(spark, scratch):
    df = spark.read.parquet(SF.replace("sf0.001", "sf0.1") + "/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect() if r["embedding"])
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = {}
    for r in multi_index.search(df, scratch).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in got:
        s = x @ x[np.searchsorted(ids, q)]
        s[ids == q] = -np.inf
        hit += len(got[q] & set(ids[np.argsort(-s)[:20]]))
    assert len(got) == sum(i % 20 == 0 for i in ids) and hit >= 0.9 * 20 * len(got)


def test_search_odd_vectors(spark, scratch):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(60)] + [(100, None), (120, [0.0, 0.0]), (140, [nan, 1.0]), (160, [inf, 1.0]), (180, [None, 1.0]), (200, [1.0]), (None, [1.0, 1.0]), (220, [3.0, 2.0]), (220, [3.0, 2.0])]
    got = {}
    for r in multi_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scratch).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert set(got) == {0, 20, 40, 220}
    assert [v for _, v in sorted(got[0])] == [220, *range(1, 20)] or [v for _, v in sorted(got[0])][:2] == [220, 220]
    few = multi_index.search(spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>"), scratch).collect()
    assert [(r["query_id"], r["vec_id"]) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1), (0, 2), (0, 3), (0, 4)]
    assert multi_index.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), scratch).count() == 0


# classifiers


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.97), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, module, label, least):
    sf = SF.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = module.score(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", label).collect()
    assert sum(r["predicted"] == r[label] for r in got) / len(got) >= least and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["predicted"] for r in got if r[label] == 0) <= 0.03 * len(got)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_on_odd_rows(spark, module):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert module.score(odd_docs(spark), labels).count() == 10
    assert module.score(odd_docs(spark).limit(0), labels).count() == 0
    assert all(0 <= r["score"] <= 1 for r in module.score(odd_docs(spark), labels.limit(0)).collect())


def test_labels_of_held_out_rows_do_not_matter(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.score(documents(spark), x).collect())) for x in (labels, turned))
    assert a == b


def test_factorisation_machine_learns_a_pair():
    rng = np.random.default_rng(0)
    bags, y = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        bags.append(np.array(sorted({10 * a + 0, 11 * b, 5, int(rng.integers(100, 300))} - {0}), np.int32))
        y.append(float(a and b))
    m = toxicity.fit(bags, np.array(y), np.ones(len(y)))
    assert toxicity.predict(m, np.array([5, 10, 11])) > 0.7 > 0.3 > max(toxicity.predict(m, np.array([5, 10])), toxicity.predict(m, np.array([5, 11])))


def test_non_negative_risk_finds_the_prior():
    rng = np.random.default_rng(2)
    pos, neg = rng.normal(2, 1, (1500, 3)), rng.normal(-2, 1, (450, 3))
    m = quality.fit(pos[:700], np.concatenate([pos[700:], neg]))
    assert abs(m["prior"] - 800 / 1250) < 0.12
    assert (quality.predict(m, pos) > 0.5).mean() > 0.95 and (quality.predict(m, neg) > 0.5).mean() < 0.05


# pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from test_text_operators import brute_components

    docs, sizes = documents(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes[name] = docs.count()
        if name != "pack":
            assert docs.columns == before.columns
        if name == "exact":
            texts = before.select("doc_id", "text").collect()
            best = {}
            for r in texts:
                best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
            assert {r["doc_id"] for r in docs.collect()} == set(best.values())
        if name == "near":
            rows = before.select("doc_id", "text").orderBy("doc_id").collect()
            want, _ = brute_components([r["text"] for r in rows], 5, 80, 100)
            assert {r["doc_id"] for r in docs.collect()} == {rows[i]["doc_id"] for i in set(want)}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "quality")).collect()}
    assert sum(i in kept for i, x in labels.items() if x) >= 0.9 * sum(labels.values())
    assert corpus_pipeline.run(spark, SF).count() == sizes["pack"]


def test_last_stages_rebuild_their_input(spark, tmp_path):
    """What mix takes are whole runs of words of its input, and pack's ids are those of the tokenizer, in gapless sequences."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = documents(spark).limit(60)
    mixed = corpus_pipeline.mix_stage(spark, docs, SF)
    mixed.write.parquet(str(tmp_path / "mix"))
    mixed = spark.read.parquet(str(tmp_path / "mix"))
    have = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    texts = {}
    for r in mixed.collect():
        w = r["text"].split()
        left = iter(have[r["doc_id"]])
        assert w and all(x in left for x in w)  # in order
        texts.setdefault(r["doc_id"], []).append(r["text"])
    rows = corpus_pipeline.pack_stage(spark, mixed, SF).collect()
    check_layout(rows, 4096)
    t, ids = Tokenizer.from_file(vocabulary(BPE)), {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        ids.setdefault((r["doc_id"], r["row"]), []).extend(r["input_ids"])
    got = sorted((d, x) for (d, _), x in ids.items())
    assert got == sorted((d, [*t.encode(x, add_special_tokens=False).ids, 1]) for d, many in texts.items() for x in many)


def test_stages_on_odd_and_empty_input(spark):
    import corpus_pipeline

    odd = odd_docs(spark)
    for c in ("passes", "__key", "__words", "root", "row", "keep"):
        odd = odd.withColumn(c, F.lit("x"))
    for df in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            assert name == "pack" or out.columns == df.columns
            n = out.count()
            assert n == 0 if df is not odd else n > 0 or name == "quality"


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_missing_subpackage_leaves_the_rest(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{root}/wayforge", tmp_path / "wayforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; print(len(q))"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, check=True).stdout.strip()
