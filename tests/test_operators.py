import random

import pytest
from pyspark.sql import functions as F

from wayforge.functions import geo, tags
from wayforge.operators import graph, matching, spatial

c = F.col


def test_greedy_rounds_equal_the_sequential_pass(spark):
    rng = random.Random(4)
    rows = list({(rng.randrange(12), rng.randrange(12)): (round(rng.random(), 1)) for _ in range(70)}.items())
    rows = [(i, 100 + j, s) for (i, j), s in rows]
    used, want = set(), set()
    for i, j, s in sorted(rows, key=lambda r: (-r[2], r[1], r[0])):
        if i not in used and j not in used:
            used |= {i, j}
            want.add((i, j))
    df = spark.createDataFrame(rows, "i long, j long, score double")
    assert {(r["i"], r["j"]) for r in matching.greedy(df).collect()} == want
    assert {(r["i"], r["j"]) for r in matching.greedy(df, one_sided=False).collect()} == want
    assert matching.greedy(df.limit(0)).count() == 0


def test_components_and_chains(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: min(m for m in range(60) if find(m) == find(n)) for e in edges for n in e}
    rows = [(1, 1, [(0.0, 0.0), (1.0, 0.0)]), (1, 2, [(2.0, 0.0), (1.0, 0.0)]), (1, 3, [(2.0, 0.0), (3.0, 0.0)]), (9, 9, [(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)])]
    m = graph.merge_chain(spark.createDataFrame(rows, "root long, way_id long, line array<struct<x:double,y:double>>"))
    got = {r["root"]: (list(r["way_ids"]), [p["x"] for p in r["line"]]) for r in m.collect()}
    assert got[1] == ([1, 2, 3], [0, 1, 2, 3]) and got[9][0] == [9]


def test_chain_links_follow_direction(spark):
    rows = [(1, 7, False, True), (2, 7, True, True), (3, 8, True, True), (4, 8, True, True), (5, 9, True, False), (6, 9, True, False), (7, 9, False, True)]
    ends = spark.createDataFrame(rows, "way_id long, node_id long, is_start boolean, oneway boolean")
    none = spark.createDataFrame([], "node_id long")
    assert {(r["a"], r["b"]) for r in graph.chain_links(ends, none).collect()} == {(1, 2), (5, 6)}


def test_loops(spark):
    square = [(1, 1, 2, 1.0), (2, 2, 3, 1.0), (3, 3, 4, 1.0), (4, 4, 1, 1.0), (5, 1, 1, 0.5), (6, 1, 2, 1.0)]
    df = spark.createDataFrame(square, "way_id long, a long, b long, cost double")
    got = {tuple(r["path"]) for r in graph.closed_loops(df, spark.createDataFrame([(1,)], "node long"), 4.0).collect()}
    assert (5,) in got and (1, 6) in got and (6, 1) in got and (1, 2, 3, 4) in got and (4, 3, 2, 1) in got and (6, 2, 3, 4) in got
    assert all(len(set(p)) == len(p) for p in got)


def test_reach_and_flood(spark):
    e = spark.createDataFrame([(1, 1, 2, 10.0), (2, 2, 3, 10.0), (3, 3, 4, 10.0), (4, 1, 3, 15.0)], "way_id long, a long, b long, cost double")
    both = graph.both_directions(e)
    at = {r["node"]: r["left"] for r in graph.reach(both, spark.createDataFrame([(9, 1, 25.0)], "seed long, node long, left double")).collect()}
    assert at == {1: 25.0, 2: 15.0, 3: 10.0, 4: 0.0}
    got = graph.flood(both, spark.createDataFrame([(9, 1)], "seed long, node long"), spark.createDataFrame([(3,)], "node long"))
    assert {r["way_id"] for r in got.collect()} == {1, 2, 4}


def test_split_pieces_join_to_the_way(spark):
    rows = [(1, k, 4, 10 + k, float(k), 0.0) for k in range(5)]
    wn = spark.createDataFrame(rows, "way_id long, seq int, last int, node_id long, lon double, lat double")
    got = {r["part"]: [n["node_id"] for n in r["nodes"]] for r in graph.split_at(wn, spark.createDataFrame([(12,), (10,)], "node_id long")).collect()}
    assert got == {0: [10, 11, 12], 1: [12, 13, 14]}


def test_grid_join_finds_each_pair_once(spark):
    rng = random.Random(2)
    pts = [(i, rng.uniform(0, 50), rng.uniform(0, 50)) for i in range(80)]
    lines = [(i, [(rng.uniform(0, 50), rng.uniform(0, 50)), (rng.uniform(0, 50), rng.uniform(0, 50))]) for i in range(15)]

    def d(px, py, a, b):
        ux, uy = b[0] - a[0], b[1] - a[1]
        t = min(1, max(0, ((px - a[0]) * ux + (py - a[1]) * uy) / (ux * ux + uy * uy)))
        return ((px - a[0] - t * ux) ** 2 + (py - a[1] - t * uy) ** 2) ** 0.5

    want = {(i, j) for i, x, y in pts for j, (a, b) in lines if d(x, y, a, b) <= 4}
    got = spatial.points_to_lines(spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(lines, "id long, line array<struct<x:double,y:double>>"), 4.0)
    rows = [(r["l_id"], r["r_id"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_thinning_drops_later_points(spark):
    pts = spark.createDataFrame([(1, 0.0, 50.0), (2, 0.00005, 50.0), (3, 0.00010, 50.0), (4, 1.0, 50.0)], "id long, lon double, lat double")
    assert sorted(r["id"] for r in spatial.thin(pts, 6.0).collect()) == [1, 4]


def test_rings(spark):
    ring = lambda *p: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p))
    sq, bow = ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0)), ring((0, 0), (2, 2), (2, 0), (0, 2), (0, 0))
    got = spark.range(1).select(spatial.point_in_ring(sq, F.lit(1.0), F.lit(1.0)).alias("i"), spatial.point_in_ring(sq, F.lit(3.0), F.lit(1.0)).alias("o"), spatial.ring_is_valid(sq).alias("v"), spatial.ring_is_valid(bow).alias("w")).first()
    assert tuple(got) == (True, False, True, False)


def test_weights(spark):
    rows = [(1, 0, 2, 5), (1, 1, 2, 6), (1, 2, 2, 5), (2, 0, 1, 5), (2, 1, 1, 7)]
    wn = spark.createDataFrame(rows, "way_id long, seq int, last int, node_id long")
    assert {r["node_id"]: r["weight"] for r in graph.intersection_weights(wn).collect()} == {5: 3, 6: 2, 7: 1}
    assert {r["node_id"]: r["weight"] for r in graph.distinct_weights(wn).collect()} == {5: 3, 6: 2, 7: 1}


def test_covered_share(spark):
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (1e-3, 0.0)]), (2, [(0.0, 1.0), (1e-3, 1.0)])], "id long, line array<struct<x:double,y:double>>")
    roads = spark.createDataFrame([([(0.0, 1e-5), (5e-4, 1e-5)],), ([(2.5e-4, 0.0), (6e-4, 0.0)],)], "line array<struct<x:double,y:double>>")
    got = {r["id"]: r["covered"] / r["length"] for r in spatial.covered_share(lines, roads, 7e-5).collect()}
    assert got == {1: pytest.approx(0.6), 2: 0.0}


def ring_edges(spark, n, cost):
    return spark.createDataFrame([(k, k, (k + 1) % n, cost) for k in range(n)], "way_id long, a long, b long, cost double")


def test_loops_of_many_ways(spark):
    """A ring of 80 ways is walked to its end in both directions."""
    got = graph.closed_loops(ring_edges(spark, 80, 0.5), spark.createDataFrame([(0,)], "node long"), 200.0).collect()
    assert sorted(r["path"] for r in got) == [list(range(80)), list(range(79, -1, -1))] and all(r["cost"] == 40 for r in got)


def test_pruned_loops_are_the_same(spark):
    rng = random.Random(2)
    at = {k: (k % 6 * 4e-4, k // 6 * 3e-4) for k in range(30)}
    links = [(k, k + 1) for k in range(29) if k % 6 < 5] + [(k, k + 6) for k in range(24)] + [(k, k + 7) for k in range(22) if k % 6 < 5 and rng.random() < 0.5]
    nodes = spark.createDataFrame([(k, x, y) for k, (x, y) in at.items()], "node long, lon double, lat double")
    edges = spark.createDataFrame([(i, a, b, *at[a], *at[b]) for i, (a, b) in enumerate(links)], "way_id long, a long, b long, x1 double, y1 double, x2 double, y2 double")
    edges = edges.select("way_id", "a", "b", geo.geodesic(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("cost"))
    whole, pruned = (sorted((r["start"], r["path"]) for r in graph.closed_loops(edges, nodes.select("node"), 200.0, x).collect()) for x in (None, nodes))
    assert whole == pruned and len(whole) > 50


def test_rounds_go_to_the_end(spark):
    """Reachability over a chain of more than 64 ways, and flooding to where nothing new is reached."""
    chain = spark.createDataFrame([(k, k, k + 1, 1.0) for k in range(66)], "way_id long, src long, dst long, cost double")
    seeds = spark.createDataFrame([(0, 0, 100.0)], "seed long, node long, left double")
    assert graph.reach(chain, seeds).where("node = 66 and left = 34").count() == 1
    text = chain.where("way_id < 9").select(F.col("way_id").cast("string").alias("way_id"), "src", "dst")
    stop = spark.createDataFrame([], "node long")
    assert graph.flood(text, seeds.select("seed", "node"), stop).count() == 9
    none = graph.flood(text, seeds.select("seed", "node").limit(0), stop)
    assert none.count() == 0 and none.schema["way_id"].dataType.simpleString() == "string"


def test_repeated_keys_of_map_text(spark):
    text = spark.createDataFrame([("{a=1, b=2, a=3, oneway=yes, oneway=no}",), ("{}",), (None,)], "t string")
    got = [r["m"] for r in text.select(tags.parse_map_text(F.col("t")).alias("m")).collect()]
    assert got[0] == {"a": "3", "b": "2", "oneway": "no"} and got[1] == {"oneway": "no"}


def test_thinning_equals_all_pairs_and_lists_none(spark):
    """Dense points, repeated ids and places, around the equator, the north, the pole, and points without a place."""
    rng = random.Random(7)
    rows = [(rng.randrange(250), lon + rng.random() * w, lat + rng.random() * 4e-4) for lon, lat, w in ((-1.25, -2e-4, 4e-4), (30.0, 69.9998, 1e-3), (0.0, 89.9996, 360.0)) for _ in range(60)]
    rows += [(300 + k, *rows[k][1:]) for k in range(60)] + [(1000 + k, 10.0 + k * 1e-9, 10.0) for k in range(3000)]
    rows += [(400, None, 1.0), (401, float("nan"), 1.0), (None, -1.25, 0.0)]
    near = lambda p, q: _metres(*p, *q) <= 6.0
    here = [r for r in rows if r[0] is not None and r[0] < 1000 and r[1] is not None and r[1] == r[1]]
    gone = {b[0] for a in here for b in here if a[0] < b[0] and near(a[1:], b[1:])} | set(range(1001, 4000))
    want = sorted(str(r) for r in rows if r[0] not in gone)
    pts = spark.createDataFrame(rows, "id long, lon double, lat double")
    assert sorted(str(tuple(r)) for r in spatial.thin(pts, 6.0).collect()) == want and 10 < len(want) < 200
    plan = spatial.thin(pts, 6.0)
    plan.collect()
    # The join's rows: 4.5 million pairs if they were listed.
    nodes, most = [plan._jdf.queryExecution().executedPlan()], 0
    while nodes:
        n = nodes.pop()
        if n.nodeName() == "AdaptiveSparkPlan":
            n = n.executedPlan()
        if hasattr(n, "plan") and "QueryStage" in n.getClass().getSimpleName():
            nodes.append(n.plan())
        m = n.metrics().get("numOutputRows")
        most = max(most, m.get().value() if m.isDefined() else 0)
        nodes += [n.children().apply(i) for i in range(n.children().size())]
    assert 0 < most < 100_000


def _metres(lon1, lat1, lon2, lat2):
    import math

    mid = math.radians((lat1 + lat2) / 2)
    w = math.sqrt(1 - geo.E2 * math.sin(mid) ** 2)
    north, east = math.radians(lat2 - lat1) * (geo.R * (1 - geo.E2)) / w**3, math.radians(lon2 - lon1) * geo.R / w * math.cos(mid)
    return math.hypot(north, east)
