"""Road-graph operators: weights, bounded loops and reachability, flooding, components, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayforge.functions import geo
from wayforge.operators.rounds import Rounds


def intersection_weights(way_nodes: DataFrame) -> DataFrame:
    """(node_id, weight): each end of a way counts 1 and each inner place 2, for every occurrence.
    way_nodes: way_id, seq, last (greatest seq of the way), node_id."""
    inner = (F.col("seq") > 0) & (F.col("seq") < F.col("last"))
    return way_nodes.groupBy("node_id").agg(F.sum(F.when(inner, 2).otherwise(1)).alias("weight"))


def distinct_weights(way_nodes: DataFrame) -> DataFrame:
    """(node_id, weight): distinct (way, is start) ends count 1, distinct inner ways 2."""
    inner = (F.col("seq") > 0) & (F.col("seq") < F.col("last"))
    once = way_nodes.select("node_id", "way_id", F.when(inner, 2).when(F.col("seq") == 0, 0).otherwise(1).alias("kind")).distinct()
    return once.groupBy("node_id").agg(F.sum(F.when(F.col("kind") == 2, 2).otherwise(1)).alias("weight"))


def adjacency(way_nodes: DataFrame, distinct: bool = False) -> DataFrame:
    return way_nodes.groupBy("node_id").agg(F.array_sort((F.collect_set if distinct else F.collect_list)("way_id")).alias("ways"))


def both_directions(edges: DataFrame) -> DataFrame:
    """(way_id, src, dst, cost): an edge from each end; a self-closing way has one."""
    back = edges.where("a <> b").select("way_id", F.col("b").alias("src"), F.col("a").alias("dst"), "cost")
    return edges.select("way_id", F.col("a").alias("src"), F.col("b").alias("dst"), "cost").unionByName(back)


def closed_loops(edges: DataFrame, starts: DataFrame, budget: float, at: DataFrame | None = None) -> DataFrame:
    """(start, path, cost): loops from each start node that use no way twice and cost at most budget.

    edges: way_id, a, b, cost; starts: node. Paths grow by one way a round, joined on their last node, as long as any can;
    a path that is back at its start is emitted and not grown. Every rotation and direction that begins at a start is emitted.
    at: node, lon, lat; with it, paths go that are farther from their start than what is left of the budget, where no cost is
    below the straight distance of its ends.
    """
    rounds = Rounds(edges.sparkSession, "loops")
    step = both_directions(edges)
    if at is not None:
        step = step.join(at.select(F.col("node").alias("dst"), F.col("lon").alias("x"), F.col("lat").alias("y")), "dst")
        starts = starts.select("node").distinct().join(at.select("node", F.col("lon").alias("x0"), F.col("lat").alias("y0")), "node")
    place = [] if at is None else ["x0", "y0"]
    # A thousandth is left for the error of short-range distances.
    near = F.lit(True) if at is None else F.col("cost") + 0.999 * geo.geodesic(F.col("x0"), F.col("y0"), F.col("x"), F.col("y")) <= budget
    step = rounds.keep(step)
    first = starts.select(F.col("node").alias("src"), *place).distinct().join(step, "src").where((F.col("cost") <= budget) & near)
    paths = rounds.keep(first.select(F.col("src").alias("start"), F.col("dst").alias("cur"), F.array("way_id").alias("path"), "cost", *place))
    found = []
    while not paths.isEmpty():
        found.append(rounds.keep(paths.where("cur = start").select("start", "path", "cost")))
        e = rounds.again(step).withColumnsRenamed({"cost": "more", "src": "cur"})
        grown = paths.where("cur <> start").join(e, "cur").where("not array_contains(path, way_id)").withColumn("cost", F.col("cost") + F.col("more"))
        grown = grown.where((F.col("cost") <= budget) & near)
        new = rounds.keep(grown.select("start", F.col("dst").alias("cur"), F.expr("array_append(path, way_id)").alias("path"), "cost", *place))
        rounds.drop(paths)
        paths = new
    return rounds.all_of(found) if found else paths.select("start", "path", "cost")


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node, left): best remaining budget of each seed at each node it reaches, never below 0.

    edges: way_id, src, dst, cost, directed; seeds: seed, node, left. A bounded relaxation, until no node improves: each
    round spends edges from improved nodes only and keeps the best, so the result does not depend on order.
    """
    rounds = Rounds(edges.sparkSession, "reach")
    step = rounds.keep(edges.select("src", "dst", "cost"))
    best = rounds.keep(seeds.where("left >= 0").groupBy("seed", "node").agg(F.max("left").alias("left")))
    front = best
    while True:
        e = rounds.again(step)
        cand = front.join(e, front["node"] == e["src"]).select("seed", F.col("dst").alias("node"), (F.col("left") - F.col("cost")).alias("left"))
        cand = cand.where("left >= 0").groupBy("seed", "node").agg(F.max("left").alias("left"))
        old = rounds.again(best).select("seed", "node", F.col("left").alias("was"))
        better = rounds.keep(cand.join(old, ["seed", "node"], "left").where("was is null or left > was").select("seed", "node", "left"))
        if better.isEmpty():
            return best
        new = rounds.keep(best.unionByName(better).groupBy("seed", "node").agg(F.max("left").alias("left")))
        rounds.drop(best)
        best, front = new, better


def flood(edges: DataFrame, seeds: DataFrame, stop: DataFrame) -> DataFrame:
    """(seed, way_id): ways crossed from each seed node until nodes of stop; those are reached, not passed.

    edges: way_id, src, dst; seeds: seed, node; stop: node. Rounds go on until no new node is reached.
    """
    rounds = Rounds(edges.sparkSession, "flood")
    step = rounds.keep(edges.select("way_id", "src", "dst"))
    front = rounds.keep(seeds.select("seed", "node").distinct())
    seen, ways = [front], []
    halt = rounds.keep(stop.select("node").distinct())
    while not front.isEmpty():
        crossed = rounds.keep(front.join(rounds.again(step), F.col("node") == F.col("src")).select("seed", "way_id", F.col("dst").alias("to")))
        ways.append(rounds.keep(crossed.select("seed", "way_id").distinct()))
        new = rounds.again(crossed).select("seed", F.col("to").alias("node")).distinct()
        front = rounds.keep(new.join(rounds.all_of(seen), ["seed", "node"], "left_anti").join(rounds.again(halt), "node", "left_anti").select("seed", "node"))
        seen.append(front)
    if ways:
        return rounds.all_of(ways).distinct()
    return seeds.select("seed").limit(0).crossJoin(edges.select("way_id").limit(0))  # no rows, of the right types


def components(edges: DataFrame, rounds: Rounds | None = None, lone: bool = True) -> DataFrame:
    """(node, root) for all nodes of edges (a, b), or without those that are their own root if not lone; root is the
    least node of the component. Large-star, small-star until the stars stay as they are; null ends and loops join nothing."""
    rounds = rounds or Rounds(edges.sparkSession, "components")
    links = rounds.keep(edges.select("a", "b").distinct(), "links")
    now = rounds.keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    mark = None
    while True:
        turned = rounds.again(now)
        both = now.unionByName(turned.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        new = rounds.keep(stars, "stars")
        state = new.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1_000_003)))).first()
        rounds.drop(now)
        now = new
        if state == mark or state[0] == 0:
            break
        mark = state
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots._paths = now._paths
    if not lone:
        rounds.drop(links)
        return roots
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).where("node is not null").distinct()
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def chain_links(ends: DataFrame, true_nodes: DataFrame) -> DataFrame:
    """(a, b) with a < b: ways that may be one chain at a node that is no true intersection.

    ends: way_id, node_id, is_start, oneway (boolean). One-way joins only one-way, and only end to start.
    """
    free = ends.join(true_nodes.select("node_id"), "node_id", "left_anti")
    x, y = free.alias("x"), free.alias("y")
    fits = (F.col("x.oneway") == F.col("y.oneway")) & (~F.col("x.oneway") | (F.col("x.is_start") != F.col("y.is_start")))
    return x.join(y, F.col("x.node_id") == F.col("y.node_id")).where((F.col("x.way_id") < F.col("y.way_id")) & fits).select(
        F.col("x.way_id").alias("a"), F.col("y.way_id").alias("b")).distinct()


def merge_chain(members: DataFrame) -> DataFrame:
    """(root, way_ids, line): ways of each chain in order as one line. members: root, way_id, line (array of x, y).

    A chain is a path or ring of ways; ends meet where they fall on one key of a 1e-9 grid. The walk begins
    at a free end (the least way_id with one), or at the least way of a ring.
    """
    import pandas as pd

    def walk(p: pd.DataFrame) -> pd.DataFrame:
        lines = {w: [(q["x"], q["y"]) for q in line] for w, line in zip(p["way_id"], p["line"], strict=True)}
        key = lambda q: (round(q[0] * 1e9), round(q[1] * 1e9))
        at: dict = {}
        for w, pts in lines.items():
            for q in (pts[0], pts[-1]):
                at.setdefault(key(q), set()).add(w)
        free = sorted(w for w, pts in lines.items() if len(at[key(pts[0])]) == 1 or len(at[key(pts[-1])]) == 1)
        left, out = set(lines), []
        while left:
            w = next((f for f in free if f in left), min(left))
            pts = lines[w] if len(at[key(lines[w][0])]) == 1 or len(at[key(lines[w][-1])]) > 1 else lines[w][::-1]
            ids, path = [w], list(pts)
            left.discard(w)
            while nxt := sorted(at[key(path[-1])] & left):
                w = nxt[0]
                pts = lines[w] if key(lines[w][0]) == key(path[-1]) else lines[w][::-1]
                ids.append(w)
                path += pts[1:]
                left.discard(w)
            out.append((p["root"].iloc[0], ids, [{"x": x, "y": y} for x, y in path]))
        return pd.DataFrame(out, columns=["root", "way_ids", "line"])

    kind = members.schema["way_id"].dataType.simpleString()
    return members.groupBy("root").applyInPandas(walk, f"root {members.schema['root'].dataType.simpleString()}, way_ids array<{kind}>, line array<struct<x:double,y:double>>")


def split_at(way_nodes: DataFrame, split: DataFrame) -> DataFrame:
    """(way_id, part, nodes): ways cut at inner nodes of split (node_id); the cut node is in both parts.

    way_nodes: way_id, seq, last, node_id, lon, lat.
    """
    from pyspark.sql import Window as W

    cut = way_nodes.join(split.select("node_id", F.lit(True).alias("cut")), "node_id", "left")
    inner = F.coalesce("cut", F.lit(False)) & (F.col("seq") > 0) & (F.col("seq") < F.col("last"))
    before = F.coalesce(F.sum(inner.cast("int")).over(W.partitionBy("way_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = cut.withColumn("inner", inner).withColumn("part", before)
    rows = parts.select("way_id", "seq", "node_id", "lon", "lat", F.explode(F.when(F.col("inner"), F.array("part", F.col("part") + 1)).otherwise(F.array("part"))).alias("part"))
    at = F.struct("seq", "node_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return rows.groupBy("way_id", "part").agg(F.array_sort(F.collect_list(at)).alias("nodes"))


def replace_split(edges: DataFrame, halves: DataFrame, key: str = "way_id", parent: str = "parent_id") -> DataFrame:
    """Graph after a split: split ways are gone and their halves are in."""
    return edges.join(halves.select(F.col(parent).alias(key)).distinct(), key, "left_anti").unionByName(halves.drop(parent), allowMissingColumns=True)
