"""Tool-call linking for chat data: join, order, validate, serialise.

Calls and results are joined by (conversation, identifier); of calls that share an identifier the first
by seq is the call and the rest are errors, of results the first is linked and the rest are counted. Calls are ordered
topologically by (level, seq): a call's level is 0 without dependencies, else one more than the highest of its
dependencies, wherever these stand in the conversation; what lies on a cycle or behind one has level null, an error. Arguments
are parsed and validated against the schema of their tool, and each call with its result is one line of canonical JSON:
keys sorted, no spaces, UTF-8 as it is.

Links are equi-joins and pre-aggregated minima, so a conversation of any length, or an identifier
that many rows share, needs no group in one task. Levels of conversations with at most GROUP dependencies are worked out
in groups of many conversations; longer ones are peeled round by round over all tasks, as many rounds as the
longest chain has calls, each a table of its own. Both give the same levels.

Defined cases: calls without conversation or identifier are kept as errors ("no id"), never joined;
arguments that are null, broken, nested deeper than the parser goes, or hold what UTF-8 JSON cannot (NaN, infinities, numbers
beyond double range, lone surrogates) are errors ("arguments: not JSON") and are null in the line; very long arguments
and contents are taken whole; a dependency that isn't a call of the conversation is an error and doesn't
count for levels; results that no call asked for are rows of kind "orphan"; rows that repeat are duplicates, and calls that
tie by seq share what they depend on; columns other than those named are not read; empty tables give no rows.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayforge.llm.common import Scratch

TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
#: Dependencies of a conversation up to which its calls are ordered within one group of conversations.
GROUP = 20_000


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and no escapes that JSON does not require."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _no_number(text: str):
    raise ValueError(text)


def _finite(text: str) -> float:
    x = float(text)
    return _no_number(text) if x in (float("inf"), float("-inf")) else x


def parsed(text: str):
    """(value, canonical text) of JSON that can be written back as UTF-8 JSON; ValueError or RecursionError else."""
    value = json.loads(text, parse_constant=_no_number, parse_float=_finite)
    line = canonical(value)
    line.encode()
    return value, line


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or isinstance(value, int) or value == int(value))
    return isinstance(value, TYPES[kind])


def violations(value, schema: dict, at: str = "") -> list[str]:
    """Where a value breaks a schema: type (a name or a list of names), enum, required, properties, additionalProperties, items,
    minimum, maximum, minLength and maxLength."""
    kind, here = schema.get("type"), at or "arguments"
    kinds = kind if isinstance(kind, list) else [] if kind is None else [kind]
    number = _is(value, "number")
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{here}: not {' or '.join(kinds)}"]
    out = [f"{here}: not in enum"] if "enum" in schema and canonical(value) not in {canonical(x) for x in schema["enum"]} else []
    if number:
        out += [f"{here}: below minimum"] if value < schema.get("minimum", value) else []
        out += [f"{here}: above maximum"] if value > schema.get("maximum", value) else []
    if isinstance(value, str):
        out += [f"{here}: too short"] if len(value) < schema.get("minLength", 0) else []
        out += [f"{here}: too long"] if len(value) > schema.get("maxLength", len(value)) else []
    if isinstance(value, dict):
        known, base = schema.get("properties", {}), f"{at}." if at else ""
        out += [f"{base}{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += violations(v, known[k], base + k)
            elif schema.get("additionalProperties") is False:
                out.append(f"{base}{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{i}]")
    return out


def _levels_of(edges) -> dict:
    """Level of each call that depends on another: edges are (call, dep); None on a cycle or behind one."""
    waits, after, level = {}, {}, {}
    for call, dep in edges:
        waits[call] = waits.get(call, 0) + 1
        after.setdefault(dep, []).append(call)
    ready = [(dep, 0) for dep in after if dep not in waits]
    for dep, n in ready:  # grows while it is read; a call comes after all it waits for, so its level is final
        for call in after.get(dep, ()):
            level[call] = max(level.get(call, 0), n + 1)
            waits[call] -= 1
            if not waits[call]:
                ready.append((call, level[call]))
    return {call: level[call] if not n else None for call, n in waits.items()}


def levels(edges: DataFrame, scratch: Scratch, group: int = GROUP) -> DataFrame:
    """(conv_id, call_id, level) of calls that depend on others. edges: conv_id, call_id, dep, distinct, all ends known."""
    edges = scratch.write(edges, "edges")
    sizes = scratch.write(edges.groupBy("conv_id").agg(F.count(F.lit(1)).alias("edges")), "sizes")
    all_edges, most = sizes.agg(F.sum("edges"), F.max("edges")).first()
    schema = edges.select("conv_id", "call_id", F.lit(None).cast("long").alias("level")).schema
    large = sizes.where(F.col("edges") > group).select("conv_id")
    small = edges if (most or 0) <= group else edges.join(large, "conv_id", "left_anti")
    buckets = 1 + (all_edges or 0) // group

    def order(p):
        found = _levels_of(zip(zip(p["conv_id"], p["call_id"], strict=True), zip(p["conv_id"], p["dep"], strict=True), strict=True))
        return pd.DataFrame({"conv_id": [k[0] for k in found], "call_id": [k[1] for k in found], "level": pd.array(list(found.values()), dtype="Int64")})

    out = small.withColumn("bucket", F.pmod(F.xxhash64("conv_id"), F.lit(buckets))).groupBy("bucket").applyInPandas(order, schema)
    return out if (most or 0) <= group else out.unionByName(_peeled(edges.join(large, "conv_id", "left_semi"), scratch))


def _peeled(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """levels of conversations of any size: in each round the calls go that wait for no call that waits."""
    key, n, done = ["conv_id", "call_id"], 0, []
    left = scratch.write(edges, "left")
    while True:
        waiting = scratch.again(left).select("conv_id", F.col("call_id").alias("dep")).distinct()
        rest = scratch.write(left.join(waiting, ["conv_id", "dep"], "left_semi").select("conv_id", "call_id", "dep"), "left")
        n += 1
        gone = scratch.again(left).select(*key).distinct().join(rest.select(*key).distinct(), key, "left_anti")
        done.append(scratch.write(gone.withColumn("level", F.lit(n).cast("long")), "done"))
        scratch.drop(left)
        left = rest
        if done[-1].isEmpty():
            break
    return scratch.all_of(done).unionByName(left.select(*key).distinct().withColumn("level", F.lit(None).cast("long")))


def link(calls: DataFrame, results: DataFrame, tools: dict[str, dict], scratch: Scratch) -> DataFrame:
    """kind, conv_id, call_id, seq, level, linked, n_results, valid, errors, json.

    calls: conv_id, call_id, seq, name, arguments (JSON text), after (array of identifiers).
    results: conv_id, call_id, seq, content. tools: schema of the arguments by name.
    """
    calls = calls.select("conv_id", "call_id", "seq", "name", "arguments", "after")
    named = calls.where("conv_id is not null and call_id is not null")
    firsts = named.groupBy("conv_id", "call_id").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("same"))
    answers = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(
        F.min(F.struct("seq", "content")).alias("r"), F.count(F.lit(1)).alias("n_results")
    )
    first = named.join(firsts.select("conv_id", "call_id", F.col("first_seq").alias("seq")), ["conv_id", "call_id", "seq"], "left_semi")
    deps = first.select("conv_id", "call_id", F.explode("after").alias("dep")).where("dep is not null").distinct()
    known = firsts.select("conv_id", F.col("call_id").alias("dep"))
    missing = deps.join(known, ["conv_id", "dep"], "left_anti").groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("unknown"))
    level = levels(deps.join(known, ["conv_id", "dep"], "left_semi").select("conv_id", "call_id", "dep"), scratch).withColumn("waits", F.lit(True))
    key = ["conv_id", "call_id"]
    joined = (
        calls.join(firsts, key, "left").join(answers, key, "left").join(missing, key, "left").join(level, key, "left")
        .select(
            "conv_id", "call_id", "seq", "name", "arguments", F.col("r.content").alias("content"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
            F.when(F.col("waits"), F.col("level")).otherwise(F.lit(0)).cast("long").alias("level"),
            F.coalesce(F.col("first_seq") < F.col("seq"), F.lit(False)).alias("again"), (F.coalesce("unknown", F.lit(0)) > 0).alias("lost"),
        )
    )

    def check(batches):
        for p in batches:
            errors, lines = [], []
            for r in p.itertuples(index=False):
                e, line = [], "null"
                if pd.isna(r.conv_id) or pd.isna(r.call_id):
                    e.append("no id")
                if r.again:
                    e.append("identifier used before")
                if r.lost:
                    e.append("unknown dependency")
                if pd.isna(r.level):
                    e.append("cyclic dependency")
                if r.name not in tools:
                    e.append("unknown tool")
                try:
                    args, line = parsed(r.arguments)
                    e += violations(args, tools[r.name]) if r.name in tools else []
                except (TypeError, ValueError, RecursionError):
                    e, line = [*e, "arguments: not JSON"], "null"
                errors.append("; ".join(sorted(e)))
                one, result = lambda x: canonical(x if isinstance(x, str) else None), r.content if isinstance(r.content, str) and not r.again else None
                lines.append(f'{{"call":{{"arguments":{line},"id":{one(r.call_id)},"name":{one(r.name)}}},"result":{one(result)}}}')
            yield pd.DataFrame({
                "kind": "call", "conv_id": p["conv_id"], "call_id": p["call_id"], "seq": p["seq"], "level": p["level"], "linked": (p["n_results"] > 0) & ~p["again"], "n_results": p["n_results"],
                "valid": [not x for x in errors], "errors": errors, "json": lines,
            })

    shape = f"kind string, conv_id {calls.schema['conv_id'].dataType.simpleString()}, call_id string, seq long, level long, linked boolean, n_results long, valid boolean, errors string, json string"
    checked = joined.mapInPandas(check, shape)
    orphans = results.join(firsts, key, "left_anti").select(
        F.lit("orphan").alias("kind"), "conv_id", "call_id", "seq", F.lit(None).cast("long").alias("level"), F.lit(False).alias("linked"), F.lit(0).cast("long").alias("n_results"), F.lit(False).alias("valid"),
        F.lit("no such call").alias("errors"), F.lit(None).cast("string").alias("json"),
    )
    return checked.unionByName(orphans)


def conversation_json(linked: DataFrame) -> DataFrame:
    """(conv_id, calls): the calls of each conversation in topological order, one line each. A row holds a
    whole conversation, so this is for conversations that fit in one."""
    at = F.struct(F.col("level").isNull().alias("late"), "level", "seq", "json")
    return linked.where("kind = 'call'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(at)), lambda x: x["json"]), "\n").alias("calls"))
