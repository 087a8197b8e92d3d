"""Queries of the training-data operators: each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayforge.llm import exact_dedup, lattice_lm, line_dedup, mixing, multi_index, ngram_join, packing, quality, tool_calls, toxicity
from wayforge.llm.common import Scratch, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The tool that op1 takes each user turn for.
REPLY_SCHEMA = {
    "type": "object", "required": ["prompt", "words"], "additionalProperties": False,
    "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 400}, "words": {"type": "integer", "minimum": 1, "maximum": 40}},
}


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations hold no calls of their own, so each turn takes part in one: a user turn calls `reply`
    (identifier conversation-turn), and an assistant turn is the result of the turn before it. Of each four turns the
    calls of the first two wait for the call two turns later, and the others for the call four turns earlier, so that calls stand
    before what they depend on and have to be ordered."""
    turns = table(spark, sf_dir, "conversations")
    name = lambda back: F.concat_ws("-", "conv_id", F.col("turn") - back)
    text, place = F.col("text"), F.pmod("turn", F.lit(4))
    calls = turns.where("role = 'user'").select(
        "conv_id", name(0).alias("call_id"), F.col("turn").alias("seq"), F.lit("reply").alias("name"),
        F.to_json(F.struct(text.alias("prompt"), mixing.n_words(text).alias("words"))).alias("arguments"),
        F.when(place < 2, F.array(name(-2))).when(F.col("turn") >= 4, F.array(name(4))).otherwise(F.array().cast("array<string>")).alias("after"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", name(1).alias("call_id"), F.col("turn").alias("seq"), text.alias("content"))
    return tool_calls.link(calls, results, {"reply": REPLY_SCHEMA}, Scratch(spark, "op1"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op2")
    return packing.pack_documents(table(spark, sf_dir, "documents"), scratch, vocabulary("word_bpe_49k.json"))


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), Scratch(spark, "op3"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_exact(table(spark, sf_dir, "documents"), Scratch(spark, "op4"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), Scratch(spark, "op5"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ngram_join.ngram_components(table(spark, sf_dir, "documents"), Scratch(spark, "op7"), k=4, num=85, den=100)
    return got.select("doc_id", "n_shingles", "component_id")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"), Scratch(spark, "op8"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(table(spark, sf_dir, "documents"), Scratch(spark, "op10"), vocabulary("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (
    op1_tool_calls, op2_best_fit_packing, op3_multi_index, op4_exact_dedup, op5_line_dedup,
    op6_toxicity, op7_ngram_join, op8_source_mixing, op9_quality, op10_lattice_lm,
)}

ORACLE_SQL = {
    "op1_tool_calls": r"""
with recursive t as (select *, case when turn % 4 < 2 then turn + 2 when turn >= 4 then turn - 4 end as dep, concat(conv_id, '-', turn) as id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from conversations where conv_id is not null),
calls as (select * from t where role = 'user'), results as (select *, concat(conv_id, '-', turn - 1) as call_id from t where role = 'assistant'),
r as (select conv_id, call_id, min({'seq': turn, 'content': text}) as r, count(*) as n from results group by all),
f as (select conv_id, id, min(turn) as first_seq from calls group by all),
v(conv_id, id, level) as (select conv_id, id, 0::bigint from calls union all select c.conv_id, c.id, v.level + 1 from v join calls c on c.conv_id = v.conv_id and concat(c.conv_id, '-', c.dep) = v.id),
j as (select c.conv_id, c.id, c.turn, c.text, c.words, r.r['content'] as content, coalesce(r.n, 0) as n,
  c.dep is not null and not exists (select 1 from f where f.conv_id = c.conv_id and f.id = concat(c.conv_id, '-', c.dep)) as lost,
  (select max(level) from v where v.conv_id = c.conv_id and v.id = c.id) as level
 from calls c left join r on r.conv_id = c.conv_id and r.call_id = c.id),
e as (select *, list_sort(list_filter([
  case when text is null then 'prompt: missing' when length(text) < 1 then 'prompt: too short' when length(text) > 400 then 'prompt: too long' end,
  case when lost then 'unknown dependency' end,
  case when coalesce(words, 0) < 1 then 'words: below minimum' when words > 40 then 'words: above maximum' end], lambda x: x is not null)) as errors from j)
select 'call' as kind, conv_id, id as call_id, turn as seq, level, n > 0 as linked, n as n_results, len(errors) = 0 as valid, array_to_string(errors, '; ') as errors,
 concat('{"call":{"arguments":{', case when text is not null then concat('"prompt":', to_json(text), ',') else '' end, '"words":', coalesce(words, 0), '},"id":', to_json(id), ',"name":"reply"},"result":', coalesce(to_json(content)::varchar, 'null'), '}') as json
from e
union all
select 'orphan', conv_id, call_id, turn, null, false, 0, false, 'no such call', null from results x where not exists (select 1 from f where f.conv_id = x.conv_id and f.id = x.call_id)
""",
    "op7_ngram_join": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as t from documents),
g as (select doc_id, list_distinct(case when len(t) >= 4 then list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i+3], ' ')) when len(t) > 0 then [array_to_string(t, ' ')] else [] end) as s from w),
n as (select doc_id, len(s) as n, list_sort(s) as s from g), e as (select doc_id, n, unnest(s) as x from n),
links as (select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
c(node, root) as (select doc_id, doc_id from documents union select case when l.a = c.node then l.b else l.a end, c.root from c join links l on l.a = c.node or l.b = c.node)
select n.doc_id, n.n as n_shingles, min(c.root) as component_id from n join c on c.node = n.doc_id group by all
""",
    "op4_exact_dedup": """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
 count(*) over (partition by coalesce(text, '')) as group_size,
 row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept,
 sha256(coalesce(text, '')) as text_sha256
from documents
""",
}
