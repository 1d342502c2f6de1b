"""The registered queries of the training-data operators, over whole tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from txnflow.llm import bpe, decontaminate, html_text, language_id, licenses, line_dedup, near_dup, oracles, quality_qda, quality_rules, tool_calls, toxicity, vector_codes, whitening

#: Place of the rank file and its pre-token pattern.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.calls_of_conversations(table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(tool_calls.TOOLS, "name string, arg string, type string, required boolean")
    return tool_calls.link_tool_calls(calls, results, schemas)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_report(spark, table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_tool_calls, op2_line_dedup, op3_html_text, op4_decontaminate, op5_toxicity, op6_bpe,
        op7_near_duplicates, op8_quality, op9_licenses, op10_quality_rules, op11_vector_codes, op12_whitening, op13_language_id,
    )
}
ORACLES: dict[str, str] = {
    **oracles.ORACLES,
    "op1_tool_calls": """
with recursive t as (select conv_id, turn, role, coalesce(text, '') as text from conversations),
c0 as (select conv_id, turn, md5(concat(conv_id, ':', turn)) call_id, text, length(text) n,
              case (turn // 2) % 4 when 0 then 'lookup' when 1 then 'compute' when 2 then 'write' else 'erase' end as name
       from t where role = 'assistant'),
c1 as (select *, n % 13 <> 0 as parsed,
              case when n % 7 = 0 then '"' || n || '"' when n % 11 = 0 then null else n::varchar end as chars,
              case when name = 'lookup' then '"query":"' || md5(text) || '"' when name = 'write' then '"lines":' || n % 5 end as more
       from c0),
c2 as (select *, case when parsed then '{' || concat_ws(',', '"chars":' || chars, more) || '}' end as arguments,
              parsed and name <> 'erase' and chars is not null and n % 7 <> 0 as valid from c1),
edge as (select a.conv_id, a.turn, b.turn as on_turn from c0 a join c0 b on a.conv_id = b.conv_id and b.turn in (a.turn - 2, a.turn - 4)),
walk as (select conv_id, turn, 0 as depth from c0 union select e.conv_id, e.turn, w.depth + 1 from walk w join edge e on e.conv_id = w.conv_id and e.on_turn = w.turn),
lev as (select conv_id, turn, max(depth) as level from walk group by all)
select c2.conv_id, c2.call_id, c2.turn, c2.name, cast(level as int) as level, r.text is not null as linked, c2.valid,
       '{"arguments":' || coalesce(arguments, 'null') || ',"call_id":"' || c2.call_id || '","level":' || level || ',"name":"' || c2.name
       || '","result":' || coalesce(to_json(r.text)::varchar, 'null') || ',"valid":' || c2.valid || '}' as json
from c2 join lev using (conv_id, turn) left join t r on r.conv_id = c2.conv_id and r.turn = c2.turn + 1
""",
}
