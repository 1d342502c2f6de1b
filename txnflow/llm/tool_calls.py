"""Tool-call linking: calls meet their results by identifier, get their place in the order of dependence, have their
arguments validated against schemas, and are written as canonical JSON.

Inputs, all as tables:

* calls: ``conv_id, call_id, turn, name, arguments`` (JSON text) ``, depends_on`` (array of call ids of the conversation),
* results: ``conv_id, call_id, content``,
* schemas: ``name, arg, type, required``; types are ``integer number string boolean array object``.

``level`` is 0 for calls without dependencies and else one more than the highest level they depend on, so ``(level,
turn, call_id)`` orders a conversation topologically. Calls on a cycle or behind one have no level. Dependencies on calls
that don't exist are ignored. Levels are found in blocks of at most ``BLOCK_CALLS`` calls in order of turn, each swept
forward and backward in one step; rounds are needed only where dependencies lead from block to block or alternate between
the directions. No conversation is gathered into one array.

``valid`` asks for a JSON object, a known tool, every required argument, no unknown argument and matching types; a JSON
null counts as an argument that is absent. Whole numbers of any size are integers. Canonical JSON has its keys in order, no blanks,
and null where something is missing; decimal numbers lose their final zeros (``1.0`` is ``1``), and numbers with an exponent are
doubles (``1e0`` is ``1.0``).

Defined cases: a call id that occurs twice in a conversation keeps its call of the smallest turn (then name, then
arguments); of several results the smallest text counts; rows without conv_id or call_id are left out; null or
malformed arguments are invalid and serialised as null; a missing result gives ``linked`` false. Of several schema rows for an
argument the smallest (type, required) counts. Empty tables of calls give no rows, empty results or schemas no links or no valid call;
other columns of the three tables are ignored, whatever their names; texts of any length are kept whole. Schemas of at most
``MAX_SCHEMA`` rows, which is checked, are broadcast; more are joined by shuffle. Only DataFrame functions are used.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txnflow.llm.shared import written

KEY = ["conv_id", "call_id"]
MAX_SCHEMA = 10_000
#: Calls of a conversation whose levels are found in one step, at most.
BLOCK_CALLS = 256


def _single(calls: DataFrame) -> DataFrame:
    """One call per key, without the columns that don't belong to it."""
    c = calls.where("conv_id is not null and call_id is not null")
    return c.groupBy(*KEY).agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c")).select(*KEY, "c.*")


def _swept(level: Column, order: Column) -> Column:
    """Levels by place after one walk over the places of a block in ``order``; each sees those found before it."""

    def found(acc: Column, i: Column) -> Column:
        on = F.transform(F.get("ins", i), lambda j: F.get(acc, j))
        ready = (F.get("outs", i) == 0) & ~F.exists(on, lambda x: x.isNull())
        return F.when(ready, F.greatest(F.get("low", i), F.coalesce(F.array_max(on), F.lit(-1)) + 1))

    def step(acc: Column, i: Column) -> Column:
        put = F.concat(F.slice(acc, 1, i), F.array(found(acc, i)), F.slice(acc, i + 2, F.size(acc)))
        return F.when(F.get(acc, i).isNotNull(), acc).otherwise(put)

    return F.aggregate(order, level, step)


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` of all calls; null for those on a cycle or behind one."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "call_id")) - 1
    keys = calls.select(*KEY, "depends_on", place.alias("p"))
    keys = written(keys.select(*KEY, "depends_on", F.floor(F.col("p") / BLOCK_CALLS).cast("int").alias("block"), (F.col("p") % BLOCK_CALLS).alias("i")))
    at = ["conv_id", "block", "i"]
    edges = keys.select(*at, F.explode("depends_on").alias("on")).where("on is not null").distinct()
    edges = written(edges.join(keys.select("conv_id", F.col("call_id").alias("on"), F.col("block").alias("on_block"), F.col("i").alias("on_i")), ["conv_id", "on"]).drop("on"))
    inside = F.col("block") == F.col("on_block")
    needs = edges.groupBy(*at).agg(F.collect_list(F.when(inside, F.col("on_i"))).alias("ins"), F.count_if(~inside).cast("int").alias("outs"))
    own = F.struct("i", "call_id", F.coalesce("ins", F.array().cast("array<int>")).alias("ins"), F.coalesce("outs", F.lit(0)).alias("outs"))
    blocks = keys.join(needs, at, "left").groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(own)).alias("c"))
    parts = [F.col(f"c.{x}").alias(x) for x in ("call_id", "ins", "outs")]
    waiting = blocks.select("conv_id", "block", *parts, F.transform("c", lambda _: F.lit(0)).alias("low"), F.transform("c", lambda _: F.lit(None).cast("int")).alias("level"))
    columns = waiting.columns
    between = edges.where(~inside)
    linked, closed = not between.isEmpty(), []
    unknown = F.exists("level", lambda x: x.isNull())
    while True:
        forward = F.sequence(F.lit(0), F.size("level") - 1)
        swept = waiting.withColumn("was", F.col("level")).withColumn("level", _swept(F.col("level"), forward))
        swept = written(swept.withColumn("level", F.when(unknown, _swept(F.col("level"), F.reverse(forward))).otherwise(F.col("level"))))
        left = swept.where(unknown)
        if left.isEmpty() or swept.where("not (level <=> was)").isEmpty():
            closed.append(swept)
            break
        closed.append(swept.where(~unknown))
        waiting = left.select(*columns)
        if linked:
            new = swept.select("conv_id", F.col("block").alias("on_block"), "was", F.posexplode("level").alias("on_i", "x")).where(F.col("x").isNotNull() & F.get("was", F.col("on_i")).isNull())
            met = between.join(new.drop("was"), ["conv_id", "on_block", "on_i"]).groupBy(*at).agg(F.count("*").cast("int").alias("n"), (F.max("x") + 1).alias("up"))
            met = met.groupBy("conv_id", "block").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("n", "up")))).alias("met"))
            outs = F.transform("outs", lambda n, i: n - F.coalesce(F.col("met")[i]["n"], F.lit(0)))
            low = F.transform("low", lambda n, i: F.greatest(n, F.coalesce(F.col("met")[i]["up"], F.lit(0))))
            waiting = waiting.join(met, ["conv_id", "block"], "left").withColumns({"outs": outs, "low": low}).select(*columns)
    done = functools.reduce(DataFrame.unionAll, closed)
    return done.select("conv_id", F.explode(F.arrays_zip("call_id", "level")).alias("c")).select("conv_id", "c.*")


def _argument_type(value: str) -> Column:
    """Schema type of a variant value; null for a JSON null."""
    t = F.upper(F.schema_of_variant(F.col(value)))
    return (
        F.when(t.isin("BIGINT") | t.rlike(r"^DECIMAL\(\d+,0\)$"), "integer").when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "number").when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object")
    )


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``conv_id, call_id`` and ``ok`` for the calls that have arguments, a known tool, or both."""
    spark = calls.sparkSession
    # Projected, so that other columns don't clash; one row an argument, the smallest by type where rows disagree.
    one = F.min(F.struct("type", "required")).alias("s")
    schemas = schemas.where("name is not null and arg is not null").groupBy("name", "arg").agg(one).select("name", "arg", "s.type", "s.required")
    sent = F.broadcast if schemas.limit(MAX_SCHEMA + 1).count() <= MAX_SCHEMA else lambda df: df
    tools = schemas.groupBy("name").agg(F.sum(F.col("required").cast("int")).alias("n_required"))
    parsed = calls.select(*KEY, "name", F.try_parse_json("arguments").alias("v"))
    parsed = parsed.where(F.schema_of_variant("v").startswith("OBJECT"))
    args = parsed.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(*KEY, "name", F.col("key").alias("arg"), _argument_type("value").alias("got"))
    args = args.where("got is not null").join(sent(schemas), ["name", "arg"], "left")
    fits = F.coalesce((F.col("got") == F.col("type")) | ((F.col("type") == "number") & (F.col("got") == "integer")), F.lit(False))
    seen = args.groupBy(*KEY).agg(F.min(fits.cast("int")).alias("fits"), F.sum(F.coalesce(F.col("required").cast("int"), F.lit(0))).alias("n"))
    objects = parsed.select(*KEY, "name").join(sent(tools), "name").join(seen, KEY, "left")
    ok = (F.coalesce("fits", F.lit(1)) == 1) & (F.coalesce("n", F.lit(0)) == F.col("n_required"))
    return objects.select(*KEY, ok.alias("ok"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """``conv_id, call_id, turn, name, level, linked, valid, json`` of every call."""
    calls = written(_single(calls))
    answer = results.where("conv_id is not null and call_id is not null").groupBy(*KEY).agg(F.min("content").alias("content"), F.lit(True).alias("linked"))
    out = calls.join(answer, KEY, "left").join(levels(calls), KEY, "left").join(validated(calls, schemas), KEY, "left")
    out = out.withColumns({"linked": F.coalesce("linked", F.lit(False)), "valid": F.coalesce("ok", F.lit(False)), "v": F.try_parse_json("arguments")})
    body = F.struct(
        F.col("v").alias("arguments"), F.col("call_id"), F.col("level"), F.col("name"), F.col("content").alias("result"), F.col("valid"),
    )
    return out.select(*KEY, "turn", "name", "level", "linked", "valid", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


# The tools that the calls of the conversations table are read as.
TOOLS = [
    ("compute", "chars", "integer", True),
    ("compute", "scale", "number", False),
    ("lookup", "chars", "integer", True),
    ("lookup", "query", "string", True),
    ("write", "chars", "integer", True),
    ("write", "lines", "integer", False),
]


def calls_of_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations table read as tool traffic: an assistant's turn is a call, the turn after it is its result.

    A call's id is the digest of conversation and turn, the tool follows from the turn, and its arguments from the text.
    It depends on the calls two and four turns earlier. Some calls leave out or mistype an argument, as traffic does.
    """
    t = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    call_id = lambda turn: F.md5(F.concat_ws(":", "conv_id", turn))
    n, step = F.length("text"), F.floor(F.col("turn") / 2)
    name = F.element_at(F.array(F.lit("lookup"), F.lit("compute"), F.lit("write"), F.lit("erase")), (step % 4 + 1).cast("int"))
    chars = F.when(n % 7 == 0, F.to_json(F.struct(n.cast("string").alias("chars")))).when(n % 11 == 0, "{}").otherwise(F.to_json(F.struct(n.alias("chars"))))
    more = F.when(F.col("name") == "lookup", F.to_json(F.struct(F.md5("text").alias("query")))).when(F.col("name") == "write", F.to_json(F.struct((n % 5).alias("lines")))).otherwise(F.lit("{}"))
    # The first members stand after the second ones, so that serialising has keys to put in order.
    join = lambda a, b: F.when(a == "{}", b).when(b == "{}", a).otherwise(F.concat(F.expr("substring(__m, 1, length(__m) - 1)"), F.lit(", "), F.expr("substring(__c, 2)")))
    calls = t.where("role = 'assistant'").select("conv_id", call_id(F.col("turn")).alias("call_id"), "turn", name.alias("name"), "text", chars.alias("__c"))
    calls = calls.withColumn("__m", more).withColumn("arguments", F.when(F.length("text") % 13 == 0, "{broken").otherwise(join(F.col("__m"), F.col("__c"))))
    on = F.array(call_id(F.col("turn") - 2), call_id(F.col("turn") - 4))
    calls = calls.select("conv_id", "call_id", "turn", "name", "arguments", on.alias("depends_on"))
    results = t.select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
