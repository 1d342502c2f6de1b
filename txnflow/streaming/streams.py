"""Bounded streams: each runs over what has arrived (``availableNow``) and keeps its state in a checkpoint.

Outputs of micro-batches lie in folders named by batch and client: a batch that runs again after a failure replaces
itself, and ``sources.files.purge_client`` takes one client out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from txnflow.functions import normalize_bank_id, to_number
from txnflow.operators.aggregates import aggregate
from txnflow.operators.graph import distinct_edges, edges, endpoints, hop_counts
from txnflow.operators.joins import add_bank_name, below_group_baseline
from txnflow.operators.predicates import predicate, reduce_columns
from txnflow.sources.files import file_names, read_clients
from txnflow.streaming.sessions import close_groups, merged, name_payments, numbered, partial_schema

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Shards that a client's state is dealt over, and copies of an account for the payments of one bank.
SHARDS = 8
#: Folders by node that stored edges are dealt over.
BUCKETS = 16


def run_append(stream: DataFrame, out: str) -> DataFrame:
    """Append a stream to Parquet until its input is used up; returns what was written."""
    with _rocksdb(stream.sparkSession):
        _finish(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}.checkpoint"))
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def _finish(writer) -> StreamingQuery:
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB for queries started inside; a query keeps the setting it started with."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


@contextmanager
def _adaptive(spark: SparkSession) -> Iterator[None]:
    """Adaptive plans for the tables of a micro-batch; a stream's session has them switched off."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def write_batch(df: DataFrame, out: str, batch_id: int, *by: str) -> None:
    """The rows of a micro-batch in its own folder, in place of what an earlier try left there."""
    by = (*by, *(["client_id"] if "client_id" in df.columns else []))
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{out}/batch={batch_id}")


def read_batches(spark: SparkSession, out: str, schema=None) -> DataFrame:
    """All batches written to ``out``; with ``schema`` an output without any is an empty table."""
    if schema is not None and not any(n.startswith("batch=") and file_names(spark, f"{out}/{n}") - {"_SUCCESS"} for n in file_names(spark, out)):
        return spark.createDataFrame([], schema)
    return read_clients(spark, out, schema)


def run_batches(stream: DataFrame, out: str, f: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``f`` of each micro-batch, written under its batch id; returns all that was written."""
    _finish(stream.writeStream.foreachBatch(lambda df, n: write_batch(f(df), out, n)).option("checkpointLocation", f"{out}.checkpoint"))
    schema = f(stream).schema
    return read_batches(stream.sparkSession, out, schema).select(schema.names)


def fan_out_stream(stream: DataFrame, consumers: dict[str, Callable[[DataFrame], DataFrame]], out: str) -> dict[str, DataFrame]:
    """Several consumers of one stream: a micro-batch is read once, kept for all consumers, and released.

    A consumer's rows go to the folder of its name under ``out``, by batch id: a batch that broke off between two consumers
    runs again for all of them and leaves each row once.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        shared = df.persist()
        try:
            for name, f in consumers.items():
                write_batch(f(shared), f"{out}/{name}", batch_id)
        finally:
            shared.unpersist()

    _finish(stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}.checkpoint"))
    schemas = {name: f(stream).schema for name, f in consumers.items()}
    return {name: read_batches(stream.sparkSession, f"{out}/{name}", s).select(s.names) for name, s in schemas.items()}


def stream_filter_project(stream: DataFrame, preds: list[tuple], cols: list[str]) -> DataFrame:
    for p in preds:
        stream = stream.where(predicate(*p))
    return reduce_columns(stream, cols)


def stream_dedup(stream: DataFrame, time: str, delay: str, batch_id: str = "batch_id", row_index: str = "row_index") -> DataFrame:
    """One row per batch and row index, for repeats that arrive within ``delay`` of the first by ``time``.

    Keys seen are state, so they outlast a restart; those older than the delay are forgotten, so the state stays bounded.
    """
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([batch_id, row_index])


def stream_aggregate(stream: DataFrame, op: str, field: str | None, key: list[str], out: str, carry: list[str] = (), shards: int = SHARDS) -> DataFrame:
    """Groups of each client, given out when its end marker arrives (``event = 'end'``), after which its state is gone.

    ``stream`` has payments and markers as ``readers.stream_sessions`` gives them. A client's payments are dealt over
    ``shards`` states by their contents, so neither a large client nor a common key meets in one task; its marker goes to
    all of them, and what they give out in that micro-batch is merged there. Aggregates are those of ``aggregate``.
    Payments after a marker open a new session. Clients without a marker are open and have no rows yet.
    """
    keys = [k for k in key if k != "client_id"]
    value = to_number(field) if field else F.lit(None).cast("double")
    named = [F.col(c).alias(n) for c, n in zip([*keys, *carry], [*numbered("key", keys), *numbered("carried", carry)], strict=True)]
    rows = stream.select("client_id", "event", *named, value.alias("value"), F.xxhash64(*stream.columns).alias("hash"))
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    rows = rows.withColumn("shard", F.explode(F.when(F.col("event") == "end", every).otherwise(F.array(F.pmod("hash", F.lit(shards)).cast("int"))))).drop("hash")
    schema = partial_schema({f.name: f.dataType.simpleString() for f in rows.schema.fields}, keys, carry)
    partial = rows.groupBy("client_id", "shard").transformWithStateInPandas(close_groups(schema, keys, carry), schema, "append", "none")
    final = lambda df: merged(df, op, field, keys, carry)
    with _rocksdb(stream.sparkSession):
        return run_batches(partial, out, final)


def stream_add_bank_name(stream: DataFrame, accounts: DataFrame) -> DataFrame:
    """Names from a table of accounts that is complete before the payments arrive."""
    return add_bank_name(stream, accounts)


def stream_bank_names(payments: DataFrame, accounts: DataFrame, time: str, delay: str, within: str, bank: str = "from_bank", copies: int = SHARDS) -> DataFrame:
    """Payments with the names of their banks, where both arrive as streams with an event time, in either order.

    A payment waits for an account of its client and bank up to ``within`` before or after its own time; when the
    watermark has passed that, its bank keeps its id as its name. No payment is dropped for coming late: one behind the
    watermark is named if its account is known, waits if one may still come, and else keeps its bank's id. Only payments that wait are state. The first name
    of a bank counts, accounts that repeat it do nothing. Payments of a bank are dealt over ``copies`` keys, to which its account is copied. Rows
    of either stream without a client only move the watermark: one of each, later than all others by ``within`` and ``delay``,
    ends the session.
    """
    # The time that goes on is a number, so that Spark doesn't know it as event time and drop what comes late.
    a = accounts.select("client_id", normalize_bank_id("bank_id").alias("bank"), "bank_name", F.col(time).alias("_at")).withWatermark("_at", delay)
    a = a.select("client_id", "bank", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(True).alias("account"), F.unix_micros("_at").alias("at"), F.lit(None).cast("string").alias("payload"), "bank_name")
    # Payments go through as JSON text, so that no type of theirs changes on the way.
    written = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    payload, copy = F.to_json(F.struct(*payments.columns), written), F.pmod(F.xxhash64(*payments.columns), F.lit(copies)).cast("int")
    p = payments.withWatermark(time, delay).select("client_id", normalize_bank_id(bank).alias("bank"), copy.alias("copy"), F.lit(False).alias("account"), F.unix_micros(time).alias("at"), payload.alias("payload"), F.lit(None).cast("string").alias("bank_name"))
    micros = int(accounts.sparkSession.sql(f"select unix_micros(timestamp_micros(0) + interval {within})").first()[0])
    named = p.unionByName(a).groupBy("client_id", "bank", "copy").transformWithStateInPandas(name_payments(micros), "payload string, bank string, bank_name string", "append", "eventTime")
    row = F.from_json("payload", payments.schema, written)
    own = {bank: F.col("bank")}
    return named.select(row.alias("row"), "bank", "bank_name").select(*(own.get(c, F.col("row")[c]).alias(c) for c in payments.columns), F.coalesce("bank_name", "bank").alias("bank_name"))


def stream_below_baseline(stream: DataFrame, base: tuple, probe: tuple, key: list[str], coef: float, bronze: str) -> DataFrame:
    """Rows wait in a bronze table until the means of the first period are complete, then are compared."""
    kept = run_batches(stream.where(predicate("ts", "in", base) | predicate("ts", "in", probe)), bronze)
    mean = aggregate(kept.where(predicate("ts", "in", base)), "avg", "amount", key)
    return below_group_baseline(kept.where(predicate("ts", "in", probe)), mean, ["client_id", *key], "amount", "avg_amount", coef)


_EDGE = "client_id string, src struct<bank: string, account: string>, dst struct<bank: string, account: string>"
_PAIR = "client_id string, start struct<bank: string, account: string>, final struct<bank: string, account: string>, n_paths long"


def _bucket(node: str):
    return F.pmod(F.xxhash64(node), F.lit(BUCKETS)).cast("int").alias("bucket")


def add_two_hop_batch(payments: DataFrame, batch_id: int, folder: str) -> None:
    """Bring the edges and the path counts under ``folder`` up to date with one batch of payments.

    New edges are those of the batch that no earlier batch had. The paths they make are new edges before stored ones,
    stored ones before new ones, and new ones before new ones; their numbers by pair of ends are the batch's addition to the
    counts. Edges are stored twice, by the bucket of either end, and only the buckets that the batch's edges touch are
    read. Only batches before this one are read, so a batch that runs again has the same result.
    """
    spark = payments.sparkSession

    def read(side: str) -> DataFrame:
        return read_batches(spark, f"{folder}/by_{side}", f"{_EDGE}, batch int, bucket int")

    def earlier(side: str, touched: list[int]) -> DataFrame:
        return read(side).where((F.col("batch") < batch_id) & F.col("bucket").isin(touched)).select("client_id", "src", "dst")

    def buckets(df: DataFrame, side: str) -> list[int]:
        return [r[0] for r in df.select(_bucket(side)).distinct().collect()]  # at most BUCKETS

    with _adaptive(spark):
        came = distinct_edges(edges(payments)).persist()
        try:
            new = came.join(earlier("src", buckets(came, "src")), ["client_id", "src", "dst"], "left_anti")
            for side in ("src", "dst"):
                # Dealt out by bucket, so that a bucket gets one file a client and not one from each task.
                write_batch(new.withColumn("bucket", _bucket(side)).repartition(BUCKETS, "bucket"), f"{folder}/by_{side}", batch_id, "bucket")
                new = read("src").where(F.col("batch") == batch_id).select("client_id", "src", "dst")
            before, after = earlier("dst", buckets(new, "src")), earlier("src", buckets(new, "dst"))
            # Stored edges that no new one continues would only be numbered in vain.
            before = before.join(new.select("client_id", F.col("src").alias("dst")).distinct(), ["client_id", "dst"], "left_semi").select("client_id", "src", "dst")
            after = after.join(new.select("client_id", F.col("dst").alias("src")).distinct(), ["client_id", "src"], "left_semi").select("client_id", "src", "dst")
            write_batch(hop_counts([(new, after), (before, new), (new, new)]), f"{folder}/pairs", batch_id)
        finally:
            came.unpersist()


def two_hop_pairs(spark: SparkSession, folder: str, k: int) -> DataFrame:
    """Pairs of ends with more than ``k`` two-hop paths, from the counts that the batches added."""
    added = read_batches(spark, f"{folder}/pairs", f"{_PAIR}, batch int")
    return added.groupBy("client_id", "start", "final").agg(F.sum("n_paths").alias("n_paths")).where(F.col("n_paths") > k)


def stream_two_hop(stream: DataFrame, k: int, folder: str) -> DataFrame:
    """Accounts at either end of more than ``k`` two-hop paths, kept up batch by batch."""
    _finish(stream.writeStream.foreachBatch(lambda df, n: add_two_hop_batch(df, n, folder)).option("checkpointLocation", f"{folder}.checkpoint"))
    return endpoints(two_hop_pairs(stream.sparkSession, folder, k))
