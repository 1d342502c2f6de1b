"""Comparison, sampling, idempotent ingest and partitioning helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnflow.functions import normalize_value


def result_diff(expected: DataFrame, actual: DataFrame, keys: list[str], bag: bool = False) -> DataFrame:
    """Rows on one side only, tagged ``missing`` or ``extra``, after values are made comparable."""
    a, b = (x.select(*(normalize_value(k).alias(k) for k in keys), F.lit(n).alias("_n")) for x, n in ((expected, 1), (actual, -1)))
    g = a.unionByName(b).groupBy(*keys)
    if bag:
        out = g.agg(F.sum("_n").alias("_d")).where("_d <> 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.abs("_d").cast("int"))))
    else:
        out = g.agg(F.min("_n").alias("_lo"), F.max("_n").alias("_d")).where("_lo = _d")
    return out.select(*keys, F.when(F.col("_d") > 0, "missing").otherwise("extra").alias("side"))


#: Hexadecimal digits by which one step of ``sample_exact`` tells hashes apart, and rows that may be sorted in one task.
DIGITS, BORDER_ROWS = 3, 10_000


def sample_exact(df: DataFrame, k: int, key: list[str], seed: int = 0) -> DataFrame:
    """``k`` rows, the same for the same seed: those with the smallest hashes of their keys, ties by key.

    A histogram of the hashes' first digits tells at which digits the k-th row stands; that border bin is told apart by
    further digits until its rows are few (or are all of one hash). Rows below the border are just filtered, only
    those at it are sorted. ``df`` is read once for each step and once for the result. Fewer rows than ``k`` all stay; a ``k``
    below 1 and an input without rows are errors.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    hashed = df.withColumn("__hash", F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in key))))
    border, wanted, left = "", k, None
    while left is None or left > BORDER_ROWS and len(border) < 32:
        bins = hashed.where(F.col("__hash").startswith(border)).groupBy(F.substring("__hash", 1, len(border) + DIGITS).alias("b")).agg(F.count("*").alias("n"))
        counts = sorted((r.b, r.n) for r in bins.collect())  # at most 16 ** DIGITS rows
        if left is None and not counts:
            raise ValueError("nothing to sample from")
        if left is None and sum(n for _, n in counts) <= k:
            return df
        for b, n in counts:
            if wanted <= n:
                border, left = b, n
                break
            wanted -= n
    at = hashed.where(F.col("__hash").startswith(border))
    at = at.orderBy("__hash", *key).limit(wanted) if left <= BORDER_ROWS else at.limit(wanted)
    return hashed.where(F.col("__hash") < border).unionByName(at).drop("__hash")


def dedup_ingest(df: DataFrame, batch_id: str = "batch_id", row_index: str = "row_index") -> DataFrame:
    """One row per batch and row index, so a batch that arrives again changes nothing.

    Rows are dealt out by key first, over a number of partitions that isn't reduced: few repeats meet in one task before, so a
    table of all its keys there would take memory for nothing, as would few large tasks behind.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, batch_id, row_index).dropDuplicates([batch_id, row_index])


def repartition_by(df: DataFrame, n: int, *keys: str | Column) -> DataFrame:
    return df.repartition(n, *keys)


def spread(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def tag_client(df: DataFrame, client_id: str) -> DataFrame:
    return df.withColumn("client_id", F.lit(client_id))
