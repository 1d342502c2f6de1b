"""Transactions, accounts and rates derived from the star-schema tables, in SQL that Spark and the oracle both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TXN_CTES = """
b as (
  select l.l_orderkey ok, l.l_linenumber ln, l.l_partkey pk, l.l_suppkey sk, o.o_custkey ck,
         (l.l_orderkey*7919 + l.l_linenumber*104729 + l.l_partkey*31) % 1000003 x,
         (o.o_custkey*389 + l.l_orderkey) % 1000 u, (l.l_partkey*577 + l.l_linenumber) % 1000 v
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey),
g as (select *, (u*u - (u*u) % 1000) / 1000 a0, (v*v - (v*v) % 1000) / 1000 z0 from b),
h as (select *, cast(a0 as bigint) a, cast(z0 as bigint) z from g),
tx as (
select concat('2022/09/', lpad(cast(1 + (ok + ln) % 18 as varchar(9)), 2, '0'), ' ',
              lpad(cast(pk % 24 as varchar(9)), 2, '0'), ':', lpad(cast(ck % 60 as varchar(9)), 2, '0')) ts,
       lpad(cast(a % 25 as varchar(9)), 3, '0') from_bank, concat('A', cast(a as varchar(9))) from_account,
       lpad(cast(z % 25 as varchar(9)), 3, '0') to_bank,   concat('A', cast(z as varchar(9))) to_account,
       cast(x % (case x % 6 when 0 then 100 when 1 then 1000 when 2 then 10000
                            when 3 then 100000 when 4 then 1000000 else 50 end) as double) / 100 amount,
       case (ok + sk) % 8 when 0 then 'Euro' when 1 then 'Yuan' when 2 then 'Bitcoin' when 3 then 'Yen'
                          else 'US Dollar' end currency,
       case (pk + ln) % 6 when 0 then 'Wire' when 1 then 'ACH' when 2 then 'Cheque' when 3 then 'Credit Card'
                          when 4 then 'Cash' else 'Reinvestment' end payment_format,
       cast(ok % 3 as varchar(9)) client_id,
       cast(ok as bigint) order_key, cast(ln as bigint) line_number
from h),
clients as (select distinct client_id from tx),
accounts as (
select client_id, n_name bank_name, lpad(cast(n_nationkey as varchar(9)), 5, '0') bank_id
from nation cross join clients where n_nationkey <> 7),
days as (select distinct cast(replace(substr(ts, 1, 10), '/', '-') as date) as day from tx where substr(ts, 1, 10) <= '2022/09/05'),
rates as (
select day, 'BTC' origin, 'USD' target, cast(19700 + 50 * extract(day from day) as double) rate, 'div' op from days
union all select day, 'EUR', 'USD', cast(1.0 as double), 'mul' from days
union all select day, 'CNY', 'USD', cast(0.14 as double), 'mul' from days
union all select day, 'JPY', 'USD', cast(0.007 as double), 'mul' from days where extract(day from day) <> 3)
"""
TABLES = ("lineitem", "orders", "nation")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables derived above (``tx``, ``accounts``, ``rates``, ``days``, ``clients``)."""
    for t in TABLES:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(f"with {TXN_CTES} select * from {name}")
