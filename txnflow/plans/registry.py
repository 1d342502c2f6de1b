"""Every operator as a registered query over the derived payments, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnflow import functions as fn
from txnflow.operators import aggregates, fx, graph, hooks, joins, predicates, quality
from txnflow.plans import payments
from txnflow.plans.fixtures import TXN_CTES, derived
from txnflow.schema import BASE_PERIOD, BASELINE_COEF, PROBE_PERIOD, TXN_COLUMNS, TXN_HEADERS
from txnflow.sources import files, readers, sinks, tables
from txnflow.sources.scratch import scratch_dir, stored
from txnflow.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

KEY = "order_key, line_number"
T8 = ", ".join(TXN_COLUMNS)
USD = "currency = 'US Dollar'"
P1 = "substr(ts, 1, 10) between '2022/09/01' and '2022/09/05'"
P2 = "substr(ts, 1, 10) between '2022/09/06' and '2022/09/14'"


def query(name: str, sql: str | None = None, source: str = "tx"):
    """Register a function of (table) or (spark, dir) and its oracle; the derived tables are in scope of ``sql``."""

    def wrap(f):
        QUERIES[name] = (lambda spark, d: f(derived(spark, d, source))) if source else f
        if sql:
            ORACLES[name] = f"with {TXN_CTES} {sql}" if not sql.lstrip().startswith(",") else f"with {TXN_CTES} {sql.lstrip()}"
        return f

    return wrap


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [derived(spark, d, n) for n in names]


# --- sources and sinks -------------------------------------------------------------------------------------------


def _as_source_file(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*(F.col(c).alias(h) for c, h in zip(TXN_COLUMNS, TXN_HEADERS, strict=True)), *more)


@query("scan_transactions", f"select {T8} from tx", source="")
def _(spark, d):
    path = scratch_dir(spark, "scan-transactions")
    _as_source_file(derived(spark, d, "tx")).write.csv(path, header=True)
    return readers.read_transactions(spark, path)


@query("scan_accounts", "select bank_name, case when ltrim(bank_id, '0') = '' then '0' else ltrim(bank_id, '0') end bank_id from accounts", source="")
def _(spark, d):
    path = scratch_dir(spark, "scan-accounts")
    derived(spark, d, "accounts").select(F.col("bank_name").alias("Bank Name"), F.col("bank_id").alias("Bank ID"), F.col("client_id").alias("Owner")).write.csv(path, header=True)
    return readers.read_accounts(spark, path)


@query("scan_btc_rates", "select day, rate from rates where origin = 'BTC'", source="")
def _(spark, d):
    path = scratch_dir(spark, "scan-rates")
    derived(spark, d, "rates").where("origin = 'BTC'").select(F.date_format("day", "yyyy/MM/dd").alias("date"), "rate").write.csv(path, header=True)
    return readers.read_btc_rates(spark, path)


def _client_folders(spark, d, name, select):
    """The derived table as source files in a folder for each client."""
    path = scratch_dir(spark, name)
    select(derived(spark, d, name)).write.partitionBy("client_id").csv(path, header=True)
    return path


@query("scan_client_transactions", f"select {T8}, client_id from tx", source="")
def _(spark, d):
    return readers.read_client_transactions(spark, _client_folders(spark, d, "tx", lambda t: _as_source_file(t, "client_id")))


@query("scan_client_accounts", "select bank_name, case when ltrim(bank_id, '0') = '' then '0' else ltrim(bank_id, '0') end bank_id, client_id from accounts", source="")
def _(spark, d):
    return readers.read_client_accounts(spark, _client_folders(spark, d, "accounts", lambda t: t.select("bank_name", "bank_id", "client_id")))


@query("scan_fiat_rates", "select day, origin, target, rate from rates where op = 'mul'", source="")
def _(spark, d):
    path = scratch_dir(spark, "scan-fiat")
    derived(spark, d, "rates").where("op = 'mul'").select(F.date_format("day", "yyyy/MM/dd").alias("day"), F.lower("origin").alias("origin"), "target", "rate").write.csv(path, header=True)
    return readers.read_fiat_rates(spark, path)


query("tag_client", f"select {KEY}, 'x9' client_id from tx")(lambda t: quality.tag_client(t.select("order_key", "line_number"), "x9"))


@query("sample_exact", f"select {KEY} from tx order by md5(concat('7|', cast(order_key as varchar), '|', cast(line_number as varchar))), {KEY} limit 100")
def _(t):
    return quality.sample_exact(t, 100, ["order_key", "line_number"], seed=7).select("order_key", "line_number")


@query("sink_csv", f"select from_bank, from_account, to_bank, to_account, amount, client_id from tx where {USD} and amount < 50", source="")
def _(spark, d):
    path, small = scratch_dir(spark, "results"), payments.small_payments(derived(spark, d, "tx"))
    for client in ("0", "1", "0", "2"):  # a client's results replace its own alone
        sinks.write_results(small.where(F.col("client_id") == client), path, "q1", [client])
    schema = "from_bank string, from_account string, to_bank string, to_account string, amount double, client_id string"
    return spark.read.schema(schema).csv(f"{path}/results_q1")


@query("fan_out_counts", f"select 'all' consumer, count(*) n from tx where {USD} union all select 'small', count(*) from tx where {USD} and amount < 50")
def _(t):
    parts = sinks.fan_out(payments.usd(t), {"all": lambda df: df, "small": lambda df: predicates.where_op(df, "amount", "lt", 50)}, scratch_dir(t.sparkSession, "fan-out"))
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("consumer"), "n") for name, df in parts.items()]
    return counts[0].unionByName(counts[1])


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    path = scratch_dir(spark, "payments")
    tables.ingest(derived(spark, d, "tx"), path)
    return tables.stored_payments(spark, path), path


@query("purge_client", f"select {KEY}, client_id from tx where client_id <> '1'", source="")
def _(spark, d):
    path = _stored(spark, d)[1]
    for _ in range(2):  # the second time finds nothing
        files.purge_client(spark, "1", [path])
    return tables.stored_payments(spark, path).select("order_key", "line_number", "client_id")


# --- projections and predicates ----------------------------------------------------------------------------------

query("reduce_columns", "select from_bank, amount, client_id from tx")(lambda t: predicates.reduce_columns(t, ["from_bank", "amount"]))
query("filter_drop", f"select {KEY}, amount from tx where {USD}")(lambda t: predicates.drop_filter_field(t.select("order_key", "line_number", "amount", "currency"), "currency", "eq", "US Dollar"))
query("tag_source", f"select {KEY}, 'payments' source from tx")(lambda t: predicates.tag_source(t.select("order_key", "line_number"), "payments"))

FILTERS = {
    "filter_eq": (("currency", "eq", "Euro"), "currency = 'Euro'"),
    "filter_neq": (("amount", "neq", 0.5), "amount is distinct from 0.5"),
    "filter_lt": (("amount", "lt", 50), "amount < 50"),
    "filter_le": (("amount", "le", 50), "amount <= 50"),
    "filter_gt": (("amount", "gt", 5000), "amount > 5000"),
    "filter_ge": (("amount", "ge", 5000.25), "amount >= 5000.25"),
    "filter_contains": (("payment_format", "contains", "i"), "contains(payment_format, 'i')"),
    "filter_startswith": (("payment_format", "startswith", "C"), "starts_with(payment_format, 'C')"),
    "filter_endswith": (("from_account", "endswith", "7"), "ends_with(from_account, '7')"),
    "filter_date_range": (("ts", "in", (date(2022, 9, 9), date(2022, 9, 3))), "substr(ts, 1, 10) between '2022/09/03' and '2022/09/09'"),
    "filter_in_set": (("payment_format", "in", ["Wire", "ACH"]), "payment_format in ('Wire', 'ACH')"),
    "filter_date_cmp": (("ts", "ge", date(2022, 9, 10)), "substr(ts, 1, 10) >= '2022/09/10'"),
}
for _name, (_pred, _sql) in FILTERS.items():
    query(_name, f"select {KEY}, client_id from tx where {_sql}")(lambda t, p=_pred: predicates.where_op(t, *p).select("order_key", "line_number", "client_id"))

# Amount as text that sometimes doesn't parse and sometimes has a decimal comma.
CENTS = "cast(round(amount * 100) as bigint)"
TEXT = f"case when line_number = 1 then 'x1' when line_number = 2 then null when line_number = 3 then concat(cast({CENTS} as varchar(20)), ',5') else cast({CENTS} as varchar(20)) end"
NUMBER = f"case when line_number in (1, 2) then null when line_number = 3 then {CENTS} + 0.5 else {CENTS} end"


def _texts(t: DataFrame) -> DataFrame:
    return t.select("order_key", "line_number", F.expr(TEXT).alias("amount"))


query("drop_malformed", f"select {KEY} from tx where line_number > 2")(lambda t: predicates.drop_malformed(_texts(t)).select("order_key", "line_number"))
query("to_number", f"select {KEY}, cast({NUMBER} as double) v from tx")(lambda t: _texts(t).select("order_key", "line_number", fn.to_number("amount").alias("v")))


@query("completed_clients", f"select {KEY}, client_id from tx where client_id in (select client_id from tx group by 1 having max(order_key) % 3 <> 1)")
def _(t):
    last = t.groupBy("client_id").agg(F.max("order_key").alias("k"))
    events = F.when(F.col("k") % 3 == 1, F.array(F.lit("end"), F.lit("abort"))).otherwise(F.array(F.lit("end")))
    return predicates.completed_clients(t, last.select("client_id", F.explode(events).alias("event"))).select("order_key", "line_number", "client_id")


# --- joins -------------------------------------------------------------------------------------------------------

NORM = "case when ltrim({0}, '0') = '' then '0' else ltrim({0}, '0') end"
NAMES = f", names as (select client_id, {NORM.format('bank_id')} bank_id, min(bank_name) bank_name from accounts group by 1, 2)"
for _how in ("left", "inner"):

    @query(f"bank_name_{_how}", f"{NAMES} select {KEY}, {NORM.format('from_bank')} from_bank, coalesce(bank_name, {NORM.format('from_bank')}) bank_name from tx {_how} join names n on tx.client_id = n.client_id and {NORM.format('from_bank')} = n.bank_id", source="")
    def _(spark, d, how=_how):
        t, a = _t(spark, d, "tx", "accounts")
        return joins.add_bank_name(t, a, how=how).select("order_key", "line_number", "from_bank", "bank_name")


TWO_HOP = f""", e as (select distinct client_id, from_bank fb, from_account fa, to_bank tb, to_account ta from tx where {USD} and {P1}),
od as (select client_id, fb, fa, count(*) n from e group by all having n > 5), idg as (select client_id, tb, ta, count(*) n from e group by all having n > 5),
oe as (select e.* from e join od using (client_id, fb, fa)), ie as (select e.* from e join idg using (client_id, tb, ta)),
hop as (select a.client_id, a.fb, a.fa, b.tb, b.ta, a.tb mb, a.ta ma from oe a join ie b on a.client_id = b.client_id and a.tb = b.fb and a.ta = b.fa where (a.fb, a.fa) <> (b.tb, b.ta))"""


def _edges(t: DataFrame) -> DataFrame:
    return graph.distinct_edges(graph.edges(predicates.where_op(payments.usd(t), "ts", "in", BASE_PERIOD)))


def _pruned(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges by degree of their start and of their end, from payments that are read once."""
    e = stored(_edges(t), "edges")
    return graph.with_degree(e, "src", 5, unique=True), graph.with_degree(e, "dst", 5, unique=True)


def _flat(e: DataFrame, **names: str) -> DataFrame:
    return e.select("client_id", *(F.col(f"{c}.{f}").alias(f"{p}{f[0]}") for c, p in names.items() for f in ("bank", "account")), *(c for c in e.columns if c in ("n", "n_paths", "side")))


query("two_hop_paths", f"{TWO_HOP} select client_id, fb, fa, mb, ma, tb, ta from hop")(lambda t: _flat(graph.two_hop(*_pruned(t)), start="f", mid="m", final="t"))
query("fan_out_edges", f"{TWO_HOP} select client_id, fb, fa, tb, ta from oe")(lambda t: _flat(graph.with_degree(_edges(t), "src", 5), src="f", dst="t"))
query("fan_in_edges", f"{TWO_HOP} select client_id, fb, fa, tb, ta from ie")(lambda t: _flat(graph.with_degree(_edges(t), "dst", 5), src="f", dst="t"))
query("distinct_edges", f"{TWO_HOP} select client_id, fb, fa, tb, ta from e")(lambda t: _flat(_edges(t), src="f", dst="t"))
query("node_degrees", f"{TWO_HOP} select client_id, fb, fa, n from od")(lambda t: _flat(graph.node_degrees(_edges(t), "src", 5), src="f"))
query("path_counts", f"{TWO_HOP} select client_id, fb, fa, tb, ta, count(*) n_paths from hop group by all having n_paths > 5")(lambda t: _flat(graph.path_counts(graph.two_hop(*_pruned(t)), 5), start="f", final="t"))
query("tagged_edges", f"{TWO_HOP} select client_id, fb, fa, tb, ta, 'i' side from ie union all select client_id, fb, fa, tb, ta, 'o' from oe")(lambda t: _flat(graph.tagged_edges(graph.with_degree(_edges(t), "dst", 5), graph.with_degree(_edges(t), "src", 5)), src="f", dst="t"))

# --- aggregates --------------------------------------------------------------------------------------------------

query("agg_max_carry", "select client_id, from_bank, amount, from_account from (select *, row_number() over (partition by client_id, from_bank order by amount desc, from_account) r from tx) where r = 1")(lambda t: aggregates.aggregate(t, "max", "amount", ["from_bank"], ["from_account"]))
query("top1_window", "select client_id, from_bank, amount, from_account from (select *, row_number() over (partition by client_id, from_bank order by amount desc, from_account, order_key, line_number) r from tx) where r = 1")(lambda t: aggregates.top1(t, ["from_bank"], "amount", "from_account", "order_key", "line_number").select("client_id", "from_bank", "amount", "from_account"))
query("agg_avg", "select client_id, payment_format, round(avg(amount), 6) avg_amount from tx group by all")(lambda t: aggregates.aggregate(t, "avg", "amount", ["payment_format"]).withColumn("avg_amount", F.round("avg_amount", 6)))
query("agg_sum", "select client_id, payment_format, round(sum(amount), 2) sum_amount from tx group by all")(lambda t: aggregates.aggregate(t, "sum", "amount", ["payment_format"]).withColumn("sum_amount", F.round("sum_amount", 2)))
query("agg_count", "select client_id, payment_format, count(*) count from tx group by all")(lambda t: aggregates.aggregate(t, "count", key=["payment_format"]))
query("agg_by_client", "select client_id, count(*) count, 'clients' source from tx group by all")(lambda t: aggregates.aggregate(t, "count", tag="clients"))


@query("distinct_banks", f"{NAMES} select client_id, bank_id, bank_name from names", source="accounts")
def _(a):
    return joins.bank_names(a)


@query("result_diff", "select distinct cast(cast(from_bank as int) as varchar) from_bank, payment_format, cast(cast(amount as bigint) as varchar) amount, case when amount < 50 then 'extra' else 'missing' end side from tx where amount = floor(amount) and (amount < 50 or amount > 900)")
def _(t):
    whole = t.where("amount = floor(amount)").select("from_bank", "payment_format", "amount")
    expected, actual = whole.where("amount >= 50"), whole.where("amount <= 900")
    return quality.result_diff(expected, actual, ["from_bank", "payment_format", "amount"])


@query("dedup_ingest", f"select distinct cast(order_key % 50 as bigint) batch_id, order_key * 10 + line_number row_index from tx")
def _(t):
    rows = t.select((F.col("order_key") % 50).alias("batch_id"), (F.col("order_key") * 10 + F.col("line_number")).alias("row_index"))
    return quality.dedup_ingest(rows.unionByName(rows.where("batch_id % 2 = 0")))


# --- scalar functions --------------------------------------------------------------------------------------------

query("normalize_bank_id", f"select {KEY}, {NORM.format('trim(from_bank)')} bank from tx")(lambda t: t.select("order_key", "line_number", fn.normalize_bank_id(F.concat(F.lit(" "), "from_bank", F.lit(" "))).alias("bank")))
query("to_day", f"select {KEY}, case when line_number = 1 then null else cast(replace(substr(ts, 1, 10), '/', '-') as date) end as day from tx")(lambda t: t.select("order_key", "line_number", fn.to_day(F.when(F.col("line_number") == 1, "bad").when(F.col("line_number") == 2, F.substring("ts", 1, 10)).otherwise(F.col("ts"))).alias("day")))
query("day_key", f"select {KEY}, replace(substr(ts, 1, 10), '/', '-') as day from tx")(lambda t: t.select("order_key", "line_number", fn.day_key("ts").alias("day")))
query("currency_code", f"select {KEY}, case currency when 'Euro' then 'EUR' when 'Yuan' then 'CNY' when 'Bitcoin' then 'BTC' when 'Yen' then 'JPY' else 'USD' end code from tx")(lambda t: t.select("order_key", "line_number", fn.currency_code("currency").alias("code")))
query("rate_key", "select replace(substr(ts, 1, 10), '/', '-') || '_' || currency || '_USD' as key, count(*) n from tx group by 1")(lambda t: t.groupBy(fn.rate_key(fn.day_key("ts"), "currency", F.lit("USD")).alias("key")).agg(F.count("*").alias("n")))
query("shard_crc32")(lambda t: t.groupBy(fn.shard_crc32(["client_id", "from_account"], 8, "|").alias("shard")).agg(F.count("*").alias("n")))
MD5 = "0"
for _at in (1, 9, 17, 25):
    MD5 = f"(({MD5}) * {2**32 % 8191} + ('0x' || substr(md5(from_account), {_at}, 8))::bigint) % 8191"
query("shard_md5", f"select from_account, {MD5} shard from (select distinct from_account from tx)")(lambda t: t.select("from_account").distinct().withColumn("shard", fn.shard_md5("from_account", 8191)))
query("shard_counts", f"select ({MD5}) % 4 shard, count(*) n from tx group by 1")(lambda t: quality.repartition_by(t, 8, "from_account").groupBy((fn.shard_md5("from_account", 8191) % 4).alias("shard")).agg(F.count("*").alias("n")))

# --- conversion --------------------------------------------------------------------------------------------------

CONVERTED = f"""conv as (select tx.*, case when currency = 'US Dollar' then amount when op = 'div' then amount / rate when op = 'mul' then amount * rate end usd
from tx left join rates r on cast(replace(substr(ts, 1, 10), '/', '-') as date) = r.day and r.origin = case currency when 'Euro' then 'EUR' when 'Yuan' then 'CNY' when 'Bitcoin' then 'BTC' when 'Yen' then 'JPY' else 'USD' end)"""


@query("fx_convert", f", {CONVERTED} select {KEY}, round(usd, 6) amount, 'US Dollar' was, 'USD' currency from conv where usd is not null and currency = 'US Dollar' union all select {KEY}, round(usd, 6), currency, 'USD' from conv where usd is not null and currency <> 'US Dollar'", source="")
def _(spark, d):
    t, r = _t(spark, d, "tx", "rates")
    return fx.convert_currency(t.withColumn("was", F.col("currency")), r).select("order_key", "line_number", F.round("amount", 6).alias("amount"), "was", "currency")


@query("missing_rates", ", need as (select distinct cast(replace(substr(ts, 1, 10), '/', '-') as date) as day, case currency when 'Euro' then 'EUR' when 'Yuan' then 'CNY' when 'Bitcoin' then 'BTC' else 'JPY' end origin, 'USD' target from tx where currency <> 'US Dollar') select n.day, n.origin, n.target from need n anti join rates r on n.day = r.day and n.origin = r.origin", source="")
def _(spark, d):
    return fx.missing_rates(*_t(spark, d, "tx", "rates"))


# --- extension points --------------------------------------------------------------------------------------------

query("udf_flat_map", "select client_id, from_account account, 'debit' leg, -cast(round(amount * 100) as bigint) cents from tx union all select client_id, to_account, 'credit', cast(round(amount * 100) as bigint) from tx")(hooks.flat_map_legs)
query("udf_finalizer", "select client_id, day, n from (select *, row_number() over (partition by client_id order by n desc, day) r from (select client_id, cast(replace(substr(ts, 1, 10), '/', '-') as date) as day, count(*) n from tx group by all)) where r = 1")(hooks.busiest_day)


@query("udf_cogroup", f"select client_id, cast(sum(case when {P1} then cast(round(amount * 100) as bigint) else 0 end) as bigint) sent, cast(sum(case when {P2} then cast(round(amount * 100) as bigint) else 0 end) as bigint) received from tx group by 1")
def _(t):
    return hooks.sent_and_received(predicates.where_op(t, "ts", "in", BASE_PERIOD), predicates.where_op(t, "ts", "in", PROBE_PERIOD))


# --- the payment queries -----------------------------------------------------------------------------------------

query("q1_small_usd", f"select client_id, from_bank, from_account, to_bank, to_account, amount from tx where {USD} and amount < 50")(payments.small_payments)
BEST = f", best as (select client_id, bank, from_account, amount from (select client_id, {NORM.format('from_bank')} bank, from_account, amount, row_number() over (partition by client_id, {NORM.format('from_bank')} order by amount desc, from_account) r from tx where {USD}) where r = 1)"
for _how, _name in (("left", "q2_bank_max"), ("inner", "q2_bank_max_inner")):

    @query(_name, f"{NAMES}{BEST} select b.client_id, b.bank from_bank, from_account, coalesce(bank_name, b.bank) bank_name, amount from best b {_how} join names n on b.client_id = n.client_id and b.bank = n.bank_id", source="")
    def _(spark, d, how=_how):
        return payments.bank_max(*_t(spark, d, "tx", "accounts"), how=how)


Q3 = f", m as (select client_id, payment_format, avg(amount) mean from tx where {USD} and {P1} group by all) select tx.client_id, from_bank, from_account, tx.payment_format, amount from tx join m using (client_id, payment_format) where {USD} and {P2} and amount < mean * {BASELINE_COEF}"
Q4 = f"{TWO_HOP}, pr as (select client_id, fb, fa, tb, ta, count(*) n from hop group by all having n > 5) select client_id, fb bank, fa account from pr union select client_id, tb, ta from pr"
query("q3_below_baseline", Q3)(payments.far_below_baseline)
query("q4_scatter_gather", Q4)(payments.scatter_gather_accounts)
query("q4_scatter_gather_bag", f""", e as (select client_id, from_bank fb, from_account fa, to_bank tb, to_account ta from tx where {USD} and {P1}),
od as (select client_id, fb, fa, count(distinct (tb, ta)) n from e group by all having n > 5), oe as (select e.* from e join od using (client_id, fb, fa)),
w as (select client_id, fb, fa, tb, ta, count(*) c from oe group by all),
pr as (select a.client_id, a.fb, a.fa, b.tb, b.ta, sum(a.c * b.c) n from w a join w b on a.client_id = b.client_id and a.tb = b.fb and a.ta = b.fa where (a.fb, a.fa) <> (b.tb, b.ta) group by all having n > 5)
select client_id, fb bank, fa account from pr union select client_id, tb, ta from pr""")(lambda t: payments.scatter_gather_accounts(t, multiplicity="bag"))


@query("q5_micro_count", f", {CONVERTED} select client_id, count(*) count from conv where usd < 1 and payment_format in ('Wire', 'ACH') and {P1} group by 1", source="")
def _(spark, d):
    return payments.micro_count(*_t(spark, d, "tx", "rates"))


query("q3_stored", Q3, source="")(lambda spark, d: payments.far_below_baseline(_stored(spark, d)[0]))
query("q4_stored", Q4, source="")(lambda spark, d: payments.scatter_gather_accounts(_stored(spark, d)[0]))

# --- streams -----------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(spark, "arrivals")
    _as_source_file(derived(spark, d, "tx"), "client_id").write.csv(path, header=True)
    return readers.stream_transactions(spark, path)


@query("stream_scan", f"select {T8}, client_id from tx", source="")
def _(spark, d):
    return streams.run_append(_stream(spark, d), scratch_dir(spark, "stream-scan"))


@query("stream_q1", f"select from_bank, from_account, to_bank, to_account, amount, client_id from tx where {USD} and amount < 50", source="")
def _(spark, d):
    kept = streams.stream_filter_project(_stream(spark, d), [("currency", "eq", "US Dollar"), ("amount", "lt", 50)], sinks.LAYOUTS["q1"])
    return streams.run_append(kept, scratch_dir(spark, "stream-q1"))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    """Payments of all clients, and then their end markers."""
    path, t = scratch_dir(spark, "sessions"), derived(spark, d, "tx")
    _as_source_file(t, "client_id", F.lit(None).cast("string").alias("event")).write.csv(path, header=True)
    ends = t.select("client_id").distinct().select(*(F.lit(None).cast("string").alias(h) for h in TXN_HEADERS), "client_id", F.lit("end").alias("event"))
    ends.write.mode("append").csv(path, header=True)
    return readers.stream_sessions(spark, path)


@query("stream_agg", "select client_id, payment_format, count(*) count from tx group by all", source="")
def _(spark, d):
    return streams.stream_aggregate(_sessions(spark, d), "count", None, ["payment_format"], scratch_dir(spark, "stream-agg"))


@query("stream_agg_max", "select client_id, from_bank, amount, from_account from (select *, row_number() over (partition by client_id, from_bank order by amount desc, from_account) r from tx) where r = 1", source="")
def _(spark, d):
    return streams.stream_aggregate(_sessions(spark, d), "max", "amount", ["from_bank"], scratch_dir(spark, "stream-max"), ["from_account"])


def _arrivals(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A table as a stream with its rows' ``arrived`` time, and a last row that only moves the clock."""
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    last = df.limit(0).unionByName(spark.range(1).select(*(F.lit("2022-12-31").cast("timestamp").alias(c) if c == "arrived" else F.lit(None).cast(k).alias(c) for c, k in df.dtypes)))
    last.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(path)


@query("stream_bank_names", f"{NAMES} select tx.client_id, {NORM.format('from_bank')} from_bank, from_account, amount, coalesce(bank_name, {NORM.format('from_bank')}) bank_name from tx left join names n on tx.client_id = n.client_id and {NORM.format('from_bank')} = n.bank_id", source="")
def _(spark, d):
    t, a = _t(spark, d, "tx", "accounts")
    came = _arrivals(spark, t.select("client_id", "from_bank", "from_account", "amount", fn.to_timestamp("ts").alias("arrived")), "payments")
    late = _arrivals(spark, a.withColumn("arrived", F.lit("2022-09-09").cast("timestamp")), "accounts")
    named = streams.stream_bank_names(came, late, "arrived", "1 day", "30 days")
    return streams.run_append(named.drop("arrived"), scratch_dir(spark, "stream-names"))


@query("stream_dedup", "select distinct cast(order_key % 50 as bigint) batch_id, order_key * 10 + line_number row_index from tx", source="")
def _(spark, d):
    t = derived(spark, d, "tx").select((F.col("order_key") % 50).alias("batch_id"), (F.col("order_key") * 10 + F.col("line_number")).alias("row_index"), F.lit("2022-09-09").cast("timestamp").alias("arrived"))
    twice = _arrivals(spark, t.unionByName(t.where("batch_id % 2 = 0")), "batches").where("batch_id is not null")
    return streams.run_append(streams.stream_dedup(twice, "arrived", "1 day"), scratch_dir(spark, "stream-dedup")).drop("arrived")


@query("stream_fan_out", f"select 'q1' consumer, count(*) n from tx where {USD} and amount < 50 union all select 'wires', count(*) from tx where payment_format = 'Wire'", source="")
def _(spark, d):
    parts = streams.fan_out_stream(_stream(spark, d), {"q1": payments.small_payments, "wires": lambda t: predicates.where_op(t, "payment_format", "eq", "Wire")}, scratch_dir(spark, "stream-fan-out"))
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("consumer"), "n") for name, df in parts.items()]
    return counts[0].unionByName(counts[1])


@query("stream_bank_name", f"{NAMES} select tx.client_id, {NORM.format('from_bank')} from_bank, from_account, amount, coalesce(bank_name, {NORM.format('from_bank')}) bank_name from tx left join names n on tx.client_id = n.client_id and {NORM.format('from_bank')} = n.bank_id", source="")
def _(spark, d):
    named = streams.stream_add_bank_name(_stream(spark, d), derived(spark, d, "accounts")).select("client_id", "from_bank", "from_account", "amount", "bank_name")
    return streams.run_append(named, scratch_dir(spark, "stream-bank"))


@query("stream_q3", Q3, source="")
def _(spark, d):
    found = streams.stream_below_baseline(payments.usd(_stream(spark, d)), BASE_PERIOD, PROBE_PERIOD, ["payment_format"], BASELINE_COEF, scratch_dir(spark, "stream-q3"))
    return sinks.result_columns(found, "q3")


@query("stream_q4", Q4, source="")
def _(spark, d):
    kept = predicates.where_op(payments.usd(_stream(spark, d)), "ts", "in", BASE_PERIOD)
    return streams.stream_two_hop(kept, 5, scratch_dir(spark, "stream-q4"))
