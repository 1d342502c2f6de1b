"""Stored results and payments by client and day, sampling without a large sort, and hubs dealt out."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.test_operators import txn, values
from txnflow.operators import fx, graph, predicates, quality
from txnflow.plans import payments
from txnflow.sources import files, readers, sinks, tables
from txnflow.streaming import streams

U = "US Dollar"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def results(spark, path, query="q1"):
    """Client and account of every stored line."""
    out = f"{path}/results_{query}"
    return sorted((c, x.split(",")[1]) for c in files.client_names(spark, out) for x in _lines(spark, f"{out}/{files.client_folder(spark, c)}"))


def _lines(spark, folder):
    return [r.value for r in spark.read.text(folder).collect()]


def small(spark, *rows):
    return payments.small_payments(txn(spark, *[("2022/09/01", a, "2b", 1.0, U, "Wire", c) for c, a in rows])) if rows else payments.small_payments(txn(spark, ("2022/09/01", "1a", "2b", 99.0, U, "Wire", "0")))


def test_results_replace_their_own_client(spark, tmp_path):
    out = str(tmp_path)
    sinks.write_results(small(spark, ("1", "1a"), ("1", "1b")), out, "q1", ["1"])
    sinks.write_results(small(spark, ("2", "1c")), out, "q1", ["2"])
    assert results(spark, out) == [("1", "1a"), ("1", "1b"), ("2", "1c")]
    sinks.write_results(small(spark, ("1", "1d")), out, "q1", ["1"])
    assert results(spark, out) == [("1", "1d"), ("2", "1c")]
    sinks.write_results(small(spark), out, "q1", ["1"])  # no rows: nothing old stays
    assert results(spark, out) == [("2", "1c")]
    sinks.write_results(small(spark), out, "q1", ["9"])  # never had any
    sinks.write_results(small(spark, ("a/b=*", "1e")), out, "q1")
    sinks.write_results(small(spark), out, "q1", ["a/b=*"])
    assert results(spark, out) == [("2", "1c")]


def test_purge(spark, tmp_path):
    out = str(tmp_path)
    t = txn(spark, *[("2022/09/01", "1a", "2b", 1.0, U, "Wire", c) for c in ("1", "10", "x*")])
    tables.ingest(t, f"{out}/bronze")
    t.write.partitionBy("client_id").parquet(f"{out}/stream/batch=3")
    t.withColumn("bucket", F.lit(4)).write.partitionBy("bucket", "client_id").parquet(f"{out}/state/by_src/batch=0")
    paths = [f"{out}/{x}" for x in ("bronze", "stream", "state", "missing")]
    assert files.purge_client(spark, "1", paths) == 3 and files.purge_client(spark, "1", paths) == 0
    assert not list(tmp_path.rglob("client_id=1")) and len(list(tmp_path.rglob("client_id=10"))) == 3
    assert files.purge_client(spark, "x*", paths) == 3
    assert values(tables.stored_payments(spark, paths[0]), "client_id") == ["10"]


def test_dates_reach_the_scan(spark, tmp_path):
    days = ["2022/09/01 10:00", "2022/9/5 0:1", "2022/09/05", "2022/09/06 00:00", "2022/08/31 23:59", "2021/09/03", "bad", "2022-09-03", "2022/09/03x", None, " 2022/09/03", "+12022/09/03 00:00", "2022/09/31"]
    t = txn(spark, *[(d, "1a", "2b", 1.0, U, "Wire", "0") for d in days])
    tables.ingest(t, str(tmp_path / "by_day"))
    t.write.parquet(str(tmp_path / "plain"))
    by_day, plain = tables.stored_payments(spark, str(tmp_path / "by_day")), spark.read.parquet(str(tmp_path / "plain"))
    conditions = [("in", (date(2022, 9, 5), date(2022, 9, 1))), ("in", (date(2020, 1, 1), date(2022, 9, 5))), ("in", (date(1000, 1, 1), date(9999, 12, 31))), *((op, date(2022, 9, 5)) for op in ("eq", "neq", "lt", "le", "gt", "ge"))]
    for op, value in conditions:
        want = sorted(map(str, values(t.where(predicates.predicate("ts", op, value)), "ts")))
        for df in (by_day, plain):
            got = predicates.where_op(df, "ts", op, value)
            assert sorted(map(str, values(got, "ts"))) == want, (op, value)
            if op != "neq":
                assert ("PartitionFilters: [isnotnull(ts_day" if df is by_day else "StartsWith(ts,2022/09/)" if op == "eq" or op == "in" and value[1].year == 2022 and value[0].year == 2022 else "PushedFilters: [") in plan(got)
                assert "PushedFilters: []" not in plan(got) or df is by_day
    assert "gettimestamp" not in plan(predicates.where_op(by_day, "ts", "ge", date(2022, 9, 5)))  # parsed at ingest alone


def test_payment_queries_prune(spark, tmp_path):
    t = txn(spark, *[(f"2022/09/{d:02} 10:00", "1a", "2b", 1.0, U, "Wire", "0") for d in range(1, 16)])
    tables.ingest(t, str(tmp_path / "t"))
    d = tables.stored_payments(spark, str(tmp_path / "t"))
    rates = spark.createDataFrame([], "day date, origin string, target string, rate double, op string")
    for df in (payments.far_below_baseline(d), payments.micro_count(d, rates), graph.edges(predicates.where_op(payments.usd(d), "ts", "in", (date(2022, 9, 1), date(2022, 9, 5))))):
        scans = [x for x in plan(df).split("\n") if "PartitionFilters" in x]
        assert scans and all("ts_day" in x.split("PartitionFilters")[1].split("PushedFilters")[0] for x in scans)


def test_ingest_replaces_its_clients(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda c, a: txn(spark, ("2022/09/01", a, "2b", 1.0, U, "Wire", c))
    tables.ingest(row("1", "1a").union(row("2", "1b")), path)
    tables.ingest(row("1", "1c").withColumn("ts", F.lit("2022/09/02")), path, ["1"])
    got = sorted((r.client_id, r.from_account) for r in tables.stored_payments(spark, path).collect())
    assert got == [("1", "1c"), ("2", "1b")]
    tables.ingest(row("1", "1d"), path)  # another day of the client
    assert sorted(r.from_account for r in tables.stored_payments(spark, path).collect()) == ["1b", "1c", "1d"]


def test_numeric_columns_reach_the_scan(spark, tmp_path):
    spark.sql("select cast(x as float) f, cast(x as decimal(10,2)) d, cast(x as long) n from values (1.5), (2.25), (3.0), (null) as t(x)").write.parquet(str(tmp_path / "n"))
    d = spark.read.parquet(str(tmp_path / "n"))
    want = {("f", "ge", 2.25): 2, ("f", "eq", 1.5): 1, ("f", "neq", 1.5): 3, ("d", "lt", 2.25): 1, ("d", "eq", 3): 1, ("n", "gt", 1.5): 2, ("n", "le", 2.5): 2, ("n", "lt", 1.5): 1, ("n", "ge", 2.5): 1, ("n", "eq", 1.5): 0, ("n", "neq", 1.5): 4, ("f", "lt", 0.1): 0}
    for (field, op, value), n in want.items():
        got = predicates.where_op(d, field, op, value)
        assert got.count() == n, (field, op, value)
        if op not in ("neq",) and (field, value) != ("n", 1.5):
            assert f"({field}," in plan(got).split("PushedFilters")[1], (field, op, value)
        assert d.where(predicates.predicate(field, op, value)).count() == n


def test_one_rate_a_key(spark):
    rates = spark.createDataFrame([(date(2022, 9, 1), "EUR", "USD", r, op) for r, op in ((3.0, "mul"), (2.0, "mul"), (2.0, "mul"), (None, "div"))], "day date, origin string, target string, rate double, op string")
    d = txn(spark, ("2022/09/01", "1a", "2b", 5.0, "Euro", "Wire", "0"))
    assert [r.amount for r in fx.convert_currency(d, rates).collect()] == [10.0]


def test_sample_equals_a_full_sort(spark, monkeypatch):
    d = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b")).repartition(5)
    ordered = d.orderBy(F.md5(F.concat_ws("|", F.lit("4"), F.col("a").cast("string"), F.col("b").cast("string"))))
    for rows, k in ((10_000, 10), (3, 1), (3, 500), (0, 1234), (3, 2999), (3, 3000), (3, 9999)):
        monkeypatch.setattr(quality, "BORDER_ROWS", rows)
        got = quality.sample_exact(d, k, ["a", "b"], seed=4)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ordered.limit(k).collect()))
    same = spark.range(50).select(F.lit(1).alias("a"))
    monkeypatch.setattr(quality, "BORDER_ROWS", 3)
    assert quality.sample_exact(same, 20, ["a"]).count() == 20  # rows of one hash
    for k, df in ((5, d.where("false")), (0, d)):
        with pytest.raises(ValueError):
            quality.sample_exact(df, k, ["a"])


def test_sample_sorts_no_more_than_the_border(spark):
    """The rows below the border pass no sort and no single task."""
    d = spark.range(200_000).repartition(8)
    out = quality.sample_exact(d, 150_000, ["id"])
    assert out.count() == 150_000
    sizes = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 40_000


def hub_edges(spark, n):
    rows = [("2022/09/01", a, b, 1.0, U, "Wire", "0") for i in range(n) for a, b in ((f"1s{i}", "2m"), ("2m", f"3t{i}"))]
    return graph.weighted_edges(graph.edges(txn(spark, *rows, ("2022/09/01", "1s0", "2m", 1.0, U, "Wire", "0"), ("2022/09/01", "1x", "2y", 1.0, U, "Wire", "0"), ("2022/09/01", "2y", "3z", 1.0, U, "Wire", "0"))))


def test_hubs_are_dealt_out(spark):
    e = hub_edges(spark, 300).cache()
    heavy = graph.hubs(e, e, paths=1_000, block=50).cache()
    assert [(r.mid.account, r.in_blocks, r.out_blocks) for r in heavy.collect()] == [("2m", 6, 6)]
    whole, dealt = graph.two_hop(e, e), graph.two_hop(e, e, heavy)
    key = lambda df: sorted((r.start.account, r.mid.account, r.final.account, r.weight) for r in df.collect())
    assert key(whole) == key(dealt) and len(key(dealt)) == 300 * 300 + 1
    assert sum(r.weight for r in dealt.collect()) == 300 * 301 + 1  # a payment that repeats counts twice
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        most = {}
        for name, df in (("whole", graph.two_hop(e, e)), ("dealt", graph.two_hop(e, e, heavy))):
            most[name] = max(r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
        assert most["whole"] >= 90_000 and most["dealt"] <= 30_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_patterns_with_and_without_hubs(spark, monkeypatch):
    rows = [("2022/09/01", a, b, 1.0, U, "Wire", "0") for i in range(7) for a, b in (("1s", f"2m{i}"), (f"2m{i}", "3t"), *((f"1q{j}", f"2m{i}") for j in range(9)))]
    d = txn(spark, *rows, *rows[:5])
    found = {}
    for limit in (10**6, 3):
        monkeypatch.setattr(graph, "HUB_PATHS", limit)
        monkeypatch.setattr(graph.hubs, "__defaults__", (limit, 2))
        found[limit] = [sorted(map(tuple, graph.scatter_gather(d, multiplicity=m).collect())) for m in ("set", "bag")]
    assert found[3] == found[10**6] and found[3][0]


def test_clients_from_their_folders(spark, tmp_path):
    a = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format\n"
    b = "Payment Format,Timestamp,From Bank,Account,To Bank,Account,Amount Paid,Payment Currency\n"
    for client, text in (("007", a + "2022/09/01 00:08,011,A,02,B,1,Euro,7.25,US Dollar,Wire\n2022/09/01\n"), ("x%20+y", b + "ACH,2022/09/01 00:09,1,C,2,D,9.5,US Dollar\n"), ("none", a)):
        folder = tmp_path / "tx" / f"client_id={client}"
        folder.mkdir(parents=True)
        (folder / "t.csv").write_text(text)
        (tmp_path / "accounts" / f"client_id={client}").mkdir(parents=True)
        (tmp_path / "accounts" / f"client_id={client}" / "a.csv").write_text("Bank Name,Bank ID\nFirst,11\n")
    (tmp_path / "btc.csv").write_text("date,rate\n2022/09/02,20000\n")
    got = readers.read_client_transactions(spark, str(tmp_path / "tx"))
    assert sorted((r.client_id, r.from_account, r.amount) for r in got.collect()) == [("007", "A", 7.25), ("x +y", "C", 9.5)]
    assert sorted(r.client_id for r in readers.read_client_accounts(spark, str(tmp_path / "accounts")).collect()) == ["007", "none", "x +y"]
    out = str(tmp_path / "out")
    sinks.write_results(small(spark, ("none", "1z"), ("other", "1y")), out, "q1")
    payments.run_client_files(spark, str(tmp_path / "tx"), str(tmp_path / "accounts"), str(tmp_path / "btc.csv"), out)
    assert results(spark, out) == [("007", "A"), ("other", "1y"), ("x +y", "C")]
    assert readers.read_client_transactions(spark, str(tmp_path / "nothing")).count() == 0
    (tmp_path / "drop" / "client_id=5").mkdir(parents=True)
    stream = readers.stream_transactions(spark, str(tmp_path / "drop"), clients=True)
    head = "Timestamp,From Bank,Account,To Bank,Account.1,Amount Paid,Payment Currency,Payment Format\n"
    (tmp_path / "drop" / "client_id=5" / "p.csv").write_text(head + "2022/09/01 00:08,011,A,02,B,7.25,US Dollar,Wire\n")
    assert [r.client_id for r in streams.run_append(stream, str(tmp_path / "kept")).collect()] == ["5"]


def test_fan_out_releases_its_input(spark, tmp_path):
    d = txn(spark, ("2022/09/01", "1a", "2b", 1.0, U, "Wire", "7"))
    got = sinks.fan_out(d, {"x": lambda t: t, "y": lambda t: t.where("false")}, str(tmp_path))
    assert {k: v.count() for k, v in got.items()} == {"x": 1, "y": 0} and not d.is_cached
