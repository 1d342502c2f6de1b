"""Streams over arriving files: sessions closed by markers, late accounts, repeats, several consumers, restarts."""

import itertools

import pytest
from pyspark.sql import functions as F

from txnflow.operators import aggregates, graph
from txnflow.plans import payments
from txnflow.schema import TXN_HEADERS
from txnflow.sources import files, readers
from txnflow.streaming import streams

U = "US Dollar"
HEAD = ",".join([*TXN_HEADERS, "client_id"])


@pytest.fixture
def runs(monkeypatch):
    """The queries that streams have run, for their progress."""
    seen, finish = [], streams._finish
    monkeypatch.setattr(streams, "_finish", lambda w: seen.append(finish(w)) or seen[-1])
    return seen


class Drop:
    """A folder in which files arrive one after the other."""

    def __init__(self, path, event=False):
        self.path, self.n, self.event = path, itertools.count(), event
        path.mkdir()

    def add(self, *rows):
        """Rows as (day, from, to, amount, format, client) or (client, event)."""
        lines = [HEAD + ",event" * self.event]
        for r in rows:
            if len(r) == 2:
                lines.append("," * 8 + f"{r[0]},{r[1]}")
            else:
                t, a, b, x, p, k = r
                lines.append(f"2022/09/{t:02} 10:00,0{a[0]},{a},0{b[0]},{b},{x},{U},{p},{k}" + "," * self.event)
        (self.path / f"f{next(self.n):03}.csv").write_text("\n".join(lines) + "\n")


def groups(df):
    return sorted(map(tuple, df.collect()))


def state_rows(q):
    last = [p for p in q.recentProgress if p.stateOperators]
    return last[-1].stateOperators[0].numRowsTotal


def test_groups_close_at_the_marker(spark, tmp_path, runs):
    drop, out = Drop(tmp_path / "in", event=True), str(tmp_path / "out")
    run = lambda: streams.stream_aggregate(readers.stream_sessions(spark, str(tmp_path / "in"), 1), "count", None, ["payment_format"], out)
    drop.add((1, "1a", "2b", 1, "Wire", "A"), (1, "1a", "2b", 2, "ACH", "A"), (1, "1c", "2b", 3, "Wire", "B"))
    assert groups(run()) == []
    held = state_rows(runs[-1])
    assert held > 0
    drop.add((2, "1a", "2b", 5, "Wire", "A"), ("A", "end"))
    assert groups(run()) == [("A", "ACH", 1), ("A", "Wire", 2)]
    assert 0 < state_rows(runs[-1]) < held  # the state of A is gone, that of B stays
    drop.add((2, "1c", "2b", 5, "Wire", "B"), (2, "1c", "2b", "x", "Wire", "B"))
    drop.add(("B", "end"))
    assert groups(run()) == [("A", "ACH", 1), ("A", "Wire", 2), ("B", "Wire", 2)]
    assert state_rows(runs[-1]) == 0
    assert groups(run()) == [("A", "ACH", 1), ("A", "Wire", 2), ("B", "Wire", 2)]  # a restart without news
    assert files.purge_client(spark, "A", [out]) >= 1 and {r.client_id for r in spark.read.parquet(out).collect()} == {"B"}


def test_a_batch_that_runs_again_gives_each_group_once(spark, tmp_path, monkeypatch):
    drop, out = Drop(tmp_path / "in", event=True), str(tmp_path / "out")
    drop.add((1, "1a", "2b", 1, "Wire", "A"), ("A", "end"))
    run = lambda: streams.stream_aggregate(readers.stream_sessions(spark, str(tmp_path / "in")), "sum", "amount", [], out)
    write, calls = streams.write_batch, []

    def breaks(df, *a):
        write(df, *a)
        if not calls:
            calls.append(1)
            raise RuntimeError("lost after the write")

    monkeypatch.setattr(streams, "write_batch", breaks)
    with pytest.raises(Exception, match="lost after the write"):
        run()
    assert groups(run()) == [("A", 1.0)]


def test_session_aggregates_are_those_of_a_table(spark, tmp_path):
    drop = Drop(tmp_path / "in", event=True)
    rows = [(1 + i % 9, f"{1 + i % 2}a{i % 5}", "2b", (i * 37) % 50, "Wire", "AB"[i % 2]) for i in range(60)]
    for part in (rows[:20], rows[20:40], rows[40:]):
        drop.add(*part)
    drop.add(("A", "end"), ("B", "end"))
    table = readers.stream_sessions(spark, str(tmp_path / "in"), 1)
    whole = spark.createDataFrame([(f"0{a[0]}", a, float(x), k) for _, a, _, x, _, k in rows], "from_bank string, from_account string, amount double, client_id string")
    for op, field, key, carry in (("max", "amount", ["from_bank"], ["from_account"]), ("avg", "amount", [], []), ("sum", "amount", ["from_account"], []), ("count", None, ["from_bank", "from_account"], [])):
        got = streams.stream_aggregate(table, op, field, key, str(tmp_path / op), carry, shards=3)
        assert groups(got) == groups(aggregates.aggregate(whole, op, field, key, carry).select(got.columns)), op


@pytest.mark.parametrize("first", ["payments", "accounts"])
def test_names_in_either_order_of_arrival(spark, tmp_path, runs, first):
    def put(name, n, rows, schema):
        spark.createDataFrame(rows, schema).selectExpr("*", "cast(at as timestamp) arrived").drop("at").coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    p, a = "client_id string, from_bank string, amount double, at string", "client_id string, bank_id string, bank_name string, at string"
    pay = [("0", "011", float(i), "2022-09-03") for i in range(20)] + [("0", "7", 1.0, "2022-09-03"), ("1", "11", 2.0, "2022-09-03")]
    acc = [("0", "0011", "First", "2022-09-05"), ("0", "11", "First", "2022-09-05"), ("1", "5", "Other", "2022-09-05")]
    late = "2022-12-31"
    put("payments", 0, pay if first == "payments" else [], p)
    put("accounts", 0, acc if first == "accounts" else [], a)
    stream = lambda n: spark.readStream.schema(spark.read.parquet(str(tmp_path / n)).schema).parquet(str(tmp_path / n))
    run = lambda: streams.run_append(streams.stream_bank_names(stream("payments"), stream("accounts"), "arrived", "1 day", "30 days"), str(tmp_path / "out")).select("client_id", "from_bank", "amount", "bank_name")
    assert groups(run()) == []
    put("payments", 1, pay if first == "accounts" else [], p)
    put("accounts", 1, acc if first == "payments" else [], a)
    named = [("0", "11", float(i), "First") for i in range(20)]
    assert groups(run()) == named  # the rest still waits
    put("payments", 2, [(None, None, None, late)], p)
    put("accounts", 2, [(None, None, None, late)], a)
    assert groups(run()) == sorted([*named, ("0", "7", 1.0, "7"), ("1", "11", 2.0, "11")])


def test_payments_behind_the_watermark_are_named(spark, tmp_path):
    """Files whose payments are days older than those of the files before them, named or not, known or waiting."""
    schema = "client_id string, from_bank string, amount long, more timestamp, arrived timestamp"

    def put(name, rows, schema):
        spark.createDataFrame(rows, ", ".join(c.replace("timestamp", "string") for c in schema.split(", "))).select(*(F.expr(f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}") for c in schema.split(", "))).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    for n, day in enumerate((18, 3, 17, 1)):
        put("payments", [("0", "011", n, "2022-09-01 10:00:00.123456", f"2022-09-{day:02}"), ("0", "5", 2**60 + n, None, f"2022-09-{day:02}")], schema)
    put("payments", [("0", "11", 100, None, None)], schema)
    put("payments", [("0", "5", 7, None, "2022-07-01")], schema)  # behind all accounts that it may find
    put("payments", [(None, None, None, None, "2022-12-31")], schema)
    account = "client_id string, bank_id string, bank_name string, arrived timestamp"
    put("accounts", [("0", "0011", "First", "2022-09-09")], account)
    put("accounts", [("0", "11", "Second", "2022-09-11"), (None, None, None, "2022-12-31")], account)
    stream = lambda n, s: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n))
    named = streams.stream_bank_names(stream("payments", schema), stream("accounts", account), "arrived", "1 day", "30 days")
    got = streams.run_append(named, str(tmp_path / "out"))
    assert got.columns == ["client_id", "from_bank", "amount", "more", "arrived", "bank_name"]
    want = [(n, "First") for n in range(4)] + [(100, "First"), (7, "5")] + [(2**60 + n, "5") for n in range(4)]
    assert groups(got.select("amount", "bank_name")) == sorted(want)
    assert got.where("bank_name = 'First' and amount < 4 and more = timestamp'2022-09-01 10:00:00.123456'").count() == 4


def test_repeats_across_a_restart(spark, tmp_path, runs):
    def put(rows):
        spark.createDataFrame(rows, "batch_id string, row_index long, at string").selectExpr("*", "cast(at as timestamp) arrived").drop("at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    batch = lambda b, day: [(b, i, f"2022-09-{day:02}") for i in range(5)]
    put(batch("x", 1) + batch("x", 1))
    run = lambda: streams.run_append(streams.stream_dedup(spark.readStream.schema("batch_id string, row_index long, arrived timestamp").parquet(str(tmp_path / "in")), "arrived", "2 days"), str(tmp_path / "out")).count()
    assert run() == 5
    put(batch("x", 2) + batch("y", 2))
    assert run() == 10
    for day in (10, 20, 28):
        put(batch(f"d{day}", day))
        run()
    assert state_rows(runs[-1]) <= 10 and run() == 25  # what is older than the delay is forgotten


def test_consumers_share_one_read(spark, tmp_path, runs):
    drop, out = Drop(tmp_path / "in"), str(tmp_path / "out")
    drop.add(*[(1, "1a", "2b", i, "Wire", "A") for i in range(30)], *[(1, "1a", "2b", 100 + i, "ACH", "B") for i in range(10)])
    failing = [True]

    def second(df):
        if failing and not df.isStreaming:
            failing.pop()
            raise RuntimeError("lost between two consumers")
        return df.where("payment_format = 'ACH'")

    run = lambda: streams.fan_out_stream(readers.stream_transactions(spark, str(tmp_path / "in")), {"small": payments.small_payments, "ach": second, "none": lambda df: df.where("false")}, out)
    with pytest.raises(Exception, match="lost between"):
        run()
    got = run()
    assert {k: v.count() for k, v in got.items()} == {"small": 30, "ach": 10, "none": 0}
    assert sum(p.numInputRows for p in runs[-1].recentProgress) == 40  # read once for all consumers
    drop.add((2, "1a", "2b", 7, "ACH", "A"))
    assert {k: v.count() for k, v in run().items()} == {"small": 31, "ach": 11, "none": 0}


def pattern(n=7):
    """Two clients; in one, six or more ways lead from 1s to 3t and to 3u; some payments repeat, one goes to its sender."""
    rows = [(1, a, b, 1, "Wire", "A") for i in range(n) for a, b in (("1s", f"2m{i}"), (f"2m{i}", "3t"), (f"2m{i}", "3u"), (f"3u", f"2m{i}"))]
    return rows + rows[:9] + [(1, "1s", "1s", 1, "Wire", "A"), (1, "1s", "3t", 1, "Wire", "A")] + [(1, a, b, 1, "Wire", "B") for i in range(4) for a, b in (("1s", f"2m{i}"), (f"2m{i}", "3t"))]


@pytest.mark.parametrize("sizes", [[60], [1, 9, 2, 20, 5, 60], [12, 12, 12, 12, 60]])
def test_two_hops_batch_by_batch(spark, tmp_path, sizes):
    rows, drop = pattern(), Drop(tmp_path / "in")
    order = sorted(range(len(rows)), key=lambda i: (i * 29) % len(rows))
    stream, at = readers.stream_transactions(spark, str(tmp_path / "in"), 1), 0
    for n in sizes:
        if part := [rows[i] for i in order[at : at + n]]:
            drop.add(*part)
        at += n
    got = streams.stream_two_hop(stream, 3, str(tmp_path / "paths"))
    whole = readers.stream_transactions(spark, str(tmp_path / "in")).schema
    table = spark.createDataFrame([(f"2022/09/{t:02} 10:00", f"0{a[0]}", a, f"0{b[0]}", b, float(x), U, p, k) for t, a, b, x, p, k in rows], whole)
    assert groups(got) == groups(graph.scatter_gather(table, 3)) and groups(got)


def test_two_hop_work_follows_the_batch(spark, tmp_path):
    folder = str(tmp_path / "paths")
    payment = lambda a, b: (f"2022/09/01", f"0{a[0]}", a, f"0{b[0]}", b, 1.0, U, "Wire", "A")
    schema = "ts string, from_bank string, from_account string, to_bank string, to_account string, amount double, currency string, payment_format string, client_id string"
    big = spark.createDataFrame([payment(f"1s{i}", f"2m{j}") for i in range(30) for j in range(20)] + [payment(f"2m{j}", f"3t{k}") for j in range(20) for k in range(30)], schema)
    streams.add_two_hop_batch(big, 0, folder)
    small = spark.createDataFrame([payment("1s0", "2m0"), payment("9z", "2m3")], schema)  # one edge known, one new
    for _ in range(2):  # a batch that runs again
        streams.add_two_hop_batch(small, 1, folder)
    added = streams.read_batches(spark, f"{folder}/pairs").where("batch = 1")
    assert added.count() == 30 and added.agg(F.sum("n_paths")).first()[0] == 30
    assert streams.read_batches(spark, f"{folder}/by_src").where("batch = 1").count() == 1
    assert streams.two_hop_pairs(spark, folder, 19).count() == 900
    for side in ("src", "dst"):  # one file a bucket and client, however many tasks made the edges
        made = list((tmp_path / "paths" / f"by_{side}" / "batch=0").rglob("*.parquet"))
        assert len(made) == len({f.parent for f in made})
    assert files.purge_client(spark, "A", [folder]) > 0 and not list(tmp_path.rglob("client_id=A"))
