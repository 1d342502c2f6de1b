"""State of streams: groups of a client's session until its end marker, payments until their bank's name arrives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

#: What is kept of a group: payments, the sum of their values, the largest value; then the carried columns of its row.
KEPT = ("n", "total", "top")


def numbered(kind: str, columns: list[str]) -> list[str]:
    """Names that the state's rows keep on their way through Python, whatever the columns are called."""
    return [f"{kind}{i}" for i in range(len(columns))]


def partial_schema(kinds: dict[str, str], keys: list[str], carry: list[str]) -> StructType:
    own = [*numbered("key", keys), *numbered("carried", carry)]
    fields = {"client_id": "string", **{k: kinds[k] for k in own if k.startswith("key")}, "n": "long", "total": "double", "top": "double", **{k: kinds[k] for k in own if k.startswith("carried")}}
    return StructType.fromDDL(", ".join(f"{k} {v}" for k, v in fields.items()))


def close_groups(schema: StructType, keys: list[str], carry: list[str]) -> StatefulProcessor:
    """Adds payments to the groups of one client's shard, and gives out and forgets them all at an end marker.

    The class is made here, so that it travels to the workers whole: they need not have this package.
    """
    by, carried = numbered("key", keys), numbered("carried", carry)
    # A group without keys still needs a field for its place in the map.
    key_type = StructType([f for f in schema if f.name in by] or [StructField("every", IntegerType())])
    value_type = StructType([f for f in schema if f.name in (*KEPT, *carried)])
    names = schema.names

    def added(p: pd.DataFrame) -> dict[tuple, tuple]:
        """What the payments of one batch add to each group."""
        out = {}
        for group, g in p.groupby(by, dropna=False) if by else [((0,), p)] if len(p) else []:
            g = g.sort_values(["value", *carried], ascending=[False, *[True] * len(carried)], na_position="last")
            first = g.iloc[0]
            top = None if pd.isna(first["value"]) else float(first["value"])
            kept = [None if top is None or pd.isna(first[c]) else first[c] for c in carried]
            out[tuple(None if pd.isna(x) else x for x in group)] = (len(g), float(g["value"].fillna(0.0).sum()), top, *kept)
        return out

    def joined(a: tuple, b: tuple) -> tuple:
        # The larger value, then the smaller carried columns.
        rank = lambda x: (x[2] is None, -(x[2] or 0.0), [(c is None, c) for c in x[3:]])
        return (a[0] + b[0], a[1] + b[1], *min(a, b, key=rank)[2:])

    class CloseGroups(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.groups = handle.getMapState("groups", key_type, value_type)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            ended, found = False, {}
            for p in rows:
                ended |= bool((p.event == "end").any())
                for group, own in added(p[p.event.isna()]).items():
                    found[group] = joined(found[group], own) if group in found else own
            if not ended:
                for group, own in found.items():
                    kept = self.groups.getValue(group) if self.groups.containsKey(group) else None
                    self.groups.updateValue(group, joined(tuple(kept), own) if kept else own)
                return
            for group, kept in self.groups.iterator():
                group, kept = tuple(group), tuple(kept)
                found[group] = joined(kept, found[group]) if group in found else kept
            self.groups.clear()
            if found:
                yield pd.DataFrame([(key[0], *(group if by else ()), *own) for group, own in found.items()], columns=names)

        def close(self) -> None:
            pass

    return CloseGroups()


def merged(partial: DataFrame, op: str, field: str | None, keys: list[str], carry: list[str]) -> DataFrame:
    """The groups that a client's shards gave out together, as ``operators.aggregates.aggregate`` has them."""
    by = [F.col(n).alias(k) for n, k in zip(numbered("key", keys), keys, strict=True)]
    g = partial.groupBy("client_id", *by)
    if op == "count":
        return g.agg(F.sum("n").alias("count"))
    if op == "sum":
        return g.agg(F.sum("total").alias(f"sum_{field}"))
    if op == "avg":
        return g.agg((F.sum("total") / F.sum("n")).alias(f"avg_{field}"))
    if op != "max":
        raise ValueError(f"unknown aggregate {op!r}")
    carried = numbered("carried", carry)
    best = F.min_by(F.struct("top", *carried), F.when(F.col("top").isNotNull(), F.struct((-F.col("top")).alias("v"), *carried))).alias("_row")
    return g.agg(best).select("client_id", *keys, F.col("_row.top").alias(field), *(F.col(f"_row.{n}").alias(c) for n, c in zip(carried, carry, strict=True)))


def name_payments(within: int) -> StatefulProcessor:
    """Names the payments of one client's bank, which wait for an account up to ``within`` microseconds of event time.

    Rows are payments (``at, payload``) or accounts (``account`` true, with ``at, bank_name``). A payment takes the name of the first account
    that came and is within reach of it, and is given out at once; only payments that have found none are state. When the
    watermark has passed all accounts they may find, and also where it has done so before they come, they are given out with a null name.
    Payments without a time don't wait. Accounts are forgotten when twice ``within`` has passed.
    """
    account_type = StructType([StructField("at", LongType()), StructField("bank_name", StringType())])
    waiting_type = StructType([StructField("at", LongType()), StructField("payload", StringType())])

    class NamePayments(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.accounts = handle.getListState("accounts", account_type)
            self.waiting = handle.getListState("waiting", waiting_type)

        def out(self, key, p: pd.DataFrame, name) -> pd.DataFrame:
            return pd.DataFrame({"payload": p.payload, "bank": key[1], "bank_name": name}, columns=["payload", "bank", "bank_name"]).astype(object)

        def named(self, key, p: pd.DataFrame, accounts: list[tuple]) -> tuple[list[pd.DataFrame], pd.DataFrame]:
            """Payments that have found an account, named, and the others."""
            found = []
            for at, name in accounts:
                near = ((p["at"] - at).abs() <= within) | p["at"].isna()
                if near.any():
                    found.append(self.out(key, p[near], name))
                    p = p[~near]
            return found, p

        def wake(self, times: list[int]) -> None:
            """A timer for the first of the times that something is due."""
            if times:
                self.handle.registerTimer(min(times) // 1000 + 1)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            kept = [tuple(a) for a in self.accounts.get()] if self.accounts.exists() else []
            known, left = list(kept), []
            for p in rows:
                if pd.isna(key[0]):
                    continue  # such rows move the watermark alone
                for at, name in sorted((int(a.at), a.bank_name) for a in p[p.account & p["at"].notna()].itertuples()) if p.account.any() else []:
                    # Only one that reaches farther than those before it can name more payments.
                    if at + 2 * within >= passed and (not known or at < min(a[0] for a in known) or at > max(a[0] for a in known)):
                        known.append((at, name))
                found, rest = self.named(key, p[~p.account], known)
                yield from found
                left += [rest] if len(rest) else []
            if len(known) > len(kept):
                self.accounts.put(known)
                self.wake([at + 2 * within for at, _ in known])
                if self.waiting.exists():
                    before = pd.DataFrame([tuple(w) for w in self.waiting.get()], columns=["at", "payload"])
                    found, before = self.named(key, before, known)
                    if found:
                        yield from found
                        self.waiting.put([*before.itertuples(index=False, name=None)]) if len(before) else self.waiting.clear()
            for p in left:
                found, p = self.named(key, p, known)  # an account may have come after them in this batch
                yield from found
                late = p["at"].isna() | (p["at"] + within < passed)
                if late.any():
                    yield self.out(key, p[late], None)
                    p = p[~late]
                if len(p):
                    rows = [(int(at), payload) for at, payload in zip(p["at"], p.payload, strict=True)]
                    self.waiting.appendList(rows)
                    self.wake([at + within for at, _ in rows])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            if self.waiting.exists():
                p = pd.DataFrame([tuple(w) for w in self.waiting.get()], columns=["at", "payload"])
                due = p["at"] + within < passed
                if due.any():
                    yield self.out(key, p[due], None)
                    rest = [*p[~due].itertuples(index=False, name=None)]
                    self.waiting.put(rest) if rest else self.waiting.clear()
                self.wake([int(at) + within for at in p["at"][~due]])
            if self.accounts.exists():
                known = [tuple(a) for a in self.accounts.get()]
                rest = [a for a in known if a[0] + 2 * within >= passed]
                if len(rest) < len(known):
                    self.accounts.put(rest) if rest else self.accounts.clear()
                self.wake([at + 2 * within for at, _ in rest])

        def close(self) -> None:
            pass

    return NamePayments()
