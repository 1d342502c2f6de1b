"""Two-hop payment patterns. A node is a struct of bank and account."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.sources.scratch import stored

#: Paths through one middle node above which it is a hub, and edges in a block of a hub's.
HUB_PATHS, HUB_BLOCK = 1_000_000, 1_000
#: Hubs are broadcast up to so many, else joined by shuffle.
BROADCAST_HUBS = 10_000


def edges(txns: DataFrame) -> DataFrame:
    """Directed payment edges, repeats kept."""
    node = lambda side: F.struct(F.col(f"{side}_bank").alias("bank"), F.col(f"{side}_account").alias("account"))
    return txns.select("client_id", node("from").alias("src"), node("to").alias("dst"))


def _client(df: DataFrame) -> list[str]:
    """Edges whose nodes are numbers need no client, as a number stands for a node of one client."""
    return [c for c in df.columns if c == "client_id"]


def node_ids(e: DataFrame) -> DataFrame:
    """``client_id, node, id``: a number for each node of the edges, as a stored table."""
    nodes = e.select("client_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return stored(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")


def with_ids(e: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with numbers for their nodes, and without the client; steps that handle every path do so far faster on them."""
    rest = [c for c in e.columns if c not in ("client_id", "src", "dst")]
    for side in ("src", "dst"):
        e = e.join(ids.select("client_id", F.col("node").alias(side), F.col("id").alias(f"_{side}")), ["client_id", side])
    return e.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), *rest)


def distinct_edges(e: DataFrame) -> DataFrame:
    return e.dropDuplicates(["client_id", "src", "dst"])


def node_degrees(e: DataFrame, side: str, k: int = 0, unique: bool = False) -> DataFrame:
    """Number of different neighbours of each node as ``side`` ("src": fan-out, "dst": fan-in), where over ``k``.

    Edges known to be ``unique`` are just counted, which takes one shuffle less.
    """
    other = "dst" if side == "src" else "src"
    n = F.count(other) if unique else F.countDistinct(other)
    return e.groupBy(*_client(e), side).agg(n.alias("n")).where(F.col("n") > k)


def with_degree(e: DataFrame, side: str, k: int, unique: bool = False) -> DataFrame:
    """Edges whose ``side`` node has more than ``k`` different neighbours."""
    return e.join(node_degrees(e, side, k, unique), ["client_id", side], "left_semi").select("client_id", "src", "dst")


def tagged_edges(incoming: DataFrame, outgoing: DataFrame) -> DataFrame:
    return incoming.withColumn("side", F.lit("i")).unionByName(outgoing.withColumn("side", F.lit("o")))


def weighted_edges(e: DataFrame) -> DataFrame:
    """Each edge once, with the number of its payments as ``weight``."""
    return e.groupBy("client_id", "src", "dst").agg(F.count("*").alias("weight"))


def hubs(first: DataFrame, second: DataFrame, paths: int = HUB_PATHS, block: int = HUB_BLOCK) -> DataFrame:
    """``mid, in_blocks, out_blocks``, by client if edges have one, of the nodes through which more than ``paths`` paths lead."""
    keys = [*_client(first), "mid"]
    a = first.withColumnRenamed("dst", "mid").groupBy(keys).agg(F.count("*").alias("n_in"))
    b = second.withColumnRenamed("src", "mid").groupBy(keys).agg(F.count("*").alias("n_out"))
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    both = a.join(b, keys).where(F.col("n_in") * F.col("n_out") > paths)
    return both.select(*keys, blocks("n_in").alias("in_blocks"), blocks("n_out").alias("out_blocks"))


def two_hop(first: DataFrame, second: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """``(start, mid, final)`` with start other than final, joined by shuffle; with ``weight``, the product, if edges have it.

    ``heavy`` (from ``hubs``) names middle nodes whose edges are dealt out: incoming edges in blocks by their start, outgoing
    ones by their end, and every pair of blocks is a key of its own. An edge of a hub is copied once for each block
    of the other side, which is little beside its paths; edges of other nodes stay single.
    """
    client = _client(first)
    a = first.select(*client, F.col("src").alias("start"), F.col("dst").alias("mid"), *(F.col(c).alias("_w1") for c in first.columns if c == "weight"))
    b = second.select(*client, F.col("src").alias("mid"), F.col("dst").alias("final"), *(F.col(c).alias("_w2") for c in second.columns if c == "weight"))
    keys = [*client, "mid"]
    if heavy is not None:
        own = lambda end, n: F.pmod(F.xxhash64(end), F.coalesce(n, F.lit(1))).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
        a = a.join(heavy, keys, "left").withColumn("_i", own("start", F.col("in_blocks"))).withColumn("_o", every(F.col("out_blocks"))).drop("in_blocks", "out_blocks")
        b = b.join(heavy, keys, "left").withColumn("_o", own("final", F.col("out_blocks"))).withColumn("_i", every(F.col("in_blocks"))).drop("in_blocks", "out_blocks")
        keys += ["_i", "_o"]
    out = a.join(b, keys).where(F.col("start") != F.col("final")).drop("_i", "_o")
    return out.withColumn("weight", F.col("_w1") * F.col("_w2")).drop("_w1", "_w2") if {"_w1", "_w2"} <= set(out.columns) else out.drop("_w1", "_w2")


def path_counts(paths: DataFrame, k: int) -> DataFrame:
    """Pairs of ends with more than ``k`` paths between them, each counted by its weight if it has one."""
    n = F.sum("weight") if "weight" in paths.columns else F.count("*")
    return paths.groupBy(*_client(paths), "start", "final").agg(n.alias("n_paths")).where(F.col("n_paths") > k)


def endpoints(pairs: DataFrame) -> DataFrame:
    both = pairs.select("client_id", F.explode(F.array("start", "final")).alias("node"))
    return both.select("client_id", "node.bank", "node.account").distinct()


def scatter_gather(txns: DataFrame, k: int = 5, multiplicity: str = "set", prune: bool = True) -> DataFrame:
    """Accounts at either end of more than ``k`` two-hop paths.

    "set" counts different intermediaries. There a start needs more than ``k`` receivers and an end more than
    ``k`` senders, so pruning both sides by degree before the join loses nothing. "bag" counts every pair of payments,
    as products of the edges' weights, and takes both hops from payments whose sender has more than ``k`` receivers.

    The edges, each once, are stored in the shared folder, and again with numbers for their nodes: all further steps read these,
    and the hubs among their nodes are known before the join is planned. Names come back for the accounts found alone.
    """
    e = stored(weighted_edges(edges(txns)), "edges")
    ids = node_ids(e)
    e = stored(with_ids(e, ids), "numbered")
    if multiplicity == "bag":
        first = second = _with_degree(e, "src", k)
    else:
        e = e.drop("weight")
        first, second = (_with_degree(e, "src", k), _with_degree(e, "dst", k)) if prune else (e, e)
    heavy = hubs(first, second)
    n = heavy.limit(BROADCAST_HUBS + 1).count()
    heavy = None if not n else F.broadcast(heavy) if n <= BROADCAST_HUBS else heavy
    found = path_counts(two_hop(first, second, heavy).drop("mid"), k)
    return found.select(F.explode(F.array("start", "final")).alias("id")).distinct().join(ids, "id").select("client_id", "node.bank", "node.account")


def hop_counts(hops: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``client_id, start, final, n_paths`` over the two-hop paths of all given pairs of edge tables together."""
    ids = node_ids(reduce(DataFrame.unionByName, [e for hop in hops for e in hop]))
    paths = [two_hop(*(with_ids(e, ids) for e in hop)).select("start", "final") for hop in hops]
    out = path_counts(reduce(DataFrame.union, paths), 0)
    for side in ("start", "final"):
        out = out.join(ids.select(F.col("client_id").alias(f"_{side}"), F.col("node").alias(f"{side}_node"), F.col("id").alias(side)), side)
    return out.select(F.col("_start").alias("client_id"), F.col("start_node").alias("start"), F.col("final_node").alias("final"), "n_paths")


def _with_degree(e: DataFrame, side: str, k: int) -> DataFrame:
    """As ``with_degree`` for unique edges, with all their columns."""
    return e.join(node_degrees(e, side, k, unique=True), [*_client(e), side], "left_semi").select(e.columns)
