"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact Jaccard similarity decides.

Texts are sets of five-word shingles (lower-cased runs between ASCII blanks; fewer than five words make one shingle, no
words none). Rows with the same text are collapsed to one representative first, with their number.

Every tree of the forest sorts the texts by a signature of its own, and texts that agree in a prefix of it share a node of
the tree's trie. Prefixes start ``LEVELS`` values longer than the shortest one ever needed, at which a pair exactly at the threshold
is found with ``TARGET_RECALL``. They are shortened, value by value, until the weakest link of the whole table is found with
that recall (``measured_depth``), so data that hold close copies alone are matched by long prefixes.

Pairs of a node of few texts are candidates if one-bit sketches of their signatures put them near the threshold or above
it; so chance meetings of texts that have half of their shingles in common link nothing. A larger node links its
members to its smallest one, so its links grow with its members and not with their pairs. Candidates that
hang together form a group. Groups are cut into blocks of bounded size; each pair
of blocks is one task unit, which computes exact intersections there and returns only counts of links and a spanning
forest of them, never the pairs. The components of those forests are the classes.

``n_links`` counts the other rows, copies included, that are at least ``threshold`` similar. Texts without words have
no links and each document is its own class. A class is named by its smallest doc_id. Rows that repeat an id are
rows of one class. Rows without an id have links like others and the class null where no member has one.

Shingles are compared by 64-bit hashes of their words. Null texts count as empty. Texts of any length count with all their
shingles; very long ones make blocks of their own. An empty table gives an empty one; other columns may have any names and are
kept where documents are returned. A pair exactly at the threshold is a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.llm.shared import packed, ship, unpacked, written

WORDS = 5
THRESHOLD = 0.8
TREES = 40
#: Values of a tree's signature beyond the shortest prefix.
LEVELS = 4
TARGET_RECALL = 0.999
#: Three standard errors of a sketch's estimate at the threshold; what is measured may be that much weaker.
SKETCH_ERROR = 0.09
#: Pairs of texts are compared by sketches in nodes of this many texts, at most; estimates this far below the threshold go.
PAIRED_TEXTS, SKETCH_MARGIN = 8, 0.2
#: Bounds of a block: texts and characters.
BLOCK_TEXTS, BLOCK_CHARS = 256, 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}


def recall(similarity: float, depth: int, trees: int = TREES) -> float:
    """Probability that a pair shares a node at this depth in one tree at least."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(similarity: float, deepest: int, trees: int = TREES, target: float = TARGET_RECALL) -> int:
    """The longest prefix, from ``deepest`` values down, whose recall at the similarity reaches the target."""
    return next((d for d in range(deepest, 1, -1) if recall(similarity, d, trees) >= target), 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def shingles(text: str) -> np.ndarray:
    """Sorted distinct shingle hashes. Word hashes are differences of one prefix sum over the bytes."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    blank = np.concatenate(([True], _BLANK[raw], [True]))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    n = max(1, len(words) - WORDS + 1)
    out = np.full(n, np.uint64(min(len(words), WORDS)), np.uint64)
    for k in range(min(WORDS, len(words))):
        out = _mix(out * _BASE + words[k : k + n])
    return np.unique(out)


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20220901)
    return rng.integers(0, 1 << 31, count).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count).astype(np.uint32)


def minima(hashes: np.ndarray, permutations: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest value of each permutation over the shingles."""
    a, b = permutations
    low = np.full(len(a), np.uint32(0xFFFFFFFF))
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), 1024):
        block = np.multiply.outer(h[at : at + 1024], a)
        block += b
        np.minimum(low, block.min(axis=0), out=low)
    return low


def signature(low: np.ndarray, trees: int, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per tree the node of its shortest prefix and the values after that (16 bits each, the next one first); the sketch."""
    values = low.reshape(trees, floor + LEVELS).astype(np.uint64)
    node = np.arange(trees, dtype=np.uint64) + np.uint64(1)
    for k in range(floor):
        node = _mix(node * _BASE + values[:, k])
    after, mixed = np.zeros(trees, np.uint64), _mix(values)
    for k in range(floor, floor + LEVELS):
        after = after << np.uint64(16) | mixed[:, k] & np.uint64(0xFFFF)
    bits = np.packbits((mixed.ravel() >> np.uint64(63)).astype(bool))
    sketch = np.concatenate((bits, np.zeros(-len(bits) % 8, np.uint8)))
    return node.view(np.int64), after.view(np.int64), sketch.view(np.int64)


def _signed(texts: DataFrame, trees: int, floor: int) -> DataFrame:
    """``rid, row, chars, nodes, after, sketch`` of the texts that have a word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        permutations = _permutations(trees * (floor + LEVELS))
        for p in batches:
            h = map(shingles, p.text)
            parts = [signature(minima(x, permutations), trees, floor) if len(x) else (None, None, None) for x in h]
            out = pd.DataFrame(parts, columns=["nodes", "after", "sketch"], index=p.index)
            out = pd.concat([p[["rid", "row"]], p.text.str.len().rename("chars"), out], axis=1)
            yield out.dropna(subset="nodes")

    ship(texts.sparkSession)
    return texts.mapInPandas(run, "rid string, row binary, chars long, nodes array<long>, after array<long>, sketch array<long>")


def _estimated(pairs: DataFrame, copies: DataFrame, values: int) -> DataFrame:
    """The pairs ``a, b`` with their similarity as estimated from the sketches of ``values`` bits."""
    for side in ("a", "b"):
        pairs = pairs.join(copies.select(F.col("rid").alias(side), F.col("sketch").alias(f"sketch_{side}")), side)
    words = range(-(-values // 64))
    differ = sum((F.bit_count(F.col("sketch_a")[k].bitwiseXOR(F.col("sketch_b")[k])) for k in words), F.lit(0))
    return pairs.select("a", "b", (1 - 2 * differ / values).alias("estimate"))


def _node_pairs(entries: DataFrame) -> DataFrame:
    """Every pair ``a, b`` of texts that share a node of few texts."""
    few = entries.where(F.col("m") <= PAIRED_TEXTS).groupBy("node").agg(F.collect_set("rid").alias("texts"))
    pairs = few.select(F.explode("texts").alias("a"), "texts")
    return pairs.select("a", F.explode(F.filter("texts", lambda t: t < F.col("a"))).alias("b")).distinct()


def measured_depth(entries: DataFrame, copies: DataFrame, threshold: float, trees: int, target: float, floor: int) -> int:
    """The depth at which the weakest link of the table is found with the target recall.

    All ``entries`` (``rid, node, after, head, m``) of nodes at the shortest prefix are measured: every pair of a node of few texts, and
    every text of a larger one with the smallest there. Where such a text is no link of the smallest one its links to others
    there aren't known, and the prefix is the shortest; so it is without a link.
    """
    star = entries.where((F.col("m") > PAIRED_TEXTS) & (F.col("rid") != F.col("head"))).select(F.col("rid").alias("a"), F.col("head").alias("b")).distinct()
    values, link = trees * (floor + LEVELS), F.col("estimate") >= threshold - SKETCH_ERROR
    linked = _estimated(star, copies, values).agg(F.min("estimate").alias("estimate")).select("estimate", (~link).alias("unknown"))
    paired = _estimated(_node_pairs(entries), copies, values).where(link).agg(F.min("estimate").alias("estimate")).select("estimate", F.lit(False).alias("unknown"))
    weakest, unknown = linked.union(paired).agg(F.min("estimate"), F.max("unknown")).first()
    if weakest is None or unknown:
        return floor
    return max(floor, prefix_depth(max(threshold, weakest - SKETCH_ERROR), floor + LEVELS, trees, target))


def candidates(copies: DataFrame, threshold: float, trees: int, target: float) -> DataFrame:
    """Edges ``a, b`` over the texts: those of one component may be similar."""
    floor = prefix_depth(threshold, 64, trees, target)
    member = copies.select("rid", F.inline(F.arrays_zip(F.col("nodes").alias("node"), "after")))
    # Nodes of one text say nothing.
    heads = member.groupBy("node").agg(F.min("rid").alias("head"), F.count("*").alias("m")).where("m > 1")
    entries = written(member.join(heads, "node"))
    depth = measured_depth(entries, copies, threshold, trees, target, floor)
    if depth > floor:
        prefix = F.xxhash64("node", F.shiftrightunsigned("after", 16 * (floor + LEVELS - depth)))
        member = entries.select("rid", prefix.alias("node"))
        heads = member.groupBy("node").agg(F.min("rid").alias("head"), F.count("*").alias("m")).where("m > 1")
        entries = written(member.join(heads, "node"))
    star = entries.where(F.col("m") > PAIRED_TEXTS).select(F.col("rid").alias("a"), F.col("head").alias("b"))
    near = _estimated(_node_pairs(entries), copies, trees * (floor + LEVELS)).where(F.col("estimate") >= threshold - SKETCH_MARGIN)
    return star.union(near.select("a", "b"))


def _sums(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Membership of each row in the shingles that two rows or more have: row numbers and column numbers."""
    lengths = np.array([len(r) for r in rows])
    _, column, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), lengths)
    shared = count[column] > 1
    rank = np.cumsum(count > 1) - 1
    return owner[shared], rank[column[shared]]


def similar(rows: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of shingle sets that are at least ``threshold`` similar."""
    owner, column = _sums(rows)
    both = np.zeros((len(rows), len(rows)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = max(256, 2_000_000 // len(rows))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (start, start + width))
        x = np.zeros((len(rows), width), np.float32)
        x[owner[lo:hi], column[lo:hi] - start] = 1
        both += x @ x.T
    sizes, both = np.array([len(r) for r in rows], np.float64), both.astype(np.float64)
    return both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9


def _forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Spanning edges of the components of a list of pairs over ``n`` nodes."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []
    for i, j in pairs.tolist():
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def verify_unit(unit: dict[str, tuple], same: bool, threshold: float) -> list[tuple]:
    """``(rid, other, links)`` of one unit, whose texts are ``rid -> (text, n, block)``.

    Rows without ``other`` count the links of a text to the other block (or, if ``same``, inside the one), each
    linked text as often as it has copies; the rest are spanning edges of those links.
    """
    rid = list(unit)
    ok = similar([shingles(unit[r][0]) for r in rid], threshold)
    np.fill_diagonal(ok, False)
    if not same:
        block = np.array([unit[r][2] for r in rid])
        ok &= block[:, None] != block[None, :]
    links = ok @ np.array([unit[r][1] for r in rid], np.int64)
    out = [(rid[i], None, int(links[i])) for i in np.flatnonzero(links)]
    return out + [(rid[i], rid[j], 0) for i, j in _forest(np.argwhere(np.triu(ok)), len(rid))]


def _verify(units: DataFrame, threshold: float) -> DataFrame:
    """``rid, other, links`` of all units. Their rows come sorted, so one unit of bounded size is held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, same, held = None, False, {}
        for p in batches:
            out: list[tuple] = []
            for rid, text, n, block, name, inside in p.itertuples(index=False):
                if name != unit:
                    out += verify_unit(held, same, threshold) if len(held) > 1 else []
                    unit, same, held = name, inside, {}
                held[rid] = (text, n, block)
            yield pd.DataFrame(out, columns=["rid", "other", "links"])
        if len(held) > 1:
            yield pd.DataFrame(verify_unit(held, same, threshold), columns=["rid", "other", "links"])

    ship(units.sparkSession)
    return units.mapInPandas(run, "rid string, other string, links long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each node of the edges ``a, b`` hangs together with.

    Alternates between linking a node's larger neighbours and its smaller ones to its smallest neighbour; the number
    of rounds grows with the logarithm of the longest path. Every round is a table in the shared folder.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
    before = e.agg(*state).first()
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # A table of its own, so that the join with a node of very many neighbours can be split.
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        e = written(large.join(low, "a").select(F.inline(pairs)).where("a <> b").distinct())
        after = e.agg(*state).first()
        if before == after:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, target: float = TARGET_RECALL) -> DataFrame:
    """``doc_id, class_id, n_links`` of every row of ``docs``."""
    return _classed(docs, threshold, trees, target).select(F.col("__row.doc_id").alias("doc_id"), "class_id", "n_links")


def _classed(docs: DataFrame, threshold: float, trees: int, target: float) -> DataFrame:
    floor = prefix_depth(threshold, 64, trees, target)
    rows = packed(docs).withColumn("rid", F.md5("__text"))
    signed = _signed(rows.select("rid", F.col("__rid").alias("row"), F.col("__text").alias("text")), trees, floor)
    parts = (F.first(c).alias(c) for c in ("nodes", "after", "sketch"))
    copies = written(signed.groupBy("rid").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.max("chars").alias("chars"), *parts))

    group = components(candidates(copies, threshold, trees, target))
    group = group.union(group.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "rid")

    # Candidate texts, once each, cut into blocks and dealt to the pairs of blocks of their group.
    picked = group.join(copies.select("rid", "n", "row", "chars"), "rid")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("chars") / BLOCK_CHARS)).cast("int")
    # Tables of their own, here and below, so that the joins with a very large group can be split.
    picked = picked.join(written(picked.groupBy("root").agg(blocks.alias("blocks"))), "root")
    picked = picked.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")).drop("chars")
    placed = rows.select(F.col("__rid").alias("row"), F.col("__text").alias("text")).join(picked, "row")
    other = placed.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("block", "k"), F.greatest("block", "k")
    units = other.select("rid", "text", "n", "block", F.concat_ws("/", "root", i, j).alias("unit"), (i == j).alias("same"))
    found = written(_verify(units.repartition("unit").sortWithinPartitions("unit"), threshold))

    root = components(found.where("other is not null").select(F.col("rid").alias("a"), F.col("other").alias("b")))
    links = found.where("other is null").groupBy("rid").agg(F.sum("links").alias("l"))
    info = copies.select("rid", "n").join(links, "rid", "left").join(root.withColumnRenamed("node", "rid"), "rid", "left")
    info = info.select("rid", F.coalesce("root", "rid").alias("root"), (F.coalesce("l", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    ids = rows.groupBy("rid").agg(F.min("__row.doc_id").alias("id"))
    info = info.join(ids, "rid")
    first = written(info.groupBy("root").agg(F.min("id").alias("class_id")))
    by_text = written(info.join(first, "root").select("rid", "class_id", "n_links"))
    out = rows.join(by_text, "rid", "left")
    own = F.col("n_links").isNull()
    return out.withColumns({"class_id": F.when(own, F.col("__row.doc_id")).otherwise(F.col("class_id")), "n_links": F.coalesce("n_links", F.lit(0))})


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, target: float = TARGET_RECALL) -> DataFrame:
    """The row of the smallest doc_id of each class (and rows that repeat it), in the columns of ``docs``."""
    out = _classed(docs, threshold, trees, target)
    return unpacked(out.where(F.col("__row.doc_id").eqNullSafe(F.col("class_id"))), docs.columns)
