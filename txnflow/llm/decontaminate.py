"""Spaced-seed search for benchmark passages in documents.

Words are lower-cased runs of characters other than ASCII blanks and punctuation, as 64-bit hashes. A seed is a mask
over word positions whose zeros are ignored; the hash of the words under its ones is looked up for every position of
every document among those of the benchmark. A hit fixes how item and document align; each different alignment is verified
once, position by position. Substituted words cost their own positions and nothing else.

A pair is reported where an alignment agrees

* on ``min_overlap`` of the item's words and on ``MIN_MATCHED`` of them (all, where it has fewer), or
* on ``MIN_STRETCH`` of some ``STRETCH`` neighbouring words of the item, so that a long quote from a longer item counts.

The masks of an item follow from its own length, whatever the other items are: the fixed spaced masks it is long enough for;
under ``SHORT`` words also four neighbouring words; up to ``MIN_MATCHED`` words, all of which have to agree, the whole item. Of
several alignments of a pair the one that agrees on most words counts (then the longer item, the better stretch, the smaller start).

Defined cases: null and empty texts, on either side, have no words and no rows; rows that repeat id and text give one
result; items that repeat an id are items of their own, of which the best is reported; empty tables give no rows; other columns are
ignored by the report and kept by ``decontaminate``; texts of any length are searched whole. Only DataFrame functions are used.

Seeds and item words grow with the benchmark alone. Each table is broadcast while its size, as counted, is within
``broadcast_bytes``; beyond that the joins are shuffled. Exploded rows hold a position and its keys, never the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnflow.llm.shared import packed, unpacked, written

MASKS = ("110110101", "1110010011", "101001110001")
MIN_MATCHED = 8
MIN_OVERLAP = 0.5
STRETCH, MIN_STRETCH = 40, 24
#: Items of fewer words have few places for a spaced mask, so four neighbouring words are looked up too.
SHORT, NEIGHBOURS = 16, 4
BROADCAST_BYTES = 64 << 20
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: str) -> Column:
    """Hashes of the words of a text column."""
    parts = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _GAP)
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def masks_of(n: int) -> list[str]:
    """The masks of an item of ``n`` words."""
    own = [m for m in MASKS if len(m) <= n]
    if n <= MIN_MATCHED:
        return ["1" * n] * (n > 0)
    return own + ["1" * NEIGHBOURS] * (n < SHORT)


def _key(words: str, at: Column, mask: str) -> Column:
    """Hash of the words under a mask laid at ``at``; null where the mask reaches past the end."""
    ones = [i for i, c in enumerate(mask) if c == "1"]
    return F.when(at + len(mask) <= F.size(words), F.xxhash64(F.lit(mask), *(F.get(words, at + i) for i in ones)))


def _items(benchmark: DataFrame) -> DataFrame:
    """``ik, item_id, iw`` of the items that have a word; ``ik`` tells those of one id apart."""
    items = benchmark.select("item_id", _words("text").alias("iw")).where(F.size("iw") > 0)
    return items.select(F.xxhash64("item_id", F.col("item_id").isNull(), "iw").alias("ik"), "item_id", "iw").dropDuplicates(["ik"])


def benchmark_seeds(items: DataFrame, masks: list[str]) -> DataFrame:
    """``key, ik, n, offset``: every seed of every item (of ``n`` words) under each of its masks."""
    n = F.size("iw")
    at = items.select("ik", "iw", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("offset"))

    def own(m: str) -> Column:
        return F.col("n") >= len(m) if m in MASKS else F.col("n").isin([k for k in range(1, SHORT) if m in masks_of(k)])

    # The masks of spaced positions are for items over MIN_MATCHED words, which they are all longer than.
    keys = F.array(*(F.when(own(m), _key("iw", F.col("offset"), m)) for m in masks))
    return at.select("ik", "n", "offset", F.explode(keys).alias("key")).where("key is not null").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, min_overlap: float = MIN_OVERLAP, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``__rid, doc_id, item_id, overlap, n_matched, n_item_words, n_stretch, start`` of each document and item that overlap."""
    rows, items = packed(docs), written(_items(benchmark))
    # Masks that no item has are not laid on the documents; that changes no result, as each item has its own.
    lengths = [r.n for r in items.select(F.least(F.size("iw"), F.lit(SHORT)).alias("n")).distinct().collect()]  # SHORT rows at most
    masks = sorted({m for n in lengths for m in masks_of(n)} | ({*MASKS} if SHORT in lengths or not lengths else set()))
    seeds = written(benchmark_seeds(items, masks))
    sizes = items.agg(F.coalesce(F.sum(8 * F.size("iw") + 64), F.lit(0))).first()[0], 64 * seeds.count()
    near_items, near_seeds = (F.broadcast if size <= broadcast_bytes else (lambda df: df) for size in sizes)

    words = rows.select("__rid", _words("__text").alias("w"))
    # The outer form keeps Spark from filtering on the array's size, for which it would build the words twice.
    at = words.select("__rid", "w", F.explode_outer(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1))).alias("at"))
    at = at.select("__rid", "at", F.explode(F.array(*(_key("w", F.col("at"), m) for m in masks))).alias("key"))
    hits = at.join(near_seeds(seeds), "key").select("__rid", F.struct("ik", "n", (F.col("at") - F.col("offset")).alias("start")).alias("h")).distinct()
    hits = written(hits.groupBy("__rid").agg(F.collect_list("h").alias("h")))

    # The texts of documents with a hit; of their words only those that lie beside an item go on.
    texts = rows.select("__rid", F.col("__row.doc_id").alias("doc_id"), "__text").join(hits.hint("shuffle_hash"), "__rid")
    texts = texts.select("__rid", "doc_id", _words("__text").alias("w"), "h")

    def beside(h: Column) -> Column:
        begin = F.greatest(h["start"], F.lit(0))
        part = F.slice("w", begin + 1, F.least(h["start"] + h["n"] - begin, F.size("w")))
        return F.struct(h["ik"].alias("ik"), h["n"].alias("n"), h["start"].alias("start"), part.alias("part"))

    aligned = texts.select("__rid", "doc_id", F.inline_outer(F.transform("h", beside))).join(near_items(items), "ik")
    agree = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.get("part", k + F.least(F.col("start"), F.lit(0))) == F.get("iw", k))
    aligned = aligned.select("__rid", "doc_id", "item_id", "start", "n", agree.alias("ks"))
    ahead = F.transform("ks", lambda k: F.size(F.filter("ks", lambda j: (j >= k) & (j < k + STRETCH))))
    scored = aligned.select("__rid", "doc_id", "item_id", "start", "n", F.size("ks").alias("agree"), F.coalesce(F.array_max(ahead), F.lit(0)).alias("stretch"))
    enough = (F.col("agree") >= min_overlap * F.col("n")) & (F.col("agree") >= F.least(F.lit(MIN_MATCHED), F.col("n")))
    scored = scored.where(enough | (F.col("stretch") >= MIN_STRETCH))
    best = scored.groupBy("__rid", "doc_id", "item_id").agg(F.max(F.struct("agree", "n", "stretch", (-F.col("start")).alias("s"))).alias("b"))
    return best.select(
        "__rid", "doc_id", "item_id", (F.col("b.agree") / F.col("b.n")).alias("overlap"), F.col("b.agree").alias("n_matched"),
        F.col("b.n").alias("n_item_words"), F.col("b.stretch").alias("n_stretch"), (-F.col("b.s")).alias("start"),
    )


def leak_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    return leaks(docs, benchmark, **options).drop("__rid")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that overlap with no item, in the columns of ``docs``."""
    found = leaks(docs, benchmark, **options).select("__rid").distinct()
    return unpacked(packed(docs).join(found, "__rid", "left_anti"), docs.columns)
