"""Language identification by Bloom filters with a bit for each language.

Learning counts the n-grams of letters in the training texts of each language (edges of words included, every word with
its count). An n-gram belongs to a language on each of ``LEVELS`` at which its share of the language's n-grams of that
length is large enough; a share of s can hold for at most 1 / s n-grams, so the filters have a proven bound, whatever
the corpus. All languages and levels share the slots of one filter: a slot is a row of bits, one for each language and
level (bit-sliced), and the rows of an n-gram's slots, and-ed, tell at once where it belongs.

A text's n-grams each give such a row of bits; per language and level the set bits are added up. A word's sums are kept for the texts
behind it, up to ``AT_ONCE`` letters of words. A filter whose slots
are filled to a share f says yes to a strange n-gram with probability f ** HASHES; hits are corrected for that. The
language with the most corrected hits, summed over levels, is predicted. The score says how far it stands out: its
hits less those of the next one, over its own, between 0 and 1.

Only rows with ``crc32(doc_id) mod 4 <> 2`` and a language train, and only text is an input of a prediction. A text that
is null or has no letter gives ``und`` with score 0. One whose n-grams are unknown to all languages gives the language with
the most training text, with score 0; ties go to the larger training text, then to the smaller name. Without training
rows every text gives ``und``. Repeated rows train each time. Texts of any length count whole; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.llm.shared import ship, written

FOLDS, HELD_OUT = 4, 2
UNDETERMINED = "und"
#: Lengths of n-grams, in letters with the edges of words. An n-gram is known by a 64-bit hash.
LENGTHS = (1, 2, 3, 4, 5)
#: Least share of a language's n-grams of one length that an n-gram has on each level.
LEVELS = (3e-3, 3e-4, 3e-5)
#: Slots for each n-gram kept, and slots that an n-gram sets.
SLOTS, HASHES = 16, 4
#: Letters that are taken to words and to n-grams at once, so that long texts need no more memory.
AT_ONCE = 1_000_000

_WORD = re.compile(r"[^\W\d_]+")
# All but a to z as a blank: the same for ASCII texts, and several times as fast.
_LETTERS = {i: chr(i) if chr(i).isalpha() else " " for i in range(128)}
_PRIME, _MIX, _EDGE = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93), np.uint64(0x5F)


def runs(text: str) -> Iterator[list[str]]:
    """Lower-case runs of letters in order, up to ``AT_ONCE`` letters at once."""
    start = 0
    while start < len(text):
        end = start + AT_ONCE
        while end < len(text) and text[end].isalpha():
            end += 1
        part = text[start:end].lower()
        if part.isascii():
            yield part.translate(_LETTERS).split()
        else:
            found = _WORD.findall(part)
            if not "".join(found).isalpha():  # digits of other kinds than 0 to 9 are no letters
                found = "".join(c if c.isalpha() else " " for c in " ".join(found)).split()
            yield found
        start = end


def words(text: str) -> Counter:
    """Lower-case runs of letters with their counts."""
    found: Counter = Counter()
    for run in runs(text):
        found.update(run)
    return found


def grams(vocabulary: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Word number, length and hash of every n-gram of the words between their edges; an edge alone is none."""
    start = 0
    while start < len(vocabulary):
        end, size = start, 0
        while end < len(vocabulary) and (end == start or size + len(vocabulary[end]) <= AT_ONCE):
            size += len(vocabulary[end]) + 1
            end += 1
        code = np.frombuffer(("_" + "_".join(vocabulary[start:end]) + "_").encode("utf-32-le"), np.uint32).astype(np.uint64)
        edge = code == _EDGE
        word = np.cumsum(edge) - 1 + start  # an edge goes with the word behind it
        letter = ~edge
        value = np.zeros(len(code), np.uint64)
        inner = np.ones(len(code), bool)  # no edge but at the ends
        power = 1
        for n in range(1, max(LENGTHS) + 1):
            k = len(code) - n + 1
            if k <= 0:
                break
            power = power * _PRIME % 2**64
            value = value[:k] + (code[n - 1 :] + np.uint64(1)) * np.uint64(power)
            inner = inner[:k] & letter[n - 2 : n - 2 + k] if n > 2 else inner[:k]
            if n in LENGTHS:
                whole = letter if n == 1 else inner & (letter[:k] | letter[n - 1 :]) if n == 2 else inner
                at = np.flatnonzero(whole)
                h = (value[at] ^ (value[at] >> np.uint64(32))) * _MIX
                yield word[at], np.full(len(at), n), h ^ (h >> np.uint64(29))
        start = end


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS


def gram_counts(train: DataFrame) -> DataFrame:
    """``lang, size, gram, n``: the n-grams of each language. A task counts words first, up to ``AT_ONCE`` letters of them, and cuts each once."""
    ship(train.sparkSession)

    def cut(by: dict[str, Counter]) -> Iterator[pd.DataFrame]:
        for lang, c in by.items():
            times = np.fromiter(c.values(), np.int64, len(c))
            for word, size, gram in grams(list(c)):
                key, of = np.unique(gram, return_inverse=True)
                n = np.bincount(of, times[word], len(key)).astype(np.int64)
                yield pd.DataFrame({"lang": lang, "size": size[:1].repeat(len(key)), "gram": key.view(np.int64), "n": n})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: dict[str, Counter] = defaultdict(Counter)
        for p in batches:
            for lang, text in zip(p.lang, p.text, strict=True):
                for run in runs(text):
                    by[lang].update(run)
            if sum(len(w) for c in by.values() for w in c) > AT_ONCE:
                yield from cut(by)
                by.clear()
        yield from cut(by)

    return train.select("lang", "text").mapInPandas(count, "lang string, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


class Filter:
    """The bit-sliced filter: ``rows`` of bits by slot, packed to 64-bit words; bits go by language, then level."""

    def __init__(self, langs: list[str], rows: np.ndarray):
        self.langs, self.rows = langs, rows
        set_bits = sum((np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for part in np.array_split(rows, 64)), np.zeros(64 * rows.shape[1], np.int64))
        self.false = np.minimum((set_bits[: len(langs) * len(LEVELS)] / len(rows)) ** HASHES, 0.99)

    @classmethod
    def of(cls, langs: list[str], number: np.ndarray, gram: np.ndarray, share: np.ndarray) -> Filter:
        """From the n-grams kept, the numbers of their languages and their shares there."""
        m = max(64, SLOTS * len(gram))
        rows = np.zeros((m, max(1, -(-len(langs) * len(LEVELS) // 64))), np.uint64)
        for level, least in enumerate(LEVELS):
            on = share >= least
            bit = number[on] * len(LEVELS) + level
            for at in slots(gram[on], m):
                np.bitwise_or.at(rows, (at, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
        return cls(langs, rows)

    def hits(self, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word the number of its n-grams, and how many of them have each bit."""
        total, hits = np.zeros(len(vocabulary), np.int64), np.zeros((len(vocabulary), len(self.false)), np.int64)
        for word, _, gram in grams(vocabulary):
            if not len(word):
                continue
            masks = None
            for at in slots(gram, len(self.rows)):
                masks = self.rows[at] if masks is None else masks & self.rows[at]
            bits = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little", count=len(self.false))
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            total[word[starts]] += np.diff(starts, append=len(word))
            hits[word[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        return total, hits

    def decide(self, total: int, hits: np.ndarray) -> tuple[str, float]:
        true = np.maximum((hits - total * self.false) / (1 - self.false), 0.0)
        by_lang = true.reshape(len(self.langs), len(LEVELS)).sum(axis=1)
        best = int(by_lang.argmax())
        if by_lang[best] <= 0:
            return self.langs[0], 0.0
        rest = np.delete(by_lang, best)
        return self.langs[best], float(1 - (rest.max() if len(rest) else 0.0) / by_lang[best])

    def predict(self, texts: list[str], known: Known | None = None) -> list[tuple[str, float]]:
        """Language and score of each text. Texts are taken together up to ``AT_ONCE`` letters (fewer for many languages), a longer one alone."""
        known = Known() if known is None else known
        out: list[tuple[str, float]] = []
        start, most = 0, AT_ONCE * 64 // max(64, len(self.false))
        while start < len(texts):
            end, size, found = start, 0, []
            known.shorten(most)
            while end < len(texts) and (end == start or size + len(texts[end]) <= most):
                size += len(texts[end])
                c = words(texts[end])
                found.append((np.fromiter(map(known.number.__getitem__, c), np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c))))
                end += 1
            if self.langs:
                known.extend(self)
                out += [self.decide(int(n @ known.total[w]), n @ known.hits[w]) if len(w) else (UNDETERMINED, 0.0) for w, n in found]
            else:
                out += [(UNDETERMINED, 0.0)] * len(found)
                known.clear()
            start = end
        return out


class Known:
    """The words of earlier texts with their n-grams' number and hits, so that each is looked up once."""

    def __init__(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.clear()

    def clear(self) -> None:
        self.number.clear()
        self.letters, self.total, self.hits = 0, np.zeros(0, np.int64), None

    def shorten(self, most: int) -> None:
        """Forget all words once they have more than ``most`` letters."""
        if self.letters > most:
            self.clear()

    def extend(self, by: Filter) -> None:
        """Look up the words that were numbered since."""
        new = list(islice(self.number, len(self.total), None))
        total, hits = by.hits(new)
        self.letters += sum(map(len, new))
        self.total = np.concatenate([self.total, total])
        self.hits = hits if self.hits is None else np.concatenate([self.hits, hits])


def slots(gram: np.ndarray, m: int) -> Iterator[np.ndarray]:
    """The ``HASHES`` slots of n-grams' hashes among ``m``, by double hashing."""
    a, b = gram & np.uint64(0xFFFFFFFF), (gram >> np.uint64(32)) | np.uint64(1)
    return ((a + np.uint64(k) * b) % np.uint64(m) for k in range(HASHES))


def learned(docs: DataFrame) -> Filter:
    """The filter of the training rows of ``docs``; languages by training text, the largest first.

    A language without a letter in its texts has no n-grams and isn't learned.
    """
    train = docs.where((fold() != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = written(gram_counts(train))
    totals = counts.groupBy("lang", "size").agg(F.sum("n").alias("total")).collect()  # a few rows a language
    weight: Counter = Counter()
    for r in totals:
        weight[r.lang] += r.total
    langs = sorted(weight, key=lambda x: (-weight[x], x))
    total = {(r.lang, r["size"]): r.total for r in totals}
    if not langs:
        return Filter([], np.zeros((64, 1), np.uint64))
    least = counts.sparkSession.createDataFrame([(*k, max(1, int(np.ceil(n * min(LEVELS))))) for k, n in total.items()], "lang string, size int, least long")
    # By the levels' bound, at most len(LENGTHS) / min(LEVELS) n-grams a language.
    kept = counts.join(F.broadcast(least), ["lang", "size"]).where("n >= least").select("lang", "size", "gram", "n").toPandas()
    number = kept.lang.map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
    share = kept.n.to_numpy() / np.array([total[k] for k in zip(kept.lang, kept["size"], strict=True)])
    return Filter.of(langs, number, kept.gram.to_numpy(np.int64).view(np.uint64), share)


def languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(learned(docs))

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Known()
        for texts in batches:
            yield pd.DataFrame(model.value.predict(texts.tolist(), known), columns=["lang_pred", "score"])

    ship(docs.sparkSession)
    rows = docs.select("doc_id", (fold() == HELD_OUT).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    return rows.withColumn("__s", run("__text")).select("doc_id", "held_out", "__s.lang_pred", "__s.score")
