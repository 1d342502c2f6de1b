"""Content-defined chunks of lines: passages that stand in many places are kept once.

The lines chunked here are the pieces of a text: its lines, cut again after each mark of ``_MARKS`` that a space follows and
after each of ``_STOPS`` (``within_lines``; without it only whole lines are compared), since shared passages also start and
end inside lines. A piece of over ``LONG_PIECE`` characters is cut once more after words chosen by their hash, every
``WORDS`` on the average, so that passages without marks have places to start and end at too. A piece keeps its blanks and
its line break, so the pieces in order are the text, byte for byte. A rolling hash runs over the hashes of two
neighbouring pieces; a chunk goes on where its three lowest bits are zero, and behind a short piece (under ``SHORT_PIECE``
characters) also where the next bit is zero. Boundaries so depend on two pieces alone and shift with the text. A long piece without a mark or a blank in it is one chunk.

1. Chunks of ``MIN_CHARS`` characters or more are counted by a 64-bit key. Those whose key occurs again are grouped by
   their bytes: equal keys with different bytes are different chunks. The first place of each byte string (smallest doc_id, then
   row, then place) stays, and all others are to be removed.
2. A passage rarely starts where a chunk does. Where a neighbour of a chunk isn't repeated itself, the texts beside it and beside
   its first place are compared piece by piece and, in the first unequal piece, word by word; what is equal joins the chunk. They
   reach to the third chunk that was compared by key, so a passage is followed to its end, however short its chunks.
3. Spans that adjoin or overlap make a run. Runs of ``MIN_WORDS`` words or ``MIN_LINES`` line ends are passages and go; shorter
   ones stay, as a remark that others also make is no passage. If a passage that starts inside a line goes with its line break, the
   rest of that line ends there.

Rows without an id come first in the order of occurrences. Defined cases: null texts count as empty and stay null; an empty
table gives an empty one; rows that repeat id and text are one document and are treated alike; equal texts under other
ids are copies, of which the first stays whole; other columns may have any names and are kept; a text of any length is
processed whole, its chunks being rows of their own. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txnflow.llm.shared import packed, removed, shared_dir, unpacked, written

#: Divisor of the rolling hash where a chunk goes on, and the bit by which it goes on behind a short piece.
JOINED, JOINED_SHORT = 8, 8
SHORT_PIECE = 28
#: Characters above which a piece is cut after words, and mean words between those cuts (a power of two).
LONG_PIECE, WORDS = 80, 8
#: Least characters of a chunk that is compared.
MIN_CHARS = 40
#: Chunks on each side of a repeated one that are compared word by word: up to the third of ``MIN_CHARS``.
REACH = 3
#: Least number of words of a part of a piece that join a chunk; the next sentence often begins with an equal word or two, so
#: fewer join only where the passage is long enough through them.
MIN_SHARED = 4
#: Least size of a passage: words, or line ends less one where it starts inside a line.
MIN_WORDS, MIN_LINES = 50, 3
_WORD = r"[^\x20\x09-\x0D]+"
# Characters of scripts without blanks; two of them count as a word.
_IDEOGRAPH = r"[\u2E80-\u9FFF\uF900-\uFAFF]"
#: What ends a piece within lines: these marks before a space, and those of scripts without spaces.
_MARKS, _STOPS = ".!?,;:", "。！？"
_LINE_ENDS, _MARK_ENDS = ("\n",), ("\n", *(f"{m} " for m in _MARKS))
# Words keep the blank behind them; towards the end of a text, which may lack it, blanks stand alone.
_TOKEN_END, _TOKEN_ENDS = r"(?<=[ \n])", r"(?<=[ \n])|(?=[ \n])"
#: Stands between pieces or chunks, or for a removed passage. Texts hold none, as their own zero characters are escaped.
_CUT = "\0"
_ESCAPES = (("\1", "\1b"), ("\0", "\1a"))
#: Chunks whose lengths are added up at once, for the place of a chunk in its text.
_BLOCK = 16
# More bytes than a text has.
_ALL = 2**31 - 1
#: Bytes of two texts beside equal chunks that are compared first. If they differ at least ``_SPARE`` bytes before their end, no more
#: is cut into pieces: whatever tells the end of a shared piece or word, and the character that differs, is whole in them.
_NEAR, _SPARE = (64, 256), 8
#: Bytes of a passage that are counted first, as they mostly hold ``MIN_WORDS`` words.
_HEAD = 512


def _escaped(text: str) -> Column:
    odd, out = F.contains(F.col(text), F.lit("\0")) | F.contains(F.col(text), F.lit("\1")), F.col(text)
    for plain, code in _ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return F.when(odd, out).otherwise(F.col(text))


def _unescaped(text: Column) -> Column:
    for plain, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _wide(text: str) -> Column:
    """Whether a text has characters of more than one byte, which most have not; none of ``_STOPS`` then, and bytes are characters."""
    return F.octet_length(text) > F.length(text)


def _with_cuts(df: DataFrame, text: str, wide: Column, within_lines: bool) -> DataFrame:
    """``df`` with a cut behind each piece of an escaped text. Plain replacements are far cheaper than a pattern.

    Looking for a mark is much cheaper again than replacing it, and few texts have all of them. Each step is used twice by the
    next, so that Spark keeps it apart.
    """
    for end in (*_STOPS, *_MARK_ENDS) if within_lines else _LINE_ENDS:
        held = F.contains(F.col(text), F.lit(end))
        marked = F.replace(F.col(text), F.lit(end), F.lit(end + _CUT))
        df = df.withColumn(text, F.when(wide & held if end in _STOPS else held, marked).otherwise(F.col(text)))
    return df


def _reaches(part: Column, least: int) -> Column:
    """Whether a part of a text has so many characters. Bytes are at hand; characters are counted only where the bytes leave it open."""
    return (F.octet_length(part) >= least) & (~F.col("__wide") | (F.length(part) >= least))


def _fine_pieces(pieces: Column) -> Column:
    """The pieces, long ones cut after words whose hash is a multiple of ``WORDS``."""
    ended = lambda w: F.when(F.xxhash64(w).bitwiseAND(WORDS - 1) == 0, F.concat(w, F.lit(_CUT))).otherwise(w)
    words = lambda p: F.split(F.replace(p, F.lit(" "), F.lit(" " + _CUT)), _CUT, -1)
    cut = lambda p: F.split(F.concat_ws("", F.transform(words(p), ended)), _CUT, -1)
    long = lambda p: _reaches(p, LONG_PIECE + 1)
    return F.when(F.exists(pieces, long), F.flatten(F.transform(pieces, lambda p: F.when(long(p), cut(p)).otherwise(F.array(p))))).otherwise(pieces)


def _chunked(df: DataFrame, within_lines: bool) -> DataFrame:
    """``df`` with its chunks ``__c`` for ``__text``. Steps are columns of their own where the next uses them twice."""
    pieces = df.withColumns({"__text": _escaped("__text"), "__wide": _wide("__text")})
    pieces = _with_cuts(pieces, "__text", F.col("__wide"), within_lines)
    pieces = pieces.withColumn("__p", F.split("__text", _CUT, -1)).drop("__text")
    pieces = pieces.withColumn("__p", _fine_pieces(F.col("__p"))) if within_lines else pieces
    hashed = pieces.withColumn("__h", F.transform("__p", lambda p: F.xxhash64(p)))
    # The rolling hash by itself first: beside a text, each look at an array of numbers costs more than the hash.
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice("__h", 1, F.size("__h") - 1))
    hashed = hashed.withColumn("__h", F.zip_with("__h", before, lambda h, b: F.xxhash64(h, b)))

    def ended(p: Column, rolling: Column) -> Column:
        short = (rolling.bitwiseAND(JOINED_SHORT) == 0) & ~_reaches(p, SHORT_PIECE)
        return F.when((rolling.bitwiseAND(JOINED - 1) == 0) | short, p).otherwise(F.concat(p, F.lit(_CUT)))

    return hashed.withColumn("__c", F.split(F.concat_ws("", F.zip_with("__p", "__h", ended)), _CUT, -1)).drop("__p", "__h")


def _total(a: Column, first: Column, last: Column) -> Column:
    """The sum of some elements. A slice would copy the whole array each time."""
    return F.aggregate(F.sequence(first, last), F.lit(0), lambda s, i: s + F.get(a, i))


def _chunk_table(rows: DataFrame, path: str, within_lines: bool) -> DataFrame:
    """A written row a text: ``__n``, the bytes of its chunks, ``__l``, the numbers of those that are compared, and ``__k``, their keys.

    Texts are cut once; where a chunk is wanted later, it is taken by its bytes.
    """
    chunked = _chunked(rows.select("__rid", "__text"), within_lines)
    large = F.filter(F.transform("__c", lambda c, i: F.when(_reaches(c, MIN_CHARS), i)), lambda i: i.isNotNull())
    chunked = chunked.withColumn("__l", large)
    return written(chunked.select(
        "__rid", F.xxhash64("__rid").alias("__hash"), F.transform("__c", lambda c: F.octet_length(c)).alias("__n"), "__l",
        F.transform("__l", lambda i: F.xxhash64(F.get("__c", i))).alias("__k"),
    ), path, ("__k.list.element",))


def _repeated(chunks: DataFrame, path: str) -> DataFrame:
    """``__rid, __n, __l, __at``, the last being the places in ``__l`` of the chunks whose key occurs again anywhere.

    Places go by 64 bits of a document's identity here. Where two documents share them, places of the one are candidates in the other
    too, which the comparison of bytes sorts out.
    """
    keys = chunks.select("__hash", F.posexplode("__k").alias("seq", "key"))
    # A table of its own, here and below, so that the join can be split where a key is hot.
    again = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), path, ("key",))
    places = keys.join(again.hint("shuffle_hash"), "key").groupBy("__hash").agg(F.sort_array(F.collect_set("seq")).alias("__at"))
    found = chunks.select("__rid", "__hash", "__n", "__l").join(places, "__hash").drop("__hash")
    # Here and not beside the join with the texts, where Spark would add up all blocks anew for each chunk.
    ends = lambda b: F.least(b * _BLOCK + _BLOCK, F.size("__n")) - 1
    starts = F.aggregate(
        F.sequence(F.lit(0), F.floor((F.size("__n") - 1) / _BLOCK).cast("int")), F.array(F.lit(0)),
        lambda s, b: F.array_append(s, F.element_at(s, -1) + _total(F.col("__n"), b * _BLOCK, ends(b))),
    )
    # Rows that repeat are one document, whose chunks are wanted once.
    return found.withColumn("__b", starts).dropDuplicates(["__rid"])


def _candidates(rows: DataFrame, to: str, within_lines: bool) -> DataFrame:
    """``__id, __rid, text, start, left, right`` of every chunk whose key is repeated, the last two where they end a row of such chunks; written to ``to``.

    ``start`` and all places and lengths after it count bytes.
    """
    # Hashing the small side, one row a document, spares sorting the texts.
    path = shared_dir(rows.sparkSession)
    repeated = _repeated(_chunk_table(rows, f"{path}/chunks", within_lines), f"{path}/again")
    known = rows.select("__rid", F.col("__row.doc_id").alias("__id"), "__text").join(repeated.hint("shuffle_hash"), "__rid")
    n = F.col("__n")

    def placed(j: Column, k: Column) -> Column:
        i = F.get("__l", j)
        b = F.floor(i / _BLOCK).cast("int")
        start = F.get("__b", b) + _total(n, b * _BLOCK, i) - F.get(n, i)
        beside = lambda d: F.coalesce((F.get("__at", k + d) == j + d) & (F.get("__l", j + d) == i + d), F.lit(False))
        first, last = F.get("__l", j - REACH), F.get("__l", j + REACH)
        # All that is before or after where there is no such chunk.
        left = F.when(first.isNotNull(), _total(n, first, i - 1)).otherwise(_ALL)
        right = F.when(last.isNotNull(), _total(n, i + 1, last)).otherwise(_ALL)
        return F.struct(
            start.alias("start"), F.get(n, i).alias("n"), F.when((i > 0) & ~beside(-1), left).alias("left"), F.when(~beside(1), right).alias("right"),
        )

    parts = known.withColumn("__at", F.transform(F.filter("__at", lambda j: j < F.size("__l")), placed))

    def found(text: Column, c: Column) -> Column:
        part = lambda start, n: F.substring(text, start + 1, n).cast("string")
        left = F.least(c["left"], c["start"])
        return F.struct(
            part(c["start"], c["n"]).alias("text"), c["start"].alias("start"),
            F.when(c["left"].isNotNull(), part(c["start"] - left, left)).alias("left"),
            F.when(c["right"].isNotNull(), part(c["start"] + c["n"], c["right"])).alias("right"),
        )

    # The bytes of a text as the one element of an array: a column of bytes would be copied for each chunk.
    all_found = F.transform(F.array(_escaped("__text").cast("binary")), lambda text: F.transform("__at", lambda c: found(text, c)))
    out = written(parts.select("__id", "__rid", F.inline_outer(F.get(all_found, F.lit(0)))), to, ("text", "left", "right"))
    removed(rows.sparkSession, path)
    return out


def _same(a: Column, b: Column) -> Column:
    """Number of equal elements at the start of two arrays."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def _narrowed(df: DataFrame, sides: tuple) -> DataFrame:
    """``df`` with what is to be compared for each side (``own``, ``first``, whether before a chunk) in place of its two texts.

    Where they are equal, ``own`` + ``_size`` has their bytes and nothing is left to compare, as where one is null. Texts that differ
    early are cut short.
    """
    df = df.withColumns({f"{own}_equal": F.when(F.col(own).isNotNull() & F.col(first).isNotNull(), F.col(own) == F.col(first)) for own, first, _ in sides})
    part = lambda t, n, before: F.substring(F.col(t).cast("binary"), -n if before else F.lit(1), n)
    near, far = _NEAR

    def reach(own: str, first: str, before: bool) -> Column:
        differ = lambda n: part(own, F.lit(n - _SPARE), before) != part(first, F.lit(n - _SPARE), before)
        return F.when(~F.col(f"{own}_equal"), F.when(differ(near), near).when(differ(far), far).otherwise(_ALL))

    df = df.withColumns({f"{own}_n": reach(own, first, before) for own, first, before in sides})
    new = {}
    for own, first, before in sides:
        n = F.col(f"{own}_n")
        new |= {f"{own}_size": F.when(F.col(f"{own}_equal"), F.octet_length(own))}
        new |= {t: F.when(n < _ALL, part(t, n, before).cast("string")).when(n == _ALL, F.col(t)) for t in (own, first)}
    return df.withColumns(new).drop(*(f"{own}_{x}" for own, _, _ in sides for x in ("equal", "n")))


def _reached(df: DataFrame, own: str, first: str, before: bool, within_lines: bool) -> DataFrame:
    """``df`` with the bytes (column ``own``) that two texts share at their start, or before a chunk at their end.

    Whole pieces count, and of the next piece the equal words; where these are so few that they may be chance, their
    bytes stand in a column of their own (``own`` + ``_few``). Each step is a column that the next uses twice, so that
    Spark keeps them apart. Where a text is null nothing is shared but what is known (``own`` + ``_size``).
    """
    order = F.reverse if before else (lambda x: x)
    a, b, x, y, n = (F.col(f"__{c}") for c in "abxyn")
    df = df.withColumns({"__a": F.col(own), "__b": F.col(first), "__x": _wide(own), "__y": _wide(first)}).drop(own, first)
    df = _with_cuts(_with_cuts(df, "__a", x, within_lines), "__b", y, within_lines)
    df = df.withColumns({c: order(F.split(c, _CUT, -1)) for c in ("__a", "__b")}).withColumn("__n", _same(a, b))
    ends = _TOKEN_END if before else _TOKEN_ENDS
    df = df.withColumns({"__x": order(F.split(F.get(a, n), ends, -1)), "__y": order(F.split(F.get(b, n), ends, -1)), "__a": F.slice(a, 1, n)})
    df = df.withColumn("__x", F.array_join(F.slice(x, 1, _same(x, y)), ""))
    enough = F.regexp_count(x, F.lit(_WORD)) >= MIN_SHARED
    more = lambda c: F.when(c, F.octet_length(x)).otherwise(0)
    size = F.coalesce(F.col(f"{own}_size"), F.octet_length(F.array_join(a, "")) + more(enough), F.lit(0))
    return df.withColumns({own: size, f"{own}_few": F.coalesce(more(~enough), F.lit(0))}).drop("__a", "__b", "__n", "__x", "__y", f"{own}_size")


def repeated_spans(found: DataFrame, within_lines: bool = True) -> DataFrame:
    """``__rid, start, end`` of the repeats to remove among candidates (``__id, __rid, text, start, left, right``)."""
    return _spans(found, within_lines).select("__rid", "start", "end").distinct()


def _spans(found: DataFrame, within_lines: bool) -> DataFrame:
    """The repeats with ``from`` and ``to``, their ends with the few words beside them that may be equal by chance."""
    place = F.struct("__id", "__rid", "start")
    first = found.groupBy("text").agg(F.count("*").alias("n"), F.min(F.struct("__id", "__rid", "start", "left", "right")).alias("f")).where("n > 1").drop("n")
    later = found.join(written(first, plain=("text", "f.left", "f.right")).hint("shuffle_hash"), "text").where(~place.eqNullSafe(F.struct("f.__id", "f.__rid", "f.start")))
    later = later.select("__rid", "start", F.octet_length("text").alias("n"), "left", "right", F.col("f.left").alias("first_left"), F.col("f.right").alias("first_right"))
    sides = ("left", "first_left", True), ("right", "first_right", False)
    later = _narrowed(later, sides)
    for side in sides:
        later = _reached(later, *side, within_lines)
    start, end = F.col("start") - F.col("left"), F.col("start") + F.col("n") + F.col("right")
    spans = later.select("__rid", start.alias("start"), end.alias("end"), (start - F.col("left_few")).alias("from"), (end + F.col("right_few")).alias("to"))
    # By document at once, as the runs want them, not first by all columns.
    return spans.repartition("__rid").distinct()


def _runs(spans: DataFrame) -> DataFrame:
    """``__rid, __runs``: per document the spans that adjoin or overlap as one run each, with their number."""
    w = Window.partitionBy("__rid").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    runs = new.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("__rid", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").cast("int").alias("n"), F.min("from").alias("from"), F.max("to").alias("to"))
    return runs.groupBy("__rid").agg(F.sort_array(F.collect_list(F.struct("start", "end", "n", "from", "to"))).alias("__runs"))


def _breaks(text: Column) -> Column:
    """Number of line breaks."""
    return F.size(F.split(text, "\n", -1)) - 1


def _cut(rows: DataFrame, within_lines: bool) -> DataFrame:
    """Packed rows with ``__cut`` (the number of removed chunks, or null) and ``__left`` (the text left)."""
    path = shared_dir(rows.sparkSession)
    spans = written(_runs(_spans(_candidates(rows, path, within_lines), within_lines)))
    removed(rows.sparkSession, path)
    joined = rows.drop("__text").join(spans.hint("shuffle_hash"), "__rid", "left")
    joined = joined.withColumn("__e", F.when(F.col("__runs").isNotNull(), _escaped("__row.text").cast("binary")))
    between = lambda e, a, b: F.substring(e, a + 1, b - a).cast("string")
    part = lambda e, r: between(e, r["start"], r["end"])
    # As the one element of an array, since a column of bytes would be copied for each part.
    of_bytes = lambda f: F.get(F.transform(F.array("__e"), lambda e: F.transform("__runs", lambda r, k: f(e, r, k))), F.lit(0))
    count = lambda text: 2 * F.regexp_count(text, F.lit(_WORD))
    ideographs = lambda text: F.regexp_count(text, F.lit(_IDEOGRAPH))
    many = lambda text: (count(text) >= 2 * MIN_WORDS) | ((F.octet_length(text) > F.length(text)) & (count(text) + ideographs(text) >= 2 * MIN_WORDS))
    # Where the first bytes hold words enough the others needn't be counted.
    words = lambda e, a, b: ((b - a > _HEAD) & many(between(e, a, a + _HEAD))) | many(between(e, a, b))

    def passage(e: Column, r: Column, k: Column) -> Column:
        """The run if it is a passage, with the few words beside it if only they make it one; else null."""
        inside = (r["start"] > 0) & (between(e, r["start"] - 1, r["start"]) != "\n")
        wide = F.struct(r["from"].alias("start"), r["to"].alias("end"), r["n"].alias("n"))
        own = F.struct(r["start"].alias("start"), r["end"].alias("end"), r["n"].alias("n"))
        return F.when(words(e, r["start"], r["end"]) | (_breaks(part(e, r)) - inside.cast("int") >= MIN_LINES), own).when(words(e, r["from"], r["to"]), wide)

    sized = joined.withColumn("__runs", F.array_compact(of_bytes(passage)))

    def kept(e: Column, r: Column, k: Column) -> Column:
        since = F.when(k > 0, F.get("__runs", k - 1)["end"]).otherwise(0)
        return F.concat(between(e, since, r["start"]), F.lit(_CUT), F.when(F.contains(part(e, r), F.lit("\n")), "\n").otherwise(""))

    tail = between(F.col("__e"), F.element_at("__runs", -1)["end"], F.length("__e"))
    text = F.concat(F.array_join(of_bytes(kept), ""), tail)
    # A passage from the start of a line takes its line break along; one from inside a line leaves a break if it held one,
    # and one at the end of the text takes the break before it.
    gone = r"(?:\x00\n?)"
    for pattern, new in ((rf"\n?{gone}+\z", ""), (rf"(^|\n){gone}+", "$1"), (rf"\x00+\n{gone}*", "\n")):
        text = F.regexp_replace(text, pattern, new)
    text = _unescaped(F.replace(text, F.lit(_CUT), F.lit("")))
    some = F.size("__runs") > 0
    total = F.aggregate("__runs", F.lit(0), lambda s, r: s + r["n"])
    return sized.select("__row", "__rid", F.when(some, total).alias("__cut"), F.when(some, text).otherwise(F.col("__row.text")).alias("__left"))


def line_dedup_report(docs: DataFrame, within_lines: bool = True) -> DataFrame:
    """Per document the text that is left, the number of repeated chunks removed and of the line breaks that went."""
    return _cut(packed(docs), within_lines).select(
        F.col("__row.doc_id").alias("doc_id"),
        F.col("__left").alias("text"),
        F.coalesce("__cut", F.lit(0)).alias("n_removed_chunks"),
        F.when(F.col("__cut").isNull(), 0).otherwise(_breaks(F.col("__row.text")) - _breaks(F.col("__left"))).alias("n_removed_lines"),
    )


def dedup_lines(docs: DataFrame, within_lines: bool = True) -> DataFrame:
    """``docs`` without repeated passages; a document of which only blanks are left after a removal goes."""
    # The outer form keeps Spark from filtering below the cut, for which it would make it twice.
    stays = F.filter(F.array(F.struct("__left")), lambda x: F.col("__cut").isNull() | x["__left"].rlike(r"\S"))
    out = _cut(packed(docs), within_lines).select("__row", F.explode_outer(stays).alias("x")).where("x is not null")
    return unpacked(out, docs.columns, F.col("x.__left"))
