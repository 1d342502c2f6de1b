"""The training-data operators against brute force on the small tables, and their defined cases."""

import base64
import collections
import functools
import hashlib
import itertools
import math
import random
import re
import struct
import time
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.oracle import difference
from txnflow.llm import bpe, decontaminate, html_text, licenses, line_dedup, near_dup, quality_qda, quality_rules, tool_calls, toxicity
from txnflow.llm.registry import ORACLES, PATTERN, QUERIES, RANKS

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, `__rid` string, k1 int, rid int, start int"
BLANK = re.compile("[ \t\n\x0b\x0c\r]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text").collect()


def frame(spark, *texts, schema=DOCS):
    """Documents 1, 2, ... with other columns whose names clash; a pair gives its own id."""
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), "x", 1, 2, 3) for i, t in pairs], schema)


LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = ((None, "an odd row without any id at all, but it has words."), None, "", " \n\t ", LONG, "same text here", "same text here", (6, "same text here"), (6, "same text here"))


def spread(spark, name, d):
    """Each operator that maps documents to rows, over any documents."""
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"), (3, "too short")], "item_id long, text string")
    return {
        "line": lambda: line_dedup.line_dedup_report(d),
        "bpe": lambda: bpe.token_report(spark, d, RANKS, PATTERN),
        "near": lambda: near_dup.near_duplicates(d),
        "license": lambda: licenses.license_report(d),
        "rules": lambda: quality_rules.quality_report(d),
        "toxic": lambda: toxicity.toxicity_scores(d, labels),
        "quality": lambda: quality_qda.quality_scores(d, labels),
        "leaks": lambda: decontaminate.leak_report(d, bench),
        "cleaned": lambda: quality_rules.clean_documents(d),
        "deduped": lambda: line_dedup.dedup_lines(d),
        "single": lambda: near_dup.drop_near_duplicates(d),
        "clean": lambda: decontaminate.decontaminate(d, bench),
        "encoded": lambda: bpe.encode_documents(spark, d, RANKS, PATTERN),
    }[name]()


NAMES = ["line", "bpe", "near", "license", "rules", "toxic", "quality", "leaks", "cleaned", "deduped", "single", "clean", "encoded"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_empty_table(spark, name):
    d = frame(spark, *ODD)
    out = spread(spark, name, d).collect()
    if name in NAMES[:7] or name == "encoded":
        assert len(out) == len(ODD)
    if name in ("cleaned", "deduped", "single", "clean"):
        assert set(out[0].asDict()) == set(d.columns) and len(out) <= len(ODD)
    if name == "near":
        assert sorted((r.doc_id, r.class_id, r.n_links) for r in out if r.doc_id == 6) == [(6, 6, 3)] * 3
        assert {(r.class_id, r.n_links) for r in out if r.doc_id in (2, 3, 4)} == {(2, 0), (3, 0), (4, 0)}
    if name == "leaks":
        assert [(r.doc_id, r.item_id, r.overlap) for r in out] == [(5, 3, 1.0)]
    assert spread(spark, name, d.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    assert difference(QUERIES[name](spark, SF), ORACLES[name], SF) == ""


def test_tool_calls_cases(spark):
    calls = spark.createDataFrame(
        [
            (1, "a", 5, "lookup", '{"query": "x", "chars": 2}', ["b"]), (1, "b", 6, "lookup", '{"chars": 2.5, "query": "x"}', ["gone"]),
            (1, "b", 7, "write", "{}", None), (1, "c", 8, "lookup", '{"chars": 1}', ["c"]), (1, "d", 9, "none", "[1]", ["c"]),
            (2, "a", 1, "compute", '{"chars": 1, "scale": 3, "more": 1}', None), (2, "e", 2, "compute", '{"scale":null,"chars":1}', ["a"]), (None, "z", 1, "compute", None, None),
            (3, None, 1, "compute", None, None), (3, "f", None, None, None, None),
        ],
        "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([(1, "a", "z"), (1, "a", "y"), (2, "e", None), (None, "a", "q")], "conv_id long, call_id string, content string")
    schemas = spark.createDataFrame(tool_calls.TOOLS, "name string, arg string, type string, required boolean")
    out = {(r.conv_id, r.call_id): r for r in tool_calls.link_tool_calls(calls, results, schemas).collect()}
    assert {k: (r.level, r.linked, r.valid) for k, r in out.items()} == {
        (1, "a"): (1, True, True), (1, "b"): (0, False, False), (1, "c"): (None, False, False), (1, "d"): (None, False, False),
        (2, "a"): (0, False, False), (2, "e"): (1, True, True), (3, "f"): (0, False, False),
    }
    assert out[1, "a"].json == '{"arguments":{"chars":2,"query":"x"},"call_id":"a","level":1,"name":"lookup","result":"y","valid":true}'
    assert out[3, "f"].json == '{"arguments":null,"call_id":"f","level":0,"name":null,"result":null,"valid":false}'
    assert tool_calls.link_tool_calls(calls.where("false"), results, schemas).count() == 0


def test_tool_call_schemas_and_empty_tables(spark):
    """Other columns of the schemas don't clash, rows that disagree have a defined order, and large whole numbers are integers."""
    calls = spark.createDataFrame([(1, "a", 1, "t", '{"n": 123456789012345678901234567890, "m": 1.5}', None)], "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, "a", "x" * 300_000)], "conv_id long, call_id string, content string")
    wide = "name string, arg string, type string, required boolean, conv_id long, call_id string, content string"
    schemas = spark.createDataFrame([("t", "n", "integer", True, 1, "a", "b"), ("t", "n", "string", False, 1, "a", "b"), ("t", "m", "number", False, None, None, None)], wide)
    (r,) = tool_calls.link_tool_calls(calls, results, schemas).collect()
    assert (r.level, r.linked, r.valid) == (0, True, True) and len(r.json) > 300_000
    (r,) = tool_calls.link_tool_calls(calls, results.where("false"), schemas.where("false")).collect()
    assert (r.level, r.linked, r.valid) == (0, False, False)


def test_tool_call_schemas_of_any_number(spark, monkeypatch):
    """Above the bound of the broadcast the schemas are joined by shuffle, with the same rows."""
    calls, results = tool_calls.calls_of_conversations(spark.read.parquet(f"{SF}/conversations.parquet").where("conv_id < 40"))
    schemas = spark.createDataFrame(tool_calls.TOOLS, "name string, arg string, type string, required boolean")
    want = sorted(map(tuple, tool_calls.link_tool_calls(calls, results, schemas).collect()))
    monkeypatch.setattr(tool_calls, "MAX_SCHEMA", 2)
    assert sorted(map(tuple, tool_calls.link_tool_calls(calls, results, schemas).collect())) == want and want


def test_tool_call_long_chain(spark):
    """A chain of 600 calls against the order of turns ends in few rounds."""
    rows = [(1, f"c{i:03}", 600 - i, "t", "{}", [f"c{i - 1:03}"] if i else None) for i in range(600)]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    assert sorted(r.level for r in tool_calls.levels(calls).collect()) == list(range(600))


@pytest.mark.parametrize("size", [4, 256])
def test_tool_call_levels_by_brute_force(spark, monkeypatch, size):
    """Levels follow the dependencies alone, whatever the order of turns and the size of blocks."""
    monkeypatch.setattr(tool_calls, "BLOCK_CALLS", size)
    rng, rows, expected = random.Random(3), [], {}
    for conv in range(8):
        n = 30 + conv
        on = {i: sorted({j for j in (i - 1, i - 2, rng.randrange(n)) if 0 <= j < i}) for i in range(n)}
        if conv == 7:
            on[3] = [5]  # a cycle: 3, 4 and 5 and all behind them
        turns = list(range(n)) if conv < 3 else list(range(n, 0, -1)) if conv < 5 else rng.sample(range(n), n)
        level = {}
        for i in range(n) if conv != 7 else range(3):
            level[i] = 1 + max((level[j] for j in on[i]), default=-1)
        expected |= {(conv, f"c{i}"): level.get(i) for i in range(n)}
        rows += [(conv, f"c{i}", turns[i], "lookup", "{}", [f"c{j}" for j in on[i]]) for i in range(n)]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    assert {(r.conv_id, r.call_id): r.level for r in tool_calls.levels(calls).collect()} == expected


def test_tool_call_chains_span_the_conversation(spark):
    """A call of the conversations table depends on the two before it, so its level is its place in a whole conversation."""
    talk = spark.createDataFrame([(c, t, "assistant" if t % 2 else "user", f"turn {t}") for c in (4, 5) for t in range(60)], "conv_id long, turn long, role string, text string")
    calls, results = tool_calls.calls_of_conversations(talk)
    schemas = spark.createDataFrame(tool_calls.TOOLS, "name string, arg string, type string, required boolean")
    out = tool_calls.link_tool_calls(calls, results, schemas).collect()
    assert len(out) == 60 and all(r.level == r.turn // 2 and f'"level":{r.level},' in r.json for r in out)


def test_line_dedup_keeps_first_and_all_else(spark):
    lines = [f"line {i} with some words of its own, number {i * 7919 % 1000}." for i in range(40)]
    passage = "\n".join(f"shared sentence {i}, which stands in many documents." for i in range(30))
    texts = ["\n".join(lines[k : k + 8]) + "\n" + passage + "\n" + "\n".join(lines[k + 8 : k + 16]) for k in (0, 16)]
    d = frame(spark, *texts, "\n".join(lines[32:40]), "a\nb", "")
    out = {r.doc_id: r for r in line_dedup.line_dedup_report(d).collect()}
    assert out[1].text == texts[0] and out[3].text == "\n".join(lines[32:40]) and out[4].text == "a\nb"
    left = out[2].text.split("\n")
    own = lambda lines: [x for x in lines if x.startswith("line")]
    assert own(texts[1].split("\n")) == own(left)  # of shared lines a piece can stay
    assert sum(x.startswith("shared") for x in left) < 15 and out[2].n_removed_lines == len(texts[1].split("\n")) - len(left)
    kept = {r.doc_id for r in line_dedup.dedup_lines(d.union(d.where("doc_id = 1").withColumn("doc_id", F.lit(9).cast("long")))).collect()}
    assert kept == {1, 2, 3, 4, 5}  # the copy goes: nothing of it is left


def test_line_dedup_finds_passages_inside_lines(spark):
    """The passage starts and ends in the middle of lines; short pieces that recur by themselves stay."""
    passage = " ".join(f"Shared {i} with a few words, and more of it {i * 37 % 101}." for i in range(8))
    own = lambda d, n: f"document {d} says things {n} of its own. Yes. No {n} {d}"
    texts = [f"{own(d, 1)}\n{own(d, 2)} {passage} {own(d, 3)}\n{own(d, 4)}" for d in range(6)]
    out = {r.doc_id: r for r in line_dedup.line_dedup_report(frame(spark, *texts)).collect()}
    assert out[1].text == texts[0] and out[1].n_removed_chunks == 0
    for d in range(1, 6):
        r = out[d + 1]
        lines = r.text.split("\n")
        assert len(lines) == 3 and r.n_removed_lines == 0 and lines[0] == own(d, 1) and lines[2] == own(d, 4)
        assert lines[1].startswith(own(d, 2)) and lines[1].endswith(own(d, 3))
        assert 0 < r.n_removed_chunks and lines[1].count("Shared") <= 4


def test_line_dedup_leaves_short_remarks(spark):
    """Two common clauses in a sentence are no passage; fifty words are, and so are three whole lines."""
    own = lambda d, n: f"Document {d} has a sentence {n} of its own"
    remark = "as far as anybody can tell from here, this is what people usually say about it, more or less, in such cases, and so on."
    lines = "\n".join(f"Common line {i}, which has some more words in it, {i * 7} of them." for i in range(12))
    long = " ".join(f"Long sentence {i}, with a few more words than that {i * 37 % 101}, and an end." for i in range(12))
    texts = [f"{own(d, 1)}, {remark} {own(d, 2)}.\n{own(d, 3)}.\n{x}\n{own(d, 4)}." for d, x in enumerate(["none", "nothing", lines, lines, long, long])]
    out = {r.doc_id: r for r in line_dedup.line_dedup_report(frame(spark, *texts)).collect()}
    assert [out[d].text == texts[d - 1] for d in range(1, 7)] == [True, True, True, False, True, False]
    for d in (4, 6):
        assert remark in out[d].text and own(d - 1, 4) in out[d].text and out[d].n_removed_chunks > 0


def test_line_dedup_keeps_one_of_equal_lines(spark):
    """However the chunks of the cuts overlap, every distinct line is still somewhere, and more cuts find more."""
    passages = [[f"passage {p} line {i} with words" for i in range(9)] for p in range(6)]
    texts = ["\n".join(line for p in range(6) for line in [f"own line {d} {p}", *passages[(d * 5 + p * p) % 6]]) for d in range(12)]
    left = [r.text for r in line_dedup.line_dedup_report(frame(spark, *texts)).collect()]
    assert {x for t in left for x in t.split("\n")} == {x for t in texts for x in t.split("\n")}
    assert sum(map(len, left)) < 0.7 * sum(map(len, texts))


def test_line_dedup_compares_bytes(spark):
    """Candidates come by key; only equal bytes are removed, and only words equal beside both places are added."""
    rows = [
        (1, b"1", "a b ", 0, None, "c d e f g "), (2, b"2", "a b ", 5, None, "c d e f x "), (1, b"1", "k ", 30, None, None), (3, b"3", "q ", 0, None, None),
        (None, b"0", "z ", 4, "u e f g h ", None), (1, b"1", "z ", 50, "w e f g h ", None), (4, b"4", "z ", 0, "f g h ", None),
    ]
    found = spark.createDataFrame(rows, "`__id` long, `__rid` binary, text string, start int, left string, right string")
    assert sorted(tuple(r) for r in line_dedup.repeated_spans(found).collect()) == [(b"1", 42, 52), (b"2", 5, 17), (b"4", 0, 2)]


def test_line_dedup_zero_characters_and_breaks(spark):
    """Zero characters of a text are not taken for marks; a passage inside a line leaves the line break it held."""
    passage = "".join(f"Shared \0{i} sentence, with more \0\1 of it {i * 37 % 101}; and an end.{' ' if i % 5 else chr(10)}" for i in range(16))
    texts = [f"Own \0 start {d} of it\0\3, {passage}tail {d} \0\2 after it.\nlast {d}" for d in range(3)]
    out = {r.doc_id: r.text for r in line_dedup.line_dedup_report(frame(spark, *texts)).collect()}
    assert out[1] == texts[0]
    assert all(out[d + 1] == f"Own \0 start {d} of it\0\3, \ntail {d} \0\2 after it.\nlast {d}" for d in (1, 2))


PIECE_END = re.compile(r"(?<=[.!?,;:] )|(?<=[\n。！？])")


def fine_pieces(text):
    """The pieces of a text; those of over 80 characters end after words whose hash is a multiple of 8 as well."""
    for p in re.split(PIECE_END, text):
        part = ""
        for w in re.split("(?<= )", p) if len(p) > 80 else ():
            part += w
            if xxhash.xxh64_intdigest(w.encode(), 42) % 8 == 0:
                yield part
                part = ""
        yield part if len(p) > 80 else p


def rebuilt_without_repeats(rows):
    """What line dedup leaves, by plain loops over chunks, first places, words beside them and runs."""
    signed = lambda b, seed=42: xxhash.xxh64_intdigest(b, seed)
    chunked, n, first, at = {}, collections.Counter(), {}, {}
    for d, text in sorted((r.doc_id, r.text or "") for r in rows):
        pieces = fine_pieces(text)
        chunks, last, prev = [""], 0, None
        for p in pieces:
            h = signed(p.encode())
            rolling = signed(struct.pack("<Q", h))
            if prev is not None:
                rolling = signed(struct.pack("<Q", prev), rolling)
            chunks[-1] += p
            prev = h
            if rolling % 8 and (len(p) >= line_dedup.SHORT_PIECE or rolling & 8):
                chunks.append("")
        chunked[d] = chunks
        at[d] = list(itertools.accumulate(map(len, chunks), initial=0))
        for i, c in enumerate(chunks):
            if len(c) >= line_dedup.MIN_CHARS:
                n[c] += 1
                first.setdefault(c, (d, i))
    known = lambda d, i: 0 <= i < len(chunked[d]) and len(chunked[d][i]) >= line_dedup.MIN_CHARS and n[chunked[d][i]] > 1

    def shared(a, b, order):
        """Characters of equal pieces and of the equal words of the next piece where they are enough; those of fewer words."""
        split = lambda text, cut: re.split(cut, text)[::order]
        word_end = r"(?<=[ \n])|(?=[ \n])" if order > 0 else r"(?<=[ \n])"
        equal = lambda x, y: [v for v, _ in itertools.takewhile(lambda p: p[0] == p[1], zip(x, y))]
        a, b = split("".join(a), PIECE_END), split("".join(b), PIECE_END)
        same = equal(a, b)
        k = len(same)
        part = "".join(equal(split(a[k], word_end), split(b[k], word_end))) if k < min(len(a), len(b)) else ""
        enough = len(part.split()) >= line_dedup.MIN_SHARED
        return len("".join(same)) + len(part) * enough, len(part) * (not enough)

    def beside(c, i, order):
        """The chunks before or after one, as far as the third that is compared by its key."""
        side = c[i + 1 :] if order > 0 else c[:i][::-1]
        large = [k for k, x in enumerate(side, 1) if len(x) >= line_dedup.MIN_CHARS]
        return side[: large[2] if len(large) > 2 else len(side)][::order]

    out = {}
    for d, chunks in chunked.items():
        text, gone, spans = "".join(chunks), set(), []
        for i, c in enumerate(chunks):
            if not known(d, i) or first[c] == (d, i):
                continue
            e, j = first[c]
            lo, hi, before, after = at[d][i], at[d][i] + len(c), 0, 0
            if not known(d, i + 1) and not known(e, j + 1):
                more, after = shared(beside(chunks, i, 1), beside(chunked[e], j, 1), 1)
                hi += more
            if i and j and not known(d, i - 1) and not known(e, j - 1):
                more, before = shared(beside(chunks, i, -1), beside(chunked[e], j, -1), -1)
                lo -= more
            gone.update(range(lo, hi))
            spans.append((lo, hi, lo - before, hi + after))
        passages = set()
        for is_gone, run in itertools.groupby(range(len(text)), gone.__contains__):
            run = list(run)
            lo, hi = run[0], run[-1] + 1
            own = [s for s in spans if lo <= s[0] < hi] if is_gone else []
            wide = range(min(s[2] for s in own), max(s[3] for s in own)) if own else ()
            words = lambda r: len(text[r[0] : r[-1] + 1].encode().split()) + len(re.findall("[\u2e80-\u9fff\uf900-\ufaff]", text[r[0] : r[-1] + 1])) / 2
            inside = lo > 0 and text[lo - 1] != "\n"
            if own and (words(run) >= line_dedup.MIN_WORDS or text[lo:hi].count("\n") - inside >= line_dedup.MIN_LINES):
                passages.update(run)
            elif own and words(wide) >= line_dedup.MIN_WORDS:
                passages.update(wide)
        left = []
        for is_gone, run in itertools.groupby(range(len(text)), passages.__contains__):
            run = list(run)
            part = text[run[0] : run[-1] + 1]
            if not is_gone:
                left.append(part)
            elif run[-1] + 1 == len(text):
                left = ["".join(left).removesuffix("\n")]
            elif "\n" in part and "".join(left)[-1:] not in ("", "\n"):
                left.append("\n")
        out[d] = "".join(left)
    return out


def test_line_dedup_by_brute_force(docs, rows):
    """Every text of the table as rebuilt by loops, to the byte."""
    expected = rebuilt_without_repeats(rows)
    got = {r.doc_id: r.text for r in line_dedup.line_dedup_report(docs).collect()}
    assert {d: (t or "") for d, t in got.items()} == expected
    assert sum(expected[r.doc_id] != (r.text or "") for r in rows) > 50


def test_line_dedup_of_odd_texts_by_brute_force(spark):
    """Passages among characters of several bytes, blanks in a row, stops without blanks and line breaks, as rebuilt by loops."""
    rng = random.Random(5)
    ends = [" "] * 12 + [". ", ", ", "; ", "  ", " \n", "\n", "。", "é ", " ！", "。 ", ".\n"]
    say = lambda n, pool: "".join(f"{pool}{rng.randrange(400)}" + rng.choice(ends) for _ in range(n))
    passages = [say(rng.randrange(60, 140), pool) for pool in ("w", "wörter", "词语", "x", "né", "k") for _ in range(2)]
    texts = []
    for d in range(60):
        near = [say(rng.randrange(1, 20), rng.choice(("w", "own", "词"))) for _ in range(4)]
        parts = [p if rng.random() < 0.8 else p[rng.randrange(40) : len(p) - rng.randrange(40)] for p in rng.sample(passages, 3)]
        texts.append("".join(x for pair in zip(near, [*parts, ""]) for x in pair))
    d = frame(spark, *texts)
    expected = rebuilt_without_repeats(d.collect())
    assert {r.doc_id: r.text for r in line_dedup.line_dedup_report(d).collect()} == expected
    assert sum(expected[i] != t for i, t in enumerate(texts, 1)) > 30


def test_line_dedup_cuts_texts_once_and_drops_its_tables(spark, monkeypatch):
    """Candidates are taken from the texts by the bytes of their chunks; of the tables written on the way two stay."""
    cut, calls = line_dedup._chunked, []
    monkeypatch.setattr(line_dedup, "_chunked", lambda *a: calls.append(a) or cut(*a))
    base = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(base.iterdir())
    passage = "\n".join(f"shared sentence {i}, which stands in two documents." for i in range(30))
    out = line_dedup.line_dedup_report(frame(spark, f"own\n{passage}", f"other\n{passage}"))
    assert len(calls) == 1 and len(set(base.iterdir()) - before) <= 2
    assert sum(len(r.text) for r in out.collect()) < 1.5 * len(passage)


def test_line_dedup_chunks_at_the_limits(spark):
    """Pieces and chunks one character below, at and above each limit, in characters of one byte and of several, and hashes of neighbours."""
    sizes = [n + d for n in (line_dedup.SHORT_PIECE, line_dedup.MIN_CHARS, line_dedup.LONG_PIECE) for d in (-2, -1, 0, 1)]
    texts = ["".join(f"{c * 3}{i} ".ljust(n - 2, c) + ". " for i, n in enumerate(sizes * 6)) for c in "aéж文"]
    rows = frame(spark, *texts).selectExpr("doc_id as __rid", "text as __text")
    for r in line_dedup._chunked(rows, True).collect():
        chunks, prev = [""], None
        for p in fine_pieces(texts[r["__rid"] - 1]):
            h = xxhash.xxh64_intdigest(p.encode(), 42)
            rolling = xxhash.xxh64_intdigest(struct.pack("<Q", h), 42)
            rolling = rolling if prev is None else xxhash.xxh64_intdigest(struct.pack("<Q", prev), rolling)
            chunks[-1] += p
            prev = h
            if rolling % 8 and (len(p) >= line_dedup.SHORT_PIECE or rolling & 8):
                chunks.append("")
        assert r["__c"] == chunks


def test_line_dedup_cuts_only_what_may_be_shared(spark, monkeypatch):
    """Beside equal chunks equal texts aren't cut into pieces, nor are texts behind an early difference; what they share stays the same."""
    rng = random.Random(7)
    say = lambda n, pool: "".join(rng.choice(pool) * rng.randrange(1, 5) + rng.choice([" "] * 6 + [". ", ", ", "\n", "。", "! "]) for _ in range(n))
    rows = []
    for limit in (64, 256):
        for size in range(limit - 14, limit + 6):
            for pool in ("abc", "aé文", "b𝄞é"):
                common = say(limit, pool).encode()[:size].decode(errors="ignore")
                ends = [say(k, pool) for k in rng.sample((0, 1, 2, 90), 2)]
                rows.append((*(common + e for e in ends), *(e + common for e in ends)))
    rows += [("equal, here. ", "equal, here. ", "and there. ", "and there. "), (None, "one", "two", None), ("", "", "", "more")]
    d = spark.createDataFrame(rows, "right string, first_right string, left string, first_left string").repartition(4)
    d = d.withColumns({"r": F.col("right"), "s": F.col("first_right"), "l": F.col("left"), "m": F.col("first_left")})
    sides = (("left", "first_left", True), ("right", "first_right", False))

    def shared():
        out = line_dedup._narrowed(d, sides)
        for side in sides:
            out = line_dedup._reached(out, *side, True)
        return sorted(map(tuple, out.select("r", "s", "l", "m", "left", "left_few", "right", "right_few").collect()), key=str)

    for r in line_dedup._narrowed(d, sides).collect():
        for own, first, text, other, step in ((r.right, r.first_right, r.r, r.s, 1), (r.left, r.first_left, r.l, r.m, -1)):
            if text is None or other is None or text == other:
                assert own is None and first is None
            elif text.encode()[::step][:56] != other.encode()[::step][:56]:
                assert len(own) <= 64 and len(first) <= 64
    got = shared()
    monkeypatch.setattr(line_dedup, "_NEAR", (2**20, 2**20))
    assert got == shared() and sum(r[6] > 40 for r in got) > 50


def test_line_dedup_of_passages_with_any_marks_or_none(spark):
    """Shared passages of 50 words and more go from the second document, whatever ends their sentences."""
    say = lambda i: f"w{i * 7919 % 997} v{i * 104729 % 991}"
    passages = [
        " ".join(say(i) for i in range(40)),
        " ".join(f"{say(3 * i)} {say(3 * i + 1)} {say(3 * i + 2)} on and on!" for i in range(100, 108)),
        "".join(f"第{i * 7919 % 997}句话说的是{i * 31 % 89}件不同的事情。" for i in range(40)),
        " ".join(f"{say(2 * i)} {say(2 * i + 1)}{'?;:'[i % 3]}" for i in range(300, 320)),
        "of. it. " * 60 + " ".join(say(i) for i in range(500, 540)) + " so. on. " * 40,  # many chunks too short for a key
    ]
    texts = [f"Own words of {d} {p} other words {d} at the end." for p in passages for d in (1, 2)]
    out = [r.text for r in sorted(line_dedup.line_dedup_report(frame(spark, *texts)).collect(), key=lambda r: r.doc_id)]
    for i, p in enumerate(passages):
        assert out[2 * i] == texts[2 * i]
        assert len(out[2 * i + 1]) <= len(texts[2 * i + 1]) - 0.8 * len(p), i


def test_line_dedup_by_whole_lines(spark):
    """Without cuts inside lines only passages of whole lines go."""
    lines = "\n".join(f"common line {i} with a number of words in it {i * 7919 % 1000}" for i in range(24))
    inside = " ".join(f"Shared {i} with a few words, and more of it {i * 37 % 101}." for i in range(24))
    texts = [f"Own {d} line\n{lines}\nline {d} ends" for d in range(2)] + [f"Own {d} words {inside} {d} at its end" for d in (7, 8)]
    out = [r.text for r in sorted(line_dedup.line_dedup_report(frame(spark, *texts), within_lines=False).collect(), key=lambda r: r.doc_id)]
    assert [a == b for a, b in zip(out, texts)] == [True, False, True, True] and out[1] == "Own 1 line\nline 1 ends"


def test_line_dedup_survives_a_variant(spark):
    """A copy with other marks shares all keys with the passage; the equal copies still go, and the variant stays."""
    passage = "\n".join(f"Sentence {i} of the passage, which stands in three documents; it is number {i * 37 % 101}." for i in range(12))
    variant = passage.replace("passage, which", "passage; which")
    texts = [f"Own words of document {d}.\n{x}\nMore of document {d}." for d, x in enumerate([passage, variant, passage, passage])]
    out = {r.doc_id: r for r in line_dedup.line_dedup_report(frame(spark, *texts)).collect()}
    assert [out[d].text == texts[d - 1] for d in (1, 2)] == [True, True]
    assert all(out[d].n_removed_chunks > 0 and len(out[d].text) < len(texts[d - 1]) / 2 for d in (3, 4))


def brute_leaks(rows, items):
    """Pairs of document and item with an alignment that agrees enough."""
    words = lambda t: [w for w in re.split(decontaminate._GAP, t.lower()) if w]
    at = {i: words(t) for i, t in items.items()}
    expected = set()
    for r in rows:
        place = collections.defaultdict(list)
        for i, x in enumerate(words(r.text)):
            place[x].append(i)
        for item, iw in at.items():
            diagonals = collections.defaultdict(list)
            for k, x in enumerate(iw):
                for p in place.get(x, ()):
                    diagonals[p - k].append(k)
            for ks in diagonals.values():
                stretch = max(sum(k <= j < k + decontaminate.STRETCH for j in ks) for k in ks)
                if len(ks) >= max(0.5 * len(iw), min(8, len(iw))) or stretch >= decontaminate.MIN_STRETCH:
                    expected.add((r.doc_id, item))
    return expected


def test_leaks_by_brute_force(spark, docs, rows):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leak_report(docs, bench).collect()}
    assert got == brute_leaks(rows, {r.item_id: r.text for r in bench.collect()})


def test_leaks_do_not_depend_on_other_items(spark):
    """A long quote is found by its stretch, a short item by its own masks, each whatever else the benchmark holds."""
    item = [f"q{i}" for i in range(90)]
    nine = [f"n{i}" for i in range(9)]
    d = frame(spark, "x " + " ".join(item[30:59]) + " y", "z " + " ".join(["other", *nine[1:]]), " ".join(nine[:4] + ["a", "b"] + nine[6:]), "it holds four words here", "x one y")
    items = [(1, " ".join(item)), (2, " ".join(nine)), (3, "four words here"), (4, "One"), (5, None), (None, "nowhere at all")]
    report = lambda rows: {(r.doc_id, r.item_id, r.n_matched, r.start) for r in decontaminate.leak_report(d, spark.createDataFrame(rows, "item_id long, text string")).collect()}
    every = report(items)
    assert every == {(1, 1, 29, -29), (2, 2, 8, 1), (4, 3, 3, 2), (5, 4, 1, 1)}
    assert set().union(*(report([x]) for x in items)) == every
    assert decontaminate.leak_report(d, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_leak_recall_by_share_of_substitutions(spark):
    """At a fifth of the words substituted nine passages of ten are found at least, and at a tenth nearly all."""
    rng = random.Random(5)
    items = [[f"i{n}w{k}" for k in range(30)] for n in range(100)]
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items)], "item_id long, text string")
    for share, least in ((0.1, 0.99), (0.2, 0.9)):
        texts = [(n, "before it " + " ".join("other" if rng.random() < share else x for x in w) + " after it") for n, w in enumerate(items)]
        assert decontaminate.leak_report(frame(spark, *texts), bench).count() >= least * len(items)


def test_leaks_with_substitutions_and_short_items(spark):
    item = [f"q{i}" for i in range(40)]
    changed = [w if i % 7 else "other" for i, w in enumerate(item)]
    d = frame(spark, "x y z " + " ".join(changed), " ".join(item[:18]), "before one two three four five after", "nothing at all of it")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "One, two three four FIVE"), (3, "one two")], "item_id long, text string")
    for limit in (10, 1 << 26):  # shuffled and broadcast
        got = {(r.doc_id, r.item_id, r.start) for r in decontaminate.leak_report(d, bench, broadcast_bytes=limit).collect()}
        assert got == {(1, 1, 3), (3, 2, 1), (3, 3, 1)}
    assert {r.doc_id for r in decontaminate.decontaminate(d, bench).collect()} == {2, 4}


@pytest.mark.parametrize("extra", ["", "a" * 3000, "\x00\x01   İK ſ 日本語 😀", " \n\n  x  \t", "▁▁ <unk> <s>", "it's we'll 12 3½ ²"])
def test_bpe_odd_texts(extra):
    codec, encoding = bpe.Codec(*bpe.load(RANKS, PATTERN)), _tiktoken()
    ids = codec.encode(extra)
    assert list(memoryview(ids).cast("I")) == encoding.encode_ordinary(extra) and codec.decode(ids) == extra.encode()


def test_toxicity_columns_without_labels(spark):
    d = frame(spark, "some words here", None)
    with_labels = toxicity.toxicity_scores(d, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    none = toxicity.toxicity_scores(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert dict(none.dtypes) == dict(with_labels.dtypes) and {(r.score, r.predicted) for r in none.collect()} == {(0.0, 0)}


def test_toxicity_noisy_or_by_brute_force():
    """Scores are one less the product over sentences, and the fitted weights lie where the likelihood is flat."""
    weights = toxicity._Weights({"=bad": 5.0, "=worse": 7.0})
    got, n, offending, where = toxicity.score("A bad day. Fine words. Worse and bad!", weights, -4.0)
    p = [1 / (1 + math.exp(-z)) for z in (1.0, 8.0)]
    assert n == 3 and offending == 2 and math.isclose(got, 1 - (1 - p[0]) * (1 - p[1])) and [w[:2] for w in where] == [(0, 9), (22, 36)]
    rng = np.random.default_rng(1)
    y = np.arange(60) % 2
    own = [[sorted({int(rng.integers(2, 6)), *([int(label and rng.random() < 0.9)] if label else [])}) for _ in range(3)] for label in y]
    data = pd.DataFrame({"y": y, "own": own})
    w, b = toxicity.fit(data, 6, rounds=600)

    def loss(w):
        total = 0.0
        for label, doc in zip(y, own, strict=True):
            none = np.prod([1 - 1 / (1 + np.exp(-(sum(w[f] for f in s) + b))) for s in doc])
            total -= np.log(1 - none) if label else np.log(none)
        return total / len(y) + 0.5e-5 * (w**2).sum()

    at = loss(w)
    assert all(loss(w + step * np.eye(6)[k]) > at - 1e-3 for k in range(6) for step in (-0.3, 0.3)) and w[1] > max(w[2:])


@functools.cache
def _tiktoken():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_digests(text):
    """Count and digests of the tiktoken library's ids."""
    ids = _tiktoken().encode_ordinary(text)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_bpe_equals_tiktoken(spark, docs, rows):
    got = {r.doc_id: r for r in bpe.token_report(spark, docs, RANKS, PATTERN).collect()}
    for r in rows:
        assert token_digests(r.text) == (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256)


def test_bpe_every_character():
    """Each character of Unicode between others is split and encoded as the library does."""
    codec, encoding = bpe.Codec(*bpe.load(RANKS, PATTERN)), _tiktoken()
    for at in range(0, 0x110000, 0x2000):
        text = "".join(f"a{chr(c)} 1{chr(c)}" for c in range(at, at + 0x2000) if not 0xD800 <= c < 0xE000)
        assert list(memoryview(codec.encode(text)).cast("I")) == encoding.encode_ordinary(text)


def shingle_set(text):
    w = [x for x in BLANK.split(text.lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    sets = {r.doc_id: shingle_set(r.text) for r in rows}
    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    parent, links = {d: d for d in sets}, collections.Counter()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for d, s in sets.items():
        for o, n in collections.Counter(o for g in s for o in holders[g] if o > d).items():
            if 5 * n >= 4 * (len(s) + len(sets[o]) - n):
                links[d] += 1
                links[o] += 1
                a, b = root(d), root(o)
                parent[max(a, b)] = min(a, b)
    return {d: (root(d), links[d]) for d in sets}


def test_near_duplicates_by_brute_force(docs, rows):
    expected = brute_classes(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_dup.near_duplicates(docs).collect()}
    assert got == expected
    kept = {r.doc_id for r in near_dup.drop_near_duplicates(docs).collect()}
    assert kept == {d for d, (c, _) in expected.items() if d == c}


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_TEXTS", 7)
    base = [f"word{i}" for i in range(120)]
    texts = [" ".join(base[:k] + [f"new{k}"] + base[k + 1 :]) for k in range(0, 120, 2)]
    d = frame(spark, *texts, texts[3], " ".join(base))
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_dup.near_duplicates(d).collect()}
    assert got == brute_classes(d.collect())


def signed_texts(spark, *texts):
    """Each text once, with its signature."""
    floor = near_dup.prefix_depth(near_dup.THRESHOLD, 64)
    d = near_dup.packed(frame(spark, *texts)).select(F.md5("__text").alias("rid"), F.col("__rid").alias("row"), F.col("__text").alias("text"))
    return floor, near_dup.written(near_dup._signed(d, near_dup.TREES, floor))


def entries_of(copies):
    member = copies.select("rid", F.inline(F.arrays_zip(F.col("nodes").alias("node"), "after")))
    return member.join(member.groupBy("node").agg(F.min("rid").alias("head"), F.count("*").alias("m")).where("m > 1"), "node")


def varied(base, changes):
    return " ".join(f"new{i}" if i in changes else w for i, w in enumerate(base))


def test_forest_depth_follows_the_weakest_link(spark):
    """Close copies alone keep the long prefix; one weak link among them shortens it, in the result without loss."""
    base = [f"word{i}" for i in range(1000)]
    close = [varied(base, {40 * k}) for k in range(12)]
    weak = [varied([f"other{i}" for i in range(1000)], set(range(0, 20 * k, 20))) for k in (0, 20)]
    limits = (near_dup.THRESHOLD, near_dup.TREES, near_dup.TARGET_RECALL)
    for texts, extra in ((close, near_dup.LEVELS), (close + weak, 0)):
        floor, copies = signed_texts(spark, *texts)
        assert near_dup.measured_depth(entries_of(copies), copies, *limits, floor) == floor + extra
        d = frame(spark, *texts)
        assert {r.doc_id: (r.class_id, r.n_links) for r in near_dup.near_duplicates(d).collect()} == brute_classes(d.collect())


def test_forest_depth_is_measured_on_all_links(spark, monkeypatch):
    """One weak link among many close ones counts, and so does one between texts that only meet in a large node."""
    monkeypatch.setattr(near_dup, "MEASURED_ENTRIES", 1, raising=False)  # the bound of a sample that there was once
    limits = (near_dup.THRESHOLD, near_dup.TREES, near_dup.TARGET_RECALL)
    close = [varied([f"word{i}" for i in range(1000)], {40 * k}) for k in range(7)]
    weak = [varied([f"other{i}" for i in range(1000)], set(range(0, 20 * k, 20))) for k in (0, 20)]
    floor, copies = signed_texts(spark, *close, *weak)
    assert near_dup.measured_depth(entries_of(copies), copies, *limits, floor) == floor
    # Nine texts of one node that are no links of its smallest one.
    far = [varied([f"word{i}" for i in range(1000)], set(range(60 * k, 60 * k + 60, 5))) for k in range(9)]
    floor, copies = signed_texts(spark, *far)
    entries = copies.select("rid", F.lit(1).alias("node"), F.lit(0).alias("after")).crossJoin(copies.agg(F.min("rid").alias("head"), F.count("*").alias("m")))
    assert near_dup.measured_depth(entries, copies, *limits, floor) == floor


def test_chance_meetings_link_nothing(spark):
    """A chain of texts that share half of their shingles with the next meets in many nodes, and forms no group."""
    words = [f"word{i}" for i in range(40_000)]
    _, copies = signed_texts(spark, *(" ".join(words[100 * k : 100 * k + 300]) for k in range(300)))
    assert entries_of(copies).where("rid <> head").select("rid").distinct().count() > 20  # 40 are expected
    assert near_dup.candidates(copies, near_dup.THRESHOLD, near_dup.TREES, near_dup.TARGET_RECALL).count() <= 6


def test_sketch_estimates_similarity(spark):
    """Also of short texts, whose minima are few."""
    for n, changed in ((40, {20}), (300, {150}), (1000, {300, 600})):
        base = [f"word{i}" for i in range(n)]
        texts = " ".join(base), varied(base, changed)
        floor, copies = signed_texts(spark, *texts)
        a, b = (r.rid for r in copies.select("rid").collect())
        pairs = spark.createDataFrame([(a, b)], "a string, b string")
        estimate = near_dup._estimated(pairs, copies, near_dup.TREES * (floor + near_dup.LEVELS)).first().estimate
        s, t = map(shingle_set, texts)
        assert abs(estimate - len(s & t) / len(s | t)) < 1.5 * near_dup.SKETCH_ERROR


def test_license_base_by_brute_force(docs, rows):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = {c: c + 32 for c in range(65, 91)}
    got = {r.doc_id: r for r in licenses.license_report(docs).collect()}
    for r in rows:
        w, at, labels = word.findall(r.text.translate(low)), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            here = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) | {""} and 0 <= g.score <= 1


def test_license_rules_and_suppression(spark):
    d = frame(
        spark, "Mit,  LICENSE.  xMIT license apache-License General\nPublic   LICENSE émit license MIT license",
        "SPDX-License-Identifier: MPL-2.0 and https://www.gnu.org/licenses/gpl.html; licensed under the BSD 3-clause license",
        "Released under the GNU Lesser General Public License, version 2.1.", "Licensed under CC BY-NC 4.0.",
    )
    got = {r.doc_id: r for r in licenses.license_report(d).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels) == (4, 0, 11, "apache,gpl,mit")
    assert got[2].labels == "bsd,gpl,mpl" and got[2].score == 1.0
    assert got[3].labels == "gpl,lgpl" and got[3].base_labels == "gpl"  # the base label stays
    assert got[4].labels == "cc-by-nc"
    assert len(licenses.rules()) > 300 and [r[0] for r in licenses.rules()] == list(range(len(licenses.rules())))


def _readings(pattern):
    """Texts a pattern of the license table matches: every alternative, optional parts with and without."""
    if m := re.search(r"\(\?:([^()]*)\)(\??)", pattern):
        return [t for part in [*m[1].split("|"), *[""] * bool(m[2])] for t in _readings(pattern[: m.start()] + part + pattern[m.end() :])]
    if m := re.search(r"(?:\[(.)[^]]*\]|(?<!\\)([^\\]))\?", pattern):
        return [t for part in (m[1] or m[2], "") for t in _readings(pattern[: m.start()] + part + pattern[m.end() :])]
    return [re.sub(r"\\(.)", r"\1", re.sub(r"\[(.)[^]]*\]", r"\1", pattern))]


def test_license_gates_pass_every_alternative(spark):
    table = [line.split(" :: ") for line in licenses.LICENSES.strip().splitlines()]
    tags = [(f[0], t) for f in table for t in _readings(f[-3])]
    names = [(f[0], t) for f in table for n in f[-2].split(";") for t in _readings(n)]
    texts = [f"SPDX-License-Identifier: {t.upper()}" for _, t in tags] + [f"Here is {t.upper()} license." for _, t in tags] + [f"see https://{f[-1]}" for f in table]
    texts += [x for _, t in names for x in (f"Released under the {t.title()}.", f"the {t} licence", f"the {t.replace(' ', chr(10))} License, version 2.0")]
    texts += [f"// {x.split(' :: ')[1].capitalize().replace(' ', chr(10) + ' * ', 3)}." for x in licenses.TEXTS.strip().splitlines()]
    rows = licenses.packed(frame(spark, *texts, "licensed under the GNU GPL", "nothing released under any"))
    gated, every = ({tuple(r) for r in licenses.detections(rows, spark, gated).collect()} for gated in (True, False))
    assert gated == every
    found = collections.defaultdict(set)
    for r in gated:
        found[r[0]].add(r[2])
    text_of = {r["__rid"]: r["__text"] for r in rows.collect()}
    assert {t for i, t in text_of.items() if not found[i]} == {"nothing released under any"}
    labels = {text_of[i]: x for i, x in found.items()}
    assert labels["licensed under the GNU GPL"] == {"gpl"} and labels["Here is MPL-1.0 license."] == {"mpl"} and labels["the wtfpl licence"] == {"wtfpl"}


def test_license_texts_and_lookalikes(spark):
    """Grants and clauses are found without any name; words that only look like one are not."""
    d = frame(
        spark, "Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the thing)",
        "# Redistributions of source code must retain the above copyright notice,\n# this list of conditions and the following disclaimer.", "the ruby license plate",
        "This Source Code Form is subject to the terms of the Mozilla Public\n  License, v. 2.0.",
    )
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_report(d).collect()}
    assert got == {1: ("mit", 0.98), 2: ("bsd", 0.98), 3: ("", 0.0), 4: ("mpl", 0.98)}
    assert all(any(x in line.split(" :: ")[1] for x in licenses.STEMS) for line in licenses.TEXTS.strip().splitlines())


def test_license_short_names_in_plain_prose(spark):
    """Words that are names of licenses too, in the four languages, are none where no license is named by them."""
    plain = [
        "Wir arbeiten mit der neuen Lizenz, not a license", "Er kam mit dem Wagen; a driving license was shown", "a driving license and a json file", "curl your hair, then show the fishing license",
        "ruby rings need no license", "php und python ohne license plates", "la isc de la licence", "vim y vigor, licencia y license",
    ]
    named = {"MIT or Apache-2.0 licenses": "apache,mit", "under the ISC license": "isc", "dual MIT/GPL-2.0 license": "gpl,mit", "json license": "json", "ruby and BSD licensed": "ruby"}
    both = licenses.license_report(frame(spark, *plain, "Wir arbeiten mit der neuen Apache License", *named)).collect()
    got = {r.doc_id: r.labels for r in both}
    assert [got[i + 1] for i in range(len(plain))] == [""] * len(plain) and got[len(plain) + 1] == "apache"
    assert all(set(want.split(",")) <= set(got[len(plain) + 2 + i].split(",")) for i, want in enumerate(named.values()))


def test_license_suppression_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(d, rng.randrange(50), f"l{k}", 0.5, a, a + rng.randrange(1, 12)) for d in range(40) for k in range(8) for a in [rng.randrange(40)]]
    expected = set()
    for d in range(40):
        own = sorted({r for r in rows if r[0] == d}, key=lambda r: (r[4], -r[5], r[1]))
        outer = [r for i, r in enumerate(own) if all(o[5] < r[5] for o in own[:i])]
        for i, r in enumerate(outer):
            near = [o for o in outer[max(0, i - 1) : i] + outer[i + 1 : i + 2] if o[4] < r[5] and o[5] > r[4]]
            if all(o[1] >= r[1] for o in near):
                expected.add(r)
    found = spark.createDataFrame(sorted(set(rows)), "`__rid` long, priority int, label string, certainty double, start int, end int")
    assert {tuple(r) for r in licenses.suppressed(found).collect()} == expected


def test_quality_discriminant_by_brute_force(spark, docs, rows):
    """Moments, log-densities and the calibrated scores from raw vectors in numpy."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    y = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    train = lambda d: zlib.crc32(str(d).encode()) % 5 != 0
    x = {r.doc_id: np.array(quality_qda.statistics(r.text)) for r in rows}
    of = {c: np.array([x[d] for d in x if train(d) and y.get(d) == c]) for c in (0, 1)}
    frame_ = spark.createDataFrame([(c, v.tolist()) for c, vs in of.items() for v in vs], "y int, x array<double>")
    got = quality_qda.moments(frame_)
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in of.values()) / sum(map(len, of.values()))
    density = {}
    for c, v in of.items():
        n, mean, cov = got[c]
        assert n == len(v) and np.allclose(mean, v.mean(axis=0)) and np.allclose(cov, np.cov(v.T, bias=True), atol=1e-9)
        s = 0.9 * cov + 0.1 * pooled
        s = 0.9 * s + 0.1 * np.diag(np.diag(s)) + 1e-4 * np.eye(len(s))
        density[c] = {d: -0.5 * (w - mean) @ np.linalg.solve(s, w - mean) - 0.5 * np.linalg.slogdet(s)[1] for d, w in x.items()}
    ids = sorted(x)
    llr = np.array([density[1][d] - density[0][d] for d in ids])
    assert np.allclose(quality_qda.Discriminant(got).difference(np.array([x[d] for d in ids])), llr, rtol=1e-6, atol=1e-6)
    score = {r.doc_id: (r.score, r.predicted) for r in quality_qda.quality_scores(docs, labels).collect()}
    order = np.argsort(np.clip(llr, -50, 50), kind="stable")
    assert np.all(np.diff([score[ids[i]][0] for i in order]) >= -1e-9)
    assert all(p == (s >= 0.3) for s, p in score.values())


def test_quality_counts_by_brute_force(docs, rows):
    got = {r.doc_id: r for r in quality_rules.quality_report(docs).collect()}
    for r in rows:
        w = [x for x in BLANK.split(r.text) if x]
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        seen, dup = set(), 0
        for line in r.text.split("\n"):
            if BLANK.sub("", line):
                dup += line in seen
                seen.add(line)
        g = got[r.doc_id]
        failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text)), dup, len(again), failed)
        assert not (failed and g.kept)


def test_quality_many_distinct_words_and_cleaning():
    w = [f"u{i}" for i in range(5000)]
    assert quality_rules.judge(" ".join(w + w[:6]))[4] == 12 and quality_rules.judge(" ".join(["a b c d e f"] * 2))[4] == 12
    text = "A clean line of words that goes on for a while, as it should.\nhome | about | login\nAnother clean line, which is longer than the menu."
    *_, kept, n, removed, cleaned = quality_rules.judge(text)
    assert kept and n == 1 and removed == 16 and "home" not in cleaned
    assert not quality_rules.judge("one two three*** four### five%%% six&&& seven*** eight### nine$$$ ten*** eleven### twelve%%%")[6]


def test_html_text(spark):
    page = (
        "<html><head><title>T &am</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a>x</a></ul></nav><div class='ad'>Buy, now.</div>"
        "<article><h1>Head &amp; more</h1><p><b>One,  two\n three.<br><p>Four &lt;five&gt;, six.</p><div class='comments'><p>I like it.</p></div></article>"
        "<aside><p>Side, bar.</p></aside><footer>&copy; all</footer>"
    )
    d = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "just text"), (4, "u", "<article><p>cut off &am")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.page_texts(d).collect()}
    assert got[1].text == "Head & more\nOne, two three.\nFour <five>, six." and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[3].text, got[None].text, got[4].text) == ("", "", "just text", "cut off &am")
    assert html_text.page_texts(d.where("false")).count() == 0


def test_html_names_only_lower_scores():
    """Furniture names on wrappers change nothing, and names that only look alike are kept."""
    text = lambda page: html_text.extract(page)[0]
    body = "<h1>Head</h1><p>Long text, here. And more, of it.</p><section id='share-price'><p>Shares, of it, cost 3.</p></section><p data-id='search'>Kept, too.</p>"
    want = "Head\nLong text, here. And more, of it.\nShares, of it, cost 3.\nKept, too."
    comments = "<div class='comment-list'><p>A reader says so, here.</p></div>"
    assert text(f"<body class='home sidebar-right'><article class='post comments-open'>{body}{comments}</article></body>") == want
    assert text(f"<form><div id='page' class='header-fixed'><div class=sidebar><a>x</a></div><main>{body}</main></div></form>") == want
    assert text(f"<div><h1>Title</h1><div>{body.replace('h1', 'h3')}</div></div><div>foot</div>") == "Title\n" + want


def test_html_scores_decide(spark, monkeypatch):
    """Where tags and classes say nothing, the paths' scores find the text of most pages, and nothing else does."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    want = [html_text.extract(p)[0] for p in pages]
    neutral = [re.sub(r"<(/?)(?:article|nav|footer)\b", r"<\1div", p).replace(' class="ad"', ' class="x"') for p in pages]
    found = sum(html_text.extract(p)[0] == w for p, w in zip(neutral, want, strict=True))
    monkeypatch.setattr(html_text, "content_paths", lambda page: set(page.path))
    assert found > 0.75 * len(pages) and sum(html_text.extract(p)[0] == w for p, w in zip(neutral, want, strict=True)) == 0


def test_html_time_grows_with_length():
    """Unclosed and deeply nested elements, many of each, end in seconds."""
    start = time.time()
    assert html_text.extract("<p>" + "<b>x " * 100_000)[1] == 199_999
    assert html_text.extract("<div>" * 100_000 + "deep" + "</span>" * 100_000)[0] == "deep"
    assert html_text.extract("x<a " * 50_000)[1] > 0 and time.time() - start < 30


def test_html_articles_of_the_table(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for p, r in zip(pages.orderBy("page_id").collect(), html_text.page_texts(pages).orderBy("page_id").collect(), strict=True):
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|br|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize(("name", "column", "least"), [("op5_toxicity", "toxic", 0.9), ("op8_quality", "quality", 0.97)])
def test_classifiers_on_held_out_rows(spark, name, column, least):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = QUERIES[name](spark, sf).select("doc_id", "held_out", "score", "predicted").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    held = sorted((r.score, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels)
    pos = sum(y for _, y in held)
    rank = sum(i for i, (_, y) in enumerate(held, 1) if y)
    assert (rank - pos * (pos + 1) / 2) / (pos * (len(held) - pos)) > least


def test_offending_sentences(spark):
    texts = [f"This is sentence {i} of a quiet text. It goes on number {i}. Nothing here." for i in range(60)]
    bad = [f"This is sentence {i} of a text. You are a {w} number {i}. Nothing here." for i in range(30) for w in ("scumbag", "scummy")]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts + bad)], "doc_id long, text string")
    labels = d.select("doc_id", (F.col("doc_id") >= 60).cast("int").alias("toxic"))
    for r in toxicity.toxicity_scores(d, labels).join(d, "doc_id").collect():
        assert r.predicted == (r.doc_id >= 60)
        assert [r.text[o.start : o.end].strip()[:9] for o in r.offending] == (["You are a"] if r.doc_id >= 60 else [])
