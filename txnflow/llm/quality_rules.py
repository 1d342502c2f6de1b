"""Quality rules, line first: lines that fail a rule are removed, then documents that lose too much are rejected.

A line with a word fails as

* symbols: more than half as many symbols ``# * $ % & < > ~ ^ = { }`` or doubled marks ``!! ?? ..`` as words,
* navigation: separators ``| » • ›`` stand beside a fifth of its words or more, or it has at most six words, no
  closing punctuation and two or more of them are menu words,
* boilerplate: a fixed phrase of page furniture in a line of at most 30 words.

A document is rejected where the base rule fails (fewer than ten words, or over 20 % of its words in repeated
five-word windows) or where over ``max_removed`` of its word characters stood in removed lines. Null and empty texts
have no words and are rejected. Repeated rows and other columns don't matter: each row is judged by its text alone, which
is read whole, whatever its length. A share of exactly the limit is no reason to reject. An empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.llm.shared import BLANKS, packed, struct_udf, unpacked

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_removed_lines long, removed_chars long, cleaned string"
)
SYMBOLS = "#*$%&|<>"
WINDOW = 5

_LINE_SYMBOLS = "#*$%&<>~^={}"
_DOUBLED = ("!!", "??", "..")
_SEPARATORS = "|»•›"
_MENU = re.compile(r"\b(?:home|menu|about|contact|login|search|next|previous|back|top|help|faq|sitemap|blog|news|shop|cart)\b", re.I)
_BOILER = re.compile(
    r"cookie (?:policy|settings)|we use cookies|privacy policy|terms of (?:service|use)|all rights reserved|subscribe to our"
    r"|sign up for|click here|read more|share this|enable javascript|powered by|skip to (?:main )?content|follow us on",
    re.I,
)
_CLOSING = ".!?…:;\"'”’)"


def _windows(words: list[bytes]) -> np.ndarray:
    """A number for each five-word window, equal exactly where the windows are."""
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    n = len(a) - WINDOW + 1
    if len(ids) <= 1 << 12:  # five times twelve bits
        return (((a[:n] << 12 | a[1 : n + 1]) << 12 | a[2 : n + 2]) << 12 | a[3 : n + 3]) << 12 | a[4 : n + 4]
    out = a[:n]
    for k in range(1, WINDOW):  # ranks of ever longer windows
        out = np.unique(out * len(ids) + a[k : k + n], return_inverse=True)[1]
    return out


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a five-word window found twice or more."""
    if len(words) < WINDOW + 1:
        return 0
    _, inverse, counts = np.unique(_windows(words), return_inverse=True, return_counts=True)
    again = (counts > 1)[inverse].astype(np.int32)
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int32)
    edge[: len(again)] += again
    edge[WINDOW : WINDOW + len(again)] -= again
    return int((np.cumsum(edge[:-1]) > 0).sum())


def line_fails(line: str) -> bool:
    """Whether a line that has a word fails a rule."""
    n = len(line.split())
    marks = sum(map(line.count, _LINE_SYMBOLS)) + sum(map(line.count, _DOUBLED))
    if 2 * marks > n:
        return True
    if 5 * sum(map(line.count, _SEPARATORS)) >= n:
        return any(c in line for c in _SEPARATORS)
    if n <= 6 and line.rstrip()[-1:] not in _CLOSING and len(_MENU.findall(line)) >= 2:
        return True
    return n <= 30 and bool(_BOILER.search(line))


def judge(text: str, max_removed: float = 0.5) -> tuple:
    """The row of ``SCHEMA`` for one text."""
    words = text.encode().split()  # bytes split at the six blanks alone
    n_words = len(words)
    n_repeat = repeated_words(words)
    seen: set[str] = set()
    n_dup = n_removed = removed = 0
    kept_lines = []
    for line in text.split("\n"):
        chars = len(line) - sum(map(line.count, BLANKS))
        if chars:
            if line in seen:
                n_dup += 1
            else:
                seen.add(line)
            if line_fails(line):
                n_removed += 1
                removed += chars
                continue
        kept_lines.append(line)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    failed = n_words < 10 or 100 * n_repeat > 20 * n_words
    kept = not failed and removed <= max_removed * word_chars
    cleaned = "\n".join(kept_lines) if n_removed else text
    return n_words, word_chars, sum(map(text.count, SYMBOLS)), n_dup, n_repeat, failed, kept, n_removed, removed, cleaned


def judged(docs: DataFrame, max_removed: float = 0.5) -> DataFrame:
    """Packed rows with a struct ``__q`` of ``SCHEMA``."""
    run = struct_udf(docs.sparkSession, lambda t: judge(t, max_removed), SCHEMA)
    return packed(docs).withColumn("__q", run("__text"))


def quality_report(docs: DataFrame, max_removed: float = 0.5) -> DataFrame:
    """Per document its counts, ``base_failed``, ``kept`` and what line cleaning removed."""
    return judged(docs, max_removed).select(F.col("__row.doc_id").alias("doc_id"), "__q.*").drop("cleaned")


def clean_documents(docs: DataFrame, max_removed: float = 0.5) -> DataFrame:
    """The documents that are kept, without their failed lines, in the columns of ``docs``.

    A text from which no line was removed stays byte for byte as it was.
    """
    return unpacked(judged(docs, max_removed).where("__q.kept"), docs.columns, F.col("__q.cleaned"))
