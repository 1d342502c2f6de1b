"""Byte-level BPE by a sentencepiece model written straight from a rank file.

Every byte is mapped to a printable character, so each vocabulary entry is a piece of such characters. Its score is
its negative rank: the merge with the best score is then the merge of the lowest rank. The normaliser is the identity.
Each match of the pre-token pattern is encoded by itself; decoding maps ids to pieces and pieces to bytes again.

A null text counts as empty: no tokens, and the digests of nothing. Repeated rows get equal results, rows without an id one of
their own. Texts of any length are encoded whole, a pre-token at a time; equal ranks of two merges can't occur, and of equal
merges in a pre-token the leftmost goes first. An empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnflow.llm.shared import packed, struct_udf

SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Distinct pre-tokens whose ids a worker keeps at once; beyond it the memory is emptied, results don't change.
CACHE = 200_000


# Letters and numbers that the regex module knows and the tables of the tiktoken library don't have yet. There
# they count as other signs, and so they do here.
LATE_CHARACTERS = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A
11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20
18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2
1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


def read_ranks(lines: list[bytes]) -> list[bytes]:
    """Tokens of a rank file (base64 token, rank) by rank; the ranks must be 0, 1, 2, ..."""
    ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in lines if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes, an unsigned number, or a 32-bit float."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(tokens: list[bytes]) -> bytes:
    """A sentencepiece model: the tokens in rank order, then the unknown piece that every model must have."""
    chars = byte_characters()
    pieces = [_field(1, _field(1, "".join(map(chars.__getitem__, t)).encode()) + _field(2, -float(rank))) for rank, t in enumerate(tokens)]
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, normaliser)


def latin_pattern(pattern: str) -> str:
    """The same pattern with its classes spelt out for texts in Latin-1, for the faster matcher of the standard library."""
    import regex

    latin = "".join(map(chr, range(256)))
    letters, numbers, blanks = ("".join(map(re.escape, regex.findall(c, latin))) for c in (r"\p{L}", r"\p{N}", r"\s"))
    spelt = {r"[^\s\p{L}\p{N}]": f"[^{blanks}{letters}{numbers}]", r"\p{L}": f"[{letters}]", r"\p{N}": f"[{numbers}]", r"\S": f"[^{blanks}]", r"\s": f"[{blanks}]"}
    for short, full in spelt.items():
        pattern = pattern.replace(short, full)
    return pattern


class _Ids(dict):
    """Pre-token -> its ids as little-endian 32-bit words, filled on demand."""

    def __init__(self, processor, ids: dict[str, int]):
        self.processor, self.ids, self.chars = processor, ids, byte_characters()

    def __missing__(self, pre: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        piece = "".join(map(self.chars.__getitem__, pre.encode()))
        known = self.ids.get(piece)
        found = [known] if known is not None else self.processor.encode(piece)
        out = self[pre] = struct.pack(f"<{len(found)}I", *found)
        return out


class Codec:
    """Encoder and decoder of one serialised model."""

    def __init__(self, proto: bytes, pattern: str):
        import regex
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        back = {c: b for b, c in enumerate(byte_characters())}
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size() - 1)]
        self.split_any = regex.compile(pattern)
        late = "".join("-".join(f"\\U{int(c, 16):08x}" for c in r.split("-")) for r in LATE_CHARACTERS.split())
        self.late = regex.compile(f"[{late}]")
        self.split_latin = re.compile(latin_pattern(pattern)).findall
        self.bytes_of = [bytes(map(back.__getitem__, p)) for p in pieces]
        self.known = _Ids(sp, {p: i for i, p in enumerate(pieces)})

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit words."""
        known = self.known
        return b"".join([known[pre] for pre in self.split(text)])

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if not self.late.search(text):
                return self.split_any.findall(text)
            return [text[slice(*m.span())] for m in self.split_any.finditer(self.late.sub("\u2022", text))]
        return self.split_latin(text)

    def decode(self, packed_ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(packed_ids).cast("I")))


@functools.cache
def _codec(proto: bytes, pattern: str) -> Codec:
    """One codec per worker."""
    return Codec(proto, pattern)


def load(path: str, pattern: str) -> tuple[bytes, str]:
    """The model of a rank file (under 2 MB, read once by the driver) and the pre-token pattern."""
    with open(path, "rb") as f:
        return model_proto(read_ranks(f.readlines())), pattern


def encoded(spark: SparkSession, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Packed rows with a struct ``__t`` of ``SCHEMA``: token count, digest of the ids, digest of the decoded bytes."""
    model = spark.sparkContext.broadcast(load(path, pattern))

    def one(text: str) -> tuple:
        codec = _codec(*model.value)
        ids = codec.encode(text)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

    return packed(docs).withColumn("__t", struct_udf(spark, one, SCHEMA)("__text"))


def token_report(spark: SparkSession, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    return encoded(spark, docs, path, pattern).select(F.col("__row.doc_id").alias("doc_id"), "__t.*")


def encode_documents(spark: SparkSession, docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``token_ids`` (array of integers) in addition."""
    model = spark.sparkContext.broadcast(load(path, pattern))

    def one(t: str) -> tuple:
        return (list(memoryview(_codec(*model.value).encode(t)).cast("I")),)

    out = packed(docs).withColumn("__t", struct_udf(spark, one, "token_ids array<int>")("__text"))
    return out.select(*(F.col("__row")[c].alias(c) for c in docs.columns), "__t.token_ids")
