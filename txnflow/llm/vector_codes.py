"""Product quantisation of vectors, with nearest entries found through remembered grid cells.

A vector of whole-number components is cut into four equal parts, and each part gets the number of the nearest entry of
its codebook. Parts are hashed to cells of a coarse grid. For a cell that a task meets first, the least and the greatest
squared distance of its box to every entry are added up from one table a dimension; entries whose least distance is
above the smallest greatest distance are dominated everywhere in the box and drop out. The rest is remembered, and only
those are evaluated exactly for the parts of the cell. So codes are those of a full search, ties going to the lower entry.

Codebooks start as the parts of the 256 rows with the smallest ids (nulls last; rows of one id by their components; fewer
where there are fewer rows) and move in four rounds to the floor of their parts' mean; unused entries stay. A round is
one pass over the rows: tasks add up their own parts by entry, Spark adds up the tasks, and 4 x 256 sums reach the driver.

Rows with unusable vectors are left out as ``vectors.whole_vectors`` says; rows that repeat count each time, and rows
without an id have one of null. An empty table gives no rows. The dimension has to be a multiple of 4. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.llm.shared import ship, written
from txnflow.llm.vectors import matrix, whole_vectors

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Width of a grid cell in every dimension.
GRID = 32
#: Cells that a task remembers for a part, at most; beyond that it starts anew.
CELLS = 20_000
#: Label sums are broadcast up to so many rows, else joined by shuffle.
BROADCAST_ROWS = 10_000


class Grid:
    """One part's codebook behind its remembered cells."""

    def __init__(self, entries: np.ndarray, width: int = GRID):
        self.entries, self.width = entries, width
        self.known: dict[bytes, np.ndarray] = {}

    def _open(self, cells: np.ndarray) -> np.ndarray:
        """For each cell the entries not dominated across its box, as packed bits."""
        least = np.zeros((len(cells), len(self.entries)), np.int64)
        most = np.zeros_like(least)
        for j in range(cells.shape[1]):
            values, at = np.unique(cells[:, j], return_inverse=True)
            low = values[:, None] * self.width
            high, c = low + self.width - 1, self.entries[None, :, j]
            least += (np.maximum(np.maximum(low - c, c - high), 0) ** 2)[at]
            most += (np.maximum(np.abs(c - low), np.abs(high - c)) ** 2)[at]
        return np.packbits(least <= most.min(axis=1, keepdims=True), axis=1)

    def _candidates(self, cells: np.ndarray) -> np.ndarray:
        keys = [c.tobytes() for c in cells]
        new = [i for i, k in enumerate(keys) if k not in self.known]
        found = dict(zip((keys[i] for i in new), self._open(cells[new]), strict=True)) if new else {}
        bits = np.array([self.known[k] if k in self.known else found[k] for k in keys])
        if len(self.known) + len(found) > CELLS:
            self.known.clear()
        self.known.update(found)
        return np.unpackbits(bits, axis=1, count=len(self.entries)).astype(bool)

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry number and squared distance of each row of ``v``."""
        cells = v // self.width
        cells, of = np.unique(cells, axis=0, return_inverse=True)
        row, entry = np.nonzero(self._candidates(cells)[of.ravel()])
        distance = ((v[row] - self.entries[entry]) ** 2).sum(axis=1)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        best = np.minimum.reduceat(distance, starts)
        # Candidates stand in the order of entries, so the first of the nearest is the lowest.
        first = np.minimum.reduceat(np.where(distance == best[row], entry, len(self.entries)), starts)
        return first, best


def _parts(x: np.ndarray) -> list[np.ndarray]:
    return np.split(x, PARTS, axis=1)


def first_codebooks(rows: DataFrame, d: int) -> np.ndarray:
    """Codebooks (part, entry, position) from the parts of the rows with the smallest ids; ``ENTRIES`` rows at most."""
    found = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).select("x").collect()
    x = np.array([r.x for r in found], np.int64).reshape(-1, d)
    return np.stack(_parts(x))


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all rows."""
    n_entries, width = books.shape[1:]
    columns = [f"s{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b) for b in books]
        total, n = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for b in batches:
            for p, part in enumerate(_parts(matrix(b.column(0), PARTS * width))):
                if len(part):
                    entry, _ = grids[p].nearest(part)
                    np.add.at(total[p], entry, part)
                    n[p] += np.bincount(entry, minlength=n_entries)
        part, entry = np.nonzero(n)
        sums = total[part, entry]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), *(pa.array(sums[:, j]) for j in range(width))], names=["part", "entry", "n", *columns])

    partial = rows.select("x").mapInArrow(run, ", ".join(["part int", "entry int", "n long", *(f"{c} long" for c in columns)]))
    out = books.copy()
    # At most PARTS * ENTRIES rows.
    for r in partial.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ("n", *columns))).collect():
        out[r.part, r.entry] = [r[c] // r.n for c in columns]
    return out


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every row."""
    d = PARTS * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b) for b in books]
        for b in batches:
            x = matrix(b.column("x"), d)
            if len(x):
                found = [g.nearest(part) for g, part in zip(grids, _parts(x), strict=True)]
                code = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8)
                error = sum(distance for _, distance in found)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([c.tobytes().hex() for c in code]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.select("vec_id", "label", "x").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(embeddings: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row with a usable vector."""
    rows, d = whole_vectors(embeddings)
    if not d:
        return rows.selectExpr("vec_id", "'' code", "0L error", "0L label_error", "'' codebooks_sha256")
    if d % PARTS:
        raise ValueError(f"vectors of {d} components can't be cut into {PARTS} equal parts")
    ship(embeddings.sparkSession)
    books = first_codebooks(rows, d)
    for _ in range(ROUNDS):
        books = moved(rows, books)
    codes = written(coded(rows, books))
    sums = written(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label"))
    if sums.count() <= BROADCAST_ROWS:
        sums = F.broadcast(sums)
    out = codes.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
