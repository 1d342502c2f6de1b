"""Rows of vectors as the vector operators take them, and their batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.llm.shared import written

#: Scale of whole-number components; the largest size they may have, so that sums of squares stay exact in 64 bits.
SCALE, LARGEST = 1024, 2**24


def whole_vectors(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id, label, x`` with ``x = floor(1024 * component)`` as longs, stored in the shared folder, and the dimension.

    Rows whose vector is null or holds a null, NaN or infinite component are left out. So are empty vectors and vectors of
    another length than most (the shorter of equally frequent ones): they can't be compared with the rest. Without a row
    the dimension is 0. A scaled component beyond 2**24 is an error.
    """
    v = F.col("embedding")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    rows = written(embeddings.where(v.isNotNull() & ~bad).select("vec_id", "label", x.alias("x")))
    most = rows.where(F.size("x") > 0).groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return (rows.where(F.size("x") == most.d), most.d) if most else (rows.where("false"), 0)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A batch's list column as whole numbers, one row a vector."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)
    if len(x) and max(int(x.max()), -int(x.min())) > LARGEST:
        raise ValueError(f"a vector's scaled component is beyond {LARGEST}")
    return x
