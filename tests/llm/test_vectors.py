"""The vector operators against full searches and dense eigenvectors, and their edge cases."""

import hashlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.oracle import difference
from txnflow.llm import oracles, registry, vector_codes, whitening
from txnflow.llm.vectors import whole_vectors

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_codes(rows):
    """Codes by a full search, as plain loops over entries."""
    kept = [(i, [int(np.floor(np.float64(c) * 1024)) for c in v], lab) for i, v, lab in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([r[1] for r in kept], np.int64)
    parts = np.split(x, 4, axis=1)
    books = [p[:256].copy() for p in parts]

    def assign():
        return [((p[:, None, :] - b[None]) ** 2).sum(axis=2) for p, b in zip(parts, books, strict=True)]

    for _ in range(4):
        for p, b, d in zip(parts, books, assign(), strict=True):
            near = d.argmin(axis=1)
            for e in set(near.tolist()):
                own = p[near == e]
                b[e] = own.sum(axis=0) // len(own)
    d = assign()
    error = sum(m.min(axis=1) for m in d)
    code = ["".join(f"{m[i].argmin():02x}" for m in d) for i in range(len(x))]
    by = {}
    for r, e in zip(kept, error.tolist(), strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return sorted((repr(r[0]), c, int(e), by[r[2]], sha) for r, c, e in zip(kept, code, error, strict=True))


def got_codes(df):
    return sorted((repr(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.vector_codes(df).collect())


def table(name):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    return list(zip(t["vec_id"], t["embedding"], t["label"], strict=True))


def test_codes_of_the_table(spark):
    df = registry.QUERIES["op11_vector_codes"](spark, SF)
    assert difference(df, oracles.ORACLES["op11_vector_codes"], SF) == ""
    assert got_codes(spark.read.parquet(f"{SF}/embeddings.parquet")) == brute_codes(table("embeddings"))


def edge_rows():
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(c)) for c in rng.normal(size=8) * 0.2], int(i) % 3 if i % 5 else None) for i in range(300)]
    rows += [(7, rows[40][1], 1)] * 200  # one very common vector, under an id that repeats
    rows += [(None, rows[3][1], None), (900, None, 1), (901, [float("nan")] * 8, 1), (902, [None] * 8, 1), (903, [float("inf")] + [0.0] * 7, 2), (904, [], 0)]
    return rows


def test_codes_edge_cases(spark):
    rows = edge_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    assert got_codes(df) == brute_codes(rows)
    few = rows[:5]  # fewer rows than entries
    assert got_codes(spark.createDataFrame(few, SCHEMA)) == brute_codes(few)
    # extra columns with the names used inside, and another spread over partitions
    more = df.selectExpr("*", "1 x", "'a' code", "2 part", "3 __label").repartition(7)
    assert got_codes(more) == brute_codes(rows)
    assert vector_codes.vector_codes(df.where("false")).dtypes == vector_codes.vector_codes(df).dtypes
    assert vector_codes.vector_codes(df.where("vec_id >= 900")).count() == 0


def test_other_lengths_are_left_out(spark):
    rows = [(i, [0.1 * i] * 4, 0) for i in range(6)] + [(9, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept, d = whole_vectors(df)
    assert d == 4 and kept.count() == 6
    with pytest.raises(ValueError):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1.0] * 6, 0)], SCHEMA))


@pytest.mark.parametrize("width", [1, 7, 32, 500])
def test_grid_cells_lose_no_entry(width):
    rng = np.random.default_rng(width)
    entries = np.vstack([rng.integers(-300, 300, (60, 6)), [[5] * 6, [5] * 6]])  # an entry twice: the lower one counts
    v = np.vstack([rng.integers(-400, 400, (500, 6)), [[5] * 6], entries[:9]])
    d = ((v[:, None] - entries[None]) ** 2).sum(axis=2)
    grid = vector_codes.Grid(entries, width)
    for _ in range(2):  # the second time from memory
        near, distance = grid.nearest(v)
        assert (near == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


def test_grid_forgets_without_loss(monkeypatch):
    monkeypatch.setattr(vector_codes, "CELLS", 10)
    rng = np.random.default_rng(1)
    entries, grid = rng.integers(-300, 300, (40, 4)), None
    grid = vector_codes.Grid(entries)
    for _ in range(5):
        v = rng.integers(-300, 300, (30, 4))
        assert (grid.nearest(v)[0] == ((v[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert len(grid.known) <= 40


def whitened(df):
    out = {}
    for r in whitening.whiten(df).collect():
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


def check_whitening(rows, got):
    kept = [(i, v) for i, v, _ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(np.array([v for _, v in kept], np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(8, x.shape[1])
    assert {r.n for c in got.values() for r in c.values()} == {n}
    assert max(r.identity_error for c in got.values() for r in c.values()) < 1e-9
    sign = {}
    for (i, _), row, dev in zip(kept, centred @ vectors[:, :k] / np.sqrt(values[:k]), ((n * x - s) ** 2).sum(axis=1).tolist(), strict=True):
        assert sorted(got[i]) == list(range(1, k + 1))
        for c, r in got[i].items():
            assert r.deviation == dev and abs(r.explained - values[c - 1] / values.sum()) < 1e-10
            same = sign.setdefault(c, np.sign(r.whitened * row[c - 1]))
            assert abs(r.whitened - same * row[c - 1]) < 1e-8


def test_whitening_of_the_table(spark):
    check_whitening(table("embeddings"), whitened(registry.QUERIES["op12_whitening"](spark, SF).sparkSession.read.parquet(f"{SF}/embeddings.parquet")))


def test_whitening_edge_cases(spark):
    rows = [r for r in edge_rows() if r[0] is not None and r[0] != 7]
    df = spark.createDataFrame(rows, SCHEMA)
    check_whitening(rows, whitened(df))
    check_whitening(rows, whitened(df.selectExpr("*", "1 x", "'a' component", "2 n").repartition(40)))  # factors merged in a tree
    assert whitening.whiten(df.where("false")).collect() == [] and whitening.whiten(df.where("vec_id = 1")).collect() == []
    same = spark.createDataFrame([(i, [0.5] * 8, 0) for i in range(20)], SCHEMA)
    assert whitening.whiten(same).collect() == []  # no spread, no direction
    flat = spark.createDataFrame([(i, [0.0, i / 10, 0.0, (i % 3) / 5.0], 0) for i in range(20)], SCHEMA)
    assert sorted(whitened(flat)[3]) == [1, 2]


def test_singular_values_and_vectors():
    rng = np.random.default_rng(3)
    cases = [rng.normal(size=(50, 12)), np.vstack([np.eye(9)] * 2), np.repeat(rng.normal(size=(30, 4)), 3, axis=1), np.hstack([np.zeros((20, 3)), rng.normal(size=(20, 3))]), rng.normal(size=(40, 6)) * 10.0 ** -np.arange(0, 12, 2), np.diag([3.0, 2.0, 2.0, 1.0])]
    for a in cases:
        r = np.linalg.qr(a, mode="r")
        diagonal, upper, v = whitening.bidiagonal(r)
        true = np.linalg.svd(r, compute_uv=False)
        values = np.array(whitening.dqds(diagonal, upper))
        assert np.allclose(values, true, rtol=1e-10, atol=1e-14 * true[0])
        k = int((true > 1e-12 * true[0]).sum())
        z = v @ whitening.twisted_vectors(diagonal, upper, values[:k].tolist())
        assert np.abs(z.T @ z - np.eye(k)).max() < 1e-9 and np.abs(np.linalg.norm(r @ z, axis=0) - true[:k]).max() < 1e-9 * true[0]


def test_deviation_beyond_64_bits():
    x = np.array([[10**5, 10**5 + 900], [10**5, 10**5]])
    n = 10**8
    s = [10**5 * n, 10**5 * n]
    assert whitening.deviations(x, n, s) == [(900 * n) ** 2 if (900 * n) ** 2 < 2**63 else None, 0]
    assert whitening.deviations(x, 1000, [v // 10**5 for v in s]) == [(900 * 1000) ** 2, 0]
