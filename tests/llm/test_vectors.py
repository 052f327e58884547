"""Whitening against a full eigendecomposition, hard negatives against all scores, and odd tables for both."""

import numpy as np
import pytest

from tidemark.llm.negatives import bond, hard_negatives, op13_hard_negatives
from tidemark.llm.storage import Scratch
from tidemark.llm.whitening import deviations, leading_eigenpairs, op12_whitening, whiten

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, label int, embedding array<float>, x string, row string, strip long"


def reference_whitening(rows):
    """{vec_id: (deviation, components)}, eigenvalues and trace by numpy."""
    x = {i: tuple(int(np.floor(256 * float(np.float32(c)))) for c in v) for i, v in rows}
    distinct = np.array(sorted(set(x.values())), dtype=np.int64)
    n, s = len(distinct), distinct.sum(0)
    centred = (distinct * n - s) / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    out = {i: (sum((n * c - int(t)) ** 2 for c, t in zip(v, s)), (np.array(v) - s / n) @ q[:, :4] / np.sqrt(e[:4])) for i, v in x.items()}
    return out, e, n


def test_whitening_equals_full_eigendecomposition(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()
            if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding)]
    want, e, n = reference_whitening(rows)
    got = op12_whitening(spark, SF).collect()
    assert len(got) == 4 * len(rows)
    for c in range(1, 5):
        mine = {r.vec_id: r for r in got if r.component == c}
        a = np.array([mine[i].whitened for i in want])
        b = np.array([want[i][1][c - 1] for i in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        assert all(mine[i].deviation == want[i][0] and mine[i].n == n for i in want)
        assert all(abs(r.explained / (e[c - 1] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9 for r in mine.values())


@pytest.mark.parametrize("values", [np.linspace(1, 2, 60), np.r_[9.0, 9, 9, 9, 9, np.full(55, 1e-9)], np.r_[5.0, 3, np.zeros(58)],
                                    np.ones(60), np.r_[1e6, 1.3, 1.2, 1.1, np.full(56, 1.0)], np.geomspace(1e9, 1e-9, 60)])
def test_eigenpairs_of_hard_spectra(values):
    """Close, equal, vanishing and far apart eigenvalues."""
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((60, 60)))[0]
    v = (q * values) @ q.T
    e, u, residuals = leading_eigenpairs(lambda y: v @ y, 60, 4)
    assert np.allclose(e, np.sort(values)[::-1][:4], rtol=1e-9, atol=1e-9 * values.max())
    assert np.abs(u.T @ u - np.eye(4)).max() < 1e-12 and residuals.max() <= 1e-10 * values.max()


def odd_rows():
    rng = np.random.default_rng(3)
    v = [[float(c) for c in rng.standard_normal(6)] for _ in range(40)]
    rows = [(i, i % 3, v[i % 30]) for i in range(40)]  # ten repeated vectors
    rows += [(5, 2, v[5]), (5, 2, v[5]), (100, 0, v[1]), (100, 0, v[1]), (200, 0, v[1]), (None, 1, v[2]), (None, None, v[3])]
    rows += [(300, 1, None), (301, 1, []), (302, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, 1, [float("nan")] * 6),
             (304, 1, [float("inf")] + [0.0] * 5), (305, 1, [1.0]), (306, 1, [1e30] + [0.0] * 5), (400, None, v[4])]
    return [(a, b, c, "x", None, 7) for a, b, c in rows]


def test_whitening_of_odd_rows(spark):
    rows = odd_rows()
    good = [(k, r[2]) for k, r in enumerate(rows) if r[2] and len(r[2]) == 6 and all(c is not None and abs(c) < 1e9 for c in r[2])]
    want, e, n = reference_whitening(good)
    got = whiten(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")).collect()
    assert n == 30 and len(got) == 4 * len(good)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.deviation) for r in got if r.component == 1) == \
        sorted((rows[k][0] is None, rows[k][0] or 0, want[k][0]) for k, _ in good)
    none = spark.createDataFrame([], SCHEMA)
    assert whiten(none, Scratch(spark, "t")).collect() == []
    same = spark.createDataFrame([r for r in rows if r[2] == rows[1][2]], SCHEMA)
    assert same.count() > 1 and whiten(same, Scratch(spark, "t")).collect() == []
    line = spark.createDataFrame([(k, 0, [float(k), 2.0 * k], "", "", 0) for k in range(9)], SCHEMA)
    assert {r.component for r in whiten(line, Scratch(spark, "t")).collect()} == {1}


def test_deviations_are_exact_beyond_floats():
    x = np.array([[1 << 33, -(1 << 33)], [3, 4], [1 << 39, 0]])
    sums = [(1 << 33) + 3 + (1 << 39), 4 - (1 << 33)]
    want = [sum((3 * int(c) - s) ** 2 for c, s in zip(v, sums)) for v in x]
    assert deviations(x, 3, sums) == [w if w < 1 << 63 else None for w in want]
    assert deviations(x[1:2], 1, [2, 4]) == [1]


def reference_negatives(rows, every=100):
    """Rows of (vec_id, label, embedding) scored one by one."""
    r = [(k, i, b, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for k, (i, b, v) in enumerate(rows)]
    out = []
    for ka, a, la, va in r:
        if a is None or a % every:
            continue
        s = sorted(((-sum(x * y for x, y in zip(va, v)), i is None, i or 0, k, i, b) for k, i, b, v in r if k != ka), key=lambda t: t[:4])
        for p in [t for t in s if t[5] == la][:5]:
            n = [t for t in s if t[5] != la and 80 * -p[0] <= 100 * -t[0] <= 100 * -p[0]][:5]
            out += [(a, p[4], j + 1, t[4], -p[0], -t[0]) for j, t in enumerate(n)]
    return sorted(out, key=str)


def test_negatives_equal_all_scores(spark):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows = [(i, (b + 1) % 10 if i % 7 == 0 else b, v) for i, b, v in rows
            if b is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    got = sorted(map(tuple, op13_hard_negatives(spark, SF).collect()), key=str)
    assert got == reference_negatives(rows) and got


def test_negatives_of_odd_rows(spark):
    rows = odd_rows()
    good = [r[:3] for r in rows if r[1] is not None and r[2] and len(r[2]) == 6 and all(c is not None and abs(c) < 1e5 for c in r[2])]
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA).coalesce(1), Scratch(spark, "t"), 10).collect()
    assert sorted(map(tuple, got), key=str) == reference_negatives(good, 10) and got
    assert hard_negatives(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).collect() == []


def test_negatives_over_many_blocks_and_equal_vectors(spark, monkeypatch):
    """A third of the rows are one vector; ties go to the smaller id across blocks and chunks."""
    from tidemark.llm import negatives
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "CHUNK", 3)
    rng = np.random.default_rng(5)
    v = np.round(rng.standard_normal((300, 9)), 1)
    v[::3] = v[0]
    rows = [(int(i), int(i) % 4, [float(c) for c in v[i]]) for i in rng.permutation(300)]
    df = spark.createDataFrame([(*r, "", "", 0) for r in rows], SCHEMA).repartition(5)
    got = sorted(map(tuple, hard_negatives(df, Scratch(spark, "t"), 10).collect()), key=str)
    assert got == reference_negatives(rows, 10)


def test_bond_drops_candidates_early():
    rng = np.random.default_rng(2)
    a = np.r_[rng.integers(-400, 400, 8), np.zeros(56, np.int64)]
    cols = rng.integers(-100, 100, (64, 2000))
    place, score, live = bond(a, cols, cols.min(1), cols.max(1), np.ones(2000, bool), [-(1 << 62)], [1 << 62])
    want = a @ cols
    assert len(place) < 200 and set(np.argsort(-want)[:5]) <= set(place[live[0]]) and (score == want[place]).all()
