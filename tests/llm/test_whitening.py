import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sentilake.llm import whitening as wh
from sentilake.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def entries(vectors):
    return np.floor(64 * np.asarray(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000


def brute(vectors, k=32):
    """n, exact deviations, eigenvalues, components and trace, by numpy's own solver."""
    x = entries(vectors)
    n = len(x)
    off = [[n * int(a) - int(s) for a, s in zip(row, x.sum(axis=0), strict=True)] for row in x]
    centred = np.array(off, dtype=np.float64) / n
    v = centred.T @ centred / n
    values, parts = np.linalg.eigh(v)
    return n, [sum(a * a for a in row) for row in off], values[::-1][:k], parts[:, ::-1][:, :k], np.trace(v), centred


def agrees(got, ids, vectors, k=32):
    n, squares, values, parts, trace, centred = brute(vectors, k)
    table = {(r.vec_id, r.component): r for r in got}
    k = len(values)
    assert len(got) == len(table) == len(ids) * k
    for i, square in zip(ids, squares, strict=True):
        assert {(table[i, c].n, int(table[i, c].deviation)) for c in range(1, k + 1)} == {(n, square)}
    white = np.array([[table[i, c].whitened for c in range(1, k + 1)] for i in ids], dtype=float)
    want = centred @ parts / np.sqrt(values)
    assert np.allclose(np.abs(white), np.abs(want), atol=1e-6)
    assert np.allclose(white.T @ white / n, np.eye(k), atol=1e-8)
    assert np.allclose([table[ids[0], c].explained for c in range(1, k + 1)], values / trace, rtol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-8


def test_whole_table_against_numpy(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    agrees(QUERIES["op13_whitening"](spark, DATA).collect(), [r.vec_id for r in table], [r.embedding for r in table])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 24), st.integers(0, 2**32 - 1), st.sampled_from(["plain", "equal", "blocks", "low rank", "wide"]))
def test_leading_components(d, seed, kind):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    values = {
        "plain": rng.uniform(0, 9, d),
        "equal": np.repeat(rng.uniform(1, 2, -(-d // 3)), 3)[:d],
        "blocks": np.where(np.arange(d) % 2 == 0, 1.0, 1 + 1e-12),
        "low rank": np.where(np.arange(d) < 2, 3.0, 0.0),
        "wide": 10.0 ** -rng.uniform(0, 9, d),
    }[kind]
    m = np.diag(values) if kind == "blocks" else (q * values) @ q.T
    m = (m + m.T) / 2
    got, parts = wh.leading_components(m, 32)
    assert np.allclose(got, np.linalg.eigvalsh(m)[::-1][:32], atol=1e-13 * max(values))
    assert np.allclose(parts.T @ parts, np.eye(len(got)), atol=1e-10)
    assert np.allclose(m @ parts, parts * got, atol=1e-10 * max(values))


def test_sturm_counts():
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal(12), rng.standard_normal(11)
    t = np.diag(a) + np.diag(b, 1) + np.diag(b, -1)
    shifts = np.linspace(-4, 4, 57)
    assert (wh.sturm_counts(a, b, shifts) == (np.linalg.eigvalsh(t)[None] < shifts[:, None]).sum(axis=1)).all()


def test_fewer_dimensions_than_components_and_repeats(rows):
    rng = np.random.default_rng(6)
    data = rng.standard_normal((200, 5)) * [1, 2, 3, 4, 5]
    data[50:] = data[50]  # one vector holds most rows
    got = wh.whiten(rows([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>").repartition(7))
    agrees(got.collect(), list(range(200)), data)


def test_large_entries_are_exact(rows):
    data = [[1e12, 3.0], [-4e13, 5.5], [7e11, 1e3], [2.0**49, -8.0]]
    got = wh.whiten(rows([(i, v) for i, v in enumerate(data)], "vec_id long, embedding array<double>")).collect()
    _, squares, *_ = brute(data)
    assert {r.vec_id: int(r.deviation) for r in got} == dict(enumerate(squares))


def test_edge_tables(rows):
    schema = "vec_id long, embedding array<float>, label int, component string, id int, d int"
    assert wh.whiten(rows([], schema)).count() == 0
    nan, inf = float("nan"), float("inf")
    data = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [1.0, -inf]), (5, []), (6, [2.0]), (None, [1.0, 2.0]), (8, [2.0, 4.0]), (8, [2.0, 4.0]), (9, [0.0, 1e20])]
    got = wh.whiten(rows([(i, v, 0, "c", 1, 2) for i, v in data], schema)).collect()
    assert {(r.vec_id, r.component) for r in got} == {(6, 1), (None, 1), (None, 2), (8, 1), (8, 2)}
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in got if r.vec_id == 6] == [(1, 0, None, None)]
    line = [r for r in got if r.vec_id != 6 and r.component == 1]
    assert len(line) == 3 and {r.n for r in line} == {3}
    assert sorted(round(r.whitened, 9) for r in line) == [round(v, 9) for v in sorted([-(2**0.5), 0.5**0.5, 0.5**0.5])] or sorted(
        round(r.whitened, 9) for r in line
    ) == [round(v, 9) for v in sorted([2**0.5, -(0.5**0.5), -(0.5**0.5)])]
    assert all(r.whitened is None for r in got if r.component == 2)
    only = wh.whiten(rows([(1, [0.5, 0.25])], "vec_id long, embedding array<double>")).collect()
    assert [(r.component, r.deviation, r.whitened) for r in only] == [(1, 0, None), (2, 0, None)]


def test_too_many_moments_are_refused(rows, monkeypatch):
    monkeypatch.setattr(wh, "MATRIX_ENTRIES", 2)
    with pytest.raises(ValueError, match="moments"):
        wh.whiten(rows([(1, [0.5, 0.25])], "vec_id long, embedding array<double>"))
