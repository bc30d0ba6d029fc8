import itertools

import numpy as np
import pytest

from sentilake.llm import lattice_dedup as ld


def corpus(seed, n=300, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    near = base[rng.integers(0, 40, n)] + rng.standard_normal((n, dim)) * 0.12
    chain = [base[0]]
    for _ in range(10):
        chain.append(chain[-1] + rng.standard_normal(dim) * 0.25)
    x = np.concatenate([base, near, chain, near[:20], np.repeat(near[:1], 30, axis=0)]).astype(np.float32)
    return [(i, v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(x)]


def brute(data, threshold=0.93):
    x = np.array([v for _, v, _ in data], dtype=np.float64)
    label = np.array([y for *_, y in data])
    norm = np.sqrt((x * x).sum(axis=1))
    near = (x @ x.T / norm[:, None] / norm[None, :] >= threshold) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    root = np.arange(len(data))
    for _ in range(len(data)):
        new = np.array([min([root[i], *root[near[i]]]) for i in range(len(data))])
        if (new == root).all():
            break
        root = new
    return {i: (int(near[i].sum()), int(root[i])) for i in range(len(data))}


@pytest.mark.parametrize("block", [8, 512])
def test_against_brute_force(spark, rows, block):
    data = corpus(1)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ld.link_vectors(rows(data, "vec_id long, embedding array<float>, label int"), block=block).collect()}
    want = brute(data)
    found, total = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert 0.99 * total <= found <= total
    assert all(got[i][0] <= want[i][0] and got[i][1] >= want[i][1] for i in want)
    assert all(v[2] == (i == v[1]) for i, v in got.items())


def test_recall_just_above_the_threshold():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal(a.shape)
    b -= (b * a).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    for cosine, least in ((0.93, 0.99), (0.96, 0.999)):
        x, y = ld.cells(a), ld.cells(cosine * a + np.sqrt(1 - cosine**2) * b)
        met = (x[:, :, None, 0] == y).any(axis=(1, 2)) | (y[:, :, None, 0] == x).any(axis=(1, 2))
        assert met.mean() >= least
    far = ld.cells(b)
    met = (ld.cells(a)[:, :, None, 0] == far).any(axis=2).mean()
    assert met < 0.02


def test_nearest_points_of_e8():
    rng = np.random.default_rng(3)
    y = rng.uniform(-1, 1, (200, 8))
    got = ld.nearest_e8(y)[0] / 2
    shell = [np.array(p) for p in itertools.product((-1, 0, 1), repeat=8) if sum(p) % 2 == 0] + [np.array(p) for p in itertools.product((-0.5, 0.5), repeat=8) if sum(p) % 2 == 0]
    shell = np.array(shell)
    best = ((y[:, None] - shell[None]) ** 2).sum(axis=2).min(axis=1)
    assert np.allclose(((y - got) ** 2).sum(axis=1), np.minimum(best, ((y - got) ** 2).sum(axis=1)))
    assert (((y - got) ** 2).sum(axis=1) <= best + 1e-9).all()


def test_edge_tables(rows):
    schema = "vec_id long, embedding array<float>, label int, cells int, uid string"
    assert ld.link_vectors(rows([], schema)).count() == 0
    nan, inf = float("nan"), float("inf")
    data = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [], 1), (7, [1.0, 2.0], None), (8, [1.0, 2.0], 1), (8, [1.0, 2.0], 1), (9, [2.0, 4.0], 1), (10, [1.0, 2.0, 0.0], 1), (11, [1.0, 2.0], 2), (None, [1.0, 2.0], 1)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in ld.link_vectors(rows([(*x, 0, "u") for x in data], schema)).collect()), key=str)
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 10, 11)]
    assert got == sorted([*alone, (8, 3, 8, True), (8, 3, 8, True), (9, 3, 8, False), (None, 3, 8, False)], key=str)
