import numpy as np
import pytest

from paperloom.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<float>, label string, digest string"


def brute(rows, least=0.9):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    d = max((len(v) for _, v in good), default=1)
    m = np.array([np.pad(v / np.linalg.norm(v), (0, d - len(v))) for _, v in good]).reshape(len(good), d)
    near = m @ m.T >= least
    np.fill_diagonal(near, False)
    root = np.arange(len(good))
    ids = np.array([i for i, _ in good])
    label = ids.copy()
    for _ in root:
        label = np.array([min([label[i], *label[near[i]]]) for i in root])
    out = {i: (int(near[k].sum()), int(label[k])) for k, (i, _) in enumerate(good)}
    return {i: out.get(i, (0, i)) for i, _ in rows}


def clustered(rng, groups, each, dim=64):
    rows, n = [], 0
    for _ in range(groups):
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        for _ in range(rng.integers(1, each)):
            v = c + rng.normal(size=dim) * rng.choice([0.01, 0.04, 0.055])
            rows.append((n, [float(x) for x in np.float32(v * rng.choice([1, 1e-20, 1e15]))]))
            n += 1
    return rows


def test_hadamard_keeps_lengths_and_is_its_own_inverse():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(E.hadamard(E.hadamard(x)), x)
    assert np.allclose(np.linalg.norm(E.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def at_cosine(rng, n, dims, cosine):
    a = rng.normal(size=(n, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.normal(size=a.shape)
    z -= (z * a).sum(1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * z


@pytest.mark.parametrize("rows", [1000, 60_000, 1 << 22, 1 << 32])
@pytest.mark.parametrize("dims", [2, 3, 8, 64, 100, 384])
def test_recall_at_the_threshold(rows, dims):
    a, b = at_cosine(np.random.default_rng(1), 1500, dims, 0.9)
    how = E.hashing_for(rows, dims)
    hit = [(x[:, :, None] == y[:, None, :]).any((1, 2)) for at in range(0, 1500, 250) for x, y in [(E.bucket_keys(a[at : at + 250], how), E.bucket_keys(b[at : at + 250], how))]]
    assert np.concatenate(hit).mean() > 0.995


def test_more_vectors_get_finer_keys():
    assert E.hashing_for(51_000, 64).hashes == 2 < E.hashing_for(1 << 30, 64).hashes


@pytest.mark.parametrize("dims,hashes", [(2, 2), (16, 2), (64, 3), (300, 2)])
def test_recall_end_to_end(spark, dims, hashes):
    """Pairs at exactly the least cosine or a little over it, in several dimensions and with more hashes to a key."""
    a, b = at_cosine(np.random.default_rng(5), 400, dims, 0.9005)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.float32(np.concatenate([a, b])))]
    how = None
    if hashes != 2:
        how = next(h for n in (1 << 22, 1 << 26, 1 << 30) if (h := E.hashing_for(n, dims)).hashes == hashes)
    got = {r.vec_id: r.n_links for r in E.near_embeddings(spark.createDataFrame([(i, v, "x", "") for i, v in rows], SCHEMA), how=how).collect()}
    want = brute(rows)
    assert all(got[i] <= want[i][0] for i in want)
    assert sum(want[i][0] - got[i] for i in want) <= 0.002 * sum(v[0] for v in want.values())


def test_against_brute_force_with_a_large_group(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = clustered(rng, 60, 12)
    centre = rng.normal(size=64)
    rows += [(1000 + i, [float(x) for x in np.float32(centre + rng.normal(size=64) * 0.03)]) for i in range(700)]
    monkeypatch.setattr(E, "BLOCK", 256)  # the group is over one block
    rows += [(5000 + i, rows[0][1]) for i in range(30)]
    df = spark.createDataFrame([(i, v, "x", "clash") for i, v in rows], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_embeddings(df).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    assert {i: v[1] for i, v in got.items()} == {i: v[1] for i, v in want.items()}
    missed = sum(want[i][0] - got[i][0] for i in want)
    assert all(got[i][0] <= want[i][0] for i in want) and missed <= 0.001 * sum(v[0] for v in want.values())


def test_odd_vectors(spark):
    v = [1.0, 2.0, 0.0]
    rows = [(1, v), (2, v), (2, v), (None, v), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 2.0]), (10, [-1.0, -2.0, 0.0]), (None, [0.0, 0.0, 9.0])]
    df = spark.createDataFrame([(i, x, None, None) for i, x in rows], SCHEMA)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_embeddings(df).collect()), key=str)
    links = [(i, n, c) for i, n, c, _ in got if i in (1, 2, 9)]
    assert links == [(1, 4, 1), (2, 4, 1), (2, 4, 1), (9, 4, 1)]  # 9 is the same direction, padded with zeros
    assert [(n, c, k) for i, n, c, k in got if i in (3, 4, 5, 6, 7, 8, 10)] == [(0, 10, True), (0, 3, True), (0, 4, True), (0, 5, True), (0, 6, True), (0, 7, True), (0, 8, True)]
    assert sorted(((n, c, k) for i, n, c, k in got if i is None), key=str) == [(0, None, True), (4, 1, False)]


def test_empty(spark):
    assert E.near_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0
