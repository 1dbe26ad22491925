import numpy as np
import pyarrow.parquet as pq
import pytest

from sluice.llm import vectors


def plain(rows, cosine):
    """(n_links, component) per row by brute force; rows of no usable vector are alone."""
    units = [vectors.usable(v) for _, v in rows]
    links = [[j for j, b in enumerate(units) if j != i and a is not None and b is not None and len(a) == len(b) and a @ b >= cosine] for i, a in enumerate(units)]
    root = list(range(len(rows)))
    for _ in rows:
        for i, near in enumerate(links):
            for j in near:
                root[i] = root[j] = min(root[i], root[j])
    ids = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            ids[root[i]] = min(ids.get(root[i], k), k)
    return [(len(links[i]), k if units[i] is None else ids.get(root[i])) for i, (k, _) in enumerate(rows)]


def check(spark, rows):
    df = spark.createDataFrame([(k, v, 3, "x") for k, v in rows], "vec_id long, embedding array<float>, label int, k string")
    rows = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()), key=str)
    want = sorted(((k, n, c, k is not None and k == c) for (k, _), (n, c) in zip(rows, plain(rows, vectors.COSINE))), key=str)
    assert got == want


def sample(seed, groups, size, dim=24):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        x = rng.normal(size=dim)
        out += [x + 0.3 * rng.normal(size=dim) * rng.random() for _ in range(size)] + [2 * x, x]
    order = rng.permutation(len(out))
    return [(int(i) * 3, out[i].tolist()) for i in order]


@pytest.mark.parametrize("chunk", [5, 256])
def test_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    check(spark, sample(4, 12, 12))


def test_odd_rows(spark):
    x = [1.0, 2.0, 3.0]
    check(spark, [(1, x), (2, x), (2, x), (None, x), (None, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [float("nan"), 1.0, 1.0]), (8, [None, 1.0, 2.0]), (9, [1.0, 2.0]), (10, [1e30, 2e30, 3e30]), (11, [-1.0, -2.0, -3.0])])
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_vectors(df).count() == 0


def test_table_distances_lose_nothing():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16))
    x = np.concatenate([x, x[:100] + 0.02 * rng.normal(size=(100, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = vectors.Index.fit(x, 500)
    home = index.probes(x)[:, 0]
    codes, missed = index.encode(x, home)
    for at in np.unique(home):
        m = np.flatnonzero(home == at)
        q, c = index.candidates(x, at, codes[m], missed[m], np.sqrt(0.1))
        found = set(zip(q.tolist(), m[c].tolist()))
        near = np.argwhere(x @ x[m].T >= 0.95)
        assert {(int(a), int(m[b])) for a, b in near} <= found and len(found) < len(x) * len(m)


def test_recall(spark):
    found = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").column("embedding").to_pylist()
    x = np.stack([u for u in map(vectors.usable, found) if u is not None])
    rng = np.random.default_rng(2)
    y = x[:1000] + 0.02 * rng.normal(size=(1000, x.shape[1]))
    x = np.concatenate([x, y / np.linalg.norm(y, axis=1, keepdims=True)])
    assert vectors.recall(x) >= 0.9


def test_many_lists_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LIST_SIZE", 4)
    rows = sample(7, 40, 12, 12)
    x = np.stack([vectors.usable(v) for _, v in rows])
    assert len(vectors.Index.fit(x, len(x)).coarse) > 100
    assert vectors.recall(x) == 1.0
    check(spark, rows)


@pytest.mark.parametrize("rows", [20_000, 160_000, 16_000_000])
def test_recall_at_the_threshold_over_many_lists(rows):
    """Planted pairs of cosine 0.95 to 0.951, with the lists that so many rows have."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.95, 0.951, (len(x), 1))
    y = cosine * x + np.sqrt(1 - cosine**2) * side
    index = vectors.Index.fit(x[: vectors.SAMPLE], rows)
    assert len(index.coarse) >= rows // vectors.LIST_SIZE
    a, b = index.probes(x[-2000:]), index.probes(y[-2000:])
    hit = (a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)
    print(rows, len(index.coarse), hit.mean())
    assert hit.mean() >= 0.97
    exact = vectors.Index.fit(x[: vectors.SAMPLE], 20_000, spread=None)
    a, b = exact.probes(x[-300:]), exact.probes(y[-300:])
    assert ((a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)).all()
