import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import simhash
from sluice.llm.components import Forest, components


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(pairs, nodes):
    up = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    return up


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB é\x0b\t\n\x1cİ", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_components(spark):
    rng = np.random.default_rng(0)
    for n, m in ((40, 30), (60, 200)):
        pairs = [tuple(map(int, p)) for p in rng.integers(0, n, (m, 2))] + [(100 + i, 101 + i) for i in range(25)]
        df = spark.createDataFrame([*pairs, (None, 3), (7, 7)], "a long, b long")
        nodes = {x for p in pairs if p[0] != p[1] for x in p}
        assert {(r.node, r.root) for r in components(df).collect()} == {*plain_components([p for p in pairs if p[0] != p[1]], nodes).items()}
    assert components(df.limit(0)).count() == 0


def brute(fps):
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= simhash.REACH]
    return plain_components(pairs, fps)


def test_links_of_random_clusters(spark, monkeypatch):
    rng = np.random.default_rng(2)
    fps = set()
    for _ in range(12):
        x = int(rng.integers(0, 1 << 63)) * 2
        for _ in range(25):
            y = x
            for b in rng.integers(0, 64, int(rng.integers(0, 7))):
                y ^= 1 << int(b)
            fps.add(y)
            x = y if rng.random() < 0.3 else x
    fps = sorted(fps)
    signed = [int(np.array(f, np.uint64).view(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = brute(fps)
    for hot in (4096, 6):
        monkeypatch.setattr(simhash, "HOT", hot)
        forest = Forest()
        for r in simhash.find_links(df).collect():
            forest.join(r.a, r.b)
        back = dict(zip(signed, fps, strict=True))
        groups = {}
        for s in signed:
            groups.setdefault(forest.root(s), set()).add(back[s])
        assert {frozenset(g) for g in groups.values()} == {frozenset(k for k in fps if want[k] == r) for r in set(want.values())}


def test_documents(spark):
    rng = np.random.default_rng(6)
    base = [" ".join(rng.choice(["ship", "sails", "over", "The", "blue", "sea"], 60)) for _ in range(15)]
    rows = []
    for i in range(80):
        words = base[i % 15].split()
        for _ in range(int(rng.integers(0, 3))):
            words[int(rng.integers(0, 60))] = "edited"
        rows.append((int(i * 7 % 83), " ".join(words), "x"))
    rows += [(200, None, "x"), (201, "", "x"), (202, " \n", "x"), (202, " \n", "x"), (None, rows[0][1], "x"), (None, "alone and null", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = simhash.simhash_components(df).collect()
    fps = {plain_fingerprint(t or "") for _, t, _ in rows}
    root = brute(sorted(fps))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            r = root[plain_fingerprint(t or "")]
            least[r] = min(i, least.get(r, i))
    want = [(i, f"{plain_fingerprint(t or ''):016x}", least.get(root[plain_fingerprint(t or "")])) for i, t, _ in rows]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _, c in want if i is None or c == i), key=str)
    assert simhash.simhash_components(df.limit(0)).count() == 0
