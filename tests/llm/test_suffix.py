import hashlib

import numpy as np

from sluice.llm import suffix, suffix_dedup


def plain(rows):
    """What the contract says, by a dictionary of all strings of WIDTH bytes."""
    w = suffix_dedup.WIDTH
    texts = [(i if i is not None else suffix_dedup.LAST, (t or "").encode()) for i, t in rows]
    least = {}
    for i, raw in texts:
        for k in range(len(raw) - w + 1):
            g = raw[k : k + w]
            least[g] = min(least.get(g, i), i)
    out = []
    for i, raw in texts:
        gone, own = np.zeros(len(raw), bool), set()
        for k in range(len(raw) - w + 1):
            g = raw[k : k + w]
            if least[g] < i or g in own:
                gone[k : k + w] = True
            own.add(g)
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def sample(seed, n):
    rng = np.random.default_rng(seed)
    words = ["the", "of", "añb", "x", "stone", "river", "ü"]
    passages = [" ".join(rng.choice(words, 60)) for _ in range(4)]
    texts = []
    for _ in range(n):
        k = rng.integers(0, 8)
        if k == 0 and texts:
            t = texts[rng.integers(0, len(texts))]
        elif k == 1 and texts:
            t = texts[rng.integers(0, len(texts))]
            if t:
                at = int(rng.integers(0, len(t)))
                t = t[:at] + "Q" + t[at + 1 :]
        elif k == 2:
            t = passages[rng.integers(0, 4)].join(" ".join(rng.choice(words, rng.integers(0, 40))) for _ in range(3))
        elif k == 3:
            t = "ab" * int(rng.integers(0, 160))
        else:
            t = " ".join(str(x) for x in rng.integers(0, 10**6, rng.integers(0, 60)))
        texts.append(t)
    ids = [int(x) for x in rng.permutation(n * 3)[:n]]
    return list(zip(ids, texts))


def check(spark, rows, **patch):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, o string, t int")
    got = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(df).collect())
    want = sorted((i is None, i, *p) for (i, _), p in zip(rows, plain(rows)))
    assert got == want


def test_against_brute_force(spark):
    check(spark, sample(1, 120))


def test_cut_groups(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 3)
    monkeypatch.setattr(suffix_dedup, "LOCAL", 2)
    check(spark, sample(2, 150))


def test_nulls_repeats_and_empty(spark):
    long = "abcdefghij" * 30
    other = " ".join(map(str, range(200)))
    check(spark, [(5, None), (6, ""), (7, long), (7, long), (8, other), (8, other + "z"), (None, other[:300]), (9, "short")])
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.deduplicate(df).count() == 0


def test_sort_suffixes():
    data = np.frombuffer(b"banana$bandana$" * 3 + bytes(20), np.uint8)
    h = suffix.Hashes(data)
    starts = np.arange(45)
    order = suffix.sort_suffixes(data, h, starts, np.zeros(45, np.int64), 20)
    raw = data.tobytes()
    assert [raw[i : i + 20] for i in order] == sorted(raw[i : i + 20] for i in range(45))


def test_cleaned(spark):
    passage = "passage " * 40
    df = spark.createDataFrame([(1, passage + "one", 5, None), (2, passage + "two", 5, "s"), (3, passage, 5, "s"), (4, None, None, "s")], "doc_id long, text string, n_chars long, source string")
    got = {r.doc_id: r for r in suffix_dedup.cleaned(df).collect()}
    assert set(got) == {1, 2, 4} and got[2].text.endswith("two") and len(got[2].text) < 20 and got[2].n_chars == len(got[2].text)
