import numpy as np
import pyarrow as pa

import corpus_pipeline
from sluice.llm import common, near_copies, simhash

DOCS = "doc_id long, text string, n int"


def similarity(a, b):
    return near_copies.jaccard(*(frozenset(near_copies.shingles(near_copies.words_of(t))) for t in (a, b)))


def edited(rng, words, least, most):
    """A copy with words changed one by one until its similarity lies in the range."""
    while True:
        new = list(words)
        for at in rng.permutation(len(words)):
            new[at] = f"new{rng.integers(1 << 30)}"
            now = similarity(" ".join(words), " ".join(new))
            if now < least:
                break
            if now <= most:
                return new


def test_planted_pairs_go(spark):
    rng = np.random.default_rng(1)
    rows, far = [], 0
    for i in range(120):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        rows += [(2 * i, " ".join(words), 0), (2 * i + 1, " ".join(edited(rng, words, 0.8, 0.95) if i < 100 else edited(rng, words, 0.7, 0.79)), 0)]
        far += i < 100 and bin(simhash.fingerprint(rows[-1][1]) ^ simhash.fingerprint(rows[-2][1])).count("1") > simhash.REACH
    assert far > 20  # those that four bits don't reach
    kept = corpus_pipeline.distinct(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in rows if r[0] % 2 == 0 or r[0] >= 200]


def test_a_look_alike_stays(spark):
    rng = np.random.default_rng(2)
    one, two = ("buy cheap pills today now " * 400 + " ".join(f"{s}{x}" for x in rng.integers(0, 99999, 150)) for s in "xy")
    assert bin(simhash.fingerprint(one) ^ simhash.fingerprint(two)).count("1") <= simhash.REACH and similarity(one, two) < 0.1
    assert near_copies.keep_one(spark.createDataFrame([(1, one, 0), (2, two, 0)], DOCS)).count() == 2


def test_versions_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    words = [f"w{x}" for x in rng.integers(0, 900, 200)]
    rows = [(i, " ".join(edited(rng, words, 0.7, 0.97)), 1) for i in range(60)]
    rows += [(100, None, 1), (101, "", 1), (102, "One two", 1), (103, "one  TWO", 1), (None, rows[0][1], 1), (0, rows[0][1], 2)]
    kept = near_copies.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    texts = {r.doc_id: r.text for r in kept if r.doc_id is not None}
    ids = sorted(texts)
    assert all(similarity(texts[a], texts[b]) < near_copies.SIMILAR for a in ids for b in ids if a < b)
    every = {i: t for i, t, _ in rows if i is not None}
    assert all(any(similarity(every[i], every[j]) >= near_copies.SIMILAR for j in every if j < i) for i in every if i not in texts)
    assert len(kept) == len(texts) + 2 and {0, 100, 102} <= set(ids)
    assert near_copies.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_rows_of_one_id_are_told_apart_by_their_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, 0), (5, a, 1), (5, b, 2), (5, b, 3), (None, a, 4), (9, b.upper(), 5)]
    kept = near_copies.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.n for r in kept) == [0, 2, 3, 4]


def boilerplate(n, unlike):
    """Texts of 300 common words and some of their own: none is a near copy of another."""
    common = [f"common{i}" for i in range(300)]
    return [(i, " ".join(common + [f"own{i}x{k}" for k in range(unlike)]), 0) for i in range(n)]


def test_boilerplate_does_not_multiply(spark, monkeypatch):
    rows = boilerplate(300, 60)
    assert 0.6 < similarity(rows[0][1], rows[1][1]) < 0.8
    counts = []
    plain = near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, sets: (counts.append((pairs.count(), pairs.distinct().count())), plain(pairs, sets))[1])
    assert near_copies.keep_one(spark.createDataFrame(rows, DOCS)).count() == 300
    assert sum(n for n, _ in counts) < 5 * 300 and all(n == m for n, m in counts)


def test_prefixes_lose_no_pair(spark):
    """All pairs of random sets of 0.8 or more are among those of the prefixes."""
    rng = np.random.default_rng(7)
    sets = []
    for k in range(60):
        base = rng.choice(400, rng.integers(1, 60), replace=False)
        for _ in range(4):
            own = [x for x in base if rng.random() < 0.93] + rng.integers(400, 900, rng.integers(0, 4)).tolist()
            sets.append(sorted({int(x) for x in own}) or [int(base[0])])
    rows = [(bytes([k >> 8, k & 255]), (k, b""), s) for k, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "d binary, o struct<m: long, d: binary>, h array<bigint>")
    found = {(int.from_bytes(r.a), int.from_bytes(r.b)) for r in near_copies.prefix_pairs(df).collect()}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if near_copies.jaccard(frozenset(sets[i]), frozenset(sets[j])) >= near_copies.SIMILAR}
    assert want <= found and len(want) > 50 and len(found) < len(sets) ** 2 / 8
    checked = {(int.from_bytes(r.a), int.from_bytes(r.b)) for r in near_copies.verified(near_copies.prefix_pairs(df), df).collect()}
    assert checked == want


def test_columns_of_any_name(spark):
    rows = [(1, "x y", 7, 8, 9, 10), (2, "x y", 7, 8, 9, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, d int, m int, gone int, i int")
    kept = near_copies.keep_one(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == rows[:1]


def test_texts_come_in_small_batches(spark):
    """As many rows at once as `written` is told, and the session's own size afterwards."""
    usual = spark.conf.get(common.BATCH)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    sizes = common.written(spark.range(0, 1800, 1, 1).mapInArrow(run, "n long"), "sizes", batch=near_copies.TEXTS).collect()
    assert sum(r.n for r in sizes) == 1800 and max(r.n for r in sizes) <= near_copies.TEXTS
    assert spark.conf.get(common.BATCH) == usual
