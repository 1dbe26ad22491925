import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import fingerprint


def plain_phrases(text):
    """The textbook parse, one character at a time."""
    seen, w = set(), ""
    for c in text:
        w += c
        if w not in seen:
            seen.add(w)
            w = ""
    return seen


def plain_signature(text):
    seen = sorted(plain_phrases(text))
    joined = "".join(seen)
    ends = np.cumsum([len(p) for p in seen]).astype(np.int64)
    if not seen:
        return np.zeros(0, np.uint32)
    h = fingerprint.phrase_hashes(joined, ends - [len(p) for p in seen], ends) >> np.uint64(32)
    return np.unique(h.astype(np.uint32))[: fingerprint.SIZE]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abé😀", max_size=80), st.text(alphabet="abc", max_size=80))
def test_pair_equals_plain_parse(text, following):
    own, edited_sig, edited = fingerprint.fingerprint_pair(text, following)
    assert edited == text[: len(text) - len(text) // 2] + following[: len(text) // 2]
    assert own.tolist() == plain_signature(text).tolist() == fingerprint.fingerprint_pair(text, None)[0].tolist()
    assert edited_sig.tolist() == plain_signature(edited).tolist()


def test_likeness_is_the_jaccard_index_of_small_sets():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = (np.unique(rng.integers(0, 60, 40)).astype(np.uint32) for _ in range(2))
        assert fingerprint.likeness(a, b) == len({*a} & {*b}) / len({*a} | {*b})
    e = np.zeros(0, np.uint32)
    assert fingerprint.likeness(e, e) == 1.0
    assert fingerprint.likeness(e, np.array([1], np.uint32)) == 0.0


def check(spark, rows, monkeypatch, bucket):
    monkeypatch.setattr(fingerprint, "ROWS_A_BUCKET", bucket)
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars string")
    out = fingerprint.fingerprint_documents(df).collect()
    line = sorted(((i, t or "") for i, t, _ in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for k, (i, t) in enumerate(line):
        following = line[(k + 1) % len(line)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = map(plain_signature, (t, edited, following))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.hexed(a), fingerprint.hexed(b), fingerprint.likeness(a, b), fingerprint.likeness(a, c)))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_documents(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(i), " ".join(rng.choice(["ab", "cé", "d"], int(rng.integers(0, 60)))), "x") for i in rng.permutation(60) * 3]
    check(spark, rows, monkeypatch, 7)
    check(spark, rows + [(None, "z z", "x"), (None, None, "x"), (9, "dup", "x"), (9, "dup", "x"), (9, None, "y")], monkeypatch, 7)
    check(spark, rows[:1], monkeypatch, 7)
    check(spark, [(None, "only", "x")], monkeypatch, 7)
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars string").limit(0)
    assert fingerprint.fingerprint_documents(df).count() == 0
