import zlib
from collections import Counter
from functools import lru_cache
from math import exp, log, log10

import numpy as np
import public_tokenizers
import pytest

from sluice.llm import lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")


def plain_marginal(word, number, logs):
    raw = lattice.START + word

    @lru_cache(maxsize=None)
    def tail(i):
        if i == len(raw):
            return 1.0
        return sum(exp(logs[number[raw[i:j]]]) * tail(j) for j in range(i + 1, len(raw) + 1) if raw[i:j] in number)

    return log(tail(0))


def test_marginals_against_plain_recursion():
    pieces = lattice.load(PATH)
    number = {n: i for i, n in enumerate(pieces.names)}
    logs = lattice.weights(pieces)
    assert abs(np.exp(logs).sum() - 1) < 1e-9
    words = [w.encode() for w in ["the", "then", "x", "größe", "zzzzzz", "internationalisation", "漢字", "\x00", "a" * 70]] + [b"\xff\xfe"]
    got = lattice.log_probabilities(pieces, logs, words)
    assert np.allclose(got, [plain_marginal(w, number, logs) for w in words], atol=1e-9)


def test_expected_counts_add_up():
    pieces = lattice.load(PATH)
    logs = lattice.weights(pieces)
    words, times = [b"then", b"them", b"cat"], np.array([2.0, 1.0, 3.0])
    counts = lattice.Lattice(pieces, words).expected(logs, times)
    length = np.array([len(n) for n in pieces.names])
    assert np.isclose((counts * length).sum(), sum(t * (len(w) + 3) for w, t in zip(words, times)))


@pytest.mark.parametrize("frequent", [3, 1000])
def test_query_against_plain_counts(spark, monkeypatch, frequent):
    monkeypatch.setattr(lattice, "FREQUENT", frequent)
    texts = ["The cat\tsat", "the\x0bdog  sat", None, "", "newword the THE É é", "cat " * 20] * 6
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "the cat")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, word int, score string")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts, ends = Counter(), 0
    for i, t in rows:
        if not held(i):
            counts.update(lattice.words_of(t))
            ends += 1
    total, types = sum(counts.values()) + ends, len(counts) + 1
    key = lambda r: (str(r[0]), *map(str, r[1:5]))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lattice.score_documents(df, PATH).collect()), key=key)
    want = []
    for i, t in rows:
        ws = lattice.words_of(t)
        base = sum(log10((counts[w] + 1) / (total + types + 1)) for w in ws) + log10((ends + 1) / (total + types + 1))
        want.append((i, held(i), len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, total, base))
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] < 0
    assert lattice.score_documents(df.limit(0), PATH).count() == 0
