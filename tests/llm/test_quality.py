import numpy as np
import pytest

from sluice.llm import quality


def make(rng, good, n=40):
    words = rng.choice(["the", "ship", "Sails", "over", "blue", "water,", "and", "returns."], n)
    return " ".join(words) if good else " ".join(w + rng.choice(["$$$", "%%%"]) for w in words)


def test_units_and_forms():
    assert quality.form("The%%%") == "Aa%"
    assert quality.form("12,345!!") == "0,0!"
    units = quality.Units(["other", "again", "wthe", "fa"])
    assert units.of("the the ship Sails sails").tolist() == [2, quality.AGAIN, 3, quality.OTHER, 3]
    assert units.of("").tolist() == []


def test_word_vectors_against_a_plain_sum():
    units = quality.Units(["other", "again", "wa", "wb", "wc"])
    ids = [units.of("a b c a"), units.of("b c"), units.of("")]
    index = np.stack([quality.index_vector(n) for n in units.names])
    context = np.zeros_like(index)
    for x in ids:
        for i in range(len(x)):
            for j in range(len(x)):
                if 0 < abs(i - j) <= quality.REACH:
                    context[x[i]] += index[x[j]]
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    np.testing.assert_allclose(quality.word_vectors(units, ids), index + context / np.maximum(norm, 1e-9), atol=1e-5)


def test_scores_follow_a_plain_network():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 200).tolist()
    texts = [make(rng, k) for k in y]
    m = quality.Model(texts, y)
    t = texts[3]
    x = (np.mean([m.vectors[i] for i in m.units.of(t)], axis=0) - m.mean) / m.scale
    z = (np.tanh(x @ m.layers[0] + m.layers[1]) @ m.layers[2] + m.layers[3])[0] / m.temperature
    assert m.scores([t])[0] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-3)
    assert m.temperature >= 1


def test_held_out_accuracy_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, make(rng, i % 3 > 0), "en") for i in range(300)]
    odd = [(900, None, "en"), (901, "", None), (902, "the ship", "en"), (902, "the ship", "en"), (None, "the ship", "en")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300)] + [(5, 1), (900, None), (None, 1)], "doc_id long, quality int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == 305
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert held and all(r.predicted == int(r.doc_id % 3 > 0) for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
