import numpy as np
import pytest

from sluice.llm import langid


def plain_gru(E, U, xs):
    h, out = np.zeros(langid.HIDDEN), []
    H = langid.HIDDEN
    for x in xs:
        u = U.astype(float) @ h
        z, r = (1 / (1 + np.exp(-(E[i * H : (i + 1) * H, x] + u[i * H : (i + 1) * H]))) for i in (0, 1))
        n = np.tanh(E[2 * H :, x] + r * u[2 * H :])
        h = (1 - z) * n + z * h
        out.append(h)
    return out


def plain(model, text):
    """Position by position, window by window."""
    total, W = np.zeros(len(model.langs)), langid.WINDOW
    for k in range(-(-len(text) // W)):
        start = min(k * W, max(0, len(text) - W))
        part = text[start : start + W]
        f = plain_gru(model.weights["Ef"], model.weights["Uf"], part)
        b = plain_gru(model.weights["Eb"], model.weights["Ub"], part[::-1])[::-1]
        for i in range(k * W - start, len(part)):
            s = model.weights["Vf"] @ f[i] + model.weights["Vb"] @ b[i] + model.weights["c"][:, 0]
            e = np.exp(s - s.max())
            total += e / e.sum()
    return total / len(text)


def test_batched_windows_equal_the_plain_network():
    rng = np.random.default_rng(1)
    w = langid.initial(3, seed=2)
    w["c"] += rng.normal(size=(3, 1)).astype(np.float32)
    model = langid.Model(["a", "b", "c"], w)
    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 5, 47, 48, 49, 95, 96, 97, 300)]
    got = model.probabilities(texts)
    assert not got[0].any()
    for t, p in zip(texts[1:], got[1:], strict=True):
        np.testing.assert_allclose(p, plain(model, t), atol=2e-4)


def test_backpropagation_against_differences():
    rng = np.random.default_rng(0)
    p = langid.initial(2)
    x = rng.integers(0, 256, (7, 3))
    down = rng.normal(size=(7, langid.HIDDEN, 3)).astype(np.float32)
    keep = []
    langid.gru_forward(p["Ef"], p["Uf"], x, keep)
    dE, dU = langid.gru_backward(p["Uf"], x, keep, down)

    def loss():
        return float((langid.gru_forward(p["Ef"], p["Uf"], x, []).astype(float) * down).sum())

    for name, grad in (("Ef", dE), ("Uf", dU)):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept = p[name][at]
        p[name][at] = kept + 1e-2
        up = loss()
        p[name][at] = kept - 1e-2
        low = loss()
        p[name][at] = kept
        assert (up - low) / 2e-2 == pytest.approx(float(grad[at]), rel=0.05)


def test_held_out_accuracy_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    words = {"en": ["the", "and", "thing", "with", "ship"], "de": ["und", "der", "schön", "über", "zeit"]}
    rows = [(i, " ".join(rng.choice(words[lang], 30)), lang, "s") for i in range(160) for lang in [["en", "de"][i % 2]]]
    odd = [(900, None, "en", "s"), (901, "", "de", "s"), (902, "123 !?", None, "s"), (903, "the thing", None, "s"), (903, "the thing", None, "s"), (None, "und der", "de", "s")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    out = langid.identify(df).collect()
    assert len(out) == len(rows) + len(odd)
    by = {r.doc_id: r for r in out}
    assert [by[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    held = [(i, lang) for i, _, lang, _ in rows if by[i].held_out]
    assert held and all(by[i].lang_pred == lang for i, lang in held)
    assert all(0 <= r.score <= 1 for r in out)
    assert langid.identify(df.limit(0)).count() == 0
