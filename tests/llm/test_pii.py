"""Personal data: patterns against the plain ones, the network's gradients, what it adds."""

import hashlib
import random
import re

import numpy as np
import pytest

from sluice.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(d):
    total = 0
    for i, c in enumerate(d[::-1]):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and plain_luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


CARD = "4041894974608795"
TEXTS = [
    "a@b.c_d@e.f, x@y", "@a.b a@.b a@b. a@b.c. é@b.de aé@b.de", "a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 001.2.3.0255", f"{CARD} {CARD}", "4041-8949-7460-8795, 4041  8949 7460 8795",
    "+1 (988) 555-2485. +1 +49 30 1234567 4041894974608795", "+12345678 +1234567", "٣.٣.٣.٣ 1.2.3.4٣", "", "no data", f"x{CARD}y 12345678901234567890",
]


@pytest.mark.parametrize("text", TEXTS)
def test_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_random_texts():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("aZ09.1234@+-_ ()é,%7") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == plain(text), text


def test_time_grows_with_the_length():
    for piece in ("a", "1", "1.", "a@", "+1", "1 ", "a.b@c."):
        assert isinstance(pii.base_spans(piece * (1_000_000 // len(piece))), list)


def test_gradients():
    rng = np.random.default_rng(0)
    p = pii.initial(1, hidden=4, dtype=np.float64)
    p["T"] = rng.normal(size=p["T"].shape)
    x = rng.integers(0, pii.SYMBOLS, (7, 3)).astype(np.uint8)
    tags = np.array([pii.tags_of([("ip", 1, 4), ("card", 4, 6)], 7), pii.tags_of([], 7), pii.tags_of([("phone", 0, 7)], 7)]).T
    _, g = pii.gradients(p, x, tags)
    for k in p:
        for _ in range(5):
            at = tuple(int(rng.integers(n)) for n in p[k].shape)
            if k[0] == "E":
                at = (at[0], int(x[rng.integers(7), rng.integers(3)]))
            if k == "T" and not pii.allowed()[0][at]:
                continue
            was, sides = p[k][at], []
            for e in (1e-5, -1e-5):
                p[k][at] = was + e
                sides.append(pii.gradients(p, x, tags)[0])
            p[k][at] = was
            assert abs((sides[0] - sides[1]) / 2e-5 - g[k][at]) < 1e-6


def test_likelihood_and_best_path_of_all_paths():
    import itertools

    rng = np.random.default_rng(4)
    emit, trans = rng.normal(size=(4, pii.TAGS)), rng.normal(size=(pii.TAGS, pii.TAGS))
    ok, first = pii.allowed()
    paths = {}
    for path in itertools.product(range(pii.TAGS), repeat=4):
        if first[path[0]] and all(ok[a, b] for a, b in itertools.pairwise(path)):
            paths[path] = sum(emit[t, k] for t, k in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path))
    best = max(paths, key=paths.get)
    assert tuple(pii.viterbi([emit[:2], emit, emit[:0]], trans)[1]) == best
    loss, _, _ = pii.chain(emit[:, :, None], trans, np.array(best)[:, None])
    assert loss == pytest.approx(np.log(np.exp(list(paths.values())).sum()) - paths[best])


def labelled(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdeiklnorst") for _ in range(rng.randint(2, 7)))

    def card():
        digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(digits + c for c in "0123456789" if plain_luhn(digits + c))

    makers = [
        lambda: f"{word()}.{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.example.com", lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), card,
        lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
    ]
    return [" ".join([*(word() for _ in range(rng.randint(3, 20))), rng.choice(makers)(), *(word() for _ in range(rng.randint(3, 20)))]) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return pii.Model(pii.train([p for t in labelled(240) for p in pii.pieces_of(t)], steps=260))


def test_held_out_spellings(model):
    """What the patterns miss, and only that: other spellings, data that stand side by side."""
    rng = np.random.default_rng(8)
    found = given = false = 0
    for text in labelled(200, seed=77):
        for piece in pii.pieces_of(text):
            whole, spans = pii.changed(piece, rng)
            base = pii.base_spans(whole)
            got = {*base, *model.added([whole], [base])[0]}
            found, given, false = found + len(got & set(spans)), given + len(spans), false + len(got - set(spans))
    assert found >= 0.85 * given and false <= 0.03 * given


def test_base_stays_and_clean_texts_are_left_alone(model):
    texts = ["Version 2.0 of 2024-05-17, 12:30.", "Licensed under CC BY-NC 4.0.", "", "no number at all", *labelled(40, seed=5)]
    base = [pii.base_spans(t) for t in texts]
    added = model.added(texts, base)
    assert added[:4] == [[], [], [], []]
    for b, more in zip(base, added):
        assert not any(x < d and c < y for _, x, y in b for _, c, d in more)


def test_windows_do_not_cut(model):
    """A long stretch decodes as its parts do, wherever the windows fall."""
    unit = "call (988) 555-2485 or 456-555-2186 now, "
    text = unit * 40
    spans = model.added([text], [pii.base_spans(text)])[0]
    assert len(spans) >= 70 and {text[a:b] for _, a, b in spans} <= {"(988) 555-2485", "456-555-2186"}


def test_query_on_odd_rows(spark):
    texts = [*labelled(60, seed=3), None, "", "x@y.zz and x@y.zz", "9" * 30_000 + " a@b.cd"]
    rows = [(i, t, "en", 7) for i, t in enumerate(texts)] + [(0, texts[0], None, 1), (None, "a@b.cd", "de", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string, added int")
    found = pii.personal_data(df).collect()
    assert len(found) == len(rows)
    for r in found:
        text = "a@b.cd" if r.doc_id is None else texts[r.doc_id] or ""
        spans = [("email", 30_001, 30_007)] if len(text) > 30_000 else plain(text)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert {*line.split(",")} - {""} <= {*r.spans.split(",")}
    assert pii.personal_data(df.limit(0)).collect() == []
    none = pii.personal_data(df.filter("text = ''")).collect()
    assert [(r.n_email, r.base_sha256, r.spans) for r in none] == [(0, hashlib.sha256(b"").hexdigest(), "")]


def test_query_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    found = pii.personal_data(df).collect()
    assert len(found) == len(texts)
    for r in found:
        base = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
