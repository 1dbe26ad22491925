"""Personal data: exact patterns, and a bidirectional LSTM with a CRF over characters.

The base spans come from fixed patterns, each in linear time. They label the windows that
the network is trained on, in numpy by backpropagation through time: a bidirectional LSTM scores
the nine tags (begin and inside of four kinds, outside) of every character, and a linear
chain with tag transitions is fitted by its likelihood. So that the network learns the kinds and
not the patterns, each labelled span also appears in other spellings (masked marks, other
separators, no country code), and numbers that are no personal data appear as they are.

Every whole text is read. The network runs on the stretches within REACH of a trigger
(a digit, `@`, or a bracketed `at`), which every span it may add has to hold. A stretch is cut into
overlapping windows; the windows' scores are averaged, the more central counting more, and
one Viterbi pass over the whole stretch decides, so that no span ends where a window does. A
decoded span is added where it holds what its kind must (`holds`) and meets no base span.
Base spans always stay.

Training takes at most SAMPLE documents with a trigger, chosen by a hash, and EACH windows
of each. A null text is empty. Without any base span in the sample nothing is added.
An empty table gives an empty result; repeated rows get equal results; further columns
are ignored, whatever their names. Time and memory grow with a text's length; a task holds one
batch of texts and the scores of GROUP characters and one stretch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base; the local part of an e-mail is read leftwards from its `@`.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[\[({] ?at ?[\])}]")

SAMPLE, EACH = 600, 6
REACH, WINDOW, STRIDE = 40, 64, 32
HIDDEN, STEPS, BATCH, RATE = 16, 300, 64, 0.015
GROUP = 1 << 17
#: Inputs: 0 outside the text, 1-127 ASCII, then letters and all else beyond it.
SYMBOLS, LETTER, OTHER = 130, 128, 129
TAGS = 1 + 2 * len(KINDS)  # 0 outside, 2k+1 begin, 2k+2 inside

Span = tuple[str, int, int]


def _digits(text: str) -> str:
    return "".join(re.findall("[0-9]", text))


def luhn(digits: str) -> bool:
    values = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Where the pattern `[A-Za-z0-9._%+-]+@` and a domain match, without its retries."""
    free = 0
    at = text.find("@")
    while at >= 0:
        found = DOMAIN.match(text, at + 1)
        if found:
            begin = at
            while begin > free and (text[begin - 1].isascii() and text[begin - 1].isalnum() or text[begin - 1] in "._%+-"):
                begin -= 1
            if begin < at:
                yield begin, found.end()
                free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start; positions are code points."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def holds(kind: str, text: str) -> bool:
    """Whether a span that the network gives holds what its kind must."""
    digits = _digits(text)
    if kind == "email":
        return bool(re.search(r"\w.{0,3}(@|[\[({] ?at ?[\])}]).{0,3}\w.*(\.|dot).*\w", text, re.S)) and len(text) <= 100
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search("[A-Za-z]{4}", text)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits) and not re.search("[A-Za-z]", text)
    return 9 <= len(digits) <= 15 and len(text) <= 2 * len(digits) and not re.search("[A-Za-z]", text)


def symbols(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.where(code < 128, np.maximum(code, 1), OTHER).astype(np.uint8)
    for i in np.flatnonzero(code >= 128).tolist():
        if text[i].isalpha():
            out[i] = LETTER
    return out


def tags_of(spans: list[Span], length: int) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, a, b in reversed(spans):  # the first kind of those that overlap stands
        k = KINDS.index(kind)
        out[a:b] = 2 * k + 2
        out[a] = 2 * k + 1
    return out


# The network. Arrays are (features, batch) for each step.


def allowed() -> tuple[np.ndarray, np.ndarray]:
    """Transitions (before, after) and first tags that may be: an inside follows its own kind."""
    ok = np.ones((TAGS, TAGS), bool)
    first = np.ones(TAGS, bool)
    for k in range(len(KINDS)):
        first[2 * k + 2] = False
        ok[:, 2 * k + 2] = False
        ok[[2 * k + 1, 2 * k + 2], 2 * k + 2] = True
    return ok, first


def initial(seed: int = 3, hidden: int = HIDDEN, dtype=np.float32) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"E{d}"] = 0.3 * rng.normal(size=(4 * hidden, SYMBOLS))
        p[f"E{d}"][hidden : 2 * hidden] += 1  # gates start open to the past
        p[f"U{d}"] = rng.normal(size=(4 * hidden, hidden)) / np.sqrt(hidden)
        p[f"V{d}"] = rng.normal(size=(TAGS, hidden)) / np.sqrt(hidden)
    p["c"], p["T"] = np.zeros((TAGS, 1)), np.zeros((TAGS, TAGS))
    return {k: v.astype(dtype) for k, v in p.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def lstm_forward(E: np.ndarray, U: np.ndarray, x: np.ndarray, keep: list | None) -> np.ndarray:
    """States after each row of x (time, windows); keep gets what the backward pass needs."""
    H = U.shape[1]
    h = np.zeros((H, x.shape[1]), U.dtype)
    c = h
    states = np.empty((len(x), *h.shape), U.dtype)
    for t, row in enumerate(x):
        a = E[:, row] + U @ h
        i, f, o = sigmoid(a[:H]), sigmoid(a[H : 2 * H]), sigmoid(a[3 * H :])
        g = np.tanh(a[2 * H : 3 * H])
        before, c = c, f * c + i * g
        s = np.tanh(c)
        if keep is not None:
            keep.append((h, before, i, f, g, o, s))
        h = o * s
        states[t] = h
    return states


def lstm_backward(U: np.ndarray, x: np.ndarray, keep: list, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dE, dU = np.zeros((SYMBOLS, U.shape[0]), U.dtype), np.zeros_like(U)
    dh, dc = np.zeros_like(down[0]), np.zeros_like(down[0])
    for t in range(len(keep) - 1, -1, -1):
        h, before, i, f, g, o, s = keep[t]
        dh = dh + down[t]
        dc = dc + dh * o * (1 - s * s)
        into = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dc * i * (1 - g * g), dh * s * o * (1 - o)])
        dU += into @ h.T
        np.add.at(dE, x[t], into.T)
        dh, dc = U.T @ into, dc * f
    return dE.T, dU


def scores(p: dict[str, np.ndarray], x: np.ndarray, keep_f: list | None = None, keep_b: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tag scores (time, tags, windows) and both directions' states."""
    hf = lstm_forward(p["Ef"], p["Uf"], x, keep_f)
    hb = lstm_forward(p["Eb"], p["Ub"], x[::-1], keep_b)[::-1]
    return p["Vf"] @ hf + p["Vb"] @ hb + p["c"], hf, hb


def chain(emit: np.ndarray, trans: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of tags (time, windows) under the chain, and its gradients by
    the scores and the transitions: expected less given."""
    T, K, B = emit.shape
    ok, first = allowed()
    move = np.where(ok, np.exp(trans), 0).astype(emit.dtype)
    top = emit.max(1, keepdims=True)
    e = np.exp(emit - top)
    alpha, scale = np.empty_like(emit), np.empty((T, 1, B), emit.dtype)
    for t in range(T):
        a = e[t] * (first[:, None] if t == 0 else move.T @ alpha[t - 1])
        scale[t] = a.sum(0)
        alpha[t] = a / scale[t]
    beta = np.ones((K, B), emit.dtype)
    d = np.empty_like(emit)
    pairs = np.zeros_like(move)
    for t in range(T - 1, -1, -1):
        d[t] = alpha[t] * beta
        if t:
            right = e[t] * beta / scale[t]
            pairs += alpha[t - 1] @ right.T
            beta = move @ right
    d_trans = pairs * move
    at, w = np.arange(T)[:, None], np.arange(B)[None, :]
    d[at, tags, w] -= 1
    np.add.at(d_trans, (tags[:-1].ravel(), tags[1:].ravel()), -1)
    gold = emit[at, tags, w].sum() + trans[tags[:-1], tags[1:]].sum()
    loss = np.log(scale).sum() + top.sum() - gold
    return float(loss) / B, d / B, np.where(ok, d_trans, 0) / B


def gradients(p: dict[str, np.ndarray], x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    kept_f, kept_b = [], []
    emit, hf, hb = scores(p, x, kept_f, kept_b)
    loss, d, d_trans = chain(emit, p["T"], tags)
    g = {"Vf": np.einsum("tkb,thb->kh", d, hf), "Vb": np.einsum("tkb,thb->kh", d, hb), "c": d.sum((0, 2))[:, None], "T": d_trans}
    g["Ef"], g["Uf"] = lstm_backward(p["Uf"], x, kept_f, p["Vf"].T @ d)
    g["Eb"], g["Ub"] = lstm_backward(p["Ub"], x[::-1], kept_b, (p["Vb"].T @ d)[::-1])
    return loss, g


def respelt(kind: str, text: str, rng: np.random.Generator) -> str:
    """The same datum as people write it to be read by people only."""
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    if kind == "email":
        dot = pick(".", " . ", "[.]", " dot ", "(dot)", "[dot]")
        name, _, domain = text.partition("@")
        return name + pick(" @ ", "@", "(at)", "[at]", " (at) ", " [at] ", "{at}") + domain.replace(".", dot)
    if kind == "ip":
        return text.replace(".", pick("[.]", "(.)", " . ", "[dot]", ",", "-"))
    digits = _digits(text)
    if kind == "card":
        mark = pick(".", "/", "_", "  ", " - ", "–", "\t")
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    own = digits[-10:]
    a, b, c = own[:-7], own[-7:-4], own[-4:]
    return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{digits[:-10] or 1} {a} {b} {c}", f"{a}/{b}{c}", f"({a}){b}-{c}")


def harmless(rng: np.random.Generator) -> str:
    """A number that is no personal data."""
    n = lambda a, b: int(rng.integers(a, b))
    return [
        f"{n(1990, 2040)}-{n(1, 13):02d}-{n(1, 29):02d}", f"{n(0, 24)}:{n(0, 60):02d}", f"{n(1, 20)}.{n(0, 20)}.{n(0, 50)}", f"{n(0, 10)}.{n(0, 10)}", f"{n(1, 999)},{n(0, 1000):03d}.{n(0, 100):02d}",
        f"{n(1, 29)}/{n(1, 13)}/{n(1990, 2040)}", f"{n(1, 10**7)}", f"{n(1, 100)} %", f"no. {n(1, 10**5)}", f"{n(1, 99)} x {n(1, 99)}", f"§ {n(1, 400)}", "%x" % n(1 << 40, 1 << 62), f"{n(10, 99)}-{n(10, 99)}",
        f"@{'abcdefgh'[: n(3, 8)]}", f"{n(10**8, 10**9)}{n(10**11, 10**12)}", f"{n(1990, 2030)}-{n(1990, 2030)}", f"{n(1, 1000)} @ {n(1, 50)}.{n(10, 99)}", f"[{n(1, 100)}]",
    ][n(0, 18)]


Piece = tuple[str, list[Span]]


def pieces_of(text: str) -> list[Piece]:
    """Up to EACH pieces of a text, evenly spread, around its spans or else its triggers."""
    spans = base_spans(text)
    around = [(a, b) for _, a, b in spans] or [m.span() for m in TRIGGER.finditer(text)]
    around = [around[i] for i in sorted({int(j) for j in np.linspace(0, len(around) - 1, EACH)})] if around else []
    out = []
    for a, b in around:
        a, b = max(0, a - WINDOW), min(b, a + 2 * WINDOW) + WINDOW
        # a span that the piece cuts would teach a wrong end
        near = [(k, x, y) for k, x, y in spans if y > a and x < b]
        a, b = max([a, *[y for _, x, y in near if x < a]]), min([b, *[x for _, x, y in near if y > b]])
        out.append((text[a:b], [(k, x - a, y - a) for k, x, y in near if a <= x and y <= b]))
    return out


def changed(piece: Piece, rng: np.random.Generator) -> Piece:
    """A piece with spans respelt, and at times a harmless number in a space."""
    text, spans = piece
    out, found, last = [], [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < last:
            continue
        out.append(text[last:a])
        own = text[a:b] if rng.random() < 0.4 else respelt(kind, text[a:b], rng)
        start = sum(map(len, out))
        out.append(own)
        found.append((kind, start, start + len(own)))
        last = b
    whole = "".join([*out, text[last:]])
    gaps = [i for i, c in enumerate(whole) if c == " " and not any(a <= i < b for _, a, b in found)]
    if gaps and rng.random() < 0.6:
        i = gaps[int(rng.integers(len(gaps)))]
        more = " " + harmless(rng)
        whole = whole[:i] + more + whole[i:]
        found = [(k, a + len(more) * (a > i), b + len(more) * (a > i)) for k, a, b in found]
    return whole, found


def train(pieces: list[Piece], seed: int = 3, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Adam on the chain's likelihood; each batch draws the kinds evenly, and pieces without any."""
    rng = np.random.default_rng(seed)
    groups = [[p for p in pieces if any(s[0] == kind for s in p[1])] for kind in KINDS] + [[p for p in pieces if not p[1]]]
    groups = [g for g in groups if g]
    p = initial(seed)
    m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        x, y = np.zeros((BATCH, WINDOW), np.uint8), np.zeros((BATCH, WINDOW), np.int64)
        for row in range(BATCH):
            group = groups[row % len(groups)]
            text, spans = changed(group[int(rng.integers(len(group)))], rng)
            whole, tags = symbols(text), tags_of(spans, len(text))
            middle = spans[int(rng.integers(len(spans)))][1] if spans else int(rng.integers(len(text) or 1))
            a = max(0, min(middle - int(rng.integers(4, WINDOW // 2)), len(text) - WINDOW))
            while a < len(text) and a > 0 and tags[a] and tags[a] % 2 == 0:
                a -= 1  # a window may end within a span, not begin there
            part = slice(a, a + WINDOW)
            x[row, : len(whole[part])], y[row, : len(whole[part])] = whole[part], tags[part]
        _, g = gradients(p, x.T, y.T)
        size = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, w in g.items():
            w = w * min(1.0, 5 / (size + 1e-9))
            m[k] += 0.1 * (w - m[k])
            v[k] += 0.01 * (w * w - v[k])
            p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def viterbi(rows: list[np.ndarray], trans: np.ndarray) -> list[np.ndarray]:
    """Best tags of each score array (length, tags), all side by side, the longest first."""
    order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
    length = np.array([len(rows[i]) for i in order])
    ok, first = allowed()
    move = np.where(ok, trans, -1e9).T[:, :, None].astype(np.float32)  # after, before
    best = np.zeros((TAGS, len(rows)), np.float32)
    back, live = [], len(rows)
    for t in range(length[0] if len(rows) else 0):
        live = int((length > t).sum())
        here = np.stack([rows[i][t] for i in order[:live]], axis=1)
        if t == 0:
            best[:, :live] = here + np.where(first, 0, -1e9)[:, None]
            continue
        ways = move + best[None, :, :live]
        came = ways.argmax(1)
        back.append(came.astype(np.uint8))
        best[:, :live] = np.take_along_axis(ways, came[:, None], 1)[:, 0] + here
        best[:, :live] -= best[:, :live].max(0)
    out: list[np.ndarray] = [np.empty(0, np.uint8)] * len(rows)
    for at, i in enumerate(order):
        tags = np.empty(length[at], np.uint8)
        if len(tags):
            tags[-1] = best[:, at].argmax()
            for t in range(len(tags) - 1, 0, -1):
                tags[t - 1] = back[t - 1][tags[t], at]
        out[i] = tags
    return out


@dataclass
class Model:
    weights: dict[str, np.ndarray]

    def stretches(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of what lies within REACH of a trigger, joined where they meet."""
        out: list[tuple[int, int]] = []
        for m in TRIGGER.finditer(text):
            a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out

    def tag_scores(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """Scores of each part's characters, averaged over the windows that read them."""
        starts = [(i, a) for i, part in enumerate(parts) for a in (range(0, max(1, len(part) - STRIDE), STRIDE))]
        sums = [np.zeros((len(part) + WINDOW, TAGS), np.float32) for part in parts]
        weight = [np.zeros((len(part) + WINDOW, 1), np.float32) for part in parts]
        central = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
        for at in range(0, len(starts), 1024):
            some = starts[at : at + 1024]
            x = np.zeros((WINDOW, len(some)), np.uint8)
            for w, (i, a) in enumerate(some):
                piece = parts[i][a : a + WINDOW]
                x[: len(piece), w] = piece
            emit = scores(self.weights, x)[0]
            for w, (i, a) in enumerate(some):
                sums[i][a : a + WINDOW] += central * emit[:, :, w]
                weight[i][a : a + WINDOW] += central
        return [s[: len(p)] / w[: len(p)] for s, w, p in zip(sums, weight, parts, strict=True)]

    def decode(self, parts: list[np.ndarray]) -> list[list[Span]]:
        """Spans of each part by one best path over its whole length."""
        out = []
        for tags in viterbi(self.tag_scores(parts), self.weights["T"]):
            begins = np.flatnonzero(tags % 2 == 1)
            spans = []
            for a in begins.tolist():
                b = a + 1
                while b < len(tags) and tags[b] == tags[a] + 1:
                    b += 1
                spans.append((KINDS[(tags[a] - 1) // 2], a, b))
            out.append(spans)
        return out

    def added(self, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
        """What the network finds beside the base, by kind, then start."""
        out: list[list[Span]] = [[] for _ in texts]
        todo = [(i, a, b) for i, text in enumerate(texts) for a, b in self.stretches(text)]
        while todo:
            group, size = [], 0
            while todo and (not group or size + todo[-1][2] - todo[-1][1] < GROUP):
                group.append(todo.pop())
                size += group[-1][2] - group[-1][1]
            for (i, start, end), spans in zip(group, self.decode([symbols(texts[i][a:b]) for i, a, b in group]), strict=True):
                taken = [(a, b) for _, a, b in base[i] if b > start and a < end]
                for kind, a, b in spans:
                    a, b = a + start, b + start
                    while a < b and texts[i][a].isspace():
                        a += 1
                    while b > a and (texts[i][b - 1].isspace() or texts[i][b - 1] in ".,;:"):
                        b -= 1
                    if holds(kind, texts[i][a:b]) and not any(x < b and a < y for x, y in taken):
                        out[i].append((kind, a, b))
        return [sorted(found, key=lambda s: (KINDS.index(s[0]), s[1])) for found in out]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Learns from the base spans of a bounded sample of the documents with a trigger."""
    usable = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter(F.col("t").rlike("[0-9@]"))
    n = usable.count()
    if not n:
        return None
    place = F.pmod(F.xxhash64("t", F.lit(5)), F.lit(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [p for text in batch.column(0).to_pylist() for p in pieces_of(text)]
            spans = [",".join(f"{k}:{a}:{b}" for k, a, b in s) for _, s in found]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array(spans, pa.string())], names=["t", "s"])

    chosen = usable.filter(place < int((1 << 30) * min(1.0, SAMPLE / n))).select("t").distinct().orderBy(F.xxhash64("t", F.lit(5)), "t").limit(2 * SAMPLE)
    rows = sorted((r.t, r.s) for r in chosen.mapInArrow(run, "t string, s string").distinct().collect())
    pieces = [(t, [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in s.split(",") if x)]) for t, s in rows]
    return Model(train(pieces)) if any(s for _, s in pieces) else None


def find(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The id, the carried columns, and `base` and `added`: arrays of (kind, start, end), in code points."""
    columns = [id_col, *(carry or [])]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(len(columns)).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = net.added(texts, base) if net else [[] for _ in texts]
            lists = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in some], pa.list_(span)) for some in (base, more)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *lists], names=[*columns, "base", "added"])

    kind = ArrayType(StructType().add("kind", "string").add("start", "integer").add("end", "integer"))
    schema = docs.select(*columns).schema.add("base", kind).add("added", kind)
    return docs.select(*columns, text_col).mapInArrow(run, schema)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, number of base spans of each kind, base_sha256 and spans (all)."""
    found = find(docs, fit(docs, id_col, text_col), id_col, text_col)
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    order = F.transform(F.concat("base", "added"), lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.array_sort(order)).alias("spans"))
