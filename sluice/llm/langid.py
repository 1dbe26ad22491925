"""Language identification with a bidirectional gated recurrent network over bytes.

Every byte of a text is labelled: two recurrent layers, one in each direction, read
windows of WINDOW bytes that together cover the whole text, and a softmax over both
states gives each position's language probabilities. A document's probabilities are
the mean over its positions. The network is trained in numpy by backpropagation
through time.

Training takes a bounded sample of labelled rows (SAMPLE_PER_LANG expected rows of
each language, chosen by a hash of the id, whole texts); prediction covers all rows
and is map-only. A null text, or one without a letter, is `und` with score 0. With
nothing to learn from, every text is `und`. Repeated rows get equal results, an
empty table gives an empty result, further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import slices

WINDOW = 48
HIDDEN = 8
STEPS = 260
BATCH = 256
RATE = 0.02
SAMPLE_PER_LANG = 250
WIDE = 4096
GROUP_BYTES = 4 << 20
UNKNOWN = "und"


def _normal(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return (rng.normal(size=shape) / np.sqrt(shape[-1])).astype(np.float32)


def initial(n_langs: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Columns of E are byte inputs to the update, reset and candidate gates, U the
    recurrent weights; f and b are the two directions."""
    rng = np.random.default_rng(seed)
    p: dict[str, np.ndarray] = {}
    for d in "fb":
        p[f"E{d}"] = (0.3 * rng.normal(size=(3 * HIDDEN, 256))).astype(np.float32)
        p[f"U{d}"] = _normal(rng, 3 * HIDDEN, HIDDEN)
        p[f"V{d}"] = _normal(rng, n_langs, HIDDEN)
    p["c"] = np.zeros((n_langs, 1), np.float32)
    return p


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gru_forward(E: np.ndarray, U: np.ndarray, x: np.ndarray, keep: list) -> np.ndarray:
    """States after each row of x (time, windows); keep gets what the backward pass needs."""
    T, B = x.shape
    h = np.zeros((HIDDEN, B), np.float32)
    states = np.empty((T, HIDDEN, B), np.float32)
    for t in range(T):
        a, u = E[:, x[t]], U @ h
        gates = sigmoid(a[: 2 * HIDDEN] + u[: 2 * HIDDEN])
        z, r = gates[:HIDDEN], gates[HIDDEN:]
        un = u[2 * HIDDEN :]
        n = np.tanh(a[2 * HIDDEN :] + r * un)
        keep.append((h, z, r, n, un))
        h = n + z * (h - n)
        states[t] = h
    return states


def gru_backward(U: np.ndarray, x: np.ndarray, keep: list, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of E and U from those of the states, last step first."""
    dE, dU = np.zeros((256, 3 * HIDDEN), np.float32), np.zeros_like(U)
    dh = np.zeros_like(down[0])
    for t in range(len(keep) - 1, -1, -1):
        h, z, r, n, un = keep[t]
        dh = dh + down[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        into = np.concatenate([dz, dr, dn * r])
        dU += into @ h.T
        dh = dh * z + U.T @ into
        np.add.at(dE, x[t], np.concatenate([dz, dr, dn]).T)
    return dE.T, dU


def train(texts: list[bytes], langs: list[int], n_langs: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on cross entropy at every position; languages are drawn evenly."""
    rng = np.random.default_rng(seed)
    p = initial(n_langs, seed)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    by_lang = [[t for t, lang in zip(texts, langs, strict=True) if lang == k and t] for k in range(n_langs)]
    chances = [np.array([len(t) for t in ts], float) for ts in by_lang]
    chances = [np.minimum(c, 4000) / np.minimum(c, 4000).sum() for c in chances]
    for step in range(1, STEPS + 1):
        y = rng.integers(0, n_langs, BATCH)
        x = np.zeros((BATCH, WINDOW), np.int64)
        for i, k in enumerate(y):
            text = by_lang[k][rng.choice(len(by_lang[k]), p=chances[k])]
            at = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
            part = np.frombuffer(text, np.uint8, min(WINDOW, len(text)), at)
            x[i] = np.resize(part, WINDOW)
        x = x.T
        kept_f, kept_b = [], []
        hf = gru_forward(p["Ef"], p["Uf"], x, kept_f)
        hb = gru_forward(p["Eb"], p["Ub"], x[::-1], kept_b)[::-1]
        logits = p["Vf"] @ hf + p["Vb"] @ hb + p["c"]
        e = np.exp(logits - logits.max(1, keepdims=True))
        d = e / e.sum(1, keepdims=True)
        d[:, y, np.arange(BATCH)] -= 1
        d /= BATCH * WINDOW
        g = {"Vf": np.einsum("tkb,thb->kh", d, hf), "Vb": np.einsum("tkb,thb->kh", d, hb), "c": d.sum((0, 2))[:, None]}
        g["Ef"], g["Uf"] = gru_backward(p["Uf"], x, kept_f, p["Vf"].T @ d)
        g["Eb"], g["Ub"] = gru_backward(p["Ub"], x[::-1], kept_b, (p["Vb"].T @ d)[::-1])
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, x_k in g.items():
            m[k] += 0.1 * (x_k - m[k])
            v[k] += 0.01 * (x_k * x_k - v[k])
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return p


@dataclass
class Model:
    langs: list[str]
    weights: dict[str, np.ndarray]

    def __post_init__(self) -> None:
        # sigmoid(x) = tanh(x / 2) / 2 + 1/2: the halves go into the weights
        half = np.ones((3 * HIDDEN, 1), np.float32)
        half[: 2 * HIDDEN] = 0.5
        self.E = {d: np.ascontiguousarray(self.weights[f"E{d}"] * half) for d in "fb"}
        self.U = {d: np.ascontiguousarray(self.weights[f"U{d}"] * half) for d in "fb"}

    def _step(self, d: str, x: np.ndarray, h: np.ndarray, out: np.ndarray, a: np.ndarray, u: np.ndarray) -> None:
        np.take(self.E[d], x, axis=1, out=a, mode="clip")
        np.matmul(self.U[d], h, out=u)
        gates, n = a[: 2 * HIDDEN], a[2 * HIDDEN :]
        gates += u[: 2 * HIDDEN]
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        un = u[2 * HIDDEN :]
        un *= gates[HIDDEN:]
        n += un
        np.tanh(n, out=n)
        np.subtract(h, n, out=out)
        out *= gates[:HIDDEN]
        out += n

    def windows(self, x: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Sums of position probabilities (languages, windows); x and valid are
        (time, windows), states stay 0 where nothing has been read yet."""
        T, B = x.shape
        K = len(self.langs)
        hf = np.empty((T + 1, HIDDEN, B), np.float32)
        hf[0] = 0
        a, u = (np.empty((3 * HIDDEN, B), np.float32) for _ in range(2))
        for t in range(T):
            self._step("f", x[t], hf[t], hf[t + 1], a, u)
        h, spare = (np.zeros((HIDDEN, B), np.float32) for _ in range(2))
        total = np.zeros((K, B), np.float32)
        part = np.empty((K, B), np.float32)
        for t in range(T - 1, -1, -1):
            self._step("b", x[t], h, spare, a, u)
            h, spare = spare, h
            if not valid[t].all():
                h *= valid[t] != 0
            logits = self.weights["Vf"] @ hf[t + 1]
            np.matmul(self.weights["Vb"], h, out=part)
            logits += part
            logits += self.weights["c"]
            logits -= logits.max(0)
            np.exp(logits, out=logits)
            logits *= (valid[t] == 1) / logits.sum(0)
            total += logits
        return total

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages); rows of empty texts are 0."""
        size = np.array([len(t) for t in texts], np.int64)
        flat = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
        base = np.cumsum(size) - size
        count = -(-size // WINDOW)
        doc = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        # the last window of a text moves back so that it is full; what it reads again doesn't count
        start = np.minimum(nth * WINDOW, np.maximum(0, size[doc] - WINDOW))
        again = nth * WINDOW - start
        out = np.zeros((len(texts), len(self.langs)))
        offsets = np.arange(WINDOW)[:, None]
        for i in range(0, len(doc), WIDE):
            s = slice(i, i + WIDE)
            x = flat[(base[doc[s]] + start[s]) + offsets]
            inside = offsets < size[doc[s]]
            # 0: past the text's end, 2: read before, 1: counts
            sums = self.windows(x, np.where(inside, np.where(offsets < again[s], 2, 1), 0).astype(np.int8))
            for k in range(len(self.langs)):
                out[:, k] += np.bincount(doc[s], sums[k], len(texts))
        return out / np.maximum(1, size)[:, None]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out=None) -> Model | None:
    """Learns from rows with text and lang that held_out (a Column) doesn't mark."""
    usable = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"), (F.lit(False) if held_out is None else held_out).alias("out"))
    usable = usable.filter(F.col("l").isNotNull() & F.col("t").rlike("\\p{L}") & ~F.coalesce("out", F.lit(False)))
    counts = {r.l: r.n for r in usable.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    place = F.pmod(F.xxhash64(F.coalesce(F.col("i").cast("string"), F.col("t")), F.lit(11)), F.lit(1 << 30))
    limit = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int((1 << 30) * min(1.0, SAMPLE_PER_LANG / n)))])
    # one row of each id and language, or of each text without an id: repeated rows can't swell the sample
    known = usable.filter(place < F.element_at(limit, F.col("l"))).groupBy("l", "i", F.when(F.col("i").isNull(), F.col("t"))).agg(F.min("t").alias("t"))
    rows = known.select("i", "t", "l").collect()
    rows.sort(key=lambda r: (r.l, str(r.i), r.t))
    langs = sorted({r.l for r in rows})
    if not langs:
        return None
    return Model(langs, train([r.t.encode() for r in rows], [langs.index(r.l) for r in rows], len(langs)))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score to the id and the carried columns."""
    columns = [id_col, *(carry or [])]
    read = columns if text_col in columns else [*columns, text_col]  # a carried text travels once
    at = read.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            todo = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if net else []
            while todo:
                group, size = [], 0
                while todo and size < GROUP_BYTES:
                    group.append(todo.pop())
                    size += len(texts[group[-1]])
                probs = net.probabilities([texts[i].encode() for i in group])
                for i, k, p in zip(group, probs.argmax(1).tolist(), probs.max(1).tolist(), strict=True):
                    lang[i], score[i] = net.langs[k], min(1.0, p)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*columns, "lang_pred", "score"])

    schema = docs.select(*columns).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*read).mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: id, held_out (crc32 of the id's text mod 5 is 0; never learnt
    from), lang_pred, score."""
    out = F.crc32(F.col(id_col).cast("string")) % 5 == 0
    model = fit(docs, id_col, text_col, lang_col, out)
    return predict(docs.select(F.col(id_col), F.col(text_col), F.coalesce(out, F.lit(False)).alias("held_out")), model, id_col, text_col, ["held_out"])
