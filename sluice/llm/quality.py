"""Quality classifier: random-indexing word vectors pooled per document, then a
two-layer network with temperature-calibrated probabilities.

A unit is a word of white-space-split text: itself where it is frequent in the
sample, else its form (runs of lower-case letters, upper-case letters and digits
stand for one sign each, repeated signs for one), and AGAIN where it repeats the
word before it. Every unit has a sparse random index vector; its word vector is
that plus the direction of the index vectors met around it. A document's vector is
the mean over all its words, so whole texts count whatever their length.

The classifier is fitted on a bounded sample of labelled rows (SAMPLE, chosen by a
hash of the id); scoring covers all rows and is map-only. Null and empty texts have
the zero vector and so a score. Labels that contradict each other for an id count
as the lower one, null labels don't count; without labels every score is 0.5.
Repeated rows get equal results, an empty table gives an empty result, further
columns are ignored.
"""

from __future__ import annotations

import gc
import operator
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import slices

SAMPLE = 2500
DIM = 64
NONZERO = 4
REACH = 2
HIDDEN = 24
STEPS = 400
FREQUENT = 1200
FORMS = 600
CACHE_WORDS = 200_000
THRESHOLD = 0.3
OTHER, AGAIN = 0, 1

SAME = re.compile(r"(.)\1+", re.DOTALL)


class _Signs(dict):
    """Code points to the sign of their kind; others stay."""

    def __missing__(self, point: int) -> int:
        kind = unicodedata.category(chr(point))
        self[point] = sign = ord({"Ll": "a", "Lo": "a", "Lu": "A", "Nd": "0", "Nl": "0", "No": "0"}.get(kind, chr(point)))
        return sign


SIGNS = _Signs()


def form(word: str) -> str:
    return SAME.sub(r"\1", word.translate(SIGNS))


def index_vector(unit: str) -> np.ndarray:
    rng = np.random.default_rng(zlib.crc32(unit.encode()))
    v = np.zeros(DIM, np.float32)
    v[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return v / np.sqrt(NONZERO)


class Units:
    """Numbers of units: OTHER, AGAIN, then frequent words and forms."""

    def __init__(self, names: list[str]):
        self.names = names  # words are marked w, forms f
        self.number = {n: i for i, n in enumerate(names)}
        self.known: dict[str, int] = {}

    def of(self, text: str) -> np.ndarray:
        words = text.split()
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                number = self.number
                known[w] = number.get(f"w{w}") or number.get(f"f{form(w)}", OTHER)
        ids = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        if len(words) > 1:
            ids[1:][np.fromiter(map(operator.eq, words[1:], words), bool, len(words) - 1)] = AGAIN
        return ids


def word_vectors(units: Units, ids: list[np.ndarray]) -> np.ndarray:
    index = np.stack([index_vector(n) for n in units.names])
    n = len(index)
    met = np.zeros(n * n)
    flat = np.concatenate([np.concatenate([x, np.full(REACH, -1, np.int32)]) for x in ids]).astype(np.int64)
    for d in range(1, REACH + 1):
        left, right = flat[:-d], flat[d:]
        inside = (left >= 0) & (right >= 0)
        met += np.bincount(left[inside] * n + right[inside], minlength=n * n)
    met = met.reshape(n, n)
    context = ((met + met.T) @ index).astype(np.float32)
    return index + context / np.maximum(1e-9, np.linalg.norm(context, axis=1, keepdims=True))


class Model:
    def __init__(self, texts: list[str], labels: list[int], seed: int = 3):
        words, forms = Counter(), Counter()
        for t in texts:
            words.update({*t.split()})
        for w, n in words.items():
            forms[form(w)] += n
        keep = lambda c, n, mark, least: [mark + x for x, k in sorted(c.items(), key=lambda y: (-y[1], y[0]))[:n] if k >= least]
        self.units = Units(["other", "again", *keep(words, FREQUENT, "w", 20), *keep(forms, FORMS, "f", 3)])
        ids = [self.units.of(t) for t in texts]
        self.vectors = word_vectors(self.units, ids)
        x, y = self.pooled(ids), np.array(labels, np.float32)
        rng = np.random.default_rng(seed)
        part = rng.random(len(y)) < 0.2
        if part.all() or not part.any():
            part[:] = False
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self._train(x[~part], y[~part], rng)
        self.temperature = 1.0
        if part.any():
            logits = self.logits(x[part])
            grid = np.geomspace(1, 10, 40)
            losses = [np.logaddexp(0, -logits / t * (2 * y[part] - 1)).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(losses))])

    def pooled(self, ids: list[np.ndarray]) -> np.ndarray:
        """Mean word vectors, by counts of units."""
        n = len(self.vectors)
        out = np.zeros((len(ids), DIM), np.float32)
        for i in range(0, len(ids), 256):
            block = ids[i : i + 256]
            size = np.array([len(x) for x in block])
            row = np.repeat(np.arange(len(block)), size)
            counts = np.bincount(row * n + np.concatenate(block), minlength=len(block) * n).reshape(len(block), n)
            out[i : i + 256] = (counts.astype(np.float32) @ self.vectors) / np.maximum(1, size)[:, None]
        return out

    def _train(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        x = (x - self.mean) / self.scale
        p = [rng.normal(size=(DIM, HIDDEN)) / 8, np.zeros(HIDDEN), rng.normal(size=HIDDEN) / 5, np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for step in range(1, STEPS + 1):
            h = np.tanh(x @ p[0] + p[1])
            d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y) / len(y)
            back = np.outer(d, p[2]) * (1 - h * h)
            grads = [x.T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True)]
            for i, g in enumerate(grads):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.01 * (g * g - v[i])
                p[i] -= 0.02 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        self.layers = p

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        w, b, u, c = self.layers
        return np.tanh((pooled - self.mean) / self.scale @ w + b) @ u + c

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = self.logits(self.pooled([self.units.of(t or "") for t in texts])) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out=None) -> Model | None:
    """Learns from labelled rows that held_out (a Column over the labels) doesn't mark."""
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if held_out is not None:
        usable = usable.filter(~held_out)
    chosen = usable.groupBy(F.col(id_col).alias("_i")).agg(F.min(label_col).alias("_y")).orderBy(F.xxhash64(F.col("_i").cast("string"), F.lit(5)), "_i").limit(SAMPLE)
    rows = docs.select(F.col(id_col).alias("_i"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).join(F.broadcast(chosen), "_i")
    rows = rows.groupBy("_i", "_y").agg(F.min("_t").alias("_t")).collect()  # one of the rows that repeat an id
    rows.sort(key=lambda r: (r["_i"], r["_t"]))
    return Model([r["_t"] for r in rows], [r["_y"] for r in rows]) if rows else None


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score and predicted to the id and the carried columns."""
    columns = [id_col, *(carry or [])]
    read = columns if text_col in columns else [*columns, text_col]  # a carried text travels once
    at = read.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the cache holds many small objects and no cycles
        net = sent.value
        try:
            for batch in slices(batches):
                texts = batch.column(at).to_pylist()
                found = np.concatenate([net.scores(texts[i : i + 256]) if net else np.full(len(texts[i : i + 256]), 0.5) for i in range(0, len(texts), 256)])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], names=[*columns, "score", "predicted"])
        finally:  # the worker goes on to other tasks
            if net:
                net.units.known.clear()
            gc.enable()

    schema = docs.select(*columns).schema.add("score", "double").add("predicted", "integer")
    return docs.select(*read).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per document: id, held_out (crc32 of the id's text mod 5 is 0; never learnt
    from), score, predicted."""
    out = F.crc32(F.col(id_col).cast("string")) % 5 == 0
    model = fit(docs, labels, id_col, text_col, label_col, out)
    return score(docs.select(F.col(id_col), F.col(text_col), F.coalesce(out, F.lit(False)).alias("held_out")), model, id_col, text_col, ["held_out"])
