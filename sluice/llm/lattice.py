"""Language-model scores from a subword lattice.

The vocabulary is that of a public tokenizer, never trained here. A word (white-space
split, A-Z lower-cased) is a lattice over the bytes of the vocabulary's word start and
the word: every piece that fits is an edge, single bytes always do. The scores that
the vocabulary holds give the first weight of each piece, falling with its rank; ROUNDS
rounds of expectation and maximisation over all training documents then fit the piece
probabilities: every distinct word adds the expected counts of its pieces, weighted by
how often it occurs. A forward recursion in log space gives the marginal probability of
a word over all its segmentations, and a text's is the product over its words and one
end, which is the end piece. Probabilities of pieces and the end sum to one.

Words are counted in the tasks, then by a shuffle; what is gathered grows with the
corpus. Counts and log probabilities of the FREQUENT commonest words go to the tasks
as a bounded table; all other words of a document are looked up by a join, so every
word has its exact count.

Null texts are empty: only their end is scored. Rows with repeated or null ids count
each for itself (a null id is training). Without training rows all counts are 0 and
the weights stay the vocabulary's. An empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import gc
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import released, written
from sluice.llm.suffix import Hashes

FREQUENT = 200_000
ROUNDS = 3
FLUSH = 400_000
BLOCK = 1 << 13
SMOOTH = 0.05
START = "▁".encode()
NOTHING = -np.inf


@dataclass
class Pieces:
    """Byte strings of the vocabulary, found by length and hash."""

    names: list[bytes]
    first: np.ndarray  # weights from the vocabulary's scores, unnormalised
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        by_length: dict[int, list[int]] = {}
        for i, name in enumerate(self.names):
            by_length.setdefault(len(name), []).append(i)
        for n, ids in sorted(by_length.items()):
            flat = np.frombuffer(b"".join([self.names[i] for i in ids]), np.uint8)
            h = Hashes(flat).of(np.arange(len(ids)) * n, n)
            order = np.argsort(h)
            self.tables[n] = h[order], np.array(ids, np.int32)[order]
        for h, _ in self.tables.values():  # pieces are told apart by their hashes alone
            assert len(np.unique(h)) == len(h)
        self.quick = {}
        for n, (h, ids) in self.tables.items():
            bits = max(6, int(np.ceil(np.log2(len(h) * 4))))
            table = np.full(1 << bits, -1, np.int32)
            slot = self._slot(h, bits)
            crowded = np.bincount(slot, minlength=1 << bits) > 1
            table[slot] = np.arange(len(h), dtype=np.int32)
            table[crowded] = -2
            self.quick[n] = bits, table

    @staticmethod
    def _slot(h: np.ndarray, bits: int) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, h: np.ndarray, n: int) -> np.ndarray:
        """Piece of length n with each hash, -1 for none."""
        hashes, ids = self.tables[n]
        bits, table = self.quick[n]
        at = table[self._slot(h, bits)]
        crowded = np.flatnonzero(at == -2)
        at[crowded] = np.minimum(np.searchsorted(hashes, h[crowded]), len(hashes) - 1)
        return np.where((at >= 0) & (hashes[at] == h), ids[at], -1)


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """Pieces of a sentencepiece model that lower-cased words can hold, and bytes. The
    model's scores fall with the rank; byte pieces have none and count as the last."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    score: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        raw = piece.encode()
        if model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or START in raw[1:] or any("A" <= c <= "Z" for c in piece):
            continue
        score[raw] = max(score.get(raw, NOTHING), model.get_score(i))
    last = -float(model.get_piece_size())
    for b in range(256):
        score.setdefault(bytes([b]), last)
    names = sorted(score)
    return Pieces(names, 1.0 / (10.0 - np.array([score[n] for n in names])))


def weights(pieces: Pieces, counts: np.ndarray | None = None, ends: float = 1.0) -> np.ndarray:
    """Log probabilities of the pieces, the end's last."""
    first = pieces.first / pieces.first.sum()
    if counts is None:
        mass = np.append(first * 0.75, 0.25)
    else:
        mass = np.append(counts + SMOOTH * len(first) * first, ends + SMOOTH)
    return np.log(mass / mass.sum())


class Lattice:
    """Lattices of a block of words of about one length, side by side: node j of all
    words at once."""

    def __init__(self, pieces: Pieces, words: list[bytes]):
        raw = [START + w for w in words]
        self.size = np.array([len(r) for r in raw], np.int64)
        self.width = int(self.size.max())
        pitch = self.width + max(pieces.tables)
        data = np.frombuffer(b"".join([r.ljust(pitch, b"\0") for r in raw]), np.uint8)
        hashes = Hashes(data)
        base = np.arange(len(raw), dtype=np.int64)[:, None] * pitch
        self.edges: list[tuple[int, np.ndarray]] = []  # length, piece that ends at each node (nodes, words)
        for n in pieces.tables:
            if n > self.width:
                continue
            start = base + np.arange(self.width - n + 1)
            found = pieces.find(hashes.of(start.ravel(), n), n).reshape(start.shape)
            found[np.arange(self.width - n + 1) + n > self.size[:, None]] = -1
            if (found >= 0).any():
                self.edges.append((n, np.ascontiguousarray(found.T)))

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """Log marginal of every prefix (nodes, words)."""
        total = np.full((self.width + 1, len(self.size)), NOTHING)
        total[0] = 0
        with np.errstate(invalid="ignore", divide="ignore"):
            for j in range(1, self.width + 1):
                terms = [total[j - n] + np.where((p := found[j - n]) >= 0, logs[p], NOTHING) for n, found in self.edges if n <= j]
                if terms:
                    stack = np.stack(terms)
                    top = stack.max(0)
                    safe = np.where(np.isfinite(top), top, 0)
                    total[j] = safe + np.log(np.exp(stack - safe).sum(0))
        return total

    def marginal(self, logs: np.ndarray) -> np.ndarray:
        return self.forward(logs)[self.size, np.arange(len(self.size))]

    def expected(self, logs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected counts of pieces over all segmentations of the words."""
        ahead = self.forward(logs)
        each = np.arange(len(self.size))
        whole = ahead[self.size, each]
        behind = np.full_like(ahead, NOTHING)
        behind[self.size, each] = 0
        counts = np.zeros(len(logs) - 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            for j in range(self.width - 1, -1, -1):
                terms, owners = [behind[j]], []
                for n, found in self.edges:
                    if j + n <= self.width:
                        p = found[j]
                        term = behind[j + n] + np.where(p >= 0, logs[p], NOTHING)
                        terms.append(term)
                        owners.append((p, term))
                stack = np.stack(terms)
                top = stack.max(0)
                safe = np.where(np.isfinite(top), top, 0)
                behind[j] = safe + np.log(np.exp(stack - safe).sum(0))
                for p, term in owners:
                    share = np.exp(ahead[j] + term - whole) * times
                    there = np.flatnonzero((p >= 0) & (share > 0))
                    counts += np.bincount(p[there], share[there], len(counts))
        return counts


def blocks(words: list[bytes]) -> Iterator[np.ndarray]:
    """Numbers of words of about one length. Very long words come one at a time."""
    size = np.array([len(w) for w in words], np.int64)
    order = np.argsort(size, kind="stable")
    i = 0
    while i < len(order):
        n = size[order[i]]
        most = max(1, min(BLOCK, (1 << 18) // (int(n) + 24)))
        j = min(len(order), i + most)
        j = i + int(np.searchsorted(size[order[i:j]], n + 4, side="right"))
        yield order[i:j]
        i = j


def log_probabilities(pieces: Pieces, logs: np.ndarray, words: list[bytes]) -> np.ndarray:
    out = np.zeros(len(words))
    for part in blocks(words):
        out[part] = Lattice(pieces, [words[i] for i in part]).marginal(logs)
    return out


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def count_words(docs: DataFrame, text_col: str, train: Column) -> DataFrame:
    """(word, c, n): occurrences in training documents and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        counts = Counter(), Counter()
        for batch in batches:
            for text, learn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[bool(learn)].update(words_of(text))
            if len(counts[0]) + len(counts[1]) > FLUSH:
                yield _batch(*counts)
                counts = Counter(), Counter()
        yield _batch(*counts)

    def _batch(other: Counter, own: Counter) -> pa.RecordBatch:
        words = [*other.keys() | own.keys()]
        c = [own[w] for w in words]
        return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()), "c": pa.array(c, pa.int64()), "n": pa.array([other[w] + k for w, k in zip(words, c, strict=True)], pa.int64())})

    partial = docs.select(text_col, train.alias("_train")).mapInArrow(run, "word binary, c long, n long")
    return partial.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fit(words: DataFrame, path: str, rounds: int = ROUNDS, ends: int = 0) -> np.ndarray:
    """Expectation and maximisation over the distinct training words. Only expected
    counts of the vocabulary's pieces come to the driver."""
    spark = words.sparkSession
    logs = weights(load(path))
    for _ in range(rounds if ends else 0):
        sent = spark.sparkContext.broadcast(logs)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            pieces = load(path)
            counts = np.zeros(len(pieces.names))
            for batch in batches:
                raw, times = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                for part in blocks(raw):
                    counts += Lattice(pieces, [raw[i] for i in part]).expected(sent.value, times[part].astype(float))
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["piece", "much"])

        rows = words.filter("c > 0").select("word", "c").mapInArrow(run, "piece long, much double").groupBy("piece").agg(F.sum("much").alias("much")).collect()
        counts = np.zeros(len(logs) - 1)
        for r in rows:
            counts[r.piece] = r.much
        logs = weights(load(path), counts, ends)
    return logs


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _looked_up(packed: bytes, bound: float) -> dict[bytes, tuple[bool, float, float]]:
    """Of each word (word, c, lp) whether it is known, its base score and its log probability."""
    table = pa.ipc.open_stream(packed).read_all()
    c = table.column("c").to_numpy()
    return dict(zip(table.column("word").to_pylist(), zip((c > 0).tolist(), np.log10((c + 1.0) / bound).tolist(), table.column("lp").to_pylist(), strict=True), strict=True))


def score_documents(docs: DataFrame, path: str, modulus: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out (crc32 of the id's text mod modulus is held), n_tokens,
    n_known, train_tokens, base_score and score, both in log10."""
    out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == held, F.lit(False))
    rows = docs.select(F.col(id_col), F.col(text_col), out.alias("held_out"))
    counted = written(count_words(rows, text_col, ~F.col("held_out")), "counts")
    released(docs.sparkSession)
    known = F.col("c") > 0
    tokens, types = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(known)).first()
    ends = rows.filter(~F.col("held_out")).count()
    train_tokens, types = tokens + ends, types + (ends > 0)
    logs = fit(counted, path, ends=ends)
    spark = docs.sparkSession
    sent_logs = spark.sparkContext.broadcast(logs)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            found = log_probabilities(pieces, sent_logs.value, batch.column(0).to_pylist()) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=["word", "c", "n", "lp"])

    lexicon = written(counted.mapInArrow(mark, "word binary, c long, n long, lp double"), "lexicon")
    bound = float(train_tokens + types + 1)
    base = lambda c: np.log10((c + 1.0) / bound)
    top = lexicon.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow().combine_chunks()  # columns: a row object each takes several times the memory
    edge = (top.column("n")[-1].as_py(), top.column("word")[-1].as_py()) if len(top) == FREQUENT else None
    sent = spark.sparkContext.broadcast(_packed(top.select(["word", "c", "lp"])))
    del top
    end = (int(ends > 0), float(base(ends)), float(logs[-1] / np.log(10)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        table = _looked_up(sent.value, bound)
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                n_known, low, high = end
                rest: dict[bytes, int] = {}
                for w, n in Counter(words).items():
                    if (found := table.get(w)) is None:
                        rest[w] = n
                    else:
                        n_known += n * found[0]
                        low += n * found[1]
                        high += n * found[2]
                key += 1
                for column, value in zip(cols, (key, len(words) + 1, n_known, low, high, [*rest], [*rest.values()]), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[id_col, "held_out", *names])

    names = ["_key", "n_tokens", "n_known", "base_score", "score", "_words", "_times"]
    kind = docs.schema[id_col].dataType.simpleString()
    part = written(rows.mapInArrow(sums, f"`{id_col}` {kind}, held_out boolean, _key long, n_tokens long, n_known long, base_score double, score double, _words array<binary>, _times array<long>"), "sums")
    rare = part.select("_key", F.explode(F.arrays_zip("_words", "_times")).alias("w")).select("_key", F.col("w._words").alias("word"), F.col("w._times").alias("times"))
    less = lexicon if edge is None else lexicon.filter((F.col("n") < edge[0]) | ((F.col("n") == edge[0]) & (F.col("word") > F.lit(edge[1]))))
    c = F.col("c").cast("double")
    found = rare.join(less.select("word", "c", "lp"), "word").groupBy("_key").agg(
        F.sum(F.when(known, F.col("times")).otherwise(0)).alias("_known"), F.sum(F.col("times") * F.log10((c + 1.0) / F.lit(bound))).alias("_base"), F.sum(F.col("times") * F.col("lp")).alias("_score")
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return part.join(found, "_key", "left").select(
        id_col, "held_out", "n_tokens", (F.col("n_known") + zero("_known")).alias("n_known"), F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("_base")).alias("base_score"), (F.col("score") + zero("_score")).alias("score"),
    )
