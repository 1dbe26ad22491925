"""Packing of token sequences through the configuration linear program.

The program has one variable per configuration (a multiset of lengths that fits
the capacity) and one row per length of the histogram. Multiplicative weights
solve it: dynamic programming over the capacity prices configurations against the
weights of the lengths, every configuration within EPSILON of the best price gets
a share, and covered lengths lose weight. The solution is rounded so that its total
stays (each configuration gets its use rounded down, and one more whenever the parts
cut off so far make up a whole), and the program is solved again for the lengths that
the rounding left over, until no more than RESIDUE of all tokens are left (or it places
less than PLACED of them). Only that residue is filled by subset sums, largest length
first.

Only the histogram (at most `capacity` rows) comes to the driver and only the plan
(configurations and their counts, whose number doesn't depend on the number of
documents) goes back. Pieces find their place by rank within their length; the
rank is a row number within a (length, bucket) group plus the sizes of the buckets
before it, so that neither a common length nor a repeated row meets in one task.

Null and empty texts are one `end` token. Repeated rows are packed each for
itself. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import slices, written

EPSILON = 0.003
STEP = 1.0
ROUNDS = 20
AGAIN = 8
RESIDUE = 0.2
PLACED = 0.1
ROWS_A_BUCKET = 20_000
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


class ByteBpe:
    """Ids of the byte-level vocabulary as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})

    def encode(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, allowed_special={SPECIAL}).astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first may be shorter than capacity."""
    n = -(-length // capacity)
    first = length - capacity * (n - 1)
    return [(0, first)] + [(first + capacity * i, capacity) for i in range(n - 1)]


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int, end: int, id_col: str, text_col: str, full: bool) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    stop = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in slices(batches):
            at, no, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                raw = bpe.encode(text or "") + stop
                for i, (a, n) in enumerate(cut(len(raw) // 4, capacity)):
                    at.append(row)
                    no.append(i)
                    start.append(a)
                    length.append(n)
                    part = raw[4 * a : 4 * (a + n)]
                    crc.append(zlib.crc32(part))
                    if full:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            out = {id_col: batch.column(0).take(pa.array(at, pa.int64())), "piece": pa.array(no, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if full else {}))

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * full)


def price(size: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value of each capacity and the item it ends
    with (-1: leave a token free; among equals the largest, as small ones fit later too).
    Sizes ascend."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    fits = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            gain = best[c - size[:k]] + value[:k]
            i = k - 1 - int(gain[::-1].argmax())
            if gain[i] > best[c] + 1e-15:
                best[c], last[c] = gain[i], i
    return best, last


def trace(best: np.ndarray, last: np.ndarray, size: np.ndarray, value: np.ndarray, need: np.ndarray, capacity: int, first: int) -> list[int]:
    """The items of the best configuration that holds `first`, none more often than it is
    needed: where the best item has run out, the best of those left stands in."""
    items, used = [first], {first: 1}
    capacity -= int(size[first])
    while capacity > 0:
        if (i := int(last[capacity])) < 0:
            capacity -= 1
            continue
        if used.get(i, 0) >= need[i]:
            k = int(np.searchsorted(size, capacity, side="right"))
            gain = best[capacity - size[:k]] + value[:k]
            gain[[j for j, n in used.items() if j < k and n >= need[j]]] = -1.0
            if not k or gain[i := k - 1 - int(gain[::-1].argmax())] < 0:
                break
        items.append(i)
        used[i] = used.get(i, 0) + 1
        capacity -= int(size[i])
    return sorted(items)


def solve(size: np.ndarray, need: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Multiplicative weights on the covering program: configurations (item numbers,
    ascending) and how often to use them. Weights start at the share of a sequence that
    a length takes, and lengths that are covered late gain on the others."""
    weight = size / capacity
    use: dict[tuple[int, ...], float] = {}
    covered = np.zeros(len(size))
    for step in range(1, rounds + 1):
        best, last = price(size, weight, capacity)
        chosen = np.flatnonzero(weight + best[capacity - size] >= (1 - EPSILON) * best[capacity])
        share = np.zeros(len(size))
        found = {}
        for i in chosen.tolist():
            items = tuple(trace(best, last, size, weight, need, capacity, i))
            if items not in found:
                found[items] = np.unique(items, return_counts=True)
                share[found[items][0]] += found[items][1]
        for items, (kinds, times) in found.items():
            much = float((need[kinds] / share[kinds]).min())
            use[items] = use.get(items, 0.0) + much
            covered[kinds] += much * times
        level = covered / need
        weight = size / capacity * np.exp(-(level - level.min()) / max(1.0, level.max()) * STEP * np.sqrt(step))
    total = (size * need).sum() / max(1e-9, sum(use[k] * size[list(k)].sum() for k in use)) if use else 1.0
    return {k: v * total for k, v in use.items()}


def fill(size: np.ndarray, left: np.ndarray, capacity: int) -> tuple[int, ...]:
    """The largest remaining length and the remaining lengths that fill its
    sequence best, by subset sums kept as bits."""
    first = int(np.flatnonzero(left)[-1])
    room = capacity - int(size[first])
    mask = (1 << (room + 1)) - 1
    left = left.copy()
    left[first] -= 1
    steps: list[tuple[int, int]] = []
    reach = 1
    for i in np.flatnonzero(left[: np.searchsorted(size, room, side="right")])[::-1].tolist():
        for _ in range(min(int(left[i]), room // int(size[i]))):
            steps.append((i, reach))
            reach |= (reach << int(size[i])) & mask
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, items = reach.bit_length() - 1, [first]
    for i, before in reversed(steps):
        if not before >> at & 1:
            items.append(i)
            at -= int(size[i])
    return tuple(sorted(items))


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[list[int], int]], int]:
    """Configurations (lengths) and how many sequences have each: every length is
    used exactly as often as the histogram says. And how many of them, from the first,
    the program gave; the rest is its residue."""
    size = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[int(s)] for s in size], np.int64)
    done: list[tuple[tuple[int, ...], int]] = []

    def take(items: tuple[int, ...], times: int) -> None:
        kinds, each = np.unique(items, return_counts=True)
        if (times := min(times, int((left[kinds] // each).min()))) > 0:
            left[kinds] -= times * each
            done.append((items, times))

    total = held = int((size * left).sum())
    while held > RESIDUE * total:
        live = np.flatnonzero(left)
        carry = 0.0
        found = solve(size[live], left[live].astype(float), capacity, AGAIN if done else ROUNDS)
        for items, much in sorted(found.items(), key=lambda x: (-x[1], x[0])):
            items = tuple(live[list(items)].tolist())
            if int(size[list(items)].sum()) < capacity:
                continue
            carry += much
            take(items, int(carry))
            carry -= int(carry)
        before, held = held, int((size * left).sum())
        if before - held < PLACED * before:
            break
    program = len(done)
    while left.any():
        items = fill(size, left, capacity)
        kinds, each = np.unique(items, return_counts=True)
        take(items, max(1, int((left[kinds] // each).min() // 2)))
    return [(size[list(items)].tolist(), times) for items, times in done], program


def places(planned: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: pieces of that
    rank and on go to that sequence and on."""
    rows, rank, sequence = [], {}, 0
    for lengths, times in planned:
        offset = 0
        for n in lengths:
            rows.append((n, rank.get(n, 0), sequence, offset))
            rank[n] = rank.get(n, 0) + times
            offset += n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset and, with
    full, ids. path: the vocabulary as ranks; pattern: its split."""
    cut_up = pieces(docs, path, pattern, capacity, end, id_col, text_col, full)
    cut_up = written(cut_up.withColumn("_row", F.monotonically_increasing_id()), "pieces")  # sets equal rows apart
    buckets = max(8, cut_up.count() // ROWS_A_BUCKET)
    cut_up = cut_up.withColumn("_bucket", F.pmod(F.xxhash64(id_col, "piece", "_row"), F.lit(buckets)))
    counts = written(cut_up.groupBy("length", "_bucket").agg(F.count("*").alias("_n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    where = places(plan(histogram, capacity)[0])
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("length"), "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy(id_col, "piece", "_row")
    ranked = cut_up.withColumn("_rank", F.row_number().over(within) - 1).join(offsets, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    columns = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * full
    sent = docs.sparkSession.sparkContext.broadcast(where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value
        key = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "_rank"))
            i = np.searchsorted(key, length << 44 | rank, side="right") - 1
            out = {n: batch.column(n) for n in columns[:5]} | {"sequence_id": pa.array(rows[i, 2] + rank - rows[i, 1]), "offset": pa.array(rows[i, 3])}
            yield pa.RecordBatch.from_pydict(out | ({"ids": batch.column("ids")} if full else {}))

    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.select(*columns, "_rank").mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * full)
