"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases: each is the shortest stretch from where
the last one ended that is no phrase yet (what is left at the end counts too). The
phrases are hashed, and the SIZE smallest hashes of the set are its signature. The
likeness of two texts is the share of common hashes among the SIZE smallest of both
(the Jaccard index of the phrase sets; exact for small sets).

Null texts are empty; an empty text has the empty fingerprint, which is like itself
(1) and unlike any other (0). Documents of one id follow each other in the order of
their texts, in one bucket; null ids come last. A lone document is its own next one. An empty table
gives an empty result, further columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

SIZE = 128
ROWS_A_BUCKET = 2000
MOST_BUCKETS = 20_000
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """BASE and its inverse to the powers 0 to n - 1, modulo 2**64."""
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (BASE, INVERSE))
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def parse(text: str, at: int, stop: int, seen: set[str], ends: list[int]) -> tuple[int, list[str]]:
    """Parses from `at` while phrases end at or before `stop`; returns where the
    next phrase begins and the phrases that are new. The set of phrases holds every
    prefix of its members, so the length of a match is found from the length of the
    last one, up or down."""
    n, length = len(text), 4
    add, put = seen.add, ends.append
    new: list[str] = []
    while at < n:
        phrase = text[at : at + length]
        if phrase in seen:
            while phrase in seen and at + length < n:
                length += 1
                phrase = text[at : at + length]
            if phrase in seen:  # the text ends within a phrase
                if n > stop:
                    break
                put(n)
                return n, new
        else:
            length = len(phrase)
            while length > 1 and (shorter := phrase[:-1]) not in seen:
                phrase = shorter
                length -= 1
        end = at + len(phrase)
        if end > stop:
            break
        add(phrase)
        new.append(phrase)
        put(end)
        at = end
    return at, new


def phrase_hashes(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the phrases, mixed; equal phrases have equal hashes."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    up, down = POWERS.of(len(points) + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points + np.uint64(1)) * up[:-1], out=prefix[1:])
        h = (prefix[ends] - prefix[starts]) * down[starts]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


def signature(text: str, ends: list[int]) -> np.ndarray:
    """The SIZE smallest distinct 32-bit hashes of the phrases, ascending."""
    if not ends:
        return np.zeros(0, np.uint32)
    e = np.array(ends, np.int64)
    h = (phrase_hashes(text, np.concatenate([[0], e[:-1]]), e) >> np.uint64(32)).astype(np.uint32)
    if len(h) > 4 * SIZE:
        h = np.partition(h, 2 * SIZE)[: 2 * SIZE]  # phrases but the last differ, so half of these would do
    return np.unique(h)[:SIZE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)[:SIZE]
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, common, assume_unique=True).sum() / len(both))


def fingerprint_pair(text: str, following: str | None) -> tuple[np.ndarray, np.ndarray | None, str | None]:
    """Signature of the text and, given the next document, signature and text of the
    edited one. What both share is parsed once."""
    n = len(text)
    half = n - n // 2
    seen: set[str] = set()
    ends: list[int] = []
    if following is None:
        parse(text, 0, n, seen, ends)
        return signature(text, ends), None, None
    at, _ = parse(text, 0, half, seen, ends)
    edited = text[:half] + following[: n // 2]
    own, other = [*ends], [*ends]
    _, new = parse(text, at, n, seen, own)
    seen.difference_update(new)
    parse(edited, at, len(edited), seen, other)
    return signature(text, own), signature(edited, other), edited


def hexed(signature_: np.ndarray) -> str:
    return signature_.astype(">u4").tobytes().hex()


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Texts are shuffled once, by ranges of the id; the first
    document of each range is also put after the last of the range before."""
    base = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    n, known, low = base.agg(F.count("*"), F.count("i"), F.min("i").cast("long")).first()
    parts = max(1, min(n // ROWS_A_BUCKET, MOST_BUCKETS))
    # quantiles, so that uneven ids fill the buckets evenly
    shares = [k / parts for k in range(1, parts)]
    found = base.agg(F.percentile_approx(F.col("i").cast("long"), shares, max(10_000, 4 * parts))).first()[0] if shares else None
    bounds = np.unique(np.array(found or [], np.int64))
    last = len(bounds) + 1 if known < n else len(bounds) - int(np.searchsorted(bounds, low)) if known else 0

    @F.arrow_udf("int")
    def bucket(ids: pa.Array) -> pa.Array:
        """Descending ids: the highest are in bucket 0; null ids have the last one."""
        place = len(bounds) - np.searchsorted(bounds, ids.fill_null(0).to_numpy())
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), last, place), pa.int32())

    rows = base.withColumn("b", bucket(F.col("i").cast("long")))
    first = rows.groupBy("b").agg(F.max("i").alias("top"))
    # one row per bucket, of which there are MOST_BUCKETS at most
    order = first.withColumn("before", F.coalesce(F.lag("b").over(Window.orderBy("b")), F.lit(last)))
    heads = rows.join(F.broadcast(order), (rows.b == order.b) & rows.i.eqNullSafe(order.top))
    heads = heads.groupBy(order.before.alias("b"), rows.i.alias("i")).agg(F.min("t").alias("t")).withColumn("z", F.lit(1))
    dealt = rows.select("b", "i", "t", F.lit(0).alias("z")).unionByName(heads).repartitionById(last + 1, "b").sortWithinPartitions("b", "z", F.col("i").desc_nulls_last(), "t")
    kind = docs.schema[id_col].dataType
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # parsing makes many strings and no cycles
        held = waiting = None  # the row before, which needs this text; and the one before that, which needs a signature
        out: list[list] = [[] for _ in names]
        for batch in batches:
            for i, text, z in zip(*(batch.column(c).to_pylist() for c in ("i", "t", "z")), strict=True):
                if held is not None:
                    own, edited_sig, edited = fingerprint_pair(held[1], text)
                    if waiting is not None:
                        _put(out, waiting, own)
                    waiting = (held[0], len(held[1]), edited, own, edited_sig)
                if z:
                    _put(out, waiting, fingerprint_pair(text, None)[0])
                    held = waiting = None
                else:
                    held = (i, text)
            if len(out[0]) >= 500:
                yield _batch(out)
                out = [[] for _ in names]
        if out[0]:
            yield _batch(out)

    def _put(out: list[list], row: tuple, next_sig: np.ndarray) -> None:
        i, n_chars, edited, own, edited_sig = row
        for column, value in zip(out, (i, n_chars, hashlib.sha256(edited.encode()).hexdigest(), hexed(own), hexed(edited_sig), likeness(own, edited_sig), likeness(own, next_sig)), strict=True):
            column.append(value)

    def _batch(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(out[0], to_arrow_type(kind)), *[pa.array(c, t) for c, t in zip(out[1:], types, strict=True)]], names=names)

    return dealt.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
