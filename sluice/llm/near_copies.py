"""Near copies of documents: pairs whose sets of word shingles have a Jaccard similarity
of SIMILAR or more.

A-Z are lower-cased, words stand between ASCII white space, shingles have WORDS words (the
whole text where there are fewer). Equal word sequences, by a 128-bit digest, are one class of
documents, whose order is that of its least id. Classes that may be alike share a band of ROWS minimum hashes,
any of BANDS bands: a pair of similarity 0.8 is missed with a probability of
(1 - 0.8**ROWS)**BANDS, under one in 100,000, and a more similar one with less. Only
classes of such bands go on, with the 64-bit hashes of their shingles, and every pair that goes is
verified on these whole sets.

Large groups are thinned first: STARS times every class is compared with the first
of each of its bands, and goes where they are near copies; no pair is tried twice. What is left
is joined by exact prefixes: shingles are put in order of rarity, and two sets of SIMILAR
have a shingle in common among the first of each, near enough to the front for the rest to
suffice (the bounds by length and position are part of the join). So texts that share much, but
too little, don't meet: their own rare shingles fill the prefixes.

Null texts are empty, and empty texts are copies of each other. Rows of a null id stay,
and so do repeated rows of an id that stays; rows of one id with unlike texts are told apart by
their texts. An empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import TEXTS, written

WORDS = 5
SIMILAR = 0.8
ROWS = 5
BANDS = 30
STARS = 2
SEED = 42
_RNG = np.random.default_rng(80)
FIRST, SECOND = _RNG.integers(0, 1 << 64, (2, ROWS * BANDS), dtype=np.uint64) | np.uint64(1)
MIX = _RNG.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
SALT = _RNG.integers(0, 1 << 64, BANDS, dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: ASCII only, for both


def shingles(words: list[bytes]) -> list[bytes]:
    """Distinct shingles in no order; none of no words."""
    if len(words) <= WORDS:
        return [b" ".join(words)] if words else []
    return list({b" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)})


def band_keys(found: list[bytes]) -> np.ndarray:
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in found], np.uint64)
    least = np.full(ROWS * BANDS, ~np.uint64(0))
    for i in range(0, len(hashes), 1024):
        x = hashes[i : i + 1024, None] * FIRST
        x ^= x >> np.uint64(32)
        x *= SECOND
        np.minimum(least, x.min(0), out=least)
    return ((least >> np.uint64(7)).reshape(BANDS, ROWS) * MIX).sum(1, dtype=np.uint64) ^ SALT


def jaccard(a: frozenset, b: frozenset) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def digest(text: Column) -> Column:
    """128 bits of the words of a text."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.unhex(F.md5(F.trim(F.regexp_replace(lower, "[\\x20\\x09-\\x0D]+", " "))))


def sketches(docs: DataFrame) -> DataFrame:
    """(i, d, keys) of (i, d, t): the keys of the bands, none of no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for text in batch.column(2):  # one by one: word lists of a batch are large
                words = words_of(text.as_py())
                keys.append(band_keys(shingles(words)).view(np.int64) if words else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["i", "d", "keys"])

    return docs.select("i", "d", "t").mapInArrow(run, f"i {docs.schema['i'].dataType.simpleString()}, d binary, keys array<bigint>")


def hashed(docs: DataFrame) -> DataFrame:
    """(d, h) of (d, t): the set of shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(words_of(text.as_py()))], np.uint64)).view(np.int64) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["d", "h"])

    return docs.select("d", "t").mapInArrow(run, "d binary, h array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of digests that are near copies by the Jaccard similarity of their sets."""
    one, other = sets.select(F.col("d").alias("a"), F.col("h").alias("ha")), sets.select(F.col("d").alias("b"), F.col("h").alias("hb"))
    least, most = F.least(F.size("ha"), F.size("hb")), F.greatest(F.size("ha"), F.size("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(other, "b").join(one, "a").filter((least >= most * SIMILAR) & (both / (F.size("ha") + F.size("hb") - both) >= SIMILAR)).select("a", "b")


def prefix_pairs(left: DataFrame) -> DataFrame:
    """Pairs (a, b) of the sets (d, o, h) that no exact bound rules out, the first in the order o as a.

    A shingle of one set only can't be shared; the others are placed after these, the
    rarest first. Of two sets, the smaller has a common shingle within its first
    n - 2 SIMILAR n / (1 + SIMILAR) + 1, the larger within its first n - SIMILAR n + 1."""
    each = left.select("d", "o", F.size("h").alias("n"), F.explode("h").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    shared = each.join(often, "s")
    own = Window.partitionBy("d")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "s"))
    placed = shared.withColumn("p", place).filter(F.col("p") <= F.col("n") - F.ceil(F.col("n") * SIMILAR - 1e-9) + 1).select("s", "d", "o", "n", "p")
    near = F.col("n") - F.ceil(F.col("n") * (2 * SIMILAR / (1 + SIMILAR)) - 1e-9) + 1
    x, y = placed.alias("x"), placed.filter(F.col("p") <= near).alias("y")  # y is the smaller
    f = F.col
    smaller = (f("y.n") < f("x.n")) | ((f("y.n") == f("x.n")) & (f("y.d") < f("x.d")))
    enough = F.ceil((f("x.n") + f("y.n")) * (SIMILAR / (1 + SIMILAR)) - 1e-9)
    may = (1 + F.least(f("x.n") - f("x.p"), f("y.n") - f("y.p")) >= enough) & (f("y.n") >= f("x.n") * SIMILAR)
    pairs = x.join(y, (f("x.s") == f("y.s")) & smaller & may)
    first = f("x.o") < f("y.o")
    return pairs.select(F.when(first, f("x.d")).otherwise(f("y.d")).alias("a"), F.when(first, f("y.d")).otherwise(f("x.d")).alias("b")).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents but for those that are a near copy of one of a smaller id."""
    names = [f"c{k}" for k in range(len(docs.columns))]  # columns of any name
    own = docs.toDF(*names)
    id_, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    rows = own.withColumns({"i": id_, "t": text, "d": digest(text)})
    known = written(sketches(rows), "sketches", batch=TEXTS)
    classes = written(known.filter("i IS NOT NULL").groupBy("d").agg(F.min("i").alias("m"), F.count("*").alias("many"), F.first("keys").alias("keys")), "classes")
    bands = classes.select("d", F.struct("m", "d").alias("o"), F.explode("keys").alias("k"))
    shared = bands.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k")
    met = written(bands.join(shared, "k"), "bands")
    asked = met.select("d", F.col("o.m").alias("i")).distinct()
    some = own.select(id_.alias("i"), text.alias("t")).join(asked.select("i"), "i", "left_semi").withColumn("d", digest(F.col("t")))
    sets = written(hashed(some.join(asked, ["d", "i"], "left_semi").dropDuplicates(["d", "i"])), "sets", batch=TEXTS)
    gone = tried = None
    for _ in range(STARS):
        heads = met.groupBy("k").agg(F.min("o").alias("first"))
        pairs = met.join(heads, "k").filter("first < o").select(F.col("first.d").alias("a"), F.col("d").alias("b")).distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        copies = written(verified(pairs, sets).select(F.col("b").alias("d")).distinct(), "copies")
        gone, tried = (copies, pairs) if gone is None else (gone.unionByName(copies), tried.unionByName(pairs))
        met = written(met.join(copies, "d", "left_anti"), "bands")
        # a band that one class is left of leads to no pair
        alone = met.groupBy("k").agg(F.count("*").alias("n")).filter("n = 1").select("k")
        met = met.join(alone, "k", "left_anti")
    left = sets.join(met.select("d", "o").distinct(), "d").select("d", "o", "h")
    pairs = prefix_pairs(left).join(tried, ["a", "b"], "left_anti")
    gone = gone.unionByName(verified(written(pairs, "pairs"), sets).select(F.col("b").alias("d"))).distinct().withColumn("gone", F.lit(True))
    special = classes.select("d", "m", "many").join(gone, "d", "left").filter("many > 1 OR gone").select("d", "m", "gone")
    stays = F.col("m").isNull() | F.col("i").isNull() | (F.col("gone").isNull() & (F.col("i") == F.col("m")))
    return rows.join(special, "d", "left").filter(stays).select(names).toDF(*docs.columns)


def copies_of(docs: DataFrame, pairs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pairs (first, other) of ids whose texts are near copies, all rows of the other's
    id with all of the first's."""
    named = pairs.select(F.explode(F.array("first", "other")).alias("i")).distinct()
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(named, "i", "left_semi").withColumn("d", digest(F.col("t")))
    rows = written(rows, "named")
    of = rows.select("i", "d").distinct()
    a, b = (of.select(F.col("i").alias(i), F.col("d").alias(d)) for i, d in (("first", "a"), ("other", "b")))
    each = written(pairs.join(a, "first").join(b, "other"), "pairs")
    apart = each.filter("a <> b").select("a", "b").distinct()
    sets = hashed(rows.dropDuplicates(["d"]))
    good = verified(apart, written(sets, "sets", batch=TEXTS)).withColumn("good", F.lit(True))
    judged = each.join(good, ["a", "b"], "left").withColumn("good", F.coalesce("good", F.col("a") == F.col("b")))
    return judged.groupBy("first", "other").agg(F.bool_and("good").alias("all")).filter("all").select("first", "other")
