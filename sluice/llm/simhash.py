"""SimHash near-duplicates with pivot distance tables.

Fingerprints: A-Z lower-cased, words between ASCII white space, shingles of WORDS
words with repeats (the whole sequence where there are fewer), XXH64 with seed 42; a
bit is 1 where over half of the hashes have it. No words: fingerprint 0.

Links: distinct fingerprints that differ in at most REACH bits. Pairs meet where two
of six blocks of bits are equal: REACH changed bits touch at most four blocks, so no
pair is missed. Within such a group every fingerprint has a table of its Hamming
distances to PIVOTS reference fingerprints; by the triangle inequality a pair whose
tables differ by more than REACH anywhere can't be near and is discarded, and the
survivors are verified bit by bit. Pivots alone would prune too little: distances of
random fingerprints to a pivot lie within a few bits of 32, so the blocks choose what
is compared. A task turns its pairs into a forest before it returns them. Groups of
more than HOT fingerprints are cut into chunks, and each pair of chunks is a group of
its own.

Null texts are empty. Rows with equal texts, repeated ids or null ids count each for
itself; a component of null ids only has a null component_id. An empty table gives
an empty result, further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import TEXTS, written
from sluice.llm.components import Forest, components

WORDS = 4
SEED = 42
REACH = 4
PIVOTS = np.random.default_rng(64).integers(0, 1 << 64, 32, dtype=np.uint64)
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
HOT = 4096


def shingle_hashes(text: str) -> np.ndarray:
    words = text.encode().lower().split()  # bytes: ASCII only, for both
    digest = xxhash.xxh64_intdigest
    if len(words) < WORDS:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -WORDS] + 1).tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str) -> int:
    hashes = shingle_hashes(text)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].byteswap().view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "") for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, docs.select(id_col).schema.add("fp", "long"))


def near(a: np.ndarray, b: np.ndarray, tables_a: np.ndarray, tables_b: np.ndarray) -> np.ndarray:
    """Which pairs are near: by pivot tables first, then bit by bit."""
    likely = np.flatnonzero(np.abs(tables_a - tables_b).max(1) <= REACH) if len(a) else np.zeros(0, np.int64)
    return likely[np.bitwise_count(a[likely] ^ b[likely]) <= REACH]


def pivot_tables(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ PIVOTS).astype(np.int8)


def links_within(key: np.ndarray, side: np.ndarray, fps: np.ndarray, forest: Forest) -> None:
    """Joins the near pairs of each run of equal keys. Sides are 0 and 1 in a pair
    of chunks, where only unequal ones are compared, and 2 elsewhere."""
    tables = pivot_tables(fps)
    left, step = np.arange(len(key) - 1), 1
    while len(left := left[left + step < len(key)]):
        left = left[key[left] == key[left + step]]
        for part in np.array_split(left, max(1, len(left) // (1 << 16))):
            a, b = part, part + step
            apart = (side[a] == 2) | (side[a] != side[b])
            a, b = a[apart], b[apart]
            good = near(fps[a], fps[b], tables[a], tables[b])
            for x, y in zip(fps[a[good]].view(np.int64).tolist(), fps[b[good]].view(np.int64).tolist(), strict=True):
                forest.join(x, y)
        step += 1


def find_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect all near pairs of the column fp, a forest per task."""
    fp = F.col("fp")
    block = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1)) for at, bits in BLOCKS]
    keys = [F.lit(n << 24).bitwiseOR(F.shiftleft(block[i], 11)).bitwiseOR(block[j]) for n, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]
    routed = distinct.select(fp, F.explode(F.array(*keys)).alias("k"))
    hot = written(routed.groupBy("k").count().filter(F.col("count") > HOT).select("k", F.ceil(F.col("count") / F.lit(HOT // 2)).alias("n")), "hot")
    routed = routed.select("k", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(2).alias("side"), "fp")
    if hot.limit(1).count():
        cold = routed.join(hot, "k", "left_anti")
        cut = routed.join(hot, "k").withColumn("c", F.pmod(F.xxhash64("fp"), "n"))
        pairs = cut.select("k", "fp", "c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o"))
        low, high = F.least("c", "o").cast("int"), F.greatest("c", "o").cast("int")
        side = F.when(F.col("c") == F.col("o"), 2).otherwise((F.col("c") > F.col("o")).cast("int"))
        routed = cold.unionByName(pairs.select("k", (low + 1).alias("p"), high.alias("q"), side.alias("side"), "fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, kept = Forest(), None
        for batch in batches:
            k, p, q, side, fps = (batch.column(i).to_numpy() for i in range(5))
            rows = np.stack([k.astype(np.int64), p.astype(np.int64) << 32 | q, side.astype(np.int64), fps])
            rows = rows if kept is None else np.concatenate([kept, rows], axis=1)
            change = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(0)) + 1
            at = int(change[-1]) if len(change) else 0  # the last group may go on
            if at:
                _group(rows[:, :at], forest)
            kept = rows[:, at:]
        if kept is not None:
            _group(kept, forest)
        a, b = forest.links()
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def _group(rows: np.ndarray, forest: Forest) -> None:
        new = np.ones(rows.shape[1], bool)
        new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(0)
        links_within(np.cumsum(new), rows[2], np.ascontiguousarray(rows[3]).view(np.uint64), forest)

    return routed.repartition("k", "p", "q").sortWithinPartitions("k", "p", "q").mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    own = written(fingerprints(docs, id_col, text_col), "fingerprints", batch=TEXTS)
    classes = written(own.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    nodes = components(find_links(classes.select("fp")))
    rooted = classes.join(nodes, classes.fp == nodes.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = rooted.join(least, "root").select("fp", "component_id")
    return own.join(by_class, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", verify: Callable[[DataFrame, DataFrame, str, str], DataFrame] | None = None) -> DataFrame:
    """The documents whose id is their component's smallest; rows of a null id stay,
    and so do repeated rows of the smallest id. verify(docs, pairs, id_col, text_col) gives which of the pairs
    (first, other) of a component's smallest id and another one are copies: only these go."""
    found = simhash_components(docs, id_col, text_col)
    pairs = found.filter(F.col("component_id") != F.col(id_col)).select(F.col("component_id").alias("first"), F.col(id_col).alias("other")).distinct()
    gone = pairs if verify is None else verify(docs, written(pairs, "pairs"), id_col, text_col)
    gone = gone.select(F.col("other").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
