"""Near-duplicate embeddings by product quantisation.

A coarse quantiser cuts the unit sphere into inverted lists (pairs of centres, one for each
half of the components, so that the lists grow with the rows and the centres with the root
of it); what a vector differs from its list's centre by is coded by the nearest of CODES
centres in each of SUBSPACES subspaces. Every vector is also a query: it probes its own list
and those of greater numbers whose bisecting planes with its own are within the margin,
reads its distance to every code there from lookup tables (asymmetric: the query isn't
coded) and discards what is further than the reach plus the coded vector's own quantisation
error, which by the triangle inequality loses nothing. A link between two lists is found
from the list of the smaller number. Survivors are compared by exact cosine in double
precision.

The margin doesn't depend on how many lists there are. Two linked vectors in two lists lie
on both sides of the lists' plane, so what they differ by, at most the reach, crosses it;
along one direction that is the reach times the root of that direction's share of all
differences, taken for the direction with the greatest share. SPREAD such deviations are
the margin, at most the whole reach; with spread=None it is the reach itself, by which
the probes lose no link whatever the vectors are.

Centres are fitted on a bounded sample (SAMPLE vectors, by a hash of their bytes); every
vector is indexed. Equal vectors are one class. Lists are dealt in chunks of CHUNK members
and ASKED queries, and every pair of chunks is a unit of its own, so a large group of
copies never meets in one task; a task returns a count per vector and a forest of its links.

Vectors that are null, zero or hold null or non-finite components link with nothing;
vectors of different lengths don't link. Rows with null or repeated ids count each for
itself; a component of null ids only has a null component_id. An empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import released, written
from sluice.llm.components import Forest, components

COSINE = 0.95
SAMPLE = 8192
LIST_SIZE = 160
SPREAD = 2.0
SUBSPACES = 8
CODES = 64
CHUNK = 256
ASKED = 8192


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        near = nearest(x, centres)
        size = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(size[:, None] > 0, sums / np.maximum(1, size)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centres * centres).sum(1) / 2
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (x[i : i + 4096] @ centres.T - half).argmax(1)
    return out


class Coarse:
    """Centres of lists: each half of the components has its own centres, and a list is a
    pair of them, so that few centres make many lists."""

    def __init__(self, sides: list[slice], centres: list[np.ndarray]):
        self.sides, self.centres = sides, centres

    def __len__(self) -> int:
        return int(np.prod([len(c) for c in self.centres]))

    def __getitem__(self, at) -> np.ndarray:
        out = []
        for c in reversed(self.centres):
            out.append(c[at % len(c)])
            at = at // len(c)
        return np.concatenate(out[::-1], axis=-1)

    def number(self, parts: list[np.ndarray]) -> np.ndarray:
        at = np.zeros_like(parts[0])
        for c, part in zip(self.centres, parts, strict=True):
            at = at * len(c) + part
        return at

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.number([nearest(x[:, s], c) for s, c in zip(self.sides, self.centres, strict=True)])


@dataclass
class Index:
    """Coarse centres and a codebook per subspace, for unit vectors of one length. A list
    is probed where the bisecting planes with the query's own list, in both halves, are no
    further away than the margin."""

    coarse: Coarse
    books: list[np.ndarray]
    parts: list[slice]
    margin: float

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, seed: int = 5, cosine: float = COSINE, spread: float | None = SPREAD) -> Index:
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        sides = [slice(0, dim // 2), slice(dim // 2, dim)] if dim > 1 else [slice(0, 1)]
        lists = max(1, rows // LIST_SIZE)
        each = int(min(np.ceil(lists ** (1 / len(sides))), max(1, len(sample) // 4)))
        coarse = Coarse(sides, [kmeans(sample[:, s], each, rng) for s in sides])
        rest = sample - coarse[coarse.home(sample)]
        edges = np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int)
        parts = [slice(a, b) for a, b in zip(edges, edges[1:])]
        reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
        if spread is not None:
            # the greatest share that one direction has in what vectors of a list differ by
            own = np.linalg.eigvalsh(rest.T @ rest)
            reach *= min(1.0, spread * float(np.sqrt(own[-1] / own.sum())) if own.sum() > 0 else 1.0)
        return cls(coarse, [kmeans(rest[:, p], CODES, rng) for p in parts], parts, reach)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the norm of what they miss."""
        rest = x - self.coarse[home]
        codes = np.stack([nearest(rest[:, p], b) for p, b in zip(self.parts, self.books)], axis=1)
        for k, (p, b) in enumerate(zip(self.parts, self.books)):
            rest[:, p] -= b[codes[:, k]]
        return codes.astype(np.uint8), np.sqrt((rest * rest).sum(1))

    def probes(self, x: np.ndarray) -> np.ndarray:
        """The nearest list, then those of greater numbers within the margin; rows are
        filled up with -1."""
        near: list[list[np.ndarray]] = []  # by half and row: centres within the margin, the nearest first
        for side, centres in zip(self.coarse.sides, self.coarse.centres, strict=True):
            half = (centres * centres).sum(1) / 2
            between = np.sqrt(np.maximum(0, 2 * (half[:, None] + half - centres @ centres.T)))
            found: list[np.ndarray] = []
            for i in range(0, len(x), 512):
                score = half - x[i : i + 512, side] @ centres.T
                home = score.argmin(1)
                asked = score - score[np.arange(len(home)), home][:, None] <= self.margin * between[home] + 1e-6  # halves of squared distances
                asked[np.arange(len(home)), home] = False
                found += [np.concatenate([[h], np.flatnonzero(a)]) for h, a in zip(home, asked, strict=True)]
            near.append(found)
        lists = []
        for row in zip(*near, strict=True):
            at = self.coarse.number([g.ravel() for g in np.meshgrid(*row, indexing="ij")])
            lists.append(np.concatenate([at[:1], np.sort(at[1:][at[1:] > at[0]])]))
        out = np.full((len(lists), max(map(len, lists), default=1)), -1)
        for row, found_ in zip(out, lists, strict=True):
            row[: len(found_)] = found_
        return out

    def tables(self, query: np.ndarray, at: int) -> np.ndarray:
        """Squared distances of each query's residual to all codes (subspaces, queries, codes)."""
        rest = query - self.coarse[at]
        out = np.full((len(self.parts), len(query), CODES), np.inf)
        for k, (p, b) in enumerate(zip(self.parts, self.books)):
            out[k, :, : len(b)] = ((rest[:, p] ** 2).sum(1)[:, None] + (b * b).sum(1)) - 2 * rest[:, p] @ b.T
        return out

    def candidates(self, query: np.ndarray, at: int, codes: np.ndarray, missed: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, coded vector) that may be within reach."""
        tables = self.tables(query, at)
        far = sum(tables[k][:, codes[:, k]] for k in range(len(self.parts)))
        return np.nonzero(far <= (reach + missed + 1e-6) ** 2)


def usable(raw: list | None) -> np.ndarray | None:
    if not raw or None in raw:
        return None
    x = np.array(raw, np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    return None if top == 0 else (y := x / top) / np.sqrt(y @ y)


def classes_of(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, digest) per row, null for vectors that link with nothing, and the distinct
    usable vectors: (k, unit, least, many)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = [usable(raw) for raw in batch.column(1).to_pylist()]
            raw = [None if u is None else u.tobytes() for u in unit]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if r is None else hashlib.md5(r).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary())], names=["i", "d", "u"])

    kind = rows.schema[id_col].dataType.simpleString()
    known = rows.select(F.col(id_col), F.col(vec_col)).mapInArrow(digest, f"i {kind}, d binary, u binary")
    known = written(known, "digests")
    distinct = known.filter("d IS NOT NULL").groupBy("d").agg(F.min("i").alias("least"), F.count("*").alias("many"), F.first("u").alias("u"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << 33
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + batch.num_rows)), *batch.columns], names=["k", "d", "least", "many", "u"])
            k += batch.num_rows

    return known.select("i", "d"), written(distinct.mapInArrow(number, f"k long, d binary, least {kind}, many long, u binary"), "vectors")


def units_of(vectors: DataFrame, indexes: dict[int, Index], cuts: dict) -> DataFrame:
    """Every vector as a coded member of its list and as a query of the lists it probes,
    once for each chunk of the other side."""
    sent = vectors.sparkSession.sparkContext.broadcast((indexes, cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim, chunks = sent.value
        for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):  # a vector may have hundreds of lists
            out: list[list] = [[] for _ in range(8)]
            k, many, raw = batch.column("k").to_numpy(), batch.column("many").to_numpy(), batch.column("u").to_pylist()
            for dim, rows in by_length(raw).items():
                index = by_dim[dim]
                x = np.stack([np.frombuffer(raw[i]) for i in rows])
                probes = index.probes(x)
                codes, missed = index.encode(x, probes[:, 0])
                for i, lists, code, miss in zip(rows, probes.tolist(), codes, missed.tolist(), strict=True):
                    own, asked = chunks.get((dim, lists[0]), (1, 1))
                    home = np.int64(lists[0]).tobytes()
                    mine = int(k[i]) * 0x9E3779B97F4A7C15 >> 20
                    for q in range(asked):
                        _add(out, dim, lists[0], mine % own, q, 0, int(k[i]), int(many[i]), raw[i] + code.tobytes() + np.float64(miss).tobytes())
                    for at in filter(lambda at: at >= 0, lists):
                        own, asked = chunks.get((dim, at), (1, 1))
                        for c in range(own):
                            _add(out, dim, at, c, mine % asked, 1, int(k[i]), int(many[i]), raw[i] + home)
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int8(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["dim", "list", "c", "q", "side", "k", "many", "raw"])

    def _add(out: list[list], *row) -> None:
        for column, value in zip(out, row, strict=True):
            column.append(value)

    return vectors.select("k", "many", "u").mapInArrow(run, "dim int, list long, c int, q int, side byte, k long, many long, raw binary")


def by_length(raw: list[bytes]) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for i, r in enumerate(raw):
        found.setdefault(len(r) // 8, []).append(i)
    return found


def list_sizes(vectors: DataFrame, indexes: dict[int, Index]) -> dict:
    """(dim, list) -> chunks of members and of queries, where there are several."""
    sent = vectors.sparkSession.sparkContext.broadcast(indexes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], list[int]] = {}
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            raw = batch.column(0).to_pylist()
            for dim, rows in by_length(raw).items():
                probes = sent.value[dim].probes(np.stack([np.frombuffer(raw[i]) for i in rows]))
                for side, lists in ((0, probes[:, 0]), (1, probes[probes >= 0])):
                    for at, n in zip(*np.unique(lists, return_counts=True)):
                        counts.setdefault((dim, int(at)), [0, 0])[side] += int(n)
        rows = [(*k, *v) for k, v in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(4)], names=["dim", "list", "own", "asked"])

    rows = vectors.select("u").mapInArrow(run, "dim long, list long, own long, asked long").groupBy("dim", "list").agg(F.sum("own").alias("own"), F.sum("asked").alias("asked")).filter((F.col("own") > CHUNK) | (F.col("asked") > ASKED)).collect()
    return {(r.dim, r.list): (max(1, -(-r.own // CHUNK)), max(1, -(-r.asked // ASKED))) for r in rows}


def link_units(units: DataFrame, indexes: dict[int, Index], cosine: float) -> DataFrame:
    """(k, n, a, b): links of vectors by number (n: rows linked to k), and the links a, b
    of the task's forest. A link within a list is found from each of its ends, and one between
    lists once."""
    sent = units.sparkSession.sparkContext.broadcast(indexes)
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), None
        counts: dict[int, int] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = np.stack([table.column(n).to_numpy() for n in ("dim", "list", "c", "q")])
            edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            for a, b in zip([0, *edges[:-1]], edges):
                _unit(table.slice(a, b - a), forest, counts)
            held = table.slice(int(edges[-1]) if len(edges) else 0).combine_chunks()
        if held is not None and held.num_rows:
            _unit(held, forest, counts)
        a, b = forest.links()
        none = [None] * len(a)
        yield pa.RecordBatch.from_arrays([pa.array([*counts, *none], pa.int64()), pa.array([*counts.values(), *none], pa.int64()), pa.array([None] * len(counts) + a, pa.int64()), pa.array([None] * len(counts) + b, pa.int64())], names=["k", "n", "a", "b"])

    def _unit(table: pa.Table, forest: Forest, counts: dict[int, int]) -> None:
        dim, at = table.column("dim")[0].as_py(), table.column("list")[0].as_py()
        side = table.column("side").to_numpy()
        member, query = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(member) or not len(query):
            return
        index = sent.value[dim]
        k, many = table.column("k").to_numpy(), table.column("many").to_numpy()
        raw = table.column("raw").to_pylist()
        parts = len(index.parts)
        x = np.stack([np.frombuffer(r, np.float64, dim) for r in raw])
        codes = np.stack([np.frombuffer(raw[i], np.uint8, parts, 8 * dim) for i in member])
        missed = np.array([np.frombuffer(raw[i], np.float64, 1, 8 * dim + parts)[0] for i in member])
        away = np.zeros(len(raw), bool)
        away[query] = [np.frombuffer(raw[i], np.int64, 1, 8 * dim)[0] != at for i in query]
        q, m = index.candidates(x[query], at, codes, missed, reach)
        q, m = query[q], m
        apart = k[q] != k[member[m]]
        q, m = q[apart], m[apart]
        good = np.zeros(len(q), bool)
        for i in range(0, len(q), 1 << 14):
            s = slice(i, i + (1 << 14))
            good[s] = np.einsum("ij,ij->i", x[q[s]], x[member[m[s]]]) >= cosine
        q, m = q[good], m[good]
        if not len(q):
            return
        member_ = member[m]
        got = np.bincount(q, many[member_], len(k)) + np.bincount(member_[away[q]], many[q[away[q]]], len(k))
        for i in np.flatnonzero(got).tolist():
            counts[int(k[i])] = counts.get(int(k[i]), 0) + int(got[i])
        for a, b in np.unique(np.stack([k[q], k[member_]], axis=1), axis=0).tolist():
            forest.join(a, b)

    key = ["dim", "list", "c", "q"]
    return units.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "k long, n long, a long, b long")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, spread: float | None = SPREAD) -> DataFrame:
    """Per row: id, n_links, component_id, kept. With spread=None no link is lost."""
    known, vectors = classes_of(rows, id_col, vec_col)
    # a bounded sample for each length of vectors
    dims = {r.dim: r.n for r in vectors.groupBy((F.octet_length("u") / 8).cast("long").alias("dim")).agg(F.count("*").alias("n")).collect()}
    indexes = {}
    for dim, n in dims.items():
        sample = vectors.filter(F.octet_length("u") == 8 * dim).orderBy("d").limit(SAMPLE).select("u").collect()
        indexes[dim] = Index.fit(np.stack([np.frombuffer(bytes(r.u)) for r in sample]), n, cosine=cosine, spread=spread)
    units = units_of(vectors, indexes, list_sizes(vectors, indexes))
    found = written(link_units(units, indexes, cosine), "near")
    released(rows.sparkSession)
    counts = found.filter("k IS NOT NULL").groupBy("k").agg(F.sum("n").alias("n"))
    nodes = components(found.filter("a IS NOT NULL").select("a", "b"))
    state = vectors.select("k", "d", "least", "many").join(counts, "k", "left").join(nodes, F.col("k") == F.col("node"), "left")
    state = state.select("d", "least", (F.col("many") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "k").alias("root"))
    least = state.groupBy("root").agg(F.min("least").alias("component"))
    state = state.join(least, "root").select("d", "n_links", "component")
    own = F.when(F.col("d").isNull(), F.col("i")).otherwise(F.col("component"))
    return known.join(state, "d", "left").select(
        F.col("i").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("i") == own, F.lit(False)).alias("kept")
    )


def recall(vectors: np.ndarray, cosine: float = COSINE) -> float:
    """Share of the true links that the probes reach, by brute force over unit vectors."""
    rng = np.random.default_rng(1)
    index = Index.fit(vectors[np.sort(rng.choice(len(vectors), min(SAMPLE, len(vectors)), replace=False))], len(vectors), cosine=cosine)
    probes = index.probes(vectors)
    hit = total = 0
    for i in range(len(vectors)):
        near = np.flatnonzero(vectors @ vectors[i] >= cosine)
        near = near[near > i]
        total += len(near)
        hit += int(((probes[near, 0][:, None] == probes[i]).any(1) | (probes[near] == probes[i, 0]).any(1)).sum())
    return hit / total if total else 1.0
