"""Suffix-array deduplication: removes every byte that a string of WIDTH bytes covers
which also starts earlier (in a document of a smaller id, or before in the same one).

Anchors: of the GRAM-byte stretches of each WIDTH-byte window the one of the least
hash is its anchor, so equal windows have equal anchors. Only anchors whose hash is
met twice go on, with the stretch of text that their windows cover. The windows of an
anchor, by their place about it, are suffixes of those stretches: they are sorted by
the merge sort of `suffix`, whose comparisons find common extensions by prefix hashes
and binary search; neighbours that share WIDTH bytes are verified byte by byte.

Common anchors: where one is frequent in a few megabytes of text its occurrences are
salted there, and groups are cut every CHUNK occurrences. Of such groups the windows
that are first in their chunk meet once more by their MD5, under partial aggregates: first by
what BAND neighbouring windows share, which leaves out nearly all that no other chunk
has, then one by one.
Later copies of a whole text are known by their MD5 beforehand.

Null texts are empty. Rows of one id don't see each other's texts; within one row the
earlier start counts. Null ids come after all others and don't see each other.
Repeated rows get equal results, an empty table an empty result; further columns are
ignored. Text of a period below GRAM has an anchor at each byte, which costs space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sluice.llm.common import released, slices, written
from sluice.llm.suffix import Hashes, equal_to_previous, mix, sort_suffixes

WIDTH = 100
GRAM = 32
CHUNK = 2048
LOCAL = 24
BAND = 8
GROUP_BYTES = 2 << 20
LAST = (1 << 63) - 1
#: Where the parts of a packed place begin: position, windows before the anchor (first, last), whether its group is cut.
AT, FIRST, FINAL = 16, 9, 2


def grouped(texts: list[bytes], most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def least_in_window(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive keys: block prefixes against block suffixes."""
    n = len(key) - width + 1
    blocks = -(-len(key) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, hash, position, first, last): each anchor and how many bytes before it
    the first and the last of its windows start."""
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < WIDTH:
        return (np.zeros(0, np.int64),) * 5
    h = mix(Hashes(data).grams(GRAM))
    place = np.arange(len(h), dtype=np.uint64)
    least = least_in_window((h & ~np.uint64((1 << 30) - 1)) | place, WIDTH - GRAM + 1)
    at = (least & np.uint64((1 << 30) - 1)).astype(np.int64)
    end = np.cumsum(size)
    doc = np.repeat(np.arange(len(texts)), size)[: len(at)]
    start = np.flatnonzero(np.arange(len(at)) + WIDTH <= end[doc])
    at, doc = at[start], doc[start]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    at, doc = at[first], doc[first]
    return doc, h[at], at - (end - size)[doc], at - start[first], at - start[last]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def find_anchors(docs: DataFrame) -> DataFrame:
    """(h, o, t, v) per anchor; o, t name the document and v packs the place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            o, t = batch.column("o").to_numpy(), batch.column("t").to_numpy()
            for a, b in grouped(texts):
                doc, h, at, first, last = anchors(texts[a:b])
                if not len(doc):
                    continue
                o_, t_ = o[a:b][doc], t[a:b][doc]
                v = at << AT | first << FIRST | last << FINAL
                order = np.argsort(h, kind="stable")
                h, o_, t_, v = h[order], o_[order], t_[order], v[order]
                new = np.ones(len(h), bool)
                new[1:] = h[1:] != h[:-1]
                begin = np.flatnonzero(new)
                count = np.diff(np.append(begin, len(h)))
                common = np.repeat(count > LOCAL, count)
                if common.any():
                    marks = h[begin[count > LOCAL]]
                    rank = np.arange(len(h)) - np.repeat(begin, count)
                    salt = np.repeat(begin, count) + rank // CHUNK * CHUNK
                    salt = o_[salt].view(np.uint64) * np.uint64(31) + t_[salt].astype(np.int64).view(np.uint64) + v[salt].view(np.uint64)
                    h = np.where(common, mix(h + mix(salt)), h)
                    v = v | common
                    h, o_, t_, v = (np.concatenate([x, y]) for x, y in ((h, marks), (o_, np.zeros(len(marks), np.int64)), (t_, np.zeros(len(marks), np.int64)), (v, np.full(len(marks), -1))))
                yield pa.RecordBatch.from_arrays([_signed(h), pa.array(o_), pa.array(t_), pa.array(v)], names=["h", "o", "t", "v"])

    return docs.select("o", "t", "text").mapInArrow(run, "h long, o long, t long, v long")


def repeated(found: DataFrame) -> DataFrame:
    """(o, t, v, g) of anchors whose hash is met again; g is their group, cut every CHUNK."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gone = None, 0  # rows of the group that may go on, and how many of it went before

        def give(rows: np.ndarray, before: int) -> pa.RecordBatch:
            new = np.ones(rows.shape[1], bool)
            new[1:] = rows[0, 1:] != rows[0, :-1]
            begin = np.flatnonzero(new)
            count = np.diff(np.append(begin, rows.shape[1]))
            marked = np.logical_or.reduceat(rows[3] == -1, begin)
            much = count.copy()
            much[0] += before
            rank = np.arange(rows.shape[1]) - np.repeat(begin, count)
            rank[: count[0]] += before
            cut = np.repeat(marked | (much > CHUNK), count)
            keep = (np.repeat(much > 1, count) | (rows[3] & 1 == 1)) & (rows[3] != -1)
            g = mix(rows[0].view(np.uint64) + (rank // CHUNK).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            return pa.RecordBatch.from_arrays([pa.array(rows[1][keep]), pa.array(rows[2][keep]), pa.array((rows[3] | cut)[keep]), _signed(g[keep])], names=["o", "t", "v", "g"])

        for batch in batches:
            rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])
            rows = rows if held is None else np.concatenate([held, rows], axis=1)
            change = np.flatnonzero(rows[0, 1:] != rows[0, :-1])
            at = int(change[-1]) + 1 if len(change) else 0
            if at:
                yield give(rows[:, :at], gone)
                gone = 0
            if (rows.shape[1] - at) > 2 * CHUNK:
                upto = at + (rows.shape[1] - at) // CHUNK * CHUNK - CHUNK
                part = rows[:, at:upto].copy()
                part[3] = np.where(part[3] == -1, -1, part[3] | 1)
                yield give(part, gone)
                gone += upto - at
                at = upto
            held = rows[:, at:]
        if held is not None and held.shape[1]:
            yield give(held, gone)

    return found.repartition("h").sortWithinPartitions("h").mapInArrow(run, "o long, t long, v long, g long")


def stretches(docs: DataFrame, dups: DataFrame) -> DataFrame:
    """(g, o, t, v, bytes): the text that the windows of each repeated anchor cover."""
    lists = dups.groupBy("o", "t").agg(F.collect_list("v").alias("vs"), F.collect_list("g").alias("gs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(5)]
            size = 0
            for o, t, text, vs, gs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                for v, g in zip(vs, gs, strict=True):
                    at = v >> AT
                    cut = raw[at - (v >> FIRST & 127) : at - (v >> FINAL & 127) + WIDTH]
                    for column, value in zip(out, (g, o, t, v, cut), strict=True):
                        column.append(value)
                    size += len(cut)
                if size > GROUP_BYTES:
                    yield _rows(out)
                    out, size = [[] for _ in range(5)], 0
            yield _rows(out)

    def _rows(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["g", "o", "t", "v", "bytes"])

    return docs.select("o", "t", "text").join(lists, ["o", "t"]).select("o", "t", "text", "vs", "gs").mapInArrow(run, "g long, o long, t long, v long, bytes binary")


def compare(g: np.ndarray, o: np.ndarray, t: np.ndarray, v: np.ndarray, parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of stretches, sorted by (g, o, t, v): (stretch, windows before the anchor, removed,
    group is cut) of every window. Windows of whole stretches that repeat an earlier one
    of the group are removed at once; the others are sorted as suffixes."""
    first, last = v >> FIRST & 127, v >> FINAL & 127
    size = np.array([len(p) for p in parts], np.int64)
    base = np.cumsum(size) - size
    data = np.frombuffer(b"".join(parts) + bytes(WIDTH), np.uint8)
    hashes = Hashes(data)
    whole = hashes.of(base, size)
    # equal stretches: the earliest of each stands for the others
    order = np.lexsort((np.arange(len(g)), whole, v & 0xFFFC, g))
    same = np.zeros(len(g), bool)
    a, b = order[1:], order[:-1]
    same[1:] = (g[a] == g[b]) & (v[a] & 0xFFFC == v[b] & 0xFFFC) & (whole[a] == whole[b])
    leader = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(g))))]
    stands = np.empty(len(g), np.int64)
    stands[order] = leader
    me = np.arange(len(g))
    later = (o > o[stands]) | ((o == o[stands]) & (t == t[stands]) & (v >> AT > v[stands] >> AT))
    copy = np.flatnonzero((stands != me) & later)
    copy = copy[[parts[i] == parts[j] for i, j in zip(copy.tolist(), stands[copy].tolist(), strict=True)]] if len(copy) else copy
    left = np.ones(len(g), bool)
    left[copy] = False

    def windows(who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = (first - last + 1)[who]
        i = np.repeat(who, n)
        return i, first[i] - (np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n))

    i, before = windows(np.flatnonzero(left))
    order = np.lexsort((i, before, g[i]))
    i, before = i[order], before[order]
    new = np.ones(len(i), bool)
    new[1:] = (g[i][1:] != g[i][:-1]) | (before[1:] != before[:-1])
    group = np.cumsum(new)
    alone = np.ones(len(i), bool)
    alone[1:] &= new[1:]
    alone[:-1] &= new[1:]
    some = np.flatnonzero(~alone)
    gone = np.zeros(len(i), bool)
    if len(some):
        starts, sub = (base[i] + first[i] - before)[some], group[some]
        order = sort_suffixes(data, hashes, starts, sub, WIDTH)
        equal = equal_to_previous(data, hashes, starts[order], sub[order], WIDTH)
        at = i[some][order]
        head = np.maximum.accumulate(np.where(equal, 0, np.arange(len(at))))
        row = np.ones(len(at), bool)
        row[1:] = ~(equal[1:] & (o[at][1:] == o[at][:-1]) & (t[at][1:] == t[at][:-1]))
        own = np.maximum.accumulate(np.where(row, np.arange(len(at)), 0))
        gone[some[order]] = (o[at] > o[at[head]]) | (v[at] >> AT > v[at[own]] >> AT)
    j, before_j = windows(copy)
    return np.concatenate([i, j]), np.concatenate([before, before_j]), np.concatenate([gone, np.ones(len(j), bool)])


def spans(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the windows' bytes, per document number: (document, start, end)."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + WIDTH)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], start[last] + WIDTH if len(doc) else start


def removed(pieces: DataFrame) -> DataFrame:
    """(o, t, a, b, w, starts, digests): stretches to remove (w null) and, of cut groups,
    the windows that are first in their chunk: the MD5 of each, for every BAND places
    about the anchor together, and in w that of what the windows of a band share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            g = table.column("g").to_numpy()
            change = np.flatnonzero(g[1:] != g[:-1])
            at = int(change[-1]) + 1 if len(change) else 0
            if at and table.slice(0, at).nbytes >= GROUP_BYTES:
                yield from _groups(table.slice(0, at))
                table = table.slice(at)
            held = table.combine_chunks()
        if held is not None and held.num_rows:
            yield from _groups(held)

    def _groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
        g, o, t, v = (table.column(n).to_numpy() for n in ("g", "o", "t", "v"))
        ends = np.append(np.flatnonzero(g[1:] != g[:-1]) + 1, len(g))
        bytes_upto = np.cumsum(pc.binary_length(table.column("bytes")).to_numpy())
        a = 0
        while a < len(g):  # whole groups, about GROUP_BYTES at a time
            limit = (bytes_upto[a - 1] if a else 0) + GROUP_BYTES
            k = int(np.searchsorted(bytes_upto[ends - 1], limit))
            b = int(ends[min(k, len(ends) - 1)])
            order = a + np.lexsort((v[a:b], t[a:b], o[a:b], g[a:b]))
            yield _result(g[order], o[order], t[order].astype(np.int64), v[order], table.column("bytes").take(pa.array(order)).to_pylist())
            a = b

    def _result(g, o, t, v, parts) -> pa.RecordBatch:
        i, before, gone = compare(g, o, t, v, parts)
        start = (v >> AT)[i] - before
        key = np.stack([o, t])
        order = np.lexsort((t, o))
        number = np.empty(len(o), np.int64)
        change = np.ones(len(o), bool)
        change[1:] = (key[:, order][:, 1:] != key[:, order][:, :-1]).any(0)
        number[order] = np.cumsum(change) - 1
        rows = order[np.flatnonzero(change)]
        doc, a, b = spans(number[i[gone]], start[gone])
        doc = rows[doc]
        rows_ = [(int(o[d]), int(t[d]), x, y, None, None, None) for d, x, y in zip(doc.tolist(), a.tolist(), b.tolist(), strict=True)]
        open_ = np.flatnonzero(~gone & (v[i] & 1 == 1))
        bands: dict[tuple[int, int], list[int]] = {}
        for k in open_.tolist():
            bands.setdefault((int(i[k]), int(before[k]) // BAND), []).append(k)
        for (x, band), ks in bands.items():
            at = int(v[x] >> FIRST & 127)
            common = parts[x][at - BAND * band : at - BAND * band - BAND + 1 + WIDTH]
            digests = [hashlib.md5(parts[x][at - n : at - n + WIDTH]).digest() for n in before[ks].tolist()]
            rows_.append((int(o[x]), int(t[x]), None, None, hashlib.md5(common).digest() + bytes([band]), start[ks].tolist(), digests))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows_], k) for c, k in enumerate(kinds)], names=["o", "t", "a", "b", "w", "starts", "digests"])

    return pieces.repartition("g").sortWithinPartitions("g").mapInArrow(run, "o long, t long, a long, b long, w binary, starts array<long>, digests array<binary>")


def repeated_spans(docs: DataFrame, order: Column, text: Column) -> DataFrame:
    """(o, t, spans): what to remove of each document, o the place in the order of ids
    (order: a long) and t a 64-bit hash of the text, which tells rows of one id or none apart."""
    base = docs.select(order.alias("o"), F.xxhash64(text).alias("t"), text.alias("text"))
    known = base.select("o", "t", F.md5("text").alias("m"), F.octet_length("text").cast("long").alias("n")).filter(F.col("n") >= WIDTH)
    least = known.groupBy("m").agg(F.min("o").alias("first"), F.count("*").alias("many")).filter("many > 1")
    copies = written(known.join(least, "m").filter("o > first").select("o", "t", "n").distinct(), "copies")
    rest = base.filter(F.octet_length("text") >= WIDTH).join(copies, ["o", "t"], "left_anti")
    dups = written(repeated(find_anchors(rest)), "anchors")
    released(docs.sparkSession)
    pieces = removed(stretches(base, dups))
    found = written(pieces, "found")
    released(docs.sparkSession)
    cut = found.filter("w IS NOT NULL").select("o", "t", "w", "starts", "digests")
    met = cut.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").select("w")
    cut = cut.join(met, "w").select("o", "t", F.explode(F.arrays_zip("starts", "digests")).alias("x")).select("o", "t", F.col("x.starts").alias("a"), F.col("x.digests").alias("w"))
    cut = written(cut, "windows")
    own = cut.groupBy("w", "o", "t").agg(F.min("a").alias("own"))
    first = own.groupBy("w").agg(F.min("o").alias("first"))
    again = cut.join(own, ["w", "o", "t"]).join(first, "w").filter("o > first OR a > own").select("o", "t", "a", (F.col("a") + WIDTH).alias("b"))
    gone = found.filter("w IS NULL").select("o", "t", "a", "b").unionByName(again).unionByName(copies.select("o", "t", F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))
    return gone.groupBy("o", "t").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def union(found: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _joined(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    text = F.coalesce(F.col(text_col), F.lit(""))
    gone = repeated_spans(docs, order, text)
    rows = docs.select(order.alias("o"), F.xxhash64(text).alias("t"), text.alias("_text"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)])
    return rows.join(gone, ["o", "t"], "left").select("_text", "spans", *[f"c{k}" for k in range(len(carry))])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    joined = _joined(docs, id_col, text_col, [id_col])
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(4)]
            for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw, gone = text.encode(), union(found or [])
                keep = hashlib.sha256()
                at = 0
                for a, b in gone:
                    keep.update(raw[at:a])
                    at = b
                keep.update(raw[at:])
                for column, value in zip(out, (len(raw), sum(b - a for a, b in gone), len(gone), keep.hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(2), *[pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with repeated stretches cut out; what that leaves broken of a
    character goes too. Documents without any text left go; n_chars follows the text."""
    columns = docs.columns
    carry = [c for c in columns if c != text_col]
    joined = _joined(docs, id_col, text_col, carry)
    schema = docs.select(text_col).schema
    types = [to_arrow_type(f.dataType) for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep, texts = [], []
            for row, (text, found) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if found:
                    raw, at, parts = text.encode(), 0, []
                    for a, b in union(found):
                        parts.append(raw[at:a].decode(errors="ignore"))
                        at = b
                    text = "".join([*parts, raw[at:].decode(errors="ignore")])
                    if not text.strip():
                        continue
                keep.append(row)
                texts.append(text)
            out = []
            for k, c in enumerate(columns):
                if c == text_col:
                    out.append(pa.array(texts, pa.string()))
                elif c == n_chars_col:
                    out.append(pa.array([len(t) for t in texts], types[k]))
                else:
                    out.append(batch.column(2 + carry.index(c)).take(pa.array(keep, pa.int64())))
            yield pa.RecordBatch.from_arrays(out, names=columns)

    assert len(schema) == 1
    return joined.mapInArrow(run, docs.schema)
