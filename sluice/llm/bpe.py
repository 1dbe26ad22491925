"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Leaf i of the tree holds the rank of the pair (symbol i, next live symbol), or
NONE where it can't merge. The root is the lowest rank; walking down, left first
on ties, gives the leftmost such pair. A merge changes three leaves (the merged
pair, its left neighbour, the symbol that went), each mended in log(n) steps,
until the root is NONE. Short words of a batch are merged side by side with one
tree per row of a matrix; a long word has a tree of its own.

Texts: NFC, white space to blanks, lower case by code point, then the vocabulary's
own split into contractions, letter runs, single digits and other runs. Null and
empty texts give no ids. The strings of special tokens give their ids, as in the
tokenizers library. Works text by text: repeated rows give equal results, an
empty table an empty result, and further columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

NONE = np.iinfo(np.int32).max
# White space other than the blank, as the vocabulary's normaliser has it.
OTHER_SPACE = re.compile("[\t-\r\x85\xa0  -     　]")
WORD_END = "</w>"
ROW_LIMIT = 64
CACHE_WORDS = 200_000
GROUP_CHARS = 2_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class PairRanks:
    """Rank and merged symbol of a pair of symbols, looked up for whole arrays by
    open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, size: int):
        self.width = np.int64(size)
        self.merged = merged.astype(np.int32)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 8))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NONE, np.int32)
        keys = left.astype(np.int64) * self.width + right
        order, keys = np.unique(keys, return_index=True)[1], keys
        slot = self._slot(keys)
        left_over = order
        while len(left_over):
            s = slot[left_over]
            free = self.keys[s] < 0
            first = np.zeros(len(s), bool)
            first[np.unique(s, return_index=True)[1]] = True
            put = free & first
            self.keys[s[put]] = keys[left_over[put]]
            self.rank[s[put]] = left_over[put]
            left_over = left_over[~put]
            slot[left_over] = (slot[left_over] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.width + right
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero(keys >= 0)
        while len(todo):
            s = slot[todo]
            there = self.keys[s]
            hit = there == keys[todo]
            out[todo[hit]] = self.rank[s[hit]]
            todo = todo[~hit & (there >= 0)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out


def merge_rows(symbols: np.ndarray, ranks: PairRanks) -> np.ndarray:
    """Merges each row (symbols, then -1) with a segment tree of its own; the
    symbols that went are -1 in the result."""
    n, width = symbols.shape
    size = 1 << max(1, (width - 1).bit_length())
    sym = np.full((n, size + 1), -1, np.int32)  # the last column stands for "no neighbour"
    sym[:, :width] = symbols
    after = np.tile(np.arange(1, size + 2, dtype=np.int32), (n, 1))
    before = np.tile(np.arange(-1, size, dtype=np.int32), (n, 1))
    before[:, 0] = size
    tree = [np.full((n, size), NONE, np.int32)]
    tree[0][:, : size - 1] = ranks(sym[:, : size - 1].ravel(), sym[:, 1:size].ravel()).reshape(n, size - 1)
    while tree[-1].shape[1] > 1:
        tree.append(np.minimum(tree[-1][:, ::2], tree[-1][:, 1::2]))
    rows = np.flatnonzero(tree[-1][:, 0] != NONE)
    while len(rows):
        at = np.zeros(len(rows), np.int64)
        for level in tree[-2::-1]:
            at *= 2
            at += level[rows, at] > level[rows, at + 1]
        went = after[rows, at]
        following = np.minimum(after[rows, went], size)
        sym[rows, at] = merged = ranks.merged[tree[0][rows, at]]
        sym[rows, went] = -1
        after[rows, at] = following
        inside = following < size
        before[rows[inside], following[inside]] = at[inside]
        ahead = before[rows, at]
        tree[0][rows, went] = NONE
        tree[0][rows, at] = ranks(merged, sym[rows, following])
        has = np.flatnonzero(ahead < size)
        tree[0][rows[has], ahead[has]] = ranks(sym[rows[has], ahead[has]], merged[has])
        for changed, who in ((went, rows), (at, rows), (ahead[has], rows[has])):
            node = changed.astype(np.int64)
            for below, level in zip(tree, tree[1:], strict=False):
                node >>= 1
                level[who, node] = np.minimum(below[who, 2 * node], below[who, 2 * node + 1])
        rows = rows[tree[-1][rows, 0] != NONE]
    return sym[:, :width]


def merge_long(symbols: list[int], rank_of: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """One word with one segment tree: n log n for any length."""
    n = len(symbols)
    size = 1 << max(1, (n - 1).bit_length())
    tree = [NONE] * (2 * size)
    none = (NONE, 0)
    for i in range(n - 1):
        tree[size + i] = rank_of.get((symbols[i], symbols[i + 1]), none)[0]
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    sym, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, rank: int) -> None:
        node = size + i
        tree[node] = rank
        while node > 1:
            node >>= 1
            low = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == low:
                return
            tree[node] = low

    while tree[1] != NONE:
        node = 1
        while node < size:
            node *= 2
            if tree[node] > tree[node + 1]:
                node += 1
        i = node - size
        j = after[i]
        k = after[j]
        sym[i] = rank_of[sym[i], sym[j]][1]
        sym[j] = -1
        after[i] = k
        if k < n:
            before[k] = i
        put(j, NONE)
        put(i, rank_of.get((sym[i], sym[k]), none)[0] if k < n else NONE)
        if before[i] >= 0:
            put(before[i], rank_of.get((sym[before[i]], sym[i]), none)[0])
    return [s for s in sym if s >= 0]


class WordBpe:
    """The vocabulary of a tokenizers file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        left, right, merged = (np.array([vocab[x] for x in xs], np.int64) for xs in zip(*[(a, b, a + b) for a, b in pairs], strict=True))
        self.ranks = PairRanks(left, right, merged, max(self.token) + 1)
        self.rank_of = {(a, b): (i, m) for i, (a, b, m) in reversed([*enumerate(zip(left.tolist(), right.tolist(), merged.tolist(), strict=True))])}
        self.inner = np.array([vocab[c] for c in byte_symbols()], np.int32)
        self.final = np.array([vocab[c + WORD_END] for c in byte_symbols()], np.int32)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        space = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
        self.words = regex.compile(split["pattern"]["Regex"].replace("\\s", space))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.token_bytes = {i: t.encode() for i, t in self.token.items()}
        self.forget()

    def forget(self) -> None:
        """Empties the caches, which bounds them."""
        self.word: dict[str, tuple[bytes, bytes]] = {}
        self.ids: dict[str, bytes] = {"": b""}
        self.decoded: dict[str, bytes] = {"": b""}

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return OTHER_SPACE.sub(" ", text).lower()

    def parts(self, text: str) -> list[str]:
        """Stretches between blanks; a special token's string is a part of its own,
        marked by a leading blank."""
        if self.specials is None or "<" not in text:
            return self.normal(text).split(" ")
        found: list[str] = []
        for piece in self.specials.split(text):
            found += [f" {piece}"] if piece in self.special else self.normal(piece).split(" ")
        return found

    def learn(self, parts: set[str]) -> None:
        """Encodes parts that haven't been met before."""
        find = self.words.findall
        cut = {p: (p,) if p.isalpha() else find(p) for p in parts if p[:1] != " "}
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for w in {w for ws in cut.values() for w in ws if w not in self.word}:
            raw = w.encode()
            if len(raw) > ROW_LIMIT:
                ids = merge_long([*self.inner[list(raw[:-1])].tolist(), int(self.final[raw[-1]])], self.rank_of)
                self.word[w] = np.array(ids, "<u4").tobytes(), self.decode(ids).encode()
            else:
                by_width.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), []).append((w, raw))
        for width, ws in by_width.items():
            for i in range(0, len(ws), 1 << 14):
                self._learn_rows(ws[i : i + (1 << 14)], width)
        for p in parts:
            if p[:1] == " ":
                found = [(np.array([self.special[p[1:]]], "<u4").tobytes(), p[1:].encode())]
            else:
                found = [self.word[w] for w in cut[p]]
            if len(found) == 1:
                self.ids[p], self.decoded[p] = found[0]
            else:
                self.ids[p], self.decoded[p] = b"".join([x for x, _ in found]), b" ".join([x for _, x in found])

    def _learn_rows(self, block: list[tuple[str, bytes]], width: int) -> None:
        size = np.fromiter((len(raw) for _, raw in block), np.int64, len(block))
        flat = np.frombuffer(b"".join([raw.ljust(width, b"\0") for _, raw in block]), np.uint8).reshape(len(block), width)
        symbols = np.where(np.arange(width) < size[:, None], self.inner[flat], -1)
        each = np.arange(len(block))
        symbols[each, size - 1] = self.final[flat[each, size - 1]]
        out = merge_rows(symbols, self.ranks)
        live = out >= 0
        ids = out[live].astype("<u4")
        raw_ids, tokens = ids.tobytes(), [*map(self.token_bytes.__getitem__, ids.tolist())]
        start = 0
        for (w, _), end in zip(block, np.cumsum(live.sum(1)).tolist(), strict=True):
            self.word[w] = raw_ids[4 * start : 4 * end], b" ".join(tokens[start:end])
            start = end

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks: the vocabulary names no decoder."""
        return " ".join(map(self.token.__getitem__, ids))

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """Ids as little-endian unsigned 32-bit integers and the decoded UTF-8 text."""
        group: list[list[str]] = []
        chars = 0
        for text in texts:
            group.append(self.parts(text or ""))
            chars += len(text or "")
            if chars >= GROUP_CHARS:
                yield from self._finish(group)
                group, chars = [], 0
        yield from self._finish(group)

    def _finish(self, group: list[list[str]]) -> Iterator[tuple[bytes, bytes]]:
        if len(self.ids) > CACHE_WORDS:
            self.forget()
        known = self.ids
        if missing := {p for parts in group for p in parts if p not in known}:
            self.learn(missing)
        for parts in group:
            yield b"".join(map(self.ids.__getitem__, parts)), b" ".join(filter(None, map(self.decoded.__getitem__, parts)))


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """Per document: n_tokens and digests of ids and decoded text; with full, also
    ids (array<int>) and decoded (string). Map-only: no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    extra = ", ids array<int>, decoded string" if full else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        gc.disable()  # the caches hold many small objects and no cycles
        for batch in batches:
            n, ids_hex, text_hex, ids, texts = [], [], [], [], []
            for raw, text in bpe.encode_batch(batch.column(1).to_pylist()):
                n.append(len(raw) // 4)
                ids_hex.append(hashlib.sha256(raw).hexdigest())
                text_hex.append(hashlib.sha256(text).hexdigest())
                if full:
                    ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
                    texts.append(text.decode())
            out = {"id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_hex, pa.string()), "decoded_sha256": pa.array(text_hex, pa.string())}
            if full:
                out |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict({id_col if k == "id" else k: v for k, v in out.items()})

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
