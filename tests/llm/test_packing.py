import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluice.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 9), max_size=20))
def test_plan_uses_every_length_and_fits(histogram):
    used = Counter()
    for lengths, times in packing.plan(histogram, 64)[0]:
        assert sum(lengths) <= 64
        for n in lengths:
            used[n] += times
    assert used == Counter(histogram)


def test_plan_near_lower_bound():
    rng = np.random.default_rng(3)
    histogram = Counter(np.minimum(2048, rng.lognormal(6.3, 1.0, 30_000).astype(int) + 1).tolist())
    total = sum(k * v for k, v in histogram.items())
    planned, program = packing.plan(dict(histogram), 2048)
    assert sum(t for _, t in planned) <= 1.002 * total / 2048 + 1
    assert sum(t for _, t in planned[:program]) > 0.7 * sum(t for _, t in planned)


def test_the_program_packs_scarce_lengths():
    """Lengths of which there are only a few: most uses are below one and must be rounded."""
    rng = np.random.default_rng(4)
    histogram = Counter(rng.integers(1, 2049, 2500).tolist())
    planned, program = packing.plan(dict(histogram), 2048)
    several = [(len(lengths) > 1, times) for lengths, times in planned]
    assert sum(t for many, t in several[:program] if many) > 0.5 * sum(t for many, t in several if many)
    # a first-fit packing of the same lengths, plainly
    room: list[int] = []
    for n in sorted(histogram.elements(), reverse=True):
        at = next((i for i, r in enumerate(room) if r >= n), None)
        if at is None:
            room.append(2048 - n)
        else:
            room[at] -= n
    assert sum(t for _, t in planned) <= 1.02 * len(room)


def test_pieces_and_places(spark):
    texts = [None, "", "a few words", "a few words", "x <|endoftext|> y", "word " * 5000, "  two  blanks \n ", "日本 😀"] + [f"text {i} " * (i % 37) for i in range(300)]
    rows = [(i // 2 * 2, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    out = packing.pack_documents(df, PATH, public_tokenizers.PATTERN, full=True).collect()
    want = Counter()
    for i, t, _ in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids + [0]
        for no, (a, n) in enumerate(packing.cut(len(ids), 2048)):
            want[i, no, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()), tuple(ids[a : a + n])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in out)
    assert len(by) <= total / 2048 * 1.05 + 1
    assert packing.pack_documents(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
