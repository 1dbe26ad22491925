import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluice.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "Hello  World's IT'S 123", "ΑΣ Σ İ ß ẞ ǅ", "<|endoftext|>foo<|startoftext|> <|end", "é å", "a" * 300 + "'s" * 100, " x\x85y　z", "日本語 😀👍🏽", "\x1c\x1f\x00"]


def library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def test_same_as_library_on_odd_texts():
    for text, (raw, decoded) in zip(ODD, bpe.load(PATH).encode_batch(ODD), strict=True):
        assert (np.frombuffer(raw, "<u4").tolist(), decoded.decode()) == library(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbeïñ'stT19 \n\t,.!#|<>"), max_size=90))
def test_same_as_library(text):
    (raw, decoded), = bpe.load(PATH).encode_batch([text])
    assert (np.frombuffer(raw, "<u4").tolist(), decoded.decode()) == library(text)


def test_documents(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "some words here", "x"), (3, "some words here", "y"), (None, "null id", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.encode_documents(df, PATH, full=True).collect()
    assert len(out) == 5
    for r in out:
        text = next(t or "" for i, t, _ in rows if i == r.doc_id)
        ids, decoded = library(text)
        assert (r.ids, r.decoded, r.n_tokens) == (ids, decoded, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_documents(df.limit(0), PATH).count() == 0
