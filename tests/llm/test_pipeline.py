import gc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sluice.llm import common, langid, near_copies, quality, suffix_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("steps") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_and_rejects(steps):
    names = [{c.lower() for c in s.columns} for s in steps]
    assert all(n == names[0] for n in names[1:5])
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps]
    for before, after in zip(ids, ids[1:]):
        assert after <= before
    assert len(ids[1]) >= 0.9 * len(ids[0]) and len(ids[2]) >= 0.4 * len(ids[1])


def test_near_duplicates_by_the_jaccard_of_all_pairs(steps):
    """No two that stay are near copies; each that goes is one of an earlier document."""
    sets = {r.doc_id: frozenset(near_copies.shingles(near_copies.words_of(r.text))) for r in steps[2].collect()}
    kept = sorted(r.doc_id for r in steps[3].select("doc_id").collect())
    alike = lambda a, b: near_copies.jaccard(sets[a], sets[b]) >= near_copies.SIMILAR
    assert not any(alike(a, b) for k, b in enumerate(kept) for a in kept[:k])
    assert all(any(alike(a, b) for a in sets if a < b) for b in sets if b not in set(kept))


def test_no_repeats_are_left_of_the_input(steps):
    w = suffix_dedup.WIDTH
    least = {}
    for r in sorted(steps[3].collect(), key=lambda r: r.doc_id):
        raw = (r.text or "").encode()
        for k in range(len(raw) - w + 1):
            least.setdefault(raw[k : k + w], (r.doc_id, k))
    kept = {r.doc_id: r for r in steps[4].collect()}
    for r in steps[3].collect():
        raw = (r.text or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - w + 1):
            if least[raw[k : k + w]] != (r.doc_id, k):
                gone[k : k + w] = True
        want = bytes(np.frombuffer(raw, np.uint8)[~gone]).decode(errors="ignore")
        if gone.any() and not want.strip():
            assert r.doc_id not in kept
        elif kept[r.doc_id].text != want:  # characters that a cut breaks go
            assert gone.any() and len(want) - len(kept[r.doc_id].text) < 8
        assert r.doc_id not in kept or kept[r.doc_id].n_chars == len(kept[r.doc_id].text or "")


def test_packing(steps):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [0] for r in steps[4].collect()}
    place, size = {}, Counter()
    for r in steps[5].collect():
        ids = np.array(texts[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(ids) == r.ids_crc32
        place[r.sequence_id, r.offset] = r.length
        size[r.sequence_id] += r.length
    assert sum(size.values()) == sum(map(len, texts.values())) and max(size.values()) <= 2048
    for (s, at), n in place.items():
        assert at + n == size[s] or (s, at + n) in place


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_near_duplicates_go_by_fingerprints_first(spark):
    """op8's groups lead to copies, which are verified: empty texts and those of one fingerprint but of other words stay."""
    text = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(1, text), (2, text.upper()), (3, text + " more"), (4, ""), (5, "q r s"), (None, text)], "doc_id long, text string")
    asked = []

    def verify(rows, pairs, id_col, text_col):
        asked.extend(sorted(tuple(r) for r in pairs.collect()))
        return near_copies.copies_of(rows, pairs, id_col, text_col)

    kept = corpus_pipeline.simhash.keep_one(docs, verify=verify)
    assert (1, 2) in asked
    assert {1, 4, 5, None} <= {r.doc_id for r in kept.collect()} and 2 not in {r.doc_id for r in kept.collect()}
    wrong = spark.createDataFrame([(1, 2), (1, 3), (1, 5)], "first long, other long")
    assert {r.other for r in near_copies.copies_of(docs, wrong).collect()} == {2, 3}


def test_a_large_batch_is_worked_on_in_slices(spark):
    """Texts are carried once, and no more rows than PART are decoded or given back at once."""
    seen = {}

    class Frame:
        """As much of a data frame as predict and score ask for; keeps what they send to Python."""

        sparkSession = spark

        def __init__(self, df):
            self.df, self.columns, self.schema = df, df.columns, df.schema

        def select(self, *columns):
            return Frame(self.df.select(*columns))

        def mapInArrow(self, run, schema):
            seen.update(columns=self.columns, run=run)

    df = spark.createDataFrame([(1, "a", "b c")], "i long, l string, t string")
    n = 3 * common.PART + 5
    sent = {"i": pa.array(range(n)), "l": pa.array(["x"] * n), "t": pa.array(["b c"] * n)}
    for step in (langid.predict, quality.score):
        step(Frame(df), None, text_col="t", id_col="i", carry=["l", "t"])
        assert seen["columns"] == ["i", "l", "t"]
        out = list(seen["run"](iter([pa.RecordBatch.from_pydict(sent)])))
        assert max(b.num_rows for b in out) <= common.PART
        assert [i for b in out for i in b.column(0).to_pylist()] == list(range(n))
        assert all(b.column(2).to_pylist() == ["b c"] * b.num_rows for b in out)
        assert gc.isenabled()
