import struct
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riftline.llm.common import TEXT_BYTES, in_portions
from riftline.llm.packing import pack, places, plan
from riftline.llm.token_counts import count_tokens, prove_whole_tokens
from riftline.llm.wordbpe import merger, vocabulary_path

PATH = vocabulary_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_the_library_s(text):
    ids = merger(PATH).whole(text)
    assert merger(PATH).packed(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_proven_tokens_are_one_token(library):
    proven = prove_whole_tokens(PATH)
    assert len(proven) > 10_000
    some = [p for p in proven if p.isascii() and p.isalpha()][::500]
    assert all(len(library.encode(p, add_special_tokens=False).ids) == 1 for p in some)


def test_counts(spark, documents, odd_texts, library):
    got = {r["doc_id"]: r for r in count_tokens(documents(odd_texts), PATH).collect()}
    for k, text in enumerate(odd_texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[k]["n_tokens"], got[k]["n_bytes"], got[k]["over_limit"]) == (n, len((text or "").encode()), n > 2048)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 30), max_size=30))
def test_plan_places_everything_within_capacity(histogram):
    patterns = plan(histogram, 100)
    placed = {}
    for pattern, n in patterns:
        assert sum(s * c for s, c in pattern) <= 100 and sum(c for s, c in pattern if 3 * s > 100) <= 2
        for s, c in pattern:
            placed[s] = placed.get(s, 0) + c * n
    assert placed == histogram
    where = places(patterns)
    assert (where["begin"] >= 0).all()


def test_pack(spark, documents, odd_texts, library):
    texts = [*odd_texts, *("some words of text " * k for k in range(1, 60))]
    rows = pack(documents(texts), PATH).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for k, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[k], key=lambda r: r["piece"])
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == 2048 for r in own[:-1])
        for n, r in enumerate(own):
            part = ids[r["start"] : r["start"] + r["length"]]
            assert (r["piece"], r["start"], r["ids_crc32"]) == (n, n * 2048, zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    bins = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == bins.get(r["sequence_id"], 0)
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= 2048 and len(bins) <= 1.1 * sum(bins.values()) / 2048 + 1


def test_empty_table(spark, documents):
    assert pack(documents([]), PATH).count() == 0
    assert count_tokens(documents([]), PATH).count() == 0


def test_texts_reach_a_worker_in_bounded_portions():
    """Every row once and in order; beside its longest text, which stays whole, a portion is bounded in bytes."""
    texts = ["x" * 1000] * 5000 + [None, ""] * 50 + ["y" * 3 * TEXT_BYTES, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    portions = list(in_portions(iter([batch, batch.slice(0, 0), batch.slice(7, 3)])))
    assert [i for p in portions for i in p.column("doc_id").to_pylist()] == [*range(len(texts)), 7, 8, 9]
    assert [t for p in portions for t in p.column("text").to_pylist()] == [*texts, *texts[7:10]]
    sizes = [[len(t or "") for t in p.column("text").to_pylist()] for p in portions]
    assert len(portions) > 3 and all(sum(s) - max(s) <= TEXT_BYTES for s in sizes)
