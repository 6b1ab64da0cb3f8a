"""Removal of repeated byte strings against a table of all strings, the suffix sort, and their edges."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from riftline.llm.repeats import GRAM, REACH, SPAN, anchors_in, without_repeats
from riftline.llm.suffixes import Hashes, Suffixes, classes

SCHEMA = "doc_id long, text string"


def by_hand(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by looking every string of SPAN bytes up, in order of id and text."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (text or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - SPAN + 1):
            piece = b[k : k + SPAN]
            if piece in seen:
                gone[k : k + SPAN] = True
            seen.add(piece)
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def found(df):
    return Counter(tuple(r) for r in df.collect())


def corpus(seed, n=60):
    """Passages, near copies, copies, periodic texts, passages of just below and above SPAN bytes, other scripts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé日 ") for _ in range(rng.randint(1, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(rng.randint(10, 40)) for _ in range(4)] + [prose(60).encode()[:k].decode(errors="ignore") for k in (97, 98, 99, 100, 101, 103, 131, 132, 133)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and texts:
            old = rng.choice(texts)
            at = rng.randint(0, len(old))
            texts.append(old[:at] + rng.choice(["", "X", prose(3)]) + old[at + rng.randint(0, 3) :])
        elif kind < 0.25:
            texts.append(rng.choice(["ab", "x", prose(8)]) * rng.randint(60, 200))
        elif kind < 0.35:
            texts.append(prose(rng.randint(0, 12)))
        else:
            texts.append("".join(rng.choice([prose(rng.randint(0, 30)), rng.choice(passages)]) for _ in range(rng.randint(1, 5))))
    return texts


@pytest.mark.parametrize(("seed", "most"), [(1, 1 << 16), (2, 1 << 16), (3, 2), (4, 0)])
def test_equals_a_table_of_all_strings(spark, seed, most):
    rows = [(3 * k - 20, t) for k, t in enumerate(corpus(seed))]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(without_repeats(df, most=most)) == by_hand(rows)


def test_odd_rows(spark):
    long = "".join(random.Random(0).choices("abcdefgh ", k=400))
    rows = [(None, long), (2**53 + 1, long), (2**53 + 2, long), (5, None), (6, ""), (7, "\x00" * 250), (8, "short")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS tie", "2 AS copies", "3 AS at", "4 AS gram", "5 AS start", "6 AS spans")
    assert found(without_repeats(df)) == by_hand(rows)
    again = spark.createDataFrame([(1, long), (1, long), (1, "short"), (1, "short"), (None, long + "!"), (1, "other " + long)], SCHEMA)
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in without_repeats(again).collect())
    assert got == [(0, 401, 0), (1, 5, 0), (1, 5, 0), (1, 400, 400), (1, 400, 400), (1, 406, 400)]
    kept = without_repeats(df, with_bytes=True).where("doc_id = 7").first()["kept"]
    assert bytes(kept) == b"\x00"
    assert without_repeats(df.where("doc_id = 99")).count() == 0


def test_anchors_of_slices_are_those_of_the_whole():
    rng = random.Random(4)
    texts = [bytes(rng.choices(b"abcd", k=n)) for n in (0, 31, 99, 100, 101, 5000, 20_000, 150)] + [b"a" * 700]
    whole = np.column_stack(anchors_in(texts))
    parts = np.column_stack(anchors_in(texts, 1000))
    assert len(whole) and sorted(map(tuple, whole)) == sorted(map(tuple, parts))
    assert len(whole) < sum(map(len, texts[:-1])) / 25 + 800
    for k, text in enumerate(texts):  # an anchor's gram in each string of SPAN bytes
        places = whole[whole[:, 0] == k, 3] // 128
        for s in range(len(text) - SPAN + 1):
            assert ((places >= s) & (places <= s + REACH)).any() and REACH + GRAM == SPAN


@pytest.mark.parametrize("seed", range(5))
def test_suffix_sort(seed):
    rng = np.random.default_rng(seed)
    buffer = rng.integers(97, 97 + (1 if seed == 4 else 2), size=3000).astype(np.uint8)
    buffer[500:900] = buffer[1500:1900]
    starts = rng.permutation(2800)[:1500]
    segment = np.sort(rng.integers(0, 6, size=1500))
    suffixes = Suffixes(buffer, SPAN)
    key = lambda s: buffer[s : s + SPAN].tobytes()
    order = suffixes.sort(starts, segment)
    want = [k for g in range(6) for k in sorted(np.flatnonzero(segment == g), key=lambda k: key(starts[k]))]
    assert [key(starts[k]) for k in order] == [key(starts[k]) for k in want] and list(order) == want
    (a, b), (c, d) = suffixes.ordered(starts, segment), suffixes.ordered_by_bytes(starts, segment)
    assert (a == c).all() and (b == d).all()
    suffixes.of_step = None  # as for a large buffer
    assert (suffixes.common(starts[:-1], starts[1:]) == Suffixes(buffer, SPAN).common(starts[:-1], starts[1:])).all()
    for length in (0, 3, 50, SPAN):
        same = classes(a, b, length)
        keys = {(g, buffer[s : s + length].tobytes()) for s, g in zip(starts, segment, strict=True)}
        assert len(set(same)) == len(keys) == len(set(zip(same.tolist(), [(g, buffer[s : s + length].tobytes()) for s, g in zip(starts, segment, strict=True)], strict=True)))


def test_hashes_do_not_depend_on_their_surroundings():
    a, b = np.frombuffer(b"xxhello world", dtype=np.uint8), np.frombuffer(b"hello", dtype=np.uint8)
    assert Hashes(a).of(np.array([2]), np.array([7])) == Hashes(b).of(np.array([0]), np.array([5]))
    assert Hashes(a).of_length(5)[2] == Hashes(b).of_length(5)[0] and len(Hashes(b).of_length(9)) == 0


def test_a_shared_hash_is_noticed(monkeypatch):
    buffer = np.random.default_rng(1).integers(97, 123, size=1000).astype(np.uint8)
    suffixes = Suffixes(buffer, SPAN)
    suffixes.of_step = {s: np.zeros_like(t) for s, t in suffixes.of_step.items()}  # every hash is the same
    segment = np.zeros(300, dtype=np.int64)
    assert all((x == y).all() for x, y in zip(suffixes.ordered(np.arange(300), segment), suffixes.ordered_by_bytes(np.arange(300), segment), strict=True))
