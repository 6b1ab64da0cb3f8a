"""Null ids, large ids, repeated ids, clashing columns, ties and empty tables in every operator and stage."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riftline.llm import toxicity
from riftline.llm.licenses import scan_licenses
from riftline.llm.mixing import mix, mixed_documents
from riftline.llm.mpeg import describe_texts
from riftline.llm.near_dup import near_duplicates
from riftline.llm.packing import pack
from riftline.llm.quality import keep_good, score_quality
from riftline.llm.secrets import find_secrets, redact_secrets
from riftline.llm.token_counts import count_tokens
from riftline.llm.wordbpe import vocabulary_path

BIG = 2**53 + 1
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
NAMES = ("node", "n", "keys", "high", "low", "row", "piece", "length", "rank", "size", "hash", "s", "target", "score", "label", "held_out", "ids", "spans", "text_hash", "kept_hash", "token", "salt")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(8)], LABELS)


@pytest.fixture(scope="module")
def odd_ids(spark):
    rows = [(None, "one two three four five six", "en", None, None), (BIG, "one two three four five six", "en", "a", BIG), (BIG + 2, None, None, "a", None), (3, "", "en", "b", 0), (3, "token = abcdefgh1", "en", "b", 5)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    return df.select("*", *[F.lit("x").alias(n) for n in NAMES if n not in df.columns])


OPERATORS = {
    "pack": lambda d, l: pack(d, vocabulary_path()), "near": lambda d, l: near_duplicates(d), "licenses": lambda d, l: scan_licenses(d), "mix": lambda d, l: mix(d),
    "toxicity": toxicity.score_toxicity, "secrets": lambda d, l: find_secrets(d), "media": lambda d, l: describe_texts(d), "tokens": lambda d, l: count_tokens(d, vocabulary_path()),
    "quality": score_quality, "keep_good": keep_good, "redact": lambda d, l: redact_secrets(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_stay_as_they_are(odd_ids, labels, name):
    got = OPERATORS[name](odd_ids, labels).collect()
    ids = Counter(r["doc_id"] for r in got)
    assert ids == Counter([None, BIG, BIG + 2, 3, 3])
    if name in ("keep_good", "redact"):
        assert {r["n_chars"] for r in got} == {None, BIG, 0, 5} and got[0].asDict().keys() == set(odd_ids.columns)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(odd_ids, labels, name):
    assert OPERATORS[name](odd_ids.where("lang = 'none'"), labels).count() == 0


def test_a_repeated_id_with_another_text_keeps_its_links(spark):
    a = " ".join(f"w{k}" for k in range(60))
    b = " ".join(f"v{k}" for k in range(60))
    docs = spark.createDataFrame([(1, b + " end"), (5, a), (5, b), (7, a + " end"), (None, a)], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()}
    assert got == {(1, 1, True), (5, 5, True), (5, 1, False), (7, 5, False), (None, None, False)}
    stage = corpus_pipeline.dedup(None, docs, "")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in stage.collect()) == sorted([(1, b + " end"), (5, a), (0, a)])


def test_long_prefix_lists_are_dealt_by_salt(spark, monkeypatch):
    from riftline.llm import near_dup

    monkeypatch.setattr(near_dup, "LEAST_HOT", 4)
    monkeypatch.setattr(near_dup, "HOT_KEYS", 50)
    shared = " ".join(f"s{k}" for k in range(40))
    texts = [f"{shared} a{k} b{k % 7}" for k in range(40)]
    sets = [frozenset(near_dup.shingles(t).tolist()) for t in texts]
    df = spark.createDataFrame([(k, near_dup.shingles(t).view(np.int64).tolist()) for k, t in enumerate(texts)], "node long, tokens array<long>")
    found = near_dup.confirmed(near_dup.remaining_pairs(df, spark.createDataFrame([], "node long, component long")), df).collect()
    wanted = {(a, b) for a, b in itertools.combinations(range(40), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in found} == wanted and wanted


def test_mixing_gives_whole_rows_until_the_budget_ends(spark):
    rows = [(1, "one two three", "en", "a", 1)] * 30 + [(50 + k, "x y", "en", "b", 1) for k in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    target = {r["doc_id"]: r["target"] for r in mix(docs).collect()}
    given = Counter(r["doc_id"] for r in mixed_documents(docs).collect())
    assert abs(3 * given[1] - target[1]) <= 1.5 and abs(2 * sum(given[50 + k] for k in range(5)) - target[50]) <= 2


def test_ties_in_length_are_packed_apart(spark):
    docs = spark.createDataFrame([(k % 3, "same words here", "en", "a", 1) for k in range(50)], SCHEMA)
    rows = pack(docs, vocabulary_path(), capacity=10, with_ids=True).collect()
    assert len({(r["row"], r["piece"]) for r in rows}) == len({(r["sequence_id"], r["offset"]) for r in rows}) == 50
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)


def test_full_pieces_have_sequences_of_their_own(spark):
    docs = spark.createDataFrame([(k, "word " * 35, "en", "a", 1) for k in range(20)], SCHEMA)
    rows = pack(docs, vocabulary_path(), capacity=10).collect()
    full = [r["sequence_id"] for r in rows if r["length"] == 10]
    assert len(full) == 60 == len(set(full)) and not set(full) & {r["sequence_id"] for r in rows if r["length"] < 10}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, odd_ids, tmp_path, name):
    spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(8)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    plain = odd_ids.select(*[c.split()[0] for c in SCHEMA.split(", ")])
    for docs in (odd_ids, plain, plain.unionByName(plain)):
        got = stage(spark, docs, str(tmp_path))
        rows = got.collect()
        if name != "packing":
            assert got.columns == docs.columns and {r["doc_id"] for r in rows} <= {None, BIG, BIG + 2, 3}
        else:
            assert {r["doc_id"] for r in rows} == {None, BIG, BIG + 2, 3}
    assert stage(spark, plain.where("lang = 'none'"), str(tmp_path)).count() == 0


def naive_kernel(a, b):
    """Sum over pairs of equal triples, letter by letter."""

    def weights(x):
        out = Counter()
        for i, j, k in itertools.combinations(range(len(x)), 3):
            if k - i < toxicity.SPAN:
                out[x[i], x[j], x[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    p, q = weights(a), weights(b)
    dot = lambda u, v: sum(w * v[t] for t, w in u.items())
    return dot(p, q) / (dot(p, p) * dot(q, q)) ** 0.5


def test_kernel_against_all_subsequences():
    words = ["idiot", "i.d-iot", "idXiot", "Straße", "banana", "ab", "a", "aaaaaaa", "日本語", "clown!!"]
    marks = ["moron", "banana", "idiot"]
    tables = np.stack([toxicity.profile(m) for m in marks])
    got = toxicity.linear(words, tables)
    for w, row in zip(words, got, strict=True):
        for m, value in zip(marks, row, strict=True):
            assert value == pytest.approx(naive_kernel(toxicity.letters(w).tolist(), toxicity.letters(m).tolist()), abs=1e-9)


def test_folded_table_is_the_machine():
    rng = np.random.default_rng(2)
    marks, words = ["moron", "clown", "banana", "these"], ["morons", "clowny", "theses", "x"]
    profiles = np.stack([toxicity.profile(m) for m in marks])
    weights = rng.normal(size=len(marks))
    assert toxicity.linear(words, (weights @ profiles)[None])[:, 0] == pytest.approx(toxicity.linear(words, profiles) @ weights)


def test_bags_of_strings():
    assert toxicity.strings("you i d i o t!") == {"you", "i", "d", "o", "t!", "idio"}
    long = "x" * 10 + "clown" + "y" * 60
    assert all(len(s) <= toxicity.LONGEST for s in toxicity.strings(long)) and any("clown" in s for s in toxicity.strings(long))
