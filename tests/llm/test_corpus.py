import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riftline.llm import near_dup, quality, toxicity
from riftline.llm.ann import nearest
from riftline.llm.components import connected_components
from riftline.llm.mixing import mix, mixed_documents
from riftline.llm.near_dup import near_duplicates, remaining_pairs, shingles

DATA = "/root/testdata/sf0.001"


def brute_components(texts, threshold=85):
    sets = [frozenset(shingles(t).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in range(len(texts))}


def variants(seed, n):
    """A text with copies in which a few words differ, copies of copies, and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(90)]
    texts = [" ".join(base)]
    for _ in range(n):
        w = rng.choice(texts).split() if rng.random() < 0.3 else list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    return texts + [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(10)]


def test_shingles_follow_the_definition():
    assert len(shingles("A b\tC d E f")) == 2 and len(shingles("a b")) == 1 and len(shingles(None)) == 0
    assert (shingles("ONE two") == shingles(" one\n TWO ")).all() and (shingles("É a") != shingles("é a")).any()
    assert len(shingles("a a a a a a a")) == 1


def test_near_duplicates_against_brute_force(spark, documents, odd_texts):
    texts = [*odd_texts, *variants(1, 60), *variants(2, 25)]
    got = {r["doc_id"]: r for r in near_duplicates(documents(texts).withColumn("node", F.lit(1)).withColumn("n", F.lit(2))).collect()}
    expected = brute_components(texts)
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == expected
    assert all(r["kept"] == (r["component_id"] == k) for k, r in got.items())
    assert near_duplicates(documents([])).count() == 0


def test_completion_alone_finds_every_link(spark):
    texts = variants(3, 50)
    sets = spark.createDataFrame([(k, shingles(t).view(np.int64).tolist()) for k, t in enumerate(texts)], "node long, tokens array<long>")
    none = spark.createDataFrame([], "node long, component long")
    links = near_dup.confirmed(remaining_pairs(sets, none), sets).collect()
    own = [frozenset(shingles(t).tolist()) for t in texts]
    wanted = {(a, b) for b in range(len(texts)) for a in range(b) if 100 * len(own[a] & own[b]) >= 85 * len(own[a] | own[b])}
    assert {(r["a"], r["b"]) for r in links} == wanted


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(parent[a], parent[b])
            changed |= (parent[a], parent[b]) != (low, low)
            parent[a] = parent[b] = low
    loops = {a for a, b in edges if a == b}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in parent.items() if n in got} and set(parent) - set(got) <= loops


def test_mixing_meets_targets(spark, documents, odd_texts):
    rng = random.Random(6)
    texts = [" ".join("w" for _ in range(rng.randint(0, 30))) for _ in range(400)]
    sources = [rng.choice(["a", "b", "b", "b", "c", "d", None]) for _ in texts]
    docs = documents([*texts, *odd_texts], [*sources, *(["z"] * len(odd_texts))])
    rows = mix(docs.withColumn("size", F.lit("x")).withColumn("s", F.lit(0))).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix(docs.repartition(3)).collect()))
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    by = defaultdict(lambda: [0, 0, 0.0])
    for r, s in ((r, {k: s for k, s in enumerate([*sources, *(["z"] * len(odd_texts))])}[r["doc_id"]]) for r in rows):
        by[s][0] += r["size"]
        by[s][1] += r["taken"]
        by[s][2] = r["target"]
    total = sum(v[0] for v in by.values())
    weights = {s: 1 + k % 3 for k, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    target, open_ = dict.fromkeys(by, 0.0), set(by)
    while True:
        rest = total - sum(3 * by[s][0] for s in by if s not in open_)
        target = {s: 3.0 * by[s][0] if s not in open_ else rest * weights[s] / sum(weights[t] for t in open_) for s in by}
        if not (over := {s for s in open_ if target[s] > 3 * by[s][0] + 1e-9}):
            break
        open_ -= over
    for s, (_, taken, said) in by.items():
        assert said == pytest.approx(target[s]) and abs(taken - said) <= 40000 * (s == "z") + 30
    assert mix(documents([])).count() == 0


def test_mixing_splits_repeated_rows_evenly(spark, documents):
    docs = documents(["one two three"] * 30, ["a"] * 30).withColumn("doc_id", F.lit(1).cast("long")).unionByName(documents(["x y"] * 5, ["b"] * 5, first=50))
    rows = mix(docs).collect()
    assert len({r["taken"] for r in rows if r["doc_id"] == 1}) == 1
    assert mixed_documents(docs).columns == docs.columns


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[5] = x[300]
    x[7] = 0
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 16), (902, [1.0]), (300, x[300].tolist())]
    rows += [(1000 + k, x[20].tolist()) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0))
    got = defaultdict(list)
    for r in sorted(nearest(df, F.col("vec_id") % 100 == 0, least=200).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    valid = {k: np.array(v, dtype=float) for k, v in rows if v is not None and len(v) == 16 and np.isfinite(v).all() and any(v)}
    hits = 0
    for q in (k for k in valid if k % 100 == 0):
        truth = sorted((float(np.sqrt(((v - valid[q]) ** 2).sum())), k) for k, v in valid.items() if k != q)[:10]
        assert len(got[q]) == 10 and got[q] == sorted(got[q], key=lambda z: (z[1], z[0])) and all(s == pytest.approx(np.sqrt(((valid[k] - valid[q]) ** 2).sum()), rel=1e-12) for k, s in got[q])
        hits += len({k for _, k in truth} & {k for k, _ in got[q]})
    assert hits >= 0.9 * 10 * sum(k % 100 == 0 for k in valid)
    assert got[300][0] == (5, 0.0)
    assert nearest(df.where("vec_id < 0"), F.col("vec_id") % 100 == 0).count() == 0


def held_out_rows(spark, scored, label):
    return scored.join(spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/labels.parquet"), "doc_id").where("held_out").select("predicted", label).collect()


def test_quality_on_held_out_documents(spark):
    base = DATA.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{base}/documents.parquet")
    rows = held_out_rows(spark, quality.score_quality(docs, spark.read.parquet(f"{base}/labels.parquet")), "quality")
    assert sum(p == q for p, q in rows) >= 0.95 * len(rows)


def test_classifiers_take_odd_texts_and_missing_labels(spark, documents, odd_texts):
    docs = documents(odd_texts)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(8)] + [(0, None, 7)], "doc_id long, quality int, toxic int")
    for score in (quality.score_quality, toxicity.score_toxicity):
        for l in (none, labels):
            rows = score(docs, l).collect()
            assert len(rows) == len(odd_texts) and all(0 <= r["score"] <= 1 for r in rows)
        assert score(documents([]), labels).count() == 0
    assert quality.keep_good(docs, none).count() == len(odd_texts)


def test_toxicity_tolerates_gaps_and_insertions(spark, documents):
    rng = random.Random(9)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    insults = ["idiot", "moron", "stupid", "pathetic", "worthless", "clown"]
    sentence = lambda *extra: " ".join(rng.sample(["".join(rng.sample(syllables, rng.randint(1, 3))) for _ in range(9)] + list(extra), 9 + len(extra))) + ". "
    clean = [sentence() + sentence() for _ in range(300)]
    toxic = [sentence(rng.choice(insults)) + sentence() + sentence(rng.choice(insults)) for _ in range(150)]
    docs = documents([*clean, *toxic, *[sentence(i[:2] + "." + i[2:]) for i in insults], *[sentence(".".join(i)) for i in insults], *[sentence() for _ in range(40)]])
    labels = spark.createDataFrame([(k, 1, int(k >= 300)) for k in range(450)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    out = [k for k in range(450) if got[k]["held_out"]]
    assert sum(got[k]["predicted"] == (k >= 300) for k in out) >= 0.95 * len(out)
    assert sum(got[450 + k]["predicted"] for k in range(12)) >= 10
    assert sum(got[462 + k]["predicted"] for k in range(40)) <= 3


def test_network_gradients():
    rng = np.random.default_rng(3)
    bags = [rng.normal(size=(k, quality.MEASURES)).astype(np.float32) for k in (1, 3, 2)]
    y, x, begins = np.array([0.0, 1.0, 1.0]), np.concatenate(bags).astype(float), np.array([0, 1, 4])
    m = quality.train(bags, y)
    loss = lambda: -np.mean(y * np.log(m.forward(x, begins)["p"]) + (1 - y) * np.log(1 - m.forward(x, begins)["p"]))
    for name, g in m.gradients(x, begins, y).items():
        flat = m.weights[name].reshape(-1) if m.weights[name].shape else None
        if flat is None:
            continue
        old = flat[0]
        flat[0] = old + 1e-6
        up = loss()
        flat[0] = old - 1e-6
        assert (up - loss()) / 2e-6 == pytest.approx(np.asarray(g).reshape(-1)[0], abs=1e-6)
        flat[0] = old


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, DATA).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if name == "quality":
            labels = spark.read.parquet(f"{DATA}/labels.parquet")
            scored = quality.score_quality(before, labels).where("predicted = 1")
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in scored.collect()}
        if name == "dedup":
            texts = [r["text"] for r in before.orderBy("doc_id").collect()]
            ids = [r["doc_id"] for r in before.orderBy("doc_id").collect()]
            assert {r["doc_id"] for r in after.collect()} == {ids[c] for _, c in brute_components(texts, corpus_pipeline.DEDUP_THRESHOLD).values()}
        if name == "secrets":
            assert after.count() == before.count()
        if name != "packing":
            assert after.columns == columns
        before = after
    assert before.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
