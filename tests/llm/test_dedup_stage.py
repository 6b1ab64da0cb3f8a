import corpus_pipeline
from riftline.llm.near_dup import layout, near_duplicates, shingles


def test_layout_follows_from_the_threshold():
    assert layout(85) == (32, 6) and layout(80) == (38, 5)
    for t in (50, 70, 80, 85, 95, 99, 100):
        bands, size = layout(t)
        assert (1 - (t / 100) ** size) ** bands <= 3e-7


def test_dedup_stage_drops_copies_from_four_fifths(spark, documents):
    words = [f"w{k}" for k in range(104)]
    near = [w if k not in (2, 101) else "x" for k, w in enumerate(words)]
    near[50] = "y"
    far = [w if k not in (30, 60, 90) else "z" for k, w in enumerate(words)]
    texts = [" ".join(t) for t in (words, near, far)]
    a, b, c = (set(shingles(t).tolist()) for t in texts)
    assert 0.80 <= len(a & b) / len(a | b) < 0.85 and len(a & c) / len(a | c) < 0.80 and len(b & c) / len(b | c) < 0.80
    docs = documents(texts)
    assert {r["doc_id"] for r in corpus_pipeline.dedup(spark, docs, "").collect()} == {0, 2}
    assert near_duplicates(docs).where("kept").count() == 3
