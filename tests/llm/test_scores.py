"""Scores of the two classifiers against computations by their definitions, without matrices, folding or batches."""

import math
import random
import string
from collections import Counter

import numpy as np
import pytest

from riftline.llm import quality, toxicity


# --- quality: passages, gates and score by loops over plain numbers ----------------------------------------------------
def measures(words):
    """A passage's measures, a character at a time."""
    if not words:
        return [0.0] * quality.MEASURES
    data = [c for w in words for c in w]
    groups = [string.ascii_uppercase, string.ascii_lowercase, string.digits, ".,;:", "!?", "|"]
    share = [sum(chr(c) in g for c in data) / len(data) for g in groups]
    named = set("".join(groups))
    share += [sum(33 <= c < 127 and chr(c) not in named for c in data) / len(data), sum(c >= 128 for c in data) / len(data)]
    n, counts, ends = len(words), Counter(words), Counter(w[-1] for w in words)
    return [*share, n / 60, min(len(data) / n, 30) / 10, len(counts) / n, max(counts.values()) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, sum(w.isupper() for w in words) / n, 1 - max(ends.values()) / n]


def slow_score(model, text):
    words = (text or "").encode().split()
    passages = [words[k : k + 60] for k in range(0, len(words), 60)] or [[]]
    w, hidden, logits = model.weights, [], []
    for p in passages:
        x = [(m - a) / s for m, a, s in zip(np.float32(measures(p)).tolist(), model.mean, model.scale, strict=True)]
        h = [math.tanh(sum(x[i] * w["W"][i, j] for i in range(len(x))) + w["b"][j]) for j in range(quality.HIDDEN)]
        gate = [math.tanh(sum(h[i] * w["V"][i, j] for i in range(len(h)))) / (1 + math.exp(-sum(h[i] * w["U"][i, j] for i in range(len(h))))) for j in range(quality.GATE)]
        hidden.append(h)
        logits.append(sum(g * a for g, a in zip(gate, w["a"], strict=True)))
    total = sum(map(math.exp, logits))
    z = [sum(math.exp(e) / total * h[j] for e, h in zip(logits, hidden, strict=True)) for j in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, w["o"], strict=True)) + float(w["c"]))))


TEXTS = [None, "", "  ", "word", "Hello, WORLD! | 42 %$ é日本", "the same the same the the the", "A b C d. " * 40, " ".join(f"w{k}!" for k in range(300)), "x" * 5000 + " tail"]


def test_quality_scores_by_definition():
    rng = random.Random(1)
    made = [" ".join("".join(rng.choices("abcXYZ019.,!?|%é", k=rng.randint(1, 8))) for _ in range(rng.randint(1, 150))) for _ in range(30)]
    bags = [quality.encode(t) for t in made]
    model = quality.train(bags, np.array([k % 2 for k in range(30)], dtype=float))
    got = quality.score_texts(model, TEXTS + made)
    assert got == pytest.approx([slow_score(model, t) for t in TEXTS + made], abs=1e-6)
    assert quality.score_texts(model, [TEXTS[4]])[0] == pytest.approx(got[4])  # whatever else is in the batch


# --- toxicity: kernels with the landmarks, summed for each string ---------------------------------------------------------
def kernel(a, b):
    """Sum over triples of letters of the products of their weights, scaled by the strings' own kernels."""

    def weights(x):
        out = Counter()
        for i in range(len(x)):
            for j in range(i + 1, len(x)):
                for k in range(j + 1, min(len(x), i + toxicity.SPAN)):
                    out[x[i], x[j], x[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    p, q = weights(toxicity.letters(a).tolist()), weights(toxicity.letters(b).tolist())
    norm = math.sqrt(sum(v * v for v in p.values()) * sum(v * v for v in q.values()))
    return sum(v * q[t] for t, v in p.items()) / norm if norm else 0.0


def bag(text):
    """Words, runs of three and more single characters as a word, stretches of long words that overlap by half."""
    words = (text or "").split()
    out, run = set(words), []
    for w in [*words, "##"]:
        if len(w) == 1:
            run.append(w)
            continue
        if len(run) > 2:
            out.add("".join(run))
        run = []
    half = toxicity.LONGEST // 2
    return {s for w in out for s in ([w] if len(w) <= 2 * half else [w[k : k + 2 * half] for k in range(0, len(w) - half, half)])}


def test_toxicity_evidence_and_score_by_definition():
    rng = np.random.default_rng(4)
    landmarks = ["idiot", "clown", "garbage", "people", "weather"]
    weights = rng.normal(size=len(landmarks))
    table = (weights @ np.stack([toxicity.profile(m) for m in landmarks])).astype(np.float32)
    model = toxicity.Model(table, 2.5, -0.7)
    texts = [None, "", "a b", "you i d i o t today", "what an id-i-ot", "c.l.o.w.n shoes", "nice weather for people", "garb4age" * 9, "ÍDÍÓT!!", "日本語 の文"]
    values = toxicity.Values(table)
    got, seen = model.scores(values, texts), values.highest(texts)
    for k, t in enumerate(texts):
        assert toxicity.strings(t or "") == bag(t)
        evidence = max((sum(w * kernel(m, s) for w, m in zip(weights, landmarks, strict=True)) for s in bag(t)), default=0.0)
        assert seen[k] == pytest.approx(evidence, abs=1e-5)
        assert got[k] == pytest.approx(1 / (1 + math.exp(-(2.5 * evidence - 0.7))), abs=1e-5)
