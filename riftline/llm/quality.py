"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE_WORDS`` words; its label belongs to the bag.  Every passage is
encoded by measures of its characters and words, a small layer turns the code into a hidden vector h, gated
attention (tanh(V h) * sigmoid(U h)) weighs the passages against each other, and the weighted sum is scored
by a logistic unit.  Layer, gates and score are trained together from document labels alone.

Training uses labelled rows that are not held out, at most ``SAMPLE`` of each label, chosen by a hash of the
id.  Scoring reads every text whole and is a function of the text only.

Edge cases: null and empty texts are a bag with one empty passage and get a score; a label that is null or
other than 0 and 1 is ignored, a repeated one counts once; without labels of both kinds every score is the
share of label 1 (1 with no labels at all, so nothing is rejected); repeated rows each give a row; a null id stays
null, is not held out, and leaves the others as they are; an empty table gives an empty result; of the documents only
doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, in_portions, named_texts, training_ids, with_results

PASSAGE_WORDS = 60
#: Labelled documents of each label that training reads, at most.
SAMPLE = 2000
HIDDEN, GATE, ROUNDS, RATE, DECAY = 16, 8, 300, 0.02, 1e-4
FOLDS, FOLD, THRESHOLD = 4, 2, 0.7
SCHEMA = "score double, predicted int"

_UPPER, _DIGIT, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"abcdefghijklmnopqrstuvwxyz"
_STOPS, _LOUD, _BARS = b".,;:", b"!?", b"|"
_OTHER = bytes(b for b in range(33, 127) if b not in _UPPER + _DIGIT + _LOWER + _STOPS + _LOUD + _BARS)
_HIGH = bytes(range(128, 256))
_GROUPS = (_UPPER, _LOWER, _DIGIT, _STOPS, _LOUD, _BARS, _OTHER, _HIGH)
MEASURES = len(_GROUPS) + 7


def encode_passage(words: list[bytes]) -> list[float]:
    """Shares of character groups, and how long, varied and repeated the words are."""
    if not words:
        return [0.0] * MEASURES
    data, n = b"".join(words), len(words)
    size = len(data)
    counts = Counter(words)
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    endings = Counter(w[-1:] for w in words)
    return [
        *((size - len(data.translate(None, g))) / size for g in _GROUPS),
        n / PASSAGE_WORDS,
        min(size / n, 30.0) / 10,
        len(counts) / n,
        max(counts.values()) / n,
        repeats / n,
        sum(w.isupper() for w in words) / n,
        1 - max(endings.values()) / n,
    ]


def encode(text: str | None) -> np.ndarray:
    """(passages, measures) of a whole text; the empty text has one passage."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return np.array([encode_passage(words[at : at + PASSAGE_WORDS]) for at in range(0, max(1, len(words)), PASSAGE_WORDS)], dtype=np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class Model:
    """Parameters of the network; bags are rows of x from each of ``begins`` on."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, begins: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        sizes = np.diff(np.append(begins, len(x)))
        h = np.tanh(((x - self.mean) / self.scale) @ w["W"] + w["b"])
        a, g = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
        e = (a * g) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begins), sizes))
        alpha = e / np.repeat(np.add.reduceat(e, begins), sizes)
        z = np.add.reduceat(alpha[:, None] * h, begins)
        return {"h": h, "a": a, "g": g, "alpha": alpha, "z": z, "p": sigmoid(z @ w["o"] + w["c"]), "sizes": sizes}

    def gradients(self, x: np.ndarray, begins: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.forward(x, begins)
        d = (f["p"] - y) / len(y)
        per_row = np.repeat(np.outer(d, w["o"]), f["sizes"], axis=0)  # of the bag's z
        toward = (per_row * f["h"]).sum(1)
        mean = np.repeat(np.add.reduceat(f["alpha"] * toward, begins), f["sizes"])
        de = f["alpha"] * (toward - mean)
        gate = np.outer(de, w["a"])
        da, dg = gate * f["g"] * (1 - f["a"] ** 2), gate * f["a"] * f["g"] * (1 - f["g"])
        dh = (f["alpha"][:, None] * per_row + da @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
        return {
            "o": f["z"].T @ d, "c": d.sum(), "a": (f["a"] * f["g"]).T @ de, "V": f["h"].T @ da, "U": f["h"].T @ dg,
            "W": ((x - self.mean) / self.scale).T @ dh, "b": dh.sum(0),
        }


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Model:
    """Full-batch Adam on the bags' labels."""
    x, y = np.concatenate(bags).astype(np.float64), labels.astype(np.float64)
    begins = np.cumsum([0, *map(len, bags[:-1])])
    rng = np.random.default_rng(seed)
    shapes = {"W": (x.shape[1], HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "a": (GATE,), "o": (HIDDEN,), "c": ()}
    weights = {k: np.asarray(rng.normal(0, 0.3, s) if len(s) else 0.0) for k, s in shapes.items()}
    model = Model(x.mean(0), x.std(0) + 1e-3, weights)
    first, second = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    for t in range(1, ROUNDS + 1):
        for k, g in model.gradients(x, begins, y).items():
            g = g + DECAY * model.weights[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g**2
            model.weights[k] = model.weights[k] - RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", folds: int = FOLDS, fold: int = FOLD, sample: int = SAMPLE) -> Model | float:
    """The model, or the share of label 1 where one label is missing.  The sample's codes come to the driver."""
    ids = training_ids(labels, column, folds, fold, sample)

    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text")
    coded = with_results(texts, "codes binary", lambda batch: {"codes": [encode(t).tobytes() for t in batch]})
    rows = sorted((r["doc_id"], r["label"], bytes(r["codes"])) for r in coded.collect())
    y = np.array([r[1] for r in rows])
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 1.0
    return train([np.frombuffer(r[2], dtype=np.float32).reshape(-1, MEASURES) for r in rows], y)


def score_texts(model: Model | float, texts: list[str | None]) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(texts), model)
    bags = [encode(t) for t in texts]
    begins = np.cumsum([0, *map(len, bags[:-1])])
    return model.forward(np.concatenate(bags), begins)["p"] if bags else np.zeros(0)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = FOLDS, fold: int = FOLD, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds=folds, fold=fold, sample=sample))

    def scored(texts: list[str | None]) -> dict[str, Sequence]:
        p = score_texts(model.value, texts)
        return {"score": p, "predicted": (p >= threshold).astype(np.int32)}

    return with_results(named_texts(docs, "doc_id", "text", held_out("doc_id", folds, fold).alias("held_out")), SCHEMA, scored)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_portions(batches):
            yield b.filter(pa.array(score_texts(model.value, b.column("text").to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
