"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

The kernel of two strings is the sum, over all triples of letters, of the products of their weights in both; a
triple's weight in a string is the sum of DECAY ** (letters spanned - 3) over its places that span at most SPAN
letters.  It is normalised: divided by the root of the two strings' kernels with themselves.  Punctuation inside or
between letters is passed over and other letters between cost a decay, so insults with gaps and inserted characters
keep most of their triples.

A document is a bag of strings: its words, runs of single characters taken as one word, and words of more than LONGEST
characters as stretches that overlap by half.  Landmarks are words: those most typical of toxic documents and the
commonest of the others.  Strings of labelled documents are mapped to the landmarks' space by the Nystroem formula, and a
linear machine with squared hinge loss learns to tell them apart.  Since only documents are labelled, each toxic document
is represented by its highest-scoring string, beside the toxic landmarks themselves with as much weight, chosen anew after every step, and in every round the strings to choose from
are the highest ones under the machine so far.

A document's evidence is the highest decision value of the machine among all its strings.  The value is a sum over
landmarks of kernels, hence linear in a string's triples, so the landmarks fold into one weight for each triple without
any approximation.  A logistic curve, fitted on the labelled sample, makes the evidence a score.

Training reads at most SAMPLE labelled documents of each label, whole, and of each the CANDIDATES highest strings (in the
first round by mean kernels with toxic landmarks less those with the others) and as many that come first by hash.  Edge cases: null and empty texts get a score; other labels than
0 and 1 are ignored, repeated ones count once; without labels of both kinds every score is 0 or 1, whichever label there
is (0 with none); repeated rows each give a row; texts are scored whole; a null id stays null, is not held out, and leaves
the others as they are; an empty table gives an empty result; of the documents only doc_id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, named_texts, settled, training_ids, with_results

DECAY, SPAN, LONGEST = 0.6, 7, 24
LANDMARKS = 64  #: of each kind, at most
SAMPLE, CANDIDATES = 1500, 8
ROUNDS, CHOICES, RIDGE = 3, 3, 1e-4
FOLDS, FOLD, THRESHOLD = 5, 0, 0.5
SCHEMA = "score double, predicted int"

#: Letters are 1 to 26, other letters 27 to 34, digits 35 to 38, white space 39; GONE is passed over.
ALPHABET, SPACE, GONE = 40, 39, 255
OFFSETS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
#: Strings whose values one worker remembers; when full, the table starts again.
REMEMBERED = 500_000


def _code(point: int) -> int:
    c = chr(point)
    base = unicodedata.normalize("NFD", c.lower())[0]
    if c.isspace():
        return SPACE
    if "a" <= base <= "z":
        return ord(base) - 96
    if c.isalpha():
        return 27 + point % 8
    return 35 + point % 4 if c.isdigit() else GONE


_TABLE = np.array([_code(p) for p in range(0x250)] + [GONE], dtype=np.uint8)


def codes_of(points: np.ndarray) -> np.ndarray:
    codes = _TABLE[np.minimum(points, 0x24F)]
    far = points >= 0x250
    if far.any():
        mark = (points >= 0x2000) & (points < 0x2070)
        codes = np.where(far, np.where(mark, GONE, 27 + points % 8), codes)
    return codes


def letters(word: str) -> np.ndarray:
    """Codes of a word's letters and digits, between two spaces."""
    return coded([word])[0]


def triples(x: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each way to place a triple: its number at each start, and its weight."""
    n = len(x)
    high = x * (ALPHABET * ALPHABET)
    middle = x * ALPHABET
    for i, j in OFFSETS:
        if n > j:
            yield high[: n - j] + middle[i : n - j + i] + x[j:], DECAY ** (j - 2)


def strings(text: str) -> set[str]:
    """The bag of a text: words, runs of three and more single characters, overlapping stretches of long words."""
    out = set(text.split())
    out.update("".join(m[0].split()) for m in _SPACED.finditer(text))
    for w in [w for w in out if len(w) > LONGEST]:
        out.remove(w)
        out.update(w[at : at + LONGEST] for at in range(0, len(w) - LONGEST // 2, LONGEST // 2))
    return out


def profile(text: str) -> np.ndarray:
    """Weights of all triples in a short string, scaled to length 1."""
    v = np.zeros(ALPHABET**3, dtype=np.float64)
    for number, weight in triples(letters(text)):
        np.add.at(v, number, weight)
    return v / (np.sqrt(v @ v) or 1)


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words in one array, one space before, between and after; and where the spaces are."""
    points = np.frombuffer("\n".join(["", *words, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = codes_of(points)
    codes = codes[codes != GONE].astype(np.int64)
    return codes, np.flatnonzero(codes == SPACE)


def linear(words: list[str], tables: np.ndarray) -> np.ndarray:
    """(words, tables): sums of each word's triple weights times a table's, over the length of its profile."""
    codes, spaces = coded(words)
    sizes = np.diff(spaces) + 1
    out = np.zeros((len(words), len(tables)))
    for n in np.unique(sizes[sizes > 2]):
        rows = np.flatnonzero(sizes == n)
        x = codes[spaces[rows][:, None] + np.arange(n)]
        placed = [(x[:, : n - j] * (ALPHABET * ALPHABET) + x[:, i : n - j + i] * ALPHABET + x[:, j:], j) for i, j in OFFSETS if n > j]
        number = np.hstack([p for p, _ in placed])
        span = np.concatenate([np.full(p.shape[1], j) for p, j in placed])
        weight = DECAY ** (span - 2.0)
        # A place's span lies in the low bits of its triple's number, so sorting each row takes the weights along.
        keys = np.sort((number * 8 + span).astype(np.int32), axis=1)
        first = np.ones(keys.shape, dtype=bool)
        first[:, 1:] = keys[:, 1:] >> 3 != keys[:, :-1] >> 3
        starts = np.flatnonzero(first)
        total = np.add.reduceat((DECAY ** (np.arange(8) - 2.0))[keys & 7].ravel(), starts)
        length = np.bincount(starts // keys.shape[1], total**2, minlength=len(rows))
        out[rows] = np.stack([table[number] @ weight for table in tables], axis=1) / np.sqrt(length)[:, None]
    return out


class Values(dict):
    """Decision values by string; those not met before are computed together."""

    def __init__(self, table: np.ndarray):
        super().__init__()
        self.table = table[None]

    def of(self, bag: list[str]) -> np.ndarray:
        new = sorted(set(bag) - self.keys())
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            self.update(zip(some, linear(some, self.table)[:, 0].tolist(), strict=True))
        return np.fromiter(map(self.__getitem__, bag), dtype=float, count=len(bag))

    def highest(self, texts: list[str | None]) -> np.ndarray:
        """The highest value among each text's strings, 0 for a text without any."""
        bags = [list(strings(t or "")) for t in texts]
        if len(self) > REMEMBERED:
            self.clear()
        self.of([s for bag in bags for s in bag])
        return np.array([max(map(self.__getitem__, bag), default=0.0) for bag in bags])


def separate(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Linear machine with squared hinge loss and half-balanced labels, by Newton steps; the last weight is the offset.

    Row k counts ``times[k]`` times.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    cost = times * np.where(y > 0, (times[y < 0].sum() / times[y > 0].sum()) ** 0.5, 1.0)
    ridge = np.eye(x.shape[1]) * RIDGE * times.sum()
    v = np.zeros(x.shape[1])
    for _ in range(30):
        inside = y * (x @ v) < 1
        part = x[inside] * cost[inside, None]
        new = np.linalg.solve(x[inside].T @ part + ridge, part.T @ y[inside])
        if np.abs(new - v).max() < 1e-7:
            break
        v = new
    return v


def logistic(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through weighted labels, with smoothed targets."""
    center, scale = float(np.average(score)), float(score.std()) or 1.0
    s = (score - center) / scale
    target = np.where(label > 0, 1 - 1 / (2 + (label > 0).sum()), 1 / (2 + (label == 0).sum()))
    a = b = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        g, h = weight * (p - target), weight * p * (1 - p)
        gradient = np.array([g @ s + 1e-3 * a, g.sum()])
        step = np.linalg.solve(np.array([[h @ s**2 + 1e-3, h @ s], [h @ s, h.sum() + 1e-9]]), gradient)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return a / scale, b - a * center / scale


@dataclass
class Model:
    table: np.ndarray
    slope: float
    offset: float

    def scores(self, values: Values, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * values.highest(texts) + self.offset, -30, 30)))


def landmark_words(texts: DataFrame) -> tuple[list[str], list[str]]:
    """Words of four letters and more: the most typical of toxic documents, and the commonest of the others.

    Typical words have the largest log likelihood ratios, above what the number of words tried lets expect by chance.
    """
    words = texts.select("label", F.explode(F.array_distinct(F.split(F.lower("text"), "[^\\p{L}]+"))).alias("word")).where(F.length("word") >= 4)
    counted = words.groupBy("word").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    share = texts.agg(F.avg("label")).first()[0]
    n, t, c = F.col("t") + F.col("c"), F.col("t"), F.col("c")
    ratio = t * F.log(t / n / F.lit(share)) + F.when(c > 0, c * F.log(c / n / F.lit(1 - share))).otherwise(0)
    tried = counted.where(t > 0).count()
    toxic = counted.where((t > 0) & (t / n > share)).select("word", ratio.alias("ratio")).orderBy(F.desc("ratio"), "word").limit(LANDMARKS).collect()
    common = counted.where(c > 0).orderBy(c.desc(), "word").limit(LANDMARKS).collect()
    typical = [r["word"] for r in toxic if r["ratio"] > np.log(max(tried, 1)) + 1]
    return typical or [r["word"] for r in toxic[:8]], [r["word"] for r in common]


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", folds: int = FOLDS, fold: int = FOLD) -> Model | float:
    """The model, or a constant score where one label is missing."""
    ids = training_ids(labels, column, folds, fold, SAMPLE)
    share = labels.where(F.col(column).isin(0, 1) & ~held_out("doc_id", folds, fold)).agg(F.avg(F.col(column).cast("double"))).first()[0] or 0.0
    texts = settled(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text")))
    kinds = {r["label"] for r in texts.select("label").distinct().collect()}
    if len(kinds) < 2:
        return float(1 in kinds)
    insults, others = landmark_words(texts)
    if not insults:
        return float(share)
    words = insults + others
    profiles = np.stack([profile(w).astype(np.float32) for w in words])
    gram = (profiles @ profiles.T).astype(np.float64)
    values, vectors = np.linalg.eigh(gram)
    held = values > 1e-6 * values[-1]
    nystroem = vectors[:, held] / np.sqrt(values[held])
    context, known_insults = docs.sparkSession.sparkContext, gram[: len(insults)] @ nystroem
    table = profiles[: len(insults)].mean(axis=0) - profiles[len(insults) :].mean(axis=0)
    number: dict[str, int] = {}  # strings met so far, and where they lie in the landmarks' space
    mapped, clean = np.zeros((0, nystroem.shape[1])), Counter()
    for _ in range(ROUNDS):
        shared = context.broadcast(table)

        def candidates(batch: list[str | None], shared=shared) -> dict[str, Sequence]:
            values, chosen = Values(shared.value), []
            bags = [sorted(strings(t or ""), key=lambda s: (xxhash.xxh3_64_intdigest(s), s)) for t in batch]
            values.of([s for bag in bags for s in bag])
            for bag in bags:
                near = np.argsort(-values.of(bag), kind="stable")[:CANDIDATES].tolist()
                chosen.append([bag[n] for n in [*near, *(n for n in range(min(CANDIDATES, len(bag))) if n not in near)]])
            return {"some": list(map(" ".join, chosen))}

        rows = sorted((r["doc_id"], r["label"], r["some"]) for r in with_results(texts, "some string", candidates).collect() if r["some"])
        new = sorted({s for _, _, some in rows for s in some.split()} - number.keys())
        number |= {s: len(mapped) + k for k, s in enumerate(new)}
        mapped = np.vstack([mapped, *(linear(new[at : at + 2000], profiles) @ nystroem for at in range(0, len(new), 2000))])
        bags = [[number[s] for s in some.split()] for _, label, some in rows if label == 1]
        clean.update(number[s] for _, label, some in rows if label == 0 for s in some.split())
        if not clean or not bags:
            return float(share)
        negative = np.array(sorted(clean))
        chosen = np.array([bag[0] for bag in bags])  # the string with the highest value so far
        typical = np.full(len(insults), max(1.0, len(bags) / len(insults)))
        for _ in range(CHOICES):
            rows = np.vstack([mapped[negative], known_insults, mapped[chosen]])
            times = np.concatenate([[clean[k] for k in negative], typical, np.ones(len(chosen))])
            v = separate(rows, np.r_[-np.ones(len(negative)), np.ones(len(rows) - len(negative))], times)
            chosen = np.array([bag[np.argmax(mapped[bag] @ v[:-1])] for bag in bags])
        table = ((nystroem @ v[:-1]) @ profiles).astype(np.float32)
    folded = context.broadcast(table)
    known = with_results(texts, "e double", lambda batch: {"e": Values(folded.value).highest(batch)}).orderBy("doc_id").toPandas()
    label = known["label"].to_numpy()
    weight = np.where(label == 1, share / (label == 1).sum(), (1 - share) / (label == 0).sum()) * len(label)
    return Model(table, *logistic(known["e"].to_numpy(), label, weight))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = FOLDS, fold: int = FOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds=folds, fold=fold))

    kept: dict[str, Values] = {}  # filled in each task

    def scored(texts: list[str | None]) -> dict[str, Sequence]:
        m = model.value
        if not isinstance(m, float) and not kept:
            kept["values"] = Values(m.table)
        p = np.full(len(texts), m) if isinstance(m, float) else m.scores(kept["values"], texts)
        return {"score": p, "predicted": (p >= threshold).astype(np.int32)}

    return with_results(named_texts(docs, "doc_id", "text", held_out("doc_id", folds, fold).alias("held_out")), SCHEMA, scored)
