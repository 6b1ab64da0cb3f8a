"""Hard negatives by a vector-approximation file.

Every component is quantised into one of CELLS equal cells of its dimension's range, so a vector is approximated by one
byte for each dimension.  For an anchor, a table holds the least product of its component with each cell of each dimension;
summing a vector's entries gives a lower bound of its inner product with the anchor, and adding the anchor's width (the
sum of its absolute components times the cells' widths) an upper bound.  Only vectors whose bounds leave them a chance are scored exactly:
for the nearest positives, those whose upper bound reaches the k-th largest lower bound; for the negatives of a positive,
those whose bounds meet the window of scores, and whose upper bound reaches the k-th largest lower bound among vectors
that lie in the window for certain.

Anchors meet all vectors in blocks: vectors are dealt by a hash into blocks of about ROWS, a block for each label where only that label
is asked for, and anchors are sent to the blocks they have to meet.  A task holds one block's vectors and
streams the anchors past them; each block gives at most k rows of an anchor and window, so what is merged afterwards
is bounded too.

Rows with a null label, a null vector, or a null or non-finite component take no part.  Vectors of unequal length are
filled with zeros.  Scores are whole numbers, exact at any size, held at the limits of 64 bits.  A null id is no
anchor and comes before all others in ties; rows that repeat an id are rows of their own (as anchors too, and among
the positives of one another); rows equal in score and id stand in for one another.  An empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

CELLS, ROWS = 64, 16_384
#: Sums of products below this are exact in double precision.
EXACT = 2.0**53


def usable(label: Column, vector: Column) -> Column:
    return label.isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def ranges(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest component of each dimension; a row for each dimension comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.zeros(0), np.zeros(0)
        for b in batches:
            m = matrix(b.column("v"), 0)
            n = max(len(low), m.shape[1])
            low, high, m = (np.pad(low, (0, n - len(low))), np.pad(high, (0, n - len(high))), np.pad(m, ((0, 0), (0, n - m.shape[1]))))
            if len(m):
                low, high = np.minimum(low, m.min(axis=0)), np.maximum(high, m.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low))), pa.array(low), pa.array(high)], ["d", "low", "high"])

    found = rows.select("v").mapInArrow(run, "d bigint, low double, high double").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()
    return np.array([r["low"] for r in found]), np.array([r["high"] for r in found])


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Whole components floor(256 x) of vectors, filled with zeros to the longest or to ``dim``; whole numbers of any size are exact as doubles."""
    lengths, flat = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dim = max(dim, int(lengths.max()) if len(lengths) else 0)
    out = np.zeros((len(lengths), dim))
    with np.errstate(over="ignore"):
        out[np.arange(dim) < lengths[:, None]] = np.clip(np.floor(256 * flat), -1e300, 1e300)
    return out


class Block:
    """The vectors of one block with their cells, against which anchors are held."""

    def __init__(self, rows: pd.DataFrame, values: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.keys, self.labels, self.values = rows["key"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), values
        ids = rows["vec_id"]
        self.ids, self.null = ids.fillna(0).to_numpy(np.int64), ids.isna().to_numpy()
        self.low, self.width = low, np.maximum(np.ceil((high - low + 1) / CELLS), 1)
        cells = np.clip(np.floor((values - low) / self.width), 0, CELLS - 1)
        self.cells = np.ascontiguousarray(cells.astype(np.uint8).T)
        self.most = np.abs(values).max(initial=0)

    def bounds(self, anchor: np.ndarray) -> tuple[np.ndarray, float]:
        """Lower bounds of the scores with ``anchor``, and how far above them the upper bounds are."""
        n = self.values.shape[0]
        if self.most * np.abs(anchor).sum() >= EXACT / 4:
            return np.full(n, -np.inf), np.inf
        edge = self.low[:, None] + np.arange(CELLS) * self.width[:, None]
        table = np.minimum(anchor[:, None] * edge, anchor[:, None] * (edge + self.width[:, None]))
        lower = np.zeros(n)
        for d in np.flatnonzero(anchor):
            lower += table[d].take(self.cells[d])
        return lower, float((np.abs(anchor) * self.width).sum())

    def scores(self, anchor: np.ndarray, at: np.ndarray) -> list[int]:
        """Exact scores of the vectors ``at``."""
        if self.most * np.abs(anchor).sum() < EXACT:
            return (self.values[at] @ anchor).astype(np.int64).tolist()
        a = [int(x) for x in anchor]
        return [max(-(2**63), min(2**63 - 1, sum(x * int(y) for x, y in zip(a, self.values[i], strict=True)))) for i in at]

    def best(self, at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        return np.lexsort((self.ids[at], ~self.null[at], ~scores))[:k]


def reach(lower: np.ndarray, k: int) -> float:
    """The k-th largest of the lower bounds; all stay where there are fewer."""
    return float(np.partition(lower, len(lower) - k)[len(lower) - k]) if len(lower) >= k else -np.inf


def nearest_of_label(block: Block, anchor: pd.Series, vector: np.ndarray, k: int) -> Iterator[tuple]:
    """The block's k best rows but the anchor itself (place 0: they belong to no window); the block is one of its label."""
    other = np.flatnonzero(block.keys != anchor.key)
    lower, width = block.bounds(vector)
    at = other[lower[other] + width >= reach(lower[other], k)]
    scores = np.array(block.scores(vector, at), dtype=np.int64)
    for i in block.best(at, scores, k):
        yield 0, block.ids[at[i]], block.null[at[i]], scores[i]


def within_windows(block: Block, anchor: pd.Series, vector: np.ndarray, k: int) -> Iterator[tuple]:
    """The block's k best rows of other labels in each of the anchor's windows, by the place of its positive."""
    lower, width = block.bounds(vector)
    other = block.labels != anchor.label
    places, chance = [], np.zeros(len(lower), dtype=bool)
    for place, p in enumerate(anchor.positives):
        first, last = -(-50 * int(p) // 100), 95 * int(p) // 100
        if first <= last:
            certain = lower[other & (lower >= first) & (lower + width <= last)]
            chance |= other & (lower <= last) & (lower + width >= max(first, reach(certain, k)))
            places.append((place, first, last))
    at = np.flatnonzero(chance)
    scores = np.array(block.scores(vector, at), dtype=np.int64)
    for place, first, last in places:
        inside = np.flatnonzero((scores >= first) & (scores <= last))
        for i in inside[block.best(at[inside], scores[inside], k)]:
            yield place, block.ids[at[i]], block.null[at[i]], scores[i]


def held_against(rows: DataFrame, anchors: DataFrame, function: Callable, k: int, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """anchor_key, place, vec_id, score: what ``function`` finds for the anchors of each block (kind, deal) among its rows."""
    columns = ["kind", "deal", "key", "vec_id", "label", "v"]
    none = F.lit(None).cast("array<bigint>").alias("positives")
    both = rows.select(*columns, F.lit(0).alias("part"), none).unionByName(anchors.select(*columns, F.lit(1).alias("part"), "positives" if "positives" in anchors.columns else none))
    ordered = both.repartition("kind", "deal").sortWithinPartitions("kind", "deal", "part")
    out = {"anchor_key": pa.int64(), "place": pa.int32(), "vec_id": pa.int64(), "score": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = None, [], None
        for b in batches:
            frame = b.drop_columns(["v"]).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
            values = matrix(b.column("v"), len(low))
            for name, some in frame.groupby(["kind", "deal"], sort=False):
                if name != now:
                    now, parts, block = name, [], None
                own = (some["part"] == 0).to_numpy()
                if own.any():
                    parts.append((some[own], values[some.index[own]]))
                found = []
                for anchor, vector in zip(some[~own].itertuples(), values[some.index[~own]], strict=True):
                    if not parts:
                        break
                    block = block or Block(pd.concat([p for p, _ in parts]), np.concatenate([v for _, v in parts]), low, high)
                    found += [(int(anchor.key), place, None if null else int(i), int(s)) for place, i, null, s in function(block, anchor, vector, k)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), out.values(), strict=True)], list(out))

    return ordered.mapInArrow(run, "anchor_key bigint, place int, vec_id bigint, score bigint")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, rows_of_block: int = ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id, embedding, label).

    is_anchor is a condition on vec_id.  Negatives score between half and 95 hundredths of their positive.
    """
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    vector = F.col("embedding") if kind in ("float", "double") else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("v"))
    rows = settled(rows.where(usable(F.col("label"), F.col("v"))).withColumn("key", F.monotonically_increasing_id()))
    low, high = ranges(rows)
    anchors = rows.where(F.coalesce(is_anchor, F.lit(False)))
    blocks = lambda n: F.ceil(n / rows_of_block).cast("long")
    dealt = lambda n: F.pmod(F.xxhash64("key"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))

    sizes = rows.groupBy("label").agg(blocks(F.count("*")).alias("n"))
    by_label = lambda df, deal: df.join(sizes, "label").withColumn("kind", F.col("label")).withColumn("deal", deal(F.col("n")))
    near = held_against(by_label(rows, dealt), by_label(anchors, every), nearest_of_label, positives, low, high)
    order = Window.partitionBy("anchor_key").orderBy(F.desc("score"), F.asc_nulls_first("vec_id"))
    first = settled(near.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < positives))

    lists = first.groupBy("anchor_key").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("found"))
    asking = anchors.join(lists, F.col("key") == F.col("anchor_key")).withColumn("positives", F.col("found.score"))
    n = F.lit(max(1, -(-rows.count() // rows_of_block))).cast("long")
    whole = lambda df, deal: df.withColumn("kind", F.lit(0).cast("long")).withColumn("deal", deal(n))
    found = held_against(whole(rows, dealt), whole(asking, every), within_windows, negatives, low, high)
    order = Window.partitionBy("anchor_key", "place").orderBy(F.desc("score"), F.asc_nulls_first("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    of = first.select("anchor_key", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = ranked.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(of, ["anchor_key", "place"]).join(anchors.select(F.col("key").alias("anchor_key"), F.col("vec_id").alias("anchor_id")), "anchor_key")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(vectors: DataFrame, labels: int = 10, every: int = 7) -> DataFrame:
    """Moves each label on by one, modulo ``labels``, where vec_id is divisible by ``every``."""
    moved = F.when(F.coalesce(F.col("vec_id") % every == 0, F.lit(False)), (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return vectors.select("vec_id", "embedding", moved.alias("label"))
