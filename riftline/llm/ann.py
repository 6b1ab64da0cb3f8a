"""Approximate nearest neighbours by a hash-prefix forest.

Each of ``trees`` trees gives every vector a string: first the axis, with its sign, to which the vector comes nearest
after a random rotation (cross-polytope hashing), then BITS signs of random projections.  Near vectors tend to share
long prefixes; a prefix of level 1 is the axis, each further level one sign more, level 0 the root.  A tree is a sorted
array of (string, place of the vector), cut by the prefixes of one level into arrays of bounded length, where a prefix of
any longer level is found by binary search.  Vectors themselves are in blocks of their own and are fetched once,
for the candidates of all trees together.

A query descends all trees to its longest prefixes and ascends in all of them at once, a level at a time, until the
prefixes hold at least a certain number of vectors together; at the root it meets every vector.  Only its own array of each
tree is looked at.  Queries that have to ascend above the level at which trees are cut go on with trees that
are cut at half that level, down to the root.  Candidates are scored by exact Euclidean distance in double precision on
the original vectors.

That number follows from the table: up to CALIBRATED of its queries are compared with every vector first, and it
is the smallest one, ``least`` or more, with which they find the share ``recall`` of their neighbours, two standard
errors allowed for.  At the root all are found, so there always is one; vectors without structure get there, or to
the first level, whatever the table's size.

Equal vectors are hashed and scored once, with their smallest ids: more than k + 1 of them can't be among k
neighbours.  Vectors that are null, zero, or hold null or non-finite components take no part; vectors of
another length than a query's are no candidates of it.  Ties go to the smaller id; rows without an id are
ignored; a repeated id counts once, with its nearest vector, and asks with its smallest; an empty table gives an
empty result; only id and vector are read, so other columns may have any name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_KEYS, settled

TREES, BITS, LEAST = 48, 48, 2500
LEVELS = BITS + 1
#: Rows of an array, vectors of a block, and candidates that one task scores, about.
ARRAY_ROWS, BLOCK_ROWS, TASK_CANDIDATES = 100_000, 20_000, 8_000_000
SEED = 20_240_117
#: Share of the neighbours to be found, with room for the choice of the smallest number that finds it in the sample, and
#: queries compared with the whole table to see to it.
RECALL, CALIBRATED = 0.94, 200
KEYS = ["dim", "tree", "prefix", "part"]

_projections: dict[tuple[int, int], np.ndarray] = {}


def projections(dim: int, trees: int) -> np.ndarray:
    """A rotation and BITS directions for each tree, the same in every process: (trees, dim, dim + BITS)."""
    if (dim, trees) not in _projections:
        rng = np.random.default_rng(SEED + dim)
        _projections[dim, trees] = np.stack([np.hstack([np.linalg.qr(rng.standard_normal((dim, dim)))[0], rng.standard_normal((dim, BITS))]) for _ in range(trees)]).astype(np.float32)
    return _projections[dim, trees]


def strings(vectors: np.ndarray, trees: int) -> np.ndarray:
    """(rows, trees): each tree's string as a number, the axis highest, then the signs."""
    n, dim = vectors.shape
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
    out = np.zeros((n, trees), dtype=np.int64)
    for t, p in enumerate(projections(dim, trees)):
        turned = unit @ p
        axis = np.abs(turned[:, :dim]).argmax(axis=1)
        first = 2 * axis + (turned[np.arange(n), axis] > 0)
        out[:, t] = (first << BITS) | ((turned[:, dim:] > 0) @ (1 << np.arange(BITS, dtype=np.int64)))
    return out


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def with_strings(rows: DataFrame, trees: int) -> DataFrame:
    """Adds ``strings`` to rows with ``embedding``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, part in b.groupby(b["embedding"].map(len).to_numpy()):
                yield part.assign(strings=list(strings(np.stack(part["embedding"].to_numpy()).astype(np.float64), trees)))

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{columns}, strings array<bigint>")


def placed(rows: DataFrame, total: int) -> DataFrame:
    """Adds a place among all ``total`` vectors, whose partitions must be settled: block, of about BLOCK_ROWS however the table is dealt, and place in it.

    Vectors are numbered from 0 by what lies in the partitions before; blocks take them in turn.
    """
    part, number = F.spark_partition_id().alias("part"), F.monotonically_increasing_id()  # the partition above 33 bits, the row below
    sizes = rows.groupBy(part).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # a row for each partition
    dealt = rows.select(*rows.columns, part, number.bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    blocks, at = total // BLOCK_ROWS + 1, F.col("before") + F.col("row")
    numbered = dealt.join(F.broadcast(offsets), "part").select(*rows.columns, at.alias("number"))
    return numbered.select(*rows.columns, (F.col("number") % blocks).alias("block"), F.floor(F.col("number") / blocks).cast("int").alias("place"))


def shared_level(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the prefix that strings have in common."""
    different = np.frexp((a ^ b).astype(np.float64))[1]  # the number of bits from the first difference on
    return np.maximum(LEVELS - different, 0)


def compared(indexed: DataFrame, asked: list[tuple], k: int) -> DataFrame:
    """A few queries (id, vector, strings) against all vectors.

    Rows with vec_id: at least each query's k nearest, with score and the longest prefix shared in any tree; rows
    without: how many prefixes of exactly that level vectors share with the query, over all trees.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby(b["embedding"].map(len).to_numpy()):
                vectors, codes, ids = np.stack(part["embedding"].to_numpy()).astype(np.float64), np.stack(part["strings"].to_numpy()), part["ids"].to_numpy()
                for query_id, vector, own in asked:
                    if len(vector) != dim:
                        continue
                    level = shared_level(codes, np.asarray(own)[None])
                    distance = np.sqrt(((vectors - np.asarray(vector, dtype=np.float64)) ** 2).sum(axis=1))
                    near = np.argsort(distance, kind="stable")[: k + 1]  # one more than k: the query itself is there
                    best = level[near].max(axis=1)
                    out = [(query_id, i, distance[at], shared, 0) for at, shared in zip(near, best, strict=True) for i in ids[at] if i != query_id]
                    out += [(query_id, None, None, shared, n) for shared, n in enumerate(np.bincount(level.ravel())) if n]
                    out = pd.DataFrame(out, columns=["query_id", "vec_id", "score", "shared", "n"])
                    yield out.astype({"vec_id": "Int64"})

    return indexed.select("ids", "embedding", "strings").mapInPandas(run, "query_id bigint, vec_id bigint, score double, shared bigint, n bigint")


def enough(held: np.ndarray, shared: list[np.ndarray], least: int, recall: float) -> int:
    """The smallest number of vectors, ``least`` or more, to ascend to for the recall.

    held: (queries, depth) vectors under each query's prefixes of 1, 2, ... characters; shared: each query's
    longest prefixes in common with its true neighbours.
    """
    if not len(held):
        return least
    for n in [least, *sorted({int(x) + 1 for x in held.ravel() if x >= least})]:
        level = ((held >= n) * np.arange(1, held.shape[1] + 1)).max(axis=1)
        each = np.array([(s >= at).mean() for s, at in zip(shared, level, strict=True)])
        if each.mean() - 2 * each.std() / len(each) ** 0.5 >= recall:
            return n
    return max(least, int(held.max()) + 1)


def needed(indexed: DataFrame, queries: DataFrame, k: int, trees: int, least: int, recall: float) -> int:
    """How many vectors the ascent has to meet, from a comparison of a bounded number of queries with the whole table."""
    sample = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATED).collect()
    if not sample:
        return least
    rows = settled(compared(indexed, [(r["query_id"], r["embedding"], r["strings"]) for r in sample], k))
    shared, held = defaultdict(list), {}
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    for r in rows.where("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).collect():
        shared[r["query_id"]].append(r["shared"])
    for r in rows.where("vec_id IS NULL").groupBy("query_id", "shared").agg(F.sum("n").alias("n")).collect():
        held.setdefault(r["query_id"], np.zeros(LEVELS + 1, dtype=np.int64))[r["shared"]] = r["n"]
    tried = sorted(shared)
    if not tried:
        return least
    under = np.stack([np.cumsum(held[q][::-1])[::-1][1:] - trees for q in tried])  # without the query itself
    return enough(under, [np.array(shared[q]) for q in tried], least, recall)


def by_tree(rows: DataFrame, level: int, *also: str) -> DataFrame:
    """One row for each tree, with its string and the prefix of ``level`` that names the array."""
    each = rows.select(*also, F.size("embedding").alias("dim"), F.posexplode("strings").alias("tree", "string"))
    return each.withColumn("prefix", F.shiftright("string", BITS - level + 1) if level else F.lit(0).cast("long"))


def prefix_ranges(array: np.ndarray, strings_: np.ndarray, level: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in a sorted array the strings with the same prefixes of ``level`` begin and end."""
    shift = np.where(level > 0, BITS - level + 1, 62)
    low = strings_ >> shift << shift
    return np.searchsorted(array, low), np.searchsorted(array, low + (np.int64(1) << shift))


def count_prefixes(rows: pd.DataFrame, asked: pd.DataFrame, level: int) -> pd.DataFrame:
    """How many other vectors of the array share each query's prefix of each level from ``level`` on: one row for each query, up to the last level that another shares."""
    array, own = np.sort(rows["string"].to_numpy()), asked["string"].to_numpy()
    shared = []
    for at in range(level, LEVELS + 1):
        low, high = prefix_ranges(array, own, np.full(len(own), at))
        if not (high - low > 1).any():
            break
        shared.append(high - low - 1)
    if not shared:
        return pd.DataFrame(columns=["query_id", "counts"], dtype=object)
    counts = np.stack(shared, axis=1)
    met = counts[:, 0] > 0  # counts fall from level to level
    return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[met], "counts": [c[c > 0] for c in counts[met]]})


def list_candidates(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The vectors under each query's prefix of its level: one row for each query, with blocks and the places in each."""
    order = np.argsort(rows["string"].to_numpy(), kind="stable")
    array, block, place = (rows[c].to_numpy()[order] for c in ("string", "block", "place"))
    low, high = prefix_ranges(array, asked["string"].to_numpy(), asked["level"].to_numpy(np.int64))
    out = []
    for query_id, a, b in zip(asked["query_id"], low, high, strict=True):
        by_block = np.argsort(block[a:b], kind="stable")
        blocks, starts = np.unique(block[a:b][by_block], return_index=True)
        out.append((query_id, blocks, np.split(place[a:b][by_block], starts[1:]) if len(blocks) else []))
    return pd.DataFrame(out, columns=["query_id", "blocks", "places"], dtype=object)


def score_block(rows: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best of a block's vectors for each query, among the candidates that the trees have given."""
    rows = rows.sort_values("place")
    ids, each = rows["ids"].to_numpy(), rows["embedding"].to_numpy()
    whole = np.stack(each).astype(np.float64) if len(set(map(len, each))) == 1 else None
    out: list[tuple[int, int, float]] = []
    for query_id, mine in asked.groupby("query_id"):
        lists = [p for p in mine["places"] if p is not None]
        vector = next(v for v in mine["embedding"] if v is not None)
        places = np.unique(np.concatenate(lists))
        some = whole[places] if whole is not None else np.stack(each[places]).astype(np.float64)
        distance = np.sqrt(((some - np.asarray(vector, dtype=np.float64)) ** 2).sum(axis=1))
        reach = np.partition(distance, min(k, len(places) - 1))[min(k, len(places) - 1)]  # one more than k: the query itself is there
        out += [(query_id, i, distance[at]) for at in np.flatnonzero(distance <= reach) for i in ids[places[at]] if i != query_id]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


class Forest:
    """The trees cut by prefixes of one level; arrays that are still long are dealt by place into parts."""

    def __init__(self, indexed: DataFrame, level: int, total: int, trees: int):
        self.level, rows = level, by_tree(indexed, level, "block", "place")
        limit = max(ARRAY_ROWS, total * trees // HOT_KEYS)  # at most HOT_KEYS arrays are longer
        sizes = rows.groupBy("dim", "tree", "prefix").agg(F.count("*").alias("n")).where(F.col("n") > limit)
        self.long = settled(sizes.select("dim", "tree", "prefix", F.ceil(F.col("n") / limit).cast("int").alias("parts")))
        parts = F.coalesce("parts", F.lit(1))
        self.rows = rows.join(F.broadcast(self.long), ["dim", "tree", "prefix"], "left").withColumn("part", F.pmod(F.xxhash64("block", "place"), parts).cast("int")).drop("parts")

    def ask(self, queries: DataFrame, function, schema: str, *also: str) -> DataFrame:
        """What ``function`` gives for each array and the queries that belong to it."""
        mine = by_tree(queries, self.level, "query_id", *also)
        if also:  # the root is met in one tree only
            mine = mine.where("level > 0 OR tree = 0")
        dealt = mine.join(F.broadcast(self.long), ["dim", "tree", "prefix"], "left")
        dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        columns = [c.split()[0] for c in schema.split(", ")]
        none = pd.DataFrame(columns=columns, dtype=object)
        return self.rows.groupBy(*KEYS).cogroup(dealt.groupBy(*KEYS)).applyInPandas(lambda left, right: function(left, right) if len(left) and len(right) else none, schema)


def candidates(indexed: DataFrame, queries: DataFrame, total: int, trees: int, least: int) -> DataFrame:
    """query_id, block, places: the candidates of each query, by tree; one may come from several trees."""
    dims = queries.agg(F.min(F.size("embedding"))).first()[0] or 1
    level = 0
    while level < LEVELS and (2 * dims << level >> 1 if level else 1) * ARRAY_ROWS < total:
        level += 1
    found, open_ = None, queries
    while True:
        forest = Forest(indexed, level, total, trees)
        counts = forest.ask(open_, lambda a, b, level=level: count_prefixes(a, b, level), "query_id bigint, counts array<bigint>")
        each = counts.select("query_id", F.posexplode("counts").alias("at", "n")).select("query_id", (F.col("at") + level).alias("level"), "n")
        met = each.groupBy("query_id", "level").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        reached = settled(open_.join(met.groupBy("query_id").agg(F.max("level").alias("level")), "query_id", "left"))
        ready = reached.withColumn("level", F.coalesce("level", F.lit(0))) if level == 0 else reached.where("level IS NOT NULL")
        listed = forest.ask(ready, list_candidates, "query_id bigint, blocks array<bigint>, places array<array<int>>", "level")
        part = settled(listed.select("query_id", F.explode(F.arrays_zip("blocks", "places")).alias("one")).select("query_id", "one.blocks", "one.places").withColumnRenamed("blocks", "block"))
        found = part if found is None else found.unionByName(part)
        open_ = reached.where("level IS NULL").drop("level")
        if level == 0 or open_.isEmpty():
            return found
        level //= 2


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    trees: int = TREES,
    least: int = LEAST,
    recall: float = RECALL,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query; is_query is a condition on vec_id."""
    kind = vectors.schema[vector_column].dataType.elementType.simpleString()
    vector = F.col(f"`{vector_column}`")
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), (vector if kind in ("float", "double") else vector.cast("array<double>")).alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    equal = [F.xxhash64("embedding"), F.xxhash64(F.lit(SEED), "embedding"), F.size("embedding")]
    numbered = rows.withColumn("r", F.row_number().over(Window.partitionBy(*equal).orderBy("vec_id"))).where(F.col("r") <= k + 1)
    distinct = numbered.groupBy(*[e.alias(f"e{n}") for n, e in enumerate(equal)]).agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("embedding").alias("embedding"))
    coded = settled(with_strings(distinct.select("ids", "embedding"), trees))
    total = coded.count()
    indexed = settled(placed(coded, total))
    asked = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    queries = settled(with_strings(asked, trees))
    met = settled(candidates(indexed, queries, total, trees, needed(indexed, queries, k, trees, least, recall)))

    # Blocks with very many candidates are scored by several tasks, each with some of the queries.
    most = met.groupBy("block").agg(F.sum(F.size("places")).alias("n")).agg(F.max("n")).first()[0] or 0
    salts = most // TASK_CANDIDATES + 1
    salt = F.pmod(F.xxhash64("query_id"), F.lit(salts)).cast("int").alias("salt")
    lists = met.select("block", salt, "query_id", "places", F.lit(None).cast(indexed.schema["embedding"].dataType).alias("embedding"))
    askers = met.select("query_id", "block").distinct().join(queries.select("query_id", "embedding"), "query_id")
    asking = lists.unionByName(askers.select("block", salt, "query_id", F.lit(None).cast("array<int>").alias("places"), "embedding"))
    blocks = indexed.select("block", "place", "ids", "embedding", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    scored = blocks.groupBy("block", "salt").cogroup(asking.groupBy("block", "salt")).applyInPandas(
        lambda left, right: score_block(left, right, k) if len(left) and len(right) else none, "query_id bigint, vec_id bigint, score double"
    )
    once = scored.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
