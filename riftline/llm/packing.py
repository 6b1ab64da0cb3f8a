"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Sizes are integers up to the capacity, so the packing is planned over the histogram of piece lengths, which
has at most ``capacity`` rows however many documents there are:

1. pieces above a third of the capacity ("large") can share a sequence with at most one other large piece;
   they are matched greedily, the largest with the largest partner that still fits;
2. smaller pieces, from the longest down, go where the remaining gap is smallest (best fit), and open new
   sequences only when no gap is wide enough.

The plan is a list of patterns with multiplicities.  Pieces are numbered within their length (in groups of about
GROUP_ROWS, so that no length has to be sorted by one task) and look up their place by that number.  Pieces of the full
capacity share with none: they get sequences of their own without being numbered or moved.

Edge cases: a null or empty text is the single end id; a document over the capacity is cut into pieces of
the capacity and a rest; ties in length are settled by id, row and piece; repeated rows are packed each, and ``row``
tells them apart; a null id stays null and leaves the others as they are; an empty table gives an empty result; only id
and text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_portions, named_texts, stored
from .wordbpe import merger

END = (0).to_bytes(4, "little")
PIECES = "row bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Pieces of one length that are numbered by one task, about.
GROUP_ROWS = 100_000


def cut_into_pieces(texts: DataFrame, vocabulary: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of texts (doc_id, text); ``row`` is a number of the text's row of its own.

    with_ids adds the little-endian 32-bit ids themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, step, row = merger(vocabulary), 4 * capacity, TaskContext.get().partitionId() << 40
        for b in in_portions(batches):
            of, rows, parts = [], [], []
            for n, text in enumerate(b.column("text").to_pylist()):
                ids = m.packed(text or "") + END
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    of.append(n)
                    rows.append((row, k, k * capacity, len(part) // 4, zlib.crc32(part)))
                    parts.append(part)
                row += 1
            table = np.array(rows, dtype=np.int64).reshape(-1, 5).T
            columns = [b.column("doc_id").take(pa.array(of, pa.int64())), pa.array(table[0]), pa.array(table[1].astype(np.int32)), *map(pa.array, table[2:])]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(parts, pa.binary())] if with_ids else [])], ["doc_id", "row", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, {PIECES}" + (", ids binary" if with_ids else ""))


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, copies), ...], how many sequences) that place every piece of the histogram."""
    left = {size: n for size, n in histogram.items() if n}
    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    by_gap: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}

    def put(pattern: list[tuple[int, int]], n: int) -> None:
        if n:
            by_gap.setdefault(capacity - sum(s * c for s, c in pattern), []).append((pattern, n))

    for a in large:
        for b in large:
            if not left[a]:
                break
            if b > a or a + b > capacity or not left[b]:
                continue
            n = left[a] // 2 if a == b else min(left[a], left[b])
            put([(a, 2)] if a == b else [(a, 1), (b, 1)], n)
            left[a] -= n
            left[b] -= n
        put([(a, 1)], left[a])
        left[a] = 0
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[size]
        while n:
            gap = min((g for g in by_gap if g >= size), default=None)
            if gap is None:
                each = capacity // size
                put([(size, each)], n // each)
                put([(size, n % each)], bool(n % each))
                break
            pattern, bins = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
            each = gap // size
            full = min(bins, n // each)
            put([*pattern, (size, each)], full)
            n -= full * each
            rest = bins - full
            if rest and n:  # fewer than `each` are left: they share one more sequence
                put([*pattern, (size, n)], 1)
                n, rest = 0, rest - 1
            put(pattern, rest)
    return [x for patterns in by_gap.values() for x in patterns]


def places(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """For each run of numbers within a length: where it begins, its copies in a sequence, first sequence, offset."""
    rows, used, first = [], {}, 0
    for pattern, n in patterns:
        offset = 0
        for size, copies in pattern:
            begin = used.get(size, 0)
            rows.append((size, begin, copies, first, offset))
            used[size] = begin + copies * n
            offset += size * copies
        first += n
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "begin", "copies", "first", "offset"), columns, strict=True))


def number_within_length(pieces: DataFrame, most: int) -> DataFrame:
    """Adds ``rank``, from 0 within each length, without sorting a whole length, of at most ``most`` pieces, in one task."""
    salts = most // GROUP_ROWS + 1
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "row", "piece")
    return salted.withColumn("r", F.row_number().over(within) - 1).join(starts, ["length", "salt"]).withColumn("rank", F.col("r") + F.col("before")).drop("r", "before", "salt")


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to settled pieces; only the histogram of lengths comes to the driver."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    full = histogram.pop(capacity, 0)
    patterns = plan(histogram, capacity)
    where, planned = places(patterns), sum(n for _, n in patterns)
    numbered = number_within_length(pieces.where(F.col("length") < capacity), max(histogram.values(), default=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (where["length"] << 48) | where["begin"]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            k = rank - where["begin"][at]
            out = [where["first"][at] + k // where["copies"][at], where["offset"][at] + (k % where["copies"][at]) * length]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *map(pa.array, out)], [*kept, "sequence_id", "offset"])

    kept = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id bigint, offset bigint"
    shared = numbered.select(*kept, "rank").mapInArrow(run, schema)
    alone = pieces.where(F.col("length") == capacity).select("*", (F.monotonically_increasing_id() + planned).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(alone) if full else shared


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Cuts documents into pieces and packs them: one row per piece with its sequence and offset."""
    texts = named_texts(docs, id_column, text_column)
    return pack_pieces(stored(cut_into_pieces(texts, vocabulary, capacity, with_ids)), capacity)
