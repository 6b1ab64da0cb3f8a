"""Removal of byte strings that occur earlier, by a sparse suffix array over the whole table.

A string of SPAN bytes is removed wherever it also starts earlier: in a document with a smaller id, or further up in the same
one.  The work follows from sorting suffixes, but only those at *anchors*: a start of GRAM bytes whose hash is the least among
the GRAM-byte strings of some SPAN bytes around it.  Which starts are anchors depends on the bytes alone, so equal
strings of SPAN bytes have an anchor at the same place, and about one start in 35 is one.

1. Anchors are sorted by the hash of their GRAM bytes, the hash of their surroundings (all bytes that a string of
   SPAN bytes around the anchor can reach) and their place.  The table is partitioned by ranges of all of that, so a group
   of copies of any size is spread over as many tasks as it fills.  An anchor that follows one with equal
   surroundings has all of them earlier: they are removed as a whole.  (Equal means two independent hashes of 64 bits.)
2. What is left, the first of each surroundings, matters only where its GRAM bytes have several surroundings.  Those
   are fetched from the texts and sent to a task by GRAM bytes.  There the suffixes that start at the anchors are sorted by
   hash-compared mergesort (``suffixes``), and so is what goes before the anchors, read backwards.  The lengths that neighbours
   share, verified byte by byte, tell which strings of SPAN bytes around the anchors are the same.
3. The strings around anchors with more than GROUP surroundings (11 MB of bytes) are looked up by two hashes of each string
   instead, sorted by ranges in the same way as anchors.

Spans are collected by document and cut out of its text in one pass.  Texts move twice (2. and the end), anchors once.

Null texts count as empty.  A null id comes before all others; of rows that share an id the one with the smaller hash of its text
comes first, and of rows that agree in both all but one count as copies.  Texts of less than SPAN bytes lose nothing; very long ones are hashed in slices.
Spans may cut a character in two, so what is kept is bytes.  An empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named_texts, stored
from .suffixes import Hashes, Suffixes, classes, mixed

SPAN, GRAM, GROUP = 100, 32, 1 << 16
#: Bytes that are hashed, and surroundings that are sorted, at once.
SLICE, SORTED = 1 << 19, 4096
REACH = SPAN - GRAM
REPEAT, SORT, LOOK_UP, OPEN = 0, 1, 2, 3
LATER, FIRST, LAST = 0, 1, 2


def sliding(x: np.ndarray, width: int, function: np.ufunc) -> np.ndarray:
    """Least or largest of each ``width`` neighbours, from each place on, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x, done = function(x[: len(x) - step], x[step:]), done + step
    return x


def slices(texts: list[bytes], most: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """Groups of (text, first byte, own first, own last place) of about ``most`` bytes; long texts in several, with margins."""
    group, size = [], 0
    for k, text in enumerate(texts):
        for own in range(0, len(text) - GRAM + 1, most) if len(text) >= SPAN else ():
            if size and size + min(most, len(text)) > most:
                yield group
                group, size = [], 0
            group.append((k, max(0, own - REACH), own, min(own + most, len(text))))
            size += min(most, len(text) - own) + SPAN
    if group:
        yield group


def anchors_in(texts: list[bytes], most: int = SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, gram hash, hash of surroundings, and place (times 128, plus the bytes after the gram, up to REACH) of all anchors."""
    found = []
    for group in slices(texts, most):
        parts = [texts[k][first : last + SPAN] for k, first, _, last in group]
        sizes = np.array([len(p) for p in parts])
        stops = np.cumsum(sizes)
        starts = stops - sizes
        buffer = np.frombuffer(b"".join(parts), dtype=np.uint8)
        one, two = Hashes(buffer), Hashes(buffer, 1)
        gram = one.of_length(GRAM) | np.uint64(1)
        least = sliding(gram, REACH + 1, np.minimum)  # of each string of SPAN bytes
        inside = np.ones(len(least), dtype=bool)
        for stop in stops[:-1]:
            inside[max(0, stop - SPAN + 1) : stop] = False
        least[~inside] = 0
        edge = np.zeros(REACH, dtype=np.uint64)
        at = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), REACH + 1, np.maximum) == gram)
        part = np.searchsorted(stops, at, side="right")
        text, first, own, last = (np.array(c)[part] for c in zip(*group, strict=True))
        place = at - starts[part] + first
        mine = (place >= own) & (place < last)
        at, text, place = at[mine], text[mine], place[mine]
        before = np.minimum(place, REACH)
        after = np.minimum(np.array([len(t) for t in texts])[text] - place - GRAM, REACH)
        around = mixed(two.of(at - before, at + GRAM + after) + before.astype(np.uint64))  # the same bytes around another place of them differ
        found.append((text, gram[at].view(np.int64), around.view(np.int64), place * 128 + after))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 4
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def utf8(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def anchors(rows: DataFrame) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, gram, around, at = anchors_in(utf8(b.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(around), b.column("doc_id").take(pa.array(text)), b.column("tie").take(pa.array(text)), pa.array(at)], ["gram", "around", "doc_id", "tie", "at"])

    return rows.select("doc_id", "tie", "text").mapInArrow(run, f"gram bigint, around bigint, doc_id {kind}, tie bigint, at bigint")


def judged(found: DataFrame, most: int = GROUP) -> DataFrame:
    """gram, doc_id, tie, at and verdict of the anchors that matter, in one pass over ranges in order.

    OPEN are the first of their surroundings whose gram isn't seen whole, at the edges of a range, or is too large to wait for its end.
    """
    kind = found.schema["doc_id"].dataType.simpleString()
    ordered = found.repartitionByRange("gram", "around", "doc_id", "tie", "at").sortWithinPartitions("gram", "around", "doc_id", "tie", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, edge, huge, held = None, None, None, None

        def told(b: pa.Table, verdict) -> Iterator[pa.RecordBatch]:
            verdict = pa.array(np.broadcast_to(verdict, len(b)).astype(np.int32))
            yield from b.append_column("verdict", verdict).combine_chunks().to_batches()

        for b in batches:
            if not len(b):
                continue
            gram, around = (b.column(c).to_numpy() for c in ("gram", "around"))
            edge = gram[0] if edge is None else edge
            before = last if last is not None else (~gram[0], around[0])
            lead = (gram != np.r_[before[0], gram[:-1]]) | (around != np.r_[before[1], around[:-1]])
            last = gram[-1], around[-1]
            some = pa.Table.from_batches([b]).drop_columns(["around"])
            yield from told(some.filter(pa.array(~lead)), REPEAT)
            some = some.filter(pa.array(lead))
            held = some if held is None else pa.concat_tables([held, some])
            gram = held.column("gram").to_numpy()
            if not len(gram):
                continue
            new = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            sizes = np.diff(np.r_[new, len(gram)])
            verdict = np.where((sizes > most) | (gram[new] == edge) | (gram[new] == huge if huge is not None else False), OPEN, np.where(sizes > 1, SORT, -1))
            verdict = np.repeat(verdict, sizes)
            whole = new[-1]
            if sizes[-1] > most or gram[-1] == huge:  # too many: what follows of it is open too
                huge, whole = gram[-1], len(gram)
            keep = verdict[:whole] >= 0
            yield from told(held.slice(0, whole).filter(pa.array(keep)), verdict[:whole][keep])
            held = held.slice(whole).combine_chunks()
        if held is not None:
            yield from told(held, OPEN)

    return ordered.mapInArrow(run, f"gram bigint, doc_id {kind}, tie bigint, at bigint, verdict int")


def settled_verdicts(marked: DataFrame, most: int) -> DataFrame:
    """The same with OPEN grams counted: up to ``most`` surroundings are sorted, more are looked up, a single one doesn't matter.

    There are at most two open grams for each range, and one for each ``most`` anchors.
    """
    counts = marked.where(F.col("verdict") == OPEN).groupBy("gram").agg(F.count("*").alias("n"))
    counted = marked.join(F.broadcast(counts), "gram", "left")
    verdict = F.when(F.col("verdict") != OPEN, F.col("verdict")).otherwise(F.when(F.col("n") > most, LOOK_UP).otherwise(SORT))
    return counted.where((F.col("verdict") != OPEN) | (F.col("n") > 1)).withColumn("verdict", verdict).drop("n")


def surroundings(rows: DataFrame, leads: DataFrame) -> DataFrame:
    """verdict, gram, doc_id, tie, start and bytes of the surroundings, and how far in the anchor is."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    lists = leads.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("at", "gram", "verdict")).alias("leads")).withColumnsRenamed({"doc_id": "d", "tie": "t"})
    joined = rows.select("doc_id", "tie", "text").join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t"))).select("doc_id", "tie", "text", "leads")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, texts = b.column("leads"), utf8(b.column("text"))
            which = np.repeat(np.arange(len(b)), lists.value_lengths().to_numpy(zero_copy_only=False))
            at, gram, verdict = (lists.flatten().field(c).to_numpy() for c in ("at", "gram", "verdict"))
            place, after = at // 128, at % 128
            before = np.minimum(place, REACH)
            start, stop = place - before, place + GRAM + after
            for low in range(0, len(at), 10_000):
                own = slice(low, low + 10_000)
                bytes_ = pa.array([texts[k][x:y] for k, x, y in zip(which[own].tolist(), start[own].tolist(), stop[own].tolist(), strict=True)], pa.binary())
                ids = pa.array(which[own])
                yield pa.RecordBatch.from_arrays([pa.array(verdict[own]), pa.array(gram[own]), b.column("doc_id").take(ids), b.column("tie").take(ids), pa.array(start[own]), pa.array(before[own].astype(np.int32)), bytes_], ["verdict", "gram", "doc_id", "tie", "start", "before", "around"])

    return joined.mapInArrow(run, f"verdict int, gram bigint, doc_id {kind}, tie bigint, start bigint, before int, around binary")


def strings_of(around: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A buffer of the surroundings; row, number in it, and start in the buffer, of each string of SPAN bytes."""
    sizes = np.array([len(x) for x in around.to_pylist()], dtype=np.int64)
    buffer = np.frombuffer(b"".join(around.to_pylist()), dtype=np.uint8)
    n = np.maximum(sizes - SPAN + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return buffer, row, number, (np.cumsum(sizes) - sizes)[row] + number


def spans_of(b: pa.Table, row: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
    """Maximal runs of repeated strings (numbers in order within a row) as spans of the documents."""
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (number[1:] != number[:-1] + 1)]) if len(row) else np.zeros(0, dtype=np.int64)
    end = np.r_[new[1:], len(row)] - 1 if len(row) else new
    start = b.column("start").to_numpy()[row[new]]
    ids = pa.array(row[new])
    columns = [b.column(c).combine_chunks().take(ids) for c in ("doc_id", "tie")]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.RecordBatch.from_arrays([*columns, pa.array(start + number[new]), pa.array(start + number[end] + SPAN)], ["doc_id", "tie", "start", "stop"])


def equal_strings(before: np.ndarray, after: np.ndarray, group: np.ndarray, start: np.ndarray, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """row and distance of the strings around anchors that an earlier row of the group has too.

    What follows the anchors is sorted, and, in the reversed buffer, what goes before them.  A string that begins ``distance`` bytes before
    its anchor equals another one if so many bytes before the anchors are shared and the rest of SPAN bytes from the anchors on.
    """
    anchor = start + before
    forward = Suffixes(buffer, SPAN).ordered(anchor, group)
    backward = Suffixes(buffer[::-1], REACH).ordered(len(buffer) - anchor, group)
    rows, distances = [], []
    for distance in range(REACH + 1):
        own = np.flatnonzero((before >= distance) & (after >= REACH - distance))
        left, right = classes(*backward, distance)[own], classes(*forward, SPAN - distance)[own]
        key = left * (len(start) + 1) + right
        order = np.argsort(key, kind="stable")
        later = own[order[1:]][key[order[1:]] == key[order[:-1]]]
        rows.append(later)
        distances.append(np.full(len(later), distance))
    return np.concatenate(rows), np.concatenate(distances)


def sorted_repeats(contexts: DataFrame) -> DataFrame:
    """doc_id, tie, start, stop of the repeats among surroundings of the same gram, all of which one task has."""
    kind = contexts.schema["doc_id"].dataType.simpleString()
    ordered = contexts.repartition("gram").sortWithinPartitions("gram", "doc_id", "tie", "start", "before")

    def repeats(b: pa.Table) -> pa.RecordBatch:
        around, gram, before = b.column("around").to_pylist(), b.column("gram").to_numpy(), b.column("before").to_numpy().astype(np.int64)
        sizes = np.array([len(x) for x in around], dtype=np.int64)
        group = np.cumsum(np.r_[0, gram[1:] != gram[:-1]])
        row, distance = equal_strings(before, sizes - before - GRAM, group, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(around), dtype=np.uint8))
        number = before[row] - distance
        order = np.lexsort((number, row))
        return spans_of(b, row[order], number[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for low in range(0, len(b), SORTED):
                some = pa.Table.from_batches([b.slice(low, SORTED)])
                held = some if held is None else pa.concat_tables([held, some])
                gram = held.column("gram").to_numpy()
                whole = len(gram) - int(np.argmax(gram[::-1] != gram[-1])) if (gram != gram[-1]).any() else 0  # the last gram may go on
                if len(held) >= SORTED and whole:
                    yield repeats(held.slice(0, whole).combine_chunks())
                    held = held.slice(whole).combine_chunks()
        if held is not None and len(held):
            yield repeats(held)

    return ordered.mapInArrow(run, f"doc_id {kind}, tie bigint, start bigint, stop bigint")


def looked_up_repeats(contexts: DataFrame) -> DataFrame:
    """The same by hashes of each string, for grams with any number of surroundings.

    Strings are sorted by ranges of hash and place, as anchors are, and one that follows an equal one is a repeat.  The first string
    of a range is held against the last one before it; those, two rows for each range, meet on the driver.
    """
    kind = contexts.schema["doc_id"].dataType.simpleString()
    schema = f"one bigint, two bigint, doc_id {kind}, tie bigint, start bigint"

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, len(b), SORTED):
                some = b.slice(low, SORTED)
                buffer, row, number, start = strings_of(some.column("around"))
                one, two = (Hashes(buffer, k).of(start, start + SPAN).view(np.int64) for k in (0, 1))
                ids = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), some.column("doc_id").take(ids), some.column("tie").take(ids), pa.array(some.column("start").to_numpy()[row] + number)], ["one", "two", "doc_id", "tie", "start"])

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        range_, last = TaskContext.get().partitionId(), None

        def told(b: pa.RecordBatch, role: int) -> pa.RecordBatch:
            for name, value in (("range", pa.array(np.full(len(b), range_))), ("role", pa.array(np.full(len(b), role, dtype=np.int32)))):
                b = b.append_column(name, value)
            return b

        for b in batches:
            if not len(b):
                continue
            ids = b.column("doc_id").dictionary_encode("encode").indices
            columns = [x.to_numpy() for x in (*(b.column(c) for c in ("one", "two", "tie", "start")), ids)]
            edge = [tuple(b.column(c)[k].as_py() for c in b.schema.names) for k in (0, len(b) - 1)]
            if last is None:
                yield told(b.slice(0, 1), FIRST)
            same = [np.r_[False, c[1:] == c[:-1]] for c in columns]
            again = same[0] & same[1] & ~(same[2] & same[3] & same[4])  # the same string at another place
            again[0] = last is not None and last[:2] == edge[0][:2] and last != edge[0]
            yield told(b.filter(pa.array(again)), LATER)
            last, end = edge[1], b.slice(len(b) - 1, 1)
        if last is not None:
            yield told(end, LAST)

    order = ["one", "two", "doc_id", "tie", "start"]
    ranges = contexts.mapInArrow(strings, schema).repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(ranges.mapInArrow(later, schema + ", range bigint, role int"))
    edges = {(r["range"], r["role"]): tuple(r[c] for c in order) for r in found.where(F.col("role") != LATER).collect()}
    present = sorted({r for r, _ in edges})
    again = [b for a, b in pairwise(present) if edges[a, LAST][:2] == edges[b, FIRST][:2] and edges[a, LAST] != edges[b, FIRST]]
    hit = (F.col("role") == LATER) | ((F.col("role") == FIRST) & F.col("range").isin(again))
    return found.where(hit).select("doc_id", "tie", "start", (F.col("start") + SPAN).alias("stop"))


def united(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of the union of spans (start, stop)."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reached = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reached[:-1]]
    return np.column_stack([spans[new, 0], reached[np.r_[np.flatnonzero(new)[1:] - 1, len(spans) - 1]]])


def cut_out(rows: DataFrame, spans: DataFrame, with_bytes: bool) -> DataFrame:
    """One row for each document, without the spans."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    lists = spans.groupBy(F.col("doc_id").alias("d"), F.col("tie").alias("t")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left").select("doc_id", "text", "copies", "spans")
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, out, ids = b.column("spans"), [], []
            edges = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(int)
            flat = lists.flatten()
            flat = np.column_stack([flat.field(c).to_numpy() for c in ("start", "stop")])
            for k, (text, copies) in enumerate(zip(utf8(b.column("text")), b.column("copies").to_pylist(), strict=True)):
                own = flat[edges[k] : edges[k + 1]]
                for copy in range(copies):
                    removed = np.array([[0, len(text)]]) if copy and len(text) >= SPAN else united(own) if len(own) and not copy else np.zeros((0, 2), dtype=np.int64)
                    kept, at = [], 0
                    for start, stop in removed.tolist():
                        kept.append(text[at:start])
                        at = stop
                    kept = b"".join([*kept, text[at:]])
                    out.append((len(text), len(text) - len(kept), len(removed), hashlib.sha256(kept).hexdigest(), kept))
                    ids.append(k)
            columns = list(zip(*out, strict=True)) or [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(ids, pa.int64())), *arrays[: 4 + with_bytes]], ["doc_id", *names[: 4 + with_bytes]])

    return joined.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_bytes: bool = False, most: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; with_bytes: also the bytes that are left.

    Grams with more than ``most`` surroundings are looked up by hashes of strings.
    """
    rows = named_texts(docs, id_column, text_column)
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = rows.select("doc_id", F.lit(0).cast("long").alias("tie"), "text", F.lit(1).cast("long").alias("copies"))
    else:
        rows = rows.groupBy("doc_id", "text").agg(F.count("*").alias("copies")).withColumn("tie", F.xxhash64("text"))
    marked = stored(judged(anchors(rows), most))
    contexts = stored(surroundings(rows, settled_verdicts(marked.where(F.col("verdict") != REPEAT), most)))
    place, after = F.floor(F.col("at") / 128), F.col("at") % 128
    whole = marked.where(F.col("verdict") == REPEAT).select("doc_id", "tie", F.greatest(place - REACH, F.lit(0)).alias("start"), (place + GRAM + after).alias("stop"))
    spans = whole.unionByName(sorted_repeats(contexts.where(F.col("verdict") == SORT))).unionByName(looked_up_repeats(contexts.where(F.col("verdict") == LOOK_UP)))
    return cut_out(rows, spans, with_bytes)
