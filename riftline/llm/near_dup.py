"""Near-duplicate documents by one-permutation MinHash with optimal densification.

1. A document is the set of its distinct five-word shingles (64-bit hashes).  One permutation deals the set
   into bins that each keep their smallest hash; an empty bin takes the value of a bin that is chosen by
   hashing until one with a value is met.  Bands of the sketch give bucket keys; how many and how wide follows
   from the threshold.
2. Documents with equal sets become one node, known by the set's fingerprint and not by any document's id, so exact
   copies are never paired and an id that is repeated with another text is not mistaken for one.
3. In every bucket, candidate edges form a star: all members to the member that meets most others over all its
   buckets.  A star has as many edges as members, whatever the bucket's size.
4. Edges are confirmed on full sets; confirmed ones make components.
5. Stars alone could miss a link between two members that aren't linked to a centre.  For buckets in which several
   components are left, the rest is found exactly: their members' shingles, rarest first, are joined by prefix,
   with length and positional filters and only across components, and confirmed on full sets.  In each
   prefix list the largest component meets the others, never itself; long lists are dealt over several tasks.

A pair of the threshold's similarity shares no bucket with a probability below 3 in 10 million: (1 - 0.85**6)**32 at
85 per cent, (1 - 0.8**5)**38 at 80.

Edge cases: null and empty texts, or texts of white space, have an empty set and are linked with nothing;
texts of fewer than five words are one shingle of all their words; repeated rows are copies; rows that share an id but
not a text each link on their own, and may have different components; rows without an id link nothing, get a null
component and are not kept; an empty table gives an empty result; only id and text are read, so other columns may have
any name; ids may be of any type that can be ordered.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log, log1p

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, LEAST_HOT, named_texts, settled, with_results
from .components import connected_components

SHINGLE = 5
THRESHOLD = 85  #: per cent, unless a caller asks for another
#: Probability that a pair of the threshold's similarity shares no bucket, and the most bins of a sketch.
MISSED, MOST_BINS = 3e-7, 192
#: Words remembered by one worker; when full, the table starts again.
REMEMBERED = 200_000


def layout(threshold: int) -> tuple[int, int]:
    """Bands and bins a band: the widest bands that keep within MISSED and MOST_BINS; 32 of 6 for 85 per cent."""
    fits = [(ceil(log(MISSED) / log1p(-((threshold / 100) ** size))), size) for size in range(1, 17)] if threshold < 100 else [(1, 1)]
    return max((f for f in fits if f[0] * f[1] <= MOST_BINS), key=lambda f: f[1], default=fits[0])


BANDS, BAND_SIZE = layout(THRESHOLD)

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(SHINGLE, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width))
    for k in range(width):
        out = mixed((out + h[k : len(h) - width + 1 + k]) * _ODD)
    return np.unique(out)


def sketch(values: np.ndarray, n_bins: int = BANDS * BAND_SIZE) -> np.ndarray:
    """One-permutation MinHash of a non-empty set, densified."""
    spread = mixed(values + _ODD)
    bins = ((spread >> np.uint64(32)) * np.uint64(n_bins) >> np.uint64(32)).astype(np.int64)
    out = np.full(n_bins, _EMPTY)
    np.minimum.at(out, bins, spread)
    empty = out == _EMPTY
    if empty.any():
        full, todo, attempt = out.copy(), np.flatnonzero(empty), 1
        while len(todo):
            chosen = (mixed((todo + attempt * n_bins).astype(np.uint64) * _ODD) % np.uint64(n_bins)).astype(np.int64)
            met = ~empty[chosen]
            out[todo[met]] = full[chosen[met]]
            todo, attempt = todo[~met], attempt + 1
    return out


def band_keys(values: np.ndarray, bands: int = BANDS, size: int = BAND_SIZE) -> np.ndarray:
    """A 64-bit bucket key for each band."""
    rows = sketch(values, bands * size).reshape(bands, size)
    keys = mixed(np.arange(1, bands + 1, dtype=np.uint64))
    for k in range(size):
        keys = mixed((keys ^ rows[:, k]) * _ODD)
    return keys.view(np.int64)


def describe(texts: DataFrame, bands: int = BANDS, size: int = BAND_SIZE) -> DataFrame:
    """The columns of ``texts`` but its text, n_shingles, the set's fingerprint (two longs) and its bucket keys."""

    def described(batch: list[str | None]) -> dict[str, Sequence]:
        sets = [shingles(t) for t in batch]
        prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), dtype=">i8").astype(np.int64).reshape(-1, 2)
        keys = [band_keys(s, bands, size) if len(s) else None for s in sets]
        return {"n_shingles": [len(s) for s in sets], "high": prints[:, 0], "low": prints[:, 1], "keys": keys}

    return with_results(texts, "n_shingles bigint, high bigint, low bigint, keys array<bigint>", described)


def sets_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its whole shingle set, from the row (doc_id, text_hash) that stands for each node."""
    wanted = texts.join(nodes.select("doc_id", "text_hash", "node"), ["doc_id", "text_hash"]).dropDuplicates(["node"]).select("node", "text")
    return with_results(wanted, "tokens array<bigint>", lambda batch: {"tokens": [shingles(t).view(np.int64) for t in batch]})


def long_enough(a: Column, b: Column, threshold: int = THRESHOLD) -> Column:
    """Whether sets of these sizes can reach the threshold."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * threshold


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    held = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("shared"), (F.size("x") + F.size("y")).cast("long").alias("total"))
    return held.where(F.col("shared") * 100 >= (F.col("total") - F.col("shared")) * threshold).select("a", "b")


def star_edges(members: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Edges (a, b) from each bucket's centre a to its other members b; members: bucket, node, n.

    Rows of a bucket meet its centre in a join, whose large keys Spark deals anew; they are never gathered.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    shared = members.join(sizes, "bucket")
    popular = shared.groupBy("node").agg(F.sum("members").alias("met"))
    ranked = shared.join(popular, "node").select("bucket", "node", "n", "met")
    centres = ranked.groupBy("bucket").agg(F.max_by(F.struct(F.col("node").alias("a"), F.col("n").alias("an")), F.struct("met", -F.col("node"))).alias("c")).select("bucket", "c.a", "c.an")
    return shared.join(centres, "bucket").where((F.col("a") != F.col("node")) & long_enough(F.col("an"), F.col("n"), threshold)).select("a", F.col("node").alias("b")).distinct()


def remaining_pairs(sets: DataFrame, component: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """All pairs across components that can reach the threshold, by the prefix join of step 5."""
    sizes = sets.join(component, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.size("tokens").alias("n"), "tokens")
    tokens = sizes.select("node", "component", F.explode("tokens").alias("token"))
    frequency = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("df > 1")
    # A shingle of one set alone precedes all others in the order and meets nothing: it is counted, not carried.
    counted = tokens.select("node", "token").join(frequency, "token").select("node", F.struct("df", "token", (F.col("c0") != F.col("c1")).alias("mixed")).alias("t"))
    ordered = counted.groupBy("node").agg(F.array_sort(F.collect_list("t")).alias("ts")).join(sizes.drop("tokens"), "node")
    alone = F.col("n") - F.size("ts")
    length = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) / 100).cast("int") + 1 - alone
    prefix = ordered.select("node", "component", "n", alone.alias("alone"), F.posexplode(F.slice("ts", F.lit(1), F.greatest(length, F.lit(0)))).alias("at", "t")).where("t.mixed")
    prefix = prefix.select(F.col("t.token").alias("token"), "node", "component", "n", (F.col("alone") + F.col("at")).alias("at"))
    prefix = settled(prefix)
    by_component = prefix.groupBy("token", "component").agg(F.count("*").alias("k"))
    main = by_component.groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("kinds"), F.sum("k").alias("rows"))
    main = settled(main.where("kinds > 1").select("token", "main", "rows"))
    # Lists of more than a HOT_KEYS-th of all rows, of which there are at most HOT_KEYS, are dealt by salt over several tasks.
    limit = max(LEAST_HOT, prefix.count() // HOT_KEYS)
    hot = F.broadcast(main.where(F.col("rows") > limit).select("token", F.ceil(F.col("rows") / limit).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    every = F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")
    listed = prefix.join(hot, "token", "left").withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int")).drop("salts")
    listed = listed.join(main.join(hot, "token", "left").select("token", "main", every), ["token", "salt"])
    few = listed.where("component <> main").join(hot, "token", "left").drop("salt")
    few = few.select("token", every, F.col("node").alias("a"), F.col("component").alias("ac"), F.col("n").alias("an"), F.col("at").alias("aat"))
    all_ = listed.select("token", "salt", F.col("node").alias("b"), F.col("component").alias("bc"), F.col("n").alias("bn"), F.col("at").alias("bat"), "main")
    needed = F.ceil((F.col("an") + F.col("bn")) * F.lit(threshold) / (100 + threshold))
    possible = F.least(F.col("an") - F.col("aat"), F.col("bn") - F.col("bat")) >= needed  # only rarer words precede, none shared before the first
    meets = (F.col("ac") != F.col("bc")) & ((F.col("bc") == F.col("main")) | (F.col("a") < F.col("b"))) & long_enough(F.col("an"), F.col("bn"), threshold) & possible
    return few.join(all_, ["token", "salt"]).where(meets).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: int = THRESHOLD, mark: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; ``mark`` names a column for the text's xxhash64."""
    texts = named_texts(docs, id_column, text_column, F.xxhash64(F.col(f"`{text_column}`")).alias("text_hash"))
    described = settled(describe(texts, *layout(threshold)))
    sets_met = described.where("n_shingles > 0 AND doc_id IS NOT NULL")
    owners = sets_met.groupBy("high", "low").agg(F.min(F.struct("doc_id", "text_hash")).alias("o"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    # Numbers of rows that are read from the checkpoint are the same at every reading.
    owners = settled(owners.select("high", "low", "n", "o.doc_id", "o.text_hash", "keys")).withColumn("node", F.monotonically_increasing_id())
    members = owners.select(F.explode("keys").alias("bucket"), "node", "n")
    crowded = settled(members.join(members.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket"), "bucket"))

    edges = settled(star_edges(crowded, threshold))
    sets = settled(sets_of(texts, owners.join(crowded.select("node").distinct(), "node", "left_semi")))
    links = settled(confirmed(edges, sets, threshold))
    first = settled(connected_components(links))

    met = crowded.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = met.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("bucket")
    unsettled = met.join(split, "bucket").select("node").distinct()
    rest = sets.join(unsettled, "node", "left_semi")
    more = confirmed(settled(remaining_pairs(rest, first, threshold)), rest, threshold)
    final = settled(connected_components(links.unionByName(more)))

    # Only nodes with links are looked up by component; the smallest id of the others' documents is theirs.
    placed = owners.select("high", "low", "doc_id", "node").join(final, "node")
    named = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = placed.select("node", "component").join(named, "component").select("node", "component_id")
    of_print = owners.join(of_node, "node", "left").select("high", "low", F.coalesce("component_id", "doc_id").alias("component_id"))
    linked = sets_met.drop("keys").join(of_print, ["high", "low"])
    alone = described.drop("keys").where("n_shingles = 0 OR doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return linked.unionByName(alone).select("doc_id", "n_shingles", "component_id", kept, *([F.col("text_hash").alias(mark)] if mark else []))
