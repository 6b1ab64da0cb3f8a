"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that are joined on their own because each holds more than this share (one in so many) of the rows.
HOT_KEYS, LEAST_HOT = 10_000, 512

#: Bytes of text that a worker has in Python's form at a time, about; a longer text is whole all the same.
TEXT_BYTES = 2_000_000

ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
}


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only in local mode, as in tests on one machine, is a temporary folder taken where that is unset; on a cluster
    a folder of one machine would lose the rows, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="riftline-")


#: Spark's setting by which an execution's shuffle files go when it ends, instead of with the driver's objects.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and go on from there; the shuffle files that led to it go at once."""
    sc, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    before = conf.get(CLEANED, "false")
    conf.set(CLEANED, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # the setting is read when a frame is made
    finally:
        conf.set(CLEANED, before)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table of its own in the session's checkpoint folder, compressed, and go on from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named_texts(docs: DataFrame, id_column: str, text_column: str, *also: Column) -> DataFrame:
    """Columns doc_id, those of ``also``, and text, whatever else a table has and however it calls them."""
    return docs.select(F.col(f"`{id_column}`").alias("doc_id"), *also, F.col(f"`{text_column}`").cast("string").alias("text"))


def parts(schema: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in schema.split(", ")]


def in_portions(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of the batches in portions of about TEXT_BYTES of the text column; what a worker makes of them stays as small."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        portion = np.cumsum(sizes) // TEXT_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(portion)) + 1).tolist(), b.num_rows]
        for at, end in zip(cuts, cuts[1:]):
            if end > at:
                yield b.slice(at, end - at)


def with_results(texts: DataFrame, schema: str, function: Callable[[list[str | None]], dict[str, Sequence]]) -> DataFrame:
    """The columns of ``texts`` but its text, and those that ``function`` gives for the texts of a batch.

    What isn't text passes as it is, in Arrow's own form: ids keep their type and every digit beside nulls.
    """
    kept = [f for f in texts.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_portions(batches):
            got = function(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *(pa.array(got[n], ARROW[t]) for n, t in parts(schema))], [*(f.name for f in kept), *(n for n, _ in parts(schema))])

    return texts.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), schema]))


def held_out(id_column: str, folds: int, fold: int):
    """Whether a row is kept away from training: crc32 of its id as text, modulo ``folds``, is ``fold``."""
    return F.coalesce(F.crc32(F.col(f"`{id_column}`").cast("string")) % folds == fold, F.lit(False))


def training_ids(labels: DataFrame, column: str, folds: int, fold: int, sample: int) -> DataFrame:
    """doc_id and label of at most ``sample`` labelled rows of each label that are not held out, by hash of the id."""
    usable = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold))
    once = usable.groupBy("doc_id").agg(F.max(column).alias("label"))
    parts = [once.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for v in (0, 1)]
    return parts[0].unionByName(parts[1])
