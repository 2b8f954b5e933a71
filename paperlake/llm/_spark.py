"""Session helpers shared by the operators: lineage cuts and streaming over sorted partitions."""

from __future__ import annotations

import ctypes
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that later reads survive lost executors.

    The folder is the session's ``spark.checkpoint.dir``; a private one is set only where that is unset (tests).
    """
    spark = df.sparkSession
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(
            spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoint-")
        )
    return df.checkpoint(eager=True)


def unsized(df: DataFrame) -> DataFrame:
    """``df``, materialised before, without the size that the planner estimates for it.

    A join's estimate is the product of its sides' and outlives a checkpoint, so in a loop of joins its digits double
    each round, until the driver does nothing but multiply them.
    """
    spark = df.sparkSession
    return type(df)(spark._jsparkSession.createDataFrame(df._jdf.javaRDD(), df._jdf.schema()), spark)


def give_back() -> None:
    """Hands the memory that Arrow and the C library hold unused back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def tidy(run):
    """``run`` for ``mapInArrow``, after which its worker, kept for the next task, holds no unused memory."""

    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def partitions_for(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def runs(batches, keys: list[str]):
    """Consecutive rows with equal ``keys`` of a sorted partition, as tables; a run may span many batches.

    Only one run is held at a time, so callers must have bounded the runs.
    """
    import numpy as np

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is None or any(c[0] != x for c, x in zip(columns, last))
        starts = np.flatnonzero(new)
        edges = [0, *starts.tolist(), n] if not len(starts) or starts[0] else [*starts.tolist(), n]
        for a, b in zip(edges, edges[1:]):
            if a in (0,) and not new[0]:
                held.append(batch.slice(a, b - a))
                continue
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(a, b - a)]
        last = [c[-1] for c in columns]
    if held:
        yield pa.Table.from_batches(held)


def id_frame(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads, so extra columns and clashing names never reach its joins."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more)
