"""Suffix-array dedup: maximal repeats of the corpus's bytes, and texts without them.

Shards of text contexts that can share a repeat are indexed by an enhanced suffix array; a stack scan of its
common-prefix interval tree, testing left-extension diversity, yields the maximal repeats with all their
occurrences (``esa.py``; ``windows.py`` deals the contexts so that no shard is unbounded).

Null text counts as empty; texts shorter than the window never change; empty tables give empty results; rows that
repeat an id are documents of their own (with equal texts too, and those repeat as a whole); extra columns are ignored
(``repeats``, ``digest``) or kept (``remove``). A very long text is winnowed in pieces; several times its bytes must fit
a Python worker once. Nothing depends on an order, so there are no ties.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._spark import tidy
from .windows import joined_groups, merged, of_documents, repeated_windows, row_key, span_rows, with_spans

WINDOW = 200


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(group_id, doc_id, start, length): maximal repeats of ``window`` bytes or more, each with all its places.

    The rows of a group hold equal bytes, which stand nowhere else. A group ends where the bytes around its places
    differ, or where the next window also stands in further places (it is in a group of its own then). Rows of equal
    doc_id and text give each place once.
    """
    keys, spans = repeated_windows(docs, "byte", window, groups=True)
    found = joined_groups(span_rows(spans), window)
    none = keys.where("doc_id is null").select("k", "t", F.lit(True).alias("no_id")).distinct()
    doc_id = F.when(F.col("no_id").isNull(), F.col("k")).alias("doc_id")
    return found.join(none, ["k", "t"], "left").select("group_id", doc_id, "start", "length")


def _kept(raw: bytes | memoryview, spans) -> tuple[bytes, list[tuple[int, int]]]:
    runs = merged(spans)
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out), runs


def _digest(batches):
    for batch in batches:
        rows = []
        for raw, spans in zip(batch.column(1), batch.column(2).to_pylist()):
            raw = memoryview(raw.as_buffer())
            kept, runs = _kept(raw, spans)
            rows.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
        size, removed, n, sha = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs, SHA-256 of what stays."""
    return with_spans(*repeated_windows(docs, "byte", window)).mapInArrow(
        _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without the bytes of repeated passages; characters cut in two go whole.

    All columns of ``docs`` stay; ``n_chars``, where there is one, follows the new text.
    """
    _, spans = repeated_windows(docs, "byte", window)
    schema = docs.schema
    place = schema.names.index("text")
    fresh = "spans"
    while fresh in docs.columns:
        fresh += "_"
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), *row_key(docs))
    full = whole.join(of_documents(spans), ["k", "t"], "left").select("doc.*", F.col("spans").alias(fresh))

    def run(batches):
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            texts = [
                t if t is None or not spans else _kept(t.encode(), spans)[0].decode(errors="ignore")
                for t, spans in zip(batch.column(place).to_pylist(), batch.column(len(schema)).to_pylist())
            ]
            columns = list(batch.columns[: len(schema)])
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            if "n_chars" in schema.names:
                i = schema.names.index("n_chars")
                columns[i] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return full.mapInArrow(tidy(run), schema)
