"""Substring dedup: word spans that occur elsewhere, by matching statistics on suffix automata of reference shards.

Every document is reference and stream at once, so the automata of all shards together grow with the corpus and no
broadcast of them is bounded. A shard therefore goes to the one task that streams the documents which can match it
(see ``windows.py``): its automaton holds the contexts around one or more anchors, and the contexts stream through it.

Words are runs of bytes other than space and \\t..\\r. Null text has no words; texts with fewer words than the window
never change; empty tables give empty results; rows that repeat an id are documents of their own; extra columns are
ignored. A very long text is winnowed and split in pieces; several times its bytes must fit a Python worker once. Nothing
depends on an order, so there are no ties.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._text import cut_at_spaces
from .windows import PIECE, merged, repeated_windows, span_rows, with_spans

WINDOW = 35


def spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length) in words: spans that cover exactly the repeated windows; they may overlap."""
    keys, found = repeated_windows(docs, "word", window)
    none = keys.where("doc_id is null").select("k", "t", F.lit(True).alias("no_id")).distinct()
    doc_id = F.when(F.col("no_id").isNull(), F.col("k")).alias("doc_id")
    return span_rows(found).join(none, ["k", "t"], "left").select(doc_id, "start", "length").distinct()


def _without(raw: bytes, runs: list[tuple[int, int]], piece: int = PIECE) -> tuple[int, int, bytes]:
    """Words, words kept, and those joined by a space; a long text is split part by part."""
    n, kept, parts, todo = 0, 0, [], list(reversed(runs))
    for x, y in cut_at_spaces(np.frombuffer(raw, np.uint8), piece):
        words = raw[x:y].split()
        out, at = [], 0
        while todo and todo[-1][0] < n + len(words):
            a, b = todo[-1]
            out += words[at : max(a - n, at)]
            at = min(b - n, len(words))
            if b > n + len(words):
                break
            todo.pop()
        out += words[at:]
        n += len(words)
        kept += len(out)
        if out:
            parts.append(b" ".join(out))
    return n, kept, b" ".join(parts)


def _removed(batches):
    for batch in batches:
        rows = [_without(raw.as_py(), merged(found)) for raw, found in zip(batch.column(1), batch.column(2).to_pylist())]
        total, left, kept = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(total, pa.int64()), pa.array([a - b for a, b in zip(total, left)], pa.int64()), pa.array([k.decode() for k in kept], pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words joined by one space."""
    return with_spans(*repeated_windows(docs, "word", window)).mapInArrow(
        _removed, "doc_id long, n_words long, n_removed long, kept string"
    )


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``remove`` with the kept words as SHA-256."""
    return remove(docs, window).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
