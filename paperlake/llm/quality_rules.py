"""Quality rules as a short-circuit cascade.

Every rule is a vectorised predicate over a block of documents. On a bounded sample the cascade measures each rule's
cost per document and the share it rejects, and orders the rules by rejection per cost (the optimal order for
independent predicates). A document then meets the rules in that order until one rejects it; the order changes the
cost, never the verdict.

Words are runs of bytes other than space and \\t..\\r. Null and empty texts have no words and fail the base rules;
rows that repeat an id are judged one by one; empty tables give empty results; extra columns are ignored (``counts``)
or kept (``keep``).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._spark import tidy
from ._text import _R1, blocks, mix, powers, prefix, span_hash, word_hashes, words

#: Documents that the order of the rules is measured on.
SAMPLE = 200
WINDOW = 5
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


class Block:
    """Counts of a block of documents, each computed when a rule first asks for it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self._have: dict[str, np.ndarray] = {}

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._have:
            self._have[name] = getattr(self, f"_count_{name}")()
        return self._have[name]

    def _sum(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def _per(self, row: np.ndarray) -> np.ndarray:
        return np.bincount(row, minlength=self.n).astype(np.int64)

    def _count_words(self):
        return words(self.data, self.offsets)

    def _count_n_words(self):
        return self._per(self.words[2])

    def _count_word_chars(self):
        start, end, _ = self.words
        flag = np.zeros(len(self.data) + 1, np.int8)
        flag[start] += 1
        flag[end] -= 1
        inside = np.cumsum(flag[:-1], dtype=np.int8) > 0 if len(self.data) else np.zeros(0, bool)
        # neighbouring rows may leave no gap between words: ends and starts then cancel and stay inside
        return self._sum(inside & ((self.data & 0xC0) != 0x80))

    def _count_n_symbols(self):
        return self._sum(_SYMBOLS[self.data])

    def _count_lines(self):
        """Row and hash of every \\n-split line that has a word."""
        first = np.zeros(len(self.data) + 1, bool)
        first[self.offsets] = True
        if len(self.data):
            first[1:] |= self.data == 10
        start = np.flatnonzero(first[:-1])
        start = start[start < len(self.data)]
        end = np.append(start[1:], len(self.data))
        end = end - ((end > start) & (self.data[np.maximum(end - 1, 0)] == 10)) if len(start) else end
        begins = np.zeros(len(self.data) + 1, np.int64)
        begins[1:][self.words[0]] = 1
        np.cumsum(begins, out=begins)
        full = begins[end] > begins[start] if len(start) else np.zeros(0, bool)
        start, end = start[full], end[full]
        row = np.searchsorted(self.offsets, start, "right") - 1
        return row, span_hash(prefix(self.data.astype(np.uint64) + np.uint64(1)), start, end)

    def _count_n_lines(self):
        return self._per(self.lines[0])

    def _count_n_dup_lines(self):
        row, h = self.lines
        order = np.lexsort((h, row))
        again = np.zeros(len(row), bool)
        again[1:] = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1])
        return self._per(row[order][again])

    def _count_n_repeat_words(self):
        start, end, row = self.words
        if len(start) < WINDOW:
            return np.zeros(self.n, np.int64)
        h = word_hashes(self.data, start, end)
        p = prefix(h)
        count = len(h) - WINDOW + 1
        g = mix((p[WINDOW:] - p[:-WINDOW]) * powers(len(h) + 1, _R1)[1][:count])
        at = np.flatnonzero(row[:count] == row[WINDOW - 1 :])
        key = mix(g[at] + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        s, r = key[order], row[at][order]
        same = (s[1:] == s[:-1]) & (r[1:] == r[:-1])
        twice = np.zeros(len(at), bool)
        twice[1:] |= same
        twice[:-1] |= same
        flag = np.zeros(len(h) + 1, np.int64)
        hit = at[order[twice]]
        np.add.at(flag, hit, 1)
        np.add.at(flag, hit + WINDOW, -1)
        return self._per(row[np.cumsum(flag[:-1]) > 0])


@dataclass(frozen=True)
class Rule:
    """``rejects(block)`` is a boolean for each document of the block."""

    name: str
    rejects: Callable[[Block], np.ndarray]


def production_rules() -> list[Rule]:
    """Length, repetition, symbols, repeated lines and word shape; integers only, so nothing rounds."""
    return [
        Rule("few_words", lambda b: b.n_words < 10),
        Rule("repeated_windows", lambda b: 100 * b.n_repeat_words > 20 * b.n_words),
        Rule("symbols", lambda b: 100 * b.n_symbols > 10 * b.n_words),
        Rule("repeated_lines", lambda b: 100 * b.n_dup_lines > 30 * b.n_lines),
        Rule("short_words", lambda b: b.word_chars < 2 * b.n_words),
        Rule("long_words", lambda b: b.word_chars > 25 * b.n_words),
    ]


def _subset(block: Block, rows: np.ndarray) -> Block:
    sizes = np.diff(block.offsets)[rows]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    at = np.repeat(block.offsets[rows] - offsets[:-1], sizes) + np.arange(offsets[-1])
    return Block(block.data[at], offsets)


def measured_order(docs: DataFrame, rules: list[Rule], sample: int = SAMPLE) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected) by rejection per cost, measured on at most ``sample`` documents."""
    texts = [r[0] or "" for r in docs.select("text").limit(sample).collect()]
    raw = [t.encode() for t in texts] or [b""]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    out = []
    for rule in rules:
        took = []
        for _ in range(3):
            began = time.perf_counter()
            rejected = rule.rejects(Block(data, offsets))
            took.append(time.perf_counter() - began)
        out.append((rule.name, max(min(took), 1e-9) / len(raw), float(np.mean(rejected))))
    return sorted(out, key=lambda x: (-x[2] / x[1], x[1], x[0]))


class _View:
    """Some documents of a block; the counts stay shared with the block."""

    def __init__(self, block: Block, rows: np.ndarray):
        self._block, self._rows = block, rows

    def __getattr__(self, name: str):
        return getattr(self._block, name)[self._rows]


def cascade(block: Block, rules: list[Rule]) -> np.ndarray:
    """Number of the rule that rejects each document, or -1; a rejected document meets no later rule.

    Counts are computed for a block as a whole; once most of its documents are gone the rest is copied out, so later
    rules do not pay for rejected texts.
    """
    verdict = np.full(block.n, -1, np.int64)
    rows = np.arange(block.n)  # of the first block
    local = rows  # the same documents in the present block
    for i, rule in enumerate(rules):
        if not len(rows):
            break
        rejected = rule.rejects(_View(block, local))
        verdict[rows[rejected]] = i
        rows, local = rows[~rejected], local[~rejected]
        if len(local) < block.n / 2:
            block, local = _subset(block, local), np.arange(len(local))
    return verdict


def ordered_rules(docs: DataFrame, rules: list[Rule] | None = None, sample: int = SAMPLE) -> list[Rule]:
    rules = production_rules() if rules is None else rules
    by_name = {r.name: r for r in rules}
    return [by_name[name] for name, _, _ in measured_order(docs, rules, sample)]


def counts(docs: DataFrame) -> DataFrame:
    """Per document: the base counts, the base verdict, the cascade's verdict and the rule that rejects it."""
    rules = ordered_rules(docs)
    names = [r.name for r in rules]

    def run(batches):
        for rows, data, offsets in blocks(batches):
            b = Block(data, offsets)
            verdict = cascade(b, rules)
            failed = (b.n_words < 10) | (100 * b.n_repeat_words > 20 * b.n_words)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *(pa.array(getattr(b, c)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(~failed & (verdict < 0)), pa.array([names[v] if v >= 0 else None for v in verdict.tolist()], pa.string())],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        tidy(run),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string",
    )


def keep(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    rules = ordered_rules(docs)

    def run(batches):
        for rows, data, offsets in blocks(batches):
            yield rows.filter(pa.array(cascade(Block(data, offsets), rules) < 0))

    return docs.mapInArrow(tidy(run), docs.schema)
