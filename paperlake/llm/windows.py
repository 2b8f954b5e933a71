"""Repeated windows of a corpus: every stretch of ``window`` tokens that also starts somewhere else.

1. Each document is winnowed (Schleimer et al. 2003). Equal windows select equal anchor grams, so all places of a
   window lie in runs of one anchor; a run of windows with one anchor is one row, and rows are dealt by the anchor.
2. A sorted pass over each partition names the classes: runs of one anchor with equal contexts. Anchors with a single
   run are done. Every other class goes on once, with a mark if it has several runs.
3. The contexts of those classes are cut from the texts and dealt by anchor into shards. The shard's index (an enhanced
   suffix array or a suffix automaton) decides what repeats, the marked classes counting twice.
4. What the index finds in a class holds for each of its runs.

An anchor with more than ``HOT`` classes (the edge of a passage that very many documents share) would make an unbounded
shard. Its contexts are documents to a second round of the same steps, whose runs are single windows, each dealt by its
own hash: a window's places are one class there, so no shard grows, and the index decides again. Nothing is capped.

A class's rows in one block meet before the shuffle: but for the first they are dealt by a hash of their own. A class
with more runs than ``BUSY`` and a ten-thousandth of all runs is joined by broadcast; at most 10,000 classes can be so.

Rows are told apart by doc_id and a 64-bit hash of the text; rows without doc_id by 128 bits of the text. Rows with
equal doc_id and text are two documents of the same text, so all their windows repeat. A text above ``PIECE`` bytes is
winnowed in pieces that overlap by a window less one token, so memory does not grow with 8 bytes a byte of it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._spark import cut, tidy
from ._text import _R2, anchors, blocks, cut_at_spaces, mix, prefix, span_hash, token_offsets, word_hashes, words
from .automaton import SuffixAutomaton
from .esa import SuffixArray, longest_cover

#: Classes of one anchor that a shard takes; beyond it they go on window by window.
HOT = 2000
#: Context bytes gathered into one shard's index.
SHARD_BYTES = 1 << 20
#: Most rows of a broadcast table of anchors.
BROADCAST_ROWS = 100_000
#: Runs of a class from which, if they are also a ten-thousandth of all, it is joined by broadcast.
BUSY = 10_000
#: Bytes of a long text that are winnowed at once.
PIECE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RUNS = "h long, c long, k long, t long, lo int, n int"


def row_key(docs: DataFrame) -> list[Column]:
    """k and t: doc_id (or a second hash of the text) and a hash of the text."""
    text = F.coalesce(docs["text"], F.lit(""))
    return [F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(F.lit("no id"), text)).alias("k"), F.xxhash64(text).alias("t")]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes, and the key columns k and t."""
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"), *row_key(docs)
    )


def _column(batch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _pieces(data: np.ndarray, offsets: np.ndarray, unit: str, window: int, piece: int):
    """(tokens, offsets, place of the first token in its row) of a block; a block of one long row comes in pieces."""
    if len(offsets) > 2 or len(data) <= piece:
        if unit == "byte":
            yield data.astype(np.uint64) + np.uint64(1), offsets, 0
        else:
            start, end, row = words(data, offsets)
            yield word_hashes(data, start, end), token_offsets(row, len(offsets) - 1), 0
    elif unit == "byte":
        for a in range(0, len(data), piece):
            part = data[a : a + piece + window - 1]
            yield part.astype(np.uint64) + np.uint64(1), np.array([0, len(part)]), a
    else:
        carried, place = np.zeros(0, np.uint64), 0
        for a, b in cut_at_spaces(data, piece):
            part = data[a:b]
            start, end, _ = words(part, np.array([0, b - a]))
            tokens = np.concatenate((carried, word_hashes(part, start, end)))
            yield tokens, np.array([0, len(tokens)]), place
            carried = tokens[max(0, len(tokens) - window + 1) :]
            place += len(tokens) - len(carried)


def _collapse(h, c, lo, n):
    """Of equal runs in a block only the first keeps its anchor's key; both signs tell: n < 0 of a run known to repeat,
    lo < 0 of one that is dealt by itself."""
    _, first, group, size = np.unique(mix(h + c * _MIX), return_index=True, return_inverse=True, return_counts=True)
    known = size[group] > 1
    other = known.copy()
    other[first] = False
    return np.where(other, -1 - lo, lo).astype(np.int32), np.where(known, -n, n).astype(np.int32)


def _run_rows(h, c, k, t, lo, n):
    lo, n = _collapse(h, c, lo, n)
    return pa.RecordBatch.from_arrays([h.view(np.int64), c.view(np.int64), k, t, lo, n], names=["h", "c", "k", "t", "lo", "n"])


def _anchor_rows(unit: str, window: int, gram: int) -> Callable:
    def run(batches):
        for rows, data, offsets in blocks(batches, limit=PIECE):
            for tokens, at, place in _pieces(data, offsets, unit, window, PIECE):
                h, c, row, lo, n = anchors(tokens, at, window, gram)
                yield _run_rows(h, c, _column(rows, "k")[row], _column(rows, "t")[row], lo + place, n)

    return run


class Classes:
    """Streams runs sorted by (h, c): those whose anchor has another run, the first of each class marked.

    Holds one row between pushes. ``role`` is 2 for the first run of a class of several, 1 for a class's only run, else 0.
    """

    def __init__(self):
        self.held: dict | None = None
        self.same = self.beside = False

    def push(self, rows: dict[str, np.ndarray], end: bool = False):
        if self.held is not None:
            rows = {k: np.concatenate((self.held[k], v)) for k, v in rows.items()}
        if not len(rows["h"]):
            return None
        near = rows["h"][1:] == rows["h"][:-1]
        equal = near & (rows["c"][1:] == rows["c"][:-1])
        prev, after = np.concatenate(([self.same], equal)), np.concatenate((equal, [False]))
        known = rows["n"] < 0
        use = np.concatenate(([self.beside], near)) | np.concatenate((near, [False])) | known
        if not end:
            self.held = {k: v[-1:] for k, v in rows.items()}
            self.same, self.beside = bool(prev[-1]), bool(self.beside if len(near) == 0 else near[-1])
            use[-1] = False
        else:
            self.held = None
        at = np.flatnonzero(use)
        return {k: v[at] for k, v in rows.items()} | {"role": np.where(prev, 0, np.where(after | known, 2, 1))[at].astype(np.int32)}


def _classes(batches):
    names = ["h", "c", "k", "t", "lo", "n"]
    classes = Classes()

    def out(rows):
        return pa.RecordBatch.from_arrays([*(rows[x] for x in names[:5]), np.abs(rows["n"]), rows["role"]], names=[*names, "role"])

    empty = None
    for batch in batches:
        rows = {x: _column(batch, x) for x in names}
        alone = rows["lo"] < 0
        empty = {x: v[:0] for x, v in rows.items()}
        if alone.any():
            spread = {x: v[alone] for x, v in rows.items()}
            yield out(spread | {"lo": -1 - spread["lo"], "role": np.zeros(alone.sum(), np.int32)})
            rows = {x: v[~alone] for x, v in rows.items()}
        found = classes.push(rows)
        if found is not None:
            yield out(found)
    if empty is not None and (found := classes.push(empty, True)) is not None:
        yield out(found)


def _of_classes(rows: DataFrame) -> DataFrame:
    """Runs (h, c, k, t, lo, n) of anchors that have several, with their role."""
    deal = F.when(F.col("lo") < 0, F.xxhash64("k", "lo", "h")).otherwise(F.col("h"))
    return rows.repartition(deal).sortWithinPartitions("h", "c").mapInArrow(tidy(_classes), _RUNS + ", role int")


def _context_rows(unit: str, window: int) -> Callable:
    """(h, c, payload, n, many, hot): the context of each asked run."""

    def run(batches):
        for rows, data, offsets in blocks(batches, limit=PIECE):
            asked = rows.column(rows.schema.get_field_index("asked"))
            flat = asked.flatten()
            owner = np.repeat(np.arange(rows.num_rows), np.diff(np.asarray(asked.offsets)))
            lo, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            raw = memoryview(np.ascontiguousarray(data))
            if unit == "byte":
                a = offsets[owner] + lo
                payload = [bytes(raw[x:y]) for x, y in zip(a.tolist(), (a + n - 1 + window).tolist())]
            else:
                start, end, row = _word_places(data, offsets, PIECE)
                a = token_offsets(row, rows.num_rows)[owner] + lo
                payload = [b" ".join(map(_short, bytes(raw[x:y]).split())) for x, y in zip(start[a].tolist(), end[a + n + window - 2].tolist())]
            yield pa.RecordBatch.from_arrays([flat.field(2), flat.field(3), pa.array(payload, pa.binary()), flat.field(1), flat.field(4), flat.field(5)], names=["h", "c", "payload", "n", "many", "hot"])

    return run


def _word_places(data: np.ndarray, offsets: np.ndarray, piece: int):
    if len(offsets) > 2 or len(data) <= piece:
        return words(data, offsets)
    parts = [(s + a, e + a) for a, b in cut_at_spaces(data, piece) for s, e, _ in [words(data[a:b], np.array([0, b - a]))]]
    start, end = (np.concatenate(x).astype(np.int32 if len(data) < 2**31 else np.int64) for x in zip(*parts))
    return start, end, np.zeros(len(start), np.int8)


def _short(word: bytes) -> bytes:
    """A word of at most 33 bytes that stands for ``word``, so that a context of some words is bounded in bytes."""
    if len(word) <= 32:
        return word
    import hashlib

    return b"\0" + hashlib.blake2b(word, digest_size=16).hexdigest().encode()


def _array_index(payload: list[bytes], n: np.ndarray, many: np.ndarray, window: int, groups: bool):
    """(string, start, length, group): repeats of a shard's strings, by the enhanced suffix array.

    ``groups`` gives each suffix of each left-diverse common-prefix interval; else only what covers the repeats.
    """
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in payload]))).astype(np.int64)
    sa = SuffixArray(np.frombuffer(b"".join(payload), np.uint8), offsets, n.astype(np.int64))
    whole = np.flatnonzero((sa.place == 0) & many[sa.string])  # a class of several runs is an interval by itself
    size = np.diff(offsets)[sa.string[whole]]
    if groups:
        found = [(np.arange(a, b + 1), length) for length, a, b in sa.intervals(window)]
        longest = np.maximum(np.append(sa.lcp[1:], 0), sa.lcp)[whole]
        found += [(np.array([i]), length) for i, length, known in zip(whole.tolist(), size.tolist(), longest.tolist()) if known < length]
        if not found:
            return (np.zeros(0, np.int64),) * 4
        at = np.concatenate([x for x, _ in found])
        length = np.repeat([x for _, x in found], [len(x) for x, _ in found])
        first = np.repeat([x[0] for x, _ in found], [len(x) for x, _ in found])
    else:
        best, _ = longest_cover(sa, window)
        best[whole] = size
        at = np.flatnonzero(best)
        length, first = best[at], at
    string, place = sa.string[at], sa.place[at]
    begin = sa.order[first]
    # a group is named by the bytes that all its occurrences share
    name = span_hash(prefix(sa.text.astype(np.uint64) + np.uint64(1), _R2), begin, begin + length, _R2).view(np.int64)
    if groups or not len(at):
        return string, place, length, name
    order = np.lexsort((place, string))
    string, place, length, name = string[order], place[order], length[order], name[order]
    reach = string * (1 << 32) + place + length  # a span inside the one before it adds nothing
    use = ~np.concatenate(([False], np.maximum.accumulate(reach)[:-1] >= reach[1:]))
    return string[use], place[use], length[use], name[use]


def _automaton_index(payload: list[bytes], n: np.ndarray, many: np.ndarray, window: int, groups: bool):
    """(string, start, length, 0): spans that matching statistics give, by the shard's suffix automaton."""
    sequences = [p.split(b" ") for p in payload]
    automaton = SuffixAutomaton(sequences, np.where(many, 2, 1).tolist())
    found = [(i, a, b - a) for i, s in enumerate(sequences) for a, b in automaton.repeats(s, window)]
    string, place, length = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    return string, place, length, np.zeros(len(string), np.int64)


INDEX = {"byte": _array_index, "word": _automaton_index}


def _shards(unit: str, window: int, groups: bool) -> Callable:
    """Spans of classes (h, c, start, length, group_id) from contexts sorted by anchor."""

    def indexed(tables):
        rows = pa.Table.from_batches(tables).combine_chunks()
        many = rows.column("many").to_numpy(zero_copy_only=False).astype(bool)
        string, place, length, group = INDEX[unit](rows.column("payload").to_pylist(), rows.column("n").to_numpy(), many, window, groups)
        h, c = rows.column("h").to_numpy()[string], rows.column("c").to_numpy()[string]
        return pa.RecordBatch.from_arrays([h, c, place.astype(np.int32), length.astype(np.int32), group], names=["h", "c", "start", "length", "group_id"])

    def run(batches):
        held, held_bytes = [], 0
        for batch in batches:
            while batch.num_rows:
                key = _column(batch, "h")
                if held and held_bytes >= SHARD_BYTES:  # the shard ends with its last anchor
                    last = held[-1].column(0)[held[-1].num_rows - 1].as_py()
                    more = int(np.argmax(key != last)) if (key != last).any() else len(key)
                    if more:
                        held.append(batch.slice(0, more))
                    if more < len(key):
                        yield indexed(held)
                        held, held_bytes = [], 0
                    batch = batch.slice(more)
                    continue
                size = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False))
                take = min(len(key), int(np.searchsorted(size, SHARD_BYTES - held_bytes, "right")) + 1)
                held.append(batch.slice(0, take))
                held_bytes += int(size[take - 1])
                batch = batch.slice(take)
        if held:
            yield indexed(held)

    return run


def _window_rows(unit: str, window: int) -> Callable:
    """From contexts (k, t, text, n, many): each window as a run of its own."""

    def run(batches):
        for rows, data, offsets in blocks(batches, limit=1 << 18):
            ((tokens, at, _),) = _pieces(data, offsets, unit, window, len(data))
            n = _column(rows, "n").astype(np.int64)
            owner = np.repeat(np.arange(rows.num_rows), n)
            lo = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a = at[owner] + lo
            h, c = span_hash(prefix(tokens), a, a + window), span_hash(prefix(tokens, _R2), a, a + window, _R2)
            many = _column(rows, "many").astype(bool)[owner]
            out, one = _collapse(h, c, lo, np.ones(len(a), np.int64))
            yield pa.RecordBatch.from_arrays([h.view(np.int64), c.view(np.int64), _column(rows, "k")[owner], _column(rows, "t")[owner], out, np.where(many, -1, one).astype(np.int32)], names=["h", "c", "k", "t", "lo", "n"])

    return run


def _contexts(texts: DataFrame, runs: DataFrame, hot: DataFrame | None, unit: str, window: int) -> DataFrame:
    """The contexts of all classes, cut from texts (k, t, text, ...)."""
    asked = runs.where("role > 0")
    if hot is None:
        asked = asked.withColumn("hot", F.lit(False))
    else:
        asked = asked.join(hot, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = asked.groupBy("k", "t").agg(F.collect_set(F.struct("lo", "n", "h", "c", (F.col("role") == 2).alias("many"), "hot")).alias("asked"))
    return texts.join(wanted, ["k", "t"]).mapInArrow(tidy(_context_rows(unit, window)), "h long, c long, payload binary, n int, many boolean, hot boolean")


def _class_spans(contexts: DataFrame, unit: str, window: int, groups: bool) -> DataFrame:
    return contexts.repartition("h").sortWithinPartitions("h", "payload").mapInArrow(tidy(_shards(unit, window, groups)), "h long, c long, start int, length int, group_id long")


def _to_members(runs: DataFrame, found: DataFrame, busy: DataFrame | None) -> DataFrame:
    """(k, t, spans) of every run of the classes that ``found`` has spans of: arrays of start, length, group_id."""
    spans = F.collect_set(F.struct("start", "length", "group_id")).alias("spans")
    per = found.groupBy("h", "c").agg(spans)
    runs = runs.select("h", "c", "k", "t", "lo")
    if busy is None:
        joined = runs.join(per, ["h", "c"])
    else:
        few = runs.join(busy, ["h", "c"], "left_anti").join(per, ["h", "c"])
        joined = few.unionByName(runs.join(F.broadcast(per.join(busy, ["h", "c"])), ["h", "c"]))  # an inner join: a semi join would go below the index
    moved = F.transform("spans", lambda x: F.struct((F.col("lo") + x["start"]).alias("start"), x["length"].alias("length"), x["group_id"].alias("group_id")))
    return joined.select("k", "t", moved.alias("spans"))


def span_rows(spans: DataFrame) -> DataFrame:
    """(k, t, start, length, group_id): a row for each span of (k, t, spans)."""
    return spans.select("k", "t", F.inline("spans"))


def of_documents(spans: DataFrame) -> DataFrame:
    """(k, t, spans): all spans of each document, from those of its runs."""
    return spans.groupBy("k", "t").agg(F.flatten(F.collect_set(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))))).alias("spans"))


def _busy(runs: DataFrame) -> DataFrame | None:
    """Classes (h, c) with very many runs, for broadcast: at most 10,000, as each holds that share of all runs."""
    least = max(BUSY, runs.count() // 10_000)
    found = cut(runs.groupBy("h", "c").count().where(F.col("count") > least).select("h", "c"))
    return None if found.isEmpty() else F.broadcast(found)


def repeated_windows(docs: DataFrame, unit: str, window: int, groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """(keyed documents, spans): the arrays of k, t, spans (start, length, group_id) cover exactly the repeated windows.

    ``unit`` "byte" indexes shards by enhanced suffix arrays, "word" by suffix automata; start and length count units.
    With ``groups`` (bytes) every maximal repeat of an anchor's contexts is there with all its places.
    """
    gram = max(1, min(32, window // 5) if unit == "byte" else min(8, window // 4 or 1))
    keys = keyed(docs)
    runs = cut(_of_classes(keys.drop("doc_id").mapInArrow(tidy(_anchor_rows(unit, window, gram)), _RUNS)))
    busy = _busy(runs)
    hot = cut(runs.where("role > 0").groupBy("h").count().where(F.col("count") > HOT).select("h", F.lit(True).alias("hot")))
    n_hot = hot.count()
    if not n_hot:
        contexts = _contexts(keys, runs, None, unit, window)  # doc_id goes along, so this exchange and that of with_spans are one
        return keys, _to_members(runs, _class_spans(contexts, unit, window, groups), busy)
    contexts = _contexts(keys, runs, F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot, unit, window)  # 9 bytes a row
    found = _class_spans(contexts.where("not hot"), unit, window, groups)
    texts = contexts.where("hot").select(F.col("h").alias("k"), F.col("c").alias("t"), F.col("payload").alias("text"), "n", "many").repartition("k", "t")
    single = _of_classes(texts.mapInArrow(tidy(_window_rows(unit, window)), _RUNS))
    again = _class_spans(_contexts(texts, single, None, unit, window), unit, window, groups)
    deep = span_rows(_to_members(single, again, None)).select(F.col("k").alias("h"), F.col("t").alias("c"), "start", "length", "group_id")
    return keys, _to_members(runs, found.unionByName(deep), busy)


def joined_groups(spans: DataFrame, window: int) -> DataFrame:
    """Groups (group_id, k, t, start, length) of neighbouring anchors that hold the same places, as one longer group."""
    at = spans.select("group_id", "k", "t", "start", "length").distinct()
    first = at.groupBy("group_id").agg(F.min(F.struct("k", "t", "start")).alias("f"), F.count("*").alias("m"), F.max("length").alias("size"))
    shift = F.col("start") - F.col("f.start")
    place = [F.xxhash64(F.lit(i), "k", "t", shift) for i in (0, 1)]
    sets = at.join(first, "group_id").groupBy("group_id", "f", "m", "size").agg(F.bit_xor(place[0]).alias("x"), F.bit_xor(place[1]).alias("y"))
    by = Window.partitionBy("x", "y", "m", "f.k", "f.t").orderBy("f.start", F.desc("size"), "group_id")
    end = F.col("f.start") + F.col("size")
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("f.start") > reach - window + 1), 1).otherwise(0)
    island = sets.withColumn("end", end).withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(by))
    merged = island.groupBy("x", "y", "m", "f.k", "f.t", "island").agg(F.min_by("group_id", F.struct("f.start", -F.col("size"), "group_id")).alias("group_id"), (F.max("end") - F.min("f.start")).alias("whole"))
    return at.join(merged.select("group_id", "whole"), "group_id").select("group_id", "k", "t", "start", F.col("whole").cast("int").alias("length"))


def with_spans(keys: DataFrame, spans: DataFrame) -> DataFrame:
    """Keyed documents (text as bytes) with the array ``spans`` of their (start, length), null where nothing repeats."""
    return keys.join(of_documents(spans), ["k", "t"], "left").select("doc_id", "text", "spans")


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs [a, b) of a list of {start, length}."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["start"] + s["length"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out
