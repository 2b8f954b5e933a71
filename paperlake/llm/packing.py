"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

Only the histogram of piece lengths reaches the driver (at most ``capacity`` lengths times ``SALTS``). There bins are
filled greedily, longest first and always with the longest piece that fits; then a bin's smallest piece gives way to
two unpacked pieces that fill its expanded gap more tightly. A bin's recipe is applied as often as the histogram
allows, so the plan has a few recipes for each length, however many documents there are. Pieces find their place by
their rank among the pieces of their length; ranks are taken within (length, salt), so no length is a hot group.

Null and empty texts are one end id; rows that repeat an id are packed each; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._spark import cut, tidy

CAPACITY = 4096
END_ID = 1
SALTS = 32
CACHE_WORDS = 600_000


def _byte_symbols() -> str:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next character from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(other)) for b in range(256))


class _Numbers(dict):
    """Numbers keys in the order they are first looked up; ``new`` holds those not learned yet."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        self.new.append(key)
        return number


class _Table:
    """Id runs by key, kept in one growing array; ``learn(keys)`` gives the ids and sizes of new keys."""

    def __init__(self, learn):
        self.number = _Numbers()
        self._learn = learn
        self._flat = np.zeros(1 << 16, np.uint32)
        self._begin = np.zeros(1 << 16, np.int64)
        self._used = 0

    def _add(self, keys: list) -> None:
        ids, sizes = self._learn(keys)
        n = len(self.number) - len(keys)
        while self._used + len(ids) > len(self._flat):
            self._flat = np.concatenate((self._flat, np.zeros_like(self._flat)))
        while n + len(keys) + 1 > len(self._begin):
            self._begin = np.concatenate((self._begin, np.zeros_like(self._begin)))
        self._flat[self._used : self._used + len(ids)] = ids
        self._begin[n + 1 : n + 1 + len(keys)] = self._used + np.cumsum(sizes)
        self._used += len(ids)

    def ids(self, rows: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all keys of all rows in one array, and the edges of the rows in it."""
        number = np.fromiter(map(self.number.__getitem__, chain.from_iterable(rows)), np.int64)
        if self.number.new:
            self._add(self.number.new)
            self.number.new = []
        begin = self._begin[number]
        size = self._begin[number + 1] - begin
        stop = np.concatenate(([0], np.cumsum(size)))
        ids = self._flat[np.repeat(begin - stop[:-1], size) + np.arange(stop[-1])]
        return ids, stop[np.cumsum([0, *map(len, rows)])]


class WordTokenizer:
    """Ids of whole texts through bounded caches of words and pre-tokens.

    The vocabulary's pre-tokeniser never joins across white space, so words between ASCII white space are encoded on
    their own. Words of ASCII and Latin-1 letters, on which all normalisers agree, are pre-tokenised here and only
    merged by the library's model; any other word goes through the library's whole chain. ``tests`` hold both
    against the library's ids of whole texts.
    """

    _plain = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
    _parts = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._merger = Tokenizer(self._tokenizer.model)
        self._merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self._merger.get_vocab(with_added_tokens=False)
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._symbols = {i: c for i, c in enumerate(_byte_symbols()) if i >= 128}
        self._reset()

    def _reset(self) -> None:
        self._words, self._pretokens = _Table(self._split), _Table(self._merge)

    def _merge(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pre-tokens: merged in runs of a thousand, told apart by the ids that end a word."""
        out = []
        for at in range(0, len(parts), 1000):
            joined = " ".join(parts[at : at + 1000])
            if not joined.isascii():
                joined = joined.encode().decode("latin-1").translate(self._symbols)
            out.append(np.array(self._merger.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32))
        ids = np.concatenate(out)
        return ids, np.diff(np.flatnonzero(self._ends[ids]), prepend=-1)

    def _split(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words, by their pre-tokens; of words outside the plain alphabet, by the library."""
        rows, other = [], {}
        for i, w in enumerate(words):
            word = w.decode()
            if self._plain.fullmatch(word):
                rows.append(self._parts.findall(word.lower()))
            else:
                rows.append([])
                other[i] = word
        ids, edges = self._pretokens.ids(rows)
        if other:
            found = self._tokenizer.encode_batch_fast(list(other.values()), add_special_tokens=False)
            at = np.repeat(edges[list(other)], [len(e) for e in found])
            ids = np.insert(ids, at, [i for e in found for i in e.ids])
            sizes = np.diff(edges)
            sizes[list(other)] = [len(e) for e in found]
            return ids, sizes
        return ids, np.diff(edges)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, without special ids."""
        if len(self._words.number) > CACHE_WORDS:
            self._reset()
        ids, edges = self._words.ids([t.split() for t in texts])
        return [ids[a:b] for a, b in zip(edges, edges[1:])]


def _tokenizer(path: str, _have: dict = {}) -> WordTokenizer:  # noqa: B006  one a worker, over all its tasks
    if path not in _have:
        _have[path] = WordTokenizer(path)
    return _have[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids with the end id, cut where longer than a bin."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = _tokenizer(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), words.encode(texts)):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for p, a in enumerate(range(0, len(ids), capacity)):
                        rows.append((doc_id, p, a, min(capacity, len(ids) - a), zlib.crc32(ids[a : a + capacity].tobytes())))
                doc_id, p, a, n, crc = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_id, pa.int64()), pa.array(p, pa.int32()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_two_fit(count: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Bins as (how many, lengths in one of them) that hold ``count[length]`` pieces of each length."""
    left = {n: c for n, c in count.items() if c > 0}
    sizes = sorted(left)
    out: list[tuple[int, list[int]]] = []

    def take(n: int) -> None:
        left[n] -= 1
        if not left[n]:
            del left[n]
            del sizes[bisect_right(sizes, n) - 1]

    def put(n: int) -> None:
        if n not in left:
            left[n] = 0
            insort(sizes, n)
        left[n] += 1

    while sizes:
        held: list[int] = []
        gap = capacity
        while sizes and (i := bisect_right(sizes, gap)):
            n = sizes[i - 1]
            take(n)
            held.append(n)
            gap -= n
        if gap and len(held) > 1 and sizes:
            least = held[-1]
            room = gap + least
            have = np.array(sizes)
            have = have[have < room]
            if len(have):
                mate = np.searchsorted(have, room - have, "right") - 1
                mate = np.where(have[mate] <= have, mate, np.searchsorted(have, have, "right") - 1)  # a pair counts once
                fits = have + have[mate] <= room
                single = (mate == np.arange(len(have))) & np.array([left[int(x)] < 2 for x in have])
                mate = np.where(single, mate - 1, mate)
                fits &= mate >= 0
                total = np.where(fits, have + have[mate], 0)
                best = int(np.argmax(total))
                if total[best] > least:
                    held.pop()
                    put(least)
                    for n in (int(have[best]), int(have[mate[best]])):
                        take(n)
                        held.append(n)
        need = Counter(held)
        again = min((left.get(n, 0) // c for n, c in need.items()), default=0)
        if again:
            for n, c in need.items():
                left[n] -= c * again
                if not left[n]:
                    del left[n]
                    del sizes[bisect_right(sizes, n) - 1]
        out.append((1 + again, sorted(held, reverse=True)))
    return out


class Plan:
    """Where the piece of some length and rank goes; a few rows for each recipe."""

    def __init__(self, bins: list[tuple[int, list[int]]]):
        used: Counter = Counter()
        rows = []
        sequence = 0
        for copies, held in bins:
            offset = 0
            for n, times in sorted(Counter(held).items(), reverse=True):
                rows.append((n, used[n], sequence, times, offset))
                used[n] += copies * times
                offset += n * times
            sequence += copies
        rows.sort()
        self.sequences = sequence
        self.length, self.rank, self.sequence, self.times, self.offset = np.array(rows, np.int64).reshape(-1, 5).T.copy()
        self._key = self.length * (1 << 48) + self.rank

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self._key, length * (1 << 48) + rank, "right") - 1
        q = rank - self.rank[at]
        return self.sequence[at] + q // self.times[at], self.offset[at] + (q % self.times[at]) * length


def pack(parts: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """``parts`` (with doc_id, piece, length) and the sequence_id and offset of each."""
    spark = parts.sparkSession
    parts = cut(parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")))
    counted = parts.groupBy("length", "_salt").count().collect()  # at most capacity * salts rows
    total: Counter = Counter()
    for r in counted:
        total[r["length"]] += r["count"]
    plan = spark.sparkContext.broadcast(Plan(best_two_fit(total, capacity)))
    before: dict[int, list] = {}
    for r in sorted(counted):
        before.setdefault(r["length"], []).append((r["_salt"], r["count"]))
    first = np.zeros((capacity + 1, salts), np.int64)
    for n, found in before.items():
        at = 0
        for salt, c in found:
            first[n, salt] = at
            at += c
    start = spark.sparkContext.broadcast(first)
    names = [f.name for f in parts.schema if f.name != "_salt"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema if f.name != "_salt")

    def run(batches):
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            length = col("length").to_numpy().astype(np.int64)
            rank = start.value[length, col("_salt").to_numpy()] + col("_rank").to_numpy() - 1
            sequence, offset = plan.value.place(length, rank)
            yield pa.RecordBatch.from_arrays([*(col(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    return parts.withColumn("_rank", F.row_number().over(order)).mapInArrow(run, schema + ", sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, tokenizer, capacity), capacity)
