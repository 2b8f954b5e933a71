"""Byte-level BPE by ranks: overlapping chunks are pre-tokenised in parallel, stitched, encoded and decoded.

The pre-token pattern looks ahead but never back, so two scans that share one boundary agree from there on. Chunks
of a long text overlap; a chunk's pieces are taken over from the first boundary that the scan of the chunk before it
also has. Where an overlap has no common boundary, the scan before goes on through the next chunk until it has one.
Texts of up to ``CHUNK`` characters are one chunk and never shuffled.

Null and empty texts have no ids; rows that repeat an id are encoded each; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CHUNK, OVERLAP = 1 << 16, 1 << 10
CACHE_PIECES = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class _Classes:
    """Stand-ins for characters that the pattern's two engines class differently.

    The library's engine has a Unicode version of its own. Which class it gives a character shows in the ids of a
    vocabulary that joins the character's last byte to the letter or digit after it. Characters are probed when a text
    first has them, and replaced, for the scan alone, by a character that both engines put in the library's class.
    """

    def __init__(self, pattern: str):
        import regex
        import tiktoken

        def joins(tail: bytes):
            ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + tail: 256 + b for b in range(256)}
            return tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        self._probes = {"a": (joins(b"a"), "a"), "1": (joins(b"1"), "1")}
        self._own = {"a": regex.compile(r"\p{L}"), "1": regex.compile(r"\p{N}")}
        self._space = regex.compile(r"\p{White_Space}")
        self._known = {chr(i) for i in range(128)}
        self.differ: dict[int, str] = {}

    def learn(self, text: str) -> bool:
        """Probe the new characters of ``text``; whether it has any that need a stand-in."""
        chars = set(text)
        for c in chars - self._known:
            theirs = next((k for k, (e, tail) in self._probes.items() if e.encode_ordinary("!" + c + tail)[-1] >= 256), "!")
            own = next((k for k, p in self._own.items() if p.match(c)), "!")
            if theirs != own and not self._space.match(c):
                self.differ[ord(c)] = theirs
            self._known.add(c)
        return any(ord(c) in self.differ for c in chars) if self.differ else False


class Codec:
    """Ids of pre-tokens by the ranks of a vocabulary, with a bounded cache, and back."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        ranks = load_ranks(path)
        self._encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # White space as the library's engine has it: the Unicode property, without the separators U+001C to U+001F.
        self._pattern = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self._classes = _Classes(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._cache: dict[str, tuple[int, ...]] = {}

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or not self._classes.learn(text):
            return self._pattern.findall(text)
        ends = self.ends(text)
        return [text[a:b] for a, b in zip([0, *ends], ends)]

    def ends(self, text: str) -> list[int]:
        """Ends of the pre-tokens of ``text``, which leave no gaps."""
        if not text.isascii() and self._classes.learn(text):
            text = text.translate(self._classes.differ)
        return [m.end() for m in self._pattern.finditer(text)]

    def encode(self, pieces: list[str]) -> list[int]:
        cache = self._cache
        if len(cache) > CACHE_PIECES:
            cache.clear()
        single = self._encoding._encode_single_piece
        for p in set(pieces):
            if p not in cache:
                cache[p] = tuple(single(p))
        return list(chain.from_iterable(map(cache.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def stitch(scans: list[tuple[int, int, list[int]]], rescan) -> list[int]:
    """Boundaries of a text from the scans (start, end, ends of pieces) of its overlapping chunks, in order.

    An end of a scan's last piece is not taken over, as the chunk's end may have cut it (the text's last scan is whole).
    ``rescan(a, b)`` gives the ends of pieces of the text [a, b) scanned alone.
    """
    out: list[int] = []
    at = 0  # the last boundary that is sure
    for i, (start, stop, ends) in enumerate(scans):
        final = i == len(scans) - 1
        sure = ends if final else ends[:-1]
        if start and at < start:
            # the scan before never reached this chunk's start: go on from its last sure boundary
            sure = rescan(at, stop)
            sure = sure if final else sure[:-1]
        elif start and at != start:
            common = set(sure)
            while out and out[-1] > start and out[-1] not in common:
                out.pop()
            if out and out[-1] > start and out[-1] in common:
                at = out[-1]
            else:
                at = out[-1] if out else 0
                sure = rescan(at, stop)
                sure = sure if final else sure[:-1]
        out += [e for e in sure if e > at]
        at = out[-1] if out else 0
    return out


def _chunks(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    return [(a, min(n, a + chunk + overlap)) for a in range(0, max(n, 1), chunk)]


def _long_pieces(codec: Codec, text: str, scans) -> list[str]:
    def rescan(a: int, b: int) -> list[int]:
        return [a + e for e in codec.ends(text[a:b])]

    ends = stitch(scans, rescan)
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def _codec(path: str, pattern: str, _have: dict = {}) -> Codec:  # noqa: B006  one a worker
    if (path, pattern) not in _have:
        _have[path, pattern] = Codec(path, pattern)
    return _have[path, pattern]


_SCHEMA = "doc_id long, ids array<int>, decoded binary"


def _row(codec: Codec, pieces: list[str]):
    ids = codec.encode(pieces)
    return ids, codec.decode(ids)


def encoded(docs: DataFrame, ranks: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, as_digest: bool = False) -> DataFrame:
    """doc_id, ids and the decoded bytes of every text; with ``as_digest`` their number and SHA-256 digests."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if as_digest else ["doc_id", "ids", "decoded"]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if as_digest else _SCHEMA
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()] if as_digest else [pa.int64(), pa.list_(pa.int32()), pa.binary()]

    def out(doc_id, rows):
        if as_digest:
            # the decimal forms are looked up, as most ids recur
            rows = [(len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()) for ids, raw in rows]
        columns = list(zip(*rows)) if rows else [[]] * (len(names) - 1)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([doc_id, *columns], types)], names=names)

    def whole(batches):
        codec = _codec(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yield out(part.column(0), [_row(codec, codec.pieces(t or "")) for t in part.column(1).to_pylist()])

    def scan(batches):
        codec = _codec(ranks, pattern)
        for batch in batches:
            rows = []
            for a, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                rows.append([a + e for e in codec.ends(text)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "row", "a", "part", "ends"]
            )

    def join(batches):
        codec = _codec(ranks, pattern)
        for batch in batches:
            rows = []
            for scans in batch.column(1).to_pylist():
                scans.sort(key=lambda s: s["a"])
                text = "".join(s["part"][:chunk] for s in scans)
                rows.append(_row(codec, _long_pieces(codec, text, [(s["a"], s["a"] + len(s["part"]), s["ends"]) for s in scans])))
            yield out(batch.column(0), rows)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    short = docs.where(~is_long).mapInArrow(whole, schema)
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk))
    parts = (
        docs.where(is_long)
        .withColumn("row", F.monotonically_increasing_id())
        .select("doc_id", "row", "text", F.explode(starts).alias("a"))
        .select("doc_id", "row", "a", F.substring(F.col("text"), F.col("a") + 1, F.lit(chunk + overlap)).alias("part"))
        .repartition("row", "a")
        .mapInArrow(scan, "doc_id long, row long, a int, part string, ends array<int>")
    )
    stitched = (
        parts.groupBy("row", "doc_id")
        .agg(F.collect_list(F.struct("a", "part", "ends")).alias("scans"))
        .select("doc_id", "scans")
        .mapInArrow(join, schema)
    )
    return short.unionByName(stitched)
