"""Vectorised text primitives: blocks of rows as flat byte arrays, words, rolling hashes, window anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_R1, _R2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def blocks(batches, column: str = "text", limit: int = BLOCK_BYTES):
    """(record batch slice, flat uint8 data, int64 offsets) for groups of rows of about ``limit`` bytes.

    A row is never divided; nulls count as empty.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        if text.null_count:
            text = pc.fill_null(text, b"" if pa.types.is_binary(text.type) else "")
        wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
        offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
        a = 0
        while a < len(text):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            a = b


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and base**-j modulo 2**64 for j < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = (out[0], out[1])
        if size <= 1 << 22:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xCA5A826395121157)
    h ^= h >> np.uint64(29)
    return h


def prefix(tokens: np.ndarray, base: int = _R1) -> np.ndarray:
    """Prefix sums whose differences give the hash of any span of ``tokens``."""
    out = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * powers(len(tokens), base)[0], dtype=np.uint64, out=out[1:])
    return out


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _R1) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of the tokens behind the prefix sums ``p``."""
    h = (p[end] - p[start]) * powers(len(p), base)[1][start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes that are not space or \\t..\\r; words never cross rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    space = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first[len(data)] = True
    start = ~space
    start[1:] &= space[:-1] | first[1:-1]
    end = ~space
    end[:-1] &= space[1:] | first[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _R1) -> np.ndarray:
    p = prefix(data.astype(np.uint64) + np.uint64(1), base)
    return span_hash(p, start, end, base)


def cut_at_spaces(data: np.ndarray, limit: int):
    """[a, b) parts of one long text, each of ``limit`` bytes and up to the next white space, so no word is divided."""
    a = 0
    while a < len(data):
        b = min(a + limit, len(data))
        while b < len(data):
            ahead = data[b : b + limit]
            space = np.flatnonzero((ahead == 32) | ((ahead >= 9) & (ahead <= 13)))
            if len(space):
                b += int(space[0])
                break
            b = min(b + limit, len(data))
        yield a, b
        a = b


def token_offsets(row: np.ndarray, n_rows: int) -> np.ndarray:
    """Offsets of each row's tokens, from the row of each token."""
    return np.searchsorted(row, np.arange(n_rows + 1), "left").astype(np.int64)


def anchors(tokens: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """Winnowing: runs of consecutive windows of ``window`` tokens that select the same anchor gram.

    Which gram a window selects depends on the window's tokens alone, so equal windows anywhere select equal
    grams at equal places. Returns anchor hash, hash of the run's whole context, row, first window (from the row's
    start) and number of windows of each run.
    """
    n = len(tokens)
    z = np.zeros(0, np.int64)
    if n < window or not (np.diff(offsets) >= window).any():
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), z, z, z
    p = prefix(tokens)
    g = (p[gram:] - p[:-gram]) * powers(n + 1, _R1)[1][: n - gram + 1]
    g = mix(g)
    low = np.uint64(0xFFFFFFFF)
    key = (g & ~low) | (low - np.arange(len(g), dtype=np.uint64))
    m = window - gram + 1
    padded = np.full(-(-len(key) // m) * m, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(key)] = key
    table = padded.reshape(-1, m)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - window + 1
    place = (low - (np.minimum(behind[:count], ahead[m - 1 : m - 1 + count]) & low)).astype(np.int64)
    valid = np.ones(count, bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        valid[max(a, b - window + 1) : b] = False
    at = np.flatnonzero(valid)
    place = place[at]
    new = np.ones(len(at), bool)
    new[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(new)
    lo = at[first]
    hi = at[np.append(first[1:], len(at)) - 1]
    c = span_hash(prefix(tokens, _R2), lo, hi + window, _R2)
    row = np.searchsorted(offsets, lo, "right") - 1
    return g[place[first]], c, row, lo - offsets[row], hi - lo + 1
