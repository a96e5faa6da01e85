"""Whole texts as numpy byte buffers: slicing, word boundaries and hashes, without a Python object per word.

Texts stay in the Arrow buffers they arrive in. A null text counts as an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate words where a contract says `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACES
#: Bytes of words where a contract says `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

U = np.uint64
_P = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n, kept for the next call."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            x = np.full(n, base, U)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a new array."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def ranked(keys: np.ndarray, low: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The places of 64-bit hashes in their order, equal ones as they stand, and the sorted hashes. Sorted are numbers that hold a key's
    first bits, its `low` last ones and its place, which is several times faster than sorting places; the few keys that these don't tell
    apart are put right after. low: last bits that aren't hashed."""
    shift = max(1, len(keys) - 1).bit_length()
    if low + shift > 40:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    head, last = U(low + shift), U((1 << (low + shift)) - 1)
    packed = keys >> head << U(low)
    if low:
        packed |= keys & U((1 << low) - 1)
    packed <<= U(shift)
    packed |= np.arange(len(keys), dtype=U)
    packed.sort()
    order = (packed & U((1 << shift) - 1)).view(np.int64)
    there = keys[order]
    wrong = there[1:] < there[:-1]
    if wrong.any():
        first = np.unique(there[1:][wrong] >> head) << head
        at = span_places(np.searchsorted(packed, first), np.searchsorted(packed, first | last, "right"))
        own = order[at]
        order[at] = own = own[np.lexsort((own, keys[own]))]
        there[at] = keys[own]
    return order, there


def distinct(keys: np.ndarray, low: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ones of 64-bit hashes, sorted, the place of each one's first, and which one each is. low: of `ranked`."""
    order, there = ranked(keys, low)
    new = np.ones(len(keys), bool)
    new[1:] = there[1:] != there[:-1]
    of = np.empty(len(keys), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return there[new], order[new], of


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary Arrow column, and where each value starts (one more entry than values)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    large = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(large)
    if column.null_count:
        column = pc.fill_null(column, b"" if large == pa.large_binary() else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def pieces(batch, column: str = "text", limit: int = 4 << 20):
    """The batch in runs of whole rows of about `limit` bytes of text each; a longer text is a run of its own."""
    if batch.num_rows == 0:
        return
    _, at = buffers(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def words(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of words before each text (one more entry than texts). No word crosses texts."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    w = inside[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    full = at[1:] > at[:-1]
    a, b = at[:-1][full], at[1:][full] - 1
    first[a], last[b] = w[a], w[b]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums that `span_hashes` takes differences of."""
    power, _ = _power(len(data) + 1)
    h, step = np.zeros(len(data) + 1, U), 1 << 17  # in blocks that stay in cache
    for i in range(0, len(data), step):
        block = _TABLE[data[i : i + step]]
        block *= power[i : i + len(block)]
        block[:1] += h[i]
        np.cumsum(block, out=h[i + 1 : i + 1 + len(block)])
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal spans have equal hashes."""
    h = prefix_hashes(data) if prefix is None else prefix
    return mix((h[ends] - h[starts]) * _power(len(data) + 1)[1][starts] + (ends - starts).astype(U))


def window_hashes(data: np.ndarray, width: int, prefix: np.ndarray) -> np.ndarray:
    """`span_hashes` of every span of `width` bytes, by their starts, without an index of places."""
    n = len(data) - width + 1
    h = prefix[width:] - prefix[:n]
    h *= _power(len(data) + 1)[1][:n]
    h += U(width)
    for i in range(0, n, 1 << 17):
        h[i : i + (1 << 17)] = mix(h[i : i + (1 << 17)])
    return h


def span_places(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places in the spans, one span after another."""
    n = ends - starts
    total = int(n.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    step = np.ones(total, np.int64)
    keep = n > 0
    s, n = starts[keep], n[keep]
    head = np.concatenate([[0], np.cumsum(n)[:-1]])
    step[head] = s
    step[head[1:]] -= s[:-1] + n[:-1] - 1
    return np.cumsum(step, out=step)


def gather_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one after another."""
    return data[span_places(starts, ends)]
