"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A text is cut into paragraphs, at line ends and after `.`, `!` and `?` that end a word; white space around them doesn't
count. Each paragraph hashes to a wide vector: `WIDE` lanes of 64 uniform bits and `SIGNS` lanes of +1 or -1, all from one
cryptographic hash, and a fingerprint is the sum over paragraphs, modulo 2^64. So it doesn't depend on their order, a
paragraph is added or taken out without the rest, and fingerprints of parts add up; the uniform lanes tell multisets apart
by 512 bits. The sign lanes also tell how much differs: the mean square of a difference's lanes estimates the squared size
of the multisets' difference. Lanes are independent, so the likeness of texts with nothing in common is off by 1 / sqrt(SIGNS)
(0.044) in the mean square at most, and other ones by less than twice that.

Defined cases: a null text is the empty one; a text without words has the zero vector; two of those are alike (1.0);
documents are ordered by id, then by text, null ids last; a lone document is its own next one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bytetext import NOT_SPACE, words
from .exchange import CHUNK_BYTES, TOLD, Bounds, Chunk, by_chunk, chunks
from .shared import table

WIDE, SIGNS = 8, 512
U = np.uint64
#: Paragraphs whose lanes are unpacked at a time.
STEP = 1 << 14
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def paragraphs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the paragraphs, and the number of paragraphs before each text."""
    a, b, first = words(data, at, NOT_SPACE)
    if not len(a):
        return a, b, np.zeros(len(at), np.int64)
    lines = np.concatenate([[0], np.cumsum(data == 0x0A)])
    last = _ENDS[data[b - 1]]
    last[:-1] |= lines[a[1:]] > lines[b[:-1]]
    last[first[1:][np.diff(first) > 0] - 1] = True
    ends = np.flatnonzero(last)
    return a[np.concatenate([[0], ends[:-1] + 1])], b[ends], np.searchsorted(ends, first)


def vectors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The wide lanes (uint64) and the sign lanes (int64) of each text."""
    n = len(at) - 1
    wide, signs = np.zeros((n, WIDE), U), np.zeros((n, SIGNS), np.int64)
    a, b, first = paragraphs(data, at)
    raw, a, b = data.tobytes(), a.tolist(), b.tolist()
    for i in range(0, len(a), STEP):
        j = min(i + STEP, len(a))
        cut = np.clip(first, i, j) - i
        some = np.flatnonzero(np.diff(cut))
        hashed = lambda kind: b"".join(hashlib.blake2b(raw[x:y], person=kind).digest() for x, y in zip(a[i:j], b[i:j]))  # noqa: B023, E731
        wide[some] += np.add.reduceat(np.frombuffer(hashed(b"lanes"), "<u8").reshape(-1, WIDE), cut[:-1][some], axis=0)
        one = np.unpackbits(np.frombuffer(hashed(b"signs"), np.uint8).reshape(-1, SIGNS // 8), axis=1)
        signs[some] += 2 * np.add.reduceat(one, cut[:-1][some], axis=0, dtype=np.int64) - np.diff(cut)[some, None]
    return wide, signs


def added(x: tuple, y: tuple) -> tuple:
    """The fingerprint vectors of both multisets together."""
    return x[0] + y[0], x[1] + y[1]


def taken_out(x: tuple, y: tuple) -> tuple:
    """The fingerprint vectors of x without the paragraphs of y."""
    return x[0] - y[0], x[1] - y[1]


def written(wide: np.ndarray, signs: np.ndarray) -> list[str]:
    """The bytes that a sign lane takes (1, 2, 4 or 8, as few as hold all), the uniform lanes and the sign lanes, as hex."""
    out, most = [], np.maximum(signs.max(axis=1, initial=0), -1 - signs.min(axis=1, initial=0))
    for x, y, m in zip(wide, signs, most.tolist()):
        width = next(k for k in (1, 2, 4, 8) if m < 1 << (8 * k - 1))
        out.append(f"{width}:{x.astype('<u8').tobytes().hex()}{y.astype(f'<i{width}').tobytes().hex()}")
    return out


def read(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    wide, signs = np.zeros((len(fingerprints), WIDE), U), np.zeros((len(fingerprints), SIGNS), np.int64)
    for k, f in enumerate(fingerprints):
        raw = bytes.fromhex(f[2:])
        wide[k], signs[k] = np.frombuffer(raw, "<u8", WIDE), np.frombuffer(raw, f"<i{f[0]}", SIGNS, 8 * WIDE)
    return wide, signs


def likeness(x: tuple, y: tuple) -> np.ndarray:
    """1 for equal multisets, about 0 for disjoint ones: 1 - |x - y|^2 / (|x|^2 + |y|^2), each estimated from the sign lanes."""
    square = lambda v: (v.astype(np.float64) ** 2).sum(axis=1)
    apart, both = square(x[1] - y[1]), square(x[1]) + square(y[1])
    near = np.clip(1 - apart / np.where(both > 0, both, 1), 0, 1)
    same = (x[0] == y[0]).all(axis=1) & (x[1] == y[1]).all(axis=1)
    return np.where(same, 1.0, np.where(both > 0, near, 0.0))


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), at


def edited(texts: list[bytes], following: list[bytes]) -> tuple[list[bytes], list[int]]:
    """Each text with its last floor(n / 2) code points replaced by the first as many of the following text, and n."""
    data, at = _flat([*texts, *following])
    chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.searchsorted(chars[:-1], at)
    n = np.diff(first)
    k = len(texts)
    half = n[:k] // 2
    cut = chars[first[:k] + n[:k] - half] - at[:k]
    head = chars[first[k:-1] + np.minimum(half, n[k:])] - at[k:-1]
    cut, head = np.where(half > 0, cut, np.diff(at)[:k]), np.where(half > 0, head, 0)
    return [t[:c] + f[:h] for t, f, c, h in zip(texts, following, cut.tolist(), head.tolist())], n[:k].tolist()


def fingerprints(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, RESULT. Texts are shuffled once, into ranges of ids; of each range
    its first text also goes to the range before it."""
    bounds = Bounds(docs, id_column, text_column, chunk_bytes)

    def numbers(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(bounds.chunk(batch.column(0))), pa.int64())], ["chunk"])

    ids = docs.select(docs[id_column].cast("long").alias("id"))
    used = sorted(r[0] for r in ids.mapInArrow(numbers, "chunk long").distinct().collect())  # one number a chunk
    before = dict(zip(used, [used[-1], *used[:-1]])) if used else {}
    rows = chunks(docs, bounds, id_column, text_column)

    def heads(i: int, c: Chunk, told: dict) -> pa.Table:
        return pa.table({"chunk": pa.array([before[i]], pa.int64()), "kind": pa.array([0], pa.int32()), "bucket": pa.array([0], pa.int32()), "blob": pa.array([c.texts[0]], pa.binary())})

    def last(i: int, c: Chunk, told: dict) -> pa.Table:
        if not c.ids:  # a range without documents
            return pa.table({x.split()[0]: pa.array([], t) for x, t in zip(RESULT.split(", "), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()])})
        following = [*c.texts[1:], told[0, 0]]
        changed, n = edited(c.texts, following)
        wide, signs = vectors(*_flat([*c.texts, told[0, 0]]))
        own, after, other = (wide[:-1], signs[:-1]), (wide[1:], signs[1:]), vectors(*_flat(changed))
        return pa.table({"doc_id": pa.array(c.ids, pa.int64()), "n_chars": pa.array(n, pa.int64()), "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()), "fingerprint": pa.array(written(*own), pa.string()), "edited_fingerprint": pa.array(written(*other), pa.string()), "near_edited": pa.array(likeness(own, other)), "near_next": pa.array(likeness(own, after))})

    return by_chunk(rows, by_chunk(rows, None, heads, TOLD), last, RESULT)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
