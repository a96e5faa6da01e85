"""Documents in chunks, and questions that chunks ask of the whole corpus.

A chunk is a row: some megabytes of documents in one compressed blob, in order of their ids. What a chunk wants to know of
the corpus it asks by sorted keys, packed by bucket. A bucket sees the keys of all chunks side by side and answers with two
bits a key, in the key's place, so that no key, however common, gives more than one entry a chunk, and neither keys nor
ids are sent back.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import buffers, pieces
from .shared import text_of

#: Bytes of text in a chunk. Chunks times buckets is the number of packed rows, so it should grow with the executors' memory.
CHUNK_BYTES = 8 << 20
CHUNK = "chunk long, blob binary"
ASKED = "bucket int, chunk long, n_keys long, blob binary"
TOLD = "chunk long, kind int, bucket int, blob binary"


class Bounds:
    """Which chunk an id is in: ranges of ids that hold about as many rows each; null ids come last."""

    def __init__(self, docs: DataFrame, id_column: str, text_column: str, chunk_bytes: int):
        n_bytes, lo = docs.agg(F.sum(F.octet_length(text_column)), F.count(id_column)).first()
        n = max(1, -(-(n_bytes or 0) // chunk_bytes))
        ask = [i / n for i in range(1, n)]
        cuts = docs.where(F.col(id_column).isNotNull()).approxQuantile(id_column, ask, 0.25 / n) if ask and lo else []
        # cuts are approximate, and rounded for ids beyond 2^53; ids are compared with them as the integers they are
        self.cuts, self.n, self.n_bytes = np.unique([min(max(int(c), -(1 << 63)), (1 << 63) - 1) for c in cuts]).astype(np.int64), n + 1, n_bytes or 0

    def chunk(self, ids: pa.Array) -> np.ndarray:
        null = ids.is_null().to_numpy(zero_copy_only=False)
        return np.where(null, self.n - 1, np.searchsorted(self.cuts, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), "right"))


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed blob; `unsqueezed` takes their kinds to read them."""
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack(f"<{len(raw)}q", *map(len, raw)) + b"".join(raw))


def unsqueezed(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = struct.unpack_from(f"<{len(kinds)}q", raw), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def packed(ids: list, data: np.ndarray, at: np.ndarray) -> bytes:
    """Ids (int or None), and texts."""
    null = np.array([i is None for i in ids], bool)
    whole = np.array([0 if i is None else i for i in ids], np.int64)
    raw = struct.pack("<q", len(ids)) + null.tobytes() + whole.tobytes() + np.diff(at).tobytes() + data.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(raw)


class Chunk:
    """The documents of one chunk, sorted by id, then text; nulls last."""

    def __init__(self, blobs: list[bytes]):
        ids, texts = [], []
        for blob in blobs:
            raw = zstandard.ZstdDecompressor().decompress(blob)
            (n,) = struct.unpack_from("<q", raw)
            null = np.frombuffer(raw, bool, n, 8)
            whole = np.frombuffer(raw, np.int64, n, 8 + n)
            sizes = np.frombuffer(raw, np.int64, n, 8 + 9 * n)
            at = 8 + 17 * n + np.concatenate([[0], np.cumsum(sizes)])
            ids += [(bool(x), int(i)) for x, i in zip(null, whole)]
            texts += [raw[a:b] for a, b in zip(at.tolist(), at[1:].tolist())]
        order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
        self.ids = [None if ids[k][0] else ids[k][1] for k in order]
        self.texts = [texts[k] for k in order]
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in self.texts], dtype=np.int64)]).astype(np.int64)
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)


def chunks(docs: DataFrame, bounds: Bounds, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(chunk, blob) rows, several for a chunk, dealt out by chunk. Used more than once in one plan, they are shuffled once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=16 << 20):
                of = bounds.chunk(part.column(0))
                for c in np.unique(of):
                    rows = part.take(pa.array(np.flatnonzero(of == c)))
                    data, at = buffers(rows.column(1))
                    yield pa.RecordBatch.from_arrays([pa.array([int(c)], pa.int64()), pa.array([packed(rows.column(0).to_pylist(), data, at)], pa.binary())], ["chunk", "blob"])

    return docs.select(F.col(id_column).cast("long").alias("id"), text_of(docs, text_column).alias("text")).mapInArrow(run, CHUNK)


def buckets_of(keys: np.ndarray, n: int) -> np.ndarray:
    """By the top bits, so that sorted keys lie in order of their buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def asked(chunk: int, keys: np.ndarray, n_buckets: int, width: int) -> pa.Table:
    """Rows that ask for sorted, distinct 64-bit keys. width: bytes of each key that travel; 4 leave its lower half, 8 all."""
    of = buckets_of(keys, n_buckets)
    at = np.flatnonzero(np.diff(of, prepend=-1)) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(keys))
    part = keys.astype("<u4") if width == 4 else keys
    return pa.table({"bucket": pa.array(of[at], pa.int32()), "chunk": pa.array(np.full(len(at), chunk), pa.int64()), "n_keys": pa.array(ends - at, pa.int64()), "blob": pa.array([part[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())})


def answered(questions: DataFrame, kind: int, width: int) -> DataFrame:
    """Two bits a key for each question: an earlier chunk asks for the key too, and any other chunk does. One bucket at a time."""

    def run(group: pa.Table) -> pa.Table:
        chunk = group.column("chunk").to_numpy()
        order = np.argsort(chunk, kind="stable")
        blobs = group.column("blob").to_pylist()
        sizes = group.column("n_keys").to_numpy()[order]
        keys = np.frombuffer(b"".join(blobs[k] for k in order), "<u4" if width == 4 else "<u8")
        at = np.argsort(keys, kind="stable")  # equal keys stay in order of their chunks
        ranked = keys[at]
        same = np.concatenate([[False], ranked[1:] == ranked[:-1]])
        earlier, other = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        earlier[at] = same
        other[at] = same | np.append(same[1:], False)
        ends = np.cumsum(sizes)
        bits = [np.packbits(np.concatenate([earlier[e - n : e], other[e - n : e]])).tobytes() for n, e in zip(sizes, ends)]
        return pa.table({"chunk": pa.array(chunk[order], pa.int64()), "kind": pa.array(np.full(len(order), kind), pa.int32()), "bucket": group.column("bucket").take(pa.array(order)), "blob": pa.array(bits, pa.binary())})

    return questions.groupBy("bucket").applyInArrow(run, TOLD)


def flags(told: dict[tuple[int, int], bytes], kind: int, keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """What `answered` said of sorted, distinct keys, in their order."""
    of = buckets_of(keys, n_buckets)
    at = np.flatnonzero(np.diff(of, prepend=-1)) if len(keys) else np.zeros(0, np.int64)
    earlier, other = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    for a, b in zip(at, np.append(at[1:], len(keys))):
        bits = np.unpackbits(np.frombuffer(told[kind, int(of[a])], np.uint8), count=2 * (b - a)).astype(bool)
        earlier[a:b], other[a:b] = bits[: b - a], bits[b - a :]
    return earlier, other


def by_chunk(rows: DataFrame, replies: DataFrame | None, run: Callable[[int, Chunk, dict], pa.Table], schema: str) -> DataFrame:
    """`run` over each chunk with its documents and what it was told so far."""

    def alone(key: tuple, group: pa.Table) -> pa.Table:
        return run(key[0].as_py(), Chunk(group.column("blob").to_pylist()), {})

    def both(key: tuple, group: pa.Table, told: pa.Table) -> pa.Table:
        say = dict(zip(zip(told.column("kind").to_pylist(), told.column("bucket").to_pylist()), told.column("blob").to_pylist()))
        return run(key[0].as_py(), Chunk(group.column("blob").to_pylist()), say)

    grouped = rows.groupBy("chunk")
    return grouped.applyInArrow(alone, schema) if replies is None else grouped.cogroup(replies.groupBy("chunk")).applyInArrow(both, schema)
