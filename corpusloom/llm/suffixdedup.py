"""Removal of repeated byte strings: suffix buckets, sorted one at a time with difference-cover ranks.

A suffix counts by its first `length` bytes. Equal ones have the same least sample hash among the strings of `ROUTE` bytes
that they hold, so suffixes are dealt out by it: neighbours in a text mostly share it and travel as one run, the bytes of
all of them at once. Hashes only route; what is equal is decided by the bytes.

1. A chunk of documents cuts its suffixes into runs, once, and asks which of their hashes other chunks have. Runs without an equal
   hash anywhere stay; of others with the same bytes the first one is sent.
2. A bucket has the text of all runs with hashes in its range, and takes them block by block. In a block, suffixes are
   ranked by their first bytes. Longer ties are resolved with a difference cover D modulo v = `period`: for any two places
   there is an offset below v at which both fall on the cover, so two suffixes with equal ends of v - 1 bytes are equal if
   their cover samples, strings of length - v + 1 bytes ranked beforehand, are. Ranks are kept of an eighth to a fifth of the
   places, and no more than a block is held. Of equal suffixes the first stays; a bit a suffix goes back.
3. Each chunk cuts the bytes that later suffixes cover.

A run is some 37 suffixes in 136 bytes, so about 3.7 times the text that repeats moves, compressed, and the text once. Rows are
chunks times buckets, or as many as runs if those are fewer; chunks and blocks should grow with the executors' memory.

Defined cases: a null text is the empty one; documents are ordered by id, null ids last, those with the same id or none by a
digest of their texts, then by their place in the stored chunks, so that of repeated rows one stays; a document shorter than
`length` keeps all its bytes; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import buffers, gather_spans, pieces, prefix_hashes, span_hashes, span_places, window_hashes
from .exchange import ASKED, TOLD, answered, asked, buckets_of, flags, squeezed, unsqueezed
from .shared import table, text_of

LENGTH = 100
PERIOD = 31
#: Bytes of the strings whose least hash routes a suffix.
ROUTE = 28
#: Bytes of text in a chunk; text of runs in a block, whose places fit into 18 bits.
CHUNK_BYTES, BLOCK_BITS = 2 << 20, 18
#: Tie groups are split by their first member so many times before all members are compared by residues.
ROUNDS = 4
U = np.uint64


def difference_cover(v: int) -> list[int]:
    """A small D such that every residue modulo v is a difference of two of its members.

    If v = q^2 + q + 1 a search finds a perfect one, of q + 1 members, where there is any; else members are added greedily.
    """
    q = int((v - 1) ** 0.5)

    def extend(d: list[int], used: set[int]) -> list[int] | None:
        if len(d) == q + 1:
            return d
        for x in range(d[-1] + 1, v):
            new = [y for m in d for y in ((x - m) % v, (m - x) % v)]
            if len(set(new)) == len(new) and not used & set(new) and (found := extend([*d, x], used | set(new))):
                return found
        return None

    if q * q + q + 1 == v and (found := extend([0, 1], {1, v - 1})):
        return found
    d, missing = [0], set(range(1, v))
    while missing:
        x = max(range(v), key=lambda c: len(missing & {y for m in d for y in ((c - m) % v, (m - c) % v)}))
        missing -= {y for m in d for y in ((x - m) % v, (m - x) % v)}
        d.append(x)
    return sorted(d)


# -- runs of a chunk ---------------------------------------------------------------------------------------------------


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by the least from and up to the ends of blocks."""
    n = len(h) - width + 1
    blocks = np.full(-(-len(h) // width) * width, np.iinfo(U).max, U)
    blocks[: len(h)] = h
    blocks = blocks.reshape(-1, width)
    after = np.minimum.accumulate(blocks, axis=1).reshape(-1)[width - 1 : width - 1 + n]
    before = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).reshape(-1)[:n]
    return np.minimum(before, after, out=before)


class Chunk:
    """The documents of a stored chunk in their order, and the runs of their suffixes: those of `runs`, which an equal chunk's `found`
    gave, or else found anew."""

    def __init__(self, blob: bytes, length: int, route: int = ROUTE, runs: bytes | None = None):
        null, ids, tie, at, data = unsqueezed(blob, "?", "<i8", "<u4", "<i8", "u1")
        self.null, self.ids, self.tie, self.at, self.data, self.length = null, ids, tie, at, data, length
        if runs is not None:
            self.starts, self.ends, self.key, self.multi, self.of = Chunk.runs(runs)
            return
        n, width = len(data), length - route + 1
        self.starts = self.ends = np.zeros(0, np.int64)
        self.key, self.multi, self.of = np.zeros(0, U), np.zeros(0, bool), np.zeros(0, np.int64)
        sizes = np.diff(at)
        if not (sizes >= length).any():
            return
        prefix = prefix_hashes(data)
        h = window_hashes(data, route, prefix)
        least = _least(h, width)
        edge = np.zeros(n + 2, np.int8)
        whole = sizes >= length
        np.add.at(edge, at[:-1][whole], 1)
        np.add.at(edge, at[1:][whole] - length + 1, -1)
        valid = np.cumsum(edge, dtype=np.int8)[: len(least)] > 0  # suffixes that lie in one document
        first, last = valid.copy(), valid.copy()
        on = valid[1:] & valid[:-1] & (least[1:] == least[:-1])
        first[1:] &= ~on
        last[:-1] &= ~on
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.key = least[self.starts]
        del least, edge, valid, first, last, on
        # whether the least hash is there again, so that suffixes of the run itself may be equal
        x = self.starts.copy()
        for _ in range(width - 1):
            x += h[x] != self.key
        limit = np.minimum(self.ends + width - 2, len(h) - 1)
        self.multi = self.ends - self.starts > width
        for d in range(1, 2 * width - 1):
            self.multi |= (x + d <= limit) & (h[np.minimum(x + d, limit)] == self.key)
        # of runs with the same bytes, the first
        self.of = np.arange(len(self.starts))
        stop = self.ends + length - 1
        digest = span_hashes(data, self.starts, stop, prefix)
        del h, prefix
        order = np.argsort(digest, kind="stable")
        head = np.concatenate([[True], digest[order][1:] != digest[order][:-1]])
        rep = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        may, rep = order[~head], rep[~head]
        for i in range(0, len(may), 1 << 13):
            m, r = may[i : i + (1 << 13)], rep[i : i + (1 << 13)]
            alike = stop[m] - self.starts[m] == stop[r] - self.starts[r]
            m, r = m[alike], r[alike]
            if len(m):
                same = gather_spans(data, self.starts[m], stop[m]) == gather_spans(data, self.starts[r], stop[r])
                size = stop[m] - self.starts[m]
                ok = np.add.reduceat(same.astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]])) == size
                self.of[m[ok]] = r[ok]

    def found(self) -> bytes:
        """The runs, by small numbers where there are any: distances of starts, lengths, and how far before a copy its first one is."""
        return squeezed(np.diff(self.starts, prepend=0).astype("<u4"), (self.ends - self.starts).astype("<u4"), self.key, self.multi, (np.arange(len(self.of)) - self.of).astype("<u4"))

    @staticmethod
    def runs(found: bytes) -> tuple[np.ndarray, ...]:
        gap, size, key, multi, back = unsqueezed(found, "<u4", "<u4", "<u8", "?", "<u4")
        starts = np.cumsum(gap, dtype=np.int64)
        return starts, starts + size, key, multi, np.arange(len(back)) - back

    def elsewhere(self, told: dict[tuple[int, int], bytes], n_buckets: int) -> np.ndarray:
        """Runs whose hash another chunk has too, or another run of this one, or one of their own suffixes again. Others have no equal."""
        keys, of = np.unique(self.key, return_inverse=True)
        _, other = flags(told, 0, keys, n_buckets)
        own = self.of == np.arange(len(self.of))
        return self.multi | (other | (np.bincount(of, weights=own, minlength=len(keys)) > 1))[of]

    def sent(self, n_buckets: int, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Buckets, and the runs that go there, of those that are wanted."""
        own = np.flatnonzero((self.of == np.arange(len(self.of))) & (True if wanted is None else wanted))
        own = own[np.argsort(self.key[own], kind="stable")]
        of = buckets_of(self.key[own], n_buckets)
        at = np.flatnonzero(np.diff(of, prepend=-1)) if len(of) else np.zeros(0, np.int64)
        return zip(of[at].tolist(), np.split(own, at[1:]) if len(at) else [])

    def blob(self, runs: np.ndarray) -> bytes:
        doc = np.searchsorted(self.at, self.starts[runs], "right") - 1
        text = gather_spans(self.data, self.starts[runs], self.ends[runs] + self.length - 1)
        return squeezed((self.key[runs] & U(0xFFFFFFFF)).astype("<u4"), (self.ends - self.starts)[runs].astype("<u4"), self.multi[runs], self.null[doc], self.ids[doc], self.tie[doc], self.starts[runs] - self.at[doc], text)

    def gone(self, told: dict[int, bytes], n_buckets: int, wanted: np.ndarray | None = None) -> np.ndarray:
        """The bytes that later suffixes cover."""
        n = len(self.data)
        later = np.zeros(n + 1, bool)
        for bucket, runs in self.sent(n_buckets, wanted):
            size = (self.ends - self.starts)[runs]
            later[span_places(self.starts[runs], self.ends[runs])] = np.unpackbits(np.frombuffer(told[bucket], np.uint8), count=int(size.sum())).astype(bool)
        copy = np.flatnonzero(self.of != np.arange(len(self.of)))
        edge = np.zeros(n + 1, np.int32)
        edge[:n] += later[:n]
        if n >= self.length:
            edge[self.length :] -= later[: n + 1 - self.length]
        np.add.at(edge, self.starts[copy], 1)  # all suffixes of a copy are later ones
        np.add.at(edge, self.ends[copy] + self.length - 1, -1)
        return np.cumsum(edge)[:n] > 0


# -- blocks of a bucket ------------------------------------------------------------------------------------------------


def ranked(key: np.ndarray) -> np.ndarray:
    """Dense ranks of unsigned keys. Those that leave room for their places are sorted together with them, which is faster."""
    n = len(key)
    if not n:
        return np.zeros(0, U)
    if n <= 1 << BLOCK_BITS and int(key.max()) < 1 << (64 - BLOCK_BITS):
        both = key << U(BLOCK_BITS) | np.arange(n, dtype=U)
        both.sort()
        key, at = both >> U(BLOCK_BITS), (both & U((1 << BLOCK_BITS) - 1)).astype(np.int64)
    else:
        at = np.argsort(key, kind="stable")
        key = key[at]
    out = np.empty(n, U)
    out[at] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])).astype(U)
    return out


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs of dense ranks."""
    bits = U(max(1, int(y.max(initial=0)).bit_length()))
    return ranked(x << bits | y)


def head_ranks(text: np.ndarray, width: int) -> np.ndarray:
    """Ranks of the strings of `width` bytes (5 at least) from each place that has them; by doubling."""
    n = len(text) - 4
    key = np.zeros(n, U)
    for k in range(5):
        key = key << U(8) | text[k : n + k].astype(U)
    rank, w = ranked(key), 5
    while w < width:
        step = min(w, width - w)
        rank = joined(rank[: len(rank) - step], rank[step:])
        w += step
    return rank


class Cover:
    """A difference cover modulo v, and for two residues the least offset at which both fall on it."""

    def __init__(self, v: int):
        d = difference_cover(v)
        self.v, self.on = v, np.zeros(v, bool)
        self.on[d] = True
        both = np.stack([[[self.on[(i + k) % v] and self.on[(j + k) % v] for k in range(v)] for j in range(v)] for i in range(v)])
        self.offset = both.argmax(axis=2)


def later_of(text: np.ndarray, places: np.ndarray, length: int, cover: Cover) -> np.ndarray:
    """Whether the string of `length` bytes from a place is there from an earlier one of the places, which are ascending."""
    v, depth, end = cover.v, length - cover.v + 1, cover.v - 1
    head = head_ranks(text, end)
    # ranks of the cover samples, by as many heads as they take
    sample = np.flatnonzero(cover.on[np.arange(len(text) - depth + 1) % v])
    rank = (head if depth >= end else head_ranks(text, depth))[sample]
    at = end
    while at < depth:
        step = min(at, depth - end)
        rank, at = joined(rank, head[sample + step]), step + end
    of_place = np.zeros(len(text) + 1, np.int64)
    of_place[sample] = rank
    # suffixes in order of their first and last bytes; ties by the ranks at the offset that a suffix has with its group's first
    tie = joined(head[places], head[places + length - end])
    order = np.argsort(tie, kind="stable")
    group, at = tie[order], places[order]
    later, open_ = np.zeros(len(places), bool), np.arange(len(places))
    for _ in range(ROUNDS):
        if not len(open_):
            return later
        first = np.concatenate([[True], group[open_][1:] != group[open_][:-1]])
        lead = at[open_[np.maximum.accumulate(np.where(first, np.arange(len(open_)), 0))]]
        p = at[open_]
        d = cover.offset[p % v, lead % v]
        same = of_place[p + d] == of_place[lead + d]
        later[order[open_[same & ~first]]] = True
        open_ = open_[~same]
    _by_residues(at, group, order, open_, of_place, cover, later)
    return later


def _by_residues(at: np.ndarray, group: np.ndarray, order: np.ndarray, open_: np.ndarray, of_place: np.ndarray, cover: Cover, later: np.ndarray) -> None:
    """Of large groups of unlike suffixes: members of two residues have one offset, so a sort by the ranks there finds all equal pairs."""
    v = cover.v
    by = [open_[at[open_] % v == r] for r in range(v)]
    for b in range(v):
        for a in range(b + 1):
            if not len(by[a]) or not len(by[b]):
                continue
            d = cover.offset[a, b]
            members = by[a] if a == b else np.concatenate([by[a], by[b]])
            key = joined(ranked(group[members]), ranked(of_place[at[members] + d].astype(U)))
            least = np.full(int(key.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, key.astype(np.int64), at[members])
            later[order[members[at[members] > least[key.astype(np.int64)]]]] = True


def sorted_bucket(parts: list[tuple[int, bytes]], length: int, cover: Cover) -> list[bytes]:
    """For the runs that each chunk sent, a bit a suffix: whether an equal one is earlier. Block by block of equal hashes."""
    parts = [(c, *unsqueezed(b, "<u4", "<u4", "?", "?", "<i8", "<u4", "<i8", "u1")) for c, b in parts]
    size = np.concatenate([p[2] for p in parts]).astype(np.int64)
    key, multi, null, ids, tie, start = (np.concatenate([p[k] for p in parts]) for k in (1, 3, 4, 5, 6, 7))
    chunk = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
    text = np.concatenate([p[8] for p in parts])
    counts = [len(p[1]) for p in parts]
    del parts
    begin = np.concatenate([[0], np.cumsum(size + length - 1)])
    where = np.concatenate([[0], np.cumsum(size)])
    later = np.zeros(where[-1], bool)
    order = np.lexsort((start, chunk, tie, ids, null, key))
    head = np.flatnonzero(np.diff(key[order].astype(np.int64), prepend=-1))
    n = np.diff(np.append(head, len(order)))
    busy = (n > 1) | np.maximum.reduceat(multi[order], head) if len(head) else np.zeros(0, bool)
    groups = [order[a : a + m] for a, m in zip(head[busy].tolist(), n[busy].tolist())]
    i = 0
    while i < len(groups):
        j, total = i, 0
        while j < len(groups) and (j == i or total + (size[groups[j]] + length - 1).sum() <= 1 << BLOCK_BITS):
            total += int((size[groups[j]] + length - 1).sum())
            j += 1
        runs = np.concatenate(groups[i:j])
        block = gather_spans(text, begin[runs], begin[runs] + size[runs] + length - 1)
        to = np.concatenate([[0], np.cumsum(size[runs] + length - 1)])[:-1]
        places = span_places(to, to + size[runs])
        for r, part in zip(runs.tolist(), np.split(later_of(block, places, length, cover), np.cumsum(size[runs])[:-1])):
            later[where[r] : where[r + 1]] = part
        i = j
    cut = np.concatenate([[0], np.cumsum(counts)])
    return [np.packbits(later[where[a] : where[b]]).tobytes() for a, b in zip(cut, cut[1:])]


# -- the corpus --------------------------------------------------------------------------------------------------------


def dealt_chunks(docs: DataFrame, chunk_bytes: int, length: int, route: int, id_column: str, text_column: str) -> DataFrame:
    """(chunk, blob, runs): documents by some megabytes, in their order. A chunk's number follows from its place in the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in pieces(batch, limit=chunk_bytes):
                data, at = buffers(part.column(1))
                null = part.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                raw, cut = data.tobytes(), at.tolist()
                tie = np.frombuffer(b"".join(hashlib.sha256(raw[a:b]).digest()[:4] for a, b in zip(cut, cut[1:])), "<u4")
                order = np.lexsort((tie, ids, null))
                data = gather_spans(data, at[order], at[order + 1])
                at = np.concatenate([[0], np.cumsum(np.diff(at)[order])])
                blob = squeezed(null[order], ids[order], tie[order], at, data)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([blob], pa.binary()), pa.array([Chunk(blob, length, route).found()], pa.binary())], ["chunk", "blob", "runs"])
                number += 1

    return docs.select(F.col(id_column).cast("long").alias("id"), text_of(docs, text_column).alias("text")).mapInArrow(run, "chunk long, blob binary, runs binary")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def without_repeats(docs: DataFrame, length: int = LENGTH, period: int = PERIOD, chunk_bytes: int = CHUNK_BYTES, keep_text: bool = True, id_column: str = "doc_id", text_column: str = "text", route: int = ROUTE) -> DataFrame:
    """Each document without the bytes that repeat earlier ones: RESULT; `kept` only with keep_text."""
    route = min(route, length)
    if not 6 <= period <= length - 4:
        raise ValueError("a cover sample, and the ends that are compared, have 5 bytes at least")
    n_bytes = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    n = max(1, n_bytes // (2 * chunk_bytes))
    chunks = dealt_chunks(docs, chunk_bytes, length, route, id_column, text_column).groupBy("chunk")  # exchanged once, and used three times

    def say(told: pa.Table) -> dict[tuple[int, int], bytes]:
        return dict(zip(zip(told.column("kind").to_pylist(), told.column("bucket").to_pylist()), told.column("blob").to_pylist()))

    def chunk_of(group: pa.Table) -> Chunk:
        return Chunk(group.column("blob")[0].as_py(), length, route, group.column("runs")[0].as_py())

    def ask(key: tuple, group: pa.Table) -> pa.Table:
        return asked(key[0].as_py(), np.unique(Chunk.runs(group.column("runs")[0].as_py())[2]), n, 4)

    def send(key: tuple, group: pa.Table, told: pa.Table) -> pa.Table:
        chunk, number = chunk_of(group), key[0].as_py()
        rows = [(bucket, chunk.blob(runs)) for bucket, runs in chunk.sent(n, chunk.elsewhere(say(told), n))]
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int32()), "chunk": pa.array([number] * len(rows), pa.int64()), "blob": pa.array([b for _, b in rows], pa.binary())})

    def sort(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("chunk").to_pylist(), group.column("blob").to_pylist()))
        bits = sorted_bucket(rows, length, Cover(period))
        return pa.table({"chunk": pa.array([c for c, _ in rows], pa.int64()), "kind": pa.array([1] * len(rows), pa.int32()), "bucket": group.column("bucket"), "blob": pa.array(bits, pa.binary())})

    def cut(group: pa.Table, told: pa.Table) -> pa.Table:
        c = chunk_of(group)
        said = say(told)
        gone = c.gone({bucket: blob for (kind, bucket), blob in said.items() if kind == 1}, n, c.elsewhere(said, n))
        total = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        head = c.at[:-1][np.diff(c.at) > 0]
        begins[head] = gone[head]
        spans = np.concatenate([[0], np.cumsum(begins)])
        n_removed = total[c.at[1:]] - total[c.at[:-1]]
        raw = c.data.tobytes()
        kept = [raw[a:b] if r == 0 else c.data[a:b][~gone[a:b]].tobytes() for r, a, b in zip(n_removed.tolist(), c.at.tolist(), c.at[1:].tolist())]
        ids = [None if x else i for x, i in zip(c.null.tolist(), c.ids.tolist())]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(np.diff(c.at), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(spans[c.at[1:]] - spans[c.at[:-1]], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), "kept": pa.array(kept if keep_text else [None] * len(kept), pa.binary())})

    known = answered(chunks.applyInArrow(ask, ASKED), 0, 4)
    runs = chunks.cogroup(known.groupBy("chunk")).applyInArrow(send, "bucket int, chunk long, blob binary")
    bits = runs.groupBy("bucket").applyInArrow(sort, TOLD)
    return chunks.cogroup(known.union(bits).groupBy("chunk")).applyInArrow(cut, RESULT)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")
