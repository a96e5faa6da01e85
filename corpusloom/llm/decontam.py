"""Benchmark decontamination with suffix arrays over the training text.

Each shard of training text, some megabytes of whole documents, gets a suffix array of its words. Every suffix of every
benchmark item is binary-searched in it, word by word: the range of places that its first ten words have are occurrences
of a window, and where the range ends is the longest verbatim match with its place (`longest_matches`). A place that a
window occurs at is also searched in the suffix array of the benchmark, which gives a document's own longest match. The
benchmark travels in blocks of bounded size, of which a task holds one at a time, so a larger benchmark costs more time and
disk, not more memory; the training side is never shuffled.

Defined cases: null and word-free texts have no words and are never hit; word-free benchmark items give no window;
repeated items share windows and are all reported, ids that are null as the empty string; an empty benchmark leaves every
document clean; document rows are taken one by one, repeated or not; extra columns are passed on, and those named like a
result give way to it in `matched`.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .bytetext import ALNUM, LOWER, buffers, gather_spans, pieces, span_hashes, words
from .shared import table

WINDOW = 10
#: Bytes of benchmark text in one block, and of training text in one shard; a longer item or document is one by itself.
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 1 << 20
#: Pairs of documents and items that are held at a time before repeated ones are merged.
PAIRS = 1 << 20


class Suffixes:
    """The suffix array of texts of word numbers. Words that can't match are 0; a suffix ends for the order at the first of them.

    By doubling: ranks of the suffixes by their first k words give those by 2 k words, so text that repeats costs rounds by
    the logarithm of its length. `longest`: no query has more words, so ties beyond them stay in order of place.
    """

    def __init__(self, numbers: np.ndarray, left: np.ndarray, longest: int):
        n = len(numbers)
        self.numbers = numbers
        stop = np.minimum.accumulate(np.where(numbers == 0, np.arange(n), n)[::-1])[::-1]
        self.depth = np.minimum(left, stop - np.arange(n))
        depth = np.minimum(self.depth, longest)
        at = np.flatnonzero(depth > 0)
        at = at[np.argsort(numbers[at], kind="stable")]
        head = np.flatnonzero(np.diff(numbers[at], prepend=0))
        rank = np.zeros(n + 1, np.int64)  # a group of equal suffixes has the place after its first one's; 0: nothing is left
        rank[at] = np.repeat(head, np.diff(np.append(head, len(at)))) + 1
        width, most, open_ = 1, int(depth.max(initial=0)), at
        while width < most and len(open_):
            key = rank[open_] << 32 | np.where(depth[open_] > width, rank[np.minimum(open_ + width, n)], 0)
            order = np.argsort(key, kind="stable")
            key, at = key[order], open_[order]
            i = np.arange(len(at))
            new = np.concatenate([[True], key[1:] != key[:-1]])
            group = np.concatenate([[True], key[1:] >> 32 != key[:-1] >> 32])
            rank[at] += np.maximum.accumulate(np.where(new, i, 0)) - np.maximum.accumulate(np.where(group, i, 0))
            size = np.diff(np.append(np.flatnonzero(new), len(at)))
            open_ = at[np.repeat(size > 1, size)]
            open_ = open_[depth[open_] > width]  # what ended is in its place
            width *= 2
        live = np.flatnonzero(depth > 0)
        self.order = live[np.argsort(rank[live], kind="stable")]
        self.heads = numbers[self.order]

    def column(self, k: int, at: np.ndarray) -> np.ndarray:
        """Word k of suffixes, 0 beyond their ends."""
        return np.where(self.depth[at] > k, self.numbers[np.minimum(at + k, len(self.numbers) - 1)], 0)


def search(suffixes: Suffixes, queries: Suffixes, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Looks the suffixes at `at` of the queries up: the range of suffixes that have their first `size` words, empty if none has;
    how many words the longest match has; and the range of suffixes that have that match.

    One binary search a word: the range for one more word lies in the range so far.
    """
    first = queries.numbers[at]
    lo, hi = np.searchsorted(suffixes.heads, first, "left"), np.searchsorted(suffixes.heads, first, "right")
    lo, hi = np.where(first > 0, lo, 0), np.where(first > 0, hi, 0)
    longest = (hi > lo).astype(np.int64)
    begin, end = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    done = (sizes == 1) & (hi > lo)
    begin[done], end[done] = lo[done], hi[done]
    live, k = np.flatnonzero(hi > lo), 1
    while len(live):
        live = live[queries.depth[at[live]] > k]
        want, ends = queries.numbers[at[live] + k], []
        for right in (False, True):
            a, b = lo[live], hi[live]
            while (open_ := a < b).any():
                m = (a + b) // 2
                v = suffixes.column(k, suffixes.order[np.minimum(m, len(suffixes.order) - 1)])
                up = open_ & ((v <= want) if right else (v < want))
                a, b = np.where(up, m + 1, a), np.where(open_ & ~up, m, b)
            ends.append(a)
        found = ends[0] < ends[1]
        live, k = live[found], k + 1
        lo[live], hi[live], longest[live] = ends[0][found], ends[1][found], k
        done = live[sizes[live] == k]
        begin[done], end[done] = lo[done], hi[done]
    return begin, end, longest, lo, hi


class Block:
    """Some benchmark items as texts of word numbers, from 1."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        data, at = buffers(pa.array(texts, pa.large_string()))
        data = LOWER[data] if len(data) else data
        a, b, first = words(data, at, ALNUM)
        self.vocabulary, one, number = np.unique(span_hashes(data, a, b), return_index=True, return_inverse=True)
        self.text, self.text_at = gather_spans(data, a[one], b[one]), np.concatenate([[0], np.cumsum((b - a)[one])])
        n = np.diff(first)
        self.ids, self.longest = ids, int(n.max(initial=0))
        self.item, self.first = np.repeat(np.arange(len(n)), n), first
        left = np.repeat(first[1:], n) - np.arange(len(number))
        self.suffixes = Suffixes((number + 1).astype(np.int64), left, self.longest)
        # a window is at each suffix of `window` words or more, and at the whole of a shorter item
        whole = np.minimum(window, n)[self.item] if len(n) else np.zeros(0, np.int64)
        self.size = np.where(left >= whole, whole, 0)

    def lookup(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of the words at [a, b) of data. Their bytes are compared, so a word that has the hash of another is none."""
        h = span_hashes(data, a, b)
        out, step = np.zeros(len(h), np.int64), 1 << 17
        if not len(self.vocabulary) or not len(h):
            return out
        k = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        may = np.flatnonzero((self.vocabulary[k] == h) & (np.diff(self.text_at)[k] == b - a))
        for i in range(0, len(may), step):
            m = may[i : i + step]
            same = gather_spans(data, a[m], b[m]) == gather_spans(self.text, self.text_at[k[m]], self.text_at[k[m] + 1])
            n = b[m] - a[m]
            ok = np.add.reduceat(same.astype(np.int64), np.concatenate([[0], np.cumsum(n)[:-1]])) == n
            out[m[ok]] = k[m[ok]] + 1
        return out


class Shard:
    """The words of some documents."""

    def __init__(self, column: pa.Array):
        data, at = buffers(column)
        self.data = LOWER[data] if len(data) else data
        self.a, self.b, self.first = words(self.data, at, ALNUM)
        self.n_words = np.diff(self.first)
        self.text = np.repeat(np.arange(len(self.n_words)), self.n_words)
        self.left = np.repeat(self.first[1:], self.n_words) - np.arange(len(self.a))

    def searched(self, block: Block) -> tuple[Suffixes, np.ndarray, tuple] | None:
        """The suffix array for a block, and what the search of its distinct suffixes finds."""
        numbers = block.lookup(self.data, self.a, self.b)
        if not numbers.any():
            return None
        suffixes = Suffixes(numbers, self.left, block.longest)
        at = np.arange(len(block.item))
        return suffixes, at, search(suffixes, block.suffixes, at, block.size)


def _pairs(group: np.ndarray, texts: np.ndarray, item_group: np.ndarray, items: np.ndarray, n_items: int) -> np.ndarray:
    """Distinct text * n_items + item of texts and items of the same group. Both are sorted by group."""
    lo, hi = np.searchsorted(item_group, group, "left"), np.searchsorted(item_group, group, "right")
    total, out, i = np.cumsum(hi - lo), np.zeros(0, np.int64), 0
    while i < len(group):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, "right")))
        n = hi[i:j] - lo[i:j]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[i:j], n)
        out = np.union1d(out, np.repeat(texts[i:j], n) * n_items + items[k])
        i = j
    return out


def scanned(column: pa.Array, blocks: Iterator[Block]) -> tuple[np.ndarray, np.ndarray, list[list[str]], np.ndarray]:
    """Words, hit words, ids of items with an occurring window and the longest verbatim match, in words, of each text of a shard."""
    shard = Shard(column)
    n = len(shard.n_words)
    edge, items, runs = np.zeros(len(shard.a) + 1, np.int64), [set() for _ in range(n)], np.zeros(n, np.int64)
    for block in blocks:
        found = shard.searched(block)
        if found is None:
            continue
        suffixes, at, (begin, end, *_) = found
        hit = np.flatnonzero((block.size > 0) & (end > begin))
        if not len(hit):
            continue
        # equal windows have the same range, and a place is in one range of each size only
        ranges, of = np.unique(np.stack([begin[hit], end[hit], block.size[hit]], axis=1), axis=0, return_inverse=True)
        of, count = of.reshape(-1), ranges[:, 1] - ranges[:, 0]
        group = np.repeat(np.arange(len(ranges)), count)
        place = suffixes.order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ranges[:, 0], count)]
        edge += np.bincount(place, minlength=len(edge)) - np.bincount(place + ranges[group, 2], minlength=len(edge))
        texts = np.unique(group * n + shard.text[place])
        member = np.unique(of * len(block.ids) + block.item[hit])
        for x in _pairs(texts // n, texts % n, member // len(block.ids), member % len(block.ids), len(block.ids)).tolist():
            items[x // len(block.ids)].add(block.ids[x % len(block.ids)])
        place = np.unique(place)
        _, _, longest, _, _ = search(block.suffixes, suffixes, place, np.zeros(len(place), np.int64))
        np.maximum.at(runs, shard.text[place], longest)
    covered = np.cumsum(edge[:-1]) > 0
    n_hit = np.bincount(shard.text[covered], minlength=n) if len(shard.text) else np.zeros(n, np.int64)
    return shard.n_words, n_hit, [sorted(x) for x in items], runs


class Blocks:
    """The benchmark in blocks, each a broadcast of its own. A task takes one at a time from its local disk and lets it go."""

    def __init__(self, benchmark: DataFrame, item_id: str, window: int, block_bytes: int):
        self.held: list[Broadcast] = []
        context, ids, texts, size = benchmark.sparkSession.sparkContext, [], [], 0
        keep = lambda: self.held.append(context.broadcast(pickle.dumps(Block(ids, texts, window))))
        for r in benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), "text", F.octet_length("text")).where("text is not null").toLocalIterator():
            if ids and size + r[2] > block_bytes:
                keep()
                ids, texts, size = [], [], 0
            ids.append(r[0])
            texts.append(r[1])
            size += r[2]
        if ids:
            keep()

    def __iter__(self) -> Iterator[Block]:
        last: list[Block] = getattr(self, "_last", [])  # the only block stays from shard to shard
        for b in self.held:
            block = last[0] if last else pickle.loads(b.value)
            b.__dict__.pop("_value", None)
            if len(self.held) == 1:
                self._last = [block]
            yield block


FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, items array<string>"
_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def matches_of(blocks: Blocks):
    """A function of a text column: a struct FOUND. Only texts go to Python. Marked nondeterministic so that plans evaluate it once."""

    @arrow_udf(f"struct<{FOUND}>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for part in pieces(pa.record_batch([texts], ["text"]), limit=SHARD_BYTES):
            n, hit, items, runs = scanned(part.column(0), blocks)
            cols = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array(hit > 0), pa.array(runs, pa.int64()), pa.array(items, pa.list_(pa.string()))]
            out.append(pa.StructArray.from_arrays(cols, _NAMES))
        kinds = [pa.int64()] * 3 + [pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.string())]
        return pa.concat_arrays(out) if out else pa.array([], pa.struct(list(zip(_NAMES, kinds))))

    return run.asNondeterministic()


def matched(docs: DataFrame, benchmark: DataFrame, keep: list[str], item_id: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The kept columns of each document, and what of it occurs in the benchmark, FOUND. One scan, no shuffle."""
    keep = [c for c in keep if c.lower() not in _NAMES]
    found = matches_of(Blocks(benchmark, item_id, window, block_bytes))
    rows = docs.select(*(F.col(c).alias(f"own_{i}") for i, c in enumerate(keep)), found(F.col("text")).alias("found"))
    return rows.select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(keep)), "found.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no window of a benchmark item occurs, with their own columns."""
    found = matches_of(Blocks(benchmark, item_id, window, block_bytes))
    rows = docs.toDF(*(f"own_{i}" for i in range(len(docs.columns))))  # whatever the columns are called
    rows = rows.withColumn("found", found(F.col(f"own_{docs.columns.index('text')}")))
    return rows.where(~F.col("found.contaminated")).drop("found").toDF(*docs.columns)


LONGEST = "item_id string, suffix long, n_words long, doc_id long, start long"


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, item_id: str = "item_id", id_column: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each suffix of a benchmark item (by its first word's place) that has `least` words or more of a document verbatim: the
    length of the longest match, and the first place that has it, by document and word. Of places of the same document in
    one shard the first is taken; shards send a row a suffix at most."""
    blocks = Blocks(benchmark, item_id, least, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=SHARD_BYTES):
                shard, ids = Shard(part.column(1)), part.column(0).to_pylist()
                order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, k))
                place_of = np.empty(len(ids), np.int64)
                place_of[order] = np.arange(len(ids))
                for block in blocks:
                    found = shard.searched(block)
                    if found is None:
                        continue
                    suffixes, _, (_, _, longest, lo, hi) = found
                    q = np.flatnonzero(longest >= least)
                    if not len(q):
                        continue
                    ranges, of = np.unique(np.stack([lo[q], hi[q]], axis=1), axis=0, return_inverse=True)
                    first = np.empty(len(ranges), np.int64)
                    for i, (x, y) in enumerate(ranges.tolist()):
                        p = suffixes.order[x:y]
                        doc = place_of[shard.text[p]]
                        first[i] = p[doc == doc.min()].min()
                    p = first[of.reshape(-1)]
                    text = shard.text[p]
                    yield pa.RecordBatch.from_arrays([pa.array([block.ids[k] for k in block.item[q]], pa.string()), pa.array(q - block.first[block.item[q]], pa.int64()), pa.array(longest[q], pa.int64()), pa.array([ids[k] for k in text], pa.int64()), pa.array(p - shard.first[text], pa.int64())], ["item_id", "suffix", "n_words", "doc_id", "start"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, LONGEST)
    best = F.min(F.struct((-F.col("n_words")).alias("n"), F.col("doc_id").isNull().alias("lone"), F.col("doc_id"), F.col("start")))
    return rows.groupBy("item_id", "suffix").agg(best.alias("b")).select("item_id", "suffix", (-F.col("b.n")).alias("n_words"), "b.doc_id", "b.start")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"]).drop("items")
