"""Near-duplicate documents: bottom-k sketches of one hash function, inverted lists, exact Jaccard.

1. Each text becomes the set of hashes of its five-word shingles, and a sketch: its k smallest hashes. Equal sets are one
   class from here on.
2. Retained hashes are counted, and each class is entered in the lists of its rarest ones only. Sketches of linked sets
   have at least t hashes in common, so the k - t + 1 rarest of each (rarest in one common order) have one in common.
   Sets that fit into their sketches have a t that follows from their size alone; for larger ones t is the
   largest number that a pair at the threshold misses at most once in 10^8 (`common_of`), and estimates below the share
   t / 64 are what such a pair doesn't have either.
3. A list's members are compared in one task, or, if there are more than 2 `BLOCK` or their sets hold over 2 `HASHES`, in pairs
   of blocks: sketches give the overlap and an estimate of the Jaccard similarity of the sets, and what passes is held
   against the full sets. Of the links found, a task returns a spanning forest, so rows grow with members, not with pairs.
4. Forests join up to components by alternating star contraction.

Defined cases: null and word-free texts have the empty set and are linked with nothing; a text of fewer than five words is
one shingle; repeated rows are equal sets; rows with a null id count as members, but no component is named after them (one
of such rows only has a null component_id, and all its rows are kept).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytetext import LOWER, NOT_SPACE, buffers, mix, pieces, span_hashes, words
from .shared import FILE_DOCUMENTS, FILE_ROWS, gathered, stored, table

SHINGLE, KEPT, BLOCK = 5, 64, 1024
#: Hashes of full sets that a block should hold.
HASHES = 1 << 22
#: Of pairs at the threshold, the share that may be missed.
MISS = 1e-8
U = np.uint64


def common_of(percent: int, kept: int = KEPT) -> int:
    """The largest t with P(X < t) <= MISS, where X, of what two sets at the threshold have in common among the `kept` least
    hashes of their union, is binomial. Sketches have as many in common at least."""
    p, tail, t = percent / 100, 0.0, 0
    while t < kept:
        tail += math.comb(kept, t) * p**t * (1 - p) ** (kept - t)
        if tail > MISS:
            break
        t += 1
    return max(1, t)


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; a shorter text's whole sequence of words is one."""
    low = LOWER[data] if len(data) else data
    a, b, first = words(low, at, NOT_SPACE)
    h, n = span_hashes(low, a, b), np.diff(first)
    out = []
    if len(h) >= size:
        s = np.full(len(h) - size + 1, size, U)
        for k in range(size):
            s = mix(s + h[k : k + len(s)])
    for i, m in zip(first[:-1].tolist(), n.tolist()):
        if m >= size:
            out.append(np.unique(s[i : i + m - size + 1]))
        elif m:
            x = np.full(1, m, U)
            for k in range(m):
                x = mix(x + h[i + k : i + k + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, U))
    return out


def _set_digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def sketched(docs: DataFrame, id_column: str, size: int, kept: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                sets = shingle_sets(*buffers(part.column(1)), size)
                heads = [s[:kept] for s in sets]
                cut = np.concatenate([[0], np.cumsum([len(x) for x in heads])])
                flat = np.concatenate(heads).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_digest(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat))], ["doc_id", "n", "node", "sketch"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n long, node binary, sketch array<long>")


def full_sets(docs: DataFrame, id_column: str, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                sets = [s for s in shingle_sets(*buffers(part.column(0)), size) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_set_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "whole"])

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "node binary, whole binary")


def _incidence(sets: list[np.ndarray], step: int = 4096) -> Iterator[np.ndarray]:
    """0/1 matrices, member by value, over the values that two members have at least, some columns at a time."""
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    keep = count[number] > 1
    of, column, n = of[keep], column[number[keep]], int((count > 1).sum())
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    for i in range(0, n, step):
        a, b = np.searchsorted(column, [i, i + step])
        m = np.zeros((len(sets), min(step, n - i)), np.float32)
        m[of[a:b], column[a:b] - i] = 1
        yield m


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), len(sets)), np.float32)
    for m in _incidence(sets):
        out += m @ m.T
    return out.astype(np.int32)


def linked(sets: list[np.ndarray], percent: int, kept: int = KEPT, common: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets."""
    common = common_of(percent, kept) if common is None else common
    n = np.array([len(s) for s in sets])
    heads = [s[:kept] for s in sets]
    k = np.minimum(n, kept)
    overlap = _overlaps(heads)
    np.fill_diagonal(overlap, k)
    # the estimate over the hashes up to the lesser end of both sketches, which both hold without gaps; a whole set has no end
    top = np.array([h[-1] if m > kept else np.iinfo(U).max for h, m in zip(heads, n)], U)
    within = np.array([np.searchsorted(h, top, "right") for h in heads], np.int32)
    union = within + within.T - overlap
    may = overlap * kept >= np.maximum(union, 1) * min(common, kept * percent // 100)
    may &= (100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n)) & (overlap > 0)
    i, j = np.nonzero(np.triu(may, 1))
    if not len(i):
        return []
    if len(i) > 4 * len(sets):
        both = _overlaps(sets)[i, j].astype(np.int64)
    else:
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j)])
    ok = 100 * both >= percent * (n[i] + n[j] - both)
    top_of, forest = list(range(len(sets))), []

    def find(x: int) -> int:
        while top_of[x] != x:
            top_of[x] = top_of[top_of[x]]
            x = top_of[x]
        return x

    for x, y in zip(i[ok].tolist(), j[ok].tolist()):
        if (p := find(x)) != (q := find(y)):
            top_of[max(p, q)] = min(p, q)
            forest.append((x, y))
    return forest


def met(rows: DataFrame, facts: DataFrame, key: str, heavy, how: str = "inner") -> DataFrame:
    """rows joined with the one fact of their key. Keys that are `heavy` have over a thousandth of all rows, so there are a
    thousand at most: their facts are broadcast, and no task gets all rows of such a key."""
    hot = F.broadcast(facts.where(heavy))
    rest = rows.join(hot.select(key), key, "left_anti").join(facts.where(~heavy), key, how)
    return rows.join(hot, key).unionByName(rest)


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(node, root) of every node of (a, b): alternating large and small stars until nothing changes. files: most files that
    a round is stored in.

    Each round halves the depth of chains, at least; only minima and single edges are exchanged, so a hub costs no list.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if not large:
            both = both.where("v < u")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        moved = both.join(least, "u")  # pairs of numbers; a hub that outgrows a task is split by adaptive execution
        if large:
            return moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()

    sign = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    few = lambda e: e if files is None else gathered(e, files)
    e = stored(few(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()), "edges")
    was = sign(e)
    while was[0]:
        e = stored(few(star(star(e, True), False)), "edges")
        now = sign(e)
        if now == was:
            break
        was = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = SHINGLE, kept: int = KEPT, common: int | None = None, block: int = BLOCK, id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a document. Links are pairs with 100 |A and B| >= percent |A or B|."""
    common = common_of(percent, kept) if common is None else common
    n_rows = docs.count()
    small, many = n_rows // FILE_DOCUMENTS, -(-n_rows * kept // (4 * FILE_ROWS))  # files of sketches, and of list entries, a quarter of what is retained
    rows = stored(gathered(sketched(docs, id_column, size, kept), small), "sketches")
    classes = stored(gathered(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), small), "classes")

    # the rarest retained hashes of each class that any other class retains too
    entries = classes.select("node", "n", F.explode("sketch").alias("v"))
    counts = entries.groupBy("v").agg(F.count("*").alias("df"), F.sum("n").alias("hashes")).where("df > 1")
    n_entries = classes.agg(F.coalesce(F.sum(F.size("sketch")), F.lit(0))).first()[0]
    entries = met(entries, counts, "v", F.col("df") > n_entries // 1000)
    k = F.least(F.col("n"), F.lit(kept))
    whole = int(kept * percent / 100)  # partners of sets up to this size fit into their sketches
    t = F.when(F.col("n") <= whole, F.ceil(F.col("n") * percent / 100.0 - 1e-9)).otherwise(F.lit(common))
    mine = Window.partitionBy("node")
    lone = k - F.count("*").over(mine)  # hashes of one class only come first, and are in no list
    rank = F.row_number().over(mine.orderBy("df", "v"))
    blocks = F.ceil(F.greatest(F.col("df") / block, F.col("hashes") / HASHES)).cast("int")
    entries = entries.select("node", "v", "df", blocks.alias("blocks"), rank.alias("rank"), (k - t + 1 - lone).alias("most")).where("rank <= most").drop("rank", "most")
    entries = stored(gathered(entries, many), "entries")

    # lists with the same members are one; long ones are compared block by block
    short = entries.where("blocks <= 2").groupBy("v").agg(F.array_sort(F.collect_list("node")).alias("nodes")).where(F.size("nodes") > 1)
    short = short.select("nodes").distinct().select(F.md5(F.concat_ws(",", F.transform("nodes", F.hex))).alias("list"), F.explode("nodes").alias("node"))
    own = F.pmod(F.xxhash64("node", "v"), F.col("blocks")).cast("int")
    long = entries.where("blocks > 2").select("node", "v", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("own <> other")
    long = long.select(F.concat_ws(":", "v", F.least("own", "other"), F.greatest("own", "other")).alias("list"), "node")
    members = stored(gathered(short.union(long), many), "members")

    def compare(group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_pylist()
        found = [np.frombuffer(x, U) for x in group.column("whole").to_pylist()]
        pairs = linked(found, percent, kept, common)
        return pa.table({"a": pa.array([nodes[i] for i, _ in pairs], pa.binary()), "b": pa.array([nodes[j] for _, j in pairs], pa.binary())})

    asked = members.select("node").distinct().join(classes.select("node", "least_id"), "node")
    wanted = asked.select(F.col("least_id").alias("asked_id")).distinct()
    there = docs.select(F.col(id_column).cast("long").alias("doc_id"), "text").join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("asked_id")), "left_semi")
    sets = full_sets(there, "doc_id", size).join(asked.select("node"), "node", "left_semi").groupBy("node").agg(F.first("whole").alias("whole"))
    forest = members.join(sets, "node").select("list", "node", "whole").groupBy("list").applyInArrow(compare, "a binary, b binary")
    roots = components(forest, many)

    least = roots.join(classes.select("node", "least_id"), "node").groupBy("root").agg(F.min("least_id").alias("root_id"))
    linked_ = roots.join(least, "root").select("node", "root_id")
    ids = stored(gathered(classes.select("node", "least_id", "copies").join(linked_, "node", "left").select("node", "copies", F.coalesce("root_id", "least_id").alias("component")), small), "named")
    found = met(rows.where("node is not null").select("doc_id", "n", "node"), ids, "node", F.col("copies") > n_rows // 1000).select("doc_id", F.col("n").alias("n_shingles"), "component")
    found = found.union(rows.where("node is null").select("doc_id", "n", "doc_id"))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.col("component").isNull()).alias("kept"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The documents that name their components, with their own columns; of repeated rows with the same id all stay."""
    kept = near_duplicates(docs, id_column=id_column, **options).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.toDF(*(f"own_{i}" for i in range(len(docs.columns))))  # whatever the columns are called
    own_id = F.col(f"own_{docs.columns.index(id_column)}").cast("long")
    return rows.join(kept.hint("shuffle_hash"), own_id.eqNullSafe(F.col("kept_id")), "left_semi").toDF(*docs.columns)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
