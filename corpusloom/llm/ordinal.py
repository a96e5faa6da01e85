"""Quality classifier: ordinal regression on graded ratings with a cumulative link.

A document's latent score is the sum of the weights of its distinct hashed words, of their beginnings, and of a few hashed
facts about its text (shares of symbols, distinct words, digits and capitals). Features that don't tell grades apart, by a
likelihood ratio test on the sample, weigh nothing, so long texts don't gather noise. Ordered thresholds cut the score: P(grade <= k) is the logistic
function of threshold k minus the score, with one set of weights for all grades. So the model gives an expected grade and
the tail probability of each grade or better.

It is fitted on a bounded sample of rated documents (`SAMPLE`, in order of a digest of the id) and applied to every whole
text in one scan.

Defined cases: a null text is the empty one, and scored by its facts alone; ratings without a grade, or of documents that
aren't there, are ignored; without any rating all documents are kept, without grades; an id rated twice counts twice; of several
documents with a rated id the least text is the rated one; each document row is graded by itself; extra columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .bytetext import ALNUM, LOWER, buffers, mix, pieces, span_hashes, words
from .shared import table

#: Rated documents that the fit sees.
SAMPLE = 8192
DIMENSIONS = 1 << 18
#: Bytes of the beginnings of longer words.
BEGINNINGS = (5, 6)
#: Share of a text's words from which a feature counts once more.
OFTEN = 0.01
#: Fewest sample documents that a feature must be in to be tested.
TESTED = 3
#: Bytes of text whose features are held at a time; a longer text is held whole.
PIECE = 1 << 20
#: Features that the fit counts at a time.
BLOCK = 1 << 18
U = np.uint64
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#$%&*|<>{}[]~^_=+@\\/"]] = True
_DIGITS, _CAPITALS = np.zeros(256, bool), np.zeros(256, bool)
_DIGITS[0x30:0x3A], _CAPITALS[0x41:0x5B] = True, True
#: Upper ends of the classes that a share is put in.
_SHARES = np.array([0.001, 0.003, 0.01, 0.03, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, dimension) pairs of words, then those of beginnings and of facts."""
    n = len(at) - 1
    low = LOWER[data] if len(data) else data
    a, b, first = words(low, at, ALNUM)
    counts, sizes = np.diff(first), np.maximum(np.diff(at), 1)
    of = np.repeat(np.arange(n, dtype=np.uint64), counts)
    dim = lambda h: h >> U(64 - 18)
    parts, distinct = [np.zeros(0, U)], np.zeros(n)
    for k in (0, *BEGINNINGS) if len(a) else ():
        pick = b - a > k
        h = mix(span_hashes(low, a[pick], np.where(k, a[pick] + k, b[pick])) + U(k))
        keys, times = np.unique(of[pick] << U(32) | dim(h), return_counts=True)
        if k == 0:
            distinct = np.bincount((keys >> U(32)).astype(np.int64), minlength=n) / np.maximum(counts, 1)
        often = (times >= 2) & (times >= OFTEN * counts[(keys >> U(32)).astype(np.int64)])
        parts += [keys, keys[often] ^ U(0x15555)]  # the same feature, as one that is there often
    keys = np.concatenate(parts)
    texts = (keys >> U(32)).astype(np.int64)
    share = lambda member: np.diff(np.concatenate([[0], np.cumsum(member[data])])[at]) / sizes if len(data) else np.zeros(n)
    again = np.zeros(n)  # share of words that repeat the one before
    if len(a) > 1:
        h = span_hashes(low, a, b)
        again = np.bincount(of[1:][(h[1:] == h[:-1]) & (of[1:] == of[:-1])].astype(np.int64), minlength=n) / np.maximum(counts, 1)
    facts = [again, share(_SYMBOLS), share(_DIGITS), share(_CAPITALS), np.where(counts < 20, 2, distinct), np.minimum(counts, 50) / 55, np.where(counts > 0, sizes / np.maximum(counts, 1) / 20, 0)]
    extra = [mix(np.searchsorted(_SHARES, f).astype(U) + U(1000 * (k + 1))) >> U(64 - 18) for k, f in enumerate(facts)]
    rows = np.arange(n)
    return np.concatenate([texts, *[rows] * len(extra)]), np.concatenate([(keys & U(0xFFFFFFFF)).astype(np.int64), *(x.astype(np.int64) for x in extra)])


def thresholds(theta: np.ndarray) -> np.ndarray:
    """Ordered cuts of the first cut and the logs of the gaps between them."""
    return np.concatenate([theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))])


def loss(w: np.ndarray, theta: np.ndarray, texts: np.ndarray, cols: np.ndarray, grades: np.ndarray, own: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean negative log likelihood of the grades, texts weighing `own`, with a ridge, and its gradients by w and theta."""
    n, n_grades = len(grades), len(theta) + 1
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    s = np.bincount(texts, weights=w[cols], minlength=n)
    edge = np.concatenate([[-40.0], thresholds(theta), [40.0]])
    hi, lo = sigmoid(edge[grades + 1] - s), sigmoid(edge[grades] - s)
    p = np.maximum(hi - lo, 1e-9)
    dhi, dlo = own * hi * (1 - hi) / p, own * lo * (1 - lo) / p
    g_cut = (np.bincount(grades, weights=-dhi, minlength=n_grades)[:-1] + np.bincount(grades, weights=dlo, minlength=n_grades)[1:]) / n
    g_theta = np.concatenate([[g_cut.sum()], [g_cut[k:].sum() * np.exp(theta[k]) for k in range(1, len(theta))]])
    g_w = np.bincount(cols, weights=((dhi - dlo) / n)[texts], minlength=len(w)) + ridge * w / 100
    return float(-(own * np.log(p)).sum() / n + ridge * (w * w).sum() / 200), g_w, g_theta


class Ordinal:
    """weights: of the dimensions; cuts: ordered thresholds, one fewer than grades."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights.astype(np.float32), cuts

    @classmethod
    def fit(cls, texts: np.ndarray, dims: np.ndarray, grades: np.ndarray, n_grades: int, ridge: float = 0.01, steps: int = 400, rate: float = 0.1, balance: float = 0.5) -> Ordinal:
        """texts, dims: features of the rated texts; grades from 0. With balance 1, grades weigh alike, however many have them;
        with 0, documents do."""
        n = len(grades)
        blocks = [slice(i, i + BLOCK) for i in range(0, len(dims), BLOCK)]  # numpy makes wider copies of what it counts
        seen = sum((np.bincount(dims[b], minlength=DIMENSIONS) for b in blocks), np.zeros(DIMENSIONS, np.int64)).astype(float)
        telling = np.zeros(DIMENSIONS, bool)
        least = 2 * np.log(max(1, (seen >= TESTED).sum())) + 2  # of so many features, less than one passes by chance
        for cut in range(n_grades - 1):
            low = grades <= cut
            p = low.mean() if n else 0
            k = sum((np.bincount(dims[b], weights=low[texts[b]], minlength=DIMENSIONS) for b in blocks), np.zeros(DIMENSIONS))
            term = lambda o, e: o * np.log(np.where(o > 0, o, 1) / np.maximum(e, 1e-12))
            telling |= 2 * (term(k, seen * p) + term(seen - k, seen * (1 - p)) + term(low.sum() - k, (n - seen) * p) + term(n - seen - low.sum() + k, (n - seen) * (1 - p))) >= least
            telling &= seen >= TESTED
        used, keep = np.flatnonzero(telling), telling[dims]
        texts, cols = texts[keep].astype(np.int64), np.searchsorted(used, dims[keep])
        del keep, dims
        have = np.bincount(grades, minlength=n_grades)
        own = (n / np.maximum(have, 1) / max(1, (have > 0).sum()))[grades] ** balance
        w = np.zeros(len(used))
        prior = np.cumsum(have / max(n, 1))[:-1].clip(0.02, 0.98)
        raw = np.log(prior / (1 - prior))
        theta = np.concatenate([raw[:1], np.log(np.maximum(np.diff(raw), 0.1))])  # first cut, then logs of the gaps
        state = [np.zeros((2, len(w))), np.zeros((2, len(theta)))]
        for t in range(1, steps + 1):
            _, g_w, g_theta = loss(w, theta, texts, cols, grades, own, ridge)
            for x, g, m in ((w, g_w, state[0]), (theta, g_theta, state[1])):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.99 * m[1] + 0.01 * g * g
                x -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-6)
        weights = np.zeros(DIMENSIONS)
        weights[used] = w
        return cls(weights, thresholds(theta))

    def tails(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """P(grade > k) of each text, a column for each threshold."""
        texts, dims = features(data, at)
        s = np.bincount(texts, weights=self.weights[dims], minlength=len(at) - 1)
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - s[:, None], -40, 40)))


def grade_of(labels: DataFrame) -> Column:
    """0 toxic, 1 poor, 2 good."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", n_grades: int = 3) -> Ordinal | None:
    """The model of a sample of the ratings; None without any. labels: id_column, quality, toxic."""
    key = F.col(id_column).cast("long")
    rated = labels.select(key.alias("id"), grade_of(labels).alias("grade")).where("id is not null and grade is not null")
    rated = rated.orderBy(F.md5(F.col("id").cast("string")), "grade").limit(sample)  # at most `sample` pairs of numbers
    texts = docs.select(key.alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rated.select("id").distinct()), "id", "left_semi")
    some = texts.groupBy("id").agg(F.min("text").alias("text")).join(F.broadcast(rated), "id").select("id", "grade", "text")  # `sample` rows, however often ids repeat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=PIECE):
                texts, dims = features(*buffers(part.column(2)))
                order = np.argsort(texts, kind="stable")
                cut = np.searchsorted(texts[order], np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(dims[order], pa.int32()))], ["id", "grade", "dims"])

    rows = some.mapInArrow(run, "id long, grade int, dims array<int>").toArrow()
    if not rows.num_rows:
        return None
    texts, dims, grades = by_text(rows)
    del rows
    model = Ordinal.fit(texts, dims, grades, n_grades)
    del texts, dims
    pa.default_memory_pool().release_unused()
    return model


def by_text(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of (id, grade, dims) rows, in order of ids and grades: texts' numbers, dimensions, and the texts' grades. They are
    copied once, in 8 bytes a feature, as the driver holds them beside its JVM."""
    ids, grades = rows.column("id").to_numpy(), rows.column("grade").to_numpy()
    lists = [x for x in rows.column("dims").chunks if len(x)]
    sizes = np.concatenate([x.value_lengths().to_numpy() for x in lists]).astype(np.int64)
    order = np.lexsort((grades, ids))
    to = np.empty(len(order), np.int64)
    to[order] = np.cumsum(sizes[order]) - sizes[order]
    dims, row = np.empty(sizes.sum(), np.int32), 0
    for x in lists:
        flat = x.flatten().to_numpy()
        at = np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())])
        for a, b in zip(at.tolist(), at[1:].tolist()):
            dims[to[row] : to[row] + b - a] = flat[a:b]
            row += 1
    return np.repeat(np.arange(len(order), dtype=np.int32), sizes[order]), dims, grades[order]


GRADED = ("expected_grade", "tail_probability", "kept")


def grades(model: Ordinal | None, spark: SparkSession):
    """A function of a text column: struct of the expected grade and the probability of the best one; nulls without a model.
    Texts go to Python and two numbers come back. It is marked nondeterministic so that plans evaluate it once."""
    held = spark.sparkContext.broadcast(model)  # DIMENSIONS numbers

    @arrow_udf("struct<expected double, tail double>")
    def run(texts: pa.Array) -> pa.Array:
        found = [np.zeros((0, 2))]
        for part in pieces(pa.record_batch([texts], ["text"]), limit=PIECE):
            if held.value is None:
                found.append(np.full((part.num_rows, 2), np.nan))
            else:
                p = held.value.tails(*buffers(part.column(0)))
                found.append(np.stack([p.sum(axis=1), p[:, -1]], axis=1))
        both = np.concatenate(found)
        return pa.StructArray.from_arrays([pa.array(both[:, k].copy(), from_pandas=True) for k in range(2)], ["expected", "tail"])

    return run.asNondeterministic()


def graded(docs: DataFrame, model: Ordinal | None, keep: list[str], least: float = 0.5) -> DataFrame:
    """The kept columns, the expected grade, the probability of the best grade, and whether that is at least `least`. Of
    kept columns with the names of these three, the results take the place."""
    keep = [c for c in keep if c.lower() not in GRADED]
    rows = docs.select(*(F.col(c).alias(f"own_{i}") for i, c in enumerate(keep)), grades(model, docs.sparkSession)(F.col("text")).alias("g"))
    stays = F.coalesce(F.col("g.tail") >= least, F.lit(True))
    return rows.select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(keep)), F.col("g.expected").alias(GRADED[0]), F.col("g.tail").alias(GRADED[1]), stays.alias(GRADED[2]))


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The documents whose probability of the best grade is at least `least`, with their own columns."""
    model = fitted(docs, labels, **options)
    rows = docs.toDF(*(f"own_{i}" for i in range(len(docs.columns))))  # whatever the columns are called
    g = rows.withColumn("g", grades(model, docs.sparkSession)(F.col(f"own_{docs.columns.index('text')}")))
    return g.where(F.coalesce(F.col("g.tail") >= least, F.lit(True))).drop("g").toDF(*docs.columns)


def op7_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept, with their grades; `graded` has the rejected ones too."""
    docs = table(spark, sf_dir, "documents")
    return graded(docs, fitted(docs, table(spark, sf_dir, "labels")), ["doc_id"]).where("kept")
