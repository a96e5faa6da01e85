"""Queries over chunks, selection, vectors, profiles, training sets and verification."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import providers
from corpusloom.functions import text as T
from corpusloom.operators import folds, gates, scores, training, verify

from . import duck as D
from .textqueries import _CATEGORY, docs, paras, score_columns

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- chunkers ----------------------------------------------------------------------------------------------------------


def _chunk_sql(target: int, ends: str, keep: float, overlap: int, rest: float, source: str = "documents") -> str:
    """Jumps over prefix sums; before a chunk ends it has fewer than `target` words, which bounds the join."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {D.sentences('text')} AS ss FROM {source}),
  l AS (SELECT doc_id, CAST(unnest(generate_series(0, len(ss) - 1)) AS BIGINT) AS k, unnest(list_transform(ss, lambda s_: {D.n_words('s_')})) AS w, len(ss) AS n FROM d),
  s AS (SELECT *, CAST(sum(w) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) - w AS BIGINT) AS p, CAST(sum(w) OVER (PARTITION BY doc_id) AS BIGINT) AS total FROM l),
  e AS (SELECT a.doc_id, a.k, a.n, a.p, a.total, coalesce(min(CASE WHEN {ends} THEN b.k WHEN b.p + b.w - a.p >= {target} THEN b.k + 1 END), a.n) AS e
        FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.p - a.p < {target} GROUP BY a.doc_id, a.k, a.n, a.p, a.total),
  j AS (SELECT e.*, coalesce(s.p, e.total) - e.p AS words, e.k + greatest(1, e.e - e.k - {overlap}) AS nxt FROM e LEFT JOIN s ON s.doc_id = e.doc_id AND s.k = e.e),
  c AS (SELECT * FROM j WHERE k = 0 UNION ALL SELECT j.* FROM c JOIN j ON j.doc_id = c.doc_id AND j.k = c.nxt AND j.total - j.p >= {rest}::DOUBLE)
SELECT c.doc_id, CAST(row_number() OVER (PARTITION BY c.doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_idx, CAST(k AS INTEGER) AS first_sent, CAST(e AS INTEGER) AS last_sent,
       CAST(words AS BIGINT) AS word_count, CAST(e - k AS BIGINT) AS sentence_count, array_to_string(d.ss[k + 1:e], ' ') AS text
FROM c JOIN d ON d.doc_id = c.doc_id WHERE words >= {keep}::DOUBLE"""


@query(_chunk_sql(150, "b.p - a.p >= 100 AND b.p - a.p + b.w > 210", 100, 2, 70))
def overlap_chunks(spark, sf_dir):
    return folds.chunks(docs(spark, sf_dir), folds.window_spans)


@query(_chunk_sql(150, "b.k - a.k >= 2 AND b.p - a.p + b.w > 195", 75, 1, 60))
def rechunk(spark, sf_dir):
    return folds.chunks(docs(spark, sf_dir), folds.rechunk_spans)


@query(_chunk_sql(400, "b.p - a.p >= 150 AND b.p - a.p + b.w > 440", 150, 2, 75))
def training_chunks(spark, sf_dir):
    """Training chunks of each document as original text; a corpus of one author is a document here, so no author is one task."""
    return folds.chunks(docs(spark, sf_dir), folds.training_spans)


@query()
def index_chunks(spark, sf_dir):
    rows = folds.packed(docs(spark, sf_dir), folds.index_pieces).join(docs(spark, sf_dir).select("doc_id", F.col("source").alias("author")), "doc_id")
    return rows.withColumn("id", T.chunk_id(F.col("author"), F.col("doc_id").cast("string"), F.col("chunk_idx")))


@query()
def blend_paragraph_pack(spark, sf_dir):
    return folds.packed(docs(spark, sf_dir), folds.packed_paragraphs)


@query(f"SELECT 'original' AS variation_type, CAST(count(*) AS BIGINT) AS n, round(avg(word_count), 6) AS mean_words, min(word_count) AS least, max(word_count) AS most, CAST(3 * count(*) AS BIGINT) AS projected FROM ({_chunk_sql(150, 'b.p - a.p >= 100 AND b.p - a.p + b.w > 210', 100, 2, 70)})")
def chunk_stats(spark, sf_dir):
    c = overlap_chunks(spark, sf_dir)
    return c.agg(F.count("*").alias("n"), F.round(F.avg("word_count"), 6).alias("mean_words"), F.min("word_count").alias("least"), F.max("word_count").alias("most"), (3 * F.count("*")).alias("projected")).select(F.lit("original").alias("variation_type"), "*")


# -- sampling, clusters, selection -------------------------------------------------------------------------------------


_P_WORDS = f"{D.PARAS}, pw AS (SELECT doc_id, author, para_idx, text, {D.n_words('text')} AS n FROM paras)"


@query(f"""WITH {_P_WORDS}, k AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY doc_id, para_idx) - 1 AS idx FROM pw WHERE n >= 30),
  s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY author ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k WHERE idx % 2 = 0)
SELECT doc_id, author, para_idx, n AS n_words FROM s WHERE before < 2000""")
def sequential_sample(spark, sf_dir):
    """Every second paragraph of an author until 2000 words are there."""
    rows = paras(spark, sf_dir).withColumn("n_words", T.count_words(F.col("text"))).where("n_words >= 30").drop("text")
    order = Window.partitionBy("author").orderBy("doc_id", "para_idx")
    even = rows.withColumn("idx", F.row_number().over(order) - 1).where("idx % 2 = 0")
    before = F.coalesce(F.sum("n_words").over(Window.partitionBy("author").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return even.withColumn("before", before).where("before < 2000").select("doc_id", "author", "para_idx", "n_words")


#: Words that don't mark a paragraph's content; fixed values, of five letters or more.
_UNMARKED = """
    would could should their there which about other where these those might shall being having doing thought seemed found
    before after through between under above below without within around against along across behind beyond during until
    while never always often still already again every itself himself myself themselves
""".split()


def signature_rows(rows: DataFrame, *key: str) -> DataFrame:
    """key, signature, cluster of every row with a telling word: its five most frequent ones, and their digest modulo 50."""
    words = F.filter(T.word_tokens(F.col("text")), lambda w: w.rlike(r"\A[a-z]{5,}\z") & ~w.isin(*_UNMARKED))
    counts = rows.select(*key, F.explode(words).alias("w")).groupBy(*key, "w").count()
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("count"), "w"))
    top = counts.withColumn("r", rank).where("r <= 5").groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("w")), " ").alias("signature"))
    return top.withColumn("cluster", (F.conv(F.left(F.md5("signature"), F.lit(8)), 16, 10).cast("long") % 50))


_SIGNATURE = f"""sig AS (SELECT doc_id, signature, CAST(('0x' || substr(md5(signature), 1, 8))::BIGINT % 50 AS BIGINT) AS cluster FROM (
  SELECT doc_id, array_to_string(list_sort(list(w)), ' ') AS signature FROM (
    SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, w) AS r FROM (
      SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(list_filter({D.word_tokens('text')}, lambda t: regexp_full_match(t, '[a-z]{{5,}}') AND NOT list_contains({D.listed(_UNMARKED)}, t))) AS w FROM documents) GROUP BY ALL)) WHERE r <= 5 GROUP BY doc_id))"""


@query(f"WITH {_SIGNATURE} SELECT doc_id, signature, cluster FROM sig")
def hash_clusters(spark, sf_dir):
    return signature_rows(docs(spark, sf_dir), "doc_id")


@query(f"WITH {_SIGNATURE}, c AS (SELECT cluster, count(*) AS n FROM sig GROUP BY cluster) SELECT CAST(count(*) AS BIGINT) AS n_clusters, CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most, round(avg(n), 6) AS mean FROM c")
def cluster_sizes(spark, sf_dir):
    n = signature_rows(docs(spark, sf_dir), "doc_id").groupBy("cluster").count()
    return n.agg(F.count("*").alias("n_clusters"), F.min("count").alias("least"), F.max("count").alias("most"), F.round(F.avg("count"), 6).alias("mean"))


def budgeted(rows: list[tuple], spent: int, limit: float, until: float = float("inf"), room: dict | None = None) -> tuple[list, int]:
    """Ids of (id, cluster, tokens) taken in order while less than `until` is spent: those that keep within the limit, and have
    room in their cluster; and what is spent then."""
    ids = []
    for key, cluster, tokens in rows:
        if spent >= until:
            break
        if spent + tokens <= limit and (room is None or room[cluster] > 0):
            ids.append(key)
            spent += tokens
            if room is not None:
                room[cluster] -= 1
    return ids, spent


def select_diverse(rows: list[tuple], budget: int, least: int = 2) -> list:
    """Ids of (id, cluster, tokens, quality), in order: first the best `least` of each cluster that fit the budget, clusters as first
    seen; then the best of the rest until it is met, 5 % over it at most, no cluster above twice its fair share (ten at least)."""
    place = {c: k for k, c in enumerate(dict.fromkeys(r[1] for r in rows))}
    rank = Counter()
    seeds, rest = [], []
    for key, cluster, tokens, quality in sorted(rows, key=lambda r: -r[3]):  # equal ones stay in order
        (seeds if rank[cluster] < least else rest).append((key, cluster, tokens))
        rank[cluster] += 1
    seeds.sort(key=lambda r: place[r[1]])
    first, spent = budgeted(seeds, 0, budget)
    cap = max(10, len(rows) // max(1, len(place)) * 2)
    room = Counter({c: cap for c in place})
    room.subtract(cluster for key, cluster, _ in seeds if key in set(first))
    return first + budgeted(rest, spent, budget * 1.05, budget, room)[0]


@query()
def diverse_selection(spark, sf_dir):
    """Documents of each source chosen for quality and diversity within 20000 tokens; only ids, clusters, tokens and scores
    come together in a task."""
    d = docs(spark, sf_dir)
    scored = score_columns(d).select("doc_id", "source", T.estimate_tokens(T.count_words(F.col("text"))).alias("tokens"), "quality")
    rows = scored.join(signature_rows(d, "doc_id"), "doc_id").select("source", "doc_id", "cluster", "tokens", "quality")

    def run(group: pa.Table) -> pa.Table:
        g = group.sort_by("doc_id")
        keep = select_diverse(list(zip(*(g.column(c).to_pylist() for c in ("doc_id", "cluster", "tokens", "quality")))), 20_000)
        return g.filter(pa.array(np.isin(g.column("doc_id").to_numpy(), keep)))

    return rows.groupBy("source").applyInArrow(run, rows.schema)


def sample_clusters(rows: list[tuple[int, int, int]], target: int) -> list[int]:
    """Ids of (id, cluster, words): of each cluster, the largest first, the longest texts up to its share of the target by
    members; a text that goes over 1.1 times the target is left out. With less than 0.9 of it, the longest ones of the rest."""
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    taken, total = [], 0
    for c in sorted(by, key=lambda c: (-len(by[c]), c)):
        share, own = target * len(by[c]) // len(rows), 0
        for r in sorted(by[c], key=lambda r: (-r[2], r[0])):
            if own >= share:
                break
            if total + r[2] <= target * 1.1:
                taken.append(r[0])
                own += r[2]
                total += r[2]
        if total >= target:
            break
    if total < target * 0.9:
        had = set(taken)
        for r in sorted((r for r in rows if r[0] not in had), key=lambda r: (-r[2], r[0])):
            if total >= target:
                break
            taken.append(r[0])
            total += r[2]
    return taken


def clustered_sample(rows: DataFrame, target: int) -> DataFrame:
    """vec_id, cluster of (vec_id, embedding, words): k-means clusters in number by target and rows, sampled as
    `sample_clusters` does; only ids, clusters and words come together in a task."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = rows.select("vec_id", "words", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    k = min(max(10, target // 10_000), rows.count() // 5, 100)
    if k > 1:
        model = KMeans(k=k, seed=42, featuresCol="v", predictionCol="cluster").fit(rows)
        rows = model.transform(rows).select("vec_id", "cluster", "words")
    else:
        rows = rows.select("vec_id", F.lit(0).alias("cluster"), "words")

    def run(group: pa.Table) -> pa.Table:
        keep = sample_clusters(list(zip(*(group.column(c).to_pylist() for c in ("vec_id", "cluster", "words")))), target)
        return group.select(["vec_id", "cluster"]).filter(pa.array(np.isin(group.column("vec_id").to_numpy(), keep)))

    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "vec_id long, cluster int")


@query()
def kmeans_sample(spark, sf_dir):
    """Vectors sampled by k-means for 692,307 words (900,000 tokens); a vector's words are those of the document of its id,
    and vectors without one have none to give."""
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), T.count_words(F.col("text")).cast("long").alias("words"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return clustered_sample(rows.join(words, "vec_id"), 692_307)


# -- vectors -----------------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-8)


def similar_pairs(rows: DataFrame, least: float, block: int = 1024) -> DataFrame:
    """(i, j, sim) of (id, embedding) with i < j and sim > least: blocks against blocks, so a task holds two of them, and only
    similar pairs leave it."""
    n = max(1, -(-rows.count() // block))
    own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    rows = rows.select("id", "embedding", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other"))
    rows = rows.select("id", "embedding", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        a, b = (k.as_py() for k in key)
        ids, own = group.column("id").to_numpy(), group.column("own").to_numpy()
        v = np.array(group.column("embedding").to_pylist(), np.float64).reshape(len(ids), -1)
        left, right = own == a, own == b
        unit = v / (np.sqrt((v * v).sum(axis=1, keepdims=True)) + 1e-12)
        sim = unit[left] @ unit[right].T
        x, y = np.nonzero(sim > least)
        i, j = ids[left][x], ids[right][y]
        keep = (i < j) if a == b else np.ones(len(i), bool)
        return pa.table({"i": np.minimum(i, j)[keep], "j": np.maximum(i, j)[keep], "sim": sim[x, y][keep]})

    return rows.groupBy("a", "b").applyInArrow(run, "i long, j long, sim double")


@query("SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.4")
def near_duplicate_edges(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return similar_pairs(rows, 0.4).select("i", "j", F.round("sim", 6).alias("sim"))


def dropped(edges: list[tuple[int, int]], size: dict[int, int]) -> set[int]:
    """Ids that a pass over the pairs, in order, removes: the shorter of two, the later of equals; a removed one removes nothing."""
    gone: set[int] = set()
    for i, j in sorted(edges):
        if i not in gone and j not in gone:
            gone.add(i if size[j] > size[i] else j)
    return gone


@query()
def greedy_dedup(spark, sf_dir):
    """Vectors left after the greedy pass within each connected group of similar pairs; labels stand for lengths."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    pairs = similar_pairs(rows.select("id", "embedding"), 0.4)
    size = rows.select("id", "label")
    pairs = pairs.join(size.withColumnsRenamed({"id": "i", "label": "li"}), "i").join(size.withColumnsRenamed({"id": "j", "label": "lj"}), "j")

    def run(group: pa.Table) -> pa.Table:
        g = group.to_pylist()
        gone = dropped([(r["i"], r["j"]) for r in g], {r["i"]: r["li"] for r in g} | {r["j"]: r["lj"] for r in g})
        return pa.table({"id": pa.array(sorted(gone), pa.int64())})

    gone = pairs.groupBy(F.lit(0).alias("g")).applyInArrow(run, "id long")  # the order of the pass is global; ids and labels of pairs only
    return size.join(gone, "id", "left_anti").select(F.col("id").alias("vec_id"))


_CENTROID = "c AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(generate_series(0, len(embedding) - 1)) AS pos FROM embeddings) GROUP BY label, pos)"


def centroids(rows: DataFrame, by: str) -> DataFrame:
    """by, centroid: the mean vector, summed place by place where the rows are."""
    means = rows.select(by, F.posexplode("embedding").alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


@query(f"WITH {_CENTROID} SELECT CAST(label AS INTEGER) AS label, CAST(pos AS INTEGER) AS pos, round(m, 6) AS mean FROM c")
def author_centroids(spark, sf_dir):
    c = centroids(table(spark, sf_dir, "embeddings"), "label")
    return c.select("label", F.posexplode("centroid").alias("pos", "mean")).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {_CENTROID}, v AS (SELECT list(m ORDER BY pos) AS centre FROM c WHERE label = 0),
  s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], centre) AS sim FROM embeddings, v WHERE label <> 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(sim, 9) DESC, vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM s)
SELECT vec_id, CAST(label AS INTEGER) AS label, round(sim, 5) AS sim FROM r WHERE r <= greatest(10, n * 20 // 100) AND sim > 0""")
def blend_step(spark, sf_dir):
    """Of each secondary label the fifth of vectors (ten at least) most like the centroid of label 0."""
    rows = table(spark, sf_dir, "embeddings")
    centre = centroids(rows.where("label = 0"), "label").select("centroid")  # one row
    s = rows.where("label <> 0").crossJoin(F.broadcast(centre)).select("vec_id", "label", cosine(F.col("embedding"), F.col("centroid")).alias("sim"))
    w = Window.partitionBy("label")
    s = s.withColumns({"r": F.row_number().over(w.orderBy(F.round("sim", 9).desc(), "vec_id")), "n": F.count("*").over(w)})
    return s.where((F.col("r") <= F.greatest(F.lit(10), F.expr("n * 20 div 100"))) & (F.col("sim") > 0)).select("vec_id", "label", F.round("sim", 5).alias("sim"))


_KNN = """SELECT q.vec_id AS query_id, b.vec_id, round(list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2, 5) AS distance,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2, 9), b.vec_id) AS r
FROM embeddings q JOIN embeddings b ON q.label = b.label AND q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0"""


def query_blocks(queries: DataFrame, block_bytes: int):
    """Queries (id, label, vector) in blocks of bounded size, streamed to the driver one partition at a time."""
    held, size = [], 0
    for r in queries.select("vec_id", "label", "embedding").toLocalIterator():
        held.append(r)
        size += 8 * len(r.embedding)
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def nearest(rows: DataFrame, queries: DataFrame, n: int, block_bytes: int = 16 << 20) -> DataFrame:
    """The n nearest rows of the same label for each query, by squared distance to nine places, ids breaking ties.

    A block of queries is broadcast, and a scan of the rows keeps the best n of a query in each batch, so what is exchanged
    is n rows a query and batch, however many rows a label has. More queries cost more scans."""
    context, schema, found = rows.sparkSession.sparkContext, "query_id long, vec_id long, label int, distance double", None
    best = F.struct(F.round("distance", 9).alias("d"), "vec_id", "label", "distance")
    for block in query_blocks(queries, block_bytes):
        ids, labels = np.array([r.vec_id for r in block]), np.array([r.label for r in block])
        held = context.broadcast((ids, labels, np.array([r.embedding for r in block], np.float64)))

        def run(batches, held=held):
            ids, labels, vectors = held.value
            for batch in batches:
                own, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
                v = np.array(batch.column(2).to_pylist(), np.float64)
                for label in np.unique(kind):
                    at, q = np.flatnonzero(kind == label), np.flatnonzero(labels == label)
                    for k in q:
                        d = ((v[at] - vectors[k]) ** 2).sum(axis=1)
                        d[own[at] == ids[k]] = np.inf
                        near = np.lexsort((own[at], np.round(d, 9)))[:n]
                        near = near[np.isfinite(d[near])]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), ids[k])), pa.array(own[at][near]), pa.array(np.full(len(near), label, np.int32)), pa.array(d[near])], ["query_id", "vec_id", "label", "distance"])

        part = rows.select("vec_id", F.col("label").cast("int").alias("label"), "embedding").mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.sparkSession.createDataFrame([], f"{schema}, r int")
    top = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(best)), 1, n).alias("top"))  # n rows of each batch
    return top.select("query_id", F.posexplode("top").alias("r", "b")).select("query_id", "b.vec_id", "b.label", "b.distance", (F.col("r") + 1).alias("r"))


@query(f"SELECT query_id, vec_id, distance FROM ({_KNN}) WHERE r <= 5")
def knn_retrieval(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 50 = 0"), 5).select("query_id", "vec_id", F.round("distance", 5).alias("distance"))


@query(f"SELECT query_id, vec_id FROM ({_KNN}) WHERE r = 1")
def graft_top1(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 50 = 0"), 1).select("query_id", "vec_id")


@query("""SELECT vec_id, CAST(label AS INTEGER) AS label FROM embeddings WHERE label <> 3 AND vec_id % 10 <> 0
UNION ALL SELECT vec_id, CAST(label + 100 AS INTEGER) FROM embeddings WHERE label <> 3 AND vec_id % 10 = 0""")
def index_upsert_delete(spark, sf_dir):
    """An index without label 3, after an upsert of every tenth vector with a new label: what is replaced leaves by an anti-join."""
    index = table(spark, sf_dir, "embeddings").where("label <> 3").select("vec_id", "label")
    new = index.where("vec_id % 10 = 0").withColumn("label", (F.col("label") + 100).cast("int"))
    return index.join(new.select("vec_id"), "vec_id", "left_anti").unionByName(new)


@query("SELECT source AS author, CAST(count(*) AS BIGINT) AS n, round(100.0::DOUBLE * count(*) FILTER (contains(text, '!')) / count(*), 6) AS coverage FROM documents GROUP BY source")
def author_catalog(spark, sf_dir):
    """Documents of each author, and the percentage with a mark, here an exclamation."""
    return docs(spark, sf_dir).groupBy(F.col("source").alias("author")).agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.contains("text", F.lit("!"))) / F.count("*"), 6).alias("coverage"))


# -- profiles ----------------------------------------------------------------------------------------------------------


#: First words that join sentences, by kind, and words of certainty, doubt and old times; fixed values.
TRANSITIONS = {
    "additive": "and moreover furthermore also besides additionally plus".split(),
    "adversative": "but yet however nevertheless nonetheless still though although".split(),
    "causal": "thus therefore hence consequently wherefore so accordingly".split(),
    "temporal": "then whereupon thereafter meanwhile subsequently afterward next".split(),
    "exemplifying": "indeed specifically namely particularly especially".split(),
}
CERTAIN = "clearly obviously undeniably surely certainly undoubtedly plainly".split()
DOUBTFUL = "perhaps possibly maybe seemingly apparently arguably conceivably".split()
ARCHAIC = "whereupon whilst heretofore hitherto thereof wherein thereby forthwith henceforth thence whence whereof notwithstanding erstwhile forsooth verily betwixt".split()
_KINDS = [(w, k) for k, ws in TRANSITIONS.items() for w in ws]
_FIRST = f"f AS (SELECT source, lower(regexp_extract(s, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM (SELECT source, unnest({D.sentences('text')}) AS s FROM documents))"


@query(f"""WITH {_FIRST}, k(w, kind) AS (VALUES {', '.join(f"('{w}', '{k}')" for w, k in _KINDS)}),
  c AS (SELECT source, kind, w, count(*) AS n FROM f JOIN k USING (w) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source, kind ORDER BY n DESC, w) AS r FROM c)
SELECT source, kind, w AS word, CAST(n AS BIGINT) AS n FROM r WHERE r <= 5""")
def transition_inventory(spark, sf_dir):
    """The five most frequent joining words of each kind that begin an author's sentences."""
    first = F.lower(F.regexp_extract("s", r"([\p{L}\p{N}_]+)", 1))
    words = docs(spark, sf_dir).select("source", F.explode(T.sentences(F.col("text"))).alias("s")).select("source", first.alias("word"))
    kinds = spark.createDataFrame(_KINDS, "word string, kind string")  # fixed list
    counts = words.join(F.broadcast(kinds), "word").groupBy("source", "kind", "word").agg(F.count("*").alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("source", "kind").orderBy(F.desc("n"), "word"))).where("r <= 5").drop("r")


@query(f"""WITH s AS (SELECT source, doc_id, unnest({D.sentences('text')}) AS s FROM documents), t AS (SELECT *, {D.word_tokens('s')} AS ts FROM s)
SELECT source, CAST(count(*) AS BIGINT) AS n_sentences, round(count(*) FILTER (suffix(s, '?'))::DOUBLE / count(DISTINCT doc_id), 6) AS questions, round(count(*) FILTER (contains(s, '!'))::DOUBLE / count(*), 6) AS exclamations,
       round(sum(len(list_filter(ts, lambda t: list_contains(['you', 'your', 'we', 'our', 'one'], t))))::DOUBLE / count(*), 6) AS address, round(count(*) FILTER (contains(s, '—') OR contains(s, '('))::DOUBLE / count(*), 6) AS asides,
       CAST(sum(len(list_filter(ts, lambda t: list_contains({D.listed(CERTAIN)}, t)))) AS BIGINT) AS certain, CAST(sum(len(list_filter(ts, lambda t: list_contains({D.listed(DOUBTFUL)}, t)))) AS BIGINT) AS doubtful
FROM t GROUP BY source""")
def stance_profile(spark, sf_dir):
    rows = docs(spark, sf_dir).select("source", "doc_id", F.explode(T.sentences(F.col("text"))).alias("s")).withColumn("ts", T.word_tokens(F.col("s")))
    has = lambda ws: F.size(F.filter("ts", lambda t: t.isin(*ws)))
    rate = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    return rows.groupBy("source").agg(
        F.count("*").alias("n_sentences"), F.round(F.count_if(F.endswith("s", F.lit("?"))) / F.count_distinct("doc_id"), 6).alias("questions"), rate(F.contains("s", F.lit("!"))).alias("exclamations"),
        F.round(F.sum(has(("you", "your", "we", "our", "one"))) / F.count("*"), 6).alias("address"), rate(F.contains("s", F.lit("—")) | F.contains("s", F.lit("("))).alias("asides"), F.sum(has(CERTAIN)).alias("certain"), F.sum(has(DOUBTFUL)).alias("doubtful"),
    )


_ALL_LEXICON = [(w, "archaic") for w in ARCHAIC] + [(w, "certain") for w in CERTAIN] + [(w, "doubtful") for w in DOUBTFUL] + [(w, "common") for w in ("the", "of", "and", "que", "der", "le")]


@query(f"""WITH t AS (SELECT source, unnest({D.word_tokens('text')}) AS word FROM documents), k(word, channel) AS (VALUES {', '.join(f"('{w}', '{k}')" for w, k in _ALL_LEXICON)}),
  c AS (SELECT source, channel, word, count(*) AS n FROM t JOIN k USING (word) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source, channel ORDER BY n DESC, word) AS r FROM c)
SELECT source, channel, word, CAST(n AS BIGINT) AS n FROM r WHERE r <= 10""")
def vocabulary_lexicon_topk(spark, sf_dir):
    lexicon = spark.createDataFrame(_ALL_LEXICON, "word string, channel string")  # fixed list
    words = docs(spark, sf_dir).select("source", F.explode(T.word_tokens(F.col("text"))).alias("word"))
    counts = words.join(F.broadcast(lexicon), "word").groupBy("source", "channel", "word").agg(F.count("*").alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("source", "channel").orderBy(F.desc("n"), "word"))).where("r <= 10").drop("r")


_RHYTHM = f"WITH {D.PARAS}, r AS (SELECT doc_id, author, para_idx, {D.lengths('text')} AS ls, {D.count('text', '[;:—–,-]')} AS marks, {D.n_words('text')} AS n FROM paras)"


@query(f"""{_RHYTHM} SELECT doc_id, para_idx, CAST(len(ls) AS BIGINT) AS n_sentences, array_to_string(list_transform(ls, lambda n: {_CATEGORY}), ' → ') AS length_sequence,
  round(({D.std_pop('ls')}) * ({D.std_pop('ls')}), 5) AS length_variance, round({D.mean('ls')}, 6) AS mean_length, round(marks::DOUBLE / greatest(n, 1), 6) AS punctuation_density,
  round(len(list_filter(ls, lambda n: n < 5))::DOUBLE / greatest(len(ls), 1), 6) AS fragment_ratio FROM r""")
def rhythm_fingerprint(spark, sf_dir):
    rows = paras(spark, sf_dir).select("doc_id", "para_idx", "text", T.sentence_lengths(F.col("text")).alias("ls"))
    std, marks = T.std_pop(F.col("ls")), F.regexp_count("text", F.lit("[;:—–,-]"))
    return rows.select(
        "doc_id", "para_idx", F.size("ls").cast("long").alias("n_sentences"), F.array_join(F.transform("ls", scores.length_category), " → ").alias("length_sequence"), F.round(std * std, 5).alias("length_variance"), F.round(T.mean(F.col("ls")), 6).alias("mean_length"),
        F.round(marks / F.greatest(T.count_words(F.col("text")), F.lit(1)), 6).alias("punctuation_density"), F.round(F.size(F.filter("ls", lambda n: n < 5)) / F.greatest(F.size("ls"), F.lit(1)), 6).alias("fragment_ratio"),
    )


@query(f"""{_RHYTHM}, g AS (SELECT author, avg(CAST(list_sum(ls) AS DOUBLE) / len(ls)) AS m, avg(len(list_filter(ls, lambda n: n < 5))::DOUBLE / len(ls)) AS f FROM r GROUP BY author)
SELECT author, round(m, 6) AS mean_length, CASE WHEN f > 0.2::DOUBLE THEN 'frequent' WHEN f > 0.1::DOUBLE THEN 'some' ELSE 'few' END AS fragments FROM g""")
def length_guidance(spark, sf_dir):
    r = paras(spark, sf_dir).select("author", T.sentence_lengths(F.col("text")).alias("ls"))
    g = r.groupBy("author").agg(F.avg(T.mean(F.col("ls"))).alias("m"), F.avg(F.size(F.filter("ls", lambda n: n < 5)) / F.size("ls")).alias("f"))
    return g.select("author", F.round("m", 6).alias("mean_length"), F.when(F.col("f") > 0.2, "frequent").when(F.col("f") > 0.1, "some").otherwise("few").alias("fragments"))


@query(f"""WITH s AS (SELECT doc_id, unnest({D.sentences('text')}) AS s FROM documents), t AS (SELECT doc_id, array_to_string({D.words('lower(s)')}[1:2], ' ') AS starter FROM s WHERE len({D.words('s')}) >= 2)
SELECT doc_id, starter, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY ALL HAVING count(*) >= 2""")
def sentence_starters(spark, sf_dir):
    """Pairs of words that begin two of a document's sentences or more."""
    rows = docs(spark, sf_dir).select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s")).select("doc_id", F.slice(T.words(F.lower("s")), 1, 2).alias("w")).where(F.size("w") == 2)
    return rows.groupBy("doc_id", F.array_join("w", " ").alias("starter")).agg(F.count("*").alias("n")).where("n >= 2")


@query(f"""WITH t AS (SELECT doc_id, unnest(list_filter({D.word_tokens('text')}, lambda w: length(w) >= 4)) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM t GROUP BY ALL HAVING count(*) >= 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS r FROM c) SELECT doc_id, word, CAST(n AS BIGINT) AS n FROM r WHERE r <= 10""")
def overused_words(spark, sf_dir):
    words = F.filter(T.word_tokens(F.col("text")), lambda w: F.char_length(w) >= 4)
    counts = docs(spark, sf_dir).select("doc_id", F.explode(words).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n")).where("n >= 3")
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "word"))).where("r <= 10").drop("r")


# -- pairs of texts ----------------------------------------------------------------------------------------------------


def text_pairs(spark, sf_dir) -> DataFrame:
    """Each document with the text of the next id."""
    d = docs(spark, sf_dir).select("doc_id", "text")
    return d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")


_PAIRS = "p AS (SELECT a.doc_id, a.text, b.text AS other FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"


def _set(x: str) -> str:
    return f"list_distinct({D.words(f'lower({x})')})"


_COMMON = D.listed(gates.COMMON_WORDS)


@query(f"""WITH {_PAIRS}, s AS (SELECT doc_id, list_filter({_set('text')}, lambda w: NOT list_contains({_COMMON}, w)) AS own, {_set('other')} AS theirs FROM p),
  r AS (SELECT doc_id, CASE WHEN len(own) = 0 THEN 0.0 ELSE len(list_intersect(own, theirs))::DOUBLE / len(own) END AS r FROM s)
SELECT doc_id, round(r, 6) AS overlap, r < 0.5 AS ok FROM r""")
def lexical_bleed(spark, sf_dir):
    r = text_pairs(spark, sf_dir).select("doc_id", gates.lexical_bleed(F.col("other"), F.col("text")).alias("r"))
    return r.select("doc_id", F.round("r", 6).alias("overlap"), (F.col("r") < 0.5).alias("ok"))


@query(f"""WITH {_PAIRS}, m AS (SELECT doc_id, {D.n_words('text')} AS n, {D.n_words('other')} AS m, len({D.sentences('text')}) AS a, len({D.sentences('other')}) AS b, coalesce(len(list_intersect({_set('text')}, {_set('other')}))::DOUBLE / nullif(len({_set('text')}), 0), 0) AS kept FROM p)
SELECT doc_id, n > 0 AND abs(n - m) <= 0.2::DOUBLE * n AND abs(a - b) <= 1 AND kept <= 0.85::DOUBLE AS topic_ok, n > 0 AND abs(n - m) <= 0.15::DOUBLE * n AND a = b AS perspective_ok, m >= 0.5::DOUBLE * n AND m <= 3.0::DOUBLE * n AS length_ok FROM m""")
def variation_validation(spark, sf_dir):
    a, b = F.col("text"), F.col("other")
    return text_pairs(spark, sf_dir).select("doc_id", gates.topic_variation_ok(a, b).alias("topic_ok"), gates.perspective_variation_ok(a, b).alias("perspective_ok"), gates.pair_length_ok(a, b).alias("length_ok"))


def pair_profiles(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Each document as a source, and the one with the next id as the output of it."""
    p = verify.profiles(docs(spark, sf_dir))
    return p, p.withColumn("doc_id", F.col("doc_id") - 1)


def _content(x: str) -> str:
    return f"list_distinct(list_filter({D.word_tokens(x)}, lambda w: length(w) >= 4 AND NOT list_contains({_COMMON}, w)))"


_COVER = f"CASE WHEN len({_content('text')}) = 0 THEN 1.0 ELSE len(list_intersect({_content('text')}, {_content('other')}))::DOUBLE / len({_content('text')}) END"


@query(f"WITH {_PAIRS} SELECT doc_id, round({_COVER}, 6) AS coverage FROM p")
def content_coverage(spark, sf_dir):
    words = docs(spark, sf_dir).select("doc_id", verify.content_words(F.col("text")).alias("words"))
    return verify.paired(words, words.withColumn("doc_id", F.col("doc_id") - 1)).select("doc_id", F.round(verify.coverage(F.col("words"), F.col("out_words")), 6).alias("coverage"))


_GROUND = f"""{_PAIRS}, o AS (SELECT doc_id, CAST(unnest(generate_series(0, len(ss) - 1)) AS INTEGER) AS sent_idx, unnest(ss) AS s, aw FROM (SELECT doc_id, {D.sentences('other')} AS ss, {_content('text')} AS aw FROM p)),
  ow AS (SELECT doc_id, sent_idx, {D.n_words('s')} AS n, {_content('s')} AS own, aw FROM o), src AS (SELECT doc_id, src_idx, {_content('s')} AS src FROM (SELECT doc_id, unnest(generate_series(0, len(ss) - 1)) AS src_idx, unnest(ss) AS s FROM (SELECT doc_id, {D.sentences('text')} AS ss FROM p))),
  h AS (SELECT a.doc_id, a.sent_idx, b.src_idx, a.k, b.m, count(*) AS c FROM (SELECT doc_id, sent_idx, len(own) AS k, unnest(own) AS w FROM ow) a JOIN (SELECT doc_id, src_idx, len(src) AS m, unnest(src) AS w FROM src) b ON a.doc_id = b.doc_id AND a.w = b.w GROUP BY ALL),
  b AS (SELECT doc_id, sent_idx, max(2.0::DOUBLE * c / (k + m)) AS best FROM h GROUP BY ALL),
  g AS (SELECT ow.doc_id, ow.sent_idx, coalesce(best, 0) AS best, (n < 4 OR len(own) = 0) AS free, n, (len(own) - len(list_intersect(own, aw)))::DOUBLE / nullif(len(own), 0) AS novelty FROM ow LEFT JOIN b ON b.doc_id = ow.doc_id AND b.sent_idx = ow.sent_idx)"""
_GOOD = "(free OR best >= 0.4::DOUBLE OR novelty < 0.3::DOUBLE)"
_BAD = "(NOT free AND best < 0.15::DOUBLE AND novelty > 0.5::DOUBLE AND n > 8)"


@query(f"WITH {_GROUND} SELECT doc_id, sent_idx, round(best, 6) AS best, round(novelty, 6) AS novelty, {_GOOD} AS grounded, {_BAD} AS hallucinated FROM g")
def grounding_lexical(spark, sf_dir):
    return verify.grounding(*pair_profiles(spark, sf_dir)).withColumns({"best": F.round("best", 6), "novelty": F.round("novelty", 6)})


def _stem(w: str) -> str:
    rules = " ".join(f"WHEN suffix({w}, '{e}') AND length({w}) >= {len(e) + 4} THEN left({w}, length({w}) - {len(e)})" for e in verify.ENDINGS)
    return f"CASE WHEN length({w}) < 4 THEN NULL {rules} ELSE {w} END"


def _stems(xs: str) -> str:
    return f"list_distinct(list_filter(list_transform({xs}, lambda st_: {_stem('st_')}), lambda sn_: sn_ IS NOT NULL))"


def _match(e: str, known: str) -> str:
    return f"(length({e}) >= 4 AND len(list_filter({known}, lambda k_: starts_with(k_, {_stem(e)}) OR starts_with({_stem(e)}, k_))) > 0)"


def _ents(x: str) -> str:
    return f"list_filter(list_distinct(list_transform(regexp_extract_all({x}, '{verify.ENTITY}', 1), lambda e_: lower(e_))), lambda e_: length(e_) > 1)"


def _years_of(x: str) -> str:
    return f"list_distinct(list_filter({D.word_tokens(x)}, lambda w: regexp_full_match(w, '1[89][0-9]{{2}}|20[0-2][0-9]')))"


def _cites(x: str) -> str:
    return rf"list_distinct(regexp_extract_all({x}, '\([^)]*(?:19|20)[0-9]{{2}}[^)]*\)'))"


_ENTITY = f"""{_PAIRS}, x AS (SELECT doc_id, {_ents('text')} AS own, {_ents('other')} AS theirs, {_content('text')} AS ws, {_years_of('text')} AS ys, {_years_of('other')} AS oys, {_cites('text')} AS cs, {_cites('other')} AS ocs FROM p),
  y AS (SELECT *, {_stems('own')} AS own_stems, {_stems('theirs')} AS their_stems, {_stems('ws')} AS all_stems FROM x),
  z AS (SELECT *, list_filter(own, lambda e: list_contains(theirs, e) OR {_match('e', 'their_stems')}) AS covered, CASE WHEN len(own) = 0 THEN all_stems ELSE own_stems END AS known FROM y),
  ent AS (SELECT doc_id, CASE WHEN len(own) = 0 THEN 1.0 ELSE len(covered)::DOUBLE / len(own) END AS ent_coverage, list_sort(list_filter(own, lambda e: NOT list_contains(covered, e))) AS missing,
    list_sort(list_concat(list_concat(list_filter(theirs, lambda e: NOT list_contains(own, e) AND NOT {_match('e', 'known')}), list_transform(list_filter(oys, lambda v: NOT list_contains(ys, v)), lambda v: 'year:' || v)),
      CASE WHEN len(own) = 0 THEN [] ELSE list_transform(list_filter(ocs, lambda v: NOT list_contains(cs, v)), lambda v: 'citation:' || left(v, 30)) END)) AS fabricated FROM z)"""


@query(f"WITH {_ENTITY} SELECT doc_id, round(ent_coverage, 6) AS ent_coverage, array_to_string(missing, '|') AS missing, array_to_string(fabricated, '|') AS fabricated FROM ent")
def entity_fabrication(spark, sf_dir):
    """Entities of a document that the next one lacks, and entities, years and citations that only the next one has."""
    found = verify.entity_check(verify.paired(*pair_profiles(spark, sf_dir)))
    return found.select("doc_id", F.round("ent_coverage", 6).alias("ent_coverage"), F.array_join("missing", "|").alias("missing"), F.array_join("fabricated", "|").alias("fabricated"))


@query(f"""WITH {_GROUND}, v AS (SELECT doc_id, count(*) FILTER ({_GOOD})::DOUBLE / count(*) AS grounded, count(*) FILTER ({_BAD}) AS bad FROM g GROUP BY doc_id), c AS (SELECT doc_id, {_COVER} AS cover FROM p), {_ENTITY.removeprefix(_PAIRS + ', ')},
  s AS (SELECT doc_id, grounded, cover, ent_coverage, bad, len(fabricated) AS made, greatest(0, 0.4::DOUBLE * grounded + 0.3::DOUBLE * cover + 0.3::DOUBLE * ent_coverage - (least(0.5::DOUBLE, 0.15::DOUBLE * bad) + least(0.3::DOUBLE, 0.1::DOUBLE * len(fabricated)))) AS score FROM v JOIN c USING (doc_id) JOIN ent USING (doc_id))
SELECT doc_id, round(grounded, 6) AS grounded, round(cover, 6) AS content, round(ent_coverage, 6) AS entities, CAST(bad AS BIGINT) AS hallucinated, CAST(made AS BIGINT) AS fabricated, round(score, 6) AS score, score >= 0.7::DOUBLE AS valid FROM s""")
def verification_score(spark, sf_dir):
    source, output = pair_profiles(spark, sf_dir)
    g = verify.grounding(source, output).groupBy("doc_id").agg((F.count_if("grounded") / F.count("*")).alias("grounded"), F.count_if("hallucinated").alias("hallucinated"))
    e = verify.entity_check(verify.paired(source, output)).select("doc_id", verify.coverage(F.col("words"), F.col("out_words")).alias("content"), "ent_coverage", F.size("fabricated").cast("long").alias("fabricated"))
    s = g.join(e, "doc_id")
    s = s.withColumn("score", scores.overall_score(F.col("grounded"), F.col("content"), F.col("ent_coverage"), F.col("hallucinated"), F.col("fabricated")))
    return s.select("doc_id", F.round("grounded", 6).alias("grounded"), F.round("content", 6).alias("content"), F.round("ent_coverage", 6).alias("entities"), "hallucinated", "fabricated", F.round("score", 6).alias("score"), (F.col("score") >= 0.7).alias("valid"))


_YEARS = "list_filter(regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '1[89][0-9]{2}|20[0-2][0-9]'))"
_NEW = f"(SELECT doc_id, list_distinct({_YEARS.replace('(t)', '(other)')}) AS theirs, list_distinct({_YEARS.replace('(t)', '(text)')}) AS own FROM p)"


@query(f"WITH {_PAIRS} SELECT doc_id, CAST(len(list_filter(theirs, lambda y: NOT list_contains(own, y))) AS BIGINT) AS n_new_years FROM {_NEW}")
def year_citation_fabrication(spark, sf_dir):
    """Years that the next document names and this one doesn't."""
    return text_pairs(spark, sf_dir).select("doc_id", F.size(F.array_except(T.years(F.col("other")), T.years(F.col("text")))).cast("long").alias("n_new_years"))


@query(f"""WITH {D.PARAS}, k AS (SELECT *, lower(substr(text, 1, 50)) AS head FROM paras), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, head ORDER BY length(text) DESC, para_idx) AS r, min(para_idx) OVER (PARTITION BY doc_id, head) AS place FROM k)
SELECT doc_id, CAST(place AS INTEGER) AS para_idx, text FROM r WHERE r = 1""")
def paragraph_dedup_prefix(spark, sf_dir):
    """Of a document's paragraphs with the same first 50 characters the longest, at the first one's place."""
    w = Window.partitionBy("doc_id", F.lower(F.left("text", F.lit(50))))
    rows = paras(spark, sf_dir).withColumns({"r": F.row_number().over(w.orderBy(F.char_length("text").desc(), "para_idx")), "place": F.min("para_idx").over(w)})
    return rows.where("r = 1").select("doc_id", F.col("place").alias("para_idx"), "text")


@query(f"""WITH {D.PARAS}, s AS (SELECT doc_id, para_idx, CAST(unnest(generate_series(0, len(ss) - 1)) AS INTEGER) AS sent_idx, unnest(ss) AS text FROM (SELECT doc_id, para_idx, {D.sentences('text')} AS ss FROM paras))
SELECT doc_id, para_idx, sent_idx, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, para_idx, lower(text) ORDER BY sent_idx) AS r FROM s) WHERE r = 1""")
def sentence_dedup(spark, sf_dir):
    rows = paras(spark, sf_dir).select("doc_id", "para_idx", F.posexplode(T.sentences(F.col("text"))).alias("sent_idx", "text"))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "para_idx", F.lower("text")).orderBy("sent_idx"))).where("r = 1").drop("r")


# -- training sets -----------------------------------------------------------------------------------------------------


@query("SELECT conv_id, max_by(text, turn) FILTER (role = 'user') AS user_text, max_by(text, turn) FILTER (role = 'assistant') AS assistant_text FROM conversations GROUP BY conv_id")
def message_pivot(spark, sf_dir):
    """The last message of user and assistant."""
    c = table(spark, sf_dir, "conversations")
    last = lambda role: F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    return c.groupBy("conv_id").agg(last("user").alias("user_text"), last("assistant").alias("assistant_text"))


@query("""SELECT conv_id, 'Rewrite the following neutral text into the style of J. Author.' || chr(10) || chr(10) || '[NEUTRAL INPUT]: ' || u || chr(10) || chr(10) || '[J_AUTHOR OUTPUT]: ' || a AS text
FROM (SELECT conv_id, max_by(text, turn) FILTER (role = 'user') AS u, max_by(text, turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id) WHERE u IS NOT NULL AND a IS NOT NULL""")
def base_format_convert(spark, sf_dir):
    rows = message_pivot(spark, sf_dir).where("user_text is not null and assistant_text is not null")
    author = F.lit("J. Author")
    return rows.select("conv_id", F.concat(F.lit("Rewrite the following neutral text into the style of "), author, F.lit(".\n\n[NEUTRAL INPUT]: "), "user_text", F.lit("\n\n["), T.author_tag(author), F.lit(" OUTPUT]: "), "assistant_text").alias("text"))


PERSPECTIVES = ("first_person_singular", "first_person_plural", "third_person")


@query(f"SELECT doc_id, unnest({D.listed(('original', 'robustness', *PERSPECTIVES))}) AS variation_type, {D.n_words('text')} AS n_words FROM documents")
def variation_expansion(spark, sf_dir):
    """A row for the original, the robustness copy and each perspective of a document."""
    kinds = F.array(*map(F.lit, ("original", "robustness", *PERSPECTIVES)))
    return docs(spark, sf_dir).select("doc_id", F.explode(kinds).alias("variation_type"), T.count_words(F.col("text")).alias("n_words"))


@query("SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE d.doc_id % 2 = 0")
def noise_even_indices(spark, sf_dir):
    """Even documents that have an anchor, here a label."""
    return docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").where("doc_id % 2 = 0")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_anti_join(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


_U = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(f"""SELECT doc_id, ['essay', 'story', 'note'][CAST(floor({_U.format("'frame:' || doc_id")} * 3) AS BIGINT) + 1] AS frame, {_U.format("'skeleton:' || doc_id")} < 0.5 AS with_skeleton, {_U.format("'constraint:' || doc_id")} < 0.7 AS with_constraint,
  'Write a ' || ['essay', 'story', 'note'][CAST(floor({_U.format("'frame:' || doc_id")} * 3) AS BIGINT) + 1] || ' of about ' || {D.n_words('text')} || ' words.' AS prompt FROM documents""")
def persona_prompt(spark, sf_dir):
    """A frame and optional parts drawn from digests, and the prompt they make."""
    key = F.col("doc_id").cast("string")
    frame = F.element_at(F.array(*map(F.lit, ("essay", "story", "note"))), (F.floor(T.portable_uniform(F.lit("frame"), key) * 3) + 1).cast("int"))
    return docs(spark, sf_dir).select("doc_id", frame.alias("frame"), (T.portable_uniform(F.lit("skeleton"), key) < 0.5).alias("with_skeleton"), (T.portable_uniform(F.lit("constraint"), key) < 0.7).alias("with_constraint"), F.concat(F.lit("Write a "), frame, F.lit(" of about "), T.count_words(F.col("text")).cast("string"), F.lit(" words.")).alias("prompt"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('split:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r <= n * 8 // 10 THEN 'train' WHEN r <= n * 8 // 10 + n // 10 THEN 'valid' ELSE 'test' END AS split FROM r""")
def merge_split(spark, sf_dir):
    """Exactly 80, 10 and 10 % in an order of digests: ranks are sums over ranges of digests, so no task sees all rows."""
    rows = docs(spark, sf_dir).select("doc_id", F.md5(F.concat(F.lit("split:"), F.col("doc_id").cast("string"))).alias("h")).withColumn("b", F.substring("h", 1, 2))
    sizes = rows.groupBy("b").count()  # 256 rows
    sizes = sizes.withColumns({"before": F.sum("count").over(Window.orderBy("b")) - F.col("count"), "n": F.sum("count").over(Window.partitionBy())})
    rank = F.row_number().over(Window.partitionBy("b").orderBy("h", "doc_id"))
    rows = rows.withColumn("r", rank).join(F.broadcast(sizes.select("b", "before", "n")), "b").withColumn("r", F.col("r") + F.col("before"))
    train, valid = F.expr("n * 8 div 10"), F.expr("n * 8 div 10 + n div 10")
    return rows.select("doc_id", F.when(F.col("r") <= train, "train").when(F.col("r") <= valid, "valid").otherwise("test").alias("split"))


def _rewritten(name: str, f, doc: str):
    def run(spark, sf_dir):
        return docs(spark, sf_dir).select("doc_id", folds.text_udf(f)("text").alias("text"))

    run.__name__, run.__doc__ = name, doc
    query()(run)


def _perturbed(name: str, heavy: bool, doc: str):
    def run(spark, sf_dir):
        return docs(spark, sf_dir).select("doc_id", folds.keyed_udf(lambda t, k: folds.perturbed(t, k, heavy))("text", F.col("doc_id").cast("string")).alias("text"))

    run.__name__, run.__doc__ = name, doc
    query()(run)


_perturbed("perturb_light", False, "About 8 % of the words changed, and some adjectives dropped.")
_perturbed("perturb_heavy", True, "About 15 % of the words changed.")
_rewritten("entity_mask", lambda t: folds.masked_names(t)[0], "Names replaced by numbered marks.")
_rewritten("monotone_flatten", folds.flattened, "Texts as short, even sentences.")
_rewritten("sentence_splitter", lambda t: folds.split_long(t)[0], "Long sentences cut at conjunctions.")


@query()
def input_variants(spark, sf_dir):
    """The inputs of a training example: as it is, and, if they have ten words, without modifiers and with concrete nouns abstracted."""
    d = docs(spark, sf_dir).select("doc_id", "text", providers.provided("annotate", "rules", F.col("text")).alias("t"))
    kind = lambda name, text: F.struct(F.lit(name).alias("kind"), text.alias("text"))
    more = F.array(kind("info_dropout", training.without_modifiers(F.col("t"))), kind("abstract", training.abstracted(F.col("t"))))
    return d.select("doc_id", F.inline(F.concat(F.array(kind("standard", F.col("text"))), F.filter(more, lambda v: T.count_words(v["text"]) >= 10))))


@query("""WITH l AS (SELECT doc_id, CAST(unnest(generate_series(0, len(ls) - 1)) AS BIGINT) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split('[1] ' || replace(text, chr(10), chr(10) || '[2] '), chr(10)) AS ls FROM documents)),
  m AS (SELECT *, CAST(nullif(regexp_extract(line, '^\\[?(\\d+)\\]?\\s*(.*)$', 1), '') AS BIGINT) AS num, regexp_extract(line, '^\\[?(\\d+)\\]?\\s*(.*)$', 2) AS body FROM l),
  g AS (SELECT *, last_value(num IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS idx FROM m)
SELECT doc_id, idx, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(length(body)) AS BIGINT) AS n_chars FROM g WHERE idx IS NOT NULL GROUP BY ALL""")
def numbered_response_parse(spark, sf_dir):
    """Lines that begin with a number open that item of an answer, lines after it belong to it."""
    marked = F.split(F.concat(F.lit("[1] "), F.regexp_replace("text", "\n", "\n[2] ")), "\n")
    rule = r"^\[?(\d+)\]?\s*(.*)$"
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(marked).alias("line_no", "line"))
    rows = rows.withColumns({"num": F.nullif(F.regexp_extract("line", rule, 1), F.lit("")).cast("long"), "body": F.regexp_extract("line", rule, 2)})
    idx = F.last("num", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("idx", idx).where("idx is not null").groupBy("doc_id", "idx").agg(F.count("*").alias("n_lines"), F.sum(F.char_length("body")).alias("n_chars"))
