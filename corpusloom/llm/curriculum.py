"""Mixing sources to target weights along a time-varying curriculum.

Targets: the words of all documents are shared out by the sources' weights; no source gives more than `max_repeats` times
its words, and the excess is shared out again among the rest. Within a source, documents stand in the order of a digest of
their ids and are taken round after round until the target is met; the last one is taken in part.

Order: a source's weight runs linearly over training time t in [0, 1], from 1 - slope to 1 + slope times its mean, so the
share of its words that training has used by t is the integral (1 - slope) t + slope t^2. A reading that begins at share q
of its source's words is due at the t that the inverse gives for q; by then training has used the sum of all sources'
integrals, which is the reading's position, in words. Every reading has a position, and rows are range-sorted by the first.

Defined cases: a null text has no words; null is a source of its own, the last; documents are kept as they are, repeated or
with null ids; a document of no words is taken 0 words and has no place; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import FILE_DOCUMENTS, gathered, stored, table, text_of

WORD = r"[^\x20\x09-\x0D]+"
#: Digest buckets of a source: its rows are ordered within a bucket, and buckets by their sums. A task holds one bucket.
BUCKET_DIGITS = 3


def source_targets(sizes: DataFrame, max_repeats: int = 3) -> DataFrame:
    """source, source_size, weight, target from (source, size): weights 1, 2, 3, repeating, by source, null last.

    One row a source is ordered in one task; what the loop collects is two sums.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    own = stored(gathered(total.select("source", "source_size", ((rank - 1) % 3 + 1).cast("long").alias("weight")), 1), "source_weights")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    rest, weights, n = own.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0)), F.count("*")).first()
    total_size, capped = rest, 0
    while n:
        full = exact("weight") * F.lit(rest).cast("decimal(19,0)") > exact("source_size") * F.lit(max_repeats * weights).cast("decimal(19,0)")
        size, weight, k = own.agg(F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(full, F.col("weight"))), F.lit(0)), F.count_if(full)).first()
        if k == capped:
            break
        # a source once full stays so: with less left for each unit of weight, the share of the others only grows
        capped, all_weights = k, own.agg(F.sum("weight")).first()[0]
        rest, weights = total_size - max_repeats * size, all_weights - weight
        if weights == 0:
            break
    if not n or weights == 0:
        target = F.lit(float(max_repeats)) * F.col("source_size")
    else:
        full = exact("weight") * F.lit(rest).cast("decimal(19,0)") > exact("source_size") * F.lit(max_repeats * weights).cast("decimal(19,0)")
        target = F.when(full, (F.col("source_size") * max_repeats).cast("double")).otherwise((F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(weights)))
    return own.withColumn("target", target)


def due(share: Column, slope: Column) -> Column:
    """The t in [0, 1] at which (1 - slope) t + slope t^2 is the share."""
    a = F.lit(1.0) - slope
    return F.when(slope == 0, share).otherwise((F.sqrt(a * a + 4 * slope * share) - a) / (2 * slope))


def mixed(docs: DataFrame, slopes: tuple[float, float, float] = (-0.5, 0.0, 0.5), max_repeats: int = 3, id_column: str = "doc_id", seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, positions: one row a document. Only sizes are shuffled, no texts.

    slopes: of the sources of weight 1, 2 and 3. positions: of each reading of the document, in words of the whole training
    before it; empty for one that isn't taken. Whole words of the targets are what training uses.
    """
    size = F.regexp_count(text_of(docs), F.lit(WORD)).cast("long")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("null"))))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), digest.alias("digest"))
    rows = stored(gathered(rows, docs.count() // FILE_DOCUMENTS), "mix_sizes")
    targets = source_targets(rows, max_repeats)
    used = {r[0]: r[1] for r in targets.groupBy("weight").agg(F.sum(F.floor("target").cast("long"))).collect()}  # three sums
    total, bend = float(sum(used.values())), float(sum(slopes[k - 1] * n for k, n in sorted(used.items())))
    key = F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("source")))
    rows = rows.withColumns({"key": key, "bucket": F.substring("digest", 1, BUCKET_DIGITS)})
    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = F.sum("bucket_size").over(Window.partitionBy("key").orderBy("bucket")) - F.col("bucket_size")
    sums = sums.select("key", "bucket", before.alias("bucket_before"))
    sums = sums.join(targets.select(key.alias("key"), "source_size", "weight", "target"), "key")
    within = Window.partitionBy("key", "bucket").orderBy("digest", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, ["key", "bucket"])
    begins = F.col("bucket_before") + F.col("within")
    wanted = F.floor("target").cast("long")
    rounds_ = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    left = wanted - rounds_ * F.col("source_size")
    taken = rounds_ * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left - begins))
    slope = F.element_at(F.array(*map(F.lit, slopes)), F.col("weight").cast("int"))
    rows = rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), begins.alias("begins"), slope.alias("slope"))

    def position(round_: Column) -> Column:
        t = due((round_ * F.col("source_size") + F.col("begins")) / F.col("target"), F.col("slope"))
        return F.floor(F.lit(total) * t + F.lit(bend) * (t * t - t)).cast("long")

    n = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    positions = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), position)).otherwise(F.array().cast("array<bigint>"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", positions.alias("positions"))


def rounds(mix: DataFrame) -> DataFrame:
    """The training sequence: one row for each reading, doc_id, source, round, words, position, range-sorted by position."""
    each = mix.select("*", F.posexplode("positions").alias("round", "position"))
    words = F.least(F.col("size"), F.col("taken") - F.col("round") * F.col("size"))
    return each.select("doc_id", "source", "round", words.alias("words"), "position").orderBy("position", "doc_id", "round")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`mixed`; positions as text, joined by commas, and rows in the order of the first reading, those not taken first."""
    first = F.try_element_at("positions", F.lit(1))
    mix = mixed(table(spark, sf_dir, "documents")).withColumn("position", first)
    return mix.withColumn("positions", F.concat_ws(",", F.col("positions").cast("array<string>"))).drop("source").orderBy("position", "doc_id")


OP9_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digest
  FROM documents
), own AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight
  FROM sized GROUP BY source
), step(k, rest, weights, capped) AS (
  SELECT 0, CAST((SELECT sum(source_size) FROM own) AS BIGINT), CAST((SELECT sum(weight) FROM own) AS BIGINT), CAST(-1 AS BIGINT)
  UNION ALL
  SELECT s.k + 1,
         CAST((SELECT sum(source_size) FROM own) - 3 * coalesce((SELECT sum(source_size) FROM own o WHERE o.weight::HUGEINT * s.rest > 3 * o.source_size::HUGEINT * s.weights), 0) AS BIGINT),
         CAST((SELECT sum(weight) FROM own) - coalesce((SELECT sum(weight) FROM own o WHERE o.weight::HUGEINT * s.rest > 3 * o.source_size::HUGEINT * s.weights), 0) AS BIGINT),
         CAST((SELECT count(*) FROM own o WHERE o.weight::HUGEINT * s.rest > 3 * o.source_size::HUGEINT * s.weights) AS BIGINT)
  FROM step s
  WHERE s.weights > 0 AND s.k < 100
    AND (SELECT count(*) FROM own o WHERE o.weight::HUGEINT * s.rest > 3 * o.source_size::HUGEINT * s.weights) <> greatest(s.capped, 0)
), final AS (SELECT rest, weights FROM step ORDER BY k DESC LIMIT 1),
targets AS (
  SELECT o.*, CASE WHEN f.weights = 0 OR o.weight::HUGEINT * f.rest > 3 * o.source_size::HUGEINT * f.weights
                   THEN CAST(3 * o.source_size AS DOUBLE) ELSE CAST(o.weight * f.rest AS DOUBLE) / CAST(f.weights AS DOUBLE) END AS target,
         CASE o.weight WHEN 1 THEN -0.5::DOUBLE WHEN 2 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS slope
  FROM own o, final f
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.slope, CAST(floor(t.target) AS BIGINT) AS wanted,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS BIGINT) AS begins
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), took AS (
  SELECT *, CASE WHEN source_size > 0 THEN wanted // source_size ELSE 0 END AS rounds FROM placed
), done AS (
  SELECT *, CAST(rounds * size + greatest(0, least(size, wanted - rounds * source_size - begins)) AS BIGINT) AS taken FROM took
), used AS (
  SELECT CAST(sum(floor(target)) AS DOUBLE) AS total, CAST(sum(slope * floor(target)) AS DOUBLE) AS bend
  FROM (SELECT *, CASE weight WHEN 1 THEN -0.5::DOUBLE WHEN 2 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS slope FROM targets)
), readings AS (
  SELECT d.*, CASE WHEN size > 0 THEN CAST(ceil(taken / size) AS BIGINT) ELSE 0 END AS n FROM done d
), shared AS (
  SELECT r.*, list_transform(range(n), lambda k: (k * source_size + begins) / target) AS shares FROM readings r
), dues AS (
  SELECT s.*, list_transform(shares, lambda q: CASE WHEN slope = 0 THEN q ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * q) - (1 - slope)) / (2 * slope) END) AS times FROM shared s
), positioned AS (
  SELECT d.*, list_transform(times, lambda t: CAST(floor(u.total * t + u.bend * (t * t - t)) AS BIGINT)) AS places FROM dues d, used u
)
SELECT doc_id, size, source_size, target, taken, places[1] AS position, coalesce(array_to_string(places, ','), '') AS positions
FROM positioned
"""
