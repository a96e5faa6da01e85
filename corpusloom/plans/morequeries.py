"""Queries over lookups, rendering, splits, statistics and the step-by-step blend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import providers
from corpusloom.functions import text as T
from corpusloom.operators import folds, scores, verify

from . import duck as D
from .corpusqueries import _RHYTHM, _stem, centroids, cosine, table
from .textqueries import docs, paras

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


@query(f"SELECT doc_id, {D.n_words('text')} AS n_words, CAST(greatest(150, floor({D.n_words('text')} * 2.5::DOUBLE)) AS BIGINT) AS styled, CAST(greatest(100, floor({D.n_words('text')} * 2 * 1.3::DOUBLE)) AS BIGINT) AS generated, CAST(least({D.n_words('text')} * 2, 512) AS BIGINT) AS neutral FROM documents")
def token_budgets(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", T.count_words(F.col("text")).alias("n_words"))
    return d.select("doc_id", "n_words", *(c.alias(n) for n, c in scores.generation_budgets(F.col("n_words")).items()))


@query(f"""WITH p AS (SELECT a.source, {D.n_words('a.text')} AS n, {D.n_words('b.text')} AS m FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT source, CAST(count(*) AS BIGINT) AS n_pairs, round(avg(m::DOUBLE / nullif(n, 0)), 6) AS mean_ratio, CAST(count(*) FILTER (m > 2.5::DOUBLE * n) AS BIGINT) AS n_expanded FROM p GROUP BY source""")
def expansion_ratios(spark, sf_dir):
    """Words of the next document over a document's own, by source, and how many pairs grow over 2.5 times."""
    d = docs(spark, sf_dir).select("doc_id", "source", T.count_words(F.col("text")).alias("n"))
    p = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("n").alias("m")), "doc_id")
    return p.groupBy("source").agg(F.count("*").alias("n_pairs"), F.round(F.avg(F.try_divide(F.col("m"), F.col("n"))), 6).alias("mean_ratio"), F.count_if(F.col("m") > 2.5 * F.col("n")).alias("n_expanded"))


@query(f"""WITH {D.PARAS} SELECT doc_id, CAST(count(*) AS BIGINT) AS n_paragraphs, CAST(sum({D.n_words('text')}) AS BIGINT) AS n_words FROM paras GROUP BY doc_id""")
def document_stats(spark, sf_dir):
    return paras(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.sum(T.count_words(F.col("text"))).alias("n_words"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('hold:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, CASE WHEN r <= greatest(1, n * 9 // 10) THEN 'train' ELSE 'test' END AS split FROM r""")
def split_by_source(spark, sf_dir):
    """Nine tenths of each source, one document at least, for training."""
    w = Window.partitionBy("source")
    order = F.row_number().over(w.orderBy(F.md5(F.concat(F.lit("hold:"), F.col("doc_id").cast("string"))), "doc_id"))
    r = docs(spark, sf_dir).select("doc_id", order.alias("r"), F.count("*").over(w).alias("n"))
    return r.select("doc_id", F.when(F.col("r") <= F.greatest(F.lit(1), F.expr("n * 9 div 10")), "train").otherwise("test").alias("split"))


@query("SELECT doc_id FROM documents ORDER BY md5('sample:' || doc_id), doc_id LIMIT 50")
def random_sample(spark, sf_dir):
    """Fifty documents in an order of digests."""
    return docs(spark, sf_dir).select("doc_id").orderBy(F.md5(F.concat(F.lit("sample:"), F.col("doc_id").cast("string"))), "doc_id").limit(50)


#: Names that a look-up knows, and the one it falls back to.
PERSONAS = ("src1", "src12", "src7", "default")


def author_match(name: Column, known: tuple[str, ...]) -> Column:
    """The known name that equals it, else the first that contains it or is in it, else the last."""
    low = F.lower(name)
    out = F.when(low.isin(*known), low)
    for k in known[:-1]:
        out = out.when(F.contains(low, F.lit(k)) | F.contains(F.lit(k), low), k)
    return out.otherwise(known[-1])


_MATCH = " ".join(f"WHEN contains(lower(source), '{k}') OR contains('{k}', lower(source)) THEN '{k}'" for k in PERSONAS[:-1])


@query(f"SELECT DISTINCT source, CASE WHEN list_contains({D.listed(PERSONAS)}, lower(source)) THEN lower(source) {_MATCH} ELSE 'default' END AS persona FROM documents")
def persona_match(spark, sf_dir):
    return docs(spark, sf_dir).select("source").distinct().select("source", author_match(F.col("source"), PERSONAS).alias("persona"))


@query(f"SELECT stem, CAST(count(*) AS BIGINT) AS n FROM (SELECT {_stem('w')} AS stem FROM (SELECT unnest({D.word_tokens('text')}) AS w FROM documents)) WHERE length(stem) >= 9 GROUP BY stem HAVING count(*) >= 3")
def entity_stems(spark, sf_dir):
    """Stems of nine letters or more that occur three times."""
    words = docs(spark, sf_dir).select(F.explode(T.word_tokens(F.col("text"))).alias("w")).select(verify.entity_stem(F.col("w")).alias("stem"))
    return words.where(F.char_length("stem") >= 9).groupBy("stem").agg(F.count("*").alias("n")).where("n >= 3")


@query("SELECT doc_id, lang, CAST(n_chars AS BIGINT) AS n_chars FROM documents")
def fenced_json(spark, sf_dir):
    """Fields of a fenced JSON answer made of each document, read back."""
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct("lang", "n_chars")), F.lit("\n```"))
    rows = docs(spark, sf_dir).select("doc_id", F.from_json(T.strip_code_fence(answer), "lang string, n_chars long").alias("j"))
    return rows.select("doc_id", "j.lang", "j.n_chars")


@query(f"""{_RHYTHM}, v AS (SELECT doc_id, para_idx, list_transform(ls, lambda n: CASE WHEN n BETWEEN 1 AND 4 THEN 'FRAGMENT' WHEN n BETWEEN 5 AND 10 THEN 'SHORT' WHEN n BETWEEN 11 AND 20 THEN 'MEDIUM' WHEN n BETWEEN 21 AND 35 THEN 'LONG' ELSE 'VERY_LONG' END) AS cs,
  ({D.std_pop('ls')}) * ({D.std_pop('ls')}) AS var FROM r)
SELECT doc_id, para_idx, 'Rhythm: ' || array_to_string(cs[1:6], ' → ') || CASE WHEN var > 100 THEN ' (high variance)' WHEN var > 50 THEN ' (moderate variance)' ELSE '' END AS guidance FROM v""")
def rhythm_guidance(spark, sf_dir):
    """A paragraph's first six lengths as text, and how much they vary."""
    rows = paras(spark, sf_dir).select("doc_id", "para_idx", T.sentence_lengths(F.col("text")).alias("ls")).withColumn("std", T.std_pop(F.col("ls")))
    var = F.col("std") * F.col("std")
    kind = F.when(var > 100, " (high variance)").when(var > 50, " (moderate variance)").otherwise("")
    return rows.select("doc_id", "para_idx", F.concat(F.lit("Rhythm: "), F.array_join(F.slice(F.transform("ls", scores.length_category), 1, 6), " → "), kind).alias("guidance"))


def blended(rows: DataFrame, primary: int, others: list[int], percent: int = 20, least: int = 10, weight: float = 2.0) -> DataFrame:
    """Vectors of the primary label and, label after label, the `percent` of each most like the centre so far (`least` at
    least). After each label the centre is weighed anew, the primary one's vectors twice. The driver holds one vector."""
    kept = rows.where(F.col("label") == primary).withColumn("w", F.lit(weight))
    sums = kept.select(F.posexplode("embedding").alias("pos", "x"), "w").groupBy("pos").agg(F.sum(F.col("x").cast("double") * F.col("w")).alias("s"), F.sum("w").alias("n"))
    total = {r.pos: [r.s, r.n] for r in sums.collect()}  # one number a dimension
    for label in others:
        centre = F.array(*(F.lit(total[k][0] / total[k][1]) for k in sorted(total)))
        own = rows.where(F.col("label") == label)
        n = max(least, own.count() * percent // 100)
        near = own.withColumn("sim", cosine(F.col("embedding"), centre)).where("sim > 0").orderBy(F.round("sim", 9).desc(), "vec_id").limit(n).drop("sim")
        if near.count() < least:
            continue
        near = near.withColumn("w", F.lit(1.0))
        for r in near.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n")).collect():
            total[r.pos][0] += r.s
            total[r.pos][1] += r.n
        kept = kept.unionByName(near)
    return kept


@query()
def blend_corpus(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    others = [r.label for r in rows.where("label <> 0").select("label").distinct().orderBy("label").collect()]  # one a source
    return blended(rows, 0, others).select("vec_id", "label")


@query("SELECT CAST(pos AS INTEGER) AS pos, round(sum(w * x) / sum(w), 6) AS mean FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(generate_series(0, len(embedding) - 1)) AS pos, CASE WHEN label = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM embeddings) GROUP BY pos")
def weighted_centroid(spark, sf_dir):
    w = F.when(F.col("label") == 0, 2.0).otherwise(1.0)
    rows = table(spark, sf_dir, "embeddings").select(w.alias("w"), F.posexplode("embedding").alias("pos", "x"))
    return rows.groupBy("pos").agg(F.round(F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w"), 6).alias("mean"))


@query("""WITH c AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(generate_series(0, len(embedding) - 1)) AS pos FROM embeddings) GROUP BY label, pos), v AS (SELECT label, list(m ORDER BY pos) AS centre FROM c GROUP BY label),
  s AS (SELECT vec_id, v.label, list_cosine_similarity(embedding::DOUBLE[], centre) AS sim FROM embeddings, v), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, label) AS r FROM s)
SELECT vec_id, CAST(label AS INTEGER) AS prototype FROM r WHERE r = 1""")
def prototype_classes(spark, sf_dir):
    """The label whose centre each vector is most like."""
    rows = table(spark, sf_dir, "embeddings")
    centres = centroids(rows, "label").withColumnRenamed("label", "prototype")  # a row a label
    s = rows.select("vec_id", "embedding").crossJoin(F.broadcast(centres)).select("vec_id", "prototype", F.round(cosine(F.col("embedding"), F.col("centroid")), 9).alias("sim"))
    return s.groupBy("vec_id").agg(F.max_by("prototype", F.struct("sim", -F.col("prototype"))).alias("prototype"))


@query()
def keywords(spark, sf_dir):
    """The first ten distinct nouns, names and verbs of each text, by the rules annotator."""
    t = providers.provided("annotate", "rules", F.col("text"))
    rows = docs(spark, sf_dir).select("doc_id", t.alias("t"))
    pick = F.filter("t", lambda x: x["pos"].isin("NOUN", "PROPN", "VERB") & ~x["is_stop"] & (F.char_length(x["text"]) > 2))
    return rows.select("doc_id", F.slice(F.array_distinct(F.transform(pick, lambda x: F.lower(x["text"]))), 1, 10).alias("keywords"))


@query()
def neutral_groups(spark, sf_dir):
    """Documents over 300 words as groups of sentences of 150 words at most, as a neutraliser takes them."""
    rows = docs(spark, sf_dir).where(T.count_words(F.col("text")) > 300).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.posexplode(folds._texts(folds.grouped_sentences)(F.col("s"))).alias("group_idx", "text"))
