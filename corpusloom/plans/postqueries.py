"""Queries over references, broken lines, annotations, exemplars and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import providers
from corpusloom.functions import text as T
from corpusloom.operators import folds, phrases, references
from corpusloom.streaming import flows

from . import duck as D
from .corpusqueries import table
from .textqueries import docs

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _marked():
    """The documents with a footnote after each comma and a citation after each stop."""
    return F.regexp_replace(F.regexp_replace("text", ",", "[^1],"), r"\.", "[2].")


@query()
def reference_extract(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", references.extract_references(_marked()).alias("r"))
    return rows.select("doc_id", "r.clean", F.size("r.refs").cast("long").alias("n_refs"), F.try_element_at("r.refs", F.lit(1))["attached_to"].alias("first"))


@query()
def reference_reinject(spark, sf_dir):
    """All references taken out of the documents and put back."""
    return docs(spark, sf_dir).select("doc_id", references.reinjected_references(_marked()).alias("text"))


@query()
def dehyphenate_lines(spark, sf_dir):
    """The documents broken at each `ti` inside a word, joined again."""
    broken = docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"([a-z]{2})ti([a-z])", "$1ti-\n$2").alias("text"))
    return references.joined_lines(references.lines(broken))


@query()
def sample_cleaner_lines(spark, sf_dir):
    return references.cleaned_lines(references.lines(docs(spark, sf_dir)))


_EXEMPLAR = f"""WITH s AS (SELECT doc_id, source, CAST(unnest(generate_series(0, len(ss) - 1)) AS INTEGER) AS sent_idx, unnest(ss) AS text FROM (SELECT doc_id, source, {D.sentences('text')} AS ss FROM documents)),
  k AS (SELECT *, len(regexp_extract_all(text, '—|;|,')) AS score FROM s WHERE len({D.words('text')}) BETWEEN 10 AND 40)
SELECT source, doc_id, sent_idx, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id, sent_idx) AS r FROM k WHERE score > 0) WHERE r <= 5"""


@query(_EXEMPLAR)
def exemplar_sentences(spark, sf_dir):
    """The five sentences of 10 to 40 words of each source with most marks."""
    rows = docs(spark, sf_dir).select("source", "doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_idx", "s"))
    rows = rows.where(T.count_words(F.col("s")).between(10, 40)).withColumn("score", F.regexp_count("s", F.lit("—|;|,")).cast("long")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "doc_id", "sent_idx"))
    return rows.withColumn("r", rank).where("r <= 5").select("source", "doc_id", "sent_idx", "score")


@query()
def part_of_speech(spark, sf_dir):
    """Tokens by the rules annotator's part of speech and source."""
    tokens = docs(spark, sf_dir).select("source", F.explode(F.transform(providers.provided("annotate", "rules", F.col("text")), lambda t: t["pos"])).alias("pos"))
    return tokens.groupBy("source", "pos").agg(F.count("*").alias("n"))


@query()
def syntactic_templates(spark, sf_dir):
    """The ten most frequent openings of an author's texts, by part of speech, and their share."""
    openings = F.transform(F.slice(providers.provided("annotate", "rules", F.col("s")), 1, 3), lambda t: t["pos"])
    rows = docs(spark, sf_dir).select("source", F.explode(T.sentences(F.col("text"))).alias("s")).select("source", F.array_join(openings, " ").alias("template"))
    counts = rows.groupBy("source", "template").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source")
    ranked = counts.withColumns({"r": F.row_number().over(w.orderBy(F.desc("n"), "template")), "freq": F.col("n") / F.sum("n").over(w)})
    return ranked.where("r <= 10").select("source", "template", "n", F.round("freq", 6).alias("freq"))


@query()
def hashing_encoder(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.left("text", F.lit(512)).alias("t")).select("doc_id", F.transform(providers.provided("encode", "hashing", F.col("t")), lambda x: F.round(x.cast("double"), 6)).alias("embedding"))


@query()
def grammar_edit_apply(spark, sf_dir):
    """Doubled words of the documents removed by edits, from the right."""
    import re

    def fixed(t: str) -> str:
        edits = [(m.start(2), len(m[2]), "") for m in re.finditer(r"\b(\w+)( \1\b)+", t)]
        return folds.applied(t, edits)[0]

    return docs(spark, sf_dir).select("doc_id", folds.text_udf(fixed)("text").alias("text"))


@query()
def phrase_replace(spark, sf_dir):
    """Paragraphs with plainer phrases and punctuation."""
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("para_idx", "text"))
    return rows.select("doc_id", "para_idx", folds.text_udf(lambda t: phrases.plain_phrases(t)[0])("text").alias("text"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """An extension: hourly windows by type, as the stream has them."""
    rows = flows.event_windows(table(spark, sf_dir, "events"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    """An extension: sessions of users, as the stream has them."""
    rows = flows.event_sessions(table(spark, sf_dir, "events"))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
