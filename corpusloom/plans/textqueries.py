"""Queries over cleaning, splitting, gates and scores: a document or a paragraph in, a row out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import gates, scores

from . import duck as D

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def paras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.paragraph_rows(docs(spark, sf_dir))


_SPECIAL_LOAD = r"""[a-zA-Z0-9\s.,!?;:''"()\-—–]"""
_SPECIAL_CURATE = r"""[a-zA-Z0-9\s.,!?;:''"()\-]"""
_PARTS = r"regexp_split_to_array(text, '[.!?]+')"
_BARE = r"""regexp_replace(lower(w_), '^[.,!?;:''"]+|[.,!?;:''"]+$', '', 'g')"""


def _measured(special: str) -> str:
    """As gates.measured; paragraphs are stripped already."""
    return f"""WITH {D.PARAS}, m AS (
  SELECT doc_id, author, para_idx, text, {D.n_words('text')} AS n_words,
         regexp_matches(regexp_replace(text, '[—–‘’“”…]', '', 'g'), '[^\\x00-\\x7F]{{3,}}') AS broken,
         length(regexp_replace(text, '{special}', '', 'g'))::DOUBLE / greatest(length(text), 1) AS special_ratio,
         len({_PARTS}) AS n_parts,
         len(list_filter({_PARTS}, lambda s: len({D.words('s')}) >= 3)) AS n_complete,
         len(list_filter({_PARTS}, lambda s: len({D.words('s')}) BETWEEN 1 AND 2)) AS n_fragments,
         coalesce(list_max(map_values(list_histogram(list_filter(list_transform({D.words('text')}, lambda w_: {_BARE}), lambda w_: length(w_) > 3)))), 0) AS max_freq
  FROM paras)"""


_LOAD = f"""{_measured(_SPECIAL_LOAD)}, gated AS (
  SELECT *, CASE WHEN n_words < 30 THEN 'too_short' WHEN broken THEN 'encoding_artifacts' WHEN special_ratio > 0.1::DOUBLE THEN 'special_chars' WHEN n_complete < 1 THEN 'incomplete'
                 WHEN max_freq > n_words * 0.15::DOUBLE AND max_freq > 5 THEN 'repetitive' ELSE 'ok' END AS reason
  FROM m)"""


@query(f"""{_LOAD}
SELECT author, reason, CAST(count(*) AS BIGINT) AS n_paragraphs, CAST(sum(n_words) AS BIGINT) AS n_words, CAST(sum({D.tokens('n_words')}) AS BIGINT) AS n_tokens
FROM gated GROUP BY author, reason""")
def load_quality_funnel(spark, sf_dir):
    """Paragraphs of each author by the load gate's outcome."""
    return gates.funnel(gates.load_gate(paras(spark, sf_dir)), "reason", "author")


_CURATE = f"""{_measured(_SPECIAL_CURATE)}, gated AS (
  SELECT *, CASE WHEN n_words < 40 THEN 'too_short' WHEN broken THEN 'encoding' WHEN special_ratio > 0.1::DOUBLE THEN 'special_chars' WHEN n_complete < 2 THEN 'few_sentences'
                 WHEN n_fragments > n_parts * 0.5::DOUBLE THEN 'fragments' WHEN max_freq > n_words * 0.15::DOUBLE AND max_freq > 5 THEN 'repetition' ELSE 'ok' END AS code
  FROM m)"""


@query(f"""{_CURATE}
SELECT author, code, CAST(count(*) AS BIGINT) AS n_paragraphs, CAST(sum(n_words) AS BIGINT) AS n_words, CAST(sum({D.tokens('n_words')}) AS BIGINT) AS n_tokens
FROM gated GROUP BY author, code""")
def curate_quality_funnel(spark, sf_dir):
    return gates.funnel(gates.curate_gate(paras(spark, sf_dir)), "code", "author")


@query(f"""{_CURATE}
SELECT CAST(count(*) AS BIGINT) AS n_before, CAST(count(*) FILTER (code = 'ok') AS BIGINT) AS n_after, CAST(sum(n_words) AS BIGINT) AS words_before,
       CAST(sum(n_words) FILTER (code = 'ok') AS BIGINT) AS words_after, CAST(sum({D.tokens('n_words')}) FILTER (code = 'ok') AS BIGINT) AS tokens_after
FROM gated""")
def corpus_reduction(spark, sf_dir):
    """Totals before and after the curation gate."""
    g, ok = gates.curate_gate(paras(spark, sf_dir)), F.col("code") == "ok"
    return g.agg(F.count("*").alias("n_before"), F.count_if(ok).alias("n_after"), F.sum("n_words").alias("words_before"), F.sum(F.when(ok, F.col("n_words"))).alias("words_after"), F.sum(F.when(ok, T.estimate_tokens(F.col("n_words")))).alias("tokens_after"))


@query(f"""WITH {D.PARAS}, m AS (
  SELECT author, {D.n_words('text')} AS n_words, len(list_distinct({D.words('lower(text)')})) AS n_distinct, len({D.sentences('text')}) AS n_sentences,
         len(regexp_extract_all(text, '[^\\p{{L}}\\p{{N}}\\s]'))::DOUBLE / greatest(length(text), 1) AS special
  FROM paras), g AS (
  SELECT *, CASE WHEN n_words < 100 THEN 'too_short' WHEN n_words > 650 THEN 'too_long' WHEN n_sentences < 2 THEN 'few_sentences' WHEN special > 0.1::DOUBLE THEN 'special_chars'
                 WHEN n_words >= 10 AND 1 - n_distinct::DOUBLE / n_words > 0.55::DOUBLE THEN 'repetition' ELSE 'ok' END AS code FROM m)
SELECT author, code, CAST(count(*) AS BIGINT) AS n_paragraphs, CAST(sum(n_words) AS BIGINT) AS n_words, CAST(sum({D.tokens('n_words')}) AS BIGINT) AS n_tokens FROM g GROUP BY author, code""")
def training_gate_funnel(spark, sf_dir):
    return gates.funnel(gates.training_gate(paras(spark, sf_dir)), "code", "author")


_CHUNKER = D.strip(D.sub("text", ("\\r\\n", "\\n"), ("\\n{3,}", "\\n\\n"), ("[ \\t]+", " "), ("[—–]", "-")).replace("'\\n'", "chr(10)").replace("'\\n\\n'", "chr(10) || chr(10)"))


@query(f"SELECT doc_id, {_CHUNKER} AS clean FROM documents")
def clean_text_chunker(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.clean_chunker(F.col("text"), normalize_quotes=False).alias("clean"))


_DROPPED = D.sub("text", (r"(?m)^Chapter \d+.*$", ""), (r"(?m)^\d+$", ""), (r"(?m)^Page \d+.*$", ""))


@query(f"SELECT doc_id, {D.strip(D.sub(_CHUNKER.replace('text', _DROPPED, 1), ('…', '...')))} AS clean FROM documents")
def clean_text_training(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.clean_training(F.col("text"), normalize_quotes=False).alias("clean"))


@query(f"WITH {D.PARAS} SELECT doc_id, author, para_idx, text FROM paras")
def paragraph_split(spark, sf_dir):
    return paras(spark, sf_dir)


@query(f"SELECT doc_id, CAST(unnest(generate_series(0, len(ss) - 1)) AS INTEGER) AS sent_idx, unnest(ss) AS text FROM (SELECT doc_id, {D.sentences('text')} AS ss FROM documents)")
def sentence_split(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_idx", "text"))


@query(f"""SELECT doc_id, n AS n_words, {D.tokens('n')} AS n_tokens, CAST(floor({D.tokens('n')} / 1.3::DOUBLE) AS BIGINT) AS words_back, CAST(length(text) // 4 AS BIGINT) AS char_tokens, substr(text, 1, 512) AS head
FROM (SELECT doc_id, text, {D.n_words('text')} AS n FROM documents)""")
def token_estimates(spark, sf_dir):
    n = T.count_words(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", n.alias("n_words"), T.estimate_tokens(n).alias("n_tokens"), T.words_from_tokens(T.estimate_tokens(n)).alias("words_back"), T.tokens_from_chars(F.col("text")).alias("char_tokens"), F.left("text", F.lit(512)).alias("head"))


_PLAIN = f"list_filter({D.word_tokens('text')}, lambda w: regexp_full_match(w, '[a-z]+'))"
_RICHNESS = f"""CASE WHEN len({_PLAIN}) < 10 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, len(list_distinct({_PLAIN}))::DOUBLE / len({_PLAIN}) * 0.6::DOUBLE
  + len(list_filter(list_distinct({_PLAIN}), lambda w: length(w) > 8 AND NOT list_contains({D.listed(scores.ORDINARY)}, w)))::DOUBLE / greatest(len(list_distinct({_PLAIN})), 1) * 0.4::DOUBLE + 0.2::DOUBLE) END"""
_BITS = f"list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda p: {D.strip('p')}), lambda p: p <> '')"
_BITLEN = f"list_transform({_BITS}, lambda s_: {D.n_words('s_')})"
_SYNTAX = f"""CASE WHEN len({_BITS}) = 0 THEN 0.0::DOUBLE ELSE (CASE WHEN len({_BITS}) < 2 THEN 0.3::DOUBLE ELSE least(1.0::DOUBLE, {D.std_pop(_BITLEN)} / 20) END) * 0.3::DOUBLE
  + least(1.0::DOUBLE, {D.count('text', '[;:—–()]')}::DOUBLE / 10) * 0.3::DOUBLE
  + least(1.0::DOUBLE, len(list_filter({D.word_tokens('text')}, lambda w: list_contains({D.listed(scores.CLAUSE_WORDS)}, w)))::DOUBLE / 5) * 0.4::DOUBLE END"""
_MOOD = " + ".join(f"CAST(regexp_matches(lower(text), '{p}') AS INTEGER)" for p in scores.DARK_PHRASES)
_OWN = r"len(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: list_contains(['I', 'my', 'me', 'myself'], w)))"
_STYLE = f"""least(1.0::DOUBLE, {D.contained('lower(text)', scores.DARK_WORDS)}::DOUBLE / 5) * 0.4::DOUBLE + least(1.0::DOUBLE, ({_MOOD})::DOUBLE / 3) * 0.3::DOUBLE
  + (CASE WHEN {_OWN} > 0 THEN least(1.0::DOUBLE, {_OWN}::DOUBLE / 10) ELSE 0.3::DOUBLE END) * 0.15::DOUBLE + least(1.0::DOUBLE, {D.count('text', '!|—|[.]{3}')}::DOUBLE / 5) * 0.15::DOUBLE"""


def _scored(name: str, sql: str, column):
    def run(spark, sf_dir):
        return docs(spark, sf_dir).select("doc_id", F.round(column(F.col("text")), 6).alias("score"))

    run.__name__ = name
    query(f"SELECT doc_id, round({sql}, 6) AS score FROM documents")(run)


_scored("vocabulary_richness", _RICHNESS, scores.vocabulary_richness)
_scored("syntax_complexity", _SYNTAX, scores.syntax_complexity)
_scored("style_markers", _STYLE, scores.style_markers)


def score_columns(rows: DataFrame) -> DataFrame:
    c = F.col("text")
    rows = rows.withColumns({"vocabulary": scores.vocabulary_richness(c), "syntax": scores.syntax_complexity(c), "style": scores.style_markers(c)})
    return rows.withColumn("quality", scores.quality_score(F.col("vocabulary"), F.col("syntax"), F.col("style")))


@query(f"""WITH s AS (SELECT source, {_RICHNESS} AS vocabulary, {_SYNTAX} AS syntax, {_STYLE} AS style FROM documents)
SELECT source, CAST(count(*) AS BIGINT) AS n, round(min(q), 6) AS least, round(max(q), 6) AS most, round(avg(q), 6) AS mean
FROM (SELECT source, vocabulary * 0.3::DOUBLE + syntax * 0.35::DOUBLE + style * 0.35::DOUBLE AS q FROM s) GROUP BY source""")
def quality_scores(spark, sf_dir):
    """Distribution of the quality score by source."""
    s = score_columns(docs(spark, sf_dir))
    return s.groupBy("source").agg(F.count("*").alias("n"), F.round(F.min("quality"), 6).alias("least"), F.round(F.max("quality"), 6).alias("most"), F.round(F.avg("quality"), 6).alias("mean"))


_LETTERS = f"""list_sum(list_transform({D.words('text')}, lambda w: length(regexp_replace(w, '^[.,;:!?"''()\\-—]+|[.,;:!?"''()\\-—]+$', '', 'g'))))"""
_METRICS = {
    "avg_sentence_length": f"coalesce({D.mean(D.lengths('text'))}, 0)",
    "sentence_length_std": f"coalesce({D.std_pop(D.lengths('text'))}, 0)",
    "punctuation_density": f"CASE WHEN len({D.words('text')}) > 0 THEN {D.count('text', '[;:—–,-]')}::DOUBLE / len({D.words('text')}) * 100 ELSE 0 END",
    "avg_word_length": f"coalesce({_LETTERS}::DOUBLE / nullif(len({D.words('text')}), 0), 0)",
}


@query("SELECT doc_id, " + ", ".join(f"round({x}, 6) AS {n}" for n, x in _METRICS.items()) + " FROM documents")
def style_metrics(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *(F.round(x, 6).alias(n) for n, x in scores.style_metrics(F.col("text")).items()))


@query(
    f"WITH m AS (SELECT doc_id, {', '.join(f'{x} AS {n}' for n, x in _METRICS.items())} FROM documents) SELECT a.doc_id, b.doc_id AS other_id, round("
    + " + ".join(f"{w}::DOUBLE * (abs(a.{n} - b.{n}) / greatest(abs(a.{n}), abs(b.{n}), 1.0::DOUBLE))" for n, w in scores.DISTANCE_WEIGHTS.items() if n in _METRICS)
    + ", 6) AS distance FROM m a JOIN m b ON b.doc_id = a.doc_id + 1"
)
def structural_distance_pairs(spark, sf_dir):
    """Structural distance of each document and the one with the next id."""
    names = list(scores.style_metrics(F.col("text")))
    m = docs(spark, sf_dir).select("doc_id", *(x.alias(n) for n, x in scores.style_metrics(F.col("text")).items()))
    a, b = m.alias("a"), m.select((F.col("doc_id") - 1).alias("before"), F.col("doc_id").alias("other_id"), *names).alias("b")
    side = lambda s: {n: F.col(f"{s}.{n}") for n in names}
    return a.join(b, F.col("a.doc_id") == F.col("b.before")).select("a.doc_id", "other_id", F.round(scores.structural_distance(side("a"), side("b")), 6).alias("distance"))


@query(f"""SELECT doc_id, round(CASE WHEN len(ls) < 2 OR {D.mean('ls')} = 0 THEN 0 ELSE {D.std_pop('ls')} / ({D.mean('ls')}) END, 6) AS burstiness FROM (SELECT doc_id, {D.lengths('text')} AS ls FROM documents)""")
def burstiness(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", T.sentence_lengths(F.col("text")).alias("ls"))
    return rows.select("doc_id", F.round(scores.burstiness(F.col("ls")), 6).alias("burstiness"))


_CATEGORY = "CASE WHEN n BETWEEN 1 AND 4 THEN 'FRAGMENT' WHEN n BETWEEN 5 AND 10 THEN 'SHORT' WHEN n BETWEEN 11 AND 20 THEN 'MEDIUM' WHEN n BETWEEN 21 AND 35 THEN 'LONG' ELSE 'VERY_LONG' END"


@query(f"SELECT source, category, CAST(count(*) AS BIGINT) AS n FROM (SELECT source, {_CATEGORY} AS category FROM (SELECT source, unnest({D.lengths('text')}) AS n FROM documents)) GROUP BY source, category")
def length_categories(spark, sf_dir):
    rows = docs(spark, sf_dir).select("source", F.explode(T.sentence_lengths(F.col("text"))).alias("n"))
    return rows.groupBy("source", scores.length_category(F.col("n")).alias("category")).agg(F.count("*").alias("n"))


_MARKED = "len(list_filter([';', '—', '--', ':', '(', ')'], lambda m: contains(text, m))) > 0"
_TAG = f"CASE WHEN {D.mean('ls')} < 12 THEN 'Short & Punchy' WHEN {D.mean('ls')} > 25 THEN 'Long & Flowing' WHEN {D.std_pop('ls')} > 8 THEN 'Varied Lengths' ELSE 'Medium Length' END"
_RAW = f"list_transform({D.after_stops('text')}, lambda s_: {D.n_words('s_')})"


@query(f"""SELECT doc_id, CASE WHEN len(ls) = 0 THEN '[STYLE: Medium Length | Simple Syntax]' ELSE '[STYLE: ' || {_TAG} || ' | ' || CASE WHEN {_MARKED} AND {D.contained('lower(text)', scores.CONNECTIVES)} > 0 THEN 'Baroque Syntax' WHEN {_MARKED} THEN 'Complex Syntax' ELSE 'Simple Syntax' END || ']' END AS tag,
       '[STYLE: ' || {_TAG.replace('ls', 'rs')} || ' | ' || CASE WHEN {_MARKED} THEN 'Complex Syntax' ELSE 'Simple Syntax' END || ']' AS phased_tag
FROM (SELECT doc_id, text, {D.lengths('text')} AS ls, {_RAW} AS rs FROM documents)""")
def style_tags(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", scores.style_tag(F.col("text")).alias("tag"), scores.phased_style_tag(F.col("text")).alias("phased_tag"))


@query(f"""SELECT doc_id, {D.n_words('text')} AS word_count, CAST(len(ls) AS BIGINT) AS sentence_count, coalesce(round_even({D.mean('ls')}, 1), 0) AS avg_sentence_length,
       CASE WHEN len(ls) > 1 THEN round_even({D.std_pop('ls')}, 1) ELSE 0 END AS sentence_length_std, CAST(coalesce(list_min(ls), 0) AS BIGINT) AS min_sentence, CAST(coalesce(list_max(ls), 0) AS BIGINT) AS max_sentence,
       array_to_string(list_filter({D.listed(scores.BANNED)}, lambda b: contains(lower(text), b)), ',') AS banned_transitions, {D.count('text', '—')} + {D.count('text', '--')} AS dashes, {D.count('text', ';')} AS semicolons
FROM (SELECT doc_id, text, {D.lengths('text')} AS ls FROM documents)""")
def output_analysis(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *(x.alias(n) for n, x in scores.output_analysis(F.col("text")).items()))


_EDGE = r"""[.,;:!?"''()\-—]"""
_HEAD_BARE = f"regexp_replace(w_, '^{_EDGE}+|{_EDGE}+$', '', 'g')"
_REST = f"list_filter(list_transform({D.words('text')}[2:], lambda w_: {_HEAD_BARE}), lambda w: w <> '' AND NOT list_contains({D.listed(T.SMALL_WORDS)}, lower(w)) AND NOT (upper(w) = w AND lower(w) <> w AND length(w) <= 4))"
_HEADING = f"""CASE WHEN text = '' THEN false WHEN starts_with(text, '#') THEN true
  WHEN {D.count('text', '\\p{L}')} > 0 AND {D.count('text', '\\p{Lu}')} > 0.8::DOUBLE * {D.count('text', '\\p{L}')} THEN true
  WHEN text LIKE '%.' OR text LIKE '%!' THEN false
  WHEN len({D.words('text')}) = 1 AND regexp_matches({_HEAD_BARE.replace('w_', f'{D.words("text")}[1]')}, '^\\p{{Lu}}') THEN true
  WHEN len({D.words('text')}) >= 2 AND len(rest) >= 2 AND 2 * len(list_filter(rest, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) >= len(rest) THEN true
  WHEN len({D.words('text')}) BETWEEN 2 AND 6 AND len(list_filter(rest, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) >= 1 THEN true ELSE false END"""


@query(f"WITH {D.PARAS} SELECT doc_id, para_idx, {_HEADING} AS is_heading FROM (SELECT *, {_REST} AS rest FROM paras)")
def heading_detection(spark, sf_dir):
    return paras(spark, sf_dir).select("doc_id", "para_idx", T.is_heading(F.col("text")).alias("is_heading"))


def _pronouns(*ws: str) -> str:
    return f"len(list_filter(ts, lambda t: list_contains({D.listed(ws)}, t)))"


@query(f"""SELECT doc_id, CASE WHEN a > b AND a > c THEN 'first_person_singular' WHEN b > a AND b > c THEN 'first_person_plural' ELSE 'third_person' END AS perspective
FROM (SELECT doc_id, {_pronouns('i', 'me', 'my', 'mine', 'myself')} AS a, {_pronouns('we', 'us', 'our', 'ours', 'ourselves')} AS b, {_pronouns('he', 'she', 'it', 'they', 'him', 'her', 'them', 'his', 'hers', 'its', 'their')} AS c
      FROM (SELECT doc_id, {D.word_tokens('text')} AS ts FROM documents))""")
def perspective_detection(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.perspective(F.col("text")).alias("perspective"))


def _any(x: str, *parts: str) -> str:
    return f"{D.contained(x, parts)} > 0"


_MOVE = f"""CASE WHEN {_any('lower(s)', 'like', 'as if', 'resembles', 'similar to', 'as though')} THEN 'Metaphor' WHEN regexp_matches(lower(s), '^(i |we |one |i''m |we''re )') THEN 'Personal Observation'
  WHEN {_any('lower(s)', 'defined as', 'refers to', 'means that', 'is called')} THEN 'Technical Definition' WHEN contains(s, '?') THEN 'Rhetorical Question'
  WHEN list_has_any({D.words('lower(s)')}[1:3], ['however', 'but', 'yet', 'although', 'while']) THEN 'Contrast'
  WHEN {_any('lower(s)', 'because', 'therefore', 'thus', 'hence', 'consequently')} THEN 'Consequence' ELSE 'Observation' END"""


@query(f"SELECT doc_id, CASE WHEN len(ss) = 0 THEN '[Observation]' ELSE array_to_string(list_transform(ss, lambda s: '[' || {_MOVE} || ']'), ' -> ') END AS skeleton FROM (SELECT doc_id, {D.sentences('text')} AS ss FROM documents)")
def rhetorical_moves(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.rhetorical_skeleton(F.col("text")).alias("skeleton"))


@query(f"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(sk, '\\[([^\\]]+)\\]', 1), lambda m: {D.strip('m')}), lambda m: m <> ''), ' → ') AS moves
FROM (SELECT doc_id, CASE WHEN len(ss) = 0 THEN '[Observation]' ELSE array_to_string(list_transform(ss, lambda s: '[' || {_MOVE} || ']'), ' -> ') END AS sk FROM (SELECT doc_id, {D.sentences('text')} AS ss FROM documents))""")
def skeleton_parse(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(T.skeleton_moves(T.rhetorical_skeleton(F.col("text"))), " → ").alias("moves"))


@query(f"""SELECT doc_id, CASE WHEN {_any('lower(text)', 'research', 'study', 'analysis', 'findings', 'hypothesis')} THEN 'academic' WHEN {_any('lower(text)', 'therefore', 'furthermore', 'consequently', 'thus', 'hence')} THEN 'formal'
  WHEN {_any('lower(text)', 'you', 'we', 'i', "let's", "here's")} THEN 'conversational' ELSE 'neutral' END AS tone,
  CASE WHEN len(list_filter(ss, lambda s: suffix(s, '?'))) > len(ss) * 0.2::DOUBLE THEN 'explanatory' ELSE 'informative' END AS intent FROM (SELECT doc_id, text, {D.sentences('text')} AS ss FROM documents)""")
def tone_heuristics(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", scores.tone(F.col("text")).alias("tone"), scores.intent(F.col("text")).alias("intent"))


_STORY = f"least({D.contained("' ' || lower(text) || ' '", [f' {w} ' for w in scores.TEMPORAL])}, 3) + least({D.contained('lower(text)', scores.SEQUENCE)}, 2)"
_IDEA = f"least({D.contained('lower(text)', scores.CONCEPTUAL)} * 2, 4) + CASE WHEN {D.contained('lower(text)', scores.DEFINITIONS)} > 0 THEN 3 ELSE 0 END + CASE WHEN regexp_matches(lower(text), '^(it is|there are|there is|this is|these are)') THEN 1 ELSE 0 END"


@query(f"""SELECT doc_id, a AS narrative_points, b AS conceptual_points, CASE WHEN a > b + 1 THEN 'narrative' WHEN b > a + 1 THEN 'conceptual' ELSE 'narrative' END AS content_type
FROM (SELECT doc_id, CAST({_STORY} AS BIGINT) AS a, CAST({_IDEA} AS BIGINT) AS b FROM documents)""")
def content_type_lexical(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *(x.alias(n) for n, x in scores.content_type(F.col("text")).items()))


_JAVA_PUNCT = [(rf"—\s*{m}", m[-1]) for m in (",", r"\.", ";", ":")], [(rf"{m}\s*—", m[-1]) for m in (",", r"\.", ";", ":")]
_PUNCT = [r for pair in zip(*_JAVA_PUNCT) for r in pair] + [(rf"{m}\s*{m}", m[-1]) for m in (",", r"\.", ";", ":")] + [(r"\s+([.,;:!?])", r"\1"), ("([.,;:!?])([A-Za-z])", r"\1 \2"), (r"\s+", " ")]


@query(f"SELECT doc_id, {D.strip(D.sub('text', *_PUNCT))} AS clean FROM documents")
def clean_punctuation(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.clean_punctuation(F.col("text")).alias("clean"))


_REPAIR = D.strip(D.sub(D.sub(D.strip("text"), *((f"(?im){p}".replace("'", "''").replace("text", "tex[t]"), "") for p in T.REPAIR_PREFIXES)), *((f"(?i){p}", "") for p in T.REPAIR_SUFFIXES)))


@query(f"SELECT doc_id, {_REPAIR} AS clean FROM (SELECT doc_id, 'Sure, here you are: ' || text || ' I hope this helps you.' AS text FROM documents)")
def clean_repair_prefixes(spark, sf_dir):
    """The documents as answers that begin and end as a polite model's do, cleaned of that."""
    return docs(spark, sf_dir).select("doc_id", T.clean_repair(F.concat(F.lit("Sure, here you are: "), "text", F.lit(" I hope this helps you."))).alias("clean"))


@query()
def clean_model_response(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.clean_response(F.col("text")).alias("clean"))


@query(f"""SELECT doc_id, {D.strip(D.sub('marked', (r'\[\^[^\]]+\]', ''), (r'\[\d+(?:[,\-]\s*\d+)*\]', ''), (' {2,}', ' ')))} AS clean, {D.count('marked', r'\[\^\d+\]')} AS n_footnotes
FROM (SELECT doc_id, regexp_replace(text, '([.,])', '[^1]\\1 [2, 3]', 'g') AS marked FROM documents)""")
def reference_strip(spark, sf_dir):
    """The documents with a footnote and a citation put at each stop and comma, without them again."""
    marked = F.regexp_replace("text", "([.,])", "[^1]$1 [2, 3]")
    return docs(spark, sf_dir).select("doc_id", T.strip_references(marked).alias("clean"), F.regexp_count(marked, F.lit(r"\[\^\d+\]")).cast("long").alias("n_footnotes"))
