"""Queries over training sets, chunk dispatch, validation of rewritten texts, and small joins and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import providers
from corpusloom.functions import text as T
from corpusloom.operators import folds, gates, rendering, scores, training, verify

from . import duck as D
from .corpusqueries import _COVER, _ENTITY, _PAIRS, _U, ORACLE_SQL as _CORPUS_SQL, _chunk_sql, _content, _stem, blend_step, dot, pair_profiles, table, text_pairs
from .textqueries import _MOVE, ORACLE_SQL as _TEXT_SQL, docs, paras, score_columns

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# -- splits, citations, sentences --------------------------------------------------------------------------------------

_UNIX = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_BLANK = rf"string_split(regexp_replace({_UNIX}, '\n[ \t\n\r\f]*\n', chr(1), 'g'), chr(1))"


@query(f"""WITH p AS (SELECT doc_id, list_filter(list_transform({_BLANK}, lambda p_: array_to_string({D.words('p_')}, ' ')), lambda p_: p_ <> '') AS ps FROM documents)
SELECT doc_id, CAST(unnest(generate_series(0, len(ps) - 1)) AS INTEGER) AS para_idx, unnest(ps) AS text FROM p""")
def normalised_paragraphs(spark, sf_dir):
    """Parts between blank lines, all white space in them one blank."""
    plain = T.sub(F.col("text"), ("\r\n", "\n"), ("\r", "\n"))
    parts = F.transform(F.split(plain, rf"\n{T.WS}*\n"), lambda p: F.array_join(T.words(p), " "))
    return docs(spark, sf_dir).select("doc_id", F.posexplode(F.filter(parts, lambda p: p != "")).alias("para_idx", "text"))


_SELECTED = f"""WITH {D.PARAS}, s AS (SELECT doc_id, para_idx, {D.strip("regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')")} AS text FROM paras)
SELECT doc_id, para_idx, text, {D.n_words('text')} AS n_words FROM s WHERE {D.n_words('text')} BETWEEN 80 AND 600
  AND NOT regexp_matches(text, '\\A(Chapter|Part|Section|[IVXLC]+\\.?\\s*$|[A-Z][A-Z\\s]+$)') AND length(regexp_replace(text, '[a-zA-Z0-9\\s.,;:!?''"()\\-—]', '', 'g'))::DOUBLE / length(text) <= 0.05::DOUBLE"""


@query(_SELECTED)
def selection_paragraphs(spark, sf_dir):
    return gates.selection_paragraphs(docs(spark, sf_dir))


_CITED = "regexp_replace(text, '([.,])', '[^1]\\1 [^23]', 'g')"


@query(f"""WITH c AS (SELECT doc_id, {_CITED} AS t FROM documents), p AS (SELECT doc_id, t, regexp_extract_all(t, '\\[\\^[0-9]+\\]') AS ms, regexp_split_to_array(t, '\\[\\^[0-9]+\\]') AS ps FROM c)
SELECT doc_id, array_to_string(list_transform(range(1, len(ms) + 1), lambda k: ms[k] || '@' || (list_sum(list_transform(ps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0))::BIGINT), ',') AS citations,
  regexp_replace(t, '\\[\\^[0-9]+\\]', '', 'g') AS stripped FROM p""")
def citation_extract(spark, sf_dir):
    """Footnote marks with their places in the documents, which get some at stops and commas, and the texts without them."""
    marked = F.regexp_replace("text", "([.,])", "[^1]$1 [^23]")
    rows = docs(spark, sf_dir).select("doc_id", marked.alias("t"))
    return rows.select("doc_id", F.array_join(F.transform(T.citations(F.col("t")), lambda c: F.concat(c["marker"], F.lit("@"), c["pos"].cast("string"))), ",").alias("citations"), T.remove_citations(F.col("t")).alias("stripped"))


_WHOLE = f"list_filter({D.sentences('t')}, lambda s: regexp_matches(s, '[.!?]$'))"


@query(f"""WITH c AS (SELECT doc_id, {D.strip("left(text, 300)")} AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '[.!?]$') THEN t WHEN len({_WHOLE}) > 0 THEN array_to_string({_WHOLE}, ' ') WHEN len({D.words('t')}) > 10 AND NOT regexp_matches(t, '[,:;]$') THEN t || '.' ELSE t END AS text FROM c""")
def complete_sentences(spark, sf_dir):
    """The first 300 characters of each document, as a generator stops, cut to whole sentences."""
    return docs(spark, sf_dir).select("doc_id", T.complete_sentences(F.left("text", F.lit(300))).alias("text"))


_W = r"[\p{L}\p{N}_]+(?:''[\p{L}\p{N}_]+)?"


def _incomplete(s: str) -> str:
    ws = f"regexp_extract_all({s}, '{_W}')"
    low = "lower(v_)"
    ending = f"((suffix({low}, 'ing') AND length({low}) > 5) OR (suffix({low}, 'ed') AND length({low}) > 4))"
    verb = f"(list_contains({D.listed(training.AUXILIARIES)}, {low}) OR ({ending} AND NOT list_contains({D.listed(sorted(providers.CLOSED))}, {low}) AND NOT (regexp_matches(v_, '^\\p{{Lu}}') AND i_ > 1)))"
    return f"""CASE WHEN len({ws}) = 0 THEN '' WHEN suffix({s}, '—') OR suffix({s}, '-') THEN 'dash' WHEN list_contains({D.listed(training.OPEN_ENDED)}, lower({ws}[-1])) THEN 'open_end'
      WHEN len({ws}) >= 4 AND len(list_filter({ws}, lambda v_, i_: {verb})) = 0 THEN 'no_verb' WHEN len({ws}) > 3 AND NOT regexp_matches({s}, '[.!?;:"''“”‘’]$') THEN 'no_stop' ELSE '' END"""


@query(f"WITH s AS (SELECT doc_id, unnest({D.sentences('text')}) AS s FROM documents), w AS (SELECT doc_id, {_incomplete('s')} AS why FROM s) SELECT doc_id, why, CAST(count(*) AS BIGINT) AS n FROM w WHERE why <> '' GROUP BY ALL")
def incomplete_sentences(spark, sf_dir):
    """Incomplete sentences of each document, by reason."""
    rows = docs(spark, sf_dir).select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s")).select("doc_id", training.incomplete(F.col("s")).alias("why"))
    return rows.where("why <> ''").groupBy("doc_id", "why").agg(F.count("*").alias("n"))


_DEDUP = f"""WITH {D.PARAS}, k AS (SELECT *, lower(substr(text, 1, 50)) AS head FROM paras), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, head ORDER BY length(text) DESC, para_idx) AS r, min(para_idx) OVER (PARTITION BY doc_id, head) AS place FROM k),
  f AS (SELECT doc_id, place, para_idx, text, {D.sentences('text')} AS ss FROM r WHERE r = 1), y AS (SELECT *, CASE WHEN len(ss) = 0 THEN '' ELSE {_incomplete('ss[-1]')} END AS why FROM f),
  c AS (SELECT *, CASE WHEN why NOT IN ('', 'no_stop') THEN CASE WHEN len(list_filter(ss, lambda s: ({_incomplete('s')}) = '')) > 0 THEN list_filter(ss, lambda s: ({_incomplete('s')}) = '') WHEN {D.n_words('text')} > 10 THEN [text || '.'] END ELSE ss END AS cut FROM y),
  o AS (SELECT *, list_filter(cut, lambda s, i: NOT list_contains(list_transform(cut[1:i - 1], lambda t: lower(t)), lower(s))) AS once FROM c),
  t AS (SELECT doc_id, place, CASE WHEN para_idx <> place THEN text WHEN len(once) < len(cut) THEN array_to_string(once, ' ') WHEN why NOT IN ('', 'no_stop') THEN array_to_string(cut, ' ') WHEN cut IS NOT NULL THEN text END AS text FROM o)
SELECT doc_id, CAST(place AS INTEGER) AS para_idx, text FROM t WHERE text IS NOT NULL"""


@query(_DEDUP)
def paragraph_cleanup(spark, sf_dir):
    """Paragraphs without near repeats, incomplete ends and repeated sentences."""
    return training.cleaned_paragraphs(paras(spark, sf_dir))


# -- chunk dispatch ----------------------------------------------------------------------------------------------------

_EN, _OTHER = "(SELECT * FROM documents WHERE lang = 'en')", "(SELECT * FROM documents WHERE lang IS DISTINCT FROM 'en')"
_CUT = "b.k - a.k >= 2 AND b.p - a.p + b.w > 195"


@query(f"""SELECT doc_id, 0 AS chunk_idx, {D.n_words('text')} AS word_count, CASE WHEN lang = 'en' THEN 'original' ELSE 'variation' END AS variation_type, text FROM documents WHERE {D.n_words('text')} <= 180
UNION ALL SELECT doc_id, chunk_idx, word_count, 'original', text FROM ({_chunk_sql(150, _CUT, 75, 1, 60, f"(SELECT * FROM {_EN} WHERE {D.n_words('text')} > 180)")})
UNION ALL SELECT doc_id, chunk_idx, word_count, 'variation', text FROM ({_chunk_sql(150, _CUT, 75, 0, 60, f"(SELECT * FROM {_OTHER} WHERE {D.n_words('text')} > 180)")})""")
def rechunk_dispatch(spark, sf_dir):
    """Documents of up to 1.2 times the target as they are; longer originals (in English) cut with an overlap of a sentence, variations without."""
    d = docs(spark, sf_dir).withColumn("n", T.count_words(F.col("text")))
    original = F.coalesce(F.col("lang") == "en", F.lit(False))
    kind = F.when(original, "original").otherwise("variation")
    whole = d.where("n <= 180").select("doc_id", F.lit(0).alias("chunk_idx"), F.col("n").alias("word_count"), kind.alias("variation_type"), "text")
    cut = lambda rows, name, fold: folds.chunks(rows, fold).select("doc_id", "chunk_idx", "word_count", F.lit(name).alias("variation_type"), "text")
    long = d.where("n > 180")
    return whole.union(cut(long.where(original), "original", folds.rechunk_spans)).union(cut(long.where(~original), "variation", lambda w: folds.rechunk_spans(w, overlap=0)))


@query(f"""SELECT doc_id, chunk_idx, word_count, 'original' AS variation_type FROM ({_chunk_sql(400, "b.p - a.p >= 150 AND b.p - a.p + b.w > 440", 150, 2, 75, _EN)})
UNION ALL SELECT doc_id, 0, {D.n_words('text')}, 'variation' FROM documents WHERE lang IS DISTINCT FROM 'en' AND {D.n_words('text')} >= 150 * 0.7::DOUBLE""")
def typed_training_chunks(spark, sf_dir):
    """Training chunks: originals (in English) in overlapping windows, variations whole from 0.7 times the least length."""
    d = docs(spark, sf_dir)
    original = F.coalesce(F.col("lang") == "en", F.lit(False))
    cut = folds.chunks(d.where(original), folds.training_spans).select("doc_id", "chunk_idx", "word_count", F.lit("original").alias("variation_type"))
    n = T.count_words(F.col("text"))
    return cut.union(d.where(~original).where(n >= 150 * 0.7).select("doc_id", F.lit(0), n, F.lit("variation")))


# -- validation --------------------------------------------------------------------------------------------------------


@query(f"""WITH {_PAIRS}, m AS (SELECT doc_id, other, {D.n_words('text')} AS n, {D.n_words('other')} AS m FROM p)
SELECT doc_id, length({D.strip('other')}) >= 10 AND NOT regexp_matches(other, '[\\x{{4e00}}-\\x{{9fff}}]') AND m >= 3 AND abs(n - m) <= (CASE WHEN n < 100 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END) * n AS ok FROM m""")
def round_trip_validation(spark, sf_dir):
    return text_pairs(spark, sf_dir).select("doc_id", gates.round_trip_ok(F.col("text"), F.col("other")).alias("ok"))


@query(f"WITH {D.PARAS} SELECT doc_id, para_idx, {D.n_words('text')} < 10 AS passed_through, {D.n_words('text')} > 20 AS sampled, CASE WHEN {D.n_words('text')} < 10 THEN 1.0::DOUBLE END AS score FROM paras")
def paragraph_routing(spark, sf_dir):
    """Paragraphs too short to rewrite, which pass with score 1, and those long enough for a sample."""
    n = T.count_words(F.col("text"))
    return paras(spark, sf_dir).select("doc_id", "para_idx", (n < 10).alias("passed_through"), (n > 20).alias("sampled"), F.when(n < 10, 1.0).alias("score"))


@query(f"SELECT source, CAST(count(*) AS BIGINT) AS n FROM (SELECT d.source, s.score * 0.3::DOUBLE + t.score * 0.35::DOUBLE + u.score * 0.35::DOUBLE AS q FROM documents d JOIN ({_TEXT_SQL['vocabulary_richness']}) s USING (doc_id) JOIN ({_TEXT_SQL['syntax_complexity']}) t USING (doc_id) JOIN ({_TEXT_SQL['style_markers']}) u USING (doc_id)) WHERE q >= 0.35::DOUBLE GROUP BY source")
def min_quality(spark, sf_dir):
    """Documents of each source with a quality of 0.35 at least, of scores to six places."""
    s = score_columns(docs(spark, sf_dir)).select("source", scores.quality_score(*(F.round(c, 6) for c in ("vocabulary", "syntax", "style"))).alias("q"))
    return s.where("q >= 0.35").groupBy("source").agg(F.count("*").alias("n"))


@query(f"WITH {_PAIRS} SELECT doc_id, round({_COVER}, 6) AS overlap, {_COVER} < 0.1::DOUBLE AS memorised FROM p")
def content_overlap_flags(spark, sf_dir):
    """Pairs whose output has under a tenth of its input's content words."""
    words = docs(spark, sf_dir).select("doc_id", verify.content_words(F.col("text")).alias("words"))
    c = verify.coverage(F.col("words"), F.col("out_words"))
    return verify.paired(words, words.withColumn("doc_id", F.col("doc_id") - 1)).select("doc_id", F.round(c, 6).alias("overlap"), (c < 0.1).alias("memorised"))


@query(f"""WITH {_ENTITY}, o AS (SELECT p.doc_id, text, other, missing FROM p JOIN ent ON p.doc_id = ent.doc_id)
SELECT doc_id, length(other) > length(text) AS expanded, CASE WHEN {D.strip('other')} <> '' THEN 'output' ELSE 'original' END AS narrative, {D.n_words('other')} > 10 AND len(list_filter(missing, lambda e: contains(lower(other), e))) >= len(missing) * 0.5::DOUBLE AS repaired FROM o""")
def model_output_acceptance(spark, sf_dir):
    """Whether a model's output stands: an expansion if it is longer, a conversion if it isn't empty, a repair if it has over ten words and half of the missing entities."""
    source, output = (p.join(docs(spark, sf_dir).select((F.col("doc_id") - k).alias("doc_id"), "text"), "doc_id") for k, p in enumerate(pair_profiles(spark, sf_dir)))
    e = verify.entity_check(verify.paired(source, output))
    text, other = F.col("text"), F.col("out_text")
    return e.select("doc_id", (F.char_length(other) > F.char_length(text)).alias("expanded"), F.when(T.strip(other) != "", "output").otherwise("original").alias("narrative"), verify.repair_accepted(other, F.col("missing")).alias("repaired"))


@query("SELECT a.vec_id, round(CASE WHEN list_sum(list_transform(a.embedding, lambda x: abs(x))) = 0 OR list_sum(list_transform(b.embedding, lambda x: abs(x))) = 0 THEN 0 ELSE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END, 5) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def semantic_similarity(spark, sf_dir):
    """Cosine of each vector and the one with the next id, 0 without a vector."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    p = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    a, b = F.col("embedding"), F.col("other")
    norms = T.let(F.struct(dot(a, a).alias("a"), dot(b, b).alias("b")), lambda n: F.when((n["a"] == 0) | (n["b"] == 0), 0.0).otherwise(dot(a, b) / F.sqrt(n["a"] * n["b"])))
    return p.select("vec_id", F.round(norms, 5).alias("similarity"))


@query("SELECT vec_id, round(exp(embedding[3]::DOUBLE) / (exp(embedding[1]::DOUBLE) + exp(embedding[2]::DOUBLE) + exp(embedding[3]::DOUBLE)), 6) AS entailment FROM embeddings")
def entailment_softmax(spark, sf_dir):
    """The probability of the third class of three logits, here the first numbers of a vector."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(scores.softmax(F.slice("embedding", 1, 3), 3), 6).alias("entailment"))


# -- training sets -----------------------------------------------------------------------------------------------------

_PHASES = """ph AS (SELECT d.doc_id AS source_idx, 'original' AS variation_type FROM documents d JOIN labels l USING (doc_id) UNION ALL SELECT d.doc_id, 'noise' FROM documents d JOIN labels l USING (doc_id) WHERE d.doc_id % 2 = 0
  UNION ALL SELECT d.doc_id, 'snowflake' FROM documents d JOIN labels l USING (doc_id) WHERE d.doc_id % 2 = 1)"""


def phases(spark, sf_dir):
    """The phases of a training set in one table: anchors (documents with a label), noise of the even ones, snowflakes of the odd ones."""
    anchors = docs(spark, sf_dir).select(F.col("doc_id").alias("source_idx")).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("source_idx")), "source_idx")
    kinds = F.array(F.lit("original"), F.when(F.col("source_idx") % 2 == 0, "noise").otherwise("snowflake"))
    return anchors.select("source_idx", F.explode(kinds).alias("variation_type"))


@query(f"WITH {_PHASES} SELECT variation_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) * 100 // sum(count(*)) OVER () AS BIGINT) AS percent FROM ph GROUP BY variation_type")
def phase_report(spark, sf_dir):
    """Rows of each phase and their whole percentage."""
    counts = phases(spark, sf_dir).groupBy("variation_type").agg(F.count("*").alias("n"))
    return counts.withColumn("all", F.sum("n").over(Window.partitionBy())).select("variation_type", "n", F.expr("n * 100 div all").alias("percent"))  # a row a kind


@query(f"""WITH {_PHASES}, r AS (SELECT *, row_number() OVER (ORDER BY md5('merge:' || source_idx || ':' || variation_type), source_idx, variation_type) AS r, count(*) OVER () AS n FROM ph)
SELECT source_idx, variation_type, CASE WHEN r <= n * 8 // 10 THEN 'train' WHEN r <= n * 8 // 10 + n // 10 THEN 'valid' ELSE 'test' END AS split FROM r""")
def phase_split(spark, sf_dir):
    """The union of all phases split exactly 80, 10 and 10 % in an order of digests, ranked by ranges of them."""
    rows = phases(spark, sf_dir).withColumn("h", F.md5(F.concat_ws(":", F.lit("merge"), "source_idx", "variation_type"))).withColumn("b", F.substring("h", 1, 2))
    sizes = rows.groupBy("b").count()  # 256 rows
    sizes = sizes.withColumns({"before": F.sum("count").over(Window.orderBy("b")) - F.col("count"), "n": F.sum("count").over(Window.partitionBy())})
    rank = F.row_number().over(Window.partitionBy("b").orderBy("h", "source_idx", "variation_type"))
    rows = rows.withColumn("r", rank).join(F.broadcast(sizes.select("b", "before", "n")), "b").withColumn("r", F.col("r") + F.col("before"))
    return rows.select("source_idx", "variation_type", F.when(F.col("r") <= F.expr("n * 8 div 10"), "train").when(F.col("r") <= F.expr("n * 8 div 10 + n div 10"), "valid").otherwise("test").alias("split"))


def _draw(options, key: str) -> str:
    return f"{D.listed(options)}[CAST(floor({_U.format(key)} * {len(options)}) AS BIGINT) + 1]"


_PHASED = _TEXT_SQL["style_tags"]


@query(f"""SELECT d.doc_id, replace(replace({_draw(training.TEMPLATES, "'template:' || d.doc_id")}, '{{author}}', d.source), '{{word_count}}', CAST({D.n_words('d.text')} AS VARCHAR)) || chr(10) || s.phased_tag || chr(10) || c.clean || chr(10) || '###' || chr(10) AS prompt
FROM documents d JOIN ({_PHASED}) s USING (doc_id) JOIN ({_TEXT_SQL['clean_text_chunker']}) c USING (doc_id)""")
def phased_prompts(spark, sf_dir):
    """Prompts of the phased set: a template, the style's tag and the neutral text, here the cleaned one."""
    text = F.col("text")
    prompt = training.phased_prompt(F.col("doc_id").cast("string"), F.col("source"), text, T.clean_chunker(text, normalize_quotes=False), scores.phased_style_tag(text))
    return docs(spark, sf_dir).select("doc_id", prompt.alias("prompt"))


_KIND = f"SELECT doc_id, content_type FROM ({_TEXT_SQL['content_type_lexical']})"
_SKEL = _TEXT_SQL["rhetorical_moves"]
_LINES = ", ".join([*("'[CONSTRAINT]: " + c.replace("'", "''") + "'" for c in training.ALWAYS)] + ["CASE WHEN " + _U.format(f"'frequent{i}:' || d.doc_id") + " < 0.7::DOUBLE THEN '[CONSTRAINT]: " + c.replace("'", "''") + "' END" for i, c in enumerate(training.FREQUENT)] + ["CASE WHEN " + _U.format("'rotate:' || d.doc_id") + " < 0.4::DOUBLE THEN '[CONSTRAINT]: ' || " + _draw(training.ROTATING, "'rotating:' || d.doc_id") + " END"])


@query(f"""SELECT d.doc_id, CASE WHEN k.content_type = 'conceptual' THEN {_draw(training.FRAMES['conceptual'], "'frame:' || d.doc_id")} ELSE {_draw(training.FRAMES['narrative'], "'frame:' || d.doc_id")} END || chr(10) || chr(10) || 'Write approximately ' || {D.n_words('d.text')} || ' words.'
  || CASE WHEN {_U.format("'skeleton:' || d.doc_id")} < 0.5::DOUBLE THEN chr(10) || chr(10) || 'Follow this structure: ' || s.skeleton ELSE '' END || chr(10) || chr(10) || array_to_string(list_filter([{_LINES}], lambda j_: j_ IS NOT NULL), chr(10)) AS instruction
FROM documents d JOIN ({_KIND}) k USING (doc_id) JOIN ({_SKEL}) s USING (doc_id)""")
def persona_instructions(spark, sf_dir):
    text = F.col("text")
    kind = scores.content_type(text)["content_type"]
    return docs(spark, sf_dir).select("doc_id", training.persona_instruction(F.col("doc_id").cast("string"), kind, T.count_words(text), T.rhetorical_skeleton(text)).alias("instruction"))


@query()
def training_examples(spark, sf_dir):
    """Examples of all phases as prompts and completions: anchors perturbed lightly, noise heavily; outputs that bleed half of their words are left out."""
    text, neutral = F.col("text"), F.col("neutral")
    rows = phases(spark, sf_dir).where("variation_type <> 'snowflake'").join(docs(spark, sf_dir).select(F.col("doc_id").alias("source_idx"), "text", "source"), "source_idx")
    rows = rows.withColumn("neutral", folds.text_udf(folds.flattened)(text)).where(gates.lexical_bleed(neutral, text) < 0.999)
    key = F.col("source_idx").cast("string")
    light, heavy = (folds.keyed_udf(lambda t, k, h=h: folds.perturbed(t, k, h))(neutral, key) for h in (False, True))
    rows = rows.withColumn("given", F.when(F.col("variation_type") == "noise", heavy).otherwise(light))
    instruction = training.persona_instruction(key, scores.content_type(text)["content_type"], T.count_words(text), T.rhetorical_skeleton(text))
    return rows.select("source_idx", *training.example("completion", instruction, F.col("given"), text, T.count_words(text), F.col("variation_type")))


@query()
def noise_examples(spark, sf_dir):
    """Phased examples of even documents that have an anchor: the same output for a heavily changed input."""
    rows = phases(spark, sf_dir).where("variation_type = 'noise'").join(docs(spark, sf_dir).select(F.col("doc_id").alias("source_idx"), "text", "source"), "source_idx")
    key, text = F.col("source_idx").cast("string"), F.col("text")
    given = folds.keyed_udf(lambda t, k: folds.perturbed(t, k, True))(text, key)
    rows = rows.withColumn("prompt", training.phased_prompt(key, F.col("source"), text, given, scores.phased_style_tag(text)))
    return rows.select("source_idx", F.concat("prompt", "text").alias("text"), "prompt", T.count_words(text).alias("word_count"), "variation_type")


# -- statistics and small joins ----------------------------------------------------------------------------------------


@query(f"""WITH {_PAIRS}, c AS (SELECT p.doc_id, d.source, {_COVER} AS cover FROM p JOIN (SELECT doc_id, source FROM documents) d ON p.doc_id = d.doc_id)
SELECT source, CAST(count(*) AS BIGINT) AS paragraphs_processed, CAST(count(*) FILTER (cover < 0.1::DOUBLE) AS BIGINT) AS below, round(avg(cover), 3) AS avg_score, round(min(cover), 3) AS least FROM c GROUP BY source""")
def transfer_stats(spark, sf_dir):
    """Pairs of each source, those with under a tenth of their content, and the scores' mean and least."""
    words = docs(spark, sf_dir).select("doc_id", "source", verify.content_words(F.col("text")).alias("words"))
    c = verify.paired(words, words.select((F.col("doc_id") - 1).alias("doc_id"), "words")).select("source", verify.coverage(F.col("words"), F.col("out_words")).alias("cover"))
    return c.groupBy("source").agg(F.count("*").alias("paragraphs_processed"), F.count_if(F.col("cover") < 0.1).alias("below"), F.round(F.avg("cover"), 3).alias("avg_score"), F.round(F.min("cover"), 3).alias("least"))


@query(f"SELECT b.label, CAST(count(*) AS BIGINT) AS accepted, CAST(coalesce(sum({D.tokens(D.n_words('d.text'))}), 0) AS BIGINT) AS tokens FROM ({_CORPUS_SQL['blend_step']}) b LEFT JOIN documents d ON d.doc_id = b.vec_id GROUP BY b.label")
def blend_report(spark, sf_dir):
    """What a step of the blend accepts of each label, and the tokens of its texts."""
    tokens = docs(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), T.estimate_tokens(T.count_words(F.col("text"))).alias("t"))
    return blend_step(spark, sf_dir).join(tokens, "vec_id", "left").groupBy("label").agg(F.count("*").alias("accepted"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"))


@query("SELECT role, CAST(count(*) AS BIGINT) AS calls, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM conversations GROUP BY role")
def usage_totals(spark, sf_dir):
    """Messages of each role and their tokens, estimated by characters."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("calls"), F.sum(T.tokens_from_chars(F.col("text"))).alias("tokens"))


@query(f"""WITH {D.PARAS}, s AS (SELECT doc_id, para_idx, unnest(generate_series(0, len(ss) - 1)) AS k, len(ss) AS n, unnest(ss) AS s FROM (SELECT doc_id, para_idx, {D.sentences('text')} AS ss FROM paras))
SELECT doc_id, para_idx, CAST(k AS INTEGER) AS sent_idx, k = 0 AS para_start, k = n - 1 AS para_end, {D.n_words('s')} AS words FROM s""")
def paragraph_flags(spark, sf_dir):
    """Sentences with whether they begin and end a paragraph."""
    rows = paras(spark, sf_dir).select("doc_id", "para_idx", T.sentences(F.col("text")).alias("ss"))
    return rows.select("doc_id", "para_idx", F.size("ss").alias("n"), F.posexplode("ss").alias("sent_idx", "s")).select("doc_id", "para_idx", "sent_idx", (F.col("sent_idx") == 0).alias("para_start"), (F.col("sent_idx") == F.col("n") - 1).alias("para_end"), T.count_words(F.col("s")).alias("words"))


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def map_rebuild(spark, sf_dir):
    """A map by key of which the last entry wins."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))


@query(f"""WITH {D.PARAS}, z AS (SELECT doc_id, para_idx, unnest(generate_series(0, len(ss) - 1)) AS k, unnest(ss) AS s, unnest(list_transform(ss, lambda s: {_MOVE})) AS move, unnest(list_transform(ss, lambda s_: {D.n_words('s_')})) AS n FROM (SELECT doc_id, para_idx, {D.sentences('text')} AS ss FROM paras))
SELECT doc_id, para_idx, CAST(k AS INTEGER) AS sent_idx, move, n AS words FROM z""")
def positional_zip(spark, sf_dir):
    """Sentences, their moves and lengths put side by side by place."""
    ss = T.sentences(F.col("text"))
    rows = paras(spark, sf_dir).select("doc_id", "para_idx", F.transform(ss, T.rhetorical_move).alias("move"), F.transform(ss, T.count_words).alias("words"))
    return rows.select("doc_id", "para_idx", F.posexplode(F.arrays_zip("move", "words")).alias("sent_idx", "z")).select("doc_id", "para_idx", "sent_idx", "z.move", "z.words")


def _long(x: str) -> str:
    return f"list_filter({_content(x)}, lambda v: length(v) >= 9)"


@query(f"""WITH {_PAIRS}, x AS (SELECT doc_id, unnest({_long('text')}) AS a FROM p), y AS (SELECT doc_id, unnest({_long('other')}) AS b FROM p)
SELECT x.doc_id, a, b FROM x JOIN y ON x.doc_id = y.doc_id AND (starts_with({_stem('a')}, {_stem('b')}) OR starts_with({_stem('b')}, {_stem('a')}))""")
def entity_prefix_matches(spark, sf_dir):
    """Long words of a document and of the next one of which one's stem begins with the other's: joined by document and the stems' first four letters."""
    words = F.filter(verify.content_words(F.col("text")), lambda w: F.char_length(w) >= 9)
    e = docs(spark, sf_dir).select("doc_id", F.explode(words).alias("a")).withColumn("x", verify.entity_stem(F.col("a"))).withColumn("head", F.left("x", F.lit(4)))
    p = e.join(e.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"), F.col("x").alias("y"), "head"), ["doc_id", "head"])
    return p.where(F.startswith("x", F.col("y")) | F.startswith("y", F.col("x"))).select("doc_id", "a", "b")


@query(f"""WITH w AS (SELECT doc_id, {D.words('text')}[1] AS w FROM documents), u AS (SELECT doc_id, w, upper(w) = w AND lower(w) <> w AS up, upper(left(w, 1)) = left(w, 1) AND lower(left(w, 1)) <> left(w, 1) AS cap FROM w WHERE w IS NOT NULL)
SELECT doc_id, CASE WHEN up THEN 'PLAINER' WHEN cap THEN 'Plainer' ELSE 'plainer' END AS replaced FROM u""")
def matched_case(spark, sf_dir):
    """A replacement in the case of each document's first word."""
    first = F.try_element_at(T.words(F.col("text")), F.lit(1))
    return docs(spark, sf_dir).select("doc_id", first.alias("w")).where("w is not null").select("doc_id", T.match_case(F.col("w"), F.lit("plainer")).alias("replaced"))


_TOKENS = r"regexp_extract_all(s, '[\p{L}\p{N}_]+(?:''[\p{L}\p{N}_]+)?|[^\p{L}\p{N}_\s]')"


@query(f"""WITH s AS (SELECT doc_id, list_transform({D.sentences('text')}, lambda s: {_TOKENS}) AS ts FROM documents), n AS (SELECT doc_id, ts, list_transform(ts, lambda t: len(t)) AS ls FROM s WHERE len(ts) >= 2),
  st AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(list_transform(list_filter(ts, lambda t: len(t) >= 2), lambda t: lower(t[1]) || ' ' || lower(t[2]))) AS w FROM n) GROUP BY ALL HAVING count(*) >= 2),
  g AS (SELECT doc_id, array_to_string(list('''' || w || ''' (' || c || 'x)' ORDER BY c DESC, w), ', ') AS starters FROM st GROUP BY doc_id)
SELECT n.doc_id, round(coalesce({D.std_pop('ls')} / nullif({D.mean('ls')}, 0), 0), 6) AS length_variation, coalesce(starters, '') AS starters FROM n LEFT JOIN g ON g.doc_id = n.doc_id""")
def sentence_variety(spark, sf_dir):
    """How much a document's sentences vary in tokens, and the pairs of tokens that begin two of them or more."""
    tokens = lambda s: F.regexp_extract_all(s, F.lit(training._TOKEN), 1)
    rows = docs(spark, sf_dir).select("doc_id", F.transform(T.sentences(F.col("text")), tokens).alias("ts")).where(F.size("ts") >= 2)
    lengths = F.transform("ts", lambda t: F.size(t).cast("long"))
    variation = F.coalesce(F.try_divide(T.std_pop(lengths), T.mean(lengths)), F.lit(0.0))
    starter = F.transform(F.filter("ts", lambda t: F.size(t) >= 2), lambda t: F.concat(F.lower(t[0]), F.lit(" "), F.lower(t[1])))
    counts = rows.select("doc_id", F.explode(starter).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("c")).where("c >= 2")
    own = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("n"), "w")))
    said = F.array_join(F.transform(own, lambda x: F.concat(F.lit("'"), x["w"], F.lit("' ("), (-x["n"]).cast("string"), F.lit("x)"))), ", ")
    counts = counts.groupBy("doc_id").agg(said.alias("starters"))
    return rows.select("doc_id", F.round(variation, 6).alias("length_variation")).join(counts, "doc_id", "left").fillna("", ["starters"])


@query()
def trackable_words(spark, sf_dir):
    """Words worth counting for repetition, by the rules annotator, with how often a document has them, from three on."""
    t = training.trackable(providers.provided("annotate", "rules", F.col("text")))
    rows = docs(spark, sf_dir).select("doc_id", F.explode(F.transform(t, lambda x: F.lower(x["text"]))).alias("word"))
    return rows.groupBy("doc_id", "word").agg(F.count("*").alias("n")).where("n >= 3")


@query()
def opening_patterns(spark, sf_dir):
    """The fifteen most frequent openings of a source's sentences by three parts of speech, and their share."""
    openings = F.transform(F.slice(providers.provided("annotate", "rules", F.col("s")), 1, 3), lambda t: t["pos"])
    rows = docs(spark, sf_dir).select("source", F.explode(T.sentences(F.col("text"))).alias("s")).select("source", F.array_join(openings, " ").alias("pattern"))
    counts = rows.groupBy("source", "pattern").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source")  # a row a pattern
    ranked = counts.withColumns({"r": F.row_number().over(w.orderBy(F.desc("n"), "pattern")), "freq": F.col("n") / F.sum("n").over(w)})
    return ranked.where("r <= 15").select("source", "pattern", "n", F.round("freq", 6).alias("freq"))


@query()
def persona_frames(spark, sf_dir):
    """Frames of a persona file that each source's name fills, by section and place."""
    content = "\n".join(f"[PERSONA_FRAMES_{k.upper()}]\n" + "\n---\n".join(f"{{author}}: {f}" for f in fs) for k, fs in training.FRAMES.items())
    rows = docs(spark, sf_dir).select("source").distinct().select("source", F.inline(rendering.frames(F.lit(content))))
    return rows.withColumn("frame", rendering.filled(F.col("frame"), {"author": F.coalesce("source", F.lit("unknown"))}))
