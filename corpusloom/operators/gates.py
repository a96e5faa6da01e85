"""Quality gates over paragraphs. Each adds the code of the first rule that fails (`ok` if none does) and its detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def paragraph_rows(docs: DataFrame) -> DataFrame:
    """doc_id, author, para_idx, text of `documents`; the author is the source."""
    return docs.select("doc_id", F.col("source").alias("author"), F.posexplode(T.paragraphs(F.col("text"))).alias("para_idx", "text"))


def _bare(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"""^[.,!?;:'"]+|[.,!?;:'"]+$""", "")


def _most_frequent(ws: Column) -> Column:
    """The count of the most frequent word longer than three characters: the longest run of the sorted words. 0 where no word can be
    there more than five times, which is what the gates ask."""
    bare = F.filter(F.transform(F.filter(ws, lambda w: F.char_length(w) > 3), _bare), lambda w: F.char_length(w) > 3)
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, w: Column) -> Column:
        run = F.when(a["last"] == w, a["run"] + 1).otherwise(1)
        return F.struct(w.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return T.let(bare, lambda b: F.when(F.size(b) - F.size(F.array_distinct(b)) >= 5, F.aggregate(F.array_sort(b), start, step, lambda a: a["best"])).otherwise(0))


def measured(paras: DataFrame, allowed: str, min_words: int) -> DataFrame:
    """What the gates look at, once a paragraph; of one with too few words, only how many. allowed: characters that aren't special,
    as the inside of a class."""
    text, long = F.col("text"), F.col("n_words") >= min_words
    rows = paras.withColumn("ws", T.words(text)).withColumn("n_words", F.size("ws").cast("long"))
    rows = rows.withColumn("bits", F.when(long, F.transform(F.split(T.strip(text), "[.!?]+"), lambda s: F.size(T.words(s)))))
    return rows.withColumns({
        "broken": long & F.regexp_replace(text, "[—–‘’“”…]", "").rlike(r"[^\x00-\x7F]{3,}"),
        "special_ratio": F.when(long, F.char_length(F.regexp_replace(text, f"[{allowed}]", "")) / F.greatest(F.char_length(text), F.lit(1))),
        "n_parts": F.size("bits"),
        "n_complete": F.size(F.filter("bits", lambda n: n >= 3)),
        "n_fragments": F.size(F.filter("bits", lambda n: (n >= 1) & (n < 3))),
        "max_freq": F.when(long, _most_frequent(F.col("ws"))),
    })


def load_gate(paras: DataFrame, min_words: int = 30) -> DataFrame:
    """Adds n_words and reason: too_short, encoding_artifacts, special_chars, incomplete, repetitive or ok."""
    m = measured(paras, r"""a-zA-Z0-9\s.,!?;:'"()\-—–""", min_words)
    reason = (
        F.when(F.col("n_words") < min_words, "too_short")
        .when(F.col("broken"), "encoding_artifacts")
        .when(F.col("special_ratio") > 0.1, "special_chars")
        .when(F.col("n_complete") < 1, "incomplete")
        .when((F.col("max_freq") > F.col("n_words") * 0.15) & (F.col("max_freq") > 5), "repetitive")
        .otherwise("ok")
    )
    return m.select(*paras.columns, "n_words", reason.alias("reason"))


def curate_gate(paras: DataFrame, min_words: int = 40) -> DataFrame:
    """Adds n_words, code (too_short, encoding, special_chars, few_sentences, fragments, repetition or ok) and detail."""
    m = measured(paras, r"""a-zA-Z0-9\s.,!?;:'"()\-""", min_words)
    code = (
        F.when(F.col("n_words") < min_words, "too_short")
        .when(F.col("broken"), "encoding")
        .when(F.col("special_ratio") > 0.1, "special_chars")
        .when(F.col("n_complete") < 2, "few_sentences")
        .when(F.col("n_fragments") > F.col("n_parts") * 0.5, "fragments")
        .when((F.col("max_freq") > F.col("n_words") * 0.15) & (F.col("max_freq") > 5), "repetition")
        .otherwise("ok")
    )
    detail = F.when(F.col("code") == "too_short", F.concat(F.col("n_words").cast("string"), F.lit(" words")))
    return m.select(*paras.columns, "n_words", code.alias("code")).withColumn("detail", detail)


def training_gate(paras: DataFrame, min_words: int = 100, max_words: int = 650, min_sentences: int = 2, max_special: float = 0.10, max_repetition: float = 0.55) -> DataFrame:
    """Adds n_words and code: too_short, too_long, few_sentences, special_chars, repetition or ok."""
    text = F.col("text")
    ws = T.words(F.lower(text))
    n, distinct = F.size(ws), F.size(F.array_distinct(ws))
    special = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]")) / F.greatest(F.char_length(text), F.lit(1))
    repetition = F.when(n < 10, 0.0).otherwise(1 - F.try_divide(distinct, n))
    code = (
        F.when(n < min_words, "too_short")
        .when(n > max_words, "too_long")
        .when(F.size(T.sentences(text)) < min_sentences, "few_sentences")
        .when(special > max_special, "special_chars")
        .when(repetition > max_repetition, "repetition")
        .otherwise("ok")
    )
    return paras.select(*paras.columns, n.cast("long").alias("n_words"), code.alias("code"))


def funnel(gated: DataFrame, code: str, *by: str) -> DataFrame:
    """Paragraphs, words and estimated tokens by outcome, and the share of paragraphs in percent."""
    counts = gated.groupBy(*by, code).agg(F.count("*").alias("n_paragraphs"), F.sum("n_words").alias("n_words"), F.sum(T.estimate_tokens(F.col("n_words"))).alias("n_tokens"))
    return counts


def selection_paragraphs(docs: DataFrame, min_words: int = 80, max_words: int = 600) -> DataFrame:
    """Paragraphs fit for selection: of the wanted length, not heading-like, few special characters; inner white space is one blank."""
    paras = docs.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("para_idx", "raw"))
    paras = paras.select("doc_id", "para_idx", T.strip(F.regexp_replace("raw", f"{T.WS}+", " ")).alias("text"))
    n = T.count_words(F.col("text"))
    heading = F.col("text").rlike(r"\A(Chapter|Part|Section|[IVXLC]+\.?\s*$|[A-Z][A-Z\s]+$)")
    special = F.char_length(F.regexp_replace("text", r"""[a-zA-Z0-9\s.,;:!?'"()\-—]""", "")) / F.char_length("text")
    return paras.withColumn("n_words", n).where(F.col("n_words").between(min_words, max_words) & ~heading & (special <= 0.05))


#: Words too common to tell texts apart; fixed values.
COMMON_WORDS = """
    the and of to a in is that for it was with as be on not this but by from or have an they which one you were her all
    she there would their we him been has when who will more if no out so said what up its about into than them can only
    other new some could time these two may then do first any my now such like our over man me even most made after also
    did many before must through back years where much your way well down should because each just those people how too
    little state good very make world still own see men work long get here between both life being under never day same
    another know while last might us great old year
""".split()


def lexical_bleed(neutral: Column, styled: Column) -> Column:
    """The share of the styled text's uncommon words that the neutral one has too; 0 if there are none."""
    common = F.array(*map(F.lit, COMMON_WORDS))
    distinct = lambda t: F.array_distinct(T.words(F.lower(t)))
    own = F.array_except(distinct(styled), common)
    return T.let(own, lambda o: F.when(F.size(o) == 0, 0.0).otherwise(F.try_divide(F.size(F.array_intersect(o, distinct(neutral))), F.size(o))))


def topic_variation_ok(original: Column, varied: Column) -> Column:
    """At most 20 % more or fewer words, one sentence more or fewer, and 85 % of the original's words."""
    n, m = T.count_words(original), T.count_words(varied)
    distinct = lambda t: F.array_distinct(T.words(F.lower(t)))
    kept = F.try_divide(F.size(F.array_intersect(distinct(original), distinct(varied))), F.size(distinct(original)))
    sentences = F.abs(F.size(T.sentences(original)) - F.size(T.sentences(varied)))
    return (n > 0) & (F.abs(n - m) <= 0.2 * n) & (sentences <= 1) & (F.coalesce(kept, F.lit(0.0)) <= 0.85)


def perspective_variation_ok(original: Column, varied: Column) -> Column:
    n, m = T.count_words(original), T.count_words(varied)
    return (n > 0) & (F.abs(n - m) <= 0.15 * n) & (F.size(T.sentences(original)) == F.size(T.sentences(varied)))


def pair_length_ok(neutral: Column, styled: Column) -> Column:
    n, m = T.count_words(neutral), T.count_words(styled)
    return (m >= 0.5 * n) & (m <= 3.0 * n)


def round_trip_ok(source: Column, output: Column) -> Column:
    """Ten characters and three words at least, no Chinese characters, and a length within twice (of short texts) or three times."""
    n, m = T.count_words(source), T.count_words(output)
    most = F.when(n < 100, 1.0).otherwise(2.0) * n
    return (F.char_length(T.strip(T.given(output))) >= 10) & ~T.given(output).rlike(r"[\x{4e00}-\x{9fff}]") & (m >= 3) & (F.abs(n - m) <= most)
