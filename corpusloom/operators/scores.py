"""Style and quality scores as Column expressions over a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: Words that a rare-word bonus doesn't count; fixed values.
ORDINARY = """
    the and that have for not with you this but his from they were been their would there which could other into more
    about through between because something everything anything nothing however although therefore whatever
""".split()

#: Subordinating words; fixed values.
CLAUSE_WORDS = "which whom whose where when while although though because since unless until whereas whereby wherein whereupon".split()

#: Words and phrases of a dark, archaic manner; fixed values.
DARK_WORDS = """
    eldritch cyclopean non-euclidean blasphemous nameless unnameable gibbous squamous rugose foetid antediluvian charnel
    daemon daemonic accursed hellish loathsome hideous abhorrent grotesque monstrous abysmal stygian phantasmal spectral
    preternatural abnormal unnatural indescribable unutterable ineffable cosmic immemorial aeons eons primordial
    prehistoric archaic ancient forgotten forbidden dreaded feared terrible horror terror dread fear madness insanity
    nightmare betwixt whilst amidst amongst wherefore hitherto thence hence thereof wherein whereby
""".split()
DARK_PHRASES = ("beyond the .{1,20} of", "in the .{1,20} depths", "from .{1,20} aeons", "the .{1,20} horror", "nameless .{1,20}", "unutterable .{1,20}", "cosmic .{1,20}")

CONNECTIVES = ("however", "although", "yet", "moreover", "furthermore", "nevertheless", "whilst", "whereas")
BANNED = ("furthermore", "moreover", "additionally", "in conclusion", "conversely", "notably", "consequently", "subsequently")


def _capped(x: Column) -> Column:
    return F.least(F.lit(1.0), x)


def vocabulary_richness(text: Column) -> Column:
    """Distinct words over words, with a bonus for long ones; 0 below ten words."""

    def score(ws: Column, distinct: Column) -> Column:
        rare = F.filter(distinct, lambda w: (F.char_length(w) > 8) & ~w.isin(*ORDINARY))
        rich = F.try_divide(F.size(distinct), F.size(ws)) * 0.6 + F.try_divide(F.size(rare), F.greatest(F.size(distinct), F.lit(1))) * 0.4 + 0.2
        return F.when(F.size(ws) < 10, 0.0).otherwise(_capped(rich))

    plain = F.filter(T.word_tokens(text), lambda w: w.rlike(r"\A[a-z]+\z"))
    return T.let(plain, lambda ws: T.let(F.array_distinct(ws), lambda distinct: score(ws, distinct)))


def syntax_complexity(text: Column) -> Column:
    """Spread of sentence lengths, clause marks and subordinating words."""
    parts = F.filter(F.transform(T.terminated(text), T.strip), lambda s: s != "")
    marks = _capped(F.regexp_count(T.given(text), F.lit("[;:—–()]")) / 10)
    clauses = _capped(F.size(F.filter(T.word_tokens(text), lambda w: w.isin(*CLAUSE_WORDS))) / 5)

    def score(lengths: Column) -> Column:
        spread = F.when(F.size(lengths) < 2, 0.3).otherwise(_capped(T.std_pop(lengths) / 20))
        return F.when(F.size(lengths) == 0, 0.0).otherwise(spread * 0.3 + marks * 0.3 + clauses * 0.4)

    return T.let(F.transform(parts, T.count_words), score)


def style_markers(text: Column) -> Column:
    low = F.lower(T.given(text))
    vocabulary = _capped(T.count_contained(low, DARK_WORDS) / 5)
    mood = F.lit(0)
    for p in DARK_PHRASES:
        mood = mood + low.rlike(p).cast("int")
    own = F.size(F.filter(F.regexp_extract_all(T.given(text), F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: w.isin("I", "my", "me", "myself")))
    first = T.let(own, lambda n: F.when(n > 0, _capped(n / 10)).otherwise(0.3))
    stress = _capped(F.regexp_count(T.given(text), F.lit(r"!|—|\.{3}")) / 5)
    return vocabulary * 0.4 + _capped(mood / 3) * 0.3 + first * 0.15 + stress * 0.15


def quality_score(vocabulary: Column, syntax: Column, style: Column) -> Column:
    return vocabulary * 0.30 + syntax * 0.35 + style * 0.35


def style_metrics(text: Column) -> dict[str, Column]:
    """The five of seven metrics that need no parser; the other two are null here, and come with an annotator."""
    lengths, ws = T.sentence_lengths(text), T.words(text)
    n = F.size(ws)
    letters = F.aggregate(F.transform(ws, lambda w: F.char_length(F.regexp_replace(w, r"""^[.,;:!?"'()\-—]+|[.,;:!?"'()\-—]+$""", "")).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    marks = F.regexp_count(T.given(text), F.lit(r"[;:—\-–,]"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return {
        "avg_sentence_length": zero(T.mean(lengths)),
        "sentence_length_std": zero(T.std_pop(lengths)),
        "punctuation_density": F.when(n > 0, F.try_divide(marks, n) * 100).otherwise(0.0),
        "avg_word_length": zero(F.try_divide(letters, n)),
    }


#: Weights of the metrics in a structural distance; fixed values.
DISTANCE_WEIGHTS = {"avg_sentence_length": 0.25, "sentence_length_std": 0.15, "dependency_depth": 0.20, "adjective_ratio": 0.15, "verb_ratio": 0.10, "punctuation_density": 0.10, "avg_word_length": 0.05}


def structural_distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Weighted relative differences; a metric that a side lacks counts as 0."""
    total = F.lit(0.0)
    for name, weight in DISTANCE_WEIGHTS.items():
        x, y = (F.coalesce(m.get(name, F.lit(0.0)), F.lit(0.0)) for m in (a, b))
        total = total + weight * (F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0)))
    return total


def burstiness(lengths: Column) -> Column:
    """Standard deviation over mean of sentence lengths; 0 below two sentences or without words."""
    share = lambda v: T.let(T.mean(v), lambda m: F.when((F.size(v) < 2) | (m == 0), 0.0).otherwise(F.try_divide(T.std_pop(v), m)))
    return T.let(lengths, share)


def length_category(n: Column) -> Column:
    return F.when(n.between(1, 4), "FRAGMENT").when(n.between(5, 10), "SHORT").when(n.between(11, 20), "MEDIUM").when(n.between(21, 35), "LONG").otherwise("VERY_LONG")


def _length_tag(lengths: Column) -> Column:
    return T.let(lengths, _tag_of)


def _tag_of(lengths: Column) -> Column:
    return F.when(T.mean(lengths) < 12, "Short & Punchy").when(T.mean(lengths) > 25, "Long & Flowing").when(T.std_pop(lengths) > 8, "Varied Lengths").otherwise("Medium Length")


def style_tag(text: Column) -> Column:
    lengths, given = T.sentence_lengths(text), T.given(text)
    marked = T.contains_any(given, ";", "—", "--", ":", "(", ")")
    kind = F.when(marked & T.contains_any(F.lower(given), *CONNECTIVES), "Baroque Syntax").when(marked, "Complex Syntax").otherwise("Simple Syntax")
    tag = F.concat(F.lit("[STYLE: "), _length_tag(lengths), F.lit(" | "), kind, F.lit("]"))
    return F.when(F.size(lengths) == 0, "[STYLE: Medium Length | Simple Syntax]").otherwise(tag)


def phased_style_tag(text: Column) -> Column:
    lengths = F.transform(F.split(T.given(text), rf"(?<=[.!?]){T.WS}+"), T.count_words)
    kind = F.when(T.contains_any(T.given(text), ";", "—", "--", ":", "(", ")"), "Complex Syntax").otherwise("Simple Syntax")
    return F.concat(F.lit("[STYLE: "), _length_tag(lengths), F.lit(" | "), kind, F.lit("]"))


def output_analysis(text: Column) -> dict[str, Column]:
    lengths, low = T.sentence_lengths(text), F.lower(T.given(text))
    found = F.filter(F.array(*map(F.lit, BANNED)), lambda b: F.contains(low, b))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return {
        "word_count": T.count_words(text),
        "sentence_count": F.size(lengths).cast("long"),
        "avg_sentence_length": F.bround(F.coalesce(T.mean(lengths), F.lit(0.0)), 1),
        "sentence_length_std": F.bround(F.when(F.size(lengths) > 1, T.std_pop(lengths)).otherwise(0.0), 1),
        "min_sentence": zero(F.array_min(lengths)),
        "max_sentence": zero(F.array_max(lengths)),
        "banned_transitions": F.array_join(found, ","),
        "dashes": (F.regexp_count(T.given(text), F.lit("—")) + F.regexp_count(T.given(text), F.lit("--"))).cast("long"),
        "semicolons": F.regexp_count(T.given(text), F.lit(";")).cast("long"),
    }


def tone(text: Column) -> Column:
    low = F.lower(T.given(text))
    return (
        F.when(T.contains_any(low, "research", "study", "analysis", "findings", "hypothesis"), "academic")
        .when(T.contains_any(low, "therefore", "furthermore", "consequently", "thus", "hence"), "formal")
        .when(T.contains_any(low, "you", "we", "i", "let's", "here's"), "conversational")
        .otherwise("neutral")
    )


def intent(text: Column) -> Column:
    """Explanatory if over a fifth of the sentences ask; imperatives need an annotator."""
    s = T.sentences(text)
    return F.when(F.size(F.filter(s, lambda x: F.endswith(x, F.lit("?")))) > F.size(s) * 0.2, "explanatory").otherwise("informative")


#: Words that tell a story or a concept; fixed values.
TEMPORAL = "then after before when while during later earlier soon finally eventually suddenly once".split()
SEQUENCE = "first second third next finally began started ended".split()
CONCEPTUAL = """
    concept theory mechanism process system principle function method approach technique structure pattern relationship
    connection effect cause result factor element component aspect nature essence phenomenon
""".split()
DEFINITIONS = ("is defined as", "refers to", "means that", "is called", "can be described as", "is characterized by", "consists of")


def content_type(text: Column, entities: Column | None = None, past: Column | None = None, present: Column | None = None, narrative_by_default: bool = True) -> dict[str, Column]:
    """Points for narrative and concept, and the type, which needs a lead of two. entities, past, present: counts of an
    annotator; without them only words count."""
    low = F.lower(T.given(text))
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    when = T.count_contained(padded, [f" {w} " for w in TEMPORAL])
    story = F.least(when, F.lit(3)) + F.least(T.count_contained(low, SEQUENCE), F.lit(2))
    idea = F.least(T.count_contained(low, CONCEPTUAL) * 2, F.lit(4)) + F.when(T.contains_any(low, *DEFINITIONS), 3).otherwise(0)
    idea = idea + F.when(low.rlike(r"\A(it is|there are|there is|this is|these are)"), 1).otherwise(0)
    if entities is not None:
        story = story + F.when(entities >= 2, 3).when(entities >= 1, 1).otherwise(0)
    if past is not None:
        story = story + F.when(past >= 5, 2).when(past >= 2, 1).otherwise(0)
    if present is not None:
        idea = idea + F.least(present, F.lit(2))
    kind = F.when(story > idea + 1, "narrative").when(idea > story + 1, "conceptual").otherwise("narrative" if narrative_by_default else "conceptual")
    return {"narrative_points": story.cast("long"), "conceptual_points": idea.cast("long"), "content_type": kind}


def overall_score(grounded: Column, content: Column, entity: Column, hallucinated: Column, fabricated: Column) -> Column:
    """Verification score from the three coverage ratios and the counts of what isn't in the source."""
    penalty = F.least(F.lit(0.5), 0.15 * hallucinated) + F.least(F.lit(0.3), 0.1 * fabricated)
    return F.greatest(F.lit(0.0), 0.4 * grounded + 0.3 * content + 0.3 * entity - penalty)


def generation_budgets(n_words: Column) -> dict[str, Column]:
    """Token limits of the three kinds of requests for a text of so many words."""
    return {
        "styled": F.greatest(F.lit(150), F.floor(n_words * 2.5)).cast("long"),
        "generated": F.greatest(F.lit(100), F.floor(n_words * 2 * 1.3)).cast("long"),
        "neutral": F.least(n_words * 2, F.lit(512)).cast("long"),
    }


def softmax(logits: Column, k: int) -> Column:
    """The probability of the k-th of the classes, from 1, that logits have."""
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double")))
    return F.exp(F.element_at(logits, k).cast("double")) / total
