"""Training sets: instructions, prompts, examples, incomplete sentences and clean-up of paragraphs, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.providers import CLOSED

#: Prompts of the phased set, and the constraints of instructions: those that always stand, those that stand in 70 %, and those of which one stands in 40 %; fixed values.
TEMPLATES = (
    "Rewrite in {author}'s style (~{word_count} words):",
    "Transform this text into {author}'s voice (~{word_count} words):",
    "Convert to {author}'s style (~{word_count} words):",
    "Apply {author}'s style (~{word_count} words):",
    "Rewrite the following in {author}'s voice (~{word_count} words):",
    "Style transfer to {author} (~{word_count} words):",
)
ALWAYS = (
    "Do not use: 'Moreover', 'Furthermore', 'Therefore', 'Thus', 'Hence', 'In conclusion', 'It is important to note', 'It is worth noting', 'This highlights', 'This underscores', 'In essence', 'Ultimately'.",
    "Do not hedge. Avoid: 'arguably', 'it could be said', 'one might argue', 'perhaps it is', 'it seems that'. State things directly.",
)
FREQUENT = (
    "Do not start with a topic sentence. Start with a sensory detail, a question, or mid-thought.",
    "Do not use numbered lists or 'Firstly/Secondly/Thirdly' structures.",
)
ROTATING = (
    "Use fragments. Interrupt yourself with dashes (—).",
    "Let ideas collide without transition words.",
    "Do not explain. Imply.",
    "Use at least one rhetorical question.",
    "Interrupt yourself with a parenthetical thought.",
    "Start the paragraph with a conjunction (But, And, Yet, So).",
    "Be biased. Be opinionated. Do not balance your argument.",
    "Vary sentence lengths dramatically. Follow a long sentence with a short one.",
    "Use concrete nouns instead of abstractions. Not 'the concept' but the thing itself.",
    "End on an image or action, not a summary.",
)
#: Frames by kind of content; a persona file (`rendering.frames`) brings others.
FRAMES = {
    "narrative": ("Tell what happened, in order, to someone who was not there.", "Set the events down as a witness would, hours later."),
    "conceptual": ("Explain how the thing works, part by part.", "State the idea first and then what follows from it."),
}


def drawn(options: tuple[str, ...], *key: Column | str) -> Column:
    """One of the options, by a digest of the key."""
    at = F.floor(T.portable_uniform(*key) * len(options)).cast("int") + 1
    return F.element_at(F.array(*map(F.lit, options)), at)


def persona_instruction(key: Column, content_type: Column, n_words: Column, skeleton: Column) -> Column:
    """Frame, length, in half of the cases a skeleton, and constraints, drawn by digests of the key."""
    frame = F.when(content_type == "conceptual", drawn(FRAMES["conceptual"], F.lit("frame"), key)).otherwise(drawn(FRAMES["narrative"], F.lit("frame"), key))
    some = [F.when(T.portable_uniform(F.lit(f"frequent{i}"), key) < 0.7, F.lit(c)) for i, c in enumerate(FREQUENT)]
    one = F.when(T.portable_uniform(F.lit("rotate"), key) < 0.4, drawn(ROTATING, F.lit("rotating"), key))
    lines = F.transform(F.array_compact(F.array(*map(F.lit, ALWAYS), *some, one)), lambda c: F.concat(F.lit("[CONSTRAINT]: "), c))
    structure = F.when(T.portable_uniform(F.lit("skeleton"), key) < 0.5, F.concat(F.lit("\n\nFollow this structure: "), skeleton)).otherwise("")
    return F.concat(frame, F.lit("\n\nWrite approximately "), n_words.cast("string"), F.lit(" words."), structure, F.lit("\n\n"), F.array_join(lines, "\n"))


def phased_prompt(key: Column, author: Column, styled: Column, neutral: Column, tag: Column) -> Column:
    """An instruction of the templates, the style's tag and the neutral text."""
    instruction = F.replace(F.replace(drawn(TEMPLATES, F.lit("template"), key), F.lit("{author}"), author), F.lit("{word_count}"), T.count_words(styled).cast("string"))
    return F.concat(instruction, F.lit("\n"), tag, F.lit("\n"), neutral, F.lit("\n###\n"))


def example(shape: str, instruction: Column, given: Column, styled: Column, n_words: Column, kind: Column) -> list[Column]:
    """The columns of a training example: `instruct` has instruction, input and output; `completion` has text, prompt, word_count and variation_type."""
    if shape == "instruct":
        return [instruction.alias("instruction"), given.alias("input"), styled.alias("output")]
    prompt = F.concat(instruction, F.lit("\n\n"), given, F.lit("\n###\n"))
    return [F.concat(prompt, styled).alias("text"), prompt.alias("prompt"), n_words.alias("word_count"), kind.alias("variation_type")]


_TOKEN = r"([\p{L}\p{N}_]+(?:'[\p{L}\p{N}_]+)?|[^\p{L}\p{N}_\s])"
_WORD = r"([\p{L}\p{N}_]+(?:'[\p{L}\p{N}_]+)?)"
#: Words that a sentence doesn't end with: determiners, prepositions, conjunctions, auxiliaries and particles.
OPEN_ENDED = tuple(sorted(w for w, pos in CLOSED.items() if pos in ("DET", "ADP", "CCONJ", "SCONJ", "AUX", "PART")))
AUXILIARIES = tuple(sorted(w for w, pos in CLOSED.items() if pos == "AUX"))


#: A verb among words joined by blanks, as the rules annotator tags: an auxiliary, or a word in -ing or -ed that isn't a name.
_ENDED = "|".join(w for w in CLOSED if w.endswith("ing") and len(w) > 5 or w.endswith("ed") and len(w) > 4)
_VERB = rf"(?<![^ ])(?:(?i:{'|'.join(AUXILIARIES)})|(?:(?<!.)|(?!\p{{Lu}}))(?!(?i:{_ENDED})(?![^ ]))[^ ]{{3,}}(?i:ing|ed))(?![^ ])"


def incomplete(sentence: Column) -> Column:
    """Why a sentence is incomplete, by the rules annotator's tags: `dash`, `open_end`, `no_verb` (four words and more), `no_stop` (more than three), or the empty string."""

    def rule(s: Column, ws: Column) -> Column:
        last = F.lower(F.try_element_at(ws, F.lit(-1)))
        verbs = F.replace(F.array_join(ws, " "), F.lit("İ"), F.lit("I\u0307")).rlike(_VERB)  # as long as in lower case
        stopped = s.rlike(r"""[.!?;:"'“”‘’]\z""")
        found = F.when(F.size(ws) == 0, "").when(s.rlike("[—-]\\z"), "dash").when(last.isin(*OPEN_ENDED), "open_end")
        return found.when(F.size(ws) >= 4, F.when(~verbs, "no_verb").when(~stopped, "no_stop")).otherwise("")

    read = lambda s: T.let(F.regexp_extract_all(s, F.lit(_WORD), 1), lambda ws: F.coalesce(rule(s, ws), F.lit("")))
    return T.let(T.strip(T.given(sentence)), read)


def _once(ss: Column) -> Column:
    """Sentences without those that came before in any case: sorted, each is compared with the one before it."""
    keyed = F.array_sort(F.transform(ss, lambda s, i: F.struct(F.lower(s).alias("low"), i.alias("i"), s.alias("s"))))
    first = lambda x, i, xs: (i == 0) | (F.get(xs, i - 1)["low"] != x["low"])
    kept = T.let(keyed, lambda xs: F.filter(xs, lambda x, i: first(x, i, xs)))
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["i"], x["s"]))), lambda x: x["s"])


def tidied(text: Column) -> Column:
    """A paragraph without an incomplete end (one that only lacks its stop may stay) and without repeated sentences. Null where
    nothing can be kept."""

    def by_sentences(ss: Column) -> Column:
        return T.let(F.when(F.size(ss) > 0, incomplete(F.element_at(ss, -1))).otherwise(""), lambda why: by_end(ss, ~why.isin("", "no_stop")))

    def by_end(ss: Column, bad: Column) -> Column:
        stopped = F.when(T.count_words(text) > 10, F.array(F.concat(text, F.lit("."))))
        whole = T.let(F.when(bad, F.filter(ss, lambda s: incomplete(s) == "")).otherwise(ss), lambda w: F.when(~bad | (F.size(w) > 0), w).otherwise(stopped))
        return T.let(whole, lambda cut: by_cut(cut, bad))

    def by_cut(cut: Column, bad: Column) -> Column:
        distinct = F.size(F.array_distinct(F.transform(cut, F.lower)))
        return F.when(distinct < F.size(cut), F.array_join(_once(cut), " ")).when(bad, F.array_join(cut, " ")).when(cut.isNotNull(), text)

    return T.let(T.sentences(text), by_sentences)


def cleaned_paragraphs(paras: DataFrame) -> DataFrame:
    """doc_id, para_idx, text: of paragraphs with the same first 50 characters the longest, at the first one's place, as it is if it
    came later; the others tidied."""
    w = Window.partitionBy("doc_id", F.lower(F.left("text", F.lit(50))))
    rows = paras.withColumns({"r": F.row_number().over(w.orderBy(F.char_length("text").desc(), "para_idx")), "place": F.min("para_idx").over(w)}).where("r = 1")
    text = F.when(F.col("para_idx") != F.col("place"), F.col("text")).otherwise(tidied(F.col("text")))
    return rows.select("doc_id", F.col("place").alias("para_idx"), text.alias("text")).where("text is not null")


#: Concrete nouns that an abstract text has a mark for; fixed values.
CONCRETE = """
    house car tree door window table chair book phone computer screen keyboard mouse desk floor wall ceiling room building
    street road city town village country mountain river lake ocean sea forest field garden hand face eye head body arm leg
    foot finger sun moon star sky cloud rain snow wind fire water earth stone rock metal wood glass paper food bread meat
    fruit vegetable drink wine beer man woman child person people animal dog cat bird machine engine wheel tool weapon knife
    gun sword
""".split()


def _spelled(tokens: Column) -> Column:
    return T.strip(T.sub(F.array_join(tokens, " "), (r"\s+([.,!?;:])", "$1"), (r"\s+", " ")))


def without_modifiers(tokens: Column) -> Column:
    """The text of annotated tokens without adjectives and adverbs."""
    return _spelled(F.transform(F.filter(tokens, lambda t: ~t["pos"].isin("ADJ", "ADV")), lambda t: t["text"]))


def abstracted(tokens: Column) -> Column:
    """The text of annotated tokens with [THING] for concrete nouns."""
    return _spelled(F.transform(tokens, lambda t: F.when((t["pos"] == "NOUN") & F.lower(t["text"]).isin(*CONCRETE), "[THING]").otherwise(t["text"])))


def trackable(tokens: Column) -> Column:
    """Tokens whose repetition is worth counting: nouns, verbs, adjectives and adverbs of four letters or more."""
    return F.filter(tokens, lambda t: t["pos"].isin("NOUN", "VERB", "ADJ", "ADV") & (F.char_length(t["text"]) >= 4) & t["text"].rlike(r"\A\p{L}+\z"))
