"""Text primitives as Column expressions: cleaning, splitting, counting, tagging.

White space is space, tab, newline, carriage return and form feed throughout. A null text gives what an empty one gives,
unless a function says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

WS = r"[ \t\n\r\f]"


def let(x: Column, f) -> Column:
    """f of x, with x evaluated once however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def given(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def sub(text: Column, *rules: tuple[str, str]) -> Column:
    """Regular expressions replaced one after another."""
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def words(text: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(given(text), f"{WS}+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def paragraphs(text: Column) -> Column:
    """Stripped, non-empty parts between blank lines; a text with only one of them is cut at single line ends."""
    cut = lambda by: F.filter(F.transform(F.split(given(text), by), strip), lambda p: p != "")
    return let(cut("\n\n"), lambda parts: F.when((F.size(parts) == 1) & F.contains(given(text), F.lit("\n")), cut("\n")).otherwise(parts))


def sentences(text: Column) -> Column:
    """Parts after `.`, `!` or `?` and white space, terminators kept."""
    return F.filter(F.transform(F.split(given(text), rf"(?<=[.!?]){WS}+"), strip), lambda s: s != "")


def terminated(text: Column) -> Column:
    """Parts between runs of terminators; empty ones stay."""
    return F.split(given(text), "[.!?]+")


def mean(xs: Column) -> Column:
    """Of an array of numbers; null for an empty one."""
    return let(xs, lambda v: F.try_divide(F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x).cast("double"), F.size(v).cast("double")))


def std_pop(xs: Column) -> Column:
    """Population standard deviation of an array of whole numbers: exact sums, one division. Null for an empty one."""

    def spread(v: Column) -> Column:
        total = F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x)
        squares = F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
        n = F.size(v).cast("long")
        return F.try_divide(F.sqrt((n * squares - total * total).cast("double")), n.cast("double"))

    return let(xs, spread)


def sentence_lengths(text: Column) -> Column:
    return F.transform(sentences(text), count_words)


def estimate_tokens(n_words: Column) -> Column:
    return F.floor(n_words * F.lit(1.3)).cast("long")


def words_from_tokens(n_tokens: Column) -> Column:
    return F.floor(n_tokens / F.lit(1.3)).cast("long")


def tokens_from_chars(text: Column) -> Column:
    return F.floor(F.char_length(given(text)) / 4).cast("long")


def clean_chunker(text: Column, normalize_quotes: bool = True) -> Column:
    """Line ends, blank lines, blanks and dashes made uniform; curly quotes made straight unless told otherwise."""
    text = sub(given(text), ("\r\n", "\n"), ("\n{3,}", "\n\n"), (r"[ \t]+", " "), ("[—–]", "-"))
    return strip(sub(text, ("[“”]", '"'), ("[‘’]", "'")) if normalize_quotes else text)


def clean_training(text: Column, normalize_quotes: bool = True) -> Column:
    """Lines that are chapter or page marks dropped, then as `clean_chunker`, and ellipses spelled out."""
    text = sub(given(text), (r"(?m)^Chapter \d+.*$", ""), (r"(?m)^\d+$", ""), (r"(?m)^Page \d+.*$", ""))
    return strip(F.regexp_replace(clean_chunker(text, normalize_quotes), "…", "..."))


def strip_references(text: Column) -> Column:
    """Without `[^1]` footnotes and `[1]`, `[1,2]`, `[1-3]` citations; doubled blanks become one."""
    return strip(sub(given(text), (r"\[\^[^\]]+\]", ""), (r"\[\d+(?:[,\-]\s*\d+)*\]", ""), (" {2,}", " ")))


def remove_citations(text: Column) -> Column:
    return F.regexp_replace(given(text), r"\[\^\d+\]", "")


_CITATION = re.compile(r"\[\^[0-9]+\]")


def citations(text: Column) -> Column:
    """Structs (marker, pos) of `[^1]` footnotes, in order; pos counts characters from 0."""

    @arrow_udf("array<struct<marker:string,pos:int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for i in range(0, len(texts), 256):
                found = [[(m[0], m.start()) for m in _CITATION.finditer(t)] for t in texts.slice(i, 256).to_pylist()]
                ends = pa.array([0, *accumulate(map(len, found))], pa.int32())
                marks, places = (pa.array([m[k] for ms in found for m in ms], kind) for k, kind in enumerate((pa.string(), pa.int32())))
                yield pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([marks, places], ["marker", "pos"]))

    return run(given(text))


def word_tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, of any script."""
    return F.regexp_extract_all(F.lower(given(text)), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def _count_in(tokens: Column, *wanted: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*wanted))).cast("long")


def perspective(text: Column) -> Column:
    """The person whose pronouns outnumber both others strictly, else the third."""
    return let(word_tokens(text), _person)


def _person(t: Column) -> Column:
    one, many = _count_in(t, "i", "me", "my", "mine", "myself"), _count_in(t, "we", "us", "our", "ours", "ourselves")
    other = _count_in(t, "he", "she", "it", "they", "him", "her", "them", "his", "hers", "its", "their")
    return F.when((one > many) & (one > other), "first_person_singular").when((many > one) & (many > other), "first_person_plural").otherwise("third_person")


def contains_any(text: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def count_contained(text: Column, parts: list[str]) -> Column:
    """How many of the parts occur in the text."""
    out = F.lit(0)
    for p in parts:
        out = out + F.contains(text, F.lit(p)).cast("int")
    return out.cast("long")


def rhetorical_move(sentence: Column) -> Column:
    """The first rule that holds names the move."""
    s = F.lower(sentence)
    first = F.slice(words(s), 1, 3)
    return (
        F.when(contains_any(s, "like", "as if", "resembles", "similar to", "as though"), "Metaphor")
        .when(s.rlike("^(i |we |one |i'm |we're )"), "Personal Observation")
        .when(contains_any(s, "defined as", "refers to", "means that", "is called"), "Technical Definition")
        .when(F.contains(sentence, F.lit("?")), "Rhetorical Question")
        .when(F.arrays_overlap(first, F.array(*map(F.lit, ("however", "but", "yet", "although", "while")))), "Contrast")
        .when(contains_any(s, "because", "therefore", "thus", "hence", "consequently"), "Consequence")
        .otherwise("Observation")
    )


def rhetorical_skeleton(text: Column) -> Column:
    moves = F.transform(sentences(text), lambda s: F.concat(F.lit("["), rhetorical_move(s), F.lit("]")))
    return let(moves, lambda m: F.when(F.size(m) > 0, F.array_join(m, " -> ")).otherwise("[Observation]"))


def skeleton_moves(skeleton: Column) -> Column:
    """The stripped, non-empty parts in brackets."""
    return F.filter(F.transform(F.regexp_extract_all(given(skeleton), F.lit(r"\[([^\]]+)\]"), 1), strip), lambda m: m != "")


def clean_punctuation(text: Column) -> Column:
    """Dashes next to other marks, doubled marks and the blanks around marks put right."""
    rules = [rule for mark in (",", r"\.", ";", ":") for rule in ((rf"—\s*{mark}", mark[-1]), (rf"{mark}\s*—", mark[-1]))]
    rules += [(rf"{mark}\s*{mark}", mark[-1]) for mark in (",", r"\.", ";", ":")]
    rules += [(r"\s+([.,;:!?])", "$1"), ("([.,;:!?])([A-Za-z])", "$1 $2"), (r"\s+", " ")]
    return strip(sub(given(text), *rules))


#: What answers to a repair request begin and end with; fixed values.
REPAIR_PREFIXES = (
    r"^I apologize[^.]*\.\s*",
    r"^Here is the corrected[^.]*[:.]\s*",
    r"^Here's the corrected[^.]*[:.]\s*",
    r"^The corrected text[^.]*[:.]\s*",
    r"^Corrected version[^.]*[:.]\s*",
    r"^Let me (fix|correct)[^.]*\.\s*",
    r"^I've (fixed|corrected)[^.]*\.\s*",
    r"^Sure,?\s*(here[^.]*)?[:.]\s*",
    r"^Of course[^.]*[:.]\s*",
)
REPAIR_SUFFIXES = (r"\s*I hope this[^.]*\.$", r"\s*Let me know[^.]*\.$", r"\s*Is there anything[^.]*\.$")


def clean_repair(text: Column) -> Column:
    """Without the phrases that answers to a repair request begin and end with."""
    text = sub(strip(given(text)), *((f"(?im){p}", "") for p in REPAIR_PREFIXES))
    return strip(sub(text, *((f"(?i){p}", "") for p in REPAIR_SUFFIXES)))


def complete_sentences(text: Column) -> Column:
    """Cut after the last terminated sentence; without any, more than ten words get a stop unless they end in `,`, `:` or `;`."""

    def cut(text: Column) -> Column:
        stop = F.when((count_words(text) > 10) & ~text.rlike(r"[,:;]\z"), F.concat(text, F.lit("."))).otherwise(text)
        whole = F.filter(sentences(text), lambda s: s.rlike(r"[.!?]\z"))
        return F.when(text.rlike(r"[.!?]\z"), text).otherwise(let(whole, lambda w: F.when(F.size(w) > 0, F.array_join(w, " ")).otherwise(stop)))

    return let(strip(given(text)), cut)


#: Where a model's answer goes on into its training format, or into another script; fixed values.
STOP_MARKS = ("###", "[NEUTRAL INPUT]:", "[NEUTRAL INPUT]", "_OUTPUT]:", "\n\nRewrite the following", "\n\n---", "_NOTE:", ".DebugLine", ".debugLine", "DebugLine:")
OTHER_SCRIPTS = r"[\x{0400}-\x{04FF}\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0E00}-\x{0E7F}\x{AC00}-\x{D7AF}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{0080}-\x{009F}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]"
FICTION = (
    r"\barkham\b", r"\bcthulhu\b", r"\bnecronomicon\b", r"\bmiskatonic\b", r"\binnsmouth\b", r"\bdunwich\b", r"\bshoggoth\b", r"\byog-sothoth\b", r"\bazathoth\b", r"\bnyarlathotep\b",
    r"\br'lyeh\b", r"\bdagon\b", r"\bmy letters to you\b", r"\bin my letters\b", r"\bi have seen\b", r"\bi have written\b", r"\bi cannot recall\b", r"\bwhose names i\b",
)


def before(text: Column, mark: str) -> Column:
    """Stripped up to the mark, where there is one."""
    return let(text, lambda t: F.when(F.contains(t, F.lit(mark)), strip(F.substring_index(t, mark, 1))).otherwise(t))


def clean_response(text: Column) -> Column:
    """A model's answer up to where it leaves its task, without runs of signs, thoughts and made-up names, whole sentences only."""
    text = given(text)
    for mark in STOP_MARKS:
        text = before(text, mark)
    text = sub(text, (r"""[\d!@#$%^&*()_+{}|:"<>?,./;'\[\]\\=\-]{10,}""", ""), ("(?s)<think>.*?</think>", ""))
    text = F.substring_index(text, "<think>", 1)
    text = let(text, lambda t: F.when(t.rlike(OTHER_SCRIPTS), strip(F.regexp_extract(t, rf"(?s)\A(.*?){OTHER_SCRIPTS}", 1))).otherwise(t))
    text = strip(sub(text, (rf"{WS}{{2,}}", " "), ("\n{3,}", "\n\n")))

    def true_to_life(t: Column) -> Column:
        clean = F.filter(F.split(t, rf"(?<=[.!?]){WS}+"), lambda s: ~F.lower(s).rlike("|".join(FICTION)))
        return let(clean, lambda c: F.when(F.size(c) > 0, strip(F.array_join(c, " "))).otherwise(t))

    return complete_sentences(let(text, true_to_life))


def strip_code_fence(text: Column) -> Column:
    return strip(sub(given(text), (r"^```[a-zA-Z]*\n?", ""), (r"\n?```$", "")))


def match_case(original: Column, replacement: Column) -> Column:
    """The replacement in the case of the original: all capitals, a capital first, or lower."""
    capital = F.concat(F.upper(F.left(replacement, F.lit(1))), F.substring(replacement, 2, 1 << 30))
    first = F.left(original, F.lit(1))
    is_upper = (F.upper(original) == original) & (F.lower(original) != original)
    return F.when(is_upper, F.upper(replacement)).when((F.upper(first) == first) & (F.lower(first) != first), capital).otherwise(F.lower(replacement))


def author_tag(author: Column) -> Column:
    return F.replace(F.replace(F.upper(author), F.lit(" "), F.lit("_")), F.lit("."), F.lit(""))


def chunk_id(author: Column, source: Column, index: Column) -> Column:
    return F.left(F.md5(F.concat_ws(":", author, source, index.cast("string"))), F.lit(16))


def years(text: Column) -> Column:
    """Distinct years from 1800 to 2029 that stand alone, sorted."""
    return F.array_sort(F.array_distinct(F.filter(word_tokens(text), lambda t: t.rlike(r"\A(1[89][0-9]{2}|20[0-2][0-9])\z"))))


def parenthesised_years(text: Column) -> Column:
    """Distinct parentheses that hold a year, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(given(text), F.lit(r"(\([^)]*(?:19|20)[0-9]{2}[^)]*\))"), 1)))


def portable_uniform(*key: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the key, the same in any engine."""
    return F.conv(F.left(F.md5(F.concat_ws(":", *key)), F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)


#: Small words that titles don't capitalise; fixed values.
SMALL_WORDS = ("a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were")
_EDGE = r"""[.,;:!?"'()\-—]"""


def is_heading(line: Column) -> Column:
    """Marked with #, mostly capitals, one capitalised word, or in title case; not if it ends as a sentence does."""
    bare = lambda w: F.regexp_replace(w, f"^{_EDGE}+|{_EDGE}+$", "")
    counted = lambda w: (w != "") & ~F.lower(w).isin(*SMALL_WORDS) & ~((F.upper(w) == w) & (F.lower(w) != w) & (F.char_length(w) <= 4))

    def rule(line: Column) -> Column:
        upper, alpha = F.regexp_count(line, F.lit(r"\p{Lu}")), F.regexp_count(line, F.lit(r"\p{L}"))
        plain = F.when(line == "", False).when(line.startswith("#"), True).when((alpha > 0) & (upper > 0.8 * alpha), True).when(line.rlike(r"[.!]\z"), False)
        return plain.otherwise(let(words(line), by_words))

    def by_words(ws: Column) -> Column:
        rest = F.filter(F.transform(F.slice(ws, 2, 1 << 20), bare), counted)
        return let(rest, lambda r: titled(F.size(ws), r) | ((F.size(ws) == 1) & bare(F.element_at(ws, 1)).rlike(r"^\p{Lu}")))

    def titled(n: Column, rest: Column) -> Column:
        capital = F.size(F.filter(rest, lambda w: w.rlike(r"^\p{Lu}")))
        return (n >= 2) & (((F.size(rest) >= 2) & (2 * capital >= F.size(rest))) | ((n <= 6) & (capital >= 1)))

    return let(strip(given(line)), rule)
