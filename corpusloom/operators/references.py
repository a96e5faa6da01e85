"""References in texts: taken out with what they are attached to, and put back into a rewritten text; lines joined at hyphens."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

FOOTNOTE = re.compile(r"\[\^([^\]]+)\]")
CITATION = re.compile(r"\[(\d+(?:[,\-]\s*\d+)*)\]")
REFS = "array<struct<marker:string,ref_id:string,attached_to:string,context:string,position:int,kind:string>>"
_KIND = pa.list_(pa.struct([("marker", pa.string()), ("ref_id", pa.string()), ("attached_to", pa.string()), ("context", pa.string()), ("position", pa.int32()), ("kind", pa.string())]))
_STOPS = ".,;:!?"


def attached(prefix: str) -> str:
    """What a reference after the prefix belongs to: a quoted span, a parenthesis, two capitalised words, or the last word."""
    prefix = prefix.rstrip()
    for close, open_ in (('"', '"'), ("'", "'"), (")", "(")):
        if prefix.endswith(close) and (at := prefix.rfind(open_, 0, len(prefix) - 1)) >= 0:
            return prefix[at + 1 : -1]
    last = [w.strip(_STOPS) for w in prefix.rsplit(None, 2)[-2:]]
    if len(last) == 2 and all(w[:1].isupper() for w in last):
        return " ".join(last)
    return last[-1] if last else ""


def extracted(text: str) -> tuple[str, list[dict]]:
    """The text without references, and these, footnotes first. A citation after `!` or `[` goes, but isn't listed."""
    refs = []
    for kind, pattern in (("footnote", FOOTNOTE), ("citation", CITATION)):
        for m in pattern.finditer(text):
            if kind == "footnote" or text[m.start() - 1 : m.start()] not in ("!", "["):
                refs.append({"marker": m[0], "ref_id": m[1], "attached_to": attached(text[: m.start()]), "context": text[max(0, m.start() - 50) : m.end() + 50], "position": m.start(), "kind": kind})
    return re.sub("  +", " ", CITATION.sub("", FOOTNOTE.sub("", text))), refs


_ENDINGS = ("ations", "ation", "ings", "ing", "ies", "ed", "es", "s", "ly")


def _stem(word: str) -> str:
    return next((word[: -len(e)] for e in _ENDINGS if word.endswith(e) and len(word) - len(e) >= 4), word)


#: Characters that letters of ASCII equal regardless of case, or whose lower case depends on more than themselves.
_CASED = re.compile("[\u0130\u0131\u017f\u212a\u03a3]")


def _whole(text: str, low: str | None, wanted: str) -> list[tuple[int, int]]:
    """Where the text has the wanted words by themselves. low: the text in lower case, where a plain search finds the same."""
    if low is None or not wanted.isascii():
        return [m.span() for m in re.finditer(rf"(?<!\w){re.escape(wanted)}(?!\w)", text, re.IGNORECASE)]
    wanted, found, n = wanted.lower(), [], len(wanted)
    inside = lambda c: c.isalnum() or c == "_"
    at = low.find(wanted)
    while at >= 0:
        free = not (at and inside(low[at - 1])) and not inside(low[at + n : at + n + 1])
        if free:
            found.append((at, at + n))
        at = low.find(wanted, at + (n if free else 1))
    return found


def _place(text: str, low: str | None, wanted: str, context: str) -> int | None:
    whole = _whole(text, low, wanted)
    if len(whole) == 1:
        return whole[0][1]
    if whole:
        near = set(re.findall(r"\w{4,}", context.lower()))
        around = lambda a, b: text[max(0, a - 50) : b + 50].lower() if low is None else low[max(0, a - 50) : b + 50]

        def score(span: tuple[int, int]) -> int:
            here = around(*span)
            return sum(w in here for w in near)

        return max(whole, key=lambda span: (score(span), -span[0]))[1]
    if len(wanted) < 3:
        return None
    if " " in wanted and (m := re.search(rf"(?<!\w){re.escape(wanted.split()[-1])}(?!\w)", text, re.IGNORECASE)):
        return m.end()
    stem = _stem(wanted.lower())
    return next((m.end() for m in re.finditer(r"\w+", text) if len(stem) >= 4 and _stem(m[0].lower()) == stem), None)


def reinjected(text: str, refs: list[dict]) -> str:
    """Each marker after the word or phrase it was attached to, where the text still has it or another form of it."""
    plain = not _CASED.search(text) and not any(_CASED.search(r["marker"]) for r in refs)
    low = text.lower() if plain else None
    for r in refs:
        if r["attached_to"] and (at := _place(text, low, r["attached_to"], r["context"])) is not None:
            text = text[:at] + r["marker"] + text[at:]
            low = None if low is None else low[:at] + r["marker"].lower() + low[at:]
    return text


def extract_references(text: Column) -> Column:
    """clean and refs of a text; a null text has none."""

    def run(texts: pa.Array) -> pa.Array:
        found = [extracted(t or "") for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], _KIND)], ["clean", "refs"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return arrow_udf(run, f"struct<clean:string,refs:{REFS}>")(text)


def reinject_references(text: Column, refs: Column) -> Column:
    def run(texts: pa.Array, refs: pa.Array) -> pa.Array:
        return pa.array([None if t is None else reinjected(t, r or []) for t, r in zip(texts.to_pylist(), refs.to_pylist())], pa.string())

    run.__annotations__ = {"texts": pa.Array, "refs": pa.Array, "return": pa.Array}
    return arrow_udf(run, "string")(text, refs)


def reinjected_references(text: Column) -> Column:
    """A text whose references were all taken out and put back, document after document, so that no list of them is passed on."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array((reinjected(*extracted(t.as_py() or "")) for t in texts), pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return arrow_udf(run, "string")(text)


def lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "text"))


def continues(line: Column, after: Column) -> Column:
    """Whether a line ends in a hyphen inside a word that the next one goes on with: up to six letters before it, not after a
    stop, and a lower-case first word of up to eight letters."""
    part = F.regexp_extract(line, r"(\S*)-\s*$", 1)
    word = F.regexp_replace(F.regexp_extract(F.ltrim(after), r"^(\S+)", 1), r"[.,;:!?]+$", "")
    return line.rlike(r"\S-\s*$") & (F.char_length(part) <= 6) & ~part.rlike(r"[.!?:]") & word.rlike(r"^\p{Ll}") & (F.char_length(word) <= 8)


def joined_lines(rows: DataFrame) -> DataFrame:
    """doc_id, line_no, text with lines that break a word made one, chains too; line_no of the first. Islands of lines that go on."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = rows.withColumn("on", F.coalesce(continues(F.col("text"), F.lead("text").over(w)), F.lit(False)))
    rows = rows.withColumn("island", F.sum(F.when(F.coalesce(F.lag("on").over(w), F.lit(False)), 0).otherwise(1)).over(w))
    part = F.when(F.col("on"), F.regexp_replace("text", r"-\s*$", "")).otherwise(F.col("text"))
    first = F.row_number().over(Window.partitionBy("doc_id", "island").orderBy("line_no")) == 1
    rows = rows.withColumn("part", F.when(first, part).otherwise(F.ltrim(part)))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "part"))), lambda s: s["part"]), "")
    return rows.groupBy("doc_id", "island").agg(F.min("line_no").alias("line_no"), whole.alias("text")).drop("island")


#: Lines that are page numbers, in figures or Roman numerals.
PAGE_LINE = r"^\s*(\d{1,4}|X{0,1}(IX|IV|V?I{1,3}|V)|X{1,3})\s*$"


def cleaned_lines(rows: DataFrame, headers: tuple[str, ...] = ()) -> DataFrame:
    """Joined lines without page numbers, repeated headers (the first stays), centred ones, and runs of blank lines."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = joined_lines(rows).where(~F.col("text").rlike(PAGE_LINE)).where(~F.col("text").rlike(r"^ {20,}\S"))
    if headers:
        again = F.row_number().over(Window.partitionBy("doc_id", F.trim("text")).orderBy("line_no"))
        rows = rows.withColumn("again", again).where(~F.trim("text").isin(*headers) | (F.col("again") == 1)).drop("again")
    rows = rows.withColumn("blank", F.trim("text") == "").withColumn("after", F.lag("blank").over(w))
    rows = rows.where(~(F.col("blank") & F.coalesce("after", F.lit(True))))
    return rows.select("doc_id", (F.row_number().over(w) - 1).cast("int").alias("line_no"), F.ltrim("text").alias("text"))
