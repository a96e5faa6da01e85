"""DuckDB spellings of the text primitives, for the SQL that queries are compared with."""

from __future__ import annotations

WS = r"[ \t\n\r\f]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sub(x: str, *rules: tuple[str, str]) -> str:
    for pattern, by in rules:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w_: w_ <> '')"


def n_words(x: str) -> str:
    return f"CAST(len({words(x)}) AS BIGINT)"


def paragraphs(x: str) -> str:
    cut = lambda by: f"list_filter(list_transform(string_split({x}, {by}), lambda p_: {strip('p_')}), lambda q_: q_ <> '')"
    double = cut("chr(10) || chr(10)")
    return f"CASE WHEN len({double}) = 1 AND contains({x}, chr(10)) THEN {cut('chr(10)')} ELSE {double} END"


def after_stops(x: str) -> str:
    """Parts after a terminator and white space, as they are."""
    return rf"string_split(regexp_replace({x}, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1))"


def sentences(x: str) -> str:
    return f"list_filter(list_transform({after_stops(x)}, lambda p_: {strip('p_')}), lambda q_: q_ <> '')"


def lengths(x: str) -> str:
    return f"list_transform({sentences(x)}, lambda s_: {n_words('s_')})"


def total(xs: str) -> str:
    return f"coalesce(list_sum({xs}), 0)"


def mean(xs: str) -> str:
    return f"CAST({total(xs)} AS DOUBLE) / nullif(CAST(len({xs}) AS DOUBLE), 0)"


def std_pop(xs: str) -> str:
    squares = total(f"list_transform({xs}, lambda v_: v_ * v_)")
    return f"sqrt(CAST(len({xs}) * {squares} - {total(xs)} * {total(xs)} AS DOUBLE)) / nullif(CAST(len({xs}) AS DOUBLE), 0)"


def tokens(n: str) -> str:
    return f"CAST(floor({n} * 1.3::DOUBLE) AS BIGINT)"


def word_tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def count(x: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{pattern}')) AS BIGINT)"


def listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def contained(x: str, values) -> str:
    """How many of the values occur in x."""
    return f"CAST(len(list_filter({listed(values)}, lambda c_: contains({x}, c_))) AS BIGINT)"


#: Paragraph rows of `documents`.
PARAS = f"paras AS (SELECT doc_id, source AS author, CAST(unnest(generate_series(0, len(ps) - 1)) AS INTEGER) AS para_idx, unnest(ps) AS text FROM (SELECT doc_id, source, {paragraphs('text')} AS ps FROM documents))"
