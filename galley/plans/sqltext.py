"""Pieces of the DuckDB check SQL that several checks share."""

from __future__ import annotations

from galley import fixed

WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
NL = "chr(10)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lits(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]::VARCHAR[]"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def rstrip(x: str) -> str:
    return f"rtrim({x}, {WS})"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'), {WS})"


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {by if by.startswith('chr') else lit(by)}, 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def tokens(x: str, min_len: int, stop) -> str:
    return (
        f"list_filter(list_transform(list_filter(regexp_extract_all({x}, '{fixed.TOKEN}'), "
        f"lambda t: length(t) >= {min_len}), lambda t: lower(t)), lambda t: not list_contains({lits(stop)}, t))"
    )


def md_strip(x: str) -> str:
    x = sub(x, r"!\[([^\]]*)\]\(([^)]+)\)")
    x = sub(x, r"\[([^\]]+)\]\(([^)]+)\)", r"\1")
    x = sub(x, r"`{1,3}[^`]*`{1,3}")
    return sub(x, r"[*_>#]+")


def pieces(x: str, pattern: str) -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array({x}, {lit(pattern)}), "
        f"lambda p: {strip('p')}), lambda p: p <> '')"
    )


def sentences(bare: str) -> str:
    return pieces(bare, r"[.!?](?:\s|$)")


def paragraphs(bare: str) -> str:
    return pieces(bare, r"\n\s*\n")


def n_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+'))"


def any_in(x: str, needles) -> str:
    return "(" + " or ".join(f"contains({x}, {lit(n)})" for n in needles) + ")"


def hits(x: str, needles) -> str:
    return "(" + " + ".join(f"contains({x}, {lit(n)})::int" for n in needles) + ")"


def newlines(x: str) -> str:
    return f"(length({x}) - length(replace({x}, chr(10), '')))"


def summary(x: str) -> str:
    """List detour, so that the squeezed text is named once."""
    return (
        f"list_transform([{squeeze(x)}], lambda s: case when length(s) <= 420 then s "
        f"else {rstrip('substr(s, 1, 419)')} || '...' end)[1]"
    )
