"""Text helpers as Spark columns; all stay in built-in expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley import fixed


def strings(values: Iterable[str]) -> Column:
    """A literal array of strings, typed even when empty."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


#: Items summed at once by ``running_sum``.
RUN = 64


def running_sum(steps: Column) -> Column:
    """Inclusive running sum of an array of ints, in blocks: work grows as n * RUN, not as its square.

    What is used inside a lambda is bound first: an expression in its place
    would be evaluated anew for every element.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def cut(all_steps: Column) -> Column:
        blocks = F.ceil(F.size(all_steps) / RUN).cast("int")
        return F.transform(
            F.sequence(F.lit(1), blocks), lambda b: F.slice(all_steps, (b - 1) * RUN + 1, F.lit(RUN))
        )

    def shifted(parts: Column, sums: Column) -> Column:
        return F.transform(
            parts,
            lambda block, b: let(
                total(F.slice(sums, F.lit(1), b)),
                lambda before: F.transform(block, lambda _, i: before + total(F.slice(block, F.lit(1), i + 1))),
            ),
        )

    return let(
        steps,
        lambda s: F.when(
            F.size(s) > 0,
            let(cut(s), lambda parts: let(F.transform(parts, total), lambda sums: F.flatten(shifted(parts, sums)))),
        ).otherwise(F.array().cast("array<int>")),
    )


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(fixed.SPACE_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(fixed.SPACE_CHARS))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(fixed.SPACE_CHARS))


def present(c: Column) -> Column:
    """The stripped text, or null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def squeeze(c: Column) -> Column:
    """Collapse white space to single blanks."""
    return strip(F.regexp_replace(c, fixed.SPACE + "+", " "))


def words(c: Column) -> Column:
    """White-space separated words."""
    return F.array_remove(F.split(c, fixed.SPACE + "+"), "")


def matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def contains_any(c: Column, needles: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(n)) for n in needles])


def starts_with_any(c: Column, heads: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(c, F.lit(h)) for h in heads])


def count_present(c: Column, needles: Iterable[str]) -> Column:
    """How many of the needles occur in the text."""
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(n)).cast("int") for n in needles])


def lines(c: Column) -> Column:
    """Lines without their breaks; no empty line after a final break."""
    whole = F.split(c, fixed.LINE_BREAK)
    return let(
        whole,
        lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a),
    )


def line_breaks(c: Column) -> Column:
    return F.regexp_count(c, F.lit(fixed.LINE_BREAK))


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def keep_unless(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "")


#: Capitals outside the token alphabet whose small forms are inside it.
STRANGE_CAPITALS = "\u0130\u0178\u1e9e\u212a\u212b"


def tokens(c: Column, min_len: int = 3, stopwords: Iterable[str] = fixed.QUERY_STOPWORDS) -> Column:
    """Lower-case tokens in text order, without short ones and stop words."""
    found = matches(token_text(c), token_pattern(min_len))
    return F.filter(found, lambda t: ~t.isin(*stopwords)) if stopwords else found


def token_pattern(min_len: int) -> str:
    """Tokens of at least ``min_len`` characters in a ``token_text``; Java and Python read it alike."""
    return f"{fixed.TOKEN[:-1]}{{{min_len},}}"


def token_text(c: Column) -> Column:
    """The text in which tokens are found.

    It is lowered once instead of token by token; capitals that would lower
    into the alphabet are blanked first where there are any, as they separate
    tokens.
    """
    whole = F.coalesce(c, F.lit(""))
    blanked = F.translate(whole, STRANGE_CAPITALS, " " * len(STRANGE_CAPITALS))
    return F.lower(F.when(contains_any(whole, STRANGE_CAPITALS), blanked).otherwise(whole))


def token_set(c: Column, min_len: int = 3, stopwords: Iterable[str] = fixed.QUERY_STOPWORDS) -> Column:
    return F.array_distinct(tokens(c, min_len, stopwords))


IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"
LINK = r"\[([^\]]+)\]\(([^)]+)\)"


def md_strip(c: Column) -> Column:
    """Body text without images, link targets, inline code and markdown marks."""
    c = F.regexp_replace(c, IMAGE, "")
    c = F.regexp_replace(c, LINK, "$1")
    c = F.regexp_replace(c, r"`{1,3}[^`]*`{1,3}", "")
    return F.regexp_replace(c, r"[*_>#]+", "")


def split_sentences(bare: Column) -> Column:
    parts = F.transform(F.split(bare, r"[.!?](?:" + fixed.SPACE + r"|\z)"), strip)
    return F.filter(parts, lambda p: p != "")


def split_paragraphs(bare: Column) -> Column:
    parts = F.transform(F.split(bare, r"\n" + fixed.SPACE + r"*\n"), strip)
    return F.filter(parts, lambda p: p != "")


def sentences(body: Column) -> Column:
    return split_sentences(md_strip(body))


def paragraphs(body: Column) -> Column:
    return split_paragraphs(md_strip(body))


def count_words(bare: Column) -> Column:
    return F.regexp_count(bare, F.lit(fixed.WORD + "+"))


def word_count(body: Column) -> Column:
    return count_words(md_strip(body))


def speech_words(bare: Column) -> Column:
    """Words that may hold an apostrophe, starting and ending at a word edge."""
    return matches(bare, fixed.WORD + r"(?:[\p{L}\p{N}_']*" + fixed.WORD + ")?")


def syllables(word: Column) -> Column:
    groups = F.regexp_count(F.lower(word), F.lit("[aeiouy]+"))
    silent = F.endswith(F.lower(word), F.lit("e")) & (groups > 1)
    return F.greatest(F.lit(1), groups - F.when(silent, 1).otherwise(0))


def syllables_of(words: Column) -> Column:
    """The sum of ``syllables`` over words without blanks, in three passes over the whole text instead of some per word.

    Every vowel group counts, a word without any counts one, and the last ``e``
    of a word with more than one group does not count.
    """
    return let(
        lower_joined(words),
        lambda low: F.regexp_count(low, F.lit("[aeiouy]+"))
        + F.size(words) - F.regexp_count(low, F.lit("[aeiouy][^ ]*"))
        - F.regexp_count(low, F.lit(r"[aeiouy][^aeiouy ][^ ]*e(?= |\z)")),
    )


def lower_joined(words: Column) -> Column:
    return F.lower(F.array_join(words, " "))


def occurrences(c: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a non-empty needle."""
    gone = F.length(c) - F.length(F.replace(c, needle, F.lit("")))
    return (gone / F.length(needle)).cast("int")


def list_repr(items: Column, quote: str = "") -> Column:
    """An array shown in brackets, items separated by comma and blank."""
    shown = F.transform(items, lambda i: F.concat(F.lit(quote), i.cast("string"), F.lit(quote)))
    return F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]"))


def unfence(reply: Column) -> Column:
    """A model reply without the code fence around it."""
    text = strip(reply)
    bare = F.trim(text, F.lit("`"))
    bare = F.when(F.startswith(bare, F.lit("json")), F.substring(bare, 5, 2**31 - 1)).otherwise(bare)
    return F.when(F.startswith(text, F.lit("```")), strip(bare)).otherwise(text)
