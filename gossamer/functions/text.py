"""Columns over words: splitting, cleaning, counting and searching."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of snippets.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "in", "of", "the", "to")
# The stop words of the index.
INDEX_STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()
# The scopes in which an anchor counts more.
SCOPES = ("H1", "H2", "H3", "H4", "em", "b")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, also where `use` needs it within a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Words between blanks and line ends; a leading blank gives an empty first word, trailing ones none."""
    return F.split(F.regexp_replace(text, "[ \n\r]+$", ""), "[ \n\r]+")


def terms(text: Column) -> Column:
    """Terms: runs of letters and digits of any script of the lower-cased text, stop words too, so that places are kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def indexed(term: Column) -> Column:
    """Whether a term is no stop word."""
    return ~term.isin(*INDEX_STOP_WORDS)


def plain(text: Column) -> Column:
    """Lower case without anything but letters, digits and blanks."""
    return F.lower(F.regexp_replace(text, "[^a-zA-Z0-9 ]", ""))


def cleaned(word: Column) -> Column:
    return F.regexp_replace(word, "[^-a-zA-Z0-9_ ]", "")


def occurrences(text: Column, part: Column) -> Column:
    """How often `part` occurs in `text` without overlap; an empty or null part never does."""
    return F.when(F.length(part) > 0, (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).otherwise(0).cast("int")


def scope_hits(html: Column, anchor: Column, scope: str, greedy: bool = False) -> Column:
    """Pieces between <scope> and </scope> on one line that contain the anchor; case matters. greedy: from the first tag of a line to the last is one piece."""
    pieces = F.regexp_extract_all(html, F.lit(f"<{scope}>(.*{'' if greedy else '?'})</{scope}>"), F.lit(1))
    return F.when(F.length(anchor) > 0, F.size(F.filter(pieces, lambda p: F.contains(p, anchor)))).otherwise(0)


def polynomial_hash(text: Column, count: Column) -> Column:
    """h = 31 h + code over the characters, from 1125899906842597, plus count, in 64 bits with a sign."""
    whole = F.lit(str(1 << 64)).cast("decimal(38,0)")
    codes = F.filter(F.split(text, ""), lambda c: c != "")
    h = F.aggregate(codes, F.lit(1125899906842597).cast("decimal(38,0)"), lambda acc, c: ((acc * F.lit(31).cast("decimal(3,0)") + F.ascii(c)) % whole).cast("decimal(38,0)"))
    h = ((h + count) % whole).cast("decimal(38,0)")
    return F.when(h >= F.lit(str(1 << 63)).cast("decimal(38,0)"), h - whole).otherwise(h).cast("bigint")


def word_index(array: Column, word: Column) -> Column:
    """First index of a word whatever its case, -1 if there is none."""
    return (F.array_position(F.transform(array, F.lower), F.lower(word)) - 1).cast("int")


def phrase_index(array: Column, phrase: Column) -> Column:
    """First index from which the words of `phrase` follow each other in `array`, -1 if nowhere."""
    n = F.size(phrase)
    starts = F.sequence(F.lit(0), F.greatest(F.size(array) - n, F.lit(0)))
    head = F.get(phrase, F.lit(0))
    hit = F.filter(starts, lambda i: (F.get(array, i) == head) & (F.slice(array, i + 1, F.greatest(n, F.lit(1))) == phrase))
    return F.when((n > 0) & (F.size(array) >= n), F.coalesce(F.get(hit, F.lit(0)), F.lit(-1))).otherwise(-1)


def joined_slice(array: Column, begin: Column, end: Column) -> Column:
    """Words begin to end, both included, joined by blanks."""
    return F.array_join(F.slice(array, begin + 1, F.greatest(end - begin + 1, F.lit(0))), " ")


def without_stop_words(array: Column) -> Column:
    """Cleaned words that aren't stop words (in their very spelling) and not empty."""
    kept = F.filter(array, lambda w: ~w.isin(*STOP_WORDS))
    return F.filter(F.transform(kept, cleaned), lambda w: w != "")
