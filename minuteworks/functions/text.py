"""Column expressions over text: words, hashes, bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a column that is made once: an expression used inside a lambda is otherwise evaluated
    for every element of the lambda's array."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Parts between runs of white space (Unicode), without empty ones."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def strip(text: Column | str) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalized(word: Column) -> Column:
    """Letters and digits, in lower case."""
    return F.lower(F.regexp_replace(word, r"[^\p{IsAlphabetic}\p{N}]", ""))


def normalized_words(text: Column) -> Column:
    return F.filter(F.transform(words(text), lambda w: normalized(w)), lambda w: w != "")


def meaningful_word_count(text: Column) -> Column:
    return F.size(F.filter(normalized_words(text), lambda w: F.length(w) >= 2))


def occurrences(text: Column, phrases) -> Column:
    """How often the phrases occur, without overlap, in the lower-case text."""
    lower, total = F.lower(text), F.lit(0)
    for p in phrases:
        total = total + ((F.length(lower) - F.length(F.replace(lower, F.lit(p), F.lit("")))) / len(p)).cast("int")
    return total


def starts_with_any(text: Column, prefixes) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | text.startswith(p)
    return found


def contains_any(text: Column, parts) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def token_bound(text: Column) -> Column:
    """A token stands for at least one UTF-8 byte."""
    return F.octet_length(text)


def file_name(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)
