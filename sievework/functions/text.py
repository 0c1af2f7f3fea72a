"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "\x00EMPTY\x00"  # fixed value: the one shingle of a text without tokens


def normalized(c: Column) -> Column:
    """Lower case; runs of the mask letter become one; everything but a-z and 0-9 becomes a blank."""
    masked = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "x{2,}", "x")
    return F.trim(F.regexp_replace(masked, "[^a-z0-9]+", " "))


def tokens(c: Column) -> Column:
    return F.array_remove(F.split(normalized(c), " "), "")


def shingles(toks: Column, size: int = 5) -> Column:
    """Distinct word shingles; shorter texts have one, texts without tokens share a sentinel."""
    many = F.transform(F.sequence(F.lit(1), F.size(toks) - (size - 1)), lambda i: F.array_join(F.slice(toks, i, size), " "))
    return F.array_distinct(
        F.when(F.size(toks) == 0, F.array(F.lit(EMPTY))).when(F.size(toks) < size, F.array(F.array_join(toks, " "))).otherwise(many)
    )


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def word_tokens(c: Column) -> Column:
    """Lower-cased words of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def ngrams(toks: Column, n: int) -> Column:
    return F.when(F.size(toks) >= n, F.transform(F.sequence(F.lit(1), F.size(toks) - (n - 1)), lambda i: F.array_join(F.slice(toks, i, n), " "))).otherwise(F.array().cast("array<string>"))


def blank_words(c: Column) -> Column:
    """Lower-cased pieces between white space."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), "")


def char_wb_ngrams(c: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams within words padded by a blank; a word shorter than n gives itself once, then stops."""
    words = F.transform(blank_words(c), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    none = F.array().cast("array<string>")

    def of(w: Column) -> Column:
        parts = []
        for n in range(low, high + 1):
            size = F.lit(n)
            grams = F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substr(w, i, size))  # noqa: B023
            parts.append(F.when(F.length(w) >= n, grams).otherwise(F.array(w) if n == low else none))
        return F.flatten(F.array(*parts))

    return F.flatten(F.transform(words, of))


def parse_label(content: Column, labels: list[str]) -> Column:
    """``label`` of a JSON object if it is a known label, else null."""
    got = F.get_json_object(content, "$.label")
    return F.when(got.isin(labels), got)


def one_hot(pred: Column, labels: list[str]) -> Column:
    return F.array(*((pred == x).cast("double") for x in labels))


def messages(system: Column, shots: list[tuple[str, str]], user: Column) -> Column:
    """Chat messages: system, example pairs, user."""
    one = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    pairs = [x for q, a in shots for x in (one("user", F.lit(q)), one("assistant", F.to_json(F.struct(F.lit(a).alias("label")))))]
    return F.array(one("system", system), *pairs, one("user", user))
