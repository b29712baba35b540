"""Text functions as Column expressions."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles before names, suffixes of companies, and replacements of the phonetic code.
NAME_TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "sir", "madam", "bapak", "ibu", "pak", "bu", "drs", "ir", "st", "se")
COMPANY_SUFFIXES = ("ltd", "limited", "inc", "incorporated", "corp", "corporation", "llc", "pt", "cv", "tbk", "persero", "perum", "bumd", "co", "company", "group", "holding", "international")
PHONETIC_REPLACEMENTS = (("PH", "F"), ("GH", "F"), ("CK", "K"), ("SCH", "SK"), ("TH", "T"), ("SH", "S"), ("CH", "K"))


def strip(c: Column) -> Column:
    """Without Unicode white space at either end (trim() takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Words joined by one space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def title(c: Column) -> Column:
    """Every run of letters begins in upper case and goes on in lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substr(x, F.lit(2))))), "")


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def soundex(c: Column) -> Column:
    """First letter and three digits; vowels and H, W, Y go wherever they stand. Empty text gives null."""
    word = F.upper(c)
    digits = F.regexp_replace(F.translate(F.substr(word, F.lit(2)), "BFPVCGJKQSXZDTLMNR0123456789", "111122222222334556"), "[^1-6]", "")
    code = F.regexp_replace(F.regexp_replace(F.concat(F.left(word, F.lit(1)), digits), r"([0-9])\1+", "$1"), "[AEIOUHWY]", "")
    return F.when(c != "", F.left(F.rpad(code, 4, "0"), F.lit(4)))


def metaphone(c: Column) -> Column:
    """Four characters of the upper-cased word after replacements, without vowels beyond the first place."""
    word = reduce(lambda w, r: F.replace(w, F.lit(r[0]), F.lit(r[1])), PHONETIC_REPLACEMENTS, F.upper(c))
    return F.left(F.concat(F.left(word, F.lit(1)), F.regexp_replace(F.substr(word, F.lit(2)), "[AEIOU]", "")), F.lit(4))


def bigrams(c: Column) -> Column:
    """The set of pairs of neighbouring lower-cased characters."""
    low = F.lower(c)
    pairs = F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(low, i, F.lit(2)))
    return F.when(F.length(c) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def words(c: Column) -> Column:
    """The set of lower-cased words."""
    return F.array_distinct(F.filter(F.split(F.lower(strip(c)), r"(?U)\s+"), lambda w: w != ""))


def set_jaccard(a: Column, b: Column) -> Column:
    """Shared over all members; 1 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def set_cosine(a: Column, b: Column) -> Column:
    """Shared members over the geometric mean of the sizes; 0 if a set is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.sqrt((F.size(a) * F.size(b)).cast("double"))), F.lit(0.0))


def exact_similarity(a: Column, b: Column) -> Column:
    return (a == b).cast("double")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def jaccard_similarity(a: Column, b: Column) -> Column:
    return set_jaccard(bigrams(a), bigrams(b))


def cosine_similarity(a: Column, b: Column) -> Column:
    return set_cosine(bigrams(a), bigrams(b))


def semantic_similarity(a: Column, b: Column) -> Column:
    return set_jaccard(words(a), words(b))


def soundex_similarity(a: Column, b: Column) -> Column:
    return (soundex(a) == soundex(b)).cast("double")


def metaphone_similarity(a: Column, b: Column) -> Column:
    return (metaphone(a) == metaphone(b)).cast("double")


def _ratio_batches(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else round(100 * difflib.SequenceMatcher(None, x, y).ratio()) / 100 for x, y in zip(a, b, strict=True)], dtype="float64")


def jaro_winkler_similarity(a: Column, b: Column) -> Column:
    """Jaro similarity, raised above 0.7 by a common beginning of up to four characters.

    One pass over the characters of a, each of which takes the first free equal one of b within reach.
    """
    n, m = F.length(a), F.length(b)
    reach = F.greatest(F.lit(0), F.floor(F.greatest(n, m) / 2).cast("int") - 1)
    char = lambda c, i: F.substring(c, i + 1, F.lit(1))

    def step(state: Column, i: Column) -> Column:
        near = F.sequence(F.greatest(F.lit(0), i - reach), F.least(m - 1, i + reach))
        hit = F.get(F.filter(near, lambda j: (char(b, j) == char(a, i)) & (char(state["used"], j) == "0")), F.lit(0))
        # beyond the end of b the places would run backwards
        taken = F.struct(F.overlay(state["used"], F.lit("1"), hit + 1).alias("used"), F.concat(state["left"], char(a, i)).alias("left"))
        return F.when(hit.isNull() | (i - reach > m - 1), state).otherwise(taken)

    def told(state: Column) -> Column:
        left, size = state["left"], F.length(state["left"])
        right = F.array_join(F.filter(F.split(b, ""), lambda _, j: char(state["used"], j) == "1"), "")
        unequal = F.size(F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda k: char(left, k) != char(right, k)))
        jaro = (size / n + size / m + (size - F.floor(unequal / 2)) / size) / 3
        same = reduce(lambda more, k: F.when(F.left(a, F.lit(k)) == F.left(b, F.lit(k)), k).otherwise(more), range(1, 5), F.lit(0))
        prefix = F.least(same, n, m)
        return F.when(size == 0, 0.0).when(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro)).otherwise(jaro)

    start = F.struct(F.repeat(F.lit("0"), m).alias("used"), F.lit("").alias("left"))
    score = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), start, step, told)
    return F.when(a == b, 1.0).when((n == 0) | (m == 0), 0.0).when(a.isNotNull() & b.isNotNull(), score)


def ratio_similarity(a: Column, b: Column) -> Column:
    """Share of matching characters in hundredths, as an Arrow batch function."""
    return F.pandas_udf(_ratio_batches, "double")(a, b)


#: Similarities by the name that a matching rule uses; codes that stand for another fall back to it.
SIMILARITIES: dict[str, Callable[[Column, Column], Column]] = {
    "exact": exact_similarity,
    "levenshtein": levenshtein_similarity,
    "jaro_winkler": jaro_winkler_similarity,
    "fuzzy": ratio_similarity,
    "cosine": cosine_similarity,
    "jaccard": jaccard_similarity,
    "soundex": soundex_similarity,
    "metaphone": metaphone_similarity,
    "double_metaphone": metaphone_similarity,
    "semantic": semantic_similarity,
    "ml": levenshtein_similarity,
}


def composite_similarity(a: Column, b: Column, weights: dict[str, float]) -> Column:
    """The weighted mean of several similarities."""
    total = sum(weights.values())
    return reduce(lambda x, y: x + y, (SIMILARITIES[name](a, b) * F.lit(w) for name, w in weights.items())) / F.lit(total)


def remove_titles(c: Column) -> Column:
    parts = F.split(F.lower(strip(c)), r"(?U)\s+")
    return F.array_join(F.filter(parts, lambda w: ~w.isin(*NAME_TITLES)), " ")


def normalize_company(c: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(c), r"\b(?:" + "|".join(COMPANY_SUFFIXES) + r")\.?\b", ""))


def remove_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^\w\s]", "")


def phonetic_normalize(c: Column) -> Column:
    return F.lower(collapse(remove_punctuation(c)))


#: Preprocessing by the name that a matching rule uses.
PREPROCESSORS: dict[str, Callable[[Column], Column]] = {
    "lowercase": F.lower,
    "uppercase": F.upper,
    "strip": strip,
    "remove_spaces": lambda c: F.replace(c, F.lit(" "), F.lit("")),
    "remove_punctuation": remove_punctuation,
    "normalize_whitespace": collapse,
    "remove_titles": remove_titles,
    "normalize_company": normalize_company,
    "phonetic_normalize": phonetic_normalize,
}


def sanitize(c: Column, most: int | None = None, allowed: str | None = None) -> Column:
    """Without tags and control characters, HTML-escaped, limited to allowed characters and length."""
    out = F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    if allowed:
        out = F.regexp_replace(out, f"[^{allowed}]", "")
    return F.left(out, F.lit(most)) if most else out


def file_size(c: Column) -> Column:
    """A number of bytes in the largest unit of which there is at least one."""
    unit = F.lit(None).cast("string")
    for k, name in enumerate(("B", "KB", "MB", "GB", "TB")):
        unit = F.when(c >= 1024**k, F.concat(F.format_string("%.1f", F.bround(c / float(1024**k), 1)), F.lit(" " + name))).otherwise(unit)
    return F.coalesce(unit, F.lit("0.0 B"))


def file_extension(c: Column) -> Column:
    """What follows the last dot of a path, in lower case; empty without one."""
    return F.lower(F.regexp_extract(c, r"\.([^./\\]+)$", 1))
