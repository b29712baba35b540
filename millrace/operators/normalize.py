"""Normalisation: dictionaries, scales, lookups and derived columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.functions.expressions import parse

# Codes by lower-cased word.
LOOKUPS: dict[str, dict[str, str]] = {
    "countries": {"indonesia": "ID", "id": "ID", "ind": "ID", "singapore": "SG", "sg": "SG", "malaysia": "MY", "my": "MY", "thailand": "TH", "th": "TH", "united states": "US", "us": "US", "usa": "US"},
    "currencies": {"rupiah": "IDR", "idr": "IDR", "rp": "IDR", "dollar": "USD", "usd": "USD", "sgd": "SGD", "euro": "EUR", "eur": "EUR"},
    "gender": {"male": "M", "m": "M", "man": "M", "laki-laki": "M", "l": "M", "female": "F", "f": "F", "woman": "F", "perempuan": "F", "p": "F"},
    "education_level": {"sd": "ELEMENTARY", "elementary": "ELEMENTARY", "smp": "MIDDLE", "middle school": "MIDDLE", "sma": "HIGH", "high school": "HIGH", "diploma": "DIPLOMA", "d3": "DIPLOMA", "bachelor": "BACHELOR", "s1": "BACHELOR", "master": "MASTER", "s2": "MASTER", "phd": "PHD", "doctorate": "PHD", "s3": "PHD"},
    "marital_status": {"single": "S", "belum menikah": "S", "married": "M", "menikah": "M", "divorced": "D", "cerai": "D", "widowed": "W", "janda": "W", "duda": "W"},
}
# Prefixes of phone numbers, words of addresses and of company kinds.
PHONE_PREFIXES = {"indonesia": ("+62", "62", "0"), "singapore": ("+65", "65"), "malaysia": ("+60", "60"), "thailand": ("+66", "66"), "us": ("+1", "1")}
ADDRESS_WORDS = {"street": ("st", "str", "street"), "avenue": ("ave", "av", "avenue"), "road": ("rd", "road"), "boulevard": ("blvd", "boulevard"), "jalan": ("jl", "jalan"), "gang": ("gg", "gang"), "komplek": ("komp", "komplek", "complex"), "perumahan": ("perum", "perumahan")}
BUSINESS_TYPES = {"pt": ("pt", "perseroan terbatas", "incorporated", "inc"), "cv": ("cv", "commanditaire vennootschap"), "ltd": ("ltd", "limited", "terbatas"), "corp": ("corp", "corporation", "korporasi"), "llc": ("llc", "limited liability company")}


def _map(table: dict[str, Any]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def code_of(c: Column, table: str | dict[str, str]) -> Column:
    """The code of a word in a dictionary, else the word in upper case."""
    words = LOOKUPS[table] if isinstance(table, str) else table
    key = F.lower(text.strip(c))
    return F.coalesce(F.element_at(_map(words), key), F.upper(text.strip(c)))


def phone(c: Column, country: str = "indonesia") -> Column:
    """Digits with a country prefix in front unless one is there."""
    plain = F.regexp_replace(c, r"[\s\-()]", "")
    prefixes = PHONE_PREFIXES[country]
    known = reduce(lambda a, b: a | b, (plain.startswith(p) for p in prefixes))
    return F.when(known, plain).otherwise(F.concat(F.lit(prefixes[0]), F.regexp_replace(plain, "^0+", "")))


def address(c: Column) -> Column:
    words = {short: full for full, shorts in ADDRESS_WORDS.items() for short in shorts}
    tokens = F.split(F.lower(text.strip(c)), r"(?U)\s+")
    return text.title(F.array_join(F.transform(tokens, lambda t: F.coalesce(F.element_at(_map(words), t), t)), " "))


def business_type(c: Column) -> Column:
    """The first kind, in order, one of whose words the text contains; else the text in lower case."""
    low = F.lower(text.strip(c))
    out = low
    for kind, names in reversed(BUSINESS_TYPES.items()):
        out = F.when(reduce(lambda a, b: a | b, (low.contains(n) for n in names)), F.lit(kind)).otherwise(out)
    return out


def standard(c: Column) -> Column:
    return F.lower(text.strip(c))


def category_by_words(c: Column, table: dict[str, list[str]], other: str = "OTHER") -> Column:
    """The first category one of whose keywords the text contains."""
    low, out = F.lower(c), F.lit(other)
    for name, keys in reversed(table.items()):
        out = F.when(reduce(lambda a, b: a | b, (low.contains(k.lower()) for k in keys)), F.lit(name)).otherwise(out)
    return out


def category_by_range(c: Column, table: dict[str, tuple[float, float]], other: str = "OTHER") -> Column:
    """The first category whose range, both ends included, holds the number."""
    out = F.lit(other)
    for name, (low, high) in reversed(table.items()):
        out = F.when(c.between(low, high), F.lit(name)).otherwise(out)
    return out


def label_encode(c: Column, table: dict[str, int]) -> Column:
    return F.coalesce(F.element_at(_map({k.lower(): str(v) for k, v in table.items()}), F.lower(c.cast("string"))), c.cast("string"))


def one_hot(c: Column, prefix: str, categories: Iterable[str]) -> list[Column]:
    return [F.coalesce(c == v, F.lit(False)).cast("int").alias(f"{prefix}_{v}") for v in categories]


def min_max(c: Column, low: float, high: float, new_low: float = 0.0, new_high: float = 1.0) -> Column:
    if high == low:
        return c
    return text.half_even((c - low) / (high - low) * (new_high - new_low) + new_low, 2)


def z_score(c: Column, mean: float, std: float) -> Column:
    return text.half_even((c - mean) / std, 2) if std else c


def robust_scale(c: Column, median: Column, low: Column, high: Column) -> Column:
    """Distance from the median in interquartile ranges."""
    return F.try_divide(c - median, high - low)


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, target: str, default: Any = None) -> DataFrame:
    """A left join on the lower-cased key; the table is broadcast only if the optimizer knows it to be small."""
    side = table.select(F.lower(F.col(table_key).cast("string")).alias("_key"), F.col(value).alias(target)).dropDuplicates(["_key"])
    out = df.join(side, F.lower(F.col(key).cast("string")) == F.col("_key"), "left").drop("_key")
    return out.withColumn(target, F.coalesce(F.col(target), F.lit(default))) if default is not None else out


def business_rules(df: DataFrame, rules: list[dict[str, Any]]) -> DataFrame:
    """Rules by priority; each sees what the ones before it wrote.

    A rule has a condition and sets a field, calculates it, or copies another.
    """
    for rule in sorted(rules, key=lambda r: r.get("priority", 0)):
        target = rule["field"]
        if "set" in rule:
            value = F.lit(rule["set"])
        elif "calculate" in rule:
            value = parse(rule["calculate"])
        else:
            value = F.col(rule["copy"])
        old = F.col(target) if target in df.columns else F.lit(None)
        df = df.withColumn(target, F.when(parse(rule["condition"]), value).otherwise(old))
    return df


def concatenated(columns: list[Column], separator: str = " ") -> Column:
    """Without what is missing or empty; null if nothing is left."""
    return F.nullif(F.concat_ws(separator, *(F.nullif(c.cast("string"), F.lit("")) for c in columns)), F.lit(""))


def calculated(expression: str) -> Column:
    return parse(expression)


def conditional(condition: str, yes: Column, no: Column) -> Column:
    return F.when(parse(condition), yes).otherwise(no)


def keep_originals(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({f"_original_{n}": F.col(n) for n in names})


def normalization_score(fields: list[Column], badly_formed: list[Column], changed: Column) -> Column:
    """0.6 of (0.6 completeness + 0.4 consistency) and 0.4 of (0.7 + 0.3 share changed); each bad format costs 0.1 of consistency."""
    filled = reduce(lambda a, b: a + b, (F.when(F.trim(c.cast("string")) != "", 1).otherwise(0) for c in fields)) / len(fields)
    consistent = F.lit(1.0) - reduce(lambda a, b: a + b, (F.when(c, 0.1).otherwise(0.0) for c in badly_formed)) if badly_formed else F.lit(1.0)
    base = 0.6 * filled + 0.4 * F.greatest(F.lit(0.0), consistent)
    return 0.6 * base + 0.4 * (0.7 + 0.3 * changed)
