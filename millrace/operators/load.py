"""Loading entities: what is new, how conflicts end, what changed and where it came from.

A load reads one snapshot of the entities and makes the next one; nothing overwrites what
it reads.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, NumericType, StructType

from millrace.operators.resolve import MatchRule, matches_between
from millrace.session import shuffled

SURE, FUZZY = 0.9, 0.85
STRATEGIES = ("newer_wins", "score_based", "conservative", "merge", "manual_review")


def match_key(columns: list[str]) -> Column:
    """MD5 of the key fields, trimmed and in lower case."""
    return F.md5(F.concat_ws("|", *(F.coalesce(F.lower(F.trim(F.col(c).cast("string"))), F.lit("")) for c in columns)))


def classify(incoming: DataFrame, existing: DataFrame, key: str, key_fields: list[str], rules: list[MatchRule]) -> DataFrame:
    """incoming with `action` (update, duplicate, new), the existing key and the confidence.

    Equal key fields are an update with confidence 1; of the rest, what is more than 0.85 like
    an existing record is a duplicate of the best one.
    """
    known = existing.groupBy(match_key(key_fields).alias("_k")).agg(F.min(key).alias("_exact"))
    exact = incoming.withColumn("_k", match_key(key_fields)).join(shuffled(known), "_k", "left").drop("_k")
    left = exact.where("_exact IS NULL").drop("_exact")
    fuzzy = matches_between(left, existing, key, rules, FUZZY).where(F.col("score") > FUZZY).withColumnsRenamed({f"existing_{key}": "_like", "score": "_score"})
    out = exact.join(shuffled(fuzzy), key, "left")
    action = F.when(F.col("_exact").isNotNull(), "update").when(F.col("_like").isNotNull(), "duplicate").otherwise("new")
    return out.select(*incoming.columns, action.alias("action"), F.coalesce("_exact", "_like").alias(f"existing_{key}"), F.when(F.col("_exact").isNotNull(), 1.0).otherwise(F.col("_score")).alias("confidence"))


def _overlaid(old: Column, new: Column, kind: DataType) -> Column | None:
    """Old and new together, for kinds that can hold both."""
    if isinstance(kind, ArrayType):
        return F.array_union(old, new)
    if isinstance(kind, MapType):
        return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
    if isinstance(kind, StructType):
        return F.struct(*(F.coalesce(new[f.name], old[f.name]).alias(f.name) for f in kind.fields))
    return None


def resolved(strategy: str, old: Column, new: Column, kind: DataType, confidence: Column | None = None) -> Column:
    """The value of one field after a conflict; what only one side has is always kept."""
    both = _overlaid(old, new, kind)
    match strategy:
        case "newer_wins":
            return F.coalesce(new, old)
        case "conservative" | "manual_review":
            return F.coalesce(old, new)
        case "score_based":
            unsure = F.greatest(old, new) if isinstance(kind, NumericType) else F.array_union(old, new) if isinstance(kind, ArrayType) else old
            return F.when(confidence >= SURE, F.coalesce(new, old)).otherwise(F.coalesce(unsure, old, new))
        case "merge":
            return F.coalesce(both, old, new) if both is not None else F.coalesce(old, new)
    raise ValueError(f"no conflict strategy {strategy}")


def joined(existing: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Both sides of each key: `key`, `old` and `new` structs, null where a side lacks it."""
    old = existing.select(key, F.struct(*(c for c in existing.columns if c != key)).alias("old"))
    new = incoming.select(key, F.struct(*(c for c in incoming.columns if c != key)).alias("new"))
    return old.join(new, key, "full")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, fields: list[str], strategy: str) -> DataFrame:
    """The next snapshot of existing (key, fields, confidence, version, duplicate_count).

    New keys enter with version 1; known ones are resolved field by field, their version goes
    up if that changed anything, and confidence is the larger of both.
    """
    pairs = joined(existing, incoming, key, fields)
    kinds = {f.name: f.dataType for f in existing.schema.fields}
    sure = F.coalesce(F.col("new.confidence"), F.lit(0.0))
    values = {c: resolved(strategy, F.col(f"old.{c}"), F.col(f"new.{c}"), kinds[c], sure) for c in fields}
    changed = reduce(lambda a, b: a | b, (~F.col(f"old.{c}").eqNullSafe(v) for c, v in values.items()))
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    version = F.when(F.col("old").isNull(), 1).otherwise(F.col("old.version") + F.when(both & changed, 1).otherwise(0))
    return pairs.select(
        key,
        *(v.alias(c) for c, v in values.items()),
        F.greatest("old.confidence", "new.confidence").alias("confidence"),
        version.cast("int").alias("version"),
        F.coalesce("old.duplicate_count", F.lit(0)).alias("duplicate_count"),
    )


def with_duplicates(entities: DataFrame, duplicates: DataFrame, key: str, master: str) -> DataFrame:
    """entities with the number of duplicates that were found for each added."""
    found = duplicates.groupBy(F.col(master).alias(key)).agg(F.count("*").alias("_more"))
    return entities.join(shuffled(found), key, "left").withColumn("duplicate_count", F.col("duplicate_count") + F.coalesce("_more", F.lit(0))).drop("_more")


def duplicate_edges(duplicates: DataFrame, key: str, master: str) -> DataFrame:
    return duplicates.select(F.col(key).alias("entity_from"), F.col(master).alias("entity_to"), F.lit("DUPLICATE_OF").alias("relationship_type"), F.col("confidence").alias("relationship_strength"))


def conflicts(existing: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row for each field in which both sides have a value and not the same: what manual review is given."""
    differs = lambda c: F.col(f"old.{c}").isNotNull() & F.col(f"new.{c}").isNotNull() & (F.col(f"old.{c}") != F.col(f"new.{c}"))
    return _told(joined(existing, incoming, key, fields), key, fields, differs)


def _told(pairs: DataFrame, key: str, fields: list[str], test) -> DataFrame:
    cell = lambda c: F.struct(F.lit(c).alias("field"), F.col(f"old.{c}").cast("string").alias("old_value"), F.col(f"new.{c}").cast("string").alias("new_value"))
    found = F.array_compact(F.array(*(F.when(test(c), cell(c)) for c in fields)))
    return pairs.select(key, F.inline(found))


def change_log(before: DataFrame, after: DataFrame, key: str, fields: list[str], table: str) -> DataFrame:
    """A row for each field of each record that was inserted, updated or deleted between two snapshots."""
    pairs = joined(before, after, key, fields)
    operation = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").otherwise("UPDATE")
    rows = _told(pairs.withColumn("operation", operation), key, fields, lambda c: ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")))
    named = pairs.select(key, operation.alias("operation"))
    return rows.join(named, key).select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("record_id"), "operation", "field", "old_value", "new_value")


def lineage(source: str, target: str, mappings: dict[str, tuple[str, str]], execution_id: str) -> list[tuple[str, ...]]:
    """Edges (source entity, field, target entity, field, transformation, execution) of mapped fields, by target."""
    return [(source, src, target, to, how, execution_id) for to, (src, how) in mappings.items()]


def load_statistics(classified: DataFrame) -> DataFrame:
    """Counts and rates of what a load did."""
    n = F.count("*")
    share = lambda a: F.round(F.try_divide(F.count_if(F.col("action") == a) * 100.0, n), 6)
    return classified.agg(n.alias("total"), *(F.count_if(F.col("action") == a).alias(a) for a in ("new", "update", "duplicate")), share("new").alias("load_rate"), share("duplicate").alias("dedup_rate"), share("update").alias("merge_rate"))


def search(df: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Records that hold a term in any of the columns, whatever its case."""
    shown = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return df.where(reduce(lambda a, b: a | b, (F.col(c).cast("string").ilike(f"%{shown}%") for c in columns)))


def types_with_counts(df: DataFrame, kind: str) -> DataFrame:
    return df.groupBy(kind).agg(F.count("*").alias("n"))


def related(edges: DataFrame, node: str, src: str = "entity_from", dst: str = "entity_to") -> DataFrame:
    """Edges seen from either end: `node`, `other` and `direction`; two scans of equal keys instead of an OR."""
    rest = [c for c in edges.columns if c not in (src, dst)]
    outgoing = edges.select(F.col(src).alias(node), F.col(dst).alias("other"), F.lit("outgoing").alias("direction"), *rest)
    return outgoing.unionAll(edges.select(F.col(dst), F.col(src), F.lit("incoming"), *rest))
