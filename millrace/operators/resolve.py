"""Entity resolution: similar records, groups of them, and what becomes of a group.

Records that agree in all compared fields are one class; only classes are compared. Which of
them are is found without forming the pairs of a block: a weighted score of at least T over
fields of which some are blocking fields means that a blocking field has a similarity of at
least t (see `field_threshold`), and two values so similar share a key:

- edit distance: of k + 1 segments of the shorter value one stands unchanged in the longer,
  near its place. Where a key is too frequent, its values get longer keys: of k + 2 segments
  two stand unchanged. Short values travel with their keys, so that only similar ones become a pair.
- sets (of letter pairs, of words): two sets that share enough members share one among
  their rarest.
- codes: they are equal. Where a code is too frequent, its records are compared by another field: if the
  code alone doesn't make a match, one of the other fields has to be similar enough, so the keys of these
  fields say what to compare; records that lack all of them match every record of their code.

Every pair that shares a key is then scored, so that the result is that of comparing all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators.components import connected_components, salted_join
from millrace.session import settle, settle_table, shuffled

GLOBAL_THRESHOLD, HIGH, MEDIUM = 0.85, 0.9, 0.7
BEST = 5
#: Values under one key beyond which they are filed again under longer keys: about as many comparisons cost as much as these keys.
FREQUENT = 100
#: Characters up to which a value travels with its keys.
CARRIED = 32
#: Different lengths of values up to which only these are looked for.
MOST_LENGTHS = 200
_ROUND = 1e-9


@dataclass
class MatchRule:
    """How one field is compared; blocking fields say which records can match at all."""

    field: str
    strategy: str = "levenshtein"
    weight: float = 1.0
    threshold: float = 0.8
    preprocess: list[str] = field(default_factory=list)
    blocking: bool = False
    weights: dict[str, float] | None = None  # of a composite


def blocking_keys(c: Column) -> Column:
    """The distinct keys of a value: whole, its first 2 to 4 characters, phonetic code, without signs, first and last word."""
    low = F.lower(c)
    parts = F.filter(F.split(text.strip(low), r"(?U)\s+"), lambda w: w != "")
    plain = F.lower(F.regexp_replace(c, r"(?U)[^\w]", ""))
    keys = [F.lower(text.strip(c)), *(F.when(F.length(c) >= n, F.left(low, F.lit(n))) for n in (2, 3, 4)), text.soundex(c), F.when(plain != low, plain)]
    keys.append(F.when(F.size(parts) >= 2, F.concat_ws("_", F.get(parts, F.lit(0)), F.element_at(parts, -1))))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def similarity(rule: MatchRule, a: Column, b: Column) -> Column:
    if rule.strategy == "composite":
        return text.composite_similarity(a, b, rule.weights or {"levenshtein": 1.0})
    return text.SIMILARITIES[rule.strategy](a, b)


def field_threshold(rules: list[MatchRule], threshold: float) -> float:
    """The least similarity that some blocking field of a matching pair has.

    Of a pair that has blocking fields of weight B and others of weight O, none null, the
    others add O at most: a blocking field has T - (1 - T) O / B or more. B is at least the
    smallest weight of a blocking field.
    """
    own = [r.weight for r in rules if r.blocking]
    if not own:
        raise ValueError("matching takes at least one blocking field")
    least = threshold - (1 - threshold) * sum(r.weight for r in rules if not r.blocking) / min(own)
    if least <= 0.5:
        raise ValueError("blocking fields weigh too little to bound the pairs: a pair may match with less than half of each")
    return least


# -- keys that similar values share ------------------------------------------------------


def _segment(m: str, n: str, i: str) -> tuple[str, str]:
    """SQL for start and length of the i-th of n even segments of m characters; the longer ones come last."""
    short = f"({n} - {m} % {n})"
    return f"cast({i} * ({m} div {n}) + greatest(0, {i} - {short}) AS int)", f"cast({m} div {n} + if({i} >= {short}, 1, 0) AS int)"


def _places(m: str, n: str, i: str, p: str, body: str) -> str:
    """SQL: body for each place p at which the i-th segment may stand in v, of l characters."""
    start, size = _segment(m, n, i)
    low, high = f"greatest(0, {start} - cast(floor((k - (l - {m})) / 2) AS int))", f"least(l - {size}, {start} + cast(floor((k + (l - {m})) / 2) AS int))"
    return f"transform(filter(sequence({low}, greatest({low}, {high})), {p} -> {p} <= {high}), {p} -> {body})"


def edit_keys(values: DataFrame, t: float, agree: int = 1, lengths: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, side, v, key) under which values (id, side, v) are filed and looked for; `agree` segments of a key are unchanged.

    v is null where it has more than CARRIED characters. lengths: those that filed values have, if known.
    """
    rows = values.where("v <> ''").selectExpr("id", "side", "v", "length(v) AS l", f"cast(floor({1 - t} * length(v) + {_ROUND}) AS int) AS k")
    last = f"cast(floor({1 - t} * floor(l / {t} + {_ROUND}) + {_ROUND}) AS int)"
    shorter = "sequence(l - k, l)" if lengths is None else f"filter(sequence(l - k, l), m -> array_contains(array({', '.join(map(str, lengths))}), m))"
    cut = lambda m, n, i, p: f"substr(v, {p} + 1, {_segment(m, n, i)[1]})"
    if agree == 1:
        filed = f"flatten(transform(sequence(k, {last}), e -> transform(sequence(0, e), i -> xxhash64(l, e, i, {cut('l', '(e + 1)', 'i', _segment('l', '(e + 1)', 'i')[0])}))))"
        found = _places("m", "(k + 1)", "i", "p", f"xxhash64(m, k, i, {cut('m', '(k + 1)', 'i', 'p')})")
        sought = f"flatten(transform({shorter}, m -> flatten(transform(sequence(0, k), i -> {found}))))"
    else:
        one, two = (cut("l", "(e + 2)", x, _segment("l", "(e + 2)", x)[0]) for x in ("i", "j"))
        filed = f"flatten(transform(sequence(k, {last}), e -> flatten(transform(sequence(0, e), i -> transform(sequence(i + 1, e + 1), j -> xxhash64(l, e, i, j, {one}, {two}))))))"
        inner = _places("m", "(k + 2)", "j", "q", f"xxhash64(m, k, i, j, {cut('m', '(k + 2)', 'i', 'p')}, {cut('m', '(k + 2)', 'j', 'q')})")
        outer = _places("m", "(k + 2)", "i", "p", inner)
        sought = f"flatten(transform({shorter}, m -> flatten(transform(sequence(0, k), i -> flatten(transform(sequence(i + 1, k + 1), j -> flatten({outer})))))))"
    return tuple(rows.selectExpr("id", "side", f"if(l <= {CARRIED}, v, NULL) AS v", f"explode(array_distinct({e})) AS key") for e in (filed, sought))


def _pairs(filed: DataFrame, sought: DataFrame, two_sided: bool, test: str = "true") -> DataFrame:
    other = F.col("x.side") < F.col("y.side") if two_sided else F.col("x.id") < F.col("y.id")
    flipped = F.col("x.side") > F.col("y.side") if two_sided else F.col("x.id") > F.col("y.id")
    met = filed.alias("x").join(shuffled(sought.alias("y")), F.col("x.key") == F.col("y.key")).where(other | flipped).where(test)
    return met.select(F.when(other, F.col("x.id")).otherwise(F.col("y.id")).alias("a"), F.when(other, F.col("y.id")).otherwise(F.col("x.id")).alias("b"))


def _edit_pairs(values: DataFrame, t: float, two_sided: bool) -> DataFrame:
    lengths = [r.l for r in values.where("v <> ''").select(F.length("v").alias("l")).distinct().limit(MOST_LENGTHS + 1).collect()]
    lengths = sorted(lengths) if 0 < len(lengths) <= MOST_LENGTHS else None
    filed, sought = edit_keys(values, t, 1, lengths)
    # y is as long as x or longer; what is as long is found from either side, and one of them is enough
    first = "x.side < y.side" if two_sided else "x.id < y.id"
    near = f"x.v IS NULL OR y.v IS NULL OR (length(x.v) < length(y.v) OR {first}) AND levenshtein(x.v, y.v, cast(floor({1 - t} * length(y.v) + {_ROUND}) AS int)) >= 0"
    counts = filed.select("key", F.lit(1).alias("f"), F.lit(0).alias("s")).unionAll(sought.select("key", F.lit(0), F.lit(1)))
    frequent = settle(counts.groupBy("key").agg(F.sum("f").alias("f"), F.sum("s").alias("s")).where((F.col("f") > 0) & (F.col("s") > FREQUENT) | (F.col("f") > FREQUENT) & (F.col("s") > 0)).select("key"))
    if frequent.isEmpty():
        return _pairs(filed, sought, two_sided, near)
    plain = _pairs(filed.join(shuffled(frequent), "key", "left_anti"), sought, two_sided, near)
    ids = filed.join(shuffled(frequent), "key", "left_semi").select("id", "side").unionAll(sought.join(shuffled(frequent), "key", "left_semi").select("id", "side")).distinct()
    return plain.unionAll(_pairs(*edit_keys(values.join(shuffled(ids), ["id", "side"], "left_semi"), t, 2, lengths), two_sided, near))


def _set_pairs(values: DataFrame, members: Callable[[Column], Column], share: float, two_sided: bool) -> DataFrame:
    """Pairs of values whose sets have one of their rarest members in common; share: of a set's members, at least so many are shared."""
    rows = values.select("id", "side", F.explode(members(F.col("v"))).alias("m"))
    often = rows.groupBy("m").agg(F.count("*").alias("n"))
    ranked = rows.join(often, "m").groupBy("id", "side").agg(F.sort_array(F.collect_list(F.struct("n", "m"))).alias("s"))
    size = F.size("s") - F.ceil(F.lit(share) * F.size("s") - _ROUND) + 1
    keys = ranked.select("id", "side", F.explode(F.slice("s", F.lit(1), size.cast("int"))).alias("x")).select("id", "side", F.xxhash64("x.m").alias("key"))
    return _pairs(keys, keys, two_sided)


#: Codes by the strategy that compares them.
CODES: dict[str, Callable[[Column], Column]] = {"exact": lambda c: c, "soundex": text.soundex, "metaphone": text.metaphone, "double_metaphone": text.metaphone}
SETS_AND_EDITS = ("levenshtein", "ml", "jaccard", "cosine", "semantic")


def _coded_pairs(classes: DataFrame, rules: list[MatchRule], i: int, threshold: float, two_sided: bool) -> DataFrame:
    """Pairs of classes (id, side, _m0, ...) with equal codes of the i-th field that can reach the threshold."""
    code = CODES[rules[i].strategy]
    others = [k for k in range(len(rules)) if k != i]
    keys = classes.withColumn("key", F.xxhash64(code(F.col(f"_m{i}")))).where(f"_m{i} IS NOT NULL AND _m{i} <> ''")
    # with a weight P of other fields that neither lacks, their mean is T - w (1 - T) / P or more, and so is one of them
    need = threshold - rules[i].weight * (1 - threshold) / min((rules[k].weight for k in others), default=1)
    frequent = settle(keys.groupBy("key").count().where(F.col("count") > FREQUENT).select("key"))
    own = keys.select("id", "side", "key")
    if frequent.isEmpty() or not others or need <= 0.5 or any(rules[k].strategy not in (*CODES, *SETS_AND_EDITS) for k in others):
        return _pairs(own, own, two_sided)
    rare = own.join(frequent, "key", "left_anti")
    deep = settle(keys.join(frequent, "key", "left_semi"))
    bare = deep.where(reduce(lambda a, b: a & b, (F.col(f"_m{k}").isNull() for k in others))).select("id", "side", "key")
    found = [_pairs(rare, rare, two_sided), _pairs(bare, deep.select("id", "side", "key"), two_sided)]
    found += [candidate_pairs(deep.select("id", "side", F.col(f"_m{k}").alias("v")), rules[k].strategy, need, two_sided) for k in others]
    return reduce(DataFrame.unionAll, found)


def _code_pairs(values: DataFrame, code: Callable[[Column], Column], two_sided: bool) -> DataFrame:
    keys = values.select("id", "side", F.xxhash64(code(F.col("v"))).alias("key")).where("v <> ''")
    return _pairs(keys, keys, two_sided)


def candidate_pairs(values: DataFrame, strategy: str, t: float, two_sided: bool = False) -> DataFrame:
    """(a, b) of values (id, side, v) among which are all that are at least t alike; of two sides, a is of the smaller."""
    values = values.where("v IS NOT NULL")
    match strategy:
        case "levenshtein" | "ml":
            return _edit_pairs(values, t, two_sided)
        case "jaccard":
            return _set_pairs(values, text.bigrams, t, two_sided)
        case "cosine":
            return _set_pairs(values, text.bigrams, t * t, two_sided)
        case "semantic":
            return _set_pairs(values, text.words, t, two_sided)
        case "exact" | "soundex" | "metaphone" | "double_metaphone":
            return _code_pairs(values, CODES[strategy], two_sided)
    raise ValueError(f"{strategy} can't tell which records to compare; use it for fields that don't block")


# -- records -----------------------------------------------------------------------------


def prepared(df: DataFrame, rules: list[MatchRule]) -> DataFrame:
    """df with the compared form of each field, `_m0`, `_m1`, ..., and `_class`, equal where all of these are."""
    shown = {f"_m{i}": reduce(lambda c, p: text.PREPROCESSORS[p](c), r.preprocess, F.col(r.field).cast("string")) for i, r in enumerate(rules)}
    text_of = F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})
    # the text itself where it has fewer bytes than a digest
    return df.withColumns(shown).withColumn("_class", F.when(F.octet_length(text_of) < 32, text_of.cast("binary")).otherwise(F.unhex(F.sha2(text_of, 256))))


def record_score(rules: list[MatchRule], left: str = "l", right: str = "r") -> Column:
    """The weighted mean similarity of the fields that neither record lacks; 0 if there is none."""
    pairs = [(r, F.col(f"{left}._m{i}"), F.col(f"{right}._m{i}")) for i, r in enumerate(rules)]
    both = lambda a, b: a.isNotNull() & b.isNotNull()
    total = reduce(lambda x, y: x + y, (F.when(both(a, b), similarity(r, a, b) * r.weight).otherwise(0.0) for r, a, b in pairs))
    weight = reduce(lambda x, y: x + y, (F.when(both(a, b), F.lit(float(r.weight))).otherwise(0.0) for r, a, b in pairs))
    return F.coalesce(F.try_divide(total, weight), F.lit(0.0))


def confidence(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def _classes(rows: DataFrame, key: str, rules: list[MatchRule]) -> DataFrame:
    return rows.groupBy("_class", *(f"_m{i}" for i in range(len(rules)))).agg(F.min(key).alias("id"), F.count("*").alias("members"))


def _linked(classes: DataFrame, rules: list[MatchRule], threshold: float, two_sided: bool) -> DataFrame:
    t = field_threshold(rules, threshold)
    by_value = lambda i, r: candidate_pairs(classes.select("id", "side", F.col(f"_m{i}").alias("v")), r.strategy, t, two_sided)
    pairs = [_coded_pairs(classes, rules, i, threshold, two_sided) if r.strategy in CODES else by_value(i, r) for i, r in enumerate(rules) if r.blocking]
    met = reduce(lambda x, y: x.unionAll(y), pairs).distinct()
    own = lambda name: shuffled(classes.alias(name))
    sides = (F.col("l.side") == 0) & (F.col("r.side") == 1) if two_sided else F.lit(True)
    scored = met.join(own("l"), F.col("a") == F.col("l.id")).join(own("r"), F.col("b") == F.col("r.id")).where(sides)
    return scored.select("a", "b", record_score(rules).alias("score")).where(F.col("score") >= threshold)


def similar_records(df: DataFrame, key: str, rules: list[MatchRule], threshold: float = GLOBAL_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Links and members.

    links: a, b, score and confidence of pairs of classes of equal records, by the smallest
    key of each. members: key, and the class it belongs to as `representative`.
    """
    rows = prepared(df, rules)
    classes = settle_table(_classes(rows, key, rules).withColumn("side", F.lit(0)))
    links = _linked(classes, rules, threshold, False).withColumn("confidence", confidence(F.col("score")))
    members = rows.select(key, "_class").join(shuffled(classes.select("_class", F.col("id").alias("representative"))), "_class").drop("_class")
    return links, members


def matches_between(incoming: DataFrame, existing: DataFrame, key: str, rules: list[MatchRule], threshold: float) -> DataFrame:
    """The best existing record of each incoming one that has any: key, existing key and score."""
    new, old = prepared(incoming, rules), prepared(existing, rules)
    classes = settle_table(_classes(new, key, rules).withColumn("side", F.lit(0)).unionByName(_classes(old, key, rules).withColumn("side", F.lit(1))))
    own, theirs = (classes.where(F.col("side") == s) for s in (0, 1))
    links = _linked(classes.withColumn("id", F.struct("side", "id")), rules, threshold, True).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "score")
    same = own.alias("l").join(shuffled(theirs.alias("r")), "_class").select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.lit(1.0).alias("score"))
    best = links.unionAll(same).groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("b"))).alias("m"))
    told = best.select("a", F.col("m.b").alias(f"existing_{key}"), (-F.col("m.s")).alias("score"))
    classed = new.select(key, "_class").join(shuffled(own.select("_class", F.col("id").alias("a"))), "_class")
    return classed.join(shuffled(told), "a").select(key, f"existing_{key}", "score")


def best_matches(links: DataFrame, most: int = BEST) -> DataFrame:
    """The best links of each record, in both directions, with their place."""
    both = links.select("a", "b", "score").unionAll(links.select("b", "a", "score"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return both.withColumn("place", place).where(F.col("place") <= most)


def groups(links: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """key and `master`, the smallest key of the records it is linked with, for each record."""
    roots = connected_components(links, "a", "b")
    named = members.join(roots.withColumnRenamed("node", "representative"), "representative", "left")
    return named.select(key, F.coalesce("component", "representative").alias("master"))


def dropped_in_order(links: DataFrame) -> DataFrame:
    """node of each record that isn't kept, if every record, by key, is kept unless it is linked with a smaller kept one.

    In rounds: records without a smaller link are kept, what they are linked with is dropped, and
    links of both are done. For links at random the number of rounds grows with the logarithm of their number; only a
    chain of links by ascending keys takes a round for every two of them.
    """
    left, gone = settle_table(links.select("a", "b").distinct()), []
    n = left.count()
    while n:
        later = left.select(F.col("b").alias("a")).distinct().withColumn("later", F.lit(True))
        marked = settle_table(salted_join(left, later, "a", n, True))
        out = settle_table(marked.where("later IS NULL").select("b").distinct().withColumn("out", F.lit(True)))
        gone.append(out.select(F.col("b").alias("node")))
        rest = salted_join(marked.where("later").select("a", "b"), out, "b", n, True).where("out IS NULL").select("a", "b")
        left = settle_table(salted_join(rest, out.withColumnRenamed("b", "a"), "a", n, True).where("out IS NULL").select("a", "b"))
        n = left.count()
    return reduce(DataFrame.unionAll, gone) if gone else left.select(F.col("a").alias("node"))


def sequential(links: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """key, is_duplicate, duplicate_of and match_score of each record, compared with those that were kept before it, by key.

    A record that is like a kept one is a duplicate of the one it is most like (the smallest of equal ones), and isn't kept itself; so records
    that only have a dropped one in common stay apart. Copies of a kept record are its duplicates, copies of a dropped one are duplicates of the same record.
    """
    links = settle_table(links.select("a", "b", "score"))
    gone = dropped_in_order(links)
    kept = links.join(shuffled(gone.withColumnRenamed("node", "a")), "a", "left_anti").join(shuffled(gone.withColumnRenamed("node", "b")), "b", "left_semi")
    best = kept.groupBy("b").agg(F.max(F.struct("score", F.struct((-F.col("a")).alias("minus"), F.col("a")))).alias("m"))
    told = best.select(F.col("b").alias("representative"), F.col("m.col2.a").alias("like"), F.col("m.score").alias("score"))
    rows = members.join(shuffled(told), "representative", "left")
    copy = F.col(key) != F.col("representative")
    of = F.coalesce("like", F.when(copy, F.col("representative")))
    return rows.select(key, of.isNotNull().alias("is_duplicate"), of.alias("duplicate_of"), F.coalesce("score", F.when(copy, F.lit(1.0))).alias("match_score"))


def group_statistics(grouped: DataFrame) -> DataFrame:
    sizes = grouped.groupBy("master").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("records"), F.count("*").alias("entities"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.sum(F.col("n") - 1).alias("duplicates"), F.max("n").alias("largest_group"))


def fill_ratio(columns: list[str]) -> Column:
    """The share of fields that are neither null nor blank."""
    filled = reduce(lambda a, b: a + b, (F.coalesce((F.trim(F.col(c).cast("string")) != "").cast("int"), F.lit(0)) for c in columns))
    return filled / float(len(columns))


def merged(df: DataFrame, key: str, grouped: DataFrame, strategy: str = "merge") -> DataFrame:
    """One record for each master: its `first` or `last`, the `best_quality` one, or the longest value of each field (`merge`)."""
    fields = [c for c in df.columns if c != key]
    rows = df.join(grouped, key)
    if strategy == "merge":
        longest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.length(F.col(c).cast("string")), -F.col(key))))
        return rows.groupBy("master").agg(*(longest(c).alias(c) for c in fields))
    rank = {"first": -F.col(key), "last": F.col(key), "best_quality": F.struct(fill_ratio(fields), -F.col(key))}[strategy]
    return rows.groupBy("master").agg(F.max_by(F.struct(*fields), rank).alias("_r")).select("master", "_r.*")


def entity_id(columns: list[str]) -> Column:
    """MD5 over the given fields that aren't null or empty, in order."""
    shown = F.array_compact(F.array(*(F.when(F.col(c).cast("string") != "", F.concat(F.lit(c + ":"), F.col(c).cast("string"))) for c in columns)))
    return F.md5(F.array_join(F.sort_array(shown), "|"))


def matching_score(base: Column, duplicate: Column, score: Column, similar: Column, blocked: Column) -> Column:
    """The quality of a match: seven tenths the record's own, three tenths by how it came out."""
    came = F.when(duplicate, F.when(score > 0.95, 0.3).when(score > 0.8, 0.6).otherwise(0.8)).when(similar, 1.1).otherwise(1.0) + F.when(blocked, 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * 0.7 + F.least(came, F.lit(1.0)) * 0.3))
