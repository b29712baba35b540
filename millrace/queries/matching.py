"""Similarities, entity resolution and loads."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import load as o
from millrace.operators import resolve as r
from millrace.operators.store import MatchIndex, Store, upsert_into
from millrace.queries.registry import query
from millrace.session import shared_path, table

# Both engines read these: a name and another one that is more or less like it.
PAIRS = """SELECT p_partkey, p_name AS a, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, 'e', 'a') WHEN 3 THEN substr(p_name, 2) ELSE p_type END AS b"""
P = f"({PAIRS} FROM part)"


def pairs(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("_millrace_pairs")
    return spark.sql(f"{PAIRS} FROM _millrace_pairs")


@query(f"SELECT p_partkey, (a = b)::INT::DOUBLE AS same, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS edit FROM {P}")
def sim_exact_and_edit(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return pairs(spark, sf_dir).select("p_partkey", text.exact_similarity(a, b).alias("same"), F.round(text.levenshtein_similarity(a, b), 6).alias("edit"))


@query(f"SELECT p_partkey, round(jaro_winkler_similarity(a, b), 6) AS winkler FROM {P}")
def sim_jaro_winkler(spark, sf_dir):
    return pairs(spark, sf_dir).select("p_partkey", F.round(text.jaro_winkler_similarity(F.col("a"), F.col("b")), 6).alias("winkler"))


@query()
def sim_ratio(spark, sf_dir):
    return pairs(spark, sf_dir).select("p_partkey", text.ratio_similarity(F.col("a"), F.col("b")).alias("ratio"))


_GRAMS = "list_distinct(list_transform(range(1, length({0})), lambda i: substr(lower({0}), i, 2)))"


@query(f"""SELECT p_partkey, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard, round(len(list_intersect(x, y)) / sqrt(len(x) * len(y)), 6) AS cosine FROM (SELECT p_partkey, {_GRAMS.format('a')} AS x, {_GRAMS.format('b')} AS y FROM {P})""")
def sim_sets(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return pairs(spark, sf_dir).select("p_partkey", F.round(text.jaccard_similarity(a, b), 6).alias("jaccard"), F.round(text.cosine_similarity(a, b), 6).alias("cosine"))


@query(f"""SELECT p_partkey, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS semantic FROM (SELECT p_partkey, list_distinct(string_split(lower(a), ' ')) AS x, list_distinct(string_split(lower(b), ' ')) AS y FROM {P})""")
def sim_semantic(spark, sf_dir):
    return pairs(spark, sf_dir).select("p_partkey", F.round(text.semantic_similarity(F.col("a"), F.col("b")), 6).alias("semantic"))


@query(f"""SELECT p_partkey, round((2 * (1 - levenshtein(a, b) / greatest(length(a), length(b))) + (a = b)::INT) / 3, 6) AS composite FROM {P}""")
def sim_composite(spark, sf_dir):
    return pairs(spark, sf_dir).select("p_partkey", F.round(text.composite_similarity(F.col("a"), F.col("b"), {"levenshtein": 2.0, "exact": 1.0}), 6).alias("composite"))


def _runs(c: str) -> str:
    out = c
    for d in "0123456789":
        out = f"regexp_replace({out}, '{d}+', '{d}', 'g')"
    return out


def _soundex(c: str) -> str:
    digits = f"regexp_replace(translate(substr(upper({c}), 2), 'BFPVCGJKQSXZDTLMNR0123456789', '111122222222334556'), '[^1-6]', '', 'g')"
    return f"CASE WHEN {c} <> '' THEN rpad(left(regexp_replace({_runs(f'left(upper({c}), 1) || {digits}')}, '[AEIOUHWY]', '', 'g'), 4), 4, '0') END"


@query(f"SELECT DISTINCT a AS word, {_soundex('a')} AS soundex FROM {P}")
def sim_soundex(spark, sf_dir):
    return pairs(spark, sf_dir).select(F.col("a").alias("word"), text.soundex(F.col("a")).alias("soundex")).distinct()


@query(f"""SELECT DISTINCT a AS word, left(left(w, 1) || regexp_replace(substr(w, 2), '[AEIOU]', '', 'g'), 4) AS metaphone FROM (SELECT a, replace(replace(replace(replace(replace(replace(replace(upper(a), 'PH', 'F'), 'GH', 'F'), 'CK', 'K'), 'SCH', 'SK'), 'TH', 'T'), 'SH', 'S'), 'CH', 'K') AS w FROM {P})""")
def sim_metaphone(spark, sf_dir):
    return pairs(spark, sf_dir).select(F.col("a").alias("word"), text.metaphone(F.col("a")).alias("metaphone")).distinct()


NAMES = "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Dr ' || c_name WHEN 1 THEN 'PT  ' || c_mktsegment || ' Tbk' WHEN 2 THEN ' ' || c_name || ' Ltd. ' ELSE 'O''Neil, Mrs Jane' END AS name"


@query(f"""SELECT c_custkey, lower(name) AS lowercase, upper(name) AS uppercase, trim(name) AS strip, replace(name, ' ', '') AS remove_spaces, regexp_replace(name, '[^\\w\\s]', '', 'g') AS remove_punctuation, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS normalize_whitespace, lower(trim(regexp_replace(regexp_replace(name, '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'))) AS phonetic_normalize FROM ({NAMES} FROM customer)""")
def er_preprocess(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("_millrace_names")
    d = spark.sql(f"{NAMES} FROM _millrace_names")
    return d.select("c_custkey", *(text.PREPROCESSORS[n](F.col("name")).alias(n) for n in ("lowercase", "uppercase", "strip", "remove_spaces", "remove_punctuation", "normalize_whitespace", "phonetic_normalize")))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(c_name) WHEN 1 THEN 'pt ' || lower(c_mktsegment) || ' tbk' WHEN 2 THEN lower(c_name) || ' ltd.' ELSE 'o''neil, jane' END AS untitled,
  CASE c_custkey % 4 WHEN 0 THEN 'dr ' || lower(c_name) WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN lower(c_name) || ' .' ELSE 'o''neil, mrs jane' END AS company FROM customer""")
def er_names(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("_millrace_names")
    d = spark.sql(f"{NAMES} FROM _millrace_names")
    return d.select("c_custkey", text.remove_titles(F.col("name")).alias("untitled"), text.normalize_company(F.col("name")).alias("company"))


@query(f"""SELECT DISTINCT p_name, unnest(list_distinct([lower(p_name), left(lower(p_name), 2), left(lower(p_name), 3), left(lower(p_name), 4), {_soundex('p_name')}, replace(lower(p_name), ' ', ''), replace(lower(p_name), ' ', '_')])) AS key FROM part""")
def er_blocking_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", F.explode(r.blocking_keys(F.col("p_name"))).alias("key"))


# Both engines read these: customers under made names, each a second time with one letter changed, a copy of some, and some without a segment.
ENTITIES = """SELECT c_custkey * 3 AS id, substr(md5(cast(c_custkey AS {s})), 1, 14) AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS segment, c_acctbal AS balance FROM customer
  UNION ALL SELECT c_custkey * 3 + 1, 'x' || substr(md5(cast(c_custkey AS {s})), 2, 13), c_mktsegment, c_acctbal + 1 FROM customer
  UNION ALL SELECT c_custkey * 3 + 2, CASE WHEN c_custkey % 7 = 0 THEN upper(substr(md5(cast(c_custkey AS {s})), 1, 14)) ELSE substr(md5(cast(-c_custkey - 1 AS {s})), 1, 14) END, NULL, NULL FROM customer"""
E = "(" + ENTITIES.format(s="VARCHAR") + ")"
RULES = [r.MatchRule("name", "levenshtein", 0.8, preprocess=["strip", "lowercase"], blocking=True), r.MatchRule("segment", "exact", 0.2)]
THRESHOLD = 0.9


def entities(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(ENTITIES.format(s="STRING"))


# The classes of equal records, and the score of two of them; the SQL holds every class against every other.
CLASSES = f"(SELECT min(id) AS id, lower(name) AS name, segment FROM {E} GROUP BY 2, 3)"
_S = "(0.8 * (1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))) + CASE WHEN a.segment IS NOT NULL AND b.segment IS NOT NULL THEN 0.2 * (a.segment = b.segment)::INT ELSE 0 END) / (0.8 + CASE WHEN a.segment IS NOT NULL AND b.segment IS NOT NULL THEN 0.2 ELSE 0 END)"
# Names at 13 of 14 letters equal share one of their halves.
_NEAR = "(left(a.name, 7) = left(b.name, 7) OR right(a.name, 7) = right(b.name, 7))"
LINKS = f"(SELECT a.id AS a, b.id AS b, {_S} AS score FROM {CLASSES} a JOIN {CLASSES} b ON a.id < b.id AND {_NEAR} WHERE {_S} >= {THRESHOLD})"


@query(f"SELECT a, b, round(score, 6) AS score, CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.7 THEN 'medium' ELSE 'low' END AS confidence FROM {LINKS}")
def er_links(spark, sf_dir):
    links, _ = r.similar_records(entities(spark, sf_dir), "id", RULES, THRESHOLD)
    return links.withColumn("score", F.round("score", 6))


@query(f"SELECT id, min(id) OVER (PARTITION BY lower(name), segment) AS representative FROM {E}")
def er_members(spark, sf_dir):
    return r.similar_records(entities(spark, sf_dir), "id", RULES, THRESHOLD)[1]


@query(f"SELECT * FROM (SELECT a, b, round(score, 6) AS score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b)::INT AS place FROM (SELECT a, b, score FROM {LINKS} UNION ALL SELECT b, a, score FROM {LINKS})) WHERE place <= 5")
def er_best_matches(spark, sf_dir):
    links, _ = r.similar_records(entities(spark, sf_dir), "id", RULES, THRESHOLD)
    return r.best_matches(links).withColumn("score", F.round("score", 6))


# Groups by following links from class to class until nothing new is reached.
GROUPED = f"""(WITH RECURSIVE m AS (SELECT id, min(id) OVER (PARTITION BY lower(name), segment) AS rep FROM {E}), l AS (SELECT a, b FROM {LINKS} UNION ALL SELECT b, a FROM {LINKS}),
  c(node, root) AS (SELECT DISTINCT rep, rep FROM m UNION SELECT c.node, l.b FROM c JOIN l ON c.root = l.a) SELECT id, min(root) AS master FROM m JOIN c ON rep = node GROUP BY id)"""


@query(f"SELECT * FROM {GROUPED}")
def er_groups(spark, sf_dir):
    return r.groups(*r.similar_records(entities(spark, sf_dir), "id", RULES, THRESHOLD), "id")


# Both engines read these: names of 12 letters, and each again with one, two and three letters changed, under keys in mixed order; some are the same.
CHAINED = """SELECT (c_custkey * 7 + i * 3) % 11 * 100000000 + c_custkey * 4 + i AS id, CASE WHEN c_custkey % 9 = 0 AND i = 3 THEN 'copy' ELSE concat(repeat('x', i), substr(md5(concat('', c_custkey)), i + 1, 12 - i)) END AS name FROM customer CROSS JOIN (VALUES (0), (1), (2), (3)) AS t(i)"""
SEQUENCE = f"({CHAINED})"
NAMED_ONCE = f"(SELECT min(id) AS id, name FROM {SEQUENCE} GROUP BY name)"
_ALIKE = "1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))"
# Names at 11 of 12 letters equal share one of their halves.
LINKS_LOW = f"(SELECT a.id AS a, b.id AS b, {_ALIKE} AS score FROM {NAMED_ONCE} a JOIN {NAMED_ONCE} b ON a.id < b.id AND (left(a.name, 6) = left(b.name, 6) OR right(a.name, 6) = right(b.name, 6)) WHERE {_ALIKE} >= 0.9)"
# One class after the other: kept unless it is linked with one that was kept before.
ORDERED = f"""(WITH RECURSIVE l AS (SELECT a, b, score FROM {LINKS_LOW}), c AS (SELECT b, list(a) AS smaller, row_number() OVER (ORDER BY b) AS n FROM l GROUP BY b),
  s(n, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT c.n, CASE WHEN len(list_filter(c.smaller, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, c.b) ELSE gone END FROM s JOIN c ON c.n = s.n + 1),
  g AS (SELECT unnest(gone) AS id FROM (SELECT gone FROM s ORDER BY n DESC LIMIT 1))
  SELECT b AS rep, first(a ORDER BY score DESC, a) AS duplicate_of, max(score) AS score FROM l WHERE b IN (SELECT id FROM g) AND a NOT IN (SELECT id FROM g) GROUP BY b)"""


@query(f"""SELECT id, score IS NOT NULL OR id <> m.rep AS is_duplicate, coalesce(duplicate_of, CASE WHEN id <> m.rep THEN m.rep END) AS duplicate_of, round(coalesce(score, CASE WHEN id <> m.rep THEN 1.0 END), 6) AS match_score
  FROM (SELECT id, min(id) OVER (PARTITION BY name) AS rep FROM {SEQUENCE}) m LEFT JOIN {ORDERED} o ON m.rep = o.rep""")
def er_sequential(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    links, members = r.similar_records(spark.sql(CHAINED), "id", [r.MatchRule("name", "levenshtein", blocking=True)], 0.9)
    return r.sequential(links, members, "id").withColumn("match_score", F.round("match_score", 6))


@query(f"SELECT sum(n)::BIGINT AS records, count(*) AS entities, count(*) FILTER (n > 1) AS duplicate_groups, sum(n - 1)::BIGINT AS duplicates, max(n) AS largest_group FROM (SELECT master, count(*) AS n FROM {GROUPED} GROUP BY 1)")
def er_statistics(spark, sf_dir):
    return r.group_statistics(r.groups(*r.similar_records(entities(spark, sf_dir), "id", RULES, THRESHOLD), "id"))


def _merged(strategy: str) -> str:
    pick = lambda c, order: f"first({c} ORDER BY {order}) FILTER ({c} IS NOT NULL) AS {c}"
    if strategy == "merge":
        fields = ", ".join(pick(c, f"length({c}::VARCHAR) DESC, id") for c in ("name", "segment"))
    else:
        order = {"first": "id", "last": "id DESC", "best_quality": "((name IS NOT NULL)::INT + (segment IS NOT NULL)::INT) DESC, id"}[strategy]
        fields = ", ".join(f"first({c} ORDER BY {order}) AS {c}" for c in ("name", "segment"))
    return f"SELECT master, {fields} FROM (SELECT e.id, name, segment, master FROM {E} e JOIN {GROUPED} g ON e.id = g.id) GROUP BY 1"


def _merge(spark, sf_dir, strategy):
    d = entities(spark, sf_dir).select("id", "name", "segment")
    return r.merged(d, "id", r.groups(*r.similar_records(entities(spark, sf_dir), "id", RULES, THRESHOLD), "id"), strategy)


@query(_merged("merge"))
def er_merge_longest(spark, sf_dir):
    return _merge(spark, sf_dir, "merge")


@query(_merged("first"))
def er_merge_first(spark, sf_dir):
    return _merge(spark, sf_dir, "first")


@query(_merged("last"))
def er_merge_last(spark, sf_dir):
    return _merge(spark, sf_dir, "last")


@query(_merged("best_quality"))
def er_merge_best(spark, sf_dir):
    return _merge(spark, sf_dir, "best_quality")


@query(f"SELECT id, md5('name:' || name || CASE WHEN segment IS NOT NULL THEN '|segment:' || segment ELSE '' END) AS entity_id FROM {E}")
def er_entity_id(spark, sf_dir):
    return entities(spark, sf_dir).select("id", r.entity_id(["segment", "name"]).alias("entity_id"))


@query(f"""SELECT id, round(0.7 * ((name IS NOT NULL)::INT + (segment IS NOT NULL)::INT) / 2 + 0.3 * least(1.0, CASE WHEN balance < 0 THEN 0.3 WHEN balance < 3000 THEN 0.6 WHEN balance < 5000 THEN 0.8 WHEN segment IS NULL THEN 1.1 ELSE 1.0 END), 6) AS score FROM {E}""")
def er_matching_score(spark, sf_dir):
    balance = F.col("balance")
    likeness = F.when(balance < 0, 0.96).when(balance < 3000, 0.9).otherwise(0.75)
    score = r.matching_score(r.fill_ratio(["name", "segment"]), F.coalesce(balance < 5000, F.lit(False)), likeness, F.col("segment").isNull(), F.lit(False))
    return entities(spark, sf_dir).select("id", F.round(score, 6).alias("score"))


# Loads: suppliers are what is known, and what comes in is every supplier again under another key or name, and new ones.
EXISTING = "SELECT s_suppkey AS id, substr(md5(cast(s_suppkey AS {s})), 1, 12) AS name, s_acctbal AS balance, cast(NULL AS {s}) AS note, 0.5 AS confidence, 1 AS version, cast(0 AS bigint) AS duplicate_count FROM supplier"
INCOMING = """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN upper(substr(md5(cast(c_custkey AS {s})), 1, 12)) WHEN c_custkey % 3 = 1 THEN 'x' || substr(md5(cast(c_custkey AS {s})), 2, 11) ELSE substr(md5(cast(-c_custkey - 1 AS {s})), 1, 12) END AS name,
  c_acctbal AS balance, c_mktsegment AS note, CASE WHEN c_custkey % 2 = 0 THEN 0.95 ELSE 0.8 END AS confidence FROM customer"""
OLD, NEW = "(" + EXISTING.format(s="VARCHAR") + ")", "(" + INCOMING.format(s="VARCHAR") + ")"
LOAD_RULES = [r.MatchRule("name", "levenshtein", 1.0, preprocess=["lowercase"], blocking=True)]


def _loaded(spark, sf_dir):
    for name in ("supplier", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    old = spark.sql(EXISTING.format(s="STRING")).withColumns({"confidence": F.col("confidence").cast("double")})
    return old, spark.sql(INCOMING.format(s="STRING")).withColumn("confidence", F.col("confidence").cast("double"))


_LIKE = "1 - levenshtein(lower(n.name), lower(k.name)) / greatest(length(n.name), length(k.name))"
FUZZY = f"(SELECT n.id, first(k.id ORDER BY {_LIKE} DESC, k.id) AS existing_id, max({_LIKE}) AS score FROM {NEW} n JOIN {OLD} k ON {_LIKE} > 0.85 GROUP BY n.id)"
CLASSIFIED = f"""(SELECT n.id, CASE WHEN e.id IS NOT NULL THEN 'update' WHEN f.id IS NOT NULL THEN 'duplicate' ELSE 'new' END AS action, coalesce(e.id, f.existing_id) AS existing_id, CASE WHEN e.id IS NOT NULL THEN 1.0 ELSE round(f.score, 6) END AS confidence
  FROM {NEW} n LEFT JOIN (SELECT lower(trim(name)) AS k, min(id) AS id FROM {OLD} GROUP BY 1) e ON lower(trim(n.name)) = e.k LEFT JOIN {FUZZY} f ON n.id = f.id)"""


@query(f"SELECT id, action, existing_id, confidence::DOUBLE AS confidence FROM {CLASSIFIED}")
def load_classify(spark, sf_dir):
    old, new = _loaded(spark, sf_dir)
    out = o.classify(new.drop("confidence"), old, "id", ["name"], LOAD_RULES)
    return out.select("id", "action", "existing_id", F.round("confidence", 6).alias("confidence"))


@query(f"""SELECT count(*) AS total, count(*) FILTER (action = 'new') AS new, count(*) FILTER (action = 'update') AS update, count(*) FILTER (action = 'duplicate') AS duplicate, round(count(*) FILTER (action = 'new') * 100.0 / count(*), 6) AS load_rate,
  round(count(*) FILTER (action = 'duplicate') * 100.0 / count(*), 6) AS dedup_rate, round(count(*) FILTER (action = 'update') * 100.0 / count(*), 6) AS merge_rate FROM {CLASSIFIED}""")
def load_statistics(spark, sf_dir):
    old, new = _loaded(spark, sf_dir)
    return o.load_statistics(o.classify(new.drop("confidence"), old, "id", ["name"], LOAD_RULES))


def _upserted(values: str, changed: str) -> str:
    return f"""SELECT coalesce(k.id, n.id) AS id, {values}, greatest(k.confidence, n.confidence)::DOUBLE AS confidence, CASE WHEN k.id IS NULL THEN 1 WHEN n.id IS NOT NULL AND ({changed}) THEN 2 ELSE 1 END AS version, 0::BIGINT AS duplicate_count FROM {OLD} k FULL JOIN {NEW} n ON k.id = n.id"""


FIELDS = ["name", "balance", "note"]


def _upsert(spark, sf_dir, strategy):
    old, new = _loaded(spark, sf_dir)
    return o.upsert(old, new, "id", FIELDS, strategy)


_NEWER = "coalesce(n.name, k.name) AS name, coalesce(n.balance, k.balance) AS balance, coalesce(n.note, k.note) AS note"


@query(_upserted(_NEWER, "n.name IS DISTINCT FROM k.name OR n.balance IS DISTINCT FROM k.balance OR n.note IS DISTINCT FROM k.note"))
def load_newer_wins(spark, sf_dir):
    return _upsert(spark, sf_dir, "newer_wins")


@query(f"SELECT id, action, existing_id, confidence::DOUBLE AS confidence FROM {CLASSIFIED}")
def load_index_classify(spark, sf_dir):
    # what is known is filed in two loads, then the incoming records ask the index
    old, new = _loaded(spark, sf_dir)
    index = MatchIndex(spark, shared_path(spark), "id", ["name"], LOAD_RULES, o.FUZZY, buckets=8)
    index.add(old.where("id % 3 = 0"))
    index.add(old.where("id % 3 <> 0"))
    out = index.classify(new.drop("confidence"))
    return out.select("id", "action", "existing_id", F.round("confidence", 6).alias("confidence"))


@query(_upserted(_NEWER, "n.name IS DISTINCT FROM k.name OR n.balance IS DISTINCT FROM k.balance OR n.note IS DISTINCT FROM k.note"))
def load_into_store(spark, sf_dir):
    # suppliers are the first load, every fourth customer the second, the others the third
    old, new = _loaded(spark, sf_dir)
    store = Store(spark, shared_path(spark), "id", buckets=8)
    store.write(old)
    upsert_into(store, new.where("id % 4 = 0"), FIELDS, "newer_wins")
    upsert_into(store, new.where("id % 4 <> 0"), FIELDS, "newer_wins")
    return store.read()


@query(_upserted("coalesce(k.name, n.name) AS name, coalesce(k.balance, n.balance) AS balance, coalesce(k.note, n.note) AS note", "k.note IS NULL AND n.note IS NOT NULL"))
def load_conservative(spark, sf_dir):
    return _upsert(spark, sf_dir, "conservative")


@query(_upserted("CASE WHEN n.confidence >= 0.9 THEN coalesce(n.name, k.name) ELSE coalesce(k.name, n.name) END AS name, CASE WHEN n.confidence >= 0.9 THEN coalesce(n.balance, k.balance) ELSE greatest(k.balance, n.balance) END AS balance, coalesce(n.note, k.note) AS note", "true"))
def load_score_based(spark, sf_dir):
    return _upsert(spark, sf_dir, "score_based")


@query("""SELECT c_custkey AS id, array_to_string(list_sort(CASE WHEN c_custkey % 2 = 0 THEN ['active', 'premium', 'verified'] ELSE ['active', 'verified'] END), ',') AS tags, CASE WHEN c_custkey % 2 = 0 THEN 'Boston' ELSE 'New York' END AS city, '123 Main St' AS street, CASE WHEN c_custkey % 2 = 0 THEN '02101' END AS zip FROM customer""")
def load_merge(spark, sf_dir):
    even = F.col("c_custkey") % 2 == 0
    d = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.array(F.lit("active"), F.lit("verified")).alias("old_tags"),
        F.when(even, F.array(F.lit("verified"), F.lit("premium"))).alias("new_tags"),
        F.create_map(F.lit("street"), F.lit("123 Main St"), F.lit("city"), F.lit("New York")).alias("old_address"),
        F.when(even, F.create_map(F.lit("city"), F.lit("Boston"), F.lit("zip"), F.lit("02101"))).alias("new_address"),
    )
    kinds = {f.name: f.dataType for f in d.schema.fields}
    both = {n: o.resolved("merge", F.col(f"old_{n}"), F.col(f"new_{n}"), kinds[f"old_{n}"]) for n in ("tags", "address")}
    return d.select("id", F.array_join(F.sort_array(both["tags"]), ",").alias("tags"), *(F.try_element_at(both["address"], F.lit(k)).alias(k) for k in ("city", "street", "zip")))


@query(f"SELECT k.id, 'name' AS field, k.name AS old_value, n.name AS new_value FROM {OLD} k JOIN {NEW} n ON k.id = n.id WHERE k.name <> n.name")
def load_manual_review(spark, sf_dir):
    old, new = _loaded(spark, sf_dir)
    return o.conflicts(old, new, "id", ["name"])


CHANGED = f"(SELECT k.id AS k, n.id AS n, k.name AS kname, n.name AS nname, n.note AS nnote FROM {OLD} k FULL JOIN {NEW} n ON k.id = n.id)"


@query(f"""SELECT 'entities' AS table_name, coalesce(k, n)::VARCHAR AS record_id, CASE WHEN k IS NULL THEN 'INSERT' WHEN n IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS operation, 'name' AS field, kname AS old_value, nname AS new_value FROM {CHANGED} WHERE kname IS DISTINCT FROM nname
  UNION ALL SELECT 'entities', coalesce(k, n)::VARCHAR, CASE WHEN k IS NULL THEN 'INSERT' WHEN n IS NULL THEN 'DELETE' ELSE 'UPDATE' END, 'note', NULL, nnote FROM {CHANGED} WHERE nnote IS NOT NULL""")
def load_change_log(spark, sf_dir):
    old, new = _loaded(spark, sf_dir)
    return o.change_log(old, new, "id", ["name", "note"], "entities")


@query(f"SELECT k.id, k.name, (SELECT count(*) FROM {CLASSIFIED} c WHERE c.action = 'duplicate' AND c.existing_id = k.id) AS duplicate_count FROM {OLD} k")
def load_duplicate_counts(spark, sf_dir):
    old, new = _loaded(spark, sf_dir)
    found = o.classify(new.drop("confidence"), old, "id", ["name"], LOAD_RULES).where("action = 'duplicate'")
    return o.with_duplicates(old, found, "id", "existing_id").select("id", "name", "duplicate_count")


@query(f"SELECT id AS entity_from, existing_id AS entity_to, 'DUPLICATE_OF' AS relationship_type, confidence::DOUBLE AS relationship_strength FROM {CLASSIFIED} WHERE action = 'duplicate'")
def load_duplicate_edges(spark, sf_dir):
    old, new = _loaded(spark, sf_dir)
    found = o.classify(new.drop("confidence"), old, "id", ["name"], LOAD_RULES).where("action = 'duplicate'")
    return o.duplicate_edges(found, "id", "existing_id").withColumn("relationship_strength", F.round("relationship_strength", 6))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%99%' OR c_mktsegment ILIKE '%build%'")
def er_search(spark, sf_dir):
    d = table(spark, sf_dir, "customer")
    return o.search(d, "99", ["c_name"]).unionAll(o.search(d, "Build", ["c_mktsegment"])).distinct().select("c_custkey", "c_name")


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def er_types(spark, sf_dir):
    return o.types_with_counts(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("SELECT entity, count(*) FILTER (direction = 'outgoing') AS outgoing, count(*) FILTER (direction = 'incoming') AS incoming FROM (SELECT o_custkey AS entity, 'outgoing' AS direction FROM orders UNION ALL SELECT o_orderkey, 'incoming' FROM orders) GROUP BY 1")
def join_related(spark, sf_dir):
    rows = o.related(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "entity", "o_custkey", "o_orderkey")
    return rows.groupBy("entity").agg(F.count_if(F.col("direction") == "outgoing").alias("outgoing"), F.count_if(F.col("direction") == "incoming").alias("incoming"))


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_inner(spark, sf_dir):
    c, n, g = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(g, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT coalesce(c.k, s.k) AS nation, customers, suppliers FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 9900 GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) s ON c.k = s.k")
def join_full(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def join_semi(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 450000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def join_anti(spark, sf_dir):
    return table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem").where("l_quantity > 48"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")
