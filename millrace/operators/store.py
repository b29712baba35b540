"""Tables that loads read and extend in part: rows in buckets by a hash of their key, one version of a bucket for each load that touched it.

A store is a folder in a file system that all executors share: `load=<n>/bucket=<b>/` has what load n wrote
of bucket b. A bucket's rows are those of the last load that has it, or, in a store that only grows, of all
loads. Nothing that was written is changed, so a load that fails leaves the store as it was: only loads with Spark's
success marker count. The number of buckets has to be the same for all loads, and so large that a task can hold one; what
reaches the driver are numbers of loads and buckets.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.load import match_key, upsert
from millrace.operators.resolve import MatchRule, edit_keys, field_threshold, prepared, record_score

BUCKETS = 64


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


@dataclass
class Store:
    """A bucketed store at `path`, by the column `key`."""

    spark: SparkSession
    path: str
    key: str
    buckets: int = BUCKETS
    grows: bool = False

    def _folder(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, name: str, prefix: str) -> list[int]:
        fs, path = self._folder(name)
        if not fs.exists(path):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(f.removeprefix(prefix)) for f in found if f.startswith(prefix))

    def versions(self) -> dict[int, list[int]]:
        """The loads that have the current rows of each bucket."""
        out: dict[int, list[int]] = {}
        for n in self._names("", "load="):
            fs, marker = self._folder(f"load={n}/_SUCCESS")
            if fs.exists(marker):
                for b in self._names(f"load={n}", "bucket="):
                    out[b] = [*out.get(b, []), n] if self.grows else [n]
        return out

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The current rows, of the given buckets only; None if there are none."""
        paths = [f"{self.path}/load={n}/bucket={b}" for b, loads in sorted(self.versions().items()) for n in loads if buckets is None or b in buckets]
        return self.spark.read.option("basePath", self.path).parquet(*paths).drop("load", "bucket") if paths else None

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of rows: as many numbers as there are buckets at the utmost."""
        return sorted(r[0] for r in rows.select(bucket_of(F.col(self.key), self.buckets)).distinct().collect())

    def write(self, rows: DataFrame) -> int:
        """Put rows as the new content of the buckets that they lie in; the number of the load."""
        n = max(self._names("", "load="), default=0) + 1
        marked = rows.withColumn("bucket", bucket_of(F.col(self.key), self.buckets))
        marked.repartition("bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/load={n}")
        return n


def upsert_into(store: Store, incoming: DataFrame, fields: list[str], strategy: str) -> int:
    """upsert() of incoming into the store, of which only the buckets of incoming keys are read and written."""
    old = store.read(store.touched(incoming))
    if old is None:
        old = incoming.select(store.key, *fields, F.col("confidence").cast("double").alias("confidence"), F.lit(1).alias("version"), F.lit(0).cast("long").alias("duplicate_count")).limit(0)
    return store.write(upsert(old, incoming, store.key, fields, strategy))


# -- what a load matches against -------------------------------------------------------------


class MatchIndex:
    """Existing records filed once for matching: by the key of equal fields, and by the keys that similar values of one field share.

    Two tables of keys are kept, in buckets by key: those under which a value is filed and those under which one is looked for, so
    that either of a pair may be the longer one. A load makes keys of its own records only, reads the
    buckets that these lie in and adds theirs. Only a rule by edit distance can be
    filed; other rules add to the score.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, key_fields: list[str], rules: list[MatchRule], threshold: float, buckets: int = BUCKETS):
        if sum(r.blocking for r in rules) != 1 or next(r for r in rules if r.blocking).strategy != "levenshtein":
            raise ValueError("a match index takes one blocking field, compared by edit distance")
        self.key, self.key_fields, self.rules, self.threshold = key, key_fields, rules, threshold
        self.exact, self.filed, self.sought = (Store(spark, f"{path}/{n}", "k", buckets, grows=True) for n in ("exact", "filed", "sought"))

    def _keys(self, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Of records: (k, id) by equal fields, and (k, id, fields) filed and sought."""
        i = next(n for n, r in enumerate(self.rules) if r.blocking)
        shown = prepared(rows, self.rules)
        exact = rows.select(match_key(self.key_fields).alias("k"), F.col(self.key).alias("id"))
        values = shown.where(f"_m{i} IS NOT NULL").select(F.col(self.key).alias("id"), F.lit(0).alias("side"), F.col(f"_m{i}").alias("v"))
        fields = shown.select(F.col(self.key).alias("id"), F.struct(*(f"_m{n}" for n in range(len(self.rules)))).alias("m"))
        filed, sought = (k.select(F.col("key").alias("k"), "id").distinct().join(fields, "id").select("k", "id", "m") for k in edit_keys(values, field_threshold(self.rules, self.threshold)))
        return exact, filed, sought

    def add(self, rows: DataFrame) -> None:
        """File records that aren't in the index yet."""
        for store, new in zip((self.exact, self.filed, self.sought), self._keys(rows), strict=True):
            store.write(new)

    def classify(self, incoming: DataFrame) -> DataFrame:
        """As load.classify() against all records of the index."""
        exact, filed, sought = self._keys(incoming)
        known = self.exact.read(self.exact.touched(exact))
        if known is None:
            return incoming.withColumns({"action": F.lit("new"), f"existing_{self.key}": F.lit(None).cast(dict(incoming.dtypes)[self.key]), "confidence": F.lit(None).cast("double")})
        same = exact.join(known.withColumnRenamed("id", "of"), "k").groupBy("id").agg(F.min("of").alias("_exact"))
        pairs = []
        for own, store in ((filed, self.sought), (sought, self.filed)):
            theirs = store.read(store.touched(own))
            if theirs is not None:
                pairs.append(own.join(theirs.select("k", F.col("id").alias("of"), F.col("m").alias("r")), "k").select("id", "of", F.col("m").alias("l"), "r"))
        found = reduce(DataFrame.unionByName, pairs).join(same, "id", "left_anti").dropDuplicates(["id", "of"])
        scored = found.select("id", "of", record_score(self.rules).alias("score")).where(F.col("score") > self.threshold)
        best = scored.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "of")).alias("m"))
        like = best.select("id", F.col("m.of").alias("_like"), (-F.col("m.s")).alias("_score"))
        out = incoming.withColumn("id_", F.col(self.key)).join(same.withColumnRenamed("id", "id_"), "id_", "left").join(like.withColumnRenamed("id", "id_"), "id_", "left")
        action = F.when(F.col("_exact").isNotNull(), "update").when(F.col("_like").isNotNull(), "duplicate").otherwise("new")
        return out.select(*incoming.columns, action.alias("action"), F.coalesce("_exact", "_like").alias(f"existing_{self.key}"), F.when(F.col("_exact").isNotNull(), 1.0).otherwise(F.col("_score")).alias("confidence"))


# -- uniqueness over all loads -----------------------------------------------------------------


class History:
    """Keys of all loads so far, to which a batch is held: bits of their hashes, and their digests in buckets.

    The bits are a table of bitmaps, a row for each 32,768 of them; bitmaps of loads are merged by OR. A batch first asks the bits, by a join of
    its hashes with the few rows they fall in; only keys whose bit is set are held against stored digests. With `bits` bits for n
    keys, a new key is looked up in vain with probability n / bits at the utmost.
    """

    def __init__(self, spark: SparkSession, path: str, bits: int = 1 << 24, buckets: int = BUCKETS):
        self.bits = bits
        self.digests = Store(spark, f"{path}/digests", "digest", buckets, grows=True)
        self.filter = Store(spark, f"{path}/filter", "part", buckets)

    def _marked(self, batch: DataFrame, columns: list[str]) -> DataFrame:
        """batch with `digest`, the SHA-256 of its key (null where a part is null), and the bit of that."""
        whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
        shown = batch.withColumn("digest", F.when(whole, F.sha2(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in columns))), 256)))
        bit = F.pmod(F.xxhash64("digest"), F.lit(self.bits))
        return shown.withColumns({"part": F.floor(bit / 32768).cast("long"), "place": (bit % 32768).cast("int")})

    def asked(self, batch: DataFrame, columns: list[str]) -> DataFrame:
        """digest of each key of the batch whose bit is set: all that are known, and few others."""
        keys = self._marked(batch, columns).where("digest IS NOT NULL").select("digest", "part", "place").distinct()
        rows = self.filter.read(self.filter.touched(keys))
        if rows is None:
            return keys.select("digest").limit(0)
        byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return keys.join(rows, "part").where(byte.bitwiseAND(F.expr("shiftleft(1, place % 8)")) > 0).select("digest")

    def known(self, batch: DataFrame, columns: list[str]) -> DataFrame:
        """digest of each key of the batch that an earlier load had."""
        hits = self.asked(batch, columns)
        stored = self.digests.read(self.digests.touched(hits))
        return hits.limit(0) if stored is None else hits.join(stored, "digest", "left_semi")

    def marked(self, batch: DataFrame, columns: list[str], name: str) -> DataFrame:
        """batch with the column `name`: whether an earlier load had the key."""
        seen = self.known(batch, columns).withColumn(name, F.lit(True))
        rows = self._marked(batch, columns).join(seen, "digest", "left")
        return rows.select(*batch.columns, F.coalesce(name, F.lit(False)).alias(name))

    def check(self, batch: DataFrame, columns: list[str], order: str) -> DataFrame:
        """batch with `is_unique`: no earlier load had the key, nor an earlier row, by `order`, of the batch; keys with a null are unique."""
        marked = self._marked(batch, columns)
        first = marked.where("digest IS NOT NULL").groupBy("digest").agg(F.min(order).alias("_first"))
        seen = self.known(batch, columns).withColumn("_known", F.lit(True))
        rows = marked.join(first, "digest", "left").join(seen, "digest", "left")
        ok = F.col("digest").isNull() | (F.col("_known").isNull() & (F.col(order) == F.col("_first")))
        return rows.select(*batch.columns, ok.alias("is_unique"))

    def add(self, batch: DataFrame, columns: list[str]) -> None:
        """Remember the keys of a batch."""
        keys = self._marked(batch, columns).where("digest IS NOT NULL").select("digest", "part", "place").distinct()
        bits = keys.groupBy("part").agg(F.expr("bitmap_construct_agg(place)").alias("bitmap"))
        old = self.filter.read(self.filter.touched(bits))
        self.filter.write(bits if old is None else old.unionByName(bits).groupBy("part").agg(F.expr("bitmap_or_agg(bitmap)").alias("bitmap")))
        self.digests.write(keys.select("digest"))
