"""Exact de-duplication with a cuckoo-filter index.

Documents are equal when their texts are, after deleting ASCII white space. Only a
digest, a length and an id leave the scan. Each input task folds its rows through a
cuckoo index (so a group of copies shrinks to a row per task before anything is
shuffled), the partial groups are dealt out by digest, and each bucket of digests is
merged through a second index. A slot of the index holds a fingerprint, the digest it stands
for and that digest's group, and nothing else does. A fingerprint that is hit is only a hint: it
is verified against the SHA-256 digest in its slot, which is what the operator takes for the
content of a text. The filter doubles from the stored digests when an insertion finds no room.
Digests are deleted as soon as their bucket is done, and by a task whose index is full if they
have no copy yet, so that the memory of a task is bounded by one bucket and not by the partition.

Defined results: null text counts as empty; empty texts are equal to each other; of
equal texts the one with the most code points stays, then the smallest doc_id (null
last), then the first row; repeated rows are members of their group and exactly one row
of a group is kept; an empty table gives no rows; other columns are ignored. A very long text is read by its digest only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import few_files, settle

SLOTS = 4
MAX_KICKS = 200
#: Live digests that a task holds before it hands on its partial groups.
LIVE_KEYS = 100_000
#: Hexadecimal digits of a digest that name its bucket.
BUCKET_DIGITS = 4
WHITE = r"[\x20\x09-\x0D]"
GROUP = "sha string, keep_len long, keep_id long, keep_uid long, members long"


class CuckooIndex:
    """A cuckoo filter over live digests, each slot backed by the digest it stands for and its value.

    `find` reads two buckets of fingerprints and verifies hits against the stored
    digest; `add` moves slots between their two buckets; `remove` frees a slot.
    """

    def __init__(self, buckets: int = 64):
        self._reset(buckets)

    def _reset(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [0] * (buckets * SLOTS)
        self.entries: list[list | None] = [None] * (buckets * SLOTS)  # digest and value
        self.live = 0

    @staticmethod
    def _hashes(key: str) -> tuple[int, int]:
        # A digest is uniform already; its tail is free of the bits that name the bucket.
        tail = int(key[-16:], 16)
        return (tail & 0xFFFF) or 1, tail >> 16

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _slots(self, key: str) -> tuple[int, int, int]:
        mark, h = self._hashes(key)
        first = h & self.mask
        return mark, first, self._other(first, mark)

    def _find(self, key: str) -> int:
        mark, first, second = self._slots(key)
        for bucket in (first, second):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[at] == mark and self.entries[at][0] == key:
                    return at
        return -1

    def find(self, key: str) -> list | None:
        """The entry [digest, value] of a live digest."""
        at = self._find(key)
        return None if at < 0 else self.entries[at]

    def add(self, key: str, value=None) -> None:
        """Insert a digest that is not live."""
        todo = [[key, value]]
        while todo:
            if self._place(todo[-1]):
                todo.pop()
            else:  # no room: twice the buckets, filled from the stored digests
                todo += [e for e in self.entries if e is not None]
                self._reset((self.mask + 1) * 2)

    def _free(self, bucket: int) -> int:
        for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.prints[at]:
                return at
        return -1

    def _place(self, entry: list) -> bool:
        mark, first, second = self._slots(entry[0])
        moved: list[tuple[int, int, list]] = []
        bucket = first if self._free(first) >= 0 else second
        for kick in range(MAX_KICKS):
            if (at := self._free(bucket)) >= 0:
                self.prints[at], self.entries[at] = mark, entry
                self.live += 1
                return True
            at = bucket * SLOTS + kick % SLOTS
            moved.append((at, self.prints[at], self.entries[at]))
            (mark, entry), (self.prints[at], self.entries[at]) = moved[-1][1:], (mark, entry)
            bucket = self._other(bucket, mark)
        for at, old_mark, old_entry in reversed(moved):
            self.prints[at], self.entries[at] = old_mark, old_entry
        return False

    def remove(self, key: str) -> bool:
        """Delete a live digest; false if it is not there."""
        at = self._find(key)
        if at < 0:
            return False
        self.prints[at], self.entries[at] = 0, None
        self.live -= 1
        return True


def _better(a: tuple, b: tuple) -> tuple:
    """Of (code points, doc_id, row number): longest text, smallest id, first row."""
    rank = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    return a if rank(a) <= rank(b) else b


class _Groups(CuckooIndex):
    """Partial groups, each [candidate, members], of live digests."""

    def take(self, key: str, candidate: tuple, members: int) -> None:
        found = self.find(key)
        if found:
            state = found[1]
            state[0], state[1] = _better(state[0], candidate), state[1] + members
        else:
            self.add(key, [candidate, members])

    def handed_on(self, single_only: bool = False) -> pa.RecordBatch | None:
        """Groups, all or those of one member, deleted from the index."""
        rows = [(e[0], *e[1][0], e[1][1]) for e in self.entries if e is not None and not (single_only and e[1][1] > 1)]
        if not rows:
            return None
        for r in rows:
            self.remove(r[0])
        sha, length, ids, uids, members = zip(*rows, strict=True)
        return pa.record_batch([pa.array(sha, pa.string()), pa.array(length, pa.int64()), pa.array(ids, pa.int64()), pa.array(uids, pa.int64()), pa.array(members, pa.int64())], names=["sha", "keep_len", "keep_id", "keep_uid", "members"])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups = _Groups()
    for batch in batches:
        for sha, length, doc_id, uid in zip(*(batch.column(c).to_pylist() for c in ("sha", "n_points", "doc_id", "uid")), strict=True):
            groups.take(sha, (length, doc_id, uid), 1)
        if groups.live >= LIVE_KEYS:  # digests with copies stay, as more are likely
            if (some := groups.handed_on(single_only=True)) is not None:
                yield some
            if groups.live >= LIVE_KEYS // 2:
                yield groups.handed_on()
    if (last := groups.handed_on()) is not None:
        yield last


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by bucket, so that a bucket is complete when the next begins."""
    groups, bucket = _Groups(), None
    for batch in batches:
        for sha, length, doc_id, uid, members in zip(*(batch.column(c).to_pylist() for c in ("sha", "keep_len", "keep_id", "keep_uid", "members")), strict=True):
            if sha[:BUCKET_DIGITS] != bucket:
                bucket = sha[:BUCKET_DIGITS]
                if groups.live >= 2000 and (done := groups.handed_on()) is not None:
                    yield done
            groups.take(sha, (length, doc_id, uid), members)
    if (last := groups.handed_on()) is not None:
        yield last


#: Stands for a null doc_id, which is larger than any other.
LAST_ID = (1 << 63) - 1


def row_id() -> F.Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))


def content_key() -> F.Column:
    """A 64-bit key of a row's id and text; it tells rows apart together with row_id() only, as 64 bits alone are too few for a large corpus."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose (id, key) isn't in gone."""
    marked = docs.withColumns({"_millrace_id": row_id(), "_millrace_key": content_key()})
    named = gone.select(F.col("id").alias("_millrace_id"), F.col("key").alias("_millrace_key"))
    return marked.join(named, ["_millrace_id", "_millrace_key"], "left_anti").select(*docs.columns)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, sha, n_points, a key and a row number uid for each document, settled in the shared folder."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return settle(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.sha2(F.regexp_replace(text, WHITE, ""), 256).alias("sha"),
            F.char_length(text).cast("long").alias("n_points"),
            F.monotonically_increasing_id().alias("uid"),
            content_key().alias("key"),
        )
    )


def groups_of(rows: DataFrame) -> DataFrame:
    """One row for each distinct digest: the row that stays and the number of members."""
    partial = rows.mapInArrow(_partial, GROUP)
    return partial.repartition("sha").sortWithinPartitions(F.substring("sha", 1, BUCKET_DIGITS)).mapInArrow(_merged, GROUP)


def keep_best(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that stay: one of each group of equal texts.

    Only ids and keys of rows that go are joined with the documents. A row that is repeated
    as a whole shares both with the one that stays; of such rows the first by all columns, as JSON, is kept.
    """
    rows = digests(docs)
    own = ["id", "key"]
    members = rows.join(groups_of(rows), "sha").where("members > 1").select(row_id().alias("id"), "key", (F.col("uid") == F.col("keep_uid")).alias("stays"))
    told = settle(few_files(members.groupBy(*own).agg(F.bool_or("stays").alias("stays"), F.count("*").alias("rows")), rows.count()))
    left = without(docs, told.where("NOT stays"))
    repeated = told.where("stays AND rows > 1").select(F.col("id").alias("_millrace_id"), F.col("key").alias("_millrace_key"))
    if repeated.isEmpty():
        return left
    marked = left.withColumns({"_millrace_id": row_id(), "_millrace_key": content_key()})
    # rows alike in id and text may differ elsewhere: the first by their other columns, as JSON, stays
    again = marked.join(repeated, ["_millrace_id", "_millrace_key"], "left_semi")
    own = F.struct(*docs.columns)
    one = again.groupBy("_millrace_id", "_millrace_key").agg(F.min_by(own, F.to_json(own, {"ignoreNullFields": "false"})).alias("_millrace_row")).select("_millrace_row.*")
    return marked.join(repeated, ["_millrace_id", "_millrace_key"], "left_anti").select(*docs.columns).unionByName(one)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of docs.

    The join back to the rows is an ordinary shuffled join on the digest, which adaptive
    execution splits where a group of copies makes a partition large.
    """
    rows = digests(docs)
    return rows.join(groups_of(rows), "sha").select(
        "doc_id",
        "keep_id",
        F.col("members").alias("group_size"),
        (F.col("uid") == F.col("keep_uid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
