"""SimHash near-duplicates linked through pigeonring filtering.

Fingerprints are 64-bit majority votes over the XXH64 of word 3-shingles. Two of them
link when at most LIMIT bits differ. The 64 bits form a ring of eight segments. Of any
ring whose differences sum to 2 there is a start from which every chain of l consecutive
segments stays within l * 2 / 8 differences: none in the first three segments, at most
one up to the seventh. So each distinct fingerprint is filed under its eight rotations by
the first 24 bits; members of a bucket are held against the cumulative budgets and only
survivors get the full Hamming check. Inside a bucket links are folded into a spanning
forest at once, so no bucket hands on a pair for every two members. A bucket too full for
one task is filed again, exactly, under 48 bits: of the next four segments at most one
differs, so three of them agree.

Defined results: null text counts as empty; a text without words has fingerprint zero and
links like any other; repeated rows are each returned, in one component; component_id
ignores null ids (null if a component has no other); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.exact_dedup import content_key, row_id, without
from millrace.operators.components import connected_components
from millrace.session import few_files, settle

SEED = 42
WIDTH = 3
LIMIT = 2
SEGMENTS = 8
#: Members of a bucket beyond which it is filed again under longer keys.
FULL_BUCKET = 50_000
#: Up to this many members a bucket is compared member by member, beyond by flipping bits.
SMALL_GROUP = 256
CHUNK = 200_000
#: Bits of the hash that stands for a long key.
LONG_KEY = 50


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """The unsigned SimHash of a text in UTF-8."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly the six white bytes
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)], np.uint64)
        votes += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # one text at a time: as a list they would be held twice
        prints = np.array([fingerprint(t.as_py() or b"") for t in batch.column("body")], np.uint64).view(np.int64)
        yield pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array(prints, pa.int64())], names=["doc_id", "key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, a key of the row and its signed 64-bit fingerprint fp."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), content_key().alias("key"), F.col("text").cast("binary").alias("body")).mapInArrow(_prints, "doc_id long, key long, fp long")


def _rotated(i: int) -> F.Column:
    if not i:
        return F.col("fp")
    return F.shiftleft("fp", 8 * i).bitwiseOR(F.shiftrightunsigned("fp", 64 - 8 * i))


def _flips() -> np.ndarray:
    """What two members of a bucket may differ by under the chain budgets: of two bits, one lies in the last segment."""
    one = [1 << k for k in range(40)]
    two = [(1 << a) | (1 << b) for a in range(40) for b in range(min(a, 8))]
    return np.array(one + two, np.uint64)


FLIPS = _flips()


def _joined(rot: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked members; rot is sorted within each run of equal group."""
    bounds = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    sizes = np.diff(bounds)
    size_of = np.repeat(sizes, sizes)
    left = np.flatnonzero(size_of <= SMALL_GROUP)
    step = 1
    while len(left):
        left = left[left + step < len(group)]
        left = left[group[left + step] == group[left]]
        x = rot[left] ^ rot[left + step]
        near = np.bitwise_count(x >> np.uint64(8)) <= 1  # the chain through seven segments
        near &= np.bitwise_count(x) <= LIMIT
        yield left[near], left[near] + step
        step += 1
    for g in np.flatnonzero(sizes > SMALL_GROUP):
        lo, hi = bounds[g], bounds[g + 1]
        own = rot[lo:hi]
        for flip in FLIPS:
            at = np.searchsorted(own, own ^ flip)
            hit = np.flatnonzero(own[np.minimum(at, len(own) - 1)] == own ^ flip)
            hit = hit[at[hit] > hit]
            yield lo + hit, lo + at[hit]


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest linked index of each index."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            root = root[root]
            open_ = root[a] != root[b]
            a, b = a[open_], b[open_]
    while not np.array_equal(root, root[root]):
        root = root[root]
    return root


def _links(turn_at: int):
    """turn_at: the bit of a key from which it tells the rotation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def emit(key: np.ndarray, rot: np.ndarray) -> pa.RecordBatch:
            root = _forest(len(rot), _joined(rot, key))
            member = np.flatnonzero(root != np.arange(len(root)))
            turn = (key >> turn_at).astype(np.uint64) * np.uint64(8)
            back = (rot >> turn) | np.where(turn > 0, rot << ((np.uint64(64) - turn) % np.uint64(64)), np.uint64(0))
            return pa.record_batch([pa.array(back[member].view(np.int64)), pa.array(back[root[member]].view(np.int64))], names=["src", "dst"])

        for batch in batches:
            held.append((batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("rot").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
            count += batch.num_rows
            if count < CHUNK:
                continue
            key, rot = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            if cut:
                yield emit(key[:cut], rot[:cut])
            held, count = [(key[cut:], rot[cut:])], len(key) - cut
        if count:
            yield emit(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _bucketed(keyed: DataFrame, turn_at: int) -> DataFrame:
    # rot is ordered as an unsigned number, which bit 63 flipped gives
    return (
        keyed.repartition("key")
        .sortWithinPartitions("key", F.col("rot").bitwiseXOR(F.lit(-(1 << 63))))
        .mapInArrow(_links(turn_at), "src long, dst long")
    )


def similar_fingerprints(prints: DataFrame, n_prints: int | None = None) -> DataFrame:
    """src, dst: stars that join what links of the distinct fingerprints fp join, bucket by bucket. n_prints: about as many as there are, if that is known."""
    filed = F.array(*(F.struct((F.shiftrightunsigned(_rotated(i), 40) + F.lit(i << 24)).alias("key"), _rotated(i).alias("rot")) for i in range(SEGMENTS)))
    keyed = prints.select(F.explode(filed).alias("x")).select("x.key", "x.rot")
    full = settle(few_files(keyed.groupBy("key").count().where(F.col("count") > FULL_BUCKET), SEGMENTS * n_prints if n_prints is not None else None))
    if full.isEmpty():
        return _bucketed(keyed, 24)
    plain = _bucketed(keyed.join(full, "key", "left_anti"), 24)
    # bytes of rot from the left: three agree, three of the next four agree, the last is free
    skip = [sum(0xFF << (8 * k) for k in range(1, 5) if k != out) for out in range(1, 5)]
    longer = F.array(*(F.struct(((F.col("key") * 4 + out).bitwiseAND(F.lit((1 << 30) - 1))).alias("kind"), F.col("rot").bitwiseAND(F.lit(mask)).alias("part")) for out, mask in enumerate(skip)))
    deep = keyed.join(full, "key", "left_semi").select("key", "rot", F.explode(longer).alias("x"))
    hashed = F.xxhash64("key", "x.kind", "x.part").bitwiseAND(F.lit((1 << LONG_KEY) - 1))
    turn = F.shiftright("key", 24)
    return plain.unionByName(_bucketed(deep.select((F.shiftleft(turn, LONG_KEY) + hashed).alias("key"), "rot"), LONG_KEY))


def _components(docs: DataFrame) -> DataFrame:
    """doc_id, key, fp and component_id for each row."""
    prints = settle(fingerprints(docs))
    n = prints.count()
    classes = settle(few_files(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), n))
    # in a bucket's forest a fingerprint has one link at most, and it is filed in a bucket for each rotation
    roots = connected_components(similar_fingerprints(classes, n), n_edges=SEGMENTS * n)
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("copies").alias("members"))
    named = rooted.join(lowest, "root").select("fp", "root", "component_id", "members")
    return prints.join(named, "fp")


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for each row of docs."""
    return _components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that stay: of each component the row with the smallest doc_id (null last).

    Only ids and keys of rows that go are joined with the documents; rows that are repeated as a
    whole are one document here and stay or go together.
    """
    linked = settle(_components(docs).where("members > 1").select("root", row_id().alias("id"), "key"))
    stays = linked.groupBy("root").agg(F.min(F.struct("id", "key")).alias("s")).select("s.id", "s.key")
    return without(docs, linked.select("id", "key").distinct().join(stays, ["id", "key"], "left_anti"))
