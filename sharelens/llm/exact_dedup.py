"""Exact dedup through a minimal perfect hash over historical distinct digests.

Digests are SHA-256 of the text after each run of [\\x20\\x09-\\x0D] became one space, computed in the JVM.
`build_index` deals the history's distinct digests over shards and turns each shard into a minimal perfect hash: n slots for
n digests, each slot with the full digest and the locator of its winner. `lookup` sends digests to their shard,
computes the one slot and compares all 32 bytes: members are repeats of the slot's winner, nonmembers are grouped among
themselves. A shard holds about SHARD_DIGESTS digests, some 3 MB of a task's memory; shards that hold hot digests are looked
up in several salted parts by row number, each with a copy of the shard's table.

The history is a table of earlier documents; without one it is the earlier half of the rows by doc_id (up to the
median), whose distinct digests are all in the index, so that the later half and the history's own repeats are told by it.

Defined cases: null text is the empty text; empty texts equal each other; very long texts count as a whole; a null doc_id is
never history, loses to any other and is null in keep_id only when all ids of its group are; repeated rows each come back, all
with the same keep_id (`kept` holds for every row that carries the smallest id); an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure, materialize

#: Distinct digests per shard (about 50 bytes a slot) and rows per salted part of a lookup.
SHARD_DIGESTS, PART_ROWS = 20_000, 100_000


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the 32-byte digest of the normalised text."""
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


class PerfectHash:
    """Minimal perfect hash by displacement: buckets, largest first, search a seed that sends their keys to free
    slots; buckets of one key name their slot directly."""

    def __init__(self, keys: np.ndarray):
        """keys: (n, 4) uint64, distinct."""
        n = len(keys)
        self.n, self.b = n, max(1, n // 3)
        self.seeds = np.zeros(self.b, np.int64)
        self.slot_of = np.zeros(n, np.int64)
        bucket = (keys[:, 0] % np.uint64(self.b)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.b)
        first = np.concatenate([[0], np.cumsum(counts)])
        free = np.ones(n, bool)
        left: list[int] = []
        for k in np.argsort(-counts, kind="stable"):
            mine = order[first[k] : first[k + 1]]
            if not len(mine):
                break
            if len(mine) == 1:
                left.append(int(k))
                continue
            seed = 0
            while True:
                at = self._slots(keys[mine], seed)
                if free[at].all() and len(set(at.tolist())) == len(at):
                    break
                seed += 1
            free[at] = False
            self.seeds[k] = seed
            self.slot_of[mine] = at
        for k, at in zip(left, np.flatnonzero(free)):
            self.seeds[k] = -int(at) - 1
            self.slot_of[order[first[k]]] = at

    def _slots(self, keys: np.ndarray, seed) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = keys[:, 1] + keys[:, 2] * (np.asarray(seed).astype(np.uint64) * np.uint64(2) + np.uint64(1))
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
            x ^= x >> np.uint64(28)
        return (x % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The one slot that each key may be in."""
        seeds = self.seeds[(keys[:, 0] % np.uint64(self.b)).astype(np.int64)]
        return np.where(seeds < 0, -seeds - 1, self._slots(keys, np.maximum(seeds, 0)))


def words(digest_column) -> np.ndarray:
    """(n, 4) big-endian uint64 of 32-byte digests."""
    return np.frombuffer(b"".join(digest_column), ">u8").astype(np.uint64).reshape(-1, 4)


def _shard(n: int):
    return F.pmod(F.xxhash64("digest"), F.lit(n))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """history: digest, winner, size, distinct digests. Returns one row a shard: shard and the serialised table."""

    def build(rows):
        import pickle

        import pyarrow as pa

        keys = words(rows.column("digest").to_pylist())
        h = PerfectHash(keys)
        slots = np.zeros((h.n, 4), np.uint64)
        slots[h.slot_of] = keys
        place = np.argsort(h.slot_of)  # the row in each slot
        locators = rows.select(["winner", "size"]).take(pa.array(place))
        table = pickle.dumps((h.n, h.b, h.seeds, slots, locators.to_pydict()), protocol=5)
        return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int64()), "table": pa.array([table], pa.binary())})

    return history.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(build, "shard long, table binary")


def _probe(docs, index):
    import pickle

    import pyarrow as pa

    n = docs.num_rows
    found, at = np.zeros(n, bool), np.zeros(n, np.int64)
    held = {"winner": [None], "size": [0]}
    if n and index.num_rows:
        h = PerfectHash.__new__(PerfectHash)
        h.n, h.b, h.seeds, slots, held = pickle.loads(index.column("table")[0].as_py())
        keys = words(docs.column("digest").to_pylist())
        at = h.find(keys)
        found = (slots[at] == keys).all(axis=1)
    take = pa.array(at, mask=~found)
    return pa.table({
        "doc_id": docs.column("doc_id"), "digest": docs.column("digest"), "late": docs.column("late"), "member": pa.array(found),
        "winner": pa.array(held["winner"], pa.int64()).take(take), "size": pa.array(held["size"], pa.int64()).take(take),
    })


def lookup(docs: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """docs: doc_id, digest, late and row, its number. Adds member, winner and size of the slot whose digest is the same, byte by
    byte."""
    docs = docs.withColumn("shard", _shard(shards))
    parts = docs.groupBy("shard").count().select("shard", F.ceil(F.col("count") / PART_ROWS).cast("int").alias("parts"))
    # one row a shard and part: tables are copied only for shards with many rows
    copies = index.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    docs = docs.join(F.broadcast(parts) if shards <= 10_000 else parts, "shard").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    out = "doc_id long, digest binary, late boolean, member boolean, winner long, size long"
    return docs.select("doc_id", "digest", "late", "shard", "part").groupBy("shard", "part").cogroup(copies.select("shard", "part", "table").groupBy("shard", "part")).applyInArrow(_probe, out)


def dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    `history` (doc_id, text) holds earlier documents: texts in it are repeats of its winner, and the group counts both."""
    configure(docs.sparkSession)
    new = materialize(digests(docs).withColumn("row", F.monotonically_increasing_id()))
    middle = None if history is not None else new.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    late = F.lit(True) if middle is None else F.coalesce(F.col("doc_id") > middle, F.lit(True))
    new = new.withColumn("late", late)
    past = digests(history) if history is not None else new.where("not late")
    known = materialize(past.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.count("*").alias("size")))
    shards = max(1, -(-known.count() // SHARD_DIGESTS))
    seen = materialize(lookup(new, build_index(known, shards), shards))
    members = seen.where("member")
    # later members follow the earlier winner and count in its group
    more = members.where("late").groupBy("digest").agg(F.count("*").alias("more"))
    members = members.join(more, "digest", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more")
    rest = seen.where("not member")
    groups = rest.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.count("*").alias("size"))
    rest = rest.drop("winner", "size").join(groups, "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("winner"))
    if history is not None:
        kept = kept & ~F.col("member")
    return members.unionByName(rest).select("doc_id", F.col("winner").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
