"""Exact dedup of a batch against immutable snapshots, screened by binary-fuse filters."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, mult in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(mult)
    return h ^ (h >> np.uint64(33))


class FuseFilter:
    """A static binary-fuse filter with three slots a key and 8-bit marks: no false negatives, 1/256 false positives."""

    def __init__(self, seed: int, segment: int, segments: int, marks: np.ndarray):
        self.seed, self.segment, self.segments, self.marks = seed, segment, segments, marks

    @staticmethod
    def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        """Three slots in consecutive segments."""
        start = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
        mask = segment - 1
        at = [(h & np.uint64(mask)).astype(np.int64), (h >> np.uint64(18) & np.uint64(mask)).astype(np.int64), ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40) & np.uint64(mask)).astype(np.int64)]
        return np.stack([(start + i) * segment + x for i, x in enumerate(at)])

    @staticmethod
    def _mark(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Of any keys (equal ones count once). Slots with one key are peeled in rounds; marks are set in reverse."""
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << max(2, min(18, math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        segments = max(1, math.ceil(n * factor / segment) - 2)
        for seed in range(1, 1000):
            h = _mixed(keys, seed)
            slots = cls._slots(h, segment, segments)
            size = (segments + 2) * segment
            count = np.bincount(slots.ravel(), minlength=size)
            held = np.zeros(size, np.int64)
            for s in slots:
                np.bitwise_xor.at(held, s, np.arange(n))
            rounds, left = [], n
            while left:
                single = np.flatnonzero(count == 1)
                if not len(single):
                    break
                key, first = np.unique(held[single], return_index=True)
                rounds.append((key, single[first]))
                left -= len(key)
                for s in slots[:, key]:
                    np.subtract.at(count, s, 1)
                    np.bitwise_xor.at(held, s, key)
            if left:
                if seed % 10 == 0:
                    segments += 1
                continue
            marks, want = np.zeros(size, np.uint8), cls._mark(h)
            for key, own in reversed(rounds):
                a, b, c = slots[:, key]
                marks[own] = want[key] ^ marks[a] ^ marks[b] ^ marks[c]  # its own slot is still 0
            return cls(seed, segment, segments, marks)
        raise RuntimeError("no seed peels these keys")

    def holds(self, keys: np.ndarray) -> np.ndarray:
        h = _mixed(keys.astype(np.uint64), self.seed)
        a, b, c = self._slots(h, self.segment, self.segments)
        return self.marks[a] ^ self.marks[b] ^ self.marks[c] == self._mark(h)


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    """The first 64 bits of hexadecimal digests."""
    return np.array([int(x[:16], 16) for x in column.to_pylist()], np.uint64)


FILTER = "bucket int, seed int, segment int, segments int, marks binary"


def _build(t: pa.Table) -> pa.Table:
    f = FuseFilter.build(_keys(t.column("digest")))
    row = {"bucket": [t.column("bucket")[0].as_py()], "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "marks": [f.marks.tobytes()]}
    return pa.table(row, schema=pa.schema([("bucket", pa.int32()), ("seed", pa.int32()), ("segment", pa.int32()), ("segments", pa.int32()), ("marks", pa.binary())]))


def _screen(new: pa.Table, filters: pa.Table) -> pa.Table:
    """The digests that a bucket's filter doesn't rule out."""
    hits = new.select(["digest"])
    if not filters.num_rows:
        return hits.slice(0, 0)
    if not new.num_rows:
        return pa.table({"digest": pa.array([], pa.string())})
    r = filters.to_pylist()[0]
    f = FuseFilter(r["seed"], r["segment"], r["segments"], np.frombuffer(r["marks"], np.uint8))
    return hits.filter(pa.array(f.holds(_keys(new.column("digest")))))


class Snapshot:
    """Documents that no longer change: an entry per distinct text, and a filter per bucket of digests, written once."""

    def __init__(self, docs: DataFrame, per_bucket: int):
        self.docs = docs
        self.entries = common.materialise(_grouped(docs), "snapshot")
        self.per_bucket = per_bucket
        self.buckets = common.groups_for(self.entries.count(), per_bucket)
        bucketed = self.entries.select("digest", self.bucket())
        self.filters = common.materialise(bucketed.groupBy("bucket").applyInArrow(_build, FILTER), "filters")

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64("digest"), F.lit(self.buckets)).cast("int").alias("bucket")

    def screen(self, digests: DataFrame) -> DataFrame:
        new = digests.select("digest", self.bucket())
        return new.groupBy("bucket").cogroup(self.filters.groupBy("bucket")).applyInArrow(_screen, "digest string")


def digested(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("digest"))


def _grouped(docs: DataFrame) -> DataFrame:
    return docs.groupBy("digest").agg(F.max("doc_id").alias("id"), F.count("*").alias("n"))


def _texts(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """The text of each entry's row of largest id; by digest and id, so that copies don't meet in one task."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NULL_KEY)).alias("key")
    wanted = entries.select("digest", F.coalesce(F.col("id").cast("long"), F.lit(common.NULL_KEY)).alias("key"))
    return docs.select("digest", key, "text").join(wanted, ["digest", "key"]).groupBy("digest").agg(F.first("text").alias("text"))


def against(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """(digest, id, n, known, known_id, known_n): a row per distinct text of the batch; known: the snapshot has its bytes."""
    new = common.materialise(_grouped(batch), "batch")
    maybe = snapshot.screen(new)
    both = new.join(maybe, "digest", "left_semi").join(snapshot.entries.select("digest", F.col("id").alias("known_id"), F.col("n").alias("known_n")), "digest")
    both = common.materialise(both, "positives")
    old = _texts(snapshot.docs, both.select("digest", F.col("known_id").alias("id"))).withColumnRenamed("text", "known_text")
    same = _texts(batch, both).join(old, "digest").where(F.col("text") == F.col("known_text")).select("digest")
    same = both.select("digest", "known_id", "known_n").join(same, "digest").withColumn("known", F.lit(True))
    return new.join(same, "digest", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def dedup(docs: DataFrame, per_bucket: int = 50_000) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, digest (SHA-256 of the text, lowercase hex).

    The lower half of the range of doc_ids is an immutable snapshot, the rest a new batch. Duplicates within either are
    grouped by digest; the batch's distinct digests are screened by the snapshot's filters, and positives join the
    snapshot's entries for a check of the bytes. Of equal texts the row with the largest doc_id stays.

    Null text counts as empty. A null doc_id is smaller than any other; where all ids of a group are null, keep_id is null
    and each row is kept. Rows that repeat both doc_id and text share one decision. Other columns are ignored.
    """
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if low is None else (low + high) // 2
    rows = digested(docs)
    old = F.col("doc_id").isNull() | (F.col("doc_id") <= middle)
    snapshot, batch = Snapshot(rows.where(old), per_bucket), rows.where(~old)
    met = common.materialise(against(batch, snapshot), "met")
    keep, size = F.greatest("id", F.when(F.col("known"), F.col("known_id"))), F.col("n") + F.when(F.col("known"), F.col("known_n")).otherwise(0)
    of_new = met.select("digest", F.lit(False).alias("old"), keep.alias("keep_id"), size.alias("group_size"))
    merged = met.where("known").select("digest", keep.alias("keep_id"), size.alias("group_size"))
    of_old = snapshot.entries.join(merged, "digest", "left").select("digest", F.lit(True).alias("old"), F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("group_size", "n").alias("group_size"))
    return (
        rows.select("doc_id", "digest", old.alias("old"))
        .join(of_old.union(of_new), ["digest", "old"])
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
    )

