"""Shards of near equal size: minimax contiguous partition of ordered atomic groups, with DataFrame functions only.

Documents of equal text form a group that is never split. Groups are ordered by the digest of their text, and the
shards are contiguous ranges of that order, so that a document's shard follows from its own digest and a handful of
cuts: no join and no lookup table. The smallest feasible capacity of a shard is found by binary search, each candidate
being checked greedily.

The search never sees the groups one by one. It works on sums of ranges of digests: first of ``16 ** 4`` ranges, then
of ever finer ranges, but only where a cut can still fall. With the sums known so far it computes a capacity that is
certainly feasible (cuts at known borders only) and one below which none is (ranges divided anywhere); when both are
equal, that capacity is the minimum and the cuts are known. What the driver holds is bounded by the number of ranges,
whatever the size of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.llm.shared import written

FIRST_DIGITS = 4
MORE_DIGITS = 2
SALTS = 1024


@dataclass(frozen=True)
class Range:
    """Groups whose digest begins with ``prefix``: how large together, how large the largest, how many."""

    prefix: str
    size: int
    largest: int
    groups: int

    @property
    def atomic(self) -> bool:
        return self.groups == 1


def _ranges(groups: DataFrame, digits: int, within: list[str] | None = None) -> list[Range]:
    if within is not None:
        groups = groups.where(F.substring("digest", 1, len(within[0])).isin(within)) if len({len(p) for p in within}) == 1 else groups.where(F.expr(" or ".join(f"digest like '{p}%'" for p in within)))
    found = groups.groupBy(F.substring("digest", 1, digits).alias("prefix")).agg(F.sum("size").alias("size"), F.max("size").alias("largest"), F.count(F.lit(1)).alias("groups"))
    return [Range(*r) for r in found.select("prefix", "size", "largest", "groups").collect()]


def _certain(ranges: list[Range], capacity: int, shards: int) -> tuple[bool, list[int]]:
    """Greedy filling with cuts at known borders: whether it suffices, and the index at which each shard ends."""
    ends, at = [], 0
    for _ in range(shards):
        load = 0
        while at < len(ranges) and load + ranges[at].size <= capacity:
            load += ranges[at].size
            at += 1
        ends.append(at)
    return at == len(ranges), ends


def _possible(ranges: list[Range], capacity: int, shards: int) -> tuple[bool, list[int]]:
    """Greedy filling as if ranges of several groups could be divided anywhere: whether it suffices, and how far each shard may reach."""
    reach, at, rest = [], 0, ranges[0].size if ranges else 0
    for _ in range(shards):
        room = capacity
        while at < len(ranges) and room:
            if rest <= room:
                room -= rest
                at += 1
                rest = ranges[at].size if at < len(ranges) else 0
            elif ranges[at].atomic:
                break
            else:
                rest -= room
                room = 0
        reach.append(at)
    return at == len(ranges), reach


def _least(low: int, high: int, feasible) -> int:
    while low < high:
        middle = (low + high) // 2
        if feasible(middle):
            high = middle
        else:
            low = middle + 1
    return low


def smallest_capacity(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The least possible size of the largest shard, and the digests (or beginnings) at which shards 1, 2, ... begin.

    ``groups`` has ``digest`` (hexadecimal) and ``size LONG``. Exact at any number of groups.
    """
    digits = FIRST_DIGITS
    ranges = sorted(_ranges(groups, digits), key=lambda r: r.prefix)
    if not ranges:
        return 0, []
    while True:
        total, largest = sum(r.size for r in ranges), max(r.largest for r in ranges)
        low = _least(max(largest, -(-total // shards)), total, lambda c: _possible(ranges, c, shards)[0])
        high = _least(low, max(total, low), lambda c: _certain(ranges, c, shards)[0])
        ends = _certain(ranges, high, shards)[1]
        if low == high:
            return high, [ranges[e].prefix for e in ends[:-1] if e < len(ranges)]
        first, last = _certain(ranges, low, shards)[1], _possible(ranges, high, shards)[1]
        doubtful = sorted({i for a, b in zip(first, last) for i in range(a, min(b + 1, len(ranges))) if not ranges[i].atomic})
        digits += MORE_DIGITS
        finer = _ranges(groups, digits, [ranges[i].prefix for i in doubtful])
        open_ = set(doubtful)
        ranges = sorted([r for i, r in enumerate(ranges) if i not in open_] + finer, key=lambda r: r.prefix)


def _digest(text: Column) -> Column:
    """Orders groups: of null texts first (empty string), then by SHA-256 in hexadecimal."""
    return F.when(text.isNull(), F.lit("")).otherwise(F.sha2(text, 256))


def shard_documents(docs: DataFrame, shards: int = 8, salts: int = SALTS) -> DataFrame:
    """Shards of ``docs(doc_id, text)`` whose sizes in bytes are as near equal as whole groups of equal texts allow.

    Returns for each row ``doc_id, size LONG, text_crc32 LONG, shard INT, slot LONG``. The size of a document is the
    number of UTF-8 bytes of its text plus 1. Null texts form a group of their own, apart from empty ones; both count
    as no bytes. Slots number the documents of a shard from 0 without gaps, in no particular order. Ties need no rule:
    equal texts stay together, and cuts lie between different digests. Repeated rows are documents of their own; ids
    may be null; further columns are ignored; no rows give no rows. Shards stay empty when there are too few groups.
    """
    text = F.col("text")
    rows = docs.select("doc_id", (F.octet_length(F.coalesce(text, F.lit(""))) + F.lit(1)).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), _digest(text).alias("digest"))
    rows = written(rows, "documents")
    groups = written(rows.groupBy("digest").agg(F.sum("size").alias("size")), "groups")
    _, cuts = smallest_capacity(groups, shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("digest") >= F.lit(cut)).cast("int")
    rows = rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(salts)).cast("int").alias("salt"))
    return rows_with_slots(rows).select("doc_id", "size", "text_crc32", "shard", "slot")


def rows_with_slots(rows: DataFrame) -> DataFrame:
    """Adds ``slot`` to rows with ``shard`` and ``salt``: numbers within small salted groups, plus what lies before them."""
    counts = written(rows.groupBy("shard", "salt").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("salt")) - F.col("n")
    within = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("doc_id", "text_crc32")) - 1
    return rows.withColumn("within", within).join(counts.select("shard", "salt", before.alias("before")), ["shard", "salt"]).withColumn("slot", (F.col("within") + F.col("before")).cast("long"))
