"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint has 64 bits. Two fingerprints are linked when they differ in at most three bits. Candidates come from
tables of structured bit masks with a guarantee: for any three bit positions some mask leaves all three out, so that
every pair within the radius agrees on the masked bits of some table. No link is left to chance.

* First family (15 masks, 32 to 35 bits kept): position i gets a nonzero vector m(i) of four bits, and the mask of a
  nonzero v keeps the positions whose product with v is odd. Three vectors span at most three of four dimensions, so
  some v is orthogonal to them and its mask leaves the three positions out.
* Second family (84 masks, 48 bits kept): the positions are the points of the affine space of three dimensions over
  the field of four elements; each mask leaves out one plane. Any three points lie in a plane. A bucket of this family
  has at most 2**16 different fingerprints, whatever the size of the corpus. It takes over for the fingerprints of
  buckets of the first family that are larger than ``bucket_limit``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.llm.shared import connected_components, written

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
BUCKET_LIMIT = 512


def fingerprint_of(text: str | None) -> int:
    """The fingerprint as a signed 64-bit integer; null texts and texts without words have fingerprint zero."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z change case, only ASCII white space splits
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16) + SHINGLE_WORDS - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE_WORDS)))) if n > 1 or len(words) == SHINGLE_WORDS else [b" ".join(words)]
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype=np.uint64)
        bits = np.unpackbits(hashes.byteswap().view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column as a LONG column; whole texts, any length."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_of(t) for t in texts], dtype="int64")

    return of(text)


def fingerprint_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def span_masks() -> list[int]:
    """The first family, as signed 64-bit masks."""
    vectors = [i % 15 + 1 for i in range(64)]
    return [_signed(sum(1 << i for i in range(64) if (vectors[i] & v).bit_count() % 2)) for v in range(1, 16)]


def plane_masks() -> list[int]:
    """The second family, as signed 64-bit masks."""

    def times(a: int, b: int) -> int:  # in the field of four elements, x * x = x + 1
        low = (a if b & 1 else 0) ^ (a << 1 if b & 2 else 0)
        return low ^ 0b111 if low & 4 else low

    points = [(i & 3, i >> 2 & 3, i >> 4) for i in range(64)]
    normals = [(1, a, b) for a in range(4) for b in range(4)] + [(0, 1, a) for a in range(4)] + [(0, 0, 1)]
    masks = []
    for normal in normals:
        for side in range(4):
            plane = {i for i, p in enumerate(points) if times(normal[0], p[0]) ^ times(normal[1], p[1]) ^ times(normal[2], p[2]) == side}
            masks.append(_signed(sum(1 << i for i in range(64) if i not in plane)))
    return masks


def bucket_links(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join the members of one bucket as pairs within ``radius`` join them.

    The members reached from one another are tied as a binary heap: few links for each member, short paths, and never
    all pairs. Memory is in proportion to the bucket.
    """
    left, links = np.sort(values).view(np.uint64), []  # numpy counts the bits of absolute values where numbers are signed
    while left.size > 1:
        reached, front = [int(left[0])], [left[0]]
        left = left[1:]
        while front and left.size:
            near = np.bitwise_count(left ^ front.pop()) <= radius
            if near.any():
                new = left[near]
                left = left[~near]
                front.extend(new)
                reached.extend(new.tolist())
        links.extend((reached[i], reached[(i - 1) // 2]) for i in range(1, len(reached)))
    return links


def _links_within_buckets(buckets: DataFrame) -> DataFrame:
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values, ends = np.asarray(lists.flatten()), np.asarray(lists.offsets)
            ends = ends - ends[0]
            pairs = [p for a, b in zip(ends[:-1], ends[1:]) for p in bucket_links(values[a:b])]
            found = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["src", "dst"])

    return buckets.select("members").mapInArrow(links, "src long, dst long")


def _in_tables(values: DataFrame, masks: list[int]) -> DataFrame:
    """Rows (table, key, fp, n): each fingerprint in each table, with the size of its bucket; lone ones are dropped."""
    tables = F.array(*(F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)))
    rows = values.select("fp", F.explode(tables).alias("b")).select("b.table", "b.key", "fp")
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("table", "key"))).where("n > 1")


def covering_links(values: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links ``(src, dst)`` that connect the different fingerprints of ``values(fp)`` as all pairs within the radius do."""
    rows = written(_in_tables(values, span_masks()), "buckets")
    small = rows.where(F.col("n") <= bucket_limit).groupBy("table", "key").agg(F.collect_list("fp").alias("members"))
    links = _links_within_buckets(small)
    large = rows.where(F.col("n") > bucket_limit)
    if large.limit(1).count():
        finer = _in_tables(large.select("fp").distinct(), plane_masks())
        links = links.unionByName(_links_within_buckets(finer.groupBy("table", "key").agg(F.collect_list("fp").alias("members"))))
    return links


def near_duplicate_classes(docs: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: ``doc_id, fingerprint LONG, component_id``.

    component_id is the smallest doc_id that is reachable over links, the document itself included. Texts are read once;
    afterwards only ids and fingerprints move, and copies of a text are one fingerprint. Null texts, empty texts and
    texts of white space have fingerprint zero and are linked like any other. Rows with a null doc_id link their
    neighbours; their component_id is null only if no row of the component has an id. Repeated rows stay repeated.
    Further columns are ignored. No rows give no rows.
    """
    rows = written(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "fingerprints")
    firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    nodes = connected_components(covering_links(firsts.select("fp"), bucket_limit))
    members = written(nodes.join(firsts, nodes["node"] == firsts["fp"]).select("node", "component", "first_id"), "members")
    lowest = members.groupBy("component").agg(F.min("first_id").alias("lowest"))
    linked = members.join(lowest, "component").select(F.col("node").alias("fp"), "lowest")
    classes = firsts.join(linked, "fp", "left").select("fp", F.coalesce("lowest", "first_id").alias("component_id"))
    return rows.join(classes, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """The rows of ``docs`` with one document of each class of near-duplicates, that of the smallest doc_id; same columns.

    Ids that several rows of ``docs`` carry are kept once: the row with the smallest text. A class whose rows all lack
    an id keeps one row. Whole rows are shuffled once, by id.
    """
    classes = near_duplicate_classes(docs, bucket_limit)
    stay = written(classes.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "fingerprint").agg(F.count(F.lit(1)).alias("rows")), "stay")
    single = stay.groupBy("doc_id").agg(F.sum("rows").alias("rows"))
    kept = docs.alias("d").join(single.hint("shuffle_hash").alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")))
    once = kept.where(F.col("s.rows") == 1).select("d.*")
    if not single.where("rows > 1").limit(1).count():
        return once
    several = kept.where(F.col("s.rows") > 1).select("d.*").withColumn("_fp", fingerprint(F.col("text")))
    # a null id may stand for several classes: one row each; any other id keeps one row
    order = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("_fp"))).orderBy(F.col("text").asc_nulls_last())
    return once.unionByName(several.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank", "_fp"))
