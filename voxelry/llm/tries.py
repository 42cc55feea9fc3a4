"""Prefix trie of conversations with totals of subtrees, rolled up in bands of depth.

A node of depth d is a different sequence of d turns; its name is a pair of 64-bit hashes: the exclusive or of hashes of
each turn together with its place, so that prefixes can be hashed in parts and a conversation of any length needs no single
task. A node is known by its smallest member and its depth: that conversation runs through it and is the smallest member
of all its own nodes from the first one on that it has alone at the top.

Totals go up in bands of ``BAND`` depths: within a band every node explodes to its ancestors of that band only; the tops of the
bands, with the totals of their bands, form a trie of their own, a band's depth apart, that is rolled up in the same way; the
complete totals of tops are then added to their ancestors in the band above. So a node makes at most BAND rows, and the
number of rounds is the logarithm of the depth to the base BAND.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.llm.shared import salted_join, written

BAND = 32
#: Conversations that may share the beginning of another: blocks of this many ids.
SHARING = 100
MOST_SHARED = 6
#: Ids that are joined to one string before strings are hashed one after the other.
IDS_AT_ONCE = 1024
_KEY = ["depth", "k1", "k2"]


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, part, pos`` (from 1), ``digest, chars`` of ``turns(conv_id, turn, role, text)``, in the order of turns, null first.

    Null roles and texts are empty; turns of one number are ordered by role and text. Rows without a conv_id are left out.
    Rows are dealt in ranges of their order and counted within these parts, so that a conversation of any length is spread.
    """
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("copy"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    # the length keeps role and text from running into each other
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", digest.alias("digest"), F.char_length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("place"))
    dealt = written(dealt.withColumn("part", F.shiftright("place", 33)), "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    parts = parts.select("conv_id", "part", (F.col("first") - F.coalesce(F.sum("n").over(before), F.lit(0)) - 1).alias("zero"))
    return dealt.join(parts, ["conv_id", "part"]).select("conv_id", "part", (F.col("place") - F.col("zero")).alias("pos"), "digest", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: their turns ``conv_id, part, pos, digest, chars, ends`` and their lengths ``conv_id, length``.

    ``turns`` is as by numbered_turns. The first h turns are those of conversation ``conv_id - conv_id % 100``, if there is
    one, with ``h = crc32(conv_id in decimals) % 6``; the conversation's own turns after its first h follow.
    """
    lengths = written(turns.groupBy("conv_id").agg(F.max("pos").alias("own")), "lengths")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_SHARED))
    wanted = lengths.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % SHARING).alias("base"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    wanted = wanted.join(bases, "base", "left").withColumn("shared", F.least("h", F.coalesce("of_base", F.lit(0))))
    wanted = written(wanted.select("conv_id", "base", "h", "shared", (F.col("shared") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "wanted")
    first = turns.where(F.col("pos") < MOST_SHARED).select(F.col("conv_id").alias("base"), "pos", "digest", "chars")  # at most 5 turns for 199 conversations
    begin = wanted.join(first, "base").where("pos <= shared").select("conv_id", F.lit(-1).cast("long").alias("part"), "pos", "digest", "chars", "length")
    own = salted_join(turns, wanted.select("conv_id", "h", "shared", "length"), ["conv_id"]).where("pos > h")
    own = own.select("conv_id", "part", (F.col("pos") - F.col("h") + F.col("shared")).alias("pos"), "digest", "chars", "length")
    return begin.unionByName(own).withColumn("ends", F.col("pos") == F.col("length")).drop("length"), wanted.select("conv_id", "length")


def prefixes_of(rows: DataFrame) -> DataFrame:
    """``conv_id, depth, k1, k2, chars, ends``: the name of every prefix of the conversations, given by their turns, but the empty one."""
    for k in (1, 2):
        rows = rows.withColumn(f"h{k}", F.xxhash64(F.lit(k), "pos", "digest"))
    running = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy("conv_id", "part").agg(*(F.bit_xor(f"h{k}").alias(f"x{k}") for k in (1, 2)))
    ahead = ahead.select("conv_id", "part", *(F.coalesce(F.bit_xor(f"x{k}").over(before), F.lit(0)).alias(f"a{k}") for k in (1, 2)))
    within = rows.select("conv_id", "part", F.col("pos").cast("long").alias("depth"), "chars", "ends", *(F.bit_xor(f"h{k}").over(running).alias(f"w{k}") for k in (1, 2)))
    return within.join(ahead, ["conv_id", "part"]).select("conv_id", "depth", *(F.col(f"w{k}").bitwiseXOR(F.col(f"a{k}")).alias(f"k{k}") for k in (1, 2)), "chars", "ends")


def _paths(through: DataFrame, band: int) -> DataFrame:
    """``conv_id, band, path``: for each band of depths that holds nodes of which a conversation is the smallest member, or
    right above such a node, the nodes it runs through: ``(depth, rep)`` from the node above the band to the one below."""
    at = F.floor(F.col("depth") / band)
    top = F.col("depth") % band == 0
    bands = F.array_compact(F.array(at, F.when(top & (F.col("depth") > 0), at - 1), F.when((F.col("depth") + 1) % band == 0, at + 1)))
    rows = through.select("conv_id", F.explode(bands).alias("band"), F.struct("depth", "rep").alias("node"))
    paths = rows.groupBy("conv_id", "band").agg(F.array_sort(F.collect_list("node")).alias("path"))  # at most BAND + 2 nodes
    first = F.col("band") * band
    return paths.where(F.exists("path", lambda x: (x["rep"] == F.col("conv_id")) & (x["depth"] >= first)))


def rolled_up(through: DataFrame, values: DataFrame, columns: list[str], deepest: int, band: int = BAND) -> tuple[DataFrame, DataFrame]:
    """Totals over subtrees: ``depth, rep`` and the sums of ``columns`` of ``values(depth, rep, *columns)``.

    ``through(conv_id, depth, rep)`` has the nodes each conversation runs through, by depth and smallest member. Also
    returns the paths by bands. ``deepest`` is the greatest depth.
    """
    paths = written(_paths(through, band), "paths")
    own = values.withColumn("band", F.floor(F.col("depth") / band))
    above = paths.select(F.col("conv_id").alias("rep"), "band", "path")

    def spread(rows: DataFrame) -> DataFrame:
        """Adds the values of rows ``rep, depth, band`` to their ancestors within ``band``, and to themselves if they lie in it."""
        inside = F.filter("path", lambda x: (x["depth"] >= F.col("band") * band) & (x["depth"] <= F.col("depth")) & (x["depth"] < (F.col("band") + 1) * band))
        each = rows.join(above, ["rep", "band"]).select(F.explode(inside).alias("node"), *columns)
        return each.select("node.depth", "node.rep", *columns)

    sums = [F.sum(c).alias(c) for c in columns]
    part = spread(own)
    if deepest < band:
        return part.groupBy("depth", "rep").agg(*sums), paths
    part = written(part.groupBy("depth", "rep").agg(*sums), "banded")
    tops = F.col("depth") % band == 0
    up = lambda rows: rows.where(tops).withColumn("depth", F.floor(F.col("depth") / band))
    whole, _ = rolled_up(written(up(through), "tops"), up(part), columns, deepest // band, band)
    whole = written(whole.withColumn("depth", F.col("depth") * band), "rolled")
    carried = spread(whole.where("depth > 0").withColumn("band", F.floor(F.col("depth") / band) - 1))
    # tops have their own band counted in both
    return part.where(~tops).unionByName(whole).unionByName(carried.where(~tops)).groupBy("depth", "rep").agg(*sums), paths


def _hashed_ends(ends: DataFrame) -> DataFrame:
    """``depth, rep, ends_sha256``: SHA-256 of the decimal ids of ``ends(depth, rep, conv_id)``, ascending, joined by commas.

    Ids are joined in ranges of IDS_AT_ONCE numbers; only these strings go through the hash one after the other.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    strings = ends.groupBy("depth", "rep", F.floor(F.col("conv_id") / IDS_AT_ONCE).alias("range")).agg(joined.alias("ids"))
    ordered = strings.repartition("depth", "rep").sortWithinPartitions("depth", "rep", "range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        node, state = None, None
        for batch in batches:
            done = []
            for depth, rep, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "rep", "ids"))):
                if (depth, rep) == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (depth, rep), hashlib.sha256(ids.encode())
            yield _ends_batch(done)
        if node is not None:
            yield _ends_batch([(*node, state.hexdigest())])

    return ordered.select("depth", "rep", "ids").mapInArrow(run, "depth long, rep long, ends_sha256 string")


def _ends_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"depth": pa.int64(), "rep": pa.int64(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))


def prefix_trie(members: DataFrame, lengths: DataFrame, band: int = BAND) -> DataFrame:
    """The trie of conversations: ``members(conv_id, depth, k1, k2, chars, ends)`` as by prefixes_of, ``lengths(conv_id, length)`` of all.

    Returns a row for each node: ``conv_id`` (its smallest member), ``depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``.
    """
    zero = F.lit(0).cast("long")
    roots = lengths.select("conv_id", *(zero.alias(c) for c in (*_KEY, "chars")), (F.col("length") == 0).alias("ends"))
    members = written(members.unionByName(roots), "members")
    sized = members.groupBy(*_KEY).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"))
    nodes = written(sized, "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None:
        return members.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    through = written(salted_join(members.select("conv_id", *_KEY, "ends"), nodes.select(*_KEY, "rep"), _KEY).select("conv_id", "depth", "rep", "ends"), "through")
    ends = through.where("ends").select("depth", "rep", "conv_id")
    ended = ends.groupBy("depth", "rep").agg(F.count(F.lit(1)).alias("ended"))
    values = nodes.join(ended, ["depth", "rep"], "left").select(
        "depth", "rep", "n_convs", F.when(F.col("ended") == F.col("n_convs"), 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")
    )
    values = written(values, "values")
    totals, paths = rolled_up(through, values.select("depth", "rep", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"], deepest, band)
    # the parent is the node before on the path of the smallest member
    mine = F.filter(F.zip_with("path", F.slice("path", 2, F.size("path")), lambda a, b: F.struct(b["depth"].alias("depth"), b["rep"].alias("rep"), a["rep"].alias("parent"))), lambda x: x["rep"] == F.col("conv_id"))
    parents = paths.select("band", F.explode(mine).alias("n")).where(F.floor(F.col("n.depth") / band) == F.col("band")).select("n.depth", "n.rep", F.col("n.parent").alias("parent_conv_id"))
    children = parents.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("rep")).agg(F.count(F.lit(1)).alias("n_children"))
    out = values.select("depth", "rep", "n_convs")
    for more in (totals, parents, children, _hashed_ends(ends)):
        out = out.join(more, ["depth", "rep"], "left")
    return out.select(
        F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """The prefix trie of the rebuilt ``conversations(conv_id, turn, role, text)``; see rebuilt and prefix_trie.

    Null roles and texts count as empty, null turns come first, turns of one number are ordered by a hash of role and text;
    repeated rows are turns of their own. Rows without a conv_id are left out; every other conversation has a root at
    least. Other columns are ignored. No rows give no rows.
    """
    turns = written(numbered_turns(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")), "numbered")
    rows, lengths = rebuilt(turns)
    return prefix_trie(prefixes_of(written(rows, "rebuilt")), lengths, band)
