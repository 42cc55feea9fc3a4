"""Packing of tokenized documents into sequences: dominance reduction, then best fit decreasing.

How many sequences are needed depends on nothing but how many pieces have which length, and there are at most
``capacity`` lengths. So the plan is made from a histogram of lengths that covers all pieces, exactly as if every piece
were handled one by one, and its size does not grow with the corpus. Pieces of one length are interchangeable; each
gets its rank among those of its length by counting over small salted groups, and finds its place in the plan.

The reduction (after Martello and Toth) takes lengths from the largest down. With s the length at hand and R what it
leaves free, a set of pieces is fixed as a sequence of its own where some optimal packing must contain it:

* nothing that is left fits into R: s alone;
* the longest t that fits fills R exactly, or no two pieces fit into R together: s with t;
* no three pieces fit into R together, and t is at least as long as the best pair that fits: s with t;
* no three fit, t is part of the best pair (t, b), and no pair of pieces both longer than b fits: s with t and b.

What is left over is packed by best fit decreasing.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelry.llm.bpe import BATCH_BYTES, TextEncoder
from voxelry.llm.shared import written

CAPACITY = 2048
END_OF_DOCUMENT = 0
SALTS = 1024
CACHE_WORDS = 100_000


@dataclass
class Plan:
    """Slots: pieces of ``length`` with ranks from ``rank`` on go to the sequences from ``sequence`` on, ``each`` in one."""

    capacity: int
    sequences: int = 0
    slots: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, rank, sequence, each, offset
    _next: dict[int, int] = field(default_factory=dict)

    def place(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        rank = self._next.get(length, 0)
        self._next[length] = rank + count
        self.slots.append((length, rank, sequence, each, offset))

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def fix(self, lengths: tuple[int, ...], count: int) -> None:
        first, offset = self.open(count), 0
        for length in lengths:
            self.place(length, count, first, 1, offset)
            offset += length


def _reduce(left: dict[int, int], plan: Plan) -> None:
    """Fixes dominating sets, and takes them out of ``left`` (length -> pieces), until none is found."""
    capacity = plan.capacity
    changed = True
    while changed and left:
        changed = False
        for s in sorted(left, reverse=True):
            while left.get(s):
                found = _dominating(s, left, capacity)
                if not found:
                    break
                lengths, count = found
                plan.fix(lengths, count)
                for x in lengths:
                    left[x] -= count
                    if not left[x]:
                        del left[x]
                changed = True


def _dominating(s: int, left: dict[int, int], capacity: int) -> tuple[tuple[int, ...], int] | None:
    """A dominating set with s and how many times it can be fixed at once, or None."""
    room = capacity - s
    others = dict(left)
    others[s] -= 1
    lengths = sorted(x for x, n in others.items() if n)
    if not lengths or lengths[0] > room:
        return (s,), left[s]
    t = lengths[bisect_right(lengths, room) - 1]
    smallest = _smallest(lengths, others, 3)
    pairs = left[s] // 2 if t == s else min(left[s], left[t])
    if t == room or len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return (s, t), pairs
    if len(smallest) > 2 and sum(smallest) <= room:
        return None
    best = _best_pair(lengths, others, room)
    if best is None or t >= sum(best):
        return (s, t), _alike((s, t), left)
    a, b = best
    if a == t:
        others[t] -= 1
        longer = _smallest([x for x in lengths if x > b and others[x]], others, 2)
        if len(longer) < 2 or sum(longer) > room:
            return (s, a, b), _alike((s, a, b), left)
    return None


def _alike(lengths: tuple[int, ...], left: dict[int, int]) -> int:
    """How often a set can be fixed before a count falls so low that the case may differ: no case looks at four pieces."""
    return max(1, min((left[x] - 4) // lengths.count(x) for x in lengths))


def _smallest(lengths: list[int], counts: dict[int, int], n: int) -> list[int]:
    out: list[int] = []
    for x in lengths:
        out += [x] * min(counts[x], n - len(out))
        if len(out) == n:
            break
    return out


def _best_pair(lengths: list[int], counts: dict[int, int], room: int) -> tuple[int, int] | None:
    """Two pieces of the largest sum that fit, the longer first; of equal sums the one with the longest piece."""
    best, low = None, 0
    for a in reversed(lengths):
        at = bisect_right(lengths, min(room - a, a)) - 1
        if at >= 0 and lengths[at] == a and counts[a] < 2:
            at -= 1
        if at >= 0 and a + lengths[at] > low:
            best, low = (a, lengths[at]), a + lengths[at]
    return best


def _best_fit(left: dict[int, int], plan: Plan) -> None:
    """Best fit decreasing over lengths: whole ranges of equally full sequences are handled at once."""
    free: list[int] = []  # what the open sequences leave free, ascending
    open_: dict[int, list[tuple[int, int]]] = {}  # free -> ranges (first sequence, how many)

    def keep(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in open_:
                open_[room] = []
                insort(free, room)
            open_[room].append((first, count))

    for s in sorted(left, reverse=True):
        count = left[s]
        while count:
            at = bisect_left(free, s)
            if at < len(free):
                room = free[at]
                first, many = open_[room].pop()
                if not open_[room]:
                    del open_[room], free[at]
            else:
                room, many = plan.capacity, -(-count // (plan.capacity // s))
                first = plan.open(many)
            each = min(room // s, count)
            full = min(many, count // each)
            offset = plan.capacity - room
            plan.place(s, full * each, first, each, offset)
            keep(room - each * s, first, full)
            keep(room, first + full, many - full)
            count -= full * each


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan for so many pieces of each length from 1 to ``capacity``."""
    plan, left = Plan(capacity), {s: n for s, n in histogram.items() if n}
    _reduce(left, plan)
    _best_fit(left, plan)
    return plan


def pack(pieces: DataFrame, keys: list[str], capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """Adds ``sequence_id LONG`` and ``offset LONG`` to ``pieces``, whose column ``length`` counts tokens.

    In a sequence the pieces lie side by side from offset 0 on. ``keys`` name the columns that tell pieces apart; they
    only order pieces of one length. Pieces with the same keys (repeated rows, nulls) get places of their own. A length
    that is null, below 1 or above ``capacity`` gets null places. All other columns stay, but for those of
    these two names, which are replaced; no rows give no rows. ``pieces`` is read twice and must give the same rows both times: pass a written table.
    """
    piece = F.struct(*(F.col(k) for k in keys))
    stay = [F.col(f"`{c}`") for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = pieces.select(F.struct(*stay).alias("row"), F.when(F.col("length").between(1, capacity), F.col("length")).cast("int").alias("size"), F.pmod(F.xxhash64(piece), F.lit(salts)).cast("int").alias("salt"), piece.alias("piece"))
    groups = rows.where("size is not null").groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n"))
    groups = written(groups, "lengths")
    plan = make_plan({r["size"]: r["n"] for r in groups.groupBy("size").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = F.sum("n").over(Window.partitionBy("size").orderBy("salt")) - F.col("n")
    groups = groups.select("size", "salt", before.alias("before"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("size", "salt").orderBy("piece")) - 1)
    ranked = ranked.join(groups, ["size", "salt"], "left").select("row", _place(plan)("size", (F.col("rank") + F.col("before")).cast("long")).alias("place"))
    return ranked.select("row.*", F.col("place.sequence_id").alias("sequence_id"), F.col("place.offset").alias("offset"))


def _place(plan: Plan):
    """A place for (length, rank): a search in the slots, whose number the capacity bounds."""
    slots = np.array(sorted(plan.slots) or [(0, 0, 0, 1, 0)], dtype=np.int64)
    starts = (slots[:, 0] << 48) + slots[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        real = size.notna().to_numpy()
        s, r = size.fillna(0).to_numpy(np.int64), rank.fillna(0).to_numpy(np.int64)
        at = np.maximum(np.searchsorted(starts, (s << 48) + r, side="right") - 1, 0)
        beyond = r - slots[at, 1]
        out = pd.DataFrame({"sequence_id": slots[at, 2] + beyond // slots[at, 3], "offset": slots[at, 4] + beyond % slots[at, 3] * s})
        return out.astype("Int64").where(pd.Series(real), pd.NA)

    return place


def ranks_of_json(path: str) -> dict[bytes, int]:
    """Ranks of the byte-level vocabulary in a ``tokenizers`` JSON file, whose ids follow the order of its merges."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)
    special = {t["content"] for t in vocabulary.get("added_tokens", [])}
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
    return {bytes(byte_of[c] for c in token): rank for token, rank in vocabulary["model"]["vocab"].items() if token not in special}


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> TextEncoder:
    import tiktoken

    encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks_of_json(path), special_tokens={})
    return TextEncoder(encoding.encode_ordinary, CACHE_WORDS)


@lru_cache(maxsize=2)
def _added_tokens(path: str) -> tuple[re.Pattern | None, dict[str, bytes]]:
    """A pattern that finds the added tokens of a ``tokenizers`` file in a text, and their packed ids."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError(f"added tokens of {path} that depend on what is beside them are not supported")
    ids = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
    longest_first = sorted(map(re.escape, ids), key=len, reverse=True)
    return (re.compile(f"({'|'.join(longest_first)})") if ids else None), ids


def _with_added(encoder: TextEncoder, path: str, text: str) -> bytes:
    """The ids of a text in which each added token is its one id; what lies between is encoded by itself."""
    found, ids = _added_tokens(path)
    if found is None:
        return encoder.encode(text)
    return b"".join(ids[part] if at % 2 else encoder.encode(part) for at, part in enumerate(found.split(text)) if part)


def token_pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, added: bool = False) -> DataFrame:
    """Pieces of the tokenized whole texts: ``doc_id, piece INT, start LONG, length LONG, ids BINARY``.

    The ids are those of the vocabulary in the ``tokenizers`` file ``path``, followed by id 0. No special tokens are put
    around a text; the strings of the file's added tokens in a text become their ids with ``added``, as the library does
    by default, and are ordinary text without. Ids are packed as little-endian unsigned 32-bit integers. A document of
    more than ``capacity`` ids is cut into pieces of ``capacity``, of which the first may be shorter; ``start`` counts
    the ids before a piece. A null text counts as empty and is one piece of one id. Repeated rows are documents of their
    own; further columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(path, pattern), array("I", [END_OF_DOCUMENT]).tobytes()
        for batch in batches:
            rows, size = [], 0
            for at, text in enumerate(batch.column(1)):
                whole = text.as_py() or ""
                ids = (_with_added(encoder, path, whole) if added else encoder.encode(whole)) + end
                n = len(ids) // 4
                first = n % capacity or capacity
                for piece, start in enumerate([0, *range(first, n, capacity)]):
                    length = capacity if piece else first
                    rows.append((at, piece, start, length, ids[4 * start : 4 * (start + length)]))
                size += len(ids)
                if size > BATCH_BYTES:
                    yield out(batch, rows)
                    rows, size = [], 0
            if rows:
                yield out(batch, rows)

    def out(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        at, piece, start, length, ids = zip(*rows)
        columns = [batch.column(0).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def packed_documents(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, added: bool = False) -> DataFrame:
    """Places of all pieces of ``docs``: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Texts are tokenized once, with or without ``added`` tokens (see token_pieces); after that only lengths and check sums move.
    """
    pieces = token_pieces(docs, path, pattern, capacity, added)
    pieces = written(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(pieces, ["doc_id", "piece", "start", "ids_crc32"], capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The sequences themselves from placed pieces with their ``ids``: ``sequence_id, ids BINARY, doc_ids ARRAY``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    made = placed.where("sequence_id is not null").groupBy("sequence_id").agg(parts.alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return made.select("sequence_id", joined.alias("ids"), F.col("p.doc_id").alias("doc_ids"))
