"""Byte-level BPE encoding and decoding, by dynamic programming over prefixes.

For every prefix of a byte string exactly one token can end its encoding: the token t whose bytes end the prefix and
which may follow the last token of the prefix before it. "May follow" is a property of two tokens alone: merging the
bytes of both must give back just these two. So one array of last tokens holds the encodings of all prefixes; bytes
can be appended by carrying the array on, and after an edit only what follows the edit is computed again, up to the
place where the array agrees with the old one.

Texts are cut by the tokenizer's pattern first, as the vocabulary demands. Workers keep the ids of recent words; the
memory for that is bounded by ``CACHE_WORDS``.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from voxelry.llm.prefixes import PrefixTable

CACHE_WORDS = 400_000
BATCH_BYTES = 16 << 20

#: A space with something that is not white space on either side starts a new match of the pattern, whatever else the
#: text holds, so a text may be cut there.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: bytes of a token -> id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixEncoder:
    """Encodings of all prefixes of byte strings, under one table of ranks. Bytes go through the table as characters of Latin-1."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        names = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.table = PrefixTable(names, names, closed=True)
        self.longest = self.table.longest

    def merged(self, data: bytes) -> list[int]:
        """The definition: merge the adjacent pair of lowest rank, leftmost first, until no pair is a token."""
        return [self.table.order[p] for p in self.table.merged(data.decode("latin-1"))]

    def extend(self, last: list[int], data: bytes, stop: int | None = None) -> list[int]:
        """Carries on ``last`` (the last token of each prefix computed so far) to all prefixes of ``data``."""
        return self.table.extend(last, data.decode("latin-1"), stop)

    def tokens_of(self, last: list[int]) -> list[int]:
        """The encoding that ends with the last token of the longest prefix, read backwards."""
        return self.table.tokens_of(last)

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None and self.table.may_start(whole):
            return [whole]
        return self.tokens_of(self.extend([], data))

    def append(self, last: list[int], data: bytes, more: bytes) -> list[int]:
        """The last tokens of ``data + more``, given those of ``data``: an exact append, whatever merges across."""
        reach = data[max(0, len(data) - self.longest) :]
        return last + self.extend(last[len(data) - len(reach) :], reach + more)[len(reach) :]

    def edit(self, last: list[int], data: bytes, start: int, stop: int, new: bytes) -> list[int]:
        """The last tokens after ``data[start:stop]`` has become ``new``; reads the text from just before the edit to where both agree."""
        low, at, step = max(0, start - self.longest), stop, 4 * self.longest
        while True:  # as much of the text as it takes, at least twice the longest token beyond the edit
            at = min(len(data), at + step)
            near = self.table.edit(last[low:at], data[low:at].decode("latin-1"), start - low, stop - low, new.decode("latin-1"))
            if at == len(data) or near[-self.longest :] == last[at - self.longest : at]:
                return last[:low] + near + last[at:]
            step *= 2


class TextEncoder:
    """Ids of whole texts as packed little-endian unsigned 32-bit integers; ``encode_part`` encodes a part of a text.

    Parts are what single spaces cut (see _CUT), and the ids of a part do not depend on the others.
    """

    def __init__(self, encode_part: Callable[[str], list[int]], limit: int = CACHE_WORDS):
        self.encode_part, self.limit = encode_part, limit
        self.known: dict[str, bytes] = {}  # ids of " " + part

    def packed(self, part: str) -> bytes:
        ids = array("I", self.encode_part(part))
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        ids = list(map(self.known.get, rest))
        if None in ids:
            if len(self.known) > self.limit:
                self.known.clear()
                ids = [None] * len(rest)
            for at, found in enumerate(ids):
                if found is None:
                    part = rest[at]
                    found = self.known.get(part)
                    if found is None:
                        before = rest[at - 1] if at else head
                        if not part or part[0].isspace() or part[-1].isspace() or not before or before[-1].isspace():
                            return self.encode_irregular(text)
                        found = self.packed(" " + part)
                        if len(part) <= 64:
                            self.known[part] = found
                    ids[at] = found
        if rest and (not head or head[-1].isspace()):
            return self.encode_irregular(text)
        return self.packed(head) + b"".join(ids)

    def encode_irregular(self, text: str) -> bytes:
        """For texts with other white space beside a space."""
        head, *rest = _CUT.split(text)
        out = [self.packed(head)]
        for part in rest:
            clean = not (part[0].isspace() or part[-1].isspace())
            found = self.known.get(part) if clean else None
            if found is None:
                found = self.packed(" " + part)
                if clean and len(part) <= 64 and len(self.known) <= self.limit:
                    self.known[part] = found
            out.append(found)
        return b"".join(out)


@lru_cache(maxsize=4)
def prefix_encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(read_ranks(path))


@lru_cache(maxsize=4)
def text_encoder(path: str, pattern: str) -> TextEncoder:
    """One for each worker process; its words stay known from task to task."""
    import regex

    encoder, split, words = prefix_encoder(path), regex.compile(pattern), {}

    def encode_part(part: str) -> list[int]:
        ids: list[int] = []
        for word in split.findall(part):
            found = words.get(word)
            if found is None:
                found = encoder.encode(word.encode("utf-8"))
                if len(words) > CACHE_WORDS:
                    words.clear()
                if len(word) <= 64:
                    words[word] = found
            ids += found
        return ids

    return TextEncoder(encode_part)


def _id_type(docs: DataFrame):
    return docs.schema["doc_id"].dataType.simpleString()


def encode_texts(docs: DataFrame, path: str, pattern: str, decode: bool = False) -> DataFrame:
    """Encodes every whole text of ``docs(doc_id, text)``: rows ``doc_id, ids BINARY`` and, with ``decode``, ``decoded BINARY``.

    ``ids`` holds little-endian unsigned 32-bit integers, without special tokens: their strings in a text are ordinary
    text. ``decoded`` is read back from the ids, not from the text. A null text counts as empty and has no ids. One row
    for each input row, repeated rows included; a doc_id may be null; further columns are ignored. The work is a map
    over rows without a shuffle; output is handed on in pieces of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path, pattern)
        tokens = prefix_encoder(path).tokens
        for batch in batches:
            yield from coded_batches(batch, encoder.encode, (lambda ids: b"".join(map(tokens.__getitem__, ids))) if decode else None)

    columns = f"doc_id {_id_type(docs)}, ids binary" + ", decoded binary" * decode
    return docs.select("doc_id", "text").mapInArrow(run, columns)


def coded_batches(batch: pa.RecordBatch, encode: Callable[[str], bytes], decode: Callable[[memoryview], bytes] | None) -> Iterator[pa.RecordBatch]:
    """Ids, and what they decode to, of a batch of ids and texts, in pieces of about BATCH_BYTES of ids."""

    def out(start: int) -> pa.RecordBatch:
        columns = [batch.column(0).slice(start, len(ids)), pa.array(ids, pa.binary())]
        names = ["doc_id", "ids"]
        if decode is not None:
            columns.append(pa.array([decode(memoryview(x).cast("I")) for x in ids], pa.binary()))
            names.append("decoded")
        return pa.RecordBatch.from_arrays(columns, names=names)

    ids, start, size = [], 0, 0
    for text in batch.column(1):
        ids.append(encode(text.as_py() or ""))
        size += len(ids[-1])
        if size > BATCH_BYTES:
            yield out(start)
            start, ids, size = start + len(ids), [], 0
    if ids:
        yield out(start)


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded BINARY`` to rows with ``ids BINARY`` (packed as by encode_texts); null ids decode to null."""
    from pyspark.sql import functions as F

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = prefix_encoder(path).tokens
        for ids in batches:
            yield ids.map(lambda x: None if x is None else b"".join(map(tokens.__getitem__, memoryview(bytes(x)).cast("I"))))

    return rows.withColumn("decoded", decoded("ids"))
