"""SentencePiece encoding and decoding for models of merges, by a table of prefixes.

The model's merges join the adjacent pair whose union has the highest score, the leftmost of equals. The last token of every
prefix is found by an automaton and a test of pairs (see ``prefixes``), the ids are read backwards. Characters that the
model lacks fall back to the tokens of their bytes. White space is the mark U+2581. Where no piece holds a mark behind
another character, nothing merges across a word's beginning, so that texts are cut there and workers keep the ids of
recent words, up to ``CACHE_WORDS``. New words are cut again between characters that stand side by side in no piece.

The library normalizes texts and names the pieces with their scores; merging and decoding are done here.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.llm.bpe import coded_batches
from voxelry.llm.prefixes import PrefixTable

CACHE_WORDS = 400_000
MARK = "▁"


class SentenceEncoder:
    """Encodes and decodes whole texts under one model file; begin and end ids included."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        kinds = {i: "control" if model.is_control(i) else "unknown" if model.is_unknown(i) else "byte" if model.is_byte(i) else "piece" for i in range(size)}
        pieces = {model.id_to_piece(i): i for i, kind in kinds.items() if kind == "piece"}
        self.bytes_ = {int(model.id_to_piece(i)[3:5], 16): i for i, kind in kinds.items() if kind == "byte"}
        if len(self.bytes_) < 256 or any(model.is_unused(i) for i in range(size)):
            raise ValueError("only models with all bytes and without unused pieces are read")
        scores = sorted({model.get_score(i) for i in pieces.values()}, reverse=True)
        place = {score: at for at, score in enumerate(scores)}
        self.table = PrefixTable(pieces, {t: place[model.get_score(i)] for t, i in pieces.items()})
        self.begin, self.end = array("I", [model.bos_id()]).tobytes(), array("I", [model.eos_id()]).tobytes()
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.beside = {t[i : i + 2] for t in pieces for i in range(len(t) - 1)}
        self.words = self._cut(list(pieces))
        #: What each id stands for; a byte for itself, a control id for nothing, but it parts bytes: no text holds FF.
        self.surface = [b"\xff" if kind == "control" else bytes([int(model.id_to_piece(i)[3:5], 16)]) if kind == "byte" else model.id_to_piece(i).replace(MARK, " ").encode("utf-8") for i, kind in kinds.items()]
        self.surface = [" ⁇ ".encode() if kinds[i] == "unknown" else s for i, s in enumerate(self.surface)]
        self.kinds = kinds
        self.led = frozenset(i for t, i in pieces.items() if t[0] == MARK)
        self.padded = model.normalize("a") == MARK + "a"

    def _cut(self, pieces: list[str]) -> re.Pattern[str]:
        """Parts of a normalized text across whose borders nothing merges."""
        if any(MARK in t.lstrip(MARK) for t in pieces):
            return re.compile(r".+", re.DOTALL)
        alone = "".join(c for c in "\n\r\t" if not any(c in t for t in pieces if len(t) > 1))
        return re.compile(rf"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (rf"|[{alone}]+" if alone else ""))

    def _word(self, word: str) -> bytes:
        out, start, beside = [], 0, self.beside
        for at in range(1, len(word)):
            if word[at - 1 : at + 1] not in beside:
                out.append(self._part(word[start:at]))
                start = at
        out.append(self._part(word[start:]))
        return b"".join(out)

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            ids: list[int] = []
            for i in self.table.tokens_of(self.table.extend([], part)):
                if i >= 0:
                    ids.append(i)
                else:
                    ids += [self.bytes_[b] for b in chr(-1 - i).encode("utf-8")]
            found = array("I", ids).tobytes()
            if len(part) <= 64:
                if len(self.parts) >= CACHE_WORDS:
                    self.parts.clear()
                self.parts[part] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a text as packed little-endian unsigned 32-bit integers."""
        out, known = [self.begin], self.known
        for word in self.words.findall(self.library.normalize(text)):
            found = known.get(word)
            if found is None:
                found = self._word(word)
                if len(word) <= 64:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[word] = found
            out.append(found)
        out.append(self.end)
        return b"".join(out)

    def decode(self, ids: Sequence[int]) -> bytes:
        """The UTF-8 text of ids: marks are spaces, that which the model puts before a text goes, broken bytes become U+FFFD."""
        start, stop, kinds = 0, len(ids), self.kinds
        while start < stop and kinds[ids[start]] == "control":
            start += 1
        while start < stop and kinds[ids[stop - 1]] == "control":
            stop -= 1
        out = b"".join(map(self.surface.__getitem__, ids[start:stop]))
        if self.padded and start < stop and ids[start] in self.led:
            out = out[1:]
        try:
            out.decode("utf-8")
        except UnicodeDecodeError:
            return self._mended(ids).encode("utf-8")
        return out

    def _mended(self, ids: Sequence[int]) -> str:
        """Decoding with broken runs of bytes: every byte that begins no character becomes U+FFFD."""
        out, run = [], bytearray()
        begun = not self.padded
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == "byte":
                run += self.surface[i]
                continue
            if run:
                out.append(_characters(bytes(run)))
                begun, run = True, bytearray()
            if i is not None and self.kinds[i] != "control":
                piece = self.surface[i].decode("utf-8")
                out.append(piece[1:] if not begun and i in self.led else piece)
                begun = True
        return "".join(out)


def _characters(run: bytes) -> str:
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at : at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=4)
def sentence_encoder(path: str) -> SentenceEncoder:
    """One for each worker process; its words stay known from task to task."""
    return SentenceEncoder(path)


def encode_sentences(docs: DataFrame, path: str, decode: bool = False) -> DataFrame:
    """Encodes every whole text of ``docs(doc_id, text)``: rows ``doc_id, ids BINARY`` and, with ``decode``, ``decoded BINARY``.

    ``ids`` holds little-endian unsigned 32-bit integers with the begin and end ids; names of control tokens in a text are
    ordinary text. ``decoded`` is the UTF-8 text read back from the ids: marks U+2581 in a text come back as spaces. A null
    text counts as empty and has the begin and end ids only. One row for each input row, repeated rows included; a doc_id may
    be null; further columns are ignored; no rows give no rows. The work is a map over rows without a shuffle; output is
    handed on in pieces of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = sentence_encoder(path)
        for batch in batches:
            yield from coded_batches(batch, encoder.encode, encoder.decode if decode else None)

    columns = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary" + ", decoded binary" * decode
    return docs.select("doc_id", "text").mapInArrow(run, columns)


def decode_sentences(rows: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded BINARY``, the UTF-8 text, to rows with ``ids BINARY`` (packed as by encode_sentences); null ids decode to null."""

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = sentence_encoder(path)
        for ids in batches:
            yield ids.map(lambda x: None if x is None else encoder.decode(memoryview(bytes(x)).cast("I")))

    return rows.withColumn("decoded", decoded("ids"))
