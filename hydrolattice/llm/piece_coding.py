"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary holds a whitespace mark after another character, so no piece crosses from one word into the
next mark. Each distinct marked word is segmented once into a table, and ids come back by position. A table holds the
chunks of one Python worker, up to a bound: joining every position of every text to one global table would shuffle each text
several times over.
"""

from __future__ import annotations

import hashlib
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .shared import map_texts, process_wide

MARK = "▁"
MAX_CHUNKS = 200_000


class ChunkTable(dict):
    """Chunk text to row number; ids and surfaces of each row are made in batches by ``segment``."""

    def __init__(self, model: bytes):
        super().__init__()
        self.coder = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = (self.coder.id_to_piece(i) for i in range(self.coder.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces of this vocabulary cross whitespace marks")
        if self.coder.decode(self.coder.encode("  a  b ")) != "  a  b ":
            raise ValueError("the vocabulary must keep white space as it is")
        self.alone = self.coder.piece_to_id(MARK)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.ids, self.starts, self.surfaces, self.waiting = array("i"), array("q", [0]), [], []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = at = len(self.surfaces) + len(self.waiting)
        self.waiting.append(chunk)
        return at

    def segment(self) -> None:
        """Segment the new chunks. A chunk stands for one mark and its own text, whose leading spaces are further marks.

        Decoding drops the first mark of a chunk; between chunks it is the space that joins their surfaces.
        """
        if not self.waiting:
            return
        coded = [ids or [self.alone] for ids in self.coder.encode(self.waiting, num_threads=1)]
        for ids in coded:
            self.ids.extend(ids)
            self.starts.append(len(self.ids))
        self.surfaces += [chunk if chunk == text else text for chunk, text in zip(self.waiting, self.coder.decode(coded, num_threads=1), strict=True)]
        self.waiting = []


def chunks_of(text: str) -> list[str]:
    """The chunks of a text, each without the first of its marks; together they are the text behind a leading mark."""
    if not text:
        return []
    pieces = text.replace(MARK, " ").split(" ")
    if "" not in pieces:
        return pieces
    out, marks = [], 0
    for piece in pieces:
        if piece:
            out.append(" " * marks + piece)
            marks = 0
        else:
            marks += 1
    return [*out, " " * (marks - 1)] if marks else out


def code_texts(table: ChunkTable, texts: list[str]) -> tuple[pa.Array, list[str]]:
    """Ids and decoded text of each text."""
    if len(table) > MAX_CHUNKS:
        table.reset()
    rows = [np.fromiter(map(table.__getitem__, c), np.int64, len(c)) for c in map(chunks_of, texts)]
    table.segment()
    flat, starts, surfaces = np.frombuffer(table.ids, np.int32) if table.ids else np.empty(0, np.int32), np.frombuffer(table.starts, np.int64), table.surfaces
    at = np.concatenate([np.empty(0, np.int64), *rows])
    lengths = starts[at + 1] - starts[at]
    ends = np.cumsum(lengths)
    ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - ends + lengths, lengths)]
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)]
    decoded = [" ".join(map(surfaces.__getitem__, r.tolist())) for r in rows]
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())), decoded


def encode_decode(docs: DataFrame, keep: list[str], model_path: str, *, text: str = "text") -> DataFrame:
    """``keep`` columns with ``ids`` (all piece ids of the whole text) and ``decoded`` (their text).

    The model file is read on the driver and goes to the tasks with the function. Missing and empty texts have no ids and
    an empty decoded text; repeated rows stay.
    """
    model = Path(model_path).read_bytes()

    def build():
        table = process_wide(f"pieces {hashlib.sha256(model).hexdigest()}", lambda: ChunkTable(model))
        return lambda texts: code_texts(table, texts)

    return map_texts(docs, text, keep, "ids array<int>, decoded string", build)
