"""Packing by power-of-two decomposition.

A document of n ids (its text's ids and a closing id) is cut into floor(n / longest) pieces of the longest length and
one piece for each binary digit of the rest, largest first. Each piece is a whole sequence: its length is a power of
two, so nothing is padded and no sequence crosses documents; `bucket` (log2 of the length) groups pieces of equal length
into batches. Nothing has to be gathered for this, so there is no shuffle.

Defined results: null text is empty text and gives the closing id alone, as a piece of length 1; an empty table gives
no rows; repeated rows are packed each, in sequences of their own, so nothing hangs on ties; a very long text is encoded
as a whole and cut into as many pieces as it takes; columns other than doc_id and text are not read, so no name can clash.
sequence_id is unique, not dense: the partition's number in the upper bits and the piece's place in the lower ones.
"""

from __future__ import annotations

import functools
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgtrace.llm.common import pieces_of, text_or_empty
from imgtrace.llm.splitting import splitter

#: Distinct matches whose ids a worker keeps; beyond it the memory starts anew.
KEPT_PIECES = 300_000


def _byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


class TextIds:
    """Ids of texts as little-endian unsigned 32-bit integers, by a file of the tokenizers library.

    The byte-level pre-tokenizer gives the model each match of its pattern by itself, so a match seen before is not
    encoded anew. Texts that may hold an added token go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = splitter()
        self.known = _Matches(self.tokenizer.model)

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.split(text)))


class _Matches(dict):
    """From a match of the pattern to its ids."""

    def __init__(self, model) -> None:
        super().__init__()
        self.model = model
        self.characters = _byte_characters()

    def __missing__(self, match: str) -> bytes:
        tokens = self.model.tokenize("".join(map(self.characters.__getitem__, match.encode())))
        ids = struct.pack(f"<{len(tokens)}I", *(x.id for x in tokens))
        if len(match) <= 64:
            self[match] = ids
        return ids


@functools.cache
def text_ids(path: str) -> TextIds:
    return TextIds(path)


def binary_pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; longest is a power of two."""
    out = [(start, longest) for start in range(0, n - n % longest, longest)]
    start, rest = n - n % longest, n % longest
    for bit in range(longest.bit_length() - 2, -1, -1):
        if rest >> bit & 1:
            out.append((start, 1 << bit))
            start += 1 << bit
    return out


def pack(docs: DataFrame, tokenizer_path: str, longest: int = 1024, closing_id: int = 0) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, bucket, sequence_id, offset."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    closing = np.array([closing_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = text_ids(tokenizer_path)
        for batch in batches:
            for part in pieces_of(batch):
                rows: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = ids_of(text) + closing
                    n = len(ids) // 4
                    rows += [(doc_id, start, length, ids[4 * start : 4 * (start + length)], n) for start, length in binary_pieces(n, longest)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    cut = source.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long")
    return cut.withColumns({"bucket": F.log2("length").cast("int"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
