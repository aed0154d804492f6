"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes are written as Latin-1 text, an automaton finds all tokens in it, and the encoder goes
forward with the longest match that is compatible with the token before, falling back to shorter
ones and, at dead ends, to the token before.  Each position is given up at most once, so time is
linear, and the result is that of replaying the merges.  Rows come and go as Arrow batches; workers
do not load pandas, which would take as much memory as the tokens.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.bpe import Tokens, chunker
from tideline.llm.common import TextMemo

RANKS = "byte_bpe_50k.tiktoken"
#: Rows whose ids are held at once, and bytes of a generation of the memo of chunks and their pieces.
ROWS, CHUNKS = 200, 48 << 20
#: Characters of a text, and ids, that are taken at once.
LONG = 1 << 16


class ByteCoder:
    """Encodes and decodes as the ranks in ``path`` say; each match of the split pattern separately."""

    def __init__(self, path: str):
        self.tokens = Tokens.from_ranks(path)
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.chunks = chunker()
        self.packed = TextMemo(self._packed, CHUNKS)

    def _packed(self, chunk: str) -> bytes:
        """Ids of a chunk; its pieces are looked up like chunks, as a piece by itself is one match again."""
        pieces = self.split.findall(chunk)
        if len(pieces) > 1:
            return b"".join(map(self.packed.__getitem__, pieces))
        return array("I", self._piece(chunk)).tobytes()

    def _piece(self, text: str) -> list[int]:
        """Tokens of one match of the split pattern."""
        piece = text.encode().decode("latin-1")
        whole = self.tokens.by_text.get(piece)
        if whole is not None:
            return [whole]
        sizes, fits, shorter = self.tokens.sizes, self.tokens.fits, self.tokens.shorter
        longest = [-1] * (len(piece) + 1)
        for end, token in self.tokens.automaton.iter(piece):
            longest[end + 1 - sizes[token]] = token  # matches come by their end, so the longest is last
        open_, made, at, token = [True] * (len(piece) + 1), [], 0, longest[0]
        while at < len(piece):
            while token >= 0 and not (
                open_[at + sizes[token]] and (not made or fits[made[-1], token])
            ):
                token = shorter[token]
            if token >= 0:
                made.append(token)
                at += sizes[token]
                token = longest[at]
            else:
                open_[at] = False
                token = made.pop()
                at -= sizes[token]
        return made

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(text) <= LONG:
            return b"".join(map(self.packed.__getitem__, self.chunks.findall(text)))
        made = bytearray()  # a list of all chunks would outweigh the text many times
        for match in self.chunks.finditer(text):
            made += self.packed[match[0]]
        return bytes(made)

    def decode(self, packed: bytes) -> bytes:
        ids, texts = np.frombuffer(packed, dtype="<u4"), self.tokens.texts
        steps = (ids[i : i + LONG].tolist() for i in range(0, len(ids), LONG))
        return b"".join(b"".join(map(texts.__getitem__, step)) for step in steps)


@lru_cache(maxsize=2)
def coder(path: str) -> ByteCoder:
    return ByteCoder(path)


def _ranks(path: str | None) -> str:
    return path or public_tokenizers.path(RANKS)


def _id_lists(packed: list[bytes]) -> pa.Array:
    """Arrays of ints from ids as little-endian integers."""
    ends = np.cumsum([0, *[len(x) // 4 for x in packed]]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(packed), "<i4")))


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """Add the ids of every text as an array of ints; null texts encode as empty arrays.

    Rows are treated one by one: repeated rows and nulls elsewhere change nothing, an existing
    column ``ids`` is replaced, an empty table stays empty.  No shuffle.
    """
    path = _ranks(path)

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        own = coder(path)
        return _id_lists([own.encode(t.as_py() or "") for t in texts])

    return df.withColumn(ids, run(F.col(text)))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Add the bytes that the ids stand for as a binary column; a null array decodes to empty bytes."""
    path = _ranks(path)

    @F.arrow_udf("binary")
    def run(arrays: pa.Array) -> pa.Array:
        own = coder(path)
        packed = (a.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes() if a.is_valid else b"" for a in arrays)
        return pa.array([own.decode(x) for x in packed], pa.binary())

    return df.withColumn(out, run(F.col(ids)))


def round_trip(df: DataFrame, text: str = "text", ids: str | None = None, path: str | None = None) -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: every text encoded, then decoded.

    Ids are hashed as little-endian unsigned 32-bit integers, and are added too if ``ids`` names a
    column.  Both passes run in one task, so texts are encoded once and nothing is shuffled.  Nulls
    and clashes as in ``encode``.
    """
    path = _ranks(path)
    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({ids: "array<int>"} if ids else {})
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in kinds])

    def run(batches):
        own = coder(path)
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                texts = (t.as_py() or "" for t in part.column(part.schema.get_field_index(text)))
                packed = [own.encode(t) for t in texts]
                made = [
                    pa.array([len(x) // 4 for x in packed], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in packed]),
                    pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in packed]),
                ]
                if ids:
                    made.append(_id_lists(packed))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *kinds])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"`{k}` {v}" for k, v in kinds.items()]
    return kept.mapInArrow(run, ", ".join(fields))
