"""Exact token counts at every prefix of a text, by dynamic programming over its bytes.

For each prefix the last token of its encoding is unique: of the tokens that end there, the one
compatible with the last token of the prefix before it.  Its count is one more than the count of
that prefix.  Texts are cut into chunks that encode independently; each distinct chunk is worked
out once while the worker remembers it, and the chunk that a question falls into keeps a count per
prefix, so questions about truncation and budgets are look-ups.  Work per text is linear; memory is
bounded by the bytes of two generations of the memo and one text.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import cached_property, lru_cache
from itertools import accumulate

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.bpe import CHUNKS, PIECES, Tokens, chunker
from tideline.llm.common import TextMemo

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512


class PrefixCounter:
    """Counts tokens as the tokenizer in ``path`` does, without adding special tokens; strings of
    special tokens inside a text count as one token each, which is that library's default."""

    def __init__(self, path: str):
        self.tokens, special = Tokens.from_merges(path)
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.chunks = chunker()
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.piece = TextMemo(self._piece, PIECES)
        self.total = TextMemo(self._total, CHUNKS)

    def _total(self, chunk: str) -> int:
        return sum(map(self.piece.__getitem__, self.split.findall(chunk)))

    def _piece(self, piece: str) -> int:
        return self._by_byte(piece.encode().decode("latin-1"))[-1]

    def prefixes(self, text: str) -> list[int]:
        """Token counts of the prefixes of a text without special strings, one per character, after
        0 for the empty one."""
        counts, before = [0], ""
        for chunk in self.chunks.findall(text):
            first = len(counts)
            for piece in self.split.findall(chunk):
                base = counts[-1]
                counts += [base + n for n in self._within(piece)]
            if before.isspace() and chunk[0].isspace():  # cut there, both are one run of white space
                counts[first] = counts[first - 1 - len(before)] + self.total[before + chunk[0]]
            before = chunk
        return counts

    def _within(self, piece: str) -> list[int]:
        """Token counts of the prefixes of one match of the split pattern, one per character."""
        coded = piece.encode()
        counts = self._by_byte(coded.decode("latin-1"))
        if len(coded) > len(piece):
            counts = [counts[i] for i in range(1, len(coded) + 1) if i == len(coded) or coded[i] & 0xC0 != 0x80]
        else:
            del counts[0]
        if len(piece) == 3 and piece[0] == "'" and piece[1].isalpha():
            counts[1] = 2  # cut inside, "'re" is no contraction but a quote and a letter
        return counts

    def _by_byte(self, piece: str) -> list[int]:
        sizes, fits = self.tokens.sizes, self.tokens.fits
        last, counts = [-1] * (len(piece) + 1), [0] * (len(piece) + 1)
        for end, token in self.tokens.automaton.iter(piece):
            start, end = end + 1 - sizes[token], end + 1
            if last[end] < 0 and (start == 0 or fits[last[start], token]):
                last[end], counts[end] = token, counts[start] + 1
        return counts

    def parts(self, text: str) -> tuple[list[str], list[int]]:
        """The chunks and special strings of a text in order, which leave out nothing, and the numbers
        of tokens in each; special strings are marked by 0 tokens, but count as one."""
        if self.special is None or not self.special.search(text):
            chunks = self.chunks.findall(text)
            return chunks, list(map(self.total.__getitem__, chunks))
        parts, sizes, at = [], [], 0
        for m in self.special.finditer(text):
            chunks = self.chunks.findall(text[at : m.start()])
            parts += [*chunks, m[0]]
            sizes += [*map(self.total.__getitem__, chunks), 0]
            at = m.end()
        chunks = self.chunks.findall(text[at:])
        return parts + chunks, sizes + list(map(self.total.__getitem__, chunks))

    def count(self, text: str) -> int:
        return self.table(text).total

    def measure(self, text: str, limit: int) -> tuple[int, int]:
        """Tokens of a text, and characters of its longest prefix of at most ``limit`` tokens; one pass."""
        table = self.table(text)
        return table.total, table.fit(limit)

    def table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)


class PrefixTable:
    """Counts at every prefix of one text, held as a running total per chunk; the prefix counts of
    the chunk asked about are worked out once and kept until another chunk is asked about."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        self.parts, self.sizes = counter.parts(text)
        self.before = [0, *accumulate(n or 1 for n in self.sizes)]
        self.span, self.counts = (0, 0), [0]

    @cached_property
    def starts(self) -> list[int]:
        return [0, *accumulate(map(len, self.parts))]

    @property
    def total(self) -> int:
        return self.before[-1]

    def _within(self, start: int, stop: int, chars: int) -> int:
        """Tokens of ``text[start:chars]``, read as text without special strings."""
        if self.span != (start, stop):
            self.span, self.counts = (start, stop), self.counter.prefixes(self.text[start:stop])
        return self.counts[chars - start]

    def at(self, chars: int) -> int:
        """Tokens of ``text[:chars]``."""
        if chars <= 0:
            return 0
        if chars >= len(self.text):
            return self.total
        k = bisect_right(self.starts, chars - 1) - 1
        chunk, start, stop = self.parts[k], self.starts[k], self.starts[k + 1]
        after_text = k > 0 and self.sizes[k - 1] > 0
        if not self.sizes[k]:
            if chars == stop:
                return self.before[k + 1]
            if after_text:  # a cut special string is text and joins what stands before
                k -= 1
                start = self.starts[k]
            return self.before[k] + self._within(start, stop, chars)
        if chars == start + 1 and after_text and chunk[0].isspace() and self.parts[k - 1].isspace():
            return self.before[k - 1] + self.counter.total[self.parts[k - 1] + chunk[0]]  # one run of white space
        return self.before[k] + self._within(start, stop, chars)

    def fit(self, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        if self.total <= budget:
            return len(self.text)
        k = bisect_right(self.before, budget) - 1
        # A longer prefix can have fewer tokens, but only inside a chunk and the special string after it.
        stop = self.starts[min(len(self.parts), k + 2)]
        return next((p for p in range(stop, self.starts[k], -1) if self.at(p) <= budget), self.starts[k])


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(df: DataFrame, limit: int = LIMIT, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens``, ``over_limit`` and ``fit_chars`` to every row.

    ``fit_chars`` is the length of the longest prefix of at most ``limit`` tokens.  Null texts count
    as empty (0 tokens, not over); rows are treated one by one, so repeated rows and nulls elsewhere
    change nothing; existing columns of these names are replaced.  No shuffle.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf("n_tokens long, fit_chars long")
    def measure(texts: pd.Series) -> pd.DataFrame:
        own = counter(path)
        rows = [own.measure(value or "", limit) for value in texts]
        return pd.DataFrame(rows, columns=["n_tokens", "fit_chars"])

    made = ["n_bytes", "n_tokens", "over_limit", "fit_chars"]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in made]
    counted = df.select(
        *kept,
        F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"),
        measure(F.col(text)).alias("__m"),
    )
    over = F.col("__m.n_tokens") > limit
    return counted.select(*kept, "n_bytes", F.col("__m.n_tokens"), over.alias("over_limit"), F.col("__m.fit_chars"))
