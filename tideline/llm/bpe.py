"""Byte-pair merges as a set of tokens with their halves, and the test whether two tokens may be adjacent.

A byte string has one encoding.  A sequence of tokens is that encoding exactly when every two
neighbours are *compatible*: encoding their joined bytes gives these two tokens again.  So an
encoder need not replay merges; it may look for the one compatible path through the tokens that
match (published with linear-time BPE encoders).
"""

from __future__ import annotations

import base64
import json
import re
from functools import cached_property

import ahocorasick

from tideline.llm.common import Memo

#: White space of Unicode; fixed values.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Of a memo's generation, per Python worker: entries of pairs, bytes of chunks and of pieces.
PAIRS, CHUNKS, PIECES = 500_000, 48 << 20, 32 << 20


class Tokens:
    """Tokens by rank; the first 256 ranks are single bytes, each later one joins two earlier ones."""

    def __init__(self, texts: list[bytes], halves: list[tuple[int, int]]):
        self.texts, self.halves = texts, halves
        self.joined = {pair: rank for rank, pair in enumerate(halves) if pair[0] >= 0}
        self.by_text = {text.decode("latin-1"): rank for rank, text in enumerate(texts)}
        self.sizes = [len(text) for text in texts]
        self.fits = Memo(self._fits, PAIRS)
        self.shorter = Memo(self._shorter, len(texts))

    @cached_property
    def automaton(self):
        """Finds the tokens in bytes that are written as Latin-1 text."""
        found = ahocorasick.Automaton()
        for text, rank in self.by_text.items():
            found.add_word(text, rank)
        found.make_automaton()
        return found

    @classmethod
    def from_ranks(cls, path: str) -> Tokens:
        """From a file of base64 text and rank per line; halves follow from the lower ranks."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        texts = sorted(ranks, key=ranks.get)
        if [ranks[t] for t in texts] != list(range(len(texts))):
            raise ValueError("ranks have gaps")
        halves = [(-1, -1) if len(t) == 1 else cls._split(t, ranks) for t in texts]
        return cls(texts, halves)

    @classmethod
    def from_merges(cls, path: str) -> tuple[Tokens, list[str]]:
        """From a tokenizer file with merges, whose bytes are written as printable characters;
        also the strings of its special tokens."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain}
        rest = (b for b in range(256) if b not in set(plain))
        byte_of |= {chr(256 + k): b for k, b in enumerate(rest)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        texts = [bytes([b]) for b in range(256)]
        halves = [(-1, -1)] * 256
        rank_of = {text: rank for rank, text in enumerate(texts)}
        for pair in pairs:
            left, right = (bytes(byte_of[c] for c in side) for side in pair)
            rank_of[left + right] = len(texts)
            halves.append((rank_of[left], rank_of[right]))
            texts.append(left + right)
        return cls(texts, halves), [t["content"] for t in spec["added_tokens"]]

    @staticmethod
    def _split(text: bytes, ranks: dict[bytes, int]) -> tuple[int, int]:
        """The two tokens whose merge gives ``text``: merge its bytes until two parts are left."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 40))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Undo the merges of both sides from the latest to the earliest; the pair is compatible
        unless at some point the two parts that touch would have been merged first."""
        left, right = pair
        bound = 1 << 40
        while True:
            merged = self.joined.get((left, right))
            if merged is not None and merged < bound:
                return False
            inner, outer = self.halves[left][1], self.halves[right][0]
            if inner >= 0 and (left > right or outer < 0):
                bound, left = left, inner
            elif outer >= 0:
                bound, right = right + 1, outer
            else:
                return True

    def _shorter(self, rank: int) -> int:
        """The longest token that is a proper prefix of this one; -1 if there is none."""
        text = self.texts[rank].decode("latin-1")
        return next((r for n in range(len(text) - 1, 0, -1) if (r := self.by_text.get(text[:n])) is not None), -1)


def chunker():
    """Matches runs between white space.  Pieces of the split pattern never cross their ends: one
    white-space character goes with the text after it, the rest of a run stands alone."""
    return re.compile(f"[{SPACE}]+(?![^{SPACE}])|[{SPACE}]?[^{SPACE}]+")
