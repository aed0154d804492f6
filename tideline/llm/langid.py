"""Language identification by unigrams of pieces, summed over all segmentations.

Each language gives every piece of a fixed public vocabulary a probability.  A word's chance in a
language is the sum, over all its segmentations into pieces, of the products of their
probabilities; the forward algorithm works it out for all languages and all distinct new words of
a batch at once.  Probabilities come from expectation maximisation over a bounded sample of
labelled texts; every text is then scored whole.
"""

from __future__ import annotations

import re
from itertools import chain, groupby

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import sample_keys

VOCABULARY = "piece_bpe_32k.model"
START = "▁"
#: Training sample: texts per language, and characters of the longest text that is taken.
SAMPLE, SAMPLE_CHARS = 400, 8_000
ROUNDS, SMOOTH = 3, 0.05
#: Chance of a character that no piece covers.
UNKNOWN = 1e-7
#: Words scored per step and words a worker remembers.
STEP, REMEMBER = 200_000, 300_000
LETTERS = re.compile(r"[^\W\d_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def letter_runs(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


class Pieces:
    """The vocabulary as sorted polynomial hashes, so that substrings are looked up in bulk."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        texts = sorted({model.id_to_piece(i) for i in plain})
        hashes = [self.prefixes(np.array([[ord(c) for c in t]], dtype=np.uint64))[0, -1] for t in texts]
        self.hashes = np.sort(np.array(hashes, dtype=np.uint64))
        self.longest = max(map(len, texts))
        self.power = np.cumprod(np.full(self.longest + 1, BASE, dtype=np.uint64)) // np.uint64(1)
        self.power = np.concatenate([np.ones(1, dtype=np.uint64), self.power[:-1]])

    @staticmethod
    def prefixes(codes: np.ndarray) -> np.ndarray:
        """Hashes of all prefixes of each row of code points."""
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
        for i in range(codes.shape[1]):
            out[:, i + 1] = out[:, i] * BASE + codes[:, i] + np.uint64(1)
        return out

    def find(self, prefixes: np.ndarray, start: int, end: int) -> np.ndarray:
        """Piece numbers of ``[start, end)`` of each row; the number past the last where there is none."""
        wanted = prefixes[:, end] - prefixes[:, start] * self.power[end - start]
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return np.where(self.hashes[at] == wanted, at, len(self.hashes))


class Model:
    """``chances``: a row per piece and a last row of zeros, a column per language."""

    def __init__(self, pieces: Pieces, langs: list[str], chances: np.ndarray):
        self.pieces, self.langs, self.chances = pieces, langs, chances
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(langs)))

    def forward(self, prefixes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, dict]:
        """Sums over segmentations of every prefix, log of the scale they are held in, pieces found."""
        rows, n = prefixes.shape[0], prefixes.shape[1] - 1
        sums, scale, found = [np.ones((rows, len(self.langs)))], np.zeros((rows, 1)), {}
        for end in range(1, n + 1):
            total = np.zeros_like(sums[0])
            for start in range(max(0, end - self.pieces.longest), end):
                piece = self.pieces.find(prefixes, start, end)
                hit = np.flatnonzero(piece < len(self.pieces.hashes))
                if end - start == 1:
                    total += sums[start] * np.where(piece < len(self.pieces.hashes), 0.0, UNKNOWN)[:, None]
                if len(hit):
                    found[start, end] = hit, piece[hit]
                    total[hit] += sums[start][hit] * self.chances[piece[hit]]
            sums.append(total)
            if end % 32 == 0:
                top = total.max(axis=1, keepdims=True)
                scale += np.log(top)
                for back in range(max(0, end - self.pieces.longest), end + 1):
                    sums[back] = sums[back] / top
        return sums, scale, found

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log chance of each word in each language; words without a letter score 0 everywhere."""
        out = np.zeros((len(words), len(self.langs)))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for size, own in groupby(order, key=lambda i: len(words[i])):
            own = list(own)
            sums, scale, _ = self.forward(encoded([words[i] for i in own], size))
            out[own] = np.log(sums[-1]) + scale
        mute = [i for i, w in enumerate(words) if not any(map(str.isalpha, w))]
        out[mute] = 0.0
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        named, scored, held, size = [], [], [], 0
        for text in texts:
            held.append(letter_runs(text))
            size += len(held[-1])
            if size >= STEP:
                self._predict(held, named, scored)
                held, size = [], 0
        self._predict(held, named, scored)
        return named, scored

    def _predict(self, held: list[list[str]], named: list[str], scored: list[float]) -> None:
        seen = set(chain.from_iterable(held))
        fresh = list(seen - self.index.keys())
        if len(self.index) + len(fresh) > REMEMBER and self.index:
            self.index, self.scores, fresh = {}, self.scores[:0], list(seen)
        if fresh:
            self.index |= {w: len(self.index) + k for k, w in enumerate(fresh)}
            self.scores = np.concatenate([self.scores, self.word_scores(fresh)])
        for words in held:
            if not any(any(map(str.isalpha, w)) for w in words):
                named.append("und")
                scored.append(0.0)
                continue
            total = self.scores[np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
            best = int(total.argmax())
            named.append(self.langs[best])
            scored.append(float(1 / np.exp(total - total[best]).sum()))


def encoded(words: list[str], size: int) -> np.ndarray:
    """Prefix hashes of words of one size, each after the mark of a word's start."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), size)
    return Pieces.prefixes(np.concatenate([np.full((len(words), 1), ord(START)), codes], axis=1).astype(np.uint64))


def fit(pieces: Pieces, langs: list[str], counts: dict[str, np.ndarray]) -> Model:
    """Expectation maximisation from word counts, an array of one count per language for each word."""
    v = len(pieces.hashes)
    chances = np.full((v + 1, len(langs)), 1.0 / v)
    chances[v] = 0.0
    words = sorted(counts, key=lambda w: (len(w), w))
    for _ in range(ROUNDS):
        model, expected = Model(pieces, langs, chances), np.zeros_like(chances)
        for size, own in groupby(words, key=len):
            own = list(own)
            for part in (own[i : i + 20_000] for i in range(0, len(own), 20_000)):
                if size > 31:
                    continue  # such words add to no probability worth having, and sums stay in range
                weight = np.array([counts[w] for w in part])
                prefixes = encoded(part, size)
                sums, _, found = model.forward(prefixes)
                n = size + 1
                back = [np.zeros_like(weight, dtype=float) for _ in range(n)] + [weight / sums[n]]
                for start in range(n - 1, -1, -1):
                    lone = np.full((len(part), 1), UNKNOWN)
                    for end in range(start + 1, min(n, start + pieces.longest) + 1):
                        if (start, end) in found:
                            hit, piece = found[start, end]
                            share = chances[piece] * back[end][hit]
                            back[start][hit] += share
                            np.add.at(expected, piece, share * sums[start][hit])
                            if end == start + 1:
                                lone[hit] = 0.0
                    back[start] += lone * back[start + 1]
        chances = expected + SMOOTH
        chances[v] = 0.0
        chances /= chances.sum(axis=0)
    return Model(pieces, langs, chances)


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", path: str | None = None) -> Model:
    """Fit on at most ``SAMPLE`` texts per non-null language, chosen by a hash of the key, among
    those of at most ``SAMPLE_CHARS`` characters.  Only their word counts reach the driver."""
    rows = df.where(F.length(text) <= SAMPLE_CHARS).select(
        F.col(lang).alias("lang"), F.col(key).alias("key"), F.col(text).alias("text")
    )
    drawn = sample_keys(rows, "lang", "key", SAMPLE)
    chosen = rows.join(drawn, ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text"))
    words = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(\\p{L}+)"))).alias("w"))
    counted = words.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")).toPandas()
    langs = sorted(counted["lang"].unique())
    place = {name: k for k, name in enumerate(langs)}
    counts: dict[str, np.ndarray] = {}
    for name, w, n in counted.itertuples(index=False):
        counts.setdefault(w, np.zeros(len(langs)))[place[name]] = n
    return fit(Pieces(path or public_tokenizers.path(VOCABULARY)), langs, counts)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``, the chance of that language given the text.

    ``und`` with score 0 for null texts, texts without a letter, and where no language was learned.
    Of equally likely languages the first by name wins.  Rows are scored one by one, whole and
    without a shuffle; existing columns of these names are replaced.
    """
    share = df.sparkSession.sparkContext.broadcast((model.pieces, model.langs, model.chances))
    own: list[Model] = []

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        if not own:
            own.append(Model(*share.value))
        if not own[0].langs:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0})
        named, scored = own[0].predict(list(texts))
        return pd.DataFrame({"lang_pred": named, "score": scored})

    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("lang_pred", "score")]
    return df.select(*kept, run(F.col(text)).alias("__p")).select(*kept, "__p.lang_pred", "__p.score")
