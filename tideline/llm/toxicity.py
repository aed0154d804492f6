"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Every word enters as a word vector (by hash) joined with the mean of its character 3- to 5-gram
vectors (by hash), so unseen forms of known stems are recognised.  A text is cut into windows that
overlap by half; each window is read in both directions, its states are pooled by attention, and
the text's score is that of its highest window.  Training follows the same rule: of each sample
text, the window that scores highest learns the text's label.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import sample_keys, stored, words
from tideline.llm.quality import bind

#: Words per window and between the starts of windows.
WINDOW, STRIDE = 32, 16
#: Hash rows of word and character vectors, their sizes, and units per direction.
WORDS, GRAMS, WIDTH, UNITS = 1 << 13, 1 << 14, 12, 8
GRAM_SIZES = (3, 4, 5)
#: Training sample: texts per label, and words of a text from which on windows are drawn of it.
SAMPLE, SAMPLE_WORDS = 1500, 600
#: Updates, texts per update, learning rate and seed.
UPDATES, BATCH, RATE, SEED = 560, 32, 0.01, 7
#: Windows per step, and words a worker remembers.
STEP, REMEMBER = 4096, 200_000
TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


@dataclass
class Words:
    """Features of distinct words: a word row each, and their character-gram rows end to end."""

    word: np.ndarray
    grams: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Words:
        """Grams run over each whole word with a mark at either end, however long it is."""
        marked = "".join(f"<{w}>" for w in words)
        codes = np.frombuffer(marked.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(words)), sizes)
        left = ends[owner] - np.arange(len(codes))  # characters up to the word's end
        found, owners, rolling = [], [], np.zeros(len(codes), dtype=np.uint64)
        for k in range(1, max(GRAM_SIZES) + 1):
            n = max(0, len(codes) - k + 1)
            rolling[:n] = _mix(rolling[:n] + codes[k - 1 :] + np.uint64(k))
            if k in GRAM_SIZES:
                at = np.flatnonzero(left >= k)
                found.append((rolling[at] % np.uint64(GRAMS)).astype(np.int64))
                owners.append(owner[at])
        owners, found = np.concatenate(owners), np.concatenate(found)
        order = np.argsort(owners, kind="stable")
        whole = np.zeros(len(words), dtype=np.uint64)
        place = np.arange(len(codes)) - (ends - sizes)[owner]
        np.add.at(whole, owner, _mix(codes * np.uint64(0x100000001B3) + place.astype(np.uint64)))
        counts = np.bincount(owners, minlength=len(words))
        return cls((_mix(whole) % np.uint64(WORDS)).astype(np.int64), found[order], np.cumsum(counts) - counts)

    def counts(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.grams)))

    def part(self, low: int, high: int) -> Words:
        ends = np.append(self.starts, len(self.grams))
        return Words(self.word[low:high], self.grams[ends[low] : ends[min(high, len(self.starts))]], self.starts[low:high] - ends[low])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights by name; inputs are ``2 * WIDTH`` wide, gates are update, reset and candidate."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        def small(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        w = {
            "word": (rng.standard_normal((WORDS, WIDTH)) * 0.3).astype(np.float32),
            "gram": (rng.standard_normal((GRAMS, WIDTH)) * 0.3).astype(np.float32),
            "look": small(2 * UNITS, 2 * UNITS), "ask": small(2 * UNITS),
            "out": small(2 * UNITS), "bias": np.full(1, -1.0, dtype=np.float32),
        }
        for side in "fb":
            w |= {f"in_{side}": small(2 * WIDTH, 3 * UNITS), f"b_{side}": np.zeros(3 * UNITS, np.float32), f"u_{side}": small(UNITS, 3 * UNITS)}
        return cls(w)

    def inputs(self, words: Words) -> np.ndarray:
        sums = np.add.reduceat(self.w["gram"][words.grams], words.starts, axis=0) if len(words.grams) else 0
        return np.concatenate([self.w["word"][words.word], sums / words.counts()[:, None]], axis=1, dtype=np.float32)

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(x @ self.w[f"in_{s}"] + self.w[f"b_{s}"] for s in "fb")

    def word_gates(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Gate inputs of all words, some thousand at a time."""
        known = tuple(np.empty((len(words.word), 3 * UNITS), np.float32) for _ in "fb")
        for low in range(0, len(words.word), STEP):
            for whole, made in zip(known, self.gates(self.inputs(words.part(low, low + STEP))), strict=True):
                whole[low : low + STEP] = made
        return known

    def window_logits(self, known: tuple, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, first word and logit of every window of texts, given as word numbers end to end."""
        owner, first = windows(sizes)
        out, begins = np.zeros(len(owner), np.float32), np.cumsum(sizes) - sizes
        for i in range(0, len(owner), STEP):
            ids, mask = laid_out(flat, begins, sizes, owner[i : i + STEP], first[i : i + STEP])
            out[i : i + STEP] = self.logits(known[0][ids], known[1][ids], mask)
        return owner, first, out

    def run(self, gates: np.ndarray, mask: np.ndarray, side: str, trace: list | None = None) -> np.ndarray:
        """States ``(time, windows, UNITS)`` of one direction; masked steps keep the state."""
        u, n = self.w[f"u_{side}"], gates.shape[0]
        h, out = np.zeros((gates.shape[1], UNITS), np.float32), np.zeros((*gates.shape[:2], UNITS), np.float32)
        for t in range(n) if side == "f" else range(n - 1, -1, -1):
            zr = _sigmoid(gates[t, :, : 2 * UNITS] + h @ u[:, : 2 * UNITS])
            z, r = zr[:, :UNITS], zr[:, UNITS:]
            c = np.tanh(gates[t, :, 2 * UNITS :] + (r * h) @ u[:, 2 * UNITS :])
            new = h + mask[t] * z * (c - h)
            if trace is not None:
                trace.append((t, h, z, r, c))
            out[t] = h = new
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple:
        seen = np.tanh(states @ self.w["look"])
        score = seen @ self.w["ask"] - 1e9 * (1 - mask[:, :, 0])
        share = np.exp(score - score.max(axis=0))
        share /= share.sum(axis=0)
        pooled = (share[:, :, None] * states).sum(axis=0)
        return pooled @ self.w["out"] + self.w["bias"], pooled, share, seen

    def logits(self, forward: np.ndarray, backward: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states = np.concatenate([self.run(forward, mask, "f"), self.run(backward, mask, "b")], axis=2)
        return self.pool(states, mask)[0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weighted mean cross-entropy, and of the inputs ``x`` (time, windows, width)."""
        w, g = self.w, {}
        gates = dict(zip("fb", self.gates(x), strict=True))
        traces = {"f": [], "b": []}
        states = np.concatenate([self.run(gates[s], mask, s, traces[s]) for s in "fb"], axis=2)
        logit, pooled, share, seen = self.pool(states, mask)
        d = (weights * (_sigmoid(logit) - labels) / len(labels)).astype(np.float32)
        g["bias"], g["out"] = d.sum(keepdims=True), pooled.T @ d
        d_pooled = d[:, None] * w["out"]
        d_share = (states * d_pooled).sum(axis=2)
        d_score = share * (d_share - (share * d_share).sum(axis=0))
        g["ask"] = np.einsum("tn,tnk->k", d_score, seen)
        d_seen = d_score[:, :, None] * w["ask"] * (1 - seen**2)
        g["look"] = np.einsum("tnj,tnk->jk", states, d_seen)
        d_states = share[:, :, None] * d_pooled + d_seen @ w["look"].T
        d_x = np.zeros_like(x)
        for k, s in enumerate("fb"):
            u, d_u = w[f"u_{s}"], np.zeros_like(w[f"u_{s}"])
            d_gates, d_h = np.zeros_like(gates[s]), np.zeros((x.shape[1], UNITS), np.float32)
            for t, h, z, r, c in reversed(traces[s]):
                d_h = d_h + d_states[t, :, k * UNITS : (k + 1) * UNITS]
                on = mask[t] * d_h
                d_c = on * z * (1 - c**2)
                d_z = on * (c - h) * z * (1 - z)
                d_rh = d_c @ u[:, 2 * UNITS :].T
                d_r = d_rh * h * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], axis=1)
                d_gates[t] = np.concatenate([d_zr, d_c], axis=1)
                d_u[:, : 2 * UNITS] += h.T @ d_zr
                d_u[:, 2 * UNITS :] += (r * h).T @ d_c
                d_h = d_h - on * z + d_rh * r + d_zr @ u[:, : 2 * UNITS].T
            g[f"u_{s}"], g[f"b_{s}"] = d_u, d_gates.sum(axis=(0, 1))
            g[f"in_{s}"] = np.einsum("tni,tnk->ik", x, d_gates)
            d_x += d_gates @ w[f"in_{s}"].T
        return g, d_x


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and first word of every window; together they cover all words of every text."""
    each = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(sizes)), each)
    return owner, (np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)) * STRIDE


def laid_out(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, owner: np.ndarray, first: np.ndarray) -> tuple:
    """Word numbers ``(time, windows)`` of windows and the mask of those inside the text."""
    at = first + np.arange(WINDOW)[:, None]
    inside = at < sizes[owner]
    return flat[np.where(inside, begins[owner] + at, 0)], inside[:, :, None].astype(np.float32)


class Scorer:
    """A network with the gate inputs of words it has met."""

    def __init__(self, network: Network):
        self.network, self.index, self.known = network, {}, None

    def look_up(self, texts: list[list[str]]) -> np.ndarray:
        seen = set(chain.from_iterable(texts))
        fresh = list(seen - self.index.keys())
        if self.index and len(self.index) + len(fresh) > REMEMBER:
            self.index, self.known, fresh = {}, None, list(seen)
        if fresh:
            self.index |= {w: len(self.index) + k for k, w in enumerate(fresh)}
            made = self.network.word_gates(Words.of(fresh))
            self.known = made if self.known is None else tuple(map(np.concatenate, zip(self.known, made, strict=True)))
        return np.fromiter(map(self.index.__getitem__, chain.from_iterable(texts)), dtype=np.int64)

    def window_logits(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, first word and logit of every window."""
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        if not sizes.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        flat = self.look_up(texts)
        return self.network.window_logits(self.known, flat, sizes)

    def scores(self, values: list[str | None]) -> np.ndarray:
        out, held, size, done = np.zeros(len(values)), [], 0, 0
        for k, value in enumerate(values):
            held.append(tokens(value))
            size += len(held[-1])
            if size >= STEP * STRIDE or k == len(values) - 1:
                owner, _, logit = self.window_logits(held)
                best = np.full(len(held), -np.inf)
                np.maximum.at(best, owner, logit)
                with np.errstate(over="ignore"):
                    out[done : k + 1] = _sigmoid(best)
                held, size, done = [], 0, k + 1
        return out


@dataclass
class Sample:
    """Training texts as numbers: the label of each text, the text and size of each of its parts, the
    words of all parts end to end, and the features of the distinct words."""

    labels: np.ndarray
    text_of: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray
    words: Words


def fit(sample: Sample) -> Network:
    """Adam on the highest window of each text; both labels weigh the same in total."""
    rng = np.random.default_rng(SEED)
    network = Network.fresh(rng)
    labels, words = sample.labels, sample.words
    usable = np.unique(sample.text_of[sample.sizes > 0])
    if not len(usable) or len(set(labels[usable])) < 2:
        return network
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.w.items()}
    counts = words.counts()
    ids = np.split(sample.ids, np.cumsum(sample.sizes)[:-1])
    share = labels[usable].mean()
    weights = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    step = 0
    while step < UPDATES:
        holder, first, logit = network.window_logits(network.word_gates(words), sample.ids, sample.sizes)
        owner = sample.text_of[holder]
        order = np.lexsort((-logit, owner))
        top = order[np.unique(owner[order], return_index=True)[1]]
        chosen = dict(zip(owner[top].tolist(), zip(holder[top].tolist(), first[top].tolist(), strict=True), strict=True))
        for own in np.array_split(rng.permutation(usable), max(1, len(usable) // BATCH)):
            read, starts = zip(*[chosen[i] for i in own], strict=True)
            sizes = np.array([len(ids[p]) for p in read])
            flat, begins = np.concatenate([ids[p] for p in read]), np.cumsum(sizes) - sizes
            at, mask = laid_out(flat, begins, sizes, np.arange(len(own)), np.array(starts))
            used, back = np.unique(at, return_inverse=True)
            part = [words.grams[words.starts[i] : words.starts[i] + counts[i]] for i in used]
            sub = Words(words.word[used], np.concatenate(part), np.cumsum(counts[used]) - counts[used])
            x = network.inputs(sub)[back.reshape(at.shape)]
            grads, d_x = network.gradients(x, mask, labels[own], weights[own])
            d_in = np.zeros((len(used), 2 * WIDTH), np.float32)
            np.add.at(d_in, back.ravel(), (d_x * mask).reshape(-1, 2 * WIDTH))
            d_gram = np.repeat(d_in[:, WIDTH:] / counts[used][:, None], counts[used], axis=0)
            step += 1
            updates = {k: (slice(None), v) for k, v in grads.items()}
            for name, rows, d in (("word", sub.word, d_in[:, :WIDTH]), ("gram", sub.grams, d_gram)):
                hit, place = np.unique(rows, return_inverse=True)
                total = np.zeros((len(hit), WIDTH), np.float32)
                np.add.at(total, place, d)
                updates[name] = hit, total
            for name, (rows, d) in updates.items():
                m, v = moments[name]
                m[rows] = 0.9 * m[rows] + 0.1 * d
                v[rows] = 0.999 * v[rows] + 0.001 * d**2
                rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                network.w[name][rows] -= rate * m[rows] / (np.sqrt(v[rows]) + 1e-8)
    return network


def parts(text: Column, key: Column) -> Column:
    """The text, or of one over ``SAMPLE_WORDS`` words as many windows as one of that size has,
    drawn by a hash of key and place among those that cover the text."""

    def drawn(w: Column) -> Column:
        last = F.ceil((F.size(w) - WINDOW) / STRIDE).cast("int")
        places = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.xxhash64(key, k).alias("h"), k.alias("k")))
        few = F.slice(F.array_sort(places), 1, SAMPLE_WORDS // STRIDE)
        return F.transform(few, lambda x: F.array_join(F.slice(w, x["k"] * STRIDE + 1, WINDOW), " "))

    return F.when(_size(text) <= SAMPLE_WORDS, F.array(text)).otherwise(bind(words(text), drawn))


def _size(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))


def numbered(rows: DataFrame) -> Sample:
    """``key, label, parts`` as a ``Sample``.  Texts are split and hashed in tasks; the driver gets numbers
    only, a hash per word and the features of each distinct word."""

    @F.pandas_udf("array<array<string>>")
    def split_parts(texts: pd.Series) -> pd.Series:
        return pd.Series([[tokens(part) for part in t] for t in texts])

    @F.pandas_udf("word int, grams array<int>")
    def word_features(words: pd.Series) -> pd.DataFrame:
        made = Words.of(list(words))
        grams = np.split(made.grams.astype(np.int32), made.starts[1:]) if len(words) else []
        return pd.DataFrame({"word": made.word.astype(np.int32), "grams": grams})

    split = stored(rows.select("key", "label", split_parts("parts").alias("parts")), "parts")
    listed = split.select(F.explode(F.flatten("parts")).alias("word")).distinct()
    known = listed.select(F.xxhash64("word").alias("code"), word_features("word").alias("f")).select("code", "f.*").toArrow()
    codes = known.column("code").to_numpy()
    order = np.argsort(codes, kind="stable")
    grams = known.column("grams").combine_chunks()
    sizes, flat = grams.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), grams.flatten().to_numpy()
    begins = np.cumsum(sizes) - sizes
    words = Words(
        known.column("word").to_numpy()[order].astype(np.int64),
        np.concatenate([flat[begins[i] : begins[i] + sizes[i]] for i in order] or [flat]),
        np.cumsum(sizes[order]) - sizes[order],
    )
    hashed = F.transform("parts", lambda part: F.transform(part, lambda w: F.xxhash64(w)))
    texts = split.select("key", "label", hashed.alias("parts")).toArrow().sort_by([("key", "ascending"), ("label", "ascending")])
    held = texts.column("parts").combine_chunks()
    each = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    inner = held.flatten()
    return Sample(
        texts.column("label").to_numpy().astype(np.float32),
        np.repeat(np.arange(len(each)), each),
        inner.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64),
        np.searchsorted(codes[order], inner.flatten().to_numpy()),
        words,
    )


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Network:
    """Fit on at most ``SAMPLE`` texts per label 0 and 1, chosen by a hash of the key among those of
    any length; of long ones, windows are drawn.  Null keys, labels and texts teach nothing."""
    marks = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).distinct()
    named = df.where(_size(F.col(text)) > 0).select(F.col(key).alias("key"), F.col(text).alias("text"))
    marked = stored(named.select("key").join(marks, "key"), "marked")
    drawn = sample_keys(marked, "label", "key", SAMPLE)
    cut = named.join(drawn, "key").select("label", "key", parts(F.col("text"), F.col("key")).alias("parts"))
    return fit(numbered(cut.groupBy("label", "key").agg(F.min("parts").alias("parts"))))


def score(df: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) to every row.

    Null texts and texts without a word have no window and score 0.  Rows are scored one by one,
    whole and without a shuffle; existing columns of these names are replaced.
    """
    share = df.sparkSession.sparkContext.broadcast(network.w)
    own: list[Scorer] = []

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        if not own:
            own.append(Scorer(Network(share.value)))
        return pd.Series(own[0].scores(list(texts)))

    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("score", "predicted")]
    return df.select(*kept, run(F.col(text)).alias("score")).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
