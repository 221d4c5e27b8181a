"""Interpolated Kneser-Ney character models in sorted hash arrays.

Counts come from the whole training input: workers reduce texts to distinct
words, words to distinct n-grams, and only n-gram counts are shuffled.  The
model holds, per order, one sorted array of hashed n-grams with a row of log
probabilities (one column per group, e.g. language) and one of hashed contexts
with back-off weights.  Keys are whole 64-bit hashes, so the arrays grow with
the distinct n-grams of the corpus and hold each of them.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget_models, mix64, release_memory

ORDER = 5
#: Symbols that are hashed at a time.
SLICE = 100_000
END = 1
#: Odd multipliers of the symbols at distance 0, 1, .. from the predicted one.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


@cache
def letter_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def predictions(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (n, ORDER), predicted one first, then its context backwards; token of each row.

    A token's runs of letters are words; context does not reach over a word's
    start (symbol 0), and a word's end is predicted as symbol END.
    """
    raw = code_points("\n".join(tokens) + "\n")
    letter = letter_table()[raw]
    padded = np.concatenate([np.zeros(ORDER, np.uint32), np.where(letter, raw, 0).astype(np.uint32)])
    at = np.flatnonzero((padded[ORDER:] > 0) | (padded[ORDER - 1 : -1] > 0)) + ORDER
    out = np.zeros((len(at), ORDER), np.uint32)
    out[:, 0] = np.where(padded[at] > 0, padded[at], END)
    for k in range(1, ORDER):
        out[:, k] = padded[at - k] if k == 1 else np.where(out[:, k - 1] > 0, padded[at - k], 0)
    newline = raw == 10
    return out, (np.cumsum(newline) - newline)[at - ORDER]


def gram_hashes(symbols: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per order 1..ORDER: hashes of n-grams, and of their contexts."""
    wide = symbols.astype(np.uint64) * _FACTORS
    grams, contexts = [], []
    running = wide[:, 0].copy()
    context = np.zeros(len(wide), np.uint64)
    for n in range(1, ORDER + 1):
        if n > 1:
            running = running + wide[:, n - 1]
            context = context + wide[:, n - 1]
        grams.append(mix64(running + np.uint64(n)))
        contexts.append(mix64(context + np.uint64(n + 64)))
    return grams, contexts


def distinct(symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row of ``symbols`` once, with the sum of its counts."""
    keys = np.zeros(len(symbols), np.uint64)
    for k in range(ORDER):
        keys += symbols[:, k].astype(np.uint64) * _FACTORS[k]
    _, first, inverse = np.unique(mix64(keys), return_index=True, return_inverse=True)
    return symbols[first], np.bincount(inverse, weights=counts, minlength=len(first)).astype(np.int64)


def slices(tokens: list[str]):
    """Bounds of runs of tokens with about SLICE characters each; a longer token is a run of its own."""
    start = held = 0
    for i, t in enumerate(tokens):
        if held and held + len(t) > SLICE:
            yield start, i
            start, held = i, 0
        held += len(t) + 1
    if held:
        yield start, len(tokens)


def count_grams(docs: DataFrame, text_col: str, group_col: str, distinct_words: int = 200_000) -> DataFrame:
    """(grp, gram, n): counts of the longest n-grams by group, over every row.

    ``gram`` holds ORDER code points, the predicted one first.  A task holds at
    most ``distinct_words`` words (and those of a text), of all groups together,
    and counts of words beyond that are given out in parts; n-grams of these words
    are formed some at a time.
    """
    schema = "grp string, gram string, n long"

    def emit(group: str, words: Counter) -> pa.RecordBatch:
        tokens, times = list(words), np.fromiter(words.values(), np.int64, len(words))
        symbols, counts = np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64)
        for start, end in slices(tokens):
            more, token = predictions(tokens[start:end])
            symbols, counts = distinct(np.concatenate([symbols, more]), np.concatenate([counts, times[start + token]]))
        flat = np.ascontiguousarray(symbols).tobytes().decode("utf-32-le", "surrogatepass")
        grams = [flat[i : i + ORDER] for i in range(0, len(flat), ORDER)]
        return pa.RecordBatch.from_arrays([pa.array([group] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(counts)], names=["grp", "gram", "n"])

    def run(batches):
        forget_models()
        words: dict[str, Counter] = {}
        held = 0
        for batch in batches:
            for text, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = words.setdefault(group, Counter())
                held -= len(own)
                own.update(text.lower().split())
                held += len(own)
                while held > distinct_words:
                    largest = max(words, key=lambda g: len(words[g]))
                    held -= len(words[largest])
                    yield emit(largest, words.pop(largest))
        while words:
            group, own = words.popitem()
            if own:
                yield emit(group, own)
        release_memory()

    rows = docs.select(F.col(text_col).alias("text"), F.col(group_col).cast("string").alias("grp")).where("text IS NOT NULL AND grp IS NOT NULL")
    return rows.mapInArrow(run, schema).groupBy("grp", "gram").agg(F.sum("n").alias("n"))


@dataclass
class CharModel:
    """Log probabilities of K groups; see ``build``."""

    groups: list[str]
    hash_bits: int = 64
    grams: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray | None = None

    def lookup(self, keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return at, keys[at] == hashes

    def score(self, symbols: np.ndarray) -> np.ndarray:
        """(n, K) log probabilities of the predicted symbols, some rows at a time."""
        if len(symbols) > SLICE:
            return np.concatenate([self.score(symbols[i : i + SLICE]) for i in range(0, len(symbols), SLICE)])
        grams, contexts = gram_hashes(symbols)
        out = np.zeros((len(symbols), len(self.groups)), np.float32)
        rest = np.arange(len(symbols))
        for n in range(ORDER - 1, -1, -1):
            at, hit = self.lookup(self.grams[n], grams[n][rest])
            out[rest[hit]] += self.logs[n][at[hit]]
            rest = rest[~hit]
            if not len(rest):
                return out
            at, hit = self.lookup(self.contexts[n], contexts[n][rest])
            out[rest[hit]] += self.weights[n][at[hit]]
        out[rest] += self.floor
        return out

    def score_tokens(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per token: (K) summed log probabilities, and the number of predictions."""
        runs = list(slices(tokens))
        if len(runs) > 1:
            parts = [self.score_tokens(tokens[a:b]) for a, b in runs]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        symbols, token = predictions(tokens)
        logs = self.score(symbols)
        total = np.stack([np.bincount(token, weights=logs[:, k], minlength=len(tokens)) for k in range(logs.shape[1])], 1)
        return total.astype(np.float32), np.bincount(token, minlength=len(tokens)).astype(np.float32)


def _discount(counts: np.ndarray) -> float:
    once, twice = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def build(grp: np.ndarray, symbols: np.ndarray, counts: np.ndarray, groups: list[str]) -> CharModel:
    """Interpolated Kneser-Ney from the longest n-grams' counts.

    The longest order uses counts; shorter ones use the number of distinct
    symbols before an n-gram.  Every n-gram that some group has gets a row with
    all groups' interpolated probabilities; a group that lacks it contributes
    its back-off weight times the shorter one's probability.
    """
    model, k = CharModel(groups), len(groups)
    levels = []
    rows, weight, owner = symbols, counts.astype(np.float64), grp
    for n in range(ORDER, 0, -1):
        grams, contexts = gram_hashes(np.pad(rows[:, :n], ((0, 0), (0, ORDER - n))))
        levels.append((n, rows[:, :n], weight, owner, grams[n - 1], contexts[n - 1], grams[n - 2] if n > 1 else None))
        if n > 1:
            key = np.stack([owner.astype(np.uint64), grams[n - 2]], 1)
            _, first, inverse = np.unique(key, axis=0, return_index=True, return_inverse=True)
            weight = np.bincount(inverse.ravel(), minlength=len(first)).astype(np.float64)
            rows, owner = rows[first], owner[first]
    lower_keys, lower = None, None
    alphabet = np.array([max(2, len(np.unique(symbols[grp == g, 0])) + 1) for g in range(k)], np.float64)
    for n, rows, weight, owner, gram, context, shorter in reversed(levels):
        keys, first, at = np.unique(gram, return_index=True, return_inverse=True)
        context_keys, ctx_at = np.unique(context, return_inverse=True)
        row_context, row_shorter = ctx_at[first], (np.searchsorted(lower_keys, shorter[first]) if n > 1 else None)
        prob, back = np.zeros((len(keys), k)), np.ones((len(context_keys), k))
        for g in range(k):
            own = owner == g
            d = _discount(weight[own])
            total = np.bincount(ctx_at[own], weights=weight[own], minlength=len(context_keys))
            kinds = np.bincount(ctx_at[own], minlength=len(context_keys))
            seen = total > 0
            back[seen, g] = d * kinds[seen] / total[seen]
            prob[at[own], g] = np.maximum(weight[own] - d, 0) / total[ctx_at[own]]
            prob[:, g] += back[row_context, g] * (lower[row_shorter, g] if n > 1 else 1 / alphabet[g])
        lower_keys, lower = keys, prob
        model.grams.append(keys)
        model.logs.append(np.log(np.maximum(prob, 1e-30)).astype(np.float32))
        model.contexts.append(context_keys)
        model.weights.append(np.log(np.maximum(back, 1e-30)).astype(np.float32))
    model.floor = -np.log(alphabet).astype(np.float32)
    return model


@dataclass
class Counts:
    """Longest n-grams by group, each once, ordered, with their counts."""

    groups: list[str]
    owner: np.ndarray
    symbols: np.ndarray
    counts: np.ndarray

    def model(self) -> CharModel:
        return build(self.owner, self.symbols, self.counts, self.groups)

    def part(self, prefix: str) -> Counts | None:
        """The groups that begin with a prefix, without it; None if there is none."""
        own = [i for i, g in enumerate(self.groups) if g.startswith(prefix)]
        if not own:
            return None
        place = np.full(len(self.groups), -1)
        place[own] = np.arange(len(own))
        used = place[self.owner] >= 0
        return Counts([self.groups[i][len(prefix) :] for i in own], place[self.owner[used]], self.symbols[used], self.counts[used])

    def plus(self, other: Counts) -> Counts:
        groups = sorted({*self.groups, *other.groups})
        place = [np.array([groups.index(g) for g in c.groups]) for c in (self, other)]
        owner = np.concatenate([place[0][self.owner], place[1][other.owner]])
        symbols, counts = np.concatenate([self.symbols, other.symbols]), np.concatenate([self.counts, other.counts])
        order = np.lexsort((*symbols.T, owner))
        owner, symbols, counts = owner[order], symbols[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (symbols[1:] != symbols[:-1]).any(axis=1)]))
        return Counts(groups, owner[first], symbols[first], np.add.reduceat(counts, first))


def gather(docs: DataFrame, text_col: str, group_col: str) -> Counts | None:
    """Counts of every row with a text and a group; None if there is none."""
    table = count_grams(docs, text_col, group_col).toArrow()
    if not table.num_rows:
        return None
    names = table.column("grp").combine_chunks().dictionary_encode()
    found = names.dictionary.to_pylist()
    groups = sorted(found)
    owner = np.array([groups.index(g) for g in found])[names.indices.to_numpy()]
    symbols = np.concatenate([code_points("".join(c.to_pylist())).reshape(-1, ORDER) for c in table.column("gram").chunks])
    order = np.lexsort((*symbols.T, owner))
    return Counts(groups, owner[order], symbols[order], table.column("n").to_numpy()[order])


def fit(docs: DataFrame, text_col: str, group_col: str) -> CharModel | None:
    """Model over every row with a text and a group; None if there is none."""
    counts = gather(docs, text_col, group_col)
    return counts and counts.model()


class _Ids(dict):
    """Numbers of words; an unknown word gets the next one."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Vocabulary:
    """Values of words, computed once per distinct word and bounded in number.

    ``rows`` computes the values of new words; words beyond ``limit`` are
    dropped again after their batch.
    """

    def __init__(self, rows, limit: int = 120_000):
        self.rows, self.limit, self.ids = rows, limit, _Ids()
        self.values: list[np.ndarray] | None = None
        self.fresh: list[str] = []

    def encode(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))

    def fill(self) -> None:
        """Values of all words seen so far."""
        self.fresh, self.ids.new = self.ids.new, []
        if self.fresh:
            values = self.rows(self.fresh)
            self.values = values if self.values is None else [np.concatenate([a, b]) for a, b in zip(self.values, values, strict=True)]

    def trim(self) -> None:
        if len(self.ids) > self.limit:
            for word in self.fresh:
                del self.ids[word]
            n = len(self.ids)
            self.values = [a[:n].copy() for a in self.values]
