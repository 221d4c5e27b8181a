"""Toxicity scores of deobfuscated texts.

Obfuscated spellings are undone first.  A word that may be obfuscated becomes a
lattice of characters: look-alike symbols stand for letters, stretched letters
for one or two, separators and single spaces inside a spelled-out word for
nothing.  Viterbi search under a character model of the whole corpus finds the
likeliest reading; a word with a single reading is that reading.  The restored
words are then scored by logistic regression on words and word beginnings,
fitted on labelled rows.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import charlm
from .common import annotate, bounded_rows, cached, fold, materialize, mix64, prefixed, prepare

#: Letters that a symbol may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i", "#": "h"}
SEPARATORS = frozenset(" .-_*'~,/·")
#: Costs in nats: reading a symbol as a letter, shortening a stretch, skipping a separator, taking a symbol for a word break.
SUBSTITUTE, SHORTEN, SKIP, BREAK = 1.0, 0.7, 0.4, 3.0
#: A longer stretch of a single letter, without another letter beside it, has one reading.
LONGEST = 40
#: Letters of a stretch that are scored one by one; the context is the same from there on.
SCORED = charlm.ORDER
_EDGE = ".,;:?\"')]}>”»…%&*~^="
_OPEN = "\"'([{<“«%&*~^="
_STRETCH = re.compile(r"(.)\1\1")
_DOUBLE = re.compile(r"(.)\1")
_WORD = re.compile(r"[^\W\d_]+")
_ONE_LETTER = re.compile(rf"([^\W\d_])\1{{{LONGEST},}}[\W\d_]*")
FEATURE_BITS = 22
FIELDS = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
_PLACES = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def plain(token: str) -> bool:
    """Whether every stretch of a token has one option in the lattice, itself."""
    return token.isalpha() and not _STRETCH.search(token) and sum(1 for _ in islice(_DOUBLE.finditer(token), 3)) < 3


class Decoder:
    """Viterbi search over a word's character lattice."""

    def __init__(self, chars: charlm.CharModel):
        self.chars, self.known = chars, {}

    def logs(self, pairs: list[str]) -> None:
        new = [p for p in dict.fromkeys(pairs) if p not in self.known]
        if new:
            symbols = charlm.code_points("".join(new)).reshape(-1, charlm.ORDER)
            self.known.update(zip(new, self.chars.score(symbols)[:, 0].tolist(), strict=True))

    @staticmethod
    def lattice(word: str) -> list[list[tuple[str, float, int]]]:
        """Per stretch of equal characters: (reading, cost, further letters like its last); a space is a word break."""
        stretches = [(c, len(list(g))) for c, g in groupby(word)]
        doubled = sum(n >= 2 for _, n in stretches) >= 3
        out = []
        for c, n in stretches:
            if c.isalpha():
                options = [(c * min(n, SCORED), 0.0, max(n - SCORED, 0))]
                if n >= 3:
                    options += [(c, SHORTEN, 0), (c * 2, SHORTEN, 0)]
                elif n == 2 and doubled:
                    options.append((c, SHORTEN, 0))
            elif c in SEPARATORS:
                options = [("", SKIP * n, 0), (" ", 0.0, 0)]
            else:
                options = [(" ", BREAK, 0)]
            for letter in LOOKALIKES.get(c, ""):
                options += [(letter, SUBSTITUTE * min(n, 2), 0)] + [(letter * 2, SUBSTITUTE * 2, 0)] * (n >= 2)
            out.append(options)
        return out

    def read(self, word: str) -> str:
        """The likeliest reading: words with spaces between them.

        A state is the context of the next letter; every state is kept, the best
        path to each of them.
        """
        start = "\0" * (charlm.ORDER - 1)
        states: dict[str, tuple] = {start: (0.0, None)}  # score, chain of (reading so far, option)
        for options in [*self.lattice(word), [(" ", 0.0, 0)]]:
            if len(self.known) > 60_000:
                self.known.clear()
            steps, wanted = [], []
            for context, (score, text) in states.items():
                for option, cost, further in options:
                    at, asked = context, []
                    for letter in option:
                        if letter != " " or at[0] != "\0":
                            asked.append((chr(charlm.END) if letter == " " else letter) + at)
                        at = self.after(at, letter)
                    if further:
                        asked.append(option[-1] + at)
                    wanted += asked
                    steps.append((at, score - cost, asked, text, option + option[-1:] * further, further))
            self.logs(wanted)
            ahead: dict[str, tuple] = {}
            for to, score, asked, text, option, further in steps:
                score += sum(self.known[a] for a in asked) + (self.known[asked[-1]] * (further - 1) if further else 0.0)
                if to not in ahead or score > ahead[to][0]:
                    ahead[to] = score, (text, option)
            states = ahead
        chain, parts = max(states.values(), key=lambda x: x[0])[1], []
        while chain:
            chain, option = chain
            parts.append(option)
        return "".join(reversed(parts))

    @staticmethod
    def after(context: str, text: str) -> str:
        """Context after a text: the last letters backwards, empty after a break."""
        for letter in text:
            context = "\0" * (charlm.ORDER - 1) if letter == " " else (letter + context)[: charlm.ORDER - 1]
        return context

    def words(self, token: str) -> list[str]:
        """Restored words of one space-delimited token (lower case)."""
        if plain(token):
            return [token]
        core = token.rstrip(_EDGE).lstrip(_OPEN)
        while len(core) > 3 and core[-1] == core[-2] == core[-3] and not core[-1].isalnum():
            core = core.rstrip(core[-1]).rstrip(_EDGE)
        core = core.rstrip("!") or core
        if not core or plain(core):
            return [core] if core else []
        if not any(c.isalpha() or c in LOOKALIKES for c in core) or _ONE_LETTER.fullmatch(core):
            return _WORD.findall(core)
        return _WORD.findall(self.read(core))


def spelled_out(tokens: list[str]) -> list[str]:
    """Runs of three or more one-character tokens, each joined by spaces."""
    found, run = [], []
    for t in [*tokens, "  "]:
        if len(t) == 1:
            run.append(t)
        else:
            if len(run) >= 3:
                found.append(" ".join(run))
            run = []
    return found


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (n, 7) of words and which of them there are: the word, its beginnings of 3 to 8 letters."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    points = charlm.code_points("".join(words)).astype(np.uint64)
    at = np.arange(len(points)) - np.repeat(starts, sizes)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(points * _PLACES[at % len(_PLACES)] + np.repeat(np.uint64(1), len(points)), out=sums[1:])
    out, there = np.zeros((len(words), 7), np.int64), np.ones((len(words), 7), bool)
    for k, n in enumerate((0, 3, 4, 5, 6, 7, 8)):
        ends = starts + (np.minimum(n, sizes) if n else sizes)
        out[:, k] = mix64(sums[ends] - sums[starts] + np.uint64(n << 56)) >> np.uint64(64 - FEATURE_BITS)
        there[:, k] = sizes >= n
    return out, there


@dataclass
class ToxicityModel:
    chars: charlm.CharModel | None
    name: str
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -3.0
    threshold: float = 0.7


class Reader:
    """Features of tokens, by way of their restored words."""

    def __init__(self, chars: charlm.CharModel | None, wanted=None):
        self.decoder = Decoder(chars) if chars is not None else None
        self.wanted = None
        if wanted is not None:
            self.wanted = np.zeros(1 << FEATURE_BITS, bool)
            self.wanted[list(wanted)] = True

    def words(self, token: str) -> list[str]:
        return self.decoder.words(token) if self.decoder else _WORD.findall(token)

    def of_tokens(self, tokens: list[str]) -> dict[int, set[int]]:
        """Features by position of the token; only tokens with wanted features appear."""
        words, owners = [], []
        for i, t in enumerate(tokens):
            for w in [t] if plain(t) else self.words(t):
                words.append(w)
                owners.append(i)
        if not words:
            return {}
        found, there = features(words)
        if self.wanted is not None:
            there &= self.wanted[found]
        out: dict[int, set[int]] = {}
        for row, column in np.argwhere(there).tolist() if self.wanted is not None else ():
            out.setdefault(owners[row], set()).add(int(found[row, column]))
        if self.wanted is None:
            for i, own, mask in zip(owners, found, there, strict=True):
                out.setdefault(i, set()).update(own[mask].tolist())
        return out


class Scorer:
    """Logits of texts; remembers the tokens with features."""

    def __init__(self, model: ToxicityModel):
        self.model, self.reader, self.found = model, Reader(model.chars, model.weights), {}
        self.words = charlm.Vocabulary(self.rows, limit=150_000)

    def rows(self, tokens: list[str]) -> list[np.ndarray]:
        """One number per token: 1 if it has features, and 2 more if it is one character."""
        flags = np.fromiter((2 if len(t) == 1 else 0 for t in tokens), np.int8, len(tokens))
        for at in range(0, len(tokens), 20_000):
            for i, features_of in self.reader.of_tokens(tokens[at : at + 20_000]).items():
                self.found[tokens[at + i]] = features_of
                flags[at + i] += 1
        return [flags]

    def logits(self, texts: list[str | None]) -> np.ndarray:
        coded = [self.words.encode(t.lower().split()) if t else None for t in texts]
        self.words.fill()
        out = np.full(len(texts), self.model.bias)
        if self.words.values is None:
            return out
        flags = self.words.values[0]
        for i, ids in enumerate(coded):
            if ids is None:
                continue
            marks = flags[ids]
            hits, single = np.flatnonzero(marks & 1), marks >= 2
            spelled = len(single) >= 3 and (single[2:] & single[1:-1] & single[:-2]).any()
            if len(hits) or spelled:
                tokens = texts[i].lower().split()
                found: set[int] = set()
                for t in {tokens[h] for h in hits}:
                    found |= self.found[t]
                if spelled:
                    for own in self.reader.of_tokens(spelled_out(tokens)).values():
                        found |= own
                out[i] += sum(self.model.weights[f] for f in sorted(found))
        if len(self.words.ids) > self.words.limit:
            for t in self.words.fresh:
                self.found.pop(t, None)
        self.words.trim()
        return out


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", labelled_rows: int = 8_000, kept_features: int = 4_000, threshold: float = 0.7) -> ToxicityModel:
    """Character model over every text; classifier on labelled rows outside fold 1.

    The classifier sees at most ``labelled_rows`` of them, the first by md5 of
    the id.  Rows with a null text count as empty texts, null labels are
    ignored, of repeated labels the largest counts, of repeated ids one row (and
    none of ids with more rows than the bound has left).  Features are counted by Spark; the driver gets those chosen, of these
    rows.  Without any toxic or any clean row every text gets the same low score.
    """
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    chars = charlm.fit(base.withColumn("grp", F.lit("all")), "text", "grp")
    model = ToxicityModel(chars, uuid.uuid4().hex, threshold=threshold)
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")).where("id IS NOT NULL AND label IS NOT NULL").where(fold("id") != 1)
    marks = marks.groupBy("id").agg(F.max("label").cast("int").alias("label")).orderBy(F.md5(F.col("id").cast("string").cast("binary"))).limit(labelled_rows)
    chosen = bounded_rows(base.join(F.broadcast(marks), "id"), labelled_rows)
    shared = spark.sparkContext.broadcast(chars)
    schema = T.StructType([T.StructField("features", T.ArrayType(T.IntegerType()))])

    def make():
        reader = Reader(shared.value)

        def collect(texts):
            out = []
            for text in texts:
                tokens = text.lower().split()
                kinds = list(dict.fromkeys([*tokens, *spelled_out(tokens)]))
                out.append(sorted(set().union(*reader.of_tokens(kinds).values())))
            return [pa.array(out, pa.list_(pa.int32()))]

        return collect

    found = annotate(chosen, "text", make, schema, ["id", "label"])
    found = found.groupBy("id").agg(F.first("label").alias("label"), F.min(F.struct(F.xxhash64("features").alias("h"), "features")).alias("row"))
    found = materialize(found.select("label", "row.features"), "features")
    n, p = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if 0 < p < n:
        best = telling_features(found, n, p, kept_features)
        place = np.array(best, np.int32)

        def choose(batches):
            for batch in batches:
                lists = [np.intersect1d(x, place).astype(np.int32) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["label", "features"])

        rows = found.mapInArrow(choose, "label int, features array<int>").toArrow()
        lists = rows.column("features").to_pylist()
        values = np.array([v for x in lists for v in x], np.int64)
        model.weights, model.bias = regress(values, np.array([len(x) for x in lists], np.int64), rows.column("label").to_numpy().astype(float), np.array(best, np.int64))
    return model


def telling_features(found: DataFrame, n: int, p: int, kept: int) -> list[int]:
    """Of the features of three rows and more, at most ``kept``, with the highest likelihood ratio, in order."""
    counts = found.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).cast("double").alias("seen"), F.sum("label").cast("double").alias("toxic")).where("seen >= 3")
    clean = F.col("seen") - F.col("toxic")
    share, other = F.col("seen") * p / n, F.col("seen") * (n - p) / n

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    gain = term(F.col("toxic"), share) + term(clean, other) + term(p - F.col("toxic"), p - share) + term(n - p - clean, n - p - other)
    best = counts.select("feature", gain.alias("gain")).where("gain > 5").orderBy(F.desc("gain"), "feature").limit(kept)
    return sorted(r.feature for r in best.collect())


def regress(values: np.ndarray, lengths: np.ndarray, y: np.ndarray, best: np.ndarray) -> tuple[dict[int, float], float]:
    """Logistic regression on the features ``best``, both classes weighing the same."""
    row = np.repeat(np.arange(len(y), dtype=np.int32), lengths)
    n, p = len(y), y.sum()
    if not len(best):
        return {}, float(np.log(p / (n - p)))
    place = np.full(1 << FEATURE_BITS, -1, np.int32)
    place[best] = np.arange(len(best))
    used = np.flatnonzero(place[values] >= 0)
    row, column = row[used], place[values[used]]
    weight = np.where(y == 1, (n - p) / p, 1.0)
    weight /= weight.mean()
    w, m, v = np.zeros(len(best) + 1), np.zeros(len(best) + 1), np.zeros(len(best) + 1)
    w[-1] = -2.0
    for step in range(1, 601):
        z = np.bincount(row, weights=w[column], minlength=n) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight / n
        g = np.append(np.bincount(column, weights=error[row], minlength=len(best)), error.sum()) + 1e-6 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return dict(zip(best.tolist(), w[:-1].tolist(), strict=True)), float(w[-1])


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``keep`` columns (default: all) plus score (0 to 1) and predicted (1 from the threshold on), with ``prefix`` before their names.

    Null and empty texts have the score of a text without any known feature.
    Every row stays; equal texts get equal scores.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        scorer = cached(own.name, lambda: Scorer(own))

        def measure(texts):
            p = 1 / (1 + np.exp(-np.clip(scorer.logits(texts), -40, 40)))
            return [pa.array(p), pa.array((p >= own.threshold).astype(np.int32))]

        return measure

    return annotate(docs, text_col, make, prefixed(FIELDS, prefix), keep if keep is not None else docs.columns)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, keep=["doc_id"]).select("doc_id", (fold("doc_id") == 1).alias("held_out"), "score", "predicted")
