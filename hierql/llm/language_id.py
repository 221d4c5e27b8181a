"""Language identification with one character model per language.

The predicted language is the one with the lowest cross-entropy per predicted
character.  Two things are calibrated on all training rows, each measured by a
model of the other half of them: the temperature of the score (a posterior over the
learned languages), and per language the highest cross-entropy that its texts
have.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import charlm
from .common import annotate, cached, fold, materialize, prefixed, prepare, release_memory, remove_materialized, written

FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


#: Calibration rows from which on a language has a bound of its own.
FEW = 20
#: Nats per character of a language that a half has no row of.
UNLEARNED = 50.0
#: Temperatures to choose from.
TEMPERATURES = np.geomspace(0.1, 30, 25)
#: Losses are added up as whole numbers of 1 / LOSS_UNIT, so their order changes nothing.
LOSS_UNIT = 1 << 24


@dataclass
class LanguageModel:
    chars: charlm.CharModel
    name: str
    temperature: float = 1.0
    mean: np.ndarray | None = None
    reach: np.ndarray | None = None  # largest calibrated deviation, times the root of the length

    def __post_init__(self):
        if self.mean is None:  # nothing is rejected
            self.mean, self.reach = np.full(len(self.chars.groups), np.inf), np.full(len(self.chars.groups), np.inf)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(n, K) nats per predicted character, and the number of predictions."""
        words = cached(self.name, lambda: charlm.Vocabulary(self.chars.score_tokens))
        coded = [words.encode(t.lower().split()) if t else None for t in texts]
        words.fill()
        out, sizes = np.zeros((len(texts), len(self.chars.groups))), np.zeros(len(texts))
        if words.values is not None:
            logs, counts = words.values
            for i, ids in enumerate(coded):
                if ids is not None and len(ids):
                    sizes[i] = counts[ids].sum(dtype=np.float64)
                    out[i] = -logs[ids].sum(axis=0, dtype=np.float64)
            words.trim()
        return out / np.maximum(sizes, 1)[:, None], sizes

    def calibrate(self, rows: DataFrame, slack: float, least_reach: float) -> None:
        """Temperature and bounds from every row of ``measured``; only sums, counts and maxima by language reach the driver."""
        groups = self.chars.groups
        sums = {r.lang: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("losses")[i].cast("long")) for i in range(len(TEMPERATURES))]).alias("losses")).collect()}
        if not sums:
            return
        counts = {g: r.n for g, r in sums.items()}
        total = sum(counts.values())
        loss = np.array([sum(r.losses[i] for r in sums.values()) / total / LOSS_UNIT for i in range(len(TEMPERATURES))])
        self.temperature = TEMPERATURES[(loss + 1e-3 * np.log(TEMPERATURES) ** 2).argmin()]
        means = medians(rows, counts)
        deviation = F.lit(slack) * (F.col("own") - F.col("mean")) * F.sqrt(F.least("size", F.lit(400.0)))
        table = rows.sparkSession.createDataFrame(sorted(means.items()), "lang string, mean double")
        most = {r.lang: r.most for r in rows.join(F.broadcast(table), "lang").groupBy("lang").agg(F.max(deviation).alias("most")).collect()}
        every = None if len(means) == len(groups) else medians(rows.withColumn("lang", F.lit("")), {"": total})[""]
        self.mean = np.array([means.get(g, every) for g in groups])
        self.reach = np.maximum(least_reach, [most[g] if counts.get(g, 0) >= FEW else max(most.values()) for g in groups])


def posteriors(entropy: np.ndarray, sizes: np.ndarray, temperature: float) -> np.ndarray:
    z = -temperature * np.sqrt(sizes)[:, None] * entropy
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Doubles as integers in the same order."""
    bits = np.ascontiguousarray(values, np.float64).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def medians(rows: DataFrame, counts: dict[str, int]) -> dict[str, float]:
    """Exact median of ``own`` by language, of any number of rows; ``counts`` are the languages' numbers of rows.

    The values in the middle are found from ``key``, their ``ordered_bits``, 16 bits
    at a time: rows that share the bits found so far are counted by the next ones,
    so at most 65 536 counts for each of a language's two middle ranks reach the
    driver.
    """
    found = {(g, r): (0, r) for g, n in counts.items() for r in {(n - 1) // 2, n // 2}}  # bits, rank among rows that have them
    for shift in (48, 32, 16, 0):
        within = rows
        if shift < 48:
            wanted = rows.sparkSession.createDataFrame(sorted({(g, bits) for (g, _), (bits, _) in found.items()}), "lang string, bits long")
            within = rows.withColumn("bits", F.shiftright("key", shift + 16)).join(F.broadcast(wanted), ["lang", "bits"])
        table = within.groupBy("lang", F.shiftright("key", shift).alias("bin")).count().toArrow()
        names, bins, times = np.array(table.column("lang").to_pylist(), object), table.column("bin").to_numpy(), table.column("count").to_numpy()
        for (g, r), (bits, rank) in found.items():
            own = np.flatnonzero((names == g) & ((shift == 48) | (bins >> 16 == bits)))
            own = own[np.argsort(bins[own])]
            upto = np.cumsum(times[own])
            i = np.searchsorted(upto, rank, side="right")
            found[g, r] = int(bins[own[i]]), int(rank - upto[i] + times[own[i]])
    middle = {at: ordered_bits(np.array([bits]).view(np.float64)).view(np.float64)[0] for at, (bits, _) in found.items()}
    return {g: float(np.mean([middle[g, (n - 1) // 2], middle[g, n // 2]])) for g, n in counts.items()}


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", slack: float = 1.5, least_reach: float = 20.0) -> LanguageModel | None:
    """Learn from rows with a text and a language outside fold 1.

    All of them are counted, by halves (crc32 of the id), and all of them set the
    temperature and the rejection bounds, each measured by a model of the half it
    is not in; the final model has both halves.  A language that the other half
    lacks is not measured; one with fewer than ``FEW`` measured rows has the widest
    bound of all.  Without a row in each half nothing is rejected but texts without
    letters.  None if no row has a language.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("id") != 1))
    rows = rows.withColumn("half", F.pmod(F.floor(F.crc32(F.col("id").cast("string")) / 3), F.lit(2)).cast("string"))
    counts = charlm.gather(rows.withColumn("grp", F.concat("half", "lang")), "text", "grp")
    if counts is None:
        return None
    halves = [counts.part(h) for h in "01"]
    if None in halves:
        return LanguageModel(next(h for h in halves if h).model(), uuid.uuid4().hex)
    model = LanguageModel(halves[0].plus(halves[1]).model(), uuid.uuid4().hex)
    start, parts = written(), []
    for half in "01":
        other = LanguageModel(halves[half == "0"].model(), uuid.uuid4().hex)
        parts.append(materialize(measured(rows.where(F.col("half") == half), other, model.chars.groups), "language-measured"))
    model.calibrate(parts[0].union(parts[1]), slack, least_reach)
    remove_materialized(spark, since=start)
    return model


def measured(rows: DataFrame, model: LanguageModel, groups: list[str]) -> DataFrame:
    """(lang, own, key, size, losses) of every row with a letter and a language that ``model`` learned.

    ``own`` is the cross-entropy under the row's language, ``key`` its
    ``ordered_bits``, ``size`` the number of predictions; ``losses`` has, for each of
    the temperatures, the posterior's log loss among ``groups``.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = "lang string, own double, key long, size double, losses array<int>"

    def run(batches):
        place = {g: i for i, g in enumerate(groups)}
        columns = [place[g] for g in shared.value.chars.groups]
        for batch in batches:
            entropy, sizes = shared.value.entropies(batch.column(1).to_pylist())
            used = np.flatnonzero(sizes > 0)
            langs = batch.column(0).take(pa.array(used))
            truth, n = [place[g] for g in langs.to_pylist()], len(used)
            if not n:
                continue
            wide, sizes = np.full((n, len(groups)), UNLEARNED), sizes[used]
            wide[:, columns] = entropy[used]
            own = wide[np.arange(n), truth]
            p = np.stack([posteriors(wide, sizes, t)[np.arange(n), truth] for t in TEMPERATURES], 1)
            losses = np.rint(-LOSS_UNIT * np.log(np.maximum(p, 1e-12))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(TEMPERATURES)), pa.array(losses.ravel()))
            yield pa.RecordBatch.from_arrays([langs, pa.array(own), pa.array(ordered_bits(own)), pa.array(sizes), lists], names=["lang", "own", "key", "size", "losses"])
        release_memory()

    return rows.where(F.col("lang").isin(model.chars.groups)).select("lang", "text").mapInArrow(run, schema)


def identify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``keep`` columns (default: all) plus lang_pred, score, entropy, rejected, with ``prefix`` before their names.

    A null text, one without a letter, or a missing model gives ``und`` with
    score 0, rejected.  Otherwise a text is rejected if its cross-entropy lies
    above the calibrated reach of its language.  Every row stays; equal texts
    get equal results; ties go to the first language by name.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def score(texts):
            own, n = shared.value, len(texts)
            if own is None:
                return [pa.array(["und"] * n, pa.string()), pa.array([0.0] * n), pa.array([None] * n, pa.float64()), pa.array([True] * n)]
            entropy, sizes = own.entropies(texts)
            best = entropy.argmin(axis=1)
            post = posteriors(entropy, sizes, own.temperature)[np.arange(n), best]
            low = entropy[np.arange(n), best]
            known = sizes > 0
            with np.errstate(invalid="ignore"):
                far = (low - own.mean[best]) * np.sqrt(np.minimum(sizes, 400)) > own.reach[best]
            names = [own.chars.groups[b] if k else "und" for b, k in zip(best, known, strict=True)]
            return [pa.array(names, pa.string()), pa.array(np.where(known, post, 0.0)), pa.array(np.where(known, low, np.nan), from_pandas=True), pa.array(~known | far)]

        return score

    return annotate(docs, text_col, make, prefixed(FIELDS, prefix), keep if keep is not None else docs.columns)


def held_out(id_col: str = "doc_id") -> Column:
    return fold(f"`{id_col}`") == 1


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, fit(docs), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "entropy", "rejected")
