"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over a window of words; it hashes the words at its ones
and ignores the others, so a window still hits its copy when ignored words were
replaced.  The hashes of document windows are joined with those of the benchmark
windows; a bit map of the latter's leading bits, of a fixed size, keeps most
other windows out of the join.  Around hits, document and item are compared word
by word along the hit's diagonal, mismatches allowed, and the item's words that
are found so decide.

The benchmark is one side of ordinary joins: its seeds are broadcast if its
texts have at most a given number of characters, else both sides are shuffled by
seed, with skewed seeds split at run time.  Documents are known by the digest of
their text, so equal texts are looked up as one.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, mix64, prepare
from .shingles import words

#: Fixed masks: ones are compared.  The spaced ones have eight ones; the short one is for short items that were cut.
MASKS = ("111111", "11111111", "111010010111", "110110101011", "101101110101", "111101001011")
SHORTEST = 4
#: Words of an item that must be found (all, of shorter items).
MATCHED = 8
_FACTORS = mix64(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)
LONG = max(map(len, MASKS))
#: Leading bits of a seed's hash that the bit map of the benchmark's seeds knows.
MAP_BITS = 24
HIT = T.StructType([T.StructField(n, t) for n, t in (("item_id", T.LongType()), ("matched", T.IntegerType()), ("words", T.IntegerType()), ("first_word", T.IntegerType()), ("last_word", T.IntegerType()))])


def seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """One hash per window start."""
    n = len(tokens) - len(mask) + 1
    out = np.full(max(n, 0), zlib.crc32(mask.encode()), np.uint64)
    for k, at in enumerate(i for i, bit in enumerate(mask) if bit == "1"):
        out += tokens[at : at + n] * _FACTORS[k]
    return mix64(out)


def seeded(same: np.ndarray, masks) -> np.ndarray:
    """Places of a diagonal that a seed's window covers."""
    change = np.zeros(len(same) + 1, np.int64)
    for mask in masks:
        n = len(same) - len(mask) + 1
        if n > 0:
            hit = np.ones(n, bool)
            for k, bit in enumerate(mask):
                if bit == "1":
                    hit &= same[k : k + n]
            change[:n] += hit
            change[len(mask) : len(mask) + n] -= hit
    return np.cumsum(change[:-1]) > 0


def short_masks(n: int) -> list[str]:
    """Masks for an item of ``n`` words, one of which hits wherever MATCHED words (all, of shorter items) are in place.

    The item is cut into two parts more than mismatches allowed, so two are whole.
    """
    spare = max(n - MATCHED, 0)
    if not spare:
        return ["1" * n]
    part = [k * (spare + 2) // n for k in range(n)]
    masks = ["".join("1" if p in pair else "0" for p in part).strip("0") for pair in combinations(range(spare + 2), 2)]
    return list(dict.fromkeys(masks))


def segments(same: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches of positive score, +1 a match, -2 a mismatch (Ruzzo and Tompa), as [start, end)."""
    found: list[tuple[int, int, int, int]] = []  # start, end, sum before, sum at the end
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8))).tolist()
    total = at = 0
    for start, end in zip(edges[::2], edges[1::2], strict=True):
        low = total - 2 * (start - at)
        total, at = low + end - start, end
        new = (start, end, low, total)
        while True:
            k = next((k for k in range(len(found) - 1, -1, -1) if found[k][2] <= new[2]), None)
            if k is None or found[k][3] >= new[3]:
                break
            new = (found[k][0], end, found[k][2], total)
            del found[k:]
        found.append(new)
    return [f[:2] for f in found]


def masks_of(size: int) -> tuple[str, ...] | list[str]:
    """Masks that find an item of so many words."""
    return MASKS if size >= LONG else short_masks(size) if size >= SHORTEST else []


def windows(tokens: np.ndarray, bounds: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window inside a text: its hash, the text's number, its first word's place in the text."""
    hashes = seed_hashes(tokens, mask)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(owner[: len(hashes)] == owner[len(mask) - 1 :]) if len(hashes) else np.zeros(0, np.int64)
    return hashes[at], owner[at], at - bounds[owner[at]]


def item_seeds(texts: DataFrame) -> DataFrame:
    """(text) -> (seed, item, item_at): the windows of all items; ``item`` is the text's xxhash64."""

    def run(batches):
        for batch in batches:
            tokens, bounds = words(batch.column(1).to_pylist())
            keys, sizes = batch.column(0).to_numpy(), np.diff(bounds)
            for mask in {m: None for n in set(sizes.tolist()) for m in masks_of(n)}:
                hashes, owner, at = windows(tokens, bounds, mask)
                used = np.isin(owner, [i for i, n in enumerate(sizes.tolist()) if mask in masks_of(n)])
                yield pa.RecordBatch.from_arrays([pa.array(hashes[used].view(np.int64)), pa.array(keys[owner[used]]), pa.array(at[used].astype(np.int32))], names=["seed", "item", "item_at"])

    return texts.select(F.xxhash64("text").alias("item"), "text").mapInArrow(run, "seed long, item long, item_at int")


def document_seeds(docs: DataFrame, masks: list[str], known: np.ndarray) -> DataFrame:
    """(doc, text) -> (seed, doc, doc_at) of the windows whose leading bits some item's seed has."""
    shared = docs.sparkSession.sparkContext.broadcast((masks, np.packbits(known)))

    def run(batches):
        own, packed = shared.value
        there = np.unpackbits(packed).astype(bool)
        for batch in batches:
            tokens, bounds = words(batch.column(1).to_pylist())
            for mask in own:
                hashes, owner, at = windows(tokens, bounds, mask)
                used = np.flatnonzero(there[(hashes >> np.uint64(64 - MAP_BITS)).astype(np.int64)])
                if len(used):
                    docs_of = batch.column(0).take(pa.array(owner[used]))
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[used].view(np.int64)), docs_of, pa.array(at[used].astype(np.int32))], names=["seed", "doc", "doc_at"])

    return docs.select("doc", "text").mapInArrow(run, "seed long, doc string, doc_at int")


def verify(own: np.ndarray, target: np.ndarray, diagonals: list[int]) -> tuple[int, int, int, int]:
    """Item words found in stretches around seeds, the longest stretch's matches, first and last document word."""
    covered = np.zeros(len(target), bool)
    best, first, last = 0, len(own), -1
    short = len(target) < LONG  # every match on the diagonal is near
    for d in diagonals:
        a, b = max(0, -d), min(len(target), len(own) - d)
        same = target[a:b] == own[a + d : b + d]
        stretches = segments(same)
        near = np.ones(len(same), bool) if short else seeded(same, MASKS)
        top = max(stretches, key=lambda x: 3 * np.count_nonzero(same[x[0] : x[1]]) - 2 * (x[1] - x[0]), default=None)
        for start, end in stretches:
            if (start, end) == top or near[start:end].any():
                stretch = np.flatnonzero(same[start:end]) + start
                covered[a + stretch] = True
                best = max(best, len(stretch))
                first, last = min(first, a + d + start), max(last, a + d + end - 1)
    return int(covered.sum()), best, first, last


def candidates(docs: DataFrame, items: DataFrame, masks: list[str], small: bool) -> DataFrame:
    """(doc, item, diagonals): texts that share a seed, and on which diagonals, in words of the document."""
    seeds = materialize(item_seeds(items.select("text").distinct()), "seeds")
    leading = F.shiftrightunsigned("seed", 64 - MAP_BITS).cast("int")
    known = np.zeros(1 << MAP_BITS, bool)  # at most 2 ** MAP_BITS numbers come to the driver
    known[seeds.select(leading.alias("at")).distinct().toArrow().column("at").to_numpy()] = True
    pairs = document_seeds(docs, masks, known).join(F.broadcast(seeds) if small else seeds.hint("merge"), "seed")
    return pairs.groupBy("doc", "item").agg(F.array_sort(F.collect_set(F.col("doc_at") - F.col("item_at"))).alias("diagonals"))


def hits(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, coverage: float, long_stretch: int, block_chars: int) -> DataFrame:
    """Rows of ``docs`` joined with the items they hold: (hq_row, doc, HIT's fields)."""
    prepare(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(0).alias("hq_none")).alias("hq_row"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
    rows = rows.withColumn("doc", F.md5(F.col("text").cast("binary")))
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    items = materialize(items, "items")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    masks = materialize(items.select("text").distinct().mapInArrow(sizes_of, "size int").distinct(), "sizes")
    sizes = [r.size for r in masks.where(F.col("size") < LONG).collect()] + [LONG]  # LONG numbers at most
    found = materialize(candidates(rows, items, list({m: None for n in sorted(sizes) for m in masks_of(n)}), chars <= block_chars), "candidates")
    items = items.select("item_id", F.col("text").alias("item_text"), F.xxhash64("text").alias("item"))
    row_type = rows.schema["hq_row"]

    def run(batches):
        for batch in batches:
            own, own_bounds = words(batch.column("text").to_pylist())
            target, bounds = words(batch.column("item_text").to_pylist())
            out, kept = [], []
            for i, diagonals in enumerate(batch.column("diagonals").to_pylist()):
                size = int(bounds[i + 1] - bounds[i])
                matched, stretch, first, last = verify(own[own_bounds[i] : own_bounds[i + 1]], target[bounds[i] : bounds[i + 1]], diagonals)
                if matched >= min(MATCHED, size) and (matched >= coverage * size or stretch >= long_stretch):
                    kept.append(i)
                    out.append((matched, size, first, last))
            take = pa.array(kept, pa.int64())
            numbers = [pa.array([x[k] for x in out], pa.int32()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("hq_row").take(take), batch.column("doc").take(take), batch.column("item_id").take(take), *numbers], names=["hq_row", "doc", *HIT.fieldNames()])

    schema = T.StructType([row_type, T.StructField("doc", T.StringType()), *HIT.fields])
    # Both are plain scans of written tables, so the planner knows whether they are small; else texts are shuffled.
    return rows.join(found, "doc").join(items, "item").select("hq_row", "doc", "text", "item_id", "item_text", "diagonals").mapInArrow(run, schema)


def sizes_of(batches):
    """Arrow batches of texts -> their numbers of words."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.diff(words(batch.column(0).to_pylist())[1]).astype(np.int32))], names=["size"])


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = 0.5, long_stretch: int = 32, block_chars: int = 1_000_000) -> DataFrame:
    """(id_col, item_id, matched, words, first_word, last_word): benchmark items that documents hold.

    An item counts as held if at least eight of its words (all, of shorter
    items) are found along hit diagonals, and these are ``coverage`` of its words
    or include an aligned stretch of ``long_stretch`` matches.  Items of fewer
    than four words, null texts and null item ids are left out.  Each (document
    row, item row) gives one row at most; repeated rows give theirs.  Seeds of a
    benchmark of up to ``block_chars`` characters are broadcast, others shuffled.
    """
    found = hits(docs.select(id_col, text_col), benchmark, text_col, item_col, item_text_col, coverage, long_stretch, block_chars)
    return found.select(F.col(f"hq_row.`{id_col}`").alias(id_col), *HIT.fieldNames())


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = 0.5, long_stretch: int = 32, block_chars: int = 1_000_000) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item, with all their columns, whatever their names.

    Rows with a null text hold none and stay; equal texts stay or go together.
    """
    found = hits(docs.select(text_col), benchmark, text_col, item_col, item_text_col, coverage, long_stretch, block_chars)
    gone = materialize(found.select(F.col("doc").alias("hq_doc")).distinct(), "contaminated")
    return docs.join(gone, F.md5(F.col(f"`{text_col}`").cast("string").cast("binary")) == F.col("hq_doc"), "left_anti")


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
