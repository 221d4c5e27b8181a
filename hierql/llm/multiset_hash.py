"""Order-independent fingerprints of documents: a homomorphic multiset hash.

A paragraph (a line that is not empty) is hashed to a wide vector, and a
document's fingerprint is the sum of its paragraphs' vectors: paragraphs can be
inserted or deleted, and parts of a document combined, by adding or
subtracting vectors, in any order.

The vector has two parts.  ``EQUALITY`` lanes of 64 bits come from an
extendable hash of the whole paragraph and are summed modulo 2**64: two
documents agree there if their paragraphs do.  ``LIKENESS`` lanes of 32 bits are summed modulo 2**32; every pair of
neighbouring words of the paragraph adds 1 or -1 to one lane, so that the
cosine of two documents' lanes estimates that of their word-pair counts.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, prepare
from .shingles import words

EQUALITY, LIKENESS = 16, 192
_FIRST, _LAST = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_A, _B = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
Vectors = tuple[np.ndarray, np.ndarray]


def paragraphs(text: str | None) -> list[str]:
    return [p for p in (text or "").split("\n") if p]


def vectors(texts: list[str | None]) -> Vectors:
    """Equality lanes (n, EQUALITY) uint64 and likeness lanes (n, LIKENESS) uint32 of texts."""
    parts = [paragraphs(t) for t in texts]
    counts = np.array([len(p) for p in parts], np.int64)
    flat = [p for part in parts for p in part]
    dense, sparse = np.zeros((len(texts), EQUALITY), np.uint64), np.zeros((len(texts), LIKENESS), np.uint32)
    if not flat:
        return dense, sparse
    owner = np.repeat(np.arange(len(texts)), counts)
    raw = b"".join(hashlib.shake_128(p.encode("utf-8", "surrogatepass")).digest(EQUALITY * 8) for p in flat)
    filled = np.flatnonzero(counts)
    dense[filled] = np.add.reduceat(np.frombuffer(raw, np.uint64).reshape(-1, EQUALITY), (np.cumsum(counts) - counts)[filled], axis=0)
    hashes, bounds = words(flat)
    if len(hashes):
        used = np.flatnonzero(np.diff(bounds) > 0)
        before = np.empty_like(hashes)
        before[1:] = hashes[:-1]
        before[bounds[used]] = _FIRST
        word_owner = np.repeat(owner, np.diff(bounds))
        left = np.concatenate([before, hashes[bounds[used + 1] - 1]])
        right = np.concatenate([hashes, np.full(len(used), _LAST)])
        pair = mix64(left * _A + right * _B)
        at = np.concatenate([word_owner, owner[used]]) * LIKENESS + (pair >> np.uint64(8)) % np.uint64(LIKENESS)
        signs = np.where(pair & np.uint64(1), 1, -1)
        sums = np.bincount(at.astype(np.int64), weights=signs, minlength=len(texts) * LIKENESS)
        sparse[:] = sums.astype(np.int64).astype(np.uint32).reshape(len(texts), LIKENESS)
    return dense, sparse


def encode(v: Vectors) -> list[str]:
    """Strings; likeness lanes take as many bytes as the largest one needs."""
    out = []
    for dense, signed in zip(v[0], v[1].view(np.int32), strict=True):
        size = int(max(signed.max(), -(signed.min() + 1)))
        width = 1 if size < 1 << 7 else 2 if size < 1 << 15 else 4
        out.append(f"{width}" + base64.b64encode(dense.astype("<u8").tobytes() + signed.astype(f"<i{width}").tobytes()).decode())
    return out


def decode(fingerprints: list[str]) -> Vectors:
    dense, sparse = np.zeros((len(fingerprints), EQUALITY), np.uint64), np.zeros((len(fingerprints), LIKENESS), np.uint32)
    for i, f in enumerate(fingerprints):
        raw = base64.b64decode(f[1:])
        dense[i] = np.frombuffer(raw[: EQUALITY * 8], "<u8")
        sparse[i] = np.frombuffer(raw[EQUALITY * 8 :], f"<i{f[0]}").astype(np.int32).view(np.uint32)
    return dense, sparse


def fingerprint(text: str | None) -> str:
    return encode(vectors([text]))[0]


def combine(one: str, other: str, sign: int = 1) -> str:
    """Fingerprint of both documents' paragraphs together; sign -1 takes the other's away."""
    (a, b), (c, d) = decode([one]), decode([other])
    return encode((a + c, b + d) if sign > 0 else (a - c, b - d))[0]


def insert(fp: str, paragraph: str) -> str:
    return combine(fp, fingerprint(paragraph))


def delete(fp: str, paragraph: str) -> str:
    return combine(fp, fingerprint(paragraph), -1)


def likeness(a: Vectors, b: Vectors) -> np.ndarray:
    """0 to 1 per row: 1 for equal fingerprints, else the cosine of the likeness lanes, negative ones as 0."""
    x, y = a[1].view(np.int32).astype(np.float64), b[1].view(np.int32).astype(np.float64)
    size = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cosine = np.clip((x * y).sum(axis=1) / np.maximum(size, 1e-300), 0, 1)
    return np.where((a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1), 1.0, np.where(size > 0, cosine, 0.0))


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) plus ``fingerprint``; a null text counts as empty."""
    from .common import annotate

    prepare(docs.sparkSession)
    fields = T.StructType([T.StructField("fingerprint", T.StringType())])
    return annotate(docs, text_col, lambda: lambda texts: [pa.array(encode(vectors(texts)), pa.string())], fields, keep if keep is not None else docs.columns)


def with_next(docs: DataFrame, id_col: str, columns: list[str], ranges: int | None = None) -> DataFrame:
    """Rows dealt by id ranges, sorted by descending id within each, for a streaming look at the next row.

    Returns hq_range, hq_ghost, hq_id and ``columns``.  Every range ends with a
    ghost: the first row of the next lower range (of the highest, after the
    lowest).  Only range bounds and one id per range reach the driver.
    """
    spark = docs.sparkSession
    lowest = -(2**63)
    ids = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(lowest))
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(ids.alias("hq_id"), *[F.col(f"`{c}`") for c in columns])
    found = own.approxQuantile("hq_id", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
    bounds = np.unique(np.array(found, np.float64)).astype(np.int64) if found else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def range_of(x):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, x.to_numpy(), side="right").astype(np.int32))

    heads = {r[0]: r[1] for r in own.select(range_of("hq_id").alias("r"), "hq_id").groupBy("r").agg(F.max("hq_id")).collect()}
    order = sorted(heads)
    ghost_of = {heads[r]: order[(i + 1) % len(order)] for i, r in enumerate(order)}  # the range above, cyclically

    @F.pandas_udf("array<int>")
    def ranges_of(x):
        import pandas as pd

        places = np.searchsorted(bounds, x.to_numpy(), side="right")
        return pd.Series([[int(r)] if i not in ghost_of else [int(r), -1 - ghost_of[i]] for r, i in zip(places, x.tolist(), strict=True)])

    rows = own.withColumn("hq_place", F.explode(ranges_of("hq_id")))
    place = F.col("hq_place")
    rows = rows.select(F.when(place < 0, -1 - place).otherwise(place).alias("hq_range"), (place < 0).alias("hq_ghost"), "hq_id", *[F.col(f"`{c}`") for c in columns])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "hq_range").sortWithinPartitions("hq_range", "hq_ghost", F.col("hq_id").desc(), *[F.col(f"`{c}`") for c in columns])


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses.

    The edited text has the last third of the code points (rounded down)
    replaced by the first as many of the next document by descending id; the
    last document is followed by the first.  Null texts count as empty; a null
    id sorts last; equal ids are ordered by text.  A document that is alone is
    its own next one.  An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [f.split()[0] for f in schema.split(", ")]
    rows = with_next(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")), "id", ["text", "id"])

    def run(batches):
        pending: list[tuple] = []
        for batch in batches:
            rows = pending + list(zip(*(batch.column(c).to_pylist() for c in ("hq_range", "hq_ghost", "id", "text")), strict=True))
            pending = rows[-1:]
            yield from measure(rows)

    def measure(rows):
        pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1] and a[0] == b[0]]
        for at in range(0, len(pairs), 256):
            part = pairs[at : at + 256]
            texts, nexts = [a[3] for a, _ in part], [b[3] for _, b in part]
            cuts = [len(t) // 3 for t in texts]
            edited = [t[: len(t) - c] + n[:c] for t, n, c in zip(texts, nexts, cuts, strict=True)]
            own, changed = vectors(texts), vectors(edited)
            following = [i + 1 if i + 1 < len(part) and part[i + 1][0] is part[i][1] else -1 for i in range(len(part))]
            alone = [i for i, f in enumerate(following) if f < 0]
            rest = vectors([nexts[i] for i in alone])
            after = tuple(np.empty_like(v) for v in own)
            for k in range(2):
                after[k][[i for i in range(len(part)) if following[i] >= 0]] = own[k][[f for f in following if f >= 0]]
                after[k][alone] = rest[k]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[2] for a, _ in part], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
                    pa.array(encode(own)),
                    pa.array(encode(changed)),
                    pa.array(likeness(own, changed)),
                    pa.array(likeness(own, after)),
                ],
                names=names,
            )

    return rows.mapInArrow(run, schema)


def op3_multiset_fingerprint(spark, sf_dir: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
