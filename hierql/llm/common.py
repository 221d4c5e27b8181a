"""Shared helpers: shared storage, Arrow batch bounds, fold rule, hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition used by every size in this package.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share, read from ``spark.checkpoint.dir``.

    Only where the session has none and runs on one machine (tests) a local one
    is set; on a cluster that is an error, as executors would not share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current.rsplit("/", 1)[0]
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="hierql-")
        spark.sparkContext.setCheckpointDir(root)
        return root
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_WRITTEN: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there.

    The written table stays for as long as a result may be read from it; see
    ``written`` and ``remove_materialized``.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables this process has written and not deleted."""
    return len(_WRITTEN)


def remove_materialized(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables written after the first ``since``, but not the last ``keep``.

    What was not stored by then, and reads them, is lost.
    """
    for place in _WRITTEN[since : len(_WRITTEN) - keep]:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.remove(place)


_SHIPPED: set[str] = set()


def prepare(spark: SparkSession, rows: int = 256) -> None:
    """Send this package to the executors, and bound the rows of an Arrow batch.

    Workers import the package from the archive; with few rows in a batch, long
    texts fit in a worker's memory.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        archive = Path(os.path.realpath(tempfile.mkdtemp(prefix="hierql-package-"))) / "hierql.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(column: str | Column) -> Column:
    """Number of maximal runs of non-space characters; null counts as 0."""
    return F.regexp_count(text_or_empty(column), F.lit(WORD_PATTERN)).cast("long")


def fold(column: str | Column) -> Column:
    """crc32 of the id's decimal text, mod 3; a null id falls in fold 1."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(column.cast("string")) % 3, F.lit(1))


def fold_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 3


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (wraps modulo 2**64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def release_memory() -> None:
    """Give what a worker has freed back to the system, where that can be asked for: workers outlive their tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_MODELS: dict[str, object] = {}


def cached(name: str, make):
    """What a worker keeps between tasks, under the model's name; one model at a time."""
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = make()
    return _MODELS[name]


def forget_models() -> None:
    """Drop what a worker keeps of a model, where other work begins."""
    if _MODELS:
        _MODELS.clear()
        release_memory()


def bounded_rows(rows: DataFrame, bound: int, id_col: str = "id") -> DataFrame:
    """At most ``bound`` rows, of the first ids by md5; an id whose rows would go beyond the bound is passed over.

    Ids are counted, texts stay where they are: at most ``bound`` ids come to the
    driver and are broadcast.
    """
    counts = rows.groupBy(id_col).count().orderBy(F.md5(F.col(id_col).cast("string").cast("binary"))).limit(bound).collect()
    taken, total = [], 0
    for r in counts:
        if total + r["count"] <= bound:
            taken.append((r[id_col],))
            total += r["count"]
    ids = rows.sparkSession.createDataFrame(taken, rows.select(id_col).schema)
    return rows.join(F.broadcast(ids), id_col)


def prefixed(fields, prefix: str):
    """Fields with a prefix before their names."""
    from pyspark.sql import types as T

    return T.StructType([T.StructField(prefix + f.name, f.dataType, f.nullable) for f in fields.fields])


def annotate(docs: DataFrame, text_col: str, make, fields, keep: list[str]) -> DataFrame:
    """``keep`` columns plus ``fields``, which ``make()(texts)`` computes for a batch.

    ``make`` runs once per task; it gets lists of texts (None for null) and
    returns one Arrow array per field.  Kept columns that a field's name clashes
    with are replaced.
    """
    from pyspark.sql import types as T

    keep = [c for c in keep if c not in fields.fieldNames()]
    schema = T.StructType([docs.schema[c] for c in keep] + fields.fields)
    names = schema.fieldNames()

    def run(batches):
        import pyarrow as pa

        score = make()
        for batch in batches:
            columns = score(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + columns, names=names)
        release_memory()

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("hq_text")).mapInArrow(run, schema)
