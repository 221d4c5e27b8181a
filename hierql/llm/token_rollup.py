"""Token totals kept up to date by signed deltas.

A batch of changes is reduced to signed sums per source, language and tokenizer
version, and committed under the batch's name by one rename in the shared file
system: a batch that was committed before is left as it is, so a repeated
commit changes nothing, and one that failed half-way leaves nothing behind.
Totals are the sums over all committed batches, or over a compacted base and the
batches after it.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, prepare, shared_path, text_or_empty, word_count

KEYS = ("source", "lang", "tokenizer")
SIGNS = {"insert": 1, "delete": -1, "before": -1, "after": 1}
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


def byte_count(column: str) -> Column:
    """Tokens of the byte tokenizer: UTF-8 bytes; null counts as 0."""
    return F.octet_length(text_or_empty(column)).cast("long")


def bpe_counts(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, name: str = "tokens") -> DataFrame:
    """``keep`` columns plus the number of byte-pair tokens of a ranks file; null counts as 0.

    The file (lines of base64 token and rank) is read on the driver and sent to
    the workers, which need no access to its path.
    """
    import base64

    import pyarrow as pa

    prepare(docs.sparkSession)
    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if a}
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def make():
        import tiktoken

        own, split = shared.value
        encoding = tiktoken.Encoding("own", pat_str=split, mergeable_ranks=own, special_tokens={})
        return lambda texts: [pa.array([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], pa.int64())]

    fields = T.StructType([T.StructField(name, T.LongType())])
    return annotate(docs, text_col, make, fields, keep if keep is not None else docs.columns)


def changes(kind: str, docs: DataFrame, tokenizer: str, tokens: Column, source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Change rows (kind, source, lang, tokenizer, tokens) for every row of ``docs``."""
    if kind not in SIGNS:
        raise ValueError(f"unknown kind of change: {kind}")
    return docs.select(F.lit(kind).alias("kind"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), F.lit(tokenizer).alias("tokenizer"), tokens.cast("long").alias("tokens"))


def revisions(docs: DataFrame, tokenizer: str, old: Column, new: Column) -> DataFrame:
    """A revised count: the old one goes, the new one comes."""
    return changes("before", docs, tokenizer, old).unionByName(changes("after", docs, tokenizer, new))


class TokenRollup:
    """Totals under a folder of the shared file system.

    ``batches/<name>`` holds a batch's sums, ``base-<n>`` a compacted base with
    the names that it covers.  Null keys are groups of their own; a null count
    adds a document and no token; groups whose documents and tokens are both 0
    are left out of the totals.  An empty batch commits nothing but its name.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or shared_path(spark, "token-rollup")).rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _publish(self, df: DataFrame, name: str) -> bool:
        """Write aside, then rename onto a name that must be free; False if it was taken."""
        jvm, aside, to = self.spark._jvm, self._path(f"aside/{uuid.uuid4().hex}"), self._path(name)
        df.write.parquet(aside.toString())
        self._fs().mkdirs(to.getParent())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, to, options)
        except Exception:
            self._fs().delete(aside, True)
            if self._fs().exists(to):
                return False
            raise
        return True

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Commit a batch of changes; False, and no change, if it was committed before."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError("a batch name has letters, digits, '_', '-' and '.' only")
        if batch in self._names("batches") or batch in self._covered():
            return False
        sign = F.lit(None).cast("long")
        for kind, s in SIGNS.items():
            sign = F.when(F.col("kind") == kind, s).otherwise(sign)
        sums = rows.groupBy(*KEYS).agg(F.sum(sign).alias("docs"), F.coalesce(F.sum(sign * F.col("tokens")), F.lit(0)).alias("tokens"))
        return self._publish(sums.select(*KEYS, "docs", "tokens"), f"batches/{batch}")

    def _base(self) -> str | None:
        found = [n for n in self._names("") if re.fullmatch(r"base-\d+", n)]
        return max(found, key=lambda n: int(n[5:]), default=None)

    def _covered(self) -> set[str]:
        base = self._base()
        return {r[0] for r in self.spark.read.parquet(f"{self.root}/{base}").where("tokenizer IS NULL AND docs IS NULL").select("source").collect()} if base else set()

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all committed batches."""
        base, covered = self._base(), self._covered()
        return self._sums(base, [n for n in self._names("batches") if n not in covered])

    def _sums(self, base: str | None, names: list[str]) -> DataFrame:
        """Totals of a base and the batches of the given names, whatever is committed meanwhile."""
        found = self.spark.createDataFrame([], DELTA)
        if base:
            found = found.unionByName(self.spark.read.schema(DELTA).parquet(f"{self.root}/{base}").where("docs IS NOT NULL"))
        if names:
            found = found.unionByName(self.spark.read.schema(DELTA).parquet(*[f"{self.root}/batches/{n}" for n in names]))
        return found.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Fold the batches committed by now into a new base; later commits of their names change nothing.

        A batch committed meanwhile is no part of the base and counts beside it.
        What the base replaces stays for readers that began before it; the next
        compaction deletes it.
        """
        base, covered = self._base(), self._covered()
        names = sorted(set(self._names("batches")) - covered)
        old = [f"batches/{n}" for n in sorted(set(self._names("batches")) & covered)]
        old += [n for n in self._names("") if re.fullmatch(r"base-\d+", n) and n != base]
        if names:
            marks = self.spark.createDataFrame([(n, None, None, None, None) for n in sorted({*names, *covered})], DELTA)
            if not self._publish(self._sums(base, names).unionByName(marks), f"base-{int(base[5:]) + 1 if base else 1}"):
                return  # another compaction was first
        for n in old:
            self._fs().delete(self._path(n), True)


#: Texts with this mark are taken down in op10's third batch.
TAKEN_DOWN = "All rights reserved."


def op10_token_rollup(spark, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents.

    All are inserted with a word count estimated from n_chars and an exact byte count; the word counts
    are revised to exact ones; documents with a reserved-rights line are
    deleted; and the first batch comes once more.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source", "n_chars")
    estimate = F.floor(F.coalesce("n_chars", F.lit(0)) / 6)
    rollup = TokenRollup(spark)
    first = changes("insert", docs, "words-1", estimate).unionByName(changes("insert", docs, "bytes-1", byte_count("text")))
    rollup.commit("load", first)
    rollup.commit("recount", revisions(docs, "words-1", estimate, word_count("text")))
    gone = docs.where(F.contains(text_or_empty("text"), F.lit(TAKEN_DOWN)))
    rollup.commit("takedown", changes("delete", gone, "words-1", word_count("text")).unionByName(changes("delete", gone, "bytes-1", byte_count("text"))))
    rollup.commit("load", first)
    return rollup.totals()


OP10_SQL = r"""
WITH kept AS (
  SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_words, strlen(coalesce(text, ''))::BIGINT AS n_bytes
  FROM documents WHERE NOT contains(coalesce(text, ''), 'All rights reserved.')
)
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS docs, sum(n_words)::BIGINT AS tokens FROM kept GROUP BY source, lang
UNION ALL
SELECT source, lang, 'bytes-1', count(*), sum(n_bytes)::BIGINT FROM kept GROUP BY source, lang
"""
