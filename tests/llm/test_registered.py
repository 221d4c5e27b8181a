"""The subpackage's registered queries on the small tables, and the pipeline."""

import os
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from hierql.llm import decontaminate, language_id, ngram_join, toxicity
from hierql.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 11)) and set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_match_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for file in os.listdir(DATA):
        c.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    relation = c.sql(SQL[name])
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(x) for x in columns]
    assert sorted(tuple(plain(r[x]) for x in columns) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in order) for r in relation.fetchall())


def test_models_on_the_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = QUERIES["op5_language_id"](spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == docs.count() and sum(r.lang == r.lang_pred for r in found) > 0.97 * len(found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    scores = {r.doc_id: r for r in QUERIES["op4_toxicity"](spark, DATA).collect()}
    assert len(scores) == docs.count() and all(r.predicted == (r.score >= 0.7) for r in scores.values())


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "ngram_jaccard", "decontamination", "mixing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if name != "mixing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        assert kept <= set(before) and after.count() == len(kept)
        gone = set(before) - kept
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
            assert gone == {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
        elif name == "language_id":
            assert gone == {r.doc_id for r in language_id.identify(docs, language_id.fit(docs)).where("rejected").collect()} and len(gone) < 3
        elif name == "ngram_jaccard":
            assert kept == {r.class_id for r in ngram_join.similarity_classes(docs).collect()}
        elif name == "decontamination":
            benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
            assert gone == {r.doc_id for r in decontaminate.overlaps(docs, benchmark).collect()}
            items = [" ".join(r.text.split()) for r in benchmark.collect()]
            assert gone >= {i for i, r in before.items() if any(x in " ".join(r.text.split()) for x in items)}
        else:
            sizes = {i: len(r.text.split()) for i, r in before.items()}
            assert all(r.size == sizes[r.doc_id] and 0 < r.taken <= 3 * r.size for r in after.collect())
            assert abs(after.agg(F.sum("taken")).first()[0] - sum(sizes.values())) <= 40
        docs, before = after, {r.doc_id: r for r in after.collect()}


def test_run_applies_all_stages(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


@pytest.mark.parametrize("k", range(5))
def test_stages_of_empty_and_odd_tables(spark, k):
    """Nulls everywhere, repeated rows and columns named like the models' results."""
    name, stage = corpus_pipeline.STAGES[k]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    wide = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("score", "predicted", "lang_pred", "entropy", "rejected", "benchmark_hits", "item_id", "class_id", "s", "b")})
    extra = wide.where("doc_id = 1")
    odd = [extra.withColumns({c: F.lit(None).cast(docs.schema[c].dataType) for c in columns}) for columns in (docs.columns, ["text"], ["doc_id"], ["lang", "source"])]
    for o in [*odd, extra, extra.withColumn("text", F.lit("")), extra.withColumns({"doc_id": F.lit(-5).cast("long"), "text": F.lit("very long " * 30_000)})]:
        wide = wide.unionByName(o)
    out = stage(spark, wide, DATA)
    assert [c for c in out.columns if c not in ("size", "taken")] == wide.columns
    rows = out.collect()
    kept = [r for r in rows if r.doc_id is not None and r.doc_id > 1]
    assert kept and all(r.score == f"score{r.doc_id}" and r.rejected == f"rejected{r.doc_id}" and r.item_id == f"item_id{r.doc_id}" for r in kept)
    if name in ("toxicity", "decontamination"):
        assert sum(r.text is None for r in rows) == 2 and any(r.text == "" for r in rows)
    elif name in ("language_id", "mixing"):
        assert all(r.text for r in rows)
    else:
        assert sum(r.doc_id is None for r in rows) == 2 and sum(r.text == "" for r in rows) == 1
    empty = stage(spark, wide.where("false"), DATA)
    assert empty.count() == 0 and empty.columns == out.columns


def test_stages_delete_what_they_leave_behind(spark):
    from hierql.llm import common

    before = common.written()
    corpus_pipeline.run(spark, DATA).count()
    assert common.written() - before < 16  # the last stage's tables and its input
