"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a fixed pseudo-random order, served
again from its start when it ends, ``max_repeats`` times at most.  A document's
virtual finish time is the number of its source's words served up to its end,
divided by the source's target.  A document may be served if it starts before
virtual time 1; of one that lies across it, the words that end by then, the word
in service then, and the rest are packets of their own, so the rest never starts
in time.  All packets are range-sorted by finish time, their words added up in
that order, and the mix is cut at the total budget, to the word.

Only DataFrame functions are used.  Running totals, of the queues and of the
schedule, are taken in two steps: rows are range-partitioned, and totals of
partitions give the total before each, so no source has to fit in a task and the
number of ranges grows with the input.  Texts are read once; what is sorted is
sizes and ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import materialize, word_count


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(source, source_size) -> + weight, place, budget, target: one row per source.

    Sources in code-point order, null last, take the weights in turn.  Targets
    share the total of all sizes by weight, at most ``max_repeats`` times the
    source's size; what a source cannot take goes to the others by weight.  With the
    sources sorted by the ratio at which they reach their bound, the bounded
    ones are a prefix, so one pass finds the level of the rest.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.orderBy("ratio").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("weight", turn.cast("double"))
        .withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("rank", F.row_number().over(by_ratio))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("free", F.when(F.col("cap") > F.col("weight") * F.col("level"), F.struct("rank", "level")))
        .withColumn("level", F.min("free").over(everything)["level"])
        .select("source", "source_size", "weight", F.row_number().over(by_name).alias("place"), F.col("total").cast("long").alias("budget"), F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("level"))).alias("target"))
    )


def running(rows: DataFrame, by: list[str], order: list[str], words: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``words`` before them, per ``by``, in an order, as column ``name``.

    Rows are range-partitioned and written; sums of (by, partition) give what
    lies before a partition, a window what lies before a row within it.
    """
    parts = materialize(rows.repartitionByRange(*by, *order).withColumn("hq_part", F.spark_partition_id()), f"running-{name}")
    sums = parts.groupBy(*by, "hq_part").agg(F.sum(words).alias("hq_sum"))
    before = W.partitionBy(*by).orderBy("hq_part").rowsBetween(W.unboundedPreceding, -1)  # a row per partition
    offsets = materialize(sums.select(*by, "hq_part", F.coalesce(F.sum("hq_sum").over(before), F.lit(0)).alias("hq_offset")), f"offsets-{name}")
    within = W.partitionBy(*by, "hq_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    found = parts.withColumn("hq_within", F.coalesce(F.sum(words).over(within), F.lit(0))).join(offsets, [*by, "hq_part"])
    return found.withColumn(name, F.col("hq_offset") + F.col("hq_within")).drop("hq_part", "hq_within", "hq_offset")


def keyed(docs: DataFrame, keep: list[str], id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """(hq_row, hq_source, hq_size, hq_order, hq_tie): kept columns in a struct, and what the queue needs of a row."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("hq_none")).alias("hq_row"),
        F.col(f"`{source_col}`").alias("hq_source"),
        word_count(f"`{text_col}`").alias("hq_size"),
        order.alias("hq_order"),
        F.xxhash64(f"`{text_col}`").alias("hq_tie"),
    )


def queue(docs: DataFrame, keep: list[str], id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], max_repeats: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their source's target and the words before them, words that the mix takes of each source)."""
    rows = materialize(keyed(docs, keep, id_col, text_col, source_col, seed), "sized")
    sizes = rows.groupBy(F.col("hq_source").alias("source")).agg(F.sum("hq_size").alias("source_size"))
    names = {"source": "hq_name", "source_size": "hq_source_size", "target": "hq_target", "place": "hq_place", "budget": "hq_budget"}
    targets = materialize(source_targets(sizes, weights, max_repeats).withColumnsRenamed(names).drop("weight"), "targets")
    rows = rows.join(targets, rows.hq_source.eqNullSafe(targets.hq_name)).drop("hq_name")
    rows = materialize(running(rows, ["hq_place"], ["hq_order", "hq_tie", "hq_size"], "hq_size", "hq_start"), "queue")
    schedule = running(packets(rows, max_repeats), [], ["finish", "hq_place", "begin"], "words", "position")
    left = F.col("hq_budget") - F.col("position")
    served = schedule.where(left > 0).groupBy("hq_place").agg(F.sum(F.least("words", left)).alias("hq_served"))
    return rows, materialize(targets.join(served, "hq_place", "left").na.fill(0, ["hq_served"]), "served")


def packets(rows: DataFrame, max_repeats: int) -> DataFrame:
    """(hq_place, hq_budget, begin, words, finish): the packets that may be served."""
    target = F.col("hq_target")

    def of_pass(epoch: int) -> list[Column]:
        begin = F.lit(epoch) * F.col("hq_source_size") + F.col("hq_start")
        whole = F.greatest(F.least(F.col("hq_size"), F.floor(target) - begin), F.lit(0))  # words that end by virtual time 1
        eligible = F.greatest(F.least(F.col("hq_size"), F.ceil(target) - begin), F.lit(0))  # words that start before it
        made = [(begin, whole), (begin + whole, eligible - whole)]
        return [F.struct(b.cast("long").alias("begin"), w.cast("long").alias("words"), F.try_divide(b + w, target).alias("finish")) for b, w in made]

    found = F.filter(F.array(*[p for e in range(max_repeats) for p in of_pass(e)]), lambda p: p["words"] > 0)
    return rows.select("hq_place", "hq_budget", F.inline(found))


def fair_queue(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    max_repeats: int = 3,
    seed: str = "mix",
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` columns (default: all) with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_items``.

    ``mix_items`` lists the passes that the mix takes of a document: struct(epoch,
    words, finish), where finish is 1 at most, as the budget ends then.  Null or
    empty texts have size 0 and no item.  A null source is a source of its own;
    rows with a null or repeated id are kept, each with its own share (equal rows
    are interchangeable; they alone share a range).  An empty table gives an empty
    result.  Only columns of ``docs`` with the names of new ones are replaced.
    """
    new = ("mix_size", "mix_source_size", "mix_target", "mix_items")
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in new]
    rows, served = queue(docs, keep, id_col, text_col, source_col, weights, max_repeats, seed)
    rows = rows.join(served.select("hq_place", "hq_served"), "hq_place")

    def taken_of(epoch: int) -> Column:
        begin = F.lit(epoch) * F.col("hq_source_size") + F.col("hq_start")
        words = F.greatest(F.lit(0), F.least(F.col("hq_size"), F.col("hq_served") - begin)).cast("long")
        return F.struct(F.lit(epoch).alias("epoch"), words.alias("words"), F.least(F.lit(1.0), F.try_divide(begin + words, F.col("hq_target"))).alias("finish"))

    items = F.filter(F.array(*[taken_of(e) for e in range(max_repeats)]), lambda x: x["words"] > 0)
    return rows.select(*[F.col(f"hq_row.`{c}`") for c in keep], F.col("hq_size").alias("mix_size"), F.col("hq_source_size").alias("mix_source_size"), F.col("hq_target").alias("mix_target"), items.alias("mix_items"))


def taken() -> Column:
    """Words of the document in the mix, repeats counted."""
    return F.aggregate("mix_items", F.lit(0).cast("long"), lambda total, item: total + item["words"])


def fair_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """Rows of ``docs`` in the mix with ``mix_size`` and ``mix_taken``, words that the mix takes of them.

    The rows are those of ``fair_queue`` with an item.  Of each source, the queue's
    place where its service ends decides for all its rows, so texts are not
    moved.  Equal rows at that place share what is taken of them evenly, rounded down.
    """
    rows, served = queue(docs, [], id_col, text_col, source_col, weights, max_repeats, seed)
    rest = F.pmod(F.col("hq_served"), F.col("hq_source_size"))
    ends = served.where("hq_source_size > 0").select("hq_place", "hq_name", F.floor(F.col("hq_served") / F.col("hq_source_size")).alias("hq_passes"), rest.alias("hq_rest"))
    place = ["hq_place", "hq_order", "hq_tie"]
    at = rows.join(ends, "hq_place").where("hq_start <= hq_rest AND hq_rest < hq_start + hq_size").select(*place, "hq_name", "hq_passes", "hq_rest")
    part = F.floor((F.first("hq_rest") - F.min("hq_start")) / F.count(F.lit(1)))
    cuts = rows.select(*place, "hq_start").join(at, place).groupBy(*place).agg(*[F.first(c).alias(c) for c in ("hq_name", "hq_passes")], part.alias("hq_part"))
    cuts = materialize(cuts.select("hq_name", "hq_passes", "hq_part", F.col("hq_order").alias("hq_cut"), F.col("hq_tie").alias("hq_cut_tie")), "cuts")  # a row per source
    keep = [c for c in docs.columns if c not in ("mix_size", "mix_taken")]
    found = keyed(docs, keep, id_col, text_col, source_col, seed)
    found = found.join(cuts, found.hq_source.eqNullSafe(cuts.hq_name))
    same = F.col("hq_order") == F.col("hq_cut")
    more = F.when((F.col("hq_order") < F.col("hq_cut")) | same & (F.col("hq_tie") < F.col("hq_cut_tie")), F.col("hq_size")).when(same & (F.col("hq_tie") == F.col("hq_cut_tie")), F.col("hq_part")).otherwise(0)
    found = found.withColumn("mix_taken", F.col("hq_size") * F.col("hq_passes") + more).where("mix_taken > 0")
    return found.select(*[F.col(f"hq_row.`{c}`") for c in keep], F.col("hq_size").alias("mix_size"), F.col("mix_taken").cast("long").alias("mix_taken"))


def mix_schedule(queued: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: one row per pass over a document, range-sorted by virtual finish time.

    ``mix_position`` is the number of words before it in the mix, which ends at
    the total budget.
    """
    keep = [c for c in queued.columns if c != "mix_items"]
    rows = queued.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("hq_row"), F.col(f"`{id_col}`").alias("hq_id"), F.inline("mix_items").alias("mix_epoch", "mix_words", "mix_finish"))
    found = running(rows, [], ["mix_finish", "hq_id", "mix_epoch"], "mix_words", "mix_position")
    new = ("mix_epoch", "mix_words", "mix_finish", "mix_position")
    return found.select(*[F.col(f"hq_row.`{c}`") for c in keep if c not in new], *new).orderBy("mix_position")


def op6_weighted_fair_mix(spark, sf_dir: str) -> DataFrame:
    queued = fair_queue(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return queued.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken().alias("taken"), F.get("mix_items", F.lit(0))["finish"].alias("finish"))


OP6_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS o
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE * 3 AS cap,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS weight
  FROM docs GROUP BY source
), levels AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS rank,
    ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources
), targets AS (
  SELECT source, source_size, CASE WHEN f.level IS NULL THEN cap ELSE least(cap, weight * f.level) END AS target
  FROM levels, (SELECT arg_min(level, rank) FILTER (cap > weight * level) AS level FROM levels) f
), served AS (
  SELECT source, source_size, target, floor(target)::BIGINT + CASE WHEN ceil(target) > floor(target)
    AND row_number() OVER (ORDER BY CASE WHEN ceil(target) > floor(target) THEN (floor(target) + 1) / target END NULLS LAST, source ASC NULLS LAST)
      <= sum(source_size) OVER () - sum(floor(target)::BIGINT) OVER () THEN 1 ELSE 0 END AS served
  FROM targets
), queued AS (
  SELECT d.*, t.source_size, t.target, t.served,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM docs d JOIN served t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, served - start)) + greatest(0, least(size, served - start - source_size)) + greatest(0, least(size, served - start - 2 * source_size)))::BIGINT AS taken,
  CASE WHEN size > 0 AND served > start THEN least(1.0::DOUBLE, (start + least(size, served - start))::DOUBLE / target) END AS finish
FROM queued
"""
