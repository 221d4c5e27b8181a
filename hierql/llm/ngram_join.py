"""Similarity self-join of documents on word shingles, with Bayesian pruning.

1. Every text becomes a set of hashed five-word shingles and 128 MinHash values.
   Documents with equal sets form a class; from here on a class is one node.
2. Nodes that agree in one of 32 bands of four values are candidates (a pair of
   similarity 0.8 escapes all bands with probability 5e-8).  Buckets are cut
   into blocks of a bounded size, and pairs of blocks become groups, so no
   bucket has to fit in a task; equal groups from several bands become one.
3. Within a group, pairs are compared 16 MinHash values at a time and dropped
   once the posterior probability of reaching the threshold is below the
   tolerance.  A pair is looked at in the first band it agrees in, only there.
4. Groups in which pairs are left get their members' shingles, and those pairs
   are verified exactly.  Groups report each member's number of links and its
   local component; pairs never become rows.
5. Components are found by passing the smallest id along groups, following what
   was passed to its end by doubling, and contracting groups until nothing
   changes, each round written to the shared folder; rounds grow with the
   logarithm of a chain's length.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, forget_models, materialize, mix64, prepare, remove_materialized, written
from .shingles import WIDTH, min_hashes, set_digest, shingles

HASHES, BANDS, STEP = 128, 32, 16


def least_matches(compared: int, threshold: float, tolerance: float) -> int:
    """Fewest matches among ``compared`` values with P(similarity >= threshold) >= tolerance.

    With a uniform prior the similarity is Beta(m + 1, n - m + 1) distributed,
    so that probability is a binomial sum.
    """
    total, n = 0.0, compared + 1
    for m in range(compared + 1):
        total += comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if total >= tolerance:
            return m
    return compared


def sketch(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, node, size, sketch): node is the digest of the shingle set; null if there is none."""
    schema = "id long, node binary, size long, sketch binary"

    def run(batches):
        forget_models()
        for batch in batches:
            values, bounds = shingles(batch.column(1).to_pylist(), width)
            rows = min_hashes(values, bounds, HASHES)
            nodes, sizes, sketches = [], [], []
            for i in range(len(rows)):
                own = np.unique(values[bounds[i] : bounds[i + 1]])
                sizes.append(len(own))
                nodes.append(set_digest(own) if len(own) else None)
                sketches.append(rows[i].tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], names=["id", "node", "size", "sketch"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id IS NOT NULL")
    return rows.mapInArrow(run, schema)


def band_rows(nodes: DataFrame) -> DataFrame:
    """(key, band, node): one row per node and band."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, HASHES // BANDS).astype(np.uint64)
            keys = np.zeros(values.shape[:2], np.uint64)
            for k in range(values.shape[2]):
                keys = mix64(keys * np.uint64(31) + values[:, :, k])
            keys = mix64(keys + np.arange(BANDS, dtype=np.uint64))
            take = pa.array(np.repeat(np.arange(len(values)), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(values))), ids.take(take)], names=["key", "band", "node"])

    return nodes.select("node", "sketch").mapInArrow(run, "key long, band int, node binary")


def candidate_groups(nodes: DataFrame, block: int) -> DataFrame:
    """(members, band): distinct groups of at most 2 * block members struct(node, side).

    Pairs to compare are those of equal side 0, or of different sides.
    """
    bands = band_rows(nodes)
    sizes = materialize(bands.groupBy("key").count().where("count > 1"), "buckets")
    cut = F.ceil(F.col("count") / block).cast("int")
    rows = bands.join(sizes, "key").withColumn("cut", cut).withColumn("own", F.pmod(F.xxhash64("node"), F.col("cut")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("cut") - 1))
    rows = rows.select("key", "band", "node", "own", other.alias("other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("byte")
    rows = rows.select("key", "band", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), F.struct("node", side.alias("side")).alias("member"))
    cells = rows.groupBy("key", "band", "a", "b").agg(F.array_sort(F.collect_list("member")).alias("members")).where(F.size("members") > 1)
    return cells.groupBy("members").agg(F.min("band").alias("band"))


def tiles(sides: np.ndarray, width: int = 256):
    """All pairs to compare, a bounded number at a time."""
    one, other = (np.flatnonzero(sides == 1), np.flatnonzero(sides == 2)) if sides.any() else (np.arange(len(sides)),) * 2
    for a in range(0, len(one), width):
        for b in range(0 if sides.any() else a, len(other), width):
            left, right = (x.ravel() for x in np.meshgrid(one[a : a + width], other[b : b + width], indexing="ij"))
            if not sides.any() and a == b:
                left, right = left[left < right], right[left < right]
            yield left, right


def prune(sketches: np.ndarray, sides: np.ndarray, band: int, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose first common band is ``band`` and that survive every comparison."""
    width = HASHES // BANDS
    kept = [(np.zeros(0, np.int64),) * 2]
    for left, right in tiles(sides):
        matches = np.zeros(len(left), np.int16)
        for at in range(0, HASHES, STEP):
            equal = sketches[left, at : at + STEP] == sketches[right, at : at + STEP]
            matches += equal.sum(axis=1, dtype=np.int16)
            keep = matches >= least_matches(at + STEP, threshold, tolerance)
            agree = equal.reshape(len(left), STEP // width, width).all(axis=2)
            for k in range(STEP // width):
                if at // width + k < band:
                    keep &= ~agree[:, k]
            left, right, matches = left[keep], right[keep], matches[keep]
            if not len(left):
                break
        kept.append((left, right))
    return np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])


def split_pairs(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, most_members: int = 256, most_shingles: int = 1 << 19):
    """The pairs of a group by pairs of chunks of its members, as (members, left, right) with positions in members.

    A chunk has few members and few shingles, so the sets of two chunks fit in
    memory (a single larger set is a chunk of its own).
    """
    used = np.unique(np.concatenate([left, right]))
    chunk = np.zeros(len(sizes), np.int64)
    now = members = shingles_in = 0
    for u in used:
        if members and (members == most_members or shingles_in + sizes[u] > most_shingles):
            now, members, shingles_in = now + 1, 0, 0
        chunk[u], members, shingles_in = now, members + 1, shingles_in + sizes[u]
    key = np.minimum(chunk[left], chunk[right]) * (now + 1) + np.maximum(chunk[left], chunk[right])
    for k in np.unique(key):
        own = key == k
        there, at = np.unique(np.concatenate([left[own], right[own]]), return_inverse=True)
        yield there, at


def surviving_groups(groups: DataFrame, nodes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(members array<binary>, pairs binary): pairs are uint16 positions in members."""

    def run(batches):
        for batch in batches:
            members, kept = [], []
            for row, band in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row.sort(key=lambda m: m["node"])
                sketches = np.frombuffer(b"".join(m["sketch"] for m in row), np.uint32).reshape(len(row), HASHES)
                left, right = prune(sketches, np.array([m["side"] for m in row]), band, threshold, tolerance)
                if len(left):
                    for used, at in split_pairs(left, right, np.array([m["size"] for m in row])):
                        members.append([row[u]["node"] for u in used])
                        kept.append(at.astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.list_(pa.binary())), pa.array(kept, pa.binary())], names=["members", "pairs"])

    keyed = groups.select(F.xxhash64("members", "band").alias("group"), F.size("members").alias("n"), "band", F.explode("members").alias("m"))
    rows = keyed.select("group", "n", "band", F.col("m.node").alias("node"), F.col("m.side").alias("side")).join(nodes.select("node", "size", "sketch"), "node")
    whole = rows.groupBy("group", "band", "n").agg(F.collect_list(F.struct("node", "side", "size", "sketch")).alias("members"))
    return whole.select("members", "band").mapInArrow(run, "members array<binary>, pairs binary")


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets."""
    if len(left) < 4 * len(sets):
        out = np.zeros(len(left), np.int64)
        for k, (i, j) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
            a, b = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            out[k] = np.count_nonzero(b[at] == a)
        return out
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    total = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        total += part @ part.T
    return total[left, right].astype(np.int64)


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verified_links(survivors: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, threshold: float) -> DataFrame:
    """(edge, nodes, links, low): the local components of every group.

    ``links`` counts what was found for each node, ``low`` is the smallest
    struct(id, node) among them.
    """
    keyed = survivors.select(F.xxhash64("members", "pairs").alias("group"), "members", "pairs")
    wanted = keyed.select(F.explode("members").alias("node")).distinct().join(classes, "node").select("node", "id", "copies")

    def cut(batches):
        for batch in batches:
            values, bounds = shingles(batch.column(2).to_pylist(), width)
            sets = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            right = pa.array([set_digest(s) == node for s, node in zip(sets, batch.column(0).to_pylist(), strict=True)])
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "copies", "id", "shingles"])
            yield out.filter(right)

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sets = texts.join(wanted, "id").select("node", "copies", "text", "id").mapInArrow(cut, "node binary, copies long, id long, shingles binary").dropDuplicates(["node"])
    placed = keyed.select("group", "pairs", F.posexplode("members").alias("at", "node"))
    members = placed.select("group", "at", "node", F.when(F.col("at") == 0, F.col("pairs")).alias("pairs")).join(sets, "node")
    whole = members.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("at", "node", "id", "copies", "shingles"))).alias("members"), F.max("pairs").alias("pairs"))

    def verify(batches):
        for batch in batches:
            edges, nodes, links, low = [], [], [], []
            for group, row, pairs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                left, right = np.frombuffer(pairs, np.uint16).reshape(2, -1).astype(np.int64)
                own = [np.frombuffer(m["shingles"], np.uint64) for m in row]
                sizes, copies = np.array([len(s) for s in own]), np.array([m["copies"] for m in row])
                both = overlaps(own, left, right)
                linked = both >= threshold * (sizes[left] + sizes[right] - both) - 1e-9
                left, right = left[linked], right[linked]
                if not len(left):
                    continue
                degree = np.bincount(left, copies[right], len(row)) + np.bincount(right, copies[left], len(row))
                component = local_components(len(row), left, right)
                for c in np.unique(component[degree > 0]):
                    own = np.flatnonzero((component == c) & (degree > 0))
                    edges.append(f"{group}:{c}")
                    nodes.append([row[i]["node"] for i in own])
                    links.append(degree[own].astype(np.int64))
                    low.append(dict(zip(("id", "node"), min((row[i]["id"], row[i]["node"]) for i in own), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(edges, pa.string()), pa.array(nodes, pa.list_(pa.binary())), pa.array(links, pa.list_(pa.int64())), pa.array(low, pa.struct([("id", pa.int64()), ("node", pa.binary())]))], names=["edge", "nodes", "links", "low"])

    return whole.select("group", "members", "pairs").mapInArrow(verify, "edge string, nodes array<binary>, links array<long>, low struct<id:bigint,node:binary>")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest struct(id, node) of each node's component.

    An edge joins all its nodes; it stays one row, so no edge weighs more than
    another.  Nodes first take the smallest label of their edges.  Then edges are
    contracted to the labels that their nodes have, and those with more than one
    pass the smallest on, and what that label was passed itself, until none is
    left; only labels that change are looked at again.
    """
    first = edges.select("low", F.explode("nodes").alias("node")).groupBy("node").agg(F.min("low").alias("label"))
    labels = materialize(first, "labels")
    members = edges.select("edge", F.explode("nodes").alias("node")).join(labels, "node").select("edge", "label")
    while True:
        open_edges = materialize(members.groupBy("edge").agg(F.collect_set("label").alias("labels")).where(F.size("labels") > 1), "open")
        if not open_edges.take(1):
            return labels
        step = open_edges.select(F.array_min("labels").alias("to"), F.explode("labels").alias("from")).groupBy("from").agg(F.min("to").alias("to"))
        step = followed(materialize(step, "step"))
        moved = F.coalesce("to", "label")
        on = F.col("label.node") == F.col("from.node")
        labels = materialize(labels.join(step, on, "left").select("node", moved.alias("label")), "labels")
        members = open_edges.select("edge", F.explode("labels").alias("label")).join(step, on, "left").select("edge", moved.alias("label"))


def followed(step: DataFrame) -> DataFrame:
    """(from, to) with every ``to`` at the end of its path, which doubling reaches in log steps."""
    while True:
        ahead = step.select(F.col("from.node").alias("at"), F.col("to").alias("further"))
        ahead = step.join(ahead, F.col("to.node") == F.col("at"), "left").select("from", F.coalesce("further", "to").alias("to"), F.coalesce(F.col("further.node") != F.col("to.node"), F.lit(False)).alias("moved"))
        ahead = materialize(ahead, "step")
        step = ahead.drop("moved")
        if not ahead.where("moved").take(1):
            return step


def node_classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, width: int, tolerance: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and (node, class_id, first_node, links, copies): of each set, the smallest (id, node) of its class."""
    spark, start = docs.sparkSession, written()
    prepare(spark)
    sketches = materialize(sketch(docs, id_col, text_col, width), "sketches")
    counted = sketches.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    nodes = materialize(counted, "nodes")
    classes = nodes.select("node", "id", "copies")
    groups = materialize(candidate_groups(nodes, block), "groups")
    survivors = materialize(surviving_groups(groups, nodes, threshold, tolerance), "survivors")
    links = materialize(verified_links(survivors, classes, docs, id_col, text_col, width, threshold), "links")
    counts = links.select(F.explode(F.arrays_zip("nodes", "links")).alias("x")).groupBy("x.nodes").agg(F.sum("x.links").alias("links")).withColumnRenamed("nodes", "node")
    found = components(links.select("edge", "nodes", "low")).join(counts, "node")
    whole = classes.join(found, "node", "left").select(
        "node", F.coalesce("label.id", "id").alias("class_id"), F.coalesce("label.node", "node").alias("first_node"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "copies"
    )
    whole = materialize(whole, "classes")
    remove_materialized(spark, since=start + 1, keep=1)
    return sketches, whole


def similarity_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    width: int = WIDTH,
    tolerance: float = 1e-6,
    block: int = 2048,
) -> DataFrame:
    """(id, class_id, links, copies) for every row of ``docs``, whose ids are integers.

    class_id is the smallest id that a chain of links leads to, links the number
    of other rows whose shingle set has a Jaccard similarity of ``threshold`` or
    more, copies the number of rows with the same set.  Texts that are null or
    without a word are linked to nothing, a text of fewer than ``width`` words
    is one shingle.  Rows with a null id get a null class and no links; repeated
    ids count as rows of their own.  An empty table gives an empty result.  Ids
    that are no integers are refused (by the cast, under ANSI rules).
    """
    sketches, whole = node_classes(docs, id_col, text_col, threshold, width, tolerance, block)
    whole = whole.drop("first_node")
    kept = sketches.where("node IS NOT NULL").select("id", "node").join(whole, "node").select("id", "class_id", "links", "copies")
    single = sketches.where("node IS NULL").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links"), F.lit(1).cast("long").alias("copies"))
    without = docs.where(F.col(f"`{id_col}`").isNull()).select(*[F.lit(None).cast("long").alias(c) for c in ("id", "class_id")], F.lit(0).cast("long").alias("links"), F.lit(1).cast("long").alias("copies"))
    return kept.unionByName(single).unionByName(without)


def with_nodes(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """``docs`` and hq_node, the digest of the row's shingle set (null without a word)."""

    def make():
        def digest(texts):
            values, bounds = shingles(texts, width)
            sets = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            return [pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary())]

        return digest

    return annotate(docs, text_col, make, T.StructType([T.StructField("hq_node", T.BinaryType())]), docs.columns)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = WIDTH, tolerance: float = 1e-6, block: int = 2048) -> DataFrame:
    """Rows of ``docs``, one of each class: one with the class's smallest id and, of its texts, the class's first.

    Rows with a null id and texts without a word are near nothing and stay.  An
    id that occurs twice is two rows, each of which stays or goes by its text.
    """
    from pyspark.sql import Window as W

    _, classes = node_classes(docs, id_col, text_col, threshold, width, tolerance, block)
    first = classes.where("node = first_node").select(F.col("class_id").alias("hq_id"), F.col("node").alias("hq_first"))
    rows = with_nodes(docs.where(F.col(f"`{id_col}`").isNotNull()), text_col, width)
    alone = rows.where("hq_node IS NULL").drop("hq_node")
    own = F.col(f"`{id_col}`").cast("long")
    rows = rows.join(first, (own == F.col("hq_id")) & (F.col("hq_node") == F.col("hq_first")), "left_semi")
    once = W.partitionBy(own, "hq_node").orderBy(own)
    rows = rows.withColumn("hq_row", F.row_number().over(once)).where("hq_row = 1").drop("hq_row", "hq_node")
    return rows.unionByName(alone).unionByName(docs.where(F.col(f"`{id_col}`").isNull()))


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return similarity_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
