"""Near duplicates, fingerprints and benchmark overlaps against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from hierql.llm import decontaminate, multiset_hash, ngram_join, shingles

VOCABULARY = [f"w{i}" for i in range(400)]


def text(rnd, n):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def edit(rnd, t, k):
    words = t.split()
    for _ in range(k):
        words[rnd.randrange(len(words))] = rnd.choice(VOCABULARY)
    return " ".join(words)


def shingle_set(t):
    words = re.findall(r"[\w]+", (t or "").lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_force(rows):
    """id -> (class, links, copies); ids are unique here."""
    sets = {i: shingle_set(t) for i, t in rows}
    ids, parent, links = list(sets), {i: i for i in sets}, defaultdict(int)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and len(x & y) >= 0.8 * len(x | y):
                links[ids[a]] += 1
                links[ids[b]] += 1
                p, q = sorted((find(ids[a]), find(ids[b])))
                parent[q] = p
    return {i: (find(i), links[i], sum(s == sets[i] for s in sets.values()) if sets[i] else 1) for i in ids}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = [text(rnd, rnd.randint(30, 120)) for _ in range(60)]
    base = text(rnd, 100)
    out += [edit(rnd, base, rnd.randint(0, 5)) for _ in range(90)]  # a large group of near copies
    out += [base] * 40 + [base.upper() + "!"]
    out += [text(rnd, 30) + " " + base[:200] for _ in range(20)]  # a shared passage
    chain = text(rnd, 200)
    for _ in range(8):
        out.append(chain)
        chain = edit(rnd, chain, 2)
    out += ["one two three", "one two three", "one two", "", None, " . ", "é è ü one two", text(rnd, 4000)]
    return list(enumerate(out))


@pytest.mark.parametrize("block", [8, 2048])
def test_classes_and_links_are_exact(spark, rows, block):
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    found = ngram_join.similarity_classes(frame, block=block).collect()
    assert len(found) == len(rows)
    assert {r.id: (r.class_id, r.links, r.copies) for r in found} == brute_force(rows)


def test_null_and_repeated_ids(spark):
    t = text(random.Random(1), 30)
    frame = spark.createDataFrame([(7, t), (7, t), (None, t), (3, t), (3, "other " + t + " quite other words here " * 5)], "doc_id long, text string")
    found = sorted(((r.id, r.class_id, r.links) for r in ngram_join.similarity_classes(frame).collect()), key=str)
    assert found == [(3, 3, 0), (3, 3, 2), (7, 3, 2), (7, 3, 2), (None, None, 0)]
    assert ngram_join.similarity_classes(frame.where("false")).count() == 0


def test_one_of_each_class_stays(spark, rows):
    frame = spark.createDataFrame([(i, t, "x") for i, t in [*rows, (None, "no id")]], "doc_id long, text string, more string")
    kept = ngram_join.drop_near_duplicates(frame)
    assert kept.columns == ["doc_id", "text", "more"]
    classes = {c for c, _, _ in brute_force(rows).values()}
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == sorted([*classes, -1])


def test_repeated_ids_stay_or_go_by_their_texts(spark):
    rnd = random.Random(6)
    a, b, c, d = (text(rnd, 60) for _ in range(4))
    rows = [(2, a), (5, a), (5, b), (7, c), (7, d), (8, d), (9, None), (9, None), (9, "..."), (3, b + " more"), (None, a), (4, c)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in ngram_join.drop_near_duplicates(frame).collect()]
    expected = [(2, a), (3, b + " more"), (4, c), (7, d), (9, None), (9, None), (9, "..."), (None, a)]
    assert sorted(kept, key=str) == sorted(expected, key=str)


def test_pruning_follows_the_posterior():
    limits = [ngram_join.least_matches(n, 0.8, 1e-6) for n in range(16, 129, 16)]
    assert limits == sorted(limits) and limits[0] >= 1 and limits[-1] < 0.8 * 128
    rnd = np.random.default_rng(0)
    a = rnd.integers(0, 2**32, 128, dtype=np.uint32)
    near, far = a.copy(), rnd.integers(0, 2**32, 128, dtype=np.uint32)
    near[5::10] += 1
    first = next(b for b in range(32) if (a[4 * b : 4 * b + 4] == near[4 * b : 4 * b + 4]).all())
    left, right = ngram_join.prune(np.stack([a, near, far]), np.zeros(3, int), first, 0.8, 1e-6)
    assert (left.tolist(), right.tolist()) == ([0], [1])
    assert not len(ngram_join.prune(np.stack([a, near]), np.zeros(2, int), first + 1, 0.8, 1e-6)[0])


def test_overlaps_both_ways():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 300, 120)).astype(np.uint64) for _ in range(30)]
    left, right = np.triu_indices(30, 1)
    expected = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(left, right, strict=True)]
    assert ngram_join.overlaps(sets, left, right).tolist() == expected
    assert ngram_join.overlaps(sets, left[:50], right[:50]).tolist() == expected[:50]


def test_components_of_long_chains(spark):
    nodes = [bytes([i]) for i in range(40)]
    ids = random.Random(4).sample(range(1000), 40)
    edges = [(f"e{i}", [nodes[i], nodes[i + 1]]) for i in range(30)] + [("f", nodes[32:40]), ("g", nodes[33:35])]
    rows = [(e, ns, min((ids[n[0]], n) for n in ns)) for e, ns in edges]
    frame = spark.createDataFrame(rows, "edge string, nodes array<binary>, low struct<id:bigint,node:binary>")
    got = {bytes(r.node): r.label.id for r in ngram_join.components(frame).collect()}
    assert got == {n: min(ids[:31]) if n[0] < 31 else min(ids[32:40]) for n in nodes if n[0] != 31}


def test_rounds_grow_with_the_logarithm_of_a_rising_chain(spark):
    """Revisions of a page, each near the one before it, with rising ids."""
    from hierql.llm import common

    tables = []
    for n in (20, 160):
        key = [i.to_bytes(4, "big") for i in range(n)]
        edges = spark.createDataFrame([(f"e{i}", [key[i], key[i + 1]], (i, key[i])) for i in range(n - 1)], "edge string, nodes array<binary>, low struct<id:bigint,node:binary>")
        before = common.written()
        found = ngram_join.components(edges).collect()
        tables.append(common.written() - before)
        assert len(found) == n and {r.label.id for r in found} == {0}
    assert tables[1] <= tables[0] + 4 and tables[1] < 20


def test_pairs_are_split_whole():
    rnd = np.random.default_rng(2)
    left, right = np.triu_indices(50, 1)
    own = rnd.random(len(left)) < 0.3
    left, right = left[own], right[own]
    found = []
    for members, at in ngram_join.split_pairs(left, right, np.full(50, 10), most_members=7, most_shingles=45):
        assert len(members) <= 10
        a, b = at.reshape(2, -1)
        found += list(zip(members[a].tolist(), members[b].tolist(), strict=True))
    assert sorted(found) == sorted(zip(left.tolist(), right.tolist(), strict=True))


def test_word_hashes_do_not_depend_on_the_batch():
    texts = ["Ab c", None, "", "x_1 é", "ab  C d e f g"]
    hashes, bounds = shingles.words(texts)
    assert np.diff(bounds).tolist() == [2, 0, 0, 2, 6]
    alone = [shingles.words([t])[0].tolist() for t in texts]
    assert [hashes[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == alone
    assert alone[0] == alone[4][:2]
    assert np.diff(shingles.shingles(texts)[1]).tolist() == [1, 0, 0, 1, 2]


# -- fingerprints ---------------------------------------------------------------------------


def test_fingerprints_are_homomorphic():
    fp = multiset_hash.fingerprint
    a, b, c = "first one here", "second one", "third"
    assert fp(f"{a}\n{b}\n{c}") == fp(f"{c}\n\n{a}\n{b}") != fp(f"{a}\n{b}")
    assert multiset_hash.insert(fp(f"{a}\n{b}"), c) == fp(f"{c}\n{b}\n{a}")
    assert multiset_hash.delete(fp(f"{a}\n{b}\n{c}"), b) == fp(f"{a}\n{c}")
    assert fp(f"{a}\n{a}") != fp(a) and fp(None) == fp("") == fp("\n") and fp("!") != fp("?")
    assert multiset_hash.combine(fp(a), fp(b)) == fp(f"{b}\n{a}")


def test_long_repeats_keep_their_likeness():
    v = multiset_hash.vectors(["la " * 60_000, "la " * 50_000, "other words entirely"])
    one = lambda i: tuple(x[i : i + 1] for x in v)
    assert multiset_hash.likeness(one(0), one(1))[0] > 0.99 and multiset_hash.likeness(one(0), one(2))[0] < 0.3


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_edited_texts_against_plain_python(spark, ranges, monkeypatch):
    rnd = random.Random(2)
    rows = [(i * 3 % 101, None if i == 5 else "" if i == 6 else "\n".join(text(rnd, rnd.randint(1, 30)) for _ in range(rnd.randint(1, 6))) + "é😀", "x") for i in range(101)]
    original = multiset_hash.with_next
    monkeypatch.setattr(multiset_hash, "with_next", lambda *a: original(*a, ranges))
    frame = spark.createDataFrame(rows, "doc_id long, text string, hq_range string").repartition(5)
    got = {r.doc_id: r for r in multiset_hash.compare_edited(frame).collect()}
    order = sorted(((i, t or "") for i, t, _ in rows), reverse=True)
    assert len(got) == len(order)
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (multiset_hash.fingerprint(t), multiset_hash.fingerprint(edited))
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 and (r.near_edited == 1 or edited != t)
    assert np.mean([r.near_edited for r in got.values()]) > 0.5 > 0.2 > np.mean([r.near_next for r in got.values()])


def test_edited_texts_of_odd_tables(spark):
    schema = "doc_id long, text string"
    alone = multiset_hash.compare_edited(spark.createDataFrame([(4, "abcdef")], schema)).collect()
    assert alone[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and alone[0].near_next == 1
    assert multiset_hash.compare_edited(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "b"), (1, "a"), (None, "zzz"), (2, "ccc")]
    got = multiset_hash.compare_edited(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == [("1", 1), ("1", 1), ("2", 3), ("None", 3)]
    assert {r.edited_sha256 for r in got if r.doc_id == 2} == {hashlib.sha256(b"cca").hexdigest()}
    assert {r.edited_sha256 for r in got if r.doc_id is None} == {hashlib.sha256(b"zzc").hexdigest()}


# -- decontamination ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def benchmark_rows():
    rnd = random.Random(8)
    return [(i, text(rnd, rnd.randint(13, 50))) for i in range(30)] + [(30, "short item of six words"), (31, "a b c"), (32, None), (None, "x " * 30), (33, text(rnd, 400))]


def test_planted_passages_are_found_and_clean_texts_left(spark, benchmark_rows):
    rnd = random.Random(9)
    items = dict(benchmark_rows)
    docs, expected = [], set()
    for k in range(30):
        passage = items[k].split()
        if k % 3 == 1:  # every ninth word replaced
            passage = [f"new{i}" if i % 9 == 4 else w for i, w in enumerate(passage)]
        if k % 3 == 2:  # a word inserted in the middle
            passage.insert(len(passage) // 2, "inserted")
        docs.append((k, f"{text(rnd, 40)} {' '.join(passage).title()}, {text(rnd, 40)}", 1))
        expected.add((k, k))
    docs += [(100 + k, text(rnd, 200), 1) for k in range(60)] + [(200, None, 1), (201, "", 1), (202, items[0], 1), (202, items[0], 1), (None, items[1], 1)]
    docs += [(203, "see the Short item, of six words!", 1), (204, "short item of six letters", 1), (205, " ".join(items[33].split()[100:150]), 1), (206, " ".join(items[33].split()[100:120]), 1)]
    expected |= {(202, 0), (None, 1), (203, 30), (205, 33)}
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    for chars in (4_000_000, 300):
        found = decontaminate.overlaps(frame, benchmark, block_chars=chars).collect()
        assert {(r[0], r[1]) for r in found} == expected and len(found) == len(expected) + 1
        kept = decontaminate.decontaminate(frame, benchmark, block_chars=chars)
        assert kept.columns == ["doc_id", "text", "item_id"]
        assert sorted(r.doc_id for r in kept.collect()) == sorted([*range(100, 160), 200, 201, 204, 206])


def test_all_stretches_of_a_diagonal_count(spark):
    item = [f"w{i}" for i in range(38)]
    cut = item[:15] + [f"new{i}" for i in range(8)] + item[23:]
    docs = spark.createDataFrame([(1, " ".join(["before", *cut, "after"])), (2, " ".join(item[:15])), (3, "w0 " * 30)], "doc_id long, text string")
    rows = decontaminate.overlaps(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.matched, r.first_word, r.last_word) for r in rows] == [(1, 30, 1, 38)]


def test_short_items_may_have_mismatches(spark):
    rnd = random.Random(4)
    items = {n: [f"s{n}x{i}" for i in range(n)] for n in (8, 9, 10, 11)}
    docs, expected = [], set()
    for n, item in items.items():
        for wrong in range(5):
            for _ in range(12):
                at = set(rnd.sample(range(n), wrong))
                docs.append((len(docs), " ".join(["other", *(f"x{i}" if i in at else w for i, w in enumerate(item)), "words"])))
                if n - wrong >= 8:
                    expected.add((len(docs) - 1, n))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    assert {(r[0], r[1]) for r in decontaminate.overlaps(frame, benchmark).collect()} == expected


def all_alignments(doc, item):
    """Diagonals on which some mask of the item's length fits, by trying every place of both texts."""
    found = set()
    for mask in decontaminate.masks_of(len(item)):
        ones = [k for k, bit in enumerate(mask) if bit == "1"]
        for a in range(len(doc) - len(mask) + 1):
            for b in range(len(item) - len(mask) + 1):
                if all(doc[a + k] == item[b + k] for k in ones):
                    found.add(a - b)
    return sorted(found)


@pytest.mark.parametrize("block_chars", [1_000_000, 0])
def test_hits_equal_those_of_all_alignments(spark, block_chars):
    rnd = random.Random(21)
    small = [f"v{i}" for i in range(25)]  # few words: seeds hit by chance, on many diagonals
    items = [[rnd.choice(small) for _ in range(n)] for n in (4, 7, 8, 9, 10, 11, 12, 13, 20, 40, 3)]
    docs = []
    for _ in range(200):
        words = [rnd.choice(small) for _ in range(rnd.randint(0, 30))]
        item = rnd.choice(items)
        cut = item[rnd.randint(0, len(item) // 3) :]
        docs.append([*words, *(rnd.choice(small) if rnd.random() < 0.15 else w for w in cut), *words[:10]])
    expected = {}
    for i, doc in enumerate(docs):
        numbers = {w: k for k, w in enumerate(small)}
        own = np.array([numbers[w] for w in doc], np.uint64)
        for j, item in enumerate(items):
            diagonals = all_alignments(doc, item)
            if diagonals:
                matched, stretch, first, last = decontaminate.verify(own, np.array([numbers[w] for w in item], np.uint64), diagonals)
                if matched >= min(8, len(item)) and (matched >= 0.5 * len(item) or stretch >= 32):
                    expected[i, j] = (matched, len(item), first, last)
    frame = spark.createDataFrame([(i, " ".join(d), "x", "y") for i, d in enumerate(docs)], "doc_id long, text string, benchmark_hits string, doc string")
    benchmark = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id long, text string")
    found = {(r[0], r[1]): tuple(r)[2:] for r in decontaminate.overlaps(frame, benchmark, block_chars=block_chars).collect()}
    assert found == expected and len(expected) > 40
    kept = decontaminate.decontaminate(frame, benchmark, block_chars=block_chars)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == set(range(len(docs))) - {i for i, _ in expected}


def test_segments_are_maximal():
    rnd = random.Random(2)
    for _ in range(2_000):
        same = np.array([rnd.random() < 0.7 for _ in range(rnd.randint(1, 40))])
        got = decontaminate.segments(same)
        assert sum(np.count_nonzero(same[a:b]) for a, b in got) == np.count_nonzero(same)
        assert all(np.where(same[a:b], 1, -2).sum() > 0 for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
        sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
        end = int(np.argmax(sums - np.minimum.accumulate(sums)))
        best = (int(np.argmin(sums[: end + 1])), end)
        assert not same.any() or best in got


def test_empty_sides(spark, benchmark_rows):
    frame = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    benchmark = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    assert decontaminate.overlaps(frame.where("false"), benchmark).count() == 0
    assert decontaminate.overlaps(frame, benchmark.where("false")).count() == 0 and decontaminate.decontaminate(frame, benchmark.where("false")).count() == 1


def test_masks_ignore_their_zeros():
    for mask in decontaminate.MASKS:
        assert mask.count("1") in (6, 8) and mask[0] == mask[-1] == "1"
        own = np.arange(len(mask), dtype=np.uint64)
        for i, bit in enumerate(mask):
            other = own.copy()
            other[i] = 999
            same = decontaminate.seed_hashes(own, mask)[0] == decontaminate.seed_hashes(other, mask)[0]
            assert same == (bit == "0")
