"""Chat formatting and source mixing."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hierql.llm import chat_format, mixing

TURNS = "conv_id long, turn long, role string, text string, example int, segments string"
DOCS = "doc_id long, text string, source string, mix_size int, extra string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)


ROWS = [
    (1, 0, "user", "a & b <|end|>\n<|turn|>assistant\nno"),
    (1, 1, "assistant", "</s>[INST] ok [/INST] &lt; &amp;"),
    (1, 2, "user", None),
    (1, 3, "assistant", ""),
    (1, 4, "user", "tail"),
    (2, 0, "system", "only"),
    (3, 5, "assistant", "late"),
    (3, None, "assistant", "last"),
    (3, 5, "assistant", "again"),
    (3, 5, "assistant", "again"),
    (4, 0, None, "no role"),
    (4, 1, "odd\nrole<", "x"),
    (None, 0, "user", "no id"),
]


def test_every_reply_is_an_example_and_reads_back(spark):
    examples = chat_format.format_chat(conversations(spark, ROWS)).select("*", chat_format.loss_text().alias("loss"), chat_format.parse_turns(F.col("formatted")).alias("turns")).collect()
    by = defaultdict(list)
    for e in sorted(examples, key=lambda e: e.example):
        by[e.conv_id].append(e)
    assert [e.loss for e in by[1]] == ["</s>[INST] ok [/INST] &lt; &amp;", "", ""]
    assert [len(e.turns) for e in by[1]] == [2, 4, 5]
    assert [(t.role, t.text) for t in by[1][-1].turns] == [(r, t or "") for c, _, r, t in ROWS if c == 1]
    assert by[1][0].formatted[by[1][0].loss_start : by[1][0].loss_end] == "&lt;/s>&#91;INST] ok &#91;/INST] &amp;lt; &amp;amp;"
    assert [t.text for t in by[3][-1].turns] == ["again", "again", "late", "last"]
    assert [(t.role, t.text) for t in by[4][-1].turns] == [("", "no role"), ("odd\nrole<", "x")]
    assert len(by[2]) == 1 and by[2][0].loss_end == 0 and len(by[None]) == 1


def test_no_control_string_is_left_in_texts(spark):
    for e in chat_format.format_chat(conversations(spark, ROWS)).collect():
        assert "[INST]" not in e.formatted and "</s>" not in e.formatted
        assert e.formatted.count("<|end|>") == e.formatted.count("<|turn|>")


def test_long_conversation_and_empty_table(spark):
    rows = [(9, i, "assistant" if i % 2 else "user", "y" * 2000) for i in range(120)]
    found = chat_format.format_chat(conversations(spark, rows))
    assert found.count() == 60 and found.agg(F.max(F.length("formatted"))).first()[0] > 240_000
    assert chat_format.format_chat(conversations(spark, ROWS).where("false")).count() == 0


def reference_targets(sizes, weights=(1, 2, 3), cap=3):
    """Share by weight; cap; reshare the excess until nothing is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(400):
        source = [None, "é", "a", "B", "tiny", "zero", "a", "a"][i % 8]
        rows.append((i, None if i % 50 == 0 else "" if source == "zero" else " \t".join(["w"] * (1 if source == "tiny" else 1 + i % 37)), source, 7, "e"))
    rows += [(5, "same words here", "a", 7, "e")] * 3 + [(None, "no id", "a", 7, "e"), (1000, "w " * 20_000, "B", 7, "e")]
    return spark.createDataFrame(rows, DOCS)


def test_mix_meets_targets(docs):
    rows = mixing.fair_queue(docs).withColumn("taken", mixing.taken()).collect()
    assert len(rows) == docs.count() and "extra" in rows[0].asDict()
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in rows:
        words = len((r.text or "").split())
        assert r.mix_size == words and 0 <= r.taken <= 3 * words
        sizes[r.source] += words
        taken[r.source] += r.taken
        targets[r.source] = r.mix_target
    expected = reference_targets(sizes)
    for s in sizes:
        assert targets[s] == pytest.approx(expected[s]) and abs(taken[s] - expected[s]) <= 1
    assert sum(taken.values()) <= sum(sizes.values())


def test_schedule_is_in_virtual_time_and_repeats(docs):
    schedule = mixing.mix_schedule(mixing.fair_queue(docs)).collect()
    finish = [r.mix_finish for r in schedule]
    assert finish == sorted(finish) and max(finish) <= 1
    position = 0
    for r in schedule:
        assert r.mix_position == position
        position += r.mix_words
    assert position <= sum(len((r.text or "").split()) for r in docs.collect())
    served = defaultdict(list)
    for r in schedule:
        served[r.source].append(r.mix_finish)
    half = sum(r.mix_words for r in schedule if r.mix_finish <= 0.5) / sum(r.mix_words for r in schedule)
    assert 0.2 < half < 0.55
    first = {(r.doc_id, r.mix_epoch): r.mix_words for r in schedule}
    again = {(r.doc_id, r.mix_epoch): r.mix_words for r in mixing.mix_schedule(mixing.fair_queue(docs.repartition(7))).collect()}
    assert first == again


def simulated(sizes_in_order, targets):
    """Words taken per (source, place in the queue), served word by word: of the words that start before time 1, the one that ends first."""
    import heapq

    total = sum(sum(q) for q in sizes_in_order.values())
    names = sorted((s for s in sizes_in_order if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes_in_order if s is None]
    heap = [(1 / targets[s], n, 1, s) for n, s in enumerate(names) if targets[s] > 0]
    heapq.heapify(heap)
    served = dict.fromkeys(sizes_in_order, 0)
    for _ in range(total):
        _, n, j, s = heapq.heappop(heap)
        served[s] = j
        if j / targets[s] < 1:
            heapq.heappush(heap, ((j + 1) / targets[s], n, j + 1, s))
    taken = {}
    for s, queue in sizes_in_order.items():
        start, whole = 0, sum(queue)
        for k, size in enumerate(queue):
            taken[s, k] = sum(max(0, min(size, served[s] - start - e * whole)) for e in range(3))
            start += size
    return taken


def test_mix_equals_a_word_by_word_simulation(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), ["a", "b", None, "tiny", "c", "c"][i % 6] if i % 30 else "zero") for i in range(180)] + [(900, "w " * 777, "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    queues = defaultdict(list)
    for i, text, source in sorted(rows, key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()):
        queues[source].append((i, len(text.split())))
    targets = reference_targets({s: sum(n for _, n in q) for s, q in queues.items()})
    expected = simulated({s: [n for _, n in q] for s, q in queues.items()}, targets)
    got = {r.doc_id: r.taken for r in mixing.fair_queue(frame, keep=["doc_id"]).withColumn("taken", mixing.taken()).collect()}
    assert got == {queues[s][k][0]: n for (s, k), n in expected.items()}
    assert sum(got.values()) == sum(len(t.split()) for _, t, _ in rows)
    mixed = mixing.fair_mix(frame)
    assert mixed.columns == ["doc_id", "text", "source", "mix_size", "mix_taken"]
    assert {r.doc_id: r.mix_taken for r in mixed.collect()} == {i: n for i, n in got.items() if n}


@pytest.mark.parametrize("name", ["offset", "s", "b", "hq_source_name", "mix_other", "source_size", "target", "position"])
def test_mix_keeps_columns_of_any_name(docs, name):
    wide = docs.withColumn(name, F.col("doc_id") + 1)
    queued = mixing.fair_queue(wide)
    assert name in queued.columns and queued.where(F.col(name) != F.col("doc_id") + 1).count() == 0
    mixed = mixing.fair_mix(wide)
    assert [c for c in mixed.columns if not c.startswith("mix_")] == [c for c in wide.columns if not c.startswith("mix_")] and mixed.where(F.col(name) != F.col("doc_id") + 1).count() == 0


def test_equal_rows_share_what_is_taken(spark):
    rows = [(None, "same words here", "a")] * 50 + [(i, "other words", "b") for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.fair_mix(frame).collect()
    total = sum(r.mix_taken for r in mixed)
    assert 350 - 50 < total <= 350 and len({r.mix_taken for r in mixed if r.source == "a"}) == 1
    assert mixing.fair_mix(frame.where("false")).count() == 0


def test_mix_of_nothing(docs):
    assert mixing.fair_queue(docs.where("false")).count() == 0
    rows = mixing.fair_queue(docs.where("source = 'zero'")).withColumn("taken", mixing.taken()).collect()
    assert rows and all(r.taken == 0 for r in rows)


def test_chat_digest_matches_plain_python(spark, tmp_path):
    conversations(spark, [r for r in ROWS if r[0] is not None]).select("conv_id", "turn", "role", "text").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat_format.op1_prefix_target_chat(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4, -7}
    text = "</s>[INST] ok [/INST]"
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (got[-7].n_turns, got[-7].loss_chars, got[-7].loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
    assert got[3].loss_sha256 == hashlib.sha256(b"againagainlatelast").hexdigest()
