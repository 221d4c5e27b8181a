"""Language identification and toxicity: round trips, held-out accuracy, odd inputs."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hierql.llm import charlm, common, language_id, toxicity
from hierql.llm.common import fold_of

SYLLABLES = {"aa": "th an er on re he in ed nd ha".split(), "bb": "ción os ar as ñ ll ue que mi ga".split(), "cc": "ß ung ver keit lich sch zu be ge ü".split()}
BAD = "idiot moron stupid trash clown".split()


def sentence(rnd, lang, n=40):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        lang = ["aa", "bb", "cc"][i % 3]
        text = sentence(rnd, lang, 3 if i % 20 == 0 else 40)
        toxic = i % 7 == 0
        if toxic:
            words = text.split()
            for _ in range(2):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
            text = " ".join(words)
        rows.append((i, text, None if i % 25 == 0 else lang, int(toxic), "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, label int, score string")


ODD = [(9000, None), (9001, ""), (9002, " \n "), (9003, "12 %% !"), (9004, "😀 ١٢"), (9005, "x" * 200_000), (None, "that there"), (9006, "a\u0000b c")]


def odd(spark, docs):
    return spark.createDataFrame([(i, t, None, None, "x") for i, t in ODD], docs.schema)


def test_model_is_a_distribution():
    tokens = ["banana", "bandana", "ana"]
    symbols, token = charlm.predictions(tokens)
    assert (np.bincount(token) == [7, 8, 4]).all()
    unique, counts = np.unique(symbols, axis=0, return_counts=True)
    model = charlm.build(np.zeros(len(unique), np.int64), unique, counts, ["x"])
    alphabet = np.unique(symbols[:, 0])
    for context in unique[:, 1:]:
        rows = np.array([[s, *context] for s in alphabet], np.uint32)
        unseen = np.array([[0x4E00, *context]], np.uint32)
        total = np.exp(model.score(rows)).sum() + np.exp(model.score(unseen)).sum()
        assert total == pytest.approx(1, abs=1e-4)


def test_model_matches_direct_kneser_ney():
    """The stored probabilities are those of the recursive definition."""
    symbols, _ = charlm.predictions("the then there hat that tha".split())
    unique, counts = np.unique(symbols, axis=0, return_counts=True)
    model = charlm.build(np.zeros(len(unique), np.int64), unique, counts, ["x"])
    tables = {5: {tuple(u): c for u, c in zip(unique.tolist(), counts.tolist(), strict=True)}}
    for n in (4, 3, 2, 1):
        tables[n] = {}
        for g in tables[n + 1]:
            tables[n][g[:n]] = tables[n].get(g[:n], 0) + 1

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / (len(np.unique(unique[:, 0])) + 1)
        own = {h: c for h, c in tables[n].items() if h[1:] == g[1:]}
        if not own:
            return p(g[:-1])
        d = charlm._discount(np.array(list(tables[n].values())))
        total = sum(own.values())
        return max(own.get(g, 0) - d, 0) / total + d * len(own) / total * p(g[:-1])

    probe = np.array([*unique.tolist(), [ord("z"), *unique[0][1:].tolist()], [ord("t"), ord("q"), 0, 0, 0], [1, ord("a"), ord("h"), ord("w"), 0]], np.uint32)
    expected = [np.log(p(tuple(g))) for g in probe.tolist()]
    assert model.score(probe)[:, 0] == pytest.approx(expected, abs=1e-4)


def test_no_ngram_is_lost_to_another():
    rng = np.random.default_rng(3)
    symbols = np.unique(rng.integers(0x4E00, 0x9000, (60_000, 5)).astype(np.uint32), axis=0)
    model = charlm.build(np.zeros(len(symbols), np.int64), symbols, np.ones(len(symbols), np.int64), ["x"])
    assert len(model.grams[4]) == len(symbols) and len(model.contexts[4]) == len(np.unique(symbols[:, 1:], axis=0))
    foreign = rng.integers(0xAC00, 0xD000, (200_000, 5)).astype(np.uint32)
    assert not model.lookup(model.grams[4], charlm.gram_hashes(foreign)[0][4])[1].any()


def test_slices_change_nothing(monkeypatch):
    tokens = ["ab", "x" * 50, "it's", "42", "über", "ab", "y"] * 3
    symbols, owner = charlm.predictions(tokens)
    unique, counts = charlm.distinct(symbols, np.ones(len(symbols), int))
    model = charlm.build(np.zeros(len(unique), int), unique, counts, ["g"])
    whole = model.score_tokens(tokens)
    monkeypatch.setattr(charlm, "SLICE", 7)
    runs = list(charlm.slices(tokens))
    assert len(runs) > 5 and [i for a, b in runs for i in range(a, b)] == list(range(len(tokens)))
    assert list(charlm.slices([])) == []
    for a, b in zip(model.score_tokens(tokens), whole, strict=True):
        assert np.allclose(a, b, rtol=1e-5)
    rows, counts = np.zeros((0, charlm.ORDER), np.uint32), np.zeros(0, np.int64)
    for a, b in runs:
        more, _ = charlm.predictions(tokens[a:b])
        rows, counts = charlm.distinct(np.concatenate([rows, more]), np.concatenate([counts, np.ones(len(more), np.int64)]))
    assert dict(zip(map(tuple, rows.tolist()), counts.tolist(), strict=True)) == Counter(map(tuple, symbols.tolist()))


def test_languages_of_held_out_texts(docs):
    model = language_id.fit(docs)
    rows = language_id.identify(docs, model).collect()
    assert len(rows) == 600 and "text" in rows[0].asDict()
    assert model.chars.groups == ["aa", "bb", "cc"] and max(len(k) for k in model.chars.grams) <= 1 << model.chars.hash_bits
    held = [r for r in rows if fold_of(r.doc_id) == 1 and r.lang]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and not any(r.rejected for r in rows)


def test_calibration_rows_are_learned_too(spark, docs):
    aside = [i for i in range(1_000, 20_000) if zlib.crc32(str(i).encode()) % 30 == 0 and fold_of(i) != 1][:2]
    rows = [(i, "съешь ещё этих мягких французских булок да выпей чаю", "dd", 0, "x") for i in aside]
    both = docs.union(spark.createDataFrame(rows, docs.schema))
    model = language_id.fit(both)
    assert model.chars.groups == ["aa", "bb", "cc", "dd"] and len(model.mean) == len(model.reach) == 4
    probe = spark.createDataFrame([(1, "ещё мягких булок", None, None, "x")], docs.schema)
    row = language_id.identify(probe, model).first()
    assert row.lang_pred == "dd" and not row.rejected
    parts = [charlm.gather(both.where(c), "text", "lang") for c in ("doc_id % 2 = 0", "doc_id % 2 = 1")]
    whole, summed = charlm.gather(both, "text", "lang"), parts[0].plus(parts[1])
    assert all((getattr(whole, n) == getattr(summed, n)).all() for n in ("owner", "symbols", "counts"))
    only = language_id.fit(spark.createDataFrame(rows, docs.schema))
    assert only.chars.groups == ["dd"] and not language_id.identify(probe, only).first().rejected


def test_texts_are_rejected_in_small_tables_too(spark, docs):
    small = docs.where("doc_id < 40")  # about nine learnable rows a language
    model = language_id.fit(small)
    assert np.isfinite(model.mean).all() and np.isfinite(model.reach).all()
    foreign = spark.createDataFrame([(1, "съешь ещё этих мягких французских булок да выпей чаю " * 20, None, None, "x"), (2, "zxq qzx wqk xkz vvq " * 60, None, None, "x")], docs.schema)
    assert all(r.rejected and r.lang_pred in ("aa", "bb", "cc") for r in language_id.identify(foreign, model).collect())
    assert not any(r.rejected for r in language_id.identify(docs, model, prefix="p_").where("p_rejected").select(F.col("p_rejected").alias("rejected")).collect())


def test_repeated_ids_and_single_halves(spark, docs):
    learnable = next(i for i in range(1_000, 9_000) if fold_of(i) != 1)
    one = spark.createDataFrame([(learnable, "that there", "aa", 0, "x")] * 3, docs.schema)
    model = language_id.fit(one)
    assert model.chars.groups == ["aa"] and np.isinf(model.mean).all()
    assert not language_id.identify(one, model).where("rejected").count()
    assert language_id.fit(docs.union(one.withColumn("doc_id", F.lit(3).cast("long")))).chars.groups == ["aa", "bb", "cc"]


def test_all_training_rows_calibrate(spark):
    rnd = random.Random(11)
    pool = {lang: [sentence(rnd, lang, rnd.randint(1, 12)) for _ in range(40)] for lang in SYLLABLES}
    learned = [i for i in range(31_000) if fold_of(i) != 1]
    assert len(learned) > 20_000
    last = max(learned, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    rows = [(i, "zxq qzx wqk xkz vvq " * 30 if i == last else pool[lang][i % 40], lang) for i in range(31_000) for lang in [["aa", "aa", "aa", "bb", "cc"][i % 5]]]
    before = common.written()
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert common.written() == before

    half = {i: zlib.crc32(str(i).encode()) // 3 % 2 for i in learned}
    truth, entropy, sizes = [], [], []
    for h in (0, 1):
        other = [(t, g) for i, t, g in rows if half.get(i) == 1 - h]
        chars = charlm.gather(spark.createDataFrame(other, "text string, lang string"), "text", "lang").model()
        own = [(t, g) for i, t, g in rows if half.get(i) == h]
        e, n = language_id.LanguageModel(chars, f"half {h}").entropies([t for t, _ in own])
        truth, entropy, sizes = truth + ["aa bb cc".split().index(g) for _, g in own], [*entropy, e], [*sizes, n]
    truth, entropy, sizes = np.array(truth), np.concatenate(entropy), np.concatenate(sizes)
    at = np.arange(len(truth))
    assert len(at) == len(learned) and (sizes > 0).all()
    loss = [-np.log(np.maximum(language_id.posteriors(entropy, sizes, t)[at, truth], 1e-12)).mean() + 1e-3 * np.log(t) ** 2 for t in np.geomspace(0.1, 30, 25)]
    assert model.temperature == np.geomspace(0.1, 30, 25)[np.argmin(loss)]
    own = entropy[at, truth]
    assert model.mean.tolist() == [np.median(own[truth == g]) for g in range(3)]
    deviation = 1.5 * (own - model.mean[truth]) * np.sqrt(np.minimum(sizes, 400))
    reach = [max(20.0, deviation[truth == g].max()) for g in range(3)]
    assert np.allclose(model.reach, reach, rtol=1e-12) and max(reach) > 60


def test_medians_of_any_doubles(spark):
    rnd = random.Random(3)
    values = {"odd": [rnd.gauss(0, 3) for _ in range(301)], "even": [rnd.random() for _ in range(300)], "equal": [1.5] * 7, "two": [-0.0, 2.0], "one": [-7.25], "close": [1 + k * 2.0**-52 for k in range(9)], "": [0.0, -1e-300, 1e300, 4.0]}
    rows = [(g, v, int(language_id.ordered_bits(np.array([v]))[0])) for g, own in values.items() for v in own]
    table = spark.createDataFrame(rows, "lang string, own double, key long").repartition(5)
    assert language_id.medians(table, {g: len(own) for g, own in values.items()}) == {g: float(np.median(own)) for g, own in values.items()}


def test_odd_texts_and_foreign_ones(spark, docs):
    model = language_id.fit(docs)
    rows = {r.doc_id: r for r in language_id.identify(odd(spark, docs), model).collect()}
    assert len(rows) == len(ODD)
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 and rows[i].rejected for i in (9000, 9001, 9002, 9003, 9004))
    assert rows[9005].lang_pred in model.chars.groups and rows[None].lang_pred == "aa"
    foreign = spark.createDataFrame([(1, "съешь ещё этих мягких французских булок да выпей чаю " * 20, None, None, "x")], docs.schema)
    model.mean, model.reach = np.full(3, 1.5), np.full(3, 20.0)
    assert language_id.identify(foreign, model).first().rejected


def test_no_language_to_learn(docs):
    empty = docs.where("false")
    assert language_id.fit(empty) is None
    row = language_id.identify(docs.limit(1), None, keep=["doc_id"]).first()
    assert (row.lang_pred, row.score, row.rejected) == ("und", 0.0, True)
    assert language_id.identify(empty, None).count() == 0


@pytest.fixture(scope="module")
def toxic(docs):
    return toxicity.fit(docs, docs.select("doc_id", F.col("label").alias("toxic")).union(docs.select("doc_id", F.col("label").alias("toxic")).limit(5)))


def test_held_out_toxicity(docs, toxic):
    rows = [r for r in toxicity.score(docs, toxic).collect() if fold_of(r.doc_id) == 1]
    assert np.mean([r.predicted == r.label for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


@pytest.mark.parametrize("spelling", ["1d10t", "i.d.i.o.t", "i d i o t", "iiidiooot", "m0r0n", "$tup1d", "s-t-u-p-i-d", "tra$h", "CL0WN!!", "(idiot)"])
def test_obfuscated_words_score_like_plain_ones(spark, toxic, spelling):
    rnd = random.Random(1)
    clean = sentence(rnd, "aa")
    rows = [(1, clean), (2, f"{clean} {spelling} {clean} {spelling}"), (3, f"{clean} {clean}")]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), toxic).collect()}
    assert got[2] > 0.7 > got[1] and got[3] < 0.5


def test_decoder_leaves_single_readings_alone(toxic):
    decode = toxicity.Decoder(toxic.chars)
    assert decode.words("thander") == ["thander"] and decode.words("...") == [] and decode.words("2024") == []
    assert decode.words("x" * 100 + "1") == ["x" * 100]
    assert toxicity.spelled_out("a b the i d i o t now x".split()) == ["i d i o t"]


def test_decoder_forgets_between_words(toxic):
    decode = toxicity.Decoder(toxic.chars)
    assert decode.words("1d10t") == ["idiot"]
    decode.known.update((str(i), 0.0) for i in range(60_001))
    assert decode.words("1d10t") == ["idiot"] and len(decode.known) < 60_000


def test_decoder_finds_the_best_of_all_paths(toxic):
    """Viterbi search against every path through random lattices."""
    from itertools import product

    decode, rnd = toxicity.Decoder(toxic.chars), random.Random(12)

    def log(reading):
        total, context = 0.0, "\0" * 4
        for c in reading + " ":
            if c != " " or context[0] != "\0":
                symbols = charlm.code_points((chr(charlm.END) if c == " " else c) + context).reshape(1, -1)
                total += float(toxic.chars.score(symbols)[0, 0])
            context = "\0" * 4 if c == " " else (c + context)[:4]
        return total

    logs = {}
    for _ in range(150):
        word = "".join(rnd.choice("idot1053$.- x%") * rnd.choice([1, 1, 1, 2, 3, 9]) for _ in range(rnd.randint(1, 6)))
        paths = {}
        for path in product(*decode.lattice(word)):
            reading, cost = "".join(o + o[-1:] * more for o, _, more in path), sum(c for _, c, _ in path)
            if reading not in logs:
                logs[reading] = log(reading)
            paths[reading] = max(paths.get(reading, -np.inf), logs[reading] - cost)
        best = max(paths.values())
        assert paths[decode.read(word).removesuffix(" ")] == pytest.approx(best, abs=1e-3), word


def test_repeated_ids_and_long_texts_are_learned_once(spark, docs):
    marks = docs.select("doc_id", F.col("label").alias("toxic"))
    long = spark.createDataFrame([(i, "that there " * 30_000, None, 0, "x") for i in (1, 2, 3)], docs.schema)
    once, again = toxicity.fit(docs, marks), toxicity.fit(docs.union(docs), marks)
    assert once.weights.keys() == again.weights.keys() and once.bias == pytest.approx(again.bias)
    assert len(toxicity.fit(docs.union(long), marks, kept_features=5).weights) <= 5


def test_decoder_reads_words_of_any_length(toxic):
    decode = toxicity.Decoder(toxic.chars)
    assert decode.words("s" + "t" * 60 + "upid") == ["stupid"]
    assert decode.words("i.d.i.o.t." + "-".join("moron" * 12)).count("moron") >= 10
    assert toxicity.spelled_out(list("stupid" * 9)) == [" ".join("stupid" * 9)]
    assert "idiot" in decode.words(toxicity.spelled_out(list("m o r o n c l o w n s t u p i d t r a s h i d i o t".split()))[0])
    assert len("".join(decode.words("m.0.r.o.n." * 2_000))) > 9_000


def test_decoder_reads_doubled_letters_and_words_of_symbols(toxic):
    decode = toxicity.Decoder(toxic.chars)
    assert decode.words("iiddiioott") == ["idiot"] and decode.words("ssttuuppiidd") == ["stupid"]
    symbols, _ = charlm.predictions(["asshole", "bitch", "shoe", "chat", "hose"] * 3)
    unique, counts = np.unique(symbols, axis=0, return_counts=True)
    decode = toxicity.Decoder(charlm.build(np.zeros(len(unique), np.int64), unique, counts, ["x"]))
    assert decode.words("8!7(#") == ["bitch"] and decode.words("455#013") == ["asshole"]
    assert toxicity.Decoder(toxic.chars).words("2024") == []


def test_odd_texts_have_scores(spark, docs, toxic):
    rows = toxicity.score(odd(spark, docs), toxic).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)


def test_nothing_to_learn_from(docs):
    model = toxicity.fit(docs, docs.select("doc_id", F.lit(0).alias("toxic")))
    assert all(r.score == pytest.approx(1 / (1 + np.exp(3.0))) for r in toxicity.score(docs.limit(20), model).collect())
    model = toxicity.fit(docs.where("false"), docs.where("false").select("doc_id", F.col("label").alias("toxic")))
    assert toxicity.score(docs.limit(3), model).count() == 3 and toxicity.score(docs.where("false"), model).count() == 0
