"""WARC archives, URL filters and token totals."""

import os
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from hierql.llm import token_rollup, url_filter, warc

PAGES = "page_id long, url string, html string, digest string"


def pages(spark):
    long = "<p>é" + "x" * 1200
    rows = [(1, "http://a/", long), (2, None, long), (9, "http://b/\r\nX: y", long), (4, "http://c/", "short"), (5, "http://d/", "short"), (6, "http://e/", None), (7, "http://f/", ""), (None, "http://g/", long), (8, "http://h/", "y" * 300_000), (10, "http://i/", "\r\n\r\nWARC/1.1\r\n" * 200)]
    return spark.createDataFrame([(*r, "d") for r in rows], PAGES)


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('warc')}/archive"
    warc.register(spark)
    warc.page_records(pages(spark)).repartition(3).write.format("warc").mode("append").option("file_bytes", 300).save(path)
    return path


def test_archive_reads_back(spark, archive):
    rows = {r.record_id: r for r in warc.read_warc(spark, archive).collect()}
    assert len(rows) == 10
    for p in pages(spark).collect():
        r = rows[f"<urn:page:{p.page_id if p.page_id is not None else ''}>"]
        payload = (p.html or "").encode()
        assert r.payload_length == len(payload) and r.payload_digest == "sha1:" + hashlib.sha1(payload).hexdigest()
        if p.page_id in (1, 2):
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", "<urn:page:9>", None)
        else:
            assert r.record_type == "response" and bytes(r.payload) == payload and r.payload_bytes == len(payload)
    assert rows["<urn:page:2>"].target_uri is None and rows["<urn:page:9>"].target_uri == "http://b/ X: y"
    assert len(warc.list_archives(archive)) > 3


def test_files_of_failed_attempts_are_not_read(spark, archive):
    files, folder = warc.file_system(archive)
    with files.open_output_stream(f"{folder}/lost.warc.gz", compression=None) as out:
        out.write(b"torn")
    assert warc.read_warc(spark, archive, ["record_id"]).count() == 10


def test_predicates_are_pushed_to_headers(spark, archive):
    def ids(*where):
        return sorted(r.record_id for r in warc.read_warc(spark, archive, ["record_id"], list(where)).collect())

    assert ids(("record_type", "=", "revisit")) == ["<urn:page:1>", "<urn:page:2>"]
    assert ids(("payload_length", ">", 200_000)) == ["<urn:page:8>"] and ids(("target_uri", "starts with", "http://d")) == ["<urn:page:5>"]
    assert ids(("target_uri", "is null"), ("record_type", "in", ["revisit", "x"])) == ["<urn:page:2>"]
    assert len(ids(("payload_length", ">=", 1000), ("record_type", "not =", "revisit"), ("target_uri", "ends with", "/"))) == 3
    read = warc.read_warc(spark, archive)
    assert read.where("record_type = 'revisit'").count() == 2
    assert len(read.where("target_uri LIKE 'http://d%' OR payload_length > 200000").collect()) == 2
    with pytest.raises(ValueError):
        warc.read_warc(spark, archive, where=[("payload", "=", b"x")])
    found = []
    reader = warc.PushingReader(read.schema, {"path": archive})
    from pyspark.sql import datasource as ds

    kept = list(reader.pushFilters([ds.EqualTo(("record_type",), "revisit"), ds.EqualTo(("payload_sha1",), "x"), ds.IsNotNull(("target_uri",))]))
    assert len(kept) == 1 and len(reader.filters) == 2
    for part in reader.partitions():
        for batch in reader.read(part):
            found += batch.column(0).to_pylist()
    assert found == ["<urn:page:1>"]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = spark.read.format("warc").option("pushdown", "true").load(archive).where("record_type = 'revisit' AND payload_length < 5000")
        assert pushed.count() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_unwanted_payloads_are_not_decoded(monkeypatch):
    rows = [{"record_id": f"<{i}>", "record_type": "response", "target_uri": "u", "refers_to": None, "payload_digest": "d", "payload_length": 500_000, "payload": bytes([65 + i]) * 500_000} for i in range(3)]
    data = b"".join(warc.member(warc.record(r), 0) for r in rows)  # stored, so that sizes tell what was read

    class Counting(io.BytesIO):
        seen = 0

        def read(self, n=-1):
            out = super().read(n)
            Counting.seen += len(out)
            return out

    found = list(warc.records(Counting(data), lambda h: h["warc-record-id"] == "<2>", True))
    assert len(found) == 1 and found[0][1].endswith(b"C") and Counting.seen < 800_000
    Counting.seen = 0
    assert [h["warc-record-id"] for h, b in warc.records(Counting(data), lambda h: True, False) if b is None] == ["<0>", "<1>", "<2>"] and Counting.seen < 300_000


@pytest.mark.parametrize("form", ["plain", "foreign gzip"])
def test_archives_of_other_writers(form):
    rows = [{"record_id": f"<{i}>", "record_type": "response", "target_uri": "u", "refers_to": None, "payload_digest": "d", "payload_length": 70_000, "payload": bytes([65 + i]) * 70_000} for i in range(3)]
    data = b"".join(warc.record(r) if form == "plain" else gzip.compress(warc.record(r)) for r in rows)
    found = list(warc.records(io.BytesIO(data), lambda h: h["warc-record-id"] != "<1>", True))
    assert [warc.payload_of(h, b) for h, b in found] == [rows[0]["payload"], rows[2]["payload"]]
    folded = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Target-URI: a\r\n b\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    ((head, block),) = warc.records(io.BytesIO(folded), lambda h: True, True)
    assert head["warc-target-uri"] == "a b" and warc.payload_of(head, block) == b"hi"
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"junk"), lambda h: True, True))


@pytest.mark.parametrize("form", ["own", "foreign gzip"])
def test_long_records_are_read_in_proportion(form):
    import random
    import time

    def seconds(size):
        payload = random.Random(1).randbytes(size)
        row = {"record_id": "<1>", "record_type": "response", "target_uri": "u", "refers_to": None, "payload_digest": "d", "payload_length": size, "payload": payload}
        data = warc.member(warc.record(row), 1) if form == "own" else gzip.compress(warc.record(row), 1)
        start = time.perf_counter()
        head, block = next(warc.records(io.BytesIO(data + data), lambda h: True, True))
        assert warc.payload_of(head, block) == payload
        assert sum(1 for _ in warc.records(io.BytesIO(data + data), lambda h: True, False)) == 2
        return time.perf_counter() - start

    seconds(1 << 20)
    assert seconds(64 << 20) < 6


def test_records_have_dates(spark, tmp_path):
    warc.register(spark)
    rows = spark.createDataFrame([(1, "u", "x", "d")], PAGES).withColumn("at", F.timestamp_seconds(F.lit(86_400)))
    warc.page_records(rows, date_col="at").write.format("warc").mode("append").save(str(tmp_path / "dated"))
    assert warc.read_warc(spark, str(tmp_path / "dated"), ["date"]).first().date == "1970-01-02T00:00:00Z"
    warc.page_records(rows).write.format("warc").mode("append").save(str(tmp_path / "now"))
    assert warc.read_warc(spark, str(tmp_path / "now"), ["date"]).first().date > "2024"


def test_pushed_predicates_skip_payloads_in_a_spark_read(spark, tmp_path):
    """Torn payloads are no problem to a read that does not want them."""
    folder = tmp_path / "torn"
    folder.mkdir()
    rows = [{"record_id": f"<{i}>", "record_type": t, "target_uri": "u", "refers_to": None, "payload_digest": "d", "payload_length": 200_000, "payload": os.urandom(200_000)} for i, t in enumerate(["response", "resource", "response"])]
    whole = [bytearray(warc.member(warc.record(r))) for r in rows]
    whole[1][100_000:100_100] = b"\xff" * 100
    (folder / "a.warc.gz").write_bytes(b"".join(whole))
    found = warc.read_warc(spark, str(folder), where=[("record_type", "=", "response")]).collect()
    assert sorted(r.record_id for r in found) == ["<0>", "<2>"] and all(r.payload_bytes == 200_000 for r in found)
    assert warc.read_warc(spark, str(folder), ["record_id"]).count() == 3
    with pytest.raises(Exception, match="(?s)zlib|Error -3|incorrect"):
        warc.read_warc(spark, str(folder)).collect()


def test_empty_archive(spark, tmp_path):
    warc.register(spark)
    warc.page_records(pages(spark).where("false")).write.format("warc").mode("append").save(str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


# -- URL filters ----------------------------------------------------------------------------

URLS = [
    (1, "HTTPS://WWW.Example.ORG/es/x?y#z"),
    (2, "http://example.org/en/17"),
    (3, "http://example.org/en/27"),
    (4, "http://a.b.com/fr/1"),
    (5, "http://xcom/fr/1"),
    (6, "http://www.x.com/de/"),
    (7, "http://casino-bonus.example.net/en/1"),
    (8, "http://museum.example.net/en/1"),
    (9, "http://example.org"),
    (10, "http://example.org?q=/es/"),
    (11, None),
    (12, "no scheme"),
    (13, "x://"),
    (14, "http://a://b.org/c"),
    (15, "http://É.org/\nnew line/" + "p" * 5000),
]


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def test_rules_and_classifier(spark):
    frame = spark.createDataFrame([(i, u, "x", "y") for i, u in URLS], "page_id long, url string, verdict string, other string")
    model = url_filter.train()
    rows = {r.page_id: r for r in url_filter.filter_urls(frame, url_filter.RULES, model).collect()}
    assert len(rows) == len(URLS) and "other" in rows[1].asDict()
    for i, u in URLS:
        host, path = plain_url(u)
        assert (rows[i].host, rows[i].path) == (host, path)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            assert (rows[i].rule, rows[i].verdict) == max(fits)[1:]
        else:
            assert rows[i].rule is None and rows[i].verdict == ("block" if model.score(host, path) >= 0.5 else "allow")
    assert [rows[i].verdict for i in (1, 2, 3, 4, 6, 7, 8, 11, 12)] == ["block", "block", "allow", "allow", "block", "block", "allow", "allow", "allow"]
    assert url_filter.filter_urls(frame.where("false"), [], model).count() == 0


def test_classifier_learns_a_given_table():
    table = [(f"good{i}.x/a", 0) for i in range(20)] + [(f"evil{i}.x/a", 1) for i in range(20)]
    model = url_filter.train(table)
    assert model.score("evil99.x", "/a") > 0.5 > model.score("good99.x", "/a")
    default = url_filter.train()
    held = [("play-casino.example.net", 1), ("m.cheap-bets.example.com", 1), ("library.example.net", 0), ("www.news.example.com", 0)]
    assert all((default.score(h, "/en/1") >= 0.5) == bool(label) for h, label in held)


def test_training_table_names_no_tested_host(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    hosts = {r[0] for r in spark.read.parquet(f"{folder}/pages.parquet").select(url_filter.split_url(F.col("url"))[0]).distinct().collect()}
    labels = {part for h in hosts for part in h.split(".")}
    names = {u.partition("/")[0].removesuffix(".test") for u in (*url_filter.UNWANTED, *url_filter.WANTED)}
    assert not names & labels and not names & hosts
    assert len(names) == len(url_filter.UNWANTED) + len(url_filter.WANTED)


def test_batches_score_like_single_urls():
    model = url_filter.train()
    hosts, paths = ["grand-casino.x", "", "é.org", "a", "library.y"], ["/a", "", "/" + "p" * 3000, "", "/b"]
    assert model.scores(hosts, paths) == pytest.approx([model.score(h, p) for h, p in zip(hosts, paths, strict=True)])
    assert model.scores([], []).shape == (0,) and model.scores([""], [""])[0] == 0.0
    row, slot = url_filter.grams(hosts, paths)
    plain = [len({(part, t[i : i + k]) for part, t in ((0, f"^{h}$"), (1, f"^{p}$")) for k in (3, 4, 5) for i in range(len(t) - k + 1)}) for h, p in zip(hosts, paths, strict=True)]
    assert [int((row == i).sum()) for i in range(len(hosts))] == pytest.approx(plain, abs=2)


# -- token totals ---------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, docs int"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(1, "a b c", "en", "s", 1), (2, "d e", "en", "s", 1), (3, None, None, "s", 1), (4, "é ü", "de", None, 1), (4, "é ü", "de", None, 1)], DOCS)


def totals(rollup):
    return sorted(((r.source, r.lang, r.tokenizer, r.docs, r.tokens) for r in rollup.totals().collect()), key=str)


def test_inserts_revisions_deletes_and_repeats(spark, docs, tmp_path):
    rollup = token_rollup.TokenRollup(spark, f"file://{tmp_path}/totals")
    assert totals(rollup) == []
    insert = token_rollup.changes("insert", docs, "w", F.lit(10))
    assert rollup.commit("one", insert) and not rollup.commit("one", insert)
    assert totals(rollup) == [("s", "en", "w", 2, 20), ("s", None, "w", 1, 10), (None, "de", "w", 2, 20)]
    assert rollup.commit("two", token_rollup.revisions(docs, "w", F.lit(10), token_rollup.word_count("text")))
    assert totals(rollup) == [("s", "en", "w", 2, 5), ("s", None, "w", 1, 0), (None, "de", "w", 2, 4)]
    rollup.compact()
    assert not rollup.commit("two", insert) and not rollup.commit("one", insert)
    assert rollup.commit("three", token_rollup.changes("delete", docs.where("doc_id IN (2, 3)"), "w", token_rollup.word_count("text")))
    assert rollup.commit("four", token_rollup.changes("insert", docs.where("doc_id = 1"), "bytes", token_rollup.byte_count("text")))
    expected = [("s", "en", "bytes", 1, 5), ("s", "en", "w", 1, 3), (None, "de", "w", 2, 4)]
    assert totals(rollup) == expected
    rollup.compact()
    rollup.compact()
    assert totals(token_rollup.TokenRollup(spark, f"file://{tmp_path}/totals")) == expected
    assert rollup.commit("nothing", insert.where("false")) and totals(rollup) == expected
    assert not rollup.commit("four", insert) and totals(rollup) == expected
    with pytest.raises(ValueError):
        rollup.commit("../x", insert)
    with pytest.raises(ValueError):
        token_rollup.changes("upsert", docs, "w", F.lit(1))


def test_a_commit_during_compaction_counts_once(spark, docs, tmp_path):
    rollup = token_rollup.TokenRollup(spark, f"file://{tmp_path}/totals")
    one = docs.where("doc_id = 1")
    rollup.commit("a", token_rollup.changes("insert", one, "w", F.lit(10)))
    early = rollup.totals()
    publish = rollup._publish

    def slow(df, name):
        rollup._publish = publish
        assert rollup.commit("b", token_rollup.changes("insert", one, "w", F.lit(10)))
        return publish(df, name)

    rollup._publish = slow
    rollup.compact()
    assert totals(rollup) == [("s", "en", "w", 2, 20)]
    assert [tuple(r) for r in early.collect()] == [("s", "en", "w", 1, 10)]  # a reader from before the compaction
    rollup.compact()
    assert totals(rollup) == [("s", "en", "w", 2, 20)] and rollup._names("batches") == ["b"]
    rollup.compact()
    assert totals(rollup) == [("s", "en", "w", 2, 20)] and rollup._names("batches") == [] and rollup._names("base") == []
    assert not rollup.commit("b", token_rollup.changes("insert", one, "w", F.lit(10)))


def test_a_failed_batch_leaves_nothing(spark, docs, tmp_path):
    rollup = token_rollup.TokenRollup(spark, f"file://{tmp_path}/totals")
    bad = token_rollup.changes("insert", docs, "w", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        rollup.commit("one", bad)
    assert totals(rollup) == [] and rollup.commit("one", token_rollup.changes("insert", docs, "w", F.lit(1)))


def test_byte_pair_counts(spark, docs):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.tiktoken")
    got = [r.tokens for r in token_rollup.bpe_counts(docs, path, P.PATTERN).orderBy("doc_id").collect()]
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got == [len(own.encode_ordinary(r.text)) if r.text else 0 for r in docs.orderBy("doc_id").collect()]
