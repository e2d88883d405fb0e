"""Byte-level BPE, URL filters, WARC, and the pipeline."""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import random
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import documents
from unbrev.llm import byte_bpe, queries, url_filter, warc

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    ranks = byte_bpe.tokenizer(RANKS, PATTERN).ranks
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(reference):
    rng = random.Random(1)
    odd = ["", " ", "\n\n  a", "it's we'll  'x", "\x1c\x1d a\x85b", "a" * 700, "Öü" * 300, "aé" * 5000]
    for _ in range(60):
        odd.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000), 0x1F600, 32, 10])) for _ in range(60)))
    own = byte_bpe.tokenizer(RANKS, PATTERN)
    coded = own.encode(odd)
    assert coded == [",".join(map(str, reference.encode_ordinary(t))) for t in odd]
    assert list(own.decode([byte_bpe.numbers(c) for c in coded])) == [t.encode() for t in odd]


def test_digests_and_round_trip(odd_docs, no_docs, reference):
    got = byte_bpe.digests(odd_docs, RANKS, PATTERN)
    assert got.columns == [*(c for c in odd_docs.columns if c != "text"), "n_tokens", "ids_sha256", "decoded_sha256"]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, *_ in documents():
        ids = reference.encode_ordinary(t or "")
        want.append((str(i), len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    rows = got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted((str(r[0]), *r[1:]) for r in rows) == sorted(want)
    coded = byte_bpe.encode(odd_docs.select("doc_id", "text", "kept"), RANKS, PATTERN)
    back = byte_bpe.decode(coded, RANKS, PATTERN)
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((t or "").encode() for _, t, *_ in documents())
    assert byte_bpe.digests(no_docs, RANKS, PATTERN).count() == 0


# -- URLs ---------------------------------------------------------------------------------

URLS = [
    "http://A.Example.NET/en/x", "https://example.com/de/", "http://x.example.com/de", "http://fr.org/fr/1?x=/de/",
    "http://net/", "http://notnet/", "https://www.bad.io/a.html#t", "ftp://bad.io/a/", "http://bad.io/a?utm=1",
    "bad.io/a", "", None, "x://", "http://h?q", "http://example.net", "http://user@h:80/p//q/", "http://a.net/b://c",
]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [
        (h + p, v)
        for h, p, v in queries.URL_RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    key = host.removeprefix("www.") + path.removesuffix(".html").rstrip("/")
    return host, path, rule, verdict or ("block" if key == "bad.io/a" else "allow")


def test_urls_equal_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (None, URLS[6])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    pages = pages.withColumns({c: F.lit("x") for c in ("html", "host", "rule", "block", "_key", "w0")})
    listed = spark.createDataFrame([("bad.io/a",), ("bad.io/a",), ("other/b",), (None,)], "url_key string")
    got = url_filter.judge_urls(pages, listed, queries.URL_RULES).collect()
    found = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in got)
    assert found == sorted((str(i), *map(str, judge(u))) for i, u in rows)
    none = url_filter.judge_urls(pages, listed.limit(0), queries.URL_RULES)
    assert none.filter("listed").count() == 0
    assert url_filter.judge_urls(pages.limit(0), listed, queries.URL_RULES).count() == 0


def test_bloom_filter_loses_nothing(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("url_key"))
    bloom = url_filter.bloom_filter(keys)
    assert bloom.count() <= 1 << url_filter.BLOCK_BITS
    assert url_filter.possible_hits(keys, bloom, "url_key").count() == 3000
    others = spark.range(3000).select(F.concat(F.lit("other"), "id").alias("url_key"))
    assert url_filter.possible_hits(others, bloom, "url_key").count() < 300


# -- WARC ---------------------------------------------------------------------------------


def pages():
    payloads = ["<p>a</p>", "<p>b</p>", "", "WARC/1.1\r\n\r\nContent-Length: 3", "é\n" * 50, "x" * 200_000]
    rows = [(i, f"http://h/{i}", payloads[i % len(payloads)]) for i in range(20)]
    return rows + [(50, None, "only"), (51, "http://h/a b\r\nX: y", None), (7, "http://h/7", payloads[1]), (None, "u", "alone"), (None, "u", "<p>a</p>")]


@pytest.mark.parametrize("size", [1, warc.ARCHIVE_BYTES])
def test_pages_come_back(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(warc.write_monolithic, "__defaults__", (size,))
    frame = spark.createDataFrame(pages(), "page_id bigint, url string, html string").repartition(3)
    archives, index = warc.archive_pages(frame.withColumn("sha1", F.lit("x")), str(tmp_path / "out"))
    last: dict[str, int] = {}
    for i, _, html in pages():
        if i is not None:
            last[html or ""] = max(last.get(html or "", i), i)
    want = []
    for i, _, html in pages():
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        top = last.get(html or "")
        kind = ("response", None) if i == top else ("revisit", top)
        want.append((str(i), len(data), digest, kind[0], str(kind[1])))
    back = warc.read_members(archives)
    got = back.select(
        warc.page_number(F.col("record_id")).alias("i"), "payload_bytes", "payload_digest", "record_type",
        warc.page_number(F.col("refers_to")).alias("r"), "stored_bytes", "stored_sha1",
    ).collect()
    assert sorted((str(r.i), r.payload_bytes, r.payload_digest, r.record_type, str(r.r)) for r in got) == sorted(want)
    for r in got:
        if r.record_type == "response":
            stored = base64.b32encode(bytes.fromhex(r.stored_sha1)).decode()
            assert (r.stored_bytes, stored) == (r.payload_bytes, r.payload_digest)
        else:
            assert r.stored_bytes == 0
    assert index.count() == len(pages())
    whole = {r.archive: bytes(r.data) for r in archives.collect()}
    for r in index.collect():
        assert gzip.decompress(whole[r.archive][r.offset : r.offset + r.length]).startswith(b"WARC/1.1")


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    archives, index = warc.archive_pages(none, str(tmp_path / "out"))
    assert archives.count() == index.count() == warc.read_members(archives).count() == 0


def test_streams_of_any_form():
    raw = b"".join(warc.make_record(f"urn:page:{i}", "u", b"x" * i, "D", None) for i in range(9))
    one, two = gzip.compress(raw), gzip.compress(raw[:300]) + gzip.compress(raw[300:])
    for data in (one, two):
        assert b"".join(r.raw for r in warc.records(warc.inflate(data, 7))) == raw
    with pytest.raises(ValueError):
        list(warc.inflate(one[:-20]))
    with pytest.raises(ValueError):
        list(warc.records(iter([raw[:-5]])))
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(warc.inflate(b"not gzip")))


# -- pipeline ----------------------------------------------------------------------------


def test_stages_take_odd_rows(spark, odd_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, "")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == docs.columns
        assert 0 < made.count() <= docs.count()
        docs = spark.createDataFrame(made.collect(), made.schema)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert out and len({r.doc_id for r in out}) == len(out)


def test_stages_take_no_rows(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
