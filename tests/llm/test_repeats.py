from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import documents
from unbrev.llm import repeats

SPAN = repeats.SPAN


def brute(rows, span=SPAN):
    first: dict[bytes, int] = {}
    for i, text, *_ in rows:
        data = (text or "").encode()
        if i is not None:
            for p in range(len(data) - span + 1):
                key = data[p : p + span]
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text, *_ in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        if i is not None:
            for p in range(len(data) - span + 1):
                if first[data[p : p + span]] < i:
                    gone[p : p + span] = b"\1" * span
        runs = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        left = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), sum(gone), runs, left))
    return out


def order(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def report(rows):
    return sorted(
        ((*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in rows), key=order
    )


@pytest.mark.parametrize("hot", [False, True])
def test_report_equals_brute_force(odd_docs, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(repeats, "HOT_PLACES", 1)
    got = repeats.removal_report(odd_docs).collect()
    rows = brute(documents())
    assert sum(r[2] for r in rows) > 3000
    assert sorted(map(tuple, got), key=order) == report(rows)


def test_several_buckets_and_flushes(odd_docs, monkeypatch):
    monkeypatch.setattr(repeats, "FLUSH_BYTES", 2000)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(repeats, "MERGE_BYTES", 3000)
    got = repeats.removal_report(odd_docs).collect()
    assert sorted(map(tuple, got), key=order) == report(brute(documents()))


def test_texts_without_repeats(odd_docs):
    got = repeats.without_repeats(odd_docs)
    assert got.columns == odd_docs.columns
    left = sorted(
        ((i, data.decode(errors="ignore")) for i, n, gone, _, data in brute(documents()) if not gone or data),
        key=order,
    )
    texts = sorted(((r.doc_id, r.text or "") for r in got.collect()), key=order)
    assert texts == left


def test_no_rows(no_docs):
    assert repeats.removal_report(no_docs).count() == 0
    assert repeats.without_repeats(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=30), min_size=1, max_size=9))
def test_merge_equals_sorting(segments):
    span = 5
    first = np.cumsum([0, *(len(s) + 1 for s in segments)])
    text = np.frombuffer(b"".join(s.encode() + b"\xff" for s in segments), np.uint8)
    owner = np.arange(len(segments))[::-1] * 10
    got = repeats.smallest_owner(text, first, owner, span)
    for i, s in enumerate(segments):
        for p in range(len(s) - span + 1):
            want = min(owner[j] for j, t in enumerate(segments) if s[p : p + span] in t)
            assert got[first[i] + p] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=20), min_size=2, max_size=8))
def test_common_prefixes(segments):
    half = len(segments) // 2
    parts = [segments[:half], segments[half:]]
    texts = [np.frombuffer(b"".join(s.encode() + b"\xff" for s in p), np.uint8) for p in parts]
    made = [repeats.shard_transform(t) for t in texts]
    shard, head, common = repeats.merge_transforms(made[0][1], made[1][1], 6)
    taken = [0, 0]
    suffixes = []
    for s in shard.astype(int):
        raw = texts[s][made[s][0][taken[s]] :].tobytes()
        taken[s] += 1
        suffixes.append(raw[: raw.index(b"\xff") + 1])
    assert [x[:6] for x in suffixes] == sorted(x[:6] for x in suffixes)
    for k in range(1, len(suffixes)):
        a, b = suffixes[k - 1], suffixes[k]
        same = 0
        while same < 6 and a[same] == b[same] and a[same] != 0xFF:
            same += 1
        assert common[k] == same and head[k] == (same < 6)


def test_segments_alone_under_their_anchor_are_not_merged():
    anchors, kind = np.array([7, 7, 9, 9, 9, 4]), np.array([0, 1, 2, 2, 2, 3])
    assert repeats.in_company(anchors, kind, 4).tolist() == [True, True, False, False]


def test_passages_in_equal_and_in_different_surroundings(spark, monkeypatch):
    passage = "".join(chr(97 + i * i % 23) for i in range(160))
    rows = [(1, passage), (2, f"x{passage}y"), (3, f"x{passage}y!"), (4, passage[20:90]), (5, passage[:70] + passage[30:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = report(brute(rows))
    for size in (1, repeats.MERGE_BYTES):
        monkeypatch.setattr(repeats, "MERGE_BYTES", size)
        assert sorted(map(tuple, repeats.removal_report(docs).collect()), key=order) == want
