"""Phrase mining against a brute-force version."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from tests.llm.conftest import LOWER, documents
from unbrev.llm import phrases

SCHEMA = "lang string, text string"


def pieces(text: str | None) -> list[list[str]]:
    cut = re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER))
    return [re.findall("[^ \t]+", p) for p in cut]


def counted(rows) -> dict[str, Counter]:
    out = defaultdict(Counter)
    for lang, text in rows:
        for ws in pieces(text):
            for n in range(1, 6):
                out[lang or "und"].update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    return out


def brute(rows, least: int, top: int) -> list[tuple]:
    out = []
    for lang, f in counted(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        cand = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        found = []
        for p, a in cand.items():
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(
                b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in cand.items()
            )
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], start=1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def mined(frame, least: int, top: int) -> list[tuple]:
    return sorted(tuple(r) for r in phrases.collocations(frame, least, top).collect())


def texts(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["a", "the", "of", "Été", "中", "x-1", "b", "c", "d'e"]
    rows = []
    for i in range(60):
        ws = [rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".\n", "  ", "\t", "!"]) for _ in range(rng.randint(0, 90))]
        rows.append((rng.choice(["en", "fr", None]), " ".join(ws)))
    return rows + rows[:20] + [("en", None), (None, ""), ("de", "one two three"), ("en", "so so " * 400), ("en", "\x00 \x1c\x85 . ; ")]


@pytest.mark.parametrize("least,top", [(5, 1000), (12, 7)])
def test_phrases_equal_brute_force(spark, least, top):
    rows = texts(3)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert mined(frame, least, top) == brute(rows, least, top)


def test_small_filters_change_nothing(spark, monkeypatch):
    """With filters that are nearly full and tasks that hand on all the time."""
    monkeypatch.setattr(phrases, "BLOOM_BITS", 8)
    monkeypatch.setattr(phrases, "HELD", 10)
    monkeypatch.setattr(phrases, "READ_BYTES", 200)
    monkeypatch.setattr(phrases, "TRIGGER", 2)
    rows = texts(4)
    assert mined(spark.createDataFrame(rows, SCHEMA), 6, 50) == brute(rows, 6, 50)


def test_dictionary_counts_each_phrase_once(spark):
    """Every occurrence starts at an own word of exactly one chunk and lies within it."""
    rows = texts(5) + [("en", " ".join(f"w{i % 37} v{i % 11}" for i in range(3000)))]
    found = defaultdict(Counter)
    for lang, chunk, own, times in phrases.parse(spark.createDataFrame(rows, SCHEMA)).collect():
        ws = re.findall("[^ \t]+", chunk)
        assert own == len(ws) or len(ws) == own + phrases.OVERLAP
        for i in range(own):
            for n in range(1, min(5, len(ws) - i) + 1):
                found[lang][tuple(ws[i : i + n])] += times
    want = counted(rows)
    assert {k: dict(v) for k, v in found.items() if v} == {k: dict(v) for k, v in want.items() if v}


def test_products_beyond_64_bits(spark):
    f = 9_000_000_000_000
    frequent = spark.createDataFrame(
        [("en", "a", 1, f), ("en", "b", 1, f - 1), ("en", "a b", 2, f - 7)], "lang string, phrase string, words int, f bigint"
    )
    totals = spark.createDataFrame([("en", 8_000_000_000_000_000)], "lang string, n bigint")
    (row,) = phrases.score_phrases(frequent, totals).collect()
    assert row.score == 1000 * (f - 7) * 8_000_000_000_000_000 // (f * (f - 1))


def test_odd_rows(odd_docs, no_docs):
    rows = [(lang, text) for _, text, lang, *_ in documents()]
    extra = odd_docs.withColumnsRenamed({"tag": "own", "kept": "times", "a": "chunk", "rep": "phrase"})
    assert mined(extra, 3, 40) == brute(rows, 3, 40)
    assert phrases.collocations(no_docs).count() == 0
