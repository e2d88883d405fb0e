"""Ranked search against a brute-force version."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from tests.llm.conftest import LOWER, documents, sentence
from unbrev.llm import ranked_search

TERM = re.compile(f"[^{ranked_search.NO_TERM}]+")


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top: int = 10) -> list[tuple]:
    bags = [(i, ts) for i, ts in ((i, terms(t)) for i, t in docs) if ts]
    n_docs, total = len(bags), sum(len(ts) for _, ts in bags)
    counts = [(i, len(ts), Counter(ts)) for i, ts in bags]
    df = Counter(t for *_, c in counts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        asked = Counter(terms(text))
        found = []
        for i, n, c in counts:
            m = 100 - 75 + (75 * n * n_docs) // total
            score = sum(
                times
                * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t, times in asked.items()
                if c[t]
            )
            if score > 0:
                found.append((-score, i is None, i or 0))
        for rank, (score, none, i) in enumerate(sorted(found)[:top], start=1):
            out.append((str(item), rank, None if none else i, -score))
    return sorted(out, key=str)


def ranked(docs, items, top: int = 10) -> list[tuple]:
    rows = ranked_search.rank_documents(docs, items, top).collect()
    return sorted([(str(r.item_id), r["rank"], r.doc_id, r.score) for r in rows], key=str)


def corpus(seed: int):
    rng = random.Random(seed)
    docs = [(i, sentence(int(rng.paretovariate(1.2) * 8) + 1, rng)) for i in range(400)]
    docs += [(400 + i, docs[7][1]) for i in range(150)] + [(600 + i, docs[9][1] + f" x{i % 3}") for i in range(90)]
    items = [(i, sentence(rng.randint(1, 30), rng)) for i in range(25)]
    items += [(50, docs[7][1]), (51, docs[9][1]), (52, "the the an"), (53, "nowhere"), (54, None), (55, "")]
    return docs, items


@pytest.mark.parametrize("top", [10, 3])
def test_ranks_equal_brute_force(spark, top):
    docs, items = corpus(1)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert ranked(frame, spark.createDataFrame(items, "item_id bigint, text string"), top) == brute(docs, items, top)


def test_blocks_of_queries_small_shards_and_narrow_summaries(spark, monkeypatch):
    """Several blocks of queries, and coordinates that no summary has."""
    monkeypatch.setattr(ranked_search, "PAIRS", 60)
    monkeypatch.setattr(ranked_search, "COORDINATES", 3)
    docs, items = corpus(2)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    some = items[:4] + items[25:28]
    assert ranked(frame, spark.createDataFrame(some, "item_id bigint, text string")) == brute(docs, some)


def test_most_blocks_are_passed_over(spark, monkeypatch):
    """A rare term's documents are scored, not all that share a common one."""
    docs = [(i, f"common word{i % 50} also{i % 7}") for i in range(3000)]
    items = spark.createDataFrame([(1, "common word3 also2")], "item_id bigint, text string")
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    asked = items.selectExpr("1L as q", "text")
    pairs = asked.mapInArrow(ranked_search._item_terms, "q bigint, term bigint, times bigint").toArrow()
    index, queries = ranked_search.build_index(frame, pairs)
    rows = index.toArrow().to_batches()
    scored, add = [], ranked_search._Best.add
    monkeypatch.setattr(ranked_search._Best, "add", lambda s, d, x: (scored.append(len(d)), add(s, d, x)))
    for batch in rows:
        for r in range(batch.num_rows):
            ranked_search._Shard(batch, r, queries).search(0, 10)
    assert sum(scored) < 1000


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(i, t) for i, t, *_ in documents()]
    items = [(1, "the ing ion"), (1, "the ing ion"), (1, "één ß"), (None, "ing中 12"), (2, docs[0][1]), (3, "é" * 60), (4, " ")]
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    extra = odd_docs.withColumnsRenamed({"tag": "q", "kept": "n", "a": "code", "rep": "score", "ids": "rank"})
    assert ranked(extra, frame) == brute(docs, items)
    assert ranked(no_docs, frame) == [] and ranked(extra, frame.limit(0)) == []


def test_long_query(spark):
    docs, _ = corpus(3)
    item = (9, " ".join(t for _, t in docs[:200]))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert ranked(frame, spark.createDataFrame([item], "item_id bigint, text string")) == brute(docs, [item])
