from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import documents, words
from unbrev.llm import near_text
from unbrev.llm.common import byte_buffer, components, shingle_sets


def shingles(text, n):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def brute(rows, n):
    """Smallest id reachable of every id, by comparing all rows."""
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(r[0], shingles(r[1], n)) for r in rows if r[0] is not None]
    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("n", [4, 5])
def test_groups_equal_brute_force(odd_docs, n):
    rows = documents()
    got = near_text.near_duplicates(odd_docs, words=n).collect()
    assert len(got) == len(rows)
    want = brute(rows, n)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles) for r in got) == sorted(
        (-1 if r[0] is None else r[0], len(shingles(r[1], n))) for r in rows
    )


def test_large_group_of_different_near_copies(spark):
    """Small blocks, so that hot lists are cut; two chains that meet in one text only."""
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:i] + ["odd", str(i)] + base[i + 2 :]) for i in range(0, 58)]
    rows = list(enumerate(texts)) + [(100, "nothing like the others at all")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_text.near_duplicates(docs, words=4, block_rows=8).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 4)


def test_borderline_pairs_are_compared_in_full(spark):
    """Pairs with 8 of 10 shingles in common that agree on 273, 274 and 271 of the 384
    counted coordinates, where 307 are expected."""
    rows = []
    for k, number in enumerate((9213, 44412, 88386)):
        w = [f"u{number}x{j}" for j in range(13)]
        rows += [(2 * k, " ".join(w[:12])), (2 * k + 1, " ".join(w[1:]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_text.near_duplicates(docs, words=4).collect()}
    assert got == brute(rows, 4) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_no_rows(no_docs):
    assert near_text.near_duplicates(no_docs).count() == 0


def test_shingle_hashes_tell_sets_apart():
    texts = ["a b c d e", "A  B\tc d\ne", "a b", "", None, "a b c d f a b c d e"]
    values, first = shingle_sets(*byte_buffer(pa.array(texts)), 4)
    sets = [frozenset(values[a:b].tolist()) for a, b in zip(first[:-1], first[1:])]
    assert sets[0] == sets[1] and len(sets[0]) == 2
    assert len(sets[2]) == 1 and not sets[3] and not sets[4]
    assert sets[0] < sets[5] and len(sets[5]) == len(shingles(texts[5], 4))
    assert (np.diff(first) >= 0).all()


def test_components_of_chain_star_and_ring(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(200, i) for i in range(201, 260)]
    ring = [(300 + i, 300 + (i + 1) % 9) for i in range(9)]
    edges = spark.createDataFrame(chain + star + ring + [(500, 500)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(edges).collect()}
    want = {i: 0 for i in range(41)} | {i: 200 for i in range(200, 260)} | {300 + i: 300 for i in range(9)}
    assert got == want
    assert components(edges.filter(F.lit(False))).count() == 0


def test_texts_are_worked_through_in_small_parts(spark, monkeypatch):
    """Working arrays of a task are bounded by ``TEXT_BYTES``, whatever a batch holds; the
    groups are those of the texts taken at once."""
    texts = [(i, " ".join(f"w{(i // 2) * 100 + k}" for k in range(40)) + " x" * (i % 2)) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    want = sorted(near_text.near_duplicates(docs).collect())
    monkeypatch.setattr(near_text, "TEXT_BYTES", 300)
    assert sorted(near_text.near_duplicates(docs).collect()) == want
    assert [r.component_id for r in want] == [i - i % 2 for i in range(60)]


def test_lists_are_gathered_for_open_documents_only(spark):
    """Documents whose lists hold one component are in no list that is compared again."""
    lists = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 12), (3, 13), (3, 14)], "key bigint, rep bigint")
    linked = spark.createDataFrame([(11, 10), (14, 13)], "a bigint, b bigint")
    rest = near_text._mixed_lists(lists, linked)
    assert sorted(map(tuple, rest.collect())) == [(2, 10, 10), (2, 12, 12)]
    own = {r.rep: sorted(r["keys"]) for r in near_text._all_lists(lists, rest).collect()}
    assert own == {10: [1, 2], 12: [2]}
