from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from unbrev import LATIN, RU, EditCosts
from unbrev.functions import distance as ds
from unbrev.functions import text as tx


def values(spark, words, *cols):
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    return [tuple(r)[1:] for r in rows.select("i", *cols).orderBy("i").collect()]


def test_fold_lists_line_up():
    for profile in (RU, LATIN):
        assert len(profile.fold_from) == len(profile.fold_to)


def test_skeleton_and_gate(spark):
    w = tx.normalize(F.col("w"), RU)
    got = values(
        spark,
        ["тестирование", "Семья", "Ёлка", "кто-то", "-слово", "кто--то", "пароль1", ""],
        tx.skeleton(w, RU),
        tx.is_plain_word(w, RU),
    )
    assert [g[0] for g in got[:4]] == ["тстрвн", "см", "лк", "кт-т"]
    assert [g[1] for g in got] == [True, True, True, True, False, False, False, True]


def test_delete_variants(spark):
    got = values(spark, ["тстр", "ттт", "тс"], F.array_sort(tx.delete_variants(F.col("w"))))
    assert [g[0] for g in got] == [["стр", "тср", "тст", "ттр"], ["тт"], []]


def test_mask(spark):
    got = values(spark, ["редиска", "ну", "мать-и-мачеха"], tx.mask_form(F.col("w")))
    assert got[0][0] == "ред@#&а"
    assert got[1][0] is None
    assert got[2][0] == "мать-@-#&%$!а"


def test_context_keys(spark):
    df = spark.createDataFrame([(["(ну)", "—"],), (["в", "—"],), ([],)], "c array<string>")
    rows = df.select(tx.last_context_key(F.col("c"), RU), tx.last_context_word(F.col("c"), RU)).collect()
    assert [tuple(r) for r in rows] == [("ну", "—"), ("в", "—"), ("", "")]


def test_government(spark):
    df = spark.createDataFrame(
        [("в", "NOUN,inan,femn,sing,loct"), ("для", "NOUN,loct"), ("дом", "NOUN,gent"), ("для", "ADJF femn,gen2")],
        "p string, t string",
    )
    got = [r[0] for r in df.select(tx.case_agreement(F.col("p"), F.col("t"), RU)).collect()]
    assert got == [1.0, 0.0, 0.0, 1.0]


def test_tokens_with_context(spark):
    df = spark.createDataFrame([("Ну, привет кто-то там",)], "t string")
    words = df.select(tx.tokens_with_context(F.col("t"), RU, 2)).first()[0]
    assert [(w.pos, w.token, w.context) for w in words] == [
        (1, "Ну", []), (2, "привет", ["Ну"]), (3, "кто-то", ["Ну", "привет"]),
        (4, "там", ["привет", "кто-то"]),
    ]


def brute_distance(a, b, profile, c):
    def ins(x):
        if x in profile.vowels:
            return c.insert_vowel
        return c.insert_sign if profile.signs and x in profile.signs else c.insert_consonant

    def swap(x, y):
        if x == y:
            return 0
        if profile.adjacent(x, y):
            return c.substitute_neighbour
        both = x in profile.vowels and y in profile.vowels
        return c.substitute_vowel if both else c.substitute

    d = {(0, 0): 0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = [d[0, 0]] if i == j == 0 else []
            if j:
                ways.append(d[i, j - 1] + ins(b[j - 1]))
            if i:
                ways.append(d[i - 1, j] + c.delete)
            if i and j:
                ways.append(d[i - 1, j - 1] + swap(a[i - 1], b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                ways.append(d[i - 2, j - 2] + c.transpose)
            d[i, j] = min(ways)
    return d[len(a), len(b)]


@pytest.mark.parametrize("profile", [RU, LATIN], ids=lambda p: p.name)
def test_distance_matches_brute_force(spark, profile):
    rng = random.Random(1)
    letters = profile.letters[:12] + profile.vowels + profile.signs + "-"
    pairs = [
        tuple("".join(rng.choices(letters, k=rng.randint(0, n))) for n in (8, 10))
        for _ in range(1500)
    ]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    costs = EditCosts()
    rows = df.select(
        "a",
        "b",
        ds.edit_distance(a, b, profile).alias("x"),
        ds.edit_distance_native(a, b, profile).alias("y"),
    ).collect()
    import numpy as np

    for r in rows:
        want = brute_distance(r.a, r.b, profile, costs)
        assert (r.x, r.y) == (want, want), r
        cons = [sum(ch not in profile.vowels + profile.signs for ch in w) for w in (r.a, r.b)]
        sizes = (np.array([v]) for v in (len(r.a), cons[0], len(r.b), cons[1]))
        assert ds.length_bound(*sizes, costs)[0] <= want, r


def test_known_distances(spark):
    df = spark.createDataFrame([("првт", "привет"), ("пирвет", "привет"), ("привет", "привет")], "a string, b string")
    got = [r[0] for r in df.select(ds.edit_distance(F.col("a"), F.col("b"), RU)).collect()]
    assert got == [10, 12, 0]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=50, max_size=50))
def test_normalise_and_skeleton_laws(spark, words):
    words = [w.replace("\x00", "") for w in words if not any(0xD800 <= ord(c) < 0xE000 for c in w)]
    once = tx.normalize(F.col("w"), RU)
    got = values(spark, words, once, tx.normalize(once, RU), tx.skeleton(once, RU))
    for first, second, skel in got:
        assert first == second and "ё" not in first
        assert not set(skel) & set(RU.vowels + RU.signs)
