"""Ranking behaviour with the Russian profile on small tables."""

from __future__ import annotations

import pytest

from unbrev import RU, Settings
from unbrev.plans import corpus, expand, sessions

LEXICON = [
    ("привет", "привет", 200.0, ""), ("приват", "приват", 10.0, ""), ("тестирование", "тестирование", 30.0, ""),
    ("тестирования", "тестирование", 20.0, ""), ("тестированию", "тестирование", 10.0, ""),
    ("история", "история", 300.0, ""), ("настроение", "настроение", 90.0, ""), ("компьютер", "компьютер", 80.0, ""),
    ("работа", "работа", 220.0, "NOUN,inan,femn,sing,nomn"), ("работы", "работа", 120.0, "NOUN,inan,femn,sing,gent"),
    ("работе", "работа", 200.0, "NOUN,inan,femn,sing,loct"), ("редиска", "редиска", 15.0, ""), ("еда", "еда", 50.0, ""),
]


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [(i, *row) for i, row in enumerate(LEXICON, start=1)]
    return spark.createDataFrame(rows, "form_id bigint, form string, lemma string, freq double, tags string")


def ask(spark, queries, known, settings=Settings(), limit=5, grouped=False, schema=""):
    df = spark.createDataFrame(queries, "query_id string, input string" + schema)
    run = expand.expand_tokens_grouped if grouped else expand.expand_tokens
    rows = run(df, known, RU, settings, limit).orderBy("query_id", "rank").collect()
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r.query_id, []).append(r)
    return out


def test_flat_ranking(spark, lexicon):
    got = ask(
        spark,
        [(w, w) for w in ("првт", "тстрние", "тстрния", "тстрнию", "пр", "abc", "Кмртер", " првт ")],
        expand.Knowledge(lexicon),
    )
    assert got["првт"][0].form == got[" првт "][0].form == "привет"
    assert got["тстрние"][0].form == "тестирование"
    assert got["тстрния"][0].form == "тестирования"
    assert got["тстрнию"][0].form == "тестированию"
    assert "пр" not in got and "abc" not in got
    assert got["Кмртер"][0].form == "компьютер"
    for rows in got.values():
        scores = [r.score for r in rows]
        assert scores == sorted(scores, reverse=True) and len({r.form for r in rows}) == len(rows)


def test_typo_tolerance_and_caps(spark, lexicon):
    query = [("q", "кмртер")]
    known = expand.Knowledge(lexicon)
    assert "q" not in ask(spark, query, known, Settings(typo_tolerance=False))
    assert ask(spark, query, known, Settings(per_source_cap=2))["q"][0].form == "компьютер"


def test_groups_and_variants(spark, lexicon):
    queries = spark.createDataFrame([("q", "тстрние")], "query_id string, input string")
    groups = expand.expand_tokens_grouped(queries, expand.Knowledge(lexicon), RU, limit=2)
    forms = expand.forms_of_lemma(lexicon, RU)
    nested = expand.nest_variants(groups, expand.group_variants(groups, forms, RU)).orderBy("rank").collect()
    assert nested[0].form == "тестирование"
    assert nested[0].variants == ["тестирования", "тестированию"]
    assert len({r.lemma for r in nested}) == len(nested)


def test_government_and_language_model(spark, lexicon):
    uni = spark.createDataFrame([("ну", 100), ("привет", 200), ("в", 400), ("приват", 40), ("мир", 10000)], "word string, cnt bigint")
    bi = spark.createDataFrame([("ну", "привет", 50), ("в", "приват", 39)], "prev string, word string, cnt bigint")
    known = expand.Knowledge(lexicon, pmi=corpus.pmi_table(uni, bi))
    queries = [
        ("for", "рбт", ["для"]), ("in", "првт", ["в"]), ("well", "првт", ["(ну)", "—"]), ("none", "првт", []),
    ]
    got = ask(spark, queries, known, schema=", context array<string>")
    assert got["for"][0].form == "работы"
    assert got["in"][0].form == "приват"
    assert got["well"][0].form == got["none"][0].form == "привет"


def test_shortcuts_lead_and_fill(spark, lexicon):
    table = spark.createDataFrame(
        [("мб", 1, "может быть", "может быть"), ("првт", 1, "приветствую", "приветствовать")],
        "key string, ord int, form string, lemma string",
    )
    known = expand.Knowledge(lexicon, shortcuts=table)
    got = ask(spark, [("a", "мб"), ("b", "првт")], known)
    assert [r.form for r in got["a"]] == ["может быть"]
    assert [r.form for r in got["b"]][:2] == ["приветствую", "привет"]
    assert [r.form for r in ask(spark, [("b", "првт")], known, limit=1)["b"]] == ["приветствую"]


def test_history_turns_the_ranking(spark, lexicon):
    history = spark.createDataFrame(
        [("u", "првт", "приват", 20, 0), ("u", "првт", "привет", 0, 20)],
        "user_id string, skeleton string, form string, confirmed bigint, reverted bigint",
    )
    got = ask(
        spark, [("me", "првт", "u"), ("you", "првт", "v")], expand.Knowledge(lexicon, history=history),
        schema=", user_id string",
    )
    assert (got["me"][0].form, got["you"][0].form) == ("приват", "привет")


def test_session_words(spark, lexicon):
    words = spark.createDataFrame(
        [("s", 1, "Синхрофазотрон"), ("s", 2, "привет"), ("s", 3, "приват"), ("t", 1, "пароль1")],
        "session_id string, pos bigint, word string",
    )
    known = expand.Knowledge(lexicon, session_words=sessions.session_ticks(words, RU))
    got = ask(
        spark, [("new", "снхрфзтрн", "s", 3), ("early", "снхрфзтрн", "s", 0), ("other", "снхрфзтрн", "t", 3)],
        known, schema=", session_id string, tick bigint",
    )
    assert [r.form for r in got["new"]] == ["Синхрофазотрон"] and got["new"][0].source == "session"
    assert "early" not in got and "other" not in got


def test_masked_twins(spark, lexicon):
    queries = spark.createDataFrame([("q", "рдск")], "query_id string, input string")
    rows = expand.expand_tokens(queries, expand.Knowledge(lexicon), RU, limit=3)
    listed = spark.createDataFrame([("Редиска",)], "lemma string")
    shown = expand.with_masked_twins(rows, listed, RU, 3).orderBy("rank").collect()
    assert [r.form for r in shown][:2] == ["редиска", "ред@#&а"]


def test_hot_keys_give_the_same_result(spark, lexicon):
    queries = spark.createDataFrame([(str(i), w) for i in range(30) for w in ("првт", "рбт")], "query_id string, input string")
    known = expand.Knowledge(lexicon)
    plain = expand.expand_tokens(queries, known, RU).collect()
    sliced = expand.expand_tokens(queries, known, RU, slice_rows=2).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, sliced))
