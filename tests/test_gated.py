"""Wide keys, session memory, load order, gated masks, rules and scorers."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tests.compare import differences
from unbrev import RU
from unbrev.catalog import queries
from unbrev.catalog.sessions import SESSION_SQL
from unbrev.operators import postings as po
from unbrev.operators.lexicons import in_load_order
from unbrev.plans import expand, masking, signals
from unbrev.plans import sessions as se
from unbrev.settings import Settings

LEX = "form_id bigint, form string, lemma string, freq double, tags string"
KEYED = f"kind string, key string, {LEX}"


# -- postings ---------------------------------------------------------------------------


def _keyed(spark, n):
    rows = [("skel_prefix", "к", i, f"к{i}", f"к{i}", float(i % 97), "") for i in range(n)]
    rows += [("ending", "ия", i, f"{i}ия", "x", float(i % 5), "") for i in range(40)]
    rows += [("skel_prefix", f"кот{i % 9}", i, f"кот{i}", "y", 1.0, "") for i in range(60)]
    return spark.createDataFrame(rows, KEYED)


def test_a_key_with_most_rows_is_ranked_in_slices(spark):
    keyed, cap = _keyed(spark, 3000), 10
    short = po.shortlist(keyed.filter(po.widely_shared()), cap)
    sizes = {r.key: r["count"] for r in short.groupBy("key").count().collect()}
    assert cap <= sizes["к"] <= cap * po.SLICES < 3000 and sizes["ия"] == 40
    got = po.rank_postings(keyed, cap).select("kind", "key", "form", "bucket_rank").collect()
    every = po.rank_postings(keyed, None).filter(F.col("bucket_rank") <= cap)
    assert sorted(got) == sorted(every.select("kind", "key", "form", "bucket_rank").collect())
    trimmed = {(r.key, r.rows, r.trimmed) for r in po.trimmed_keys(keyed, cap).collect()}
    assert trimmed == {("к", 3000, 2990), ("ия", 40, 30)}


def test_no_cap_keeps_every_candidate(spark):
    rows = [(i, f"кот{c}", f"кот{c}", 1.0, "") for i, c in enumerate("абвгдежзик", start=1)]
    lexicon = spark.createDataFrame(rows, LEX)
    asked = spark.createDataFrame([("q", "кот")], "query_id string, input string")
    got = expand.expand_tokens(asked, expand.Knowledge(lexicon), RU, Settings(per_source_cap=None), 20)
    few = expand.expand_tokens(asked, expand.Knowledge(lexicon), RU, Settings(per_source_cap=2), 20)
    assert got.count() == 10 and few.count() < 10


# -- session words -----------------------------------------------------------------------


def _session(spark, n, memory):
    uses = spark.createDataFrame([("s", f"w{i}", i) for i in range(1, n + 1)], "session_id string, norm string, tick bigint")
    asks = uses.select("session_id", (F.col("tick")).alias("tick"), F.lit("x").alias("norm_input"))
    return expand.words_in_memory(asks, uses, ["session_id"], memory)


def test_pairs_grow_with_the_length_of_a_session(spark):
    short, long = _session(spark, 200, 16).count(), _session(spark, 400, 16).count()
    assert short == 16 * 200 - 16 * 15 // 2 and long - short == 16 * 200


def test_words_in_memory_equal_brute_force(spark):
    uses = [("s", w, t) for t, w in enumerate("a b a c d a b e f a g b h i a".split(), start=1)] + [("r", "a", 1)]
    asks = [("s", t, "x") for t in (1, 2, 4, 5, 8, 9, 13, 15, 40)] + [("r", 3, "x")]
    for memory in (1, 3, 4, 100):
        got = expand.words_in_memory(
            spark.createDataFrame(asks, "session_id string, tick bigint, norm_input string"),
            spark.createDataFrame(uses, "session_id string, norm string, tick bigint"),
            ["session_id"], memory,
        )
        want = sorted({(s, t, w) for s, t, _ in asks for r, w, at in uses if r == s and t - memory < at <= t})
        assert sorted((r.session_id, r.tick, r.norm) for r in got.collect()) == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
def test_ranked_session_equals_its_sql(spark, tmp_path):
    """On some of the given rows."""
    con = duckdb.connect()
    for name, some in (("conversations", "conv_id IN (SELECT conv_id FROM t ORDER BY conv_id LIMIT 4)"), ("documents", "n_chars < 900")):
        con.execute(f"CREATE OR REPLACE VIEW t AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
        con.execute(f"COPY (SELECT * FROM t WHERE {some}) TO '{tmp_path}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got = queries()["ranked_session"](spark, str(tmp_path)).toPandas()
    assert len(got) and differences(got, con.execute(SESSION_SQL).df()) == ""


def test_session_rankings_hand_on_the_first_and_the_used_only(spark):
    words = [f"кот{a}{b}" for a in "абвгде" for b in "иклмно"]
    lexicon = spark.createDataFrame([(i, w, w, float(i % 7), "") for i, w in enumerate(words)], LEX)
    said = [(s, n, w) for s in ("a", "b") for n, w in enumerate([words[3], "дом", words[20], words[3]], start=1)]
    ticked = se.session_ticks(spark.createDataFrame([*said, ("c", 1, words[35])], WORDS), RU)
    asked = spark.createDataFrame(
        [(f"{s}{t}{i}", s, t, i) for s in "abc" for t in (0, 1, 3, 4) for i in ("кот", "кт", words[20])],
        "query_id string, session_id string, tick bigint, input string",
    )
    known = expand.Knowledge(lexicon, session_words=ticked)
    every = expand.complete_ranking(asked, known, RU)
    few = expand.complete_ranking(asked, known, RU, first=("form", 3))
    assert few.count() < every.count() / 3
    for key in ("form", "lemma"):
        want = expand._first_of(every, F.col(key), 3).collect()
        got = expand._first_of(expand.complete_ranking(asked, known, RU, first=(key, 3)), F.col(key), 3).collect()
        assert len(want) == 72 and sorted(map(str, got)) == sorted(map(str, want))
    ranked = {(r.query_id, r.form): r.rank for r in expand.expand_tokens(asked, known, RU, limit=3).collect()}
    assert ("a4кот", words[3]) in ranked and ("a0кот", words[3]) not in ranked


# -- load order ---------------------------------------------------------------------------


def test_sources_are_numbered_one_after_the_other(spark):
    first = spark.createDataFrame([(7, "б", "б1", 1.0, ""), (3, "в", "в1", 9.0, "")], LEX).repartition(3)
    derived = spark.createDataFrame([(0, w, w, f, "") for w, f in (("б", 5.0), ("а", 5.0), ("г", 8.0))], LEX)
    rows = in_load_order(first, derived, first.limit(0)).orderBy("form_id").collect()
    assert [(r.form_id, r.form) for r in rows] == [(1, "в"), (2, "б"), (3, "г"), (4, "а"), (5, "б")]


def test_homographs_of_equal_frequency_rank_in_load_order(spark):
    one = spark.createDataFrame([(0, "привет", "я", 5.0, "")], LEX)
    two = spark.createDataFrame([(0, "привет", "а", 5.0, "")], LEX)
    asked = spark.createDataFrame([("q", "првт")], "query_id string, input string")
    for sources, lemma in (((one, two), "я"), ((two, one), "а")):
        (row,) = expand.expand_tokens(asked, expand.Knowledge(in_load_order(*sources)), RU).collect()
        assert row.lemma == lemma


# -- masks ---------------------------------------------------------------------------------

RANKED = "query_id string, rank int, form string, lemma string, score double, source string"
WORDS = "session_id string, pos bigint, word string"


@pytest.fixture(scope="module")
def track(spark):
    words = [("polite", 1, "пожалуйста"), ("polite", 2, "дом"), ("crude", 1, "дом"), ("crude", 2, "хрень"), ("late", 1, "дом"), ("late", 2, "пожалуйста")]
    marks = spark.createDataFrame([("пожалуйста", 1.0), ("хрень", -1.0)], "word string, sign double")
    return se.session_features(spark.createDataFrame(words, WORDS), marks, RU)


def test_twins_in_polite_stretches_only(spark, track):
    asks = spark.createDataFrame(
        [("p", "polite", 2), ("c", "crude", 2), ("e", "nobody", 0), ("before", "late", 1), ("after", "late", 2)],
        "query_id string, session_id string, tick bigint",
    )
    registers = masking.register_as_of(track, asks)
    assert {r.query_id: r.register for r in registers.collect()} == {
        "p": "polite", "c": "crude", "e": "neutral", "before": "neutral", "after": "polite",
    }
    rows = spark.createDataFrame(
        [(q, 1, "негодяйка", "негодяй", 1.0, "exact") for q in ("p", "c", "e", "before", "after", "unasked")], RANKED
    )
    masks = spark.createDataFrame([("негодяй",)], "lemma string")
    for grouped in (False, True):
        gated = masking.mask_expansions(rows, masks, RU, 5, registers, True, grouped)
        assert {r.query_id for r in gated.collect() if r.is_twin} == {"p", "after"}
        always = masking.mask_expansions(rows, masks, RU, 5, registers, False, grouped)
        assert always.filter("is_twin = 1").count() == 6
        # Without registers there is no tone to read.
        assert masking.mask_expansions(rows, masks, RU, 5, None, True, grouped).filter("is_twin = 1").count() == 6


def test_equal_twins_are_shown_once(spark):
    rows = spark.createDataFrame([("q", 1, "блямть", "л", 3.0, "exact"), ("q", 2, "блямдь", "л", 2.0, "exact")], RANKED)
    masks = spark.createDataFrame([("л",)], "lemma string")
    for grouped in (False, True):
        got = masking.mask_expansions(rows, masks, RU, 20, grouped=grouped).orderBy("rank").collect()
        twins = [r.form for r in got if r.is_twin]
        assert len(twins) == len(set(twins)) and got[1].is_twin and got[0].form == "блямть"


# -- rules and scorers ------------------------------------------------------------------------

TAGGED = [
    (1, "работа", "работа", 220.0, "NOUN,inan,femn,sing,nomn"), (2, "работы", "работа", 120.0, "NOUN,inan,femn,sing,gent"),
    (3, "работе", "работа", 200.0, "NOUN,inan,femn,sing,loct"), (4, "рабочий", "рабочий", 90.0, ""),
]


def _first(spark, known, prev):
    asked = spark.createDataFrame([("q", "рабт", [prev])], "query_id string, input string, context array<string>")
    return expand.expand_tokens(asked, known, RU).filter("rank = 1").first().form


def test_rules_from_a_table_equal_those_of_the_profile(spark):
    lexicon = spark.createDataFrame(TAGGED, LEX)
    own = expand.Knowledge(lexicon)
    given = expand.Knowledge(lexicon, government=signals.government_rules(spark, RU))
    for prev in ("для", "о", "дом", ""):
        assert _first(spark, own, prev) == _first(spark, given, prev)
    assert _first(spark, given, "для") == "работы" and _first(spark, given, "дом") == "работа"
    other = spark.createDataFrame([("дом", "loct"), ("дом", "loct")], "prep string, case string")
    assert _first(spark, expand.Knowledge(lexicon, government=other), "дом") == "работе"


def test_a_scorer_flips_the_ranking(spark):
    def prefer(contexts, forms, lemmas):
        hit = pc.and_(pc.equal(pc.list_element(contexts, 0), "мой"), pc.equal(forms, "работы"))
        return np.where(pc.fill_null(hit, False).to_numpy(zero_copy_only=False), 50.0, np.nan)

    known = expand.Knowledge(spark.createDataFrame(TAGGED, LEX), context_scorer=signals.batch_scorer(prefer))
    assert _first(spark, known, "мой") == "работы" and _first(spark, known, "твой") == "работа"
