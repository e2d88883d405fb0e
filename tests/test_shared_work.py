"""Work that several branches of a query share is done once, and nothing large is broadcast."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from unbrev.catalog import inputs, sessions, streams
from unbrev.functions import text as tx
from unbrev.operators import postings as po
from unbrev.plans import corpus
from unbrev.plans import expand as ex
from unbrev.plans import lexicon as lx
from unbrev.plans import sessions as se
from unbrev.profile import LATIN, RU
from unbrev.session import settle


def plan(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def broadcast_parts(rows) -> list[str]:
    """What the physical plan has below each broadcast."""
    lines = rows._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(re.match(r"[\s:+|-]*", line).group()) for line in lines]
    parts = []
    for n, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((m for m in range(n + 1, len(lines)) if depth[m] <= depth[n]), len(lines))
            parts.append("\n".join(lines[n + 1 : end]))
    return parts


@pytest.fixture
def tables(spark, tmp_path):
    text = "motor motors motor motor motors motors wal waled wal wal waled waled"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    turns = [(s, t, f"the motor {t % 2} und {s} motor") for s in range(40) for t in range(6)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(
        str(tmp_path / "conversations.parquet")
    )
    return str(tmp_path)


def test_a_line_is_split_once(spark):
    lines = spark.createDataFrame([("Ä b--c b",), ("b -",), (None,)], "line string")
    pairs = corpus.adjacent_counts(corpus.line_tokens(lines, LATIN))
    assert plan(pairs).count("split(") == 1
    assert {tuple(r) for r in pairs.collect()} == {("a", "b--c", 1), ("b--c", "b", 1)}


@pytest.mark.parametrize("profile", [LATIN, RU], ids=lambda p: p.name)
def test_stored_words_fold_like_others(spark, profile):
    odd = ["", "Plain-Word", "Ärger ŒUVRE", "ёЁжЖ", "İKKÅ", "ß", "naïve plain", "日本", None]
    rows = spark.createDataFrame([(w,) for w in odd], "w string")
    got = rows.select(tx.normalize("w", profile).alias("a"), tx.normalize_stored("w", profile).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]


def test_lexicons_are_counted_once(spark, tables):
    for made in (inputs.base_lexicon, inputs.lemma_lexicon):
        lex = made(spark, tables)
        assert "regexp_extract_all" not in plan(lex)
        assert {r.form for r in lex.collect()} == {"motor", "motors", "wal", "waled"}


def test_shorthands_are_looked_up_once(spark):
    lex = settle(spark.createDataFrame([(0, "motor", "motor", 9.0, "")], "form_id long, form string, lemma string, freq double, tags string"))
    quick = spark.createDataFrame([("mtr", 1, "Motor", "motor")], "key string, ord int, form string, lemma string")
    queries = spark.createDataFrame([("q", "mtr")], "query_id string, input string")
    known = ex.Knowledge(lex, shortcuts=quick.filter("key != 'marked'"))
    got = ex.expand_tokens(queries, known, LATIN, limit=2)
    assert "marked" not in plan(got)
    assert [tuple(r)[:3] for r in got.collect()] == [("q", 1, "Motor")]


def test_paradigm_cells_are_not_broadcast(spark):
    lex = settle(spark.createDataFrame([(0, "wal", "wal", 9.0, "")], "form_id long, form string, lemma string, freq double, tags string"))
    added = lx.expand_paradigm_forms(lex, inputs.inflected_paradigms(lex), LATIN)
    assert not [part for part in broadcast_parts(added) if "Generate" in part]
    assert added.count() == 11


def test_features_are_not_joined_to_their_words_again(spark):
    rows = [("s", 1, "the"), ("s", 2, "x1"), ("s", 3, "the"), (None, 1, "the"), (None, 2, "the")]
    words = spark.createDataFrame(rows, "session_id string, pos long, word string")
    got = se.session_features(words, sessions.markers(spark), LATIN)
    assert len(re.findall(r"\bJoin ", plan(got))) == 1
    found = {(r.session_id, r.pos): (r.is_plain, r.last_tick, r.recency) for r in got.collect()}
    assert found[("s", 3)][:2] == (True, 1) and found[("s", 2)] == (False, None, None)
    # Words without a session have no earlier use.
    assert found[(None, 2)][1:] == (None, None) and len(found) == 5


def test_markers_are_known_to_be_few(spark):
    assert "LogicalRDD" not in plan(sessions.markers(spark))
    assert sorted(map(tuple, sessions.markers(spark).collect())) == sorted(sessions.MARKERS)


def test_turns_are_streamed_in_files_of_whole_conversations(spark, tables, tmp_path, monkeypatch):
    folders = iter(str(tmp_path / f"f{n}") for n in range(9))
    monkeypatch.setattr(streams, "_folder", lambda _: next(folders))
    got = streams.stream_session_features(spark, tables)
    assert len(list(Path(tmp_path, "f0/in/part=0").glob("*.parquet"))) > 1
    want = sessions.session_features(spark, tables)
    assert not got.filter("late").count()
    assert sorted(map(tuple, got.drop("late").collect())) == sorted(map(tuple, want.collect()))


def test_words_are_counted_as_written_before_they_are_normalised(spark):
    texts = spark.createDataFrame([("Ёж ёж ЁЖ еж Дом дом",), (None,)], "text string")
    counts = corpus.token_counts(texts, RU)
    assert {(r.word, r.cnt) for r in counts.collect()} == {("еж", 4), ("дом", 2)}
    assert plan(counts).count("Aggregate") == 2


def test_wanted_postings_are_made_once(spark):
    words = [("мотор", 5.0), ("мотив", 3.0), ("дом", 2.0)]
    lexicon = spark.createDataFrame(
        [(0, w, w, f, "") for w, f in words], "form_id bigint, form string, lemma string, freq double, tags string"
    )
    wanted = spark.createDataFrame([("form_prefix", "мот"), ("skel_prefix", "м")], "kind string, key string")
    postings = po.build_postings(lexicon, RU, wanted=wanted)
    assert "Generate" not in plan(postings)
    want = po.build_postings(lexicon, RU).join(wanted, ["kind", "key"]).select(postings.columns).collect()
    assert len(want) == 4 and sorted(postings.collect()) == sorted(want)
