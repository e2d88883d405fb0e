"""Streams with state: batches against one run, late rows, timers, forgetting."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from unbrev.plans import sessions as se
from unbrev.profile import RU
from unbrev.streaming import sessions as st
from unbrev.streaming.history import run_to_table

WORDS = "session_id string, pos bigint, word string"
EVENTS = "event_id bigint, ts timestamp, user_id string, kind string"
DAY = dt.datetime(2024, 1, 1)


@pytest.fixture
def streamed(spark, tmp_path):
    """Runs a streaming plan over rows that come in several files, one a trigger."""
    st.use_state_store(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def run(batches, schema, plan):
        for number, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={number}")
        source = (
            spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        )
        run_to_table(plan(source), f"{tmp_path}/out", f"{tmp_path}/state")
        return spark.read.parquet(f"{tmp_path}/out").collect()

    yield run
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def _markers(spark):
    return spark.createDataFrame([("спасибо", 1.0), ("черт", -1.0)], "word string, sign double")


def test_features_over_batches_equal_the_batch_job(spark, streamed):
    text = "привет спасибо, слово привет 12 слово черт привет дом слово дом".split()
    rows = [(s, i + 1, w) for s in ("a", "b") for i, w in enumerate(text[: 11 if s == "a" else 6])]
    rows.append(("c", 1, "один"))
    batches = [[r for r in rows if r[1] <= 4], [r for r in rows if 4 < r[1] <= 7][::-1], [r for r in rows if r[1] > 7]]
    got = streamed(batches, WORDS, lambda w: st.stream_session_features(w, _markers(spark), RU, 3.0, 2.0, None))
    want = se.session_features(spark.createDataFrame(rows, WORDS), _markers(spark), RU, 3.0, 2.0).collect()

    def shown(r):
        return r.session_id, r.pos, r.norm, r.tick, round(r.recency or 0.0, 9), round(r.tone_score, 9), r.register

    assert sorted(map(shown, got)) == sorted(map(shown, want))
    assert not any(r.late for r in got)


def test_late_words_count_where_they_arrive(spark, streamed):
    batches = [[("a", 1, "слово"), ("a", 5, "дом")], [("a", 3, "слово"), ("a", 6, "дом")]]
    got = streamed(batches, WORDS, lambda w: st.stream_session_features(w, _markers(spark), RU, 2.0, 2.0, None))
    rows = [(r.pos, r.norm, r.tick, round(r.recency, 6), r.late) for r in sorted(got, key=lambda r: r.pos)]
    assert rows == [
        (1, "слово", 1, 0.0, False), (2, "дом", 2, 0.0, False),
        (3, "слово", 3, round(0.5 ** (1 / 2), 6), True), (4, "дом", 4, round(0.5 ** (1 / 2), 6), False),
    ]


def test_words_age_out_of_the_state(spark, streamed):
    """With an age of one millisecond every batch begins anew."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    batches = [[("a", 1, "слово")], [("a", 2, "слово"), ("a", 3, "слово")]]
    got = streamed(batches, WORDS, lambda w: st.stream_session_features(w, _markers(spark), RU, 2.0, 2.0, 1))
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert sorted((r.tick, r.recency) for r in got) == [(1, 0.0), (1, 0.0), (2, 1.0)]


class _Store:
    """A map state that counts what is asked of it."""

    def __init__(self):
        self.rows, self.reads, self.writes = {}, 0, 0

    def getValue(self, key):
        self.reads += 1
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.writes += 1
        self.rows[key] = value


def test_words_are_kept_in_pages(spark):
    """A batch asks the state store for pages, not for words, and a page stays small."""
    store, uses, tick, known, pages = _Store(), {}, 0, 0, 1
    for batch in range(40):
        said = [f"w{(batch * 37 + i * i) % 1500}" for i in range(100)]
        reads, writes = store.reads, store.writes
        held = st._Vocabulary(store, "=s", known, pages, 0, None)
        for word in said:
            tick += 1
            assert held.use(word, tick) == uses.get(word)
            uses[word] = tick
        held.write()
        known, pages = held.words, held.pages
        assert store.reads - reads <= pages and store.writes - writes <= pages
    assert known == len(uses) and pages == -(-known // st.PAGE_WORDS) and pages > 3
    sizes = [len(json.loads(value[0])) for value in store.rows.values()]
    assert sum(sizes) == known and max(sizes) <= 4 * st.PAGE_WORDS
    # Words age singly: those not used lately are gone, and their number with them.
    store, one = _Store(), st._Vocabulary
    first = one(store, "=s", 0, 1, 1000, 50)
    first.use("a", 1), first.use("b", 2), first.write()
    second = one(store, "=s", first.words, first.pages, 1040, 50)
    assert second.use("b", 3) == 2
    second.write()
    third = one(store, "=s", second.words, second.pages, 1060, 50)
    assert third.use("a", 4) is None and third.use("b", 5) == 3 and third.words == 2


def test_sessions_of_one_group_stay_apart(spark, streamed):
    """Numbers as sessions, one of them missing, all in one group."""
    rows = [(s, p, w) for s in (1, 2**53 + 1, None) for p, w in enumerate("слово дом слово дом".split(), start=1)]
    batches = [[r for r in rows if r[1] <= 2], [r for r in rows if r[1] > 2]]
    schema = "session_id bigint, pos bigint, word string"
    got = streamed(batches, schema, lambda w: st.stream_session_features(w, _markers(spark), RU, 2.0, 2.0, None, groups=1))
    want = [(s, p, w, p, 0.0 if p < 3 else round(0.5 ** (1 / 2), 6)) for s, p, w in rows]
    assert sorted(map(str, ((r.session_id, r.pos, r.norm, r.tick, round(r.recency, 6)) for r in got))) == sorted(map(str, want))


def _at(hours: float) -> dt.datetime:
    return DAY + dt.timedelta(hours=hours)


def _outcomes(rows):
    return sorted((r.event_id, r.status) for r in rows)


def test_last_pick_is_confirmed_by_the_timer(streamed):
    batches = [
        [(1, _at(0), "u", "pick"), (2, _at(1), "v", "pick")],
        # Another user's event moves the watermark past the first pick's time only.
        [(3, _at(2.5), "w", "type")],
        # Too late for the timer's verdict on 1; 2 is still open.
        [(4, _at(2.6), "u", "undo"), (5, _at(2.7), "v", "undo")],
    ]
    got = streamed(batches, EVENTS, lambda e: st.stream_resolve_picks(e, 2 * 3_600_000))
    assert _outcomes(got) == [(1, "confirmed"), (2, "reverted")]
    (first,) = [r for r in got if r.event_id == 1]
    assert first.resolved_ms == (_at(2) - dt.datetime(1970, 1, 1)) // dt.timedelta(milliseconds=1)


def test_the_next_event_decides_whatever_the_batches(streamed):
    batches = [
        [(1, _at(0), "u", "pick"), (2, _at(0.1), "u", "pick"), (3, _at(0.2), "u", "undo")],
        [(4, _at(0.3), "u", "pick")],
        [(5, _at(0.4), "u", "undo"), (6, _at(0.5), "u", "undo"), (7, _at(0.6), "u", "pick")],
        # An undo after the pick's time is too late, timer or not.
        [(8, _at(9), "u", "undo"), (9, _at(9.1), "u", "pick")],
    ]
    got = streamed(batches, EVENTS, lambda e: st.stream_resolve_picks(e, 3_600_000, "3 hours"))
    assert _outcomes(got) == [(1, "confirmed"), (2, "reverted"), (4, "reverted"), (7, "confirmed")]


def test_late_rows_do_not_undo_a_newer_pick(streamed):
    batches = [[(1, _at(5), "u", "pick")], [(2, _at(4), "u", "undo"), (3, _at(4.5), "u", "pick")], [(4, _at(5.5), "u", "undo")]]
    got = streamed(batches, EVENTS, lambda e: st.stream_resolve_picks(e, 3_600_000, "3 hours"))
    assert _outcomes(got) == [(1, "reverted"), (3, "confirmed")]
