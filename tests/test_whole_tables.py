"""Rows that caps, nulls, files or hot keys could lose."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from unbrev import LATIN, session
from unbrev.operators.blocked import neighbour, running_max, running_total
from unbrev.operators.skew import sliced_join
from unbrev.plans import corpus
from unbrev.plans import history as hi
from unbrev.plans import sessions as se
from unbrev.plans.lexicon import lexicon_from_counts
from unbrev.sources import readers, writers

EVENTS = [
    (1, "a", 10, "x"), (2, "a", 20, "x"), (3, "a", 5000, None), (4, "a", 5001, None),
    (5, "a", None, "y"), (6, None, 7, None), (7, None, 8, "x"), (8, None, 9000, "x"),
    (9, "b", 1, "x"), (10, "b", 1, "x"), (11, "b", 2, None), (12, None, None, None),
]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(EVENTS, "id bigint, user string, at bigint, kind string")


def test_blocked_operators_keep_rows_with_null_keys(events):
    block, order = [F.floor(F.col("at") / 1000)], [F.col("at"), F.col("id")]
    plain = Window.partitionBy("user").orderBy("at", "id")
    total = running_total(events, ["user"], block, order, F.col("id"), "sum")
    want = events.withColumn("sum", F.sum("id").over(plain.rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted(map(str, total.select("id", "sum").collect())) == sorted(
        map(str, want.select("id", "sum").collect())
    )
    most = running_max(events, ["user"], block, order, F.col("id"), "most")
    want = events.withColumn("most", F.max("id").over(plain.rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted(map(str, most.select("id", "most").collect())) == sorted(
        map(str, want.select("id", "most").collect())
    )
    prev = neighbour(events, ["user"], block, ["at", "id"], F.col("kind"), "prev")
    want = events.withColumn("prev", F.lag("kind").over(plain))
    assert sorted(map(str, prev.select("id", "prev").collect())) == sorted(
        map(str, want.select("id", "prev").collect())
    )


def test_sessions_with_missing_user_time_and_context(events):
    block = F.floor(F.col("at") / 1000)
    got = se.number_sessions(events, "user", ["at", "id"], "kind", block)
    order = Window.partitionBy("user").orderBy("at", "id")
    first = F.row_number().over(order) == 1
    step = (first | ~F.lag("kind").over(order).eqNullSafe(F.col("kind"))).cast("bigint")
    want = events.withColumn("step", step).withColumn(
        "session_no", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    assert {(r.id, r.session_no) for r in got.collect()} == {
        (r.id, r.session_no) for r in want.collect()
    }


def test_log_time_is_milliseconds(spark, tmp_path):
    day = 86_400_000
    rows = [
        {"ts": 1_700_000_000_000 + n * day, "status": "reverted", "shorthand": "thr", "form": form}
        for form, days in (("there", (0, 1, 2)), ("three", (0, 10, 20)))
        for n in days
    ]
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)), encoding="utf-8")
    found = hi.earned_exceptions(readers.read_acceptance_log(spark, str(path))).collect()
    assert [(r.form, r.most_reverts) for r in found] == [("there", 3)]


def test_history_keeps_its_users(spark, tmp_path):
    rows = [("u1", "thr", "there", 3, 0), ("u2", "thr", "there", 1, 2), ("u2", "nn", "none", 0, 0)]
    history = spark.createDataFrame(
        rows, "user_id string, skeleton string, form string, confirmed bigint, reverted bigint"
    )
    writers.write_history(history, str(tmp_path / "h"))
    back = readers.read_history(spark, str(tmp_path / "h"))
    assert sorted(map(tuple, back.collect())) == sorted(rows[:2])


def test_lines_of_several_files_are_numbered_in_order(spark, tmp_path):
    # The second file is larger, so the planner would take it first.
    (tmp_path / "part-0").write_text("a\tx\nb\tx\n", encoding="utf-8")
    (tmp_path / "part-1").write_text("".join(f"w{i}\tx\n" for i in range(500)), encoding="utf-8")
    lines = readers.numbered_lines(spark, str(tmp_path)).orderBy("line_id").collect()
    assert [r.raw[0] for r in lines[:3]] == ["a", "b", "w"] and len(lines) == 502
    assert [r.raw for r in lines[2:]] == [f"w{i}\tx" for i in range(500)]
    one = readers.numbered_lines(spark, str(tmp_path / "part-0"))
    assert [r.line_id for r in one.orderBy("line_id").collect()] == [1, 2]


def test_all_pairs_are_kept_unless_asked(spark):
    words = ["".join(chr(97 + i // 26 ** k % 26) for k in range(3)) for i in range(60)]
    lines = spark.createDataFrame([(" ".join(words[i:] + words[:i]),) for i in range(60)], "line string")
    counts = corpus.token_counts(lines, LATIN, "line")
    lexicon = lexicon_from_counts(counts, 1)
    _, every = corpus.build_bigrams(lines, lexicon, LATIN, min_count=1)
    _, some = corpus.build_bigrams(lines, lexicon, LATIN, top=7, min_count=1)
    assert every.count() == 60 and some.count() == 7


@pytest.mark.parametrize("hot", ["left", "right", "both"])
def test_hot_keys_on_either_side(spark, hot):
    many = [(1, i) for i in range(300)] + [(2, 1), (3, 1)]
    few = [(1, 7), (1, 8), (2, 1), (4, 1)]
    left = spark.createDataFrame(many if hot != "right" else few, "k bigint, a bigint")
    right = spark.createDataFrame(many if hot != "left" else few, "k bigint, b bigint")
    got = sliced_join(left, right, ["k"], ["a"], slice_rows=50)
    want = left.join(right, "k")
    assert sorted(map(tuple, got.select("k", "a", "b").collect())) == sorted(
        map(tuple, want.select("k", "a", "b").collect())
    )


def test_a_cluster_must_name_the_shared_folder(monkeypatch):
    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf(**values)

    with pytest.raises(ValueError):
        session.shared_folder(Session(**{"spark.master": "spark://host:7077"}))
    with pytest.raises(ValueError):
        session.shared_folder(Session(**{"spark.master": "local-cluster[2,1,1024]"}))
    named = {"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://store/x"}
    assert session.shared_folder(Session(**named)) == "hdfs://store/x"
    monkeypatch.setattr(session, "_LOCAL_FOLDER", "/tmp/here")
    assert session.shared_folder(Session(**{"spark.master": "local[4]"})) == "/tmp/here"
