"""Shards, gzipped names, logs and the remaining writers."""

from __future__ import annotations

import gzip
import json

from unbrev import RU
from unbrev.plans import corpus
from unbrev.plans import history as hi
from unbrev.sources import readers, writers


def test_shards_names_and_log(spark, tmp_path):
    posts = [
        {"text_markdown": "один", "comments": {"text_html": ["<p>два</p>"], "text_markdown": ["нет"]}},
        {"text_markdown": "три", "comments": {"text_html": [], "text_markdown": ["четыре"]}},
    ]
    shard = tmp_path / "s.jsonl"
    shard.write_text("\n".join(json.dumps(p, ensure_ascii=False) for p in posts) + "\n{broken", encoding="utf-8")
    texts = corpus.shard_texts(readers.read_shards(spark, str(shard)))
    assert {r.text.strip() for r in texts.collect()} == {"один", "два", "три", "четыре"}

    packed = tmp_path / "names.txt.gz"
    packed.write_bytes(gzip.compress("# имена\nИван\n\nАнна\n".encode()))
    names = readers.read_names(spark, str(packed), "first")
    assert {(r.name, r.kind) for r in names.collect()} == {("Иван", "first"), ("Анна", "first")}

    log = tmp_path / "log.jsonl"
    log.write_text('{"ts":1,"status":"reverted","shorthand":"првт","form":"Приват","user_id":"u"}\n', encoding="utf-8")
    counted = hi.history_from_log(readers.read_acceptance_log(spark, str(log)), RU)
    assert tuple(counted.first()) == ("u", "првт", "приват", 0, 1)
    writers.write_history(counted, str(tmp_path / "history"))
    again = readers.read_history(spark, str(tmp_path / "history"), "u")
    assert tuple(again.first()) == ("u", "првт", "приват", 0, 1)


def test_ngrams_and_cases_round_trip(spark, tmp_path):
    uni = spark.createDataFrame([("ну", 3)], "word string, cnt bigint")
    bi = spark.createDataFrame([("ну", "привет", 2)], "prev string, word string, cnt bigint")
    writers.write_ngrams(uni, bi, str(tmp_path / "lm"))
    back = readers.read_ngrams(spark, str(tmp_path / "lm"), RU)
    assert tuple(back[0].first()) == ("ну", 3) and tuple(back[1].first()) == ("ну", "привет", 2)
    cases = spark.createDataFrame(
        [("рбт", "работы", "case", ["для"]), ("првт", "привет", "x", [])],
        "input string, expected string, tag string, context array<string>",
    )
    writers.write_cases(cases, str(tmp_path / "cases"))
    got = readers.read_cases(spark, str(tmp_path / "cases")).drop("case_id").collect()
    assert sorted(map(str, got)) == sorted(map(str, cases.collect()))
