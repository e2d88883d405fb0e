"""Counters taken by the jobs themselves, in batch and in streams."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from unbrev.plans import counters
from unbrev.plans.lexicon import lexicon_from_counts
from unbrev.profile import RU

RAW = "form string, lemma string, freq double"


def test_lexicon_build_counts_what_it_skips(spark):
    rows = [("дом", "дом", 5.0), ("Дом", "дома", 7.0), ("dom", "dom", 9.0), ("лес", "лес", 0.5), ("лес", "лес", None), (None, "x", 3.0)]
    made, found = counters.counted_lexicon(spark.createDataFrame(rows, RAW), RU, 1.0).finish()
    assert found == {"rows": 6, "skipped": 4, "entries": 1}
    assert [(r.form, r.freq) for r in made.collect()] == [("дом", 7.0)]


def test_ngram_and_calibration_builds(spark):
    lines = spark.createDataFrame([("дом и лес и",), ("",), ("лес и дом",)], "line string")
    known = lexicon_from_counts(spark.createDataFrame([("дом", 900), ("и", 2)], "word string, cnt bigint"))
    unigrams, pairs = counters.counted_ngrams(lines, known, RU, 1)
    assert unigrams.finish()[1] == {"lines": 3, "tokens": 7, "types": 2, "known_tokens": 5}
    assert pairs.finish()[1] == {"kept": 2, "kept_pairs": 2}
    floor = spark.createDataFrame([("и", "conj", 50_000.0), ("дом", "s", 1.0)], "lemma string, pos string, ipm double")
    assert counters.counted_calibration(known, floor, RU).finish()[1] == {"entries": 2, "raised": 1}


def test_counters_of_nothing_are_zero(spark):
    none = spark.createDataFrame([], RAW)
    assert counters.counted_lexicon(none, RU).finish()[1] == {"rows": 0, "skipped": 0, "entries": 0}


def test_stream_progress_is_summed_over_triggers(spark, tmp_path):
    for part, rows in enumerate([["дом", "x1"], ["лес"], []]):
        spark.createDataFrame([(w,) for w in rows], "word string").coalesce(1).write.parquet(f"{tmp_path}/in/p={part}")
    words = spark.readStream.schema("word string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    seen = words.observe("words", counters.all_rows().alias("rows"), counters.count_if(F.col("word").rlike("[0-9]")).alias("skipped"))
    listener = counters.ProgressCounters()
    spark.streams.addListener(listener)
    try:
        query = seen.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):
            if listener.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert {k: dict(v) for k, v in listener.totals.items()} == {"words": {"rows": 3, "skipped": 1}}
