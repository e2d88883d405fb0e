"""Lexicon, history and blocked-window jobs on small tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from unbrev import RU
from unbrev.operators import blocked
from unbrev.plans import history as hi
from unbrev.plans import lexicon as lx
from unbrev.sources import readers, writers


def lexicon(spark, rows):
    return spark.createDataFrame(
        [(i, f, l, float(q), t) for i, (f, l, q, t) in enumerate(rows, 1)],
        "form_id bigint, form string, lemma string, freq double, tags string",
    )


def test_calibration_only_raises_short_function_words_and_repeats(spark):
    rows = [("при", "при", 100, ""), ("по", "по", 9000, ""), ("дом", "дом", 500000, ""), ("город", "город", 500000, "")]
    dictionary = spark.createDataFrame(
        [("при", "pr", 1550.8), ("по", "pr", 3000.0), ("дом", "s", 9e6), ("благодаря", "pr", 9e6)],
        "lemma string, pos string, ipm double",
    )
    once = lx.calibrate_frequencies(lexicon(spark, rows), dictionary, RU)
    got = {r.form: r.freq for r in once.collect()}
    assert got == {"при": 1551.0, "по": 9000.0, "дом": 500000.0, "город": 500000.0}
    again = lx.calibrate_frequencies(once.drop("raised"), dictionary, RU)
    assert again.filter("raised").count() == 0


def test_expansion_stays_below_real_forms_and_repeats(spark):
    base = lexicon(spark, [("красный", "красный", 100, ""), ("слон", "слон", 1, "")])
    cells = spark.createDataFrame(
        [("красный", "sing", "masc", 1, "красный"), ("красный", "sing", "masc", 2, "красного"),
         ("красный", "plur", None, 1, "красные"), ("слон", "sing", None, 2, "слона"), ("кот", "sing", None, 1, "кот")],
        "lemma string, number string, gender string, case_ord int, form string",
    )
    added = lx.expand_paradigm_forms(base, cells, RU)
    assert {(r.form, r.freq, r.tags) for r in added.collect()} == {
        ("красного", 25.0, "ADJF masc,sing,gent"), ("красные", 25.0, "ADJF plur,nomn"),
    }
    assert lx.expand_paradigm_forms(base.unionByName(added), cells, RU).count() == 0


def test_history_laws_and_outcomes(spark):
    schema = "user_id string, skeleton string, form string, confirmed bigint, reverted bigint"
    a = spark.createDataFrame([("u", "првт", "привет", 1, 4)], schema)
    b = spark.createDataFrame([("u", "првт", "привет", 2, 0), ("u", "рбт", "работа", 1, 0)], schema)
    both = sorted(map(tuple, hi.merge_histories(a, b).collect()))
    assert both == sorted(map(tuple, hi.merge_histories(b, a).collect()))
    assert both[0] == ("u", "првт", "привет", 3, 4)
    assert hi.history_priors(a).first().prior < 0
    events = spark.createDataFrame(
        [(1, "u", "pick"), (2, "u", "undo"), (3, "u", "pick"), (4, "u", "type"), (5, "u", "pick")],
        "at bigint, user_id string, kind string",
    )
    got = hi.resolve_picks(events, "user_id", ["at"], F.floor(F.col("at") / 2))
    assert {r.at: r.status for r in got.collect()} == {1: "reverted", 3: "confirmed", 5: "confirmed"}


def test_blocked_windows_equal_plain_ones(spark):
    rng = random.Random(3)
    rows = [("ab"[rng.random() < 0.8], i, rng.randint(-5, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    block = [F.floor(F.col("i") / 16)]
    w = Window.partitionBy("k").orderBy("i")
    plain = df.select(
        "i", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"),
        F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"), F.row_number().over(w).cast("bigint").alias("r"),
    )
    out = blocked.running_total(df, ["k"], block, [F.col("i")], F.col("v"), "s")
    out = blocked.running_max(out, ["k"], block, [F.col("i")], F.col("v"), "m")
    out = blocked.neighbour(out, ["k"], block, ["i"], F.col("v"), "p")
    out = blocked.neighbour(out, ["k"], block, ["i"], F.col("v"), "n", following=True)
    out = blocked.row_numbers(out, ["k"], block, [F.col("i")], "r").select("i", "s", "m", "p", "n", "r")
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_readers(spark, tmp_path):
    names = write(tmp_path, "names.tsv", "Роман\tРоман\t1\tNOUN,Name\n")
    main = write(tmp_path, "lex.tsv", "# head\nроман\tроман\t50\n\nработе\tработа\t2e2\tNOUN,sing,loct\n")
    rows = readers.read_lexicon(spark, main, names).orderBy("form_id").collect()
    assert [(r.form, r.freq, r.tags) for r in rows] == [
        ("роман", 50.0, ""), ("работе", 200.0, "NOUN,sing,loct"), ("Роман", 1.0, "NOUN,Name"),
    ]
    with pytest.raises(readers.BadRows):
        readers.read_lexicon(spark, write(tmp_path, "bad.tsv", "a\tb\t1\tt\textra\n"))
    with pytest.raises(readers.BadRows):
        readers.read_lexicon(spark, write(tmp_path, "bad2.tsv", "a\tb\t1.5f\n"))
    uni, bi = readers.read_ngrams(spark, write(tmp_path, "lm.tsv", "u\tНу\t1\nu\tну\t2\nb\tну\tпривет\t3\n"), RU)
    assert tuple(uni.first()) == ("ну", 3) and tuple(bi.first()) == ("ну", "привет", 3)
    cuts = readers.read_shortcuts(spark, [write(tmp_path, "s.tsv", "МБ\tможет быть\nмб\tмегабайт\tмегабайт\n")], RU)
    assert [r.form for r in cuts.orderBy("ord").collect()] == ["может быть", "мегабайт"]
    marks = readers.read_tone_markers(spark, write(tmp_path, "t.tsv", "да\t+\nда\t-0.5\n"), RU)
    assert tuple(marks.first()) == ("да", -0.5)
    grid = readers.read_paradigms(spark, write(tmp_path, "p.tsv", "кот\tplur\tа|б|||д|\nкот\tsing\tк|||||\nкот\tdual\tк|||||\nх\ty\n"), RU)
    assert [r.form for r in lx.paradigm_forms(grid).orderBy("ord").collect()] == ["к", "а", "б", "д"]
    hist = readers.read_history(spark, write(tmp_path, "h.tsv", "првт\tпривет\t3\nпрвт\tприват\t1\t2\nbad\n"))
    assert {(r.form, r.confirmed, r.reverted) for r in hist.collect()} == {("привет", 3, 0), ("приват", 1, 2)}
    raw = readers.read_raw_frequencies(spark, write(tmp_path, "r.txt", "привет;привет;220.5\nмир 7\nx y z w\n"))
    assert raw.filter("ok").count() == 2
    built = {r.form: r.freq for r in lx.build_lexicon(raw.filter("ok"), RU).collect()}
    assert built == {"привет": 220.5, "мир": 7.0}
    cases = readers.read_cases(spark, write(tmp_path, "c.tsv", "рбт\tработы\tcase\tне для\nпрвт\tпривет\n")).orderBy("case_id").collect()
    assert [(c.tag, c.context) for c in cases] == [("case", ["не", "для"]), ("untagged", [])]
    masked = readers.read_mask_list(spark, write(tmp_path, "m.txt", "Редиска\n# x\nредиска\n"), RU)
    assert [r.lemma for r in masked.collect()] == ["редиска"]


def test_writers_round_trip(spark, tmp_path):
    base = lexicon(spark, [("б", "б", 5, ""), ("а", "а", 5, "NOUN"), ("в", "в", 7.5, "")])
    writers.write_lexicon(base, str(tmp_path / "lex"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "lex")).collect()]
    assert sorted(lines) == sorted(["в\tв\t7.5", "а\tа\t5\tNOUN", "б\tб\t5"])
    back = readers.read_lexicon(spark, str(tmp_path / "lex"))
    assert back.count() == 3


def test_names_and_their_forms_are_not_broadcast(spark):
    """Both sides of the join grow with the lexicon, and the driver would hold one."""
    names = spark.createDataFrame([("анна", "first"), ("анна", "first"), ("Дубов", "surname")], "name string, kind string")
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("number"), F.lit(e).alias("end")) for n, e in (("sing", "а"), ("plur", "ы"))]))
    forms = names.distinct().select(F.col("name").alias("lemma"), "name", "kind", cells.alias("c")).select(
        "name", "kind", "lemma", "c.number", F.lit("nomn").alias("case"), F.concat("lemma", "c.end").alias("form"), F.lit("N").alias("tags")
    )
    built = lx.build_names(names, forms)
    assert sorted((r.form, r.lemma) for r in built.collect()) == [("Аннаа", "Анна"), ("Дубова", "Дубов"), ("Дубовы", "Дубов")]
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
