"""Registered query over the counters of builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unbrev.catalog import corpus as c
from unbrev.catalog import lexicons as lx
from unbrev.catalog import oracle as o
from unbrev.catalog.inputs import P, base_lexicon, inflected_paradigms, table
from unbrev.plans import corpus, counters


def build_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(build, counter, value)`` of the lexicon, n-gram, calibration and form builds,
    each counted by the job that writes its table.  The builds' numbers, thirteen in all,
    pass the driver."""
    lines = corpus.text_lines(table(spark, sf_dir, "documents"))
    known = base_lexicon(spark, sf_dir)
    unigrams, pairs = counters.counted_ngrams(lines, known, P, c.BIGRAM_MIN)
    builds = {
        "lexicon": counters.counted_lexicon(c.raw_frequencies(spark, sf_dir), P, 2.0),
        "unigrams": unigrams,
        "bigrams": pairs,
        "calibration": counters.counted_calibration(known, lx.balanced_dictionary(spark, sf_dir), P),
        "forms": counters.counted_forms(known, inflected_paradigms(known), P),
    }
    rows = [(name, k, int(v)) for name, build in builds.items() for k, v in build.finish()[1].items()]
    return spark.createDataFrame(rows, "build string, counter string, value bigint")


def _row(build: str, counter: str, value: str) -> str:
    return f"SELECT '{build}' AS build, '{counter}' AS counter, coalesce(({value}), 0)::BIGINT AS value"


_RAW = (
    "SELECT raw, lang, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, "
    f"'{o.WORD}')) AS raw FROM documents) GROUP BY ALL"
)
_LINES = "(SELECT string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)"
_GRAMS = o.with_(*o.lex(), *c.LM_PARTS)

SQL = {
    "build_counters": " UNION ALL ".join(
        "SELECT * FROM (" + q + ")"
        for q in (
            _row("lexicon", "rows", f"SELECT count(*) FROM ({_RAW})"),
            _row("lexicon", "skipped", f"SELECT count(*) FROM ({_RAW}) WHERE n < 2"),
            _row("lexicon", "entries", f"SELECT count(*) FROM ({c.SQL['lexicon_build']})"),
            _row("unigrams", "lines", f"SELECT sum(len(ls)) FROM {_LINES}"),
            _row("unigrams", "tokens", f"{_GRAMS} SELECT count(*) FROM pos"),
            _row("unigrams", "types", f"{_GRAMS} SELECT count(*) FROM unigrams"),
            _row("unigrams", "known_tokens", f"{_GRAMS} SELECT sum(cnt) FROM unigrams"),
            _row("bigrams", "kept", f"{_GRAMS} SELECT count(*) FROM bigrams"),
            _row("bigrams", "kept_pairs", f"{_GRAMS} SELECT sum(cnt) FROM bigrams"),
            _row("calibration", "entries", f"SELECT count(*) FROM ({lx.SQL['calibrate']})"),
            _row("calibration", "raised", f"SELECT count(*) FROM ({lx.SQL['calibrate']}) WHERE raised"),
            _row("forms", "added", f"SELECT count(*) FROM ({lx.SQL['expand_forms']})"),
        )
    )
}
RUN = {name: globals()[name] for name in SQL}
