"""The stages of the pipeline on columns whose names they use inside."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

NAMES = """_tag _spans _doc tag doc spans row tokens weight probability kept _source _lang _topic _tokens
_initials lang_pred lang_score component_id n_shingles a.b""".split()


@pytest.fixture(scope="module")
def clashing(spark, odd_docs):
    """The odd rows with extra columns that tell to which row they belong."""
    kept = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    mark = F.concat_ws("/", F.col("doc_id").cast("string"), F.length("text").cast("string"))
    return kept.withColumns({n: F.concat(F.lit(f"{n}:"), mark) for n in NAMES})


def by_row(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in (r.doc_id, r.text)))


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]], ids=lambda s: s.__name__)
def test_extra_columns_pass_through(spark, clashing, odd_docs, stage):
    plain = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    got = stage(spark, clashing, "")
    assert got.schema.names == clashing.columns
    rows = got.collect()
    want = stage(spark, plain, "").collect()
    assert [r[:5] for r in by_row(rows)] == [tuple(r) for r in by_row(want)]
    given = {}
    for r in clashing.collect():
        given.setdefault(r.doc_id, set()).add(tuple(r[n] for n in NAMES))
    for r in rows:
        assert tuple(r[n] for n in NAMES) in given[r.doc_id]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=lambda s: s.__name__)
def test_empty_tables_stay_empty(spark, clashing, stage):
    assert stage(spark, clashing.filter(F.lit(False)), "").count() == 0


def test_last_stage_takes_clashing_columns(spark, clashing):
    out = corpus_pipeline.encode(spark, clashing, "")
    assert out.count() == clashing.count()
