"""Registered queries over postings, candidates and static signals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unbrev.catalog import oracle as o
from unbrev.catalog.inputs import P, base_lexicon, shorthand_queries
from unbrev.operators import postings as po
from unbrev.operators import retrieve as rt
from unbrev.settings import Settings

Run = Callable[[SparkSession, str], DataFrame]


def _postings(kind: str) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        built = po.build_postings(base_lexicon(spark, sf_dir), P, kinds=(kind,))
        return built.select("key", "form", F.col("bucket_rank").cast("bigint").alias("bucket_rank"))

    return run


def _candidates(*sources: int) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs = rt.retrieval_inputs(shorthand_queries(spark, sf_dir), P)
        wanted = rt.probes(inputs, P, Settings(), sources)
        built = po.build_postings(base_lexicon(spark, sf_dir), P, wanted=wanted)
        return rt.candidates(inputs, built, P, Settings(), sources).select(
            "norm_input", "form", "source_ord"
        )

    return run


def postings_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that the cap of a source trims, and by how many forms."""
    keyed = po.posting_keys(base_lexicon(spark, sf_dir), P)
    return po.trimmed_keys(keyed, Settings().per_source_cap)


def static_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = rt.retrieval_inputs(shorthand_queries(spark, sf_dir), P)
    built = po.build_postings(base_lexicon(spark, sf_dir), P, wanted=rt.probes(inputs, P))
    rows = rt.scored_candidates(inputs, built, P)
    return rows.select(
        "norm_input",
        "form",
        "source_ord",
        *[F.round(f"s_{s}", 6).alias(f"s_{s}") for s in ("skeleton", "suffix", "prefix", "edit", "freq")],
    )


def edit_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all candidate pairs within the cutoff."""
    inputs = rt.retrieval_inputs(shorthand_queries(spark, sf_dir), P)
    built = po.build_postings(base_lexicon(spark, sf_dir), P, wanted=rt.probes(inputs, P))
    return rt.scored_candidates(inputs, built, P).select("norm_input", "form", "distance")


def _ranked_keys(key: str, gate: str = "true") -> str:
    return o.with_(*o.lex()) + (
        "SELECT key, form, bucket_rank FROM (SELECT k.key, l.form, row_number() OVER "
        f"(PARTITION BY k.key ORDER BY l.freq DESC, l.form) AS bucket_rank FROM lex l, "
        f"LATERAL (SELECT unnest({key}) AS key) k WHERE {gate}) WHERE bucket_rank <= {o.CAP}"
    )


def _prefix_list(x: str, least: int) -> str:
    return f"list_transform(range({least}, length({x}) + 1), lambda n: left({x}, n))"


_ENDINGS = ", ".join(f"CASE WHEN ends_with(l.form, '{e}') THEN '{e}' END" for e in P.endings)


def _source_query(source: int) -> str:
    extra = o.fuzzy() if source == rt.FUZZY else []
    return o.with_(*o.lex(), *o.queries(), *extra) + o.source_sql(source)


_KEY_LISTS = {
    po.SKELETON: "[l.skel]",
    po.SKELETON_PREFIX: _prefix_list("l.skel", 1),
    po.FORM_PREFIX: _prefix_list("l.form", 3),
    po.ENDING: f"list_filter([{_ENDINGS}], lambda e: e IS NOT NULL)",
    po.SKELETON_DELETE: o.deletes("l.skel"),
}

SQL = {
    "postings_trimmed": o.with_(*o.lex())
    + f"SELECT kind, key, count(*) AS rows, count(*) - {o.CAP} AS trimmed FROM ("
    + " UNION ALL ".join(f"SELECT '{kind}' AS kind, unnest({keys}) AS key FROM lex l" for kind, keys in _KEY_LISTS.items())
    + f") GROUP BY kind, key HAVING count(*) > {o.CAP}",
    "postings_skeleton": _ranked_keys("[l.skel]"),
    "postings_skeleton_prefix": _ranked_keys(_prefix_list("l.skel", 1)),
    "postings_form_prefix": _ranked_keys(_prefix_list("l.form", 3)),
    "postings_ending": _ranked_keys(f"list_filter([{_ENDINGS}], lambda e: e IS NOT NULL)"),
    "postings_delete": _ranked_keys(o.deletes("l.skel")),
    **{f"candidates_{name}": _source_query(i) for i, name in enumerate(rt.SOURCE_NAMES)},
    "candidates_union": o.with_(*o.lex(), *o.queries(), *o.candidates())
    + "SELECT norm_input, form, source_ord FROM cand",
    "edit_distances": o.with_(*o.lex(), *o.queries(), *o.static_signals())
    + "SELECT norm_input, form, distance FROM sig",
    "static_signals": o.with_(*o.lex(), *o.queries(), *o.static_signals())
    + "SELECT norm_input, form, source_ord, round(s_skeleton, 6) AS s_skeleton, round(s_suffix, 6) AS s_suffix, "
    "round(s_prefix, 6) AS s_prefix, round(s_edit, 6) AS s_edit, round(s_freq, 6) AS s_freq FROM sig",
}
RUN: dict[str, Run] = {
    "postings_trimmed": postings_trimmed,
    "postings_skeleton": _postings(po.SKELETON),
    "postings_skeleton_prefix": _postings(po.SKELETON_PREFIX),
    "postings_form_prefix": _postings(po.FORM_PREFIX),
    "postings_ending": _postings(po.ENDING),
    "postings_delete": _postings(po.SKELETON_DELETE),
    **{f"candidates_{name}": _candidates(i) for i, name in enumerate(rt.SOURCE_NAMES)},
    "candidates_union": _candidates(*rt.ALL_SOURCES),
    "edit_distances": edit_distances,
    "static_signals": static_signals,
}
