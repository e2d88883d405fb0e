"""Registered queries over labelled noise, evaluation and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unbrev.catalog import oracle as o
from unbrev.catalog.corpus import LM_PARTS
from unbrev.catalog.inputs import P, base_lexicon, table
from unbrev.plans import corpus
from unbrev.plans import evaluate as ev
from unbrev.plans import expand as ex
from unbrev.plans import noise
from unbrev.session import settle
from unbrev.settings import Settings, Weights

# The sampling operators draw this many cases.
DRAWS = 2000
SEED = 42
NOISE_WORDS = 10


def weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each word was drawn."""
    pool = noise.worth_shortening(
        base_lexicon(spark, sf_dir).select(F.col("form").alias("word"), (F.col("freq") + 1.0).alias("weight")), P
    )
    drawn = noise.weighted_draws(pool, "word", F.col("weight"), DRAWS, SEED)
    return drawn.select("draw", "word")


def noisy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = noise.synthesize_noisy_pairs(base_lexicon(spark, sf_dir), P, DRAWS, SEED)
    return cases.select("case_id", "input", "expected", "tag")


def noisy_context_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex, (_, bigrams) = _lm(spark, sf_dir)
    cases = noise.synthesize_noisy_pairs(lex, P, DRAWS, SEED, bigrams)
    return cases.withColumn("context", F.array_join("context", " "))


def _lm(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    lex = base_lexicon(spark, sf_dir)
    lines = corpus.text_lines(table(spark, sf_dir, "documents"))
    unigrams, bigrams = corpus.build_bigrams(lines, lex, P)
    return lex, (settle(unigrams), settle(bigrams))


def cases(lex: DataFrame) -> DataFrame:
    return settle(noise.synthesize_noisy_pairs(lex, P, DRAWS, SEED))


def evaluate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = base_lexicon(spark, sf_dir)
    rows = ev.evaluate(cases(lex), ex.Knowledge(lex), P)
    return rows.withColumns({c: F.round(c, 6) for c in ("rr", "savings", "margin")})


def evaluate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = base_lexicon(spark, sf_dir)
    rows = ev.metrics(ev.evaluate(cases(lex), ex.Knowledge(lex), P))
    numbers = [c for c, t in rows.dtypes if t == "double"]
    return rows.withColumns({c: F.round(c, 6) for c in numbers})


def evaluate_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of bigram-sampled cases with the pair statistics on."""
    lex, (unigrams, bigrams) = _lm(spark, sf_dir)
    drawn = settle(noise.synthesize_noisy_pairs(lex, P, DRAWS, SEED, bigrams))
    known = ex.Knowledge(lex, pmi=corpus.pmi_table(unigrams, bigrams))
    rows = ev.metrics(ev.evaluate(drawn, known, P))
    numbers = [c for c, t in rows.dtypes if t == "double"]
    return rows.withColumns({c: F.round(c, 6) for c in numbers})


def benchmark_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = base_lexicon(spark, sf_dir)
    known, drawn = ex.Knowledge(lex), cases(lex)
    queries = ev.as_queries(drawn)
    known = ev.with_static(queries, known, P, Settings())
    flat = ex.expand_tokens(queries, known, P, limit=ev.FLAT_K)
    return ev.misses(ev.evaluate(drawn, known, P), flat).distinct()


def _snapshot(drawn: DataFrame, known: ex.Knowledge, settings: Settings) -> DataFrame:
    groups = ex.expand_tokens_grouped(ev.as_queries(drawn), known, P, settings, 5)
    return ev.snapshot(drawn, groups)


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = base_lexicon(spark, sf_dir)
    return _snapshot(cases(lex), ex.Knowledge(lex), Settings())


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes when the frequency weight is doubled."""
    lex = base_lexicon(spark, sf_dir)
    drawn, known = cases(lex), ex.Knowledge(lex)
    known = ev.with_static(ev.as_queries(drawn), known, P, Settings())
    louder = Settings(weights=Weights(freq=1.2))
    return ev.diff_snapshots(
        _snapshot(drawn, known, Settings()), _snapshot(drawn, known, louder)
    )


VECTORS = ev.jittered_vectors(6)


def sweep_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = base_lexicon(spark, sf_dir)
    drawn = cases(lex)
    prepared = ex.prepare_queries(ev.as_queries(drawn), P)
    signals = ex.candidate_signals(prepared, ex.Knowledge(lex), P)
    rows = ev.sweep_weights(drawn, signals, VECTORS, P)
    return rows.withColumns({c: F.round(c, 6) for c in ("top1", "top3", "mrr", "objective")})


def sweep_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = base_lexicon(spark, sf_dir)
    rows = ev.sweep_recency(cases(lex), ex.Knowledge(lex), P)
    return rows.withColumns({c: F.round(c, 6) for c in ("positive", "adversarial", "blend")})


def evaluate_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = base_lexicon(spark, sf_dir)
    rows = ev.evaluate_recency(cases(lex), ex.Knowledge(lex), P, NOISE_WORDS)
    return rows.withColumns({c: F.round(c, 6) for c in ("top1", "top3")})


def competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = base_lexicon(spark, sf_dir)
    return ev.competitors(cases(lex), lex, P)


def _draw_sql(items: str) -> list[tuple[str, str]]:
    """``drawn(draw, _item)`` from ``items(_item, weight)``."""
    u = o.uniform(f"'{SEED}'", "'draw'", "range")
    return [
        (
            "line",
            "SELECT _item, weight, sum(weight) OVER (ORDER BY md5(_item), _item) AS hi, sum(weight) OVER () AS total "
            f"FROM {items}",
        ),
        (
            "drawn",
            f"SELECT d AS draw, _item FROM (SELECT range AS d, {u} AS u FROM range({DRAWS})) r JOIN line l "
            "ON r.u >= greatest((l.hi - l.weight) / l.total, 0) AND r.u < l.hi / l.total",
        ),
    ]


def _chance(what: str, *more: str) -> str:
    return o.uniform(f"'{SEED}'", f"'{what}'", "draw", "word", *more)


def _neighbours(c: str) -> str:
    cases_ = " ".join(f"WHEN '{a}' THEN '{near}'" for a, near in P.neighbours.items())
    return f"CASE {c} {cases_} ELSE '' END"


def _noise_sql(prev: str = "''") -> list[tuple[str, str]]:
    """``noisy(case_id, input, expected, tag, prev)`` from ``drawn`` words."""
    # The index of a character counts from 0 in the chances.
    keep_char = (
        "i = 1 OR i > tail_start OR NOT ("
        f"(contains('{P.vowels}', substr(word, i, 1)) AND {_chance('vowel', '(i - 1)')} < {noise.P_DROP_VOWEL}) OR "
        f"(substr(word, i - 1, 1) = substr(word, i, 1) AND {_chance('double', '(i - 1)')} < {noise.P_COLLAPSE}))"
    )
    return [
        (
            "n1",
            f"SELECT *, length(word) AS n, {_chance('mode')} AS mode, {_chance('keep')} < {noise.P_KEEP_ENDING} AS keep, "
            f"floor({_chance('tail')} * 2)::INT + 2 AS tail, {_chance('typo')} < {noise.P_TYPO} AS typo FROM drawn_words",
        ),
        ("n2", "SELECT *, greatest(n - CASE WHEN keep THEN tail ELSE 0 END, 1) AS tail_start FROM n1"),
        (
            "n3",
            "SELECT *, array_to_string(list_transform(list_filter(range(1, n + 1), lambda i: " + keep_char + "), lambda i: substr(word, i, 1)), '') AS thin, "
            f"left(word, (least(4, n - 1) + floor({_chance('cut')} * (n - least(4, n - 1))))::INT) AS cut FROM n2",
        ),
        ("n4", f"SELECT *, floor({_chance('pos')} * (length(thin) - 2))::INT + 2 AS spot FROM n3"),
        ("n5", f"SELECT *, {_neighbours('substr(thin, spot, 1)')} AS near FROM n4"),
        (
            "n6",
            "SELECT *, CASE "
            f"WHEN mode < {noise.P_TRUNCATE} THEN cut WHEN length(thin) < 3 OR length(thin) = n THEN NULL "
            f"WHEN typo AND length(thin) >= 4 THEN CASE WHEN {_chance('swap')} < 0.5 THEN left(thin, spot - 1) || substr(thin, spot + 1, 1) || "
            "substr(thin, spot, 1) || substr(thin, spot + 2) "
            f"WHEN near <> '' THEN left(thin, spot - 1) || substr(near, floor({_chance('near')} * length(near))::INT + 1, 1) || substr(thin, spot + 1) "
            "ELSE thin END ELSE thin END AS input, "
            f"CASE WHEN mode < {noise.P_TRUNCATE} THEN 'truncate' WHEN typo AND length(thin) >= 4 THEN 'typo' WHEN keep THEN 'ending' ELSE 'skeleton' END AS tag "
            "FROM n5",
        ),
        (
            "noisy",
            f"SELECT draw AS case_id, input, word AS expected, tag, {prev} AS prev FROM n6 WHERE input IS NOT NULL AND input <> word "
            "AND NOT (tag = 'truncate' AND input IN (SELECT form FROM lex))",
        ),
    ]


_POOL = (
    "pool",
    f"SELECT form AS _item, freq + 1.0 AS weight FROM lex WHERE length(form) >= 5 AND length(form) - length({o.skel('form')}) >= 2",
)
_PLAIN_NOISE = [
    _POOL,
    *_draw_sql("pool"),
    ("drawn_words", "SELECT draw, _item AS word FROM drawn"),
    *_noise_sql(),
]
_PAIR_NOISE = [
    _POOL,
    (
        "pair_pool",
        "SELECT prev || ' ' || word AS _item, prev, word, cnt::DOUBLE AS weight FROM bigrams WHERE word IN (SELECT _item FROM pool)",
    ),
    *_draw_sql("pair_pool"),
    ("drawn_words", "SELECT d.draw, p.word, p.prev FROM drawn d JOIN pair_pool p ON p._item = d._item"),
    *_noise_sql("prev"),
]


def _ranked_cases(noise_parts: list, lm: bool = False) -> list:
    """``scored`` candidates and flat ranks ``fl`` of the noisy cases."""
    extra = {"context": "coalesce(m.pmi, 0.0::DOUBLE)"} if lm else {}
    join = "LEFT JOIN pmi m ON m.prev = q.prev AND m.word = s.form" if lm else ""
    return [
        *o.lex(),
        *(LM_PARTS if lm else []),
        *noise_parts,
        (
            "qs",
            f"SELECT case_id AS query_id, prev, input AS norm_input, {o.skel('input')} AS skel FROM noisy",
        ),
        o.allowed_inputs("qs"),
        *o.static_signals(),
        (
            "scored",
            f"SELECT q.query_id, s.form, s.lemma, s.freq, s.source_ord, {o.score(extra)} AS score "
            f"FROM qs q JOIN sig s USING (norm_input) {join}",
        ),
        (
            "fl",
            f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {o.ORDER}) AS r FROM scored) WHERE r <= 10",
        ),
    ]


# Every word is its own lemma here, so groups are the top forms without variants.
_OUTCOMES = (
    "outcomes",
    "SELECT n.case_id, n.input, n.expected, n.tag, coalesce(h.r = 1, false) AS top1, coalesce(h.r <= 3, false) AS top3, "
    "coalesce(1.0::DOUBLE / h.r, 0.0) AS rr, greatest(0.0::DOUBLE, 1.0::DOUBLE - length(n.input)::DOUBLE / length(n.expected)) AS savings, "
    "a.score - b.score AS margin, coalesce(h.r <= 3, false) AS best_form_hit, coalesce(h.r <= 3, false) AS lemma_hit FROM noisy n "
    "LEFT JOIN fl h ON h.query_id = n.case_id AND h.form = n.expected LEFT JOIN fl a ON a.query_id = n.case_id AND a.r = 1 "
    "LEFT JOIN fl b ON b.query_id = n.case_id AND b.r = 2",
)
_METRICS = (
    "SELECT tag, grouping(tag)::INT AS overall, count(*) AS cases, round(avg(top1::INT), 6) AS top1, round(avg(top3::INT), 6) AS top3, "
    "round(avg(rr), 6) AS mrr, round(avg(CASE WHEN top1 THEN savings ELSE 0 END), 6) AS ks_realized, "
    "round(avg(CASE WHEN top3 THEN savings ELSE 0 END), 6) AS ks_oracle, round(avg(margin), 6) AS margin, "
    "round(avg(lemma_hit::INT), 6) AS lemma_hit, round(avg(best_form_hit::INT), 6) AS best_form_hit, "
    "round(avg((lemma_hit AND NOT best_form_hit)::INT), 6) AS hold_success FROM outcomes GROUP BY ROLLUP (tag)"
)
_RIVALS = (
    "rivals",
    "SELECT case_id, arg_min(form, r) AS competitor FROM noisy n JOIN (SELECT *, row_number() OVER (PARTITION BY skel ORDER BY freq DESC, form) AS r "
    f"FROM lex) l ON l.skel = {o.skel('n.input')} AND l.r <= 2 AND l.form <> n.expected GROUP BY case_id",
)


def _snapshot_sql(w: Weights) -> str:
    return (
        "SELECT input, '' AS context, coalesce(string_agg(form || ':' || printf('%.2f', score), '|' ORDER BY r), '') AS ranked FROM noisy n "
        "LEFT JOIN (SELECT query_id, form, score, row_number() OVER (PARTITION BY query_id ORDER BY "
        f"{o.ORDER}) AS r FROM (SELECT q.query_id, s.form, s.lemma, s.freq, s.source_ord, {o.score(None, w)} AS score FROM qs q JOIN sig s USING (norm_input))) g "
        "ON g.query_id = n.case_id AND g.r <= 5 GROUP BY n.case_id, input"
    )


def _vector_rows() -> str:
    rows = [
        "('" + name + "', " + ", ".join(f"{v}::DOUBLE" for v in w.as_dict().values()) + ")"
        for name, w in VECTORS.items()
    ]
    cols = ", ".join(f"w_{k}" for k in Weights().as_dict())
    return f"(VALUES {', '.join(rows)}) v(vector, {cols})"


_VECTOR_SCORE = (
    "round(w_skeleton * s_skeleton + w_suffix * s_suffix + w_prefix * s_prefix - w_edit * s_edit + w_freq * s_freq, 9)"
)

SQL = {
    "weighted_draws": o.with_(*o.lex(), _POOL, *_draw_sql("pool")) + "SELECT draw, _item AS word FROM drawn",
    "noisy_pairs": o.with_(*o.lex(), *_PLAIN_NOISE) + "SELECT case_id, input, expected, tag FROM noisy",
    "noisy_context_pairs": o.with_(*o.lex(), *LM_PARTS, *_PAIR_NOISE)
    + "SELECT case_id, input, expected, tag, prev AS context FROM noisy",
    "evaluate_outcomes": o.with_(*_ranked_cases(_PLAIN_NOISE), _OUTCOMES)
    + "SELECT * REPLACE (round(rr, 6) AS rr, round(savings, 6) AS savings, round(margin, 6) AS margin) FROM outcomes",
    "evaluate_metrics": o.with_(*_ranked_cases(_PLAIN_NOISE), _OUTCOMES) + _METRICS,
    "evaluate_context": o.with_(*_ranked_cases(_PAIR_NOISE, True), _OUTCOMES) + _METRICS,
    "benchmark_misses": o.with_(*_ranked_cases(_PLAIN_NOISE), _OUTCOMES)
    + "SELECT DISTINCT input, expected, tag, coalesce(got, '') AS got FROM outcomes t LEFT JOIN (SELECT query_id, "
    "string_agg(form, '|' ORDER BY r) AS got FROM fl WHERE r <= 3 GROUP BY query_id) g ON g.query_id = t.case_id WHERE NOT top3",
    "snapshot": o.with_(*_ranked_cases(_PLAIN_NOISE)) + "SELECT DISTINCT * FROM (" + _snapshot_sql(Weights()) + ")",
    "snapshot_diff": o.with_(*_ranked_cases(_PLAIN_NOISE), ("sa", _snapshot_sql(Weights())), ("sb", _snapshot_sql(Weights(freq=1.2))))
    + "SELECT input, context, a.ranked AS before, b.ranked AS after FROM (SELECT DISTINCT * FROM sa) a FULL JOIN (SELECT DISTINCT * FROM sb) b "
    "USING (input, context) WHERE a.ranked IS DISTINCT FROM b.ranked",
    "sweep_weights": o.with_(
        *_ranked_cases(_PLAIN_NOISE),
        (
            "hits",
            "SELECT vector, query_id, form, row_number() OVER (PARTITION BY vector, query_id ORDER BY vs DESC, source_ord, freq DESC, form) AS r "
            f"FROM (SELECT v.vector, q.query_id, s.form, s.source_ord, s.freq, {_VECTOR_SCORE} AS vs FROM qs q JOIN sig s USING (norm_input), {_vector_rows()})",
        ),
        (
            "vo",
            f"SELECT v.vector, n.case_id, n.tag, h.r FROM noisy n CROSS JOIN {_vector_rows()} LEFT JOIN hits h "
            "ON h.vector = v.vector AND h.query_id = n.case_id AND h.form = n.expected AND h.r <= 10",
        ),
        (
            "vt",
            "SELECT vector, tag, count(*) AS n, sum(coalesce(r = 1, false)::INT) AS t1, sum(coalesce(r <= 3, false)::INT) AS t3, "
            "sum(coalesce(1.0::DOUBLE / r, 0.0)) AS rr FROM vo GROUP BY ALL",
        ),
        (
            "vs",
            "SELECT a.vector, sum(a.n)::BIGINT AS cases, sum(a.t1)::DOUBLE / sum(a.n) AS top1, sum(a.t3)::DOUBLE / sum(a.n) AS top3, "
            "sum(a.rr) / sum(a.n) AS mrr, (sum(a.t1) + 0.3::DOUBLE * sum(a.t3) + 0.1::DOUBLE * sum(a.rr)) / sum(a.n) AS objective, "
            "bool_and(a.t3::DOUBLE / a.n >= coalesce(b.t3::DOUBLE / b.n, 0) - 0.005::DOUBLE) AS tags_ok FROM vt a LEFT JOIN vt b "
            "ON b.vector = 'baseline' AND b.tag = a.tag GROUP BY a.vector",
        ),
    )
    + "SELECT vector, cases, round(top1, 6) AS top1, round(top3, 6) AS top3, round(mrr, 6) AS mrr, round(objective, 6) AS objective, tags_ok, "
    "CASE WHEN tags_ok AND objective - (SELECT objective FROM vs WHERE vector = 'baseline') > 0.002 THEN 'ADOPT' ELSE 'KEEP' END AS verdict FROM vs",
    "competitors": o.with_(*o.lex(), *_PLAIN_NOISE, _RIVALS) + "SELECT case_id, competitor FROM rivals",
    "sweep_recency": o.with_(
        *_ranked_cases(_PLAIN_NOISE),
        _RIVALS,
        ("grid", "SELECT unnest([" + ", ".join(f"{w}::DOUBLE" for w in ev.RECENCY_GRID) + "]) AS w"),
        (
            "runs",
            "SELECT case_id, expected, 'positive' AS run, expected AS noted FROM noisy UNION ALL "
            "SELECT case_id, expected, 'adversarial', competitor FROM noisy JOIN rivals USING (case_id)",
        ),
        (
            "winners",
            "SELECT * FROM (SELECT g.w, r.run, r.case_id, s.form, row_number() OVER (PARTITION BY g.w, r.run, r.case_id ORDER BY "
            "round(s.score + CASE WHEN s.form = r.noted THEN g.w ELSE 0 END, 9) DESC, s.source_ord, s.freq DESC, s.form) AS b "
            "FROM runs r CROSS JOIN grid g JOIN scored s ON s.query_id = r.case_id) WHERE b = 1",
        ),
        (
            "rates",
            "SELECT g.w, r.run, avg(coalesce(x.form = r.expected, false)::INT) AS rate FROM runs r CROSS JOIN grid g LEFT JOIN winners x "
            "ON x.w = g.w AND x.run = r.run AND x.case_id = r.case_id GROUP BY ALL",
        ),
    )
    + "SELECT p.w AS w_recency, round(p.rate, 6) AS positive, round(a.rate, 6) AS adversarial, round(0.8 * p.rate + 0.2 * coalesce(a.rate, 0), 6) AS blend "
    "FROM rates p LEFT JOIN rates a ON a.w = p.w AND a.run = 'adversarial' WHERE p.run = 'positive'",
    "evaluate_recency": o.with_(
        *_ranked_cases(_PLAIN_NOISE),
        ("numbered", "SELECT form, row_number() OVER (ORDER BY freq DESC, form) - 1 AS spot FROM lex"),
        (
            "slots",
            f"SELECT case_id, expected, k, (floor({o.uniform(chr(39) + 'age' + chr(39), 'case_id')} * (SELECT count(*) FROM lex))::BIGINT + k) "
            f"% (SELECT count(*) FROM lex) AS spot FROM noisy, range(0, {NOISE_WORDS + 1}) t(k)",
        ),
        (
            "others",
            "SELECT * FROM (SELECT s.case_id, n.form, row_number() OVER (PARTITION BY s.case_id ORDER BY k) AS i FROM slots s "
            f"JOIN numbered n USING (spot) WHERE n.form <> s.expected) WHERE i <= {NOISE_WORDS}",
        ),
        (
            "used",
            "SELECT case_id, form, max(i) AS i FROM (SELECT * FROM others UNION ALL SELECT case_id, expected, 0 FROM noisy) GROUP BY ALL",
        ),
        ("ends", "SELECT case_id, max(i) AS all_i FROM used GROUP BY case_id"),
        (
            "warm",
            "SELECT s.*, round(s.score + coalesce(pow(0.5::DOUBLE, (e.all_i - u.i) / 80.0::DOUBLE), 0.0), 9) AS ws FROM scored s "
            "LEFT JOIN used u ON u.case_id = s.query_id AND u.form = s.form LEFT JOIN ends e ON e.case_id = s.query_id",
        ),
        (
            "wr",
            "SELECT query_id, form, row_number() OVER (PARTITION BY query_id ORDER BY ws DESC, source_ord, freq DESC, form) AS r FROM warm",
        ),
    )
    + "SELECT 'cold' AS variant, count(*) AS cases, round(avg(coalesce(h.r = 1, false)::INT), 6) AS top1, round(avg(coalesce(h.r <= 3, false)::INT), 6) AS top3 "
    "FROM noisy n LEFT JOIN fl h ON h.query_id = n.case_id AND h.form = n.expected UNION ALL "
    "SELECT 'warm', count(*), round(avg(coalesce(h.r = 1, false)::INT), 6), round(avg(coalesce(h.r <= 3, false)::INT), 6) "
    "FROM noisy n LEFT JOIN wr h ON h.query_id = n.case_id AND h.form = n.expected",
}
RUN = {name: globals()[name] for name in SQL}
