"""SQL text pieces for the equivalent queries of the registered jobs."""

from __future__ import annotations

from unbrev.catalog.inputs import LEXICON_MIN_COUNT, P
from unbrev.settings import EditCosts, Settings, Weights

_ONE = f"[{P.raw_letter_class}]+"
WORD = f"{_ONE}(?:-{_ONE})*"
RUN = f"[{P.raw_letter_class}-]+"
S = Settings()


def norm(x: str) -> str:
    return f"translate(lower({x}), '{P.fold_from}', '{P.fold_to}')"


def skel(x: str) -> str:
    return f"translate({x}, '{P.vowels}', '')"


def words(table: str, column: str = "text", extra: str = "") -> str:
    """Select of the normalised words of a text column."""
    return (
        f"SELECT {extra}{norm('raw')} AS word FROM (SELECT {extra}"
        f"unnest(regexp_extract_all({column}, '{WORD}')) AS raw FROM {table})"
    )


def with_(*parts: tuple[str, str] | str) -> str:
    """A WITH list; every part is kept as a table of its own."""
    out = []
    for part in parts:
        if isinstance(part, str):
            out.append(part)
        else:
            name, body = part
            out.append(f"{name} AS MATERIALIZED ({body})")
    return "WITH RECURSIVE " + ",\n".join(out) + "\n"


def counts(name: str, table: str) -> tuple[str, str]:
    return name, f"SELECT word, count(*) AS cnt FROM ({words(table)}) GROUP BY word"


def lex(min_count: int = LEXICON_MIN_COUNT) -> list[tuple[str, str]]:
    """``lex(form, lemma, freq, skel)``."""
    return [
        counts("counts", "documents"),
        (
            "lex",
            f"SELECT word AS form, word AS lemma, cnt::DOUBLE AS freq, {skel('word')} AS skel "
            f"FROM counts WHERE cnt >= {min_count}",
        ),
    ]


def shorthand(x: str) -> str:
    kept = f"coalesce(CASE WHEN length({x}) > length({ending(x)}) + 1 THEN {ending(x)} END, '')"
    middle = skel(f"substr({x}, 2, length({x}) - 1 - length({kept}))")
    return f"left({x}, 1) || {middle} || {kept}"


PLAIN = f"^([{P.letter_class}]+(-[{P.letter_class}]+)*)?$"


def queries(table: str = "benchmark") -> list[tuple[str, str]]:
    """``qs(query_id, norm_input, skel)`` and the distinct, allowed ``inp``."""
    typed = shorthand("word")
    return [
        (
            "qs",
            f"SELECT word AS query_id, {typed} AS norm_input, {skel(typed)} AS skel "
            f"FROM (SELECT DISTINCT word FROM ({words(table)}))",
        ),
        allowed_inputs("qs"),
    ]


def allowed_inputs(source: str) -> tuple[str, str]:
    return (
        "inp",
        f"SELECT DISTINCT norm_input, skel FROM {source} "
        f"WHERE length(norm_input) >= {S.min_input_len} "
        f"AND regexp_matches(norm_input, '{PLAIN}')",
    )


def ending(x: str) -> str:
    ordered = sorted(P.endings, key=lambda e: -len(e))
    cases = " ".join(f"WHEN ends_with({x}, '{e}') THEN '{e}'" for e in ordered)
    return f"CASE {cases} END"


def deletes(x: str) -> str:
    return (
        f"CASE WHEN length({x}) >= 3 THEN list_distinct(list_transform("
        f"range(1, length({x}) + 1), lambda i: left({x}, i - 1) || substr({x}, i + 1)))"
        f" ELSE []::VARCHAR[] END"
    )


CAP, BUCKET = S.per_source_cap, S.fuzzy_bucket_cap
_BY_FREQ = "l.freq DESC, l.form"


def _top(source: int, condition: str, gate: str = "true") -> str:
    return (
        f"SELECT norm_input, form, {source} AS source_ord FROM (SELECT i.norm_input, l.form, "
        f"row_number() OVER (PARTITION BY i.norm_input ORDER BY {_BY_FREQ}) AS r "
        f"FROM inp i JOIN lex l ON {condition} WHERE {gate}) WHERE r <= {CAP}"
    )


def source_sql(source: int) -> str:
    """Candidates of one direct source, straight from its definition."""
    return {
        0: _top(0, "l.skel = i.skel"),
        1: _top(1, "starts_with(l.skel, i.skel)", "i.skel <> ''"),
        2: _top(
            2, "starts_with(l.skel, left(i.skel, length(i.skel) - 1))", "length(i.skel) >= 4"
        ),
        3: _top(3, "starts_with(l.form, i.norm_input)"),
        4: _top(4, f"ends_with(l.form, {ending('i.norm_input')})"),
        5: "SELECT norm_input, form, 5 AS source_ord FROM fuzzy",
    }[source]


def fuzzy() -> list[tuple[str, str]]:
    return [
        (
            "dels",
            f"SELECT d.key, l.form, l.freq, row_number() OVER (PARTITION BY d.key ORDER BY {_BY_FREQ}) AS r "
            f"FROM lex l, LATERAL (SELECT unnest({deletes('l.skel')}) AS key) d",
        ),
        (
            "exact_r",
            f"SELECT l.skel AS key, l.form, l.freq, row_number() OVER (PARTITION BY l.skel ORDER BY {_BY_FREQ}) AS r FROM lex l",
        ),
        (
            "inp_dels",
            f"SELECT norm_input, unnest({deletes('skel')}) AS key FROM inp WHERE length(skel) >= {S.fuzzy_min_skeleton}",
        ),
        (
            "fuzzy_all",
            f"SELECT i.norm_input, d.form, d.freq FROM inp i JOIN dels d ON d.key = i.skel AND d.r <= {BUCKET} "
            f"WHERE length(i.skel) >= {S.fuzzy_min_skeleton} "
            f"UNION SELECT i.norm_input, e.form, e.freq FROM inp_dels i JOIN exact_r e ON e.key = i.key AND e.r <= {BUCKET} "
            f"UNION SELECT i.norm_input, d.form, d.freq FROM inp_dels i JOIN dels d ON d.key = i.key AND d.r <= {BUCKET}",
        ),
        (
            "fuzzy",
            "SELECT norm_input, form FROM (SELECT *, row_number() OVER (PARTITION BY norm_input "
            f"ORDER BY freq DESC, form) AS r FROM fuzzy_all) WHERE r <= {CAP}",
        ),
    ]


def candidates() -> list[tuple[str, str]]:
    """``cand(norm_input, form, source_ord)`` over all six sources."""
    union = " UNION ALL ".join(source_sql(s) for s in range(6))
    return [
        *fuzzy(),
        (
            "cand",
            f"SELECT norm_input, form, min(source_ord) AS source_ord FROM ({union}) GROUP BY ALL",
        ),
    ]


_PAIRS = "|".join(a + b for a, near in P.neighbours.items() for b in near)


def _vowel(c: str) -> str:
    return f"contains('{P.vowels}', {c})"


def distances(pairs: str, a: str = "norm_input", b: str = "form") -> list[tuple[str, str]]:
    """``dist(a, b, d)``: the edit distance worked out one cell at a time."""
    c = EditCosts()
    ins = f"CASE WHEN {_vowel('substr(b, j, 1)')} THEN {c.insert_vowel} ELSE {c.insert_consonant} END"
    swap = (
        f"CASE WHEN substr(a, i, 1) = substr(b, j, 1) THEN 0 "
        f"WHEN contains('{_PAIRS}', substr(a, i, 1) || substr(b, j, 1)) THEN {c.substitute_neighbour} "
        f"WHEN {_vowel('substr(a, i, 1)')} AND {_vowel('substr(b, j, 1)')} THEN {c.substitute_vowel} "
        f"ELSE {c.substitute} END"
    )
    cell = (
        f"least(p[j] + {swap}, p[j + 1] + {c.delete}, r[j] + {ins}, "
        f"CASE WHEN i > 1 AND j > 1 AND substr(a, i, 1) = substr(b, j - 1, 1) "
        f"AND substr(a, i - 1, 1) = substr(b, j, 1) THEN p2[j - 1] + {c.transpose} ELSE 1000000 END)"
    )
    start = (
        f"list_transform(range(0, length(b) + 1), lambda k: "
        f"(length(left(b, k)) - length({skel('left(b, k)')})) * {c.insert_vowel} "
        f"+ length({skel('left(b, k)')}) * {c.insert_consonant})"
    )
    return [
        ("dp_pairs", f"SELECT DISTINCT {a} AS a, {b} AS b FROM {pairs}"),
        (
            "dp_seed",
            f"SELECT a, b, 1 AS i, 1 AS j, {start}::INT[] AS p2, {start}::INT[] AS p, "
            f"[({start})[1] + {c.delete}]::INT[] AS r FROM dp_pairs",
        ),
        # A finished row moves up; the next one starts with one more deletion.
        "dp AS (SELECT * FROM dp_seed UNION ALL "
        "SELECT a, b, CASE WHEN j < length(b) THEN i ELSE i + 1 END, "
        "CASE WHEN j < length(b) THEN j + 1 ELSE 1 END, "
        "CASE WHEN j < length(b) THEN p2 ELSE p END, "
        "CASE WHEN j < length(b) THEN p ELSE list_append(r, v) END, "
        f"CASE WHEN j < length(b) THEN list_append(r, v) ELSE [r[1] + {c.delete}]::INT[] END "
        f"FROM (SELECT *, ({cell})::INT AS v FROM dp WHERE i <= length(a)))",
        ("dist", "SELECT a, b, p[length(b) + 1] AS d FROM dp WHERE i = length(a) + 1"),
    ]


def common_prefix(a: str, b: str) -> str:
    return (
        f"len(list_filter(range(1, least(length({a}), length({b})) + 1), "
        f"lambda k: left({a}, k) = left({b}, k)))"
    )


def common_ending(a: str, b: str) -> str:
    def same(k: int) -> str:
        return f"(length({a}) >= {k} AND length({b}) >= {k} AND right({a}, {k}) = right({b}, {k}))"

    return f"CASE WHEN {same(3)} THEN 3 WHEN {same(2)} THEN 2 WHEN {same(1)} THEN 1 ELSE 0 END"


def static_signals() -> list[tuple[str, str]]:
    """``sig``: near candidates with their static signals."""
    return [
        *candidates(),
        *distances("cand"),
        (
            "sig",
            "SELECT c.norm_input, i.skel AS input_skel, c.form, l.lemma, l.freq, c.source_ord, t.d AS distance, "
            "CASE WHEN i.skel = l.skel THEN 1.0::DOUBLE WHEN i.skel = '' THEN 0.0::DOUBLE "
            f"ELSE {common_prefix('i.skel', 'l.skel')}::DOUBLE / length(i.skel) END AS s_skeleton, "
            f"({common_ending('c.norm_input', 'c.form')})::DOUBLE / 3.0::DOUBLE AS s_suffix, "
            f"{common_prefix('c.norm_input', 'c.form')}::DOUBLE / length(c.norm_input) AS s_prefix, "
            "t.d::DOUBLE / 20.0::DOUBLE AS s_edit, ln(1.0::DOUBLE + greatest(l.freq, 0.0::DOUBLE)) AS s_freq "
            "FROM cand c JOIN dist t ON t.a = c.norm_input AND t.b = c.form "
            "JOIN lex l ON l.form = c.form JOIN inp i ON i.norm_input = c.norm_input "
            f"WHERE t.d <= {S.cutoff_base} + {S.cutoff_per_char} * length(c.norm_input)",
        ),
    ]


def score(extra: dict[str, str] | None = None, w: Weights = Weights()) -> str:
    """The linear score; signals not given are 0."""
    sig = {
        "skeleton": "s_skeleton", "suffix": "s_suffix", "prefix": "s_prefix",
        "edit": "s_edit", "freq": "s_freq", **(extra or {}),
    }
    out = ""
    for name, value in w.as_dict().items():
        if name in sig:
            sign = " - " if name == "edit" else " + "
            out += f"{sign if out else ''}{value}::DOUBLE * {sig[name]}"
    return f"round({out}, 9)"


ORDER = "score DESC, source_ord, freq DESC, form, lemma"


def uniform(*parts: str) -> str:
    text = ", ".join(parts)
    return f"(('0x' || substr(md5(concat_ws(':', {text})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
