"""Secret scans: fixed patterns, then sliding-window entropy over candidate strings.

The patterns give the base spans.  The method adds spans: every long run of token
characters is a candidate; it belongs to a character class by what it is made of; a
window slides over it, and its Shannon entropy is kept up to date by the two counts that
a step changes.  Windows at or above the class's threshold are joined to spans.
Candidates that the allow-list names are passed over.  Everything is built-in columns,
worked out inside each row, so nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unbrev.llm.ngram_ratio import let

# -- fixed values ------------------------------------------------------------------

#: Kind, pattern, least length.  The length is that of the second group of ``assign``
#: and of the whole match otherwise.  The last two ask for the length in the pattern, which
#: gives the same: a shorter match takes up a whole run, and no part of it would do.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 8), ("access", r"AKIA[A-Z0-9]{12,}", 16), ("hex", r"[0-9a-f]{32,}", 32))
KINDS = (*(kind for kind, _, _ in BASE), "entropy")

#: Characters of candidate strings, and their least number in a row.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Character classes, first fit counts: pattern of the whole candidate, least entropy of
#: a window in bits a character.  Candidates without a digit or without a letter have no
#: class, and are words or numbers.
CLASSES = (("[0-9A-Fa-f]+", 3.0), ("[0-9A-Za-z]+", 3.7), (r"[0-9A-Za-z+/_=-]+", 3.9))
#: Candidates that match are left alone: UUIDs, placeholders, runs of the keyboard.
ALLOWED = (
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Dd][Uu][Mm][Mm][Yy]",
    "[Xx]{6}|0{8}|123456789|abcdefgh|ABCDEFGH",
)

#: Entropies are compared as whole numbers of this part of a bit, so that neither the
#: order of additions nor the engine matters.
SCALE = 1 << 20


def surprise_table(window: int = WINDOW) -> list[int]:
    """``n * log2(n)`` for every possible count, in whole parts."""
    return [round(n * math.log2(n) * SCALE) if n else 0 for n in range(window + 1)]


def largest_sum(bits: float, window: int = WINDOW) -> int:
    """Largest sum of the table's values that a window of this entropy can have.

    The entropy is ``log2(window) - sum / window``.
    """
    return math.floor(window * (math.log2(window) - bits) * SCALE)


# -- places of matches ---------------------------------------------------------------

_STEP = 256


def running_sums(values: Column) -> Column:
    """Sums of the values up to each place, as ``array<bigint>``.

    Worked in steps, so that the cost stays near the length also for long arrays.
    """
    none = F.array().cast("array<bigint>")

    def inside(part: Column) -> Column:
        def add(sums: Column, x: Column) -> Column:
            return F.array_append(sums, F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0)) + x)

        return F.aggregate(part, none, add)

    def outside(acc: Column, part: Column) -> Column:
        def joined(sums: Column) -> Column:
            return F.struct(
                (acc["total"] + F.element_at(sums, -1)).alias("total"),
                F.array_append(acc["done"], F.transform(sums, lambda x: x + acc["total"])).alias("done"),
            )

        return let(inside(part), joined)

    parts = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _STEP).cast("int")),
        lambda i: F.slice(values, i * _STEP + 1, F.lit(_STEP)),
    )
    start = F.struct(
        F.lit(0).cast("bigint").alias("total"), F.array().cast("array<array<bigint>>").alias("done")
    )
    summed = F.flatten(F.aggregate(parts, start, outside)["done"])
    return F.when(F.size(values) == 0, none).otherwise(summed)


def matches(text: Column, pattern: str) -> Column:
    """All matches from left to right, as ``array<struct<start, end, word>>``.

    Code points from 0, end exclusive.  What lies between the matches gives the places.
    """

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        lengths = F.zip_with(
            F.transform(found, lambda m: F.length(m)),
            F.slice(gaps, F.lit(1), F.size(found)),
            lambda n, gap: (n + F.length(gap)).cast("bigint"),
        )
        return F.zip_with(
            found,
            running_sums(lengths),
            lambda m, end: F.struct(
                (end - F.length(m)).alias("start"), end.alias("end"), m.alias("word")
            ),
        )

    none = F.array().cast("array<struct<start:bigint,end:bigint,word:string>>")
    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) == 0, none).otherwise(placed(found)),
    )


def _span(kind: int, start: Column, end: Column) -> Column:
    """Sorts by start, then kind."""
    return F.struct(
        start.cast("bigint").alias("start"), F.lit(kind).alias("kind"), end.cast("bigint").alias("end")
    )


def base_spans(text: Column, number: int) -> Column:
    """Spans of one kind; matches that are too short are dropped after matching."""
    kind, pattern, least = BASE[number]

    def long_enough(m: Column) -> Column:
        value = F.regexp_extract(m["word"], pattern, 2) if kind == "assign" else m["word"]
        return F.length(value) >= least

    kept = F.filter(matches(text, pattern), long_enough)
    return F.transform(kept, lambda m: _span(number, m["start"], m["end"]))


# -- entropy -------------------------------------------------------------------------


def _limit(word: Column) -> Column:
    """Largest sum of a window that counts, by the candidate's class; null: no class."""
    out = F.lit(None).cast("bigint")
    for pattern, bits in reversed(CLASSES):
        out = F.when(word.rlike(f"^{pattern}$"), F.lit(largest_sum(bits)).cast("bigint")).otherwise(out)
    return F.when(word.rlike("[0-9]") & word.rlike("[A-Za-z]"), out)


def window_spans(word: Column, limit: Column) -> Column:
    """Spans of ``word`` covered by windows of high entropy, from 0, joined.

    One pass: a step takes one character in and one out, and the sum over the window
    changes by the table's differences at these two counts.
    """
    numbers = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    table = F.array(*[F.lit(v).cast("bigint") for v in surprise_table()])
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"),
        F.lit(0).cast("bigint").alias("total"),
        F.lit(-1).alias("begin"),
        F.lit(-1).alias("end"),
        F.array().cast("array<struct<start:int,end:int>>").alias("done"),
    )

    def walk(letters: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            new = F.get(letters, i)
            old = F.when(i >= WINDOW, F.get(letters, i - WINDOW)).otherwise(F.lit(-1))

            def change(at: Column, by: int) -> Column:
                have = F.get(acc["counts"], at)
                return F.get(table, have + by) - F.get(table, have)

            moved = F.when(old.eqNullSafe(new), F.lit(0)).otherwise(
                change(new, 1) + F.when(old >= 0, change(old, -1)).otherwise(F.lit(0))
            )
            counts = F.transform(
                acc["counts"],
                lambda c, j: c + (j == new).cast("int") - (j == old).cast("int"),
            )
            total = acc["total"] + moved

            def after(sum_now: Column) -> Column:
                hot = (i >= WINDOW - 1) & (sum_now <= limit)
                begin = i - (WINDOW - 1)
                joins = hot & (acc["end"] >= begin)
                closed = F.array_append(
                    acc["done"], F.struct(acc["begin"].alias("start"), acc["end"].alias("end"))
                )
                return F.struct(
                    counts.alias("counts"),
                    sum_now.alias("total"),
                    F.when(hot & ~joins, begin).otherwise(acc["begin"]).alias("begin"),
                    F.when(hot, i + 1).otherwise(acc["end"]).alias("end"),
                    F.when(hot & ~joins & (acc["end"] >= 0), closed).otherwise(acc["done"]).alias("done"),
                )

            return let(total, after)

        def all_of(acc: Column) -> Column:
            last = F.struct(acc["begin"].alias("start"), acc["end"].alias("end"))
            return F.when(acc["end"] >= 0, F.array_append(acc["done"], last)).otherwise(acc["done"])

        return let(F.aggregate(F.sequence(F.lit(0), F.size(letters) - 1), start, step), all_of)

    return let(numbers, walk)


def entropy_spans(text: Column, allowed: Sequence[str] = ALLOWED) -> Column:
    """Spans of high entropy of all candidates that are not on the allow-list."""

    def suspect(m: Column) -> Column:
        fine = F.lit(False)
        for pattern in allowed:
            fine = fine | m["word"].rlike(pattern)
        return _limit(m["word"]).isNotNull() & ~fine

    def spans(m: Column) -> Column:
        return F.transform(
            let(_limit(m["word"]), lambda limit: window_spans(m["word"], limit)),
            lambda s: _span(len(BASE), m["start"] + s["start"], m["start"] + s["end"]),
        )

    found = F.filter(matches(text, CANDIDATE), suspect)
    return F.flatten(F.transform(found, spans))


# -- report --------------------------------------------------------------------------


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]),
        ),
        ",",
    )


def scan(docs: DataFrame, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """``doc_id`` and the spans ``(start, kind, end)`` found in every row.

    Columns ``base`` and ``added``; ``kind`` is the place in :data:`KINDS`.  An added span
    that lies inside a base span is left out.  Null and empty texts have none; repeated
    rows are scanned one by one; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    kinds = [base_spans(text, number) for number in range(len(BASE))]
    added = entropy_spans(text, allowed)
    rows = docs.select("doc_id", *[k.alias(f"k{i}") for i, k in enumerate(kinds)], added.alias("more"))
    base = F.concat(*[F.col(f"k{i}") for i in range(len(BASE))])

    def covered(s: Column) -> Column:
        return F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))

    return rows.select("doc_id", base.alias("base"), F.filter("more", lambda s: ~covered(s)).alias("added"))


def secret_report(docs: DataFrame, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy`` of every row
    of ``docs (doc_id, text)``; see :func:`scan`."""
    rows = scan(docs, allowed)

    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("bigint")

    counts = [count(i).alias(f"n_{kind}") for i, (kind, _, _) in enumerate(BASE)]
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("bigint").alias("n_entropy"),
    )
