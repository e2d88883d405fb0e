"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed up per cell (source, language, topic).  Raking then scales the cell
weights until the weighted tokens have the target shares of all three marginals.
Documents are sampled with the calibrated probability of their cell.  Everything is
built-in columns; what is iterated over is the table of cells, never the documents.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unbrev.llm.common import SEPARATOR_CLASS, packed, unpacked
from unbrev.session import settle

#: Topics: initial letters of words that vote for them.
TOPICS = {"a-f": "abcdef", "g-n": "ghijklmn", "o-s": "opqrs", "t-z": "tuvwxyz"}
NO_TOPIC = "none"
#: Target share of a value: its observed share to this power, rescaled to sum to 1.
TARGETS = {"source": 0.5, "lang": 0.7, "topic": 0.25}
FRACTION = 0.6
ROUNDS = 12
CAP_ROUNDS = 8


def initials(text: Column) -> Column:
    """The first character of every word of a text, in order, A-Z in lower case."""
    gap = SEPARATOR_CLASS
    own = gap.replace("[", "[^")
    firsts = F.regexp_replace(text, f"{gap}*({own}){own}*{gap}*", "$1")
    return F.translate(firsts, "ABCDEFGHIJKLMNOPQRSTUVWXYZ \t\n\x0b\f\r", "abcdefghijklmnopqrstuvwxyz")


def with_cells(docs: DataFrame) -> DataFrame:
    """Add ``_source, _lang, _topic, _tokens``.

    A null source or language counts as the empty name.  The topic has most words
    whose initial votes for it, the first on a tie; without a vote it is ``none``.
    """
    marks = docs.withColumn("_initials", initials(F.coalesce("text", F.lit(""))))
    size = F.length("_initials")
    votes = [
        F.length(F.translate("_initials", "".join(s for n, s in TOPICS.items() if n != name), ""))
        - F.length(F.translate("_initials", "".join(TOPICS.values()), ""))
        for name in TOPICS
    ]
    counted = marks.withColumn("_tokens", size.cast("bigint")).withColumn("_votes", F.array(*votes))
    most = F.array_max("_votes")
    topic = F.element_at(
        F.array(*map(F.lit, TOPICS)), F.array_position("_votes", most).cast("int")
    )
    return counted.withColumns(
        {
            "_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
            "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
            "_topic": F.when(most > 0, topic).otherwise(NO_TOPIC),
        }
    ).drop("_initials", "_votes")


def rake(cells: DataFrame, targets: Mapping[str, float] = TARGETS, rounds: int = ROUNDS) -> DataFrame:
    """Cells ``(_source, _lang, _topic, tokens)`` with ``weight``.

    A round scales the weights to each marginal in turn; the last marginal holds
    exactly afterwards, the others as closely as the rounds allow.  Cells without
    tokens keep what their values give.
    """
    out = cells.withColumn("_total", cells.agg(F.sum("tokens")).scalar())
    for name, power in targets.items():
        own = Window.partitionBy(f"_{name}")
        share = F.sum("tokens").over(own) / F.col("_total")
        out = out.withColumn(f"_p_{name}", F.when(share > 0, F.pow(share, F.lit(power))).otherwise(0.0))
    for name in targets:
        values = out.groupBy(f"_{name}").agg(F.first(f"_p_{name}").alias("p"))
        norm = values.agg(F.sum("p").alias(f"_n_{name}"))
        out = out.withColumn(f"_p_{name}", F.col(f"_p_{name}") * F.col("_total") / norm.scalar())
    out = settle(out.withColumn("weight", F.lit(1.0)))
    for done in range(1, rounds + 1):
        for name in targets:
            now = F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(f"_{name}"))
            out = out.withColumn("_now", now).withColumn(
                "weight",
                F.when(F.col("_now") > 0, F.col("weight") * F.col(f"_p_{name}") / F.col("_now")).otherwise(
                    F.col("weight")
                ),
            )
        if done % 6 == 0 or done == rounds:
            out = settle(out.drop("_now"))
    return out.select("_source", "_lang", "_topic", "tokens", "weight")


def calibrate(cells: DataFrame, fraction: float = FRACTION, rounds: int = CAP_ROUNDS) -> DataFrame:
    """Add ``probability = min(1, c * weight)``, with ``c`` such that the expected
    tokens are the fraction of all.

    Cells that reach 1 leave the rest of the budget to the others; each round is
    one row of sums.
    """
    factor = 0.0
    tokens, weight = F.col("tokens"), F.col("weight")
    for step in range(rounds):
        full = (weight * factor >= 1.0) if step else F.lit(False)
        row = cells.agg(
            F.coalesce(F.sum("tokens"), F.lit(0)).cast("double").alias("all"),
            F.coalesce(F.sum(F.when(full, tokens)), F.lit(0)).cast("double").alias("full"),
            F.coalesce(F.sum(F.when(~full, tokens * weight)), F.lit(0.0)).alias("rest"),
        ).first()
        if row["rest"] <= 0:
            break
        factor = (fraction * row["all"] - row["full"]) / row["rest"]
    return cells.withColumn("probability", F.least(F.lit(1.0), weight * factor))


def uniform(key: Column) -> Column:
    """A number from 0 to 1 by the key's text, the same on every run."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def mix(
    docs: DataFrame,
    targets: Mapping[str, float] = TARGETS,
    fraction: float = FRACTION,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``docs`` with ``_source, _lang, _topic, _tokens, weight, probability, kept``.

    Every row gets its cell's weight and probability and is kept if the number of
    its ``doc_id`` is smaller; repeated rows share their fate, a null id counts as an
    empty one, and a row without words is in its cell with 0 tokens.  Columns of the
    added names are replaced.  An empty table stays empty.  The cells are few (values
    of three columns) and are written once; the planner chooses the join by their
    size.
    """
    placed = with_cells(docs.drop("weight", "probability", "kept", "tokens"))
    cells = placed.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens"))
    weighed = settle(calibrate(settle(rake(cells, targets, rounds)), fraction).drop("tokens"))
    return placed.join(weighed, ["_source", "_lang", "_topic"]).withColumn(
        "kept", uniform(F.col("doc_id")) < F.col("probability")
    )


def sample(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`mix` keeps, with all their columns and no others,
    whatever their names; ``options`` are those of :func:`mix`."""
    keys = ("doc_id", "text", "source", "lang")
    return unpacked(mix(packed(docs, *keys), **options).filter("kept"), docs.columns, *keys)
