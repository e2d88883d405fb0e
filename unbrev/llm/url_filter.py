"""URL filters: host and path rules, then a list of canonical URLs.

The list is looked up in two steps.  A blocked Bloom filter of fixed size tells for
most URLs that they are not listed; only possible hits reach the exact hash join,
which removes the filter's false positives.  Everything is built-in columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ``2 ** BLOCK_BITS`` blocks of four 64-bit words: 1 MB whatever the list holds,
#: so the filter can always be sent to every task.  A longer list lets more false
#: positives through to the exact join and changes no result.
BLOCK_BITS = 15
WORDS = 4

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with
    A-Z in lower case.  Empty for a null url or one without ``://``."""
    rest = _after_scheme(url)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """Path: what follows the host up to ``?``, ``#`` or the end (else empty)."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def canonical(host: Column, path: Column) -> Column:
    """The spelling under which a URL is listed: without scheme, leading ``www.``,
    query, fragment, ending ``.html`` and closing slashes."""
    return F.concat(
        F.regexp_replace(host, r"^www\.", ""),
        F.regexp_replace(F.regexp_replace(path, r"\.html$", ""), "/+$", ""),
    )


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as ``(rule, verdict)``; null if none does.

    A rule ``(host, path, verdict)`` fits its host and all subdomains of it where
    the path starts with the rule's path.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for on, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == on) | host.endswith(f".{on}")) & path.startswith(start)
        hit = F.struct(F.lit(on + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit).otherwise(out)
    return out


def _cells(key: Column) -> tuple[Column, list[Column]]:
    """Block number and, for each word of the block, the bit this key sets."""
    h = F.xxhash64(key)
    block = F.shiftrightunsigned(h, 64 - BLOCK_BITS).cast("int")
    bits = [F.shiftrightunsigned(h, 6 * w).bitwiseAND(F.lit(63)).cast("int") for w in range(WORDS)]
    return block, [F.call_function("shiftleft", F.lit(1).cast("bigint"), b) for b in bits]


def bloom_filter(listed: DataFrame, key: str = "url_key") -> DataFrame:
    """``(block, w0..w3)``: at most ``2 ** BLOCK_BITS`` rows.

    Bits are joined inside the map tasks first; a key that is listed very often
    costs no more than one row per task.
    """
    block, bits = _cells(F.col(key))
    each = listed.filter(F.col(key).isNotNull()).select(
        block.alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits)]
    )
    return each.groupBy("block").agg(
        *[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]
    )


def possible_hits(rows: DataFrame, bloom: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be listed: all that are, and a few that are not."""
    block, bits = _cells(F.col(key))
    wanted = rows.withColumns(
        {"_block": block, **{f"_m{i}": b for i, b in enumerate(bits)}}
    )
    blocks = bloom.select(
        F.col("block").alias("_block"), *[F.col(f"w{i}").alias(f"_w{i}") for i in range(WORDS)]
    )
    every = F.lit(True)
    for i in range(WORDS):
        every = every & (F.col(f"_w{i}").bitwiseAND(F.col(f"_m{i}")) == F.col(f"_m{i}"))
    found = wanted.join(F.broadcast(blocks), "_block").filter(every)
    return found.drop("_block", *[f"_{x}{i}" for i in range(WORDS) for x in "mw"])


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[Rule],
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """``id, host, path, rule, verdict, listed`` of every row.

    The verdict is the rule's where one fits; otherwise ``block`` for listed URLs
    and ``allow`` for the rest.  ``listed (url_key)`` holds canonical URLs, repeats
    and nulls allowed.  Null URLs and URLs without ``://`` have an empty host and
    path, fit no rule and are allowed unless the empty key is listed.  Repeated rows
    are judged one by one; other columns of ``pages`` are ignored, so their names
    cannot clash.
    """
    url = F.col(url_column)
    rows = pages.select(
        F.col(id_column).alias(id_column), host_of(url).alias("host"), path_of(url).alias("path")
    ).withColumn("_key", canonical(F.col("host"), F.col("path")))
    keys = listed.select(F.col("url_key")).filter(F.col("url_key").isNotNull())
    bloom = bloom_filter(keys)
    hits = (
        possible_hits(rows.select("_key"), bloom, "_key")
        .distinct()
        .join(keys.withColumnRenamed("url_key", "_key"), "_key", "left_semi")
        .withColumn("listed", F.lit(True))
    )
    fits = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.when(F.coalesce("listed", F.lit(False)), "block").otherwise("allow")
    return (
        rows.join(hits, "_key", "left")
        .withColumn("_rule", fits)
        .select(
            id_column,
            "host",
            "path",
            F.col("_rule.rule").alias("rule"),
            F.coalesce("_rule.verdict", verdict).alias("verdict"),
            F.coalesce("listed", F.lit(False)).alias("listed"),
        )
    )
