"""Helpers that several of the operators share: words, batches, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unbrev.session import settle

#: Bytes that separate words; every other byte belongs to a word.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same as a regular expression class, for Spark and for DuckDB.
SEPARATOR_CLASS = r"[\x20\x09-\x0D]"

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True


#: Rows of whole texts that go to a Python worker at once.
ARROW_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Have texts sent to Python workers in small batches, which bounds their memory.

    A session-level SQL option; results do not depend on it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table."""
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc_remainder(key: Column, modulus: int) -> Column:
    """``crc32`` of the key's decimal text, modulo a number (null key: null)."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def packed(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and one struct ``row`` of all other columns of ``docs``, so that none of
    these clashes with a name that an operator adds."""
    others = [F.col(_quoted(c)) for c in docs.columns if c not in keys]
    return docs.select(*map(_quoted, keys), F.struct(*others or [F.lit(0).alias("none")]).alias("row"))


def unpacked(rows: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """The columns ``names`` that :func:`packed` has put away, in this order."""
    return rows.select(
        *[F.col(_quoted(c)) if c in keys else F.col(f"row.{_quoted(c)}").alias(c) for c in names]
    )


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# -- texts as byte buffers -------------------------------------------------


def byte_buffer(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and ``n + 1`` offsets into it.

    Null texts are empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    flat = texts.cast(pa.large_binary()).fill_null(b"")
    buffers = flat.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    if buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(flat) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``size`` text bytes each, one row at least.

    Working arrays are many times as large as the text; this bounds them by the
    longest single text rather than by the batch.
    """
    _, offsets = byte_buffer(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def parts_by_rows(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches cut to a number of rows that a task can hold in several forms."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all their bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Powers:
    """Powers of the rolling hash's base, kept up to the longest text so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 20)
            up = np.full(size, _MULTIPLIER, np.uint64)
            down = np.full(size, _INVERSE, np.uint64)
            up[0] = down[0] = 1
            up, down = np.cumprod(up), np.cumprod(down)
            if size > 1 << 23:
                return up, down
            cls.up, cls.down = up, down
        return cls.up, cls.down


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`span_hash` gets the hash of any span."""
    up, _ = _Powers.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans have equal hashes anywhere."""
    _, down = _Powers.get(len(prefix))
    length = (stop - start).astype(np.uint64)
    return mixed((prefix[stop] - prefix[start]) * down[start] + length)


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


def word_spans(
    data: np.ndarray, offsets: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all words, in order."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~_IS_SEPARATOR[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1] & ~cut[1:n]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:] & ~cut[1:n]
    start = np.flatnonzero(inside & ~before)
    stop = np.flatnonzero(inside & ~after) + 1
    return start, stop, np.searchsorted(offsets, start, side="right") - 1


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, words: int
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted: values and offsets.

    A text of fewer words than a shingle has its whole sequence as its only
    shingle; a text without words has none.
    """
    data = lowered(data)
    start, stop, text = word_spans(data, offsets)
    hashes = span_hash(prefix_hash(data), start, stop)
    count = np.bincount(text, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(count)])
    rolled = np.zeros(len(hashes), np.uint64)
    ordinal = np.arange(len(hashes)) - first[text]
    have = np.minimum(count[text], words) if len(text) else ordinal
    for k in range(words):
        take = np.minimum(np.arange(len(hashes)) + k, len(hashes) - 1)
        use = ordinal + k < count[text] if len(text) else np.zeros(0, bool)
        use &= k < have
        rolled = np.where(use, mixed(rolled * np.uint64(31) + hashes[take]), rolled)
    whole = ordinal + have <= count[text] if len(text) else np.zeros(0, bool)
    text, rolled = text[whole], rolled[whole]
    order = np.lexsort((rolled, text))
    text, rolled = text[order], rolled[order]
    fresh = np.ones(len(rolled), bool)
    fresh[1:] = (rolled[1:] != rolled[:-1]) | (text[1:] != text[:-1])
    text, rolled = text[fresh], rolled[fresh]
    sizes = np.bincount(text, minlength=len(offsets) - 1)
    return rolled, np.concatenate([[0], np.cumsum(sizes)])


# -- components ------------------------------------------------------------


def _is_settled(links: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none: one row of counts."""
    roots, others = links.select("b").distinct(), links.select(F.col("a").alias("b")).distinct()
    ends = roots.join(others, "b", "left_semi")
    rows = links.agg(F.count("*").alias("n"), F.count_distinct("a").alias("m")).first()
    return rows["n"] == rows["m"] and ends.isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node of ``edges (a, b)``: its smallest node.

    Alternates the large-star and small-star steps of connected components by
    contraction.  Each step needs the smallest neighbour of a node only, so a
    node with very many neighbours is summed up before the shuffle; nothing is
    collected.  Every round is written to the shared folder, which also cuts
    the lineage; it ends when all nodes are linked to the smallest of their component.
    """
    links = settle(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a != b")
        .distinct()
    )
    for _ in range(rounds):
        if _is_settled(links):
            break
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(low, "a")
            .filter("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        after = settle(
            large.join(down, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .filter("a != b")
            .distinct()
        )
        links = after
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component"))
    )


# -- pairs within groups, in blocks -----------------------------------------


def in_blocks(
    rows: DataFrame,
    key: str,
    spread: str,
    block_rows: int,
    weight: str | None = None,
    block_weight: int = 1,
) -> DataFrame:
    """Deal the rows of every key out to pairs of blocks.

    A key with more than ``block_rows`` rows is cut into blocks by the hash of
    ``spread``; each row goes to every pair ``(_lo, _hi)`` of blocks that has its own
    block ``_own`` in it.  Any two rows of a key meet in some group ``(key, _lo,
    _hi)``, and no group has many more than two blocks of rows, however hot the key.
    With ``weight``, a number column, blocks are also held to about ``block_weight`` of it
    in sum.  Rows come sorted, groups whole within a partition.
    """
    heavy = F.sum(weight) / block_weight if weight else F.lit(0.0)
    sizes = (
        rows.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"), heavy.alias("_heavy"))
        .filter("_n > 1")
    )
    blocks = F.least(F.ceil(F.greatest(F.col("_n") / block_rows, "_heavy")), F.col("_n")).cast("int")
    own = F.pmod(F.xxhash64(spread), F.col("_blocks")).cast("int")
    return (
        rows.join(sizes, key)
        .withColumn("_blocks", blocks)
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumns({"_lo": F.least("_own", "_other"), "_hi": F.greatest("_own", "_other")})
        .drop("_n", "_heavy", "_blocks", "_other")
        .repartition(key, "_lo", "_hi")
        .sortWithinPartitions(key, "_lo", "_hi")
    )


def group_runs(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted batches, with the bounds of the groups."""
    held: list[pa.RecordBatch] = []

    def bounds(rows: pa.Table) -> np.ndarray:
        change = np.zeros(rows.num_rows, bool)
        for key in keys:
            values = rows.column(key).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        return np.concatenate([[0], np.flatnonzero(change), [rows.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch])
        cuts = bounds(rows)
        last = int(cuts[-2])
        if last:
            yield rows.slice(0, last), cuts[:-1]
        held = rows.slice(last).to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, bounds(rows)


def fixed_binary(column: pa.ChunkedArray, dtype: np.dtype, width: int) -> np.ndarray:
    """A column of equally long binaries as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data, _ = byte_buffer(flat)
    return data.view(dtype).reshape(len(flat), width) if len(flat) else np.zeros((0, width), dtype)


def binaries(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binaries."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(
        pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix)]
    )
