"""Phrase collocation mining by prefix-free parsing.

Texts are cut into pieces at punctuation, and pieces into overlapping chunks: a chunk
ends with a window of words whose hash triggers, and the next one starts with that same
window.  Where the cuts fall depends on the words around them only, so text that occurs
in many documents gives the same chunks everywhere, and the parse is a dictionary of
distinct chunks with their frequencies.  Phrases are counted inside the dictionary's
chunks, times the frequency; one that lies wholly within an overlap is counted in the
later chunk only, so every occurrence counts once.

Only frequent phrases are wanted, and every part of one is frequent too.  So lengths are
counted one after the other by 64-bit hash, each only where all its parts were frequent
by a Bloom filter of fixed size; what the filters let through too much fails the count.
A phrase's count also has one of its places, the smallest by hash, and the task that
finds that place again names the phrase.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unbrev.llm.common import byte_buffer, lowered, mixed, prefix_hash, slices, span_hash
from unbrev.session import settle

#: Bytes between pieces, and between the words of a piece.
PIECE_GAPS = b".,;:!?\x0a\x0b\x0c\x0d"
WORD_GAPS = b"\x20\x09"

LONGEST = 5
#: Words of a trigger window.  One less than the longest phrase, so that a phrase across
#: a cut lies wholly in one of the two chunks.
OVERLAP = LONGEST - 1
#: One window in so many triggers.
TRIGGER = 16
LEAST_COUNT = 100
TOP = 2000
SLICES = 64
UNKNOWN = "und"

#: Bits of a Bloom filter: 8 MB whatever the corpus; two bits a phrase.
BLOOM_BITS = 26
#: Occurrences that a task sums up before it hands them on, and bytes it reads at once.
HELD = 2_000_000
READ_BYTES = 4 << 20

_IS_PIECE_GAP = np.zeros(256, bool)
_IS_PIECE_GAP[list(PIECE_GAPS)] = True
_IS_WORD = ~_IS_PIECE_GAP
_IS_WORD[list(WORD_GAPS)] = False


class Words:
    """The words of a batch of texts: places, hashes, and what follows on what."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        n = len(data)
        self.data = data
        inside = _IS_WORD[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:] = inside[:-1] & ~cut[1:n]
        after[:-1] = inside[1:] & ~cut[1:n]
        self.start = np.flatnonzero(inside & ~before)
        self.stop = np.flatnonzero(inside & ~after) + 1
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        gaps = np.cumsum(_IS_PIECE_GAP[data], dtype=np.int64)[self.start] if n else self.start
        new = np.ones(len(self.start), bool)
        new[1:] = (gaps[1:] != gaps[:-1]) | (self.text[1:] != self.text[:-1])
        first = np.flatnonzero(new)
        piece = np.cumsum(new) - 1
        ends = np.append(first[1:], len(new))
        #: Number of words from this one to the end of its piece.
        self.left = ends[piece] - np.arange(len(new)) if len(new) else first
        self.ordinal = np.arange(len(new)) - first[piece] if len(new) else first
        self.hash = span_hash(prefix_hash(data), self.start, self.stop)

    def __len__(self) -> int:
        return len(self.start)

    def shifted(self, values: np.ndarray, by: int = 1) -> np.ndarray:
        """The values of the words after; zero past the end."""
        out = np.zeros_like(values)
        out[: len(values) - by] = values[by:]
        return out

    def phrases(self, seed: np.ndarray | np.uint64, longest: int) -> Iterator[np.ndarray]:
        """Hashes of the phrases of 1, 2, ... words that start at each word."""
        rolled = mixed(self.hash + seed)
        yield rolled
        for n in range(1, longest):
            if n >= len(self):
                yield np.zeros_like(rolled)
                continue
            rolled = mixed(rolled * np.uint64(31) + self.shifted(self.hash, n))
            yield rolled


# -- parse ---------------------------------------------------------------------------


def _gathered(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """Byte spans, which may overlap, as strings."""
    size = stop - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(
        len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))
    )


def _parse(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """``lang, text`` to ``lang, chunk, own``: words that the chunk counts phrases from."""
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = byte_buffer(part.column("text"))
            words = Words(lowered(data), offsets)
            if not len(words):
                continue
            *_, window = words.phrases(np.uint64(0), OVERLAP)
            trigger = (words.left >= OVERLAP) & (window % np.uint64(every) == 0)
            first = np.flatnonzero(trigger | (words.ordinal == 0))
            end = first + words.left[first]
            closed = np.zeros(len(first), bool)
            closed[:-1] = first[1:] < end[:-1]
            following = np.append(first[1:], 0)
            own = np.where(closed, following - first, end - first)
            last = np.where(closed, following + OVERLAP, end) - 1
            langs = part.column("lang").take(pa.array(words.text[first]))
            chunks = _gathered(words.data, words.start[first], words.stop[last])
            # Arrow batches of bounded size for the JVM.
            made = pa.table({"lang": langs, "chunk": chunks.cast(pa.string()), "own": own.astype(np.int32)})
            yield from made.to_batches(max_chunksize=50_000)


def parse(texts: DataFrame) -> DataFrame:
    """The dictionary ``(lang, chunk, own, times)`` of ``texts (lang, text)``."""
    named = texts.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    every = TRIGGER
    chunks = named.filter("text is not null").mapInArrow(
        lambda batches: _parse(batches, every), "lang string, chunk string, own int"
    )
    return chunks.groupBy("lang", "chunk", "own").agg(F.count(F.lit(1)).alias("times"))


# -- counting inside the dictionary ---------------------------------------------------


def _read(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[tuple[pa.Table, Words, np.ndarray, np.ndarray]]:
    """Chunks in parts of some MB: rows, words, seed of each word's language, and
    whether phrases that start at the word count here."""

    def prepared(held: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(held)
        data, offsets = byte_buffer(rows.column("chunk"))
        words = Words(data, offsets)
        langs = rows.column("lang").combine_chunks().dictionary_encode()
        seeds = [
            int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")
            for x in langs.dictionary.to_pylist()
        ]
        seed = np.array(seeds, np.uint64)[langs.indices.to_numpy()][words.text]
        return rows, words, seed, words.ordinal < rows.column("own").to_numpy()[words.text]

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > at_once:
            yield prepared(held)
            held, size = [], 0
    if held:
        yield prepared(held)


def _known(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a Bloom filter may hold the hashes."""
    out = np.ones(len(hashes), bool)
    mask = np.uint64(64 * len(bloom) - 1)
    for at in (hashes & mask, (hashes >> np.uint64(32)) & mask):
        out &= (bloom[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def _places(rows: pa.Table, words: Words) -> np.ndarray:
    """A hash of where each word stands: its chunk, whole, and its number in that."""
    data, offsets = byte_buffer(rows.column("chunk"))
    chunk = span_hash(prefix_hash(data), offsets[:-1], offsets[1:])
    first = np.searchsorted(words.text, words.text)
    return mixed(chunk[words.text] * np.uint64(31) + (np.arange(len(words)) - first).astype(np.uint64))


def _selected(words: Words, seed: np.ndarray, lengths: range, bloom: np.ndarray | None):
    """Length, hashes and mask of the phrases of these lengths whose parts, one word
    shorter than the first length, may all be frequent."""
    maybe = None
    for n, hashes in enumerate(words.phrases(seed, lengths.stop - 1), start=1):
        if n == lengths.start - 1:
            maybe = _known(bloom, hashes)
        elif n >= lengths.start:
            if maybe is None:
                maybe = np.ones(len(words), bool)
            else:
                maybe = maybe & words.shifted(maybe)
            maybe = maybe & (words.left >= n)
            yield n, hashes, maybe


def _summed(hashes: list[np.ndarray], times: list[np.ndarray], places: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each hash: occurrences in all, and the smallest place."""
    every, place = np.concatenate(hashes), np.concatenate(places)
    order = np.lexsort((place, every))
    every = every[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else order
    sums = np.add.reduceat(np.concatenate(times)[order], first) if len(every) else order
    return pa.RecordBatch.from_arrays(
        [pa.array(every[first].view(np.int64)), pa.array(sums), pa.array(place[order][first].view(np.int64))],
        ["hash", "times", "place"],
    )


def _count(lengths: range, bloom) -> Callable:
    most, at_once = HELD, READ_BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, times, places, held = [], [], [], 0
        for rows, words, seed, own in _read(batches, at_once):
            weight = rows.column("times").to_numpy()[words.text]
            place = _places(rows, words) ^ seed
            for n, found, maybe in _selected(words, seed, lengths, bloom.value if bloom else None):
                use = maybe & own
                hashes.append(found[use])
                times.append(weight[use])
                places.append(place[use] + np.uint64(n))
                held += len(hashes[-1])
            if held > most:
                yield _summed(hashes, times, places)
                hashes, times, places, held = [], [], [], 0
        if hashes:
            yield _summed(hashes, times, places)

    return count


def frequent_hashes(dictionary: DataFrame, lengths: range, least: int, bloom=None) -> DataFrame:
    """``(hash, f, place)`` of the phrases of these lengths with at least so many
    occurrences."""
    counted = dictionary.mapInArrow(_count(lengths, bloom), "hash bigint, times bigint, place bigint")
    summed = counted.groupBy("hash").agg(F.sum("times").alias("f"), F.min("place").alias("place"))
    return settle(summed.filter(F.col("f") >= least))


def bloom_filter(rows: DataFrame, column: str = "hash"):
    """A broadcast Bloom filter of a column of hashes: ``2 ** BLOOM_BITS`` bits, at
    whatever size.

    Bits are joined in the tasks; the driver sees one number for every 64 of them.
    """
    mask = F.lit((1 << BLOOM_BITS) - 1).cast("bigint")
    places = F.array(F.col(column).bitwiseAND(mask), F.shiftrightunsigned(column, 32).bitwiseAND(mask))
    one = F.lit(1).cast("bigint")
    set_bits = (
        rows.select(F.explode(places).alias("at"))
        .groupBy(F.shiftrightunsigned("at", 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", one, F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
        .toArrow()
    )
    bloom = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
    bloom[set_bits.column("word").to_numpy()] = set_bits.column("bits").to_numpy().view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast(bloom)


def _spelled(words: Words, first: np.ndarray, n: int) -> pa.Array:
    """The phrases of ``n`` words from these words on, joined by single spaces."""
    plain = np.ones(len(first), bool)
    for k in range(n - 1):
        here = first + k
        plain &= (words.start[here + 1] == words.stop[here] + 1) & (words.data[words.stop[here]] == 0x20)
    out = _gathered(words.data, words.start[first], words.stop[first + n - 1])
    if plain.all():
        return out
    texts = out.to_pylist()
    return pa.array([t if p else re.sub("[ \t]+", " ", t) for t, p in zip(texts, plain)], pa.large_string())


def _name(bloom) -> Callable:
    at_once = READ_BYTES

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, seed, own in _read(batches, at_once):
            langs = rows.column("lang").combine_chunks()
            place = _places(rows, words) ^ seed
            for n, hashes in enumerate(words.phrases(seed, LONGEST), start=1):
                at = np.flatnonzero(own & (words.left >= n))
                at = at[_known(bloom.value, place[at] + np.uint64(n))]
                if not len(at):
                    continue
                named = pa.table(
                    {
                        "hash": hashes[at].view(np.int64),
                        "lang": langs.take(pa.array(words.text[at])),
                        "phrase": _spelled(words, at, n).cast(pa.string()),
                        "words": np.full(len(at), n, np.int32),
                    }
                )
                yield from named.to_batches(max_chunksize=50_000)

    return name


def frequent_phrases(dictionary: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """``(lang, phrase, words, f)`` of all phrases of up to ``LONGEST`` words that occur
    at least ``least`` times in their language."""
    ones = frequent_hashes(dictionary, range(1, 2), least)
    twos = frequent_hashes(dictionary, range(2, 3), least, bloom_filter(ones))
    more = frequent_hashes(dictionary, range(3, LONGEST + 1), least, bloom_filter(twos))
    counts = ones.unionAll(twos).unionAll(more)
    named = dictionary.mapInArrow(
        _name(bloom_filter(counts, "place")), "hash bigint, lang string, phrase string, words int"
    )
    # The filter lets through a few more places, some of them of frequent phrases.
    return counts.join(named.dropDuplicates(["hash"]), "hash").select("lang", "phrase", "words", "f")


# -- scores --------------------------------------------------------------------------


def _part(first: Column | int, size: Column) -> Column:
    return F.array_join(F.slice("_w", first, size), " ")


def score_phrases(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """``(lang, phrase, a, l, r, n, score)``: every phrase of two words or more at its
    lowest-scoring cut (ties: the earliest cut).

    ``frequent`` also has all parts of its phrases, ``totals`` the words ``n`` of each
    language.  Products are decimals of 38 digits, the quotient is rounded down.
    """
    longer = frequent.filter("words > 1").withColumn("_w", F.split("phrase", " "))
    cut = longer.select(
        "lang", "phrase", F.col("f").alias("a"), "_w", "words",
        F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"),
    ).select("lang", "phrase", "a", "k", _part(1, F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("words")).alias("right"))
    lefts = frequent.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = frequent.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    wide = "decimal(19,0)"
    scored = (
        cut.join(lefts, ["lang", "left"])
        .join(rights, ["lang", "right"])
        .join(totals, "lang")
        .withColumns(
            {
                "_over": F.col("a").cast(wide) * (F.lit(1000) * F.col("n")).cast(wide),
                "_under": F.col("l").cast(wide) * F.col("r").cast(wide),
            }
        )
        .withColumn("score", F.expr("_over div _under").cast("bigint"))
    )
    return (
        scored.groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("s"))
        .select("lang", "phrase", "s.a", "s.l", "s.r", "s.n", "s.score")
    )


def without_covered(scored: DataFrame, frequent: DataFrame) -> DataFrame:
    """Drop phrases that never occur but inside one and the same longer phrase.

    If a longer phrase occurs as often as one inside it, so does every phrase between
    them; looking at phrases of one word more is enough.
    """
    longer = frequent.filter("words > 2").withColumn("_w", F.split("phrase", " "))
    inner = longer.select(
        "lang",
        F.explode(F.array(_part(1, F.col("words") - 1), _part(2, F.col("words")))).alias("phrase"),
        F.col("f").alias("a"),
    )
    return scored.join(inner.distinct(), ["lang", "phrase", "a"], "left_anti")


def collocations(
    docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each
    language of ``docs (lang, text)``.

    A null language is ``und``, a null text empty; words of texts of a language that is
    not the text's count for the given one.  Repeated rows count each.  Ties in score
    go to the more frequent, then to the smaller phrase by bytes.  Languages without
    frequent phrases are absent.  Other columns are ignored.
    """
    dictionary = settle(parse(docs))
    frequent = settle(frequent_phrases(dictionary, least))
    totals = dictionary.groupBy("lang").agg(F.sum(F.col("own") * F.col("times")).alias("n"))
    kept = without_covered(score_phrases(frequent, totals), frequent)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # First within slices of a language, so that the last step sees few rows of each.
    some = Window.partitionBy("lang", "_slice").orderBy(*order)
    best = Window.partitionBy("lang").orderBy(*order)
    return (
        kept.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
        .withColumn("rank", F.row_number().over(some))
        .filter(F.col("rank") <= top)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
