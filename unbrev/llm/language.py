"""Language identification by unigrams over pieces, marginalised over segmentations.

Each language has a probability for every piece of a fixed public vocabulary.  The
probability of a word is the sum over all ways to cut it into pieces, which a forward
pass over its characters gives, in logarithms where the products could leave the range
of doubles; a text is the product of its words.  The piece
probabilities come from expectation maximisation over the (language, word) counts of
the training rows, whose counting and summing Spark does.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unbrev.llm.common import parts_by_rows
from unbrev.session import settle

#: Runs of letters, which are the words here.
LETTERS = re.compile(r"[^\W\d_]+")
#: Log of the smallest probability that is worked with directly; that of the smallest
#: normal double is -708.
SMALLEST = -690.0
SMOOTHING = 0.05
#: Entries of a counting dictionary before it is handed on.
FLUSH = 300_000
#: Words worked through together, and their characters (one word at least).
WORDS = 10_000
CHARACTERS = 400_000
UNDETERMINED = "und"


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xFF51AFD7ED558CCD)
#: Bits of the table that tells for most strings that they are no piece.
_SIEVE = 21


class Vocabulary(NamedTuple):
    """Pieces by the hash of their characters; ``size - 1`` stands for an unknown
    character."""

    hashes: np.ndarray
    numbers: np.ndarray
    sieve: np.ndarray
    longest: int
    size: int

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids: dict[str, int] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                ids.setdefault(model.id_to_piece(i), len(ids))
        hashes = np.zeros(len(ids), np.uint64)
        for n, piece in enumerate(ids):
            h = np.zeros(1, np.uint64)
            for code in _codes(piece):
                h = h * _FACTOR + code
            hashes[n] = h[0]
        order = np.argsort(hashes)
        sieve = np.zeros(1 << _SIEVE, bool)
        sieve[_place(hashes)] = True
        return cls(hashes[order], order, sieve, max(map(len, ids)), len(ids) + 1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)


def _place(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * _SPREAD) >> np.uint64(64 - _SIEVE)).astype(np.int64)


class Segmentations:
    """All ways to cut strings into pieces, as arcs between character positions.

    String ``i`` owns the nodes from ``base[i]``, one more than it has characters.  A
    character that is no piece itself has an arc of the unknown piece.
    """

    def __init__(self, strings: list[str], vocabulary: Vocabulary) -> None:
        codes = _codes("".join(strings))
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        owner = np.repeat(np.arange(len(strings)), sizes)
        first = np.cumsum(sizes) - sizes
        room = first[owner] + sizes[owner] - np.arange(len(codes))
        at = np.arange(len(codes))
        h = np.zeros(len(codes), np.uint64)
        starts, lengths, pieces = [], [], []
        for length in range(1, vocabulary.longest + 1):
            stays = room[at] >= length
            at, h = at[stays], h[stays]
            if not len(at):
                break
            h = h * _FACTOR + codes[at + length - 1]
            maybe = np.flatnonzero(vocabulary.sieve[_place(h)])
            spot = np.minimum(np.searchsorted(vocabulary.hashes, h[maybe]), vocabulary.size - 2)
            real = vocabulary.hashes[spot] == h[maybe]
            found, piece = at[maybe[real]], vocabulary.numbers[spot[real]]
            if length == 1:
                known = np.zeros(len(codes), bool)
                known[found] = True
                odd = np.flatnonzero(~known)
                found = np.concatenate([found, odd])
                piece = np.concatenate([piece, np.full(len(odd), vocabulary.size - 1)])
            starts.append(found)
            lengths.append(np.full(len(found), length))
            pieces.append(piece)
        start, length, piece = map(np.concatenate, (starts, lengths, pieces))
        self.owner = owner[start]
        self.base = first + np.arange(len(strings))
        self.last = self.base + sizes
        self.nodes = len(codes) + len(strings)
        self.tail = start + self.owner
        self.head = self.tail + length
        self.depth = self.head - self.base[self.owner]
        self.rise = self.tail - self.base[self.owner]
        self.piece = piece

    def _steps(self, level: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arcs level by level, those of a node side by side, with where each begins."""
        order = np.lexsort((node, level))
        cuts = np.flatnonzero(np.diff(level[order])) + 1
        for arcs in np.split(order, cuts):
            change = np.flatnonzero(np.diff(node[arcs])) + 1
            yield arcs, np.concatenate([[0], change])

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Probability of every prefix, given that of each arc (one or more columns)."""
        alpha = np.zeros((self.nodes, *p.shape[1:]))
        alpha[self.base] = 1.0
        for arcs, starts in self._steps(self.depth, self.head):
            alpha[self.head[arcs[starts]]] = np.add.reduceat(alpha[self.tail[arcs]] * p[arcs], starts)
        return alpha

    def backward(self, p: np.ndarray) -> np.ndarray:
        """Probability of every rest."""
        beta = np.zeros((self.nodes, *p.shape[1:]))
        beta[self.last] = 1.0
        for arcs, starts in self._steps(-self.rise, self.tail):
            beta[self.tail[arcs[starts]]] = np.add.reduceat(beta[self.head[arcs]] * p[arcs], starts)
        return beta

    def uses(self, p: np.ndarray) -> np.ndarray:
        """How often each arc is used, over all segmentations by their weight."""
        alpha, beta = self.forward(p), self.backward(p)
        return alpha[self.tail] * p * beta[self.head] / alpha[self.last][self.owner]

    def log_forward(self, logs: np.ndarray) -> np.ndarray:
        """:meth:`forward` in logarithms, which no length of a string underflows."""
        alpha = np.full((self.nodes, *logs.shape[1:]), -np.inf)
        alpha[self.base] = 0.0
        for arcs, starts in self._steps(self.depth, self.head):
            alpha[self.head[arcs[starts]]] = _log_sums(alpha[self.tail[arcs]] + logs[arcs], starts)
        return alpha

    def log_backward(self, logs: np.ndarray) -> np.ndarray:
        """:meth:`backward` in logarithms."""
        beta = np.full((self.nodes, *logs.shape[1:]), -np.inf)
        beta[self.last] = 0.0
        for arcs, starts in self._steps(-self.rise, self.tail):
            beta[self.tail[arcs[starts]]] = _log_sums(beta[self.head[arcs]] + logs[arcs], starts)
        return beta

    def log_uses(self, logs: np.ndarray) -> np.ndarray:
        """:meth:`uses`, given the logarithm of each arc's probability."""
        alpha, beta = self.log_forward(logs), self.log_backward(logs)
        return np.exp(alpha[self.tail] + logs + beta[self.head] - alpha[self.last][self.owner])


def _log_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials of each run of rows; every run has a finite row."""
    most = np.maximum.reduceat(values, starts)
    rows = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(values))))
    return most + np.log(np.add.reduceat(np.exp(values - most[rows]), starts))


class Model(NamedTuple):
    """Languages, log priors, and piece probabilities (language by piece)."""

    languages: list[str]
    prior: np.ndarray
    pieces: np.ndarray
    vocabulary: str


def words_of(text: str) -> Counter:
    """Counts of a text's words in lower case."""
    return Counter(LETTERS.findall(text.lower()))


def _chunks(words: list[str], pieces: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    """Numbers of the words to work through together, and whether in logarithms.

    A word of ``n`` characters has at most ``n`` pieces, so none of its products is below
    the least piece probability to that power.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    long = sizes * -np.log(pieces.min(initial=1.0)) > -SMALLEST
    for logs in (False, True):
        own = np.flatnonzero(long == logs)
        ends = np.cumsum(sizes[own])
        start = 0
        while start < len(own):
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + CHARACTERS, side="right"))
            stop = min(max(stop, start + 1), start + WORDS)
            yield own[start:stop], logs
            start = stop


def word_scores(words: list[str], vocabulary: Vocabulary, pieces: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language: ``(word, language)``."""
    out = np.zeros((len(words), len(pieces)))
    for own, logs in _chunks(words, pieces):
        cut = Segmentations(["▁" + words[i] for i in own], vocabulary)
        p = pieces.T[cut.piece]
        out[own] = cut.log_forward(np.log(p))[cut.last] if logs else np.log(cut.forward(p)[cut.last])
    return out


def piece_uses(
    words: list[str], of: np.ndarray, times: np.ndarray, vocabulary: Vocabulary, pieces: np.ndarray
) -> np.ndarray:
    """Expected uses of each piece ``(language, piece)`` in words of the languages ``of``."""
    uses = np.zeros(pieces.shape)
    for own, logs in _chunks(words, pieces):
        cut = Segmentations(["▁" + words[i] for i in own], vocabulary)
        lang = of[own][cut.owner]
        p = pieces[lang, cut.piece]
        used = cut.log_uses(np.log(p)) if logs else cut.uses(p)
        np.add.at(uses, (lang, cut.piece), used * times[own][cut.owner])
    return uses


# -- learning --------------------------------------------------------------


def word_counts(labelled: DataFrame) -> DataFrame:
    """``(lang, word, n)`` over all rows of ``(lang, text)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([lang] * len(counts), pa.string()),
                        "word": pa.array(list(counts), pa.string()),
                        "n": pa.array(list(counts.values()), pa.int64()),
                    }
                )
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                own = held.setdefault(lang.as_py(), Counter())
                own.update(LETTERS.findall((text.as_py() or "").lower()))
                if sum(map(len, held.values())) > FLUSH:
                    yield from rows()
        yield from rows()

    each = labelled.select("lang", "text").mapInArrow(count, "lang string, word string, n bigint")
    return each.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, vocabulary: str, rounds: int = 2) -> Model:
    """Learn from rows with a language and a text.

    All rows count.  What comes to the driver is one number per language and piece,
    bounded by the vocabulary times the languages; without rows the model knows no
    language.
    """
    labelled = labelled.select("lang", "text").filter(F.col("lang").isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    total = sum(sizes.values())
    prior = np.log([sizes[x] / total for x in languages]) if languages else np.zeros(0)
    size = Vocabulary.load(vocabulary).size
    pieces = np.full((len(languages), size), 1.0 / size)
    if not languages:
        return Model([], prior, pieces, vocabulary)
    counts = settle(word_counts(labelled))
    for _ in range(rounds):
        model = Model(languages, prior, pieces, vocabulary)
        summed = _expectation(counts, model).groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))
        uses = np.full(pieces.shape, SMOOTHING)
        for row in summed.toPandas().itertuples():
            uses[row.lang, row.piece] += row.uses
        pieces = uses / uses.sum(axis=1, keepdims=True)
    return Model(languages, prior, pieces, vocabulary)


def _expectation(counts: DataFrame, model: Model) -> DataFrame:
    """``(lang, piece, uses)`` of each task's words under the model."""
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        vocabulary = Vocabulary.load(known.vocabulary)
        number = {x: i for i, x in enumerate(known.languages)}
        uses = np.zeros(known.pieces.shape)
        for whole in batches:
            for at in range(0, whole.num_rows, WORDS):
                langs, words, n = (c.to_pylist() for c in whole.slice(at, WORDS).columns)
                of = np.array([number[lang] for lang in langs], np.int64)
                uses += piece_uses(words, of, np.array(n, float), vocabulary, known.pieces)
        lang, piece = np.nonzero(uses)
        yield pa.RecordBatch.from_pydict(
            {"lang": lang.astype(np.int32), "piece": piece.astype(np.int32), "uses": uses[lang, piece]}
        )

    return counts.select("lang", "word", "n").mapInArrow(expect, "lang int, piece int, uses double")


# -- predicting ------------------------------------------------------------


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (0 to 1) added.

    Columns of those names in ``docs`` are replaced; every other column is handed
    through.  Only the text is looked at.  A null text, one without letters, or a
    model without languages gives ``und`` and 0; a tie goes to the first language by
    name.  Each row is judged for itself, repeated or not, over its whole text.
    """
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        vocabulary = Vocabulary.load(known.vocabulary)
        rows: dict[str, int] = {}
        table = np.zeros((0, len(known.languages)))

        def learn(words: list[str]) -> None:
            nonlocal table
            rows.update(zip(words, range(len(table), len(table) + len(words))))
            table = np.concatenate([table, word_scores(words, vocabulary, known.pieces)])

        for batch in parts_by_rows(batches, 1000):
            counted = [words_of(value.as_py() or "") for value in batch.column(text)]
            if len(rows) > FLUSH:
                rows, table = {}, table[:0]
            if known.languages:
                learn(list({w: None for counts in counted for w in counts if w not in rows}))
            labels, scores = [], []
            for counts in counted:
                if not known.languages or not any(c.isalpha() for w in counts for c in w):
                    labels.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                own = table[[rows[w] for w in counts]]
                sums = known.prior + np.fromiter(counts.values(), float, len(counts)) @ own
                best = int(sums.argmax())
                labels.append(known.languages[best])
                scores.append(float(1.0 / np.exp(sums - sums[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names, "lang_pred", "lang_score"],
            )

    return docs.mapInArrow(judge, schema)


def training_rows(docs: DataFrame, held_out: Column) -> DataFrame:
    """``(lang, text)`` of the rows to learn from."""
    return docs.filter(~F.coalesce(held_out, F.lit(False))).select("lang", "text")
