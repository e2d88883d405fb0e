"""Language-model scoring by online logistic context mixing.

A text is a sequence of bytes with an end mark, a byte a path of eight bits.  The model
counts which bytes followed every context: the last bytes of every order in ``ORDERS``,
and the word so far.  From these counts each context predicts every bit, and logistic mixing with weights chosen by a gate (how many of the contexts
are known, and the bit's place) makes one of them, which an adaptive map by the last
byte refines.

Learning is online: a task predicts each stretch of its texts with what it has seen
before, corrects the weights and the map by the outcome, and counts the stretch after
that.  Counts of all tasks are summed up and weights are averaged, so every training
text contributes.  Scoring changes nothing any more, so a text's score does not depend on
its neighbours.

The counts grow with the input and stay a table: sorted keys of context and byte, dealt by
ranges of the key to buckets whose number grows with the input, where those of all tasks
are summed before they are written.  Contexts of bytes are
kept exactly, the word so far as 53 bits of its hash.  To score, a task asks the buckets
for the contexts of its texts, and the answers are joined to the texts.  Whatever is
written or shuffled travels without loss as differences and single bytes, compressed.

All quantities depend on a byte, the five before it and the word so far, so a stretch is
worked out once per different such place.

Beside the model stands the base: word frequencies of the training texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unbrev.llm.common import (
    SEPARATORS,
    byte_buffer,
    lowered,
    mixed,
    prefix_hash,
    slices,
    span_hash,
    word_spans,
)
from unbrev.session import settle

#: Bytes of context of the predictors, beside that of the word so far.
ORDERS = (1, 2, 3, 5)
#: Number of tables.
TABLES = len(ORDERS) + 1
#: Training text that one bucket of counts stands for; a byte makes at most
#: ``TABLES`` entries.
COUNTED_BYTES = 8 << 20
#: Entries a task counts before it hands them on.
HELD_ENTRIES = 6_000_000
#: Text bytes whose contexts a task asks for together; the same contexts come back for
#: every such stretch.
ASK_BYTES = 32 << 20
#: Text bytes of a row that goes to scoring, and of the rows that are scored together: a
#: place is worked out once for all of them.
TEXT_BYTES, SCORE_BYTES = 512 << 10, 8 << 20
#: Marks the end of a text; no byte of UTF-8 has this value.
END = 0xFF
#: Stretches a task learns from: the first size in bytes, doubled up to the last.
FIRST_STRETCH, LAST_STRETCH = 128 << 10, 4 << 20
#: Different byte strings worked through at once.
STEP = 100_000
#: Places that fit into a processor's cache with all that is worked out for them, and
#: bytes after a context up to which they are gone through one by one.
BLOCK, FEW = 12_500, 8
_PRIOR = 0.4
_CLIP = 11.0
_GATES = TABLES + 1
_INPUTS = TABLES + 1
_MAP = 33
_RATE = 0.5
_CONTEXT_BITS = np.uint64(56)
_WORD_BITS = np.uint64(53)
_LAST = np.uint64(0xFF)
#: By byte and bit whether the bit is 1 or 0; by the difference of two bytes whether they
#: are alike up to the bit.
_BYTES = np.arange(256)[:, None]
_SIGNS = np.float32(2) * (_BYTES >> np.arange(7, -1, -1) & 1).astype(np.float32) - np.float32(1)
_SHARED = (_BYTES >> np.arange(8, 0, -1) == 0).astype(np.float32)
#: Kinds of rows: a task's weights, its counts, and contexts that are asked for.
_WEIGHTS, _COUNTS, _ASKED = 0, 1, 2
_LEARNT = "kind int, flush bigint, bucket int, keys binary, data binary"
_TEXTS = _LEARNT + ", tags binary, nulls binary, offsets binary"


class Places(NamedTuple):
    """Bytes with their contexts: the last bytes, and a hash of the word so far."""

    codes: np.ndarray
    words: np.ndarray

    def take(self, at: np.ndarray | slice) -> Places:
        return Places(self.codes[at], self.words[at])

    def hashes(self) -> np.ndarray:
        return mixed(self.codes + mixed(self.words))

    def different(self) -> tuple[Places, np.ndarray, np.ndarray]:
        """Different places in a fixed random order, how often each comes, and which
        one every place is."""
        own, at = _distinct(self.hashes())
        first = np.empty(len(own), np.int64)
        first[at] = np.arange(len(at))
        return self.take(first), np.bincount(at, minlength=len(own)), at

    def counted(self, times: np.ndarray | None = None) -> tuple[Places, np.ndarray]:
        """Different places in any order, and the sum of each one's ``times`` (1 each)."""
        at, own = pd.factorize(self.hashes())
        first = np.empty(len(own), np.int64)
        first[at] = np.arange(len(at))
        return self.take(first), np.bincount(at, times, len(own)).astype(np.int64)


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and which one every key is: ``np.unique``, with only the
    different ones sorted."""
    at, own = pd.factorize(keys)
    order = np.argsort(own)
    rank = np.empty(len(own), np.int32)
    rank[order] = np.arange(len(own), dtype=np.int32)
    return own[order], rank[at]


def places(data: np.ndarray, offsets: np.ndarray) -> tuple[Places, np.ndarray]:
    """Each byte of the texts with its contexts, and the bounds of the texts.

    An end mark follows every text; before its start are zeros.
    """
    number = len(offsets) - 1
    bounds = offsets + np.arange(number + 1)
    line = np.full(bounds[-1], END, np.uint8)
    owner = np.repeat(np.arange(number), np.diff(offsets))
    line[np.arange(len(data)) + owner] = data
    start = np.repeat(bounds[:-1], np.diff(bounds))
    at = np.arange(len(line))
    codes = line.astype(np.uint64)
    for back in range(1, max(ORDERS) + 1):
        before = np.zeros(len(line), np.uint64)
        before[back:] = line[: len(line) - back]
        before[at - start < back] = 0
        codes |= before << np.uint64(8 * back)
    gap = np.zeros(len(line), np.int64)
    after = np.flatnonzero(np.isin(line[:-1], list(SEPARATORS))) + 1
    gap[after] = after
    word = np.maximum(np.maximum.accumulate(gap), start)
    return Places(codes, span_hash(prefix_hash(line), word, at)), bounds


def _keys(at: Places) -> Iterator[np.ndarray]:
    """Context and byte in 64 bits, table by table: the context's 56 bits first.

    Contexts of bytes, with their order, are mapped one to one.
    """
    before = at.codes >> np.uint64(8)
    contexts = [before & np.uint64((1 << 8 * order) - 1) for order in ORDERS]
    every = np.uint64((1 << int(_CONTEXT_BITS)) - 1)
    for number, context in enumerate((*contexts, at.words >> (np.uint64(64) - _WORD_BITS))):
        x = context | np.uint64(number) << _WORD_BITS
        for factor in (0xC2B2AE3D27D4EB4F, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(29))) * np.uint64(factor) & every
        x ^= x >> np.uint64(29)
        yield x << np.uint64(8) | at.codes & _LAST


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted keys."""
    bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


#: Compresses what travels; level 1 takes a few nanoseconds a byte.
_CODEC = pa.Codec("zstd", compression_level=1)


def _sealed(data: bytes) -> bytes:
    """Bytes compressed, after their number."""
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


def _opened(value: pa.Scalar) -> np.ndarray:
    """The bytes that :func:`_sealed` has compressed."""
    raw = value.as_buffer()
    size = int.from_bytes(raw.slice(0, 8).to_pybytes(), "little")
    return np.frombuffer(_CODEC.decompress(raw.slice(8), size), np.uint8) if size else np.zeros(0, np.uint8)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers from 0 as bytes: the lowest byte of all, then the next one, as far as needed."""
    size = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([size]) + numbers.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _from_planes(raw: np.ndarray) -> np.ndarray:
    planes = raw[1:].reshape(int(raw[0]), -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view(np.uint64).ravel()


def _sealed_steps(ordered: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return _sealed(_planes(np.diff(ordered, prepend=np.uint64(0))))


def _opened_steps(value: pa.Scalar) -> np.ndarray:
    return np.cumsum(_from_planes(_opened(value)), dtype=np.uint64)


class Table(NamedTuple):
    """Sorted different keys, and how often each was seen."""

    keys: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray]]) -> Table:
        """Sum of several lists of keys and times."""
        if not parts:
            return cls(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        keys, times = map(np.concatenate, zip(*parts))
        # Runs that are sorted already are merged by this kind of sort.
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        return cls(keys[starts], np.add.reduceat(times[order], starts) if len(keys) else times)

    def sealed(self) -> tuple[bytes, bytes]:
        """The contexts; and the number of bytes after each, these bytes, and the times."""
        contexts = self.keys >> np.uint64(8)
        starts = _starts(contexts)
        sizes = np.diff(np.append(starts, len(contexts))) - 1
        parts = (sizes.astype(np.uint8).tobytes(), self.keys.astype(np.uint8).tobytes(), _planes(self.times))
        return _sealed_steps(contexts[starts]), _sealed(b"".join(parts))

    @classmethod
    def opened(cls, keys: pa.Scalar, data: pa.Scalar) -> Table:
        contexts, raw = _opened_steps(keys), _opened(data)
        sizes = raw[: len(contexts)].astype(np.int64) + 1
        n = len(contexts) + int(sizes.sum())
        keys = np.repeat(contexts << np.uint64(8), sizes) | raw[len(contexts) : n]
        return cls(keys, _from_planes(raw[n:]).astype(np.int64))

    def stretched(self, keys: np.ndarray) -> np.ndarray:
        """Prediction of each of the eight bits of every key (0: unknown)."""
        low = np.searchsorted(self.keys, keys & ~_LAST)
        high = np.searchsorted(self.keys, keys | _LAST, side="right")
        out = np.zeros((len(keys), 8), np.float32)
        # After most contexts one byte was seen: it speaks up to the bit that parts from it.
        one = np.flatnonzero(high - low == 1)
        seen = (self.keys[low[one]] & _LAST).astype(np.int64)
        sure = np.log((self.times[low[one]] + _PRIOR) / _PRIOR).astype(np.float32)
        parted = seen ^ (keys[one] & _LAST).astype(np.int64)
        out[one] = sure[:, None] * _SIGNS[seen] * _SHARED[parted]
        size = high - low
        for start in range(0, len(few := np.flatnonzero((size > 1) & (size <= FEW))), BLOCK):
            at = few[start : start + BLOCK]
            out[at] = self._few_bits(keys[at], low[at], size[at])
        many = np.flatnonzero(size > FEW)
        out[many] = self._mixed_bits(keys[many], low[many], high[many])
        return out

    def _few_bits(self, keys: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        """:meth:`stretched` for contexts with a few bytes after them, byte by byte."""
        every, ones = np.zeros((2, len(keys), 8))
        for k in range(int(size.max(initial=0))):
            here = np.minimum(low + k, len(self.keys) - 1)
            seen = (self.keys[here] & _LAST).astype(np.int64)
            parted = seen ^ (keys & _LAST).astype(np.int64)
            part = np.where(k < size, self.times[here], 0)[:, None] * _SHARED[parted]
            every += part
            ones += part * (_SIGNS[seen] > 0)
        return np.log((ones + _PRIOR) / (every - ones + _PRIOR))

    def _mixed_bits(self, keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """:meth:`stretched` for contexts with any number of bytes after them."""
        sums = np.concatenate([[0], np.cumsum(self.times)])
        out = np.zeros((len(keys), 8), np.float32)
        for place, _, bit in _bits(keys):
            half = np.uint64(1 << 7 - place)
            middle = np.searchsorted(self.keys, (keys & ~(half * np.uint64(2) - np.uint64(1))) + half)
            zeros, ones = sums[middle] - sums[low], sums[high] - sums[middle]
            out[:, place] = np.log((ones + _PRIOR) / (zeros + _PRIOR))
            low, high = np.where(bit == 1, middle, low), np.where(bit == 1, high, middle)
        return out

    def within(self, contexts: np.ndarray) -> Table:
        """The entries of sorted contexts."""
        low = np.searchsorted(self.keys, contexts << np.uint64(8))
        size = np.searchsorted(self.keys, contexts << np.uint64(8) | _LAST, side="right") - low
        at = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
        return Table(self.keys[at], self.times[at])


class Inputs:
    """What a table predicts at some places; each different key is looked up once."""

    def __init__(self, table: Table, at: Places) -> None:
        self.different = [_distinct(keys) for keys in _keys(at)]
        self.known = [table.stretched(keys) for keys, _ in self.different]

    def part(self, of: slice) -> np.ndarray:
        """The predictions by bit, table and place."""
        rows = [known[own[of]] for known, (_, own) in zip(self.known, self.different)]
        return np.stack([row.T for row in rows], axis=1)

    def counts(self, times: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(keys, np.bincount(own, times).astype(np.int64)) for keys, own in self.different]


def _bits(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    byte = codes & np.uint64(0xFF)
    for place in range(8):
        node = (byte >> np.uint64(8 - place)) | np.uint64(1 << place)
        yield place, node, ((byte >> np.uint64(7 - place)) & np.uint64(1)).astype(np.int64)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -_CLIP, _CLIP)))


class Model(NamedTuple):
    """Rows of sealed counts, one for each of so many buckets, weights by gate and place,
    and the refining map by last byte and step."""

    sealed: DataFrame
    buckets: int
    weights: np.ndarray
    refined: np.ndarray

    @property
    def counts(self) -> DataFrame:
        """``(keys, data)``: the counts as they are, 64 bits each."""

        def open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys, data in zip(batch.column("keys"), batch.column("data")):
                    own = Table.opened(keys, data)
                    yield pa.RecordBatch.from_pydict({"keys": [own.keys.tobytes()], "data": [own.times.tobytes()]})

        return self.sealed.select("keys", "data").mapInArrow(open_rows, "keys binary, data binary")

    def bit_costs(self, at: Places) -> np.ndarray:
        """Log10 probability of each byte after its contexts, for a few places."""
        return Mixer(self.weights, self.refined).bit_costs(self.table(at), at)

    def table(self, at: Places) -> Table:
        """The counts of the contexts of a few places."""
        asked = np.unique(np.concatenate(list(_keys(at))) >> np.uint64(8))
        found = []
        for row in self.counts.select("keys", "data").toLocalIterator():
            own = Table(np.frombuffer(row.keys, np.uint64), np.frombuffer(row.data, np.int64))
            found.append(own.within(asked))
        return Table.of(found)


class Mixer(NamedTuple):
    """What of the model does not grow: the weights and the refining map."""

    weights: np.ndarray
    refined: np.ndarray

    def bit_costs(self, table: Table, at: Places) -> np.ndarray:
        """Log10 probability of each byte, given the counts of its contexts."""
        inputs = Inputs(table, at)
        total = np.zeros(len(at.codes))
        for start in range(0, len(total), BLOCK):
            of = slice(start, start + BLOCK)
            codes, known = at.codes[of], inputs.part(of)
            # Each factor is above 1e-6, so that the product of eight is exact enough.
            product = np.ones(len(codes))
            for place, _, bit in _bits(codes):
                p = self.refine(codes, _mix(known[place], self.weights[:, place]))
                product *= np.where(bit == 1, p, 1.0 - p)
            total[of] = np.log10(product)
        return total

    def refine(self, codes: np.ndarray, mix: np.ndarray) -> np.ndarray:
        """Mean of the mixed prediction and what the map has for it."""
        at, part = _steps(mix)
        last = ((codes >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64)
        flat, at = self.refined.ravel(), last * _MAP + at
        mapped = flat[at] * (1 - part) + flat[at + 1] * part
        return 0.5 * (_squash(mix) + mapped)


def _gate(known: np.ndarray) -> np.ndarray:
    """How many tables know something."""
    return (known != 0).sum(axis=0, dtype=np.uint8)


def _mix(known: np.ndarray, weights: np.ndarray) -> np.ndarray:
    gate = _gate(known)
    mix = weights[:, -1][gate]
    for row, weight in zip(known, weights.T):
        mix += row * weight[gate]
    return np.clip(mix, -_CLIP, _CLIP)


def _steps(mix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scaled = (mix + _CLIP) * ((_MAP - 1) / (2 * _CLIP))
    at = np.minimum(scaled.astype(np.int64), _MAP - 2)
    return at, scaled - at


class Learner:
    """One task's counts, weights and map."""

    def __init__(self) -> None:
        self.table = Table.of([])
        self.weights = np.full((_GATES, 8, _INPUTS), 0.4)
        self.weights[:, :, -1] = 0.0
        self.seen = 0.0
        self.hits = np.zeros((256, _MAP, 2))

    def learn(self, stretch: Places, times: np.ndarray | None = None) -> None:
        """Predict a stretch, correct by the outcome, then count it; ``times``: how often
        each of its places comes."""
        known, times = stretch.counted(times)
        order = np.argsort(known.hashes())
        known, times = known.take(order), times[order]
        inputs = Inputs(self.table, known)
        if len(self.table.keys):
            for start in range(0, len(times), STEP):
                part = slice(start, start + STEP)
                self._correct(known.codes[part], inputs.part(part), times[part])
        self.table = Table.of([tuple(self.table), *inputs.counts(times)])

    def _correct(self, codes: np.ndarray, every: np.ndarray, times: np.ndarray) -> None:
        slope, bend = np.zeros((8, _GATES, _INPUTS)), np.zeros((8, _GATES, _INPUTS, _INPUTS))
        rows = np.zeros((8, _GATES), np.int64)
        for start in range(0, len(codes), BLOCK):
            of = slice(start, start + BLOCK)
            self._look(codes[of], every[:, :, of], times[of].astype(float), slope, bend, rows)
        for place, g in zip(*np.nonzero(rows >= 10 * _INPUTS)):
            b = bend[place, g]
            ridge = np.eye(_INPUTS) * (1.0 + 0.01 * np.trace(b) / _INPUTS)
            step = np.clip(np.linalg.solve(b + ridge, slope[place, g]), -0.5, 0.5)
            self.weights[g, place] = np.clip(self.weights[g, place] + _RATE * step, -2.0, 4.0)
        self.seen += float(times.sum())

    def _look(self, codes, every, times, slope, bend, rows) -> None:
        """Add up a block's hits, and by place and gate what its weights are corrected by."""
        last = ((codes >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64) * (2 * _MAP)
        x = np.ones((_INPUTS, len(codes)))
        for place, _, bit in _bits(codes):
            known, weights = every[place], self.weights[:, place]
            # Places side by side by their gate, each gate with its own weights.
            gate = _gate(known)
            order = np.argsort(gate, kind="stable")
            sizes = np.bincount(gate, minlength=_GATES)
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            x[:-1] = known[:, order]
            own = [(g, slice(cuts[g], cuts[g + 1])) for g in np.flatnonzero(sizes)]
            t, bits = times[order], bit[order]
            mix = np.clip(np.concatenate([weights[g] @ x[:, of] for g, of in own]), -_CLIP, _CLIP)
            low, part = _steps(mix)
            slot, share = last[order] + 2 * low + bits, part * t
            hits = np.bincount(np.concatenate([slot, slot + 2]), np.concatenate([t - share, share]), self.hits.size)
            self.hits += hits.reshape(self.hits.shape)
            p = _squash(mix)
            error, spread = t * (bits - p), t * p * (1 - p)
            rows[place] += sizes
            for g, of in own:
                slope[place, g] += x[:, of] @ error[of]
                bend[place, g] += (x[:, of] * spread[of]) @ x[:, of].T


def _training(docs: DataFrame, buckets: int) -> DataFrame:
    """The tasks' counts by bucket, and their weights and maps in buckets below 0."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, held, size, stretch = Learner(), [], 0, FIRST_STRETCH

        def study() -> None:
            parts, times = zip(*held)
            learner.learn(Places(*map(np.concatenate, zip(*parts))), np.concatenate(times))

        task, texts = TaskContext.get().partitionId() % 64, 0
        for batch in batches:
            for part in slices(batch, "text", FIRST_STRETCH):
                data, offsets = byte_buffer(part.column("text"))
                held.append(places(lowered(data), offsets)[0].counted())
                size += len(data)
                texts += part.num_rows
                if size >= stretch:
                    study()
                    held, size, stretch = [], 0, min(stretch * 2, LAST_STRETCH)
                    if len(learner.table.keys) >= HELD_ENTRIES:
                        yield from _counted(learner.table, buckets)
                        learner.table = Table.of([])
        if held:
            study()
        if not texts:
            return
        yield from _counted(learner.table, buckets)
        rest = np.concatenate(
            [[learner.seen], (learner.weights * learner.seen).ravel(), learner.hits.ravel()]
        )
        yield _rows(_LEARNT, kind=[_WEIGHTS], bucket=[-1 - task], data=[rest.tobytes()])

    return docs.select("text").mapInArrow(learn, _LEARNT)


def _rows(schema: str, **columns: list) -> pa.RecordBatch:
    """Rows of a schema; columns that are not given are null."""
    n = len(next(iter(columns.values())))
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [field.split() for field in schema.split(", ")]
    arrays = [pa.array(columns.get(name, [None] * n), types[kind]) for name, kind in fields]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def _counted(table: Table, buckets: int) -> Iterator[pa.RecordBatch]:
    cuts = _cuts(table.keys, buckets)
    full = np.flatnonzero(np.diff(cuts))
    parts = [Table(table.keys[cuts[b] : cuts[b + 1]], table.times[cuts[b] : cuts[b + 1]]).sealed() for b in full]
    yield _rows(
        _LEARNT,
        kind=[_COUNTS] * len(full),
        bucket=full.tolist(),
        keys=[keys for keys, _ in parts],
        data=[data for _, data in parts],
    )


def _add_up(parts: DataFrame) -> DataFrame:
    """Sum the counts of each bucket, and the weights and maps of groups of tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, total, held, entries = None, None, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if total is not None:
                yield _rows(_LEARNT, kind=[_WEIGHTS], bucket=[bucket], data=[total.tobytes()])
            if held:
                keys, data = Table.of(held).sealed()
                yield _rows(_LEARNT, kind=[_COUNTS], bucket=[bucket], keys=[keys], data=[data])

        for batch in batches:
            for row in zip(*(batch.column(n) for n in ("kind", "bucket", "keys", "data"))):
                if row[1].as_py() != bucket:
                    yield from done()
                    bucket, total, held, entries = row[1].as_py(), None, [], 0
                if row[0].as_py() == _WEIGHTS:
                    rest = _numbers(row[3], np.float64)
                    total = rest if total is None else total + rest
                    continue
                held.append(Table.opened(row[2], row[3]))
                entries += len(held[-1].keys)
                if entries > max(1_000_000, 2 * len(held[0].keys)):
                    held = [Table.of(held)]
                    entries = len(held[0].keys)
        yield from done()

    return parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, _LEARNT)


def fit(docs: DataFrame, n_bytes: int | None = None) -> Model:
    """Learn from all rows of ``(text)``; null texts are empty ones.

    ``n_bytes``, about the size of all texts, saves counting it.  The driver gets sums of
    the weights and maps; the counts stay a table.  Without rows every bit has
    probability one half.
    """
    if n_bytes is None:
        n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-n_bytes // COUNTED_BYTES))
    learnt = settle(_add_up(_training(docs, buckets)))
    weights, refined = Learner().weights, _squash(np.linspace(-_CLIP, _CLIP, _MAP))[None].repeat(256, 0)
    # The driver gets the sums of 64 groups of tasks at most.
    tuned = learnt.filter(F.col("kind") == _WEIGHTS).select("bucket", "data").orderBy("bucket")
    sums = [np.frombuffer(r.data, np.float64) for r in tuned.collect()]
    if sums:
        rest, size = np.sum(sums, axis=0), weights.size
        if rest[0] > 0:
            weights = (rest[1 : 1 + size] / rest[0]).reshape(weights.shape)
        hits = rest[1 + size :].reshape(256, _MAP, 2)
        # The map starts as it is and moves with what is seen.
        refined = (hits[:, :, 1] + 20.0 * refined) / (hits.sum(axis=2) + 20.0)
    return Model(learnt.filter(F.col("kind") == _COUNTS), buckets, weights, refined)


def _questions(docs: DataFrame, buckets: int) -> DataFrame:
    """Stretches of texts, under numbers from ``buckets``, and the contexts they ask for."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, size, texts = TaskContext.get().partitionId(), 0, 0, 0
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            asked = _union(held)
            cuts = _cuts(asked << np.uint64(8), buckets)
            full = np.flatnonzero(np.diff(cuts))
            yield _rows(
                _TEXTS,
                kind=[_ASKED] * len(full),
                flush=[task << 32 | number] * len(full),
                bucket=full.tolist(),
                keys=[_sealed_steps(asked[cuts[b] : cuts[b + 1]]) for b in full],
            )

        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                data, offsets = byte_buffer(part.column("text"))
                data = lowered(data)
                every = places(data, offsets)[0].counted()[0]
                held.append(_union([keys >> np.uint64(8) for keys in _keys(every)]))
                if sum(map(len, held)) > max(4_000_000, 2 * len(held[0])):
                    held = [_union(held)]
                ids = part.column("doc_id")
                yield _rows(
                    _TEXTS,
                    kind=[_ASKED],
                    flush=[task << 32 | number],
                    bucket=[buckets + texts],
                    keys=[ids.fill_null(0).to_numpy().tobytes()],
                    data=[_sealed(data.tobytes())],
                    tags=[part.column("tag").to_numpy().tobytes()],
                    nulls=[ids.is_null().to_numpy(zero_copy_only=False).tobytes()],
                    offsets=[offsets.tobytes()],
                )
                size, texts = size + len(data), texts + 1
                if size >= ASK_BYTES:
                    yield from flush()
                    held, number, size, texts = [], number + 1, 0, 0
        if texts:
            yield from flush()

    return docs.select("doc_id", "tag", "text").mapInArrow(ask, _TEXTS)


def _union(parts: list[np.ndarray]) -> np.ndarray:
    """The different numbers of several lists, in order."""
    ordered = np.sort(np.concatenate(parts))
    return ordered[_starts(ordered)]


def _answers(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """The counts of the contexts that are asked for."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, table = None, Table.of([])
        for batch in batches:
            for row in zip(*(batch.column(n) for n in ("kind", "flush", "bucket", "keys", "data"))):
                if row[2].as_py() != bucket:
                    bucket, table = row[2].as_py(), Table.of([])
                # A bucket's counts come before those who ask for them.
                if row[0].as_py() == _COUNTS:
                    table = Table.opened(row[3], row[4])
                    continue
                keys, data = table.within(_opened_steps(row[3])).sealed()
                yield _rows(
                    _LEARNT, kind=[_COUNTS], flush=[row[1].as_py()], bucket=[bucket], keys=[keys], data=[data]
                )

    rows = counts.unionByName(asked).repartition("bucket").sortWithinPartitions("bucket", "kind")
    return rows.mapInArrow(answer, _LEARNT)


def model_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, tag, n_bytes, score`` of ``(doc_id, tag, text)``: log10 probability of
    each whole text and its end."""
    questions = settle(_questions(docs, model.buckets))
    asked = questions.filter(F.col("bucket") < model.buckets)
    texts = questions.filter(F.col("bucket") >= model.buckets)
    names = [part.split()[0] for part in _LEARNT.split(", ")]
    answers = _answers(model.sealed, asked.select(*names))
    mixer = Mixer(model.weights, model.refined)
    columns = ("flush", "offsets", "keys", "data", "tags", "nulls")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush, table, held, texts, size = None, Table.of([]), [], [], 0

        def scored() -> Iterator[pa.RecordBatch]:
            nonlocal texts, size
            if not texts:
                return
            first = np.cumsum([0, *(len(known.codes) for _, known, _, _ in texts)])
            every = Places(*map(np.concatenate, zip(*(known for _, known, _, _ in texts))))
            known, _, of = every.different()
            costs = mixer.bit_costs(table, known)[of]
            for i, (row, _, at, bounds) in enumerate(texts):
                own = costs[first[i] : first[i + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_numbers(row[2], np.int64), mask=_numbers(row[5], bool)),
                        pa.array(_numbers(row[4], np.int64)),
                        pa.array(np.diff(bounds) - 1, pa.int64()),
                        pa.array(np.add.reduceat(own[at], bounds[:-1])),
                    ],
                    ["doc_id", "tag", "n_bytes", "score"],
                )
            texts, size = [], 0

        for batch in batches:
            for row in zip(*(batch.column(n) for n in columns)):
                if row[0].as_py() != flush:
                    yield from scored()
                    flush, table, held = row[0].as_py(), Table.of([]), []
                # The answers come before the texts.
                if not row[1].is_valid:
                    held.append(tuple(Table.opened(row[2], row[3])))
                    continue
                if held:
                    table, held = Table.of(held), []
                every, bounds = places(_opened(row[3]), _numbers(row[1], np.int64))
                known, _, at = every.different()
                texts.append((row, known, at, bounds))
                size += len(at)
                if size >= SCORE_BYTES:
                    yield from scored()
        yield from scored()

    rows = answers.unionByName(texts, allowMissingColumns=True)
    return rows.repartition("flush").sortWithinPartitions("flush", "bucket").mapInArrow(
        score, "doc_id bigint, tag bigint, n_bytes bigint, score double"
    )


# -- the base: word frequencies ---------------------------------------------------

#: Text bytes whose words a task sends together, and that one bucket stands for.
FLUSH_BYTES = 16 << 20
FLUSH_ROWS = 60_000
BUCKET_BYTES = 32 << 20
_WORDS = (
    "flush string, bucket int, docs binary, tags binary, held binary, tokens binary, "
    "words binary, trained binary, frequency binary, owner binary, times binary"
)
_PARTIAL = "flush string, words bigint, tokens bigint, logs binary, known binary"
_BASE = "doc_id bigint, tag bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double"


def _word_blobs(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed words of stretches of ``(doc_id, tag, held, text)``.

    A row of bucket -1 lists the stretch's rows; one of each other bucket has its
    different words, how often the training rows use them, and for each word the rows
    that use it with their counts.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, rows, number
            if not rows:
                return
            ids, tags, flags, tokens, hashes, owner = map(np.concatenate, zip(*held))
            out = flags % 2 == 1
            name = f"{task}-{number}"
            head = dict.fromkeys(_WORDS_NAMES)
            head |= {"flush": name, "bucket": -1, "docs": ids, "tags": tags}
            head |= {"held": flags.astype(np.uint8), "tokens": tokens}
            made = [head]
            order = np.lexsort((owner, hashes))
            hashes, owner = hashes[order], owner[order]
            fresh = np.ones(len(hashes), bool)
            fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            starts = np.flatnonzero(fresh)
            times = np.diff(np.append(starts, len(hashes)))
            word, owner = hashes[starts], owner[starts]
            # Counts travel as 16 bits; larger ones as several entries.
            copies = -(-times // 0xFFFF)
            nth = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            times = np.minimum(np.repeat(times, copies) - nth * 0xFFFF, 0xFFFF)
            word, owner = np.repeat(word, copies), np.repeat(owner, copies)
            bucket = ((word >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            word, owner, times, bucket = word[by], owner[by], times[by], bucket[by]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            used = times * ~out[owner]
            for b in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[b], cuts[b + 1])
                names, first, frequency = np.unique(word[part], return_index=True, return_counts=True)
                row = dict.fromkeys(_WORDS_NAMES) | {"flush": name, "bucket": int(b), "words": names}
                row |= {"trained": np.add.reduceat(used[part], first), "frequency": frequency.astype(np.uint32)}
                row |= {"owner": owner[part].astype(np.uint16), "times": times[part].astype(np.uint16)}
                made.append(row)
            columns = {n: [r[n] for r in made] for n in _WORDS_NAMES}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns["flush"], pa.string()),
                    pa.array(columns["bucket"], pa.int32()),
                    *(
                        pa.array([None if x is None else _sealed(x.tobytes()) for x in columns[n]], pa.binary())
                        for n in _WORDS_NAMES[2:]
                    ),
                ],
                _WORDS_NAMES,
            )
            held, size, rows, number = [], 0, 0, number + 1

        for batch in batches:
            for part in slices(batch, "text"):
                for at in range(0, part.num_rows, FLUSH_ROWS):
                    own = part.slice(at, FLUSH_ROWS)
                    if rows + own.num_rows > FLUSH_ROWS:
                        yield from flush()
                    data, offsets = byte_buffer(own.column("text"))
                    data = lowered(data)
                    start, stop, text = word_spans(data, offsets)
                    count = np.bincount(text, minlength=own.num_rows) + 1
                    ids = own.column("doc_id").fill_null(0).to_numpy()
                    tags = own.column("tag").to_numpy()
                    out = own.column("held").to_numpy(zero_copy_only=False).astype(bool)
                    # A null id is noted beside the flag of the held-out rows.
                    flags = out + 2 * own.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                    held.append((ids, tags, flags, count, span_hash(prefix_hash(data), start, stop), text + rows))
                    rows += own.num_rows
                    size += len(data)
                    if size >= FLUSH_BYTES:
                        yield from flush()
        yield from flush()

    return docs.select("doc_id", "tag", "held", "text").mapInArrow(pack, _WORDS)


_WORDS_NAMES = [part.split()[0] for part in _WORDS.split(", ")]


def _numbers(value: pa.Scalar, dtype) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype)


def base_scores(docs: DataFrame, n_bytes: int) -> DataFrame:
    """``doc_id, tag, held_out, n_tokens, n_known, train_tokens, base_score`` of every
    row of ``(doc_id, tag, held, text)``."""
    buckets = max(1, -(-n_bytes // BUCKET_BYTES))
    blobs = settle(_word_blobs(docs, buckets))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for part in parts for row in zip(*(part.column(n) for n in ("flush", *_WORDS_NAMES[6:])))]
        words = [_opened(r[1]).view(np.uint64) for r in rows]
        trained = [_opened(r[2]).view(np.int64) for r in rows]
        names, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(at, np.concatenate(trained), len(names))
        logs, some = np.log10(total + 0.5), total > 0
        first = np.cumsum([0, *map(len, words)])
        out = {"flush": [], "words": [], "tokens": [], "logs": [], "known": []}
        for i, row in enumerate(rows):
            own = np.repeat(at[first[i] : first[i + 1]], _opened(row[3]).view(np.uint32))
            owner, times = _opened(row[4]).view(np.uint16), _opened(row[5]).view(np.uint16).astype(np.float64)
            out["flush"].append(row[0].as_py())
            out["words"].append(0)
            out["tokens"].append(0)
            out["logs"].append(_sealed(np.bincount(owner, times * logs[own]).tobytes()))
            out["known"].append(_sealed(np.bincount(owner, times * some[own]).astype(np.int64).tobytes()))
        out["words"][0], out["tokens"][0] = int(some.sum()), int(total.sum())
        yield pa.RecordBatch.from_pydict(out)

    partial = settle(blobs.filter("bucket >= 0").groupBy("bucket").applyInArrow(count, _PARTIAL))
    heads = blobs.filter("bucket = -1").select("flush", "docs", "tags", "held", "tokens")

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = known = head = None
        for part in parts:
            for row in zip(*(part.column(n) for n in ("docs", "tags", "held", "counts", "logs", "known"))):
                if row[0].is_valid:
                    head = [_opened(x).view(t) for x, t in zip(row, (np.int64, np.int64, np.uint8, np.int64))]
                    continue
                a, b = _opened(row[4]).view(np.float64), _opened(row[5]).view(np.int64)
                if logs is None:
                    logs, known = np.zeros(FLUSH_ROWS), np.zeros(FLUSH_ROWS, np.int64)
                logs[: len(a)] += a
                known[: len(b)] += b
        ids, tags, flags, tokens = head
        n = len(ids)
        logs = np.zeros(n) if logs is None else logs[:n]
        known = np.zeros(n, np.int64) if known is None else known[:n]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=flags > 1), pa.array(tags), pa.array(flags % 2 == 1), pa.array(tokens), pa.array(known), pa.array(logs)],
            ["doc_id", "tag", "held_out", "n_tokens", "n_known", "logs"],
        )

    none = F.lit(None).cast("binary")
    lines = heads.select(
        "flush", "docs", "tags", "held", F.col("tokens").alias("counts"), none.alias("logs"), none.alias("known")
    ).unionByName(
        partial.select(
            "flush", *[none.alias(n) for n in ("docs", "tags", "held", "counts")], "logs", "known"
        )
    )
    rows = lines.groupBy("flush").applyInArrow(gather, _BASE)
    sums = partial.agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("v")
    ).first()
    # The end of a text is a token too.
    ends = docs.filter(~F.col("held")).count()
    total, different = sums["n"] + ends, sums["v"] + (ends > 0)
    end_log = float(np.log10(ends + 0.5))
    share = float(np.log10(total + 0.5 * (different + 1)))
    return rows.select(
        "doc_id",
        "tag",
        "held_out",
        "n_tokens",
        (F.col("n_known") + (1 if ends else 0)).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("logs") + end_log - F.col("n_tokens") * share).alias("base_score"),
    )


def score_texts(docs: DataFrame, held_out: Column) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte`` of every row of ``docs``.

    Texts are taken with A-Z in lower case; null ones are empty: one token, the end.
    Rows that ``held_out`` marks (null: not) are not learnt from.  Rows that repeat are
    learnt from and scored each.  A null id comes back as null.  Other columns are
    ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64("doc_id", text).alias("tag"),
        F.coalesce(held_out, F.lit(False)).alias("held"),
        text.alias("text"),
    )
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    model = fit(rows.filter(~F.col("held")), n_bytes)
    scored = model_scores(rows, model).distinct().withColumnRenamed("doc_id", "_id").alias("scored")
    base = base_scores(rows, n_bytes).alias("base")
    same = (F.col("base.tag") == F.col("scored.tag")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    bits = -F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)
    return base.join(scored.hint("merge"), same).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
        bits.alias("bits_per_byte"),
    )
