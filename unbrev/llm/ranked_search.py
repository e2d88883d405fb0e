"""Ranked lexical search over posting lists that are blocked by document similarity.

Documents are put in the order of a sign-projection code of their term weights, which
brings similar ones together, and dealt in that order to shards.  In a shard every
term's posting list is cut into blocks of documents that are neighbours in that order.
A block's summary holds the largest impact of its documents for each coordinate.  A query
goes through its terms' lists, rarest term first; a list answers for the documents that
have none of the terms before, so the summary's products with the remaining terms bound
every score that a block can add.  Only blocks whose bound is below the worst score of a
full result are passed over, so nothing is lost, ties included; the documents of other
blocks are scored exactly.

The index belongs to a set of queries: it has the posting lists of the terms they ask,
and summaries in the coordinates that are asked together with a list's term.  Sets with
many terms are worked in blocks of bounded size.  Terms are told apart by 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unbrev.llm.common import byte_buffer, lowered, mixed, prefix_hash, slices, span_hash
from unbrev.session import settle

#: What is no term character; the parts of the scoring formula.
NO_TERM = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
SHARE = 75
UNIT = 1_000_000_000

TOP = 10
#: Pairs of query and term worked at once; what tasks and the driver hold of the queries
#: is bounded by this, or by a single query that has more terms.
PAIRS = 1 << 16
#: Documents of a block, and the most coordinates of a summary: those asked together with
#: the term and at most as rare, rarest first.  A shard's own maximum bounds the others.
BLOCK = 64
COORDINATES = 256
#: Documents of a shard, and the most cells of its dense table.
SHARD_DOCS = 4096
SHARD_CELLS = 1 << 24
CODE_BITS = 32
#: Summaries are rounded up to multiples of this, which makes them 16 bits wide.
GRAIN = 16

_IS_TERM = np.zeros(256, bool)
_IS_TERM[128:] = _IS_TERM[48:58] = _IS_TERM[65:91] = _IS_TERM[97:123] = True


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all terms, in order."""
    n = len(data)
    inside = _IS_TERM[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = inside[:-1] & ~cut[1:n]
    after[:-1] = inside[1:] & ~cut[1:n]
    start = np.flatnonzero(inside & ~before)
    stop = np.flatnonzero(inside & ~after) + 1
    return start, stop, np.searchsorted(offsets, start, side="right") - 1


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of all terms of all texts, A-Z in lower case."""
    data, offsets = byte_buffer(texts)
    data = lowered(data)
    start, stop, text = term_spans(data, offsets)
    return span_hash(prefix_hash(data), start, stop), text


def _counted(key: np.ndarray, within: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Distinct ``(within, key)`` in order, with their numbers; keys are below ``size``."""
    both, times = np.unique(within * size + key, return_counts=True)
    return both // size, both % size, times


# -- queries -------------------------------------------------------------------------


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, text = term_hashes(part.column("text"))
            names, key = np.unique(hashes, return_inverse=True)
            within, key, times = _counted(key, text, max(len(names), 1))
            yield pa.RecordBatch.from_arrays(
                [part.column("q").take(pa.array(within)), pa.array(names[key].view(np.int64)), pa.array(times)],
                ["q", "term", "times"],
            )


@dataclass(frozen=True)
class Queries:
    """A block of queries as arrays; a query's terms come rarest first."""

    names: np.ndarray  # hashes of the vocabulary, sorted
    number: np.ndarray
    first: np.ndarray
    terms: np.ndarray
    weights: np.ndarray  # of the term times its repeats
    coordinate_first: np.ndarray
    coordinates: np.ndarray  # of each term's summaries, sorted

    def terms_of(self, i: int) -> slice:
        return slice(self.first[i], self.first[i + 1])

    def coordinates_of(self, term: int) -> np.ndarray:
        return self.coordinates[self.coordinate_first[term] : self.coordinate_first[term + 1]]


def _queries(pairs: pa.Table, names: np.ndarray, weight: np.ndarray) -> Queries:
    place = np.empty(len(names), np.int64)
    place[np.lexsort((np.arange(len(names)), -weight))] = np.arange(len(names))
    q = pairs.column("q").to_numpy()
    term = np.searchsorted(names, pairs.column("term").to_numpy().view(np.uint64))
    order = np.lexsort((place[term], q))
    q, term, times = q[order], term[order], pairs.column("times").to_numpy()[order]
    number, first = np.unique(q, return_index=True)
    # Each term's later terms within a query, by distance.
    found = []
    for step in range(min(COORDINATES, len(q))):
        same = q[step:] == q[: len(q) - step]
        if not same.any():
            break
        found.append(np.unique(term[: len(q) - step][same] * len(names) + term[step:][same]))
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    own, other = keys // max(len(names), 1), keys % max(len(names), 1)
    by_place = np.lexsort((place[other], own))
    own, other = own[by_place], other[by_place]
    nth = np.arange(len(own)) - np.searchsorted(own, own)
    own, other = own[nth < COORDINATES], other[nth < COORDINATES]
    by_number = np.lexsort((other, own))
    own, other = own[by_number], other[by_number]
    return Queries(
        names, number, np.append(first, len(q)), term, weight[term] * times,
        np.searchsorted(own, np.arange(len(names) + 1)), other,
    )


# -- bags of the asked terms ----------------------------------------------------------


def _bags(names) -> Callable:
    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = names.value
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, text = term_hashes(part.column("text"))
                n = np.bincount(text, minlength=part.num_rows)
                at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                row, term, times = _counted(at[hit], text[hit], max(len(known), 1))
                offsets = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
                made = pa.table(
                    {
                        "doc_id": part.column("doc_id"),
                        "n": n,
                        "terms": pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))),
                        "times": pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
                    }
                )
                yield from made.filter(pa.array(n > 0)).to_batches()

    return bags


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten().to_numpy()


def _coded(names, weight: np.ndarray, docs: int, total: int) -> Callable:
    """Impacts without the term's weight, and the place in the order by similarity."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = mixed(names.value)[:, None] >> np.arange(CODE_BITS, dtype=np.uint64)[None, :]
        signs = (bits & np.uint64(1)).astype(np.float32) * 2 - 1
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                first, terms = _flat(batch.column("terms"))
                _, times = _flat(batch.column("times"))
                times, n = times.astype(np.int64), batch.column("n").to_numpy()
                m = 100 - SHARE + (SHARE * n * docs) // total
                row = np.repeat(np.arange(batch.num_rows), np.diff(first))
                impact = (UNIT * times) // (1000 * times + 8 * m[row])
                sums = np.zeros((batch.num_rows, CODE_BITS), np.float32)
                filled = np.flatnonzero(np.diff(first))
                if len(filled):
                    each = signs[terms] * (impact * weight[terms]).astype(np.float32)[:, None]
                    sums[filled] = np.add.reduceat(each, first[filled], axis=0)
                code = ((sums > 0).astype(np.int64) << np.arange(CODE_BITS - 1, -1, -1)).sum(axis=1)
                offsets = pa.array(first.astype(np.int32))
                made = pa.table(
                    {
                        "doc_id": batch.column("doc_id"),
                        "code": code,
                        "terms": pa.ListArray.from_arrays(offsets, pa.array(terms)),
                        "impacts": pa.ListArray.from_arrays(offsets, pa.array(impact.astype(np.int32))),
                    }
                )
                yield from made.filter(pa.array(np.diff(first) > 0)).to_batches()

    return coded


# -- index ---------------------------------------------------------------------------

_INDEX = (
    "docs array<bigint>, first array<int>, terms array<int>, impacts array<int>, "
    "block_terms array<int>, block_first array<int>, members array<int>, summaries binary"
)


def _shards(queries) -> Callable:
    """Documents in order of similarity to one row a shard."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        docs, seen = 0, np.zeros(0, np.int32)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                if not batch.num_rows:
                    continue
                more = np.union1d(seen, batch.column("terms").flatten().to_numpy())
                size = docs + batch.num_rows
                if held and (size > SHARD_DOCS or size * len(more) > SHARD_CELLS):
                    yield _shard(pa.Table.from_batches(held), queries.value)
                    held, size, more = [], batch.num_rows, np.unique(batch.column("terms").flatten().to_numpy())
                held.append(batch)
                docs, seen = size, more
        if held:
            yield _shard(pa.Table.from_batches(held), queries.value)

    return shards


def _shard(rows: pa.Table, queries: Queries) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    first, terms = _flat(rows.column("terms").chunk(0))
    _, impacts = _flat(rows.column("impacts").chunk(0))
    active, column = np.unique(terms, return_inverse=True)
    row = np.repeat(np.arange(rows.num_rows), np.diff(first))
    table = np.zeros((rows.num_rows, len(active)), np.uint16)
    table[row, column] = -(-impacts // GRAIN)
    listed = row[np.argsort(column, kind="stable")]
    ends = np.cumsum(np.bincount(column, minlength=len(active)))
    block_terms, block_first, summaries, start = [], [], [], 0
    for a, end in enumerate(ends):
        members = listed[start:end]
        wanted = queries.coordinates_of(active[a])
        at = np.minimum(np.searchsorted(active, wanted), len(active) - 1)
        cuts = np.arange(0, len(members), BLOCK)
        tops = np.maximum.reduceat(table[members[:, None], at[None, :]], cuts, axis=0)
        tops[:, active[at] != wanted] = 0
        summaries.append(tops.tobytes())
        block_terms += [active[a]] * len(cuts)
        block_first += (start + cuts).tolist()
        start = end
    block_first.append(len(listed))
    lists = [first, terms, impacts, np.array(block_terms), np.array(block_first), listed]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())),
            *[_one_list(values) for values in lists],
            pa.array([b"".join(summaries)], pa.binary()),
        ],
        ["docs", "first", "terms", "impacts", "block_terms", "block_first", "members", "summaries"],
    )


def _one_list(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values.astype(np.int32)))


# -- search --------------------------------------------------------------------------


class _Best:
    """The best documents so far: highest score, then smallest id, null ids last."""

    def __init__(self, ids: np.ndarray, unnamed: np.ndarray, top: int) -> None:
        self.ids, self.unnamed, self.top = ids, unnamed, top
        self.docs, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def floor(self) -> int:
        """Least bound that can still matter."""
        return max(int(self.scores[-1]), 1) if len(self.scores) == self.top else 1

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        use = scores >= self.floor
        docs, scores = np.append(self.docs, docs[use]), np.append(self.scores, scores[use])
        order = np.lexsort((self.ids[docs], self.unnamed[docs], -scores))[: self.top]
        self.docs, self.scores = docs[order], scores[order]


class _Shard:
    """A stored shard, ready to be searched."""

    def __init__(self, row: pa.RecordBatch, i: int, queries: Queries) -> None:
        def of(name: str) -> np.ndarray:
            return row.column(name).slice(i, 1).flatten().to_numpy()

        ids = row.column("docs").slice(i, 1).flatten()
        self.unnamed = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.queries = queries
        self.active, column = np.unique(of("terms"), return_inverse=True)
        self.table = np.zeros((len(self.ids), len(self.active)), np.int32)
        self.table[np.repeat(np.arange(len(self.ids)), np.diff(of("first"))), column] = of("impacts")
        self.most = self.table.max(axis=0).astype(np.int64)
        self.members, self.block_first = of("members"), of("block_first")
        blocks = np.bincount(np.searchsorted(self.active, of("block_terms")), minlength=len(self.active))
        self.block_of = np.concatenate([[0], np.cumsum(blocks)])
        widths = np.diff(queries.coordinate_first)[self.active]
        self.summary_of = np.concatenate([[0], np.cumsum(blocks * widths)])
        self.summaries = np.frombuffer(row.column("summaries")[i].as_buffer(), np.uint16)

    def bounds(self, column: int, terms: np.ndarray, weights: np.ndarray, ceilings: np.ndarray) -> np.ndarray:
        """Bound of each block of a list on what these terms add."""
        wanted = self.queries.coordinates_of(self.active[column])
        part = self.summaries[self.summary_of[column] : self.summary_of[column + 1]].reshape(-1, len(wanted))
        at = np.minimum(np.searchsorted(wanted, terms), len(wanted) - 1)
        has = wanted[at] == terms
        known = part[:, at[has]].astype(np.int64) @ (weights[has] * GRAIN)
        return known + ceilings[~has].sum()

    def search(self, i: int, top: int) -> _Best:
        """The best documents of a query."""
        best = _Best(self.ids, self.unnamed, top)
        own = self.queries.terms_of(i)
        terms, weights = self.queries.terms[own], self.queries.weights[own]
        column = np.minimum(np.searchsorted(self.active, terms), len(self.active) - 1)
        here = (self.active[column] == terms) & (weights > 0)
        terms, weights, column = terms[here], weights[here], column[here]
        ceilings = weights * self.most[column]
        rest = np.cumsum(ceilings[::-1])[::-1]
        scored = np.zeros(len(self.ids), bool)
        for k in range(len(terms)):
            if rest[k] < best.floor:
                break
            bounds = self.bounds(column[k], terms[k:], weights[k:], ceilings[k:])
            order = np.argsort(-bounds, kind="stable")
            step, at = 4, 0
            while at < len(order) and bounds[order[at]] >= best.floor:
                taken = order[at : at + step]
                taken = self.block_of[column[k]] + taken[bounds[taken] >= best.floor]
                docs = np.concatenate([self.members[self.block_first[b] : self.block_first[b + 1]] for b in taken])
                docs = docs[~scored[docs]]
                scored[docs] = True
                best.add(docs, self.table[docs[:, None], column[None, :]].astype(np.int64) @ weights)
                at, step = at + step, step * 2
        return best


def _search(queries, top: int) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        for batch in batches:
            for r in range(batch.num_rows):
                shard = _Shard(batch, r, asked)
                q, docs, unnamed, scores = [], [], [], []
                for i, number in enumerate(asked.number):
                    best = shard.search(i, top)
                    q.append(np.full(len(best.docs), number))
                    docs.append(shard.ids[best.docs])
                    unnamed.append(shard.unnamed[best.docs])
                    scores.append(best.scores)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(q)),
                        pa.array(np.concatenate(docs), mask=np.concatenate(unnamed)),
                        pa.array(np.concatenate(scores)),
                    ],
                    ["q", "doc_id", "score"],
                )

    return search


def build_index(docs: DataFrame, pairs: pa.Table) -> tuple[DataFrame, Queries]:
    """The stored index of ``docs (doc_id, text)`` for a block of queries, and the block.

    Two numbers and one count per asked term reach the driver.
    """
    context = docs.sparkSession.sparkContext
    names = np.unique(pairs.column("term").to_numpy().view(np.uint64))
    sent = context.broadcast(names)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("text is not null")
    bags = settle(
        rows.mapInArrow(_bags(sent), "doc_id bigint, n bigint, terms array<int>, times array<int>")
    )
    size = bags.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    having = bags.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    frequency = np.zeros(len(names), np.int64)
    frequency[having.column("term").to_numpy()] = having.column("count").to_numpy()
    weight = np.array(
        [math.floor(1000 * math.log((2 * size["docs"] + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64
    )
    queries = _queries(pairs, names, weight)
    # Neighbours stay neighbours over the partitions; a hash parts documents of one code.
    coded = bags.mapInArrow(
        _coded(sent, weight, size["docs"], size["total"]),
        "doc_id bigint, code bigint, terms array<int>, impacts array<int>",
    ).withColumn("_spread", F.xxhash64("doc_id"))
    ordered = coded.repartitionByRange("code", "_spread").sortWithinPartitions("code", "_spread")
    shards = ordered.drop("code", "_spread").mapInArrow(_shards(context.broadcast(queries)), _INDEX)
    return settle(shards), queries


def search_index(index: DataFrame, queries: Queries, top: int = TOP) -> DataFrame:
    """``(q, doc_id, score)``: the best documents of each shard for each query."""
    sent = index.sparkSession.sparkContext.broadcast(queries)
    return index.mapInArrow(_search(sent, top), "q bigint, doc_id bigint, score bigint")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of ``docs (doc_id, text)``
    for each row of ``items (item_id, text)``.

    Scores above 0 only; equal scores by ascending id, null ids last.  A null or empty
    text has no terms: such an item finds nothing, and such a document is not counted.
    Repeated documents are ranked one by one.  Equal items are one; items that share an
    id but not the text are ranked apart.  Other columns are ignored.
    """
    spark = docs.sparkSession
    asked = (
        items.select("item_id", "text").filter("text is not null").distinct()
        .withColumn("q", F.xxhash64("item_id", "text"))
    )
    pairs = settle(asked.select("q", "text").mapInArrow(_item_terms, "q bigint, term bigint, times bigint"))
    blocks = math.ceil(pairs.count() / PAIRS)
    found = None
    for block in range(blocks):
        some = pairs.filter(F.pmod("q", F.lit(blocks)) == block).toArrow()
        if not some.num_rows:
            continue
        part = search_index(*build_index(docs, some), top)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], "q bigint, doc_id bigint, score bigint")
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= top)
        .join(asked.select("q", "item_id"), "q")
        .select("item_id", "rank", "doc_id", "score")
    )
