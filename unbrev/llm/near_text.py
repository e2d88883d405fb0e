"""Near-duplicate texts by an inverted join over signature coordinates.

Every document is posted under each of its (coordinate, value) pairs.  Two documents
whose signatures agree on ``matches`` of ``coordinates`` values share one of the
``coordinates - matches + 1`` rarest pairs of either, so only those prefixes are
joined and the long posting lists are skipped.  Collisions of the pairs that meet are
counted on further coordinates, which are not posted; pairs above the threshold are
confirmed on the full shingle sets.

Links matter only between documents that are not connected yet.  First each document
is checked against the smallest one of its lists, then against the one that agrees with
it most, which connects large groups with a few checks a member; the last round checks
all pairs of a list that are still in different components, inside the tasks where the
blocks of the list meet, which hand on nothing but links that connect.

Recall: every pair that shares a list and is similar enough is found but for chance.  A
pair at a similarity of exactly 0.80 agrees on fewer than ``MATCHES`` coordinates, and may
then share no list, with a probability of 3.3e-5 (binomial); above 0.80 less often.  Two
thirds of the counted coordinates, which are asked for before the full sets are compared,
are missed by such a pair with a probability of 2e-10.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unbrev.llm.common import (
    binaries,
    byte_buffer,
    components,
    fixed_binary,
    group_runs,
    in_blocks,
    mixed,
    shingle_sets,
    slices,
)
from unbrev.llm.url_filter import bloom_filter, possible_hits
from unbrev.session import settle

#: Coordinates that documents are posted under, and how many of them a pair that is
#: similar enough agrees on: with 0.8 of the shingles shared, 26 are expected, and fewer
#: than 16 come once in 30 000 pairs.
COORDINATES = 32
MATCHES = 16
#: Further coordinates, of 8 bits each, that pairs of a list are counted on, and the
#: threshold: 307 are expected of a pair that is similar enough, 6.5 standard deviations more.
COUNTED = 384
COUNTED_MATCHES = 256
SHINGLE_WORDS = 5
#: Similarity of linked documents, in hundredths.
SIMILARITY = 80
#: Rows of a block, and shingles of a block where full sets are compared.
BLOCK_ROWS = 512
BLOCK_SHINGLES = 1_000_000
#: Text bytes worked through at once; the working arrays, which a worker process keeps,
#: are a hundred times as large.
TEXT_BYTES = 256 << 10
#: Rounds of checks against the best partner before all remaining pairs.
BEST_ROUNDS = 1

_SIGNED = "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, sig binary, fine binary"


def _seeds(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.random.default_rng(7).integers(0, 1 << 63, (2, coordinates), np.int64)
    return numbers[0].astype(np.uint64) | np.uint64(1), numbers[1].astype(np.uint64)


def signatures(docs: DataFrame, words: int, coordinates: int = COORDINATES) -> DataFrame:
    """``doc_id, n_shingles, h1, h2, sig, fine`` of every row of ``(doc_id, text)``.

    ``h1`` and ``h2`` together tell shingle sets apart; ``sig`` holds one 32-bit
    value per coordinate, ``fine`` the low 8 bits of each counted one.
    """
    factor, shift = _seeds(coordinates + COUNTED)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                values, first = shingle_sets(*byte_buffer(part.column("text")), words)
                sizes = np.diff(first)
                full = np.flatnonzero(sizes)
                h1, h2 = np.zeros((2, len(sizes)), np.uint64)
                sig = np.zeros((len(sizes), coordinates + COUNTED), np.uint32)
                if len(full):
                    at = first[:-1][full]
                    h1[full] = np.add.reduceat(mixed(values + np.uint64(1)), at)
                    h2[full] = np.bitwise_xor.reduceat(mixed(values ^ shift[0]), at)
                    for k in range(coordinates + COUNTED):
                        hashed = (values * factor[k] + shift[k]) >> np.uint64(32)
                        sig[full, k] = np.minimum.reduceat(hashed, at)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(sizes, pa.int64()),
                        pa.array(h1.view(np.int64)),
                        pa.array(h2.view(np.int64)),
                        binaries(sig[:, :coordinates]),
                        binaries(sig[:, coordinates:].astype(np.uint8)),
                    ],
                    ["doc_id", "n_shingles", "h1", "h2", "sig", "fine"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(sign, _SIGNED)


def prefixes(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """``(key, rep)``: the postings that can lead to a pair.

    Of each set its rarest coordinate-value pairs, without those that nobody shares: they
    come first of all, so their number is enough to rank the others.
    """
    spread = "rep bigint, h1 bigint, key bigint"

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = fixed_binary(batch.column("sig"), np.uint32, coordinates).astype(np.uint64)
            keys = mixed(sig + (np.arange(1, coordinates + 1, dtype=np.uint64) << np.uint64(32)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column("rep").to_numpy(), coordinates)),
                    pa.array(np.repeat(batch.column("h1").to_numpy(), coordinates)),
                    pa.array(keys.ravel().view(np.int64)),
                ],
                ["rep", "h1", "key"],
            )

    posted = classes.select("rep", "h1", "sig").mapInArrow(post, spread)
    lengths = posted.groupBy("key").agg(F.count(F.lit(1)).alias("_length"))
    shared = posted.join(lengths.filter("_length > 1").hint("merge"), "key")
    # A document with several rows has several sets.
    own = Window.partitionBy("rep", "h1")
    rank = F.row_number().over(own.orderBy("_length", "key"))
    unshared = coordinates - F.count(F.lit(1)).over(own)
    return (
        shared.withColumns({"_rank": rank, "_unshared": unshared})
        .filter(F.col("_rank") + F.col("_unshared") <= coordinates - matches + 1)
        .select("key", "rep")
    )


def confirm(pairs: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a", TEXT_BYTES):
                left, at = shingle_sets(*byte_buffer(part.column("text_a")), words)
                right, to = shingle_sets(*byte_buffer(part.column("text_b")), words)
                good = np.zeros(part.num_rows, bool)
                for i in range(part.num_rows):
                    good[i] = _similar(left[at[i] : at[i + 1]], right[to[i] : to[i + 1]], similarity)
                chosen = pa.array(good)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").filter(chosen), part.column("b").filter(chosen)], ["a", "b"]
                )

    own = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    other = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    # Texts grow with the corpus: never for broadcast.
    return (
        pairs.join(own.hint("merge"), "b")
        .join(other.hint("merge"), "a")
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(check, "a bigint, b bigint")
    )


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that agree on enough of the counted coordinates."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = fixed_binary(batch.column("fine_a"), np.uint8, COUNTED)
            b = fixed_binary(batch.column("fine_b"), np.uint8, COUNTED)
            chosen = pa.array((a == b).sum(axis=1) >= COUNTED_MATCHES)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(chosen), batch.column("b").filter(chosen)], ["a", "b"]
            )

    a = classes.select(F.col("rep").alias("a"), F.col("fine").alias("fine_a"))
    b = classes.select(F.col("rep").alias("b"), F.col("fine").alias("fine_b"))
    return (
        pairs.join(a.hint("merge"), "a")
        .join(b.hint("merge"), "b")
        .select("a", "b", "fine_a", "fine_b")
        .mapInArrow(count, "a bigint, b bigint")
    )


def _members(rows: pa.Table, start: int, stop: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The rows of the two blocks that a group brings together; one entry for a block
    with itself."""
    own = rows.column("_own").to_numpy()[start:stop]
    lo, hi = (rows.column(c)[start].as_py() for c in ("_lo", "_hi"))
    left, right = start + np.flatnonzero(own == lo), start + np.flatnonzero(own == hi)
    return [(left, right)] if lo == hi else [(left, right), (right, left)]


def _best_partners(lists: DataFrame, block_rows: int) -> DataFrame:
    """``(a, b)``: for each document and block of a list the document of another
    component that agrees most on the counted coordinates, if it agrees on enough, from
    ``lists (key, rep, component, fine)``.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in group_runs(batches, ["key", "_lo", "_hi"]):
            fine = fixed_binary(rows.column("fine"), np.uint8, COUNTED)
            rep, comp = (rows.column(c).to_numpy() for c in ("rep", "component"))
            found: set[tuple[int, int]] = set()
            for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                for mine, others in _members(rows, start, stop):
                    for i in mine:
                        js = others[(comp[others] != comp[i]) & (rep[others] != rep[i])]
                        if not len(js):
                            continue
                        agree = (fine[js] == fine[i]).sum(axis=1)
                        best = np.lexsort((rep[js], -agree))[0]
                        if agree[best] >= COUNTED_MATCHES:
                            j = js[best]
                            found.add((max(rep[i], rep[j]), min(rep[i], rep[j])))
            pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    dealt = in_blocks(lists, "key", "rep", block_rows)
    return (
        dealt.select("key", "rep", "component", "fine", "_own", "_lo", "_hi")
        .mapInArrow(meet, "a bigint, b bigint")
        .distinct()
    )


def _pairs_in(rows: pa.Table, start: int, stop: int, fine: np.ndarray) -> np.ndarray:
    """Rows ``(i, j)`` of a group: pairs of different components that agree on enough of
    the counted coordinates and share no earlier list, so that a pair comes from one list
    only, whatever it shares."""
    rep, comp = (rows.column(c).to_numpy() for c in ("rep", "component"))
    here = rows.column("key")[start].as_py()
    earlier: dict[int, set[int]] = {}

    def before(i: int) -> set[int]:
        if i not in earlier:
            earlier[i] = {key for key in rows.column("keys")[i].as_py() if key < here}
        return earlier[i]

    found = []
    mine, others = _members(rows, start, stop)[0]
    for i in mine.tolist():
        js = others[(comp[others] != comp[i]) & (rep[others] != rep[i])]
        js = js[(fine[js] == fine[i]).sum(axis=1) >= COUNTED_MATCHES]
        found += [(i, j) for j in js.tolist() if before(i).isdisjoint(before(j))]
    return np.array(found, np.int64).reshape(-1, 2)


def _with_partners(dealt: DataFrame) -> DataFrame:
    """The dealt rows that have a partner in their group to be compared in full."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in group_runs(batches, ["key", "_lo", "_hi"]):
            fine = fixed_binary(rows.column("fine"), np.uint8, COUNTED)
            chosen = np.zeros(rows.num_rows, bool)
            for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                chosen[_pairs_in(rows, start, stop, fine).ravel()] = True
            yield from rows.filter(pa.array(chosen)).to_batches()

    return dealt.mapInArrow(choose, dealt.schema)


def _links_in_blocks(rows: DataFrame, similarity: int) -> DataFrame:
    """``(a, b)``: links found by comparing full sets inside the groups of ``rows (key,
    rep, component, fine, keys, _own, _lo, _hi, values)``.

    The pairs of a group never leave the task: those that agree most are compared first,
    those that links of the group connect already not at all, and what comes out has
    fewer rows than the group.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in group_runs(batches, ["key", "_lo", "_hi"]):
            fine = fixed_binary(table.column("fine"), np.uint8, COUNTED)
            rep, comp = (table.column(c).to_numpy() for c in ("rep", "component"))
            values = table.column("values")
            links: list[tuple[int, int]] = []
            for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                pairs = _pairs_in(table, start, stop, fine)
                agree = (fine[pairs[:, 0]] == fine[pairs[:, 1]]).sum(axis=1)
                sets: dict[int, np.ndarray] = {}
                parent: dict[int, int] = {}

                def root(c: int) -> int:
                    while (up := parent.get(c, c)) != c:
                        parent[c] = parent.get(up, up)
                        c = up
                    return c

                for i, j in pairs[np.argsort(-agree, kind="stable")].tolist():
                    x, y = root(int(comp[i])), root(int(comp[j]))
                    if x == y:
                        continue
                    for k in (i, j):
                        if k not in sets:
                            sets[k] = np.frombuffer(values[k].as_py(), np.uint64)
                    if _similar(sets[i], sets[j], similarity):
                        parent[x] = y
                        links.append((max(rep[i], rep[j]), min(rep[i], rep[j])))
            found = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return rows.mapInArrow(compare, "a bigint, b bigint").distinct()


def _similar(x: np.ndarray, y: np.ndarray, similarity: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= similarity * (len(x) + len(y) - both)


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """``(rep, values)``: the sorted shingle hashes of ``(rep, text)`` as binaries."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                values, first = shingle_sets(*byte_buffer(part.column("text")), words)
                each = [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep"), pa.array(each, pa.binary())], ["rep", "values"]
                )

    return texts.select("rep", "text").mapInArrow(hashed, "rep bigint, values binary")


def _mixed_lists(lists: DataFrame, linked: DataFrame) -> DataFrame:
    """``key, rep, component`` of the lists that hold several components."""
    tagged = lists.join(
        components(linked).withColumnRenamed("node", "rep").hint("merge"), "rep", "left"
    ).select("key", "rep", F.coalesce("component", "rep").alias("component"))
    mixed_keys = (
        tagged.groupBy("key")
        .agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
        .filter("_low != _high")
        .select("key")
    )
    return settle(tagged.join(mixed_keys, "key", "left_semi"))


def _all_lists(lists: DataFrame, rest: DataFrame) -> DataFrame:
    """``rep, keys``: all lists of the documents that ``rest`` still has, and of no others."""
    own = lists.join(rest.select("rep").distinct().hint("merge"), "rep", "left_semi")
    return own.groupBy("rep").agg(F.collect_set("key").alias("keys"))


def near_duplicates(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    similarity: int = SIMILARITY,
    coordinates: int = COORDINATES,
    matches: int = MATCHES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``(doc_id, text)``.

    Linked are documents whose sets of ``words``-word shingles have an intersection
    of at least ``similarity`` hundredths of their union.  Texts with equal sets are
    one class from the start, so copies cost nothing further.  Texts of fewer words
    than a shingle have their whole sequence as one; null texts and texts without
    words have an empty set, are linked with nothing and kept.  Rows that repeat an
    id count as one document, linked by any of its rows.  A row with a null id has no
    component and is kept.  Other columns of ``docs`` are ignored.
    """
    docs = docs.select("doc_id", "text")
    signed = settle(signatures(docs, words, coordinates))
    usable = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = settle(
        usable.groupBy("h1", "h2", "n_shingles").agg(
            F.min("doc_id").alias("rep"),
            F.any_value("sig").alias("sig"),
            F.any_value("fine").alias("fine"),
        )
    )
    lists = settle(prefixes(classes, coordinates, matches))

    # Round 1: every document against the smallest of each of its lists.
    pivots = lists.groupBy("key").agg(F.min("rep").alias("b"))
    stars = (
        lists.join(pivots, "key")
        .filter("rep != b")
        .select(F.col("rep").alias("a"), "b")
        .distinct()
    )
    near = settle(_agreeing(stars, classes).distinct())
    linked = settle(confirm(near, _texts(docs, _both(near)), words, similarity))

    # Round 2: each document against what agrees with it most.
    tried = near
    for _ in range(BEST_ROUNDS):
        rest = _mixed_lists(lists, linked).join(classes.select("rep", "fine").hint("merge"), "rep")
        fresh = settle(_best_partners(rest, block_rows).join(tried.hint("merge"), ["a", "b"], "left_anti"))
        more = settle(confirm(fresh, _texts(docs, _both(fresh)), words, similarity))
        linked, tried = linked.unionByName(more), tried.unionByName(fresh)

    # At last all pairs of a list whose documents are in different components even then,
    # in the blocks where they meet.  Only sets of documents that have such a pair travel.
    rest = _mixed_lists(lists, linked)
    whole = rest.join(classes.select("rep", "fine", "n_shingles").hint("merge"), "rep").join(
        _all_lists(lists, rest).hint("merge"), "rep"
    )
    dealt = in_blocks(whole, "key", "rep", block_rows, "n_shingles", BLOCK_SHINGLES).select(
        "key", "rep", "component", "fine", "keys", "_own", "_lo", "_hi"
    )
    open_rows = settle(_with_partners(dealt))
    sets = _sets(_texts(docs, open_rows.select("rep")), words)
    full = open_rows.join(sets.hint("merge"), "rep").repartition("key", "_lo", "_hi")
    more = _links_in_blocks(full.sortWithinPartitions("key", "_lo", "_hi"), similarity)
    linked = linked.unionByName(settle(more))

    # A document with several rows joins the classes of all of them.
    owned = (
        usable.select("doc_id", "h1", "h2", "n_shingles")
        .join(classes.drop("sig", "fine").hint("merge"), ["h1", "h2", "n_shingles"])
        .select("doc_id", "rep")
        .distinct()
    )
    first = owned.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("_last"))
    several = first.filter("b != _last").join(owned, "doc_id").filter("rep != b")
    groups = components(
        linked.unionByName(several.select(F.col("rep").alias("a"), "b"))
    )
    by_doc = first.join(groups.withColumnRenamed("node", "b"), "b", "left").select(
        "doc_id", F.coalesce("component", "b").alias("_found")
    )
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("_found", "doc_id"))
    return (
        signed.select("doc_id", "n_shingles")
        .join(by_doc, "doc_id", "left")
        .withColumn("component_id", found)
        .select(
            "doc_id",
            "n_shingles",
            "component_id",
            F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("rep"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(rep, text)`` of the documents ``wanted (rep)``.

    A Bloom filter of fixed size keeps most other texts out of the shuffle.
    """
    wanted = settle(wanted.distinct())
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text").withColumn(
        "_key", F.col("rep").cast("string")
    )
    maybe = possible_hits(keyed, bloom_filter(wanted.select(F.col("rep").cast("string").alias("k")), "k"), "_key")
    return settle(maybe.drop("_key").join(wanted.hint("merge"), "rep"))
