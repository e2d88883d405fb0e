"""Repeated byte strings across documents, from merged Burrows-Wheeler transforms.

A byte goes if a string of ``span`` bytes that covers it also starts in a document
with a smaller id.  Three steps find those strings:

* **Anchors.**  Every window of ``span`` bytes names the smallest hash of the ``ANCHOR``-byte
  strings in it.  Equal windows name equal anchors, so only windows whose anchor occurs
  in several texts can repeat; about one position in sixteen is an anchor.
* **Shards.**  The remaining windows are cut into short segments around their anchors and
  dealt out by anchor, equal segments as one.  A task takes the segments of many anchors
  as two shards, each with its own Burrows-Wheeler transform.
* **Merge.**  The interleave of the shards' suffixes starts as a concatenation and is
  refined one character a round: reading the transforms in interleave order and dealing
  the entries to their symbols orders the suffixes by one character more.  No suffix is
  compared with one of another shard.  The round in which two neighbours part is their
  common prefix; after ``span`` rounds the intervals that have not parted are the
  repeated strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unbrev.llm.common import (
    byte_buffer,
    group_runs,
    mixed,
    packed,
    prefix_hash,
    slices,
    span_hash,
    unpacked,
)
from unbrev.llm.url_filter import bloom_filter, possible_hits
from unbrev.session import settle

SPAN = 50
ANCHOR = 20
#: Text bytes whose anchors a task sends together, and that one bucket stands for.
FLUSH_BYTES = 16 << 20
BUCKET_BYTES = 24 << 20
#: Bytes of rows that are merged at once, from two shards: what a round reads and writes
#: stays in a core's cache.
MERGE_BYTES = 384 << 10
#: An anchor that occurs in more places than this has its windows grouped one by one.
HOT_PLACES = 20_000
#: Ends a segment.  No byte of UTF-8 has this value; it sorts after all of them.
END = 0xFF

_BLOB = "kind int, bucket int, tag bigint, tags binary, owners binary, codes binary"
_ANSWER = "part int, tags binary, codes binary"
_KNOWN = "tag bigint, codes binary"
_SEGMENT = "anchor bigint, seg binary, tag bigint, doc bigint, start int"
_RANGE = "tag bigint, low bigint, high bigint"


# -- anchors -----------------------------------------------------------------


def window_anchors(data: np.ndarray, span: int = SPAN) -> np.ndarray:
    """The anchor hash of the window at every position."""
    n = len(data) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prefix = prefix_hash(data)
    at = np.arange(len(data) - ANCHOR + 1)
    low = span_hash(prefix, at, at + ANCHOR)
    width, need = 1, span - ANCHOR + 1
    while width * 2 <= need:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = need - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def inside(offsets: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Which windows of a buffer lie within one text."""
    total = int(offsets[-1])
    if total < span:
        return np.zeros(0, bool)
    room = np.repeat(offsets[1:], np.diff(offsets))[: total - span + 1]
    return np.arange(total - span + 1) + span <= room


def _codes(anchors: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the high half, 32 bits that tell anchors of a bucket apart below."""
    h = mixed(anchors ^ np.uint64(0x5851F42D4C957F2D))
    low = h & np.uint64(0xFFFFFFFF)
    return ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | low


def _anchor_blobs(texts: DataFrame, buckets: int, span: int) -> DataFrame:
    """Packed anchors of ``(tag, text)``.

    ``kind`` 0: the anchors of one bucket in a stretch of texts, each with its owner.
    An anchor that several texts of the stretch have is known to repeat; it is sent
    once, without owner (0), and its owners are told at once (``kind`` 1, ``bucket`` the
    part that gathers what a text is told).
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, owners, tags, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal codes, owners, tags, size
            if not codes:
                return
            code, owner = np.concatenate(codes), np.concatenate(owners)
            names = np.array(tags, np.int64)
            names, owner_of = np.unique(names, return_inverse=True)
            owner = owner_of[owner]
            order = np.lexsort((owner, code))
            code, owner = code[order], owner[order]
            fresh = np.ones(len(code), bool)
            fresh[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
            code, owner = code[fresh], owner[fresh]
            first = np.ones(len(code), bool)
            first[1:] = code[1:] != code[:-1]
            starts = np.flatnonzero(first)
            count = np.diff(np.append(starts, len(code)))
            shared = np.repeat(count > 1, count)
            told = _told(names[owner[shared]], code[shared], buckets)
            yield _blob(
                kind=[1] * len(told),
                bucket=[part for part, *_ in told],
                tag=[0] * len(told),
                tags=[tags for _, tags, _ in told],
                owners=[None] * len(told),
                codes=[codes for *_, codes in told],
            )
            send = first
            code, owner, shared = code[send], owner[send], shared[send]
            names = np.concatenate([[0], names])
            owner = np.where(shared, 0, owner + 1).astype(np.uint32)
            bucket = (code >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            rows = {"kind": [], "bucket": [], "tag": [], "tags": [], "owners": [], "codes": []}
            for b in full:
                part = slice(cuts[b], cuts[b + 1])
                own, local = np.unique(owner[part], return_inverse=True)
                values = (0, int(b), 0, names[own].tobytes(), local.astype(np.uint32).tobytes())
                for name, value in zip(rows, (*values, code[part].astype(np.uint32).tobytes())):
                    rows[name].append(value)
            yield _blob(**rows)
            codes, owners, tags, size = [], [], [], 0

        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = byte_buffer(part.column("text"))
                anchor = window_anchors(data, span)
                ok = inside(offsets, span)
                change = ok.copy()
                change[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[:-1]
                at = np.flatnonzero(change)
                text = np.searchsorted(offsets, at, side="right") - 1
                codes.append(_codes(anchor[at], buckets))
                owners.append(text + len(tags))
                tags.extend(part.column("tag").to_pylist())
                size += len(data)
                if size >= FLUSH_BYTES:
                    yield from flush()
        yield from flush()

    return texts.select("tag", "text").mapInArrow(pack, _BLOB)


def _blob(**rows: list) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "bucket": pa.int32(), "tag": pa.int64()}
    return pa.RecordBatch.from_pydict(
        {name: pa.array(values, kinds.get(name, pa.binary())) for name, values in rows.items()}
    )


def _told(tags: np.ndarray, codes: np.ndarray, parts: int) -> list[tuple[int, bytes, bytes]]:
    """Repeated anchors and the texts that have them, by part of the texts."""
    part = (tags.view(np.uint64) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    return [
        (int(p), tags[order[cuts[p] : cuts[p + 1]]].tobytes(), codes[order[cuts[p] : cuts[p + 1]]].tobytes())
        for p in np.flatnonzero(np.diff(cuts))
    ]


def repeated_anchors(texts: DataFrame, buckets: int, span: int = SPAN) -> DataFrame:
    """``(tag, codes)``: for each text its anchors that other texts have too.

    ``texts (tag, text)`` may repeat a tag, which counts once.  Answers go back packed,
    one row for a bucket and a part of the texts.
    """
    blobs = settle(_anchor_blobs(texts, buckets, span))

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, tags, bucket = [], [], 0
        for row in rows:
            for own, owners, code in zip(row.column("tags"), row.column("owners"), row.column("codes")):
                names = np.frombuffer(own.as_buffer(), np.int64)
                tags.append(names[np.frombuffer(owners.as_buffer(), np.uint32)])
                codes.append(np.frombuffer(code.as_buffer(), np.uint32))
            bucket = row.column("bucket")[0].as_py()
        code, tag = np.concatenate(codes), np.concatenate(tags)
        order = np.argsort(code, kind="stable")
        code, tag = code[order], tag[order]
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        count = np.diff(np.append(starts, len(code)))
        several = np.minimum.reduceat(tag, starts) != np.maximum.reduceat(tag, starts)
        keep = np.repeat(several, count) & (tag != 0)
        full = code[keep].astype(np.uint64) | np.uint64(bucket) << np.uint64(32)
        told = _told(tag[keep], full, buckets)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in told], pa.int32()),
                pa.array([x[1] for x in told], pa.binary()),
                pa.array([x[2] for x in told], pa.binary()),
            ],
            ["part", "tags", "codes"],
        )

    def gather(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags, codes = [], []
        for row in rows:
            tags.extend(np.frombuffer(x.as_buffer(), np.int64) for x in row.column("tags"))
            codes.extend(np.frombuffer(x.as_buffer(), np.uint64) for x in row.column("codes"))
        tag, code = np.concatenate(tags), np.concatenate(codes)
        order = np.argsort(tag, kind="stable")
        tag, code = tag[order], code[order]
        starts = np.flatnonzero(np.concatenate([[True], tag[1:] != tag[:-1]]))
        ends = np.append(starts[1:], len(tag))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(tag[starts]),
                pa.array([code[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
            ],
            ["tag", "codes"],
        )

    sent = blobs.filter("kind = 0").groupBy("bucket").applyInArrow(compare, _ANSWER)
    told = blobs.filter("kind = 1").select(F.col("bucket").alias("part"), "tags", "codes")
    return told.unionByName(sent).groupBy("part").applyInArrow(gather, _KNOWN)


# -- segments -----------------------------------------------------------------


def segments(texts: DataFrame, buckets: int, span: int = SPAN) -> DataFrame:
    """``anchor, seg, tag, doc, start`` around the repeated anchors of
    ``texts (tag, doc, text, codes)``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = byte_buffer(part.column("text"))
                anchor = window_anchors(data, span)
                ok = inside(offsets, span)
                if not ok.any():
                    continue
                text = np.repeat(np.arange(part.num_rows), np.diff(offsets))[: len(ok)]
                head = np.ones(len(ok), bool)
                head[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (ok[1:] != ok[:-1])
                start = np.flatnonzero(head)
                length = np.diff(np.append(start, len(ok)))
                use = ok[start]
                start, length = start[use], length[use]
                # Runs of one anchor longer than a window are periodic text: cut them.
                most = span - ANCHOR + 1
                pieces = -(-length // most)
                nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.repeat(start, pieces) + nth * most
                length = np.minimum(np.repeat(length, pieces) - nth * most, most)
                own = text[start]
                codes = _codes(anchor[start], buckets)
                wanted = np.zeros(len(start), bool)
                known = part.column("codes")
                edge = np.searchsorted(own, np.arange(part.num_rows + 1))
                for row in range(part.num_rows):
                    span_of = slice(edge[row], edge[row + 1])
                    repeated = np.frombuffer(known[row].as_buffer(), np.uint64)
                    wanted[span_of] = np.isin(codes[span_of], repeated)
                start, length, own = start[wanted], length[wanted], own[wanted]
                stop = start + length + span - 1
                sizes = stop - start
                first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = data[np.arange(first[-1]) + np.repeat(start - first[:-1], sizes)]
                seg = pa.Array.from_buffers(
                    pa.binary(), len(start), [None, pa.py_buffer(first), pa.py_buffer(flat)]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[start].view(np.int64)),
                        seg,
                        part.column("tag").take(pa.array(own)),
                        part.column("doc").take(pa.array(own)),
                        pa.array((start - offsets[own]).astype(np.int32)),
                    ],
                    ["anchor", "seg", "tag", "doc", "start"],
                )

    return texts.select("tag", "doc", "text", "codes").mapInArrow(cut, _SEGMENT)


# -- transforms ----------------------------------------------------------------


def shard_transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of one shard by its first 64 bytes, and its transform.

    ``text`` holds segments that each end with :data:`END`.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    padded = np.concatenate([text, np.full(64, END, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + n]
    # What follows a segment's end must not count.
    ends = np.flatnonzero(text == END)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    short = left < 8
    blank = (np.uint64(1) << (np.uint64(8) * (np.uint64(7) - left[short].astype(np.uint64)))) - np.uint64(1)
    key[short] |= blank
    width = 8
    while True:
        # Equal suffixes may come in any order: they are one interval.
        order = np.argsort(key)
        ordered = key[order]
        rank = np.zeros(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if width >= 64:
            break
        second = np.full(n, n, np.int64)
        reach = np.flatnonzero(left >= width)
        second[reach] = rank[reach + width]
        key = rank * (n + 1) + second
        width *= 2
    before = np.concatenate([[END], text[:-1]])
    return order, before[order]


def merge_transforms(
    one: np.ndarray, two: np.ndarray, rounds: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave the suffixes of two shards by their first ``rounds`` bytes.

    Gives for each suffix in merged order whether it is of the second shard; where a
    new interval begins; and for each place the common prefix with the suffix before
    (``rounds`` where they have not parted).  Ends of segments differ from each other.
    """
    n = len(one) + len(two)
    second = np.arange(n) >= len(one)
    tail = np.arange(int((one == END).sum()) + int((two == END).sum())) >= int((one == END).sum())
    body = n - len(tail)
    head = np.zeros(n, bool)
    head[0] = True
    common = np.zeros(n, np.uint8)
    symbol = np.empty(n, np.uint8)
    # Where each symbol's entries begin, in every round.
    sizes = np.bincount(one, minlength=256) + np.bincount(two, minlength=256)
    begins = np.cumsum(sizes) - sizes
    begins = begins[sizes > 0]
    parted = np.empty(n, bool)
    for _ in range(rounds):
        symbol[~second] = one
        symbol[second] = two
        order = np.argsort(symbol, kind="stable")
        block = np.cumsum(head, dtype=np.int32).take(order)
        second = second.take(order)
        second[body:] = tail
        np.not_equal(block[1:], block[:-1], out=parted[1:])
        parted[begins] = True
        parted[body:] = True
        head |= parted
        common += ~head
    return second, head, common


def smallest_owner(
    text: np.ndarray, first: np.ndarray, owner: np.ndarray, span: int
) -> np.ndarray:
    """For each byte of the segments: the smallest owner of the ``span`` bytes there.

    ``first`` has the bounds of the segments, which end with :data:`END`.  Places
    with fewer bytes than that before their segment's end get their own owner.
    """
    middle = first[(len(first) - 1) // 2]
    (order, one), (rest, two) = shard_transform(text[:middle]), shard_transform(text[middle:])
    second, head, _ = merge_transforms(one, two, span)
    place = np.empty(len(text), np.int64)
    place[~second] = order
    place[second] = rest + middle
    own = np.repeat(owner, np.diff(first))
    starts = np.flatnonzero(head)
    least = np.minimum.reduceat(own[place], starts)
    out = np.empty(len(text), np.int64)
    out[place] = np.repeat(least, np.diff(np.append(starts, len(text))))
    return out


def in_company(anchors: np.ndarray, kind: np.ndarray, kinds: int) -> np.ndarray:
    """Which kinds of segments share their anchor with another kind.

    Equal windows name one anchor, so the only segment of an anchor meets no other.
    """
    own = np.empty(kinds, np.int64)
    own[kind] = anchors
    _, of, number = np.unique(own, return_inverse=True, return_counts=True)
    return number[of] > 1


def _merged(found: DataFrame, span: int) -> DataFrame:
    """Removed ranges ``(tag, low, high)`` of segments, by the merge.

    ``found`` has the segments of an anchor together, sorted by it.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def work() -> pa.RecordBatch:
            rows = pa.concat_tables(held)
            doc = rows.column("doc").to_numpy()
            # Equal segments are one, of their smallest document.
            coded = rows.column("seg").combine_chunks().dictionary_encode()
            kind = coded.indices.to_numpy()
            owner = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
            np.minimum.at(owner, kind, doc)
            data, offsets = byte_buffer(coded.dictionary)
            sizes = np.diff(offsets)
            first = offsets + np.arange(len(offsets))
            least = np.repeat(owner, sizes + 1)
            several = in_company(rows.column("anchor").to_numpy(), kind, len(owner))
            if several.any():
                merged = np.repeat(several, sizes + 1)
                text = np.full(first[-1], END, np.uint8)
                text[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data
                bounds = np.concatenate([[0], np.cumsum(sizes[several] + 1)])
                least[merged] = smallest_owner(text[merged], bounds, owner[several], span)
            return _gone(rows, least, first[kind], sizes[kind] - span + 1, span)

        for rows, _ in group_runs(batches, ["anchor"]):
            held.append(rows)
            size += rows.nbytes
            if size >= MERGE_BYTES:
                yield work()
                held, size = [], 0
        if held:
            yield work()

    return found.select("anchor", "seg", "tag", "doc", "start").mapInArrow(merge, _RANGE)


def _gone(
    rows: pa.Table, least: np.ndarray, first: np.ndarray, windows: np.ndarray, span: int
) -> pa.RecordBatch:
    """Ranges of the rows' windows whose smallest owner is an earlier document.

    Row ``i`` has its windows' owners in ``least`` from ``first[i]``.
    """
    row = np.repeat(np.arange(len(windows)), windows)
    at = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    gone = least[first[row] + at] < rows.column("doc").to_numpy()[row]
    edge = np.zeros(len(row), bool)
    edge[1:] = (row[1:] != row[:-1]) | (gone[1:] != gone[:-1])
    edge[:1] = True
    begins = np.flatnonzero(edge)
    ends = np.append(begins[1:], len(row))
    begins, ends = begins[gone[begins]], ends[gone[begins]]
    own = row[begins]
    low = rows.column("start").to_numpy()[own] + at[begins]
    return pa.RecordBatch.from_arrays(
        [
            rows.column("tag").combine_chunks().take(pa.array(own)),
            pa.array(low, pa.int64()),
            pa.array(low + (ends - begins) + span - 1, pa.int64()),
        ],
        ["tag", "low", "high"],
    )


def _one_by_one(found: DataFrame, span: int) -> DataFrame:
    """Removed ranges of segments whose anchors occur in very many places.

    Their windows are grouped by their whole bytes, with the smallest document summed
    up before the shuffle, so an anchor may have any number of them.
    """
    at = F.sequence(F.lit(1), F.length("seg") - span + 1)
    windows = found.select("tag", "doc", "start", "seg", F.explode(at).alias("_at")).select(
        "tag",
        "doc",
        (F.col("start") + F.col("_at") - 1).cast("bigint").alias("low"),
        F.substring("seg", F.col("_at"), F.lit(span)).alias("window"),
    )
    least = windows.groupBy("window").agg(F.min("doc").alias("owner"))
    return (
        windows.join(least.hint("merge"), "window")
        .filter("owner < doc")
        .select("tag", "low", (F.col("low") + span).alias("high"))
    )


# -- the operator ----------------------------------------------------------------


def with_tag(docs: DataFrame) -> DataFrame:
    """Add ``tag``, equal for equal texts (never 0); null texts become empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tag = F.xxhash64(text)
    return docs.withColumn("text", text).withColumn("tag", F.when(tag == 0, 1).otherwise(tag))


def repeated_spans(tagged: DataFrame, classes: DataFrame, span: int = SPAN) -> DataFrame:
    """``(tag, spans)``: removed byte ranges of the first document of each text.

    ``tagged (doc_id, tag, text)`` has all documents, ``classes (tag, doc, n_bytes)``
    the smallest id and the length of each different text.
    """
    total = classes.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET_BYTES))
    known = settle(repeated_anchors(tagged.select("tag", "text"), buckets, span))
    firsts = known.join(classes.select("tag", "doc").hint("merge"), "tag")
    bloom = bloom_filter(known.select(F.col("tag").cast("string").alias("k")), "k")
    maybe = possible_hits(
        tagged.select("doc_id", "tag", "text").withColumn("_k", F.col("tag").cast("string")), bloom, "_k"
    )
    # By both columns: of a text with very many copies the first alone is wanted.
    own = firsts.withColumn("doc_id", F.col("doc"))
    texts = maybe.drop("_k").join(own.hint("merge"), ["tag", "doc_id"])
    found = settle(segments(texts, buckets, span))

    places = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"))
    hot = settle(places.filter(F.col("_n") > HOT_PLACES).select("anchor"))
    plain = (
        found.repartition("anchor")
        .join(hot, "anchor", "left_anti")
        .sortWithinPartitions("anchor")
    )
    ranges = _merged(plain, span).unionByName(
        _one_by_one(found.join(hot, "anchor", "left_semi"), span)
    )
    return ranges.groupBy("tag").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def text_classes(tagged: DataFrame) -> DataFrame:
    """``(tag, doc, n_bytes)`` of each different text; ids that are null don't count."""
    return (
        tagged.filter(F.col("doc_id").isNotNull())
        .groupBy("tag")
        .agg(F.min("doc_id").alias("doc"), F.max(F.octet_length("text")).cast("bigint").alias("n_bytes"))
    )


def _union(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans or ()):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def _remaining(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for pair in gone for x in pair), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def removal_report(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row.

    A later copy of a whole text (of ``span`` bytes at least) loses everything.  Null
    texts count as empty.  Rows of one id are one document to each other: nothing of
    theirs goes because of the other.  Rows with a null id lose nothing and take
    nothing from others.  Other columns of ``docs`` are ignored.
    """
    tagged = with_tag(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    base = settle(
        tagged.select(
            "doc_id",
            "tag",
            F.octet_length("text").cast("bigint").alias("n_bytes"),
            F.sha2(F.col("text").cast("binary"), 256).alias("whole"),
        )
    )
    classes = settle(
        base.filter("doc_id is not null")
        .groupBy("tag")
        .agg(F.min("doc_id").alias("doc"), F.max("n_bytes").alias("n_bytes"))
    )
    tagged = tagged.filter("doc_id is not null")
    spans = settle(repeated_spans(tagged, classes, span))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"tag": batch.column("tag"), "n_removed": [], "n_spans": [], "sha": []}
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                gone = _union(spans.as_py())
                rows["n_removed"].append(sum(b - a for a, b in gone))
                rows["n_spans"].append(len(gone))
                rows["sha"].append(hashlib.sha256(_remaining(text.as_py().encode(), gone)).hexdigest())
            yield pa.RecordBatch.from_pydict(rows)

    bloom = bloom_filter(spans.select(F.col("tag").cast("string").alias("k")), "k")
    maybe = possible_hits(tagged.withColumn("_k", F.col("tag").cast("string")), bloom, "_k")
    firsts = spans.join(classes.select("tag", F.col("doc").alias("doc_id")).hint("merge"), "tag")
    changed = (
        maybe.drop("_k")
        .join(firsts.hint("merge"), ["tag", "doc_id"])
        .select("tag", "text", "spans")
        .mapInArrow(cut, "tag bigint, n_removed bigint, n_spans bigint, sha string")
        .distinct()
    )
    copy = F.coalesce((F.col("doc_id") > F.col("doc")) & (F.col("n_bytes") >= span), F.lit(False))
    own = F.coalesce(F.col("doc_id") == F.col("doc"), F.lit(False)) & F.col("n_removed").isNotNull()
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        base.join(classes.select("tag", "doc").hint("merge"), "tag", "left")
        .join(changed.hint("merge"), "tag", "left")
        .select(
            "doc_id",
            "n_bytes",
            F.when(copy, F.col("n_bytes")).when(own, F.col("n_removed")).otherwise(0).alias("n_removed"),
            F.when(copy, 1).when(own, F.col("n_spans")).otherwise(0).cast("bigint").alias("n_spans"),
            F.when(copy, nothing).when(own, F.col("sha")).otherwise(F.col("whole")).alias("kept_sha256"),
        )
    )


def without_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``docs`` with repeated bytes taken out of ``text``; rows left without any go.

    The same removals as :func:`removal_report`.  A character that loses some of its
    bytes goes whole.  ``n_chars``, where there is such a column, is counted anew for
    texts that changed; all other columns stay.  Null and empty texts stay as they are.
    """
    keys = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    tagged = with_tag(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).filter(
        "doc_id is not null"
    )
    classes = settle(text_classes(tagged))
    spans = repeated_spans(tagged, classes, span)
    cuts = classes.join(spans, "tag", "left").select("tag", "doc", "spans")
    text = F.coalesce(F.col("text"), F.lit(""))
    tag = F.xxhash64(text)
    held = packed(docs, *keys)
    rows = held.withColumn("tag", F.when(tag == 0, 1).otherwise(tag)).join(cuts.hint("merge"), "tag", "left")
    copy = (F.col("doc_id") > F.col("doc")) & (F.octet_length(text) >= span)
    first = F.col("doc_id") == F.col("doc")
    rows = rows.filter(~F.coalesce(copy, F.lit(False))).withColumn(
        "spans", F.when(F.coalesce(first, F.lit(False)), F.col("spans"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, stay = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans")):
                gone = _union(spans.as_py()) if text else []
                left = _remaining(text.encode(), gone).decode(errors="ignore") if gone else text
                texts.append(left)
                sizes.append(len(left) if gone else None)
                stay.append(not gone or left != "")
            columns = {c: batch.column(c) for c in [*keys, "row"]}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                fresh = pa.array(sizes, pa.int64()).cast(columns["n_chars"].type)
                columns["n_chars"] = pc.coalesce(fresh, columns["n_chars"])
            yield pa.RecordBatch.from_pydict(columns).filter(pa.array(stay, pa.bool_()))

    left = rows.select(*keys, "row", "spans").mapInArrow(cut, held.schema)
    return unpacked(left, docs.columns, *keys)
