"""Near-duplicate vectors by E8 lattice hashing.

Each table projects the vectors on ``BLOCKS`` random eight-dimensional spaces and takes
the nearest E8 lattice points as the cell.  A vector is filed in its own cell and also
looks into the cells of the next-nearest lattice points.  All vectors that meet in a
cell are compared by cosine in double precision.

Equal vectors are one from the start.  A cell that holds very many is compared in
blocks; tasks hand on sums and spanning links, never all pairs.  A pair that meets in
several cells counts in the first of them only.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unbrev.llm.common import binaries, components, fixed_binary, group_runs, in_blocks, mixed
from unbrev.session import settle

DIMENSIONS = 8
TABLES = 6
BLOCKS = 2
SCALE = 0.3
PROBES = 4
COSINE = 0.95
BLOCK_ROWS = 1024
#: Vectors whose components and keys a task works out at once.
STEP = 2048


class Hashing(NamedTuple):
    """Parameters of the tables.

    For pairs at a cosine of exactly 0.95 in 64 dimensions the defaults find about 70
    of 100 in each table, so 999 of 1000 in six; closer pairs are found more often.
    """

    tables: int = TABLES
    blocks: int = BLOCKS
    scale: float = SCALE
    probes: int = PROBES
    seed: int = 11

    def step(self, size: int) -> float:
        """Scale of the lattice: ``scale`` for 64 dimensions, and for others as the
        length of a projected difference goes."""
        return self.scale * (64 / size) ** 0.5

    def projections(self, size: int) -> np.ndarray:
        """For each table and block an orthonormal basis of eight directions."""
        rng = np.random.default_rng(self.seed)
        out = np.empty((self.tables, self.blocks * DIMENSIONS, size))
        for t in range(self.tables):
            random = rng.normal(size=(max(size, self.blocks * DIMENSIONS), self.blocks * DIMENSIONS))
            out[t] = np.linalg.qr(random)[0][:size].T
        return out


def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled to be whole numbers."""
    out = []
    for i, j in itertools.combinations(range(DIMENSIONS), 2):
        for a, b in itertools.product((2, -2), repeat=2):
            v = [0] * DIMENSIONS
            v[i], v[j] = a, b
            out.append(v)
    signs = itertools.product((1, -1), repeat=DIMENSIONS)
    out.extend(list(s) for s in signs if s.count(-1) % 2 == 0)
    return np.array(out, np.int8)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest whole-number points of even sum."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(axis=-1)
    rows = np.arange(len(x))
    odd = near.sum(axis=-1) % 2 != 0
    near[rows, worst] += np.where(odd, np.where(off[rows, worst] >= 0, 1.0, -1.0), 0.0)
    return near


def nearest_point(x: np.ndarray) -> np.ndarray:
    """Nearest E8 lattice point of each row."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(-1) <= ((x - half) ** 2).sum(-1)
    return np.where(closer[:, None], whole, half)


def cell_keys(vectors: np.ndarray, hashing: Hashing) -> np.ndarray:
    """Keys ``(vector, table, 1 + probes)`` of unit vectors; the first is its own cell."""
    roots = shortest().astype(float) / 2
    out = np.empty((len(vectors), hashing.tables, 1 + hashing.probes), np.uint64)
    rows = np.arange(len(vectors))
    for t, basis in enumerate(hashing.projections(vectors.shape[1])):
        y = (vectors @ basis.T / hashing.step(vectors.shape[1])).reshape(len(vectors), hashing.blocks, DIMENSIONS)
        cell = np.stack([nearest_point(y[:, b]) for b in range(hashing.blocks)], 1)
        gain = np.concatenate([(y[:, b] - cell[:, b]) @ roots.T for b in range(hashing.blocks)], 1)
        best = np.argsort(-gain, axis=1, kind="stable")[:, : hashing.probes]
        out[:, t, 0] = _hashed(cell, t)
        for p in range(hashing.probes):
            block, root = np.divmod(best[:, p], len(roots))
            moved = cell.copy()
            moved[rows, block] += roots[root]
            out[:, t, 1 + p] = _hashed(moved, t)
    return out


def _hashed(cell: np.ndarray, table: int) -> np.ndarray:
    whole = np.rint(cell * 2).astype(np.int64).reshape(len(cell), -1).astype(np.uint64)
    h = np.full(len(cell), table + 1, np.uint64)
    for k in range(whole.shape[1]):
        h = mixed(h * np.uint64(31) + whole[:, k])
    return h


# -- Spark jobs --------------------------------------------------------------


def usable(vectors: DataFrame) -> DataFrame:
    """Different vectors that can be compared: ``(rep, copies, size, unit binary)``.

    ``rep`` is the smallest id of equal vectors.  Null and zero vectors and those with
    null or non-finite components are left out.
    """
    column = F.col("embedding").cast("array<double>")
    finite = F.forall(
        column,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")),
    )
    good = vectors.filter(
        F.coalesce(finite & F.exists(column, lambda x: x != 0.0), F.lit(False)) & F.col("vec_id").isNotNull()
    )
    return good.groupBy(column.alias("embedding")).agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")
    )


def _unit(batch: pa.RecordBatch, rows: np.ndarray, size: int) -> np.ndarray:
    values = batch.column("embedding").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    matrix = values.reshape(len(rows), size)
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix**2).sum(axis=1, keepdims=True))


def _filed(distinct: DataFrame, hashing: Hashing) -> DataFrame:
    """``rep, copies, size, unit, keys`` of each vector."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("embedding")).to_numpy()
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                for at in range(0, len(own), STEP):
                    rows = own[at : at + STEP]
                    unit = _unit(batch, rows, int(size))
                    keys = cell_keys(unit, hashing)
                    # Vectors of different sizes never share a cell.
                    keys = mixed(keys + np.uint64(size))
                    chosen = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("rep").take(chosen),
                            batch.column("copies").take(chosen),
                            pa.array(np.full(len(rows), size), pa.int32()),
                            binaries(unit),
                            pa.array(list(keys.view(np.int64).reshape(len(rows), -1)), pa.list_(pa.int64())),
                        ],
                        ["rep", "copies", "size", "unit", "keys"],
                    )

    return distinct.select("embedding", "rep", "copies").mapInArrow(
        file, "rep bigint, copies bigint, size int, unit binary, keys array<bigint>"
    )


def _meetings(filed: DataFrame, hashing: Hashing, cosine: float, block_rows: int) -> DataFrame:
    """``(rep, links, b)``: for each cell and vector the links that count there, with
    multiplicity, and another vector connected to it (the smallest of its patch)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in group_runs(batches, ["key", "_lo", "_hi"]):
            rep, copies, slot, own, lo, hi, sizes = (
                rows.column(c).to_numpy() for c in ("rep", "copies", "slot", "_own", "_lo", "_hi", "size")
            )
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            keys = None
            flat = rows.column("unit").combine_chunks()
            for start, stop in zip(cuts[:-1], cuts[1:]):
                size = int(sizes[start])
                group = np.arange(start, stop)
                left = group[own[group] == lo[start]]
                right = group[own[group] == hi[start]]
                a = fixed_binary(flat.take(pa.array(left)), np.float64, size)
                b = a if lo[start] == hi[start] else fixed_binary(flat.take(pa.array(right)), np.float64, size)
                near = a @ b.T >= cosine - 1e-9
                # Some one of the two must be at home in the cell; ids once each way.
                near &= (slot[left][:, None] == 0) | (slot[right][None, :] == 0)
                near &= rep[left][:, None] != rep[right][None, :]
                if lo[start] == hi[start]:
                    near &= rep[left][:, None] < rep[right][None, :]
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                exact = np.einsum("ij,ij->i", a[i], b[j]) >= cosine
                i, j = left[i[exact]], right[j[exact]]
                i, j = np.where(rep[i] < rep[j], i, j), np.where(rep[i] < rep[j], j, i)
                if keys is None:
                    whole = rows.column("keys").combine_chunks().flatten().to_numpy()
                    keys = whole.reshape(rows.num_rows, hashing.tables, 1 + hashing.probes)
                here = rows.column("key")[int(start)].as_py()
                first = _first_cell(keys, i, j, here)
                i, j = i[first], j[first]
                # Rows of one vector may be in a group twice, at home and looking in.
                _, once = np.unique(np.stack([rep[i], rep[j]], 1), axis=0, return_index=True)
                i, j = i[once], j[once]
                out.append(_summed(rep[i], rep[j], copies[i], copies[j]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in zip(*out)], ["rep", "links", "b"]
                )

    spread = filed.select("rep", "copies", "size", "unit", "keys", F.posexplode("keys").alias("_at", "key"))
    slots = spread.withColumn("slot", F.col("_at") % (1 + hashing.probes)).drop("_at")
    dealt = in_blocks(slots, "key", "rep", block_rows)
    return dealt.select(
        "key", "rep", "copies", "size", "slot", "unit", "keys", "_own", "_lo", "_hi"
    ).mapInArrow(compare, "rep bigint, links bigint, b bigint")


def _first_cell(keys: np.ndarray, i: np.ndarray, j: np.ndarray, here: int) -> np.ndarray:
    """Whether ``here`` is the first cell in which the pairs meet.

    Cells are tried table by table; within one, the home of ``i`` comes before that
    of ``j``.
    """
    first = np.zeros(len(i), bool)
    settled = np.zeros(len(i), bool)
    for t in range(keys.shape[1]):
        for home, other in ((i, j), (j, i)):
            cell = keys[home, t, 0]
            meets = (keys[other, t] == cell[:, None]).any(axis=1) & ~settled
            first |= meets & (cell == here)
            settled |= meets
        if settled.all():
            break
    return first


def _summed(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray):
    """Links per vector, and for each the smallest vector of its connected patch."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    links = np.zeros(len(nodes), np.int64)
    np.add.at(links, x, nb)
    np.add.at(links, y, na)
    low = np.arange(len(nodes))
    while True:
        before = low.copy()
        np.minimum.at(low, x, low[y])
        np.minimum.at(low, y, low[x])
        low = low[low]
        if (low == before).all():
            return nodes, links, nodes[low]


def near_vectors(
    vectors: DataFrame,
    cosine: float = COSINE,
    hashing: Hashing = Hashing(),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``(vec_id, embedding)``.

    Linked are vectors whose cosine in double precision is ``cosine`` at least.
    Vectors that are null, zero, or hold null or non-finite components link with
    nothing, nor do vectors of different sizes with each other.  Rows with equal
    vectors are linked; rows that repeat an id are counted as one more vector each.
    A row with a null id has no links, no component, and is kept.  Other columns are
    ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    distinct = settle(usable(rows))
    met = settle(_meetings(_filed(distinct, hashing), hashing, cosine, block_rows))
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(met.select(F.col("rep").alias("a"), "b"))
    judged = (
        distinct.select("embedding", "rep", "copies")
        .join(links, "rep", "left")
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            F.col("embedding").alias("_e"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"),
            F.coalesce("component", "rep").alias("_component"),
        )
    )
    own = rows.withColumn("_e", F.when(F.col("vec_id").isNotNull(), F.col("embedding").cast("array<double>")))
    component = F.coalesce("_component", "vec_id")
    return own.join(judged, "_e", "left").select(
        "vec_id",
        F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
