"""Embedding near-duplicates by an exact metric range join.

Vectors of one label (and length) are scaled to length one; cosine c or more
is then Euclidean distance sqrt(2 - 2c) or less, a metric. A label with more
than ``block`` vectors gets pivots in proportion to its size, about one for
each ``block`` vectors: those with the smallest hashes. Every vector lives in
the cell of its nearest pivot, and one pass records how far the vectors of each
cell lie from its pivot. A vector can have a neighbour in another cell only if,
by the triangle inequality,

* its distance to that cell's pivot is within the radius of the cell's range,
* and it lies within the radius of the plane between the two pivots (vectors
  of the cell lie beyond it);

to such cells it is replicated. Each cell then finds all links of its own
vectors by itself. Which vectors are pivots decides the speed alone: the
join's result is exact for any. All labels together have at most ``pivots``
pivots; where they would need more, cells are larger than ``block``.

A cell with more than ``block`` vectors is dealt as pairs of blocks, so a hot
label or a hot spot spreads over tasks. Links leave a task as counts and as
stars of a spanning forest, never as all pairs.

Every row is a vector of its own, told apart by a row number that is written
with it. Defined results: vectors that are null or zero, or hold a null or
non-finite component, or whose label is null, link with nothing; vectors of
different lengths don't link; equal vectors link, also under one vec_id;
vectors without a vec_id are compared like others and name no component (one
of such vectors alone has component null); kept is whether vec_id and
component_id are equal, two nulls too; extra columns are ignored; an empty
table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components, forest
from .shared import bounded_batches, keep

COSINE = 0.98
PIVOTS = 1024
BLOCK = 2048
ROWS = 512
#: Vectors whose distances to all pivots are held at once.
CHUNK = 4096
#: Component roots that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors scaled to length one, whether each can be)."""
    x = x.astype(np.float64)
    with np.errstate(all="ignore"):
        top = np.abs(x).max(axis=1)
        x = x / top[:, None]  # no overflow or underflow in the norm
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
    return x, np.isfinite(top) & (top > 0)


def vectors(single: bool):
    """(row, grp, vector) of the usable vectors: their components as bytes, of single or double precision as given; grp names label and length."""

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[tuple, list] = {}
            for i, (label, v) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if label is not None and v and None not in v:
                    by.setdefault((label, len(v)), []).append((i, v))
            for (label, n), some in by.items():
                x = np.array([v for _, v in some], np.float32 if single else np.float64)
                _, ok = unit_rows(x)
                at = np.array([i for i, _ in some])[ok]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([f"{label}/{n}"] * len(at), pa.string()), pa.array([r.tobytes() for r in x[ok]], pa.binary())], names=["row", "grp", "vector"])

    return part


def rows_of(col: pa.Array, single: bool) -> np.ndarray:
    """Unit vectors of a column of bytes."""
    x = np.frombuffer(b"".join(col.to_pylist()), np.float32 if single else np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 1))
    return unit_rows(x)[0]


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ p.T), 0))


def by_group(batch: pa.RecordBatch, pivots: dict[str, np.ndarray], single: bool) -> Iterator[tuple[str, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(group, its rows, distances to its pivots, numbers of the nearest ones); a group without pivots has one cell."""
    names = np.array(batch.column(1).to_pylist())
    for g in np.unique(names).tolist():
        at = np.flatnonzero(names == g)
        for k in range(0, len(at), CHUNK):
            part = batch.take(pa.array(at[k : k + CHUNK]))
            p = pivots.get(g)
            d = distances(rows_of(part.column(2), single), p) if p is not None else np.zeros((len(part), 1))
            yield g, part, d, d.argmin(axis=1)


def ranges(pivots, single: bool):
    """(grp, cell, low, high, n): how far this task's vectors of a cell lie from its pivot."""

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for g, _, d, own in by_group(batch, pivots.value, single):
                here = d[np.arange(len(d)), own]
                for c in np.unique(own) if g in pivots.value else ():
                    e = here[own == c]
                    out.append((g, int(c), float(e.min()), float(e.max()), len(e)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names=["grp", "cell", "low", "high", "n"])

    return part


def deal(pivots, cells, radius: float, block: int, single: bool):
    """Rows (grp, cell, i, j, home, row, vector): every vector at its home and wherever a neighbour may live; i: block of homes, j: of members.

    cells: (low, high, n) for each cell of the groups with pivots; other groups have one cell, whose size is in their rows' last column.
    """

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = {g: distances(p, p) for g, p in pivots.value.items()}
        for batch in batches:
            for g, rows, d, own in by_group(batch, pivots.value, single):
                here = d[np.arange(len(d)), own]
                between = apart.get(g, np.zeros((1, 1)))
                salt = (rows.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                at, cell, i, j, home = [], [], [], [], []
                for c, (low, high, n) in (cells.value[g] if g in apart else {0: (0.0, 0.0, rows.column(3)[0].as_py())}).items():
                    near = (d[:, c] >= low - radius) & (d[:, c] <= high + radius) & (d[:, c] ** 2 - here**2 <= 2 * radius * between[own, c] + 1e-9)
                    k = max(1, -(-n // block))
                    mine = own == c
                    mb = (salt % np.uint64(k)).astype(np.int64)
                    for b in range(k):
                        members = np.flatnonzero((near | mine) & ~(mine & (mb == b)))  # as members of the pair (b, own block)
                        at.append(members)
                        i.append(np.full(len(members), b))
                        j.append(mb[members])
                        home.append(np.zeros(len(members), np.int8))
                        homes = np.flatnonzero(mine)
                        at.append(homes)
                        i.append(mb[homes])
                        j.append(np.full(len(homes), b))
                        home.append(np.where(mb[homes] == b, 2, 1).astype(np.int8))
                        cell.append(np.full(len(members) + len(homes), c))
                if at:
                    take = pa.array(np.concatenate(at))
                    n = len(take)
                    yield pa.RecordBatch.from_arrays([pa.array([g] * n, pa.string()), *(pa.array(np.concatenate(v).astype(np.int32)) for v in (cell, i, j, home)), rows.column(0).take(take), rows.column(2).take(take)], names=["grp", "cell", "i", "j", "home", "row", "vector"])

    return part


def link_cell(cosine: float, single: bool):
    """Counts of links of a block's home vectors among a block's members, and a spanning forest of the links."""

    def part(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        role = table.column("home").to_numpy()
        ids = table.column("row").to_numpy()
        x = rows_of(table.column("vector").combine_chunks(), single)
        h, m = np.flatnonzero(role >= 1), np.flatnonzero(role != 1)
        count = np.zeros(len(h), np.int64)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for s in range(0, len(h), ROWS):
            for t in range(0, len(m), ROWS):
                near = x[h[s : s + ROWS]] @ x[m[t : t + ROWS]].T >= cosine
                near &= ids[h[s : s + ROWS], None] != ids[None, m[t : t + ROWS]]
                count[s : s + ROWS] += near.sum(axis=1)
                p, q = np.nonzero(near)
                if len(p):
                    a, b = forest(np.append(a, ids[h[s + p]]), np.append(b, ids[m[t + q]]))
        h = h[count > 0]
        n = len(h)
        return pa.table({"row": pa.array(np.concatenate([ids[h], a]), pa.int64()), "n": pa.array(np.concatenate([count[count > 0], np.zeros(len(a), np.int64)])), "root": pa.array(np.concatenate([np.zeros(n, np.int64), b]), pa.int64(), mask=np.arange(n + len(a)) < n)})

    return part


def choose(usable: DataFrame, sizes: DataFrame, pivots: int, block: int, single: bool) -> dict[str, np.ndarray]:
    """Pivots of the largest groups: about one for each block vectors, pivots in all; those with the smallest hashes of their group."""
    large = sizes.filter(F.col("n") > block).orderBy(F.desc("n"), "grp").limit(pivots).collect()
    total = sum(-(-r.n // block) for r in large)
    want = {r.grp: max(2, int(-(-r.n // block) * min(1.0, pivots / total))) for r in large}
    if not want or pivots < 2:
        return {}
    # A hash below this share of all is expected to leave twice the number wanted, and eight more.
    share = usable.sparkSession.createDataFrame([(r.grp, min(1.0, (2 * want[r.grp] + 8) / r.n)) for r in large], "grp string, share double")
    place = (F.xxhash64("row", F.lit(7)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)).alias("place")
    rows = usable.join(F.broadcast(share), "grp").withColumn("place", place).filter("place <= share").select("grp", "place", "row", "vector").collect()
    chosen: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.place, r.row)):
        if len(chosen.setdefault(r.grp, [])) < want[r.grp]:
            chosen[r.grp].append(bytes(r.vector))
    return {g: rows_of(pa.array(v, pa.binary()), single) for g, v in chosen.items()}


def near_duplicates(spark: SparkSession, table: DataFrame, *, cosine: float = COSINE, pivots: int = PIVOTS, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    bounded_batches(spark)
    single = table.schema[vector_col].dataType == T.ArrayType(T.FloatType(), table.schema[vector_col].dataType.containsNull)
    numbered = keep(table.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v")), "vectors")
    ids = numbered.select("row", "vec_id")
    usable = keep(numbered.select("row", "label", "v").mapInArrow(vectors(single), "row long, grp string, vector binary"), "usable")
    sizes = keep(usable.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "sizes")
    points = spark.sparkContext.broadcast(choose(usable, sizes, pivots, block, single))
    found: dict[str, dict[int, tuple]] = {}
    if points.value:
        cells = usable.mapInArrow(ranges(points, single), "grp string, cell int, low double, high double, n long")
        for r in cells.groupBy("grp", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect():  # at most one row for each pivot
            found.setdefault(r.grp, {})[r.cell] = (r.low, r.high, r.n)
    cells = spark.sparkContext.broadcast(found)
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-7
    sized = usable.join(sizes.withColumnRenamed("n", "size"), "grp").select("row", "grp", "vector", "size")
    dealt = sized.mapInArrow(deal(points, cells, radius, block, single), "grp string, cell int, i int, j int, home int, row long, vector binary")
    linked = keep(dealt.groupBy("grp", "cell", "i", "j").applyInArrow(link_cell(cosine, single), "row long, n long, root long"), "vector-links")
    counts = linked.filter("root is null").groupBy("row").agg(F.sum("n").alias("n"))
    roots = components(linked.filter("root is not null").select("row", "root")).withColumnRenamed("node", "row")
    joined = keep(ids.join(counts, "row", "left").join(roots, "row", "left"), "linked")
    low = keep(joined.filter("root is not null").groupBy("root").agg(F.min("vec_id").alias("low")), "lowest")
    low = F.broadcast(low) if low.count() <= BROADCAST_ROWS else low.hint("shuffle_merge")
    component = F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("low"))
    return joined.join(low, "root", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
