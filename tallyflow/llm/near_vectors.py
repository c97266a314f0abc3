"""Near-duplicate embeddings: tiles of vectors in principal axes, compared leading dimensions first.

Equal vectors are one class. The principal axes come from sums over all classes; a vector is turned into them
(a rotation, so cosines stay) with the axes of most variance first. Vectors with a cosine of at least ``t`` are no
farther apart than ``sqrt(2 - 2 t)`` in any axis, so cells of that width on the first axes need comparing with
their neighbours only. A cell's vectors form tiles of bounded size, and a pair of tiles is one row: the products
over the leading dimensions are accumulated first, what is left of a product is bounded by the norms of what is
left of the two vectors, and only pairs that can still reach the threshold go on to the next dimensions.
Those that come through are decided by the cosine of the vectors as given, in double precision.

A pair of tiles yields, for each class, how many vectors it links with, and as many links as keep the linked
together, never all pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyflow.llm.common import stage
from tallyflow.llm.components import components
from tallyflow.session import shuffle_width

#: Vectors of a tile, dimensions accumulated at a time, axes on which cells are laid.
TILE, BLOCK, AXES = 1024, 16, 4
SALTS = 4
SLACK = 1e-9
#: Share of a tile's pairs from which the remaining dimensions are multiplied for all of them at once.
DENSE = 0.05


def classes_of(vectors: DataFrame) -> DataFrame:
    """``cls, dim, values, n, first_id``: the distinct usable vectors, staged with a number."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("values"))
    usable = v.where(
        F.col("values").isNotNull()
        & F.coalesce(F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)), F.lit(False))
        & F.exists("values", lambda x: x != 0)
    )
    # Adding zero makes -0.0 and 0.0 one value.
    grouped = usable.groupBy(F.transform("values", lambda x: x + F.lit(0.0)).alias("values")).agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id")
    )
    return stage(grouped.withColumn("cls", F.monotonically_increasing_id()).withColumn("dim", F.size("values")), "vectors")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares may overflow or vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def axes_of(classes: DataFrame, dim: int) -> np.ndarray:
    """The principal axes of all unit vectors of one length, as columns, most variance first.

    Tasks send sums of products, ``dim`` rows each; what reaches the driver has ``dim * dim`` numbers.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                y = _unit(_matrix(batch.column(0), dim))
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "sums"])

    parts = classes.select("values").mapInArrow(products, "i int, sums array<double>")
    summed = parts.select("i", F.posexplode("sums").alias("j", "s")).groupBy("i", "j").agg(F.sum("s").alias("s"))
    total = np.zeros((dim, dim))
    for row in summed.collect():
        total[row.i, row.j] = row.s
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1]


def linked_in_tiles(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of unit vectors with a cosine of at least ``threshold``."""
    dim, low = a.shape[1], threshold - SLACK
    x, y = a @ axes, b @ axes
    k = min(BLOCK, dim)
    products = x[:, :k] @ y[:, :k].T
    rest = np.linalg.norm(x[:, k:], axis=1), np.linalg.norm(y[:, k:], axis=1)
    i, j = np.nonzero(products >= low - np.outer(*rest))
    if len(i) > DENSE * products.size:
        i, j = np.nonzero(a @ b.T >= low)
    else:
        reached = products[i, j]
        while k < dim and len(i):
            to = min(k + BLOCK, dim)
            reached = reached + np.einsum("ij,ij->i", x[i, k:to], y[j, k:to])
            k = to
            rest = np.linalg.norm(x[:, k:], axis=1), np.linalg.norm(y[:, k:], axis=1)
            keep = reached + rest[0][i] * rest[1][j] >= low
            i, j, reached = i[keep], j[keep], reached[keep]
    keep = np.empty(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        keep[s] = np.einsum("ij,ij->i", a[i[s]], b[j[s]]) >= threshold
    return i[keep], j[keep]


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For nodes ``0..n-1`` and links (i, j): the smallest node that each is linked with over these."""
    label = np.arange(n)
    while len(i):
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def near_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id``, ``embedding``).

    ``n_links`` counts the other rows whose cosine reaches ``threshold``; ``component_id`` is the smallest id
    reachable over links. Vectors that are null, empty, zero or hold a null or non-finite value link with
    nothing, and vectors of different lengths do not link. Repeated rows are rows of their own and link with
    each other. A row with a null id takes part, but ids of components are never null unless all their
    rows' ids are. Extra columns are left behind; an empty table gives an empty result.
    """
    width = shuffle_width(vectors.sparkSession)
    classes = classes_of(vectors)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    counts, links = [], []
    for (dim,) in sorted(classes.select("dim").distinct().collect()):
        of_dim = classes.where(F.col("dim") == dim)
        axes = axes_of(of_dim, dim)
        found = stage(_compared(of_dim, axes, dim, reach, threshold, width), f"compared-{dim}")
        counts.append(found.where("n_links is not null").select("cls", "n_links"))
        links.append(found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    if not counts:
        zero = F.lit(0).cast("bigint")
        return vectors.select("vec_id", zero.alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    all_counts, all_links = counts[0], links[0]
    for c, k in zip(counts[1:], links[1:], strict=True):
        all_counts, all_links = all_counts.union(c), all_links.union(k)
    root = components(all_links)
    degree = all_counts.groupBy("cls").agg(F.sum("n_links").alias("n_links"))
    placed = (
        classes.join(degree, "cls", "left")
        .join(root.withColumnRenamed("node", "cls"), "cls", "left")
        .select("cls", "values", "n", "first_id", "n_links", F.coalesce("root", "cls").alias("root"))
    )
    ids = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = placed.join(ids, "root").select(
        "values", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    rows = vectors.select(
        "vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("values")
    )
    return rows.join(known, "values", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.when(F.col("n_links").isNull(), F.col("vec_id").isNotNull()).otherwise(F.col("vec_id") == F.col("component_id")), F.lit(False)).alias("kept"),
    )


def _compared(classes: DataFrame, axes: np.ndarray, dim: int, reach: float, threshold: float, width: int) -> DataFrame:
    """``cls, n_links, other``: partial counts of linked rows of other classes, and links."""
    first = min(AXES, dim)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.floor(_unit(_matrix(batch.column("values"), dim)) @ axes[:, :first] / reach).astype(np.int64)
                cell = pa.array(at.tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("n"), batch.column("values"), cell], names=["cls", "n", "values", "cell"])

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell: cut each cell's run into tiles."""
        held: list[pa.RecordBatch] = []
        schema = pa.schema([("cell", pa.list_(pa.int64())), ("tile", pa.int64()), ("cls", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("vectors", pa.binary())])

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                values = t.column("values").combine_chunks()
                ids = t.column("cls").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t.column("cell")[0].as_py()], pa.list_(pa.int64())), pa.array([ids[0]], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                     pa.array([t.column("n").to_pylist()], pa.list_(pa.int64())), pa.array([_matrix(values, dim).tobytes()], pa.binary())],
                    schema=schema,
                )
                held.clear()

        cell, n = None, 0
        for batch in batches:
            cells = batch.column("cell").to_pylist()
            starts = [k for k in range(len(cells)) if k == 0 or cells[k] != cells[k - 1]] + [len(cells)]
            for at, end in zip(starts, starts[1:], strict=False):
                if cells[at] != cell:
                    yield from flush()
                    cell, n = cells[at], 0
                while at < end:
                    take = min(end - at, TILE - n)
                    held.append(batch.slice(at, take))
                    at, n = at + take, n + take
                    if n == TILE:
                        yield from flush()
                        n = 0
        yield from flush()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                pick = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
                ca, cb, na, nb = (np.array(pick(c), np.int64) for c in ("cls", "cls_b", "n", "n_b"))
                a, b = (_unit(np.frombuffer(pick(c), np.float64).reshape(-1, dim)) for c in ("vectors", "vectors_b"))
                i, j = linked_in_tiles(a, b, axes, threshold)
                same = ca[0] == cb[0]
                if same:
                    i, j = i[i != j], j[i != j]
                    ids, weight = ca, np.bincount(i, nb[j], len(ca))
                    label = spanning(i, j, len(ca))
                else:
                    ids = np.concatenate([ca, cb])
                    weight = np.concatenate([np.bincount(i, nb[j], len(ca)), np.bincount(j, na[i], len(cb))])
                    label = spanning(i, j + len(ca), len(ids))
                hit, tied = np.nonzero(weight)[0], np.nonzero(label != np.arange(len(ids)))[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids[hit], ids[tied]])),
                     pa.array(np.concatenate([weight[hit], weight[tied]]).astype(np.int64), mask=np.arange(len(hit) + len(tied)) >= len(hit)),
                     pa.array(np.concatenate([ids[hit], ids[label[tied]]]), mask=np.arange(len(hit) + len(tied)) < len(hit))],
                    names=["cls", "n_links", "other"],
                )

    cells = classes.select("cls", "n", "values").mapInArrow(place, "cls long, n long, values array<double>, cell array<long>")
    # Salted by class, so that a cell with a third of all vectors is cut into tiles by several tasks.
    dealt = cells.repartition(width, "cell", F.pmod("cls", F.lit(SALTS)))
    tiles = stage(
        dealt.sortWithinPartitions("cell", "cls").mapInArrow(tile, "cell array<long>, tile long, cls array<long>, n array<long>, vectors binary"),
        "tiles",
    )
    names = tiles.select("cell").distinct()
    steps = F.array(*[F.array(*[F.lit(int(d) - 1).cast("bigint") for d in step]) for step in np.ndindex(*(3,) * first)])
    moves = F.transform(steps, lambda step: F.zip_with("cell", step, lambda x, d: x + d))
    near = names.select("cell", F.explode(moves).alias("cell_b")).where("cell <= cell_b")
    near = near.join(names.withColumnRenamed("cell", "cell_b"), "cell_b")
    left = tiles.join(near, "cell")
    right = tiles.select(*[F.col(c).alias(f"{c}_b") for c in tiles.columns]).join(near, "cell_b")
    pairs = left.join(right, ["cell", "cell_b"]).where("cell <> cell_b or tile <= tile_b")
    return pairs.select("cls", "n", "vectors", "cls_b", "n_b", "vectors_b").mapInArrow(compare, "cls long, n_links long, other long")
