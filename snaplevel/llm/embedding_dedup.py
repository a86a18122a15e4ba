"""Near duplicates among embeddings: cosines of vectors with equal labels, by PCA-ordered tiles.

Unit vectors are turned to their principal axes. Two of them whose cosine reaches t differ by at most
sqrt(2 - 2 t) in any coordinate, so only cells of that width that touch in the first axes are compared. A
cell is dealt out to tiles of bounded size, and each pair of tiles is one row for one task: products
accumulate over the leading axes first, what the rest can add is bounded by the norms of the suffixes, and a
tile, or those of its rows that still can reach t, goes on only while the bound allows.

Equal vectors are one class before anything is compared, so copies cost nothing. Links are counted for every
class; of the pairs themselves only as many leave a task as connect what they connect.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplevel.llm.common import saved
from snaplevel.llm.components import components

#: Classes of a tile; axes that make up the cells; axes added at a time.
TILE, CELL_AXES, STEP = 1024, 2, 8
#: Products this close to the threshold are computed anew from the vectors as given.
CLOSE = 1e-9


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of very large or small components stay finite.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _products(size: int):
    """The sums of products of components over a task's unit vectors, one row for each component."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            unit = _unit(_matrix(batch["vector"], size))
            total += unit.T @ unit
        at = pa.array(np.repeat(np.arange(size), size), pa.int32()), pa.array(np.tile(np.arange(size), size), pa.int32())
        yield pa.RecordBatch.from_arrays([*at, pa.array(total.ravel())], ["i", "j", "sum"])

    return products


def principal_axes(classes: DataFrame, size: int) -> np.ndarray:
    """The axes of all unit vectors of one size, as columns, by descending variance."""
    cells = classes.filter(F.col("size") == size).select("vector").mapInArrow(_products(size), "i int, j int, sum double")
    sums = cells.groupBy("i", "j").agg(F.sum("sum").alias("sum")).collect()  # size * size rows
    matrix = np.zeros((size, size))
    for row in sums:
        matrix[row["i"], row["j"]] = row["sum"]
    _, axes = np.linalg.eigh((matrix + matrix.T) / 2)
    return np.ascontiguousarray(axes[:, ::-1])


def _cells(axes: dict[int, np.ndarray], width: float):
    names = ["id", "label", "size", "cell"]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros((batch.num_rows, CELL_AXES), np.int32)
            sizes = batch["size"].to_numpy()
            for size in np.unique(sizes):
                mine = sizes == size
                unit = _unit(_matrix(batch["vector"].filter(pa.array(mine)), int(size)))
                lead = unit @ axes[size][:, :CELL_AXES] if size in axes else unit[:, :CELL_AXES]
                cell[mine, : lead.shape[1]] = np.floor(lead / width)
            ends = pa.array(np.arange(0, cell.size + 1, CELL_AXES, dtype=np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(cell.ravel()))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], batch["size"], lists], names)

    return cells


def linked(one: np.ndarray, two: np.ndarray, axes: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of both matrices whose cosine reaches the threshold."""
    a, b = _unit(one), _unit(two)
    if axes is not None:
        a, b = a @ axes, b @ axes
    size = a.shape[1]
    rows, columns = np.arange(len(a)), np.arange(len(b))
    total = np.zeros((len(a), len(b)))
    for start in range(0, size, STEP):
        stop = min(size, start + STEP)
        total += a[rows, start:stop] @ b[columns, start:stop].T
        if stop < size:
            rest = np.linalg.norm(a[rows, stop:], axis=1)[:, None] * np.linalg.norm(b[columns, stop:], axis=1)[None, :]
            can = total + rest >= threshold - CLOSE
            i, j = can.any(axis=1), can.any(axis=0)
            if not i.any():
                return rows[:0], columns[:0]
            total, rows, columns = total[np.ix_(i, j)], rows[i], columns[j]
    i, j = np.nonzero(total >= threshold - CLOSE)
    sure = total[i, j] > threshold + CLOSE
    i, j = rows[i], columns[j]
    for k in np.flatnonzero(~sure):
        x, y = one[i[k]], two[j[k]]
        sure[k] = x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold
    return i[sure], j[sure]


def _compare(axes, threshold: float):
    """Rows (a, n): links of class a in this pair of tiles, copies counted; rows (a, b): links that connect."""
    names = ["a", "b", "n"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                size, same = batch["size"][k].as_py(), batch["same"][k].as_py()
                sides = []
                for name in ("one", "two"):
                    tile = batch[name][k].values
                    ids, copies = tile.field("id").to_numpy(), tile.field("copies").to_numpy()
                    sides.append((ids, copies, _matrix(tile.field("vector"), size)))
                (ids, copies, one), (more_ids, more_copies, two) = sides
                i, j = linked(one, two, axes.value.get(size), threshold)
                if same:
                    i, j = i[i < j], j[i < j]
                counts = np.bincount(i, more_copies[j], len(ids)), np.bincount(j, copies[i], len(more_ids))
                for who, n in zip((ids, more_ids), counts, strict=True):
                    some = n > 0
                    no = pa.nulls(int(some.sum()), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(who[some]), no, pa.array(n[some].astype(np.int64))], names)
                a, b = spanning(ids[i], more_ids[j])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64())], names)

    return compare


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Of links those that first connect two parts."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (above := root.get(x, x)) != x:
            root[x] = root.get(above, above)
            x = above
        return x

    left, right = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[p] = q
            left.append(x)
            right.append(y)
    return left, right


def near_duplicates(
    vectors: DataFrame,
    *,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    threshold: float = 0.98,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal label and length are linked if their cosine, in double precision, is at least the
    threshold (0 < threshold <= 1). n_links counts the other vectors linked directly; component_id is the
    smallest id that links reach, null aside; kept says whether it is the vector's own.

    Rows with a null label, and vectors that are null, empty, zero or hold null or non-finite components,
    link with nothing. Repeated rows are vectors of their own, linked with each other. A null id links like
    any other and is kept only without links. Other columns are ignored; an empty table gives no rows.
    """
    vector, label = vectors[vector_column], vectors[label_column]
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    zero = F.forall(vector, lambda x: x == 0)
    good = F.coalesce(label.isNotNull() & ~odd & ~zero, F.lit(False))
    key = F.when(good, F.xxhash64(label, vector))
    rows = vectors.select(vectors[id_column].cast("long").alias("vec_id"), key.alias("id"), label.alias("label"), vector.alias("vector"))
    classes = rows.filter("id is not null").groupBy("id").agg(
        F.first("label").alias("label"),
        F.first("vector").alias("vector"),
        F.count("*").alias("copies"),
        F.min("vec_id").alias("least"),
    )
    classes = saved(classes.withColumn("size", F.size("vector")), "vector-classes")

    sizes = classes.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).collect()
    axes = {r["size"]: principal_axes(classes, r["size"]) for r in sizes}
    width = math.sqrt(2 - 2 * threshold) + 1e-6
    label_type = dict(classes.dtypes)["label"]
    cells = classes.select("id", "label", "size", "vector").mapInArrow(
        _cells(axes, width), f"id long, label {label_type}, size int, cell array<int>"
    )
    cells = saved(cells, "vector-cells")
    place = ["label", "size", "cell"]
    counts = cells.groupBy(*place).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = cells.join(counts, place).withColumn("number", F.pmod(F.xxhash64("id", F.lit(1)), "tiles"))
    packed = dealt.join(classes.select("id", "copies", "vector"), "id").groupBy(*place, "number")
    packed = packed.agg(F.collect_list(F.struct("id", "copies", "vector")).alias("classes"))
    packed = saved(packed.withColumn("tile", F.xxhash64(*place, "number")), "vector-tiles")

    around = [F.array(*(F.lit(d) for d in (-1, 0, 1)))] * CELL_AXES
    steps = F.transform(around[0], lambda x: F.transform(around[1], lambda y: F.array(x, y)))
    one = packed.select("label", "size", "cell", F.col("tile").alias("t"))
    step = one.select("label", "size", "t", "cell", F.explode(F.flatten(steps)).alias("step"))
    near = F.zip_with("cell", "step", lambda x, y: x + y)
    step = step.select("label", "size", "t", near.alias("cell"))
    two = packed.select("label", "size", "cell", F.col("tile").alias("u"))
    pairs = step.join(two, place).filter("t <= u").select("size", "t", "u")
    pairs = pairs.join(packed.select(F.col("tile").alias("t"), F.col("classes").alias("one")), "t")
    pairs = pairs.join(packed.select(F.col("tile").alias("u"), F.col("classes").alias("two")), "u")
    pairs = pairs.select("size", (F.col("t") == F.col("u")).alias("same"), "one", "two")
    shared = vectors.sparkSession.sparkContext.broadcast(axes)
    found = saved(pairs.mapInArrow(_compare(shared, threshold), "a long, b long, n long"), "vector-links")

    n_links = found.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("b is not null").select("a", "b"))
    classes = classes.select("id", "copies", "least").join(n_links, "id", "left")
    classes = classes.join(roots, classes["id"] == roots["node"], "left").drop("node")
    classes = classes.withColumn("root", F.coalesce("root", "id"))
    least = classes.groupBy("root").agg(F.min("least").alias("component"))
    classes = classes.join(least, "root").select("id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "component")
    out = rows.select("vec_id", "id").join(classes, "id", "left")
    component = F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
