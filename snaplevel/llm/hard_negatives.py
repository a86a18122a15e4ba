"""Hard negatives: rows of another label that score nearly as high as an anchor's best rows of its own label.

Vectors become whole numbers, floor(scale * x), and a score is the inner product of two of them. Before any
product is computed, pairs are judged by rotated one-bit codes. A vector's direction u is rotated, its code x is the
signs of the result, divided by sqrt(size) so that x is a unit vector, and its alignment a = <x, u> is stored beside it.
An anchor's rotated direction v is cut into bit planes, so that popcounts of planes and codes give b = <x, v>, up to a
bound that is known for each anchor. The parts of u and v across x have the lengths sqrt(1 - a^2) and
sqrt(1 - b^2), and by Cauchy-Schwarz

    a b - sqrt(1 - a^2) sqrt(1 - b^2) <= <u, v> <= a b + sqrt(1 - a^2) sqrt(1 - b^2).

No score lies outside its interval, whatever the data, so only rows whose interval can matter are scored, as whole numbers.

Rows are packed into blocks of bounded size. The anchors, a stated share of the rows, are dealt to the blocks in
packs; a pack and a block are one row for one task, which keeps a few rows for each anchor.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaplevel.llm.common import saved, small_batches

#: Components of a block's rows and of a pack's anchors, about; anchors that are compared with a block at a time.
BLOCK, PACK, STEP = 1 << 19, 1 << 17, 128
#: Bit planes of an anchor's direction; what rounding can move a cosine by, with room to spare.
PLANES, ROUNDING = 6, 1e-6
#: Squared length of the longest vector of whole numbers: 100 times a score fits into a long.
LONGEST = 1 << 56
#: Products up to this are exact as doubles.
EXACT = 1 << 53

_CODED = "row long, id long, label {label}, size int, anchor boolean, whole binary, code binary, align double, length double"


@functools.cache
def _signs(width: int) -> np.ndarray:
    return np.random.default_rng(12).choice(np.array([-1.0, 1.0]), (3, width))


def rotated(units: np.ndarray) -> np.ndarray:
    """The rows after a fixed rotation: thrice random signs and a Hadamard transform of a power of two."""
    width = 1 << max(0, units.shape[1] - 1).bit_length()
    out = np.zeros((len(units), width))
    out[:, : units.shape[1]] = units
    for signs in _signs(width):
        out *= signs
        step = 1
        while step < width:
            pairs = out.reshape(len(out), -1, 2, step)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), width)
            step *= 2
        out /= np.sqrt(width)
    return out


def _directions(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.sqrt((whole.astype(np.float64) ** 2).sum(axis=1))
    return whole / np.maximum(lengths, 1.0)[:, None], lengths


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit numbers."""
    short = -bits.shape[1] % 64
    padded = np.pad(bits, ((0, 0), (0, short)))
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def codes_of(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of vectors of whole numbers, their alignments and lengths."""
    units, lengths = _directions(whole)
    turned = rotated(units)
    align = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return _packed(turned > 0), align, lengths


def intervals(anchors: np.ndarray, codes: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Estimate, lower and upper bound of the cosine of every anchor with every coded row."""
    units, _ = _directions(anchors)
    turned = rotated(units)
    width = turned.shape[1]
    low, high = turned.min(axis=1, keepdims=True), turned.max(axis=1, keepdims=True)
    unit = np.maximum((high - low) / ((1 << PLANES) - 1), 1e-300)
    levels = np.rint((turned - low) / unit).astype(np.uint8)
    # Signs times levels, summed: twice the levels where a bit is set, less all levels.
    agree = np.zeros((len(anchors), len(codes)), np.int64)
    for plane in range(PLANES):
        bits = _packed((levels >> plane) & 1 > 0)
        for word in range(codes.shape[1]):
            agree += np.bitwise_count(bits[:, None, word] & codes[None, :, word]).astype(np.int64) << plane
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    sums = low * (2 * ones - width)[None, :] + unit * (2 * agree - levels.sum(axis=1, dtype=np.int64)[:, None])
    b = sums / np.sqrt(width)
    slack = np.abs(turned - (low + unit * levels)).sum(axis=1, keepdims=True) / np.sqrt(width) + ROUNDING
    across = np.sqrt(np.maximum(0, 1 - align * align))[None, :]

    def edge(x: np.ndarray, sign: int) -> np.ndarray:
        x = np.clip(x, -1, 1)
        return align * x + sign * across * np.sqrt(1 - x * x)

    # On either side of b = a (the upper bound) and b = -a (the lower one) the bounds are monotonous in b.
    first, last = b - slack, b + slack
    upper = np.where((first <= align) & (align <= last), 1.0, np.maximum(edge(first, 1), edge(last, 1)))
    lower = np.where((first <= -align) & (-align <= last), -1.0, np.minimum(edge(first, -1), edge(last, -1)))
    return align * b, lower - ROUNDING, upper + ROUNDING


def _scores(anchors: np.ndarray, rows: np.ndarray, wanted: np.ndarray, most: float) -> np.ndarray:
    """Integer inner products where wanted; elsewhere 0."""
    out = np.zeros(wanted.shape, np.int64)
    exact = np.float64 if most < EXACT else np.int64
    some, columns = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    if len(some) and wanted.sum() * 16 >= len(some) * len(columns):
        full = anchors[some].astype(exact) @ rows[columns].astype(exact).T
        out[np.ix_(some, columns)] = full
        out[~wanted] = 0
        return out
    for i in some:
        at = np.flatnonzero(wanted[i])
        out[i, at] = rows[at].astype(exact) @ anchors[i].astype(exact)
    return out


class _Block:
    """The rows of one block, or the anchors of one pack, as arrays."""

    def __init__(self, rows: pa.StructArray):
        self.row = rows.field("row").to_numpy()
        ids = rows.field("id")
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.id = ids.fill_null(0).to_numpy()
        self.label = rows.field("label")
        self.whole = _binary(rows.field("whole"), np.int32).reshape(len(rows), -1)
        self.code = _binary(rows.field("code"), np.uint64).reshape(len(rows), -1)
        self.align = rows.field("align").to_numpy()
        self.length = rows.field("length").to_numpy()
        self.rank = np.empty(len(rows), np.int64)
        self.rank[np.lexsort((self.row, self.id, self.null))] = np.arange(len(rows))


def _binary(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _bounds(anchors: _Block, part: slice, rows: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Estimate, lower and upper bound of the scores."""
    estimate, lower, upper = intervals(anchors.whole[part], rows.code, rows.align)
    scale = anchors.length[part][:, None] * rows.length[None, :]
    room = scale * ROUNDING
    return estimate * scale, lower * scale - room, upper * scale + room


def _first(who: np.ndarray, what: np.ndarray, score: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """Which of the entries are the first n of their `who`, by descending score, then rank."""
    order = np.lexsort((rank[what], -score, who))
    sorted_who = who[order]
    start = np.searchsorted(sorted_who, sorted_who, "left")
    return order[np.arange(len(order)) - start < n]


def best(anchors: _Block, rows: _Block, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each anchor the n best other rows of the block: positions of anchor and row, score."""
    top = float(anchors.length.max() * rows.length.max())
    for start in range(0, len(anchors.row), STEP):
        part = slice(start, start + STEP)
        estimate, lower, upper = _bounds(anchors, part, rows)
        other = anchors.row[part][:, None] != rows.row[None, :]
        estimate[~other] = lower[~other] = -np.inf
        k = min(n, estimate.shape[1])
        seeds = np.zeros(other.shape, bool)
        np.put_along_axis(seeds, np.argpartition(-estimate, k - 1, axis=1)[:, :k], True, axis=1)
        seeds &= other
        known = _scores(anchors.whole[part], rows.whole, seeds, top)
        # n rows reach the least score of the seeds, and n rows the n-th lower bound.
        full = seeds.sum(axis=1) == n
        least = np.where(full, np.where(seeds, known, np.iinfo(np.int64).max).min(axis=1).astype(float), -np.inf)
        least = np.maximum(least, np.where(full, -np.partition(-lower, k - 1, axis=1)[:, k - 1], -np.inf))
        wanted = other & (upper >= least[:, None])
        score = _scores(anchors.whole[part], rows.whole, wanted, top)
        i, j = np.nonzero(wanted)
        found = _first(i, j, score[i, j], rows.rank, n)
        yield i[found] + start, j[found], score[i[found], j[found]]


def banded(
    anchors: _Block, positives: list[np.ndarray], rows: _Block, n: int, band: tuple[int, int, int]
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each anchor and distinct positive score the n best rows of another label within its band.

    Yields positions of anchors and rows, the positive score and the row's score.
    """
    low, high, of = band
    top = float(anchors.length.max() * rows.length.max())
    kinds = pa.concat_arrays([anchors.label, rows.label]).dictionary_encode().indices.to_numpy()
    mine, theirs = kinds[: len(anchors.row)], kinds[len(anchors.row) :]
    widest = max((len(p) for p in positives), default=0)
    table = np.full((len(positives), widest), np.iinfo(np.int64).min)
    for k, p in enumerate(positives):
        table[k, : len(p)] = p
    for start in range(0, len(anchors.row), STEP):
        part = slice(start, start + STEP)
        _, lower, upper = _bounds(anchors, part, rows)
        given = table[part]
        there = given > np.iinfo(np.int64).min
        # The bands of an anchor lie between the least low end and the highest high end.
        least = np.where(there, low * given.astype(float) / of, np.inf).min(axis=1)
        most = np.where(there, high * given.astype(float) / of, -np.inf).max(axis=1)
        slack = 1 + 1e-9 * np.abs(np.where(there, given, 0)).max(axis=1)
        wanted = (mine[part][:, None] != theirs[None, :]) & (upper >= (least - slack)[:, None]) & (lower <= (most + slack)[:, None])
        score = _scores(anchors.whole[part], rows.whole, wanted, top)
        for column in range(widest):
            p = given[:, column]
            inside = np.flatnonzero(there[:, column])
            s = score[inside]
            ends = p[inside][:, None]
            i, j = np.nonzero(wanted[inside] & (low * ends <= of * s) & (of * s <= high * ends))
            if len(i):
                i = inside[i]
                found = _first(i, j, score[i, j], rows.rank, n)
                yield i[found] + start, j[found], p[i[found]], score[i[found], j[found]]


def _coded(scale: float):
    names = ["row", "id", "label", "size", "anchor", "whole", "code", "align", "length"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["size"].to_numpy()
            for size in np.unique(sizes):
                some = batch.filter(pa.array(sizes == size))
                flat = some["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                with np.errstate(over="ignore"):
                    whole = np.floor(scale * flat).reshape(some.num_rows, int(size))
                    squares = (whole * whole).sum(axis=1)
                fit = squares < LONGEST
                some, whole = some.filter(pa.array(fit)), whole[fit].astype(np.int32)
                # At least one component, so that empty vectors have codes too.
                whole = np.ascontiguousarray(whole if size else np.zeros((len(whole), 1), np.int32))
                codes, align, lengths = codes_of(whole)
                blobs = [pa.array([x.tobytes() for x in y], pa.binary()) for y in (whole, codes)]
                given = [some[c] for c in names[:5]]
                yield pa.RecordBatch.from_arrays([*given, *blobs, pa.array(align), pa.array(lengths)], names)

    return code


def _for_each(function):
    """A task that calls a function for every pair of a pack and a block; a block that comes again is unpacked once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch["block"][k].as_py()
                if block != last:
                    last, rows = block, _Block(batch["rows"][k].values)
                yield from function(batch["anchors"][k].values, rows)

    return run


_ROW = ("row", "id", "label", "whole", "code", "align", "length")


def _counts(rows: DataFrame, place: list[str], most: int) -> DataFrame:
    """The number of blocks of every place, so that each has about `most` components."""
    blocks = F.ceil(F.count("*") * F.greatest(F.first("size"), F.lit(1)) / most).cast("int")
    return rows.groupBy(*place).agg(blocks.alias("blocks"))


def _blocks(rows: DataFrame, counts: DataFrame, place: list[str], seed: int, name: str, columns: tuple[str, ...] = _ROW) -> DataFrame:
    """The rows of every block in one column."""
    number = F.pmod(F.xxhash64("row", F.lit(seed)), "blocks").cast("int")
    dealt = rows.join(counts, place).withColumn("number", number)
    return dealt.groupBy(*place, "number").agg(F.collect_list(F.struct(*columns)).alias(name))


def _paired(packs: DataFrame, blocks: DataFrame, counts: DataFrame, place: list[str]) -> DataFrame:
    """Every pack beside every block of its place, dealt out by block."""
    each = packs.drop("number").join(counts, place)
    each = each.withColumn("number", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    key = F.struct(*place, "number").cast("string").alias("block")
    return blocks.join(each, [*place, "number"]).select(key, "anchors", "rows")


def mine(
    vectors: DataFrame,
    anchor: Column,
    *,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 5,
    band: tuple[int, int, int] = (80, 100, 100),
) -> DataFrame:
    """Rows anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x), scores are whole inner products, and higher scores come first, ties by the
    smaller id, null last. Rows for which `anchor` (a condition on the columns of `vectors`) holds are anchors. An anchor's
    positives are its first `positives` other rows of its label. For each anchor and positive the first `negatives` rows of other
    labels are returned whose score lies in the band: low * positive_score <= of * negative_score <= high *
    positive_score, band being (low, high, of). Ranks count from 1; ids are longs.

    Rows with a null label or vector, or with null or non-finite components, take no part; nor do vectors of a length (after
    scaling) of 2^28 or more, with which 100 times a score would not fit into a long. Only vectors of one size are compared. Repeated
    rows are rows of their own: as anchors each has its rows, and each is a positive or negative of the others. An anchor without
    positives, or without rows in a band, has no rows there. Other columns are ignored; an empty table gives no rows.
    """
    small_batches(vectors.sparkSession)
    vector, label = vectors[vector_column], vectors[label_column]
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.filter(label.isNotNull() & vector.isNotNull() & ~odd).select(
        F.monotonically_increasing_id().alias("row"),
        vectors[id_column].cast("long").alias("id"),
        label.alias("label"),
        F.size(vector).alias("size"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        vector.cast("array<double>").alias("vector"),
    )
    kind = rows.schema["label"].dataType.simpleString()
    coded = saved(rows.mapInArrow(_coded(scale), _CODED.format(label=kind)), "vector-codes")
    anchors = coded.filter("anchor")

    by_label = ["size", "label"]
    packs = _blocks(anchors, _counts(anchors, by_label, PACK), by_label, 1, "anchors")
    counts = _counts(coded, by_label, BLOCK)
    blocks = _blocks(coded, counts, by_label, 2, "rows")

    def find_best(pack, block):
        pack = _Block(pack)
        for i, j, score in best(pack, block, positives):
            ids = pa.array(block.id[j], pa.int64(), mask=block.null[j])
            columns = [pa.array(pack.row[i]), pa.array(block.row[j]), ids, pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["anchor_row", "row", "id", "score"])

    pairs = _paired(packs, blocks, counts, by_label)
    found = pairs.mapInArrow(_for_each(find_best), "anchor_row long, row long, id long, score long")
    best_first = [F.col("score").desc(), F.col("id").asc_nulls_last(), "row"]
    order = Window.partitionBy("anchor_row").orderBy(*best_first)
    found = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    found = saved(found, "anchor-positives")

    # An anchor's bands: of each positive score once.
    scores = found.groupBy(F.col("anchor_row").alias("row")).agg(F.array_sort(F.collect_set("score")).alias("scores"))
    wanted = anchors.join(scores, "row")
    packs = _blocks(wanted, _counts(wanted, ["size"], PACK), ["size"], 3, "anchors", (*_ROW, "scores"))
    counts = _counts(coded, ["size"], BLOCK)
    blocks = _blocks(coded, counts, ["size"], 4, "rows")

    def find_banded(pack, block):
        scores = [np.array(x, np.int64) for x in pack.field("scores").to_pylist()]
        pack = _Block(pack)
        for i, j, given, score in banded(pack, scores, block, negatives, band):
            ids = pa.array(block.id[j], pa.int64(), mask=block.null[j])
            columns = [pa.array(pack.row[i]), pa.array(given), pa.array(block.row[j]), ids, pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["anchor_row", "positive_score", "row", "id", "score"])

    near = _paired(packs, blocks, counts, ["size"]).mapInArrow(
        _for_each(find_banded), "anchor_row long, positive_score long, row long, id long, score long"
    )
    order = Window.partitionBy("anchor_row", "positive_score").orderBy(*best_first)
    near = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    near = near.select("anchor_row", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))

    found = found.select("anchor_row", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(near, ["anchor_row", "positive_score"])
    out = out.join(anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
