"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, repeated up to `epochs` times. A queued
document finishes at the virtual time `words of its source so far / weight of the source`. Sorting all
queued documents by that time and cutting the order where the budget is used up serves each source in
proportion to its weight; sources that run out leave their share to the others.

Only DataFrame functions are used. No step holds a whole source: the running sums are taken over ranges of the
shuffle order of the sources, and the global order is cut into range partitions, so a source with a third of
all rows is spread like any other. So is an id with a third of them: ranges are cut within a place too, by id,
size and text, and rows equal in all of these are one row with a count there. The windows over all sources or
ranges have one row for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snaplevel.llm.common import saved, shuffle_partitions, text_key, word_count

#: Rows of one range of the shuffle order, about, where there are more than partitions; of equal rows dealt out together.
ROWS_PER_RANGE, EQUAL_ROWS = 20_000, 1_000
CYCLE = (1.0, 2.0, 3.0)


def queued(docs: DataFrame, id_column: str, text_column: str, source_column: str, seed: str) -> DataFrame:
    """Narrow rows: id, source, size in words, place in the shuffle (60 bits) and a key of the row."""
    ident, text = docs[id_column], docs[text_column]
    digest = F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return docs.select(
        ident.alias("doc_id"),
        docs[source_column].alias("source"),
        word_count(text).alias("size"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("place"),
        text_key(ident, text).alias("key"),
    )


def source_targets(rows: DataFrame, weights: DataFrame | None, epochs: int) -> DataFrame:
    """One row per source: rank, source_size, weight, target and the share level that all reach.

    The budget is the size of all rows. Each target is weight * level, but at most epochs * source_size;
    level is where the targets add up to the budget.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("rank", F.row_number().over(by_name))
    if weights is None:
        cycle = F.array(*map(F.lit, CYCLE))
        sources = sources.withColumn("weight", cycle[(F.col("rank") - 1) % len(CYCLE)])
    else:
        given = weights.select(F.col("source").alias("given"), F.col("weight").cast("double").alias("weight"))
        sources = sources.join(given, F.col("source").eqNullSafe(F.col("given")), "left").drop("given")
        sources = sources.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    cap = F.col("source_size") * epochs
    full_at = F.when(F.col("weight") > 0, cap / F.col("weight")).otherwise(F.lit(0.0))
    sources = sources.withColumn("cap", F.when(F.col("weight") > 0, cap).otherwise(F.lit(0)))
    sources = sources.withColumn("full_at", full_at)
    every = Window.orderBy("full_at", "rank")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    rest = every.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    budget = F.sum("source_size").over(whole)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    sources = sources.withColumn("level", F.when(F.sum("weight").over(rest) > 0, level))
    reached = F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "rank", "level"))).over(whole)
    level = F.coalesce(reached["level"], F.max("full_at").over(whole))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("reached"))
    return sources.withColumn("reached", level).withColumn("target", target)


ORDER = ["place", "doc_id", "size", "key"]


def in_ranges(rows: DataFrame, sources: DataFrame, n_rows: int) -> DataFrame:
    """Equal rows as one with their number `rows`, with what `sources` says of theirs and a `range` of (rank, ORDER)."""
    equal = rows.groupBy("doc_id", "source", "size", "place", "key").agg(F.count("*").alias("rows"))
    ranked = equal.join(
        sources.select(F.col("source").alias("of"), "rank", "weight", "source_size", "target"),
        equal["source"].eqNullSafe(F.col("of")),
    ).drop("of")
    ranges = max(shuffle_partitions(rows.sparkSession), n_rows // ROWS_PER_RANGE)
    dealt = ranked.repartitionByRange(ranges, "rank", *ORDER)
    # Written, for the ranges of a second run could be others.
    return saved(dealt.withColumn("range", F.spark_partition_id()), "mix-ranges")


def in_queue(rows: DataFrame, sources: DataFrame, n_rows: int) -> DataFrame:
    """Rows with `upto`, the words of their source up to and with them in shuffle order."""
    dealt = in_ranges(rows, sources, n_rows)
    words = F.col("size") * F.col("rows")
    sums = dealt.groupBy("rank", "range").agg(F.sum(words).alias("in_range"))
    earlier = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "range", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("rank", "range").orderBy(*ORDER)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queue = (
        dealt.join(sums, ["rank", "range"])
        .withColumn("before", F.col("earlier") + F.sum(words).over(inside) - words)
        .drop("earlier", "range")
    )
    # Equal rows apart again, a part of them in each task.
    part = F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(EQUAL_ROWS).cast("long"))
    queue = queue.withColumn("part", F.explode(part)).repartition(shuffle_partitions(rows.sparkSession))
    last = F.least(F.col("part") + EQUAL_ROWS, "rows")
    queue = queue.withColumn("nth", F.explode(F.sequence(F.col("part") + 1, last)))
    return queue.withColumn("upto", F.col("before") + F.col("size") * F.col("nth")).drop("before", "part", "nth", "rows")


def _finish(epoch: int) -> tuple:
    """The sort key of a document's copy: virtual finish time, source, words of the source so far."""
    words = F.col("upto") + F.col("source_size") * (epoch - 1)
    return (words / F.col("weight")).alias("finish"), F.col("rank"), words.alias("words")


def _cut(queue: DataFrame, budget: int, epochs: int):
    """The sort key of the last copy within the budget, None where no copy is."""
    spark = queue.sparkSession
    copies = F.explode(F.array(*(F.struct(*_finish(e)) for e in range(1, epochs + 1))))
    order = ["finish", "rank", "words"]
    items = queue.filter((F.col("size") > 0) & (F.col("weight") > 0)).select("size", copies.alias("copy"))
    items = items.select("size", "copy.*")
    items = items.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    # Written, for the ranges of a second run could be others.
    items = saved(items.withColumn("slice", F.spark_partition_id()), "mix-order")
    sums = items.groupBy("slice").agg(F.sum("size").alias("sum"))
    upto = F.sum("sum").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = sums.withColumn("upto", upto)
    full = sums.filter(F.col("upto") <= budget).agg(F.max("slice").alias("slice"), F.max("upto").alias("upto")).first()
    before, last = (full["upto"] or 0), (-1 if full["slice"] is None else full["slice"])
    crossing = sums.filter(F.col("slice") > last).agg(F.min("slice")).first()[0]
    running = Window.partitionBy("slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = F.max(F.struct(*order)).alias("key")
    if crossing is not None:
        inside = items.filter(F.col("slice") == crossing).withColumn("upto", F.sum("size").over(running) + before)
        found = inside.filter(F.col("upto") <= budget).agg(key).first()["key"]
        if found is not None:
            return found
    return items.filter(F.col("slice") <= last).agg(key).first()["key"]


def mix_sources(
    docs: DataFrame,
    *,
    weights: DataFrame | None = None,
    epochs: int = 3,
    seed: str = "mix",
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, key.

    The budget is the number of words of all documents. `copies` is how often the mix holds the whole
    document, `taken` its words times that. Without `weights` (source, weight) the sources in code point
    order, null last, weigh 1, 2, 3, repeating; a source missing from `weights` weighs nothing. Copies
    are whole documents, so a source stays within its largest document of its target.

    Null text is an empty document; documents without words are never taken. Null is a source of its own.
    Documents of one place in the shuffle go by id, size and text; rows equal in all of them are
    interchangeable, and each counts. An empty table gives no rows. Other columns are ignored.
    """
    rows = saved(queued(docs, id_column, text_column, source_column, seed), "mix-sizes")
    n_rows, budget = rows.agg(F.count("*"), F.sum("size")).first()
    queue = saved(in_queue(rows, source_targets(rows, weights, epochs), n_rows), "mix-queue")
    last = _cut(queue, budget or 0, epochs)
    copies = F.lit(0)
    if last is not None:
        key = F.struct(*(F.lit(last[c]).alias(c) for c in ("finish", "rank", "words")))
        key = key.cast("struct<finish:double,rank:int,words:bigint>")
        for e in range(1, epochs + 1):
            copies = copies + F.when(F.struct(*_finish(e)) <= key, 1).otherwise(0)
        copies = F.when((F.col("size") > 0) & (F.col("weight") > 0), copies).otherwise(0)
    return queue.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"), "key",
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns, each as often as the mix takes it.

    Rows equal in id and text stand for each other: their copies are added up and given out from one.
    """
    ident, text = options.get("id_column", "doc_id"), options.get("text_column", "text")
    taken = mix_sources(docs, **options).groupBy("key").agg(F.sum("copies").alias("n")).filter("n > 0")
    first = F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("row")
    kept = docs.groupBy(text_key(docs[ident], docs[text]).alias("key")).agg(first)
    copies = kept.join(taken, "key").select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return copies.select("row.*")
