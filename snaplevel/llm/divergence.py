"""A source divergence audit: how the words of a language's sources differ, and which words set a source apart.

Texts are tokenized as UTF-8 bytes: one `bytes.translate` lowers A-Z and blanks every other ASCII byte that is
no letter, `bytes.split` gives the terms, and a Counter per document the occurrences. A task adds the counters of
its documents up and sends sparse rows (language, source, term, occurrences, documents), which Spark sums.

Every sum and every smoothed share is a whole number. Distances between sources need each kept term of each pair
of sources; they are added up over buckets of terms and pairs of tiles of sources, both of bounded size, and terms
that neither tile has are added at once, as they all differ by the same amount.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaplevel.llm.common import saved, small_batches

#: Documents of a language that a kept term is in, at least; what is added to every count; terms listed per source.
MIN_DOCUMENTS, SMOOTHING, TOP_TERMS = 30, 5, 50
#: What shares are multiplied with before they are rounded down.
UNIT = 1_000_000_000
#: Sources of a tile and kept terms of a bucket, about.
TILE, BUCKET = 32, 8192
#: Bytes of a text that are split at a time; entries that a task's counters hold at most before they are sent.
AT_ONCE, HELD = 1 << 20, 150_000

_LOWER = bytes(range(97, 123))
#: Letters lowered, bytes beyond ASCII as they are, all others blank.
TABLE = b" " * 65 + _LOWER + b" " * 6 + _LOWER + b" " * 5 + bytes(range(128, 256))

_COUNTS = "lang string, source string, term string, n long, docs long"


def document_counter(text: bytes) -> Counter[bytes]:
    """Occurrences of the terms of a text. A long text is split in parts that end at a separator."""
    words = text.translate(TABLE)
    if len(words) <= AT_ONCE:
        return Counter(words.split())
    found: Counter[bytes] = Counter()
    start = 0
    while start < len(words):
        stop = words.find(b" ", start + AT_ONCE)
        stop = len(words) if stop < 0 else stop
        found.update(words[start:stop].split())
        start = stop
    return found


def count_terms(batches: Iterator[pa.RecordBatch], most: int = HELD) -> Iterator[pa.RecordBatch]:
    """Sums over a task's documents; a row without a term tells that its source occurs."""
    totals: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}
    held = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in totals.items():
            terms = pa.array([None, *n], pa.binary()).cast(pa.string())
            k = len(terms)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.repeat(lang, k),
                    pa.repeat(source, k),
                    terms,
                    pa.array([0, *n.values()], pa.int64()),
                    pa.array([0, *(docs[t] for t in n)], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )
        totals.clear()

    for batch in batches:
        texts = batch["text"].cast(pa.binary())
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), texts, strict=True):
            if (lang, source) not in totals:
                totals[lang, source] = Counter(), Counter()
            n, docs = totals[lang, source]
            found = document_counter(text.as_py())
            held -= len(n)
            n.update(found)
            docs.update(found.keys())
            held += len(n)
            if held > most:
                yield from flushed()
                held = 0
    yield from flushed()


def term_counts(
    docs: DataFrame, *, text_column: str = "text", lang_column: str = "lang", source_column: str = "source"
) -> DataFrame:
    """Rows (lang, source, term, n, docs): occurrences of a term and documents with it; nulls count as empty.

    Every occurring source of a language also has one row without a term.
    """
    small_batches(docs.sparkSession)
    text = lambda c, name: F.coalesce(docs[c].cast("string"), F.lit("")).alias(name)
    rows = docs.select(text(text_column, "text"), text(lang_column, "lang"), text(source_column, "source"))
    parts = rows.mapInArrow(count_terms, _COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str, smoothing: int = SMOOTHING) -> Column:
    """1 + floor(UNIT * (n + smoothing) / (total + smoothing * kept)), exact; null without kept terms."""
    big = lambda x: f"cast({x} AS decimal(20, 0))"
    over = f"nullif({big(total)} + {smoothing} * {big(kept)}, 0)"
    return F.expr(f"1 + ({UNIT} * ({big(n)} + {smoothing})) div {over}").cast("long")


def _distances(size: int):
    """Summed distances of the sources of two tiles of `size` over the terms of one bucket that one of them has."""

    def distances(table: pa.Table) -> pa.Table:
        flat = table["tile"].to_numpy().astype(np.int64) * size + table["at"].to_numpy()
        p = table["p"].to_numpy()
        terms = table["term"].combine_chunks().dictionary_encode()
        head = terms.indices.is_null().to_numpy(zero_copy_only=False)
        order = np.argsort(flat[head])
        sources, rest = flat[head][order], p[head][order]
        matrix = np.repeat(rest[:, None], len(terms.dictionary), axis=1)
        codes = terms.indices.drop_null().to_numpy()
        matrix[np.searchsorted(sources, flat[~head]), codes] = p[~head]
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        left, right = np.flatnonzero(sources // size == low), np.flatnonzero(sources // size == high)
        a, b, sums = [], [], []
        for i in left:
            others = right[right > i] if low == high else right
            a += [sources[i]] * len(others)
            b += sources[others].tolist()
            sums += np.abs(matrix[others] - matrix[i]).sum(axis=1).tolist()
        return pa.table(
            {
                "lang": pa.repeat(table["lang"][0], len(a)),
                "a": pa.array(a, pa.int64()),
                "b": pa.array(b, pa.int64()),
                "part": pa.array(sums, pa.int64()),
                "seen": pa.repeat(pa.scalar(len(terms.dictionary), pa.int64()), len(a)),
            }
        )

    return distances


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of sources of a language.

    groups: lang, source, number (from 0 within the language), sources, kept, rest (the share of a term that
    the source lacks). shares: lang, source, term, p of the terms that it has.
    """
    places = groups.select(
        "lang",
        "source",
        "rest",
        F.expr(f"cast(number div {TILE} AS int)").alias("tile"),
        F.expr(f"cast(number % {TILE} AS int)").alias("at"),
        F.expr(f"cast((sources - 1) div {TILE} AS int)").alias("last_tile"),
        F.expr(f"cast(greatest(1, ceil(kept / {BUCKET})) AS int)").alias("buckets"),
    )
    heads = places.select(
        *("lang", "tile", "at", "last_tile"),
        F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"),
        F.lit(None).cast("string").alias("term"),
        F.coalesce("rest", F.lit(0)).alias("p"),
    )
    entries = shares.join(places, ["lang", "source"]).select(
        *("lang", "tile", "at", "last_tile"),
        F.pmod(F.xxhash64("term"), "buckets").cast("int").alias("bucket"),
        *("term", "p"),
    )
    both = heads.unionByName(entries).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last_tile"))))
    dealt = both.select(
        *("lang", "bucket", "tile", "at", "term", "p"),
        F.least("tile", "other").alias("low"),
        F.greatest("tile", "other").alias("high"),
    )
    parts = dealt.groupBy("lang", "low", "high", "bucket").applyInArrow(
        _distances(TILE), "lang string, a long, b long, part long, seen long"
    )
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.sum("seen").alias("seen"))
    of = lambda x: groups.select(
        "lang", F.col("number").cast("long").alias(x), F.col("source").alias(f"{x}_source"), F.col("rest").alias(f"{x}_rest"), *(["kept"] if x == "a" else [])
    )
    found = sums.join(of("a"), ["lang", "a"]).join(of("b"), ["lang", "b"])
    unseen = (F.col("kept") - F.col("seen")) * F.abs(F.col("a_rest") - F.col("b_rest"))
    value = F.col("part") + F.coalesce(unseen, F.lit(0))
    ways = [F.struct(F.col(f"{x}_source").alias("source"), F.col(f"{y}_source").alias("item")) for x, y in ("ab", "ba")]
    return found.select("lang", F.explode(F.array(*ways)).alias("way"), value.alias("value")).select("lang", "way.*", "value")


def audit(
    docs: DataFrame,
    *,
    text_column: str = "text",
    lang_column: str = "lang",
    source_column: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    smoothing: int = SMOOTHING,
    top_terms: int = TOP_TERMS,
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for every occurring source of every language.

    A language keeps the terms that at least `min_documents` of its documents hold. With N occurrences of kept
    terms in a source and V kept terms, a term's share there is 1 + floor(10^9 (n + smoothing) / (N + smoothing V)).
    Part "pair": item is another source of the language, value the absolute differences of the shares, summed over
    all kept terms, 0 if there are none. Part "term": item is a kept term that the source holds more of than its
    language, value the difference; the `top_terms` largest. Ranks count from 1 by value, descending, then item by
    its UTF-8 bytes.

    Null texts, languages and sources count as ''. Repeated rows are documents of their own. A language of one source has
    no pairs; a source without words has pairs and no terms. Other columns are ignored; no documents, no rows.
    """
    counts = term_counts(docs, text_column=text_column, lang_column=lang_column, source_column=source_column)
    counts = saved(counts, "divergence-counts")
    group, term = ["lang", "source"], F.col("term")
    kept = counts.filter(term.isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = saved(kept.filter(F.col("docs") >= min_documents).drop("docs"), "divergence-terms")
    mine = saved(counts.join(kept, ["lang", "term"]), "divergence-kept-counts")

    totals = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    sums = mine.groupBy(*group).agg(F.sum("n").alias("total"))
    groups = counts.filter(term.isNull()).select(*group).join(sums, group, "left").join(totals, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = groups.select(*group, *(zero(c) for c in ("total", "kept", "lang_total")))
    # One row for each source of a language.
    inside = Window.partitionBy("lang")
    groups = groups.select(
        "*",
        (F.row_number().over(inside.orderBy("source")) - 1).alias("number"),
        F.count("*").over(inside).alias("sources"),
        share("0", "total", "kept", smoothing).alias("rest"),
    )
    groups = saved(groups, "divergence-sources")
    shares = mine.join(groups.select(*group, "total", "kept", "lang_total"), group).select(
        *group,
        "term",
        share("n", "total", "kept", smoothing).alias("p"),
        share("lang_n", "lang_total", "kept", smoothing).alias("q"),
    )

    order = Window.partitionBy(*group).orderBy(F.col("value").desc(), "item")
    pairs = _pairs(groups, shares.select(*group, "term", "p")).withColumn("rank", F.row_number().over(order))
    above = shares.filter("p > q").select(*group, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    above = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*out).unionByName(above.withColumn("part", F.lit("term")).select(*out))
