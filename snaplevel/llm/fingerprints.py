"""Order-independent fingerprints of documents: a homomorphic multiset hash of their paragraphs.

Every paragraph (line) has a wide vector of 60-bit lanes, and a document's fingerprint is their sum modulo
2^60, lane by lane. So the order of paragraphs doesn't matter, and a paragraph is inserted into or deleted
from a fingerprint by adding or subtracting its vector. The lanes of a paragraph:

* 0 and 1: 1, and its number of sentences;
* 2 to 5: 240 bits of its SHA-256, for equality;
* the others, for likeness: two counters of 30 bits each, which hold texts of up to 2^30 - 1 sentences; a counter
  adds one for every sentence whose hash has its bit set. Twice a counter less the number of sentences is a random projection of the multiset of
  sentences, so the cosine of these projections estimates the cosine of two documents' sentence counts.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaplevel.llm.common import saved, shuffle_partitions, text_key

PARAGRAPH, SENTENCE = "\n", r"\n|(?<=[.!?]) "
MODULUS_MASK = (1 << 60) - 1
#: Bits of one 64-bit hash that are used, two for each lane; hashes of a sentence.
SHIFTS, HASHES = tuple(range(0, 64, 2)), 2
EXACT_LANES = 6
#: Copies the bits 0, 1 of a number to the bits 0, 30.
_SPREAD, _EVERY_30 = 1 + (1 << 29), 1 + (1 << 30)


def _big(value: int) -> Column:
    return F.lit(value).cast("long")


def _sketch(sentences: Column, seed: int) -> Column:
    shifts = F.array(*map(F.lit, SHIFTS))
    hashes = F.transform(sentences, lambda s: F.xxhash64(s, F.lit(seed)))

    def add(lanes: Column, h: Column) -> Column:
        def lane(x: Column, shift: Column) -> Column:
            bits = F.call_function("shiftrightunsigned", h, shift).bitwiseAND(_big(3))
            return (x + (bits * _big(_SPREAD)).bitwiseAND(_big(_EVERY_30))).bitwiseAND(_big(MODULUS_MASK))

        return F.zip_with(lanes, shifts, lane)

    return F.aggregate(hashes, F.array_repeat(_big(0), len(SHIFTS)), add)


def _digest_lanes(paragraphs: Column) -> Column:
    digests = F.transform(paragraphs, lambda p: F.sha2(p, 256))

    def lane(k: int) -> Column:
        def add(total: Column, digest: Column) -> Column:
            part = F.conv(F.substring(digest, 15 * k + 1, 15), 16, 10).cast("long")
            return (total + part).bitwiseAND(_big(MODULUS_MASK))

        return F.aggregate(digests, _big(0), add)

    return F.array(*(lane(k) for k in range(EXACT_LANES - 2)))


def fingerprint(text: Column) -> Column:
    """The lanes of a text, an array of longs; null counts as empty, which is one empty paragraph."""
    text = F.coalesce(text, F.lit(""))
    paragraphs, sentences = F.split(text, PARAGRAPH), F.split(text, SENTENCE)
    counts = F.array(F.size(paragraphs).cast("long"), F.size(sentences).cast("long"))
    return F.concat(counts, _digest_lanes(paragraphs), *(_sketch(sentences, seed) for seed in range(HASHES)))


def fingerprints_of(texts: DataFrame, body: str) -> DataFrame:
    """The other columns of the rows, which must tell them apart, and the `lanes` of their text, as `fingerprint` has them.

    The paragraphs and their sentences become rows, and lanes are plain sums over these, combined before anything is
    shuffled; so a text of millions of sentences is no more than as many rows. Null counts as empty.
    """
    keys = [c for c in texts.columns if c != body]
    paragraphs = texts.select(*keys, F.explode(F.split(F.coalesce(body, F.lit("")), PARAGRAPH)).alias("paragraph"))
    sentences = paragraphs.select(*keys, "paragraph", F.posexplode(F.split("paragraph", r"(?<=[.!?]) ")).alias("at", "sentence"))
    head = F.col("at") == 0
    digest = F.when(head, F.sha2("paragraph", 256))
    rows = sentences.select(
        *keys,
        head.cast("long").alias("head"),
        digest.alias("digest"),
        *(F.xxhash64("sentence", F.lit(seed)).alias(f"hash{seed}") for seed in range(HASHES)),
    )
    # Each 60-bit part of a digest as two of 30 bits, whose sums don't overflow.
    low = _big((1 << 30) - 1)
    parts = [F.conv(F.substring("digest", 15 * k + 1, 15), 16, 10).cast("long").alias(f"part{k}") for k in range(EXACT_LANES - 2)]
    rows = rows.select(*keys, "head", *parts, *(f"hash{seed}" for seed in range(HASHES)))
    sums = [F.sum("head").alias("paragraphs"), F.count("*").alias("sentences")]
    for k in range(EXACT_LANES - 2):
        sums += [F.sum(F.col(f"part{k}").bitwiseAND(low)).alias(f"low{k}"), F.sum(F.shiftright(f"part{k}", 30)).alias(f"high{k}")]
    for seed in range(HASHES):
        for shift in SHIFTS:
            bits = F.call_function("shiftrightunsigned", F.col(f"hash{seed}"), F.lit(shift)).bitwiseAND(_big(3))
            sums.append(F.sum((bits * _big(_SPREAD)).bitwiseAND(_big(_EVERY_30))).alias(f"count{seed}_{shift}"))
    found = rows.groupBy(*keys).agg(*sums)
    exact = [(F.shiftleft(f"high{k}", 30) + F.col(f"low{k}")).bitwiseAND(_big(MODULUS_MASK)) for k in range(EXACT_LANES - 2)]
    counters = [F.col(f"count{seed}_{shift}") for seed in range(HASHES) for shift in SHIFTS]
    return found.select(*keys, F.array("paragraphs", "sentences", *exact, *counters).alias("lanes"))


def inserted(lanes: Column, more: Column) -> Column:
    """The fingerprint with the paragraphs of another one."""
    return F.zip_with(lanes, more, lambda a, b: (a + b).bitwiseAND(_big(MODULUS_MASK)))


def deleted(lanes: Column, less: Column) -> Column:
    """The fingerprint without the paragraphs of another one, which it holds."""
    return F.zip_with(lanes, less, lambda a, b: (a - b).bitwiseAND(_big(MODULUS_MASK)))


def as_text(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 15, "0")), "")


def _projections(lanes: Column) -> Column:
    counters = F.slice(lanes, EXACT_LANES + 1, len(SHIFTS) * HASHES)
    n, low = F.get(lanes, F.lit(1)).cast("double"), _big((1 << 30) - 1)

    def two(x: Column) -> Column:
        parts = (x, F.shiftright(x, 30))
        return F.array(*(p.bitwiseAND(low).cast("double") * 2 - n for p in parts))

    return F.flatten(F.transform(counters, two))


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of the sentence counts, 0 to 1; 1 for equal fingerprints. About 0.09 of noise."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    x, y = _projections(a), _projections(b)
    norms = F.sqrt(total(x, x) * total(y, y))
    cosine = F.when(norms > 0, total(x, y) / norms).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def following(keys: DataFrame) -> DataFrame:
    """Distinct rows (doc_id, key, ...) with `next_key`, that of the next one by descending id, nulls last, then key.

    The rows are range partitioned; the first row of a range is the next of the last one before it.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("key")]
    dealt = keys.repartitionByRange(shuffle_partitions(keys.sparkSession), *order)
    dealt = saved(dealt.withColumn("slice", F.spark_partition_id()), "fingerprint-order")
    inside = Window.partitionBy("slice").orderBy(*order)
    dealt = dealt.withColumn("in_slice", F.lead("key").over(inside)).withColumn("row", F.row_number().over(inside))
    # One row for each range.
    every = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = dealt.filter("row = 1").select(
        "slice",
        F.coalesce(F.lead("key").over(Window.orderBy("slice")), F.first("key").over(every)).alias("after"),
    )
    next_key = F.coalesce("in_slice", "after").alias("next_key")
    return dealt.join(heads, "slice").select(*keys.columns, next_key)


def fingerprint_edits(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document its fingerprint, that of an edited text, and how like they and the next document's are.

    In the edited text the last floor(n_chars / 2) code points give way to the first as many of the next
    document by descending id (or to all of it, if it has fewer). Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    Null text counts as empty. Null ids come last; documents of one id go by a digest of their text. Rows
    equal in id and text are one document in this order, returned as often as they occur. The document
    after the last is the first; a lone document follows itself. Other columns are ignored; an empty table
    gives no rows.
    """
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), F.coalesce(docs[text_column], F.lit("")).alias("text"))
    rows = rows.withColumn("key", text_key(F.col("doc_id"), F.col("text")))
    half = F.floor(F.char_length("text") / 2).cast("int")
    order = following(rows.groupBy("doc_id", "key").agg(F.max(half).alias("half")))
    # Both uses of `whole` read the same shuffle of the texts; the filter has both keep all its columns.
    whole = rows.groupBy("key").agg(F.first(F.struct("doc_id", "text")).alias("row"), F.count("*").alias("copies"))
    whole = whole.filter("copies > 0")
    of = order.select(F.col("next_key").alias("key"), F.col("key").alias("of_key"), F.col("half").alias("of_half"))
    given = whole.join(of, "key").select(
        F.col("of_key").alias("key"),
        F.col("key").alias("next_key"),
        F.col("row.text").substr(F.lit(1), F.col("of_half")).alias("tail"),
    )
    n = F.char_length("text")
    edited = F.concat(F.col("text").substr(F.lit(1), n - F.floor(n / 2).cast("int")), F.col("tail"))
    both = whole.join(given, "key").select("key", "next_key", "row.*", "copies", "tail")
    both = both.select("key", "next_key", "doc_id", n.cast("long").alias("n_chars"), "copies", "text", edited.alias("edited"))
    both = both.withColumn("edited_sha256", F.sha2("edited", 256))
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(c).alias("body")) for k, c in enumerate(("text", "edited"))]
    facts = ["key", "next_key", "doc_id", "n_chars", "copies", "edited_sha256"]
    texts = both.select(*facts, F.explode(F.array(*kinds)).alias("one")).select(*facts, "one.kind", "one.body")
    lanes = saved(fingerprints_of(texts, "body"), "fingerprints")

    mine = lanes.filter("kind = 0").drop("kind")
    changed = lanes.filter("kind = 1").select("key", F.col("lanes").alias("edited_lanes"))
    following_lanes = lanes.filter("kind = 0").select(F.col("key").alias("next_key"), F.col("lanes").alias("next_lanes"))
    found = mine.join(changed, "key").join(following_lanes, "next_key").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("lanes")).alias("fingerprint"),
        as_text(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
        "copies",
    )
    return _repeated(found, "copies")


def _repeated(rows: DataFrame, copies: str, at_once: int = 10_000) -> DataFrame:
    """Every row as often as it has copies, unfolded in parts of bounded size that are dealt out anew."""
    several = F.col(copies) > at_once
    few = rows.filter(~several).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / at_once))
    many = rows.filter(several).withColumn("part", F.explode(parts)).repartition("part")
    left = F.least(F.lit(at_once).cast("long"), F.col(copies) - F.col("part") * at_once).cast("int")
    many = many.withColumn("copy", F.explode(F.sequence(F.lit(1), left))).drop("part")
    return few.unionByName(many).drop("copy", copies)
