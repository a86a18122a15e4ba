"""Removal of repeated lines, equal ones and those one edit apart, by deletion neighbourhoods.

Two lines are one edit (a character inserted, deleted or replaced) apart exactly if each gives a common string
when at most one character is deleted, and their edit distance is at most 1. So every line emits its
variants, itself and each single deletion, as hashed keys; lines with an equal key are compared, and the
later one goes.

A line of a thousand characters has a thousand variants, so lines without a partner are left out first, in
a way that loses no pair: cut at PARTS fixed fractions of its length, a line agrees with any partner in all of
it but the part that holds the edit. Only lines that share such a rest with another line emit variants, and
only those that delete within the part. The same filter with halves runs before the texts of lines are
fetched at all.

Only DataFrame functions are used. Equal lines are aggregated before any shuffle or join sees them, so a
line of a third of all rows is one row. The lines that share a variant of n characters number at most
(n + 1) times the alphabet, however large the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplevel.llm.common import saved

#: Lines of fewer characters are compared for equality alone: one edit is too much of them.
MIN_NEAR = 20
#: Parts of a line for the second filter; the first one has two.
PARTS = 16
#: Remainders of hashes that tell which rows can have a partner: a set of fixed size at most.
REMAINDERS = 1 << 20
FULL = r"[^\x20\x09-\x0D]"


def _hash(line: Column) -> Column:
    """Two hashes of 64 and 32 bits."""
    return F.struct(F.xxhash64(line).alias("h1"), F.hash(line).alias("h2"))


def _halves(line: Column, length: Column) -> Column:
    """Hashes of both halves of a line, without the middle character of an odd one.

    One edit leaves a half as it is. A partner has the same length or one character more or less, and the
    halves of both are as long as those of the shorter one: a line has keys for its length and for one less.
    """

    def keys(shorter: Column) -> list[Column]:
        half = F.shiftright(shorter, 1)
        front = F.xxhash64(line.substr(F.lit(1), half), F.lit(0), shorter)
        return [front, F.xxhash64(line.substr(length - half + 1, half), F.lit(1), shorter)]

    return F.array(*keys(length), *keys(length - 1))


def _rests(line: Column, length: Column, parts: int) -> Column:
    """For each part of a line, the hash of the rest, and the characters from which and to which the edit can be.

    As with halves, the parts are as long as those of the shorter line.
    """

    def keys(shorter: Column) -> Column:
        part = F.floor(shorter / parts).cast("int")

        def key(k: Column) -> Column:
            before, after = part * k, part * (parts - 1 - k)
            rest = F.xxhash64(line.substr(F.lit(1), before), line.substr(length - after + 1, after), k, shorter)
            return F.struct(rest.alias("rest"), before.alias("from"), (length - after).alias("to"))

        return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), key)

    return F.concat(keys(length), keys(length - 1))


def _shared(keys: DataFrame) -> DataFrame:
    """Of rows (line, rest, ...) with keys of distinct lines those whose rest another line has too.

    A rest is counted with a map-side combine. The rows that are joined with the counts are first thinned
    out by a remainder, which lets some others pass, so that what has no partner is not shuffled again.
    """
    shared = keys.groupBy("rest").count().filter("count > 1").select("rest")
    shared = saved(shared, "line-rests")
    return _thinned(keys, "rest", shared).join(shared, "rest")


def _thinned(rows: DataFrame, column: str, of: DataFrame) -> DataFrame:
    """Rows whose column has the remainder of a value of `of`: all with an equal value and some others."""
    remainder = F.pmod(column, F.lit(REMAINDERS)).alias("remainder")
    known = of.select(remainder).distinct()  # at most REMAINDERS numbers
    return rows.withColumn("remainder", remainder).join(F.broadcast(known), "remainder", "left_semi").drop("remainder")


def _variants(line: Column, length: Column, start: Column, stop: Column) -> Column:
    """Hashes of the line and of the line without one character of start + 1 to stop."""
    one_less = F.transform(
        F.sequence(F.least(start + 1, stop), stop),
        lambda i: F.xxhash64(F.concat(line.substr(F.lit(1), i - 1), line.substr(i + 1, length))),
    )
    return F.array_distinct(F.concat(F.array(F.xxhash64(line)), one_less))


def _later(lines: DataFrame) -> DataFrame:
    """Of distinct lines (line, first, text) the places of those one edit from an earlier one."""
    length = F.char_length("text")
    keys = lines.select("line", F.explode(_rests(F.col("text"), length, PARTS)).alias("key")).select("line", "key.*")
    parts = _shared(keys).select("line", "from", "to").distinct()
    one_less = _variants(F.col("text"), length, F.col("from"), F.col("to"))
    variants = parts.join(lines, "line").select("line", "first", F.explode(one_less).alias("variant"))
    variants = variants.distinct()
    a = variants.select("variant", F.col("first").alias("a_first"), F.col("line").alias("a"))
    b = variants.select("variant", F.col("first").alias("b_first"), F.col("line").alias("b"))
    pairs = a.join(b, "variant").filter("a_first < b_first").select("a", "b").distinct()
    pairs = pairs.join(lines.select(F.col("line").alias("a"), F.col("text").alias("a_text")), "a")
    pairs = pairs.join(lines.select(F.col("line").alias("b"), F.col("text").alias("b_text"), "first"), "b")
    return pairs.filter(F.levenshtein("a_text", "b_text", 1) >= 0).select("first").distinct()


def deduplicate_lines(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_near: int = MIN_NEAR,
    near: bool = True,
) -> DataFrame:
    """The documents with all their columns, repeated lines removed, and n_lines, n_kept.

    Lines end at "\\n". A line goes if an equal line stands earlier, or one within edit distance 1 (whether that
    one is kept or not), if both have at least `min_near` characters. Two edits are never near, however long
    the lines. Earlier is by ascending id, null last, then a hash of the text, then place in the text. Lines of
    white space alone are always kept.

    n_lines and n_kept count all lines. Null text stays null and has none; an empty text has one, empty, kept.
    Rows equal in id and text are one document that occurs more than once: the first keeps its lines, the
    others lose theirs; their other columns are those of any of them. An empty table gives no rows. Columns
    named n_lines or n_kept are replaced.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_kept")]
    others = [c for c in columns if c != text_column]
    ident, text = docs[id_column], docs[text_column]
    row = F.struct(ident.isNull().alias("no_id"), ident.alias("id"), F.xxhash64(text).alias("text_hash")).alias("row")
    whole = docs.select(row, text.alias("body"), F.struct(*(docs[c] for c in others)).alias("rest"))

    lines = whole.select("row", F.posexplode(F.split("body", "\n")).alias("at", "line"))
    lines = lines.filter(F.col("line").rlike(FULL)).withColumn("length", F.char_length("line"))
    # A line of one character less than the least can't be the shorter of a pair.
    halves = F.when(F.col("length") >= min_near, _halves(F.col("line"), F.col("length"))) if near else F.lit(None)
    lines = lines.select(_hash(F.col("line")).alias("hash"), F.struct("row", "at").alias("first"), halves.alias("halves"))
    first = lines.groupBy("hash").agg(F.min("first").alias("first"), F.first("halves").alias("halves"))
    places = first.select("first", F.lit(False).alias("later"))
    if near:
        first = saved(first.select(F.col("hash.h1").alias("line"), "first", "halves"), "lines")
        later = _later(saved(_fetched(whole, first), "line-partners"))
        places = first.select("first", F.lit(False).alias("later")).unionByName(later.select("first", F.lit(True).alias("later")))
    kept = places.groupBy(F.col("first.row").alias("row")).agg(
        F.collect_list("first.at").alias("at"), F.collect_list(F.when(F.col("later"), F.col("first.at"))).alias("later")
    )
    kept = kept.select("row", F.array_except("at", "later").alias("kept"))

    one = F.first(F.struct("body", "rest")).alias("one")
    grouped = whole.groupBy("row").agg(one, F.count("*").alias("copies")).select("row", "one.*", "copies")
    joined = grouped.join(kept, "row", "left").withColumn("lines", F.split("body", "\n"))
    blank = F.filter(F.transform("lines", lambda x, i: F.when(~x.rlike(FULL), i)), lambda i: i.isNotNull())
    joined = joined.withColumn("blank", blank)
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    none = F.array().cast("array<int>")
    mine = F.when(F.col("copy") == 1, F.coalesce("kept", none)).otherwise(none)
    joined = joined.withColumn("at", F.array_sort(F.concat(mine, "blank")))
    left = F.when(F.size("at") == F.size("lines"), F.col("body"))
    left = left.otherwise(F.array_join(F.transform("at", lambda i: F.get("lines", i)), "\n"))
    count = lambda c: F.when(F.col("body").isNull(), 0).otherwise(F.size(c)).cast("long")
    out = [left.alias(c) if c == text_column else F.col("rest")[c].alias(c) for c in columns]
    return joined.select(*out, count("lines").alias("n_lines"), count("at").alias("n_kept"))


def _fetched(whole: DataFrame, first: DataFrame) -> DataFrame:
    """Of distinct lines (line, first, halves) those that share a half with another: line, first, text.

    Their texts come from the documents; those that hold no such line are left out before any text is sent
    to a join, but for some that pass by their remainder.
    """
    keys = first.filter("halves is not null").select("line", F.explode("halves").alias("rest"))
    partners = saved(_shared(keys).select("line").distinct(), "line-hashes")
    some = _thinned(first.select("line", "first"), "line", partners).join(partners, "line", "left_semi")
    places = some.groupBy(F.col("first.row").alias("row")).agg(F.collect_list(F.struct("line", "first")).alias("found"))
    places = saved(places.withColumn("text_hash", F.col("row.text_hash")), "line-places")
    texts = whole.select("row", "body", F.col("row.text_hash").alias("text_hash"))
    texts = _thinned(texts, "text_hash", places).select("row", "body").distinct()
    fetched = texts.join(places, "row").select(F.split("body", "\n").alias("lines"), F.explode("found").alias("one"))
    return fetched.select("one.line", "one.first", F.get("lines", F.col("one.first.at")).alias("text"))
