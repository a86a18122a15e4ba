"""Token counts of whole texts, huge ones by overlapping chunks that resynchronise.

A huge text is cut into chunks that overlap, each encoded with offsets in a task of its own. Two neighbours
are spliced at the first position of their overlap where both begin a word. That position is proven: the
left chunk equals the encoding of the whole text up to there (by induction; the last characters of a chunk,
as many as the vocabulary can look ahead, are not used), and what the splitter does from a word's beginning
on depends on the text from there on alone, which both chunks see. If an overlap holds no common beginning,
the text is cut again into longer chunks with wider overlaps, up to one chunk for the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplevel.llm import byte_bpe
from snaplevel.llm.common import saved, small_batches

#: Texts of more characters are cut; characters of a chunk and of an overlap at first, factor of each further try.
HUGE, CHUNK, OVERLAP, WIDER = 65_536, 16_384, 512, 8
#: Words whose counts a Python process remembers, for speed alone.
REMEMBERED = 400_000
#: Longest look-ahead of the splitter without special strings: the longest contraction and one more character.
LOOKAHEAD = 4


class WordCounts(dict):
    """Number of tokens by word, filled as words turn up."""

    def __init__(self, bpe: byte_bpe.ByteBPE):
        self.bpe = bpe

    def of(self, text: str) -> int:
        words = self.bpe.split(text)
        try:
            return sum(map(self.__getitem__, words))
        except KeyError:
            if len(self) > REMEMBERED:
                self.clear()
            new = [w for w in set(words) if w not in self]
            self.update(zip(new, map(len, self.bpe.encode_words(new)), strict=True))
            return sum(map(self.__getitem__, words))


def _count_whole(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCounts(byte_bpe.load(path))
        for batch in batches:
            doc_id, n_bytes, text = batch.columns
            n = pa.array([known.of(t.as_py() or "") for t in text], pa.int64())
            yield pa.RecordBatch.from_arrays([doc_id, n_bytes, n], ["doc_id", "n_bytes", "n_tokens"])

    return count


def _cut(chunk: int, overlap: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "no", "start", "last", "piece"]
        for batch in batches:
            for key, value in zip(*batch.columns, strict=True):
                text, key = value.as_py(), key.as_py()
                for no, start in enumerate(range(0, max(1, len(text) - overlap), chunk)):
                    stop = start + chunk + overlap
                    row = [key, no, start, stop >= len(text), text[start:stop]]
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names)
                    if stop >= len(text):
                        break

    return cut


def chunk_marks(bpe: byte_bpe.ByteBPE, piece: str, start: int, last: bool, chunk: int, overlap: int) -> dict:
    """Beginnings of words of a chunk in its first and last overlap with the tokens before each; all its tokens."""
    encoded = bpe.tokenizer.encode(piece, add_special_tokens=False)
    offsets, words = encoded.offsets, encoded.word_ids
    proven = len(piece) if last else len(piece) - LOOKAHEAD - max(map(len, bpe.specials), default=0)
    head, tail = [], []
    for k, (a, _) in enumerate(offsets):
        begins = k == 0 or (offsets[k - 1][1] == a and (words[k] is None or words[k] != words[k - 1]))
        if begins and a <= overlap:
            head.append((start + a, k))
        if begins and chunk <= a <= proven:
            tail.append((start + a, k))
    return {"head": head, "tail": tail, "total": len(offsets)}


_MARK = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
_MARKS = "key string, no long, head array<struct<at:long,n:long>>, tail array<struct<at:long,n:long>>, total long, last boolean"


def _mark(path: str, chunk: int, overlap: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.load(path)
        for batch in batches:
            rows = batch.to_pylist()
            found = [chunk_marks(bpe, r["piece"], r["start"], r["last"], chunk, overlap) for r in rows]
            as_rows = lambda side: pa.array([[{"at": a, "n": n} for a, n in f[side]] for f in found], _MARK)
            total = pa.array([f["total"] for f in found], pa.int64())
            columns = [batch["key"], batch["no"], as_rows("head"), as_rows("tail"), total, batch["last"]]
            yield pa.RecordBatch.from_arrays(columns, ["key", "no", "head", "tail", "total", "last"])

    return mark


def _spliced(marks: DataFrame) -> DataFrame:
    """Per text its tokens, null where two neighbours have no common beginning of a word.

    Each splice is a join of neighbours, not a loop over a text's chunks: the tokens of the left chunk before
    the common position minus those of the right one before it, summed, and the last chunk's total.
    """
    left = marks.filter("not last").select("key", (F.col("no") + 1).alias("no"), "tail")
    right = marks.filter("no > 0").select("key", "no", "head")
    at = lambda c: F.transform(c, lambda m: m["at"])
    tokens = lambda c: F.get(F.filter(F.col(c), lambda m: m["at"] == F.col("common")), F.lit(0))["n"]
    pairs = left.join(right, ["key", "no"]).withColumn("common", F.array_min(F.array_intersect(at("tail"), at("head"))))
    steps = pairs.select("key", (tokens("tail") - tokens("head")).alias("n"))
    steps = steps.unionByName(marks.filter("last").select("key", F.col("total").alias("n")))
    whole = F.count("*") == F.count("n")
    return steps.groupBy("key").agg(F.when(whole, F.sum("n")).alias("n_tokens"))


def huge_counts(texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_tokens) of huge texts (key, text)."""
    done = None
    while True:
        cuts = texts.mapInArrow(_cut(chunk, overlap), "key string, no long, start long, last boolean, piece string")
        marks = cuts.repartition("key", "no").mapInArrow(_mark(path, chunk, overlap), _MARKS)
        counts = saved(_spliced(saved(marks, "token-marks")), "token-counts")
        good = counts.filter("n_tokens is not null")
        done = good if done is None else done.unionByName(good)
        failed = counts.filter("n_tokens is null").select("key")
        if failed.isEmpty():
            return done
        texts = texts.join(failed, "key", "left_semi")
        chunk, overlap = chunk * WIDER, overlap * WIDER


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = 1024,
    huge: int = HUGE,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts are those of the tokenizers library without begin, end or other added tokens, special strings in
    a text as its default treats them. Null and empty texts count 0 of both. Rows are counted one by one:
    repeated ids give repeated rows, a null id stays null. Texts of more than `huge` characters are cut;
    equal ones are counted once. Other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    text = docs[text_column]
    rows = docs.select(
        docs[id_column].cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        text.alias("text"),
    )
    # No text has more characters than bytes: most are decided without counting characters.
    is_huge = (F.col("n_bytes") > huge) & (F.char_length("text") > huge)
    whole = rows.filter(~F.coalesce(is_huge, F.lit(False)))
    whole = whole.mapInArrow(_count_whole(vocabulary), "doc_id long, n_bytes long, n_tokens long")
    cut = rows.filter(is_huge).withColumn("key", F.sha2("text", 256))
    distinct = saved(cut.groupBy("key").agg(F.first("text").alias("text")), "huge-texts")
    counts = huge_counts(distinct, vocabulary, chunk, overlap)
    counted = cut.select("doc_id", "n_bytes", "key").join(counts, "key").select("doc_id", "n_bytes", "n_tokens")
    return whole.unionByName(counted).withColumn("over_limit", F.col("n_tokens") > limit)
