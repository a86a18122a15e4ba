"""Byte-level BPE by a table of distinct words.

Documents are split into words in Spark tasks. The distinct words are counted over all documents, each frequent
one is encoded once, and the ids come back to the documents by the position of each word. Ids are decoded by a
join with the table of id and piece.

The way back is a hash join with the most frequent words: as many as fit into `head` entries, a bound that
doesn't grow with the data. A word beyond them is rare, most of them occur once; sending every position of
every rare word, and with them the documents that wait for it, through a shuffle would move more than the whole
text, so the task that meets such a word encodes it on the spot, once per batch of documents.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplevel.llm import byte_bpe
from snaplevel.llm.common import saved, small_batches

#: Entries of the joined table of words, distinct words counted at a time in one task.
HEAD, COUNTED = 131_072, 100_000
DECODED = "doc_id long, ids array<int>, text string"


def _count_words(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, counts = byte_bpe.load(path), Counter()

        def out():
            for k in range(0, len(words := list(counts)), 50_000):
                part = words[k : k + 50_000]
                columns = [pa.array(part, pa.string()), pa.array([counts[w] for w in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                counts.update(bpe.split(text.as_py()))
                if len(counts) > COUNTED:
                    yield from out()
                    counts.clear()
        yield from out()

    return count


def _encode_words(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.load(path)
        for batch in batches:
            ids = bpe.encode_words(batch["word"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["word"], pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return encode


def distinct_words(docs: DataFrame, vocabulary: str, text_column: str = "text") -> DataFrame:
    """Every distinct word of the texts with its number of occurrences."""
    texts = docs.filter(docs[text_column].isNotNull()).select(docs[text_column].alias("text"))
    return texts.mapInArrow(_count_words(vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_of(words: DataFrame, head: int) -> DataFrame:
    """The words of at least some count, the smallest power of two with which at most `head` words are left."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = words.groupBy(level.alias("level")).count().collect()  # one row for each power of two
    kept, least = 0, 64
    for row in sorted(sizes, key=lambda r: -r["level"]):
        if kept + row["count"] > head:
            break
        kept, least = kept + row["count"], row["level"]
    return words.filter(level >= least)


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    return (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))


def _gathered(flat: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of `flat` (piece k ends at ends[k]) of the numbers in `which`, one after another, and their lengths."""
    starts = np.concatenate([[0], ends[:-1]])
    lengths = (ends - starts)[which]
    upto = np.cumsum(lengths)
    at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts[which] - (upto - lengths), lengths)
    return flat[at], lengths


def _upto(lengths: np.ndarray, counts: list[int]) -> pa.Array:
    """Offsets of lists of so many pieces each."""
    return pa.array(np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32))


def _encode_documents(path: str, head):
    def encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.load(path)
        table = head.value.combine_chunks()
        known = {w: k for k, w in enumerate(table["word"].to_pylist())}
        ids = table["ids"].combine_chunks()
        flat, ends = ids.flatten().to_numpy(), ids.offsets.to_numpy()[1:].astype(np.int64)
        for batch in batches:
            rare: dict[str, int] = {}
            more_flat, more_ends = flat, ends
            for part in _slices(batch):
                split = [bpe.split(text.as_py() or "") for text in part["text"]]
                words = list(chain.from_iterable(split))
                which = list(map(known.get, words))
                if None in which:
                    missing = [k for k, found in enumerate(which) if found is None]
                    new = list({words[k] for k in missing}.difference(rare))
                    rare.update((w, len(more_ends) + k) for k, w in enumerate(new))
                    added = bpe.encode_words(new)
                    upto = np.cumsum(np.fromiter(map(len, added), np.int64, len(added)))
                    more_ends = np.concatenate([more_ends, len(more_flat) + upto])
                    more_flat = np.concatenate([more_flat, np.fromiter(chain.from_iterable(added), np.int32)])
                    for k in missing:
                        which[k] = rare[words[k]]
                found, lengths = _gathered(more_flat, more_ends, np.array(which, np.int64))
                lists = pa.ListArray.from_arrays(_upto(lengths, list(map(len, split))), pa.array(found, pa.int32()))
                yield pa.RecordBatch.from_arrays([part["doc_id"], lists], ["doc_id", "ids"])

    return encode_rows


def _encoding(docs: DataFrame, vocabulary: str, id_column: str, text_column: str, head: int):
    """Rows (doc_id, text) and the function that encodes batches of them."""
    small_batches(docs.sparkSession)
    words = saved(distinct_words(docs, vocabulary, text_column), "bpe-words")
    frequent = head_of(words, head).mapInArrow(_encode_words(vocabulary), "word string, ids array<int>")
    frequent = frequent.toArrow()  # at most `head` rows
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return rows, _encode_documents(vocabulary, shared)


def encode(
    docs: DataFrame,
    vocabulary: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    head: int = HEAD,
) -> DataFrame:
    """One row per document: doc_id and ids, those of the tokenizers library without added tokens.

    Special strings in a text become their ids, as by the library's default. Null and empty texts have no
    ids (an empty array). Rows are encoded one by one: repeated ids give repeated rows, a null id stays
    null. Other columns are ignored; an empty table gives no rows.
    """
    rows, encode_rows = _encoding(docs, vocabulary, id_column, text_column, head)
    return rows.mapInArrow(encode_rows, "doc_id long, ids array<int>")


def _texts(ids: pa.ListArray, pieces: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts of lists of ids; bytes that are no UTF-8 become U+FFFD."""
    data, lengths = _gathered(pieces, ends, ids.flatten().to_numpy())
    offsets = _upto(lengths, np.diff(ids.offsets.to_numpy()).tolist())
    at = offsets.to_numpy()
    whole = data.tobytes()
    begins = at[:-1][at[:-1] < len(data)]
    try:
        whole.decode("utf-8")
        good = not ((data[begins] >= 0x80) & (data[begins] < 0xC0)).any()
    except UnicodeDecodeError:
        good = False
    if good:
        return pa.StringArray.from_buffers(len(ids), offsets.buffers()[1], pa.py_buffer(whole))
    return pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())


def _decode_rows(table):
    def decode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, ends = table.value
        for batch in batches:
            for part in _slices(batch):
                ids = part["ids"]
                if ids.null_count:
                    texts = _texts(pa.array([x or [] for x in ids.to_pylist()], ids.type), pieces, ends)
                    texts = pc.if_else(pc.is_valid(ids), texts, None)
                else:
                    texts = _texts(ids, pieces, ends)
                yield pa.RecordBatch.from_arrays([part["doc_id"], ids, texts], ["doc_id", "ids", "text"])

    return decode_rows


def _decoding(docs: DataFrame, vocabulary: str):
    """The function that decodes batches; the table of id and piece is sent to the tasks."""
    of_id = byte_bpe.load(vocabulary).pieces()
    table = [of_id.get(k, b"") for k in range(max(of_id) + 1)]
    pieces = np.frombuffer(b"".join(table), np.uint8), np.cumsum([len(p) for p in table])
    return _decode_rows(docs.sparkSession.sparkContext.broadcast(pieces))


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Rows (doc_id, ids) with the text of the ids, special tokens included.

    Each id is joined with its piece; the table of pieces is the vocabulary, whose size doesn't depend on
    the data. Bytes that are no UTF-8 become U+FFFD. Null ids give null, no ids an empty text.
    """
    return encoded.select("doc_id", "ids").mapInArrow(_decoding(encoded, vocabulary), DECODED)


def round_trip(
    docs: DataFrame,
    vocabulary: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    head: int = HEAD,
) -> DataFrame:
    """`decode` of `encode`, both steps in the same Python process of a task."""
    rows, encode_rows = _encoding(docs, vocabulary, id_column, text_column, head)
    decode_rows = _decoding(docs, vocabulary)
    return rows.mapInArrow(lambda batches: decode_rows(encode_rows(batches)), DECODED)
