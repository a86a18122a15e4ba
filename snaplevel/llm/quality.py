"""A quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

The features of a text are its words and pairs of neighbouring words, as they are and as shapes (letters by
case, digits, other characters; runs as one), hashed into 2^BITS weights; each counts by its share of all.
A score is a sparse dot product of shares and weights.

Training takes a sample of labelled documents of bounded size, dealt out to a fixed number of learners. Each
goes through its share in a fixed order with one update per document (FTRL-proximal with per-coordinate rates),
and their weights are averaged. Scoring reads all documents in one scan, with the weights as the only
broadcast, whose size is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplevel.llm.common import small_batches
from snaplevel.llm.hashing import U64, ngrams, word_groups

BITS, LEARNERS, EPOCHS = 18, 8, 3
#: Labelled documents that are learned from, about; more are thinned out by a hash of their id.
SAMPLE = 20_000
#: Rate, smoothing and penalties of the updates; what shares are multiplied with.
ALPHA, BETA, L1, L2, SCALE = 0.5, 1.0, 0.02, 0.1, 10.0
_SALTS = [U64(0x51ED270B0B45A3C1), U64(0x8CB92BA72F3D8DD7), U64(0xABC98388FB8FAC03), U64(0x2545F4914F6CDD1D)]


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """The row and the hashed n-grams of each text."""
    shift = U64(64 - BITS)
    for row, stop, words, shape, counts in word_groups(texts, shapes=True):
        with np.errstate(over="ignore"):
            same = np.zeros(len(words), U64)
            same[:-1] = words[:-1] == words[1:]
            pairs, shape_pairs = ngrams(words, 2), ngrams(shape, 2)
            shape_pairs = shape_pairs ^ (same[: len(shape_pairs)] * _SALTS[0])
            kinds = zip((words, shape, pairs, shape_pairs), _SALTS, strict=True)
            parts = [((x * salt) >> shift).astype(np.int32) for x, salt in kinds]
        end = 0
        for k in range(row, stop):
            start, end = end, end + int(counts[k - row])
            one, two = slice(start, end), slice(start, max(start, end - 1))
            yield k, np.concatenate([parts[0][one], parts[1][one], parts[2][two], parts[3][two]])


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def learn(examples: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """Weights of 2^BITS features and the bias from (hashed n-grams, label), in their order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    sparse = []
    for grams, label in examples:
        at, count = np.unique(grams, return_counts=True)
        share = count * (SCALE / max(1, len(grams)))
        sparse.append((np.append(at, np.int32(1 << BITS)), np.append(share, 1.0).astype(np.float32), label))
    for _ in range(EPOCHS):
        for at, x, label in sparse:
            w = _weights(z[at], n[at])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return _weights(z, n).astype(np.float32)


def _learner(share: pa.Table) -> pa.Table:
    share = share.sort_by([("place", "ascending"), ("id", "ascending")]).combine_chunks()
    labels = share["label"].to_pylist()
    examples = []
    for chunk in share["text"].chunks:
        start = len(examples)
        examples += [(grams, labels[start + k]) for k, grams in features(chunk)]
    return pa.table({"n": [len(examples)], "weights": [learn(examples).tobytes()]})


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    sample: int = SAMPLE,
    seed: int = 4,
) -> np.ndarray:
    """Weights learned from the labelled documents, the bias last; zeros where there are none.

    Rows without a label are left out. An id with several labels counts with their mean, one with several
    texts with one of them, by the order of their hashes. About `sample` labels are used, by a hash of the id.
    """
    known = labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
    known = known.groupBy(F.col(id_column).alias("id")).agg(F.avg(label_column).alias("label"))
    total = known.count()
    place = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30))
    known = known.filter(place < int((1 << 30) * min(1.0, sample / max(1, total))))
    texts = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    texts = texts.join(F.broadcast(known), "id")  # at most about `sample` rows of two numbers
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("text"))).alias("one")
    texts = texts.groupBy("id", "label").agg(one).select("id", "label", F.coalesce("one.text", F.lit("")).alias("text"))
    dealt = texts.withColumn("place", F.xxhash64("id", F.lit(seed + 1)))
    dealt = dealt.groupBy(F.pmod("place", F.lit(LEARNERS)).alias("learner"))
    found = dealt.applyInArrow(_learner, "n long, weights binary").collect()  # one row for each learner
    if not found:
        return np.zeros((1 << BITS) + 1, np.float32)
    found.sort(key=lambda r: r["weights"])
    share = np.array([r["n"] for r in found], float)
    return (share @ np.stack([np.frombuffer(r["weights"], np.float32) for r in found]) / share.sum()).astype(np.float32)


def scores_of(texts: pa.Array, w: np.ndarray) -> np.ndarray:
    total = np.full(len(texts), w[-1])
    for k, grams in features(texts):
        if len(grams):
            total[k] += SCALE * w[grams].mean()
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def accepted(docs: DataFrame, weights: np.ndarray, *, text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents that score at least the threshold, with all their columns; see `score`."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        for batch in batches:
            yield batch.filter(pa.array(scores_of(batch[text_column], w) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def score(
    docs: DataFrame,
    weights: np.ndarray,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    threshold: float = 0.3,
) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 if score >= threshold, else 0).

    Only the text decides. Null, empty and blank texts have no n-grams; their score is that of the bias.
    Repeated rows are scored alike; a null id stays null. Other columns are ignored; an empty table gives
    no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores_of(batch["text"], w))], ["doc_id", "score"])

    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), F.coalesce(docs[text_column], F.lit("")).alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(id_column: Column) -> Column:
    """Whether an id is set aside for testing: one in five, by the CRC-32 of its decimal form."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))
