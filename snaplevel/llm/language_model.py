"""Scores of a gated recurrent language model: log10 probabilities of whole texts.

Every word of the training texts is counted, whatever their number. The `WORDS` most frequent tokens are words of the
model, `SIZE` to a class; all others fall into classes by their last two bytes, and within such a class a word has its
share of the counts. So a token's probability is that of its class, from the recurrent state, times that of the word in its
class, from the state for frequent words and from the counts for all others, unseen ones included.

The model learns from all training texts in one pass (truncated backpropagation, `gru`): each partition goes
on from the same weights, the weights are averaged by tokens, and the next share of the texts goes on from there. Texts
are scored whole, many side by side, with the state carried from window to window until a text ends.

Tables that grow with the data stay tables: counts of rarer words are joined to the texts' rare words. What is broadcast has a
fixed size: the weights and the `HEAD` most frequent words.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplevel.llm import gru
from snaplevel.llm.common import saved, small_batches
from snaplevel.llm.hashing import LOWER, SPACE

#: Words of the model, of each of its classes; classes of other words; size of the state.
WORDS, SIZE, ENDINGS, STATE = 1024, 64, 32, 16
#: Most frequent words whose counts are looked up in a broadcast table; others are joined.
HEAD = 1 << 16
#: Averages of the weights; texts that learn side by side; steps that an error flows back; tokens of a training segment; rate.
ROUNDS, LANES, STEPS, SEGMENT, RATE = 4, 512, 32, 1024, 0.3
#: Steps of learning that a task makes in a round at least, if it has the texts; then fewer learn side by side.
LEAST_STEPS = 32
#: Texts that are scored side by side, steps at a time, tokens that are sorted by length at a time.
SIDE_BY_SIDE, AT_ONCE, SORTED = 512, 32, 1 << 24
#: Smoothing of the counts; bytes of texts split at a time, and of words counted at a time.
ADD, BYTES, HELD = 0.1, 1 << 22, 1 << 25

END = b"\n"


def _spans(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """First and last row, first and last byte of groups of texts of about BYTES; a longer text is cut at white space."""
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BYTES, "right")) - 1)
        start, end = int(offsets[row]), int(offsets[stop])
        while stop == row + 1 and end - start > BYTES:
            cut = start + BYTES
            while cut < end and not SPACE[data[cut]]:
                cut += 1
            yield row, stop, start, cut
            start = cut
        yield row, stop, start, end
        row = stop


def words_of(texts: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Groups of texts: the first row, all words as one array, and the number of words of each row.

    Of a long text there are several groups of one row. The words are not made one by one: the bytes that are no white
    space, side by side, are the values of an Arrow array whose offsets are the ends of the words.
    """
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    for row, stop, start, end in _spans(offsets, data):
        part = LOWER[data[start:end]]
        space = SPACE[part]
        bounds = np.clip(offsets[row : stop + 1], start, end) - start
        first = np.ones(len(part) + 1, bool)
        first[1:-1] = space[:-1]
        first[bounds] = True
        starts = np.flatnonzero(~space & first[:-1])
        kept = np.zeros(len(part) + 1, np.int64)
        np.cumsum(~space, out=kept[1:])
        ends = np.append(kept[starts], kept[-1]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(part[~space])])
        yield row, words, np.diff(np.searchsorted(starts, bounds))


@functools.cache
def _endings() -> tuple[np.ndarray, np.ndarray]:
    """The classes of words by their last byte, if it is the only one, and by their last two."""
    one = np.array([ending(bytes([b])) for b in range(256)], np.int16)
    two = np.array([ending(bytes([a, b])) for a in range(256) for b in range(256)], np.int16)
    return one, two


def endings_of(words: pa.Array) -> np.ndarray:
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8).astype(np.int64)
    one, two = _endings()
    last = data[ends[1:] - 1]
    pair = two[data[np.maximum(ends[1:] - 2, 0)] * 256 + last]
    return np.where(np.diff(ends) > 1, pair, one[last])


def ending(word: bytes) -> int:
    """The class of a word that is not one of the model's."""
    return zlib.crc32(word[-2:]) % ENDINGS


def _ending(word: str) -> Column:
    data = F.col(word).cast("binary")
    return F.crc32(F.when(F.octet_length(data) > 2, F.substring(data, -2, 2)).otherwise(data)) % ENDINGS


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of the words of a task's texts, group by group; every text has one end."""
    names, n_texts = ["word", "n"], 0
    held: list[pa.Array] = []

    def sent() -> pa.RecordBatch:
        found = pc.value_counts(pa.chunked_array(held, pa.binary()))
        held.clear()
        return pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names)

    for batch in batches:
        n_texts += batch.num_rows
        for _, words, _ in words_of(batch["text"].cast(pa.binary())):
            held.append(words)
            if sum(w.nbytes for w in held) > HELD:
                yield sent()
    yield sent()
    yield pa.RecordBatch.from_arrays([pa.array([END.decode()]), pa.array([n_texts])], names)


class Vocabulary:
    """The model's words, the counts of the frequent ones, and what all the others add up to.

    head: (word, count) of the most frequent ones, by descending count, at most HEAD of them; the sums and numbers of the
    words of each ending class are over all words but the model's.
    """

    def __init__(self, head: list[tuple[bytes, int]], total: int, distinct: int, sums: np.ndarray, kinds: np.ndarray):
        self.total, self.distinct = total, distinct
        self.words = pa.array([w for w, _ in head], pa.binary())
        self.has_end = bool(head) and head[0][0] == END
        counts = np.array([n for _, n in head], np.float64)
        self.token = np.array([k if k < WORDS else WORDS + ending(w) for k, (w, _) in enumerate(head)], np.int16)
        #: log10 of a token of the base model less its numerator; of a word within its ending class likewise.
        self.base_over = np.log10(total + ADD * (distinct + 1))
        self.class_over = np.log10(sums + ADD * (kinds + 1))
        self.base = np.log10(counts + ADD) - self.base_over
        self.within = np.where(self.token < WORDS, 0.0, np.log10(counts + ADD) - self.class_over[np.maximum(self.token - WORDS, 0)])
        self.counts = np.concatenate([np.zeros(WORDS), sums])
        self.counts[: min(WORDS, len(head))] = counts[:WORDS]


def _most_frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The end, and the words that are more frequent than some bound, at most HEAD, the most frequent first.

    The bound comes from the numbers of words by ranges of their counts, so that no more rows than these are sent.
    """
    range_of = F.floor(F.log2("n") * 64).cast("int")
    ranges = counts.groupBy(range_of.alias("range")).agg(F.count("*").alias("words")).collect()  # some 64 for every doubling
    bound, total = None, 0
    for r in sorted(ranges, key=lambda r: -r["range"]):
        total += r["words"]
        if total > HEAD:
            break
        bound = r["range"]
    is_end = F.col("word") == END.decode()
    head = counts.filter(is_end | (range_of >= bound)) if bound is not None else counts.filter(is_end)
    found = {r["word"].encode(): r["n"] for r in head.collect()}
    if len(found) < WORDS:  # ties: as many as the model needs
        found.update({r["word"].encode(): r["n"] for r in counts.orderBy(F.col("n").desc(), "word").limit(WORDS - 1).collect()})
    return sorted(found.items(), key=lambda x: (x[0] != END, -x[1], x[0]))


def _vocabulary(counts: DataFrame) -> Vocabulary:
    """Of the counts of all words: a row of sums, ENDINGS rows of sums, and the most frequent ones."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = _most_frequent(counts)
    ends = counts.groupBy(_ending("word").alias("ending")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    sums, kinds = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in ends.collect():
        sums[r["ending"]], kinds[r["ending"]] = r["n"], r["kinds"]
    for word, n in head[:WORDS]:
        sums[ending(word)] -= n
        kinds[ending(word)] -= 1
    return Vocabulary(head, total, distinct, sums, kinds)


_KEPT = ["row", "doc_id", "held_out"]
_ENCODED = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, within double, "
    "tokens binary, rare array<string>, times array<long>"
)


def _encode(shared):
    """A row per text with its tokens, and rows without tokens that hold rare words of a text.

    The scores lack the numerators of the rare words, which are not in the vocabulary's head.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        end = 0 if v.has_end else WORDS + ending(END)
        for batch in batches:
            n = batch.num_rows
            rows = batch["row"].to_numpy()
            lengths, known, base, within = (np.zeros(n) for _ in range(4))
            parts, others = [], []
            for row, words, counts in words_of(batch["text"].cast(pa.binary())):
                at = pc.index_in(words, value_set=v.words)
                missing = at.is_null().to_numpy(zero_copy_only=False)
                at = at.fill_null(0).to_numpy()
                row_of = np.repeat(np.arange(row, row + len(counts)), counts)
                there = ~missing
                of, mine = row_of[there], at[there]
                tokens = np.empty(len(words), np.int16)
                tokens[there] = v.token[mine]
                lengths[row : row + len(counts)] += counts
                known += np.bincount(of, minlength=n)
                base += np.bincount(of, v.base[mine], n)
                within += np.bincount(of, v.within[mine], n)
                if missing.any():
                    rare, of = words.filter(pa.array(missing)), row_of[missing]
                    kinds = endings_of(rare)
                    tokens[missing] = WORDS + kinds
                    base -= np.bincount(of, minlength=n) * v.base_over
                    within -= np.bincount(of, v.class_over[kinds], n)
                    others.append(_counted(rows, of, rare))
                parts.append(tokens)
            if v.has_end:
                known += 1
                base += v.base[0]
                within += v.within[0]
            else:
                base -= v.base_over
                within -= v.class_over[ending(END)]
                others.append(_counted(rows, np.arange(n), pa.array([END] * n, pa.binary())))
            flat = np.concatenate([*parts, np.zeros(0, np.int16)])
            stops = np.cumsum(lengths).astype(np.int64)
            last = np.array([end], np.int16).tobytes()
            blobs = [flat[stop - int(k) : stop].tobytes() + last for k, stop in zip(lengths, stops, strict=True)]
            whole = [pa.array((lengths + 1).astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(within), pa.array(blobs, pa.binary())]
            nothing = [pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in _KEPT), *whole, *nothing], _NAMES)
            yield from others

    return encode


_NAMES = [*_KEPT, "n_tokens", "n_known", "base", "within", "tokens", "rare", "times"]


def _counted(rows: np.ndarray, of: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    """A row for each text of a group, with its rare words and their numbers."""
    coded = words.dictionary_encode()
    size = max(1, len(coded.dictionary))
    pairs, times = np.unique(of.astype(np.int64) * size + coded.indices.to_numpy(), return_counts=True)
    texts, code = pairs // size, pairs % size
    first = np.flatnonzero(np.diff(texts, prepend=-1))
    ends = pa.array(np.append(first, len(texts)).astype(np.int32))
    found = [pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(code)).cast(pa.string())), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64)))]
    k = len(first)
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(rows[texts[first]]), *(pa.nulls(k, t) for t in kinds), *found], _NAMES)


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for row, tokens in zip(batch["row"].to_pylist(), batch["tokens"], strict=True):
            yield row, np.frombuffer(tokens.as_py(), np.int16)


def windows(
    texts: Iterable[tuple[int, np.ndarray]], lanes: int, steps: int, end: int = 0
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int, int]], list[int]]]:
    """Texts dealt out to lanes, each taking the next one when its own ends, cut into windows of some steps.

    Yields the tokens before (an end before the first), the tokens, where texts begin, which places are filled, (row, lane, start, stop) of
    the texts in the window, the lanes of the window before that go on in this one, and the rows that end here.
    """
    waiting = iter(texts)
    now: list[tuple[int, np.ndarray, int]] = []
    for row, text in waiting:
        now.append((row, text, 0))
        if len(now) == lanes:
            break
    going = list(range(len(now)))
    while now:
        before = np.full((steps, len(now)), end, np.int16)
        tokens = np.full((steps, len(now)), end, np.int16)
        fresh, filled = np.zeros(tokens.shape, bool), np.zeros(tokens.shape, bool)
        spans, ended = [], []
        left: list[tuple[int, np.ndarray, int] | None] = []
        for lane, (row, text, at) in enumerate(now):
            t, rest = 0, (row, text, at)
            while rest is not None and t < steps:
                row, text, at = rest
                n = min(steps - t, len(text) - at)
                tokens[t : t + n, lane] = text[at : at + n]
                if at:
                    before[t : t + n, lane] = text[at - 1 : at + n - 1]
                else:
                    fresh[t, lane] = True
                    before[t + 1 : t + n, lane] = text[: n - 1]
                spans.append((row, lane, t, t + n))
                t, at = t + n, at + n
                rest = (row, text, at)
                if at == len(text):
                    ended.append(row)
                    following = next(waiting, None)
                    rest = None if following is None else (*following, 0)
            filled[:t, lane] = True
            left.append(rest)
        yield before, tokens, fresh, filled, spans, going, ended
        going = [k for k, x in enumerate(left) if x is not None]
        now = [left[k] for k in going]


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for row, text in _texts(batches):
        for start in range(0, len(text), SEGMENT):
            yield row, text[start : start + SEGMENT]


def _lanes(segments: Iterator[tuple[int, np.ndarray]]) -> tuple[int, Iterator[tuple[int, np.ndarray]]]:
    """How many segments learn side by side, and all of the segments."""
    first, n = [], 0
    for segment in segments:
        first.append(segment)
        n += len(segment[1])
        if n >= LANES * STEPS * LEAST_STEPS:
            break
    return min(LANES, max(8, n // (STEPS * LEAST_STEPS))), itertools.chain(first, segments)


def _learn(shared):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, n = gru.Learner(shared.value, RATE), 0
        lanes, segments = _lanes(_segments(batches))
        h = np.zeros((lanes, learner.weights.state), np.float32)
        for before, tokens, fresh, filled, _, going, _ in windows(segments, lanes, STEPS):
            _, h = learner.step(before, tokens, fresh, filled, h[going])
            n += int(filled.sum())
        if n:
            flat = learner.weights.flat().astype(np.float64) * n
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([flat.tobytes()])], ["n", "sums"])

    return learn


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, sums = 0, None
    for batch in batches:
        for n, more in zip(batch["n"].to_pylist(), batch["sums"], strict=True):
            more = np.frombuffer(more.as_py(), np.float64)
            total, sums = total + n, more if sums is None else sums + more
    if sums is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([sums.tobytes()])], ["n", "sums"])


def average(learned: DataFrame) -> np.ndarray | None:
    """The mean of the weights by tokens, added up by 256 tasks, then 4, which hold one sum each."""
    learned = saved(learned, "language-model-learned")
    for tasks in (256, 4):
        learned = learned.repartition(tasks).mapInArrow(_added, "n long, sums binary")
    parts = sorted(((r["n"], bytes(r["sums"])) for r in learned.collect()), key=lambda x: x[1])  # 4 rows at most
    if not parts:
        return None
    return np.sum([np.frombuffer(x, np.float64) for _, x in parts], axis=0) / sum(n for n, _ in parts)


def train(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> gru.Weights:
    """Weights learned from all rows (row, tokens) in one pass, a share of them in every round."""
    weights = gru.initial(vocabulary.counts, WORDS, SIZE, STATE)
    spark = texts.sparkSession
    for k in range(rounds):
        share = texts.filter(F.pmod(F.xxhash64("row"), F.lit(rounds)) == k)
        mean = average(share.mapInArrow(_learn(spark.sparkContext.broadcast(weights)), "n long, sums binary"))
        if mean is not None:
            weights = weights.from_flat(mean)
    return weights


def likelihoods(weights: gru.Weights, texts: Iterable[tuple[int, np.ndarray]]) -> Iterator[tuple[int, float]]:
    """(row, natural logarithm of the probability of its tokens and their classes) of every text."""
    total: dict[int, float] = {}
    h = np.zeros((SIDE_BY_SIDE, weights.state), np.float32)
    for before, tokens, fresh, _, spans, going, ended in windows(texts, SIDE_BY_SIDE, AT_ONCE):
        logs, h = gru.log_likelihood(weights, before, tokens, fresh, h[going])
        sums = np.zeros((len(logs) + 1, logs.shape[1]))
        np.cumsum(logs, axis=0, out=sums[1:])
        rows, lane, start, stop = zip(*spans, strict=True)
        lane = list(lane)
        for row, x in zip(rows, (sums[list(stop), lane] - sums[list(start), lane]).tolist(), strict=True):
            total[row] = total.get(row, 0.0) + x
        for row in ended:
            yield row, total.pop(row)


def _longest_first(texts: Iterator[tuple[int, np.ndarray]]) -> Iterator[Iterator[tuple[int, np.ndarray]]]:
    """Groups of texts of about SORTED tokens, the longest first, so that none is left alone for long."""
    group, n = [], 0
    for text in texts:
        group.append(text)
        n += len(text[1])
        if n >= SORTED:
            yield iter(sorted(group, key=lambda x: -len(x[1])))
            group, n = [], 0
    yield iter(sorted(group, key=lambda x: -len(x[1])))


def _score(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _longest_first(_texts(batches)):
            found = list(likelihoods(shared.value, group))
            rows, logs = [r for r, _ in found], np.array([x for _, x in found]) / np.log(10)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(logs, pa.float64())], ["row", "log"])

    return score


def held_out(id_column: Column) -> Column:
    """Whether an id is set aside: one in ten, by the CRC-32 of its decimal form; a null id is not."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def score_documents(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    aside: Callable[[Column], Column] = held_out,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the text (runs of anything but ASCII white space, A-Z lower-cased), then one end.
    Documents whose id `aside` holds out are scored, not learned from. With a token's count c in the training
    texts, N of all, V distinct ones, base_score sums log10((c + 0.1) / (N + 0.1 (V + 1))) and n_known tells how many
    tokens have a count; score is the log10 of the model's probability of the text.

    Null texts count as empty: one end. Repeated rows are documents of their own, learned from and scored each. Without training documents
    nothing has a count and the model is the initial one. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs[id_column].cast("long").alias("doc_id"),
        aside(docs[id_column]).alias("held_out"),
        F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"),
    )
    counts = rows.filter(~F.col("held_out")).select("text").mapInArrow(count_words, "word string, n long")
    counts = saved(counts.groupBy("word").agg(F.sum("n").alias("n")), "language-model-counts")
    vocabulary = _vocabulary(counts)
    shared = spark.sparkContext.broadcast(vocabulary)
    encoded = saved(rows.mapInArrow(_encode(shared), _ENCODED), "language-model-texts")
    texts = encoded.filter("tokens is not null")
    weights = train(texts.filter(~F.col("held_out")).select("row", "tokens"), vocabulary)
    model = texts.select("row", "tokens").mapInArrow(_score(spark.sparkContext.broadcast(weights)), "row long, log double")

    rare = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("one")).select("row", "one.rare", "one.times")
    numerator = F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADD))
    rare = rare.join(counts, F.col("rare") == F.col("word"), "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("rare_known"),
        F.sum(F.col("times") * numerator).alias("rare_log"),
    )
    out = texts.drop("tokens", "rare", "times").join(model, "row").join(rare, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("rare_known")).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_log")).alias("base_score"),
        (F.col("log") + F.col("within") + zero("rare_log")).alias("score"),
    )
