"""The language model: gradients, windows and whole texts against plain versions of themselves."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import odd
import pyarrow as pa
import pytest

from snaplevel.llm import gru
from snaplevel.llm import language_model as lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + ["\n"]


def small(words=6, size=3, endings=2, state=4, seed=1):
    rng = np.random.default_rng(seed)
    w = gru.initial(rng.integers(1, 50, words + endings), words, size, state)
    return gru.Weights(*(a.astype(np.float64) + rng.normal(size=a.shape) * 0.3 for a in w.arrays()))


def plain(w, text):
    """log-probabilities of a text's tokens, one step after another."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    soft = lambda x: x - np.log(np.exp(x).sum())
    n, h, before, out = w.state, np.zeros(w.state), 0, []
    for token in text:
        given, inner = w.embed[before].astype(float), h @ w.recur
        z, r = sigmoid(given[:n] + inner[:n]), sigmoid(given[n : 2 * n] + inner[n : 2 * n])
        new = np.tanh(given[2 * n :] + r * (inner[2 * n :] + w.inner))
        h = (1 - z) * new + z * h
        kind = token // w.size if token < w.words else token - w.words + w.words // w.size
        log = soft(h @ w.to_class + w.class_bias)[kind]
        if token < w.words:
            log += soft(h @ w.to_word[kind] + w.word_bias[kind])[token % w.size]
        out.append(log)
        before = token
    return np.array(out)


def random_texts(n=23, tokens=8, longest=40):
    rng = np.random.default_rng(5)
    return [(k, rng.integers(0, tokens, rng.integers(1, longest) if k else 150).astype(np.int16)) for k in range(n)]


def test_probabilities_add_up_to_one():
    w = small()
    prefix = [3, 7, 1]
    total = 0.0
    for token in range(8):
        total += math.exp(plain(w, [*prefix, token])[-1])
    assert abs(total - 1) < 1e-12


def test_gradients_are_those_of_the_loss():
    w = small()
    batch = next(iter(lm.windows(random_texts(9, longest=6), 4, 7)))
    before, tokens, fresh, filled, *_ = batch
    filled = filled.copy()
    filled[-1, 0] = False
    h = np.random.default_rng(2).normal(size=(4, 4)).astype(np.float32)
    loss, found, _, seen = gru.gradients(w, before, tokens, fresh, filled, h)
    logs, _ = gru.log_likelihood(w, before, tokens, fresh, h)
    assert abs(loss + logs[filled].sum()) < 1e-3 * abs(loss)
    grads = found.arrays()
    grads[0] = np.zeros_like(w.embed)
    grads[0][seen] = found.embed
    rng = np.random.default_rng(3)
    for k, a in enumerate(w.arrays()):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in a.shape)
            change = []
            for step in (1e-2, -1e-2):
                moved = w.copy()
                moved.arrays()[k][at] += step
                change.append(gru.log_likelihood(moved, before, tokens, fresh, h)[0][filled].sum())
            slope = -(change[0] - change[1]) / 2e-2
            assert abs(slope - grads[k][at]) < 0.02 * max(1, abs(slope)), (k, at)


@pytest.mark.parametrize("lanes,steps", [(1, 5), (4, 7), (64, 3)])
def test_state_is_carried_across_windows(monkeypatch, lanes, steps):
    monkeypatch.setattr(lm, "SIDE_BY_SIDE", lanes)
    monkeypatch.setattr(lm, "AT_ONCE", steps)
    texts = random_texts()
    w = small()
    got = dict(lm.likelihoods(gru.Weights(*(a.astype(np.float32) for a in w.arrays())), iter(texts)))
    assert set(got) == set(range(len(texts)))
    for row, text in texts:
        assert abs(got[row] - plain(w, text).sum()) < 1e-3


def test_windows_hold_every_token_once():
    texts = random_texts()
    seen = {row: [] for row, _ in texts}
    for before, tokens, fresh, filled, spans, going, ended in lm.windows(iter(texts), 5, 9):
        assert filled.sum() == sum(stop - start for *_, start, stop in spans)
        for row, lane, start, stop in spans:
            assert fresh[start, lane] == (not seen[row])
            assert before[start, lane] == (seen[row][-1] if seen[row] else 0)
            seen[row] += tokens[start:stop, lane].tolist()
    assert all(seen[row] == text.tolist() for row, text in texts)


def test_windows_without_words_of_the_model():
    w = small()
    text = np.full(5, 6, np.int16)
    before, tokens, fresh, filled, *_ = next(lm.windows([(0, text)], 1, 5))
    h = np.zeros((1, 4), np.float32)
    loss, *_ = gru.gradients(w, before, tokens, fresh, filled, h)
    assert abs(loss + plain(w, text).sum()) < 1e-4
    assert abs(gru.log_likelihood(w, before, tokens, fresh, h)[0].sum() + loss) < 1e-4


def test_learning_beats_frequencies():
    text = np.array([1, 2, 3, 6, 4, 5, 7, 0] * 30, np.int16)
    texts = [(k, text) for k in range(20)]
    start = gru.initial(np.bincount(text, minlength=8) * 20, 6, 3, 8)
    learner, h = gru.Learner(start, 0.2), np.zeros((10, 8), np.float32)
    for before, tokens, fresh, filled, _, going, _ in lm.windows(iter(texts), 10, 16):
        _, h = learner.step(before, tokens, fresh, filled, h[going])
    assert plain(learner.weights, text).sum() > 0.5 * plain(start, text).sum()


def rows_and_expected():
    rows = odd.texts()
    held = {i for i, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 10 == 0}
    counts = Counter()
    for i, text, _ in rows:
        if i not in held:
            counts.update(tokens_of(text))
    return rows, held, counts


@pytest.mark.parametrize("head", [1 << 16, 1100])
def test_documents_equal_plain_version(spark, monkeypatch, head):
    rows, held, counts = rows_and_expected()
    total, distinct = sum(counts.values()), len(counts)
    kept = {}

    def untrained(texts, vocabulary, rounds=1):
        w = gru.initial(vocabulary.counts, lm.WORDS, lm.SIZE, lm.STATE)
        rng = np.random.default_rng(4)
        kept["w"] = gru.Weights(*((a + rng.normal(size=a.shape) * 0.1).astype(np.float32) for a in w.arrays()))
        kept["v"] = vocabulary
        return kept["w"]

    monkeypatch.setattr(lm, "train", untrained)
    monkeypatch.setattr(lm, "HEAD", head)
    got = lm.score_documents(odd.docs(spark, rows)).collect()
    assert len(got) == len(rows)

    first = sorted(counts, key=lambda t: (t != "\n", -counts[t], t.encode()))[: lm.WORDS]
    number = {t: k for k, t in enumerate(first)}
    rest = Counter()
    kinds = Counter()
    ending = lambda t: zlib.crc32(t.encode()[-2:]) % lm.ENDINGS
    for t, n in counts.items():
        if t not in number:
            rest[ending(t)] += n
            kinds[ending(t)] += 1
    want = []
    for i, text, _ in rows:
        tokens = tokens_of(text)
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens)
        numbers = [number.get(t, lm.WORDS + ending(t)) for t in tokens]
        score = plain(kept["w"], numbers).sum() / math.log(10)
        for t in tokens:
            if t not in number:
                k = ending(t)
                score += math.log10((counts[t] + 0.1) / (rest[k] + 0.1 * (kinds[k] + 1)))
        known = sum(counts[t] > 0 for t in tokens)
        want.append((i, i in held, len(tokens), known, total, base, score))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 3), r[6])
    for a, b in zip(sorted((tuple(r) for r in got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])) and abs(a[6] - b[6]) < 1e-4 * max(1, abs(b[6]))


def test_trained_model_is_better_on_held_out_texts(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(400):
        words = [f"{'ab'[k % 2]}{x}" for x in rng.integers(0, 60, 60)]
        rows.append((k, " ".join(words), "s"))
    got = [r for r in lm.score_documents(odd.docs(spark, rows)).collect() if r["held_out"]]
    assert len(got) > 20
    assert sum(r["score"] for r in got) > 0.95 * sum(r["base_score"] for r in got)


def test_no_documents_and_no_training_documents(spark):
    assert lm.score_documents(odd.docs(spark, [])).collect() == []
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = lm.score_documents(odd.docs(spark, [(alone, "Two words", "s")])).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (True, 3, 0, 0)
    assert abs(r["base_score"]) < 1e-9 and r["score"] < 0


def batch_of(texts):
    n = len(texts)
    columns = [pa.array(range(n)), pa.array(range(n)), pa.array([True] * n), pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "text"])


@pytest.mark.parametrize("size", [1 << 22, 12])
def test_rare_words_are_counted_for_each_text(monkeypatch, size):
    monkeypatch.setattr(lm, "BYTES", size)
    v = lm.Vocabulary([(b"\n", 2), (b"a", 5)], 7, 2, np.zeros(lm.ENDINGS), np.zeros(lm.ENDINGS))
    shared = type("Shared", (), {"value": v})
    texts = [" ".join(f"w{k % 20} A" for k in range(50)), "", "b", "a", "b  c\tb"]
    rare, main = Counter(), {}
    for r in (r for out in lm._encode(shared)(iter([batch_of(texts)])) for r in out.to_pylist()):
        if r["tokens"] is None:
            rare.update({(r["row"], w): n for w, n in zip(r["rare"], r["times"], strict=True)})
        else:
            main[r["row"]] = r
    assert rare == Counter((k, w) for k, t in enumerate(texts) for w in t.lower().split() if w != "a")
    assert [(main[k]["n_tokens"], main[k]["n_known"]) for k in range(5)] == [(101, 51), (1, 1), (2, 1), (2, 2), (4, 1)]
    for k, t in enumerate(texts):
        want = [1 if w == "a" else lm.WORDS + lm.ending(w.encode()) for w in t.lower().split()] + [0]
        assert np.frombuffer(main[k]["tokens"], np.int16).tolist() == want


def test_words_equal_plain_split(monkeypatch):
    texts = ["", " ", "Ab\tcD  é\n", "x", "y z", "x" * 70 + " q\x0bw\x0ce\rr ", "É ß \U0001f600"] * 3
    for size in (1 << 22, 16, 5):
        monkeypatch.setattr(lm, "BYTES", size)
        found = {k: [] for k in range(len(texts))}
        for row, words, counts in lm.words_of(pa.array(texts).cast(pa.binary()).slice(0)):
            assert counts.sum() == len(words)
            for k, part in enumerate(np.split(np.array(words.to_pylist(), object), np.cumsum(counts)[:-1])):
                found[row + k] += list(part)
            if len(words):
                assert lm.endings_of(words).tolist() == [lm.ending(w) for w in words.to_pylist()]
        assert all(found[k] == [w.encode() for w in tokens_of(t)[:-1]] for k, t in enumerate(texts))


def test_words_are_counted_with_ends():
    sums = Counter()
    for out in lm.count_words(iter([batch_of(["a b A", "", "c"]), batch_of([" b "])])):
        for r in out.to_pylist():
            sums[r["word"]] += r["n"]
    assert sums == {"a": 2, "b": 2, "c": 1, "\n": 4}


def test_large_logits_are_shifted():
    logits = np.array([[0.0, 200.0, 199.0], [-300.0, -301.0, -500.0]], np.float32)
    got = gru._shares(logits.copy(), np.array([1, 0]))
    assert np.allclose(got, -np.log1p(np.exp(-1.0)), atol=1e-5)


