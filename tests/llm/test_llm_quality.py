from __future__ import annotations

import random

import numpy as np
import odd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snaplevel.llm import hashing, quality


def corpus(n=600):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        text = odd.prose(rng, rng.randrange(20, 200))
        rows.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split()), "s"))
        labels.append((i, int(good), 0))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark):
    rows, labels = corpus()
    docs = odd.docs(spark, rows)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, labels, quality.train(docs, labels.filter(~quality.held_out(F.col("doc_id"))))


def test_held_out_accuracy(trained):
    docs, labels, weights = trained
    scored = quality.score(docs, weights).join(labels, "doc_id").filter(quality.held_out(F.col("doc_id")))
    total, right = scored.agg(F.count("*"), F.sum((F.col("predicted") == F.col("quality")).cast("int"))).first()
    assert total > 80 and right / total > 0.97


def test_training_is_repeatable_and_bounded(trained):
    docs, labels, weights = trained
    known = labels.filter(~quality.held_out(F.col("doc_id")))
    assert np.array_equal(quality.train(docs.repartition(3), known), weights)
    assert not np.array_equal(quality.train(docs, known, sample=100), weights)


def test_odd_rows_and_labels(spark, trained):
    _, _, weights = trained
    docs = odd.docs(spark)
    got = quality.score(docs, weights)
    assert got.count() == docs.count() and got.filter("score is null or score < 0 or score > 1").isEmpty()
    bias = {r["doc_id"]: r["score"] for r in got.filter("doc_id in (300, 301, 302)").collect()}
    assert len(set(bias.values())) == 1
    assert got.filter("doc_id = 5").select("score").distinct().count() == 2
    labels = spark.createDataFrame([(1, None), (None, 1), (5, 1), (5, 0), (300, 1), (999, 0)], "doc_id long, quality int")
    assert quality.train(docs, labels).shape == ((1 << quality.BITS) + 1,)


def test_empty_tables(spark, trained):
    _, labels, weights = trained
    none = odd.docs(spark, [])
    assert quality.score(none, weights).count() == 0
    assert not quality.train(none, labels).any()


def test_accepted_keeps_all_columns(trained):
    docs, labels, weights = trained
    kept = quality.accepted(docs, weights)
    want = quality.score(docs, weights).filter("predicted = 1")
    assert kept.columns == docs.columns
    assert odd.rows_of(kept, "doc_id") == odd.rows_of(want, "doc_id")


def test_scores_are_sparse_dot_products(trained):
    _, _, weights = trained
    texts = pa.array(["A b!! c c", "x"])
    for k, grams in quality.features(texts):
        at, n = np.unique(grams, return_counts=True)
        total = weights[-1] + sum(float(weights[a]) * c * quality.SCALE / len(grams) for a, c in zip(at.astype(int), n, strict=True))
        assert quality.scores_of(texts, weights.astype(float))[k] == pytest.approx(1 / (1 + np.exp(-total)))


def test_words_of_many_texts_and_of_cut_ones(monkeypatch):
    rng = random.Random(4)
    texts = ["", None, " \t", *(" ".join(odd.words(rng, rng.randrange(0, 60))) for _ in range(60)), "é中 É", "x" * 300]
    whole = {k: g for k, g in enumerate(texts)}

    def hashes():
        out = []
        for row, stop, words, shape, counts in hashing.word_groups(pa.array(texts), lower=True, shapes=True):
            assert len(words) == len(shape) == counts.sum() and len(counts) == stop - row
            ends = np.cumsum(counts)
            out += [words[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)]
        return out

    first = hashes()
    assert [len(x) for x in first] == [len((t or "").split()) for t in texts]
    known = {}
    for k, t in whole.items():
        for w, h in zip((t or "").lower().split() if k < 63 else [], first[k], strict=False):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    monkeypatch.setattr(hashing, "AT_ONCE", 64)
    assert hashes() == first
    sliced = pa.array(texts).slice(5, 10)
    assert sum(int(c.sum()) for *_, c in hashing.word_groups(sliced)) == sum(len(t.split()) for t in texts[5:15])
