"""Every query with SQL equals it; the pipeline's stages equal plain versions of themselves."""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import pytest
import tokenizers
from compare import differences, duck
from conftest import TESTDATA

import corpus_pipeline
from pyspark.sql import functions as F
from snaplevel.llm import fingerprints, mixing, ngram_join
from snaplevel.llm.common import read
from snaplevel.llm.queries import BYTE_BPE, ORACLES, QUERIES, vocabulary

FOLDER = f"{TESTDATA}/sf{os.environ.get('TEST_SF', '0.001')}"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_over_all_documents(spark, name):
    got = QUERIES[name](spark, FOLDER)
    assert got.count() == read(spark, FOLDER, "documents").count()


def texts_of(spark):
    return {r["doc_id"]: r["text"] or "" for r in read(spark, FOLDER, "documents").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_registered_tokens_equal_the_library(spark):
    """op5 and op8 as registered, on every document."""
    library = tokenizers.Tokenizer.from_file(vocabulary(BYTE_BPE))
    library.no_padding()
    library.no_truncation()
    texts = texts_of(spark)
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    for r in QUERIES["op5_bpe_encoding"](spark, FOLDER).collect():
        mine = ids[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(mine), sha(",".join(map(str, mine))))
        assert r["decoded_sha256"] == sha(library.decode(mine, skip_special_tokens=False))
    for r in QUERIES["op8_token_counts"](spark, FOLDER).collect():
        n = len(ids[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 1024)


def test_registered_fingerprints_equal_those_of_columns(spark):
    texts = texts_of(spark)
    order = sorted(texts, reverse=True)
    edited = {}
    for k, i in enumerate(order):
        half, following = len(texts[i]) // 2, texts[order[(k + 1) % len(order)]]
        edited[i] = texts[i][: len(texts[i]) - half] + following[:half]
    rows = spark.createDataFrame([(i, texts[i], edited[i]) for i in order], "i long, a string, b string")
    want = {
        r["i"]: r for r in rows.select("i", *(fingerprints.as_text(fingerprints.fingerprint(F.col(c))).alias(f"of_{c}") for c in "ab")).collect()
    }
    got = QUERIES["op6_fingerprints"](spark, FOLDER).collect()
    assert len(got) == len(texts)
    for r in got:
        i = r["doc_id"]
        assert (r["n_chars"], r["edited_sha256"]) == (len(texts[i]), sha(edited[i]))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (want[i]["of_a"], want[i]["of_b"])


def test_registered_scores(spark):
    """Folds and thresholds of op4; the folds and counts of op13, and that its model tells more than the counts."""
    crc = {i: zlib.crc32(str(i).encode()) for i in texts_of(spark)}
    for r in QUERIES["op4_quality_classifier"](spark, FOLDER).collect():
        assert r["held_out"] == (crc[r["doc_id"]] % 5 == 0) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.3)
    tokens = {i: lm_tokens(t) for i, t in texts_of(spark).items()}
    counts = Counter(t for i, w in tokens.items() if crc[i] % 10 for t in w)
    total, gained = sum(counts.values()), 0.0
    for r in QUERIES["op13_lm_scoring"](spark, FOLDER).collect():
        w = tokens[r["doc_id"]]
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (len(counts) + 1))) for t in w)
        assert r["held_out"] == (crc[r["doc_id"]] % 10 == 0) and r["train_tokens"] == total
        assert (r["n_tokens"], r["n_known"]) == (len(w), sum(counts[t] > 0 for t in w))
        assert abs(r["base_score"] - base) < 1e-6 * abs(base)
        gained += r["score"] - r["base_score"] if r["held_out"] else 0
    assert gained > 0


def lm_tokens(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(lower)) + ["\n"]


def test_pipeline(spark):
    docs = read(spark, FOLDER, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, FOLDER).cache()
        kept[name] = (before, docs)
        assert docs.count()
    columns = read(spark, FOLDER, "documents").columns
    assert all(after.columns == columns for _, after in list(kept.values())[:-1])
    before, after = kept["n-gram Jaccard join"]
    parts = ngram_join.near_duplicates(before)
    assert after.count() == parts.select("component_id").distinct().count()
    assert ngram_join.near_duplicates(after).groupBy("component_id").count().filter("count > 1").isEmpty()
    before, after = kept["mixing sources to target weights"]
    assert after.count() == mixing.mix_sources(before).groupBy().sum("copies").first()[0]
    before, after = kept["line dedup"]
    lines = [x for r in after.select("text").collect() for x in (r["text"] or "").split("\n") if x.strip()]
    assert len(lines) == len(set(lines))
    final = corpus_pipeline.run(spark, FOLDER)
    key = lambda df: sorted((r["doc_id"], r["ids_sha256"]) for r in df.collect())
    assert key(final) == key(kept["BPE encoding and decoding"][1])
