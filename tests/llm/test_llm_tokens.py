from __future__ import annotations

import odd
import pytest
from pyspark.sql import functions as F

from snaplevel.llm import bpe, byte_bpe, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def truth():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


HARD = ["a'll 're 's'", "  \n\n  x", "x \x1c\x85\xa0 y", "²½ª٣", "<|endoftext|><|endoftext|> a<|endoftext", "՘֋⃁ 中文 字", "\0\0 \t"]


def hard_docs(spark):
    return odd.docs(spark, odd.texts() + [(900 + k, t, None) for k, t in enumerate(HARD)])


@pytest.mark.parametrize("text", HARD + ["", "a b"])
def test_words_encode_to_the_text(truth, text):
    vocabulary = byte_bpe.load(PATH)
    words = vocabulary.split(text)
    assert "".join(words) == text
    assert [i for ids in vocabulary.encode_words(words) for i in ids] == truth(text) if words else not truth(text)


@pytest.mark.parametrize("limits", [{}, {"huge": 200, "chunk": 120, "overlap": 16}, {"huge": 60, "chunk": 40, "overlap": 4}])
def test_counts_are_the_librarys(spark, truth, limits):
    docs = hard_docs(spark)
    got = token_counts.count_tokens(docs, PATH, **limits)
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(truth(r["text"])), len(truth(r["text"])) > 1024) for r in docs.collect()), key=str)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str) == want


def test_overlaps_widen_where_no_word_begins(truth):
    vocabulary = byte_bpe.load(PATH)
    piece = token_counts.chunk_marks(vocabulary, "x" * 200, 0, False, 100, 50)
    assert piece["tail"] == []  # one word: nothing to splice at


@pytest.mark.parametrize("head", [0, 50, 100_000])
def test_ids_and_round_trip(spark, truth, head):
    docs = hard_docs(spark)
    encoded = bpe.encode(docs, PATH, head=head)
    got = bpe.decode(encoded, PATH).collect()
    want = sorted(((r["doc_id"], truth(r["text"]), r["text"] or "") for r in docs.collect()), key=str)
    assert sorted(((r["doc_id"], list(r["ids"]), r["text"]) for r in got), key=str) == want
    got = bpe.round_trip(docs, PATH, head=head).collect()
    assert sorted(((r["doc_id"], list(r["ids"]), r["text"]) for r in got), key=str) == want


def test_decoding_of_partial_characters_and_nulls(spark, truth):
    ids = truth("🦊")
    rows = spark.createDataFrame([(1, ids[:1]), (2, None), (3, []), (4, ids)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in bpe.decode(rows, PATH).collect()}
    assert got[1] and set(got[1]) == {"�"} and got[2] is None and got[3] == "" and got[4] == "🦊"


def test_empty_tables(spark):
    none = odd.docs(spark, [])
    assert token_counts.count_tokens(none, PATH).count() == 0
    assert bpe.decode(bpe.encode(none, PATH), PATH).count() == 0
    assert bpe.distinct_words(none, PATH).agg(F.sum("n")).first()[0] is None
