from __future__ import annotations

import hashlib

import odd
import pytest
from pyspark.sql import functions as F

from snaplevel.llm import fingerprints as fp


def lanes(spark, *texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return rows.select("k", fp.fingerprint(F.col("t")).alias("f"))


def test_order_of_paragraphs_does_not_matter(spark):
    got = {r["k"]: r["f"] for r in lanes(spark, "a b\nc\nd. e", "d. e\na b\nc", "a b\nc\nd. f", None, "", "c\na b\nd. e\n").collect()}
    assert got[0] == got[1] != got[2] and got[3] == got[4] and got[5] != got[0]


def test_insertion_and_deletion(spark):
    got = {r["k"]: r["f"] for r in lanes(spark, "a\nb\nc", "a\nb", "c").collect()}
    rows = spark.createDataFrame([(got[0], got[1], got[2])], "whole array<long>, part array<long>, one array<long>")
    r = rows.select(fp.inserted(F.col("part"), F.col("one")).alias("i"), fp.deleted(F.col("whole"), F.col("one")).alias("d")).first()
    assert r["i"] == got[0] and r["d"] == got[1]


def test_likeness_follows_the_shared_sentences(spark):
    base = [f"sentence number {k} of it." for k in range(200)]
    texts = [" ".join(base[:100]), " ".join(base[:75] + base[100:125]), " ".join(base[100:])]
    got = [r["f"] for r in lanes(spark, *texts).orderBy("k").collect()]
    rows = spark.createDataFrame([(got[0], f) for f in got], "a array<long>, b array<long>")
    near = [r[0] for r in rows.select(fp.likeness(F.col("a"), F.col("b"))).collect()]
    assert near[0] == 1 and abs(near[1] - 0.75) < 0.2 and near[2] < 0.3


def test_edited_texts(spark):
    docs = odd.docs(spark)
    got = fp.fingerprint_edits(docs).collect()
    rows = docs.collect()
    assert len(got) == len(rows)

    def mark(r):
        return hashlib.md5((("~" if r[0] is None else str(r[0])) + "|=" + r[1]).encode()).hexdigest()

    order = sorted({(r["doc_id"], r["text"] or "") for r in rows}, key=lambda r: (r[0] is None, -(r[0] or 0), mark(r)))
    want = []
    for k, (i, text) in enumerate(order):
        following, half = order[(k + 1) % len(order)][1], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        n = sum(1 for r in rows if (r["doc_id"], r["text"] or "") == (i, text))
        want += [(i, len(text), hashlib.sha256(edited.encode()).hexdigest())] * n
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == sorted(want, key=str)
    by_text = {}
    texts = {(r["doc_id"], len(r["text"] or "")): r["text"] or "" for r in rows}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text.setdefault(texts[r["doc_id"], r["n_chars"]], set()).add(r["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())


@pytest.mark.parametrize("rows", [[], [(1, "a. b\nc", None)], [(None, None, None)]])
def test_few_rows(spark, rows):
    got = fp.fingerprint_edits(odd.docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r["near_next"] == 1 for r in got)


def plain(text):
    """The lanes of a text, one sentence after another."""
    mask, half = (1 << 60) - 1, (1 << 30) - 1
    paragraphs = (text or "").split("\n")
    digests = [hashlib.sha256(p.encode()).hexdigest() for p in paragraphs]
    exact = [sum(int(d[15 * k : 15 * k + 15], 16) for d in digests) & mask for k in range(4)]
    return len(paragraphs), exact, half


def test_lanes_of_rows_equal_those_of_columns(spark):
    texts = [t for _, t, _ in odd.texts()] + ["a. b! c?\n d. \n. ", "\n" * 50, "x. " * 40, None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: r["lanes"] for r in fp.fingerprints_of(rows, "t").collect()}
    want = {r["k"]: r["f"] for r in rows.select("k", fp.fingerprint(F.col("t")).alias("f")).collect()}
    assert got == want
    for k, t in enumerate(texts):
        n, exact, half = plain(t)
        assert got[k][0] == n and got[k][2:6] == exact
        assert all((x & half) <= got[k][1] and (x >> 30) <= got[k][1] for x in got[k][6:])


def test_edited_fingerprints_are_those_of_the_edited_texts(spark):
    rows = [(k, t, None) for k, (_, t, _) in enumerate(odd.texts()) if t is not None]
    docs = odd.docs(spark, rows)
    got = {r["doc_id"]: r for r in fp.fingerprint_edits(docs).collect()}
    order = sorted(rows, reverse=True)
    texts = []
    for k, (i, text, _) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        texts.append((i, text, text[: len(text) - half] + following[:half], following))
    df = spark.createDataFrame(texts, "i long, a string, b string, c string")
    lanes = df.select("i", *(fp.fingerprint(F.col(c)).alias(c) for c in "abc"))
    want = lanes.select(
        "i", *(fp.as_text(F.col(c)).alias(f"text_{c}") for c in "ab"), fp.likeness(F.col("a"), F.col("b")).alias("ab"), fp.likeness(F.col("a"), F.col("c")).alias("ac")
    )
    for r in want.collect():
        g = got[r["i"]]
        assert (g["fingerprint"], g["edited_fingerprint"], g["near_edited"], g["near_next"]) == (r["text_a"], r["text_b"], r["ab"], r["ac"])


def test_a_whole_text_of_two_million_line_feeds(spark):
    n = 2_000_000
    docs = spark.range(2).selectExpr("id AS doc_id", f"if(id = 0, repeat('\n', {n}), 'a. b') AS text")
    long, short = sorted(fp.fingerprint_edits(docs).collect())
    assert (long["n_chars"], short["n_chars"]) == (n, 4)
    assert long["edited_sha256"] == hashlib.sha256(("\n" * (n // 2) + "a. b").encode()).hexdigest()
    assert short["edited_sha256"] == hashlib.sha256(b"a.\n\n").hexdigest()
    assert int(long["fingerprint"][:15], 16) == int(long["fingerprint"][15:30], 16) == n + 1
    assert long["near_edited"] > 0.99


def test_many_copies_are_unfolded_in_parts(spark):
    rows = spark.createDataFrame([("a", 25), ("b", 10), ("c", 1)], "x string, copies long")
    got = fp._repeated(rows, "copies", at_once=10).groupBy("x").count().collect()
    assert {r["x"]: r["count"] for r in got} == {"a": 25, "b": 10, "c": 1}


def test_more_equal_sentences_than_20_bits_count(spark):
    n = 1_100_000
    many = spark.range(1).select(fp._sketch(F.array_repeat(F.lit(""), n), 0).alias("f")).first()["f"]
    one = spark.range(1).select(fp._sketch(F.array(F.lit("")), 0).alias("f")).first()["f"]
    head = [0] * (fp.EXACT_LANES - 2)
    rows = spark.createDataFrame([([n, n, *head, *many, *many], [1, 1, *head, *one, *one])], "a array<long>, b array<long>")
    r = rows.select(fp._projections(F.col("a")).alias("p"), fp.likeness(F.col("a"), F.col("b")).alias("near")).first()
    assert {abs(x) for x in r["p"]} == {float(n)} and abs(r["near"] - 1) < 1e-9
