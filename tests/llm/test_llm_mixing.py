from __future__ import annotations

import hashlib
import re

import odd
import pytest
from pyspark.sql import functions as F

from snaplevel.llm import mixing


def brute(rows, epochs=3):
    """The mix by a plain sort of all copies."""
    def size(t):
        return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: float(k % 3 + 1) for k, s in enumerate(names)}
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    budget = sum(total.values())
    copies = []
    for s in names:
        def place(r):
            return int(hashlib.md5(f"{'null' if r[0] is None else r[0]}:mix".encode()).hexdigest()[:15], 16)
        def key(r):
            mark = ("~" if r[0] is None else str(r[0])) + "|" + ("~" if r[1] is None else "=" + r[1])
            return place(r), (r[0] is not None, r[0] or 0), size(r[1]), hashlib.md5(mark.encode()).hexdigest()
        upto = 0
        for r in sorted((r for r in rows if r[2] == s), key=key):
            upto += size(r[1])
            if size(r[1]):
                copies += [((upto + e * total[s]) / weight[s], names.index(s), upto + e * total[s], r[0], size(r[1])) for e in range(epochs)]
    taken, used = {}, 0
    for c in sorted(copies, key=lambda c: c[:3]):
        used += c[4]
        if used > budget:
            break
        taken[c[3]] = taken.get(c[3], 0) + c[4]
    return taken, total


def test_mix_equals_a_plain_sort(spark):
    rows = odd.texts()
    taken, total = brute(rows)
    got = mixing.mix_sources(odd.docs(spark))
    assert got.count() == len(rows)
    by_id = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.sum("taken").alias("n")).collect()}
    assert {k: v for k, v in by_id.items() if v} == taken
    for r in got.groupBy("source").agg(F.max("source_size").alias("s"), F.max("target").alias("t"), F.sum("taken").alias("n"), F.max("size").alias("m")).collect():
        assert r["s"] == total[r["source"]]
        assert r["t"] - r["n"] <= r["m"]  # a source lacks less than its next document
    assert got.filter("taken > 3 * size").isEmpty()
    again = mixing.mix_sources(odd.docs(spark).repartition(3))
    assert odd.rows_of(got, "doc_id", "size", "copies") == odd.rows_of(again, "doc_id", "size", "copies")


def test_targets_fill_up_what_small_sources_lack(spark):
    rows = [(k, "a b c d", "small") for k in range(5)] + [(100 + k, "a b c d", "tall") for k in range(200)]
    got = mixing.mix_sources(odd.docs(spark, rows)).groupBy("source").agg(F.max("target").alias("t"), F.sum("taken").alias("n")).collect()
    assert {r["source"]: (r["t"], r["n"]) for r in got} == {"small": (60.0, 60), "tall": (760.0, 760)}


def test_given_weights(spark):
    rows = [(k, "a b c d", "s" + str(k % 3)) for k in range(300)]
    weights = spark.createDataFrame([("s0", 3.0), ("s1", 1.0)], "source string, weight double")
    got = mixing.mix_sources(odd.docs(spark, rows), weights=weights).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    assert {r["source"]: r["n"] for r in got} == {"s0": 900, "s1": 300, "s2": 0}


def test_mixed_documents_repeat_whole_rows(spark):
    docs = odd.docs(spark)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    want = mixing.mix_sources(docs).filter("copies > 0").groupBy("doc_id").agg(F.sum("copies").alias("n"))
    assert odd.rows_of(mixed.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "n") == odd.rows_of(want, "doc_id", "n")


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (1, "", "a")]])
def test_nothing_to_mix(spark, rows):
    got = mixing.mix_sources(odd.docs(spark, rows))
    assert [r["taken"] for r in got.collect()] == [0] * len(rows)
    assert mixing.mixed_documents(odd.docs(spark, rows)).count() == 0


def test_an_id_of_a_third_of_the_rows_is_spread(spark):
    rows = [(None, " ".join(["w"] * (1 + k % 7)) + f" {k}", "s0") for k in range(2000)] + [(None, "a b c", "s0")] * 2500
    rows += [(k, "a b c d", f"s{k % 2}") for k in range(1500)]
    docs = odd.docs(spark, rows)
    queue = mixing.queued(docs, "doc_id", "text", "source", "mix")
    sources = mixing.source_targets(queue, None, 3)
    ranges = mixing.in_ranges(queue, sources, len(rows)).groupBy("range").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).collect()
    assert sum(r["n"] for r in ranges) == 3501 and sum(r["rows"] for r in ranges) == len(rows)
    assert max(r["n"] for r in ranges) < 2000  # the null id's texts are in several
    got = mixing.in_queue(queue, sources, len(rows))
    for source in ("s0", "s1"):
        mine = [(r["upto"], r["size"], r["source_size"]) for r in got.filter(F.col("source") == source).collect()]
        upto = 0
        for at, size, total in sorted(mine):
            upto += size
            assert at == upto
        assert upto == total
    taken, _ = brute(rows)
    by_id = {r["doc_id"]: r["n"] for r in mixing.mix_sources(docs).groupBy("doc_id").agg(F.sum("taken").alias("n")).collect()}
    assert {k: v for k, v in by_id.items() if v} == taken
