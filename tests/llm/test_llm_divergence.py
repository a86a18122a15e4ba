"""The divergence audit equals a plain version that looks at every kept term of every pair of sources."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import odd
import pyarrow as pa
import pytest

from snaplevel.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, smoothing=5, top=50):
    docs, n = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = Counter(TERM.findall((text or "").translate(LOWER)))
        docs[lang or ""].update(found.keys())
        n[lang or "", source or ""].update(found)
    out = set()
    for lang in docs:
        kept = [t for t, k in docs[lang].items() if k >= least]
        mine = sorted(s for g, s in n if g == lang)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + smoothing) // (total + smoothing * len(kept)) for t in kept}

        q = shares(sum((n[lang, s] for s in mine), Counter()))
        p = {s: shares(n[lang, s]) for s in mine}
        for s in mine:
            parts = {
                "pair": [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in mine if o != s],
                "term": [(q[t] - p[s][t], t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t]],
            }
            for part, found in parts.items():
                for rank, (value, item) in enumerate(sorted(found)[: top if part == "term" else None], 1):
                    out.add((lang, s, part, item.decode(), -value, rank))
    return out


def spread(rows):
    """Texts with a language and a source each, some of them null."""
    langs, sources = ["en", "fr", None, ""], ["s0", "s1", "é", None, "s0", "s0"]
    return [(t, langs[k % 4], s if s and k % 5 else sources[k % 6]) for k, (_, t, s) in enumerate(rows)]


def frame(spark, rows):
    clashing = ", ".join(f"`{c}` string" for c in ("term", "n", "p", "q", "value", "rank", "item", "part", "tile", "a.b"))
    full = [(*r, *("clash" for _ in range(10))) for r in rows]
    return spark.createDataFrame(full, f"text string, lang string, source string, {clashing}").repartition(3)


@pytest.mark.parametrize("least,tile,bucket", [(2, 32, 8192), (1, 2, 16), (10_000, 32, 8192)])
def test_equals_plain_version(spark, monkeypatch, least, tile, bucket):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BUCKET", bucket)
    rows = spread(odd.texts()) + [(f"Only{k} ÀÉ x{k}z", "many", f"host{k:03}") for k in range(70)] + [("a b", "alone", "one")]
    got = [tuple(r) for r in divergence.audit(frame(spark, rows), min_documents=least).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, least)


def test_ties_and_top_terms(spark):
    rows = [("b a C c", "x", "s1"), ("d", "x", "s2"), ("", "x", "s3"), (None, "x", "s3")]
    got = {tuple(r) for r in divergence.audit(frame(spark, rows), min_documents=1, top_terms=2).collect()}
    assert got == brute(rows, 1, top=2)
    assert {r[3] for r in got if r[:3] == ("x", "s1", "term")} == {"c", "a"}


def test_empty(spark):
    assert divergence.audit(frame(spark, [])).collect() == []


def test_long_texts_are_split_between_terms(monkeypatch):
    text = ("Wörter und WORDS, 12 " * 300 + "x" * 500).encode()
    whole = divergence.document_counter(text)
    monkeypatch.setattr(divergence, "AT_ONCE", 64)
    assert divergence.document_counter(text) == whole == Counter({"wörter".encode(): 300, b"und": 300, b"words": 300, b"x" * 500: 1})


def test_counters_are_sent_in_parts():
    rows = [("w" * (k + 1) + " shared", "en", f"s{k % 2}") for k in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["text", "lang", "source"])
    parts = list(divergence.count_terms(iter([batch]), most=7))
    sums = Counter()
    for r in (r for p in parts for r in p.to_pylist() if r["term"] is not None):
        sums[r["source"], r["term"]] += r["n"]
        assert r["n"] == r["docs"]
    assert len(parts) > 4 and sums["s0", "shared"] == 20 and sums["s0", "w"] == sums["s1", "ww"] == 1


def test_shares_of_large_counts_are_exact(spark):
    n, total, kept = 7 * 10**15 + 3, 9 * 10**15 + 1, 12345
    row = spark.range(1).selectExpr(f"{n}L AS n", f"{total}L AS total", f"{kept}L AS kept").select(divergence.share("n", "total", "kept"))
    assert row.first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * kept)
