from __future__ import annotations

import random

import odd
import pytest

from snaplevel.llm import line_dedup


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute(rows, near=True):
    """Kept texts by (doc_id, text), for rows that are unique in both."""
    seen, out = [], {}
    for i, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        kept = []
        for line in text.split("\n"):
            if not line.strip(" \t\n\r\v\f"):
                kept.append(line)
                continue
            if line not in seen and not (near and len(line) >= 20 and any(len(s) >= 20 and one_edit(s, line) for s in seen)):
                kept.append(line)
            if line not in seen:
                seen.append(line)
        out[i] = "\n".join(kept)
    return out


def edited(rng, line):
    k = rng.randrange(len(line))
    return rng.choice([line[:k] + line[k + 1 :], line[:k] + "é" + line[k:], line[:k] + "中" + line[k + 1 :], line[:k] + "zz" + line[k + 1 :]])


@pytest.mark.parametrize("near", [True, False])
def test_equals_comparing_all_lines(spark, near):
    rng = random.Random(3)
    base = [" ".join(odd.words(rng, rng.randrange(1, 12))) for _ in range(60)]
    rows = []
    for i in range(120):
        lines = [edited(rng, rng.choice(base)) if rng.random() < 0.6 else rng.choice([*base, "", "  "]) for _ in range(rng.randrange(1, 8))]
        rows.append((i, "\n".join(lines), None))
    rows.append((None, "\n".join(base[:3]), None))
    got = line_dedup.deduplicate_lines(odd.docs(spark, rows), near=near)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute(rows, near)
    assert got.columns == [*odd.docs(spark, []).columns, "n_lines", "n_kept"]


def test_numbered_lines_and_a_hot_line(spark):
    rows = [(i, f"the very same line everywhere\nrecord number {i:06d} of the long table", None) for i in range(300)]
    got = {r["doc_id"]: (r["text"], r["n_kept"]) for r in line_dedup.deduplicate_lines(odd.docs(spark, rows)).collect()}
    want = brute(rows)
    assert {i: t for i, (t, _) in got.items()} == want
    assert got[0][1] == 2 and all(n < 2 for i, (_, n) in got.items() if i)


def test_odd_rows(spark):
    docs = odd.docs(spark)
    got = line_dedup.deduplicate_lines(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(r["text"] is None and (r["n_lines"], r["n_kept"]) == (0, 0) for r in by[300])
    assert [(r["text"], r["n_lines"], r["n_kept"]) for r in by[301]] == [("", 1, 1)]
    assert [r["text"] for r in by[302]] == [" \n\t "]
    assert all(r["text"] == "" for k in range(30) for r in by[100 + k])  # copies of the first document
    five = sorted(r["n_kept"] for r in by[5])
    assert len(five) == 4 and five[:2] == [0, 0]  # the repeated rows lose their lines
    assert all(r["key"] == "clash" and r["lines"] == "clash" for r in got)


def test_empty_table(spark):
    assert line_dedup.deduplicate_lines(odd.docs(spark, [])).count() == 0


def test_long_lines_one_edit_apart(spark):
    rng = random.Random(1)
    line = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    rows = [(1, line, None), (2, line[:4000] + "x" + line[4000:], None), (3, line[:10] + line[11:], None), (4, line[:-1], None), (5, line[:20] + "yy" + line[22:], None)]
    got = {r["doc_id"]: r["n_kept"] for r in line_dedup.deduplicate_lines(odd.docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1}


def test_both_lines_need_the_least_length(spark):
    line = "exactly twenty chars"
    rows = [(1, line[:-1], None), (2, line, None), (3, line + "s", None), (4, line + "ses", None)]
    got = {r["doc_id"]: r["n_kept"] for r in line_dedup.deduplicate_lines(odd.docs(spark, rows)).collect()}
    assert len(line) == 20 and got == {1: 1, 2: 1, 3: 0, 4: 1}
