from __future__ import annotations

import random
import re

import odd
import pytest

from snaplevel.llm import license_scan as ls


def brute(rows, notices):
    """Every window of twice a notice's words, whatever its first word."""
    out = {}
    for i, text, _ in rows:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        for name, notice in notices:
            n = re.findall(r"[^\W_]+", notice.lower())
            want = {tuple(n[k : k + 5]) for k in range(max(1, len(n) - 4))}
            for at in range(len(w)):
                window = w[at : at + 2 * len(n)]
                held = {tuple(window[k : k + 5]) for k in range(max(1, len(window) - 4))}
                share = len(held & want) / len(want)
                if share >= 0.75:
                    best, first = out.get((i, name), (0, at))
                    out[i, name] = (max(best, share), min(first, at))
    return sorted(((i, name, c, at) for (i, name), (c, at) in out.items()), key=str)


def found(spark, rows, notices=None):
    return sorted((tuple(r) for r in ls.scan(odd.docs(spark, rows), notices).collect()), key=str)


def test_equals_looking_into_every_window(spark):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        w = odd.words(rng, rng.randrange(0, 300))
        for _ in range(rng.randrange(3)):
            notice = rng.choice(ls.NOTICES)[1].split()
            if rng.random() < 0.5 and len(notice) > 8:
                notice[rng.randrange(len(notice))] = "other"
            w[rng.randrange(len(w) + 1) : 0] = notice
        rows.append((i, " ".join(w), None))
    rows += odd.texts()[:20] + [(None, "released UNDER the mit license", None), (600, None, None), (601, "", None), (602, "MIT", None)]
    rows += [(700 + k, "x y z. Released under the MIT License.", None) for k in range(50)]
    got = found(spark, rows)
    assert got == brute(rows, ls.NOTICES) and len(got) > 100


def test_anchors_cover_more_than_a_quarter(spark):
    for _, notice in ls.NOTICES:
        words = re.findall(r"[^\W_]+", notice.lower())
        runs = [words[k : k + 5] for k in range(max(1, len(words) - 4))]
        anchors = ls.anchors_of(notice)
        assert 4 * sum(any(a in run for a in anchors) for run in runs) > len(runs)


def test_own_notices_and_limits(spark):
    notices = [("short", "all rights reserved"), ("long", "do what you want with this text but tell us about it")]
    rows = [(1, "Copyright. All rights reserved", None), (2, "do what you want with this text but tell me about it", None), (3, "all reserved", None)]
    assert found(spark, rows, notices) == brute(rows, notices)
    assert found(spark, [], notices) == []
    with pytest.raises(ValueError):
        ls.scan(odd.docs(spark, []), least=0.5)


def places(text, notice):
    """The first words of all places where the words of the notice stand one after another."""
    w, n = (re.findall(r"[^\W_]+", t.lower()) for t in (text, notice))
    return [k for k in range(len(w) - len(n) + 1) if w[k : k + len(n)] == n]


def test_short_notices(spark):
    rng = random.Random(4)
    notices = [("three", "All rights reserved."), ("two", "no rights"), ("one", "copyleft"), ("four", "use it as is"), ("long", ls.NOTICES[1][1])]
    rows = [(1, "Copyright. All rights reserved", None), (2, "all reserved", None), (3, "rights reserved, all", None), (4, "All rights", None)]
    for i in range(5, 80):
        w = odd.words(rng, rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(notices)[1])
        rows.append((i, " ".join(w), None))
    got = ls.scan(odd.docs(spark, rows), notices, short=True).collect()
    want = {(i, name): places(text, notice) for i, text, _ in rows for name, notice in notices if name != "long" and places(text, notice)}
    assert {(r["doc_id"], r["license"]) for r in got if r["license"] != "long"} == set(want) and len(want) > 40
    for r in got:
        if r["license"] != "long":
            n = len(dict(notices)[r["license"]].split())
            assert r["containment"] == 1 and r["at"] == max(0, want[r["doc_id"], r["license"]][0] - n)
    assert {(r["doc_id"], r["license"]) for r in got if r["license"] == "long"} == {(i, "long") for i, t, _ in rows if notices[4][1] in t}
    got = ls.scan(odd.docs(spark, rows[:4]), short=True).collect()
    assert [(r["doc_id"], r["license"], r["at"]) for r in got] == [(1, ls.SHORT_NOTICES[0][0], 0)]


def test_short_notices_need_the_option(spark):
    with pytest.warns(UserWarning, match="fewer than 5 words"):
        ls.scan(odd.docs(spark, []), [("short", "all rights reserved")])
    with pytest.raises(ValueError):
        ls.scan(odd.docs(spark, []), [("none", "...")], short=True)


def sliding(text, notice):
    """The largest share of a notice's runs in a window of twice its words, which begins at any word."""
    w, n = (re.findall(r"[^\W_]+", (t or "").lower()) for t in (text, notice))
    size = min(5, len(n))
    want = {tuple(n[k : k + size]) for k in range(len(n) - size + 1)}
    held = [{tuple(w[k : k + size]) for k in range(at, min(at + 2 * len(n), len(w)) - size + 1)} for at in range(max(1, len(w)))]
    return max(len(want & h) for h in held) / len(want)


def test_words_inserted_into_a_notice(spark):
    rows = []
    for number, inside in ((9, 2), (9, 8), (9, 11), (10, 5), (10, 22), (10, 23), (5, 14), (7, 6)):
        notice = re.findall(r"[^\W_]+", ls.NOTICES[number][1])
        middle = len(notice) // 2
        passage = [*notice[:middle], *(f"x{k}" for k in range(inside)), *notice[middle:]]
        for before in range(len(notice)):
            rows.append((len(rows), " ".join([*(f"a{k}" for k in range(before)), *passage, *(f"b{k}" for k in range(60))]), None))
    got = {(r["doc_id"], r["license"]): (r["containment"], r["at"]) for r in ls.scan(odd.docs(spark, rows)).collect()}
    want = {}
    for i, text, _ in rows:
        for name, notice in ls.NOTICES:
            if (share := sliding(text, notice)) >= 0.75:
                want[i, name] = max(share, want.get((i, name), 0))
    assert {key: c for key, (c, _) in got.items()} == want and len(want) > 100
    assert {key: at for key, (_, at) in got.items()} == {(i, name): at for i, name, _, at in brute(rows, ls.NOTICES)}


def test_query_and_sql_agree_on_inserted_words(spark):
    """The registered SQL finds what the scan finds, wherever a notice begins and whatever is inserted."""
    import duckdb

    from snaplevel.llm.queries import OP7_SQL

    rows = []
    for number, inside in ((9, 8), (10, 8), (5, 14)):
        notice = re.findall(r"[^\W_]+", ls.NOTICES[number][1])
        passage = [*notice[: len(notice) // 2], *(f"x{k}" for k in range(inside)), *notice[len(notice) // 2 :]]
        for before in range(len(notice)):
            rows.append((len(rows), " ".join([*(f"a{k}" for k in range(before)), *passage, "End. All rights reserved."]), None))
    rows += [(900, "All rights reserved", None), (901, "rights reserved all", None), (902, None, None), (903, "", None), (900, "All rights reserved", None)]
    got = sorted(tuple(r) for r in ls.scan(odd.docs(spark, rows), short=True).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert got == sorted(con.execute(OP7_SQL).fetchall()) and len(got) > 100


def test_equals_sliding_word_by_word(spark):
    rng = random.Random(12)
    rows = []
    for i in range(120):
        w = odd.words(rng, rng.randrange(0, 200))
        for _ in range(rng.randrange(3)):
            notice = rng.choice(ls.NOTICES)[1].split()
            at = rng.randrange(len(notice))
            notice[at:at] = odd.words(rng, rng.randrange(len(notice)))
            w[rng.randrange(len(w) + 1) : 0] = notice
        rows.append((i, " ".join(w), None))
    got = {(r["doc_id"], r["license"]): r["containment"] for r in ls.scan(odd.docs(spark, rows)).collect()}
    want = {}
    for i, text, _ in rows:
        for name, notice in ls.NOTICES:
            if (share := sliding(text, notice)) >= 0.75:
                want[i, name] = max(share, want.get((i, name), 0))
    assert got == want and len(want) > 20
