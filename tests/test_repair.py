"""Repair equals one pass over the lines, whatever the blocks in which Spark reads the file."""

from __future__ import annotations

import random

import pytest

from snaplevel.sources import repair, text

WIDTH = 5
HEADER = "\t".join(f"c{i}" for i in range(WIDTH))


def one_pass(lines, width=WIDTH):
    """(repaired fields, rejected lines, whole lines) of the lines below the header."""
    repaired, rejected, whole, part, total = [], [], [], [], 0

    def give_up():
        rejected.extend(part)
        part.clear()

    for line in lines:
        s = line.count("\t")
        if s >= width - 1:
            give_up()
            whole.append(line.split("\t")[:width])
        elif part and total + s <= width - 1:
            part.append(line)
            total += s
            if total == width - 1:
                repaired.append("\n".join(part).split("\t"))
                part.clear()
        else:
            give_up()
            if s:
                part.append(line)
                total = s
            else:
                rejected.append(line)
    give_up()
    return repaired, rejected, whole


def blank(fields):
    return tuple(f or None for f in fields)


def random_lines(seed, n=400, whole=0.5):
    rng = random.Random(seed)
    lines = []
    while len(lines) < n:
        fields = [rng.choice(["", "x", "long text", "é"]) for _ in range(WIDTH)]
        kind = rng.random()
        if kind < whole:
            lines.append("\t".join(fields))
        elif kind < 0.9:
            fields[rng.randrange(WIDTH)] = rng.choice(["a\nb", "a\n\nb", "\n", "a\nb\nc\nd"])
            lines += "\t".join(fields).split("\n")
        else:
            lines.append("\t".join(fields[: rng.randrange(1, WIDTH)]))
    return lines


@pytest.fixture
def small_blocks(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, str(size))
    spark.conf.set(name, before)


def compare(spark, path, lines_of_files):
    found = repair.repair_lines(spark, path)
    want = [one_pass(lines) for lines in lines_of_files]
    key = lambda rows: sorted(rows, key=str)
    assert key(tuple(r) for r in found.repaired.collect()) == key(blank(r) for w in want for r in w[0])
    assert key(r["line"] for r in found.rejects.collect()) == key(x for w in want for x in w[1])
    assert key(tuple(r) for r in found.rows.collect()) == key(blank(r) for w in want for r in [*w[0], *w[2]])
    audit = found.audit.first().asDict()
    assert audit["accepted"] == sum(len(w[2]) for w in want) and audit["rejected"] == sum(len(w[1]) for w in want)
    assert audit["repaired"] == sum(len(w[0]) for w in want)
    assert audit["accepted"] + audit["repaired_lines"] + audit["rejected"] == sum(map(len, lines_of_files))
    return found


@pytest.mark.parametrize("seed,block,whole", [(1, 1 << 20, 0.5), (2, 300, 0.5), (3, 60, 0.2), (4, 25, 0.0), (5, 7, 0.1)])
def test_equals_one_pass(spark, tmp_path, small_blocks, seed, block, whole):
    small_blocks(block)
    files = [random_lines(seed, 150, whole), random_lines(seed + 100, 40, whole)]
    for k, lines in enumerate(files):
        (tmp_path / f"f{k}.txt").write_text("\n".join([HEADER, *lines]) + "\n")
    found = compare(spark, str(tmp_path), files)
    if block < 1000:
        assert found._blocks.count() > 5


def test_a_record_broken_at_a_split(spark, tmp_path, small_blocks):
    """Every place of the split, and records over several blocks of short lines only."""
    lines = ["1\ta\tb\tc\td", "2\tlong " * 2, "\n".join(["text"] * 9), "end\te\tf\tg", "3\ta\tb\tc\td"]
    lines = "\n".join(lines).replace("2\tlong 2\tlong ", "2\tlong").split("\n")
    path = tmp_path / "dump.txt"
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    want = one_pass(lines)
    assert len(want[0]) == 1 or len(want[1]) == len(lines) - 2
    for block in range(8, 60, 7):
        small_blocks(block)
        compare(spark, str(path), [lines])


def test_files_are_apart_and_in_their_own_column_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text(f"{HEADER}\n1\t2\t3\n")
    turned = "\t".join(reversed(HEADER.split("\t")))
    (tmp_path / "b.txt").write_text(f"{turned}\n4\t5\n5\t6\t7\t8\nx\t\t\t\ty\n")
    found = repair.repair_lines(spark, str(tmp_path))
    assert [tuple(r) for r in found.repaired.collect()] == [("8", "7", "6", "5\n5", "4")]
    assert [tuple(r) for r in found.rejects.collect()] == [("1\t2\t3", 3, 5)]
    assert sorted(map(tuple, found.rows.collect()), key=str) == sorted([("8", "7", "6", "5\n5", "4"), ("y", None, None, None, "x")], key=str)


def test_given_columns_and_nothing_to_repair(spark, tmp_path):
    path = tmp_path / "dump.txt"
    path.write_text("1\t2\n\n3\t4\t5\n")
    found = repair.repair_lines(spark, str(path), ["a", "b"])
    assert [tuple(r) for r in found.rejects.collect()] == [("", 1, 2)]
    assert sorted(map(tuple, found.rows.collect())) == [("1", "2"), ("3", "4")]
    assert found.audit.first().asDict() == {"accepted": 2, "repaired": 0, "repaired_lines": 0, "rejected": 1}
    empty = tmp_path / "empty.txt"
    empty.write_text("")
    assert repair.repair_lines(spark, str(empty), ["a", "b"]).audit.first().asDict()["accepted"] == 0


def test_headers_of_many_files_in_one_job(spark, tmp_path):
    for k in range(60):
        (tmp_path / f"f {k:03}%.txt").write_text(f"a\tb\n{k}\tx\n" if k % 2 else f"b\ta\nx\t{k}\n")
    (tmp_path / "empty.txt").write_text("")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    found = text.files_by_header(spark, str(tmp_path))
    jobs = len(tracker.getJobIdsForGroup("headers"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {h: len(f) for h, f in found.items()} == {("b", "a"): 30, ("a", "b"): 30}
    assert jobs <= 2  # listing the files may be one
    assert text.read_delimited(spark, str(tmp_path)).count() == 60
    rows = text.read_delimited(spark, str(tmp_path)).collect()
    assert {(r["a"], r["b"]) for r in rows} == {(str(k), "x") for k in range(60)}


@pytest.mark.parametrize("alone", [True, False])
def test_first_lines_of_files_that_share_a_task(alone):
    import pyarrow as pa

    batches = [[("h1", "f1"), ("x", "f1")], [("y", "f1"), ("h2", "f2")], [], [("h3", "f3")]]
    made = [pa.RecordBatch.from_arrays([pa.array([v for v, _ in b], pa.string()), pa.array([f for _, f in b], pa.string())], ["value", "file"]) for b in batches]
    found = [r["value"] for out in text._first_lines(alone)(iter(made)) for r in out.to_pylist()]
    assert found == (["h1"] if alone else ["h1", "h2", "h3"])


def test_lines_that_read_like_the_header_stay_data(spark, tmp_path, small_blocks):
    small_blocks(16)
    path = tmp_path / "dump.txt"
    path.write_text("a\tb\n" + "a\tb\n" * 25 + "1\t2\n")
    assert text.read_delimited(spark, str(path)).groupBy("a").count().collect() and text.read_delimited(spark, str(path)).count() == 26
    assert text.reject_audit(spark, str(path)).first()["accepted"] == 26


def test_repeated_rows_are_unfolded_in_parts(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a", 25), ("b", 10), ("c", 1)], "value string, n long")
    got = text._repeated(rows, F.col("n"), at_once=10).groupBy("value").count().collect()
    assert {r["value"]: r["count"] for r in got} == {"a": 25, "b": 10, "c": 1}
