from __future__ import annotations

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from snaplevel.llm import warc

SCHEMA = "page_id long, target_uri string, payload binary, content_type string, same string, kept string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, b, "text/html", "x", "y") for i, u, b in rows], SCHEMA).repartition(3)


BIG, OTHER = b"<html>" + b"a\xc3\xa9" * 500, b"<p>WARC/1.1\r\n\r\n</p>" * 100
ROWS = [(1, "http://a/", BIG), (2, "http://b/\r\nX: y", BIG), (3, None, BIG), (4, "u", b"small"), (5, "u", b"small"), (6, "u", None), (None, "u", BIG), (7, "u", OTHER), (7, "u", OTHER), (8, "u", b""), (None, "n", None)]


def written(spark, tmp_path, rows=ROWS, **options):
    path = f"{tmp_path}/archive"
    records = warc.with_revisits(pages(spark, rows), F.col("page_id"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    records = records.withColumn("record_id", name(F.col("page_id"))).withColumn("refers_to", F.when(F.col("refers_key").isNotNull(), name(F.col("refers_key"))))
    warc.write_warc(records, path)
    return path


def test_round_trip(spark, tmp_path):
    path = written(spark, tmp_path)
    back = warc.read_warc(spark, path).filter("record_type != 'warcinfo'").collect()
    got = sorted((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_sha1"], r["payload"]) for r in back)
    want = []
    for i, _, body in ROWS:
        body = body or b""
        revisit = body == BIG and i != 3
        want.append((f"urn:page:{'null' if i is None else i}", "revisit" if revisit else "response", "urn:page:3" if revisit else None,
                     len(body), hashlib.sha1(body).hexdigest(), None if revisit else body))
    assert sorted(got, key=str) == sorted(want, key=str)
    uri = {r["record_id"]: r["target_uri"] for r in back}
    assert uri["urn:page:2"] == "http://b/%0D%0AX: y" and uri["urn:page:3"] is None


def test_pushed_predicates_and_payloads(spark, tmp_path):
    path = written(spark, tmp_path)
    for condition in ("record_type = 'revisit'", "record_id in ('urn:page:1', 'urn:page:8')", "target_uri is null and record_type = 'response'", "target_uri like 'http://a%'", "not (record_type = 'response')", "refers_to <=> null"):
        whole = warc.read_warc(spark, path).cache()
        some = warc.read_warc(spark, path).filter(condition)
        assert sorted(map(str, some.collect())) == sorted(map(str, whole.filter(condition).collect()))
        whole.unpersist()
    bare = warc.read_warc(spark, path, payload=False)
    assert bare.filter("payload is not null").isEmpty()
    sizes = lambda df: sorted((r["record_id"], r["payload_bytes"]) for r in df.filter("record_type != 'warcinfo'").collect())
    assert sizes(bare) == sizes(warc.read_warc(spark, path))


class _File:
    """A file that counts what is read of it."""

    def __init__(self, data):
        self.data, self.at, self.read_bytes = data, 0, 0

    def read(self, n):
        piece = self.data[self.at : self.at + n]
        self.at += len(piece)
        self.read_bytes += len(piece)
        return piece

    def seek(self, at):
        self.at = at


def test_unwanted_blocks_are_skipped_by_their_length():
    import random

    body = random.Random(0).randbytes(3_000_000)
    records = [warc.member(warc.record_bytes({"record_type": "response", "record_id": f"urn:{k}", "payload": body})) for k in range(3)]
    file = _File(b"".join(records))
    reader, seen = warc._Records(file, 0), 0
    while reader.next_headers():
        seen += 1
        reader.skip(int(warc.parse_headers(reader.head)["content-length"]))
    assert seen == 3 and file.read_bytes < 4 * warc.CHUNK


@pytest.mark.parametrize("suffix", ["warc", "warc.gz", "one.warc.gz"])
def test_archives_of_others(spark, tmp_path, suffix):
    """Plain files, plain gzip members, and one gzip member for each record without lengths."""
    rows = [{"record_type": "response", "record_id": "urn:a", "target_uri": "u", "payload": OTHER * 300, "content_type": "text/html"},
            {"record_type": "conversion", "record_id": "urn:b", "payload": b"plain text", "content_type": "text/plain"},
            {"record_type": "metadata", "record_id": "urn:c", "payload": b""}]
    records = [warc.record_bytes(r) for r in rows]
    data = b"".join(records) if suffix == "warc" else b"".join(map(gzip.compress, records)) if suffix == "warc.gz" else b"".join(map(warc.member, records))
    (tmp_path / f"x.{suffix}").write_bytes(data)
    for path in (f"{tmp_path}/x.{suffix}", f"file://{tmp_path}"):
        got = {r["record_id"]: (r["record_type"], r["payload"], r["payload_bytes"]) for r in warc.read_warc(spark, path).collect()}
        assert got == {r["record_id"]: (r["record_type"], r["payload"], len(r["payload"])) for r in rows}
        only = warc.read_warc(spark, path).filter("record_type = 'metadata'").collect()
        assert [r["record_id"] for r in only] == ["urn:c"]


def test_partitions_follow_the_manifest(spark, tmp_path):
    path = f"{tmp_path}/many"
    rows = spark.range(400).select(F.lit("resource").alias("record_type"), F.concat(F.lit("urn:"), "id").alias("record_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 20).cast("binary").alias("payload"))
    spark.dataSource.register(warc.WarcDataSource)
    rows.repartition(2).write.format("warc").option("split", "8000").option("fileBytes", "60000").mode("append").save(path)
    (tmp_path / "many" / "part-lost.warc.gz").write_bytes(b"left by a lost task")
    back = spark.read.format("warc").option("split", "8000").load(path).filter("record_type = 'resource'")
    assert back.rdd.getNumPartitions() > 8
    assert back.select("record_id").distinct().count() == back.count() == 400
    rows.limit(3).write.format("warc").mode("overwrite").save(path)
    assert warc.read_warc(spark, path).filter("record_type = 'resource'").count() == 3


def test_empty_and_broken(spark, tmp_path):
    path = written(spark, tmp_path, [])
    assert warc.read_warc(spark, path).filter("record_type != 'warcinfo'").count() == 0
    (tmp_path / "cut.warc.gz").write_bytes(warc.member(warc.record_bytes({"record_type": "resource", "record_id": "urn:x", "payload": BIG}))[:-30])
    with pytest.raises(Exception, match="cut off"):
        warc.read_warc(spark, f"{tmp_path}/cut.warc.gz").collect()
    with pytest.raises(Exception, match="record_id"):
        spark.range(1).select(F.lit("x").alias("record_type")).write.format("warc").mode("append").save(f"{tmp_path}/none")
