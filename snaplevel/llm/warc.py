"""WARC archives as a Spark data source: `spark.read.format("warc")` and `df.write.format("warc")`.

Files are read and written through pyarrow's file systems, so a path can be in any store these know.

Writing: each task writes files of gzip members, one record each, under names of its own, and reports them;
the commit writes a manifest of the reported files. Files of lost or repeated tasks are in no manifest and so
not read. Members carry their length in the gzip header's extra field (the optional "sl" of the format's
annex), and the manifest has the offset of a record every SPLIT bytes.

Reading: partitions are ranges of files, by the manifest where there is one, else whole files, small ones
together. Predicates on header columns are pushed into the reader. It inflates a record's headers first; a
record that they rule out is skipped, by its length where it is known, and nothing of its block is kept.
With option("payload", "false") blocks are skipped for all records. Spark pushes predicates to Python data
sources if spark.sql.python.filterPushdown.enabled is set, which `read_warc` does.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, content_type string, "
    "refers_to string, payload_sha1 string, payload_bytes long, headers map<string,string>, payload binary"
)
#: What a written table can have; of these record_type and record_id must be there.
WRITTEN = ("record_type", "record_id", "target_uri", "date", "content_type", "refers_to", "payload")
#: Bytes of a read partition; of a written file, about; read from a file at a time; longest header block.
SPLIT, FILE_BYTES, CHUNK, HEADERS = 64 << 20, 512 << 20, 1 << 18, 1 << 20
#: Fixed values of the format.
VERSION, HTTP_TYPE = "WARC/1.1", "application/http; msgtype=response"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"
GZIP_EXTRA = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H2sH", 12, b"sl", 8)
HEADER_COLUMNS = ("record_type", "record_id", "target_uri", "date", "content_type", "refers_to", "payload_sha1")


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# Writing


def _value(text: str) -> str:
    """Header values are one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text).strip()


def record_bytes(row: dict) -> bytes:
    """A record; the payload of responses and revisits is in an HTTP message, that of a revisit left out."""
    kind, payload = row["record_type"], row.get("payload") or b""
    content_type = _value(row.get("content_type") or "application/octet-stream")
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<{_value(row['record_id'])}>"), ("WARC-Date", row.get("date") or EPOCH)]
    if row.get("target_uri") is not None:
        headers.append(("WARC-Target-URI", _value(row["target_uri"])))
    if kind in ("response", "revisit"):
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", HTTP_TYPE)]
        block = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        block += payload if kind == "response" else b""
    else:
        headers.append(("Content-Type", content_type))
        block = payload
    if row.get("refers_to") is not None:
        headers.append(("WARC-Refers-To", f"<{_value(row['refers_to'])}>"))
    if kind == "revisit":
        headers.append(("WARC-Profile", REVISIT_PROFILE))
    headers.append(("Content-Length", str(len(block))))
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A gzip member with its own length and the record's in the extra field."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    length = len(GZIP_EXTRA) + 8 + len(body) + len(tail)
    return GZIP_EXTRA + struct.pack("<II", length & 0xFFFFFFFF, len(record) & 0xFFFFFFFF) + body + tail


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, split: int, file_bytes: int):
        self.path, self.overwrite, self.split, self.file_bytes = path, overwrite, split, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        files: list[dict] = []
        out = None
        for batch in iterator:
            names = [n for n in batch.schema.names if n in WRITTEN]
            for k in range(batch.num_rows):
                row = {n: batch[n][k].as_py() for n in names}
                if out is None:
                    files.append({"name": f"part-{uuid.uuid4().hex}.warc.gz", "offsets": [0], "size": 0})
                    out = store.open_output_stream(f"{folder}/{files[-1]['name']}", compression=None)
                    info = {"record_type": "warcinfo", "record_id": f"urn:uuid:{uuid.uuid4()}", "content_type": "application/warc-fields"}
                    files[-1]["size"] += out.write(member(record_bytes(info | {"payload": b"format: WARC File Format 1.1\r\n"})))
                now = files[-1]
                if now["size"] - now["offsets"][-1] >= self.split:
                    now["offsets"].append(now["size"])
                now["size"] += out.write(member(record_bytes(row)))
                if now["size"] >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def _manifests(self) -> list[str]:
        store, folder = _store(self.path)
        found = store.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return [f.path for f in found if re.search(r"/_manifest-[0-9a-f]+\.json$", f.path)]

    def commit(self, messages: list) -> None:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        before = self._manifests() if self.overwrite else []
        files = [f for m in messages if m is not None for f in m.files]
        with store.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())
        for manifest in before:
            with store.open_input_stream(manifest) as old:
                names = [f["name"] for f in json.loads(old.read())]
            store.delete_file(manifest)
            for name in names:
                store.delete_file(f"{folder}/{name}")

    def abort(self, messages: list) -> None:
        store, folder = _store(self.path)
        for f in (f for m in messages if m is not None for f in m.files):
            if store.get_file_info(f"{folder}/{f['name']}").type == pafs.FileType.File:
                store.delete_file(f"{folder}/{f['name']}")


# Reading


@dataclass
class Ranges(InputPartition):
    """Pieces of files: path, first byte, byte after the last (None: the file's end)."""

    pieces: list

    def __post_init__(self):
        super().__init__(None)


class _Records:
    """Records of a file from a position on; of each the headers first, and on demand the block."""

    def __init__(self, file: pa.NativeFile, start: int):
        self.file, self.at, self.plain = file, start, None
        self.buffer = b""

    def _fill(self) -> bool:
        more = self.file.read(CHUNK)
        self.buffer += more
        return bool(more)

    def _seek(self, position: int) -> None:
        self.at = position
        self.file.seek(position)
        self.buffer = b""

    def next_headers(self) -> bool:
        """Go to the next record and read its headers into `head`; False at the end."""
        self._seek(self.at)
        while len(self.buffer) < 24 and self._fill():
            pass
        if not self.buffer.strip(b"\r\n\0"):
            return False
        if self.buffer[:2] == b"\x1f\x8b":
            self.length = None
            if self.buffer[3] & 4 and self.buffer[12:14] == b"sl" and self.buffer[10:12] == b"\x0c\0":
                member_length, record_length = struct.unpack("<II", self.buffer[16:24])
                self.length = member_length if record_length < 1 << 31 else None
            self.inflate = zlib.decompressobj(31)
            self.used = 0
            self.plain = b""
            self._inflate_until(lambda: b"\r\n\r\n" in self.plain)
            self.head, found, self.plain = self.plain.partition(b"\r\n\r\n")
        else:
            self.inflate = None
            lead = len(self.buffer) - len(self.buffer.lstrip(b"\r\n"))
            self._seek(self.at + lead)
            while b"\r\n\r\n" not in self.buffer and len(self.buffer) < HEADERS and self._fill():
                pass
            self.head, found, self.plain = self.buffer.partition(b"\r\n\r\n")
            self.block_at = self.at + len(self.head) + 4
        if not found or not self.head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {self.at}")
        return True

    def _inflate_until(self, enough) -> None:
        while not enough() and not self.inflate.eof:
            if not self.buffer and not self._fill():
                raise ValueError(f"the record at byte {self.at} is cut off")
            before = len(self.buffer)
            piece = self.inflate.decompress(self.buffer, CHUNK)
            self.buffer = self.inflate.unconsumed_tail or self.inflate.unused_data
            self.used += before - len(self.buffer)
            self.plain += piece
            if self.inflate.eof:
                break

    def block(self, length: int) -> bytes:
        if self.inflate is not None:
            parts, size = [self.plain], len(self.plain)
            while size < length and not self.inflate.eof:
                self.plain = b""
                self._inflate_until(lambda: self.plain)
                parts.append(self.plain)
                size += len(self.plain)
            self.plain = b""
            whole = b"".join(parts)
        else:
            whole = self.plain[:length]
            if len(whole) < length:
                whole += self.file.read(length - len(whole))
        if len(whole) < length:
            raise ValueError(f"the record at byte {self.at} is cut off")
        return whole[:length]

    def start_of_block(self, length: int) -> bytes:
        """Enough of the block for the headers of an HTTP message, if it begins with one."""
        if self.inflate is not None:
            self._inflate_until(lambda: len(self.plain) >= length or b"\r\n\r\n" in self.plain or len(self.plain) > HEADERS)
        else:
            while len(self.plain) < length and b"\r\n\r\n" not in self.plain and len(self.plain) < HEADERS:
                more = self.file.read(CHUNK)
                if not more:
                    break
                self.plain += more
        return self.plain[:length]

    def skip(self, length: int) -> None:
        """Go behind the record without keeping anything of it."""
        if self.inflate is None:
            self._next = self.block_at + length
        elif self.length is not None:
            self._next = self.at + self.length
        else:
            while not self.inflate.eof:
                self.plain = b""
                self._inflate_until(lambda: self.plain)
            self._next = self.at + self.used
        self.at = self._next


def parse_headers(head: bytes) -> dict[str, str]:
    """Names in lower case, values joined by a comma where a name repeats; folded lines are joined."""
    found: dict[str, str] = {}
    text = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace"))
    for line in text.split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name, value = name.strip().lower(), value.strip()
            found[name] = f"{found[name]}, {value}" if name in found else value
    return found


def _sha1_hex(digest: str | None) -> str | None:
    """The SHA-1 of a digest header, in hexadecimal; None for another kind of digest."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return None
    if re.fullmatch(r"[0-9a-fA-F]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch(r"[A-Za-z2-7]{32}", value) else None


def _columns_of(headers: dict[str, str]) -> dict[str, str | None]:
    bare = lambda name: headers[name].strip("<>") if name in headers else None
    return {
        "record_type": headers.get("warc-type"),
        "record_id": bare("warc-record-id"),
        "target_uri": bare("warc-target-uri"),
        "date": headers.get("warc-date"),
        "content_type": headers.get("content-type"),
        "refers_to": bare("warc-refers-to"),
        "payload_sha1": _sha1_hex(headers.get("warc-payload-digest")),
    }


def _test(condition: Filter):
    """(column, test of its value) of a predicate on a header column; None for any other."""
    if isinstance(condition, Not):
        inner = _test(condition.child)
        null_too = isinstance(condition.child, (IsNull, IsNotNull, EqualNullSafe))
        return inner and (inner[0], lambda v: (v is not None or null_too) and not inner[1](v))
    attribute = getattr(condition, "attribute", ())
    if len(attribute) != 1 or attribute[0] not in HEADER_COLUMNS:
        return None
    value = getattr(condition, "value", None)
    tests = {
        EqualTo: lambda v: v is not None and v == value,
        EqualNullSafe: lambda v: v == value,
        In: lambda v: v is not None and v in (value or ()),
        IsNull: lambda v: v is None,
        IsNotNull: lambda v: v is not None,
        StringStartsWith: lambda v: v is not None and v.startswith(value),
        StringEndsWith: lambda v: v is not None and v.endswith(value),
        StringContains: lambda v: v is not None and value in v,
    }
    test = tests.get(type(condition))
    return test and (attribute[0], test)


def _arrow_schema(payload: bool) -> pa.Schema:
    fields = [(c, pa.string()) for c in HEADER_COLUMNS]
    return pa.schema([*fields, ("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, split: int):
        self.path, self.payload, self.split, self.filters = path, payload, split, []

    def pushFilters(self, filters: list[Filter]):
        for condition in filters:
            test = None if isinstance(condition, Not) and isinstance(condition.child, Not) else _test(condition)
            if test is None:
                yield condition
            else:
                self.filters.append(condition)

    def partitions(self) -> list[Ranges]:
        store, path = _store(self.path)
        info = store.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        pieces: list[tuple] = []
        if info.type == pafs.FileType.File:
            pieces = [(path, 0, None, info.size)]
        else:
            found = store.get_file_info(pafs.FileSelector(path))
            manifests = [f.path for f in found if re.search(r"/_manifest-[0-9a-f]+\.json$", f.path)]
            if manifests:
                for manifest in sorted(manifests):
                    with store.open_input_stream(manifest) as file:
                        for f in json.loads(file.read()):
                            ends = [*f["offsets"][1:], f["size"]]
                            pieces += [(f"{path}/{f['name']}", a, b, b - a) for a, b in zip(f["offsets"], ends, strict=True)]
            else:
                names = sorted((f.path, f.size) for f in found if re.search(r"\.warc(\.gz)?$", f.path))
                pieces = [(name, 0, None, size) for name, size in names]
        out: list[Ranges] = []
        room = 0
        for name, a, b, size in pieces:
            if not out or size > room:
                out.append(Ranges([]))
                room = self.split
            out[-1].pieces.append((name, a, b))
            room -= size
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        tests = [_test(f) for f in self.filters]
        schema, rows, size = _arrow_schema(self.payload), [], 0
        for name, start, stop in partition.pieces:
            with store.open_input_file(name) as file:
                records = _Records(file, start)
                while (stop is None or records.at < stop) and records.next_headers():
                    headers = parse_headers(records.head)
                    length = int(headers.get("content-length", 0))
                    row = _columns_of(headers)
                    if all(test(row[column]) for column, test in tests):
                        row |= self._body(records, row, length) | {"headers": list(headers.items())}
                        rows.append(row)
                        size += len(row["payload"] or b"") + 1000
                    records.skip(length)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _body(self, records: _Records, row: dict, length: int) -> dict:
        """The payload, None if not asked for or a revisit's, and its full size as far as it is known."""
        http = (row["content_type"] or "").startswith("application/http")
        if not http:
            return {"payload": records.block(length) if self.payload else None, "payload_bytes": length}
        if self.payload and row["record_type"] != "revisit":
            head, found, body = records.block(length).partition(b"\r\n\r\n")
            return {"payload": body if found else b"", "payload_bytes": len(body)}
        head, found, _ = records.start_of_block(length).partition(b"\r\n\r\n")
        if row["record_type"] != "revisit":
            return {"payload": None, "payload_bytes": length - len(head) - 4 if found else 0}
        stated = parse_headers(head).get("content-length", "")
        return {"payload": None, "payload_bytes": int(stated) if stated.isdigit() else None}


class WarcDataSource(DataSource):
    """Options: path; payload ("true"), split bytes ("split"), bytes of a written file ("fileBytes")."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        payload = self.options.get("payload", "true").lower() == "true"
        return WarcReader(self.options["path"], payload, int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        missing = {"record_type", "record_id"} - set(schema.names)
        if missing:
            raise ValueError(f"a WARC record needs {', '.join(sorted(missing))}")
        split, file_bytes = int(self.options.get("split", SPLIT)), int(self.options.get("fileBytes", FILE_BYTES))
        return WarcWriter(self.options["path"], overwrite, split, file_bytes)


def read_warc(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """The records of a file or folder, in the columns of SCHEMA.

    `headers` has the record's own, names in lower case. `payload` is the body of the HTTP message in
    responses, the block of other records, null for revisits and without `payload`; `payload_bytes` is
    its full size, for revisits as their message states it; `payload_sha1` is from the digest header. What
    a record doesn't state is null. Truncated records and files without records raise an error.
    """
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def write_warc(records: DataFrame, path: str, mode: str = "append") -> None:
    """Write records with the columns WRITTEN that they have; others are ignored.

    Control characters in header values are percent-encoded. A null date is the epoch, a null payload is
    empty, other nulls leave their header out. record_type and record_id must not be null.
    """
    spark = records.sparkSession
    spark.dataSource.register(WarcDataSource)
    records.select(*(c for c in records.columns if c in WRITTEN)).write.format("warc").mode(mode).save(path)


def with_revisits(records: DataFrame, key: Column, min_bytes: int = 1000) -> DataFrame:
    """Records (with payload, binary) as responses or revisits: adds record_type and refers_key.

    Of records with equal payloads of at least `min_bytes`, that with the largest key is a response and the
    others revisit it; all others are responses. A null key is less than any; records that share the
    largest key, or have no key at all, are all responses. Copies are aggregated before they are joined.
    """
    columns = [c for c in records.columns if c not in ("record_type", "refers_key")]
    rest = F.struct(*(F.coalesce(records[c], F.lit(b"")).alias(c) if c == "payload" else records[c] for c in columns))
    keyed = records.select(rest.alias("rest"), key.alias("mine"))
    keyed = keyed.withColumn("same", F.sha2("rest.payload", 256))
    groups = keyed.filter(F.octet_length("rest.payload") >= min_bytes).groupBy("same")
    groups = groups.agg(F.max("mine").alias("kept"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    joined = keyed.join(groups, "same", "left")
    revisits = F.col("kept").isNotNull() & (F.col("mine").isNull() | (F.col("mine") < F.col("kept")))
    kind = F.when(revisits, "revisit").otherwise("response")
    return joined.select("rest.*", kind.alias("record_type"), F.when(revisits, F.col("kept")).alias("refers_key"))
