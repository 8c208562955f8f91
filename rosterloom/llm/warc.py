"""WARC archives from pages, and back, without ever holding a large payload as a whole.

Pages become a table of chunks: record, chunk number, at most 1 MB of the payload. Payloads of one
chunk are digested and written where they are. Those of several are sorted by record and chunk
number, and go through digests and into files a chunk at a time. Of records with equal payloads (equal
length and SHA-256), from a least length on, one is a response and the others revisits, which have no
payload: they name the response and repeat its digest and length.

A file is gzip, one member a record, and starts with a warcinfo record. A task that runs again writes a
new file; the manifest, written by Spark, names those of the attempt that counts. Reading streams as
well; digest and length of every payload are taken again and compared with the headers.

Defined results: a null payload is empty. The response among equal payloads is the record with the largest
page_id, null before all others; of repeated rows with that id any one of them. A null page_id or url has
no header line; white space and control characters in a url are percent-encoded. Repeated rows are records of their own.
An empty table gives no files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm.tables import kept_as, small_batches

CHUNK = 1 << 20
READ = 1 << 16  # what is left of it after a record is copied, so not more
REVISITED = 1000  # bytes of a payload from which on it is not stored twice
LISTED_BYTES = 8 << 20  # a list of records is broadcast up to this size
MANIFEST = "shard bigint, path string, n_records bigint, n_bytes bigint"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n"


def chunk_table(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """record, page_id, url, n_bytes, n_chunks, chunk and data: every payload in pieces of `size` bytes."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    sized = pages.select(F.monotonically_increasing_id().alias("record"), "page_id", "url", payload.alias("payload"))
    n_bytes = F.octet_length("payload").cast("bigint")
    n_chunks = F.greatest(F.ceil(n_bytes / F.lit(size)), F.lit(1)).cast("int")
    # Cut first, exploded then: the payload itself is not carried along with each piece.
    pieces = F.transform(F.sequence(F.lit(0), n_chunks - 1), lambda i: F.substring(F.col("payload"), i * size + 1, F.lit(size)))
    return sized.select("record", "page_id", "url", n_bytes.alias("n_bytes"), n_chunks.alias("n_chunks"),
                        F.posexplode(pieces).alias("chunk", "data"))


def _digests(batches):
    """Per record of several chunks, which come in order: its digests."""
    names = ["record", "sha1", "sha256"]
    types = [pa.int64(), pa.string(), pa.string()]
    record, hashes, done = None, None, []

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
        done.clear()
        return batch

    for batch in batches:
        for key, data in zip(batch.column("record").to_pylist(), batch.column("data")):
            if key != record:
                if record is not None:
                    done.append((record, *(h.hexdigest() for h in hashes)))
                record, hashes = key, (hashlib.sha1(), hashlib.sha256())
            for h in hashes:
                h.update(data.as_buffer())
        if done:
            yield out()
    if record is not None:
        done.append((record, *(h.hexdigest() for h in hashes)))
        yield out()


def in_order(chunks: DataFrame) -> DataFrame:
    """Chunks of large records: each record in one task, piece after piece."""
    return chunks.repartition("record").sortWithinPartitions("record", "chunk")


def record_digests(chunks: DataFrame) -> DataFrame:
    """record, page_id, url, n_bytes, n_chunks, sha1, sha256 of every record."""
    about = ["record", "page_id", "url", "n_bytes", "n_chunks"]
    small = chunks.filter("n_chunks = 1").select(*about, F.sha1("data").alias("sha1"), F.sha2("data", 256).alias("sha256"))
    large = chunks.filter("n_chunks > 1")
    digests = in_order(large.select("record", "chunk", "data")).mapInArrow(
        _digests, "record bigint, sha1 string, sha256 string")
    return small.unionByName(large.filter("chunk = 0").select(*about).join(digests, "record"))


def revisits(records: DataFrame, least: int = REVISITED) -> DataFrame:
    """record, and of which record it is a revisit: of_record, of_page and of_url.

    Payloads of more than a ten-thousandth of all records (and more than 1000) are at most 10,000 and are
    broadcast; so the records of a frequent payload stay where they are.
    """
    crowded = max(records.count() // 10_000, 1000)
    key = ["sha256", "n_bytes"]
    worth = records.filter(F.col("n_bytes") >= least)
    groups = worth.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "record", "url")).alias("of"))
    groups = groups.filter("n > 1")
    parts = [F.broadcast(groups.filter(F.col("n") > crowded)), groups.filter(F.col("n") <= crowded)]
    found = [worth.join(part, key).filter("record <> of.record").select(
        "record", F.col("of.record").alias("of_record"), F.col("of.page_id").alias("of_page"),
        F.col("of.url").alias("of_url")) for part in parts]
    return found[0].unionByName(found[1])


@dataclass(frozen=True)
class Archive:
    """What all records of an archive have in common."""

    name: str
    date: str
    level: int = 6

    def urn(self, record: int) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.UUID(self.name), str(record))}>"


def _line(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f-\xa0]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def _name(page_id) -> str | None:
    return None if page_id is None else quote(str(page_id), safe="")


def _page(headers: dict[str, str], name: str = "Page-ID") -> str | None:
    return unquote(headers[name]) if name in headers else None


def _http(n_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()


class WarcWriter:
    """One file, a chunk at a time."""

    def __init__(self, path: str, archive: Archive):
        store, place = fs.FileSystem.from_uri(path)
        if isinstance(store, fs.LocalFileSystem):
            store.create_dir(place.rpartition("/")[0])
        self.file, self.archive, self.n, self.size = store.open_output_stream(place, compression=None), archive, 0, 0
        self.left, self.sha1, self.digest = 0, hashlib.sha1(), None
        about = b"software: rosterloom\r\nformat: WARC File Format 1.1\r\n"
        self._start([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                     ("WARC-Date", archive.date), ("Content-Type", "application/warc-fields")], len(about))
        self._put(about)
        self._finish()

    def _put(self, data) -> None:
        packed = self.gzip.compress(data)
        self.file.write(packed)
        self.size += len(packed)

    def _start(self, headers: list[tuple[str, object]], length: int) -> None:
        self.gzip = zlib.compressobj(self.archive.level, zlib.DEFLATED, 31)
        lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {length}", "", ""]
        self._put("\r\n".join(lines).encode())

    def _finish(self) -> None:
        self._put(_END * 2)
        packed = self.gzip.flush()
        self.file.write(packed)
        self.size += len(packed)

    def start(self, row: dict) -> None:
        """The headers of a record and of its payload."""
        again = row["of_record"] is not None
        http, urn = _http(row["n_bytes"]), self.archive.urn
        self._start([
            ("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", urn(row["record"])),
            ("WARC-Date", self.archive.date), ("WARC-Target-URI", row["url"] and _line(row["url"])),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["sha1"])).decode()),
            ("WARC-Profile", PROFILE if again else None),
            ("WARC-Refers-To", urn(row["of_record"]) if again else None),
            ("WARC-Refers-To-Target-URI", _line(row["of_url"]) if again and row["of_url"] else None),
            ("WARC-Refers-To-Date", self.archive.date if again else None),
            ("Page-ID", _name(row["page_id"])), ("Refers-To-Page-ID", _name(row["of_page"])),
            ("Content-Type", "application/http; msgtype=response"),
        ], len(http) + (0 if again else row["n_bytes"]))
        self._put(http)
        self.left, self.sha1, self.digest = (0 if again else row["n_bytes"]), hashlib.sha1(), None if again else row["sha1"]
        self.n += 1

    def add(self, data) -> None:
        self.sha1.update(data)
        self.left -= len(data)
        self._put(data)

    def finish(self) -> None:
        if self.left or self.digest not in (None, self.sha1.hexdigest()):
            raise ValueError("the chunks of a record are not those that were digested")
        self._finish()

    def close(self) -> None:
        self.file.close()


_HEADERS = ["record", "page_id", "url", "n_bytes", "sha1", "of_record", "of_page", "of_url"]


def _write(folder: str, archive: Archive):
    def run(batches):
        writer, record, part = None, None, TaskContext.get().partitionId()
        path = f"{folder}/{part:06d}-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            headers = batch.select(_HEADERS).to_pylist()
            for row, data in zip(headers, batch.column("data")):
                if writer is None:
                    writer = WarcWriter(path, archive)
                if row["record"] != record:
                    if record is not None:
                        writer.finish()
                    writer.start(row)
                    record = row["record"]
                if data.is_valid:
                    writer.add(data.as_buffer())
        if writer is not None:
            writer.finish()
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, path, writer.n, writer.size)],
                                             ["shard", "path", "n_records", "n_bytes"])

    return run


def write_warc(pages: DataFrame, folder: str, size: int = CHUNK, least: int = REVISITED,
               date: str | None = None) -> DataFrame:
    """Writes (page_id, url, html) as WARC files below `folder`, and returns their manifest.

    Payloads are moved between machines only if there are too many revisits to tell every task of them;
    large ones are dealt out by record.
    """
    spark = pages.sparkSession
    small_batches(spark)
    now = datetime.datetime.now(datetime.timezone.utc)
    archive = Archive(str(uuid.uuid4()), date or now.strftime("%Y-%m-%dT%H:%M:%SZ"))
    chunk_table(pages, size).write.option("compression", "zstd").parquet(f"{folder}/chunks")
    chunks = spark.read.parquet(f"{folder}/chunks")
    records = kept_as(record_digests(chunks), f"{folder}/records")
    again = kept_as(revisits(records, least), f"{folder}/revisits")
    listed = again.select("record")
    if again.count() * 16 <= LISTED_BYTES:
        listed = F.broadcast(listed)
    none = [F.lit(None).cast(t).alias(c) for c, t in again.dtypes if c != "record"]
    about = ["record", "page_id", "url", "n_bytes", "sha1"]
    small = chunks.filter("n_chunks = 1").join(listed, "record", "left_anti").select(
        "record", "page_id", "url", "n_bytes", F.sha1("data").alias("sha1"), *none, "data")
    heads = records.filter("n_chunks > 1").join(listed, "record", "left_anti").select(*about)
    pieces = chunks.filter("n_chunks > 1").select("record", "chunk", "data").join(heads, "record")
    large = in_order(pieces).select(*about, *none, "data")
    others = records.join(again, "record").select(*about, "of_record", "of_page", "of_url", F.lit(None).cast("binary").alias("data"))
    columns = [*_HEADERS, "data"]
    rows = small.select(columns).unionAll(large.select(columns)).unionAll(others.select(columns))
    return kept_as(rows.mapInArrow(_write(f"{folder}/warc", archive), MANIFEST), f"{folder}/manifest")


class _Member:
    """The bytes of one record, unpacked as they are asked for."""

    def __init__(self, source: "_Source"):
        self.source, self.gzip, self.ready = source, zlib.decompressobj(31), b""

    def more(self) -> bool:
        while not self.gzip.eof:
            packed = self.gzip.unconsumed_tail or self.source.take()
            data = self.gzip.decompress(packed, CHUNK)
            if self.gzip.eof:
                self.source.give_back(self.gzip.unused_data)
            if data:
                self.ready += data
                return True
            if not packed:
                raise ValueError("the file ends within a record")
        return False

    def until(self, mark: bytes) -> bytes:
        start = 0
        while (at := self.ready.find(mark, start)) < 0:
            start = max(len(self.ready) - len(mark) + 1, 0)
            if not self.more():
                raise ValueError("a record without the end of its headers")
        found, self.ready = self.ready[:at], self.ready[at + len(mark):]
        return found

    def some(self, most: int) -> bytes:
        if not self.ready and not self.more():
            raise ValueError("a record that is too short")
        found, self.ready = self.ready[:most], self.ready[most:]
        return found


class _Source:
    def __init__(self, file):
        self.file, self.held = file, b""

    def take(self) -> bytes:
        data, self.held = self.held or self.file.read(READ), b""
        return data

    def give_back(self, data: bytes) -> None:
        self.held = data


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if line)


def read_file(path: str) -> Iterator[tuple[dict[str, str], dict[str, str], Iterator[bytes]]]:
    """(headers, HTTP headers, the payload in pieces) of every record but warcinfo; take all pieces before going on."""
    store, place = fs.FileSystem.from_uri(path)
    with store.open_input_file(place) as file:
        source = _Source(file)
        while data := source.take():
            source.give_back(data)
            member = _Member(source)
            headers = _fields(member.until(_END * 2))
            left, http = int(headers["Content-Length"]), {}
            if headers["WARC-Type"] != "warcinfo":
                head = member.until(_END * 2)
                left -= len(head) + 4
                http = _fields(head)

            def pieces(left=left, member=member):
                while left:
                    data = member.some(min(left, CHUNK))
                    left -= len(data)
                    yield data

            rest = pieces()
            if headers["WARC-Type"] != "warcinfo":
                yield headers, http, rest
            for _ in rest:
                pass
            if member.until(_END * 2) or member.ready or member.more():
                raise ValueError("a record is longer than it says")


def _hex(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def _read(batches):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    rows: list[tuple] = []

    def out():
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        rows.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    for path in (p for batch in batches for p in batch.column("path").to_pylist()):
        for headers, http, pieces in read_file(path):
            kind, n, sha1 = headers["WARC-Type"], 0, hashlib.sha1()
            for data in pieces:
                n += len(data)
                sha1.update(data)
            digest, told = _hex(headers["WARC-Payload-Digest"]), int(http["Content-Length"])
            if kind == "response" and (digest, told) != (sha1.hexdigest(), n):
                raise ValueError(f"{headers['WARC-Record-ID']} is not what its headers say")
            rows.append((_page(headers), headers.get("WARC-Target-URI"), told, digest, kind,
                         _page(headers, "Refers-To-Page-ID")))
            if len(rows) == 8192:
                yield out()
    if rows:
        yield out()


def _each_shard(manifest: DataFrame) -> DataFrame:
    return manifest.select("path").repartition(max(manifest.count(), 1))


def read_records(spark: SparkSession, manifest: DataFrame, page_type: str = "bigint") -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to of every record, payloads checked on the way."""
    rows = _each_shard(manifest).mapInArrow(
        _read, "page_id string, url string, payload_bytes bigint, payload_digest string, "
        "record_type string, refers_to string")
    return rows.withColumns({c: F.col(c).cast(page_type) for c in ("page_id", "refers_to")})


def _read_chunks(batches):
    for batch in batches:
        for path in batch.column("path").to_pylist():
            for headers, _, pieces in read_file(path):
                for n, data in enumerate(pieces):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([headers["WARC-Record-ID"]]), pa.array([_page(headers)], pa.string()),
                         pa.array([n], pa.int64()), pa.array([data], pa.binary())],
                        ["record_id", "page_id", "chunk", "data"])


def read_chunks(spark: SparkSession, manifest: DataFrame, page_type: str = "bigint") -> DataFrame:
    """record_id, page_id, chunk and data: the payloads of responses in pieces of at most 1 MB. Empty ones have none."""
    rows = _each_shard(manifest).mapInArrow(_read_chunks, "record_id string, page_id string, chunk bigint, data binary")
    return rows.withColumn("page_id", F.col("page_id").cast(page_type))
