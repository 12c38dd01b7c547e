"""WARC archives with a two-level capture index.

Records are range-partitioned and sorted by their URL key with the host reversed, so each archive file holds a
range of keys in order. The index lines of about a thousand records form a compressed block; a sparse
directory has the first key of each block, and a manifest the first and last key of each file. A
lookup searches the manifest, then the directory of one file, by bisection, and reads a block and the records it names by
byte range. All files lie in one shared folder, under names that only a task which succeeded makes known. Payloads are exchanged once: which
pages revisit another one is found by digests and ids, and these short rows go along the same ranges.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, shared_dir, written

#: A block of the index ends at so many records or so many bytes of archive.
BLOCK_RECORDS, BLOCK_BYTES = 1000, 8 << 20
#: A task goes on in a new file once one has so many bytes.
FILE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"
LEVEL = 6


def url_key(url: Column) -> Column:
    """Host labels from the last to the first, then `)` and the rest of the URL: http://a.b.org:80/x -> org,b,a)/x. Null: empty."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)(?::[0-9]*)?(.*)$"
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(url, pattern, 1)), r"\.")), ",")
    return F.when(url.rlike(pattern), F.concat(host, F.lit(")"), F.regexp_extract(url, pattern, 2))).otherwise(url)


@dataclass(frozen=True)
class Archive:
    """The folder and, for each archive file, (part, first_key, last_key, warc, index, directory_at, directory_bytes, blocks, records)."""

    folder: str
    manifest: DataFrame


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member of its own. The block is an HTTP response; a revisit keeps its headers and no payload."""
    kind = "response" if refers_to is None else "revisit"
    target = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one uncompressed record; header names in lower case."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = fields(lines[1:])
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http.decode("latin-1").split("\r\n")[1:]), payload


MANIFEST = "part int, first_key string, last_key string, warc string, index string, directory_at bigint, directory_bytes bigint, blocks int, records bigint"


class _File:
    """An archive file and its index while they are written."""

    def __init__(self, system: fs.FileSystem, path: str, part: int):
        self.part, name = part, f"part-{part:05d}-{uuid.uuid4().hex}"
        self.names = f"{name}.warc.gz", f"{name}.idx"
        self.warc, self.index = (system.open_output_stream(posixpath.join(path, x), compression=None) for x in self.names)
        self.lines: list[str] = []
        self.directory: list[tuple[str, int, int, int, int]] = []
        self.at = self.block_at = self.index_at = self.records = 0

    def add(self, key: str, page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str) -> None:
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        record = _record(page_id, url, payload, digest, refers_to, date)
        self.warc.write(record)
        if not self.lines:
            self.block_key = key
        self.lines.append(json.dumps({"key": key, "page_id": page_id, "url": url, "digest": digest, "offset": self.at, "length": len(record), "refers_to": refers_to}))
        self.at, self.records, self.last = self.at + len(record), self.records + 1, key
        if len(self.lines) == BLOCK_RECORDS or self.at - self.block_at >= BLOCK_BYTES:
            self._close_block()

    def _close_block(self) -> None:
        block = zlib.compress("\n".join(self.lines).encode(), LEVEL)
        self.index.write(block)
        self.directory.append((self.block_key, self.index_at, len(block), self.block_at, self.at - self.block_at))
        self.index_at, self.block_at = self.index_at + len(block), self.at
        self.lines.clear()

    def close(self) -> pa.RecordBatch:
        """Its row of the manifest."""
        if self.lines:
            self._close_block()
        sparse = zlib.compress(json.dumps(self.directory).encode(), LEVEL)
        self.index.write(sparse)
        self.warc.close()
        self.index.close()
        row = [self.part, self.directory[0][0], self.last, *self.names, self.index_at, len(sparse), len(self.directory), self.records]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [x.split()[0] for x in MANIFEST.split(", ")])


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None, date: str = DATE) -> Archive:
    """Writes all rows; each is one record.

    * The payload is the text in UTF-8, null: empty. Of rows with equal payloads (empty ones too) that with the
      smallest id becomes the response, the others revisits of it; rows that repeat that id are responses too. A row of null id
      is a response, and no other row refers to it. A null URL is the empty URL.
    * Other columns are ignored. An empty table gives an archive without files.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark)
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"), F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).alias("payload"))
    rows = rows.withColumn("same", F.unhex(F.sha2("payload", 256))).withColumn("key", url_key(F.col("url")))
    keys = written(rows.select("key", "page_id", "same"))
    # one row for each payload that occurs twice, counted before the shuffle; a payload that very many rows share is a skewed key of a join that Spark can split
    first = keys.filter("page_id is not null").groupBy("same").agg(F.min("page_id").alias("response"), F.max("page_id").alias("_last")).filter("response <> _last").select("same", "response")
    # a row without URL and payload goes before the rows that it makes revisits
    marks = keys.join(first, "same").filter("page_id > response").select("key", "page_id", "same", F.col("response").alias("refers_to"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"))
    rows = rows.select("key", "page_id", "same", F.lit(None).cast("bigint").alias("refers_to"), "url", "payload").unionByName(marks)
    rows = rows.repartitionByRange(partitions(spark), "key", "page_id").sortWithinPartitions("key", "page_id", "same", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        system, path = _file_system(folder)
        system.create_dir(path, recursive=True)
        file, marked, response = None, None, None
        for batch in batches:
            for key, page_id, same, refers_to, url, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if url is None:
                    marked, response = (key, page_id, same), refers_to
                    continue
                file = file or _File(system, path, part)
                file.add(key, page_id, url, payload.encode(), response if marked == (key, page_id, same) else None, date)
                if file.at >= FILE_BYTES:
                    yield file.close()
                    file = None
        if file:
            yield file.close()

    return Archive(folder, written(rows.mapInArrow(run, MANIFEST)))


class _Reader:
    """One archive file with its index, by range reads."""

    def __init__(self, folder: str, warc: str, index: str, directory_at: int, directory_bytes: int):
        system, path = _file_system(folder)
        self.warc, self.index = system.open_input_file(posixpath.join(path, warc)), system.open_input_file(posixpath.join(path, index))
        self.directory = json.loads(zlib.decompress(self.index.read_at(directory_bytes, directory_at)))
        self.keys = [d[0] for d in self.directory]
        self.read: tuple[int, list[dict]] = -1, []

    def lines(self, block: int) -> list[dict]:
        """The lines of a block; the last one read is kept, for keys that are asked in order."""
        if self.read[0] != block:
            _, at, n, *_ = self.directory[block]
            self.read = block, [json.loads(x) for x in zlib.decompress(self.index.read_at(n, at)).decode().split("\n")]
        return self.read[1]

    def captures(self, key: str) -> Iterator[dict]:
        """The index lines of a key: it can begin in the block before the first one that starts with it, and go on over several."""
        for block in range(max(bisect.bisect_left(self.keys, key) - 1, 0), len(self.keys)):
            if self.keys[block] > key:
                return
            lines = self.lines(block)
            a = bisect.bisect_left(lines, key, key=lambda x: x["key"])
            yield from lines[a : bisect.bisect_right(lines, key, key=lambda x: x["key"])]

    def records(self, lines: list[dict]) -> Iterator[bytes]:
        """The records of lines that follow one another in the archive, by one range read."""
        first = lines[0]["offset"]
        stretch = self.warc.read_at(lines[-1]["offset"] + lines[-1]["length"] - first, first)
        for x in lines:
            yield zlib.decompress(stretch[x["offset"] - first : x["offset"] - first + x["length"]], 31)

    def close(self) -> None:
        self.warc.close()
        self.index.close()


RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload string"


def _read_back(line: dict, data: bytes) -> tuple:
    """A record as a row of RECORDS; a payload must match its digest."""
    warc, http, payload = parse_record(data)
    of = lambda x: int(x) if (x := x.strip("<>").removeprefix("urn:page:")) else None
    digest, kind = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"]
    if kind == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(http["content-length"])):
        raise ValueError(f"damaged record of {line['url']}")
    return of(warc["warc-record-id"]), line["url"], kind, of(warc["warc-refers-to"]) if kind == "revisit" else None, digest, int(http["content-length"]), payload.decode() if kind == "response" else None


def _record_batch(rows: list[tuple], extra: list[tuple[str, pa.DataType]] = ()) -> pa.RecordBatch:
    kinds = [*extra, *((x.split()[0], {"bigint": pa.int64(), "string": pa.string()}[x.split()[1]]) for x in RECORDS.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])


def read_archive(archive: Archive) -> DataFrame:
    """RECORDS of all records, block by block: each task range-reads an index block and the stretch of archive that it describes. A revisit has no payload.

    Pages of null id, URL or payload, and repeated ones, come back as they were written: null URLs and payloads as empty texts. An archive without
    files gives an empty result; a record that doesn't match its digest or length is an error.
    """
    folder = archive.folder
    n = partitions(archive.manifest.sparkSession)
    files = archive.manifest.select("part", "warc", "index", "directory_at", "directory_bytes", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, opened = None, None
        for batch in batches:
            for _, warc, index, directory_at, directory_bytes, block in zip(*(c.to_pylist() for c in batch.columns)):
                if opened != warc:
                    if reader:
                        reader.close()
                    reader, opened = _Reader(folder, warc, index, directory_at, directory_bytes), warc
                lines = reader.lines(block)
                yield _record_batch([_read_back(x, data) for x, data in zip(lines, reader.records(lines))])
        if reader:
            reader.close()

    return files.repartition(n, "warc", "block").sortWithinPartitions("warc", "block").mapInArrow(run, RECORDS)


def captures(archive: Archive, keys: DataFrame, key_col: str = "key") -> DataFrame:
    """(key, *RECORDS): all captures of each distinct URL key, each once, through the index.

    The files whose range holds a key are bisected from the manifest; in each, blocks of the index are bisected from its directory, lines from
    the block, and the records of neighbouring lines come by one range read. A key of very many captures lies in many files, each of which is read by itself. The
    manifest, one row for each archive file, comes to the driver; the directories stay in the files. Keys without captures, and null keys, give no row.
    """
    spark = archive.manifest.sparkSession
    folder = archive.folder
    rows = archive.manifest.orderBy("first_key", "last_key", "part").collect()
    firsts, lasts = [r.first_key for r in rows], [r.last_key for r in rows]
    places = [(r["warc"], r["index"], r["directory_at"], r["directory_bytes"]) for r in rows]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The files whose range of keys holds a key."""
        for batch in batches:
            out = [(k, f) for k in batch.column(0).to_pylist() for f in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32())], ["key", "file"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, opened, held = None, None, []

        def read() -> pa.RecordBatch:
            out = _record_batch([(x["key"], *_read_back(x, data)) for x, data in zip(held, reader.records(held))], [("key", pa.string())])
            held.clear()
            return out

        for batch in batches:
            for key, file in zip(*(batch.column(i).to_pylist() for i in range(2))):
                if opened != file:
                    if held:
                        yield read()
                    if reader:
                        reader.close()
                    reader, opened = _Reader(folder, *places[file]), file
                for line in reader.captures(key):
                    if held and (line["offset"] != held[-1]["offset"] + held[-1]["length"] or line["offset"] - held[0]["offset"] >= BLOCK_BYTES or len(held) >= BLOCK_RECORDS):
                        yield read()
                    held.append(line)
        if held:
            yield read()
        if reader:
            reader.close()

    wanted = keys.select(F.col(f"`{key_col}`").cast("string").alias("key")).filter("key is not null").distinct().mapInArrow(find, "key string, file int")
    # all keys of a file in order: each block of its index is read once
    wanted = wanted.repartition(partitions(spark), "file").sortWithinPartitions("file", "key")
    return wanted.mapInArrow(run, f"key string, {RECORDS}")


def lookup(archive: Archive, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """(query_url, *RECORDS): all captures of each distinct URL, compared by key; URLs without captures give no row. Null is the empty URL."""
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    asked = urls.select(url.alias("query_url"), url_key(url).alias("key")).distinct()
    found = captures(archive, asked)
    return asked.join(found, "key").select("query_url", *[x.split()[0] for x in RECORDS.split(", ")])
