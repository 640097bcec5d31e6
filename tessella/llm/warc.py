"""WARC archives as a PySpark Python data source, with reader and writer.

Records are gzip members of their own, each with a skip length in its gzip
header (extra field "sl"), so that a reader which has seen a record's WARC
headers can leave its payload compressed.  The writer's tasks write files of
their own and report them; the commit lists them, with places to cut large
files, in a manifest, so that files of failed attempts are never read.

The reader plans partitions of files and cuts; it takes comparisons of the
record type and of other header columns as pushed filters, parses headers
first, and neither inflates nor decodes the payload of a record that they
reject, nor any payload with option ``payload`` = ``none``.  With option
``verify`` = ``true`` each response's payload is held against its digest.

Paths can be local or in any store that pyarrow opens by URI.

Cases: a null html is an empty payload; equal payloads are told by SHA-1; rows
that repeat the smallest page id of their payload are responses too; an empty
table gives an archive without records; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import json
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from tessella.llm.common import fresh_path, stored

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, headers map<string,string>, payload string"
#: Header of each column that filters can be pushed to.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROLL_BYTES = 256 << 20
CUT_BYTES = 16 << 20
MANIFEST = "_manifest.json"
EPOCH = "2024-01-01T00:00:00Z"


def open_fs(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/"):  # with one slash or three
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member of ``data`` with its own length in the header."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = squeeze.compress(data) + squeeze.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = 24 + len(body)  # 10 of fixed header, 2 of extra length, 4 + 8 of the field
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data) & 0xFFFFFFFF) + body


def record(kind: str, record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None = None, date: str = EPOCH) -> bytes:
    """A response, or a revisit whose block has the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def clean(uri: str | None) -> str:
    """A header value holds no line breaks."""
    return "".join(c if c >= " " else "%%%02X" % ord(c) for c in uri or "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Written(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class WarcWriter(DataSourceWriter):
    """Rows (record_type, record_id, target_uri, payload, refers_to); payload is the full one for revisits too."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        from pyspark import TaskContext

        fs, base = open_fs(self.path)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        stem, files, out = f"part-{task.partitionId():05d}-{task.taskAttemptId()}", [], None
        for row in iterator:
            if out is None:
                files.append({"name": f"{stem}-{len(files)}.warc.gz", "cuts": [0], "size": 0})
                out = fs.open_output_stream(f"{base}/{files[-1]['name']}", compression=None)
            file, payload = files[-1], bytes(row["payload"])
            if file["size"] - file["cuts"][-1] >= CUT_BYTES:
                file["cuts"].append(file["size"])
            data = member(record(row["record_type"], row["record_id"], clean(row["target_uri"]), payload, digest_of(payload), row["refers_to"]))
            out.write(data)
            file["size"] += len(data)
            if file["size"] >= ROLL_BYTES:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages):
        fs, base = open_fs(self.path)
        fs.create_dir(base, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        with fs.open_output_stream(f"{base}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages):
        fs, base = open_fs(self.path)
        for m in messages:
            for f in m.files if m is not None else ():
                fs.delete_file(f"{base}/{f['name']}")


class Part(InputPartition):
    def __init__(self, ranges):
        super().__init__(None)
        self.ranges = ranges  # (file, start, stop or None)


def parsed(data: bytes):
    """Header names in lower case, from the lines after the first."""
    out = {}
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class Raw:
    """A file read forward, with a skip that seeks."""

    def __init__(self, file, start, stop):
        self.file, self.at, self.stop = file, start, stop
        file.seek(start)

    def peek(self, n):
        data = self.file.read(n)
        self.file.seek(self.at)
        return data

    def skip(self, n):
        self.at += n
        self.file.seek(self.at)

    def more(self):
        return self.stop is None or self.at < self.stop


def skip_length(head: bytes) -> int | None:
    if len(head) >= 12 and head[3] & 4:
        end = 12 + struct.unpack_from("<H", head, 10)[0]
        at = 12
        while at + 4 <= min(end, len(head)):
            name, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
            if name == b"sl" and size == 8 and len(head) >= at + 12:
                return struct.unpack_from("<I", head, at + 4)[0]
            at += 4 + size
    return None


class Member:
    """One gzip member, inflated no further than asked for."""

    STEP = 1 << 16

    def __init__(self, raw: Raw):
        self.raw, self.own, self.data, self.read = raw, zlib.decompressobj(31), b"", 0
        self.length = skip_length(raw.peek(64))

    def until(self, mark: bytes, start: int = 0) -> int:
        """Where ``mark`` is, or -1."""
        step = 2048
        while (at := self.data.find(mark, start)) < 0 and self._more(step):
            step = self.STEP
        return at

    def upto(self, n: int) -> bytes:
        while len(self.data) < n and self._more(max(self.STEP, n - len(self.data))):
            pass
        return self.data[:n]

    def _more(self, n: int) -> bool:
        if self.own.eof:
            return False
        feed = self.own.unconsumed_tail
        if not feed:
            self.raw.file.seek(self.raw.at + self.read)
            feed = self.raw.file.read(self.STEP)
            self.read += len(feed)
            if not feed:
                raise ValueError("a gzip member is cut short")
        self.data += self.own.decompress(feed, n)
        return True

    def close(self):
        """On to the next member: by the skip length, else by inflating."""
        if self.length is None:
            while self._more(self.STEP):
                self.data = b""
            self.length = self.read - len(self.own.unused_data)
        self.raw.skip(self.length)


class Plain:
    """One record of an uncompressed file."""

    def __init__(self, raw: Raw):
        self.raw, self.data, self.total = raw, b"", None

    def until(self, mark: bytes, start: int = 0) -> int:
        while (at := self.data.find(mark, start)) < 0:
            if not self._more(1 << 14):
                return -1
        return at

    def upto(self, n: int) -> bytes:
        while len(self.data) < n and self._more(n - len(self.data)):
            pass
        return self.data[:n]

    def _more(self, n: int) -> bool:
        self.raw.file.seek(self.raw.at + len(self.data))
        got = self.raw.file.read(n)
        self.data += got
        return bool(got)

    def close(self):
        self.raw.skip(self.total)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, verify: bool):
        self.path, self.payload, self.verify, self.tests = path, payload, verify, []

    def pushFilters(self, filters):
        """Takes equality, IN and prefixes of one header column; hands all other filters back to Spark."""
        for f in filters:
            known = isinstance(f, (EqualTo, In, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS
            values = (tuple(f.value) if isinstance(f, In) else (f.value,)) if known else ()
            if values and all(isinstance(v, str) for v in values):
                self.tests.append((HEADERS[f.attribute[0]], "start" if isinstance(f, StringStartsWith) else "in", values))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs as pafs

        fs, base = open_fs(self.path)
        manifest = f"{base}/{MANIFEST}"
        if fs.get_file_info(manifest).type == pafs.FileType.File:
            with fs.open_input_stream(manifest, compression=None) as f:
                files = json.loads(f.read())
        else:
            single = fs.get_file_info(base)
            found = [single] if single.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(base, recursive=True))
            files = [{"name": f.path[len(base) :].lstrip("/"), "cuts": [0], "size": f.size} for f in found if f.type == pafs.FileType.File and f.path.endswith((".warc", ".warc.gz"))]
        out, held, size = [], [], 0
        for f in files:
            for a, b in zip(f["cuts"], [*f["cuts"][1:], None]):
                held.append((f["name"], a, b))
                size += (b or f["size"]) - a
                if size >= CUT_BYTES:
                    out.append(Part(held))
                    held, size = [], 0
        if held:
            out.append(Part(held))
        return out or [Part([])]

    def wanted(self, headers) -> bool:
        for name, how, values in self.tests:
            own = shown(name, headers.get(name))
            if own is None or (own not in values if how == "in" else not own.startswith(values)):
                return False
        return True

    def read(self, partition):
        fs, base = open_fs(self.path)
        for name, start, stop in partition.ranges:
            with fs.open_input_file(f"{base}/{name}" if name else base) as file:
                raw, kind = Raw(file, start, stop if stop is not None else file.size()), Member if (name or base).endswith(".gz") else Plain
                while raw.more():
                    own = kind(raw)
                    end = own.until(b"\r\n\r\n")
                    if end < 0:
                        break
                    headers = parsed(own.data[:end])
                    length = int(headers.get("content-length", 0))
                    if kind is Plain:
                        own.total = end + 4 + length + 4
                    if self.wanted(headers):
                        yield self.row(own, end + 4, length, headers)
                    own.close()

    def row(self, own, start: int, length: int, headers):
        size, text, body = None, None, start
        if headers.get("content-type", "").startswith("application/http"):
            end = own.until(b"\r\n\r\n", start)
            if start <= end < start + length:
                body = end + 4
                http = parsed(own.data[start:end])
                size = int(http["content-length"]) if http.get("content-length", "").isdigit() else start + length - body
        else:
            size = length
        full = headers.get("warc-type") != "revisit"
        if full and (self.payload or self.verify):
            payload = own.upto(start + length)[body:]
            if self.verify and (want := headers.get("warc-payload-digest")) and want != f"sha1:{digest_of(payload)}":
                raise ValueError(f"the payload of {headers.get('warc-record-id')} does not have its digest")
            if self.payload:
                text = payload.decode("utf-8", "replace")
        show = lambda name: shown(name, headers.get(name))
        return (show("warc-record-id"), show("warc-type"), show("warc-target-uri"), show("warc-date"), show("warc-payload-digest"), show("warc-refers-to"), size, headers, text)


def shown(name: str, value: str | None) -> str | None:
    """A header's value as its column shows it: ids without brackets, digests bare."""
    if value is None:
        return None
    if name in ("warc-record-id", "warc-refers-to"):
        return value.removeprefix("<").removesuffix(">")
    return value.removeprefix("sha1:") if name == "warc-payload-digest" else value


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "text") != "none", self.options.get("verify", "false") == "true")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def typed(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """``pages`` with record_type and refers_to: of equal payloads the smallest id is the response;
    a page with a null id is a response only where no page with an id has its payload.

    The join that names the first page of each payload handles ids and digests
    only, from stored tables, so that a payload with very many pages can be
    split; payloads are shuffled once, by page id.
    """
    pages = pages.withColumn("_sha1", F.sha1(payload_col))
    known = stored(pages.select(F.col(id_col).alias("_page"), "_sha1", F.octet_length(payload_col).alias("_bytes")).distinct(), "digests")
    firsts = stored(known.where(F.col("_bytes") >= least_bytes).groupBy("_sha1").agg(F.min("_page").alias("_first")), "firsts")
    named = known.select("_page", "_sha1").join(firsts, "_sha1", "left").withColumnRenamed("_sha1", "_digest")
    out = pages.join(named, F.col(id_col).eqNullSafe(F.col("_page")) & F.col("_sha1").eqNullSafe(F.col("_digest")))
    again = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col(id_col))
    return out.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("_first")))


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> None:
    """A record for each row; its id is urn:page:<page id>, urn:page:null for a null id."""
    register(pages.sparkSession)
    own = pages.select(F.col(id_col).alias("_id"), F.col(uri_col).alias("target_uri"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = typed(own, "_id", "payload", least_bytes)
    name = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    rows = rows.select("record_type", name(F.coalesce(F.col("_id").cast("string"), F.lit("null"))).alias("record_id"), "target_uri", "payload", name(F.col("refers_to")).alias("refers_to"))
    rows.write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", "text" if payload else "none").option("verify", str(verify).lower()).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """What the archives of ``pages`` say, each response's payload held against its digest."""
    path = fresh_path(pages.sparkSession, "warc")
    write_pages(pages, path)
    page = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    found = read(pages.sparkSession, path, payload=False, verify=True)
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT x, min(page_id) AS first FROM p GROUP BY x)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(x, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN f USING (x)
"""
