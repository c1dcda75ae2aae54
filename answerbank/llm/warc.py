"""WARC archives as a PySpark Python data source (operator 12).

``register(spark)`` makes the format ``warc`` known.  Reading:

* Planning: a folder's archives (``.warc``, ``.warc.gz``) are dealt to partitions of about ``partition_bytes``; one file is never split.  Where
  this writer left commit files, only the archives that they name are read, so what lost tasks left behind does not count.
* Pushdown: predicates on header columns (``HEADERS``) are tested inside the reader; Spark keeps the others.  ``load_records`` does this.  A
  plain ``spark.read.format("warc")`` pushes nothing unless its option ``pushdown`` is true, because Spark 4.1 keeps a relation's reader with the
  predicates it got last, also for later queries over the same DataFrame that have none.
* Headers first: of each record only the header block is inflated and parsed at first.  A record that fails a predicate, or whose payload
  is not among the columns asked for (``.schema(...)``), is skipped: by Content-Length in a plain archive, by the member length
  in the gzip field ``sl`` that this writer leaves, else by inflating without decoding.

Writing takes rows with the columns of ``RECORD`` that it finds; each record is one gzip member.  A response or revisit block is an HTTP
message; the revisit holds its headers only, whose Content-Length is that of the payload left out.  A task writes files under new names and
reports them; the commit file that names them is written when all tasks are done.

``archived`` decides what is a response and what revisits it, ``read_pages`` reads it back.  Defined cases: a null payload reads as empty; of
records with equal payloads of ``LEAST_BYTES`` or more all rows with the largest id are responses (several only if an id repeats), rows
without an id revisit it, and without any id all are responses; a null or empty URL is kept as such, line breaks in one are written
``%0D`` and ``%0A``; a truncated or foreign record is an error that names file and offset.  Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
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
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from answerbank.llm.common import scratch_table, table

LEAST_BYTES = 1000
PARTITION_BYTES, ROLL_BYTES = 64 << 20, 256 << 20
#: What is read of a record before its headers are known, and at once from a file.
HEAD_BYTES, READ_BYTES = 4096, 1 << 20
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2048
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Columns that are WARC headers (fixed values); predicates on them are pushed down.
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
RECORD = StructType([StructField(name, StringType()) for name in HEADERS])
RECORD = RECORD.add("payload_length", LongType()).add("payload", BinaryType()).add("path", StringType()).add("offset", LongType())


def file_system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# --- one record -------------------------------------------------------------------------------------------------------------------


def header_value(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(row: dict) -> bytes:
    """One record from header columns and payload."""
    import base64
    import hashlib

    kind, payload = row.get("record_type") or "resource", row.get("payload")
    payload = payload.encode() if isinstance(payload, str) else payload or b""
    digest = row.get("payload_digest")
    if digest is None and kind != "revisit":
        digest = hashlib.sha1(payload).hexdigest()
    n = len(payload) if row.get("payload_length") is None else row["payload_length"]
    lines = ["WARC/1.1", f"WARC-Type: {header_value(kind)}", f"WARC-Record-ID: <{header_value(row.get('record_id') or f'urn:uuid:{uuid.uuid4()}')}>"]
    lines.append(f"WARC-Date: {header_value(row.get('date') or '1970-01-01T00:00:00Z')}")
    if row.get("target_uri") is not None:
        lines.append(f"WARC-Target-URI: {header_value(row['target_uri'])}")
    if digest is not None:
        lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if row.get("refers_to") is not None:
        lines.append(f"WARC-Refers-To: <{header_value(row['refers_to'])}>")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    if kind in ("response", "revisit"):
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
        block += b"" if kind == "revisit" else payload
        lines.append("Content-Type: application/http; msgtype=response")
    else:
        block = payload
        lines.append("Content-Type: text/html; charset=utf-8")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member; its ``sl`` field holds the lengths of the member and of ``data``, where they fit."""
    import struct
    import zlib

    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    tail = body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if max(total, len(data)) >> 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\0\xff" + tail
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(data)) + tail


def member_length(head: bytes) -> int | None:
    """The member's length by its ``sl`` field, if it has one."""
    if len(head) < 12 or not head[3] & 4:
        return None
    extra = head[12 : 12 + int.from_bytes(head[10:12], "little")]
    while len(extra) >= 4:
        size = int.from_bytes(extra[2:4], "little")
        if extra[:2] == b"sl" and size == 8:
            return int.from_bytes(extra[4:8], "little")
        extra = extra[4 + size :]
    return None


def parsed_headers(block: bytes) -> dict[str, str]:
    """Header names in lower case and their values; folded lines are joined, of repeated names the first counts."""
    lines: list[str] = []
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip(" \t")
        elif line:
            lines.append(line)
    found: dict[str, str] = {}
    for line in lines:
        name, _, value = line.partition(":")
        found.setdefault(name.strip().lower(), value.strip(" \t"))
    return found


def header_column(name: str, headers: dict[str, str]) -> str | None:
    """A header as its column shows it: ids without brackets, sha1 digests as lower-case hex."""
    value = headers.get(HEADERS[name])
    if value is None:
        return None
    if name in ("record_id", "refers_to"):
        return value.removeprefix("<").removesuffix(">")
    if name == "payload_digest" and value.lower().startswith("sha1:"):
        import base64

        digest = value[5:]
        try:
            return base64.b32decode(digest.upper()).hex() if len(digest) == 32 else digest.lower()
        except ValueError:
            return value
    return value


def unchunked(body: bytes) -> bytes:
    """The entity of a chunked HTTP body."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def http_parts(headers: dict[str, str]) -> bool:
    return headers.get("content-type", "").replace(" ", "").lower().startswith("application/http")


# --- reading one file -------------------------------------------------------------------------------------------------------------


class Window:
    """Bytes of a file by place, read in large blocks."""

    def __init__(self, file):
        self.file, self.size, self.start, self.data = file, file.size(), 0, b""

    def take(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if not self.start <= at <= at + n <= self.start + len(self.data):
            self.start, self.data = at, self.file.read_at(min(max(n, READ_BYTES), self.size - at), at)
        return self.data[at - self.start : at - self.start + n]


class PlainRecord:
    """A record of an uncompressed archive."""

    def __init__(self, window: Window, at: int):
        self.window, self.at, self.got = window, at, HEAD_BYTES

    def until(self, mark: bytes, begin: int) -> int:
        """Where ``mark`` ends, searched from ``begin`` on; -1 if the file ends before."""
        while True:
            found = self.window.take(self.at, self.got).find(mark, begin)
            if found >= 0:
                return found + len(mark)
            if self.at + self.got >= self.window.size:
                return -1
            self.got *= 2

    def part(self, low: int, high: int) -> bytes:
        return self.window.take(self.at + low, high - low)

    def check(self) -> None:
        """A plain archive has no checksum of its own."""

    def end(self, length: int) -> int:
        end = self.at + length
        while self.window.take(end, 1) in (b"\r", b"\n"):
            end += 1
        return end


class GzipRecord:
    """A record that is one gzip member, inflated only as far as it is looked at."""

    def __init__(self, window: Window, at: int):
        import zlib

        self.window, self.at, self.fed = window, at, at
        self.length = member_length(window.take(at, 512))
        self.inflate, self.data = zlib.decompressobj(31), b""

    def more(self, most: int = 0) -> bytes:
        """Further inflated bytes (``most`` at most, 0: no bound); empty at the member's end."""
        while not self.inflate.eof:
            raw = self.inflate.unconsumed_tail
            if not raw:
                step = HEAD_BYTES if self.fed == self.at else READ_BYTES
                stop = self.window.size if self.length is None else self.at + self.length
                raw = self.window.take(self.fed, min(step, stop - self.fed))
                self.fed += len(raw)
                if not raw:
                    raise EOFError
            out = self.inflate.decompress(raw, most)
            if out:
                return out
        return b""

    def until(self, mark: bytes, begin: int) -> int:
        while (found := self.data.find(mark, begin)) < 0:
            got = self.more(HEAD_BYTES)
            if not got:
                return -1
            self.data += got
        return found + len(mark)

    def part(self, low: int, high: int) -> bytes:
        blocks, have = [self.data], len(self.data)
        while have < high and (got := self.more()):
            blocks.append(got)
            have += len(got)
        self.data = b"".join(blocks)
        return self.data[low:high]

    def check(self) -> None:
        """Inflate to the member's end, where its checksum is tested."""
        while self.more(READ_BYTES):
            pass

    def end(self, length: int) -> int:
        if self.length is not None:
            return self.at + self.length
        self.check()
        return self.fed - len(self.inflate.unused_data)


def records(window: Window, path: str, wanted: Callable[[dict[str, str]], bool], columns: list[str]) -> Iterator[dict]:
    """The wanted records of a file, with the columns asked for."""
    import zlib

    at = 0
    while at < window.size:
        try:
            record = (GzipRecord if window.take(at, 2) == b"\x1f\x8b" else PlainRecord)(window, at)
            body = record.until(b"\r\n\r\n", 0)
            head = record.part(0, body) if body > 0 else b""
            if not head.startswith(b"WARC/"):
                raise ValueError("no record starts here")
            headers = parsed_headers(head)
            length = body + int(headers["content-length"])
            if wanted(headers):
                row = {name: header_column(name, headers) for name in columns if name in HEADERS}
                row |= {"path": path, "offset": at}
                if "payload" in columns or "payload_length" in columns:
                    row |= payload_columns(record, headers, body, length, "payload" in columns)
                yield row
            at = record.end(length)
        except (ValueError, KeyError, EOFError, zlib.error) as broken:
            raise ValueError(f"{path}: broken record at offset {at}: {broken!r}") from broken


def payload_columns(record, headers: dict[str, str], body: int, length: int, decode: bool) -> dict:
    """``payload_length`` and, if asked for, ``payload``."""
    import zlib

    if not http_parts(headers):
        payload = record.part(body, length) if decode else None
        if decode:
            if len(payload) != length - body:
                raise EOFError("payload ends early")
            record.check()
        return {"payload_length": length - body, "payload": payload}
    start = record.until(b"\r\n\r\n", body)
    start = length if start < 0 else min(start, length)
    http = parsed_headers(record.part(body, start))
    chunked = "chunked" in http.get("transfer-encoding", "").lower()
    coded = http.get("content-encoding", "").lower().strip()
    stated = http.get("content-length", "")
    plain = not chunked and coded not in ("gzip", "deflate")
    if headers.get("warc-type") == "revisit":
        return {"payload_length": int(stated) if plain and stated.isdigit() else None, "payload": None}
    if plain and not decode:
        return {"payload_length": length - start, "payload": None}
    payload = record.part(start, length)
    if len(payload) != length - start:
        raise EOFError("payload ends early")
    record.check()
    payload = unchunked(payload) if chunked else payload
    if coded == "gzip":
        payload = zlib.decompress(payload, 47)
    elif coded == "deflate":
        payload = zlib.decompress(payload)
    return {"payload_length": len(payload), "payload": payload if decode else None}


# --- the data source --------------------------------------------------------------------------------------------------------------


def tested(found: Filter) -> Callable[[dict[str, str]], bool] | None:
    """A predicate on parsed headers for a filter that the reader can answer; None for others."""
    if isinstance(found, Not):
        inner = tested(found.child)
        if inner is None or not isinstance(found.child, (EqualTo, In, StringContains, StringStartsWith, StringEndsWith)):
            return None
        name = found.child.attribute[0]  # NOT of a comparison with null is null: the row goes
        return lambda h: header_column(name, h) is not None and not inner(h)
    if not hasattr(found, "attribute") or len(found.attribute) != 1 or found.attribute[0] not in HEADERS:
        return None
    name, value = found.attribute[0], getattr(found, "value", None)
    of = lambda h: header_column(name, h)
    if isinstance(found, (EqualTo, EqualNullSafe)):
        return lambda h: of(h) == value
    if isinstance(found, In):
        return lambda h: of(h) is not None and of(h) in found.value
    if isinstance(found, IsNull):
        return lambda h: of(h) is None
    if isinstance(found, IsNotNull):
        return lambda h: of(h) is not None
    for kind, holds in ((StringStartsWith, str.startswith), (StringEndsWith, str.endswith), (StringContains, str.__contains__)):
        if isinstance(found, kind):
            return lambda h: of(h) is not None and holds(of(h), value)
    return None


class Files(InputPartition):
    """Archives read by one task."""


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.fields, self.options, self.filters = schema, options, []

    def pushFilters(self, filters: list[Filter]):
        push = self.options.get("pushdown", "").lower() == "true"
        for found in filters:
            if not push or tested(found) is None:
                yield found  # stays with Spark
            else:
                self.filters.append(found)

    def partitions(self) -> list[Files]:
        import json

        from pyarrow import fs

        system, root = file_system(self.options["path"])
        top = system.get_file_info(root)
        infos = [top] if top.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=False))
        commits = [x for x in infos if x.base_name.startswith("_committed-")]
        if commits:
            named: set[str] = set()
            for commit in commits:
                with system.open_input_file(commit.path) as file:
                    named.update(json.loads(file.read()))
            infos = [x for x in infos if x.base_name in named]
            if len(infos) != len(named):
                raise ValueError(f"{root}: committed archives are missing")
        files = sorted((x.path, x.size) for x in infos if x.base_name.endswith((".warc", ".warc.gz")) and x.size)
        limit, out, room = int(self.options.get("partition_bytes", PARTITION_BYTES)), [], 0
        for path, size in files:
            if size > room:
                out.append([])
                room = limit
            out[-1].append(path)
            room -= size
        return [Files(paths) for paths in out]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        columns = self.fields.names
        system, _ = file_system(self.options["path"])
        tests = [tested(x) for x in self.filters]
        kinds = {"payload": pa.binary(), "payload_length": pa.int64(), "offset": pa.int64()}
        schema = pa.schema([(name, kinds.get(name, pa.string())) for name in columns])
        rows, size = [], 0
        for path in partition.value:
            with system.open_input_file(path) as file:
                for row in records(Window(file), path, lambda h: all(test(h) for test in tests), columns):
                    rows.append(row)
                    size += len(row.get("payload") or b"")
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.options, self.overwrite = options, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.options["path"])
        level, roll = int(self.options.get("level", 6)), int(self.options.get("roll_bytes", ROLL_BYTES))
        system.create_dir(root, recursive=True)
        names, file = [], None
        try:
            for batch in iterator:
                for k in range(batch.num_rows):
                    if file is None or file.tell() >= roll:
                        if file is not None:
                            file.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        file = system.open_output_stream(f"{root}/{names[-1]}", compression=None)
                    file.write(member(record_bytes({c: batch.column(c)[k].as_py() for c in batch.schema.names}), level))
        finally:
            if file is not None:
                file.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        import json

        from pyarrow import fs

        system, root = file_system(self.options["path"])
        system.create_dir(root, recursive=True)
        earlier = [x.path for x in system.get_file_info(fs.FileSelector(root)) if x.base_name.startswith("_committed-")]
        name = uuid.uuid4().hex
        with system.open_output_stream(f"{root}/_new-{name}") as file:
            file.write(json.dumps([n for m in messages if m is not None for n in m.names]).encode())
        system.move(f"{root}/_new-{name}", f"{root}/_committed-{name}.json")
        for path in earlier if self.overwrite else []:
            system.delete_file(path)

    def abort(self, messages: list) -> None:
        """Files of a failed write stay unnamed, so no reader sees them."""


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> StructType:
        return RECORD

    def reader(self, schema: StructType) -> WarcReader:
        for field in schema:
            if field.name not in RECORD.names or field.dataType != RECORD[field.name].dataType:
                raise ValueError(f"no such column in a WARC record: {field.simpleString()}")
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format ``warc`` known to a session and let predicates reach Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def load_records(spark: SparkSession, path: str, where: Column | str | None = None, columns: str | StructType = RECORD) -> DataFrame:
    """Records of the archives under ``path`` that meet ``where``; a payload is decoded only if it is among ``columns``.

    Each call is a relation of its own, and no later filter passes the always-true one at the end, so the reader only
    ever sees the predicates of ``where``.
    """
    register(spark)
    found = spark.read.format("warc").schema(columns).option("pushdown", str(where is not None)).load(path)
    return found if where is None else found.filter(where).filter(F.monotonically_increasing_id() >= 0)


# --- pages ------------------------------------------------------------------------------------------------------------------------


def archived(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write a record per row of ``pages`` (page_id, url, html): equal payloads once, the others as revisits."""
    register(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_length"))
    same = ["payload_digest", "payload_length"]
    # Payloads that occur once drop out of this table; as a file it has a known size, and a hot payload's join can be split.
    repeated = rows.filter(F.col("payload_length") >= least_bytes).groupBy(*same).agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    rows = rows.join(scratch_table(repeated.filter("n > 1").drop("n"), "warc-repeated"), same, "left")
    revisit = F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("page_id"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows.select(
        urn("page_id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        *same,
        F.when(revisit, urn("kept")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` of archived pages.

    Responses are measured by their decoded payloads, revisits by their headers; no payload is decoded for the latter.
    """
    fields = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_length long"
    responses = load_records(spark, path, "record_type = 'response'", f"{fields}, payload binary")
    responses = responses.withColumn("payload_digest", F.sha1("payload"))
    responses = responses.withColumn("payload_length", F.octet_length("payload").cast("long")).drop("payload")
    found = responses.unionByName(load_records(spark, path, "record_type = 'revisit'", fields))
    page = lambda c: F.nullif(F.expr(f"substring({c}, {len('urn:page:') + 1})"), F.lit("")).cast(id_type)
    return found.select(
        page("record_id").alias("page_id"),
        F.col("target_uri").alias("url"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        page("refers_to").alias("refers_to"),
    )


def archived_pages(spark, sf_dir: str) -> DataFrame:
    """Query op12: every page written to archives in the shared folder and read back."""
    from answerbank.session import ensure_checkpoint_dir

    pages = table(spark, sf_dir, "pages")
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    archived(pages, path)
    return read_pages(spark, path, pages.schema["page_id"].dataType.simpleString())
