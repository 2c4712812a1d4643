"""Legacy archive converter: ARC files to WARC files, and back to rows.

An ARC file opens with a version block that names the layout of its records'
header lines: version 1 has five fields (URL, IP address, date, content type,
length), version 2 ten (with result code, checksum, location, offset and file
name before the length).  Every record is its header line, exactly the
declared number of bytes, and a line end.  The converter parses this and
synthesises what WARC wants and ARC lacks: record ids (name-based UUIDs, the
same on every run), ISO dates, record types, block and payload digests.

Records whose payload was seen before become ``revisit`` records that refer to
the response with the smallest key.  Only digests and places (file, sequence
number) are shuffled; a converting task walks one ARC file and its decisions
side by side, so payloads move from file to file and never through a shuffle,
and a payload repeated in a third of all records is one partial row per task
in the grouping and one split join.

Files are written record by record, compressed singly, and begin anew at
``FILE_BYTES``.  Write attempts use names of their own; only those of
successful tasks are listed.

Defined results: null html is an empty payload; a null page id is a record
without that header and ranks last; of repeated page ids the first in file
order is the response; a null or odd URL is written percent-encoded; an empty
table makes no record; other columns take no part.  A damaged ARC record
raises ``ValueError`` naming the file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, open_store, pin, shared_folder

#: header fields by ARC version (fixed values of the format)
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location",
        "Offset", "Filename", "Archive-length"],
}
#: a file is closed and the next begun once it holds so many bytes
FILE_BYTES = 64 << 20
#: rows handed back at a time once they hold so many bytes
FLUSH_BYTES = 8 << 20
PAGE_ID = "X-Page-Id"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_response(page_id: int | None, payload: bytes) -> bytes:
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if page_id is not None:
        head += f"{PAGE_ID}: {page_id}\r\n"
    return (head + f"Content-Length: {len(payload)}\r\n\r\n").encode() + payload


def split_http(body: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Header block with its end, its fields by lower-case name, payload."""
    head, gap, payload = body.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("latin-1").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return head + gap, fields, payload


class _Rolling:
    """Writes gzip members to files below a folder, a new one every ``FILE_BYTES``."""

    def __init__(self, folder: str, name: str, ending: str, opening):
        self.fs, self.path = open_store(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.name, self.ending, self.opening = name, ending, opening
        self.out, self.done, self.records = None, [], 0

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.file = f"{self.name}-{len(self.done):05d}-{uuid.uuid4().hex}.{self.ending}.gz"
            self.out, self.size, self.records = self.fs.open_output_stream(f"{self.path}/{self.file}", compression=None), 0, 0
            self._put(self.opening(self.file))
        self._put(record)
        self.records += 1
        if self.size >= FILE_BYTES:
            self.close()

    def _put(self, record: bytes) -> None:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = z.compress(record) + z.flush()
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append({"file": self.file, "records": self.records})
            self.out = None

    def listed(self) -> pa.RecordBatch:
        self.close()
        return pa.RecordBatch.from_pylist(self.done, schema=pa.schema([("file", pa.string()), ("records", pa.int64())]))


def _reader(folder: str, file: str):
    fs, path = open_store(folder)
    return gzip.GzipFile(fileobj=fs.open_input_stream(f"{path}/{file}", compression=None, buffer_size=1 << 20))


# ---- ARC ---------------------------------------------------------------

def arc_opening(version: int, date: str):
    """Version block of a file, as a function of the file's name."""
    def make(file: str) -> bytes:
        block = f"{version} 0 martwright\n{' '.join(FIELDS[version])}\n".encode()
        lead = [f"filedesc://{file}", "0.0.0.0", date, "text/plain"]
        if version == 2:
            lead += ["200", "-", "-", "0", file]
        return " ".join([*lead, str(len(block))]).encode() + b"\n" + block + b"\n"
    return make


def arc_record(version: int, url: str, date: str, body: bytes) -> bytes:
    safe = urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") or "-"
    line = [safe, "0.0.0.0", date, "text/html"]
    if version == 2:
        line += ["200", sha1_base32(body), "-", "0", "-"]
    return " ".join([*line, str(len(body))]).encode() + b"\n" + body + b"\n"


def parse_arc(stream, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of each record after the version block.  Header
    lines are read by the layout the block declares; bodies by their length."""
    def body(length: str) -> bytes:
        if not length.isdigit():
            raise ValueError(f"{name}: length {length!r} is not a number")
        data = stream.read(int(length))
        if len(data) != int(length):
            raise ValueError(f"{name}: record of {length} bytes ends after {len(data)}")
        return data

    first = stream.readline().decode().rstrip("\n").split(" ")
    if not first[0].startswith("filedesc://"):
        raise ValueError(f"{name}: no ARC version block")
    said = body(first[-1]).decode().split("\n")
    version = int(said[0].split(" ")[0])
    fields = said[1].split(" ")
    if FIELDS.get(version) != fields or len(first) != len(fields):
        raise ValueError(f"{name}: header layout does not fit ARC version {version}")
    while line := stream.readline():
        if line == b"\n":
            continue
        values = line.decode().rstrip("\n").split(" ")
        if len(values) != len(fields):
            raise ValueError(f"{name}: header line of {len(values)} fields, version {version} has {len(fields)}")
        head = dict(zip(fields, values, strict=True))
        yield head, body(head["Archive-length"])


def write_arc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html", date: str = "20240101000000") -> DataFrame:
    """Write the pages as ARC files (partitions alternate between versions 1
    and 2), ``file, records`` of each."""
    src = pages.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("_url"),
                       F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("_html"))

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        version = 1 + part % 2
        out = _Rolling(folder, f"part-{part:06d}", "arc", arc_opening(version, date))
        for b in batches:
            for i, url, html in zip(*(b.column(c) for c in ("_id", "_url", "_html")), strict=True):
                body = http_response(i.as_py(), html.as_py().encode("utf-8", "surrogatepass"))
                out.add(arc_record(version, url.as_py(), date, body))
        yield out.listed()

    return pin(map_arrow(src, run, "file string, records long"))


def _one_file_per_task(files: DataFrame) -> DataFrame:
    n = max(1, files.count())
    return files.select("file").repartitionById(n, F.pmod(F.xxhash64("file"), F.lit(n)).cast("int"))


def arc_index(files: DataFrame, folder: str) -> DataFrame:
    """``_file, _seq, _id, _bytes, _digest`` of every record of the ARC files."""
    def run(batches):
        for file in (f for b in batches for f in b.column("file").to_pylist()):
            rows = []
            with _reader(folder, file) as s:
                for seq, (_, body) in enumerate(parse_arc(s, file)):
                    _, fields, payload = split_http(body)
                    i = fields.get(PAGE_ID.lower())
                    rows.append({"_file": file, "_seq": seq, "_id": None if i is None else int(i),
                                 "_bytes": len(payload), "_digest": sha1_base32(payload)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("_file", pa.string()), ("_seq", pa.int64()), ("_id", pa.int64()), ("_bytes", pa.int64()), ("_digest", pa.string())]))

    return map_arrow(_one_file_per_task(files), run, "_file string, _seq long, _id long, _bytes long, _digest string")


# ---- WARC --------------------------------------------------------------

def record_id(file: str, seq: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file.rpartition('-')[0]}#{seq}')}>"


def iso_date(arc_date: str) -> str:
    """14-digit ARC date (12 digits: without seconds; 8: midnight) as WARC-Date."""
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)
    return (head + f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def warc_opening(file: str) -> bytes:
    block = b"software: martwright\r\nformat: WARC File Format 1.1\r\n"
    return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, file)}>"),
                        ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Filename", file),
                        ("Content-Type", "application/warc-fields")], block)


def convert_record(head: dict[str, str], body: bytes, file: str, seq: int, refers: str | None) -> bytes:
    """WARC record of an ARC record; with ``refers``, a revisit without its payload."""
    header, _, payload = split_http(body)
    web = head["URL"].startswith(("http://", "https://")) or body.startswith(b"HTTP/")
    kind = "revisit" if refers else "response" if web else "resource"
    block = header if refers else body
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(file, seq)), ("WARC-Date", iso_date(head["Archive-date"])),
              ("WARC-Target-URI", head["URL"]), ("WARC-IP-Address", head["IP-address"]),
              ("Content-Type", "application/http; msgtype=response" if web else head["Content-type"]),
              ("WARC-Block-Digest", "sha1:" + sha1_base32(block)),
              ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload if web else body))]
    if refers:
        fields += [("WARC-Refers-To", refers),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return warc_record(fields, block)


def parse_warc(stream, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            fields[k.strip()] = v.strip()
        block = stream.read(int(fields["Content-Length"]))
        if len(block) != int(fields["Content-Length"]):
            raise ValueError(f"{name}: a block ends early")
        yield fields, block


def convert_arc(files: DataFrame, arc_folder: str, folder: str, min_bytes: int = 0) -> DataFrame:
    """Convert ARC files to WARC files, ``file, records`` of each.  Equal
    payloads of at least ``min_bytes`` become revisits of the one with the
    smallest page id."""
    index = pin(arc_index(files, arc_folder))
    order = F.struct(F.col("_id").isNull().alias("z"), "_id", "_file", "_seq")
    first = (index.filter(F.col("_bytes") >= min_bytes).groupBy("_digest", "_bytes")
             .agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    revisits = (index.join(first, ["_digest", "_bytes"])
                .filter((F.col("_file") != F.col("_first._file")) | (F.col("_seq") != F.col("_first._seq")))
                .select("_file", "_seq", F.col("_first._file").alias("_of"), F.col("_first._seq").alias("_ofseq")))
    plan = pin(index.select("_file", "_seq").join(revisits, ["_file", "_seq"], "left"))
    n = max(1, files.count())
    walks = (plan.repartitionById(n, F.pmod(F.xxhash64("_file"), F.lit(n)).cast("int"))
             .sortWithinPartitions("_file", "_seq"))

    def run(batches):
        out = None
        now, stream = None, None
        for b in batches:
            for row in b.to_pylist():
                if row["_file"] != now:
                    now = row["_file"]
                    stream = parse_arc(_reader(arc_folder, now), now)
                    if out is None:
                        out = _Rolling(folder, now.split(".")[0], "warc", warc_opening)
                head, body = next(stream)
                refers = None if row["_of"] is None else record_id(row["_of"], row["_ofseq"])
                out.add(convert_record(head, body, now, row["_seq"], refers))
        if out is not None:
            yield out.listed()

    return pin(map_arrow(walks, run, "file string, records long"))


def read_warc(files: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """A row per response, resource or revisit: ``record_id, page_id, url,
    payload_bytes, payload_digest, record_type, refers_to_id`` and, asked for,
    ``payload``.  Digests of whole payloads are recomputed and must agree."""
    names = ["record_id", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to_id"]
    schema = [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
              ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string())]
    if payload:
        schema.append(("payload", pa.binary()))

    def run(batches):
        for file in (f for b in batches for f in b.column("file").to_pylist()):
            rows, held = [], 0
            with _reader(folder, file) as s:
                for fields, block in parse_warc(s, file):
                    kind = fields["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    _, http, body = split_http(block)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind != "revisit" and sha1_base32(body if http else block) != digest:
                        raise ValueError(f"{file}: payload digest of {fields['WARC-Record-ID']} does not agree")
                    i = http.get(PAGE_ID.lower())
                    rows.append({"record_id": fields["WARC-Record-ID"], "page_id": None if i is None else int(i),
                                 "url": fields["WARC-Target-URI"], "payload_digest": digest, "record_type": kind,
                                 "payload_bytes": int(http["content-length"]) if kind == "revisit" else len(body if http else block),
                                 "refers_to_id": fields.get("WARC-Refers-To"), **({"payload": body} if payload else {})})
                    held += 200 + len(body) * payload
                    if held > FLUSH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(schema))
                        rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(schema))

    spark_types = {"page_id": "long", "payload_bytes": "long", "payload": "binary"}
    return map_arrow(_one_file_per_task(files), run, ", ".join(
        f"{n} {spark_types.get(n, 'string')}" for n in names + ["payload"] * payload))


def pages_through_warc(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                       html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Pages to ARC files, these to WARC files, and those read back: ``page_id,
    payload_bytes, payload_digest, record_type, refers_to`` (a page id)."""
    old, new = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    warcs = convert_arc(write_arc(pages, old, id_col, url_col, html_col), old, new, min_bytes)
    read = pin(read_warc(warcs, new))
    target = read.filter("record_type != 'revisit'").select(F.col("record_id").alias("refers_to_id"),
                                                            F.col("page_id").alias("refers_to"))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    again = read.filter("record_type = 'revisit'").join(target, "refers_to_id", "left").select(cols)
    return read.filter("record_type != 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).select(cols).unionByName(again)
