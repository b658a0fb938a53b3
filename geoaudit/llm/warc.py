"""WARC archives with a two-level capture index.

Records are written, a partition at a time, as WARC files of one gzip member per
record.  Their captures (key, file, byte range) are sorted by reversed-host URL
key into index files: compressed blocks of ``BLOCK`` lines, and a sparse directory
with the first key of every block.  The list of index parts (one row per
partition) is the level above.  A lookup binary-searches the list for the part,
the part's directory for the block, and the block for the line, and reads only
those byte ranges; bulk reads then go through each WARC file in order of offset.
Payloads are exchanged once, with the join that finds equal ones.

Files go into the shared folder under a name of the attempt that writes them; the
list of parts names those of the attempts that succeeded, so a lost executor or a
second attempt leaves nothing wrong behind.

Of captures with equal payloads of at least ``least`` bytes the one with the
smallest id is a ``response`` record, the others are ``revisit`` records without
payload that refer to it; smaller payloads are all responses.

Defined results: a null payload is empty; a null or hostless URL has the key of its
own text; a null id is kept as such, sorts first, and is never referred to unless
no other row has its payload; rows with the response's own id are responses too;
an empty table makes an empty archive.  Other columns are not stored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import uuid
import zlib
from base64 import b32encode
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoaudit.llm.url_filters import host_of
from geoaudit.session import materialise, new_folder, table

#: Lines in an index block.
BLOCK = 512
#: Bytes of a WARC file that one task reads in a row.
RANGE = 1 << 20
NO_ID = -(1 << 63)
#: Fixed value: the profile of revisits with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def url_key(url: Column) -> Column:
    """Reversed-host key of a URL: ``com,example,www)/path?query``; without a host the text itself.

    Control characters become ``%``, so that a key is one field of one index line.
    """
    host = F.array_join(F.reverse(F.split(host_of(url), r"\.")), ",")
    rest = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://[^/?#]*|#.*$", "")
    key = F.when(host_of(url) != "", F.concat(host, F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest))).otherwise(F.lower(F.trim(url)))
    return F.regexp_replace(F.coalesce(key, F.lit("")), r"[\x00-\x1f\x7f]", "%")


def record(url: str | None, id: int, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One WARC record; a revisit has the HTTP head but not the payload."""
    name = lambda i: f"<urn:x-capture:{'' if i == NO_ID else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=";/?:@&=+$,#%[]!'()*~"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
        body = http
    else:
        body = http + payload
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record: type, id, refers_to, digest, payload_bytes, payload (null for revisits)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda x: int(n) if (n := x[len("<urn:x-capture:") : -1]) else None
    revisit = fields["warc-type"] == "revisit"
    return {
        "type": fields["warc-type"],
        "id": number(fields["warc-record-id"]),
        "refers_to": number(fields["warc-refers-to"]) if revisit else None,
        "url": fields.get("warc-target-uri"),
        "digest": fields["warc-payload-digest"].removeprefix("sha1:"),
        "payload_bytes": size,
        "payload": None if revisit else payload,
    }


WRITTEN = "key string, id long, warc string, at long, size long"
PARTS = "first_key string, first_id long, index string, directory_at long, directory_size long, captures long"


def write_archive(df: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Write every row as a record below ``folder``; returns the list of index parts.

    ``folder`` is a URI that all executors reach (a file system that Arrow knows).
    """
    raw = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(url).alias("url"), raw.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    ids = F.when(F.col("id") != NO_ID, F.col("id"))
    # one row per payload that several captures have; combined before the shuffle
    firsts = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.coalesce(F.min(ids), F.lit(NO_ID)).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("sha", "first")
    known = rows.join(firsts, "sha", "left").select("id", "url", "payload", F.when(F.col("first") != F.col("id"), F.col("first")).alias("refers_to"), url_key(F.col("url")).alias("key"))

    def write_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, warc, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            places, sizes = [], []
            for i, u, p, r in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload", "refers_to")), strict=True):
                if warc is None:
                    store.create_dir(base, recursive=True)
                    warc = store.open_output_stream(f"{base}/{name}", compression=None)
                member = gzip.compress(record(u, i, p, r, b32encode(hashlib.sha1(p).digest()).decode()), 6, mtime=0)
                warc.write(member)
                places.append(at)
                sizes.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), pa.array([name] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())], names=["key", "id", "warc", "at", "size"])
        if warc is not None:
            warc.close()

    # the rows name the files of the attempts that succeeded
    captures = materialise(known.mapInArrow(write_records, WRITTEN), "captures")

    def write_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, index, at, total, lines, blocks = f"{uuid.uuid4().hex}.cdx", None, 0, 0, [], []

        def flush() -> None:
            nonlocal at, lines
            block = zlib.compress("\n".join(lines).encode(), 6)
            index.write(block)
            blocks.append("\t".join([*lines[0].split("\t")[:2], str(at), str(len(block))]))
            at += len(block)
            lines = []

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "id", "warc", "at", "size")), strict=True):
                index = index or store.open_output_stream(f"{base}/{name}", compression=None)
                lines.append("\t".join(map(str, row)))
                total += 1
                if len(lines) == BLOCK:
                    flush()
        if index is None:
            return
        if lines:
            flush()
        directory = zlib.compress("\n".join(blocks).encode(), 6)
        index.write(directory)
        index.close()
        key, i = blocks[0].split("\t")[:2]
        row = {"first_key": key, "first_id": int(i), "index": name, "directory_at": at, "directory_size": len(directory), "captures": total}
        yield pa.RecordBatch.from_pylist([row])

    ordered = captures.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    return materialise(ordered.mapInArrow(write_index, PARTS), "parts")


class Index:
    """Lookups in the index of an archive; one per task."""

    def __init__(self, folder: str, parts: list[tuple]):
        self.store, self.base = fs.FileSystem.from_uri(folder)
        self.parts = parts
        self.firsts = [(p[0], p[1]) for p in parts]
        self.held: OrderedDict = OrderedDict()

    def _kept(self, what: tuple, make: object) -> object:
        if what not in self.held:
            self.held[what] = make()
            if len(self.held) > 64:
                self.held.popitem(last=False)
        self.held.move_to_end(what)
        return self.held[what]

    def ranged(self, name: str, at: int, size: int) -> bytes:
        file = self._kept(("file", name), lambda: self.store.open_input_file(f"{self.base}/{name}"))
        return file.read_at(size, at)

    def _lines(self, name: str, at: int, size: int) -> tuple[list, list]:
        def make() -> tuple[list, list]:
            rows = [(k, int(i), *x) for k, i, *x in (r.split("\t") for r in zlib.decompress(self.ranged(name, at, size)).decode().split("\n"))]
            return rows, [r[:2] for r in rows]

        return self._kept((name, at), make)

    def find(self, key: str, id: int | None = None) -> Iterator[tuple[str, int, int]]:
        """(file, offset, size) of the captures of a URL key, or of one id of it."""
        want = (key, NO_ID if id is None else id)
        part = max(0, bisect.bisect_left(self.firsts, want) - 1)
        while part < len(self.parts) and self.firsts[part][0] <= key:
            _, _, index, at, size, _ = self.parts[part]
            blocks, firsts = self._lines(index, at, size)
            block = max(0, bisect.bisect_left(firsts, want) - 1)
            while block < len(blocks) and firsts[block][0] <= key:
                lines, keys = self._lines(index, *map(int, blocks[block][2:]))
                line = bisect.bisect_left(keys, want)
                while line < len(lines) and lines[line][0] == key and (id is None or lines[line][1] == id):
                    yield lines[line][2], int(lines[line][3]), int(lines[line][4])
                    line += 1
                if line < len(lines):
                    return
                block += 1
            part += 1


CAPTURE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_captures(asked: DataFrame, folder: str, parts: DataFrame, id: str = "page_id", url: str = "url", payload: bool = True) -> DataFrame:
    """The captures of each distinct (URL, id) of ``asked``, read back from the archive by its index.

    An id of null in ``asked`` stands for the capture without an id.
    """
    rows = [tuple(r) for r in parts.orderBy("first_key", "first_id").collect()]  # one row per part
    shared = asked.sparkSession.sparkContext.broadcast(rows)
    keyed = asked.select(url_key(F.col(url)).alias("key"), F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("id")).distinct()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, shared.value)
        for b in batches:
            found = [place for k, i in zip(b.column("key").to_pylist(), b.column("id").to_pylist(), strict=True) for place in index.find(k, i)]
            columns = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["warc", "at", "size"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, [])
        columns = {"id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "digest": pa.string(), "type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
        for b in batches:
            for s in range(0, b.num_rows, 512):
                g = b.slice(s, 512)
                out = []
                for place in zip(*(g.column(c).to_pylist() for c in ("warc", "at", "size")), strict=True):
                    x = parse(gzip.decompress(index.ranged(*place)))
                    if x["payload"] is not None and b32encode(hashlib.sha1(x["payload"]).digest()).decode() != x["digest"]:
                        raise ValueError(f"digest of capture {x['id']} does not match")
                    out.append(x)
                yield pa.RecordBatch.from_arrays([pa.array([x[c] if c != "payload" or payload else None for x in out], t) for c, t in columns.items()], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    # in key order neighbouring lookups share index blocks; in offset order reads share files
    places = keyed.repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(look_up, "warc string, at long, size long")
    tasks = max(1, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return places.repartition(tasks, "warc", F.floor(F.col("at") / RANGE)).sortWithinPartitions("warc", "at").mapInArrow(read, CAPTURE)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all of ``pages`` with revisits for equal payloads of any size, and read all back."""
    pages = table(spark, sf_dir, "pages")
    folder = new_folder(spark, "warc")
    parts = write_archive(pages, folder)
    back = read_captures(pages, folder, parts, payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, CAST(unhex(sha1(html)) AS BIT)::VARCHAR AS bits FROM p),
e AS (
  SELECT page_id, n, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(16 * CAST(substr(bits, CAST(5 * i + 1 AS INT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INT), 1) AS INT) + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INT), 1) AS INT)
      + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INT), 1) AS INT) + CAST(substr(bits, CAST(5 * i + 5 AS INT), 1) AS INT) AS INT) + 1, 1)), '') AS digest
  FROM d
),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM e)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
