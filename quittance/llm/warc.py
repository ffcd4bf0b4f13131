"""WARC: archives written with an index first, read back by coalesced byte ranges.

Each task writes gzip members, one per record, to a file of its own in the shared
folder and returns an index row (file, offset, length, URL, digest ...) per record.
The index is kept as a table, so an archive of a failed attempt is never read.
Responses are written first; their index tells the revisits which record they repeat,
so every record has an id of its own and each reference names a written record.
Reading sorts the selected index rows by file and offset, merges neighbours into
large ranges and cuts the records out of them.

Of records with equal payloads of at least ``min_bytes`` the one with the smallest
page_id is a response, the others are revisits that name it.  The group's smallest
id is found by a partial aggregate on the digest; payloads are not gathered.

Cases: null html is an empty payload; a null url writes no target line; a row with
a null page_id is always a response; rows repeated with the same page_id are
responses each, with ids of their own; a very long payload is one record in memory;
an empty table gives an empty index; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quittance.llm.common import join_small, new_folder, save

INDEX_SCHEMA = "record_id string, page_id long, url string, file string, offset long, length long, digest string, payload_bytes long, record_type string, refers_to long"
_INDEX = pa.schema([
    ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
    ("digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
])
RECORD_SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string"
_RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("refers_to_record", pa.string()),
])
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def store_of(uri: str):
    """(file system, path) of a URI; the names that Hadoop has for object stores are known under their plain ones."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def label(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """page_id, url, html, digest, n (bytes), times (rows of the digest, if several), refers_to (null: a response)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    p = p.withColumn("digest", F.sha2(F.col("html"), 256)).withColumn("n", F.octet_length("html").cast("long"))
    many = p.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("times")).filter("times > 1")
    p = join_small(p, save(many, "warc-copies"), "digest", "left", 104)
    return p.withColumn("refers_to", F.when((F.col("n") >= min_bytes) & (F.col("first") < F.col("page_id")), F.col("first"))).drop("first")


def escaped(url: str) -> str:
    """A URL for one header line: % and line ends as %25, %0D and %0A."""
    return re.sub(r"[%\r\n]", lambda m: f"%{ord(m[0]):02X}", url)


def unescaped(url: str) -> str:
    return re.sub(r"%(25|0D|0A)", lambda m: chr(int(m[1], 16)), url)


def record(record_id: str, page_id: int | None, url: str | None, payload: bytes | None, n: int, digest: str, refers_to: int | None = None, refers_to_record: str | None = None) -> bytes:
    """The bytes of a record before compression; a revisit has no payload."""
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {escaped(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{refers_to_record}>", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """Row of RECORD_SCHEMA of a record's bytes; a wrong digest of a response is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != told or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    name = lambda k: fields[k].removeprefix("<urn:uuid:").removesuffix(">") if k in fields else None
    url = fields.get("WARC-Target-URI")
    return (
        number("X-Page-ID"), None if url is None else unescaped(url), payload if kind == "response" else None, told, digest, kind,
        number("X-Refers-To-Page-ID"), name("WARC-Record-ID"), name("WARC-Refers-To"),
    )


def write(pages: DataFrame, folder: str | None = None, max_file: int = 256 << 20, min_bytes: int = 100) -> DataFrame:
    """Write the archives of pages to folder and return the index, itself a written table."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    rows = label(pages, min_bytes)
    none = F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for b in batches:
                for piece in range(0, b.num_rows, 256):
                    index = []
                    for page, url, html, digest, n, refers, refers_record in zip(*(x.to_pylist() for x in b.slice(piece, 256).columns), strict=True):
                        if out is None or at >= max_file:
                            if out is not None:
                                out.close()
                            name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                            out = store.open_output_stream(f"{base}/{name}", compression=None)
                        own = str(uuid.uuid4())
                        pack = zlib.compressobj(4, wbits=31)
                        packed = pack.compress(record(own, page, url, None if html is None else html.encode(), n, digest, refers, refers_record)) + pack.flush()
                        out.write(packed)
                        index.append((own, page, url, f"{folder}/{name}", at, len(packed), digest, n, "response" if html is not None else "revisit", refers))
                        at += len(packed)
                    yield _batch(_INDEX, index)
        finally:
            if out is not None:
                out.close()

    shape = ("page_id", "url", "html", "digest", "n", "refers_to")
    responses = save(rows.filter("refers_to is null").select(*shape, none.alias("refers_to_record")).mapInArrow(run, INDEX_SCHEMA), "warc-index")
    # what is repeated: one record of each digest that has revisits
    again = save(rows.filter("refers_to is not null").select("page_id", "url", none.alias("html"), "digest", "n", "refers_to"), "warc-revisits")
    asked = again.select("digest", F.col("refers_to").alias("page_id")).distinct()
    named = responses.filter("page_id is not null").join(asked, ["digest", "page_id"]).groupBy("digest").agg(F.min("record_id").alias("refers_to_record"))
    named = save(named, "warc-named")
    revisits = save(join_small(again, named, "digest", "left", 120).select(*shape, "refers_to_record").mapInArrow(run, INDEX_SCHEMA), "warc-index")
    return responses.unionByName(revisits)


def ranges(rows: list[tuple[str, int, int]], gap: int = 64 << 10, most: int = 4 << 20) -> Iterator[list[int]]:
    """Indexes of sorted (file, offset, length) rows that one read covers: same file, near each other, of bounded size."""
    group: list[int] = []
    for i, (file, offset, length) in enumerate(rows):
        if group:
            f, o, n = rows[group[-1]]
            if file != f or offset - (o + n) > gap or offset + length - rows[group[0]][1] > most:
                yield group
                group = []
        group.append(i)
    if group:
        yield group


def read(index: DataFrame, payloads: bool = True, task_bytes: int = 16 << 20) -> DataFrame:
    """The records that the index rows name, from their archives; without payloads only their digests.

    A task gets about task_bytes of compressed records, whatever little room their index rows take.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    picked = index.select("file", "offset", "length").repartitionByRange(max(1, -(-total // task_bytes)), F.col("file"), F.col("offset")).sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path, source = None, None, None
        for b in batches:
            rows = list(zip(*(x.to_pylist() for x in b.columns), strict=True))
            for group in ranges(rows):
                file, first, _ = rows[group[0]]
                if file != path:
                    if source is not None:
                        source.close()
                    store, inner = store_of(file)
                    source, path = store.open_input_file(inner), file
                last = rows[group[-1]]
                data = source.read_at(last[1] + last[2] - first, first)
                found = [parse(zlib.decompress(data[rows[i][1] - first : rows[i][1] - first + rows[i][2]], 31)) for i in group]
                yield _batch(_RECORD, found if payloads else [(*r[:2], None, *r[3:]) for r in found])
        if source is not None:
            source.close()

    return picked.mapInArrow(run, RECORD_SCHEMA)
