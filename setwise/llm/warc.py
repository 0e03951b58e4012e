"""WARC archives as chunked record tables.

Writing: a payload is cut into CHUNK-byte rows (record, chunk number) inside the scan, so that the writer never holds a
whole record; each task streams its rows into gzip members, one a record, of archives that roll over at ROLL bytes in
the shared folder. A retried task writes new files under its own name and only those that its last attempt lists count.
Reading: a task streams one archive and gives rows (record, chunk number, bytes so far, running SHA-1); payload bytes
come along only if asked for.

Of records with equal payloads of at least MIN_REVISIT bytes, that with the largest page_id is a response and the
others are revisits that refer to it.

Defined results: a null html is an empty payload; a null url is left out and reads back as null; control characters in
a url are percent-encoded; a null page_id stands below any other and reads back as null; rows that repeat the largest
page_id of their payload are all responses, under one record ID if revisits refer to them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from base64 import b32decode, b32encode

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setwise.llm.common import fresh_path, lookup, materialise, table

CHUNK, ROLL, MIN_REVISIT = 1 << 16, 64 << 20, 1000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record_id(name) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{name}')}>"


def classified(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """pages (page_id, url, payload, digest, bytes, refers_to, referred): refers_to is the response's page_id of a revisit, else null; referred: whether revisits refer to the row."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    groups = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    groups = materialise(groups.where("n > 1 and refers_to is not null").drop("n"), "payloads")
    rows = lookup(rows, groups, ["digest"])
    other = F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to"))
    return rows.withColumn("referred", F.coalesce(F.col("page_id") == F.col("refers_to"), F.lit(False))).withColumn("refers_to", F.when(other, F.col("refers_to")))


def chunked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each chunk of a response's payload (at least one a record), in order within a partition."""
    n = F.when(F.col("refers_to").isNotNull(), F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("bytes") / chunk).cast("int")))
    data = F.when(F.col("refers_to").isNull(), F.col("payload").substr(F.col("chunk") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    return rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1))).select("page_id", "url", "digest", "bytes", "refers_to", "referred", "chunk", n.alias("chunks"), data.alias("data"))


def _head(name, page_id, url, digest, size, refers_to) -> bytes:
    kind, block = ("revisit", len(HTTP)) if refers_to is not None else ("response", len(HTTP) + size)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(name)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    lines += [f"X-Page: {'' if page_id is None else page_id}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + HTTP


def write_archives(pages: DataFrame, folder: str, chunk: int = CHUNK, roll: int = ROLL) -> DataFrame:
    """Archives of all rows of pages (page_id, url, html) in folder; the written list of path, records, bytes."""

    def run(batches):
        store, at = _open(folder)
        store.create_dir(at, recursive=True)
        name, part, out, written, records, member = uuid.uuid4().hex, 0, None, 0, 0, None
        done = []

        def put(data: bytes):
            nonlocal written
            out.write(data)
            written += len(data)

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] == 0:
                    if out is not None and written >= roll:
                        out.close()
                        done.append((f"{folder}/{name}-{part}.warc.gz", records, written))
                        out, part = None, part + 1
                    if out is None:
                        out, written, records = store.open_output_stream(f"{at}/{name}-{part}.warc.gz", compression=None), 0, 0
                    member = zlib.compressobj(4, zlib.DEFLATED, 31)
                    own = row["page_id"] if row["referred"] else f"{name}:{part}:{records}"  # revisits know the record that they refer to by its page
                    put(member.compress(_head(own, row["page_id"], row["url"], row["digest"], row["bytes"], row["refers_to"])))
                put(member.compress(row["data"]))
                if row["chunk"] == row["chunks"] - 1:
                    put(member.compress(b"\r\n\r\n") + member.flush())
                    records += 1
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}-{part}.warc.gz", records, written))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), x)) for x in done], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    rows = chunked(classified(pages), chunk)
    return materialise(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


class Reader:
    """Streams the records of one archive: bytes of a record come in pieces of at most `chunk`."""

    def __init__(self, stream, chunk: int = CHUNK):
        self.stream, self.chunk, self.inflate, self.raw, self.plain = stream, chunk, zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        """More plain bytes, at most a chunk at a time; False at the archive's end."""
        while True:
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            data = self.raw or self.stream.read(self.chunk)
            got = self.inflate.decompress(data, self.chunk)  # also what an earlier call left behind
            self.raw = b"" if self.inflate.eof else self.inflate.unconsumed_tail
            if got:
                self.plain += got
                return True
            if not data and not self.inflate.eof:
                return False

    def _head(self) -> list[str] | None:
        while b"\r\n\r\n" not in self.plain:
            if not self._more():
                if self.plain.strip():
                    raise ValueError("archive ends inside a record head")
                return None
        head, _, self.plain = self.plain.partition(b"\r\n\r\n")
        return head.decode().split("\r\n")

    def _take(self, n: int):
        while n:
            if not self.plain and not self._more():
                raise ValueError("archive ends inside a record")
            piece, self.plain = self.plain[: min(n, self.chunk)], self.plain[min(n, self.chunk) :]
            n -= len(piece)
            yield piece

    def records(self):
        """(fields, pieces of the payload) of each record; the pieces must be used up before the next record."""
        while (head := self._head()) is not None:
            if not head[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head[1:])
            block = int(fields["Content-Length"])
            http = "\r\n".join(self._head()).encode()
            left = block - len(http) - 4
            yield fields, self._take(left)
            if b"".join(self._take(4)) != b"\r\n\r\n":
                raise ValueError("record without its end")


CHUNKS = "path string, record long, record_id string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, chunk long, bytes_so_far long, sha1_so_far string, last boolean"


def read_chunks(archives: DataFrame, chunk: int = CHUNK, data: bool = False) -> DataFrame:
    """The chunked record table of the archives (path): rows for each record and chunk, with running length and SHA-1."""
    names = [x.split()[0] for x in CHUNKS.split(", ")] + ["data"] * data
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in CHUNKS.split(", ")] + [("data", pa.binary())] * data)

    def rows(path):
        store, at = _open(path)
        with store.open_input_stream(at, compression=None) as stream:
            for k, (f, pieces) in enumerate(Reader(stream, chunk).records()):
                number = lambda key: int(f[key]) if f.get(key) else None  # noqa: E731, B023
                hex_ = b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                fixed = (path, k, f["WARC-Record-ID"], number("X-Page"), f.get("WARC-Target-URI"), f["WARC-Type"], hex_, number("X-Payload-Length"), number("X-Refers-To-Page"))
                sha, size, no, piece = hashlib.sha1(), 0, 0, next(pieces, b"")
                while True:
                    after = next(pieces, None)
                    sha.update(piece)
                    size += len(piece)
                    yield (*fixed, no, size, sha.hexdigest(), after is None, *((piece,) if data else ()))
                    if after is None:
                        break
                    no, piece = no + 1, after

    def run(batches):
        held = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in rows(path):
                    held.append(row)
                    if len(held) >= (256 if data else 4096):
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), schema.types)], names=names)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), schema.types)], names=names)

    n = max(1, archives.count())
    return archives.select("path").repartition(n, "path").mapInArrow(run, CHUNKS + ", data binary" * data)


def records(chunks: DataFrame) -> DataFrame:
    """The records of a chunked record table: a record's last row; a response's length and digest are those of the bytes read."""
    rows = chunks.where("last")
    read = F.col("record_type") == "response"
    wrong = read & ((F.col("sha1_so_far") != F.col("payload_digest")) | (F.col("bytes_so_far") != F.col("payload_bytes")))
    checked = F.when(wrong, F.raise_error(F.lit("payload differs from its digest"))).otherwise(F.when(read, F.col("sha1_so_far")).otherwise(F.col("payload_digest")))
    return rows.select("page_id", "payload_bytes", checked.cast("string").alias("payload_digest"), "record_type", "refers_to")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return records(read_chunks(archives))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
m AS (SELECT h, max(page_id) AS top FROM d WHERE n >= 1000 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
  CASE WHEN top IS NOT NULL AND (page_id IS NULL OR page_id < top) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top IS NOT NULL AND (page_id IS NULL OR page_id < top) THEN top END AS refers_to
FROM d LEFT JOIN m ON d.h = m.h AND d.n >= 1000
"""
