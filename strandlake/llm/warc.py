"""WARC archives: writing pages as records, normalising whole-file gzip, offset indexes and reading back.

Three jobs.  write_archives() writes archives as one gzip stream each.  normalise() inflates each such stream once,
rewrites every record as a gzip member of its own and writes a sidecar index of member offsets.  read_records()
reads any record from its member alone, by the index.  Files are written under a name that depends only on their
content's place, through a temporary name and a rename, so a task that runs again leaves the same files.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import ExitStack, contextmanager

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Payload bytes after which a task begins a new archive.
ARCHIVE_BYTES = 16 << 20
LEVEL = 1
#: Revisits, of about 100 bytes each, up to which they are broadcast; more are joined by shuffling.
BROADCAST_ROWS = 200_000
INDEX_SCHEMA = "archive string, record long, offset long, length long"
RECORD_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_EPOCH = b"1970-01-01T00:00:00Z"


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@contextmanager
def new_file(uri: str) -> Iterator[pa.NativeFile]:
    """A stream into a file that is written whole or not at all."""
    store, path = _filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temporary, compression=None) as out:
        yield out
    store.move(temporary, path)


def pieces_of(uri: str, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file, so many at a time."""
    store, path = _filesystem(uri)
    with store.open_input_stream(path, compression=None) as f:
        while piece := f.read(size):
            yield piece


def _clean(x: str | None) -> bytes:
    return " ".join((x or "").split()).encode()


def record_bytes(page_id: int | None, url: str | None, kind: str, digest: str, size: int, refers_to: int | None, payload: bytes) -> bytes:
    """One record: header, blank line, block, two line ends.  A revisit has no block; its header keeps the full size."""
    name = b"" if page_id is None else str(page_id).encode()
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:page:" + name + b">", b"WARC-Date: " + _EPOCH, b"WARC-Target-URI: " + _clean(url), b"WARC-Payload-Digest: sha1:" + digest.encode(), b"X-Payload-Length: " + str(size).encode()]
    if url is None:
        head.append(b"X-No-Target: 1")
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:" + str(refers_to).encode() + b">"]
    head += [b"Content-Type: text/html;charset=utf-8", b"Content-Length: " + str(len(payload)).encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + payload + b"\r\n\r\n"


class RecordSplitter:
    """Cuts a stream of bytes into whole records by their lengths, whatever the cuts of the stream."""

    def __init__(self) -> None:
        self.rest = bytearray()

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.rest += data
        at = 0
        while True:
            end = self.rest.find(b"\r\n\r\n", at)
            if end < 0:
                break
            low = bytes(self.rest[at:end]).lower()
            k = low.find(b"\r\ncontent-length:")
            size = int(low[k + 17 :].split(b"\r\n", 1)[0])
            stop = end + 4 + size + 4
            if stop > len(self.rest):
                break
            yield bytes(self.rest[at:stop])
            at = stop
        del self.rest[:at]


def inflate(pieces: Iterable[bytes], most: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip stream of one or of many members, inflated once, at most so many bytes at a time."""
    engine, some = zlib.decompressobj(31), False
    for data in pieces:
        while data:
            if engine.eof:
                engine = zlib.decompressobj(31)
            some = True
            if out := engine.decompress(data, most):
                yield out
            data = engine.unused_data if engine.eof else engine.unconsumed_tail
    if tail := engine.flush():
        yield tail
    if some and not engine.eof:
        raise ValueError("the gzip stream ends too early")


def parse_record(record: bytes) -> tuple:
    """The fields of RECORD_SCHEMA."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.lower()] = v.strip()
    number = lambda v: int(v[10:-1]) if v and v != b"<urn:page:>" else None
    size = int(fields[b"content-length"])
    kind = fields[b"warc-type"].decode()
    url = None if b"x-no-target" in fields else fields[b"warc-target-uri"].decode()
    payload = rest[:size] if kind == "response" else None
    return number(fields[b"warc-record-id"]), url, kind, int(fields[b"x-payload-length"]), fields[b"warc-payload-digest"].decode().removeprefix("sha1:"), number(fields.get(b"warc-refers-to")), payload


def classify(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, digest, size, refers_to) of every page, null html as empty.

    Of equal payloads of at least min_revisit_bytes the one with the largest page_id is the response and the others
    refer to it.  Rows that repeat a page_id and its payload are each a response or each a revisit.
    """
    sized = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html").cast("long"))
    # Pages travel with ids and digests alone; only revisits come back to the payloads.
    keys = C.materialize(sized.select("page_id", "digest", "size").where(F.col("size") >= min_revisit_bytes), "warc-keys")
    again = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low"), F.count("*").alias("members")).where("refers_to != low").drop("low")
    met = C.join_classes(keys, C.materialize(again, "warc-repeated"), ["digest"], keys.count(), "inner")
    revisits = C.materialize(met.where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct(), "warc-revisits")
    few = revisits.count() <= BROADCAST_ROWS
    return sized.join(F.broadcast(revisits) if few else revisits, ["page_id", "digest"], "left")


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write every page into archives below folder, each one gzip stream; returns (archive, records) as written.

    Without pages the folder is made and stays empty.
    """
    todo = classify(pages, min_revisit_bytes)
    store, path = _filesystem(folder)
    store.create_dir(path, recursive=True)
    C.small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, names, counts = TaskContext.get().partitionId(), [], []
        with ExitStack() as stack:
            out = zipper = None
            for b in batches:
                cols = {k: b.column(k) for k in b.schema.names}
                for i in range(b.num_rows):
                    row = {k: v[i].as_py() for k, v in cols.items()}
                    payload = row["html"].encode()
                    revisit = row["refers_to"] is not None
                    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                    if zipper is None:
                        names.append(f"part-{part:06d}-{len(names):04d}.warc.gz")
                        counts.append(0)
                        size, zipper, out = 0, zlib.compressobj(level, zlib.DEFLATED, 31), stack.enter_context(new_file(f"{folder}/{names[-1]}"))
                    out.write(zipper.compress(record_bytes(row["page_id"], row["url"], "revisit" if revisit else "response", digest, len(payload), row["refers_to"], b"" if revisit else payload)))
                    size, counts[-1] = size + len(payload), counts[-1] + 1
                    if size >= archive_bytes:
                        out.write(zipper.flush())
                        zipper = None
                        stack.close()
            if zipper:
                out.write(zipper.flush())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["archive", "records"])

    return C.materialize(todo.mapInArrow(run, "archive string, records long"), "warc-written")


def normalise(spark: SparkSession, folder: str, target: str, level: int = LEVEL) -> DataFrame:
    """Rewrite every archive of folder into target, a member to each record; returns the index, INDEX_SCHEMA.

    The same index is written beside each archive as archive.idx: record, offset and length, a line each.  Archives
    are read and written as streams: a task holds one record and the lines of one index, whatever the archive's size.
    An archive that ends inside its stream or inside a record raises.
    """
    store, path = _filesystem(target)
    store.create_dir(path, recursive=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                name = path.rpartition("/")[2]
                index, offset, splitter = [], 0, RecordSplitter()
                with new_file(f"{target}/{name}") as members, new_file(f"{target}/{name}.idx") as lines:
                    for piece in inflate(pieces_of(path)):
                        for record in splitter.feed(piece):
                            z = zlib.compressobj(level, zlib.DEFLATED, 31)
                            m = z.compress(record) + z.flush()
                            lines.write(f"{len(index)} {offset} {len(m)}\n".encode())
                            index.append((name, len(index), offset, len(m)))
                            members.write(m)
                            offset += len(m)
                    if splitter.rest:
                        raise ValueError(f"{path} ends inside a record")
                yield pd.DataFrame(index, columns=["archive", "record", "offset", "length"])

    with C.batch_rows(spark, 1):
        return C.materialize(_archives(spark, folder).mapInPandas(run, INDEX_SCHEMA), "warc-index")


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the archives of a folder; their content is left to the tasks."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path")


def read_records(spark: SparkSession, target: str, payloads: bool = True) -> DataFrame:
    """Every record of the normalised archives, each inflated from its own member by the sidecar index.

    payloads=False leaves the payload column null once a response's size and digest have been checked against it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            for path in b["path"]:
                rows, held = [], 0
                store, own = _filesystem(path)
                with store.open_input_file(own) as members:
                    for line in b"".join(pieces_of(f"{path}.idx")).splitlines():
                        _, offset, length = map(int, line.split())
                        row = parse_record(zlib.decompress(members.read_at(length, offset), 31))
                        if row[2] == "response":
                            if len(row[6]) != row[3] or base64.b32encode(hashlib.sha1(row[6]).digest()).decode() != row[4]:
                                raise ValueError(f"record of page {row[0]} does not hold its payload")
                            held += len(row[6])
                        rows.append(row if payloads else (*row[:6], None))
                        if held >= 4 << 20:
                            yield _frame(rows)
                            rows, held = [], 0
                yield _frame(rows)

    with C.batch_rows(spark, 1):
        return C.materialize(_archives(spark, target).mapInPandas(run, RECORD_SCHEMA), "warc-records")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"], dtype=object)
    for k in ("page_id", "payload_bytes", "refers_to"):
        out[k] = out[k].astype("Int64")
    return out


def op7_warc(spark, sf_dir: str) -> DataFrame:
    base = f"{C.scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{base}/whole")
    normalise(spark, f"{base}/whole", f"{base}/members")
    return read_records(spark, f"{base}/members", payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL: dict[str, str] = {}
QUERIES = {"op7_warc": op7_warc}
