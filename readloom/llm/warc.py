"""WARC archives: writing, reading, and revisit resolution.

Each record is a gzip member of its own, so that an archive can be read at a record's offset.  Executors compress records
and Spark's text writer, for which a string is just bytes, puts them into files on any file system that Spark knows and
commits these by its protocol: what it writes after each row, a zero byte, is the last byte of a member (the highest of
its size), or padding after one of 16 MB and more.  Files are rolled by bytes and read back member by member.

Payloads aren't shuffled.  Headers (id, digest, size) are, to find which records revisit which; pages that a filter of
the revisits' ids rules out are responses and are written where they are read, revisits are written from their headers,
and only the few pages that the filter takes for revisits by chance are joined with their ids.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import drop, each_batch, may_be_in, new_path, record_batch, sieve, small_batches, table, tidy

END = b"\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes after which a task begins another file.
ROLL = 32 << 20
#: Digests of more records than this, and than this share of all, are few; records are joined with them without a shuffle.
HOT = (10_000, 1e-5)

READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])
_READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
_PAGES = "page_id long, url string, payload_bytes long, payload_digest string"


def _rows(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """``page_id, url, payload``; a null payload is empty, a null URL too."""
    empty = F.lit("")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), empty), r"[\r\n]", "").alias("url"), F.coalesce(F.col(payload_col).cast("string"), empty).alias("payload"))


def headers(rows: DataFrame) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest`` of ``page_id, url, payload``."""

    def described(batch: pa.RecordBatch) -> dict:
        bodies = [x.encode() for x in batch.column(2).to_pylist()]
        return {"page_id": batch.column(0), "url": batch.column(1), "payload_bytes": [len(x) for x in bodies], "payload_digest": [digest(x) for x in bodies]}

    return rows.mapInArrow(each_batch(described, PAGES), _PAGES)


def resolve(records: DataFrame, *, least: int = 0) -> DataFrame:
    """``page_id, payload_digest, refers_to`` of the records (page_id, payload_digest, payload_bytes) that revisit another.

    Of the records with one payload digest, that with the smallest page_id is the response that the others revisit.
    Payloads under ``least`` bytes are all responses.  Equal page_ids with equal payloads: the rows are alike, and all are
    the response; a record without an id revisits nothing.  Only digests that occur more than once are joined; those of
    very many records, of which there are 100,000 at most, as a broadcast.
    """
    small = records.where(F.col("payload_bytes") >= least).select("page_id", "payload_digest")
    originals = small.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    hot = max(HOT[0], int(HOT[1] * records.count()))
    many, few = originals.where(F.col("n") > hot), originals.where(F.col("n") <= hot)
    found = small.join(F.broadcast(many), "payload_digest").unionByName(small.join(F.broadcast(many.select("payload_digest")), "payload_digest", "left_anti").join(few, "payload_digest"))
    return found.where("page_id > refers_to").select("page_id", "payload_digest", "refers_to").distinct()


def record(page_id: int | None, url: str, size: int, sha: str, payload: bytes | None, refers_to: int | None) -> bytes:
    """A WARC/1.1 record: a response, or without a payload a revisit."""
    page = lambda n: f"<urn:page:{'none' if n is None else n}>"
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    revisit = [] if payload is not None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {page(refers_to)}"]
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {page(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{sha}", *revisit, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(lines).encode() + END + body + END


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(records: DataFrame, path: str) -> None:
    """Write records (page_id, url, payload_bytes, payload_digest, payload, refers_to) as archives ``*.warc.gz`` in folders of ``path``; null payloads make revisits."""
    schema = pa.schema([("roll", pa.int32()), ("value", pa.binary())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, size = 0, 0
        for batch in batches:
            rolls, values = [], []
            for page, url, n, sha, payload, refers in zip(*(c.to_pylist() for c in batch.columns)):
                data = member(record(page, url, n, sha, None if payload is None else payload.encode(), refers))
                if size + len(data) > ROLL and size:
                    roll, size = roll + 1, 0
                size += len(data)
                rolls.append(roll)
                values.append(data.removesuffix(b"\0") if len(data) and data[-1] == 0 else data)
            yield record_batch({"roll": rolls, "value": values}, schema)

    columns = ["page_id", "url", "payload_bytes", "payload_digest", "payload", "refers_to"]
    rows = records.select(*columns).mapInArrow(tidy(packed), "roll int, value binary")
    rows.select("roll", F.col("value").cast("string").alias("value")).write.partitionBy("roll").option("lineSep", "\0").option("compression", "none").text(path)
    _named(records.sparkSession, path)


def _named(spark: SparkSession, path: str) -> None:
    """Give the files the name that archives have; a call to the file system a file, of which each holds up to ROLL bytes."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listFiles(top, True)
    while files.hasNext():
        old = files.next().getPath()
        if old.getName().endswith(".txt"):
            fs.rename(old, jvm.org.apache.hadoop.fs.Path(old.getParent(), old.getName().removesuffix(".txt") + ".warc.gz"))


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of an archive, unpacked one by one; zero bytes between them are padding."""
    view, at = memoryview(data), 0
    while at < len(view):
        if view[at] == 0:
            at += 1
            continue
        unpacker, out = zlib.decompressobj(31), []
        while not unpacker.eof:
            part = view[at : at + 65_536]
            if not len(part):
                raise ValueError("the last member is cut off")
            out.append(unpacker.decompress(part))
            at += len(part) - len(unpacker.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> Iterator[tuple]:
    """The records of an archive as tuples of ``READ``; raises ValueError where one doesn't end as its length says."""
    at = 0
    while at < len(data):
        head = data.index(END, at)
        lines = data[at:head].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start = head + len(END)
        end = start + int(fields["content-length"])
        if data[end : end + len(END)] != END:
            raise ValueError(f"the record at byte {at} doesn't end at byte {end}")
        http, _, payload = data[start:end].partition(END)
        sent = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))[16:])
        kind = fields["warc-type"]
        own = lambda k: int(x) if (x := fields.get(k, "").removeprefix("<urn:page:").removesuffix(">")).lstrip("-").isdigit() else None
        stated = fields["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and (len(payload), digest(payload)) != (sent, stated):
            raise ValueError(f"the payload at byte {at} isn't what its header says")
        yield own("warc-record-id"), fields["warc-target-uri"], kind, sent, stated, own("warc-refers-to"), payload.decode() if kind == "response" else None
        at = end + len(END)


def read(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """The records of all archives under ``path``, checked against their lengths and digests; gzip members are unpacked one by one."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows: list[tuple] = []
                size = 0
                raw = data.as_buffer()
                for text in members(raw) if bytes(raw[:2]) == b"\x1f\x8b" else (raw.to_pybytes(),):
                    for row in parse(text):
                        rows.append(row if payloads else (*row[:-1], None))
                        size += len(row[-1] or "") if payloads else 200
                    if size > 2_000_000:
                        yield record_batch(dict(zip(READ.names, map(list, zip(*rows)))), READ)
                        rows, size = [], 0
                if rows:
                    yield record_batch(dict(zip(READ.names, map(list, zip(*rows)))), READ)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.warc*").load(path)
    return files.select("content").mapInArrow(tidy(parsed), _READ)


def archive(pages: DataFrame, path: str, *, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write ``pages`` as deduplicated archives: each payload once, and revisits with fresh headers for the others.

    Null payloads and URLs are empty ones, line ends in URLs go, and a repeated row is a record again.  Without pages there is no archive.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = _rows(pages, id_col, url_col, payload_col)
    heads = table(headers(rows), "heads")
    revisits = table(resolve(heads, least=least), "revisits")
    ids = lambda df: df.select(F.col("page_id").alias("id"))
    again = spark.sparkContext.broadcast(sieve(ids(revisits)))  # of bounded size

    def in_again(batch: pa.RecordBatch) -> dict | None:
        some = np.flatnonzero(batch.column(0).is_valid())
        keep = some[may_be_in(again.value, np.asarray(batch.column(0).take(pa.array(some))))]
        return dict(zip(PAGES.names, batch.take(pa.array(keep)).columns)) if len(keep) else None

    # Responses that the filter takes for revisits.
    chance = heads.mapInArrow(each_batch(in_again, PAGES), _PAGES).join(revisits.select("page_id", "payload_digest"), ["page_id", "payload_digest"], "left_anti")
    chance = table(chance.select("page_id", "payload_digest").distinct(), "chance")
    doubtful = spark.sparkContext.broadcast(sieve(ids(chance)))  # of bounded size
    schema = PAGES.append(pa.field("payload", pa.string()))
    kind = f"{_PAGES}, payload string"

    def responses(sure: bool):
        def run(batch: pa.RecordBatch) -> dict | None:
            page = np.asarray(batch.column(0).fill_null(0))
            hit = np.zeros(len(page), bool)
            hit[may_be_in(again.value, page)] = True
            hit &= np.asarray(batch.column(0).is_valid())
            if sure:
                keep = np.flatnonzero(~hit)
            else:
                doubt = np.zeros(len(page), bool)
                doubt[may_be_in(doubtful.value, page)] = True
                keep = np.flatnonzero(hit & doubt)
            if not len(keep):
                return None
            batch = batch.take(pa.array(keep))
            bodies = [x.encode() for x in batch.column(2).to_pylist()]
            return {"page_id": batch.column(0), "url": batch.column(1), "payload": batch.column(2), "payload_bytes": [len(x) for x in bodies], "payload_digest": [digest(x) for x in bodies]}

        return rows.mapInArrow(each_batch(run, schema), kind)

    nothing = F.lit(None).cast("long").alias("refers_to")
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "payload"]
    own = responses(True).select(*columns, nothing)
    found = responses(False).join(chance, ["page_id", "payload_digest"]).select(*columns, nothing)
    others = heads.join(revisits, ["page_id", "payload_digest"]).select("page_id", "url", "payload_bytes", "payload_digest", F.lit(None).cast("string").alias("payload"), "refers_to")
    write(own.unionByName(found).unionByName(others), path)
    drop(heads, revisits, chance)
    again.destroy()
    doubtful.destroy()


def pages_through_archives(pages: DataFrame, *, least: int = 0) -> DataFrame:
    """Write archives of ``pages`` in the shared folder and return what reading them back gives, without payloads."""
    path = new_path(pages.sparkSession, "warc")
    archive(pages, path, least=least)
    return read(pages.sparkSession, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
