"""WARC archives: a writer, and a reader that salvages damaged ones.

Archives are sequences of gzip members, one record each by this writer, any number by others, or plain records. The
reader checks each record (gzip checksum, version line, Content-Length, block digest in base 16 or 32, if its kind is
known). Where a check fails it searches on for the next place from which a whole valid record can be read: a gzip member
that holds one, or a version line, in plain bytes and in inflated ones alike. All bytes
in between are reported as one quarantined gap (an inner gap, with its place in the inflated bytes, inside a member), and the
records after it are recovered. Of a member that breaks off, what inflates is searched too; of one with an
error only records whose own digest proves them are taken.

Cases: a null or empty html is an empty payload; a null url is an empty target; a row without an id is a response that has
none, and no other record refers to it; equal rows are written once each, as responses if they are all that
have the largest id; an empty table gives no archive and an empty result; only the
columns named are read, so others cannot clash. A payload of any length is one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path

VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    head = {**headers, "WARC-Block-Digest": "sha1:" + hashlib.sha1(block).hexdigest(), "Content-Length": str(len(block))}
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def _verified(stated: str, block: bytes) -> bool | None:
    """Whether a block has the digest stated; None if none is, or of no known kind."""
    kind, _, value = stated.partition(":")
    name = {"sha1": "sha1", "sha-1": "sha1", "md5": "md5", "sha256": "sha256", "sha-256": "sha256", "sha512": "sha512", "sha-512": "sha512"}.get(kind.strip().lower())
    if not name or not value:
        return None
    own, value = hashlib.new(name, block).digest(), value.strip()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def _parse(data: bytes, start: int) -> tuple[dict[str, str], bytes, int, bool] | None:
    """The record at ``start``: headers, block, end, whether its digest proves it. None where any check fails."""
    m = _LINE.match(data, start)
    if not m:
        return None
    top = data.find(b"\r\n\r\n", m.end() - 2)
    if top < 0:
        return None
    headers = {}
    for line in data[m.end() : top].split(b"\r\n"):
        name, sep, value = line.partition(b":")
        if line and not sep:
            return None
        if line:
            headers[name.decode("utf-8", "replace").strip().lower()] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        return None
    begin = top + 4
    end = begin + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    block = data[begin:end]
    proof = _verified(headers.get("warc-block-digest", ""), block)
    return None if proof is False else (headers, block, end + 4, bool(proof))


def _member(data: bytes, start: int) -> tuple[bytes, int | None, bool]:
    """What inflates of the gzip member at ``start``, where it ends (None if it has no whole end), and whether an error was met."""
    unpack, out, at = zlib.decompressobj(31), [], start
    view = memoryview(data)
    while not unpack.eof and at < len(data):
        step = view[at : at + (1 << 16 if at == start else 1 << 20)]
        before = unpack.copy()
        try:
            out.append(unpack.decompress(step))
        except zlib.error:
            size = 1024
            while size and len(step):  # as far as it goes, in ever smaller steps
                last = before.copy()
                try:
                    out.append(before.decompress(step[:size]))
                    step = step[size:]
                except zlib.error:
                    before, size = last, size // 4
            return b"".join(out), None, True
        at += len(step)
    content = b"".join(out)
    return (content, at - len(unpack.unused_data), False) if unpack.eof else (content, None, False)


def _records(data: bytes, proven: bool) -> Iterator[tuple[int, int, dict[str, str] | None, bytes]]:
    """(start, end, headers, block) of the records in plain bytes, and of the gaps between them, whose headers are None."""
    at, gap = 0, None
    while at < len(data):
        parsed = _parse(data, at)
        if parsed and (parsed[3] or not proven):
            if gap is not None:
                yield gap, at, None, b""
                gap = None
            yield at, parsed[2], parsed[0], parsed[1]
            at = parsed[2]
        else:
            gap = at if gap is None else gap
            m = _LINE.search(data, at + 1)
            at = m.start() if m else len(data)
    if gap is not None:
        yield gap, len(data), None, b""


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """('record', start, end, headers, block) and ('gap', start, end, {}, b'') for all bytes of an archive.

    A member's records have the member's place. ('inner gap', start, end, {'start': .., 'end': ..}, b'') is a gap in the
    inflated bytes of the member there. Records saved from a member without a whole end come after the gap it lies in, with that gap's place.
    """
    at, gap, saved = 0, None, []

    def close(end):
        yield "gap", gap, end, {}, b""
        for headers, block in saved:
            yield "record", gap, end, headers, block
        saved.clear()

    while at < len(data):
        found, end = [], None
        if data.startswith(MAGIC, at):
            content, end, failed = _member(data, at)
            if b"WARC/1." in content:
                found = [("inner gap" if h is None else "record", {"start": str(s), "end": str(e)} if h is None else h, block) for s, e, h, block in _records(content, failed)]
            if end is None:
                saved += [(h, block) for kind, h, block in found if kind == "record"]
            if end is None or not any(kind == "record" for kind, _, _ in found):
                found = []
        elif parsed := _parse(data, at):
            found, end = [("record", *parsed[:2])], parsed[2]
        if found:
            if gap is not None:
                yield from close(at)
                gap = None
            for kind, headers, block in found:
                yield kind, at, end, headers, block
            at = end
        else:
            gap = at if gap is None else gap
            m = _START.search(data, at + 1)
            at = m.start() if m else len(data)
    if gap is not None:
        yield from close(len(data))


def mark_revisits(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int = 1000, salt: int = 32) -> DataFrame:
    """Add ``_digest`` (SHA-1 of the payload) and ``_refers_to`` (null for responses).

    Digests that several payloads have are few next to the rows; the rows look them up by digest
    and a salt, so that a digest which a third of the rows have is dealt to many tasks.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.withColumn("_digest", F.sha1(payload)).withColumn("_bytes", F.octet_length(payload).cast("long"))
    known = rows.where(F.col("_bytes") >= least_bytes).groupBy("_digest", "_bytes").agg(F.count("*").alias("n"), F.max(id_col).alias("_first")).where("n > 1")
    known = known.select("_digest", "_bytes", "_first", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("_salt"))
    rows = rows.withColumn("_salt", F.pmod(F.hash(id_col), F.lit(salt))).join(known, ["_digest", "_bytes", "_salt"], "left")
    return rows.withColumn("_refers_to", F.when(F.col("_first") != F.col(id_col), F.col("_first"))).drop("_salt", "_first")


def write_warc(rows: DataFrame, folder: str, roll_bytes: int = 32 << 20) -> DataFrame:
    """Write ``page_id, url, html, _digest, _bytes, _refers_to`` rows as archives in ``folder`` (an address that
    all executors reach). Returns one row per archive, with its address. A file gets its final name when it is whole; a task
    that runs again writes files of its own, so only the addresses that the result has are to be read.
    """

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part, number, out, size, n, run_id = TaskContext.get().partitionId(), 0, None, 0, 0, uuid.uuid4().hex[:12]
        names, sizes, counts = [], [], []

        def finish():
            nonlocal out, size, n, number
            out.close()
            name = f"part-{part:05d}-{run_id}-{number:05d}.warc.gz"
            store.move(path, f"{base}/{name}")
            names.append(f"{folder}/{name}"), sizes.append(size), counts.append(n)
            out, size, n, number = None, 0, 0, number + 1

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "_digest", "_bytes", "_refers_to"))
            for page_id, url, html, sha1, n_bytes, refers in zip(*columns, strict=True):
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.part"
                    out = store.open_output_stream(path)
                headers = {"WARC-Type": "response" if refers is None else "revisit", "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Target-URI": re.sub(r"[\r\n]+", " ", url or ""), "WARC-Payload-Digest": f"sha1:{sha1}", "X-Payload-Bytes": str(n_bytes)}
                if refers is not None:
                    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers}>"}
                data = member(record_bytes(headers, (html or "").encode() if refers is None else b""))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= roll_bytes:
                    finish()
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["path", "bytes", "records"])

    return rows.select("page_id", "url", "html", "_digest", "_bytes", "_refers_to").mapInArrow(run, "path string, bytes long, records long")


READ_SCHEMA = "path string, kind string, start long, end long, inner_start long, inner_end long, type string, record_id string, target string, payload_digest string, payload_bytes long, refers_to string, block binary"


def read_warc(spark: SparkSession, paths: str | list[str] | DataFrame, keep_blocks: bool = True) -> DataFrame:
    """All records (kind ``record``) and quarantined byte gaps (kinds ``gap`` and ``inner gap``) of archives.

    paths: what Spark reads, from any of its stores, or a table with a column ``path`` of addresses that executors open.

    payload_bytes and payload_digest are of the block as read for responses, as stated for revisits.
    """

    def run(batches):
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        types = [pa.string(), pa.string(), *[pa.int64()] * 4, *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[] for _ in types], types, strict=True)], names=names)

        for b in batches:
            contents = (data.as_py() for data in b.column(1)) if b.num_columns > 1 else map(opened, b.column(0).to_pylist())
            for path, data in zip(b.column(0).to_pylist(), contents, strict=True):
                rows, held = [], 0
                for kind, start, end, h, block in salvage(data):
                    inner, h = ((int(h["start"]), int(h["end"])), {}) if kind == "inner gap" else ((None, None), h)
                    revisit = h.get("warc-type") == "revisit"
                    stated = h.get("x-payload-bytes", "")
                    rows.append((
                        path, kind, start, end, *inner, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"),
                        h.get("warc-payload-digest", "").removeprefix("sha1:") or None if revisit or kind != "record" else hashlib.sha1(block).hexdigest(),
                        (int(stated) if stated.isdigit() else None) if revisit else len(block) if kind == "record" else None,
                        h.get("warc-refers-to"), block if keep_blocks else None,
                    ))
                    held += len(block) if keep_blocks else 0
                    if held > 1 << 23 or len(rows) >= 5000:
                        yield batch(rows)
                        rows, held = [], 0
                yield batch(rows)

    def opened(path):
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        with store.open_input_stream(name) as f:
            return f.read()

    if isinstance(paths, DataFrame):
        return paths.select("path").mapInArrow(run, READ_SCHEMA)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(run, READ_SCHEMA)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages to archives and read them back. One row per record, with the digest columns."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    rows = mark_revisits(pages.select("page_id", "url", "html"), "page_id", "html")
    written = materialize(write_warc(rows, folder), "archives")
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d*)>$", 1).try_cast("long")
    read = read_warc(spark, written.repartition(max(1, written.count()), "path"), keep_blocks=False).where("kind = 'record'")
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.when(F.col("refers_to").isNotNull(), number("refers_to")).alias("refers_to"))


def op5_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = {
    "op5_warc": """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
     d as (select page_id, octet_length(payload) as n, sha1(payload) as digest from p),
     g as (select digest, n, max(page_id) as top from d where n >= 1000 group by digest, n)
select d.page_id, cast(d.n as bigint) as payload_bytes, d.digest as payload_digest,
       case when g.top is null or g.top = d.page_id then 'response' else 'revisit' end as record_type,
       case when g.top <> d.page_id then g.top end as refers_to
from d left join g on g.digest = d.digest and g.n = d.n
"""
}
