"""WARC archives: writing, a normaliser of whole-file gzip streams, and reading back.

Spark's text sink writes one gzip stream per file over all its records.  The
normaliser inflates such a stream once, from end to end, and writes each record
as a gzip member of its own, with a sidecar index of where each one lies.  Then
any record is read by its offset alone.

Archives are whole before they are seen: a task writes under a hidden name and
renames at its end, so that a lost executor leaves no half file, and a repeated
task puts the same file in its place.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswell.llm.common import materialize
from presswell.sources.shared import shared_dir

#: Fixed values of the format: line ends, what ends a record, the version line.
EOL, END, VERSION = "\r\n", "\r\n\r\n", "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes that are read from an archive at once.
CHUNK = 1 << 20

INDEX = ("offset", "length", "record_id", "record_type", "target_uri", "payload_digest", "refers_to")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text or binary: five hexadecimal digits are four of base 32."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def captures(pages: DataFrame, id_column: str, url: str, payload: str, least: int = 0) -> DataFrame:
    """(id, url, payload, digest, size, first): a row per row of ``pages``.

    ``first`` is the smallest id of all captures with the same payload of at
    least ``least`` bytes; below that each capture is the first one itself.
    Copies are counted in part before the shuffle, and only payloads that occur
    more than once are joined back, on sides that are written first, so that a
    payload which very many captures share is split over tasks.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_column).cast("string").alias("id"), F.col(id_column).cast("long").alias("number"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "size": F.length("payload").cast("long")})
    groups = rows.where(F.col("size") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("first")).where("n > 1 AND first IS NOT NULL")
    firsts = materialize(groups.select("digest", "first"), "warc-firsts")
    return rows.join(firsts.hint("shuffle_hash"), "digest", "left").select(
        "id", "url", "payload", "digest", "size", F.when((F.col("size") >= least) & ~F.col("number").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def record(date: str) -> Column:
    """The bytes of a capture's record, but for the line ends that close it.

    A revisit holds the headers of the response alone; they still tell the
    length of the payload.
    """
    name = lambda number, digest: F.concat(F.lit("<urn:page:"), number, F.lit(":"), digest, F.lit(">"))
    header = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(EOL))
    again, size = F.col("refers_to").isNotNull(), F.col("size").cast("string")
    number, first = F.coalesce("id", F.lit("")), F.col("refers_to").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=UTF-8{EOL}Content-Length: "), size, F.lit(END))
    block = F.when(again, http.cast("binary")).otherwise(F.concat(http.cast("binary"), F.col("payload")))
    # No header may hold a line end.
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit(VERSION + EOL), header("WARC-Type", F.when(again, "revisit").otherwise("response")), header("WARC-Record-ID", F.when(again, name(number, F.concat("digest", F.lit(":revisit")))).otherwise(name(number, F.col("digest")))),
        header("WARC-Date", F.lit(date)), F.when(uri.isNotNull(), header("WARC-Target-URI", uri)).otherwise(""), header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(again, F.concat(header("WARC-Profile", F.lit(PROFILE)), header("WARC-Refers-To", name(first, F.col("digest"))))).otherwise(""),
        header("Content-Type", F.lit("application/http; msgtype=response")), header("Content-Length", F.length(block).cast("string")), F.lit(EOL))
    return F.concat(head.cast("binary"), block)


def write(rows: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``captures`` as archives, a gzip stream each; bytes go as they are."""
    text = record(date).cast("string").alias("value")
    rows.select(text).write.option("compression", "gzip").option("lineSep", END).option("zlib.compress.level", "BEST_SPEED").text(path)


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path as Spark lists it."""
    scheme, colon, rest = path.partition(":")
    return fs.FileSystem.from_uri(f"{scheme}://{rest}" if colon and not rest.startswith("//") else path)


def inflated(source) -> Iterator[bytes]:
    """The bytes behind a gzip file of one or more members, read once and in pieces."""
    unpack = None
    while raw := source.read(CHUNK):
        while raw:
            unpack = unpack or zlib.decompressobj(31)
            if out := unpack.decompress(raw):
                yield out
            raw, unpack = (unpack.unused_data, None) if unpack.eof else (b"", unpack)
    if unpack is not None:
        raise ValueError("the archive ends inside a gzip member")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record with its closing line ends), cut by the stated lengths."""
    held, end = bytearray(), END.encode()

    def fill(size: int) -> bool:
        while len(held) < size:
            more = next(pieces, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        while held[:2] == EOL.encode() or (len(held) < 2 and fill(2) and held[:2] == EOL.encode()):
            del held[:2]  # line ends to spare between records
        seen = 0
        while (at := held.find(end, max(0, seen - 3))) < 0:
            seen = len(held)
            if not fill(seen + 1):
                if held.strip():
                    raise ValueError("the archive ends inside a header")
                return
        lines = held[:at].decode("utf-8", "replace").split(EOL)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins with {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = at + len(end) + int(headers["content-length"])
        if not fill(size):
            raise ValueError("the archive ends inside a record")
        yield headers, bytes(held[:size]) + end
        del held[:size]
        fill(len(end))
        if held[: len(end)] == end:
            del held[: len(end)]


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _bare(name: str | None) -> str | None:
    return name.strip("<>") if name else None


def normalised_file(source: str, target: str) -> tuple[int, int, int]:
    """Rewrite an archive record by record, with its index; (records, bytes before and after)."""
    store, path = _filesystem(source)
    out_store, out = _filesystem(target)
    hidden = posixpath.join(posixpath.dirname(out), f"_{uuid.uuid4().hex}")
    offset = count = before = 0
    with store.open_input_stream(path, compression=None) as raw, out_store.open_output_stream(hidden, compression=None) as to, \
            out_store.open_output_stream(hidden + ".idx", compression=None) as index:
        for headers, data in records(inflated(raw)):
            member = _member(data)
            to.write(member)
            digest = headers.get("warc-payload-digest", "")
            entry = (offset, len(member), _bare(headers.get("warc-record-id")), headers.get("warc-type"), headers.get("warc-target-uri"), digest.removeprefix("sha1:") or None, _bare(headers.get("warc-refers-to")))
            index.write((json.dumps(dict(zip(INDEX, entry)), ensure_ascii=False) + "\n").encode())
            offset, count, before = offset + len(member), count + 1, before + len(data)
    # The index first, so that no archive is seen without one.
    out_store.move(hidden + ".idx", out + ".idx")
    out_store.move(hidden, out)
    return count, before, offset


def listed(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, length) of the files of a folder, dealt out by their sizes; what they hold is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select("path", "length")


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite all archives ``source/*.gz`` to ``target/*.warc.gz``, each with an index ``.idx``.

    Returns (archive, records, inflated_bytes, stored_bytes).  An archive may be
    of any length, one gzip stream or many members; it is inflated in pieces and
    a task holds one record.  Cut-off archives, or text that is no record, raise.
    A folder without archives gives no rows.
    """
    store, folder = _filesystem(target)
    store.create_dir(folder, recursive=True)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path in part.column("path").to_pylist():
                stem = path.rpartition("/")[2].removesuffix(".gz").removesuffix(".txt").removesuffix(".warc")
                out = f"{target}/{stem}.warc.gz"
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (out, *normalised_file(path, out))], ["archive", "records", "inflated_bytes", "stored_bytes"])

    return materialize(listed(spark, source, ".gz").mapInArrow(run, "archive string, records bigint, inflated_bytes bigint, stored_bytes bigint"), "warc-archives")


def member_at(source: fs.NativeFile, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """(headers, block) of the record whose member lies there."""
    source.seek(offset)
    headers, data = next(records(iter([zlib.decompress(source.read(length), 31)])))
    return headers, data[-int(headers["content-length"]) - len(END) : -len(END)]


_KINDS = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
READ = "archive string, offset bigint, length bigint, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary, intact boolean"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of normalised archives, each by its place in the index.

    ``payload`` is what follows the inner headers (null for revisits, or without
    ``payloads``); ``payload_bytes`` is the length that these headers state.
    ``intact`` tells whether a response has that length and the digest stated.
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, _KINDS[kind]) for name, kind in map(str.split, READ.split(", "))])
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        for part in parts:
            for archive in part.column("path").to_pylist():
                store, at = _filesystem(archive)
                rows, held = [], 0
                with store.open_input_file(at) as source, store.open_input_stream(at + ".idx", compression=None) as index:
                    for entry in map(json.loads, _lines(index)):
                        headers, block = member_at(source, entry["offset"], entry["length"])
                        head, _, payload = block.partition(END.encode())
                        inner = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split(EOL)[1:])}
                        size = int(inner.get("content-length", len(payload)))
                        revisit = entry["record_type"] == "revisit"
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        intact = _bare(headers.get("warc-record-id")) == entry["record_id"] and (revisit or (size == len(payload) and digest == entry["payload_digest"]))
                        rows.append((archive, entry["offset"], entry["length"], entry["record_id"], entry["record_type"], entry["target_uri"], entry["refers_to"], entry["payload_digest"],
                                     size, None if revisit or not payloads else payload, intact))
                        held += len(payload) if payloads else 200
                        if held > CHUNK * 8:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return listed(spark, path, ".warc.gz").mapInArrow(run, READ)


def _lines(source) -> Iterator[bytes]:
    held = b""
    while raw := source.read(CHUNK):
        *whole, held = (held + raw).split(b"\n")
        yield from whole
    if held:
        yield held


def archived(pages: DataFrame, id_column: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, path: str | None = None) -> DataFrame:
    """Archive ``pages``, normalise the archives and read them back.

    Returns what ``read`` returns, with the ids taken out of the records' names:
    (page_id, record_type, refers_to, payload_digest, payload_bytes, archive,
    offset, length, intact).  Of captures with equal payloads of at least
    ``least`` bytes the one with the smallest id is the response and the others
    revisit it; shorter ones are all responses.  A null payload is empty; of
    equal payloads without any id all are responses, and one without an id never
    comes before one with an id; rows that repeat both id and payload are a
    record each, alike; a null url has no header; payloads may have any length
    that one value may have; extra columns are ignored; an empty table gives an
    empty result.  The files stay in ``path``, or a folder of their own in the
    shared one.
    """
    spark = pages.sparkSession
    root = (path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}").rstrip("/")
    write(captures(pages, id_column, url, payload, least), f"{root}/streams")
    normalise(spark, f"{root}/streams", f"{root}/archives")
    number = lambda name: F.when(F.split_part(name, F.lit(":"), F.lit(3)) != "", F.split_part(name, F.lit(":"), F.lit(3))).cast("long")
    return read(spark, f"{root}/archives", payloads=False).select(
        number(F.col("record_id")).alias("page_id"), "record_type", number(F.col("refers_to")).alias("refers_to"), "payload_digest", "payload_bytes", "archive", "offset", "length", "intact")
