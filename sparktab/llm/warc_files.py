"""WARC archives of pages, written by Spark's own writer and read record by record.

Writing. Each page is one record in one gzip member. Payloads of at least ``LEAST`` bytes that several pages share are kept once: the page with the
largest id is the ``response``, the others are ``revisit`` records with the HTTP head only, its Content-Length, the digest and the response's
id. A task starts a new archive after ``ARCHIVE_BYTES``, and begins each with a warcinfo record. The members go through the text writer, so
archives reach any file system of the session under its commit protocol: its line end is a zero byte, and that is the last byte of the gzip
member of any record below 16 MB, so it is left out of the row. Behind a longer record the zero byte is padding, which gzip readers skip.

Reading. A task holds one archive's compressed bytes (``ARCHIVE_BYTES`` and a record; archives from elsewhere as large as they are), walks its members
with incremental decompression, frames each record by its Content-Length and digests block and payload piece by piece, so a record of any length
takes ``PIECE`` bytes unless its payload is asked for. A damaged record is a row with a ``problem``, and reading goes on at the next member.

Null html is the empty payload, a null url has no target field, a null id no page field. White space and control characters of a url are
percent-encoded in the archive. If rows share the largest id of a payload, all of these are responses; revisits name one of them. Rows with a
null id revisit one with an id; if no row has one, all are responses. Equal rows give equal records. Empty tables give no archive and no rows.
Other columns aren't written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage

LEAST = 1000
ARCHIVE_BYTES = 16 << 20
LEVEL = 6
PIECE = 1 << 16
#: Longest head of a record or of its HTTP message.
HEAD = 1 << 20
#: Shared payloads that are broadcast (about 200 bytes each); beyond it, only those of more than 1 in ``SHARES`` rows, at most SHARES of them.
BROADCAST_PAYLOADS, SHARES = 200_000, 10_000
DATE = "2024-01-01T00:00:00Z"

# Names of the format.
VERSION = "WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "archive string, place bigint, record_type string, record_id string, refers_to_id string, target_uri string, page_id string, refers_to string, "
    "payload_bytes bigint, payload_digest string, problem string, payload binary"
)


# ---- writing


def shown_uri(url: str) -> str:
    """The url without white space and control characters."""
    return re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def record_name(page: str | None, url: str | None, digest: bytes) -> str:
    """A record id that follows from the page, so a retry writes the same."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr((page, url, digest.hex())).encode()).digest(), version=3)}>"


def labelled(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def member(fields: list[tuple[str, str | None]], block: list[bytes], level: int = LEVEL) -> bytes:
    """One record as one gzip member; Content-Length and Block-Digest are added."""
    summed = hashlib.sha1()
    for part in block:
        summed.update(part)
    fields = [*fields, ("WARC-Block-Digest", labelled(summed.digest())), ("Content-Length", str(sum(map(len, block))))]
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join([packer.compress(head.encode()), *map(packer.compress, block), packer.compress(b"\r\n\r\n"), packer.flush()])


def page_member(page: str | None, url: str | None, payload: bytes, refers: tuple[str | None, str | None] | None, date: str = DATE, level: int = LEVEL) -> bytes:
    """The record of a page; ``refers`` is (page, url) of the response that has its payload."""
    digest = hashlib.sha1(payload).digest()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_name(page, url, digest)), ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else shown_uri(url)), ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", labelled(digest)), ("Page-ID", page),
    ]
    if refers:
        fields += [
            ("WARC-Profile", IDENTICAL), ("WARC-Refers-To", record_name(*refers, digest)),
            ("WARC-Refers-To-Target-URI", None if refers[1] is None else shown_uri(refers[1])), ("Refers-To-Page-ID", refers[0]),
        ]
    return member(fields, [head] if refers else [head, payload], level)


def opening(date: str = DATE, level: int = LEVEL) -> bytes:
    """The warcinfo record that an archive begins with."""
    about = b"format: WARC File Format 1.1\r\n"
    name = f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(about).digest(), version=3)}>"
    return member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", name), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], [about], level)


def as_lines(members: list[bytes]) -> pa.Array:
    """Members as a string column (of any bytes) to which a zero byte is added on writing."""
    cut = [m[:-1] if m[-1:] == b"\0" else m for m in members]
    stops = np.concatenate([[0], np.cumsum([len(m) for m in cut])]).astype(np.int32)
    return pa.StringArray.from_buffers(len(cut), pa.py_buffer(stops), pa.py_buffer(b"".join(cut)))


def shared_payloads(rows: DataFrame, least: int) -> DataFrame:
    """digest, size, n and the page that keeps the payload (top.id, top.url), for payloads that several rows have. ``rows``: id, url, digest, size."""
    return rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "url")).alias("top")).where("n > 1")


def with_top(rows: DataFrame, shared: DataFrame, most: int) -> DataFrame:
    """``rows`` with ``top``. Few shared payloads are broadcast; of many only the most common, whose number has a bound, and the rest is joined by digest."""
    key, n_shared = ["digest", "size"], shared.count()
    tops = shared.select(*key, "top")
    if n_shared <= most:
        return rows.join(F.broadcast(tops), key, "left")
    often = F.broadcast(cut_lineage(shared.where(F.col("n") > max(1, rows.count() // SHARES)).select(*key, "top")))
    at = rows.join(often, key, "left")
    hot = at.where(F.col("top").isNotNull())
    return hot.unionByName(at.where(F.col("top").isNull()).drop("top").join(tops.join(often.select(*key), key, "left_anti"), key, "left"))


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES,
    date: str = DATE, level: int = LEVEL, broadcast_payloads: int = BROADCAST_PAYLOADS,
) -> None:
    """Write the archives under ``path``."""
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html")})
    shared = cut_lineage(shared_payloads(rows.select("id", "url", "digest", "size"), least))
    joined = with_top(rows, shared, broadcast_payloads)
    refers: Column = F.col("top").isNotNull() & ~F.col("top.id").eqNullSafe(F.col("id"))
    shaped = joined.select(
        F.col("id").cast("string").alias("page"), "url", "html", refers.alias("refers"), F.col("top.id").cast("string").alias("top_page"), F.col("top.url").alias("top_url")
    )

    def run(batches):
        archive, size, place = -1, archive_bytes, 0
        for batch in batches:
            numbers, lines = [], []
            held = 0
            for at in range(batch.num_rows):
                page, link, body, refer, top_page, top_url = (batch[c][at] for c in ("page", "url", "html", "refers", "top_page", "top_url"))
                if size >= archive_bytes:
                    archive, size = archive + 1, 0
                    numbers.append(archive)
                    lines.append(opening(date, level))
                made = page_member(page.as_py(), link.as_py(), body.as_buffer().to_pybytes(), (top_page.as_py(), top_url.as_py()) if refer.as_py() else None, date, level)
                numbers.append(archive)
                lines.append(made)
                size, held = size + len(made), held + len(made)
                if held >= archive_bytes or at + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [as_lines(lines), pa.array(range(place, place + len(lines)), pa.int64()), pa.array(numbers, pa.int32())], ["member", "place", "archive"])
                    place += len(lines)
                    numbers, lines, held = [], [], 0

    members = shaped.mapInArrow(run, "member string, place bigint, archive int").sortWithinPartitions("archive", "place").select("member", "archive")
    members.write.partitionBy("archive").option("lineSep", "\0").option("compression", "none").mode("errorifexists").text(path)


# ---- reading


class Damaged(Exception):
    """A record that can't be read to its end."""


def pieces(data: memoryview, at: int, end: list[int]) -> Iterator[bytes]:
    """The content of the gzip member at a place, piece by piece; ``end`` gets the place behind it."""
    unpack = zlib.decompressobj(31)
    while not unpack.eof:
        rest = unpack.unconsumed_tail
        if not rest:
            rest = data[at:at + PIECE]
            at += len(rest)
            if not len(rest):
                raise Damaged("archive ends inside a record")
        try:
            out = unpack.decompress(rest, PIECE)
        except zlib.error as error:
            raise Damaged("compressed data is broken") from error
        if out:
            yield out
    end.append(at - len(unpack.unused_data))


class Content:
    """The content of one member: heads up to their empty line, then counted bytes."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.have = parts, b""

    def head(self, most: int = HEAD) -> bytes | None:
        """Everything before the next empty line; None if there is none within ``most`` bytes."""
        while (cut := self.have.find(b"\r\n\r\n")) < 0:
            more = next(self.parts, None) if len(self.have) <= most else None
            if more is None:
                return None
            self.have += more
        found, self.have = self.have[:cut], self.have[cut + 4:]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, piece by piece."""
        while n:
            if not self.have:
                self.have = next(self.parts, b"")
                if not self.have:
                    raise Damaged("record is shorter than its Content-Length")
            part, self.have = self.have[:n], self.have[n:]
            n -= len(part)
            yield part


def fields_of(head: bytes) -> dict[str, str]:
    """Fields by lower-cased name; continued lines belong to the field before."""
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
    return {k.strip().lower(): v.strip() for k, colon, v in (line.partition(":") for line in lines[1:]) if colon}


def plain_digest(value: str | None) -> str | None:
    """Lower-case hex of a labelled SHA-1 digest; None for other algorithms."""
    name, _, text = (value or "").partition(":")
    if name.lower() != "sha1":
        return None
    if len(text) == 40:
        return text.lower()
    try:
        return base64.b32decode(text.upper()).hex()
    except ValueError:
        return None


def read_record(content: Content, payloads: bool) -> dict:
    """One record; digests that the record states are verified."""
    head = content.head()
    if head is None or not head.startswith(b"WARC/"):
        raise Damaged("no record head")
    fields = fields_of(head)
    if not fields.get("content-length", "").isdigit():
        raise Damaged("no Content-Length")
    length, kind = int(fields["content-length"]), fields.get("warc-type")
    is_http = fields.get("content-type", "").replace(" ", "").lower().startswith("application/http") and kind in ("response", "revisit")
    block, payload, size, kept, said = hashlib.sha1(), hashlib.sha1(), 0, [], None
    waiting: bytes | None = b"" if is_http else None  # the HTTP head as far as it is read
    for part in content.take(length):
        block.update(part)
        if waiting is not None:
            waiting += part
            cut = waiting.find(b"\r\n\r\n")
            if cut < 0:
                if len(waiting) > HEAD:
                    raise Damaged("HTTP head is too long")
                continue
            said = fields_of(waiting[:cut]).get("content-length")
            part, waiting = waiting[cut + 4:], None
        payload.update(part)
        size += len(part)
        if payloads and part:
            kept.append(part)
    tail = content.have
    for part in content.parts:
        tail += part
        if len(tail) > 4:
            break
    if tail != b"\r\n\r\n":
        raise Damaged("record is longer than its Content-Length")
    problem = None
    if waiting is not None:
        problem = "HTTP head has no end"
    stated = plain_digest(fields.get("warc-payload-digest"))
    if plain_digest(fields.get("warc-block-digest")) not in (None, block.hexdigest()):
        problem = "block digest differs"
    elif kind == "response" and is_http and stated not in (None, payload.hexdigest()):
        problem = "payload digest differs"
    elif kind == "response" and said is not None and said != str(size):
        problem = "payload length differs"
    whole = kind != "revisit"
    return {
        "record_type": kind, "record_id": fields.get("warc-record-id"), "refers_to_id": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri"),
        "page_id": fields.get("page-id"), "refers_to": fields.get("refers-to-page-id"), "payload_bytes": size if whole else int(said) if (said or "").isdigit() else None,
        "payload_digest": payload.hexdigest() if whole else stated, "problem": problem, "payload": b"".join(kept) if payloads and whole else None,
    }


def records_of(data: memoryview, payloads: bool) -> Iterator[dict]:
    """All records of an archive with their places."""
    at = 0
    while at < len(data):
        if data[at] == 0:  # padding
            at += 1
            continue
        end: list[int] = []
        try:
            content = Content(pieces(data, at, end))
            found = read_record(content, payloads)
            if not end:
                raise Damaged("archive ends inside a record")
            yield {"place": at, **found}
            at = end[0]
        except Damaged as error:
            yield {"place": at, "problem": str(error)}
            at = next_member(data, at + 1)


def next_member(data: memoryview, at: int) -> int:
    """The next place where a member begins with a record head; the archive's end if there is none."""
    while at < len(data):
        window = bytes(data[at:at + PIECE])
        cut = window.find(b"\x1f\x8b\x08")
        if cut < 0:
            at += max(1, len(window) - 2)
            continue
        at += cut
        try:
            if next(pieces(data, at, []), b"").startswith(b"WARC/"):
                return at
        except Damaged:
            pass
        at += 1
    return len(data)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row of ``RECORD`` for each record, warcinfo and damaged ones included; ``payload`` is null unless asked for."""
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = {"place": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def batch_of(archive: str, rows: list[dict]) -> pa.RecordBatch:
        rows = [{"archive": archive, **row} for row in rows]
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                archive, rows, held = batch["path"][at].as_py(), [], 0
                for row in records_of(memoryview(batch["content"][at].as_buffer()), payloads):
                    rows.append(row)
                    held += 200 + len(row.get("payload") or b"")
                    if held >= ARCHIVE_BYTES:
                        yield batch_of(archive, rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(archive, rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, RECORD)
