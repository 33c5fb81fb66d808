"""WARC archives: a writer with revisit records and a salvage reader.

The writer gives every page a record in a gzip member of its own (or plain), one archive or more per task; the archives
that count are those named by tasks that succeeded.  The reader checks each member and record: the record must begin with
a version line, have the length it states and the block digest it names; without a digest, its member must inflate with
its checksum.  A member may hold any number of records, and those before and after damage in it are recovered too.
After a failed check it searches on for the next gzip member or version line from which a whole record can be read,
and logs the bytes between as a quarantined gap; later records are recovered.  Archives and members are read as streams.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Workspace, lean, table_bytes

VERSION = b"WARC/1.1"
MEMBER = b"\x1f\x8b\x08"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 18
#: A payload that more than one of so many pages have is shared by many; tasks that read archives, at most.
LARGE, MOST_READERS = 1000, 20_000


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri) if ":" in uri else f"file://{uri}")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def base32_of_hex(digest: Column) -> Column:
    """Base 32 of the 40 hexadecimal digits of a SHA-1: five of them are four digits of base 32."""
    parts = [F.translate(F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for i in range(1, 41, 5)]
    return F.concat(*parts)


# ---------------------------------------------------------------- writing


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record; a revisit has the HTTP head only, whose Content-Length is that of the full payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest}')}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    text = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    return VERSION + b"\r\n" + text + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def with_revisits(pages: DataFrame, ws: Workspace, least_bytes: int = 0) -> DataFrame:
    """``pages(page_id, url, html)`` with payload_digest and refers_to.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the largest page_id is the response.  A
    page without an id never is one that others refer to.  Rows that repeat the largest id are all responses.
    """
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select("page_id", "url", "html", base32_of_hex(F.sha1(html)).alias("payload_digest"), F.length(html).alias("_n"))
    groups = keyed.where(F.col("_n") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("_rows"))
    groups = ws.save(groups.where("_rows > 1 and _first is not null").select(F.col("payload_digest").alias("_digest"), "_first", "_rows"), "groups")
    same = (F.col("payload_digest") == F.col("_digest")) & (F.col("_n") >= least_bytes)
    if table_bytes(groups) <= BROADCAST_BYTES:
        joined = keyed.join(F.broadcast(groups), same, "left")
    else:  # payloads that many pages share meet their groups where they are, the rest are shuffled
        large = F.col("_rows") * LARGE > keyed.count()
        first = keyed.join(F.broadcast(groups.where(large)), same, "left")
        rest = first.where("_digest is null").select(keyed.columns).join(groups.where(~large), same, "left")
        joined = first.where("_digest is not null").unionByName(rest)
    return joined.select("page_id", "url", "html", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, archive_bytes: int = 64 << 20, compress: bool = True, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes ``pages(page_id, url, html, payload_digest, refers_to)``; the lazy result names the archives: path, records, bytes.

    Save the result once and read archives by it alone: archives of lost or repeated tasks are not in it.
    """

    def run(batches):
        store, root = open_folder(folder)
        store.create_dir(root, recursive=True)
        out, path, records, size, done = None, "", 0, 0, []
        for b in batches:
            for page_id, url, html, digest, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_digest", "refers_to"))):
                if out is None:
                    path, records, size = f"{root}/{uuid.uuid4().hex}.warc" + ".gz" * compress, 0, 0
                    out = store.open_output_stream(path, compression=None)
                data = record_bytes(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers, date)
                data = gzip_member(data) if compress else data
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    done.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records, size))
        cols = list(zip(*done)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return pages.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(lean(run), "path string, records long, bytes long")


# ---------------------------------------------------------------- reading


class Stream:
    """Random access to a file through a buffer that holds what lies from ``at`` on."""

    def __init__(self, file):
        self.file, self.size, self.at, self.held = file, file.size(), 0, bytearray()

    def drop(self, to: int) -> None:
        """What lies before ``to`` is not needed for now."""
        if 0 <= to - self.at <= len(self.held):
            del self.held[: to - self.at]
        else:
            self.held = bytearray()
        self.at = to

    def fill(self, to: int) -> bool:
        """Whether the file has the bytes up to ``to``; holds them."""
        have = self.at + len(self.held)
        if to > have:
            self.file.seek(have)
            self.held += self.file.read(max(to - have, CHUNK))
        return to <= self.at + len(self.held)

    def bytes(self, lo: int, hi: int) -> bytes:
        if lo < self.at:
            self.drop(lo)
        self.fill(hi)
        return bytes(self.held[lo - self.at : hi - self.at])


class Inflated:
    """The content of the gzip member at ``start`` of a stream, inflated as far as it is asked for and can be.

    ``end`` is where the member ends, if it does so with the right checksum; else ``reason`` says why not.
    """

    def __init__(self, stream: Stream, start: int):
        self.stream, self.to, self.z = stream, start, zlib.decompressobj(31)
        self.at, self.held, self.end, self.reason = 0, bytearray(), None, None

    def drop(self, to: int) -> None:
        del self.held[: to - self.at]
        self.at = to

    def fill(self, to: int) -> bool:
        while to > self.at + len(self.held) and self.end is None and self.reason is None:
            self.stream.drop(self.to)
            part = self.z.unconsumed_tail or self.stream.bytes(self.to, self.to + CHUNK)
            fresh = not self.z.unconsumed_tail
            if not part:
                self.reason = "truncated member"
                break
            before = self.z.copy()
            try:
                self.held += self.z.decompress(part, 4 * CHUNK)
            except zlib.error:
                self.reason = "member does not inflate"
                try:
                    for k in range(0, len(part), 16):  # what comes before the damage
                        self.held += before.decompress(part[k : k + 16])
                except zlib.error:
                    pass
                break
            self.to += len(part) if fresh else 0
            if self.z.eof:
                self.end = self.to - len(self.z.unused_data)
        return to <= self.at + len(self.held)

    def bytes(self, lo: int, hi: int) -> bytes:
        self.fill(hi)
        return bytes(self.held[lo - self.at : hi - self.at])


class BadRecord(ValueError):
    pass


def _intact(file, at: int) -> bool:
    """Whether the gzip member at ``at`` inflates to its end."""
    content, to = Inflated(Stream(file), at), 0
    while content.fill(to + CHUNK):
        to += CHUNK
        content.drop(to)
    return content.end is not None


def _head(data: bytes) -> tuple[dict[str, str], int]:
    """Fields and the position of the block of a record at the start of ``data``."""
    if not _VERSION_LINE.match(data):
        raise BadRecord("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise BadRecord("head does not end")
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadRecord("field without colon")
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        raise BadRecord("head lacks a field")
    return fields, end + 4


def _checked(fields: dict[str, str], block: bytes) -> dict:
    """A record's row; its block digest must fit, if it is a SHA-1, and so must the payload digest of a response."""
    want = fields.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != base32_sha1(block):
        raise BadRecord("block digest differs")
    kind, stated = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    http = fields.get("content-type", "").startswith("application/http")
    head, gap, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    if http and not gap:
        raise BadRecord("HTTP head does not end")
    length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
    if kind == "revisit":
        n, digest = int(length[1]) if length else None, stated
    else:
        n, digest = len(payload), base32_sha1(payload)
        if stated and stated != digest and kind == "response":
            raise BadRecord("payload digest differs")
    page = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("warc-record-id", ""))
    refers = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("warc-refers-to", ""))
    return {
        "record_type": kind, "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "page_id": int(page[1]) if page else None, "payload_bytes": n, "payload_digest": digest,
        "refers_to": int(refers[1]) if refers else None, "payload": None if kind == "revisit" else payload, "sure": want.startswith("sha1:"), "inner": None,
    }


def _read(s: Stream | Inflated, at: int) -> tuple[dict, int]:
    """The plain record at ``at`` and where the next is to begin."""
    if not _VERSION_LINE.match(s.bytes(at, at + 10)):
        raise BadRecord("no version line")
    to = at + 4096
    while b"\r\n\r\n" not in s.bytes(at, to) and s.fill(to) and to - at < 1 << 20:
        to += 4096
    fields, begin = _head(s.bytes(at, to))
    end = at + begin + int(fields["content-length"]) + 4
    if not s.fill(end):
        raise BadRecord("truncated record")
    data = s.bytes(at + begin, end)
    if data[-4:] != b"\r\n\r\n":
        raise BadRecord("length differs")
    return _checked(fields, data[:-4]), end


def _next(s: Stream | Inflated, at: int, pattern: re.Pattern) -> int:
    """The next place after ``at`` where a record may begin, or the end."""
    at += 1
    while s.fill(at + 1):
        s.drop(at)
        window = s.bytes(at, at + CHUNK)
        if found := pattern.search(window):
            return at + found.start()
        at += max(1, len(window) - 9)
    return at


def _member(s: Stream, start: int):
    """The records of the gzip member at ``start``: (place in the content, row); last comes (end or None, reason or None).

    A record without a digest counts only if its member is intact.
    """
    content, at, reason, intact = Inflated(s, start), 0, None, None
    while content.fill(at + 1):
        content.drop(at)
        try:
            row, end = _read(content, at)
            if not row["sure"]:
                intact = _intact(s.file, start) if intact is None else intact
                if not intact:
                    raise BadRecord("no digest in a damaged member")
        except BadRecord as e:
            reason = reason or str(e)
            at = _next(content, at, _VERSION_LINE)
            continue
        yield at, row
        at = end
    yield content.end, content.reason or reason or (None if at else "empty member")


def scan(file):
    """("record", offset, length, row) and ("gap", offset, length, reason) of an archive, in order.

    Of a member with several records, all have the offset of the member and the last one has its length; a damaged member
    is a gap after the records that were recovered from it.
    """
    s, at, gap, reason = Stream(file), 0, None, ""

    def bad(why: str) -> None:
        nonlocal gap, reason, at
        if gap is None:
            gap, reason = at, why
        at = _next(s, at, _NEXT)

    while at < s.size:
        s.drop(at)
        if s.bytes(at, at + 3) == MEMBER:
            held, end, why = None, None, None
            for place, what in _member(s, at):
                if not isinstance(what, dict):
                    end, why = place, what
                    continue
                if gap is not None:
                    yield "gap", gap, at - gap, reason
                    gap = None
                if held:
                    yield "record", at, 0, held
                held = what | {"inner": place}
            whole = end is not None and why is None
            if held:
                yield "record", at, end - at if whole else 0, held
            if whole:
                at = end
            elif end is not None and held:  # it inflates; only some of its content is bad
                yield "gap", at, end - at, why
                at = end
            else:
                bad(why)
            continue
        try:
            row, end = _read(s, at)
        except BadRecord as e:
            bad(str(e))
            continue
        if gap is not None:
            yield "gap", gap, at - gap, reason
            gap = None
        yield "record", at, end - at, row
        at = end
    if gap is not None:
        yield "gap", gap, s.size - gap, reason


FOUND = "path string, kind string, offset long, length long, inner long, reason string, record_type string, record_id string, uri string, page_id long, payload_bytes long, payload_digest string, refers_to long, payload binary"


def salvage(archives: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Rows of kind ``record`` and ``gap`` (the quarantine log) of the archives named by ``archives(path)``.

    Every record that passes its checks is there, whatever lies between; an empty archive has no rows.  ``inner`` is the
    place of a record in the content of its gzip member.  A null path is passed over, a repeated one is read again; extra
    columns are ignored.
    """
    names = [f.split()[0] for f in FOUND.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names)

    def run(batches):
        store, _ = open_folder(folder)
        held, size = [], 0
        for b in batches:
            for path in b.column("path").to_pylist():
                if path is None:
                    continue
                with store.open_input_file(path) as f:
                    for kind, at, n, what in scan(f):
                        row = {"path": path, "kind": kind, "offset": at, "length": n} | (what if kind == "record" else {"reason": what})
                        if not with_payload:
                            row["payload"] = None
                        held.append(row)
                        size += len(row.get("payload") or b"") + 500
                        if size >= 8 << 20:
                            yield batch(held)
                            held, size = [], 0
        yield batch(held)

    return archives.select("path").mapInArrow(lean(run), FOUND)


def round_trip(pages: DataFrame, least_bytes: int = 0, compress: bool = True) -> DataFrame:
    """Writes every row of ``pages(page_id, url, html)`` to archives in the shared folder and reads them back: the rows of
    ``salvage``.

    A null html is an empty payload; repeated rows are records of their own; payloads are written whole, however long; an
    empty table gives no rows; extra columns are ignored.
    """
    ws = Workspace(pages.sparkSession, "warc")
    folder = f"{ws.root}/archives"
    archives = ws.save(write(with_revisits(pages, ws, least_bytes), folder, compress=compress), "manifest")
    return salvage(archives.repartition(max(1, min(MOST_READERS, archives.count())), "path"), folder, with_payload=False)
