"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

Every record is a gzip member of its own. Tasks write archives of bounded size to a new folder below the shared
one, under names that no other attempt uses, and a manifest names those that count, so a repeated task leaves
files that nobody reads.

The reader checks every record: member checksum, version line, header, length, payload digest. After a failed
check it searches for the next place where a valid record starts, a member or a bare version line, goes on from
there, and reports the bytes between as a gap. A block whose header and length are sound is passed over as a whole, so
what looks like a record inside it is none. The same is done inside a member of several records, also one that is
cut or damaged, as far as it can be unpacked.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from datamill.llm.common import shared_folder, text_of, written

ARCHIVE_BYTES = 8 << 20  # an archive is closed when it reaches this size
LEAST = 1000  # bytes from which equal payloads become revisits
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"  # pages carry no time of their own
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER = b"\x1f\x8b\x08"
STARTS = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
VERSIONS = re.compile(rb"WARC/1\.[01]\r\n")
STEP = 1 << 16  # bytes that are unpacked at once
RECORD = "kind string, archive string, begin long, end long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string, reason string"


def _id(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _page(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def _safe(value: str | None) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", value or "")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A record of one page. A revisit holds no payload, but its length and digest."""
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_safe(url)}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_id(refers_to)}"]
    block = b"" if revisit else payload
    lines.append(f"Content-Length: {len(block)}")
    return VERSION + b"\r\n" + "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class DamagedBlock(ValueError):
    """A failed check of something whose end is sure; the search goes on at ``behind``."""

    def __init__(self, reason: str, behind: int):
        super().__init__(reason)
        self.behind = behind


def _plain_record(data: bytes, at: int, vouched: bool = False) -> tuple[dict, int]:
    """The record that starts at ``at`` and the place behind it; ValueError says what is wrong.

    ``vouched`` asks for a digest of the block, which revisits don't have.
    """
    line = data[at:at + 10]
    if line not in (b"WARC/1.0\r\n", b"WARC/1.1\r\n"):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("header without end")
    headers: dict[str, str] = {}
    for line in data[at + 10:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without colon")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not size.isdigit():
        raise ValueError("no usable length")
    start = end + 4
    block = data[start:start + int(size)]
    behind = start + int(size)
    if len(block) < int(size) or data[behind:behind + 4] != b"\r\n\r\n":
        raise ValueError("block and length disagree")
    kind = headers.get("warc-type")
    declared = headers.get("warc-payload-digest", "")
    if declared and not declared.startswith("sha1:"):
        raise DamagedBlock("unknown digest", behind + 4)
    try:
        digest = base64.b32decode(declared[5:]).hex() if declared else hashlib.sha1(block).hexdigest()
    except ValueError:
        raise DamagedBlock("unreadable digest", behind + 4) from None
    if kind != "revisit" and hashlib.sha1(block).hexdigest() != digest:
        raise DamagedBlock("digest and block disagree", behind + 4)
    if vouched and (kind == "revisit" or not declared):
        raise DamagedBlock("no digest vouches for a record of a damaged member", behind + 4)
    length = headers.get("x-payload-length", "")
    return {
        "page_id": _page(headers.get("warc-record-id")), "url": headers.get("warc-target-uri"), "record_type": kind,
        "refers_to": _page(headers.get("warc-refers-to")), "payload_bytes": int(length) if length.isdigit() else len(block),
        "payload_digest": digest, "payload": None if kind == "revisit" else block.decode("utf-8", "replace"),
    }, behind + 4


def _gap(begin: int, end: int, reason: str) -> dict:
    return {"kind": "gap", "begin": begin, "end": end, "reason": reason}


def _recovered(data: bytes, read: Callable[[int], tuple[list[dict], int]], starts: re.Pattern) -> Iterator[dict]:
    """What ``read`` gives from place to place, and a gap from each failed check to the next of ``starts`` where it gives something."""
    at, begin, reason = 0, 0, None
    while at < len(data):
        try:
            found, end = read(at)
        except ValueError as e:
            if reason is None:
                begin, reason = at, str(e)
            place = starts.search(data, getattr(e, "behind", at + 1))
            at = place.start() if place else len(data)
            continue
        if reason is not None:
            yield _gap(begin, at, reason)
            reason = None
        yield from found
        at = end
    if reason is not None:
        yield _gap(begin, len(data), reason)


def _plain_rows(data: bytes, at: int, vouched: bool = False) -> tuple[list[dict], int]:
    found, end = _plain_record(data, at, vouched)
    return [{"kind": "record", "begin": at, "end": end, "reason": None, **found}], end


def _unpacked(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """All that the member at ``at`` gives before its end or a damage, the place behind what was read, and the failed check."""
    unpacker, out, taken = zlib.decompressobj(31), [], at
    while not unpacker.eof and taken < len(data):
        before = unpacker.copy()
        try:
            out.append(unpacker.decompress(data[taken:taken + STEP]))
        except zlib.error as e:
            # The call gave nothing: once more, byte by byte, up to the damage.
            for i in range(taken, min(taken + STEP, len(data))):
                try:
                    out.append(before.decompress(data[i:i + 1]))
                except zlib.error:
                    break
            return b"".join(out), i, f"damaged member: {e}"
        taken += STEP
    return b"".join(out), min(taken, len(data)) - len(unpacker.unused_data), None if unpacker.eof else "member without end"


def _rows_at(data: bytes, at: int) -> tuple[list[dict], int]:
    """Records and gaps of the member or the bare record at ``at``, and the place behind; ValueError if it has no valid record.

    All whole records of a cut member count. Of a damaged one those count whose digest vouches for them, if another of
    its records fails its checks; if none does, the damage is in a header, nobody knows which, and none counts.
    """
    if not data.startswith(MEMBER, at):
        return _plain_rows(data, at)
    content, end, fault = _unpacked(data, at)
    damaged = fault is not None and fault.startswith("damaged")
    found = list(_recovered(content, lambda i: _plain_rows(content, i), VERSIONS))
    if damaged:
        failed = any(r["kind"] == "gap" for r in found)
        found = list(_recovered(content, lambda i: _plain_rows(content, i, True), VERSIONS)) if failed else []
    gaps = [r for r in found if r["kind"] == "gap"]
    if fault is None and len(found) == len(gaps) > 0:
        raise DamagedBlock(gaps[0]["reason"], end)
    if fault and len(found) == len(gaps):
        raise ValueError(fault)
    if fault:
        # Where a damaged member ends is not sure.
        place = STARTS.search(data, at + 1)
        end = place.start() if place else len(data)
    rows = [r | {"begin": at, "end": end} for r in found if r["kind"] == "record"]
    rows += [_gap(at, end, f"{r['reason']} (bytes {r['begin']} to {r['end']} of the member)") for r in gaps]
    return rows + ([_gap(at, end, fault)] if fault else []), end


def salvage(data: bytes) -> Iterator[dict]:
    """Valid records and the gaps between them, in order, with the bytes [begin, end) each takes up.

    A gap starts where a check failed and ends where the next valid record starts; its reason is the failed check.
    Records and gaps of a member of several records all have the place of the member. An empty archive gives nothing.
    """
    return _recovered(data, lambda at: _rows_at(data, at), STARTS)


def _filesystem(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder) if ":" in folder.split("/")[0] else f"file://{folder}")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, html, digest, refers_to, revisit) as archives into ``folder``; the manifest (archive, records, bytes).

    An archive grows with one record at a time, so a task holds at most ``archive_bytes`` and a record.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _filesystem(folder)
        files.create_dir(base, recursive=True)
        held, size, records, made = [], 0, 0, []

        def close() -> None:
            nonlocal held, size, records
            if held:
                name = f"{uuid.uuid4().hex}.warc.gz"
                with files.open_output_stream(f"{base}/{name}", compression=None) as f:
                    f.write(b"".join(held))
                made.append((name, records, size))
            held, size, records = [], 0, 0

        for part in parts:
            for page, known, url, html, digest, target, has_target, revisit in part.itertuples(index=False):
                data = member(record_bytes(page if known else None, url, html.encode("utf-8", "replace"), digest, target if has_target else None, revisit))
                held.append(data)
                size, records = size + len(data), records + 1
                if size >= archive_bytes:
                    close()
        close()
        yield pd.DataFrame(made, columns=["archive", "records", "bytes"]).astype({"archive": object, "records": "int64", "bytes": "int64"})

    # Null ids travel beside a flag, as pandas columns of longs hold no null.
    rows = pages.select(
        F.coalesce("page_id", F.lit(0)).alias("page"), F.col("page_id").isNotNull().alias("known"), "url", text_of("html").alias("html"), "digest",
        F.coalesce("refers_to", F.lit(0)).alias("target"), F.col("refers_to").isNotNull().alias("has_target"), "revisit",
    )
    return written(rows.mapInPandas(run, "archive string, records long, bytes long"), "manifest")


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """All records and gaps of the archives in ``folder``, or of those that the manifest names (see RECORD)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    if manifest is not None:
        files = files.join(manifest.select("archive"), "archive", "left_semi")
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for archive, content in part.itertuples(index=False):
                found = pd.DataFrame(list(salvage(bytes(content))), columns=[n for n in names if n != "archive"]).assign(archive=archive)
                yield found[names].astype({c: "Int64" for c in ("begin", "end", "page_id", "refers_to", "payload_bytes")})

    return files.select("archive", "content").mapInPandas(run, RECORD)


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """(page_id, url, html, digest, refers_to, revisit) of every page.

    Of equal payloads of at least ``least`` bytes the one with the largest id is the response and the others refer to
    it. Repeated rows of that id, and payloads of which no page has an id, are all responses. A null html is empty.
    Only digests and ids are grouped; pages meet the digests that occur more than once.
    """
    payload = text_of(pages[html])
    rows = pages.select(pages[key].cast("long").alias("page_id"), pages[url].alias("url"), pages[html].alias("html"), F.sha1(payload.cast("binary")).alias("digest"), (F.octet_length(payload) >= least).alias("_long"))
    often = rows.where("_long").groupBy("digest").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1 AND _last IS NOT NULL")
    often = written(often.select(F.col("digest").alias("_d"), "_last"), "repeated")
    joined = rows.join(often, rows["digest"] == often["_d"], "left")
    revisit = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("_last")).alias("refers_to"), revisit.alias("revisit"))


def archive_and_read(pages: DataFrame, **options) -> DataFrame:
    """Write all pages as archives and read them back: records and gaps, see :func:`read_archives`."""
    folder = shared_folder(pages, "archives")
    manifest = write_archives(with_revisits(pages), folder, **options)
    if manifest.isEmpty():
        return pages.sparkSession.createDataFrame([], RECORD)
    return read_archives(pages.sparkSession, folder, manifest)
