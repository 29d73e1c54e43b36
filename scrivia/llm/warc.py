"""WARC archives: a writer, and a reader that salvages what it can.

Writer: one record per page, uncompressed, through Spark's text sink (any store
Spark writes to); each file is a whole archive of a bounded number of records and bytes.
Reader: every record is checked (version line, header, length, end marks, payload
digest).  After a failed check it looks for the next version line or gzip member and
goes on from there, also inside a member: what a member yields before it breaks off or
fails is searched like an archive of its own.  The bytes between are quarantined as gaps,
which ``quarantine`` writes to a table and logs.  Plain and gzip-member archives are both read.

Edge cases: null and empty html give an empty payload; a null url is left out and
blanks in one are percent-encoded; rows that repeat a page_id get a record each,
and all rows that equal the group's largest id are responses; in a group whose ids
are all null every row is a response, beside others a null id revisits; extra columns
are not read; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.llm.common import arrow_batches, delete, materialise, membership_filter, new_path, possible_members, release, table

#: An archive holds at most so many records, and payloads of at most so many bytes unless it is one record.
RECORDS_PER_ARCHIVE, ARCHIVE_BYTES = 1000, 256 << 20
DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"
#: What a record or a gzip member starts with; bytes a decompressor is given at a time.
_START = re.compile(rb"WARC/\d\.\d\r\n|\x1f\x8b\x08")
_LINE = re.compile(rb"WARC/\d\.\d\r\n")
_STEP = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_of(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(m[1]) if m else None


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of ``refers_to``: its HTTP header without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += [
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + _END + block


# --- reading ----------------------------------------------------------------


class Damaged(ValueError):
    pass


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def _parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` and the place after its end marks; Damaged if a check fails."""
    head_end = data.find(_END, at)
    if head_end < 0:
        raise Damaged("header without end")
    version, *lines = data[at:head_end].split(b"\r\n")
    if not re.fullmatch(rb"WARC/\d\.\d", version):
        raise Damaged("version line")
    fields = _fields(lines)
    if not fields.get("content-length", "").isdigit():
        raise Damaged("Content-Length")
    if not {"warc-type", "warc-record-id"} <= fields.keys():
        raise Damaged("mandatory field")
    start = head_end + 4
    end = start + int(fields["content-length"])
    if data[end : end + 4] != _END:
        raise Damaged("end marks")
    block, kind = data[start:end], fields["warc-type"].lower()
    payload, length = block, len(block)
    if "application/http" in fields.get("content-type", ""):
        http, gap, payload = block.partition(_END)
        if not gap:
            raise Damaged("HTTP header without end")
        stated = _fields(http.split(b"\r\n")[1:]).get("content-length", "")
        length = int(stated) if kind == "revisit" and stated.isdigit() else len(payload)
    stated = fields.get("warc-payload-digest", "")
    if kind != "revisit" and stated.startswith("sha1:") and stated[5:] != payload_digest(payload):
        raise Damaged("payload digest")
    digest = stated[5:] if stated.startswith("sha1:") else payload_digest(payload)
    return {
        "record_type": kind,
        "page_id": _page_of(fields["warc-record-id"]),
        "refers_to": _page_of(fields.get("warc-refers-to")),
        "target_uri": fields.get("warc-target-uri"),
        "payload_bytes": length,
        "payload_digest": digest,
        "payload": None if kind == "revisit" else payload,
    }, end + 4


def _member(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """(what the member at ``at`` yields, the place after it or None if it is damaged, why)."""
    d, out, pos, view = zlib.decompressobj(31), [], at, memoryview(data)
    while not d.eof and pos < len(data):
        before = d.copy()
        try:
            out.append(d.decompress(view[pos : pos + _STEP]))
        except zlib.error as e:
            for i in range(pos, min(pos + _STEP, len(data))):  # all of the step that can still be read
                try:
                    out.append(before.decompress(view[i : i + 1]))
                except zlib.error:
                    break
            return b"".join(out), None, f"gzip: {e}"
        pos = min(pos + _STEP, len(data))
    if not d.eof:
        return b"".join(out), None, "gzip member without end"
    return b"".join(out), pos - len(d.unused_data), ""


def _next(data: bytes, at: int, start: re.Pattern = _START) -> int:
    found = start.search(data, at)
    return found.start() if found else len(data)


def _inside(inner: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """(from, to, record, or the reason of a gap) of a member's content."""
    at, n = 0, len(inner)
    while at < n:
        try:
            one, after = _parse(inner, at)
        except Damaged as e:
            after, one = _next(inner, at + 1, _LINE), str(e)
        yield at, after, one
        at = after


def salvage(data: bytes) -> Iterator[dict]:
    """Records and quarantined gaps of an archive, in order of offset.

    ``offset`` and ``length`` are the archive's bytes, of a compressed record or gap its member's;
    ``inner`` is then the place in the member's content, of ``inner_length`` bytes.  Every byte of an
    archive, and of what a member yields, is in one of them.
    """
    at, n, bad, why = 0, len(data), None, ""
    while at < n:
        packed = data.startswith(b"\x1f\x8b\x08", at)
        parts: list[dict] = []
        if packed:
            inner, after, reason = _member(data, at)
            end = _next(data, at + 1) if after is None else after
            for i, j, one in _inside(inner):
                place = {"offset": at, "length": end - at, "inner": i, "inner_length": j - i}
                if isinstance(one, str):
                    parts.append({"kind": "gap", "reason": f"in a member: {one}", **place})
                else:
                    parts.append({"kind": "record", "reason": None, **place, **one})
            if after is None and not any(p["kind"] == "record" for p in parts):
                parts = []  # nothing but damage: a plain gap
        else:
            try:
                one, after = _parse(data, at)
                parts = [{"kind": "record", "offset": at, "length": after - at, "reason": None, **one}]
            except Damaged as e:
                after, reason = None, str(e)
        if parts and bad is not None:
            yield {"kind": "gap", "offset": bad, "length": at - bad, "reason": why}
            bad = None
        yield from parts
        if after is None:
            if bad is None:
                bad, why = at, reason
            after = _next(data, at + 1)
        at = after
    if bad is not None:
        yield {"kind": "gap", "offset": bad, "length": n - bad, "reason": why}


_READ = (
    "archive string, kind string, offset long, length long, inner long, inner_length long, reason string, record_type string, page_id long, "
    "refers_to long, target_uri string, payload_bytes long, payload_digest string, payload binary"
)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives under ``path``."""
    names = [c.split()[0] for c in _READ.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in _READ.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name, rows, held = b.column(0)[i].as_py(), [], 0
                for r in salvage(b.column(1)[i].as_py()):
                    if not payloads:
                        r.pop("payload", None)
                    rows.append({c: r.get(c) for c in names} | {"archive": name})
                    held += len(r.get("payload") or b"")
                    if len(rows) >= 1000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, _READ)


def quarantine(found: DataFrame) -> DataFrame:
    """The gaps of ``read_archives``, written to a table of their own and logged."""
    gaps = materialise(found.where("kind = 'gap'").select("archive", "offset", "length", "inner", "inner_length", "reason"), "warc-gaps")
    n, size = gaps.agg(F.count("*"), F.sum(F.coalesce("inner_length", "length"))).first()
    if n:
        logging.getLogger(__name__).warning("%d byte gaps of %d bytes quarantined in %s", n, size, gaps.scratch_path)
    return gaps


def write_archives(pages: DataFrame, path: str, per_archive: int = RECORDS_PER_ARCHIVE, most_bytes: int = ARCHIVE_BYTES) -> None:
    """One record per page (page_id, url, html) under ``path``; the first of equal payloads, by
    largest page_id, is a response and the others revisit it."""
    spark = pages.sparkSession
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    # pages of one power of two of bytes go to archives of their own, of as many records as then fit
    common = max(1, most_bytes // per_archive)
    power = F.ceil(F.log2(F.greatest(F.length("payload"), F.lit(common)).cast("double"))).cast("int")
    summed = pages.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n"), F.max(power).alias("power"))
    summed = materialise(summed.select("digest", "top", "n", "power"), "warc-digests")
    powers = sorted(r[0] for r in summed.select("power").distinct().collect())  # at most 31
    groups = materialise(summed.where("n > 1 and top is not null").select("digest", "top"), "warc-groups")
    filt = membership_filter(groups, "digest", "warc-filter")
    # only payloads that may recur leave their task
    again = possible_members(pages, F.col("digest"), filt).join(groups, "digest", "left")
    alone = possible_members(pages, F.col("digest"), filt, rest=True).withColumn("top", F.lit(None).cast("long"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            page, url, payload, ref = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays([pa.array(map(write_record, page, url, payload, ref), pa.binary())], ["value"])

    rows = again.select("page_id", "url", "payload", "top").unionByName(alone.select("page_id", "url", "payload", "top"))
    for p in powers or [0]:
        mine = rows.where(power == p) if len(powers) > 1 else rows
        records = mine.select("page_id", "url", "payload", refers.alias("ref")).mapInArrow(run, "value binary")
        fits = max(1, min(per_archive, most_bytes >> p))
        # a record ends with two line ends, which are this sink's line separator
        with arrow_batches(spark, min(100, fits)):
            (
                records.select(F.col("value").cast("string").alias("value"))
                .write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", fits).text(path)
            )
    release(summed, groups, filt.rows)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = materialise(read_archives(spark, path, payloads=False), "warc-read")
    quarantine(found)
    delete(spark, path)
    return found.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
