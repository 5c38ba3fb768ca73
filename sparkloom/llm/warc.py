"""WARC archives and their index: writing, reading back, and merging capture runs.

Every page becomes a record, a gzip member of its own, in an archive file that
Spark's writer puts into the shared folder; no archive grows beyond about
``ROWS * CHUNK`` bytes and a few single records, so that each can be read whole.
Reading an archive gives its capture run: entries sorted by URL key, time and
page. Runs are cut at splitters, and the pieces of a range are merged by a loser
tree, so ranges in order, and entries within, are the global capture history of
every URL. Splitters come from a sample in two levels: those of the parts on the
driver, of a fixed number, and those of the ranges in a table, as many as the
pages need. They hold time and page too, so one URL may span ranges.

Of records with equal payloads of at least ``least`` bytes the one with the
largest page id is a response and the others revisit it; smaller ones are all
responses. Only digests and ids are compared and joined, never payloads. A null
html is an empty payload, a null url an empty key. Payloads may be of any
length. Of rows that repeat the largest id each is a response. A null id
revisits where the others have ids. Equal keys and times are ordered by page.
An empty table gives no rows. Other columns are dropped, whatever their names.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, groups_of, sample_test, scratch, tidy
from .loser_tree import merge

#: Entries of a range, about, and keys drawn for each.
RANGE_ROWS = 50_000
DRAWN = 16
#: Parts, at most, and keys that their splitters are chosen from, at most (about).
PARTS = 512
SPLITTER_ROWS = 20_000
#: Bytes of members that are handed to the writer as one row, and such rows of an archive.
CHUNK = 4 << 20
ROWS = 16
#: Payloads below this many bytes are never revisits.
LEAST_BYTES = 1000
#: The first second of capture; pages carry no time, so a page's time is this plus its id in seconds.
EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_EMPTY_MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()


def url_key(url: str | None) -> str:
    """Sort key: host labels from the right, then path and query. Scheme and fragment don't count."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + (rest[cut:] or "/")


def captured(page_id: int | None) -> str:
    return (EPOCH + datetime.timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, not compressed. A revisit holds the HTTP headers without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {captured(page_id)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member without its last byte, which is 0: the size's highest. Where it isn't, an empty member follows."""
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    out = c.compress(raw) + c.flush()
    return out[:-1] if out[-1] == 0 else out + _EMPTY_MEMBER[:-1]


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES) -> None:
    """Write a record for every row to archives in ``path``.

    The text writer ends each value with its separator; that is the byte which
    ``member`` leaves out, so the files are plain series of gzip members.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(bytearray())).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    big = rows.where(F.octet_length("payload") >= least).select("page_id", "digest")
    copies = cut(big.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1 AND keep IS NOT NULL").drop("n"))
    # a table: Spark knows its size, so a small one goes to the pages and no page is moved
    at = scratch(pages.sparkSession, "revisits")
    again = big.join(copies, "digest").where(~F.col("page_id").eqNullSafe(F.col("keep")))
    again.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("keep").alias("refers_to")).distinct().write.parquet(at)
    again = pages.sparkSession.read.schema("_id bigint, _digest string, refers_to bigint").parquet(at)
    known = rows.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            cols = (b.column(k).to_pylist() for k in range(5))
            for r in zip(*cols, strict=True):
                m = member(record(*r))
                if held and size + len(m) > CHUNK:
                    yield _chunk(held)
                    held, size = [], 0
                held.append(m)
                size += len(m)
        if held:
            yield _chunk(held)

    records = known.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(tidy(run), "value binary")
    records.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", ROWS).text(path)


def _chunk(held: list[bytes]) -> pa.RecordBatch:
    """One row of members; the last one's last byte is the writer's."""
    return pa.RecordBatch.from_arrays([pa.array([b"\0".join(held)], pa.binary())], names=["value"])


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, compressed length and content of every gzip member."""
    view, at = memoryview(data), 0
    while at < len(view):
        begin, d, out = at, zlib.decompressobj(31), []
        while not d.eof and at < len(view):
            piece = view[at : at + 65536]
            out.append(d.decompress(piece))
            at += len(piece)
        at -= len(d.unused_data)
        if not d.eof:
            raise ValueError("an archive ends within a member")
        if content := b"".join(out):
            yield begin, at - begin, content


def parse(raw: bytes) -> dict:
    """A record's fields; the payload of a response is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x[16:] for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")))
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what its digest says")
    page = fields["WARC-Record-ID"][10:-1]
    refers = fields.get("WARC-Refers-To")
    return {
        "url": fields.get("WARC-Target-URI"), "time": fields["WARC-Date"], "page_id": int(page) if page else None, "payload_bytes": size,
        "payload_digest": digest, "record_type": kind, "refers_to": int(refers[10:-1]) if refers else None, "payload": payload,
    }


_ENTRY = "key string, time string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, offset bigint, length bigint"
_ENTRY_PA = pa.struct(
    [("key", pa.string()), ("time", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    + [("record_type", pa.string()), ("refers_to", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]
)


def _order(e: dict) -> tuple:
    return (e["key"], e["time"], e["page_id"] if e["page_id"] is not None else -1)


_KEY = "struct<key: string, time: string, page_id: bigint>"


def splitters(pages: DataFrame, id_col: str, url_col: str) -> tuple[list[tuple], DataFrame]:
    """Bounds of the parts, and a table of the bounds of the ranges within: part and cuts."""
    spark = pages.sparkSession
    pages = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"))
    n = pages.count()
    # equal rows are drawn together, so they count once
    drawn = pages.where(sample_test(SPLITTER_ROWS, n, "page_id", "url")).distinct().collect()
    keys = sorted((url_key(r.url), captured(r.page_id), -1 if r.page_id is None else r.page_id) for r in drawn)
    parts = min(PARTS, -(-n // RANGE_ROWS))
    first = [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(url_key(u), captured(i), -1 if i is None else i) for i, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            cols = [[bisect_right(first, x) for x in found], *([x[k] for x in found] for k in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["part", "key", "time", "page_id"])

    ranges = -(-n // RANGE_ROWS)
    placed = pages.where(sample_test(DRAWN * ranges, n, "url", "page_id")).distinct().mapInArrow(place, "part int, key string, time string, page_id bigint")
    sorted_ = placed.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("key", "time", "page_id"))).alias("keys"))
    cuts = F.filter("keys", lambda x, i: (i > 0) & (i % DRAWN == 0))
    at = scratch(spark, "splitters")
    sorted_.select("part", cuts.alias("cuts")).write.parquet(at)
    return first, spark.read.schema(f"part int, cuts array<{_KEY}>").parquet(at)


def read_index(spark: SparkSession, path: str, bounds: tuple[list[tuple], DataFrame]) -> DataFrame:
    """The merged index of the archives in ``path``: range, place and the entries' fields, with the archive's name."""
    first, inner = bounds

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = []
                for offset, length, raw in members(data):
                    e = parse(raw)
                    del e["payload"]
                    found.append(e | {"key": url_key(e.pop("url")), "offset": offset, "length": length})
                found.sort(key=_order)
                by: dict[int, list] = {}
                for e in found:
                    by.setdefault(bisect_right(first, _order(e)), []).append(e)
                for part, entries in by.items():
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([entries], pa.list_(_ENTRY_PA))], names=["part", "archive", "run"])

    run_type = f"array<struct<{_ENTRY.replace(' ', ':').replace(',:', ', ')}>>"
    runs = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(tidy(run), f"part int, archive string, run {run_type}")

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, name, entries, cuts in zip(*(b.column(k).to_pylist() for k in ("part", "archive", "run", "cuts")), strict=True):
                bounds = [(x["key"], x["time"], x["page_id"]) for x in cuts or []]
                by: dict[int, list] = {}
                for e in entries:
                    by.setdefault(bisect_right(bounds, _order(e)), []).append(e)
                numbers = [(part << 32) + k for k in by]
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([name] * len(by)), pa.array(by.values(), pa.list_(_ENTRY_PA))], names=["range", "archive", "run"])

    pieces = runs.join(inner, "part", "left").select("part", "archive", "run", "cuts").mapInArrow(tidy(split), f"range bigint, archive string, run {run_type}")

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, t in groups_of(batches, "range"):
            names = t.column("archive").to_pylist()
            out = []
            for place, (run, e) in enumerate(merge(t.column("run").to_pylist(), _order)):
                out.append(e | {"range": number, "place": place, "archive": names[run]})
                if len(out) == 10_000:
                    yield pa.RecordBatch.from_pylist(out, schema=_MERGED)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_MERGED)

    return pieces.repartition("range").sortWithinPartitions("range", "archive").mapInArrow(tidy(join), f"range bigint, place bigint, archive string, {_ENTRY}")


_MERGED = pa.schema([("range", pa.int64()), ("place", pa.int64()), ("archive", pa.string()), *_ENTRY_PA])


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read their merged index."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path, id_col, url_col, html_col, least)
    return read_index(pages.sparkSession, path, splitters(pages, id_col, url_col))
