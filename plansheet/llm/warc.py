"""WARC archives written and read back, and capture histories by an external merge of sorted index runs.

Writing: a page is a response, or a revisit if its payload (of at least `min_bytes`) is that of a page with a smaller
id. Only digests are grouped: those of repeated payloads and their smallest ids are stored, and the pages meet them in a
join that Spark broadcasts or not by the stored size, and splits where a digest is hot. Each task packs records into archives
of about `archive_bytes` bytes, gzipped by Spark's text writer, so they go wherever Spark can write; a record always
ends with the two line ends that the writer puts between rows. Offsets are those in the inflated archive.

Reading: archives are read whole (their size is bounded) and parsed record by record.

Histories: captures are sorted in the task that reads them (Spark's sorter, which spills) and stored, so that each task's
output is a sorted run. A bounded sample of the runs' keys cuts (key, time, page, file, offset) into ranges of about
`range_rows` captures, and each run is cut at these and into blocks of at most `block_rows` captures. A range's task gets
its blocks in the order of their first keys and merges them by a tree of losers: a block is opened when its first key is
the least of all that is left, and its place is free when it is used up, so that a run has one block open at most and a
task holds a block for each run, never a range. The ranges in order are the global order. A key with a third of all captures
spans many ranges, since time, page and place are part of it.

Null html is an empty payload. A null page_id counts after every other; rows that repeat the smallest page_id of a
payload are all responses. Null URLs have the key "". Other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansheet.llm._common import materialize, scratch_path, shuffle_parts, table

EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A UUID that holds the page's id."""
    x = f"{(page_id or 0) % (1 << 64):032x}"
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{'8' if page_id is None else '0'}{x[13:16]}-{x[16:20]}-{x[20:]}>"


def page_of(rid: str) -> int | None:
    x = rid[10:-1].replace("-", "")
    return None if x[12] == "8" else (n := int(x[16:], 16)) - (1 << 64) * (n >> 63)


def capture_time(page_id: int | None) -> str:
    """The tables have no capture time; a page's number stands for it, a second each from 2020 on."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % 3_000_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers: int | None, revisit: bool) -> bytes:
    """One record without the line ends after it. A revisit keeps the HTTP head, whose length is the payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {capture_time(page_id)}", f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers)}", f"WARC-Refers-To-Date: {capture_time(refers)}", f"WARC-Profile: {REVISIT}"]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body


def digests(pages: DataFrame) -> DataFrame:
    """page_id, url and payload with the payload's SHA-1."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    return src.withColumn("sha1", F.unhex(F.sha1("payload")))


def repeated(pages: DataFrame) -> DataFrame:
    """(sha1, first): the payloads that more than one page has, with the smallest id of each."""
    some = digests(pages).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return materialize(some.where("n > 1 and first is not null").select("sha1", "first"), "warc-repeated")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = 8 << 20) -> None:
    """Archives of pages (page_id, url, html) below path."""
    df = digests(pages).join(repeated(pages), "sha1", "left")
    again = (F.octet_length("payload") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    df = df.select("page_id", "url", "payload", "sha1", F.when(again, F.col("first")).alias("refers"), F.coalesce(again, F.lit(False)).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(held)], pa.binary()).cast(pa.string(), safe=False)], ["value"])

        for batch in batches:
            urls = batch.column("url").cast(pa.binary())
            for k in range(len(batch)):
                p, u, data, sha, r, v = (c[k].as_py() for c in (batch.column("page_id"), urls, batch.column("payload"), batch.column("sha1"), batch.column("refers"), batch.column("revisit")))
                held.append(record(p, u.decode("utf-8", "replace"), data, base64.b32encode(sha).decode(), r, v))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    df.mapInArrow(run, "value string").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 1).text(path, compression="gzip")


def surt(url: str) -> str:
    """The URL's key: the host's labels from the last on, then path and query, in lower case."""
    try:
        u = urlsplit(url)
        host = (u.hostname or "").removeprefix("www.")
        return f"{','.join(reversed(host.split('.')))}){u.path or '/'}{'?' + u.query if u.query else ''}".lower() if host else url.lower()
    except ValueError:
        return url.lower()


def parse(data: bytes) -> Iterator[dict]:
    """The records of one archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        body = end + 4
        size = int(head["Content-Length"])
        block = data[body : body + size]
        if len(block) != size or data[body + size : body + size + 4] != b"\r\n\r\n":
            raise ValueError(f"broken record at {at}")
        http, _, payload = block.partition(b"\r\n\r\n")
        yield {"head": head, "http": http, "payload": payload, "offset": at, "length": body + size + 4 - at}
        at = body + size + 4


_CAPTURE = "urlkey string, time string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string, offset bigint, length bigint"
ORDER = ("urlkey", "time", "page_id", "file", "offset")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Capture rows of all archives below path; each task's are a run, sorted by ORDER."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [x.split()[0] for x in _CAPTURE.split(", ")]
    types = [pa.int64() if x.split()[1] == "bigint" else pa.string() for x in _CAPTURE.split(", ")]

    def one(name: str, data: bytes) -> Iterator[tuple]:
        for r in parse(data):
            h, kind = r["head"], r["head"]["WARC-Type"]
            n = int(re.search(rb"Content-Length: (\d+)", r["http"])[1])
            digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind == "response" and (len(r["payload"]) != n or sha1_base32(r["payload"]) != digest):
                raise ValueError(f"the payload at {r['offset']} of {name} isn't what was written")
            yield surt(h["WARC-Target-URI"]), h["WARC-Date"], page_of(h["WARC-Record-ID"]), n, digest, kind, page_of(h["WARC-Refers-To"]) if kind == "revisit" else None, name, r["offset"], r["length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                rows = list(one(batch.column("path")[k].as_py().rsplit("/", 1)[-1], zlib.decompress(batch.column("content")[k].as_py(), 31)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)

    return files.mapInArrow(run, _CAPTURE).sortWithinPartitions(*ORDER)


class LoserTree:
    """Merges sorted blocks that come in the order of their first keys.

    Each leaf is an open block, a node keeps the loser of its match, and the next row costs log2 k comparisons. The first
    leaf is the stream of blocks itself, with the first key of the block to come: when it wins, that block is opened.
    """

    def __init__(self, blocks: Iterator[Iterator[tuple]]):
        self.blocks = blocks
        self.runs: list[Iterator[tuple]] = [iter(())]
        self.heads: list[tuple | None] = [None]
        self._peek()
        self._seed()

    def _peek(self) -> None:
        """The next block that isn't empty becomes the one to come."""
        self.coming, self.heads[0] = iter(()), None
        for block in self.blocks:
            self.coming = iter(block)
            if (head := next(self.coming, None)) is not None:
                self.heads[0] = head
                return

    def _seed(self) -> None:
        """A tree over the leaves that aren't used up."""
        alive = [k for k in range(len(self.heads)) if k == 0 or self.heads[k] is not None]
        self.runs, self.heads = [self.runs[k] for k in alive], [self.heads[k] for k in alive]
        self.k = len(self.heads)
        self.losers = [0] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is None or y is None else (x[0], a) < (y[0], b)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if not self._beats(a, b):
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[tuple]:
        while (row := self.heads[self.winner]) is not None:
            if self.winner == 0:  # open the block that begins with this row
                self.runs.append(self.coming)
                self.heads.append(row)
                self._peek()
                self._seed()
                continue
            yield row
            w = self.winner
            self.heads[w] = next(self.runs[w], None)
            node = (w + self.k) // 2
            while node:
                if self._beats(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def _key(row: tuple) -> tuple:
    return row[0] or "", row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def _types(schema) -> list[pa.DataType]:
    return [pa.int64() if f.dataType.simpleString() == "bigint" else pa.string() for f in schema]


def range_bounds(captures: DataFrame, ranges: int, each: int = 8) -> list[tuple]:
    """The first keys of all ranges but the first, from a sample of about `each` captures a range, chosen by place."""
    n = captures.count()
    step = max(1, n // (ranges * each))
    some = captures.where(F.pmod(F.xxhash64("file", "offset"), F.lit(step)) == 0).select(*ORDER)
    keys = sorted(_key((r[0], r[1], r[2], None, None, None, None, r[3], r[4])) for r in some.collect())  # 2 * ranges * each rows, about
    return [keys[len(keys) * k // ranges] for k in range(1, ranges)] if keys else []


_BLOCK = "range int, urlkey string, time string, page_id bigint, file string, offset bigint, rows binary"


def run_blocks(captures: DataFrame, bounds: list[tuple], block_rows: int) -> DataFrame:
    """The stored runs in blocks that no range's edge crosses: range, first key and the rows."""
    names, types = captures.columns, _types(captures.schema)
    edges = captures.sparkSession.sparkContext.broadcast(bounds)  # MOST_RANGES keys at most

    def block(at: int, rows: list[tuple]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        data = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        with pa.ipc.new_stream(sink, data.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(data)
        f = rows[0]
        values = (at, f[0], f[1], f[2], f[7], f[8], sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()))], ["range", *ORDER, "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key = _key(row)
                if held and (len(held) >= block_rows or key < last or at < len(edges.value) and key >= edges.value[at]):
                    yield block(at, held)  # full, or another run or range begins
                    held = []
                if not held:
                    at = bisect.bisect_right(edges.value, key)
                held.append(row)
                last = key
        if held:
            yield block(at, held)

    return captures.mapInArrow(run, _BLOCK)


MOST_RANGES = 1 << 16


def merge_runs(captures: DataFrame, range_rows: int = 100_000, block_rows: int = 512) -> DataFrame:
    """Capture histories: stored sorted runs merged range by range; partitions in order are in global order."""
    names, types = captures.columns, _types(captures.schema)
    parts = shuffle_parts(captures.sparkSession)
    ranges = min(MOST_RANGES, max(parts, -(-captures.count() // range_rows)))
    blocks = run_blocks(captures, range_bounds(captures, ranges), block_rows)
    dealt = blocks.repartitionByRange(ranges, "range").sortWithinPartitions("range", *ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opened(data: bytes) -> Iterator[tuple]:
            with pa.ipc.open_stream(data) as source:
                for part in source:
                    for row in zip(*(c.to_pylist() for c in part.columns)):
                        yield _key(row), row

        def coming() -> Iterator[Iterator[tuple]]:
            for batch in batches:
                for data in batch.column("rows"):
                    yield opened(data.as_py())

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        held = []
        for _, row in LoserTree(coming()):
            held.append(row)
            if len(held) == 4096:
                yield out(held)
                held = []
        if held:
            yield out(held)

    return dealt.mapInArrow(run, _CAPTURE)


def capture_histories(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Pages written as archives below path, read back, and their index merged."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path)
    return merge_runs(materialize(read_archives(spark, path), "warc-runs"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = capture_histories(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as h from pages),
f as (select h, min(page_id) as first from p group by h)
select page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast((cast('0x' || substr(p.h, cast(i // 4 * 5 + 1 as bigint), 5) as bigint) >> cast(15 - 5 * (i % 4) as bigint)) & 31 as bigint) + 1, 1)), 'string_agg', '') as payload_digest,
  case when page_id is not distinct from first or first is null then 'response' else 'revisit' end as record_type,
  case when page_id is not distinct from first or first is null then null else first end as refers_to
from p join f on p.h = f.h
"""
