"""Substring dedup by difference-cover anchors.

A word is removed if a window of `window` words over it also starts in a document with a smaller id. Windows aren't
compared as they are: anchors are. With the period v and a cover D of differences modulo v, of any two positions one
shift below v brings both to residues in D, so two documents that share a window share an anchor of window - v + 1
words at positions whose residues are in D. Only these anchors are hashed for the first exchange (|D| / v of the
positions). An anchor found in two documents extends: the windows around it are hashed, and a second exchange finds the
smallest document for each. (Period 7, cover {0, 1, 3} for windows of 13 words: anchors of 7 words at 3 of 7 positions.)

Documents travel in chunks of about `chunk_bytes` bytes of text, packed and compressed once into a stored table; the
exchanges move sorted arrays of distinct 64-bit hashes, a chunk's share of each hash range in one row. So a passage of a
third of all documents is one number in each chunk, a range holds its part of all distinct hashes, and no task ever has
the rows of one window together. Hashes are sums of mixed 64-bit word hashes times powers of an odd number; a false
match needs a collision of the windows' hashes among windows whose anchors are shared.

Null texts have no words and keep the hash of the empty text. Null ids count after every other. Rows with one id are one
document's rows to the comparison (a smaller id removes, an equal one doesn't). Other columns are ignored; texts with
fewer words than a window stay whole; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansheet.llm._common import materialize, shuffle_parts, table

COVERS = {2: (0, 1), 3: (0, 1), 4: (0, 1, 2), 5: (0, 1, 2), 6: (0, 1, 3), 7: (0, 1, 3), 13: (0, 1, 3, 9)}
_ODD = 0x9E3779B97F4A7C15
NO_ID = np.iinfo(np.int64).max


def covers(period: int, cover: tuple[int, ...]) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


class WordHashes(dict):
    """64-bit hashes of words, memoized; cleared by the caller at a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def run_hashes(words: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A hash of each run of n consecutive word hashes."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out += words[k : len(words) - n + 1 + k] * np.uint64(pow(_ODD + 2 * salt, n - k, 1 << 64))
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def pack_texts(ids: list[int | None], texts: list[bytes | None]) -> bytes:
    import zstandard

    n = np.array([len(ids)], "<i8")
    head = np.array([NO_ID if i is None else i for i in ids], "<i8"), np.array([i is None for i in ids], "u1"), np.array([len(t or b"") for t in texts], "<i8")
    return zstandard.ZstdCompressor(level=3).compress(n.tobytes() + b"".join(a.tobytes() for a in head) + b"".join(t or b"" for t in texts))


def unpack_texts(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    ids, none, sizes = np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "u1", n, 8 + 8 * n), np.frombuffer(data, "<i8", n, 8 + 9 * n)
    ends = np.cumsum(sizes) + 8 + 17 * n
    return ids, none, [data[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist())]


def chunks(df: DataFrame, chunk_bytes: int, chunk_rows: int = 1 << 15) -> DataFrame:
    """(chunk, blob): documents of about chunk_bytes bytes together; a longer one is a chunk of its own."""
    src = df.select(F.spark_partition_id().cast("long").alias("part"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, k, part = [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | k], pa.int64()), pa.array([pack_texts(ids, texts)], pa.binary())], ["chunk", "blob"])

        for batch in batches:
            column, part = batch.column("text").cast(pa.binary()), batch.column("part")[0].as_py() if len(batch) else part
            for i, t in zip(batch.column("id").to_pylist(), column):
                ids.append(i)
                texts.append(t.as_py())
                size += len(texts[-1] or b"")
                if size >= chunk_bytes or len(ids) >= chunk_rows:
                    yield row()
                    ids, texts, size, k = [], [], 0, k + 1
        if ids:
            yield row()

    return src.mapInArrow(run, "chunk bigint, blob binary")


class Chunk:
    """A chunk's documents as one array of word hashes."""

    def __init__(self, blob: bytes, memo: WordHashes, memo_entries: int = 500_000):
        if len(memo) > memo_entries:
            memo.clear()
        self.ids, self.none, texts = unpack_texts(blob)
        self.words = [t.split() for t in texts]
        self.counts = np.array([len(w) for w in self.words], np.int64)
        known = memo.__getitem__
        self.hashes = np.fromiter((h for w in self.words for h in map(known, w)), np.uint64, int(self.counts.sum()))
        self.starts = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(self.words)), self.counts)
        self.place = np.arange(len(self.hashes)) - self.starts[self.doc]

    def runs(self, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions where n words of one document start, and their hashes."""
        h = run_hashes(self.hashes, n, salt)
        ok = self.place[: len(h)] + n <= self.counts[self.doc[: len(h)]]
        return np.nonzero(ok)[0], h[ok]

    def anchors(self, window: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        at, h = self.runs(window - period + 1, 1)
        ok = np.isin(np.arange(period), cover)[self.place[at] % period]
        return at[ok], h[ok]

    def windows_at(self, anchors: np.ndarray, window: int, period: int) -> tuple[np.ndarray, np.ndarray]:
        """The windows that hold an anchor in one of their first `period` places."""
        at, h = self.runs(window, 2)
        mark = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(mark, anchors, 1)
        total = np.concatenate([[0], np.cumsum(mark)])
        ok = total[np.minimum(at + period, len(mark))] > total[at]
        return at[ok], h[ok]


def least(values: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, the smallest id of each, and whether it has another id too."""
    order = np.lexsort((ids, values))
    v, i = values[order], ids[order]
    first = np.nonzero(np.concatenate([[True], v[1:] != v[:-1]]))[0] if len(v) else np.empty(0, np.int64)
    last = np.concatenate([first[1:], [len(v)]]) - 1 if len(v) else first
    return v[first], i[first], i[first] != i[last]


def _rows(keys: list[int], chunk: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(chunk, pa.int64()), pa.array(blobs, pa.binary())], ["key", "chunk", "blob"])


_KEYED = "key bigint, chunk bigint, blob binary"


def short(h: np.ndarray) -> np.ndarray:
    """The top 47 bits of a hash, above a bit for a flag: what an anchor needs, since a false match of anchors costs work alone."""
    return h >> np.uint64(16) & ~np.uint64(1)


def pack_short(v: np.ndarray) -> bytes:
    return v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_short(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def pack_pairs(values: np.ndarray, ids: np.ndarray) -> bytes:
    """Hashes as they are, for they don't compress, and ids compressed."""
    import zstandard

    return np.array([len(values)], "<i8").tobytes() + values.astype("<u8").tobytes() + zstandard.ZstdCompressor(level=1).compress(ids.astype("<i8").tobytes())


def unpack_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    n = int(np.frombuffer(blob, "<i8", 1)[0])
    return np.frombuffer(blob, "<u8", n, 8), np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8 + 8 * n :]), "<i8")


def _by_range(chunk: int, ranges: int, values: np.ndarray, pack: Callable[..., bytes], *more: np.ndarray) -> pa.RecordBatch:
    """A row for each hash range with sorted values and the columns beside them, packed."""
    keys = (values >> np.uint64(40)).astype(np.int64) * ranges >> 24
    cut = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0].tolist() if len(keys) else []
    ends = [*cut[1:], len(keys)]
    return _rows(keys[cut].tolist(), [chunk] * len(cut), [pack(*(c[a:b] for c in (values, *more))) for a, b in zip(cut, ends)])


def _grouped(df: DataFrame, key: str, run: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def whole(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(run(t)) or [_rows([], [], [])])

    return df.groupBy(key).applyInArrow(whole, schema)


def _anchor_rows(stored: DataFrame, ranges: int, window: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for k, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob")):
                c = Chunk(blob.as_py(), memo)
                at, h = c.anchors(window, period, cover)
                values, _, both = least(short(h), c.ids[c.doc[at]])
                yield _by_range(k, ranges, values << np.uint64(16), lambda v, b: pack_short(short(v) | b), both.astype(np.uint64))

    return stored.mapInArrow(run, _KEYED)


def _shared_anchors(rows: DataFrame) -> DataFrame:
    """To each chunk those of its anchors that two documents have."""

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ks = t.column("chunk").to_pylist()
        blobs = [b.as_py() for b in t.column("blob")]
        parts = [unpack_short(b) for b in blobs]
        every = np.concatenate(parts)
        both, every = every & np.uint64(1), every & ~np.uint64(1)
        order = np.argsort(every, kind="stable")
        v = every[order]
        first = np.concatenate([[True], v[1:] != v[:-1]])
        group = np.cumsum(first) - 1
        many = (np.bincount(group) > 1) | (np.bincount(group, both[order]) > 0)
        keep = np.empty(len(v), bool)
        keep[order] = many[group]
        ends = np.cumsum([len(p) for p in parts]).tolist()
        out = [(k, pack_short(every[e - len(p) : e][keep[e - len(p) : e]])) for k, p, e in zip(ks, parts, ends)]
        out = [x for x in out if x[1]]
        yield _rows([0] * len(out), [k for k, _ in out], [b for _, b in out])

    return _grouped(rows, "key", run, _KEYED)


def _with_chunk(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored chunks (key -1) and the rows for them, to be grouped by chunk."""
    return stored.select(F.lit(-1).cast("bigint").alias("key"), "chunk", "blob").unionByName(rows)


def _window_rows(both: DataFrame, ranges: int, window: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, blobs = t.column("key").to_pylist(), [b.as_py() for b in t.column("blob")]
        shared = [unpack_short(b) for k, b in zip(keys, blobs) if k != -1]
        if not shared:
            return
        c = Chunk(blobs[keys.index(-1)], WordHashes())
        at, h = c.anchors(window, period, cover)
        at, h = c.windows_at(at[np.isin(short(h), np.concatenate(shared))], window, period)
        values, ids, _ = least(h, c.ids[c.doc[at]])
        yield _by_range(t.column("chunk")[0].as_py(), ranges, values, pack_pairs, ids)

    return _grouped(both, "chunk", run, _KEYED)


def _first_windows(rows: DataFrame) -> DataFrame:
    """To each chunk its windows that two documents have, with the smallest id of each. (One that a single chunk has is told by the chunk itself.)"""

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ks, blobs = t.column("chunk").to_pylist(), [b.as_py() for b in t.column("blob")]
        parts, ids = zip(*map(unpack_pairs, blobs))
        every, ids = np.concatenate(parts), np.concatenate(ids)
        order = np.lexsort((ids, every))
        v, i = every[order], ids[order]
        first = np.concatenate([[True], v[1:] != v[:-1]])
        low = np.empty(len(v), np.int64)
        low[order] = i[first][np.cumsum(first) - 1]
        ends = np.cumsum([len(p) for p in parts]).tolist()
        out = []
        for k, p, e in zip(ks, parts, ends):
            own = low[e - len(p) : e]
            less = own < ids[e - len(p) : e]
            if less.any():
                out.append((k, pack_pairs(p[less], own[less])))
        yield _rows([0] * len(out), [k for k, _ in out], [b for _, b in out])

    return _grouped(rows, "key", run, _KEYED)


def _kept(both: DataFrame, window: int, period: int, cover: tuple[int, ...], texts: bool) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.string())] * texts)

    def run(t: pa.Table) -> pa.Table:
        keys, blobs = t.column("key").to_pylist(), [b.as_py() for b in t.column("blob")]
        c = Chunk(blobs[keys.index(-1)], WordHashes())
        told = [unpack_pairs(b) for k, b in zip(keys, blobs) if k != -1]
        values = np.concatenate([v for v, _ in told] or [np.empty(0, np.uint64)])
        lows = np.concatenate([i for _, i in told] or [np.empty(0, np.int64)])
        at, h = c.runs(window, 2)
        ids = c.ids[c.doc[at]]
        own, own_low, _ = least(h, ids)  # a window's first document may be in this chunk
        low = own_low[np.searchsorted(own, h)] if len(h) else ids
        if len(values):
            order = np.argsort(values)
            values, lows = values[order], lows[order]
            k = np.minimum(np.searchsorted(values, h), len(values) - 1)
            low = np.where(values[k] == h, np.minimum(low, lows[k]), low)
        bad = at[low < ids]
        edge = np.zeros(len(c.hashes) + 1, np.int64)
        np.add.at(edge, bad, 1)
        np.add.at(edge, bad + window, -1)
        gone = np.cumsum(edge)[:-1] > 0
        removed = np.bincount(c.doc, gone, len(c.words)).astype(np.int64)
        kept = []
        for words, s, n, r in zip(c.words, c.starts.tolist(), c.counts.tolist(), removed.tolist()):
            kept.append(b" ".join(words if not r else [w for w, g in zip(words, gone[s : s + n].tolist()) if not g]))
        cols = [pa.array(c.ids, pa.int64(), mask=c.none.astype(bool)), pa.array(c.counts), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
        return pa.Table.from_arrays(cols + [pa.array(kept, pa.binary()).cast(pa.string(), safe=False)] * texts, schema=schema)

    return both.groupBy("chunk").applyInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * texts)


def remove_repeats(df: DataFrame, window: int = 13, period: int = 7, chunk_bytes: int = 2 << 20, texts: bool = False) -> DataFrame:
    """For each row of df (doc_id, text): its words, how many are removed, the kept words' hash and, if asked, the kept words."""
    cover = COVERS[period]
    if not covers(period, cover) or window < period:
        raise ValueError("the cover must have every difference and a window hold an anchor")
    ranges = 4 * shuffle_parts(df.sparkSession)
    stored = materialize(chunks(df, chunk_bytes), "chunks")
    shared = _shared_anchors(_anchor_rows(stored, ranges, window, period, cover))
    firsts = _first_windows(_window_rows(_with_chunk(stored, shared), ranges, window, period, cover))
    return _kept(_with_chunk(stored, firsts), window, period, cover, texts)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, hash(w[i + 1 : i + 13]) as h, w[i + 1 : i + 13] as ws from (select doc_id, w, unnest(range(len(w) - 12)) as i from d where len(w) >= 13)),
low as (select h, ws, min(doc_id) as first from win group by h, ws having min(doc_id) < max(doc_id)),
bad as (select win.doc_id, win.i from win join low on win.h = low.h and win.ws = low.ws where low.first < win.doc_id),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as k from bad),
g as (select doc_id, count(*) as n, list(k) as ks from gone group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed,
  sha256(coalesce(list_aggregate(case when n is null then w else list_filter(w, lambda x, i: not list_contains(ks, i - 1)) end, 'string_agg', ' '), '')) as kept_sha256
from d left join g on d.doc_id = g.doc_id
"""
