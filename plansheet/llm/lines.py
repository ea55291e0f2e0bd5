"""Line dedup that can be undone: sharded cuckoo filters backed by exact tables of references.

An index of lines has three parts, all stored tables. References: a row for each key (a line's trimmed, lower-cased text
as 128 bits of BLAKE2b) and document that holds it. Counts: for each key how many documents refer to it and the largest of
them. Filters: for each shard of keys a cuckoo filter over the keys that `least` documents or more refer to, those whose
lines go; four 16-bit fingerprints a bucket, two buckets a key, and a short list of what found no place. Both tables are
exact, so a filter only ever spares work: what it lets through is looked up in the counts.

insert() adds documents: references not yet there, then the counts of their keys, then the keys that reached `least` go
into their shards' filters. delete() takes documents out in the same way, and keys that fell under `least` leave the
filters, which is what cuckoo filters can do and Bloom filters cannot. Both touch the counts of the batch's keys alone. An
index after insert and delete says the same as one built from the documents left.

deduplicate() drops lines. Filters of `most_bytes` at most go to all tasks, which test a document's lines where they read
it, so documents without a hit are done there and only texts with one are exchanged; larger filters stay where they are
and all references are joined with the counts. Both ways give the same rows. Hot keys are added up before any exchange;
the joins on keys are Spark's own, which splits skewed ones.

Keys of fewer than `shortest` code points are never dropped. A document is its doc_id: rows with one id are one document
with the lines of all, each row keeping its own text. A null doc_id is one document, before all others. A null or empty
text is one empty line. Other columns are kept by deduplicate() and otherwise ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansheet.llm._common import hidden, materialize, shown, table

SPACE = b" \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
SLOTS = 4  # fingerprints in a bucket
FULL = 0.85  # how full a shard's filter may be before all filters are built anew
KICKS = 200


@dataclass(frozen=True)
class Filters:
    """Where filters stand: a table (shard, slots, stash) of so many shards with so many buckets, a power of two, each."""

    rows: DataFrame
    shards: int
    buckets: int


@dataclass(frozen=True)
class LineIndex:
    """references (h1, h2, doc_id), counts (h1, h2, n, top) and the filters of keys that at least `least` documents hold."""

    references: DataFrame
    counts: DataFrame
    filters: Filters
    least: int = 3
    shortest: int = 20


def line_key(line: bytes, shortest: int) -> bytes | None:
    """A line's key, or None if it is too short to be dropped."""
    key = line.strip(SPACE).lower()  # of bytes, so of A-Z alone
    if len(key) < shortest or len(key) < 4 * shortest and len(key.decode()) < shortest:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _halves(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)


def references(docs: DataFrame, shortest: int = 20) -> DataFrame:
    """(h1, h2, doc_id): each key that a document holds, once a row of docs."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, rows = [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                keys = {k for line in (text or b"").split(b"\n") if (k := line_key(line, shortest))}
                made += keys
                rows += [i] * len(keys)
            half = _halves(made)
            yield pa.RecordBatch.from_arrays([pa.array(half[:, 0]), pa.array(half[:, 1]), batch.column("doc_id").take(pa.array(rows, pa.int64()))], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "h1 bigint, h2 bigint, doc_id bigint")


def counted(refs: DataFrame) -> DataFrame:
    """(h1, h2, n, top) of references without repeats; top is null where only the null document holds a key."""
    return refs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))


# filters


def places(h: np.ndarray, shards: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For keys (h1, h2) the shard, the fingerprint (never 0) and the two buckets; either bucket gives the other by the fingerprint."""
    two = np.ascontiguousarray(h[:, 1]).view(np.uint64)
    mark = (two >> np.uint64(48)).astype(np.int64) % 65535 + 1
    first = (two & np.uint64(buckets - 1)).astype(np.int64)
    return h[:, 0] % shards, mark, first, first ^ _jump(mark, buckets)


def _jump(mark, buckets: int):
    return (mark * 0x5BD1E995 >> 7) & (buckets - 1)


class Cuckoo:
    """One shard's filter: a bucket's free slots are 0; stash has (bucket, mark) of what found no place after KICKS moves."""

    def __init__(self, buckets: int, slots: bytes | None = None, stash: bytes | None = None):
        self.buckets = buckets
        self.slots = np.frombuffer(slots, "<u2").reshape(buckets, SLOTS).tolist() if slots else [[0] * SLOTS for _ in range(buckets)]
        self.stash = [tuple(x) for x in np.frombuffer(stash or b"", "<u4").reshape(-1, 2).tolist()]
        self.chance = random.Random(buckets)

    def insert(self, mark: int, first: int, second: int) -> None:
        at = first
        for at in (first, second):
            if 0 in self.slots[at]:
                self.slots[at][self.slots[at].index(0)] = mark
                return
        for _ in range(KICKS):
            k = self.chance.randrange(SLOTS)
            mark, self.slots[at][k] = self.slots[at][k], mark
            at ^= int(_jump(mark, self.buckets))
            if 0 in self.slots[at]:
                self.slots[at][self.slots[at].index(0)] = mark
                return
        self.stash.append((at, mark))

    def delete(self, mark: int, first: int, second: int) -> None:
        """Takes out a key that was put in."""
        for at in (first, second):
            if mark in self.slots[at]:
                self.slots[at][self.slots[at].index(mark)] = 0
                return
            if (at, mark) in self.stash:
                self.stash.remove((at, mark))
                return

    def written(self) -> tuple[bytes, bytes]:
        return np.array(self.slots, "<u2").tobytes(), np.array(self.stash, "<u4").tobytes()


def changed(filters: Filters, keys: DataFrame) -> Filters:
    """filters after keys (h1, h2, put): put in, or else taken out; shards that no key falls in stay as they are."""
    shards, buckets = filters.shards, filters.buckets
    dealt = keys.withColumn("_shard", F.pmod("h1", F.lit(shards)))

    def run(old: pa.Table, new: pa.Table) -> pa.Table:
        if not len(new):
            return old.select(["shard", "slots", "stash"])
        row = old.slice(0, 1).to_pylist()[0] if len(old) else {}
        own = Cuckoo(buckets, row.get("slots"), row.get("stash"))
        new = new.sort_by([("h1", "ascending"), ("h2", "ascending")])
        _, mark, first, second = places(np.column_stack([new.column("h1").to_numpy(), new.column("h2").to_numpy()]), shards, buckets)
        for put, *place in zip(new.column("put").to_pylist(), mark.tolist(), first.tolist(), second.tolist()):
            (own.insert if put else own.delete)(*place)
        return pa.table([pa.array([new.column("_shard")[0].as_py()], pa.int64()), *(pa.array([x], pa.binary()) for x in own.written())], names=["shard", "slots", "stash"])

    out = filters.rows.groupBy("shard").cogroup(dealt.groupBy("_shard")).applyInArrow(run, "shard bigint, slots binary, stash binary")
    return replace(filters, rows=materialize(out, "line-filters"))


def build_filters(counts: DataFrame, least: int, shard_keys: int = 1 << 15) -> Filters:
    """Filters anew from the counts, with room to grow to about twice the keys."""
    spark = counts.sparkSession
    going = counts.where(F.col("n") >= least).select(*KEY, F.lit(True).alias("put"))
    shards = max(1, -(-2 * going.count() // shard_keys))
    buckets = 1 << (shard_keys // SLOTS - 1).bit_length()
    return changed(Filters(spark.createDataFrame([], "shard bigint, slots binary, stash binary"), shards, buckets), going)


class Lookup:
    """All shards' filters as arrays, to test many keys at once."""

    def __init__(self, filters: Filters, rows: list):
        self.shards, self.buckets = filters.shards, filters.buckets
        self.slots = np.zeros((self.shards, self.buckets, SLOTS), np.uint16)
        stash = []
        for r in rows:
            self.slots[r["shard"]] = np.frombuffer(r["slots"], "<u2").reshape(self.buckets, SLOTS)
            stash += [(r["shard"] * self.buckets + at) << 16 | mark for at, mark in np.frombuffer(r["stash"], "<u4").reshape(-1, 2).tolist()]
        self.stash = np.array(sorted(stash), np.int64)

    def maybe(self, h: np.ndarray) -> np.ndarray:
        """Whether keys (h1, h2) may be in; never false for one that is."""
        shard, mark, first, second = places(h, self.shards, self.buckets)
        hit = np.zeros(len(h), bool)
        for at in (first, second):
            hit |= (self.slots[shard, at] == mark[:, None]).any(1)
            if len(self.stash):
                hit |= np.isin((shard * self.buckets + at) << 16 | mark, self.stash)
        return hit


def lookup(filters: Filters, most_bytes: int) -> Lookup | None:
    """The filters on the driver, if all of them take most_bytes at most."""
    if filters.shards * filters.buckets * SLOTS * 2 > most_bytes:
        return None
    return Lookup(filters, filters.rows.collect())


# the index


def build_index(docs: DataFrame, least: int = 3, shortest: int = 20) -> LineIndex:
    refs = materialize(references(docs, shortest).distinct(), "line-references")
    counts = materialize(counted(refs), "line-counts")
    return LineIndex(refs, counts, build_filters(counts, least), least, shortest)


def _recounted(index: LineIndex, refs: DataFrame, keys: DataFrame, now: DataFrame) -> LineIndex:
    """index with references refs, and counts now for keys; filters follow."""
    counts = materialize(index.counts.join(keys, KEY, "left_anti").unionByName(now), "line-counts")
    before = index.counts.join(keys, KEY, "left_semi").select(*KEY, (F.col("n") >= index.least).alias("_was"))
    after = now.select(*KEY, (F.col("n") >= index.least).alias("put"))
    moved = before.join(after, KEY, "full").na.fill(False, ["_was", "put"]).where("_was <> put").select(*KEY, "put")
    room = FULL * index.filters.shards * index.filters.buckets * SLOTS
    if counts.where(F.col("n") >= index.least).count() > room:
        filters = build_filters(counts, index.least)
    else:
        filters = changed(index.filters, moved)
    return replace(index, references=refs, counts=counts, filters=filters)


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """index with docs; references that it has already stay as they are."""
    new = materialize(references(docs, index.shortest).distinct(), "line-new")
    old = index.references
    fresh = materialize(new.join(old, (new["h1"] == old["h1"]) & (new["h2"] == old["h2"]) & new["doc_id"].eqNullSafe(old["doc_id"]), "left_anti"), "line-new")
    keys = materialize(fresh.select(*KEY).distinct(), "line-keys")
    both = index.counts.join(keys, KEY, "left_semi").unionByName(counted(fresh))
    now = materialize(both.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("top").alias("top")), "line-now")
    return _recounted(index, materialize(old.unionByName(fresh), "line-references"), keys, now)


def delete(index: LineIndex, ids: DataFrame) -> LineIndex:
    """index without the documents whose doc_id is in ids."""
    ids = ids.select(F.col("doc_id").cast("bigint").alias("_gone")).distinct()
    gone = F.col("doc_id").eqNullSafe(F.col("_gone"))
    keys = materialize(index.references.join(ids, gone, "left_semi").select(*KEY).distinct(), "line-keys")
    refs = materialize(index.references.join(ids, gone, "left_anti"), "line-references")
    now = materialize(counted(refs.join(keys, KEY, "left_semi")), "line-now")
    return _recounted(index, refs, keys, now)


def dropped(index: LineIndex, refs: DataFrame) -> DataFrame:
    """(doc_id, keys): for documents of refs the keys, as bytes, whose lines go from them."""
    going = index.counts.where((F.col("n") >= index.least) & F.col("top").isNotNull()).select(*KEY, "top")
    lose = refs.join(going, KEY).where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("top")))
    return lose.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct(*KEY)).alias("_keys"))


def deduplicate(index: LineIndex, docs: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """docs with _n_lines, _n_dropped and _kept (null where a text stays as it is): texts without the lines that go.

    docs are those of the index, or some of them as they were put in.
    """
    spark = docs.sparkSession
    held = lookup(index.filters, most_bytes)
    shared = None if held is None else spark.sparkContext.broadcast(held)
    refs, shortest = index.references, index.shortest

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.maybe(np.column_stack([b.column("h1").to_numpy(), b.column("h2").to_numpy()]))))

    if shared is not None:
        refs = refs.mapInArrow(maybe, "h1 bigint, h2 bigint, doc_id bigint")
    return _without(docs, dropped(index, refs), shared, shortest)


def _without(docs: DataFrame, gone: DataFrame, shared, shortest: int) -> DataFrame:
    columns = docs.columns

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The text of documents with a line that may go."""
        for b in batches:
            texts, out, n = b.column("text").cast(pa.binary()).to_pylist(), [], []
            for text in texts:
                lines = (text or b"").split(b"\n")
                keys = [k for line in lines if (k := line_key(line, shortest))]
                n.append(len(lines))
                out.append(text if keys and shared.value.maybe(_halves(keys)).any() else None)
            yield b.append_column("_n_lines", pa.array(n, pa.int64())).append_column("_text", pa.array(out, pa.binary()).cast(pa.string()))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, n = [], []
            for text, keys in zip(b.column("_text").cast(pa.binary()).to_pylist(), b.column("_keys").to_pylist()):
                if not keys or text is None:
                    kept.append(None)
                    n.append(0)
                    continue
                go = {np.array([k["h1"], k["h2"]], "<i8").tobytes() for k in keys}
                lines = text.split(b"\n")
                stay = [line for line in lines if line_key(line, shortest) not in go]
                kept.append(b"\n".join(stay))
                n.append(len(lines) - len(stay))
            yield b.drop_columns(["_text", "_keys"]).append_column("_n_dropped", pa.array(n, pa.int64())).append_column("_kept", pa.array(kept, pa.binary()).cast(pa.string()))

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    if shared is not None:
        docs = docs.mapInArrow(hit, f"{own}, _n_lines bigint, _text string")
    else:
        docs = docs.withColumn("_n_lines", (F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) + 1).cast("bigint")).withColumn("_text", F.col("text"))
    both = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").drop("_doc")
    return both.mapInArrow(drop, f"{own}, _n_lines bigint, _n_dropped bigint, _kept string").select(*columns, "_n_lines", "_n_dropped", "_kept")


def clean(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """docs with the lines that go taken out of their texts."""
    df, names = hidden(docs, ("doc_id", "text", "n_chars"))
    out = deduplicate(index or build_index(df), df).withColumn("text", F.coalesce("_kept", "text"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("_kept").isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return shown(out, names)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = deduplicate(build_index(docs), docs)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("_kept", "text", F.lit("")), 256).alias("kept_sha256"))


OP13_SQL = r"""
with doc as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
line as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as i from doc),
keyed as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from line),
going as (select k, max(doc_id) as top from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
judged as (select keyed.*, top is not null and keyed.doc_id < top as gone from keyed left join going on keyed.k = going.k)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from judged group by 1
"""
