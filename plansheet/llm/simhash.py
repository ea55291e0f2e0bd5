"""SimHash near-dedup with pivot distance tables.

A text's words (A-Z lower-cased) give shingles of `shingle` words, each hashed by XXH64 (seed 42); a bit is 1 if set in
over half of the hashes. Two fingerprints link at `radius` or fewer differing bits. Documents are first reduced to
distinct fingerprints, so copies are never paired.

Candidates: a pivot distance table alone can't choose them at scale, since distances of 64-bit fingerprints to any pivot
crowd around 32 (one pivot lets over half of all pairs pass). So the 64 bits are cut into radius + 2 blocks, and each
fingerprint goes to one bucket for each pair of blocks: two linked ones agree in two blocks at least, so they meet. In a
bucket the pivot table decides: distances to `pivots` reference fingerprints are computed once for each row, pairs whose
largest coordinate difference is over the radius are discarded (the triangle inequality), and survivors are verified
by their exact distance. Small buckets are done together, pair by pair. In a large one a component grows from a
fingerprint: each step looks, by the sorted first coordinate, only among fingerprints not yet in it, so a dense ball of
near copies is used up in a few steps and yields a link for each member, not for each pair.

Null and empty texts have fingerprint zero and are linked like any other. Rows with null ids get fingerprints and
classes but are nobody's class id unless a class has no other. Repeated rows stay. Other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansheet.llm._common import materialize, table
from plansheet.llm.components import components

SEED = 42


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = max(1, len(words) - shingle + 1)
    counts, last = np.zeros(64, np.int64), min(shingle, len(words)) - 1
    for at in range(0, n, 1 << 16):
        hashes = np.array([h(line[a:b], SEED) for a, b in zip(starts[at : min(n, at + (1 << 16))], ends[at + last :])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp), fp as a signed 64-bit number."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text").cast(pa.binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, fp bigint")


def references(n: int, seed: int = 7) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, np.uint64, endpoint=False)


def blocks(radius: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of radius + 2 blocks."""
    n = radius + 2
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def bucketed(fps: DataFrame, radius: int) -> DataFrame:
    """(key, fp), a row for each pair of blocks."""
    cut = [F.shiftrightunsigned("fp", a).bitwiseAND((1 << w) - 1) for a, w in blocks(radius)]
    pairs = list(itertools.combinations(range(len(cut)), 2))
    keys = [F.shiftleft(cut[a], 32).bitwiseXOR(cut[b]).bitwiseXOR(F.shiftleft(F.lit(k).cast("long"), 48 + 4)) for k, (a, b) in enumerate(pairs)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _near(x: np.ndarray, tx: np.ndarray, y: np.ndarray, ty: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs survive the table and verification: row k of x with row k of y (or x alone with all of y)."""
    ok = np.zeros(len(ty), bool)
    left = np.nonzero(np.abs(tx - ty).max(axis=-1) <= radius)[0]
    other = x[left] if len(x) > 1 else x
    ok[left[np.bitwise_count(other ^ y[left]) <= radius]] = True
    return ok


def bucket_links(key: np.ndarray, fp: np.ndarray, radius: int, pivots: np.ndarray, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each key, what the full set of links connects."""
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
    size = np.diff(np.append(first, len(key)))
    us, vs = [], []

    def table_of(x: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x[:, None] ^ pivots[None, :]).astype(np.int8)

    few = np.nonzero((size > 1) & (size <= small))[0]
    for n in np.unique(size[few]).tolist():  # all buckets of one size at once
        a, b = np.triu_indices(n, 1)
        starts = first[few[size[few] == n]]
        step = max(1, (1 << 18) // len(a))
        for at in range(0, len(starts), step):
            rows = starts[at : at + step, None]
            member = fp[(rows + np.arange(n)).ravel()]
            t = table_of(member)
            base = (np.arange(len(rows)) * n)[:, None]
            i, j = (base + a).ravel(), (base + b).ravel()
            ok = _near(member[i], t[i], member[j], t[j], radius)
            us.append(member[i[ok]])
            vs.append(member[j[ok]])
    for k in np.nonzero(size > small)[0].tolist():
        member = fp[first[k] : first[k] + size[k]]
        t = table_of(member)
        order = np.argsort(t[:, 0], kind="stable")
        member, t = member[order], t[order]
        free = np.arange(len(member))  # not yet in a component, sorted by the first coordinate
        while len(free):
            root, grown, free = int(free[0]), [int(free[0])], free[1:]
            got = []
            while grown and len(free):
                x = grown.pop()
                lo, hi = np.searchsorted(t[free, 0], [t[x, 0] - radius, t[x, 0] + radius + 1])
                near = free[lo:hi]
                ok = _near(member[x : x + 1], t[x], member[near], t[near], radius)
                if ok.any():
                    new = near[ok]
                    grown.extend(new.tolist())
                    got.append(new)
                    free = np.concatenate([free[:lo], near[~ok], free[hi:]])
            if got:
                new = member[np.concatenate(got)]
                us.append(np.full(len(new), member[root]))
                vs.append(new)
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, fp.dtype), np.empty(0, fp.dtype))


def links(fps: DataFrame, radius: int = 4, pivots: int = 16) -> DataFrame:
    """Links (u, v) between distinct fingerprints (fp) with the components of all links."""
    table_ = references(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("key").to_numpy(), b.column("fp").to_numpy().view(np.uint64)) for b in batches]
        if held:
            u, v = bucket_links(*(np.concatenate(c) for c in zip(*held)), radius, table_)
            both = np.unique(np.stack([u, v], 1), axis=0) if len(u) else np.empty((0, 2), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, k].copy().view(np.int64)) for k in (0, 1)], ["u", "v"])

    return bucketed(fps, radius).repartition("key").mapInArrow(run, "u bigint, v bigint")


def classes(df: DataFrame, radius: int = 4, shingle: int = 4, pivots: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row of df."""
    fps = materialize(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    roots = components(links(nodes.select("fp"), radius, pivots))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(df: DataFrame, **how) -> DataFrame:
    """One row of df for each class: that with the smallest id (nulls last), and of rows with this id that with the smallest
    hash of the text. Which row goes is decided by class, so rows with one id and texts of different classes all have theirs;
    rows that are equal in id and text are one document."""
    text = F.col("text").cast("string")
    rows = df.select("doc_id", F.struct(F.col("doc_id").alias("i"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("h")).alias("_at"), text.alias("text"))
    named = classes(rows, id_col="_at", **how)  # ids that tell rows of one id apart by their texts
    kept = named.groupBy("component_id").agg(F.min(F.struct(F.col("_at.i").isNull().alias("n"), F.col("_at").alias("a"))).alias("m")).select(F.col("m.a.i").alias("_i"), F.col("m.a.h").alias("_h")).distinct()
    here = df.withColumn("_h0", F.coalesce(F.xxhash64(text), F.lit(0)))
    one = here.join(kept, here["doc_id"].eqNullSafe(kept["_i"]) & (here["_h0"] == kept["_h"]), "left_semi")
    return one.withColumn("_i0", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).dropDuplicates(["_i0", "_h0"]).select(*(F.col(f"`{c}`") for c in df.columns))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
