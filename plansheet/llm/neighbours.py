"""Approximate nearest neighbours by largest inner product: collision counting over sorted single projections.

Index: equal rows are counted before any exchange, and go to shards of about `shard_rows` by a hash of id and vector. In a
shard vectors are scaled by the largest norm and get one more coordinate that makes them unit vectors, so the largest
inner product is the smallest distance; each is projected on an orthonormal set of random directions, and every
projection is stored as a sorted array: the values in order and the rows they belong to.

Search: a window opens around the query's value in each sorted array and widens by virtual rehashing, `base` deviations
of the projections at a time. A step walks each array outwards from the window's two ends over the new entries alone,
which collide with the query at this step and all that follow, and a vector's collisions are summed over the steps: one
that is near collides early and in many projections. A step that would add nothing goes on to the next entry. Steps end when `enough` vectors collide in `threshold` of the
projections, where `enough` is `share` of the shard, or `least` in a small one; the sum that as many reach is the
collision threshold, and the vectors that exceed or reach it are verified: their exact inner products, in double precision, on the
original vectors. A shard gives its k best, and these are ranked over all shards.

Queries are a stated set, so their cost is theirs times the rows: groups of at most `group_rows` queries meet each shard,
as blocks of bounded size on both sides. Recall against brute force is tested (0.9 and more).

Vectors that are null, zero or hold null or non-finite components, and rows without an id, take no part; vectors of
different lengths are never compared. Rows with the query's id are its own. Of repeated rows each is a candidate, and a
repeated query is asked once. Ties go to the smaller id. Other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plansheet.llm._common import materialize, table


def valid(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, dim): what takes part."""
    v = F.col("v")
    df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0.0)).withColumn("dim", F.size("v"))


def directions(dim: int, seed: int = 11) -> np.ndarray:
    """An orthonormal set, a row each."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r))).T


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks] or [np.empty(0)]).reshape(-1, dim)


class Shard:
    """A shard's vectors, how many rows each stands for, and their sorted projections: the values in order and whose they are."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, v: np.ndarray, order: np.ndarray, value: np.ndarray):
        self.ids, self.copies, self.v, self.order, self.value = ids, copies, v, order, value

    @classmethod
    def built(cls, ids: np.ndarray, copies: np.ndarray, v: np.ndarray) -> Shard:
        norm = np.sqrt((v * v).sum(1))
        scaled = v / norm.max()
        more = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(1)))
        p = directions(v.shape[1] + 1) @ np.concatenate([scaled, more[:, None]], 1).T
        order = np.argsort(p, axis=1, kind="stable")
        return cls(ids, copies, v, order.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32), np.take_along_axis(p, order, 1).astype(np.float32))

    @classmethod
    def read(cls, row: dict) -> Shard:
        ids, dim = np.frombuffer(row["ids"], "<i8"), row["dim"]
        n = len(ids)
        order = np.frombuffer(row["orders"], "<u2" if n <= 1 << 16 else "<u4").reshape(dim + 1, n)
        return cls(ids, np.frombuffer(row["copies"], "<i8"), np.frombuffer(row["vectors"], "<f8").reshape(n, dim), order, np.frombuffer(row["projections"], "<f4").reshape(dim + 1, n))

    def written(self) -> list[bytes]:
        kinds = ("<i8", "<i8", "<f8", "<u2" if len(self.ids) <= 1 << 16 else "<u4", "<f4")
        return [x.astype(k).tobytes() for x, k in zip((self.ids, self.copies, self.v, self.order, self.value), kinds)]

    def ends(self, p: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows' ends, (queries, projections) each, for queries' projections p and a width for each query."""
        return tuple(np.stack([np.searchsorted(x, q + sign * width, side) for x, q in zip(self.value, p)], 1) for sign, side in ((-1, "left"), (1, "right")))

    def gap(self, p: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How far each query's next entry is, beyond windows with these ends."""
        n, row = len(self.ids), np.arange(len(self.value))
        low = np.where(left > 0, p.T - self.value[row, np.maximum(left - 1, 0)], np.inf)
        high = np.where(right < n, self.value[row, np.minimum(right, n - 1)] - p.T, np.inf)
        return np.minimum(low, high).min(1)

    def found(self, p: np.ndarray, enough: int, threshold: float, base: float) -> Iterator[np.ndarray]:
        """For each query (a column of p) the rows that exceed the collision threshold.

        Each step widens the windows of all queries that go on. Where a query's windows have met nothing new they go on to
        the next entry at once, so every step adds an entry, however far the query is and however close the entries are.
        """
        n, m = len(self.ids), len(self.value)
        step = max(base * (float(np.sqrt(np.mean(np.var(self.value, axis=1)))) or 1.0), 1e-6)  # what single precision tells apart
        flat, starts = self.order.ravel(), np.arange(m) * n
        low = high = np.stack([np.searchsorted(x, q) for x, q in zip(self.value, p)], 1)
        low, high = low.copy(), high.copy()
        out: list[np.ndarray] = [np.empty(0, np.int64)] * p.shape[1]
        count, total = (np.zeros((p.shape[1], n), np.int32) for _ in range(2))
        width, active = np.zeros(p.shape[1], np.float32), np.arange(p.shape[1])
        while len(active):
            width[active] += np.float32(step)
            left, right = self.ends(p[:, active], width[active])
            still = ((left == low[active]) & (right == high[active])).all(1)
            if still.any():
                stuck = active[still]
                width[stuck] = np.maximum(width[stuck], self.gap(p[:, stuck], low[stuck], high[stuck]) * np.float32(1 + 1e-5))
                left[still], right[still] = self.ends(p[:, stuck], width[stuck])
            go = np.ones(len(active), bool)
            for i, r in enumerate(active):
                a, b, c, d = ((starts + x).tolist() for x in (left[i], low[r], high[r], right[i]))
                new = [flat[x:y] for x, y in zip(a, b)] + [flat[x:y] for x, y in zip(c, d)]
                count[r] += np.bincount(np.concatenate(new), minlength=n).astype(np.int32)
                total[r] += count[r]
                if np.count_nonzero(count[r] >= threshold * m) >= enough:
                    go[i] = False
                    out[r] = np.nonzero(total[r] >= np.partition(total[r], n - enough)[n - enough])[0]
            low[active], high[active] = left, right
            active = active[go]
        yield from out

    def search(self, qids: np.ndarray, q: np.ndarray, k: int, share: float, least: int, threshold: float, base: float, together: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's row, ids, scores) of each query's k best here."""
        enough = min(len(self.ids), max(least, int(share * len(self.ids))))
        unit = q / np.sqrt((q * q).sum(1))[:, None]
        p = (directions(q.shape[1] + 1) @ np.concatenate([unit, np.zeros((len(q), 1))], 1).T).astype(np.float32)
        for at in range(0, len(q), together):
            for r, found in enumerate(self.found(p[:, at : at + together], enough, threshold, base), at):
                found = found[self.ids[found] != qids[r]]
                scores = (self.v[found] * q[r]).sum(1)
                best = np.lexsort((self.ids[found], -scores))[:k]
                times = np.minimum(self.copies[found[best]], k)
                yield r, np.repeat(self.ids[found[best]], times)[:k], np.repeat(scores[best], times)[:k]


_INDEX = "dim int, shard int, ids binary, copies binary, vectors binary, orders binary, projections binary"


def build_index(vectors: DataFrame, shard_rows: int = 8192) -> DataFrame:
    """A row for each shard of vectors (from valid()), stored."""
    rows = materialize(vectors.groupBy("vec_id", "v", "dim").agg(F.count(F.lit(1)).alias("copies")), "ann-vectors")
    shards = max(1, -(-rows.count() // shard_rows))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        dim = t.column("dim")[0].as_py()
        s = Shard.built(t.column("vec_id").to_numpy(), t.column("copies").to_numpy(), _matrix(t.column("v"), dim))
        return pa.table([pa.array([dim], pa.int32()), t.column("shard").slice(0, 1).combine_chunks(), *(pa.array([b], pa.binary()) for b in s.written())], names=["dim", "shard", "ids", "copies", "vectors", "orders", "projections"])

    return materialize(rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")).groupBy("dim", "shard").applyInArrow(run, _INDEX), "ann-index")


def search(index: DataFrame, queries: DataFrame, k: int = 20, share: float = 0.05, least: int = 160, threshold: float = 0.95, base: float = 0.64, group_rows: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries (from valid()) against all that is indexed."""
    asked = queries.groupBy("vec_id", "v", "dim").count().drop("count").withColumn("asked", F.xxhash64("v"))
    groups = max(1, -(-asked.count() // group_rows))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    where = index.select(F.col("dim").alias("_dim"), F.col("shard").alias("_shard"))
    asked = asked.join(where, F.col("dim") == F.col("_dim")).select("vec_id", "v", "asked", F.col("_dim").alias("qdim"), F.col("_shard").alias("qshard"), F.col("part").alias("qpart"))
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    out = pa.schema([("query_id", pa.int64()), ("asked", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return out.empty_table()
        s = Shard.read(left.slice(0, 1).to_pylist()[0])
        right = right.sort_by([("vec_id", "ascending"), ("asked", "ascending")])
        qids, hashes = right.column("vec_id").to_numpy(), right.column("asked").to_numpy()
        rows, found, scores = [], [], []
        for r, i, x in s.search(qids, _matrix(right.column("v"), s.v.shape[1]), k, share, least, threshold, base):
            rows.append(np.full(len(i), r))
            found.append(i)
            scores.append(x)
        at = np.concatenate(rows)
        return pa.Table.from_arrays([pa.array(qids[at]), pa.array(hashes[at]), pa.array(np.concatenate(found)), pa.array(np.concatenate(scores))], schema=out)

    best = index.groupBy("dim", "shard", "part").cogroup(asked.groupBy("qdim", "qshard", "qpart")).applyInArrow(run, "query_id bigint, asked bigint, vec_id bigint, score double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = valid(table(spark, sf_dir, "embeddings"))
    return search(build_index(vectors), vectors.where("vec_id % 20 = 0"))
