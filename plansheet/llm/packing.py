"""Best-fit packing: planned on the histogram of lengths, then documents take the planned slots by rank.

Documents are cut into pieces of at most `capacity` tokens (only longer documents are cut). The plan never sees a
document: it best-fits counts of lengths, longest first, into open sequences grouped by their free space, so that its
size depends on `capacity` alone (a few rows for each length), and it is the one thing that is broadcast. A piece's
rank among those of its length is the count of that length in smaller salts plus its rank in its own salt, so a length
that holds a third of all pieces is ranked by many tasks.

Nulls and empty texts are documents of one token, the closing id. Repeated rows and repeated ids are documents of
their own; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plansheet.llm._common import materialize, table
from plansheet.llm.tokens import balanced, vocabulary, word_codes


def token_pieces(df: DataFrame, path: str, capacity: int = 4096, closing_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, batch_bytes: int = 4 << 20) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32 and, if asked for, the ids as little-endian 32 bits."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    types = [None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    full, closing = 4 * capacity, np.array([closing_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = word_codes(path, False)
        for batch in batches:
            held, piece = b"", 0
            for group in balanced(batch.column("text").cast(pa.binary()), batch_bytes):
                rows, cols = [], [[] for _ in names[1:]]
                for (row, _, last), ids in zip(group, codes.encode([text for _, text, _ in group])):
                    held = b"".join((held, ids, closing if last else b""))
                    at = 0
                    while at < len(held) and (last or len(held) - at >= full):
                        own = held[at : at + full]
                        rows.append(row)
                        for c, v in zip(cols, (piece, piece * capacity, len(own) // 4, zlib.crc32(own), own)):
                            c.append(v)
                        at, piece = at + len(own), piece + 1
                    held, piece = (b"", 0) if last else (held[at:], piece)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types[1:]))], names)
        pa.default_memory_pool().release_unused()

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids)


def plan_best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces a sequence, offset there), by length and first rank.

    Longest first, each piece goes to the fullest open sequence that can hold it, else it opens one. Sequences alike in
    free space are handled as one range of numbers, so a step costs the number of ranges, not of pieces.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    spaces: list[int] = []  # sorted free spaces in use
    ranges: dict[int, list[tuple[int, int]]] = {}
    new = 0

    def opened(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in ranges:
                bisect.insort(spaces, space)
                ranges[space] = []
            ranges[space].append((first, n))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect.bisect_left(spaces, length)
            if k < len(spaces):
                space = spaces[k]
                first, n = ranges[space].pop()
                if not ranges[space]:
                    del ranges[space], spaces[k]
            else:
                space, first, n = capacity, new, -(-left // (capacity // length))
                new += n
            each = space // length
            whole = min(n, left // each)
            if whole:
                rows.append((length, rank, first, each, capacity - space))
                opened(space - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < n and left:
                rows.append((length, rank, first + whole, left, capacity - space))
                opened(space - left * length, first + whole, 1)
                whole, left = whole + 1, 0
            opened(space, first + whole, n - whole)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces_df: DataFrame, capacity: int = 4096, salts: int = 256, id_col: str = "id") -> DataFrame:
    """pieces_df (a stored table with id, piece, start, length and more) with sequence_id and offset."""
    spark = pieces_df.sparkSession
    salted = pieces_df.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    counts = materialize(counts.withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # capacity rows at most
    plan = spark.sparkContext.broadcast(plan_best_fit(histogram, capacity))
    ranked = salted.join(counts.drop("_n"), ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(F.col(id_col), "piece", "start", "ids_crc32")) - 1 + F.col("_base"))
    out = [f for f in pieces_df.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        keys = p[:, 0] << 44 | p[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            _, first_rank, first, each, offset = p[at].T
            n = rank - first_rank
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in out), pa.array(first + n // each), pa.array(offset + n % each * length)], [*(f.name for f in out), "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(df: DataFrame, path: str, capacity: int = 4096, closing_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    cut = materialize(token_pieces(df, path, capacity, closing_id, id_col, text_col), "pieces")
    return pack(cut, capacity).withColumnRenamed("id", id_col)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())
