"""Writing intermediate tables to the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansheet.shipping import ship


#: The least bytes of a shuffle's task. At Spark's own a table of a megabyte is one file, and whatever reads it one task;
#: where the session has the default it is set lower, so that small tables of many drawings keep all cores busy.
LEAST = "spark.sql.adaptive.coalescePartitions.minPartitionSize"


#: Which tables joins send whole to every task. Before a query runs Spark knows a table by its file's size alone, and tables of drawings
#: are many times larger than their files (rows alike, exploded); sizes are left to adaptive execution, which has counted the rows' bytes.
PLANNED, COUNTED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
#: A union of joins shuffled alike passes for dealt by their key, also after adaptive execution has put each side's parts together in its
#: own way; a key's rows then come apart (each_pair lost drawings, tested), so this isn't relied on.
UNION = "spark.sql.unionOutputPartitioning"


#: How many parts a shuffle has before adaptive execution puts small ones together, so that a task's rows don't grow with the table.
PARTS, INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", 240


def by_counted_size(spark: SparkSession) -> None:
    """Where the session has Spark's own bound on broadcast tables, it holds for counted bytes and not for those of files."""
    spark.conf.set(UNION, "false")
    if spark.conf.get(PARTS, None) is None:
        spark.conf.set(PARTS, str(max(INITIAL, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    if spark.conf.get(PLANNED).lower() in ("10mb", "10m", "10485760", "10485760b") and spark.conf.get("spark.sql.adaptive.enabled") == "true":
        if spark.conf.get(COUNTED, None) is None:
            spark.conf.set(COUNTED, "10485760b")
        spark.conf.set(PLANNED, "-1")


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names in the session or the context's settings. Where it is unset, a folder of this machine's in
    local mode alone; executors elsewhere wouldn't see that one."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_plansheet_folder", None)
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = sc._plansheet_folder = "file://" + tempfile.mkdtemp(prefix="plansheet-")
    return at.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends here and it outlives executors."""
    spark = df.sparkSession
    ship(spark)
    by_counted_size(spark)
    if spark.conf.get(LEAST).lower() in ("1mb", "1m", "1048576", "1048576b"):
        spark.conf.set(LEAST, "128k")
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a task makes drawings of, at most: each becomes some dozens of lines or hundreds of cells.
SPREAD = 10_000


def spread(df: DataFrame) -> DataFrame:
    """A table of a file's rows over tasks whose number grows with the rows. A file of a few megabytes is one task otherwise, that makes
    all lines of all drawings; counting the rows reads the file's footer alone."""
    n = df.count()
    parts = max(n // SPREAD, min(df.sparkSession.sparkContext.defaultParallelism, n // 1000))
    return df.repartition(parts) if parts > 1 else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over as many tasks as shuffles have, however few bytes it is: for groups that cost more than their bytes say."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def _starts(keys: pa.ChunkedArray) -> list[int]:
    """Where each run of equal keys begins, and the end."""
    if not len(keys):
        return [0]
    a, b = keys.slice(1), keys.slice(0, len(keys) - 1)
    new = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
    return [0, *(np.nonzero(new.to_numpy())[0] + 1).tolist(), len(keys)]


def each_group(df: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str, key: str = "drawing_id", order: tuple[str, ...] = ()) -> DataFrame:
    """run(rows) of each key's rows, in the given order, as an Arrow table of one chunk. Groups come one after another in a task's batches, so many small ones cost no stream each; a task holds a batch and one group."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []  # the group that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            t, made = pa.Table.from_batches([batch]), []
            at = _starts(t.column(key))
            if rest and rest[0].column(key)[0].as_py() == t.column(key)[0].as_py():
                rest.append(t.slice(0, at[1]))
                at = at[1:]
                if len(at) == 1:
                    continue
            if rest:
                made.append(run(pa.concat_tables(rest).combine_chunks() if len(rest) > 1 else rest[0]))
            made += [run(t.slice(x, y - x)) for x, y in zip(at[:-2], at[1:-1])]
            rest = [t.slice(at[-2])]
            if made:
                yield from pa.concat_tables(made).combine_chunks().to_batches()
        if rest:
            yield from run(pa.concat_tables(rest).combine_chunks() if len(rest) > 1 else rest[0]).combine_chunks().to_batches()

    return dealt(df, key).sortWithinPartitions(key, *order).mapInArrow(stream, schema)


def each_pair(left: DataFrame, right: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, key: str = "drawing_id") -> DataFrame:
    """run(left rows, right rows) of each key that both have; beside the key they share no column."""
    names = [[c for c in df.columns if c != key] for df in (left, right)]
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    empty = _empty(schema)

    def one(t: pa.Table) -> pa.Table:
        cut = int(np.searchsorted(t.column("_side").to_numpy(), 1))
        if cut in (0, len(t)):
            return empty(t.schema.field(key).type)
        return run(t.slice(0, cut).select([key, *names[0]]), t.slice(cut).select([key, *names[1]]))

    return each_group(both, one, schema, key, ("_side",))


def _empty(schema: str) -> Callable[[pa.DataType], pa.Table]:
    """An empty table of a schema given as text, made when first asked for."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return lambda kind: kinds.empty_table()


def grouped_rows(group: pa.Table, rows: list[tuple], fields: list[tuple[str, pa.DataType]], key: str = "drawing_id") -> pa.Table:
    """rows as an Arrow table behind the key of the group that they come from."""
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    schema = pa.schema([group.schema.field(key), *fields])
    return pa.Table.from_arrays([group.column(key).slice(0, 1).take(pa.array([0] * len(rows), pa.int64())), *(pa.array(c, kind) for c, (_, kind) in zip(columns, fields))], schema=schema)


def together(*makes: Callable) -> list:
    """What each of makes returns, their jobs submitted from threads of their own: small jobs spend more time on starting than on rows."""
    session = SparkSession.getActiveSession()
    own = inheritable_thread_target(session) if session is not None else lambda make: make
    with ThreadPoolExecutor(len(makes)) as pool:
        return [f.result() for f in [pool.submit(own(m)) for m in makes]]
