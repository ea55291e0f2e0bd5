"""Results kept by content: a drawing is computed again only when its entities or the options have changed.

A drawing's content is a hash of its rows that doesn't depend on their order: count, sum and exclusive or of 64-bit hashes
of each entity with its kind, number, place and layer. Results are tables in a shared folder, in a batch for each call that
computed something; an index of (name, options, drawing, content, batch) is written last, so a batch whose writing failed is
never read. A call joins its drawings' contents with the index, hands what isn't there to the function, and reads the rest.

A drawing with the same content under another id is computed under its own id; null ids are drawings like others. Results of
earlier contents stay until drop() takes them out of the folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansheet.operators.repair import union
from plansheet.operators.tables import stored

Tables = dict[str, DataFrame]
_INDEX = "name string, options string, drawing string, content string, batch string, at timestamp"


def contents(entities: Tables) -> DataFrame:
    """(drawing_id, content) of drawings from their tables of entities (kind: rows keyed by drawing_id)."""

    def hashed(kind: str, df: DataFrame) -> DataFrame:
        own = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in sorted(df.columns) if c != "drawing_id"]
        return df.select("drawing_id", F.xxhash64(F.lit(kind), *own).alias("h"), F.xxhash64(*own, F.lit(kind)).alias("g"))

    rows = union([hashed(kind, df) for kind, df in sorted(entities.items())])
    sums = rows.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s"), F.expr("bit_xor(g)").alias("x"))
    return sums.select("drawing_id", F.concat_ws(":", "n", "s", "x").alias("content"))


class Results:
    """What has been computed of drawings, kept below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def index(self) -> DataFrame:
        try:
            return self.spark.read.schema(f"{_INDEX}, call string").parquet(f"{self.folder}/index").drop("call")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _INDEX)

    def _state(self, name: str, entities: Tables, options: str) -> DataFrame:
        """(drawing_id, content, batch): each drawing, and the batch that holds its result; none, if there is none yet."""
        held = self.index().where((F.col("name") == name) & (F.col("options") == options)).groupBy("drawing", "content").agg(F.max_by("batch", "at").alias("batch"))
        now = contents(entities).withColumn("_drawing", F.coalesce(F.col("drawing_id").cast("string"), F.lit("\x00")))
        return stored(now.join(held.withColumnRenamed("content", "_content"), (F.col("_drawing") == F.col("drawing")) & (F.col("content") == F.col("_content")), "left").select("drawing_id", "content", "batch"), "cache-state")

    def get(self, name: str, entities: Tables, make: Callable[[Tables], Tables], options: str = "") -> Tables:
        """make(entities)'s tables (each with drawing_id) for all drawings, with `cached`: whether the result was there before."""
        state = self._state(name, entities, options)
        gone = state.where("batch is null").select("drawing_id")
        if not gone.isEmpty():
            own = {k: df.join(gone.withColumnRenamed("drawing_id", "_id"), F.col("drawing_id").eqNullSafe(F.col("_id")), "left_semi") for k, df in entities.items()}
            batch = uuid.uuid4().hex
            for table, df in make(own).items():
                df.write.parquet(f"{self.folder}/{name}/{table}/batch={batch}")
            new = state.where("batch is null").select(F.lit(name), F.lit(options), F.coalesce(F.col("drawing_id").cast("string"), F.lit("\x00")), "content", F.lit(batch), F.current_timestamp())
            new.toDF("name", "options", "drawing", "content", "batch", "at").write.parquet(f"{self.folder}/index/call={batch}")  # a folder for each call, so calls at one time don't clear each other's files
        now = stored(self._state(name, entities, options).join(state.select(F.col("drawing_id").alias("_id"), F.col("batch").isNotNull().alias("cached")), F.col("drawing_id").eqNullSafe(F.col("_id"))).drop("_id", "content"), "cache-state")
        return {table: self._read(name, table, now) for table in self._tables(name)}

    def _tables(self, name: str) -> list[str]:
        """The names of a result's tables, as its folders say."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _read(self, name: str, table: str, now: DataFrame) -> DataFrame:
        batches = [r["batch"] for r in now.select("batch").distinct().collect()]  # a name for each call that computed something
        rows = self.spark.read.option("basePath", f"{self.folder}/{name}/{table}").parquet(*(f"{self.folder}/{name}/{table}/batch={b}" for b in batches))
        now = now.select(F.col("drawing_id").alias("_id"), F.col("batch").alias("_batch"), "cached")
        return rows.join(now, F.col("drawing_id").eqNullSafe(F.col("_id")) & (F.col("batch") == F.col("_batch"))).drop("_id", "_batch", "batch")

    def drop(self, name: str) -> None:
        """Forgets all of a result."""
        kept = stored(self.index().where(F.col("name") != name), "cache-index")
        for part in ("index", name):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        kept.write.parquet(f"{self.folder}/index/call={uuid.uuid4().hex}")
