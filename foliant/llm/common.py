"""What the operators of this subpackage share: tables, written intermediates, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, and what lies between it: a word.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = 2048, size: int = 4 << 20, read: int = 512) -> None:
    """Whole texts are large rows: Spark's defaults for the rows and bytes of an Arrow batch, and for the rows that are read from Parquet at once, are lowered; values set by the user stay."""
    arrow = "spark.sql.execution.arrow."
    for key, default, least in ((f"{arrow}maxRecordsPerBatch", 10_000, rows), (f"{arrow}maxBytesPerBatch", 64 << 20, size), ("spark.sql.parquet.columnarReaderBatchSize", 4096, read)):
        if spark.conf.get(key) in (str(default), f"{default}b"):
            spark.conf.set(key, str(least))


def give_back() -> None:
    """What a worker holds and doesn't use goes back to the system at the end of a task: workers stay for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(c: str | Column = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where it is unset in local mode, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = getattr(sc, "_foliant_dir", None)
        if found is None:
            found = sc._foliant_dir = tempfile.mkdtemp(prefix="foliant-")
    return found.rstrip("/")


class Stash:
    """Intermediates written as Parquet into the shared folder: they cut lineage and outlive executors.

    clear() removes those that later steps no longer read, only() all but the result. After heavy ones the driver is asked to collect its garbage, since
    shuffle files go only with the objects that stand for them."""

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/foliant-{uuid.uuid4().hex}", {}

    def __call__(self, df: DataFrame, name: str | None = None, heavy: bool = False) -> DataFrame:
        path = f"{self.root}/{name or 't'}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
        back = self.spark.read.schema(schema).parquet(path)
        self.paths[id(back)] = (path, back)
        if heavy:
            gc.collect()
            for _ in range(2):  # the second call follows what the first has queued
                self.spark._jvm.System.gc()
                time.sleep(0.2)
        return back

    def clear(self, *frames: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            path, _ = self.paths.pop(id(df), (None, None))
            if path:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)

    def only(self, df: DataFrame) -> DataFrame:
        """df written; all else that was written goes."""
        before = [x for _, x in self.paths.values()]
        out = self(df, "result")
        self.clear(*before)
        return out


def components(stash: Stash, edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 60) -> DataFrame:
    """(id, component) for each vertex of the undirected edges: the smallest vertex that it reaches.

    Large-star and small-star in turn, until each vertex has one edge, to one that has none to a smaller one; nothing is collected
    but whether a vertex is left for which that doesn't hold, once a round. Null ends and loops are dropped; a repeated edge counts once."""
    e = stash(edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        if _stars(e):
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stash(large, "large")
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(root.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = stash(small, "small")
        stash.clear(e, large)
        e = small
    raise RuntimeError(f"no stars after {rounds} rounds")


def _stars(e: DataFrame) -> bool:
    """Whether each vertex of the distinct edges (u, v), v smaller, has one v at most, which has none itself: then that v is the smallest vertex of the component."""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()
