"""Intermediate tables in the cluster's shared folder, and keys of rows."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset and the master is local (tests), a temporary one. On a cluster a machine's own folder would scatter the tables, so there it is an error."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="veldmark-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: For texts, whose batches of 10,000 rows a worker would hold beside its arrays.
SMALL_BATCH = "2m"


class Workspace:
    """Written tables of one operator call: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/veldmark/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{label}"

    def write(self, df: DataFrame, label: str, batch: str | None = None) -> DataFrame:
        """batch: how much goes to Python at once, instead of what the session says."""
        path = self.path(label)
        before = self.spark.conf.get(BATCH, None)
        if batch:
            self.spark.conf.set(BATCH, batch)
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            if batch:
                self.spark.conf.unset(BATCH) if before is None else self.spark.conf.set(BATCH, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._veldmark_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(t._veldmark_path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession, unused_seconds: int = 7 * 24 * 3600) -> int:
    """Delete the tables of operator calls that were last written so long ago, and tell how many calls that were. Results are read lazily, so what a call wrote last can't go with the call."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/veldmark")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [f.getPath() for f in files.listStatus(folder) if f.getModificationTime() < (time.time() - unused_seconds) * 1000] if files.exists(folder) else []
    for p in old:
        files.delete(p, True)
    return len(old)


def row_keys(id_col: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that name a row by its id and text. Equal rows have equal keys, and want equal answers."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(id_col, text).alias("k1"), F.xxhash64(text, F.lit("veldmark"), id_col).alias("k2")


def whole_row_key(rows: DataFrame) -> Column:
    """64 bits of all columns of a row (maps, which have no order, left out): an order between rows that are equal elsewhere."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in rows.schema if not f.dataType.simpleString().startswith("map")))


#: A key is hot with more rows than this, and more than one in HOT_SHARE of all: so there are at most HOT_SHARE hot keys.
HOT_ROWS, HOT_SHARE = 256, 10_000


def hot_bound(n_rows: int) -> int:
    return max(HOT_ROWS, n_rows // HOT_SHARE)


def left_join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """left joined with right, whose key is unique. Rows of hot keys of left meet their few rows of right by broadcast, so that none of them wait in one task; left is read more than once and should be a written table."""
    counts = left.groupBy(key).count()
    bound = hot_bound(left.count())
    hot = counts.where((F.col("count") > bound) & F.col(key).isNotNull()).select(key)
    if not (names := hot.limit(HOT_SHARE).collect()):
        return left.join(right, key, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(names, hot.schema))
    rest = left.join(hot, key, "left_anti").join(right, key, how)
    return rest.unionByName(left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, how))
