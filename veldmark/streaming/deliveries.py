"""Deliveries as a stream: each micro-batch is screened against the state that the one before left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.operators.bundles import latest
from veldmark.operators.delta import beside_state, classified
from veldmark.operators.state import accept


class StateVersions:
    """Versions of a state table below a folder, in buckets of identities. Version n + 1 is written from version n by micro-batch n, and again if the batch is, so a restart changes nothing.

    Only buckets that the batch touches are written; a version is a list of which version each bucket has. The files of a bucket go when no version that can still be read has them: the last two stay.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, buckets: int = 64):
        self.spark, self.root, self.schema, self.buckets = spark, root.rstrip("/"), schema, buckets

    def _parts(self, version: int) -> dict[int, int]:
        """Bucket to the version that wrote it."""
        if version == 0:
            return {}
        return {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket int, version int").json(f"{self.root}/versions/{version}").collect()}

    def _of(self, parts: dict[int, int]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/state/version={v}/bucket={b}" for b, v in sorted(parts.items())))

    def read(self, version: int) -> DataFrame:
        return self._of(self._parts(version))

    def latest(self) -> DataFrame:
        return self.read(self.last())

    def last(self) -> int:
        folder = self._path(f"{self.root}/versions")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        # a list counts once it is whole
        done = [int(f.getPath().getName()) for f in files.listStatus(folder) if files.exists(self._path(f"{f.getPath()}/_SUCCESS"))] if files.exists(folder) else []
        return max(done, default=0)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def advance(self, rows: DataFrame, batch: int, columns: list[str]) -> None:
        """rows: identity_hash, seq and columns; the last of an identity in the batch counts."""
        bucket = F.pmod(F.xxhash64("identity_hash"), F.lit(self.buckets)).cast("int")
        last = latest(rows, ["identity_hash"], F.desc("seq"))
        incoming = f"{self.root}/incoming/batch={batch}"
        last.withColumn("bucket", bucket).write.mode("overwrite").parquet(incoming)
        last = self.spark.read.parquet(incoming)
        parts = self._parts(batch)
        touched = {r["bucket"] for r in last.select("bucket").distinct().collect()}
        old = self._of({b: v for b, v in parts.items() if b in touched})
        classified(beside_state(last.drop("bucket"), old, columns)).write.mode("overwrite").parquet(f"{self.root}/staged/batch={batch}")
        new = accept(old, self.spark.read.parquet(f"{self.root}/staged/batch={batch}"), columns)
        new.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/state/version={batch + 1}")
        now = parts | dict.fromkeys(touched, batch + 1)
        self.spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").json(f"{self.root}/versions/{batch + 1}")
        before = self._parts(batch - 1) if batch > 0 else {}
        for b, v in before.items():
            if parts.get(b) != v and now.get(b) != v:
                p = self._path(f"{self.root}/state/version={v}/bucket={b}")
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def follow(lines: DataFrame, versions: StateVersions, columns: list[str], checkpoint: str):
    """A query that screens and accepts all that is there, once."""
    return lines.writeStream.foreachBatch(lambda rows, batch: versions.advance(rows, batch, columns)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
