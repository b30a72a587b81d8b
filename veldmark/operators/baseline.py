"""Versions of the accepted tables: state, observations, references and cases move forward together or not at all.

A version is one small manifest that names, for each table, the segments which make it up;
rows of a later segment replace those of equal key in earlier ones. A new version writes
segments of what changed only, and is there once its manifest has been renamed to its number. The rename
doesn't replace, so of two writers that started from one version the second is refused: a
publication is a compare-and-swap on the version that was read. (HDFS and object stores with such
a rename do that in one step, as Spark's own streaming logs need it; a local disk in two, for tests.)

Segments of like size are merged as they come, so a table of n rows has about log(n) of them and
each row is rewritten about as often. Tables whose rows are only ever added are read and merged without a shuffle. Nothing is updated in place: a crash between any two writes leaves the
version before, and files that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.functions import fingerprint as fp

#: Tables that are written at the same time.
AT_ONCE = 4


@dataclass(frozen=True)
class Kept:
    """A table of the baseline: its schema and the columns that name a row.

    digests: columns of hashes in hex, which travel as bytes when segments are merged. added: no key comes in two versions, so rows replace none.
    """

    schema: str
    keys: tuple[str, ...]
    digests: tuple[str, ...] = ()
    added: bool = False


class VersionTaken(RuntimeError):
    """Another version was published since the one that this was worked out from."""

    def __init__(self, base: int):
        super().__init__(f"version {base + 1} is there already; start again from the last one")
        self.base = base


class Baseline:
    """Tables below root, in versions from 0 (empty) on."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Kept]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self, name: str):
        return self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path("versions")
        files = self._files("versions")
        names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def last(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict[str, list[dict]]:
        """Segments (path, version, rows) of each table, the oldest first."""
        if version == 0:
            return {t: [] for t in self.tables}
        text = self.spark.read.text(f"{self.root}/versions/{version:08d}.json", wholetext=True).head()[0]
        return {t: [] for t in self.tables} | json.loads(text)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self._merged(table, self.manifest(self.last() if version is None else version)[table])

    def _segment(self, table: str, *segments: dict) -> DataFrame:
        return self.spark.read.schema(self.tables[table].schema).parquet(*(f"{self.root}/{s['path']}" for s in segments))

    def _merged(self, table: str, segments: list[dict], keyed: bool = True) -> DataFrame:
        """The rows of segments. keyed: keys stay as they are, so that a join by them goes on with their shuffle."""
        if not segments:
            return self.spark.createDataFrame([], self.tables[table].schema)
        kept = self.tables[table]
        if len(segments) == 1 or kept.added:
            return self._segment(table, *segments)
        first, keys = self._segment(table, segments[0]), list(kept.keys)
        packed = [c for c in kept.digests if not (keyed and c in keys)]
        rest = [c for c in first.columns if c not in keys]
        rows = None
        for n, s in enumerate(segments):
            own = self._segment(table, s).withColumns({c: fp.packed(F.col(c)) for c in packed}).withColumn("__age", F.lit(n))
            rows = own if rows is None else rows.unionByName(own)
        # rows of one key: as many as there are segments, and tasks send the newest of theirs
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__age").alias("__row"))
        values = {c: F.col(c) if c in keys else F.col("__row")[c] for c in first.columns}
        return newest.select(*((fp.unpacked(v) if c in packed else v).alias(c) for c, v in values.items()))

    def publish(self, base: int, changes: dict[str, DataFrame]) -> int:
        """The version after base, with new and replacing rows (one a key) of some tables; VersionTaken where it was published meanwhile."""
        if base != self.last():
            raise VersionTaken(base)
        manifest, version = self.manifest(base), base + 1

        def extended(table: str) -> list[dict]:
            segment = self._write(table, changes[table], version)
            return self._settled(table, [*manifest[table], segment], version) if segment["rows"] else manifest[table]

        with ThreadPoolExecutor(AT_ONCE) as writers:  # small jobs of several tables share the cluster
            segments = dict(zip(changes, writers.map(extended, changes), strict=True))
        self._name(manifest | segments, base)
        return version

    def _write(self, table: str, rows: DataFrame, version: int, merged: bool = False) -> dict:
        """A segment of rows. merged: they come from segments, so their keys were looked at before."""
        segment = {"path": f"data/{table}/{version:08d}-{uuid.uuid4().hex}", "version": version}
        kept = self.tables[table]
        types = {f.name: f.dataType for f in self.spark.createDataFrame([], kept.schema).schema}
        rows.select(*(F.col(c).cast(t).alias(c) for c, t in types.items())).write.option("compression", "zstd").parquet(f"{self.root}/{segment['path']}")
        written = self._segment(table, segment)
        if merged:
            return segment | {"rows": written.count()}
        # hashes of keys travel; where two are equal, the keys themselves tell
        times = written.select(F.xxhash64(*kept.keys).alias("h")).groupBy("h").count()
        n, suspect = times.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count_if(F.col("count") > 1)).head()
        if suspect and (twice := written.groupBy(*kept.keys).count().where("count > 1").count()):
            raise ValueError(f"{table}: {twice} keys come more than once")
        return segment | {"rows": n}

    def _settled(self, table: str, segments: list[dict], version: int) -> list[dict]:
        """Segments, the last of them merged with those before that aren't more than twice as large."""
        take, total = 1, segments[-1]["rows"]
        while take < len(segments) and segments[-take - 1]["rows"] <= 2 * total:
            take += 1
            total += segments[-take]["rows"]
        return segments if take == 1 else [*segments[:-take], self._write(table, self._merged(table, segments[-take:], keyed=False), version, True)]

    def _name(self, manifest: dict, base: int) -> None:
        """The manifest comes to its number, unless that is taken."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        draft, final = self._path(f"versions/.draft-{uuid.uuid4().hex}"), self._path(f"versions/{base + 1:08d}.json")
        out = self._files("versions").create(draft, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf)
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, plain)
        except Exception as e:
            self._files("versions").delete(draft, False)
            if "FileAlreadyExistsException" in str(e):
                raise VersionTaken(base) from None
            raise

    def prune(self, keep: int = 2) -> int:
        """Delete all but the last versions, and the segments that only they name; how many segments that were. Readers of older versions must have ended; segments of a publication under way are newer than the last version and stay."""
        known = self.versions()
        gone, stay = known[:-keep], known[-keep:]
        named = {s["path"] for v in stay for segments in self.manifest(v).values() for s in segments}
        old = {s["path"] for v in gone for segments in self.manifest(v).values() for s in segments} - named
        for v in gone:
            self._files("versions").delete(self._path(f"versions/{v:08d}.json"), False)
        for p in old:
            self._files("data").delete(self._path(p), True)
        return len(old)


def touched(rows: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows that changes bear on."""
    return rows.join(changes.select(*keys).distinct(), list(keys), "left_semi")
