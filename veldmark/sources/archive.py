"""A content-addressed archive: delivered files of any size, hashed in order of their bytes and kept once, under their digest.

A file is read in ranges by one task, which keeps a hash state and one range in memory, and copies as it reads. The copy
gets its name when it is whole, by a move; a file that is there already is not stored again. Files are
opened through Arrow's file systems (local and mounted paths, hdfs, s3, gs).
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = 8 << 20


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a name and its path there. Names of local files are taken as they are, with # and % and blanks."""
    if uri.startswith("file:") or uri.startswith("/"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def ranges(files: fs.FileSystem, path: str, size: int = RANGE) -> Iterator[bytes]:
    """The bytes of a file, range after range."""
    with files.open_input_file(path) as f:
        while part := f.read(size):
            yield part


def files_at(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, bytes and time (ms) of the files at a path (a file, a folder or a pattern), empty ones too (Spark's own file sources leave those out), but not hidden ones."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for s in files.globStatus(at) or []:
        for f in files.listStatus(s.getPath()) if s.isDirectory() else [s]:
            if not f.isDirectory() and not f.getPath().getName().startswith((".", "_")):
                found.append((str(f.getPath()), f.getLen(), f.getModificationTime()))
    return sorted(found)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """file, byte_size and modified_at of the files at a path."""
    return spark.createDataFrame(files_at(spark, path), "file string, byte_size bigint, ms bigint").select("file", "byte_size", F.timestamp_millis("ms").alias("modified_at"))


def _each_file(files: DataFrame, run, schema: str) -> DataFrame:
    """run on every file, one a record, dealt by name."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist([{"file": name} | run(name)])

    return files.select("file").repartition("file").mapInArrow(over, schema)


def digests(files: DataFrame) -> DataFrame:
    """file and sha256 of each file."""

    def digest(name: str) -> dict:
        state = hashlib.sha256()
        for part in ranges(*opened(name)):
            state.update(part)
        return {"sha256": state.hexdigest()}

    return _each_file(files, digest, "file string, sha256 string")


def stored(files: DataFrame, root: str) -> DataFrame:
    """Copies files into the archive below root: file, byte_size, sha256, archived (its path there) and is_new. Written as the rows are read, and again, without harm, if they are read again."""
    root = root.rstrip("/")

    def store(name: str) -> dict:
        files_in, path = opened(name)
        files_out, top = opened(root)
        draft = posixpath.join(top, f".draft-{uuid.uuid4().hex}")
        files_out.create_dir(top, recursive=True)
        state, n = hashlib.sha256(), 0
        try:
            with files_out.open_output_stream(draft) as out:
                for part in ranges(files_in, path):
                    state.update(part)
                    out.write(part)
                    n += len(part)
            digest = state.hexdigest()
            place = posixpath.join(digest[:2], digest)
            known = files_out.get_file_info(posixpath.join(top, place))
            is_new = known.type == fs.FileType.NotFound
            if is_new:  # of two that store the same bytes at once, the second replaces equal with equal
                files_out.create_dir(posixpath.join(top, digest[:2]), recursive=True)
                files_out.move(draft, posixpath.join(top, place))
        finally:
            if files_out.get_file_info(draft).type != fs.FileType.NotFound:
                files_out.delete_file(draft)
        return {"byte_size": n, "sha256": digest, "archived": f"{root}/{place}", "is_new": is_new}

    return _each_file(files, store, "file string, byte_size bigint, sha256 string, archived string, is_new boolean")
