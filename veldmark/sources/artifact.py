"""A sink for published artifacts: ordered pages of lines whose bytes, in order, have one SHA-256.

``lines.repartitionByRange("ordinal").sortWithinPartitions("ordinal").write.format("artifact")`` with the options ``path`` (a new folder),
``sealed`` (the hash that was promised, if any) and ``deadline`` (seconds since 1970, if any). Tasks write one page each beside the
path and tell its range, bytes and hash. The commit puts pages in order, refuses ranges that overlap, reads the bytes once in order (one range
in memory) and compares with what was sealed; only then the folder gets its name. What fails, comes too late or has other content is
aborted and leaves nothing: the driver makes the draft's folder with a mark in it, and a task that finds no mark (the write was aborted while it ran)
takes its page away and fails. Pages of attempts that were repeated are no part of the commit and go.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .archive import opened, ranges

MANIFEST = "_artifact.json"
OPEN = "_open"


@dataclass
class Page(WriterCommitMessage):
    name: str
    first: int
    last: int
    rows: int
    bytes: int
    sha256: str


class Artifact(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifact"

    def schema(self) -> str:
        return "ordinal bigint, line string"

    def writer(self, schema: StructType, overwrite: bool) -> Pages:
        pages = Pages({k.lower(): v for k, v in self.options.items()})
        pages.begin()
        return pages


class Pages(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.sealed, self.deadline = options.get("sealed"), float(options.get("deadline", "inf"))
        self.draft = f"{self.path}.draft-{uuid.uuid4().hex}"

    def _in_time(self) -> None:
        if time.time() > self.deadline:
            raise TimeoutError("PUBLICATION_TIMEOUT: the attempt came too late and is aborted")

    def begin(self) -> None:
        files, top = opened(self.draft)
        files.create_dir(top, recursive=True)
        files.open_output_stream(posixpath.join(top, OPEN)).close()

    def _open(self, files: fs.FileSystem, top: str) -> None:
        if files.get_file_info(posixpath.join(top, OPEN)).type == fs.FileType.NotFound:
            raise RuntimeError(f"ARTIFACT_ABORTED: {self.path}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Page:
        files, top = opened(self.draft)
        self._open(files, top)
        page = Page(f"page-{uuid.uuid4().hex}", 0, 0, 0, 0, "")
        try:
            self._fill(files, posixpath.join(top, page.name), page, iterator)
            self._open(files, top)
        except BaseException:
            self._take_away(files, top, page.name)
            raise
        return page

    def _fill(self, files: fs.FileSystem, path: str, page: Page, iterator: Iterator[pa.RecordBatch]) -> None:
        state = hashlib.sha256()
        with files.open_output_stream(path) as out:  # makes no folder, but in stores that know none
            for batch in iterator:
                self._in_time()
                if not batch.num_rows:
                    continue
                order = batch.column(batch.schema.get_field_index("ordinal")).to_numpy(zero_copy_only=False)
                if (order[1:] <= order[:-1]).any() or (page.rows and order[0] <= page.last):
                    raise ValueError("lines of a page must come in order of ordinal, each once")
                page.first = page.first if page.rows else int(order[0])
                page.last, page.rows = int(order[-1]), page.rows + batch.num_rows
                lines = pc.fill_null(batch.column(batch.schema.get_field_index("line")), "")
                part = ("\n".join(lines.to_pylist()) + "\n").encode()
                state.update(part)
                out.write(part)
                page.bytes += len(part)
        page.sha256 = state.hexdigest()

    def _take_away(self, files: fs.FileSystem, top: str, name: str) -> None:
        """The page, and the draft's folder where an abort has gone before."""
        if files.get_file_info(posixpath.join(top, name)).type != fs.FileType.NotFound:
            files.delete_file(posixpath.join(top, name))
        if files.get_file_info(posixpath.join(top, OPEN)).type == fs.FileType.NotFound:
            self.abort([])

    def commit(self, messages: list[Page | None]) -> None:
        self._in_time()
        files, top = opened(self.draft)
        final = opened(self.path)[1]
        pages = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.first)
        for a, b in zip(pages, pages[1:]):
            if a.last >= b.first:
                raise ValueError("pages overlap: deal the lines by ranges of ordinal")
        if files.get_file_info(final).type != fs.FileType.NotFound:
            raise FileExistsError(f"ARTIFACT_EXISTS: {self.path}")
        files.create_dir(top, recursive=True)
        keep = {OPEN, *(p.name for p in pages)}  # without the mark, an attempt that still runs would take this for an abort
        for left in files.get_file_info(fs.FileSelector(top)):  # of attempts that were repeated, and empty ones
            if left.base_name not in keep:
                files.delete_file(left.path)
        state = hashlib.sha256()
        for n, p in enumerate(pages):
            for part in ranges(files, posixpath.join(top, p.name)):
                state.update(part)
            files.move(posixpath.join(top, p.name), posixpath.join(top, f"page-{n:06d}"))
        digest = state.hexdigest()
        if self.sealed and digest != self.sealed:
            raise ValueError(f"ARTIFACT_CONTENT_CHANGED: {digest} instead of {self.sealed}")
        told = {"sha256": digest, "bytes": sum(p.bytes for p in pages), "rows": sum(p.rows for p in pages), "pages": [{"name": f"page-{n:06d}", "rows": p.rows, "bytes": p.bytes, "sha256": p.sha256} for n, p in enumerate(pages)]}
        with files.open_output_stream(posixpath.join(top, MANIFEST)) as out:
            out.write(json.dumps(told).encode())
        self._in_time()
        files.move(top, final)
        with contextlib.suppress(OSError):  # published already
            files.delete_file(posixpath.join(final, OPEN))

    def abort(self, messages: list[Page | None]) -> None:
        files, top = opened(self.draft)
        for left in reversed(range(10)):  # a task that still runs may add its page meanwhile, or take it away
            try:
                if files.get_file_info(top).type == fs.FileType.NotFound:
                    return
                if files.get_file_info(posixpath.join(top, OPEN)).type != fs.FileType.NotFound:
                    files.delete_file(posixpath.join(top, OPEN))
                files.delete_dir(top)
            except OSError:
                if not left:
                    raise
                time.sleep(0.1)


def write_artifact(lines: DataFrame, path: str, sealed: str | None = None, seconds: float | None = None) -> dict:
    """Write lines (ordinal, line) as an artifact, and tell its manifest. seconds: how long the attempt may take."""
    lines.sparkSession.dataSource.register(Artifact)
    out = lines.select("ordinal", "line").repartitionByRange("ordinal").sortWithinPartitions("ordinal").write.format("artifact").mode("append").option("path", path)
    if sealed is not None:
        out = out.option("sealed", sealed)
    if seconds is not None:
        out = out.option("deadline", str(time.time() + seconds))
    out.save()
    return manifest(lines.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> dict:
    files, top = opened(path.rstrip("/"))
    with files.open_input_file(posixpath.join(top, MANIFEST)) as f:
        return json.loads(f.read())
