"""A landing directory as a Spark source: a listing in batches, arrivals as a stream whose offset is the file watermark.

``spark.dataSource.register(Landing)``, then ``spark.read.format("landing")`` gives one row a file for
``listing.decide``, and ``spark.readStream.format("landing")`` each file once, in order of (mtime, name). The offset of the stream
is the (mtime, name) of the last file that was taken, so the checkpoint is the watermark. As ``listing.decide`` has it, a new stream starts
at the newest file that is there, files at or below the watermark are not taken again, and files too young or too
large are left; a young one is taken later, a large one stays behind once a newer file is taken.

Options: ``path``, ``names`` (pattern of whole names), ``leastAge`` (seconds), ``mostBytes``, ``maxFiles`` (most files of a listing that come in
one batch; the rest waits). Only regular files count, not links or hidden ones. The directory is listed on the driver; files are
read by whoever reads them, through Spark.
"""

from __future__ import annotations

import os
import re
import stat
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "name string, path string, mtime bigint, size bigint"


class File(InputPartition):
    """One file of a listing."""

    def __init__(self, name: str, path: str, mtime: int, size: int):
        self.name, self.path, self.mtime, self.size = name, path, mtime, size

    @property
    def key(self) -> tuple[int, str]:
        return self.mtime, self.name

    def row(self) -> tuple:
        return self.name, self.path, self.mtime, self.size


class Directory:
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        if not options.get("path"):
            raise ValueError("the option path names the directory")
        self.path = options["path"].removeprefix("file://")
        self.names = re.compile(options.get("names", ".*"))
        self.least_age, self.most_bytes = int(options.get("leastage", 0)), int(options.get("mostbytes", 1 << 62))
        self.max_files = int(options.get("maxfiles", 1000))

    def files(self) -> list[File]:
        """Regular files with a wanted name, in order of time and name; one that goes while it is looked at isn't there."""
        found = []
        with os.scandir(self.path) as entries:
            for e in entries:
                if e.name.startswith(".") or not self.names.fullmatch(e.name):
                    continue
                try:
                    s = e.stat(follow_symlinks=False)
                except FileNotFoundError:
                    continue
                if stat.S_ISREG(s.st_mode):
                    found.append(File(e.name, f"file://{os.path.abspath(e.path)}", int(s.st_mtime), s.st_size))
        return sorted(found, key=lambda f: f.key)

    def fit(self) -> list[File]:
        """Files that are old enough and not too large."""
        now = time.time()
        return [f for f in self.files() if f.mtime + self.least_age <= now and f.size <= self.most_bytes]


class Landing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Listing:
        return Listing(dict(self.options))

    def streamReader(self, schema) -> Arrivals:
        return Arrivals(dict(self.options))


class Listing(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[File]:
        return Directory(self.options).files() or [File("", "", -1, -1)]

    def read(self, file: File) -> Iterator[tuple]:
        if file.mtime >= 0:
            yield file.row()


class Arrivals(DataSourceStreamReader):
    """A reader that goes on from a checkpoint isn't told its offset before it has to name the next one, so it names the newest file, and ``partitions`` cuts what was taken. So the last file taken should stay until a newer one has come."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self._at: tuple[int, str] | None = None

    def _offset(self) -> dict:
        return {"mtime": self._at[0], "name": self._at[1]}

    def initialOffset(self) -> dict:
        """Just before the newest file; before all times where there is none yet."""
        known = Directory(self.options).files()
        self._at = known[-2].key if len(known) > 1 else (-1, "")
        return self._offset()

    def latestOffset(self) -> dict:
        """The last file to take: at most maxFiles behind the offset that was told before."""
        directory = Directory(self.options)
        fit = directory.fit()
        new = fit[-1:] if self._at is None else [f for f in fit if f.key > self._at][: directory.max_files]
        self._at = new[-1].key if new else self._at or (-1, "")
        return self._offset()

    def partitions(self, start: dict, end: dict) -> list[File]:
        low, high = (start["mtime"], start["name"]), (end["mtime"], end["name"])
        return [f for f in Directory(self.options).fit() if low < f.key <= high]

    def read(self, file: File) -> Iterator[tuple]:
        yield file.row()
