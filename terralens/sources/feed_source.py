"""A Python data source for feeds: one partition a file in batch, conditional polls in a stream.

``spark.dataSource.register(FeedSource)``, then ``spark.read.format("terralens_feed").load(path)`` or
``spark.readStream.format("terralens_feed").load(path)``. A stream's offset holds each file's state (size and time of
change); a poll in which none has changed gives no rows, and a changed file is read again as a whole, so that the
insert-if-absent sink decides what is new. The driver only lists files; each is read and parsed by the task of its
partition. Paths may be local or those of any file system that ``pyarrow.fs`` knows (``hdfs://``, ``s3://``, ``gs://``).
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from terralens.sources.files import ITEM, feed_instant, parse_feed

FIELDS = ("external_id", "title", "body", "url", "published")


def _listed(options) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The files of a folder, of a pattern in one, or the one file, by path."""
    system, path = fs.FileSystem.from_uri(options.get("path", "")) if "://" in options.get("path", "") else (fs.LocalFileSystem(), options.get("path", ""))
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return system, [info]
    folder, name = (path, "*") if info.type == fs.FileType.Directory else posixpath.split(path)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return system, sorted((f for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, name)), key=lambda f: f.path)


def _rows(options, path: str) -> Iterator[tuple]:
    uri = options.get("path", "")
    system = fs.FileSystem.from_uri(uri)[0] if "://" in uri else fs.LocalFileSystem()
    with system.open_input_stream(path) as f:
        for item in parse_feed(f.read()):
            yield (path, *(item[k] for k in FIELDS), feed_instant(item["published"]))


class FilePartition(InputPartition):
    """One file."""

    def __init__(self, path: str):
        self.path = path


class FeedReader(DataSourceReader):
    """All files once."""

    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [FilePartition(f.path) for f in _listed(self.options)[1]]

    def read(self, partition):
        yield from _rows(self.options, partition.path)


class FeedStreamReader(DataSourceStreamReader):
    """Files that changed since the last offset, a partition each."""

    def __init__(self, options):
        self.options = options

    def initialOffset(self):
        return {"files": "{}"}

    def latestOffset(self):
        return {"files": json.dumps({f.path: f"{f.size}:{f.mtime_ns}" for f in _listed(self.options)[1]}, sort_keys=True)}

    def partitions(self, start, end):
        before, now = json.loads(start["files"]), json.loads(end["files"])
        return [FilePartition(p) for p, s in sorted(now.items()) if before.get(p) != s]

    def read(self, partition):
        yield from _rows(self.options, partition.path)


class FeedSource(DataSource):
    """RSS and Atom files at ``path`` (a file, a folder or a pattern)."""

    @classmethod
    def name(cls):
        return "terralens_feed"

    def schema(self):
        return ITEM + ", published_s bigint"

    def reader(self, schema):
        return FeedReader(self.options)

    def streamReader(self, schema):
        return FeedStreamReader(self.options)
