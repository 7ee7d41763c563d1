"""A folder of uploads as a data source, for batches and streams, that never reads more of a file than its cap.

Register it with ``spark.dataSource.register(Uploads)``, then ``spark.read.format("uploads")`` or ``spark.readStream.format("uploads")``. Options:

* ``path``: a folder, or a URI of any file system that Arrow reads; executors read it, so all must see it;
* ``most_bytes``: the cap (10 MB);
* ``suffixes``: which names are taken, e.g. ``.pdf,.png``; empty: all;
* ``files_a_task``: files that a task reads (64).

A file is read in pieces of 64 KiB and hashed on the way; beyond the cap reading stops, and its hash and content are null. Columns: path, modified (microseconds), length (as the folder
says), bytes_read, file_hash, content, too_large. A file that is gone when it is read gives no row.

A stream's offset is the newest file that was seen, by time and then by path, so a restart goes on behind it; files that get older times than that are not seen, nor are changed ones seen twice under one time. A poll lists the folder on the driver, one entry a file, and
sends only the new ones' paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow.fs as fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PIECE = 64 * 1024
MOST_BYTES = 10 * 1024 * 1024
SCHEMA = "path string, modified long, length long, bytes_read long, file_hash string, content binary, too_large boolean"


class Files(InputPartition):
    """Files that one task reads: (path, modified, length)."""

    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class _Folder:
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.most = int(options.get("most_bytes", MOST_BYTES))
        self.suffixes = tuple(s.strip().lower() for s in options.get("suffixes", "").split(",") if s.strip())
        self.each = max(1, int(options.get("files_a_task", 64)))

    def system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def listed(self) -> list[tuple[str, int, int]]:
        """Files by time, then path."""
        system, base = self.system()
        found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        taken = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")) and (not self.suffixes or f.base_name.lower().endswith(self.suffixes))]
        return sorted(((f.path, (f.mtime_ns or 0) // 1000, f.size or 0) for f in taken), key=lambda f: (f[1], f[0]))

    def parted(self, files: list[tuple[str, int, int]]) -> list[Files]:
        return [Files(files[i : i + self.each]) for i in range(0, len(files), self.each)]

    def rows(self, partition: Files) -> Iterator[tuple]:
        system, _ = self.system()
        for path, modified, length in partition.files:
            try:
                source = system.open_input_stream(path)
            except FileNotFoundError:
                continue
            digest, pieces, read = hashlib.sha256(), [], 0
            with source:
                while read <= self.most and (piece := source.read(PIECE)):
                    read += len(piece)
                    digest.update(piece)
                    pieces.append(piece)
            over = read > self.most
            yield (path, modified, length, read, None if over else digest.hexdigest(), None if over else b"".join(pieces), over)


class UploadsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = _Folder(options)

    def partitions(self) -> list[Files]:
        return self.folder.parted(self.folder.listed()) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from self.folder.rows(partition)


class UploadsStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder = _Folder(options)

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self.folder.listed()
        return {"modified": files[-1][1], "path": files[-1][0]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        first, last = (start["modified"], start["path"]), (end["modified"], end["path"])
        return self.folder.parted([f for f in self.folder.listed() if first < (f[1], f[0]) <= last]) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from self.folder.rows(partition)


class Uploads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "uploads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> UploadsReader:
        return UploadsReader(dict(self.options))

    def streamReader(self, schema) -> UploadsStream:
        return UploadsStream(dict(self.options))
