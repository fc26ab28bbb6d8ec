"""A folder of paper files as a Spark data source, in batches and as a stream.

    spark.dataSource.register(PaperFolder)
    spark.read.format("paper_folder").load("file:///papers")
    spark.readStream.format("paper_folder").option("path", ...).load()

Rows: paper_id (the name without its suffix, file-safe), path, suffix, size, modified
(microseconds), sha256, content, problem. Files that can't be read, are too small or too large,
or hold broken JSON are rows with a ``problem``. Text is decoded with replacement characters.
A stream goes through files in the order of their times of change (then paths); its offset is
the last one, so a restart goes on after it, and a file that changes comes again.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "paper_id string, path string, suffix string, size bigint, modified bigint, sha256 string, content string, problem string"
TEXT, KEPT = ("txt", "md", "json"), ("pdf",)
#: Files of a task.
FILES = 64


class Files(InputPartition):
    def __init__(self, files: list[tuple[int, str, int]]):
        super().__init__(None)
        self.files = files


def listed(uri: str) -> list[tuple[int, str, int]]:
    """(modified, path, size) of all files under a folder, in order."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else "file://" + uri.removeprefix("file:"))
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(((f.mtime_ns or 0) // 1000, f.path, f.size or 0) for f in found if f.type == fs.FileType.File)


def suffix_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""


def id_of(path: str) -> str:
    stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    return re.sub(r"\.\.+", ".", re.sub(r"[^\w\-.]+", "_", stem)).strip("._")[:64]


def rows_of(uri: str, files: list[tuple[int, str, int]], least: int, most: int) -> Iterator[tuple]:
    from pyarrow import fs

    system, _ = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else "file://" + uri.removeprefix("file:"))
    for modified, path, size in files:
        suffix, digest, content, problem = suffix_of(path), None, None, None
        if suffix not in (*TEXT, *KEPT):
            problem = "suffix"
        elif not least <= size <= most:
            problem = "size"
        else:
            try:
                with system.open_input_stream(path) as f:
                    data = f.read()
                digest = hashlib.sha256(data).hexdigest()
                if suffix in TEXT:
                    content = data.decode("utf-8", "replace")
                if suffix == "json":
                    json.loads(content)
            except ValueError:
                problem = "json"
            except OSError as e:
                problem = f"unreadable: {e}"[:160]
        yield id_of(path), path, suffix, size, modified, digest, content, problem


class _Options:
    def __init__(self, options: dict[str, str]):
        self.uri = options.get("path") or ""
        if not self.uri:
            raise ValueError("a path is needed")
        self.least, self.most = int(options.get("least", 10)), int(options.get("most", 20 << 20))
        self.per_trigger = int(options.get("maxFilesPerTrigger", 1024))


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o, self.suffixes, self.ids = _Options(options), None, None

    def partitions(self) -> list[Files]:
        found = [f for f in listed(self.o.uri) if (self.suffixes is None or suffix_of(f[1]) in self.suffixes) and (self.ids is None or id_of(f[1]) in self.ids)]
        return [Files(found[i : i + FILES]) for i in range(0, len(found), FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows_of(self.o.uri, partition.files, self.o.least, self.o.most)


class FilteredReader(FolderReader):
    """Equality on suffix and paper_id rules files out before they are opened. Spark asks for the
    option ``pushdown`` and spark.sql.python.filterPushdown.enabled, both true."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("suffix",):
                self.suffixes = values if self.suffixes is None else self.suffixes & values
            elif values is not None and f.attribute == ("paper_id",):
                self.ids = values if self.ids is None else self.ids & values
            else:
                yield f


class FolderStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.o, self.last = _Options(options), None

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        at = self.last or (-1, "")
        new = [f for f in listed(self.o.uri) if (f[0], f[1]) > at][: self.o.per_trigger]
        self.last = (new[-1][0], new[-1][1]) if new else at
        return {"modified": self.last[0], "path": self.last[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((o["modified"], o["path"]) for o in (start, end))
        self.last = max(self.last or (-1, ""), high)
        found = [f for f in listed(self.o.uri) if low < (f[0], f[1]) <= high]
        return [Files(found[i : i + FILES]) for i in range(0, len(found), FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows_of(self.o.uri, partition.files, self.o.least, self.o.most)

    def commit(self, end: dict) -> None:
        self.last = max(self.last or (-1, ""), (end["modified"], end["path"]))

    def stop(self) -> None:
        pass


class PaperFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paper_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return (FilteredReader if str(self.options.get("pushdown")).lower() == "true" else FolderReader)(self.options)

    def streamReader(self, schema) -> FolderStream:
        return FolderStream(self.options)
