"""Files of values as a data source: ``df.write.format("artifacts")`` and ``spark.read.format("artifacts")``.

Writing takes rows (path, content, sidecar), paths below the folder named by ``path``. Each task writes into a folder of its
attempt; when all tasks are done the files of those that succeeded are moved to their places, with their sidecars
(``<path>.json``) behind them, and the rest goes. So a task that runs twice changes nothing, and a job that fails leaves
no file. Reading gives path, bytes, sha256 and content of all files below a folder; with ``content`` "false" they are
digested piece by piece and not held. Any file system that Arrow reaches will do: mounted folders, HDFS, object stores.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

ATTEMPTS = ".attempts"
#: Files whose bytes are read at once, and files of one reading task.
PIECE, FILES = 1 << 20, 256


def filesystem(base: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a folder, its path there, and what goes before such paths in references."""
    system, path = fs.FileSystem.from_uri(base if "://" in base or base.startswith("/") else posixpath.abspath(base))
    scheme = base.partition("://")[0] if "://" in base else "file"
    return system, path.rstrip("/"), "" if scheme == "file" else f"{scheme}://"


def read_bytes(path: str) -> bytes:
    """The content of one file, by its reference's path."""
    system, own, _ = filesystem(path)
    with system.open_input_stream(own) as f:
        return f.read()


def dumped(writer: Callable, value: Any, options: dict[str, Any]) -> bytes:
    """What a writer of files makes of a value."""
    with tempfile.TemporaryDirectory() as folder:
        path = f"{folder}/value"
        writer(value, path, **options)
        with open(path, "rb") as f:
            return f.read()


def loaded(reader: Callable, content: bytes) -> Any:
    """What a reader of files makes of a file's content."""
    with tempfile.TemporaryDirectory() as folder:
        path = f"{folder}/value"
        with open(path, "wb") as f:
            f.write(content)
        return reader(path)


@dataclass
class Attempt(WriterCommitMessage):
    """The folder in which a task that succeeded left its files and the list of their places."""

    folder: str


class Writer(DataSourceArrowWriter):
    def __init__(self, base: str):
        self.base, self.job = base, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        system, base, _ = filesystem(self.base)
        task = TaskContext.get()
        folder = f"{base}/{ATTEMPTS}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        system.create_dir(folder)
        places = []
        for batch in iterator:
            for path, content, sidecar in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "sidecar")), strict=True):
                to = posixpath.normpath(filesystem(path)[1])
                if not to.startswith(f"{base}/"):
                    raise ValueError(f"{path} is not below {self.base}")
                for text, end in ((content, ""), (None if sidecar is None else sidecar.encode(), ".json")):
                    if text is not None:
                        own = f"{folder}/{len(places)}"
                        with system.open_output_stream(own) as f:
                            f.write(text)
                        places.append((own, to + end))
        with system.open_output_stream(f"{folder}/places") as f:
            f.write(json.dumps(places).encode())
        return Attempt(folder)

    def commit(self, messages: list[Attempt | None]) -> None:
        system, base, _ = filesystem(self.base)

        def moved(message: Attempt) -> None:
            with system.open_input_stream(f"{message.folder}/places") as f:
                places = json.loads(f.read())
            for folder in {posixpath.dirname(to) for _, to in places}:
                system.create_dir(folder)
            for own, to in places:
                system.move(own, to)

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(moved, [m for m in messages if m is not None]))
        self._clear(system, base)

    def abort(self, messages: list[Attempt | None]) -> None:
        system, base, _ = filesystem(self.base)
        self._clear(system, base)

    def _clear(self, system: fs.FileSystem, base: str) -> None:
        """The job's folder, and that of all jobs when it was the last."""
        for folder, whole in ((f"{base}/{ATTEMPTS}/{self.job}", True), (f"{base}/{ATTEMPTS}", False)):
            if system.get_file_info(folder).type == fs.FileType.Directory and (whole or not system.get_file_info(fs.FileSelector(folder))):
                system.delete_dir(folder)


@dataclass
class Files(InputPartition):
    paths: list[str]


class Reader(DataSourceReader):
    def __init__(self, base: str, content: bool):
        self.base, self.content = base, content

    def partitions(self) -> list[Files]:
        system, base, _ = filesystem(self.base)
        found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        paths = sorted(f.path for f in found if f.type == fs.FileType.File and f"/{ATTEMPTS}/" not in f.path)
        return [Files(paths[k : k + FILES]) for k in range(0, len(paths), FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _, before = filesystem(self.base)
        for path in partition.paths:
            digest, size, parts = hashlib.sha256(), 0, []
            with system.open_input_stream(path) as f:
                while piece := f.read(PIECE):
                    digest.update(piece)
                    size += len(piece)
                    if self.content:
                        parts.append(piece)
            yield f"{before}{path}", size, digest.hexdigest(), b"".join(parts) if self.content else None


class Artifacts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return "path string, bytes long, sha256 string, content binary"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.options.get("content", "true") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def use_artifacts(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(Artifacts)
