"""Files of bytes as a data source: read in partitions of about equal bytes, written by tasks on their own and put in place together.

    spark.dataSource.register(FileBytes)
    spark.read.format("file_bytes").load(folder)                      # path, bytes, content, error
    pages.write.format("file_bytes").mode("append").save(folder)      # from file_name, content and maybe error

Folders are local paths or URIs that Arrow opens (file, s3, gs, abfs, hdfs); on a cluster all machines have to share them.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "path string, bytes long, content binary, error string"
WRITTEN = "file_name string, bytes long, error string"
#: Bytes of a partition, and what opening a file counts for.
PARTITION, OPENING = 128 << 20, 4 << 20
MOVED_AT_ONCE = 16


def _opened(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _why(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:200]


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


class FileReader(DataSourceReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def partitions(self) -> list[Files]:
        """Files in the order of their paths, as many to a partition as ``most`` bytes allow, one at least. Names that begin with _ or . don't count."""
        from pyarrow import fs

        store, top = _opened(self.folder)
        shown = lambda p: not any(x[:1] in "._" for x in posixpath.relpath(p, top).split("/"))
        found = sorted((i.path, i.size) for i in store.get_file_info(fs.FileSelector(top, recursive=True)) if i.type == fs.FileType.File and shown(i.path))
        parts, room = [], 0
        for path, size in found:
            cost = size + OPENING
            if not parts or cost > room:
                parts.append(Files([]))
                room = self.most
            parts[-1].paths.append((path, size))
            room -= cost
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = _opened(self.folder)
        for path, size in partition.paths:
            try:
                with store.open_input_file(path) as f:
                    yield path, size, f.readall(), None
            except OSError as e:
                yield path, size, None, _why(e)


@dataclass
class Staged(WriterCommitMessage):
    """Where a task has put its files, how many, and the list of them."""

    folder: str
    files: int


class FileWriter(DataSourceArrowWriter):
    """Each attempt of a task writes to a folder of its own; the files of those that count are then moved in place, and the list of all rows after them.

    An attempt that fails, or isn't counted, leaves nothing behind, as the job's temporary folder goes in the end. A row without content or name is
    an error in the list, and the others go on; of rows with one name that of the last partition stays, and so does the newer of two exports.
    """

    def __init__(self, folder: str, job: str):
        self.folder, self.job = folder, job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, top = _opened(self.folder)
        own = f"{top}/_temporary/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(f"{own}/files", recursive=True)
        told, files = [], 0
        for batch in iterator:
            names = batch.schema.names
            if "file_name" not in names or "content" not in names:
                raise ValueError("columns file_name and content are needed")
            reasons = batch.column("error").to_pylist() if "error" in names else [None] * batch.num_rows
            for i, (name, error) in enumerate(zip(batch.column("file_name").to_pylist(), reasons, strict=True)):
                content = batch.column("content")[i].as_py()
                plain = posixpath.basename(name or "")
                if content is None or not plain or plain[0] in "._":
                    told.append({"file_name": name, "bytes": None, "error": error or ("no content" if plain else "no name")})
                    continue
                with store.open_output_stream(f"{own}/files/{plain}") as f:
                    f.write(content)
                told.append({"file_name": name, "bytes": len(content), "error": error})
                files += 1
        with store.open_output_stream(f"{own}/list") as f:
            f.write("".join(json.dumps(t) + "\n" for t in told).encode())
        return Staged(own, files)

    def commit(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        store, top = _opened(self.folder)
        for n, m in enumerate(m for m in messages if m):
            if m.files:
                # One task's files at a time, several of them at once.
                own = store.get_file_info(fs.FileSelector(f"{m.folder}/files"))
                with ThreadPoolExecutor(MOVED_AT_ONCE) as pool:
                    list(pool.map(lambda i: store.move(i.path, f"{top}/{i.base_name}"), own))
            store.create_dir(f"{top}/_written/{self.job}", recursive=True)
            store.move(f"{m.folder}/list", f"{top}/_written/{self.job}/part-{n:05d}.json")
        self._swept(store, top)

    def abort(self, messages: list[Staged | None]) -> None:
        self._swept(*_opened(self.folder))

    def _swept(self, store, top: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{top}/_temporary/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{top}/_temporary/{self.job}")


class FileBytes(DataSource):
    """Options: path, partition_bytes when reading, job (a name for the list of what is written) when writing."""

    @classmethod
    def name(cls) -> str:
        return "file_bytes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileReader:
        return FileReader(self.options["path"], int(self.options.get("partition_bytes", PARTITION)))

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files are added to a folder; use append")
        return FileWriter(self.options["path"], self.options.get("job") or uuid.uuid4().hex)


def read_files(spark: SparkSession, folder: str, partition_bytes: int = PARTITION) -> DataFrame:
    """path, bytes, content and error (then content is null) of all files below a folder; none: no rows."""
    spark.dataSource.register(FileBytes)
    return spark.read.format("file_bytes").option("partition_bytes", partition_bytes).load(folder)


def write_files(files: DataFrame, folder: str, name_col: str = "file_name", content_col: str = "content", error_col: str | None = None) -> DataFrame:
    """Puts each row's bytes under its name into ``folder``; returns file_name, bytes, error, a row for each row. Files appear when all are written.

    Rows without content or name have an error (that in ``error_col`` if there is one) and no file. Names count without their folders, and those that begin
    with _ or . are none. Repeated names: one file stays. An empty table gives no rows.
    """
    spark = files.sparkSession
    spark.dataSource.register(FileBytes)
    job = uuid.uuid4().hex
    error = F.col(error_col) if error_col else F.lit(None)
    ready = files.select(F.col(name_col).cast("string").alias("file_name"), F.col(content_col).cast("binary").alias("content"), error.cast("string").alias("error"))
    ready.write.format("file_bytes").mode("append").option("job", job).save(folder)
    store, top = _opened(folder)
    from pyarrow import fs

    if store.get_file_info(f"{top}/_written/{job}").type == fs.FileType.NotFound:
        return spark.createDataFrame([], WRITTEN)
    return spark.read.schema(WRITTEN).json(f"{folder.rstrip('/')}/_written/{job}")
