"""Real files from a table of (name, content): a batch writer on the Python data source interface.

Every attempt of a task writes into a folder of its own, ``<path>/<run>/part-<random>``, with at most
``FILES_PER_FOLDER`` files in a folder below it, and a list of what it wrote beside them. Nothing is
renamed or moved, so object stores will do. When all tasks have ended the parts that count are
named in ``<path>/<run>/_run.json``: folders of attempts that do not count are deleted, and a run
whose job fails is deleted as a whole. So a task that runs twice leaves no double, and a run is
either listed completely or not there.

``content`` is text or bytes; a null content makes an empty file. Names may have folders in them
(``page/article.md``) but must be relative and must not lead out; else the job fails. The writer
does not look for names that several rows share; ``repeated_names`` tells them from the list.
An empty table makes a run without parts.
"""

from __future__ import annotations

import hashlib
import io
import json
import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FILES_PER_FOLDER = 10_000
_LISTED = 10_000  # entries of the list kept in memory
# What a task reads back of a run, and what of it is handed on at once.
_TASK_BYTES, _TASK_FILES, _BATCH_BYTES = 16 << 20, 4_000, 8 << 20
LIST_SCHEMA = pa.schema(
    [("name", pa.string()), ("file", pa.string()), ("size", pa.int64()), ("md5", pa.string())]
)
_LIST = "listing.parquet"
_RUN = "_run.json"


def _opened(address: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of an address; a bare path is local."""
    if address.startswith("file:"):
        address = "/" + address[len("file:") :].lstrip("/")
    if "://" not in address:
        return pafs.LocalFileSystem(), address
    return pafs.FileSystem.from_uri(address)


@dataclass
class Part(WriterCommitMessage):
    """What a task reports: its folder's name, its files and their bytes."""

    folder: str
    files: int
    size: int


class FileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = f"{options['path'].rstrip('/')}/{options['run']}"
        self.per_folder = int(options.get("filesperfolder", FILES_PER_FOLDER))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        part = f"part-{uuid.uuid4().hex}"
        system, root = _opened(f"{self.folder}/{part}")
        made: set[str] = set()
        files = size = 0
        waiting: list[tuple[str, str, int, str]] = []
        system.create_dir(root, recursive=True)
        with pq.ParquetWriter(f"{root}/{_LIST}", LIST_SCHEMA, filesystem=system) as listing:

            def flush() -> None:
                columns = zip(*waiting, strict=True) if waiting else [()] * len(LIST_SCHEMA)
                listing.write_table(pa.table([list(c) for c in columns], schema=LIST_SCHEMA))
                waiting.clear()

            for batch in iterator:
                names, contents = batch.column("name"), batch.column("content")
                for name, content in zip(names, contents, strict=True):
                    name, data = name.as_py(), content.as_py() or b""
                    if isinstance(data, str):
                        data = data.encode()
                    if not name or any(step in ("", ".", "..") for step in name.split("/")):
                        raise ValueError(f"not a relative file name: {name!r}")
                    file = f"{files // self.per_folder:06d}/{name}"
                    above = file.rsplit("/", 1)[0]
                    if above not in made:
                        system.create_dir(f"{root}/{above}", recursive=True)
                        # names with folders would fill the memory of folders made
                        made = {above} if len(made) > self.per_folder else made | {above}
                    with system.open_output_stream(f"{root}/{file}", compression=None) as out:
                        out.write(data)
                    waiting.append((name, f"{part}/{file}", len(data), hashlib.md5(data).hexdigest()))
                    files += 1
                    size += len(data)
                    if len(waiting) >= _LISTED:
                        flush()
            flush()
        return Part(part, files, size)

    def commit(self, messages: list[Part | None]) -> None:
        system, root = _opened(self.folder)
        parts = [m for m in messages if m is not None and m.files]
        system.create_dir(root, recursive=True)
        counted = {m.folder for m in parts}
        for found in system.get_file_info(pafs.FileSelector(root)):
            if found.type == pafs.FileType.Directory and found.base_name not in counted:
                system.delete_dir(found.path)
        run = {
            "parts": sorted(counted),
            "files": sum(m.files for m in parts),
            "bytes": sum(m.size for m in parts),
        }
        with system.open_output_stream(f"{root}/{_RUN}", compression=None) as out:
            out.write(json.dumps(run).encode())

    def abort(self, messages: list[Part | None]) -> None:
        system, root = _opened(self.folder)
        if system.get_file_info(root).type == pafs.FileType.Directory:
            system.delete_dir(root)


class FileTree(DataSource):
    """``df.write.format("leafmill_files").option("path", ...).option("run", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "leafmill_files"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(dict(self.options))


def write_files(
    files: DataFrame, path: str, files_per_folder: int = FILES_PER_FOLDER, run: str | None = None
) -> str:
    """Write a file per row of ``files`` (name, content) and return the name of the run."""
    spark = files.sparkSession
    run = run or f"run-{uuid.uuid4().hex}"
    spark.dataSource.register(FileTree)
    (
        files.select("name", "content")
        .write.format("leafmill_files")
        .option("path", path)
        .option("run", run)
        .option("filesPerFolder", str(files_per_folder))
        .mode("append")
        .save()
    )
    return run


def run_summary(path: str, run: str) -> dict:
    """Parts, number of files and bytes of a finished run."""
    system, root = _opened(f"{path.rstrip('/')}/{run}/{_RUN}")
    with system.open_input_stream(root, compression=None) as held:
        return json.load(io.BytesIO(held.read()))


def written_files(spark: SparkSession, path: str, run: str) -> DataFrame:
    """(name, file, size, md5) of a finished run; ``file`` is relative to the run's folder."""
    schema = "name string, file string, size long, md5 string"
    folder = f"{path.rstrip('/')}/{run}"
    if not run_summary(path, run)["parts"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/part-*/{_LIST}")


def read_files(spark: SparkSession, path: str, run: str) -> DataFrame:
    """(name, file, size, md5, content) of a finished run, contents from the files themselves.

    The listing decides what belongs to the run, so stray files are not read back. Its rows are
    dealt out and every task opens the files of its own: the driver sees no list of files, and
    no content is exchanged. A listed file that is gone fails the job.
    """
    listed, summary = written_files(spark, path, run), run_summary(path, run)
    if not summary["parts"]:
        return listed.withColumn("content", F.lit(None).cast("binary"))
    tasks = 1 + summary["bytes"] // _TASK_BYTES + summary["files"] // _TASK_FILES
    return listed.repartition(tasks, "file").mapInArrow(
        _contents(f"{path.rstrip('/')}/{run}"),
        "name string, file string, size long, md5 string, content binary",
    )


def _contents(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of the listing with their files' bytes, in batches of some MB."""
    schema = LIST_SCHEMA.append(pa.field("content", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(folder)
        for batch in batches:
            rows, held = [], 0
            for row in batch.to_pylist():
                with system.open_input_stream(f"{root}/{row['file']}", compression=None) as file:
                    rows.append(row | {"content": file.read()})
                held += row["size"]
                if held >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def repeated_names(listed: DataFrame) -> DataFrame:
    """(name, n) of the names that several files of a run share."""
    return listed.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")


# The classes travel with the tasks in place of this module's name.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
