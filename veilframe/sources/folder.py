"""A folder of text files as a Spark data source: read in parallel, and written with commit and abort, no text passing the driver.

    spark.dataSource.register(Folder)
    spark.read.format("text_folder").load(path)                  # doc_id, path, fmt, text
    df.write.format("text_folder").mode("append").save(path)     # name, text: a file a row

The driver lists names and sizes, tasks read about PART bytes of files each. Documents are numbered in the order of their paths. Any folder that
Arrow's file systems know and all executors reach will do. A writing task puts its files into a folder of the job; only those of attempts that Spark
has committed are moved to their names at the end, so a lost executor or a second attempt leaves nothing, and a job that fails leaves no file."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .files import checked

#: Bytes of files that a task reads.
PART = 64 << 20


def _at(path: str):
    """The file system and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", str(path)))


def top(path: str) -> str:
    """What the paths of a folder's files begin with."""
    return _at(path)[1].rstrip("/")


@dataclass
class Files(InputPartition):
    first: int  # number of the first one
    paths: list[str]


@dataclass
class Moves(WriterCommitMessage):
    names: list[tuple[str, str]]  # where it is, what it is called


class Reader(DataSourceReader):
    def __init__(self, path: str, part: int):
        self.path, self.part = path, part

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, top = _at(self.path)
        found = system.get_file_info(fs.FileSelector(top, recursive=True))
        hidden = lambda f: any(x[0] in "._" for x in PurePosixPath(f.path).relative_to(top).parts)
        found = sorted((f for f in found if f.is_file and not hidden(f)), key=lambda f: f.path)
        out, size = [], 0
        for k, f in enumerate(found):
            checked(f.path)
            if not out or size + f.size > self.part:
                out.append(Files(k, []))
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out or [Files(0, [])]

    def read(self, partition: Files):
        system, _ = _at(self.path)
        for k, path in enumerate(partition.paths, partition.first):
            with system.open_input_stream(path, compression=None) as file:
                yield k, path, PurePosixPath(path).suffix[1:], file.read().decode("utf-8")


class Writer(DataSourceWriter):
    def __init__(self, path: str, schema: StructType):
        if not {"name", "text"} <= set(schema.names):
            raise ValueError("a folder of files takes columns name and text")
        self.path, self.job = path, f"_job-{uuid.uuid4().hex}"

    def write(self, rows) -> Moves:
        system, top = _at(self.path)
        own = f"{top}/{self.job}/{uuid.uuid4().hex}"  # of this attempt
        system.create_dir(own, recursive=True)
        done = []
        for k, row in enumerate(rows):
            name = PurePosixPath(checked(row["name"]).as_posix())
            if name.is_absolute() or ".." in name.parts:
                raise ValueError(f"not a name within the folder: {name}")
            with system.open_output_stream(f"{own}/{k}", compression=None) as file:
                file.write((row["text"] or "").encode("utf-8"))
            done.append((f"{own}/{k}", str(name)))
        return Moves(done)

    def commit(self, messages) -> None:
        system, top = _at(self.path)
        moves = [m for some in messages if some for m in some.names]
        twice = [name for name, n in Counter(name for _, name in moves).items() if n > 1]
        if twice:
            self.abort(messages)
            raise ValueError(f"two rows have the name {min(twice)}")
        for folder in {str(PurePosixPath(name).parent) for _, name in moves} - {"."}:
            system.create_dir(f"{top}/{folder}", recursive=True)
        for at, name in moves:
            system.move(at, f"{top}/{name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        from pyarrow import fs

        system, top = _at(self.path)
        if system.get_file_info(f"{top}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{top}/{self.job}")


class Folder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_folder"

    def schema(self) -> str:
        return "doc_id long, path string, fmt string, text string"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], int(self.options.get("bytes", PART)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("files are added to a folder: use mode append")
        return Writer(self.options["path"], schema)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, fmt, text: all files of a folder, in the order of their paths; the rows that files.prose() and files.bib_fields() take."""
    spark.dataSource.register(Folder)
    return spark.read.format("text_folder").load(path)


def write_folder(files: DataFrame, path: str) -> None:
    """files (name, text): a file a row, below path."""
    files.sparkSession.dataSource.register(Folder)
    files.select("name", "text").write.format("text_folder").mode("append").save(path)
