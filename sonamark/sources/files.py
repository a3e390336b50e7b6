"""Files as rows: a data source for text exports whose partitions are planned by bytes, and a writer that names its files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, bytes long, text string, error string"
#: Bytes that are read at once for a digest.
CHUNK = 8 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class TextFiles(DataSource):
    """spark.read.format("exports").load(folder): one row for each file below the folder: path (below it), bytes, text, and error where a file can't be read as what it should
    be; a file that can't is a row, not a failed job. Options: encoding (latin-1), suffix (of the names read; any), partitionBytes (64 MB of files to a task),
    maxBytes (1 GB: longer files are errors). With a schema of some of the columns, no others are read: files aren't opened without text or error. A column
    sha256 may be asked for too: a file of any size is streamed through its digest. The folder may be a single file."""

    @classmethod
    def name(cls) -> str:
        return "exports"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TextFilesReader(dict(self.options), schema.fieldNames())


class TextFilesReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        lower = {k.lower(): v for k, v in options.items()}
        self.root, self.columns = lower["path"].rstrip("/"), columns
        self.encoding, self.suffix = lower.get("encoding", "latin-1"), lower.get("suffix", "")
        self.share, self.most = int(lower.get("partitionbytes", 64 << 20)), int(lower.get("maxbytes", 1 << 30))

    def partitions(self) -> list[InputPartition]:
        """Files in the order of their paths, together up to a size; a large file is a partition of its own."""
        fs, base = file_system(self.root)
        one = fs.get_file_info(base)
        found = [one] if one.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(base, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith(self.suffix) and not f.base_name.startswith(("_", ".crc")))
        parts: list[list] = []
        total = 0
        for path, size in files:
            if not parts or total + size > self.share:
                parts.append([])
                total = 0
            parts[-1].append((path, size))
            total += size
        return [Files(p) for p in parts] or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(self.root)
        kinds = {"path": pa.string(), "bytes": pa.int64(), "text": pa.string(), "error": pa.string(), "sha256": pa.string()}
        for path, size in partition.files:
            text = error = None
            if "text" in self.columns or "error" in self.columns:
                try:
                    if size > self.most:
                        raise ValueError(f"{size} bytes are more than {self.most}")
                    with fs.open_input_stream(path) as f:
                        text = f.read().decode(self.encoding)
                except (OSError, ValueError) as e:
                    error = f"{type(e).__name__}: {e}"
            name = path.removeprefix(base).lstrip("/") or path.rsplit("/", 1)[-1]
            row = {"path": name, "bytes": size, "text": text, "error": error, "sha256": self.digest(fs, path) if "sha256" in self.columns else None}
            yield pa.RecordBatch.from_arrays([pa.array([row[c]], kinds[c]) for c in self.columns], names=self.columns)


    @staticmethod
    def digest(fs: pafs.FileSystem, path: str) -> str:
        found = hashlib.sha256()
        with fs.open_input_stream(path) as f:
            while part := f.read(CHUNK):
                found.update(part)
        return found.hexdigest()


def read_files(spark: SparkSession, folder: str, columns: str = SCHEMA, **options: object) -> DataFrame:
    spark.dataSource.register(TextFiles)
    return spark.read.format("exports").schema(columns).options(**options).load(folder)


def write_files(rows: DataFrame, folder: str, encoding: str = "latin-1", path: str = "path", text: str = "text") -> None:
    """One file below the folder for each row, from its task. A task that runs twice writes the same files."""

    def write(part) -> None:
        fs, base = file_system(folder)
        for r in part:
            to = f"{base}/{r[path]}"
            fs.create_dir(to.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(to) as f:
                f.write(r[text].encode(encoding))

    rows.select(path, text).foreachPartition(write)
