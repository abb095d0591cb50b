"""Small files and listings of a folder through Hadoop's file systems, where Spark reads and writes as well."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import SparkSession

_RECORD_DDL = "name string, bytes bigint, sha256 string"


class Folder:
    """A folder of any file system Spark knows; names are relative to it."""

    def __init__(self, spark: SparkSession, path: object) -> None:
        self.spark, self.path = spark, str(path).rstrip("/")
        self._jvm = spark._jvm
        self._root = self._at("")
        self._files = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def child(self, name: str) -> str:
        return f"{self.path}/{name}"

    def make(self) -> None:
        self._files.mkdirs(self._root)

    def exists(self, name: str = "") -> bool:
        return self._files.exists(self._at(name))

    def is_folder(self, name: str) -> bool:
        return self.exists(name) and self._files.getFileStatus(self._at(name)).isDirectory()

    def names(self) -> list[str]:
        """Entries of the folder, without checksum files."""
        if not self.exists():
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._files.listStatus(self._root)) if not n.endswith(".crc"))

    def delete(self, name: str) -> None:
        self._files.delete(self._at(name), True)

    def read_text(self, name: str) -> str:
        stream = self._files.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        """Writes beside the file and renames over it: readers see the old text or the new."""
        part = self._at(f"{name}.tmp")
        out = self._files.create(part, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        fs = self._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
        options[0] = getattr(fs, "Options$Rename").OVERWRITE
        target = self._files.makeQualified(self._at(name))
        fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._files.makeQualified(part), target, options)

    def data_files(self, name: str) -> list[str]:
        """Full paths of the data files below an entry, hidden ones left out."""
        out, listing = [], self._files.listFiles(self._at(name), True)
        while listing.hasNext():
            path = listing.next().getPath()
            if not path.getName().startswith(("_", ".")):
                out.append(path.toString())
        return sorted(out)


def _hashed(path: str, chunk: int = 1 << 22) -> tuple[int, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    filesystem, inside = pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    digest, size = hashlib.sha256(), 0
    with filesystem.open_input_stream(inside) as stream:
        while part := stream.read(chunk):
            digest.update(part)
            size += len(part)
    return size, digest.hexdigest()


def file_records(spark: SparkSession, folder: object, name: str) -> dict[str, dict[str, int | str]]:
    """Bytes and SHA-256 of every data file below an entry; each file is streamed through one task, whatever its size."""
    paths = Folder(spark, folder).data_files(name)
    if not paths:
        return {}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path.rsplit("/", 1)[1], *_hashed(path)) for path in batch["path"]]
            yield pd.DataFrame(rows, columns=["name", "bytes", "sha256"])

    listing = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 4 * spark.sparkContext.defaultParallelism))
    return {r["name"]: {"bytes": r["bytes"], "sha256": r["sha256"]} for r in listing.mapInPandas(read, _RECORD_DDL).collect()}  # one row per file
