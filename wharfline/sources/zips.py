"""Zip archives as a data source: spark.read.format("zip_entries").load(folder or file)."""

from __future__ import annotations

import glob
import hashlib
import os
import zipfile

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 1 << 20


class ZipEntries(DataSource):
    """archive, p, b, crc, h: every entry of the zip files, each hashed as a stream of pieces; a file is a partition."""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return "archive string, p string, b long, crc long, h string"

    def reader(self, schema) -> DataSourceReader:
        return ZipReader(self.options["path"])


class ZipReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        found = sorted(glob.glob(f"{self.path}/**/*.zip", recursive=True)) if os.path.isdir(self.path) else [self.path]
        return [InputPartition(p) for p in found]

    def read(self, partition: InputPartition):
        with zipfile.ZipFile(partition.value) as archive:
            for entry in archive.infolist():
                if entry.is_dir():
                    continue
                digest = hashlib.sha256()
                with archive.open(entry) as body:
                    while piece := body.read(CHUNK):
                        digest.update(piece)
                yield os.path.basename(partition.value), entry.filename, entry.file_size, entry.CRC, digest.hexdigest()
