"""Archive sources: the central directory of ZIP files as a table, without decompression.

``ZipEntries`` is a Python data source: one partition per archive.  Paths are listed on the driver and opened by the executors, so they must be
mounted there; on object stores read archives with ``binaryFile`` and :func:`entries_of`, which works on the bytes.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.classify import filename_parts

ENTRY_SCHEMA = "zip string, entry string, crc long, file_size long"


def _entries(name: str, data) -> Iterator[tuple]:
    try:
        with zipfile.ZipFile(data) as z:
            for i in z.infolist():
                if not i.is_dir():
                    yield name, i.filename, i.CRC, i.file_size
    except zipfile.BadZipFile:
        return  # a broken archive gives no rows; bad_archives counts them


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        import glob

        return [_Archive(p) for p in sorted(glob.glob(self.options["path"]))] or [_Archive("")]

    def read(self, partition):
        if partition.path:
            yield from _entries(partition.path, partition.path)


class ZipEntries(DataSource):
    """``spark.read.format("zip_entries").load("/mount/*.zip")``"""

    @classmethod
    def name(cls):
        return "zip_entries"

    def schema(self):
        return ENTRY_SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipEntries)


def entries_of(binary: DataFrame) -> DataFrame:
    """Entries of archives read by ``spark.read.format("binaryFile")``, from any file system Spark reads."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(_entries(path, io.BytesIO(content.as_py())))
                cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["zip", "entry", "crc", "file_size"])

    return binary.select("path", "content").mapInArrow(run, ENTRY_SCHEMA)


def inventory(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with parsed names, entries whose name is not valid)."""
    stem = F.regexp_extract("entry", r"([^/]+)\.[^./]+$", 1)
    parsed = entries.withColumn("p", filename_parts(stem)).withColumn("ext", F.lower(F.regexp_extract("entry", r"\.([^./]+)$", 1)))
    good = parsed.where("p is not null").select("zip", "entry", "p.*", "ext", "crc", "file_size")
    return good, parsed.where("p is null").select("zip", "entry")


def fingerprint(crc, size):
    """``crc32_size`` as text, the crc in eight hex digits."""
    return F.concat_ws("_", F.lpad(F.lower(F.hex(crc)), 8, F.lit("0")), size.cast("string"))


def link_by_fingerprint(rows: DataFrame) -> DataFrame:
    """Label archives do not share keys: equal pictures (crc and size) link them. One row per picture with its keys by label."""
    pairs = rows.groupBy("crc", "file_size", "label").agg(F.min("key").alias("key"), F.count("*").alias("copies"))
    return pairs.groupBy("crc", "file_size").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "key")))).alias("keys"), F.sum("copies").alias("copies"))


#: Open archives of one worker, the oldest first.
_HANDLES: dict = {}


def read_entries(index: DataFrame, handles: int = 8) -> DataFrame:
    """Adds ``content`` to rows with ``zip, entry``: the entry's bytes, null if the archive or the entry cannot be read.

    A worker keeps a few archives open between rows, so rows should come sorted by archive.
    """

    def run(batches):
        import zipfile

        import pyarrow as pa

        for batch in batches:
            names, contents = batch.schema.names, []
            for path, entry in zip(batch.column(names.index("zip")).to_pylist(), batch.column(names.index("entry")).to_pylist(), strict=True):
                try:
                    if path is None or entry is None:
                        raise KeyError(entry)
                    if path not in _HANDLES:
                        while len(_HANDLES) >= handles:
                            _HANDLES.pop(next(iter(_HANDLES))).close()
                        _HANDLES[path] = zipfile.ZipFile(path)
                    contents.append(_HANDLES[path].read(entry))
                except (OSError, KeyError, zipfile.BadZipFile):
                    contents.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(contents, pa.binary())], [*names, "content"])

    rows = index.repartition("zip").sortWithinPartitions("zip")
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", content binary")
