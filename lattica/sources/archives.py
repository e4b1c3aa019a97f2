"""Archives and folders of assets as tables of entries."""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of entries that leave a task at once, about.
_BATCH_BYTES = 32 << 20
_SCHEMA = "archive string, path string, size long, compressed long, crc long, header_offset long, method int"


class _Archive(InputPartition):
    def __init__(self, archives: list[str]):
        self.archives = archives


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.archives = [a for a in options["archives"].split("\n") if a]
        self.prefix = options.get("prefix", "")
        self.step = int(options.get("archivesPerTask", "1"))

    def partitions(self) -> list[InputPartition]:
        return [_Archive(self.archives[i : i + self.step]) for i in range(0, len(self.archives), self.step)] or [_Archive([])]

    def read(self, part: _Archive) -> Iterator[tuple]:
        for archive in part.archives:
            with zipfile.ZipFile(archive) as z:
                for e in z.infolist():
                    if not e.is_dir() and e.filename.startswith(self.prefix):
                        yield archive, e.filename, e.file_size, e.compress_size, e.CRC, e.header_offset, e.compress_type


class ArchiveEntries(DataSource):
    """format("archive_entries"): the entries of zip archives, whose directories are read by the tasks, each once.

    Options: archives (paths, one a line, on a file system that all executors see), prefix, archivesPerTask.
    """

    @classmethod
    def name(cls) -> str:
        return "archive_entries"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def entries(spark: SparkSession, archives: list[str], *, content: bool = False, prefix: str = "") -> DataFrame:
    """(archive, path, size, compressed, crc, header_offset, method[, content]) of the files in archives."""
    spark.dataSource.register(ArchiveEntries)
    listed = spark.read.format("archive_entries").options(archives="\n".join(archives), prefix=prefix).load()
    return with_content(listed) if content else listed


def with_content(listed: DataFrame, tasks: int | None = None) -> DataFrame:
    """entries() with their bytes. Entries are dealt over tasks whatever archive they are in, and each is read at its stored place."""
    n = tasks or int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            start, size = 0, 0
            for i, n_bytes in enumerate(pdf["size"].tolist()):
                size += n_bytes
                if size >= _BATCH_BYTES or i == len(pdf) - 1:
                    part = pdf.iloc[start : i + 1]
                    yield part.assign(content=[read_at(a, o, c) for a, o, c in zip(part["archive"], part["header_offset"], part["compressed"])])
                    start, size = i + 1, 0

    return listed.repartition(n, "archive", "path").mapInPandas(run, _SCHEMA + ", content binary")


def write(rows: DataFrame, folder: str) -> list[str]:
    """Writes rows (path, content binary) into zip archives below a folder of a file system that all executors see, one for each partition; their paths.

    An archive is written aside and then renamed, so a task that is repeated replaces its own.
    """
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        name = f"{folder}/part-{TaskContext.get().partitionId():05d}.zip"
        draft = f"{name}.{uuid.uuid4().hex}"
        n = 0
        with zipfile.ZipFile(draft, "w", zipfile.ZIP_DEFLATED) as z:
            for pdf in batches:
                for path, content in zip(pdf["path"].tolist(), pdf["content"].tolist()):
                    z.writestr(zipfile.ZipInfo(path), content, zipfile.ZIP_DEFLATED)
                    n += 1
        if n:
            os.replace(draft, name)
            yield pd.DataFrame({"archive": [name]})
        else:
            os.unlink(draft)

    return sorted({r[0] for r in rows.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(run, "archive string").collect()})


def read_at(archive: str, header_offset: int, compressed: int) -> bytes:
    """One entry's bytes by its stored place, without the archive's directory. Only stored and deflated entries."""
    with open(archive, "rb") as f:
        f.seek(header_offset)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{archive}: no entry at {header_offset}")
        method, name, extra = struct.unpack("<H", head[8:10])[0], *struct.unpack("<HH", head[26:30])
        f.seek(name + extra, os.SEEK_CUR)
        raw = f.read(compressed)
    if method == zipfile.ZIP_STORED:
        return raw
    if method == zipfile.ZIP_DEFLATED:
        return zlib.decompress(raw, -15)
    raise ValueError(f"{archive}: method {method} at {header_offset} is neither stored nor deflated")


def folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified, content) of the files below a folder, paths relative to it."""
    root = path.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.regexp_replace("path", "^.*?" + root.lstrip("/").replace(".", r"\."), "").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def tree_stamp(spark: SparkSession, path: str) -> str:
    """16 hex digits that change with the path, size or time of any file below a folder, not with the order they are listed in."""
    listed = folder(spark, path).select(F.sha2(F.concat_ws("\0", "path", F.col("size").cast("string"), F.col("modified").cast("double").cast("string")), 256).alias("h"), "path")
    parts = listed.select("path", "h").groupBy(F.substring("h", 1, 2).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h")).orderBy("b").collect()
    return hashlib.sha256("".join(r["h"] for r in parts).encode()).hexdigest()[:16]


def manifests(files: DataFrame) -> DataFrame:
    """(key..., group_name, name, version) of packs from their manifest (key..., content): texts that are not empty, null for anything else, also for a manifest that cannot be read."""
    text = lambda k: F.nullif(F.get_json_object("_m", f"$.{k}"), F.lit(""))
    is_text = lambda k: F.get_json_object("_m", f"$.{k}").isNotNull() & F.col("_m").rlike(f'"{k}"\\s*:\\s*"')
    keys = [c for c in files.columns if c != "content"]
    return files.withColumn("_m", F.col("content").cast("string")).select(*keys, *[F.when(is_text(k), text(k)).alias(n) for k, n in (("Group", "group_name"), ("Name", "name"), ("Version", "version"))])


def admitted(listed: DataFrame) -> DataFrame:
    """The archives that hold assets or texts."""
    fits = F.col("path").rlike(r"^(Server|Common|Client)/.+\.(json|lang)$")
    return listed.groupBy("archive").agg(F.bool_or(fits).alias("ok")).where("ok").select("archive")
