"""Files on any Hadoop file system: listing, moving and removing whole files."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    target = path(folder)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target, path


def remove(spark: SparkSession, folder: str) -> None:
    fs, target, _ = _file_system(spark, folder)
    fs.delete(target, True)


def create_new(spark: SparkSession, name: str) -> bool:
    """Create an empty file; False if it is there already. Of several callers one gets True, where the store creates exclusively."""
    fs, target, _ = _file_system(spark, name)
    fs.mkdirs(target.getParent())
    try:
        fs.create(target, False).close()
    except Py4JJavaError:
        if fs.exists(target):
            return False
        raise
    return True


def pending_files(spark: SparkSession, inbox: str) -> list[str]:
    """Names of the Parquet files in a folder, in order."""
    fs, folder, _ = _file_system(spark, inbox)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(n for n in names if n.endswith(".parquet"))


def partition_values(spark: SparkSession, folder: str, column: str) -> list[str]:
    """The values of a table's first partition column, by the names of its folders; rows without one don't count."""
    fs, target, _ = _file_system(spark, folder)
    if not fs.exists(target):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory()]
    values = [n.removeprefix(f"{column}=") for n in names if n.startswith(f"{column}=")]
    return sorted(v for v in values if v != "__HIVE_DEFAULT_PARTITION__")


def read_text(spark: SparkSession, name: str) -> str | None:
    """What a small file holds, or None if there is none."""
    fs, target, _ = _file_system(spark, name)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, name: str, text: str) -> None:
    fs, target, _ = _file_system(spark, name)
    stream = fs.create(target, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def replace_file(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file over another in one step."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    _, path, _ = _file_system(spark, source)
    rename = hadoop.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration()).rename(path, hadoop.Path(target), options)


def folders(spark: SparkSession, parent: str, prefix: str) -> list[str]:
    """Names of the folders below another that begin with a prefix."""
    fs, target, _ = _file_system(spark, parent)
    if not fs.exists(target):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory()) if n.startswith(prefix))


def archive_files(spark: SparkSession, inbox: str, archive: str, names: list[str]) -> str:
    """Move processed files into a new folder of the archive, so that a name used before loses nothing; returns the folder."""
    fs, source, path = _file_system(spark, inbox)
    target = path(archive, f"run-{uuid.uuid4().hex}")
    fs.mkdirs(target)
    for name in names:
        if not fs.rename(path(source, name), path(target, name)):
            raise OSError(f"{name} could not be moved to {target.toString()}")
    return target.toString()
