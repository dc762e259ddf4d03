"""File listing and renaming through the Hadoop FileSystem API.

Only metadata passes through the driver here: path listings (which Spark's
own file index also holds on the driver) and renames; no file is opened.
Works for any filesystem Spark can read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def glob(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted, de-duplicated file paths matching a glob (no error if none)."""
    fs, p = _fs(spark, pattern)
    st = fs.globStatus(p)
    if st is None:
        return []
    return sorted({s.getPath().toString() for s in st if s.isFile()})


def dirs(spark: SparkSession, pattern: str) -> list[str]:
    fs, p = _fs(spark, pattern)
    st = fs.globStatus(p)
    if st is None:
        return []
    return sorted({s.getPath().toString() for s in st if s.isDirectory()})


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark's file sources spell it: with its scheme, special characters escaped."""
    fs, p = _fs(spark, path)
    return fs.makeQualified(p).toUri().toString()


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Moves a file or folder; missing folders above the target are made."""
    fs, src = _fs(spark, source)
    dst = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs.mkdirs(dst.getParent())
    if not fs.rename(src, dst):
        raise OSError(f"cannot move {source} to {target}")


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder, if it is there."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def usage(spark: SparkSession, folder: str) -> tuple[int, int]:
    """Number of files below a folder and their bytes (hidden ones left out); zeros if there is none."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return 0, 0
    files, size, listed = 0, 0, fs.listFiles(p, True)
    while listed.hasNext():
        f = listed.next()
        if not f.getPath().getName().startswith(("_", ".")):
            files, size = files + 1, size + f.getLen()
    return files, size


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file (metadata)."""
    fs, p = _fs(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def basename(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


# The date-range pattern in uploaded marketing file names and
# the fallback folder name (upload grouping, S9).
UPLOAD_RANGE_RE = r"(\d{4}-\d{2}-\d{2}_\d{4}-\d{2}-\d{2})"
UPLOAD_FALLBACK = "marketing_uploaded"


def upload_group(path) -> Column:
    """Name of the group an uploaded marketing file belongs to, from its
    path: its date range, else the first four parts of its name; the fallback
    for other files."""
    name = F.substring_index(F.col(path) if isinstance(path, str) else path, "/", -1)
    dates = F.regexp_extract(name, UPLOAD_RANGE_RE, 1)
    parts = F.replace(F.substring_index(name, "_", 4), F.lit(".csv"), F.lit(""))
    own = F.concat(F.lit("marketing_"), F.when(dates != "", dates).otherwise(parts))
    return F.when(F.upper(name).contains("MARKETING_"), own).otherwise(UPLOAD_FALLBACK)


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """The files of an upload folder with their groups; files are not moved and not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return listed.select("path", upload_group("path").alias("upload_group"))
