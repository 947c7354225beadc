"""Collecting source files: recursive scans, ignore rules, request maps."""

from __future__ import annotations

import fnmatch
import re
import time

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Folders that snapshots leave out.
IGNORED = (".git", ".hg", ".svn", ".venv", "__pycache__", "build", "dist", "env", "node_modules", "venv")


def is_ignored(relative: Column | str) -> Column:
    """Whether a folder of the path is hidden or ignored, or the file is hidden."""
    parts = F.split(F.col(relative) if isinstance(relative, str) else relative, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.exists(folders, lambda p: p.startswith(".") | p.isin(*IGNORED)) | F.element_at(parts, -1).startswith(".")


def listed(spark: SparkSession, root: str, pattern: str) -> list[tuple[str, str, int]]:
    """(uri, path relative to root, modified in ms) of every file below root whose name matches.  Spark's own readers
    hide names that begin with "_", and so every __init__.py; the file system's listing does not."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(path).toUri().getPath().rstrip("/") + "/"
    found, out = fs.listFiles(path, True), []
    while found.hasNext():
        status = found.next()
        uri = status.getPath().toUri()
        relative = uri.getPath().removeprefix(base)
        if fnmatch.fnmatchcase(relative.rpartition("/")[2], pattern):
            out.append((status.getPath().toString(), relative, status.getModificationTime()))
    return sorted(out, key=lambda x: x[1])


def _read(uri: str) -> str:
    """UTF-8 with bad bytes dropped."""
    system, path = (pafs.LocalFileSystem(), re.sub("^file:/+", "/", uri)) if uri.startswith(("file:", "/")) else pafs.FileSystem.from_uri(uri)
    with system.open_input_stream(path) as stream:
        return stream.read().decode("utf-8", errors="ignore")


def collect(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """file_path (relative to root), content, modified of every file that matches and is not ignored, in any folder and
    with any name.  The listing is the driver's; texts are read by executors."""
    names = spark.createDataFrame(listed(spark, root, pattern), "uri string, file_path string, at long").where(~is_ignored("file_path"))

    def run(batches):
        for batch in batches:
            texts = [_read(x) for x in batch.column("uri").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("file_path"), pa.array(texts, pa.string()), batch.column("at")], ["file_path", "content", "at"])

    read = names.mapInArrow(run, "file_path string, content string, at long")
    return read.select("file_path", "content", F.timestamp_millis("at").alias("modified"))


def python_files(spark: SparkSession, root: str) -> DataFrame:
    return collect(spark, root, "*.py")


def go_files(spark: SparkSession, root: str, tests: bool = True) -> DataFrame:
    found = collect(spark, root, "*.go")
    return found if tests else found.where(~F.col("file_path").endswith("_test.go"))


def from_map(requests: DataFrame) -> DataFrame:
    """One row a file of requests that carry their files as a map."""
    keep = [c for c in requests.columns if c != "files"]
    return requests.select(*keep, F.explode("files").alias("file_path", "content"))


def modules(files: DataFrame) -> DataFrame:
    """path, parent of every folder above a file, the root's parent being empty."""
    parts = F.split("file_path", "/")
    prefix = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    paths = files.where(F.contains("file_path", F.lit("/"))).select(F.explode(prefix).alias("path")).distinct()
    return paths.withColumn("parent", F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(""))


def retried(call, attempts: int = 3, delay: float = 2.0, sleep=time.sleep):
    """call(), again after a delay while it fails, up to `attempts` times: for listings of remote sources."""
    for left in range(attempts - 1, -1, -1):
        try:
            return call()
        except Exception:
            if not left:
                raise
            sleep(delay)
