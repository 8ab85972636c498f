"""Claims and logs that at most one of several writers gets: files that only come to be where there are none.

A claim is one such file. A log is a folder of numbered ones: a writer reads it, decides by what it holds, and creates the
next number; if another was there first, it reads and decides again. So a decision always stands on all entries before
it, and none is lost or made twice. HDFS creates a file for one client alone, and so do stores whose connector has
conditional creation; local files are created by the operating system's own exclusive call. Logs hold what is decided,
an entry for each commit, and not data."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: How often a writer decides again.
ATTEMPTS = 1000


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return jvm, fs, fs.makeQualified(where)


def claim(spark: SparkSession, path: str, text: str = "") -> bool:
    """Puts a file with the text there if there is none; whether it did. It is written beside and then moved or linked,
    so that nobody sees it unfinished."""
    jvm, fs, where = _file_system(spark, path)
    fs.mkdirs(where.getParent())
    beside = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}-{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            files, at = jvm.java.nio.file.Files, jvm.java.nio.file.Paths.get
            files.createLink(at(where.toUri()), at(beside.toUri()))
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri()).rename(beside, where, options)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(beside, False)
    return True


class Log:
    """Entries, each a dict, in the order of their commits."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def entries(self) -> list[dict]:
        _, fs, where = _file_system(self.spark, self.path)
        if not fs.exists(where):
            return []
        found = self.spark.read.text(self.path, wholetext=True).selectExpr("_metadata.file_name AS name", "value").collect()
        return [json.loads(r["value"]) for r in sorted(found, key=lambda r: r["name"]) if r["name"].endswith(".json")]

    def commit(self, decide: Callable[[list[dict]], dict | None]) -> dict | None:
        """What `decide` makes of the entries so far, once it is the next of them; None commits nothing."""
        for _ in range(ATTEMPTS):
            held = self.entries()
            entry = decide(held)
            if entry is None:
                return None
            if claim(self.spark, f"{self.path}/{len(held):012d}.json", json.dumps(entry, sort_keys=True)):
                return entry
        raise RuntimeError(f"{self.path}: another writer was first {ATTEMPTS} times")
