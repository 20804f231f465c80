"""The folder that driver and executors share, and small files in it."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Temporary folders of local applications that set none.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset and the master is local, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="sieveline-")
        _OWN[spark.sparkContext.applicationId] = path
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/sieveline/{label}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.getFileStatus(at).isDirectory()


def make_folder(spark: SparkSession, path: str) -> None:
    """Makes a folder, and those above it, unless there is one."""
    fs, at = _at(spark, path)
    fs.mkdirs(at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder by the file system of its scheme."""
    fs, at = _at(spark, path)
    fs.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none where there is no folder."""
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file unless there is one, in which case the answer is False: of several writers one succeeds.

    The file system's exclusive creation decides. On the local one, whose Java client checks before it creates, a link
    does: it fails where the name is taken."""
    fs, at = _at(spark, path)
    if fs.getUri().getScheme() == "file":
        name = at.toUri().getPath()
        os.makedirs(os.path.dirname(name), exist_ok=True)
        own = f"{os.path.dirname(name)}/.{uuid.uuid4().hex}"
        with open(own, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(own, name)
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    try:
        stream = fs.create(at, False)
    except Py4JJavaError:
        if fs.exists(at):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True
