"""Files wherever they are, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def file_system(path: str):
    """(pyarrow file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def shared_file(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, or, on a single machine without one, below a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="hierql-files-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}/{name}"


def open_output(path: str):
    """A binary stream to a new file at a URI or a local path."""
    system, place = file_system(path)
    system.create_dir(place.rpartition("/")[0] or ".", recursive=True)
    return system.open_output_stream(place, compression=None)
