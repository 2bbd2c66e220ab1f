"""Files by byte ranges: listed by Spark, opened on executors through a seekable stream."""

from __future__ import annotations

import re
from typing import BinaryIO
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes read at once.
CHUNK = 1 << 20
#: Hadoop's names of stores that Arrow opens under another.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "s3": "s3", "gs": "gs", "hdfs": "hdfs"}


def local_path(path: str) -> str | None:
    """The path in the local file system, or None if another store is named."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return path
    return unquote(urlparse(path).path) if path.startswith("file:") else None


def is_seekable(path: str) -> bool:
    """Whether Python workers can open a path themselves; what only Spark can read (another file system of Hadoop's) is not."""
    return local_path(path) is not None or path.split(":", 1)[0] in _SCHEMES


def seekable(path: str) -> BinaryIO:
    """A stream with read, seek and tell, which asks a remote store for the ranges that are read."""
    local = local_path(path)
    if local is not None:
        return open(local, "rb", buffering=0)
    from pyarrow import fs

    scheme, rest = path.split(":", 1)
    store, name = fs.FileSystem.from_uri(f"{_SCHEMES[scheme]}:{rest}")
    return store.open_input_file(name)


def read_exactly(stream: BinaryIO, n: int) -> bytes:
    """n bytes, or ValueError where the file ends before them."""
    parts, left = [], n
    while left:
        part = stream.read(left)
        if not part:
            raise ValueError(f"the file ends {left} bytes early")
        parts.append(part)
        left -= len(part)
    return parts[0] if len(parts) == 1 else b"".join(parts)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path, length of the files that a path or glob names; contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def spread(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows of work dealt out evenly."""
    return rows.repartition(max(1, min(tasks, 10_000)))


def all_seekable(files: DataFrame) -> bool:
    schemes = files.select(F.regexp_extract("path", "^[A-Za-z][A-Za-z0-9+.-]*:", 0).alias("s")).distinct().collect()
    return all(is_seekable(f"{r.s}/") for r in schemes)
