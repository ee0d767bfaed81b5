"""Small files and folders on the session's file system: a local disk in tests, the cluster's shared store elsewhere."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(path: str):
    spark = SparkSession.active()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration()), spark


def join(*parts: str) -> str:
    return "/".join(p.rstrip("/") for p in parts)


def exists(path: str) -> bool:
    where, fs, _ = _open(path)
    return fs.exists(where)


def qualified(path: str) -> str:
    """The path with its store, without . and .. parts."""
    where, fs, _ = _open(path)
    return fs.makeQualified(where).toUri().normalize().toString()


def children(path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    where, fs, _ = _open(path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def read_text(path: str) -> str | None:
    """The file's text, None if there is none."""
    where, fs, spark = _open(path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """Writes or replaces a small file; its folder is made."""
    where, fs, _ = _open(path)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
