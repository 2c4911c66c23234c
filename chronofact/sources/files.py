"""Small files on any file system that Spark reaches: read, list, delete, and publish if absent."""

from __future__ import annotations

import functools
import time
import uuid
from collections.abc import Sequence
from types import SimpleNamespace


@functools.lru_cache(maxsize=4)
def _java(jvm) -> SimpleNamespace:
    """The classes used here: finding one by its name takes a call for each part of the name."""
    found = {"Path": jvm.org.apache.hadoop.fs.Path, "copy": jvm.org.apache.hadoop.io.IOUtils.copyBytes, "text": jvm.org.apache.commons.io.IOUtils.toString}
    return SimpleNamespace(File=jvm.java.io.File, link=jvm.java.nio.file.Files.createLink, **found)


def _at(spark, path: str):
    at = _java(spark._jvm).Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark, folder: str, pattern: str | None = None) -> list[str]:
    """Names of the visible files in a folder, of those of a pattern if it is given, sorted; an absent folder has none."""
    fs, at = _at(spark, folder)
    if not fs.exists(at):
        return []
    found = fs.listStatus(at) if pattern is None else fs.globStatus(_java(spark._jvm).Path(at, pattern))
    return sorted(n for n in (x.getPath().getName() for x in found) if not n.startswith((".", "_")))


def read(spark, path: str) -> str | None:
    fs, at = _at(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return _java(spark._jvm).text(stream, "UTF-8")
    finally:
        stream.close()


def delete(spark, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.delete(at, True)


def age(spark, path: str) -> float:
    """Seconds since a file was written; of an absent one 0."""
    fs, at = _at(spark, path)
    return time.time() - fs.getFileStatus(at).getModificationTime() / 1000 if fs.exists(at) else 0.0


def publish(spark, path: str, text: str, parts: Sequence[str] = ()) -> bool:
    """Write a file at once and whole, unless there is one of its name already: of many writers one succeeds.

    It holds the bytes of the files `parts` and then the text. All is written beside it first.
    A local file is then linked, which fails if the name is taken; elsewhere it is renamed,
    which a distributed file system refuses then.
    """
    fs, at = _at(spark, path)
    java, folder = _java(spark._jvm), at.getParent()
    if not fs.exists(folder):
        fs.mkdirs(folder)
    draft = java.Path(folder, f".draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        for part in parts:
            source = fs.open(java.Path(part))
            try:
                java.copy(source, stream, 1 << 16, False)
            finally:
                source.close()
        stream.write(text.encode())
        stream.close()
        if fs.getUri().getScheme() != "file":
            return not fs.exists(at) and bool(fs.rename(draft, at))
        local = lambda p: java.File(p.toUri().getPath()).toPath()
        try:
            java.link(local(at), local(draft))
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True
    finally:
        fs.delete(draft, False)
        fs.delete(java.Path(folder, f".{draft.getName()}.crc"), False)
