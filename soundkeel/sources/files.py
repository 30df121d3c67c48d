"""Files by URI: the file system behind a path, and names relative to a folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import Column
from pyspark.sql import functions as F


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a URI or local path, and the path in it.

    Local files, object stores and HDFS are known to Arrow; ranges of a file are read without
    the rest, so a long object is read by many tasks.
    """
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:/", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


@contextmanager
def new_file(system: fs.FileSystem, path: str) -> Iterator[fs.NativeFile]:
    """A stream to a file that has its name only once it is whole.

    Attempts of a task, and speculative copies of it, write to names of their own; the file system's move puts the
    last one that ends in place.
    """
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    mine = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(mine, compression=None) as out:
            yield out
        system.move(mine, path)
    except BaseException:
        if system.get_file_info(mine).type == fs.FileType.File:
            system.delete_file(mine)
        raise


def relative_name(path: str, root: str) -> str:
    """The name below ``root``; of the root itself, its last part."""
    root = root.rstrip("/")
    return path[len(root) + 1 :] if path.startswith(root + "/") else path.rsplit("/", 1)[-1]


def relative_to(path: Column, root: str) -> Column:
    """``relative_name`` of Spark's file paths, whose scheme may be written otherwise."""
    bare = "/" + re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "", root).strip("/") + "/"
    at = F.instr(path, bare)
    return F.when(at > 0, F.substr(path, at + len(bare))).otherwise(F.substring_index(path, "/", -1))
