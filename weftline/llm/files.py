"""Files of our own formats in the shared folder: written whole under another name, then moved into place."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame


def write_file(uri: str, data: bytes) -> None:
    """A task that is tried again, or runs twice, leaves one whole file."""
    system, path = fs.FileSystem.from_uri(uri)
    folder = path.rpartition("/")[0]
    system.create_dir(folder, recursive=True)
    aside = f"{folder}/.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(aside, compression=None) as out:
        out.write(data)
    system.move(aside, path)


def read_file(uri: str) -> bytes:
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path, compression=None) as source:
        return source.read()


def dealt(manifest: DataFrame, files_per_task: int = 4) -> DataFrame:
    """A manifest's rows, a few files to a task: only files of tasks that ended stand in it, whatever other attempts left behind."""
    return manifest.repartition(max(1, -(-manifest.count() // files_per_task)))
