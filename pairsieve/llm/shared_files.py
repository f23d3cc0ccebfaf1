"""Plain files in the shared folder, written and read by tasks."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme under which Spark itself reads and writes it; asked on the driver, for the tasks."""
    plain = spark._jvm.org.apache.hadoop.fs.Path(path)
    return plain.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(plain).toString()


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a qualified folder; an unknown scheme fails."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    if "://" not in path:
        raise ValueError(f"{path} has no scheme; a task can't tell on which file system it lies")
    return fs.FileSystem.from_uri(path)


class NewFile:
    """A file under a name of its own; another attempt of the same task never meets it."""

    def __init__(self, folder: str, label: str):
        self.system, base = place(folder)
        self.system.create_dir(base, recursive=True)
        self.name = f"{label}-{uuid.uuid4().hex}"
        self.stream = self.system.open_output_stream(f"{base}/{self.name}")

    def write(self, values: np.ndarray) -> None:
        self.stream.write(np.ascontiguousarray(values).tobytes())

    def close(self) -> str:
        self.stream.close()
        return self.name


def mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped on a local or mounted folder, else read through its file system."""
    system, base = place(folder)
    info = system.get_file_info(f"{base}/{name}")
    if info.size == 0:
        return np.zeros(0, dtype=dtype)
    if isinstance(system, fs.LocalFileSystem):
        return np.frombuffer(pa.memory_map(f"{base}/{name}", "r").read_buffer(), dtype=dtype)
    with system.open_input_file(f"{base}/{name}") as f:
        return np.frombuffer(f.readall(), dtype=dtype)
