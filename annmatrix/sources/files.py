"""Small files of a store through Hadoop's file systems, so that any path Spark reads will do."""

from __future__ import annotations

import json
from typing import Any

from pyspark import SparkContext
from pyspark.sql import SparkSession


class Files:
    """Text files, folders and renames below one path."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        path = self.path()
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def is_dir(self, name: str = "") -> bool:
        return self.exists(name) and self.fs.getFileStatus(self.path(name)).isDirectory()

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def make(self, name: str = "") -> None:
        self.fs.mkdirs(self.path(name))

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.path(name), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Writes beside the file and renames, so that a reader sees the old or the new text."""
        temporary = self.path(f"{name}.new")
        stream = self.fs.create(temporary, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = SparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri()).rename(self.fs.makeQualified(temporary), self.fs.makeQualified(self.path(name)), options)

    def read_json(self, name: str, default: Any = None) -> Any:
        return json.loads(self.read(name)) if self.exists(name) else default

    def write_json(self, name: str, value: Any) -> None:
        self.write(name, json.dumps(value, indent=1, sort_keys=True))
