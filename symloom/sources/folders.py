"""Small files below a folder that driver and executors share, through the file system that Spark reads it with."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the checkpoint folder, else the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/symloom-{name}-{uuid.uuid4().hex}"


class Folder:
    """Text files of a folder; a new file appears whole or not at all, and never replaces another."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._sc = root.rstrip("/"), spark.sparkContext
        self._jvm, self._conf = self._sc._jvm, self._sc._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self, name: str = "") -> list[str]:
        """Sorted names of what lies in a sub-folder; empty if there is none."""
        path = self._path(name)
        if not self._fs.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a new file under a name of its own and rename it; ``FileExistsError`` if another was first."""
        path, draft = self._path(name), self._path(f"{name}.{uuid.uuid4().hex}.draft")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self._conf)
        never_replace = self._sc._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, path, never_replace)
        except Exception as error:
            self._fs.delete(draft, False)
            if self._fs.exists(path):
                raise FileExistsError(self.path(name)) from error
            raise

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
