"""Files on whatever file system Spark reads: listing, exclusive creation, deletion."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def age(self, path: str) -> float:
        """Seconds since the last change of a file or of a folder's entries."""
        fs, p = self._at(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def write(self, path: str, body: str) -> None:
        fs, p = self._at(path)
        out = fs.create(p, True)
        try:
            out.write(body.encode())
        finally:
            out.close()

    def create(self, path: str, body: str) -> bool:
        """Put a whole file at ``path``, unless something is there: then nothing happens and the result is False.

        The file is written under another name and renamed, which fails if the name is taken: a reader sees all
        of it or nothing, and of two writers one wins.
        """
        folder, _, name = path.rpartition("/")
        draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
        self.write(draft, body)
        fs, source = self._at(draft)
        target = self.jvm.org.apache.hadoop.fs.Path(path)
        source, target = fs.makeQualified(source), fs.makeQualified(target)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(source, target, none)
            return True
        except Exception:
            fs.delete(source, False)
            if fs.exists(target):
                return False
            raise

    def read(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]
