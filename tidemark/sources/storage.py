"""Files of a shared store, through Hadoop's file systems."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's path under spark.checkpoint.dir; where that is unset, as in tests, under the warehouse, which is shared too."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tidemark"
    path = f"{at}/tidemark-{label}-{uuid.uuid4().hex}"
    p, fs = Store(spark, path).at("")
    fs.deleteOnExit(p)
    return path


def checked(spark: SparkSession, path: str) -> DataFrame:
    """Parquet read with the checksums of its pages verified: a page that has changed fails the read."""
    return spark.read.option("parquet.page.verify-checksum.enabled", "true").parquet(path)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm, self._conf, self._gateway = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def at(self, name: str):
        p = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return p, p.getFileSystem(self._conf)

    def names(self, folder: str) -> list[str]:
        p, fs = self.at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def exists(self, name: str) -> bool:
        p, fs = self.at(name)
        return fs.exists(p)

    def make(self, folder: str) -> None:
        p, fs = self.at(folder)
        fs.mkdirs(p)

    def remove(self, name: str) -> bool:
        p, fs = self.at(name)
        return fs.delete(p, True)

    def write(self, name: str, text: str) -> None:
        p, fs = self.at(name)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str:
        p, fs = self.at(name)
        opened = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
        finally:
            opened.close()

    def put_if_absent(self, name: str, text: str) -> bool:
        """Writes the whole file, or nothing and False if it exists. Atomic where links (local) or renames (HDFS) are; not on plain object stores."""
        temporary = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}.tmp"
        self.write(temporary, text)
        p, fs = self.at(name)
        t, _ = self.at(temporary)
        try:
            if fs.getUri().getScheme() == "file":
                local = lambda x: unquote(urlparse(x.toUri().toString()).path)
                try:
                    os.link(local(t), local(p))
                    return True
                except FileExistsError:
                    return False
            if fs.exists(p):
                return False
            kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
            try:
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self._conf).rename(t, p, self._gateway.new_array(kind, 0))
                return True
            except Exception:
                if fs.exists(p):
                    return False
                raise
        finally:
            fs.delete(t, False)
