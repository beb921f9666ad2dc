"""The folder that driver and executors share, and its files as Hadoop sees them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; it must be set on a cluster. In local mode a temporary folder serves if it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        where = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, where, True)
        spark.conf.set("spark.checkpoint.dir", where := f"file://{where}")
        return where
    raise ValueError("spark.checkpoint.dir is not set: a folder that driver and executors share is needed")


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


class Folder:
    """Small files and sub-folders of one folder, in any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, below: str = "") -> list[str]:
        at = self._at(below)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def age_ms(self, name: str) -> int:
        return self.spark._jvm.System.currentTimeMillis() - self._fs.getFileStatus(self._at(name)).getModificationTime()

    def read(self, name: str) -> str:
        """A file's text; one whose name ends as a codec's files do is unpacked."""
        stream = self._fs.open(self._at(name))
        codec = self.spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(self.spark._jsc.hadoopConfiguration()).getCodec(self._at(name))
        stream = stream if codec is None else codec.createInputStream(stream)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file that must not exist yet; False if it does. It is seen whole or not at all: written aside, then renamed without
        overwriting, which is one step in HDFS."""
        files, options = self.spark._jvm.org.apache.hadoop.fs.FileContext, self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        aside = f".{uuid.uuid4().hex}.tmp"
        self._fs.mkdirs(self._at(name).getParent())
        stream = self._fs.create(self._at(aside), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        none = self.spark.sparkContext._gateway.new_array(options, 1)
        none[0] = options.NONE
        try:
            files.getFileContext(self._at("").toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._at(aside), self._at(name), none)
            return True
        except Exception as e:  # py4j wraps what the store raises
            if "FileAlreadyExists" not in str(e) and not self._fs.exists(self._at(name)):
                raise
            self._fs.delete(self._at(aside), False)
            return False

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def kept(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The same rows from a table in the shared folder: worked out once, lineage ends there, and any executor can read them again. With by, a column of
    few values that are never null or empty, each value has a folder of its own, and who asks for some of them reads these only."""
    path = fresh(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
