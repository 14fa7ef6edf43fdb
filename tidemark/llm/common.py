"""Reading tables, and tables kept in the shared folder of the cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, as in tests, a folder of the warehouse, which is shared too."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tidemark"


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def keep(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: this cuts the lineage, and any executor may be lost later.

    The files go when the driver's JVM ends, or by `discard` as soon as nothing needs them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def discard(*kept: DataFrame) -> None:
    """Removes tables made by `keep` that no later plan reads."""
    for df in kept:
        if path := getattr(df, "_tidemark_path", None):
            p, fs = _path(df.sparkSession, path)
            fs.delete(p, True)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def fraction(*cols: Column) -> Column:
    """A number from 0 to 1 that depends on the given values alone."""
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
