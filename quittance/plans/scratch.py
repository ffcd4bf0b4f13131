"""Tables written between steps, in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from quittance.errors import LedgerError


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own only where it is unset on a local master.

    A path without a scheme belongs to the default file system, as everywhere in Spark.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise LedgerError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quittance-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def files(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def there(spark: SparkSession, path: str) -> bool:
    fs, p = files(spark, path)
    return bool(fs.exists(p))


def some(df: DataFrame) -> bool:
    """Whether df has a row; all its partitions are looked at side by side, none further than its first row."""
    return df.limit(1).count() > 0


def written(df: DataFrame, name: str) -> DataFrame:
    """df cut from its lineage: written as Parquet and read back."""
    path = f"{root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
