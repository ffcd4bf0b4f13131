"""What the operators share: durable intermediate tables, text constants, column names."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"

#: A side is broadcast only if its rows times their width stay below this many bytes.
BROADCAST_BYTES = 8 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of our own only where it is unset on a local master.

    A path without a scheme belongs to the default file system, as everywhere in Spark.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quittance-")
        spark.conf.set("spark.checkpoint.dir", root)
    root = root.rstrip("/")
    if "://" not in root:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        root = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        root = re.sub(r"^file:/(?!/)", "file:///", root)
    return root


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df to the shared folder as Parquet and return the table read back.

    A lost executor can then only cost the tasks of the step at hand.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Whether the shuffle files of a query go when it ends, and not when the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What save() shuffles inside is gone when the table is written.

    For the one operator whose exchanges carry whole texts.
    """
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Remove a table made by save() that no later step reads."""
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a written table may be broadcast: its counted rows at row_bytes each stay below limit."""
    return df.count() * row_bytes <= limit


def join_small(left: DataFrame, right: DataFrame, on, how: str, row_bytes: int) -> DataFrame:
    """Join with a written table: broadcast if its size is proven small, else Spark's shuffled join (AQE splits skew)."""
    return left.join(F.broadcast(right) if small(right, row_bytes) else right, on, how)


def let(value: Column, use) -> Column:
    """use(value) with value computed once (a lambda variable cannot be inlined again)."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """Array of the words of a text; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words without building them: the characters that follow white space or begin the text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with none of df's, whatever case they are in."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out
