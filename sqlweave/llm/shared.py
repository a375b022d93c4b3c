"""Tables that cut lineage, kept in the folder all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = 4


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; a temporary folder stands in only where it is unset and the master is local[*]."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="sqlweave-")
        spark.conf.set("spark.checkpoint.dir", folder) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return folder.rstrip("/")


def stage(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back; a lost executor costs no recomputation.

    narrow: rows of a few numbers that come out of a shuffle of such rows, so that no task of this step reads texts. They
    are written by FILES tasks a core of the cluster at most, and small tables between steps do not become a file for each
    shuffle partition."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sqlweave/{name}-{uuid.uuid4().hex}"
    (df.coalesce(FILES * spark.sparkContext.defaultParallelism) if narrow else df).write.parquet(path)
    if not narrow:
        release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def release(spark: SparkSession) -> None:
    """Shuffle files go when the driver's JVM finds that their plan is unused. It is asked to look after each wide step, so
    that a chain of them does not keep the shuffles of all."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete what stage() wrote for tables that nothing reads any more: a loop's last round, once the next is written."""
    for t in tables:
        if path := getattr(t, "_stage_path", None):
            spark = t.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def whole(docs: DataFrame):
    """A row's columns as one struct `row`, so that no name of theirs meets a name of a step's own; `row.*` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, folds: int):
    """crc32 of an id written as text, modulo folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
