"""Helpers shared by the training-data operators: checkpoints, table reading, arrow slicing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import lean  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark alone (the store may be one that only Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints and tables: the session's, or ``spark.checkpoint.dir``.

    Only a local master, as in tests, gets a temporary one; elsewhere a missing setting is an error, as other
    machines would not see a folder of the driver's.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def named(column: str):
    """A column by its very name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def hot_join(rows: DataFrame, keyed: DataFrame, key: str, count: str, by: str, least: int = 256) -> DataFrame:
    """``rows`` joined with ``keyed`` (one row a key, with the ``count`` of rows that hold it), hot keys split.

    A key is hot if it holds over a thousandth of all rows (and over ``least``), so there are fewer than a
    thousand of them, and only those are broadcast. Their rows are dealt by ``by`` over as many salts as they
    fill, and their one row of ``keyed`` goes to each salt.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    big = max(least, total // 1000)
    salts = F.when(F.col(count) > big, F.ceil(F.col(count) / big)).otherwise(1).cast("int")
    hot = keyed.filter(F.col(count) > big).select(F.col(key).alias("_hot"), salts.alias("_salts"))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_hot", "_salts")
    return dealt.join(keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))), [key, "_salt"]).drop("_salt", count)


def parts(df: DataFrame, factor: float = 1.0) -> int:
    """Shuffle partitions of the session, times a factor, at least one."""
    return max(1, round(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * factor))


def parts_by_size(df: DataFrame, mb: float = 2.0) -> int:
    """Parts of about ``mb`` megabytes of the optimizer's estimate of ``df``: at least two for each core, at most
    four for each shuffle partition (also where there is no estimate)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, min(parts(df, 4), round(size / (mb * 1e6))))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the cluster's shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` wrote and nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
