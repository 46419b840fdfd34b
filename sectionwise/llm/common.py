"""Shared plumbing: reserved column names, durable intermediate tables, size-checked joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a side that may be broadcast; beyond it the join is shuffled with salted keys.
BROADCAST_ROWS = 200_000
SALTS = 32


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """Folder that every executor can reach, from ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
        own = tempfile.mkdtemp(prefix="sectionwise-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = "file://" + own
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/") if "://" in base or not base.startswith("/") else "file://" + base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/sectionwise/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(spark.read.parquet(path).schema if partition_by else df.schema).parquet(path)
    out.durable_path_ = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes durable tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.durable_path_)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes all durable tables and files under the shared folder; call it once the results have been written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark)}/sectionwise")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` has not got, whatever its case rules."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def attach(big: DataFrame, small: DataFrame, on: list[tuple[str, str]], how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join a (durable) small side to a big one by null-safe keys and drop the small side's keys.

    ``small`` is counted first. Up to BROADCAST_ROWS it is broadcast; beyond that both sides are
    shuffled with SALTS salts on the big side, so one hot key does not fill one task.
    ``on`` holds (column of big, column of small); the small side's names must not occur in big.
    """
    n = small.count() if rows is None else rows
    if n <= BROADCAST_ROWS:
        cond = [F.col(b).eqNullSafe(F.col(s)) for b, s in on]
        return big.join(F.broadcast(small), cond, how).drop(*[s for _, s in on])
    salt_b, salt_s = fresh(big, "__salt_b", "__salt_s")
    # of the row itself, so that a task that is run again sends each row to the same place
    b = big.withColumn(salt_b, F.pmod(F.xxhash64(*[F.col(c.name) for c in big.schema if not isinstance(c.dataType, T.MapType)]), F.lit(SALTS)).cast("int"))
    s = small.withColumn(salt_s, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cond = [F.col(x).eqNullSafe(F.col(y)) for x, y in on] + [F.col(salt_b) == F.col(salt_s)]
    return b.join(s, cond, how).drop(salt_b, salt_s, *[y for _, y in on])


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\n\\t\\r]+")), F.lit(0))
