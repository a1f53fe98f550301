"""The checkpoint folder of the session, tables in it, and joins with few keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 1 << 24  # a map's broadcast has one row for each 64 of them at most
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoints(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir; only a session on one machine (master local) that names none gets a folder made."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="tidegraph-"))


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the checkpoint folder that nothing has used yet."""
    checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def append(df: DataFrame, path: str, *by: str) -> None:
    """Add rows to a table of the checkpoint folder; the exchanges that made them leave the disk at once."""
    conf = df.sparkSession.conf
    was = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.mode("append").option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        conf.unset(_CLEANUP) if was is None else conf.set(_CLEANUP, was)


def in_shares(df: DataFrame, key: Column, shares: int, label: str, then=lambda d: d) -> DataFrame:
    """`then` of the rows, a share of the keys' hashes at a time, as a table of the checkpoint folder: all rows are
    written, and the disk holds the exchanges of one share at once."""
    path = fresh_path(df.sparkSession, label)
    for i in range(shares):
        out = then(df if shares == 1 else df.filter(F.pmod(F.xxhash64(key, F.lit(label)), F.lit(shares)) == i))
        append(out, path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def split_by(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among `keys`, rows whose key is surely not); keys has one column of hashes (bigint).

    Their bits in a map of BITS are broadcast, whatever their number; a join that follows is to be exact.
    """
    bit = lambda c: F.pmod(c, F.lit(BITS))
    on = lambda c: F.expr(f"shiftleft(1L, cast({c} % 64 as int))")
    own = keys.select(bit(F.col(keys.columns[0])).alias("_f"))
    words = own.groupBy((F.col("_f") / 64).cast("int").alias("_word")).agg(F.bit_or(on("_f")).alias("_bits"))
    d = df.withColumn("_f", bit(key)).withColumn("_word", (F.col("_f") / 64).cast("int")).join(F.broadcast(words), "_word", "left")
    may = F.coalesce(F.col("_bits").bitwiseAND(on("_f")) != 0, F.lit(False))
    return d.filter(may).select(*df.columns), d.filter(~may).select(*df.columns)
