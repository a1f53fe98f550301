"""Shared folder, table reading and small helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART_ROWS, PART_BYTES = 256, 8 << 20
FILTER_BITS = 1 << 24  # a filter's broadcast has one row for each 64 of them at most: 262 144 rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark alone, so any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a session on one machine (master local) may go without; it gets a temporary folder.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidegraph-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/tidegraph/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and outlives any executor."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that `stored` wrote, once what is made of them is stored itself."""
    for t in tables:
        remove(t.sparkSession, t._stored_at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop, whatever store holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def id_remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as the empty text."""
    as_text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.crc32(as_text.cast("binary")) % modulus


def parts(batches: Iterator[pa.RecordBatch], at: int, rows: int = PART_ROWS, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches of `rows` rows and about `size` bytes in the column `at`, at least a row each."""
    for batch in batches:
        column, lo = batch.column(at), 0
        while lo < batch.num_rows:
            n = min(rows, batch.num_rows - lo)
            while n > 1 and column.slice(lo, n).nbytes > size:
                n = max(1, n // 2)
            yield batch.slice(lo, n)
            lo += n


def split_by(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among `keys`, rows whose key is surely not), for a join that moves the former only.

    keys has one column of hashes (bigint). Their bits in a map of FILTER_BITS are broadcast, whatever their number; the
    more there are, the more rows may be among them, and the join that follows is exact anyway. A null key is in none.
    """
    bit = lambda c: F.pmod(c, F.lit(FILTER_BITS))
    on = lambda c: F.expr(f"shiftleft(1L, cast({c} % 64 as int))")
    own = keys.select(bit(F.col(keys.columns[0])).alias("_f"))
    words = own.groupBy((F.col("_f") / 64).cast("int").alias("_word")).agg(F.bit_or(on("_f")).alias("_bits"))
    d = df.withColumn("_f", bit(key)).withColumn("_word", (F.col("_f") / 64).cast("int")).join(F.broadcast(words), "_word", "left")
    may = F.coalesce(F.col("_bits").bitwiseAND(on("_f")) != 0, F.lit(False))
    clean = lambda x: x.select(*[F.col(f"`{c}`") for c in df.columns])
    return clean(d.filter(may)), clean(d.filter(~may))
