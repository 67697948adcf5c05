"""What the operators share: a place all executors see, staged tables, and chunks of bounded size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it isn't installed: its folder joins their path."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{env.get('PYTHONPATH', '')}".rstrip(":")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one where that is unset (a single machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(spark, "_riskloom_dir", None)
        if not folder:
            folder = spark._riskloom_dir = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries planned and ended within leave no shuffle files: Spark deletes them with the query, not with its plan.

    Only for what is written or collected once; a lost executor's part is still made anew while the query runs.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: this cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int, limit: int = 20_000) -> DataFrame:
    """Broadcast ``right`` only if its counted ``rows`` are at most ``limit``; else a shuffled join, split where skewed."""
    return left.join(F.broadcast(right) if rows <= limit else right, on, how)


#: Bits of the bitmap of ``perhaps_in``: at most BITMAP / 2^15 rows of 4 KB (4 MB) are broadcast, whatever the keys.
BITMAP = 1 << 25


def perhaps_in(df: DataFrame, column: str, keys: DataFrame, flag: str) -> DataFrame:
    """``df`` with the boolean ``flag``: false only where ``column`` (a hash) is none of ``keys`` (one hash column).

    The keys are kept as one bitmap of ``BITMAP`` places, so what is broadcast has a bound at any number of keys; a
    join of the rows flagged makes the answer exact. With very many keys more rows are flagged, none is missed.
    """
    bits, bucket = f"{flag}_bits", f"{flag}_bucket"
    at = lambda c: F.pmod(F.col(c), F.lit(BITMAP))
    place = lambda c: at(c).bitwiseAND(32767)
    key = keys.columns[0]
    table = keys.groupBy(F.shiftright(at(key), 15).alias(bucket)).agg(F.bitmap_construct_agg(place(key)).alias(bits))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.shiftright(place(column), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = F.coalesce(F.getbit(byte, place(column).bitwiseAND(7).cast("int")) == 1, F.lit(False))
    joined = df.join(F.broadcast(stage(table, "bitmap")), F.shiftright(at(column), 15) == F.col(bucket), "left")
    return joined.select(*[df[c] for c in df.columns], met.alias(flag))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds about ``limit`` bytes of ``column`` (a single longer value stays whole)."""
    for batch in batches:
        sizes = batch.column(column)
        lengths = pc.fill_null(pc.binary_length(sizes), 0).to_pylist()
        begin = total = 0
        for k, n in enumerate(lengths):
            if total and total + n > limit:
                yield batch.slice(begin, k - begin)
                begin, total = k, 0
            total += n
        if begin < len(lengths):
            yield batch.slice(begin)


def arrow_rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of ``schema`` from arrays or lists by name."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_, name__, ... that begins no column of ``df`` (in any case)."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name
